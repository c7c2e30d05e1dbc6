"""Licences by the digest of a canonical text, looked up with a hash join; built-in functions only.

The canonical text is lower case, without copyright lines and list markers, with one space for
whatever is neither a letter a-z nor a digit, and with one of several usual spellings. A document
whose whole canonical text has a known digest is that licence's text; a line whose canonical text is
a known notice puts the document under the notice's licence.

Defined cases: null and empty texts, and such without a letter or digit, have the digest of the empty
text and no licence; licences of notices are listed once, sorted; equal documents get equal rows;
known texts that are empty match nothing; further columns are not looked at; very long texts
and lines are canonicalised whole, in some ten times their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.llm.license_texts import DIGESTS, NOTICES, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Regular expressions and what takes their place; ``^`` is the start of a line.
PATTERNS = [
    (r"^[^a-z0-9\n]*((portions )?copyright[ \t]*(\(c\)|©|:|by |[0-9]{4}|<|\[)|\(c\)[ \t]|©)[^\n]*", ""),
    (r"^[ \t]*([0-9]{1,2}[.)]|\([a-z0-9]{1,2}\)|[*-])[ \t]+", ""),
    (r"[^a-z0-9\n]+", " "),
    (r"\n", " \n "),
]

# Spellings to be treated as equal, the second for the first.
SPELLINGS = [
    (" acknowledgement", " acknowledgment"),
    (" analogue", " analog"),
    (" analyse", " analyze"),
    (" artefact", " artifact"),
    (" authoris", " authoriz"),
    (" cancelled", " canceled"),
    (" catalogue", " catalog"),
    (" categoris", " categoriz"),
    (" centre", " center"),
    (" emphasis", " emphasiz"),
    (" favour", " favor"),
    (" fulfil ", " fulfill "),
    (" fulfilment", " fulfillment"),
    (" https ", " http "),
    (" initialis", " initializ"),
    (" judgement", " judgment"),
    (" labelling", " labeling"),
    (" labour", " labor"),
    (" licence", " license"),
    (" maximis", " maximiz"),
    (" modelled", " modeled"),
    (" modelling", " modeling"),
    (" offence", " offense"),
    (" optimis", " optimiz"),
    (" organis", " organiz"),
    (" practise", " practice"),
    (" programme ", " program "),
    (" realis", " realiz"),
    (" recognis", " recogniz"),
    (" signalling", " signaling"),
    (" utilis", " utiliz"),
    (" whilst ", " while "),
]


# The same for phrases, within a line first, then over the ends of lines.
PHRASES = [
    (" all rights reserved ", " "),
    (" copyright holder", " copyright owner"),
    (" non commercial", " noncommercial"),
    (" non infringement", " noninfringement"),
    (" per cent", " percent"),
    (" sub license", " sublicense"),
    (" third part", " thirdpart"),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form of a text's lines, parted by line feeds, spaces around each."""
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, by in PATTERNS:
        x = F.regexp_replace(x, "(?md)" + pattern, by)
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for one, other in SPELLINGS + PHRASES:
        x = F.replace(x, F.lit(one), F.lit(other))
    return x


def flat(lines: Column) -> Column:
    """The canonical form of a text from that of its lines."""
    x = F.regexp_replace(lines, "[ \n]+", " ")
    for one, other in PHRASES:
        x = F.replace(x, F.lit(one), F.lit(other))
    return F.trim(x)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return flat(canonical_lines(text))


def _lines_sql(text: str) -> str:
    x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, by in PATTERNS:
        x = f"regexp_replace({x}, '(?m){pattern}', '{by}', 'g')" if pattern != "\\n" else f"replace({x}, chr(10), ' ' || chr(10) || ' ')"
    x = f"(' ' || {x} || ' ')"
    for one, other in SPELLINGS + PHRASES:
        x = f"replace({x}, '{one}', '{other}')"
    return x


def _flat_sql(lines: str) -> str:
    x = f"regexp_replace({lines}, '[ \\n]+', ' ', 'g')"
    for one, other in PHRASES:
        x = f"replace({x}, '{one}', '{other}')"
    return f"trim({x})"


def canonical_sql(text: str) -> str:
    """``canonical`` in DuckDB's SQL."""
    return _flat_sql(_lines_sql(text))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of known texts; of licences with one text, the first by name."""
    rows = spark.createDataFrame(texts, "license string, text string").select("license", canonical(F.col("text")).alias("c"))
    return rows.where("c <> ''").select(F.sha2("c", 256).alias("digest"), "license").distinct()


def scan(docs: DataFrame, texts: DataFrame, notices: DataFrame, most_notices: int = 10_000, broadcast_texts: int = 1_000_000) -> DataFrame:
    """Per document: canonical digest, the licence whose text it is, the licences its lines declare.

    ``texts`` and ``notices`` (digest, license) are tables of any origin. Documents are read once. Up to ``most_notices``
    notices, counted first, lines are looked up where they are; more are joined with the lines. Up to ``broadcast_texts``
    texts go to every task, more are joined by a shuffle of digests.
    """
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    digests = lambda: F.transform(F.array_distinct(F.split("lines", "\n")), lambda x: F.sha2(flat(x), 256))
    rows = rows.select("doc_id", F.sha2(flat(F.col("lines")), 256).alias("canonical_sha256"), digests().alias("found"))
    known_notices = notices.groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("ids"))
    few = known_notices.limit(most_notices + 1).collect()
    if len(few) <= most_notices:
        listed = F.array(*[F.lit(r["digest"]) for r in few]).cast("array<string>")
        ids = F.create_map(*[x for r in few for x in (F.lit(r["digest"]), F.array(*[F.lit(i) for i in r["ids"]]))]) if few else None
        names = F.flatten(F.transform(F.array_intersect("found", listed), lambda d: F.element_at(ids, d))) if few else F.array().cast("array<string>")
        rows = rows.select("doc_id", "canonical_sha256", names.alias("names"))
    else:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        lines = numbered.select("row", F.explode("found").alias("digest")).join(known_notices, "digest")
        named = lines.groupBy(F.col("row").alias("at")).agg(F.flatten(F.collect_set("ids")).alias("names"))
        rows = numbered.join(named, F.col("row") == F.col("at"), "left").select("doc_id", "canonical_sha256", "names")
    whole = texts.groupBy("digest").agg(F.min("license").alias("license")).withColumnRenamed("digest", "canonical_sha256")
    whole = F.broadcast(whole) if whole.count() <= broadcast_texts else whole
    shown = F.array_join(F.array_sort(F.array_distinct(F.coalesce("names", F.array().cast("array<string>")))), ",").alias("notices")
    return rows.join(whole, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", shown)


def default_texts(spark: SparkSession) -> DataFrame:
    """The texts of ``TEXTS``, with their titles or without, and those of ``DIGESTS``."""
    short = known(spark, [(i, t) for i, _, t in TEXTS] + [(i, f"{title}\n\n{t}") for i, title, t in TEXTS])
    return short.unionByName(spark.createDataFrame([(d, i) for i, d in DIGESTS], "digest string, license string"))


def default_notices(spark: SparkSession) -> DataFrame:
    return known(spark, NOTICES)


def scan_sql() -> str:
    """``scan`` of ``documents`` for the texts and notices above, in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quote(i)}, {quote(t)})" for i, t in rows)
    table = lambda rows: f"(SELECT sha256(c) AS digest, min(license) AS license FROM (SELECT license, {canonical_sql('t')} AS c FROM (VALUES {values(rows)}) AS v(license, t)) WHERE c <> '' GROUP BY 1)"
    texts = [(i, t) for i, _, t in TEXTS] + [(i, f"{title}\n\n{t}") for i, title, t in TEXTS]
    return f"""
WITH t AS (SELECT * FROM {table(texts)} UNION ALL SELECT * FROM (VALUES {values([(d, i) for i, d in DIGESTS])}) AS v(digest, license)), n AS {table(NOTICES)},
d AS (SELECT *, sha256({_flat_sql('lines')}) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text, {_lines_sql('text')} AS lines FROM documents)),
l AS (SELECT doc_id, text, unnest(string_split(lines, chr(10))) AS line FROM d),
m AS (SELECT DISTINCT doc_id, text, license FROM (SELECT doc_id, text, sha256({_flat_sql('line')}) AS digest FROM l) JOIN n USING (digest)),
g AS (SELECT doc_id, text, string_agg(license, ',' ORDER BY license) AS notices FROM m GROUP BY doc_id, text)
SELECT d.doc_id, d.digest AS canonical_sha256, t.license, coalesce(g.notices, '') AS notices
FROM d LEFT JOIN t ON t.digest = d.digest LEFT JOIN g ON g.doc_id = d.doc_id AND g.text = d.text"""
