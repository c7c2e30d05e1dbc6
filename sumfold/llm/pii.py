"""Personal data by patterns of form, and by contexts bootstrapped from what these find; built-in functions only.

Base spans are matches of four forms (e-mail addresses, IP addresses, payment cards, telephone numbers) that pass the form's check.
They are the seeds. Every text is also cut into identifiers: whatever has one of the forms, and words with four digits or an at
sign. An identifier's contexts are its lexical patterns: the three words before it, the two before it, and the one before with the
one after it, in lower case, digits alike. Patterns and identifiers are a graph, of distinct identifiers whatever their number
of copies, and are scored in turns, for each kind:

* a pattern's score is the sum of its identifiers' scores, over their number and a half; it counts if the sum is 3 or more and the score 0.8 or more;
* an identifier's score is 1 less the product of (1 - score) of its patterns that count; that of a seed is 1.

After the last turn, identifiers that are no base spans are added as spans of the kind whose patterns found them, if their own shape is
possible for that kind and they overlap no base span. Seeds of one round and what it finds so induce the patterns of the next.

Defined cases: null is the empty text, which has no spans; ids may be null or repeat, a row's result is its own; equal texts have equal
spans; offsets are code points, ends exclusive; an empty table gives no rows; further columns are not looked at; very long texts are
searched whole by one task, in time in proportion to them, and matches to the power of 1.5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone")

#: The forms, so that no position is looked at twice: possessive, and entered only at the start of a run of characters.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+/-]*+[0-9@](?:[._%+@/-]*+[A-Za-z0-9]++)*+"
IDENTIFIER = "|".join(f"(?:{x})" for x in [*FORMS.values(), _WORD])

#: Characters of the text before and after an identifier that its contexts are taken from.
BEFORE, AFTER = 64, 32
SUPPORT, CONFIDENCE, ROUNDS = 3.0, 0.8, 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.split(F.reverse(digits), "")
    added = F.transform(turned, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(added, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a form passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.ltrim(x, F.lit("0")).rlike(r"\A(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))


def possible(kind: str, value: Column) -> Column:
    """Whether an identifier found by its context may be of a kind."""
    if kind == "email":
        return value.rlike("[A-Za-z]")
    if kind == "ip":
        return value.rlike(r"\A[0-9A-Fa-f.]+\z")
    return F.length(_digits(value)).between(12, 19) if kind == "card" else F.length(_digits(value)).between(7, 15)


def _running(rows: DataFrame, of: str) -> DataFrame:
    """With the running sums of an array of lengths in its place, by pieces of as many items as there are pieces."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(of))).cast("int"))
    pieces = F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / width).cast("int")), lambda j: F.slice(of, j * width + 1, width)))

    def sums(items: Column, first: Column) -> Column:
        """The first value, and what comes after each item."""
        return F.aggregate(items, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    rows = rows.withColumn(of, F.coalesce(pieces, F.array()))
    totals = F.transform(of, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    each = F.transform(F.arrays_zip(F.col(of).alias("p"), sums(totals, F.lit(0)).alias("first")), lambda x: F.when(x["p"].isNotNull(), F.slice(sums(x["p"], x["first"]), 2, F.size(x["p"]))))
    return rows.withColumn(of, F.flatten(F.filter(each, lambda x: x.isNotNull())))


def matched(rows: DataFrame, form: str, to: str, context: bool = False) -> DataFrame:
    """``rows`` with the matches of ``form`` in ``text`` as an array of (start, end, value), and what is before and after each if asked for."""
    n = F.size("_m")
    rows = rows.withColumn("_m", F.regexp_extract_all("text", F.lit(form), F.lit(0)))
    rows = rows.withColumn("_p", F.when(n > 0, F.split("text", form, -1)).otherwise(F.array().cast("array<string>")))
    # lengths of what is before each match, from the end of the one before it
    shifted = F.when(n > 0, F.concat(F.array(F.lit("")), F.slice("_m", 1, n - 1))).otherwise(F.col("_m"))
    rows = rows.withColumn("_s", F.zip_with(F.slice("_p", 1, n), shifted, lambda p, m: F.length(p) + F.length(m)))
    rows = _running(rows, "_s")
    if not context:
        found = F.zip_with("_s", "_m", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
        return rows.withColumn(to, found).drop("_m", "_p", "_s")
    left = F.transform(F.slice("_p", 1, n), lambda p, i: F.right(F.when(i > 0, F.concat(F.lit("#"), p)).otherwise(p), F.lit(BEFORE)))
    right = F.transform(F.slice("_p", 2, n), lambda p: F.left(p, F.lit(AFTER)))
    zipped = F.arrays_zip(F.col("_s").alias("s"), F.col("_m").alias("m"), left.alias("l"), right.alias("r"))
    found = F.transform(zipped, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("value"), x["l"].alias("before"), x["r"].alias("after")))
    return rows.withColumn(to, found).drop("_m", "_p", "_s")


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with an array of spans (start, end, value) per kind."""
    for kind in KINDS:
        docs = matched(docs, FORMS[kind], kind)
        docs = docs.withColumn(kind, F.filter(kind, lambda x: passes(kind, x["value"])))  # noqa: B023
    return docs


def seed_kind(value: Column) -> Column:
    """The number of the kind whose form and check an identifier passes, or null."""
    return F.coalesce(*[F.when(value.rlike(rf"\A(?:{FORMS[k]})\z") & passes(k, value), F.lit(i)) for i, k in enumerate(KINDS)])


def _words(window: Column) -> Column:
    shown = F.translate(F.lower(window), "123456789", "000000000")
    return F.filter(F.split(shown, r"\s+"), lambda x: x != "")


def contexts(before: Column, after: Column) -> Column:
    """An identifier's lexical patterns."""
    left, right = F.concat(F.array(F.lit("^"), F.lit("^"), F.lit("^")), _words(before)), F.concat(_words(after), F.array(F.lit("$")))
    item = lambda words, at: F.element_at(words, at)
    three = F.concat_ws(" ", F.lit("3"), item(left, -3), item(left, -2), item(left, -1))
    two = F.concat_ws(" ", F.lit("2"), item(left, -2), item(left, -1))
    around = F.concat_ws(" ", F.lit("1"), item(left, -1), F.lit("*"), item(right, 1))
    return F.array(three, two, around)


def identifiers(found: DataFrame) -> DataFrame:
    """(row, start, end, value, kind, id, patterns): seeds, whose kind is known, and words that may be identifiers."""
    rows = found.select("row", F.explode("identifiers").alias("x")).select("row", "x.*")
    rows = rows.withColumn("kind", seed_kind(F.col("value")))
    rows = rows.where(F.col("kind").isNotNull() | F.col("value").contains("@") | (F.length(_digits(F.col("value"))) >= 4))
    return rows.select("row", "start", "end", "value", "kind", F.xxhash64("value").alias("id"), contexts(F.col("before"), F.col("after")).alias("patterns"))


def bootstrapped(found: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, kind, score) that count and identifiers' scores (id, kind, score), after so many turns.

    ``found`` is a table of ``identifiers``.
    """
    each = found.select(F.explode("patterns").alias("pattern"), "id", "kind")
    # copies of a text, however many, are one edge
    edges = written(each.groupBy("pattern", "id").agg(F.min("kind").alias("kind")), "edges")
    seeds = edges.where("kind IS NOT NULL").groupBy("id", "kind").agg(F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = seeds = written(seeds, "scores")
    edges = edges.select("pattern", "id")
    for _ in range(rounds):
        sums = edges.join(scores, "id").groupBy("pattern", "kind").agg(F.sum("score").alias("s")).where(F.col("s") >= support - 1e-9)
        counting = sums.join(sizes, "pattern").withColumn("score", F.col("s") / (F.col("n") + 0.5)).where(F.col("score") >= confidence)
        patterns = written(counting.select("pattern", "kind", "score"), "patterns")
        least = F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(1 - 1e-9)))))
        more = edges.join(patterns, "pattern").groupBy("id", "kind").agg((1 - least).alias("score"))
        scores = written(seeds.unionByName(more).groupBy("id", "kind").agg(F.max("score").alias("score")), "scores")
    return patterns, scores


def discovered(found: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(row, kind, start, end): identifiers without a form, in a pattern that counts, by the kind of the highest score."""
    patterns, scores = bootstrapped(found, support, confidence, rounds)
    unseen = found.where("kind IS NULL").select("row", "start", "end", "value", "id", F.explode("patterns").alias("pattern"))
    hits = unseen.join(patterns.select("pattern", "kind"), "pattern")
    fits = reduce(lambda a, k: a.when(F.col("kind") == k[0], possible(k[1], F.col("value"))), enumerate(KINDS), F)
    hits = hits.where(fits).join(scores.where(F.col("score") >= confidence), ["id", "kind"])
    best = hits.groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("best"))
    return best.select("row", F.col("best.kind").alias("kind"), "start", "end")


def spans(docs: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, and per kind an array of base spans (start, end, value); ``added`` has (kind, start, end) of the others."""
    rows = matched(base(texts(docs)), IDENTIFIER, "identifiers", context=True)
    # the row's number is fixed by writing it
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, "identifiers"), "spans")
    found = written(identifiers(rows), "identifiers")
    more = discovered(found, support, confidence, rounds).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    out = rows.drop("identifiers").join(more, "row", "left")
    held = F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    free = F.filter("added", lambda a: ~F.exists(held, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return out.select("doc_id", *KINDS, F.coalesce(F.when(F.col("added").isNotNull(), free), F.array()).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """Per row of ``spans``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    name = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    own = F.concat(*[F.transform(k, lambda x: shown(F.lit(k), x)) for k in KINDS])  # noqa: B023
    all_ = F.concat("added", *[F.transform(k, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))) for i, k in enumerate(KINDS)])  # noqa: B023
    every = F.transform(F.sort_array(all_), lambda x: shown(F.element_at(name, x["kind"] + 1), x))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(own, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size("added").cast("bigint").alias("n_added"))
