"""Merkle manifest of a table: a digest tree per source, the sources' roots under one root, and a proof for every row.

A row's leaf is the digest of its columns, each written with its length. A leaf's place in its source follows from histograms of the
id's digits, as in a radix sort that moves counts instead of rows: rows are counted by id, ids by their leading
bits and so on up to a few leading digits; then each digit's rows before it, among at most 1024 siblings, are added from the
top down. Rows that share an id are ranked the same way by the digits of their leaves. No rows are sorted as a whole, and no
source is held by one task.

A place in base 3 spells the way from the root to the leaf: nodes are keyed by prefixes of it and reduced from the longest
prefix up, five digits (a block of 243 nodes) a shuffle. From the top down each block then hands its nodes the
siblings on their way to the root.

Defined cases: null columns count as ``-``, which no value is written as; a null id comes before all others, a null source
before all others and is a source of its own; rows of one id follow each other by leaf, and rows that are equal in all five
columns take places of their own next to each other; a source of one row is its leaf; an empty table gives no rows and has no
root; further columns are not looked at; a very long text is digested by one task, in some three times its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.functions.radix import numbered
from sumfold.llm.common import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of the tree that one shuffle reduces.
LEVELS = 5
BLOCK = FANOUT**LEVELS
#: Bits of an id that are one digit, and hexadecimal digits of a leaf that are one.
BITS, NIBBLES = 10, 3
#: Equal rows are written out in pieces of so many.
PIECE = 1 << 16


def digest(values: list[Column]) -> Column:
    """The digest of a row's values, each with its length in bytes."""

    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(shown, values)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(g, k, leaf, changed): a row's source as a key that is never null, its id, its digest, and the digest it has with ``tampered`` for a text."""
    values = [F.col(c) for c in COLUMNS]
    leaf = digest(values)
    changed = leaf if tampered is None else F.when(tampered.isNull() | (tampered == F.col("text")), leaf).otherwise(digest([*values[:-1], tampered]))
    group = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    return docs.select(group.alias("g"), F.col("doc_id").cast("bigint").alias("k"), leaf.alias("leaf"), changed.alias("changed"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal; the right side's keys go."""
    right = right.withColumnsRenamed({c: f"_r{c}" for c in keys})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys])
    return left.join(right, on).drop(*[f"_r{c}" for c in keys])


def _before(keys: list[str], order: list[str], n: str = "n") -> Column:
    """The sum of ``n`` over the rows of ``keys`` that come before."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(window), F.lit(0).cast("bigint"))


def starts(counts: DataFrame) -> DataFrame:
    """(g, k, n, start) from (g, k, n): how many rows of the source have a smaller id, by histograms of the id's digits."""
    low, high = counts.agg(F.min("k"), F.max("k")).first()
    levels = 0
    while low is not None and (high >> BITS * levels) - (low >> BITS * levels) >= 1 << BITS:
        levels += 1
    histograms = [counts.select("g", F.col("k").alias("p"), "n")]
    for _ in range(levels):
        histograms.append(histograms[-1].groupBy("g", F.shiftright("p", BITS).alias("p")).agg(F.sum("n").alias("n")))
    out = histograms[-1].withColumn("start", _before(["g"], ["p"]))
    for h in reversed(histograms[:-1]):
        above = out.select("g", F.col("p").alias("up"), F.col("start").alias("above"))
        out = _joined(h.withColumn("up", F.shiftright("p", BITS)), above, ["g", "up"])
        out = out.select("g", "p", "n", (F.col("above") + _before(["g", "up"], ["p"])).alias("start"))
    return out.withColumnRenamed("p", "k")


def _tied(rows: DataFrame) -> DataFrame:
    """Places of rows that share an id, by the digits of their leaves; equal rows are counted first and written out last."""
    keys = ["g", "k"]
    kinds = rows.groupBy(*keys, "leaf", "changed").agg(F.min("start").alias("start"), F.count("*").alias("n"))
    kinds = written(kinds.withColumn("p1", F.substring("leaf", 1, NIBBLES)).withColumn("p2", F.substring("leaf", 1, 2 * NIBBLES)), "tied")
    second = kinds.groupBy(*keys, "p1", "p2").agg(F.sum("n").alias("n"))
    first = second.groupBy(*keys, "p1").agg(F.sum("n").alias("n"))
    first = first.select(*keys, "p1", _before(keys, ["p1"]).alias("b1"))
    second = _joined(second, first, [*keys, "p1"]).select(*keys, "p2", (F.col("b1") + _before([*keys, "p1"], ["p2"])).alias("b2"))
    placed = _joined(kinds, second, [*keys, "p2"])
    placed = placed.select(*keys, "leaf", "changed", "n", (F.col("start") + F.col("b2") + _before([*keys, "p2"], ["leaf", "changed"])).alias("start"))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PIECE)))).repartition("leaf", "piece")
    size = F.least(F.lit(PIECE).cast("bigint"), F.col("n") - PIECE * F.col("piece"))
    pieces = pieces.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)))
    return pieces.select(*keys, "leaf", "changed", (F.col("start") + PIECE * F.col("piece") + F.col("nth")).alias("pos"))


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(g, k, leaf, changed, pos): each leaf's place in its source, from 0."""
    out = _joined(rows, starts(counts), ["g", "k"])
    alone = out.where("n = 1").select("g", "k", "leaf", "changed", F.col("start").alias("pos"))
    return alone.unionByName(_tied(out.where("n > 1")))


def _run(level: Column, i: Column) -> Column:
    """The digest of the run of three that starts at 3 i."""
    return F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), ""), 256)


def _blocks(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, pos, m, items, l0 ... l5): nodes (g, pos, h, row) in blocks, with the digests of each of the block's levels.

    ``m`` is how many nodes the whole tree has; a tree that has come down to one node stays as it is.
    """
    item = F.struct("pos", "h", "row")
    out = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = _joined(out, sizes, ["g"]).select("g", F.col("block").alias("pos"), "m", "items", F.transform("items", lambda x: x["h"]).alias("l0"))
    for i in range(LEVELS):
        below = F.col(f"l{i}")
        up = F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int")), lambda j: _run(below, j))  # noqa: B023
        out = out.withColumn(f"l{i + 1}", F.when(F.col("m") > FANOUT**i, up).otherwise(below))
    return out


def _way(p: Column) -> Column:
    """The siblings of the block's node ``p`` from the block's lowest level up, those before it and those after it."""
    steps = []
    for i in range(LEVELS):
        at = F.floor(p / FANOUT**i).cast("int")
        first = (F.floor(at / FANOUT) * FANOUT).cast("int")
        level = F.col(f"l{i}")
        step = F.struct(F.array_join(F.slice(level, first + 1, at - first), "").alias("before"), F.array_join(F.slice(level, at + 2, first + 2 - at), "").alias("after"))
        steps.append(F.when(F.col("m") > FANOUT**i, step))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def _tree(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (g, h) of trees over nodes (g, pos, h, row), ``sizes`` (g, m) of them, and the blocks of each round."""
    most, rounds = sizes.agg(F.max("m")).first()[0] or 1, []
    while True:
        rounds.append(written(_blocks(nodes, sizes), "blocks"))
        nodes = rounds[-1].select("g", "pos", F.element_at(f"l{LEVELS}", 1).alias("h"), F.lit(None).cast("string").alias("row"))
        sizes = sizes.select("g", F.ceil(F.col("m") / BLOCK).cast("bigint").alias("m"))
        most = -(-most // BLOCK)
        if most == 1:
            return nodes.select("g", "h"), rounds


def _ways(rounds: list[DataFrame], roots: DataFrame, *keep: str) -> DataFrame:
    """(g, pos, item, way, keep): every lowest node with the siblings on its way up, then those of its tree's root in ``roots``."""
    above = roots.select("g", F.lit(0).cast("bigint").alias("pos"), "way", *keep)
    for blocks in reversed(rounds):
        both = _joined(blocks, above.withColumnRenamed("way", "above"), ["g", "pos"])
        both = both.select("g", F.explode(F.transform("items", lambda x: F.struct(x.alias("item"), _way((x["pos"] % BLOCK).cast("int")).alias("way")))).alias("x"), "above", *keep)
        above = both.select("g", F.col("x.item.pos").alias("pos"), F.concat("x.way", "above").alias("way"), F.col("x.item").alias("item"), *keep)
        out, above = above, above.drop("item")
    return out


def folded(leaf: Column, way: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(way, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, pos, leaf, subroot, root, way, changed.

    ``way`` has, level by level from the leaf to the root, the concatenated digests of the siblings ``before`` and ``after``;
    ``changed`` is the leaf that the row has with ``tampered`` in place of its text (null: as it is).
    """
    rows = written(leaves(docs, tampered), "leaves")
    counts = written(rows.groupBy("g", "k").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("g").agg(F.sum("n").alias("m"))
    nodes = ranked(rows, counts).select("g", "pos", F.col("leaf").alias("h"), F.struct("k", "changed").alias("row"))
    roots, rounds = _tree(nodes, sizes)
    roots = written(roots, "roots")
    # sources, in the order of their names, are the leaves of one more tree
    named = _joined(roots, numbered(roots, "g"), ["g"]).select(F.lit("").alias("g"), F.col("number").alias("pos"), "h", F.col("g").alias("row"))
    root, upper = _tree(named, roots.agg(F.count("*").alias("m")).select(F.lit("").alias("g"), "m"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    upper = _ways(upper, root.select("g", none.alias("way"), F.col("h").alias("root")), "root")
    upper = upper.select(F.col("item.row").alias("g"), "way", F.col("item.h").alias("subroot"), "root")
    out = _ways(rounds, upper, "subroot", "root")
    source = F.when(F.substring("g", 1, 1) == "1", F.expr("substring(g, 2)"))
    return out.select(F.col("item.row.k").alias("doc_id"), source.alias("source"), "pos", F.col("item.h").alias("leaf"), "subroot", "root", "way", F.col("item.row.changed").alias("changed"))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: ``manifest`` with its ways folded."""
    rows = manifest(docs, tampered)
    siblings = F.array_join(F.transform("way", lambda x: F.concat(x["before"], x["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("changed"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines_in_half() -> Column:
    """The text without its newlines where 2 divides the CRC-32 of the id in decimal digits; elsewhere as it is."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def proofs_sql(levels: int = 12, upper: int = 5) -> str:
    """``proofs`` of ``documents``, with tampering in half of them, for sources of up to 3^levels rows and 3^upper sources."""
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten({digits})), lambda a, x: {step}), 4294967295)"

    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END" for v in values) + "))"

    def tree(name: str, first: str, count: int) -> str:
        """CTEs {name}0 (g, p, h, n), {name}1 ... of nodes by level, and {name}r0 ... of runs."""
        out = f"{name}0 AS ({first})"
        for i in range(count):
            out += f""",
{name}r{i} AS (SELECT g, p // 3 AS p, any_value(n) AS n, list(h ORDER BY p) AS hs FROM {name}{i} GROUP BY g, p // 3),
{name}{i + 1} AS (SELECT g, p, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 2) // 3 AS n FROM {name}r{i})"""
        return out

    def climb(name: str, count: int, start: str, to: str) -> str:
        """CTEs {to}0 (..., g, p, f, proof) ... a level up each."""
        out = f"{to}0 AS ({start})"
        for i in range(count):
            before, after = "array_to_string(hs[1 : p0 % 3], '')", "array_to_string(hs[p0 % 3 + 2 : 3], '')"
            out += f""",
{to}{i + 1} AS (SELECT doc_id, leaf, g, sub, up, p0 // 3 AS p, CASE WHEN n > 1 THEN sha256(concat({before}, f, {after})) ELSE f END AS f, CASE WHEN n > 1 THEN concat(proof, {before}, {after}) ELSE proof END AS proof
  FROM (SELECT doc_id, leaf, g, sub, up, p AS p0, f, proof FROM {to}{i}) AS x JOIN (SELECT g AS rg, p AS rp, n, hs FROM {name}r{i}) ON rg = g AND rp = p0 // 3)"""
        return out

    return f"""WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS leaf,
  CASE WHEN ({crc}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
{tree("t", "SELECT g, p, leaf AS h, n FROM o", levels)},
s AS (SELECT g, h AS sub, row_number() OVER (ORDER BY g) - 1 AS up, count(*) OVER () AS n FROM t{levels}),
{tree("u", "SELECT '' AS g, up AS p, sub AS h, n FROM s", upper)},
{climb("t", levels, "SELECT o.doc_id, o.leaf, o.g, s.sub, s.up, o.p, o.changed AS f, '' AS proof FROM o JOIN s ON o.g = s.g", "a")},
{climb("u", upper, f"SELECT doc_id, leaf, '' AS g, sub, up, up AS p, f, proof FROM a{levels}", "b")}
SELECT doc_id, leaf, sub AS subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM b{upper}, u{upper}"""
