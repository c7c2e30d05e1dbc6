"""Large sparse linear systems X = M X + B by regions: local systems are solved where they are, only separators are combined.

The graph of M is cut into regions of a bounded number of labels. Separators are labels at an edge between regions; all others are inside.
A region with M in the parts [I,I], [I,S], [S,I] and [S,S] and B in [I] sends on

    M[S,S] + M[S,I] M[I,I]* M[I,S]   and   M[S,I] M[I,I]* B[I],

which is what its separators say to each other and to the right-hand side. Together with the edges between regions these make a smaller system over
the separators alone, which is solved the same way and in dense blocks once it is small; what is inside is then M[I,I]* (B[I] + M[I,S] X[S]).
A region without separators is solved at once, and a label that only B has is its own solution. Many regions are eliminated together, as a stack of matrices.
No task holds more than a batch of regions, and the driver nothing but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumfold.functions.dense import Dense, dense
from sumfold.functions.scratch import settled
from sumfold.functions.semiring import Semiring
from sumfold.operators import blocks

#: Labels of a region, at most.
SIZE = 256
#: Labels of a system that is solved in dense blocks.
SMALL = 2048


#: Rows that a task takes together when it grows or solves regions, and cells of a stack of matrices.
ROWS = 1 << 18
CELLS = 1 << 21


def regions(edges: DataFrame, size: int = SIZE, rounds: int = 64) -> DataFrame:
    """(id, part) of the ends of ``edges`` (row, col): connected regions of at most ``size`` labels.

    Labels are dealt out by ranges, and each task first joins labels of its own along their edges, as far as the sum of sizes allows: labels that follow
    each other often are near. Then, in each round, half of the regions, by a hash, may join a neighbour of the other half: the one they share
    most edges with, as far as sizes allow. It ends when no two neighbours fit together; only regions with neighbours outside and the edges between them
    take part in rounds.
    """
    label = dict(edges.dtypes)["row"]
    both = edges.select(F.col("row").alias("a"), F.col("col").alias("b")).union(edges.select("col", "row"))
    near = both.repartitionByRange("a").sortWithinPartitions("a", "b")
    first = settled(near.mapInArrow(_grown(size), f"id {label}, part {label}"))
    of = lambda c: first.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
    links = both.where("a <> b").join(of("a"), "a").join(of("b"), "b").where("a_part <> b_part")
    links = settled(links.groupBy(F.col("a_part").alias("a"), F.col("b_part").alias("b")).agg(F.count("*").alias("w")))
    sizes = settled(first.groupBy("part").agg(F.count("*").alias("n")).join(links.select(F.col("a").alias("part")).distinct(), "part", "left_semi"))
    moves = settled(sizes.select("part", F.col("part").alias("to")))
    for r in range(rounds):
        fits = links.join(sizes.select(F.col("part").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("part").alias("b"), F.col("n").alias("nb")), "b").where(F.col("na") + F.col("nb") <= size)
        # links that do not fit never will
        links = settled(fits)
        if links.isEmpty():
            break
        coin = lambda c: F.pmod(F.xxhash64(F.lit(r), c), F.lit(2))  # noqa: B023, E731
        tails = links.where((coin("a") == 0) & (coin("b") == 1))
        # one neighbour each, then as many as fit, smaller ones first
        pick = tails.groupBy("a", "na").agg(F.max(F.struct("w", F.xxhash64("a", "b").alias("h"), "b", "nb")).alias("x")).select("a", "na", "x.b", "x.nb")
        fit = F.sum("na").over(Window.partitionBy("b").orderBy("na", "a").rowsBetween(Window.unboundedPreceding, 0)) + F.col("nb") <= size
        joins = settled(pick.withColumn("fit", fit).where("fit").select(F.col("a").alias("old"), F.col("b").alias("new")))
        moved = lambda df, c: df.join(joins.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: B023, E731
        moves = settled(moved(moves, "to"))
        sizes = settled(moved(sizes, "part").groupBy("part").agg(F.sum("n").alias("n")))
        links = moved(moved(links.select("a", "b", "w"), "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return first.join(moves, "part", "left").select("id", F.coalesce("to", "part").alias("part"))


def _grown(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, part) from links (a, b) sorted by a: labels of a stretch of rows joined along the links among them, up to ``size`` a region."""

    def grow(links: pa.Table, before: pa.Scalar | None) -> pa.Table:
        a = links["a"].combine_chunks()
        own = pc.unique(a)
        if before is not None:
            own = own.filter(pc.not_equal(own, before))
        i, j = (pc.fill_null(pc.index_in(x, value_set=own), -1).to_numpy(zero_copy_only=False) for x in (a, links["b"].combine_chunks()))
        use = (i >= 0) & (j > i)
        root, count = list(range(len(own))), [1] * len(own)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(i[use].tolist(), j[use].tolist()):
            x, y = find(x), find(y)
            if x != y and count[x] + count[y] <= size:
                root[y], count[x] = x, count[x] + count[y]
        return pa.table({"id": own, "part": own.take(pa.array([find(x) for x in range(len(own))], pa.int64()))})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, before
            links = pa.Table.from_batches(held)
            yield from grow(links, before).to_batches()
            held, before = [], links["a"][-1]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS:
                yield from flush()
        if held:
            yield from flush()

    return apply


def solution(cells: DataFrame, right: DataFrame, semiring: Semiring, size: int = SIZE, small: int = SMALL, parts: DataFrame | None = None) -> DataFrame:
    """(row, col, payload) of M* B from the cells (row, col, payload) of M and of B, whose columns are labels of their own.

    ``parts`` (id, part) gives regions where they are known, of bounded size. A graph that has no small separators, at which cutting
    leaves more than three quarters of the labels, goes on in dense blocks.
    """
    d = dense(semiring)
    if d is None:
        raise ValueError(f"{semiring.name} has no dense blocks with a star")
    sums = [x.cast(t).alias(p) for x, t, p in zip(semiring.add([F.col(p) for p in semiring.payload]), semiring.types, semiring.payload)]
    cells = settled(cells.where("row IS NOT NULL AND col IS NOT NULL").groupBy("row", "col").agg(*sums))
    right = settled(right.where("row IS NOT NULL").groupBy("row", "col").agg(*sums))
    labels = settled(cells.select("row").union(cells.select("col")).distinct())
    count = labels.count()
    # columns of the right-hand side need a label here as in dense blocks
    alone = right.where("col IS NOT NULL").join(labels, "row", "left_anti").where(F.col(semiring.payload[0]) != F.lit(d.zero))
    right = right.where("col IS NOT NULL").join(labels, "row", "left_semi")
    if not count:
        return alone
    if count <= small:
        return blocks.solution(cells, right, semiring).unionByName(alone)
    parts = settled(regions(cells, size) if parts is None else parts)
    end = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
    placed = settled(cells.join(end("row"), "row").join(end("col"), "col"))
    between = placed.where("row_part <> col_part")
    separators = settled(between.select("row").union(between.select("col")).distinct())
    left = separators.count()
    if left > 0.75 * count:
        return blocks.solution(cells, right, semiring).unionByName(alone)
    (value,), kind, label = semiring.payload, semiring.types[0], dict(cells.dtypes)["row"]
    target = dict(right.dtypes)["col"]
    mark = lambda c: separators.select(F.col("row").alias(c), F.lit(True).alias(f"{c}_out"))
    none = lambda t: F.lit(None).cast(t)
    within = placed.where("row_part = col_part").join(mark("row"), "row", "left").join(mark("col"), "col", "left")
    within = within.select(F.col("row_part").alias("part"), "row", "col", none(target).alias("target"), F.col("row_out").isNotNull().alias("row_out"), F.col("col_out").isNotNull().alias("col_out"), value)
    given = right.join(end("row"), "row").join(mark("row"), "row", "left")
    given = given.select(F.col("row_part").alias("part"), "row", none(label).alias("col"), F.col("col").alias("target"), F.col("row_out").isNotNull().alias("row_out"), F.lit(False).alias("col_out"), value)
    shape = f"row {label}, col {label}, target {target}, {value} {kind}"
    inside = lambda df: df.repartition("part").sortWithinPartitions("part").mapInArrow(_eliminated(d, value), shape)
    solved = lambda df: df.where("target IS NOT NULL AND col IS NULL").select("row", F.col("target").alias("col"), value)
    if not left:
        return solved(inside(within.unionByName(given))).unionByName(alone)
    within = settled(within)
    given = given.where("NOT row_out")
    outer = settled(inside(within.unionByName(given)).join(separators, "row", "left_semi"))
    ahead = outer.where("col IS NOT NULL").select("row", "col", value).unionByName(between.select("row", "col", value))
    asked = solved(outer).unionByName(right.join(separators, "row", "left_semi"))
    known = settled(solution(ahead, asked, semiring, size, small))
    beside = known.join(end("row"), "row").select(F.col("row_part").alias("part"), "row", none(label).alias("col"), F.col("col").alias("target"), F.lit(False).alias("row_out"), F.lit(False).alias("col_out"), value)
    # separators are what is known of them, and nothing else
    rest = within.where("NOT row_out").withColumn("col_out", F.lit(False)).unionByName(given).unionByName(beside)
    return known.unionByName(solved(inside(rest)).join(separators, "row", "left_anti")).unionByName(alone)


def _eliminated(d: Dense, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is left of regions when the labels inside have been eliminated: cells of M among separators (row, col), and of the right-hand side (row, target).

    Rows are sorted by part.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole(batches, "part", ROWS):
            yield from _stacked(d, value, group)

    return apply


def _whole(batches: Iterator[pa.RecordBatch], by: str, rows: int) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows, of whole groups of a column that rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held)
            same = pc.equal(table[by], table[by][-1]).to_numpy()
            cut = len(same) - int(same.sum())
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, -1 where there is none, and the values."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype("i8"), coded.dictionary


def _ranks(part: np.ndarray, key: np.ndarray, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (part, key), the place of each key in its part, those that come ``later`` last; and (part, place, key) of all of them."""
    both, first, at = np.unique(np.stack([part, key]), axis=1, return_index=True, return_inverse=True) if len(part) else (np.empty((2, 0), "i8"),) + (np.empty(0, "i8"),) * 2
    order = np.lexsort((both[1], later[first], both[0])) if later is not None else np.arange(both.shape[1])
    parts = both[0][order]
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order)) - np.searchsorted(parts, parts)
    return place[at.ravel()], np.stack([both[0], place, both[1]])


def _stacked(d: Dense, value: str, group: pa.Table) -> Iterator[pa.RecordBatch]:
    part, _ = _codes(group["part"])
    names = pa.chunked_array(group["row"].chunks + group["col"].chunks, group["row"].type)
    key, labels = _codes(names)
    target, targets = _codes(group["target"])
    v = group[value].to_numpy(zero_copy_only=False)
    n, m = len(part), target < 0
    row_out, col_out = (group[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("row_out", "col_out"))
    # labels of a part, those inside first
    where = np.concatenate([np.ones(n, bool), m])
    here, out = np.concatenate([part, part])[where], np.concatenate([row_out, col_out])[where]
    place, known = _ranks(here, key[where], out)
    inner = np.zeros(part.max() + 1, "i8")
    _, first = np.unique(np.stack([here, place]), axis=1, return_index=True)
    np.add.at(inner, here[first], ~out[first])
    i, j = place[:n], np.zeros(n, "i8")
    j[m] = place[n:]
    j[~m], asked = _ranks(part[~m], target[~m])
    sizes, widths = (np.bincount(x, minlength=len(inner)) for x in (known[0], asked[0]))
    # stacks of parts of about one size
    for rank in np.unique((sizes + 7) // 8):
        of = np.flatnonzero((sizes + 7) // 8 == rank)
        tall, wide = sizes[of].max(), widths[of].max()
        step = max(1, CELLS // int(tall * (tall + wide)))
        for s in range(0, len(of), step):
            mine = of[s : s + step]
            at = np.full(len(inner), -1)
            at[mine] = np.arange(len(mine))
            a = np.full((len(mine), tall, tall + wide), d.zero, d.dtype)
            x = np.flatnonzero(at[part] >= 0)
            a[at[part[x]], i[x], j[x] + np.where(m[x], 0, tall)] = v[x]
            a = _swept(d, a, inner[mine])
            # labels and targets by part and place
            name, ask = np.full((len(mine), tall), -1), np.full((len(mine), wide + 1), -1)
            y, z = at[known[0]] >= 0, at[asked[0]] >= 0
            name[at[known[0][y]], known[1][y]] = known[2][y]
            ask[at[asked[0][z]], asked[1][z]] = asked[2][z]
            p, q, r = np.nonzero(a != d.zero)
            side = r >= tall
            keep = side | (np.minimum(q, r) >= inner[mine][p])
            p, q, r, side = p[keep], q[keep], r[keep], side[keep]
            col = np.where(side, -1, name[p, np.minimum(r, tall - 1)])
            goal = np.where(side, ask[p, np.where(side, r - tall, 0)], -1)
            take = lambda values, k: values.take(pa.array(k, pa.int64(), mask=k < 0))
            yield from pa.table({"row": take(labels, name[p, q]), "col": take(labels, col), "target": take(targets, goal), value: pa.array(a[p, q, r])}).to_batches()


def _swept(d: Dense, a: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A stack of matrices with further columns on the right after the elimination of the first ``inner`` labels of each."""
    zero = np.array(d.zero, d.dtype)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(int(inner.max(initial=0))):
            star = np.array([d.star(x) for x in a[:, k, k].tolist()], d.dtype)
            column = a[:, :, k]
            # zero times anything is zero, minus infinity included
            first = np.where((column == zero) | (inner <= k)[:, None], zero, d.mul(column, star[:, None]))
            a = d.add(a, d.mul(first[:, :, None], a[:, None, k, :]))
    return a
