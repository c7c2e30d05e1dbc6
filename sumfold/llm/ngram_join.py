"""Documents whose sets of word n-grams are alike, by vertical partitioning.

Each distinct set of n-gram hashes is a member; equal sets are one. The range of hashes, which is the global
order of n-grams, is cut into fragments. Each holds its part of all members' sets, and there, without looking
elsewhere,

* n-grams of one member alone are told from those that are shared, and counted per member: members
  whose shared n-grams, summed over fragments, cannot make up a link drop out;
* partial overlaps of candidate pairs are counted, in ``cuts`` ranges of fragments each, and summed per pair.

There are as many fragments as hold ``fragment_size`` n-grams each. An n-gram of so many members that it
would fill a fragment by itself never meets in one place: tasks count n-grams as they name the members, those
with ``fragment_size / 8`` members or more are known as shared beforehand and bypass the fragments.

A member's n-grams are ranked by how many members share them (in powers of two), then by hash. Members that
link have an n-gram in common among the first of each, so candidates meet at these. They are not all paired.
At each n-gram members are compared with ``pivots`` central ones, those with the largest shares of shared n-grams, and
components are drawn; then with central ones of those outside the largest component there; at last, pairs of members in different
components are compared one by one, around all but the largest component at an n-gram. Two
members of one component need not be compared, so no link between different components is lost, and groups
of near copies cost about as many comparisons as they have members. An n-gram of many members is
dealt out in blocks of about ``block`` of them, each against those others that their sizes allow.

Defined cases: null and empty texts, and such without words, have no n-grams and are linked with nothing; a text
of fewer words than an n-gram is one n-gram; equal rows are alike; a null ``doc_id`` is larger than
any; an empty table gives no rows; further columns are not looked at; very long texts are read whole, by one task
that holds some 60 bytes for each byte of the text. Sets are told apart by 64 bits; n-grams by their fragment and 48 bits more, so
that two different ones among a fragment's million are taken for one about once in 500 fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import free, written
from sumfold.llm.components import components
from sumfold.llm.words import SPACED, Words, mixed, slices

_U = np.uint64
_BATCH = 4 << 20  # bytes of text in a batch of fragments
_LOW48 = _U((1 << 48) - 1)
_FEW = 32  # members in a task below which an n-gram is not reported as frequent


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, and the text of each, in order of texts and hashes."""
    w = Words(data, offsets, SPACED)
    at, doc = w.gram_docs(n)
    h = w.grams(n)[at]
    words = np.diff(w.bounds)
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):
        short = np.zeros(len(few), "u8")
        for j in range(n - 1):
            more = words[few] > j
            short[more] = mixed(short[more] * _U(31) + w.hashes[w.bounds[few[more]] + j])
        h, doc = np.concatenate([h, short]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first]


def names(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the size of its set and a hash of it."""
    size = np.bincount(doc, minlength=n_docs)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed(h ^ _U(0x2545F4914F6CDD1D)))])
    ends = np.cumsum(size)
    return size, mixed(total[ends] - total[ends - size] + size.astype("u8")).view("i8")


def _counted(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their ``n``."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, "i8")
    return h[at], np.add.reduceat(n, at) if len(at) else n


def _listed(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(flat))


def members(docs: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, ref, n, often, counts): the name and size of each document's set; ``docs`` has row, doc_id, text.

    A row without a name has n-grams that are frequent in a task, and in how many sets.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, "u8"), np.zeros(0, "i8")
        for batch, data, offsets in slices(batches, 2):
            h, doc = sets(data, offsets, n)
            size, ref = names(h, doc, batch.num_rows)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ref), pa.array(size), none, none], names=["row", "doc_id", "ref", "n", "often", "counts"])
            one, count = _counted(h, np.ones(len(h), "i8"))
            more = count > 1
            held = _counted(np.concatenate([held[0], one[more]]), np.concatenate([held[1], count[more]]))
        many = held[1] >= _FEW
        if many.any():
            ends = np.array([many.sum()])
            null = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, null, _listed(held[0][many].view("i8"), ends), _listed(held[1][many], ends)], names=["row", "doc_id", "ref", "n", "often", "counts"])

    return docs.mapInArrow(name, "row long, doc_id long, ref long, n long, often array<long>, counts array<long>")


def frequent(named: DataFrame, least: int, most: int = 200_000) -> list[tuple[int, int]]:
    """(hash, level) of n-grams in about ``least`` sets or more, the ``most`` most frequent ones, in order of unsigned hashes."""
    counts = named.where("often IS NOT NULL").select(F.inline(F.arrays_zip("often", "counts"))).groupBy("often").agg(F.sum("counts").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "often").limit(most)
    return sorted(((h, int(np.log2(c))) for h, c in found.collect()), key=lambda x: x[0] % (1 << 64))


class _Cut:
    """The order of n-grams, cut into fragments, and these in ``cuts`` ranges."""

    def __init__(self, total: int, fragment_size: int, cuts: int):
        self.cuts = cuts
        self.fragments = cuts * max(1, -(-total // (fragment_size * cuts)))

    def of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(32)) * _U(self.fragments) >> _U(32)).astype("i8")

    def token(self, f: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The name of an n-gram: its range of fragments in front, a hash of its fragment and low bits behind."""
        v = f * self.cuts // self.fragments
        return (v.astype("u8") << _U(56)) | (mixed(low + mixed(f.astype("u8") + _U(1))) >> _U(8))


def _packed(bucket: np.ndarray, ref: np.ndarray, n: np.ndarray, token: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
    """(bucket, refs, ns, tokens, levels): n-grams of members, together by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, ref, n, token, level = (x[order] for x in (bucket, ref, n, token, level))
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, "i8")
    cut = list(zip(at.tolist(), np.append(at[1:], len(bucket)).tolist()))
    columns = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (ref, n.astype("u4"), token, level.astype("u1"))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *columns], names=["bucket", "refs", "ns", "tokens", "levels"])


_PACKED = "bucket long, refs binary, ns binary, tokens binary, levels binary"


def _texts_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes, members' names, members' sizes) of the different members in a batch of texts."""
    held: list[tuple[np.ndarray, ...]] = []
    seen: set[int] = set()
    size = 0
    for batch, data, offsets in slices(batches, 0):
        h, doc = sets(data, offsets, n)
        sizes, ref = names(h, doc, batch.num_rows)
        fresh = np.array([r not in seen and not seen.add(r) for r in ref.tolist()], bool)
        keep = fresh[doc]
        if keep.any():
            held.append((h[keep], ref[doc[keep]], sizes[doc[keep]]))
        size += len(data)
        if size >= _BATCH and held:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, seen, size = [], set(), 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def fragmented(docs: DataFrame, n: int, cut: _Cut, known: np.ndarray) -> DataFrame:
    """(fragment, refs, ns, counts, hashes): for a batch of members, their hashes in a fragment but those ``known``, packed."""
    known_ = docs.sparkSession.sparkContext.broadcast(known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = known_.value
        for h, ref, size in _texts_sets(batches, n):
            if len(often):
                rare = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] != h
                h, ref, size = h[rare], ref[rare], size[rare]
            f = cut.of(h)
            order = np.argsort(f, kind="stable")
            f, h, ref, size = f[order], h[order], ref[order], size[order]
            at = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, "i8")
            rows = []
            for i, j in zip(at.tolist(), np.append(at[1:], len(f)).tolist()):
                of = ref[i:j]
                new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                counts = np.diff(np.append(new, len(of)))
                rows.append((int(f[i]), of[new].tobytes(), size[i:j][new].astype("u4").tobytes(), counts.astype("u4").tobytes(), h[i:j].view("u1").reshape(-1, 8)[:, :6].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], names=["fragment", "refs", "ns", "counts", "hashes"])

    return docs.select("text").mapInArrow(deal, "fragment long, refs binary, ns binary, counts binary, hashes binary")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared(parts: DataFrame, cut: _Cut, buckets: int) -> DataFrame:
    """``_PACKED``: of each fragment the n-grams that several members have, by buckets of members."""

    def count(key: tuple, t: pa.Table) -> pa.Table:
        six = _joined(t["hashes"], "u1").reshape(-1, 6)
        low = np.zeros((len(six), 8), "u1")
        low[:, :6] = six
        low = low.reshape(-1).view("u8")
        counts = _joined(t["counts"], "u4")
        ref, size = np.repeat(_joined(t["refs"], "i8"), counts), np.repeat(_joined(t["ns"], "u4"), counts)
        order = np.lexsort((ref, low))
        low, ref, size = low[order], ref[order], size[order]
        first = np.append(True, (low[1:] != low[:-1]) | (ref[1:] != ref[:-1]))
        low, ref, size = low[first], ref[first], size[first]
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        df = np.diff(np.append(at, len(low)))
        df = np.repeat(df, df)
        keep = df > 1
        low, ref, size, df = low[keep], ref[keep], size[keep], df[keep]
        f = np.full(len(low), key[0].as_py(), "i8")
        return pa.Table.from_batches([_packed(_bucket(ref, buckets), ref, size, cut.token(f, low), np.log2(df))])

    return parts.groupBy("fragment").applyInArrow(count, _PACKED)


def known_shared(docs: DataFrame, n: int, cut: _Cut, known: list[tuple[int, int]], buckets: int) -> DataFrame:
    """``_PACKED``: the members' n-grams among those ``known`` to be frequent, which no fragment holds."""
    table = docs.sparkSession.sparkContext.broadcast((np.array([h for h, _ in known], "i8").view("u8"), np.array([x for _, x in known], "u1")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = table.value
        for h, ref, size in _texts_sets(batches, n):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            h, ref, size, at = h[hit], ref[hit], size[hit], at[hit]
            yield _packed(_bucket(ref, buckets), ref, size, cut.token(cut.of(h), h & _LOW48), levels[at])

    return docs.select("text").mapInArrow(look, _PACKED)


def _bucket(ref: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ref.view("u8")) % _U(buckets)).astype("i8")


def assembled(packed: DataFrame, percent: int) -> DataFrame:
    """(ref, n, shared, tokens, rests, grams): members with enough shared n-grams to link, a bucket at a time.

    ``tokens`` are a member's first n-grams, ``rests`` how many n-grams are left from each on: of its n, the
    first ``n - ceil(percent * n / 100) + 1``, those it shares with no one being the very first.
    """

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        ref, n, token, level = (_joined(t[c], k) for c, k in (("refs", "i8"), ("ns", "u4"), ("tokens", "u8"), ("levels", "u1")))
        order = np.lexsort((token, ref))
        ref, n, token, level = ref[order], n[order].astype("i8"), token[order], level[order]
        new = np.append(True, (ref[1:] != ref[:-1]) | (token[1:] != token[:-1]))  # equal sets of several batches
        ref, n, token, level = ref[new], n[new], token[new], level[new]
        at = np.flatnonzero(np.append(True, ref[1:] != ref[:-1])) if len(ref) else np.zeros(0, "i8")
        held = np.diff(np.append(at, len(ref)))
        keep = np.repeat(100 * held >= percent * n[at], held)
        ref, n, token, level = ref[keep], n[keep], token[keep], level[keep]
        at = np.flatnonzero(np.append(True, ref[1:] != ref[:-1])) if len(ref) else np.zeros(0, "i8")
        held = np.diff(np.append(at, len(ref)))
        order = np.lexsort((token, level, ref))
        of = np.repeat(np.arange(len(at)), held)
        pos = np.arange(len(ref)) - at[of]
        size = n[at]
        take = size + (-percent * size // 100) + 1 - (size - held)
        first = pos < take[of]
        rests = (held[of] - pos)[first]
        return pa.table({"ref": pa.array(ref[at]), "n": pa.array(size), "shared": pa.array(held), "tokens": _listed(token[order][first].view("i8"), np.cumsum(np.bincount(of[first], minlength=len(at)))), "rests": _listed(rests, np.cumsum(np.bincount(of[first], minlength=len(at)))), "grams": _listed(token.view("i8"), np.cumsum(held))})

    return packed.groupBy("bucket").applyInArrow(gather, "ref long, n long, shared long, tokens array<long>, rests array<long>, grams array<long>")


def compared(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) that link: overlaps of the members' parts in each range (``segments``: ref, v, grams), summed per pair."""
    one = segments.select(F.col("ref").alias("a"), "v", F.col("grams").alias("ours"))
    other = segments.select(F.col("ref").alias("b"), F.col("v").alias("w"), F.col("grams").alias("theirs"))
    both = pairs.join(one, "a").withColumnRenamed("v", "w").join(other, ["b", "w"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ours", "theirs")).cast("long").alias("overlap"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return summed.where((100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _may_link(percent: int) -> Column:
    """Whether sizes, and what is left from a first common n-gram, allow a link of (n, rest) and (m, left)."""
    enough = (100 + percent) * F.least("rest", "left") >= percent * (F.col("n") + F.col("m"))
    return (F.col("component") != F.col("theirs")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & enough


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs of ``met`` (ref, n, other, m), the smaller name first."""
    swap = F.col("ref") > F.col("other")
    pick = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one))
    return met.select(pick("ref", "other").alias("a"), pick("other", "ref").alias("b"), pick("n", "m").alias("na"), pick("m", "n").alias("nb")).distinct()


def _with_pivots(at: DataFrame, of: DataFrame, pivots: int) -> DataFrame:
    """Rows of ``at`` with central members of ``of`` at the same n-gram, the same ones wherever they may."""

    def central(i: int) -> Column:
        rank = F.col("share") if i == 0 else F.round(8 * F.col("share"))
        return F.max(F.struct(rank.alias("_"), F.xxhash64("ref", F.lit(i)).alias("__"), F.col("ref").alias("other"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("component").alias("theirs")))

    few = of.groupBy("token").agg(*[central(i).alias(f"p{i}") for i in range(pivots)])
    few = few.select("token", F.array_distinct(F.array(*[F.struct(f"p{i}.other", f"p{i}.m", f"p{i}.left", f"p{i}.theirs") for i in range(pivots)])).alias("p"))
    return at.join(few, "token").select("*", F.inline("p")).drop("p")


def _outside(at: DataFrame) -> DataFrame:
    """Rows outside the largest component at their n-gram, with the number of ``members`` there."""
    sized = at.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = sized.groupBy("token").agg(F.max(F.struct("size", "component")).alias("x"), F.count("*").alias("k"), F.sum("size").alias("members"))
    largest = largest.where("k > 1").select("token", F.col("x.component").alias("most"), "members")
    return at.join(largest, "token").where("component <> most").drop("most")


def _all_left(at: DataFrame, outside: DataFrame, percent: int, block: int) -> DataFrame:
    """Rows of ``outside`` with all of ``at`` at the same n-gram whose sizes lie within reach, in blocks."""
    step = float(np.log(max(100 / percent, 1.01)))
    kind = lambda x: F.floor(F.log(x) / step).cast("long")
    # a partner has at least ``percent`` of the n-grams, and no more than an overlap of all that is left allows
    least, most = percent * F.col("n") / 100, ((100 + percent) * F.col("rest") - percent * F.col("n")) / percent
    parts = lambda: F.ceil(F.col("members") / block).cast("long")
    ours = outside.where(most >= least * (1 - 1e-9)).withColumn("part", F.pmod(F.xxhash64("ref"), parts())).drop("members")
    ours = ours.withColumn("kind", F.explode(F.sequence(kind(least * (1 - 1e-9)), kind(most * (1 + 1e-9)))))
    blocks = outside.groupBy("token").agg(F.max("members").alias("members"))
    other = at.join(blocks, "token").select("token", F.col("ref").alias("other"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("component").alias("theirs"), kind(F.col("n")).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), parts() - 1)).alias("part"))
    return ours.join(other, ["token", "kind", "part"])


def groups(docs: DataFrame, n: int = 5, percent: int = 75, pivots: int = 2, fragment_size: int = 1_000_000, cuts: int = 8, block: int = 4096, frequent_share: int = 8) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, stays): ``docs`` has row, doc_id, text.

    ``component_id`` is the smallest ``doc_id`` that links of at least ``percent`` per cent lead to; ``stays`` marks one row of
    each component, that of the smallest ``doc_id``.
    """
    docs = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named_sets = written(members(docs, n), "members")
    found = named_sets.where("often IS NULL").select("row", "doc_id", "ref", "n")
    cut = _Cut(found.agg(F.sum("n")).first()[0] or 0, fragment_size, cuts)
    known = frequent(named_sets, max(2, fragment_size // frequent_share))
    packed = shared(fragmented(docs, n, cut, np.array([h for h, _ in known], "i8").view("u8")), cut, cut.fragments)
    if known:
        packed = packed.union(known_shared(docs, n, cut, known, cut.fragments))
    kept = written(assembled(packed, percent), "kept")
    # the first bits of a token name its range
    ranges = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("v")
    segments = kept.select("ref", ranges, "grams").select("ref", "v", F.expr("filter(grams, g -> shiftrightunsigned(g, 56) = v)").alias("grams")).where("size(grams) > 0")
    segments = written(segments, "segments")
    rows = kept.select("ref", "n", (F.col("shared") / F.col("n")).alias("share"), F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("rests").alias("rest"))))
    meeting = rows.groupBy("token").count().where("count > 1").select("token")
    rows = written(rows.join(meeting, "token"), "postings")
    links, done, named = None, None, None

    for turn in range(3):
        at = rows.withColumn("component", F.col("ref"))
        if named is not None:
            at = rows.join(named, F.col("ref") == F.col("node"), "left").withColumn("component", F.coalesce("component", "ref")).drop("node")
            at = written(at, "postings")
        if turn == 0:
            met = _with_pivots(at, at, pivots)
        else:
            outside = written(_outside(at), "outside")
            met = _with_pivots(at, outside, pivots) if turn == 1 else _all_left(at, outside, percent, block)
        pairs = _pairs(met.where(_may_link(percent)).select("ref", "n", "other", "m"))
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.union(pairs)
        new = written(compared(pairs, segments, percent), "linked")
        links = new if links is None else links.union(new)
        named = written(components(links), "named")

    at = found.withColumn("component", F.col("ref")) if named is None else found.join(named, F.col("ref") == F.col("node"), "left").withColumn("component", F.coalesce("component", "ref"))
    # a null id comes after all others
    first = at.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "row")).alias("first"))
    # written, so that the join below can split a component of very many rows
    first = written(first.select(F.col("component").alias("c"), F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept")), "first")
    out = at.join(first, (F.col("component") == F.col("c")) & (F.col("n") > 0), "left")
    alone = F.col("n") == 0
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("kept"))).alias("stays"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row; the table must give the same rows each time it is read."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns, without but one document of each component."""
    row, stays_row = free(docs.columns, "_ngram_join_row"), free(docs.columns, "_ngram_join_stays")
    named = docs.withColumn(row, F.monotonically_increasing_id())
    stays = groups(named.select(F.col(row).alias("row"), "doc_id", "text"), **options).where("stays").select(F.col("row").alias(stays_row))
    return named.join(stays, F.col(row) == F.col(stays_row), "left_semi").drop(row)
