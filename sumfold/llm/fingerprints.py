"""Threshold-scaled sketches: of a text's shingle hashes, all those below a fixed fraction.

Sketches of any two texts sample the same part of the hash space, so that intersections,
unions and containments can be estimated between very unequal texts, and the sketch of
texts put together is the union of theirs. A text none of whose hashes is below the bound keeps its
least one instead, which leaves as soon as another hash below the bound is merged in. A text of fewer words
than a shingle has its whole word sequence as one shingle.

Defined cases: null is the empty text; texts without words have an empty sketch; two empty
sketches have likeness 1, an empty and another one 0; equal texts have equal sketches;
``doc_id`` orders the documents, nulls first, equal ids by their texts; of one document alone the next is
itself; an empty table gives no rows; further columns are not looked at; a very long text is hashed by
one task, which holds some 60 bytes for each byte of it and the text that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import texts
from sumfold.llm.words import SPACED, Words, column_bytes, mixed

_DIGITS = 10  # hexadecimal digits kept of each hash
_KEPT = np.uint64((1 << 64) - (1 << (64 - 4 * _DIGITS)))
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def sketches(texts_: list[str], shingle: int, scale: int) -> list[np.ndarray]:
    """The sketch of each text: its sorted hashes below 1/``scale`` of the range, or the least one."""
    data, offsets = column_bytes(pa.array(texts_, pa.large_string()))
    w = Words(data, offsets, SPACED)
    grams = w.grams(shingle)
    at, doc = w.gram_docs(shingle)
    h = grams[at] & _KEPT
    bound = np.uint64(min((1 << 64) // scale, (1 << 64) - 1))
    low = h < bound
    order = np.lexsort((h[low], doc[low]))
    hs, ds = h[low][order], doc[low][order]
    first = np.ones(len(hs), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[first], ds[first]
    ends = np.searchsorted(ds, np.arange(len(texts_) + 1))
    own = np.searchsorted(doc, np.arange(len(texts_) + 1))
    out = []
    for i in range(len(texts_)):
        s = hs[ends[i] : ends[i + 1]]
        if not len(s):
            lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
            if own[i + 1] > own[i]:
                s = h[own[i] : own[i + 1]].min(keepdims=True)
            elif hi > lo:
                g = np.zeros(1, "u8")
                for j in range(lo, hi):
                    g = mixed(g * np.uint64(31) + w.hashes[j : j + 1])
                s = g & _KEPT
        out.append(s)
    return out


def shown(sketch: np.ndarray) -> str:
    """A sketch as text: the leading hexadecimal digits of its hashes, ascending."""
    h = sketch.astype(">u8").tobytes().hex()
    return "".join(h[i : i + _DIGITS] for i in range(0, len(h), 16))


def read(fingerprint: str) -> set[str]:
    return {fingerprint[i : i + _DIGITS] for i in range(0, len(fingerprint), _DIGITS)}


def merged(one: str, other: str, scale: int) -> str:
    """The fingerprint of two texts' shingles together."""
    both = sorted(read(one) | read(other))
    low = [x for x in both if int(x, 16) < (1 << 4 * _DIGITS) // scale]
    return "".join(low or both[:1])


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of Jaccard's similarity, and of the share of ``a`` that ``b`` contains."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Documents in ranges of ``doc_id``, each range followed by the first document after it.

    Range bounds come from approximate quantiles; the row that closes a range is the first
    of the next range that has any, after the last range that of the first. Columns: part, k, text,
    doc_id, closing.
    """
    docs = texts(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = sorted(set(docs.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    docs = docs.withColumn("part", _part([int(c) for c in cuts]))
    heads = docs.groupBy("part").agg(F.min("k").alias("k"))
    order = Window.orderBy("part")
    previous = F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy()))
    heads = heads.select("k", previous.alias("before"))
    # a row per range: as many as ``parts`` at most
    closing = docs.join(F.broadcast(heads), "k").select("before", "k", "text", "doc_id", F.lit(True).alias("closing"))
    rows = docs.select("part", "k", "text", "doc_id", F.lit(False).alias("closing"))
    return rows.union(closing)


def _part(cuts: list[int]) -> Column:
    """The range of ``k`` by a nested choice: as many comparisons as the logarithm of the ranges."""

    def choose(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("k") < F.lit(cuts[mid]), choose(lo, mid)).otherwise(choose(mid + 1, hi))

    return choose(0, len(cuts))


def neighbours(docs: DataFrame, shingle: int = 5, scale: int = 4, parts: int | None = None) -> DataFrame:
    """A row of ``RESULT`` per document: its sketch, its edited text's, and how near it is to that and to the next document."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (doc_id, text) whose next one has not come yet, or is in the list
        size, last = 0, None  # of a range

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """All but the last row, which is the next of the one before."""
            texts_ = [t for _, t in rows]
            changed = [edited(t, n) for t, n in zip(texts_, texts_[1:])]
            own, theirs = sketches(texts_, shingle, scale), sketches(changed, shingle, scale)
            done = []
            for i, t in enumerate(changed):
                near, contained = likeness(own[i], theirs[i])
                near_next, contained_next = likeness(own[i], own[i + 1])
                done.append((rows[i][0], len(texts_[i]), hashlib.sha256(t.encode()).hexdigest(), shown(own[i]), shown(theirs[i]), near, near_next, contained, contained_next))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[x.split()[0] for x in RESULT.split(", ")])

        closed = False
        for batch in batches:
            ids, closings, ranges = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(0).to_pylist()
            column = batch.column(2)
            for i, doc_id in enumerate(ids):
                if ranges[i] != last:
                    last, closed, rows, size = ranges[i], False, [], 0
                if closed:
                    continue  # others with the id of the closing row
                text = column[i].as_py()
                rows.append((doc_id, text))
                size += len(text)
                closed = closings[i]
                if len(rows) > 1 and (closed or size > 1 << 20):
                    yield out(rows)
                    rows, size = rows[-1:], len(text)

    dealt = with_next(docs, parts).repartition("part").sortWithinPartitions("part", "closing", "k", "text")
    return dealt.mapInArrow(walk, RESULT)
