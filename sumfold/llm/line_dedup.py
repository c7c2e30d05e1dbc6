"""Repeated runs of lines, found with a suffix array over line ids, and their later copies deleted.

Every line that is not empty gets an id, and suffixes of the documents' id sequences are ranked
by prefix doubling: ranks by 2^k lines and the rank 2^k lines on give ranks by 2^(k+1) lines, each
round a distributed sort of the pairs that occur more than once. A suffix whose pair occurs once
drops out, so that only what repeats is sorted on. The suffixes that share ``m`` lines, an interval of
the suffix array whose common prefixes are that long, are those whose ranks by 2^k <= m lines agree at both
ends of the ``m`` lines. A run of lines with ``min_words`` words or more that occurs earlier too is made up
of shortest such runs, each the shortest from its first line on or up to its last; of each interval of
these the first suffix stays and the lines of the others go.

A line is thus deleted exactly if it lies in a run of at least ``min_words`` words that also starts
earlier, earlier meaning a smaller ``doc_id`` (null first), then an earlier row, then an earlier line.
Ranks are needed only up to the longest such run's lines, so rounds are as many as its logarithm.

Defined cases: null texts stay null; empty lines and texts never match, an empty line goes with the line before
it; runs never reach over documents or empty documents; copies may overlap, and in a document that repeats
one line the first stays; equal rows are copies of each other; an empty table gives no rows; all columns are
kept but such that are called like ``counts``, which give way, and ``n_chars``, where there is one, follows the text; ``doc_id`` has any
type that can be ordered; a very long text is cut into lines by one task, which holds some 60 bytes for each byte of it. ``docs`` must give the same rows each time it is read, as
stored tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumfold.llm.common import free, written
from sumfold.llm.words import EXACT, LINES, SPACED, Words, slices


def _id(df: DataFrame) -> str:
    """``doc_id`` with its type, which is any that can be ordered."""
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def lines(docs: DataFrame) -> DataFrame:
    """Lines that are not empty of ``docs`` (row, doc_id, text): row, doc_id, ln, w words, h1, h2."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, 2):
            one, other = (Words(data, offsets, LINES, weight) for weight in EXACT)
            words = np.searchsorted(Words(data, offsets, SPACED).starts, np.append(one.starts, len(data)))
            n = np.diff(one.bounds)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            ln = np.arange(len(one.starts)) - np.repeat(one.bounds[:-1], n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(ln), pa.array(np.diff(words)), pa.array(one.hashes.view("i8")), pa.array(other.hashes.view("i8"))], names=["row", "doc_id", "ln", "w", "h1", "h2"])

    return docs.mapInArrow(cut, f"row long, {_id(docs)}, ln long, w long, h1 long, h2 long")


def ranked(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` that occur more than once, with ``rank`` in their order (not dense)."""
    often = pairs.groupBy(*keys).count().where("count > 1").select(*keys)
    sorted_ = often.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written before use: the ranges are drawn once
    return written(sorted_.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated(found: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur elsewhere too, in stretches of ``min_words`` words: row, doc_id, ln, seg, w, r0."""
    ranks = ranked(found, "h1", "h2")
    again = found.join(ranks, ["h1", "h2"]).select("row", "doc_id", "ln", "w", F.col("rank").alias("r0"))
    by_row = Window.partitionBy("row").orderBy("ln")
    again = again.withColumn("seg", F.col("ln") - F.row_number().over(by_row))
    again = again.withColumn("words", F.sum("w").over(Window.partitionBy("row", "seg")))
    return again.where(F.col("words") >= min_words).drop("words")


def doubled(suffixes: DataFrame, k: int) -> DataFrame:
    """With ranks by 2^(k+1) lines from those by 2^k, null where these lines occur once."""
    on = F.lead(f"r{k}", 1 << k).over(Window.partitionBy("row", "seg").orderBy("ln"))
    pairs = suffixes.withColumn("then", on)
    ranks = ranked(pairs.where(f"r{k} IS NOT NULL AND then IS NOT NULL"), f"r{k}", "then")
    return pairs.join(ranks.withColumnRenamed("rank", f"r{k + 1}"), [f"r{k}", "then"], "left").drop("then")


def _shortest(w: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and lengths of the shortest runs of ``min_words`` words, from each line on and up to each."""
    total = np.concatenate([[0], np.cumsum(w)])
    first = np.arange(len(w))
    end = np.searchsorted(total, total[:-1] + min_words)  # smallest with total[end] - total[first] >= min_words
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1  # largest with enough up to the line
    runs = {(a, b - a) for a, b in zip(first.tolist(), end.tolist()) if b <= len(w)} | {(a, b + 1 - a) for b, a in enumerate(start.tolist()) if a >= 0}
    if not runs:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    a, m = np.array(sorted(runs), "i8").T
    keep = m > 0
    return a[keep], m[keep]


def runs(suffixes: DataFrame, levels: int, min_words: int) -> DataFrame:
    """Shortest runs that occur more than once: row, doc_id, ln, m lines, and what names their interval."""
    ranks = [f"r{k}" for k in range(levels + 1)]
    # a document's lines at most
    segments = suffixes.groupBy("row", "doc_id", "seg").agg(F.sort_array(F.collect_list(F.struct("ln", "w", *ranks))).alias("s"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2)
            at, of = np.asarray(s.offsets), s.values
            ln, w = (np.asarray(of.field(i)) for i in (0, 1))
            r = [np.asarray(of.field(2 + k).fill_null(-1)) for k in range(levels + 1)]
            out = []
            for i in range(batch.num_rows):
                lo, hi = int(at[i]), int(at[i + 1])
                a, m = _shortest(w[lo:hi], min_words)
                k = np.frexp(m.astype("f8"))[1] - 1 if len(m) else m
                if not levels and len(m):
                    k = np.zeros_like(k)
                for level in set(k.tolist()):
                    if level <= levels:
                        sel = k == level
                        x, y = r[level][lo + a[sel]], r[level][lo + a[sel] + m[sel] - (1 << level)]
                        good = (x >= 0) & (y >= 0)
                        n = int(good.sum())
                        out.append((np.full(n, i), ln[lo + a[sel][good]], m[sel][good], x[good], y[good]))
            i, *rest = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "i8"),) * 5
            of = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *map(pa.array, rest)], names=["row", "doc_id", "ln", "m", "x", "y"])

    segments = segments.select("row", "doc_id", "s")
    return segments.mapInArrow(name, f"row long, {_id(suffixes)}, ln long, m long, x long, y long")


def longest(suffixes: DataFrame, min_words: int) -> int:
    """The lines of the longest of the shortest runs."""
    segments = suffixes.groupBy("row", "seg").agg(F.sort_array(F.collect_list(F.struct("ln", "w"))).alias("s")).select("s")

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0)
            at, w = np.asarray(s.offsets), np.asarray(s.values.field(1))
            m = [int(_shortest(w[i:j], min_words)[1].max(initial=0)) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([max(m, default=0)], pa.int64())], names=["m"])

    return segments.mapInArrow(most, "m long").agg(F.max("m")).first()[0] or 0


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, ln, m): runs of ``m`` lines from ``ln`` on that occur earlier too; ``docs`` has row, doc_id, text."""
    suffixes = written(repeated(lines(docs), min_words), "suffixes")
    most, k = longest(suffixes, min_words), 0
    while 2 << k <= most:
        suffixes = written(doubled(suffixes, k), "suffixes")
        k += 1
    found = written(runs(suffixes, k, min_words), "runs")
    here = F.struct("doc_id", "row", "ln")
    first = found.groupBy("m", "x", "y").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join can split an interval of very many suffixes
    first = written(first, "first")
    return found.join(first, ["m", "x", "y"]).where(here > F.col("first")).select("row", "ln", "m")


def dedup(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` without later copies of repeated runs, and ``counts``: lines not empty, and those of them deleted."""
    docs = docs.drop(*counts)
    columns = docs.columns
    row, later_row, spans_of = (free(columns, f"_line_dedup_{x}") for x in ("row", "later", "runs"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    later = later_copies(numbered.select(F.col(row).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), min_words)
    later = later.groupBy(F.col("row").alias(later_row)).agg(F.collect_list(F.struct("ln", "m")).alias(spans_of))
    both = numbered.join(later, F.col(row) == F.col(later_row), "left").drop(row, later_row)
    text_at, has_size = columns.index("text"), "n_chars" in columns

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = batch.column(text_at).to_pylist(), [], []
            for i, spans in enumerate(batch.column(len(columns)).to_pylist()):
                parts = (texts[i] or "").split("\n")
                n = sum(map(bool, parts))
                gone = np.zeros(n + 1, "i8")
                for s in spans or ():
                    gone[s["ln"]] += 1
                    gone[s["ln"] + s["m"]] -= 1
                gone = np.cumsum(gone)[:n] > 0
                total.append(n)
                removed.append(int(gone.sum()))
                if removed[-1]:
                    kept, at, drop = [], 0, False
                    for p in parts:
                        if p:
                            drop, at = bool(gone[at]), at + 1
                        if not drop:
                            kept.append(p)
                    texts[i] = "\n".join(kept)
            arrays = list(batch.columns[: len(columns)])
            arrays[text_at] = pa.array(texts, pa.string())
            if has_size:
                at = columns.index("n_chars")
                sizes = [old if not r else len(t) for old, r, t in zip(arrays[at].to_pylist(), removed, texts)]
                arrays[at] = pa.array(sizes, arrays[at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, *counts])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return both.mapInArrow(delete, schema)
