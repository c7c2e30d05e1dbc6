"""Benchmark passages in documents, found by winnowing.

A passage is a window of ``window`` consecutive words of a benchmark item, or an item of fewer words
as a whole. Of any ``window - k + 1`` consecutive ``k``-gram hashes the least is kept, in items and
documents alike, so that any two equal runs of ``window`` words keep an equal hash: each match of
kept hashes is extended word by word to both sides, and runs of ``window`` words or more count.
Items of fewer words keep the hash of all their words, and documents that of each run as long.

The fingerprints of a benchmark of at most ``broadcast_words`` words go to every task (a
checked bound), and documents are read once, without a shuffle. A larger benchmark is joined
with the documents on fingerprints, and only documents with a match are looked at again.

Defined cases: null and empty texts have no words and are never contaminated, such items match
nothing; items of equal text all match; equal ids count once; items without an id are not counted,
though their words are hit; equal documents get equal rows; an empty benchmark hits nothing; further columns are not looked at by ``contamination`` and kept by ``clean``; a very
long text is hashed by one task, which holds some 60 bytes for each byte of it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import free, texts, written
from sumfold.llm.words import PLAIN, Words, column_bytes, slices

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def kept(grams: np.ndarray, span: int) -> np.ndarray:
    """Winnowing: positions of the least of each ``span`` consecutive hashes, the last of equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, "i8")
    least = grams[:n].copy()
    at = np.arange(n)
    for j in range(1, span):
        here = grams[j : j + n]
        lower = here <= least
        at[lower] = np.flatnonzero(lower) + j
        np.minimum(least, here, out=least)
    return np.unique(at)


class Fingerprints:
    """A benchmark's words and the places of its fingerprints, for one task's lookups."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, k: int):
        self.window, self.k = window, k
        self.ids = [i for i, _ in items]
        data, offsets = column_bytes(pa.array([t or "" for _, t in items], pa.string()))
        self.words: list[list[bytes]] = []
        places: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        w = Words(data, offsets, PLAIN)
        for i in range(len(items)):
            lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
            n = hi - lo
            self.words.append([w.word(j) for j in range(lo, hi)])
            if n >= window:
                g = w.grams(k)[lo : hi - k + 1]
                for at in kept(g, window - k + 1).tolist():
                    places[0][int(g[at])].append((i, at))
            elif n:
                places[n][int(w.grams(n)[lo])].append((i, 0))
        self.places = {n: dict(p) for n, p in places.items()}
        self.sorted = {n: np.sort(np.fromiter(p, "u8", len(p))) for n, p in self.places.items()}

    def matches(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(word of ``w``, item, word of the item) of equal fingerprints."""
        for n, known in self.sorted.items():
            k = n or self.k
            grams = w.grams(k)
            at, _ = w.gram_docs(k)
            if not len(at):
                continue
            if n == 0:
                # spans that lie in one text are among all spans; what was chosen across two texts is left out
                own = np.zeros(len(grams), bool)
                own[at] = True
                at = kept(grams, self.window - k + 1)
                at = at[own[at]]
            g = grams[at]
            found = np.searchsorted(known, g)
            hit = known[np.minimum(found, len(known) - 1)] == g
            for a, h in zip(at[hit].tolist(), g[hit].tolist()):
                for i, q in self.places[n][h]:
                    yield a, i, q

    def hits(self, w: Words) -> dict[int, tuple[set[int], set[int]]]:
        """By text: its words inside passages, and the items these come from."""
        out: dict[int, tuple[set[int], set[int]]] = {}
        done: dict[tuple[int, int], int] = {}  # (item, shift) to the first word not yet compared
        for a, i, q in self.matches(w):
            item, shift = self.words[i], a - q
            if done.get((i, shift), -1) > a:
                continue
            doc = int(np.searchsorted(w.bounds, a, "right")) - 1
            lo, hi = int(w.bounds[doc]), int(w.bounds[doc + 1])
            right = a
            while right < hi and right - shift < len(item) and w.word(right) == item[right - shift]:
                right += 1
            left = a
            while left > lo and left - shift > 0 and w.word(left - 1) == item[left - 1 - shift]:
                left -= 1
            done[i, shift] = max(right, a + 1)
            if right - left >= min(self.window, len(item)):
                at, of = out.setdefault(doc, (set(), set()))
                at.update(range(left, right))
                of.add(i)
        return out

    def rows(self, doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        w = Words(data, offsets, PLAIN)
        n_words, found = np.diff(w.bounds).tolist(), self.hits(w)
        out = []
        for d, (doc_id, n) in enumerate(zip(doc_ids, n_words)):
            at, of = found.get(d, ((), ()))
            ids = sorted({str(self.ids[i]) for i in of if self.ids[i] is not None})
            out.append((doc_id, n, len(at), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(at) > 0 and 20 * len(at) >= n))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in RESULT.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, broadcast_words: int = 2_000_000) -> DataFrame:
    """A row of ``RESULT`` for each document. A word is hit if it lies in a passage of an item."""
    items = _items(benchmark)
    known = _bounded(items, broadcast_words)
    if known is None:
        return _joined(docs, items, window, k)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(known.value, window, k)
        for batch, data, offsets in slices(batches, 1):
            yield prints.rows(batch.column(0).to_pylist(), data, offsets)

    return texts(docs).mapInArrow(scan, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, broadcast_words: int = 2_000_000) -> DataFrame:
    """``docs``, all its columns, without contaminated documents."""
    items = _items(benchmark)
    known = _bounded(items, broadcast_words)
    if known is None:
        key, bad_key = free(docs.columns, "_clean_row"), free(docs.columns, "_clean_bad")
        keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
        # documents of one text are contaminated or not alike
        once = keyed.select("text", F.xxhash64(key).alias("doc_id")).dropDuplicates(["doc_id"])
        bad = _joined(once, items, window, k).where("contaminated").select(F.col("doc_id").alias(bad_key))
        return keyed.join(bad, F.xxhash64(key) == F.col(bad_key), "left_anti").drop(key)
    n = len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(known.value, window, k)
        for batch, data, offsets in slices(batches, n):
            bad = prints.rows([None] * batch.num_rows, data, offsets).column(5)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.compute.invert(bad))

    return docs.withColumn(free(docs.columns, "_clean_text"), F.coalesce("text", F.lit(""))).mapInArrow(keep, docs.schema)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")


def _bounded(items: DataFrame, words: int):
    """The items as a broadcast, or None if they may have more than ``words`` words."""
    size, rows = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    # a word and what parts it from the next are two characters at least; items may be empty
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]) if max(size / 2, rows) <= words else None


def _joined(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The same for a benchmark of any size, by a join on fingerprints.

    Texts and items are named by hashes; each different text is compared with each item that it shares a fingerprint with, in
    rows of their own, and what they hit is put together by text.
    """
    short = [r[0] for r in items.select(F.expr(r"size(regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0))").alias("n")).where(f"n BETWEEN 1 AND {window - 1}").distinct().collect()]

    def prints(batches: Iterator[pa.RecordBatch], all_of: list[int]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, 1):
            w = Words(data, offsets, PLAIN)
            grams = {n: w.grams(n) for n in {k, *all_of}}
            for d in range(batch.num_rows):
                lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                own = grams[k][lo : max(lo, hi - k + 1)]
                found = [own[kept(own, window - k + 1)]] if hi - lo >= window else []
                lengths = all_of if all_of else [hi - lo] if 0 < hi - lo < window else []
                found += [(grams[n] if n in grams else w.grams(n))[lo : hi - n + 1] for n in lengths if hi - lo >= n]
                h = np.unique(np.concatenate(found)).view("i8") if found else np.zeros(0, "i8")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[d].as_py()] * len(h), pa.string()), pa.array(h)], names=["key", "h"])

    keyed = texts(docs).withColumn("key", F.sha2("text", 256))
    once = keyed.select("key", "text").dropDuplicates(["key"])
    of_items = items.where("text IS NOT NULL").select(F.sha2("text", 256).alias("item"), F.col("text").alias("item_text"), "item_id")
    different = of_items.select("item", "item_text").dropDuplicates(["item"])
    # written, so that the join can split a fingerprint of very many texts
    ours = written(once.mapInArrow(lambda b: prints(b, short), "key string, h long"), "prints")
    theirs = written(different.mapInArrow(lambda b: prints(b, []), "key string, h long"), "prints")
    pairs = ours.join(theirs.withColumnRenamed("key", "item"), "h").select("key", "item").distinct()
    both = pairs.join(once, "key").join(different, "item").select("key", "text", "item", "item_text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, 1):
            keys, ids, own = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for d in range(batch.num_rows):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                at, of = Fingerprints([(ids[d], own[d])], window, k).hits(Words(data[lo:hi], np.array([0, hi - lo]), PLAIN)).get(0, ((), ()))
                if of:
                    out.append((keys[d], ids[d], sorted(at)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.list_(pa.int64())))], names=["key", "item", "at"])

    hits = written(both.mapInArrow(look, "key string, item string, at array<long>"), "hits")
    n_hit = hits.select("key", F.explode("at").alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = hits.join(of_items.select("item", "item_id").where("item_id IS NOT NULL"), "item").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    # a word begins where a word's character follows none
    words = F.expr(r"size(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))").cast("long")
    out = keyed.select("doc_id", "key", words.alias("n_words")).join(n_hit, "key", "left").join(named, "key", "left")
    hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
