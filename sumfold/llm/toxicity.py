"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

A word is spelled byte by byte to its end. The history of a byte is the word so far, or the last ``depth`` bytes of a longer one.
Both models back off to what they share. With ``n`` a history's or continuation's count in a class or in both, ``t`` its number
of different continuations, ``d`` the discount and ``m`` the strength:

* lowest, by the last two bytes ``s``: ``P(x|s) = (max(c - d, 0) + d t(s) / 257) / c(s)``, where ``c`` counts different histories that end
  in ``s`` and go on with ``x`` (continuation counts), 1 / 257 where ``s`` was never met;
* shared, both classes together: ``P(x|h) = (max(n - d, 0) + d t(h) P(x|s)) / n(h)``, the lowest where ``h`` was never met;
* of a class: ``P_c(x|h) = (max(n_c - d, 0) + (d t_c(h) + m) P(x|h)) / (n_c(h) + m)``.

Histories of fewer than ``least`` words count as never met, here and in the continuation counts (a cut-off, as usual for long histories). So
rare expressions, of which a class says little by itself, weigh about the same in both. A
document's different words are counted once each, in the models and in ``evidence``: a toxic document is mostly ordinary words, so its
words come from the toxic model by ``share`` and else from the ordinary one, and each adds
``log(1 - share + share P_1(w) / P_0(w))``; the sum is divided by the square root of the number of the document's words, and a
logistic curve turns it into a score. ``toxic_nats`` and ``ordinary_nats`` are the two models' log-likelihoods of all words
of the document, repeated ones too, by their number.

All labelled rows of the training part are counted. The curve is fitted to the evidence of a fifth of them, by models of the other four
fifths; documents are scored by models of all. Models of up to ``table``
continuations go to the tasks as sorted arrays; larger ones stay tables, and the different words of the documents are
joined with them and their sums with the documents: keys move, texts do not.

Defined cases: null and empty texts have no evidence and likelihoods of 0; rows of ``labels`` that are null,
or name no document, teach nothing; several labels of a document all count; a document that
stands there twice is scored twice; without labels of both classes every score is the share of
toxic labels (0.5 without any); further columns are not looked at; very long texts and words are read whole, by one task that holds some
100 bytes for each byte of the text. ``docs`` must give the same rows each time it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import texts, written
from sumfold.llm.words import PLAIN, Words, mixed, slices

_SALT, _SLID = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_HELD = 1 << 20  # continuations that a task adds up before it hands them on
_KNOWN = 1 << 19  # words whose likelihoods a task remembers
_SYMBOLS = 257  # bytes, and a word's end
RESULT = "row long, doc_id long, evidence double, toxic_nats double, ordinary_nats double"


def remainder(doc_id: Column, by: int) -> Column:
    """The CRC-32 of an id written out, modulo ``by``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def _key(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The name of a history's continuation by a byte (0: the word's end)."""
    return mixed(q * _SALT + x.astype("u8"))


def spelled(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the word, the history, and the two bytes before and the byte itself in one number."""
    n = w.lengths + 1
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = w.starts[of]
    here = start + i
    since = np.maximum(start, here - depth)
    history = w.between(since, here) ^ np.where(since > start, _SLID, np.uint64(0))
    back = lambda k: np.where(i >= k, w.lowered(here - k), 0)
    return of, history, (back(2) << 16) + (back(1) << 8) + np.where(i < w.lengths[of], w.lowered(here), 0)


def _once(w: Words, of_doc: np.ndarray) -> np.ndarray:
    """Places of the first of each document's equal words."""
    return np.unique(w.hashes ^ mixed(of_doc.astype("u8") + np.uint64(1)), return_index=True)[1]


def counted(rows: DataFrame, depth: int) -> DataFrame:
    """(q, sx, n1, n0, m1, m0): how many words of toxic and of ordinary documents in ``rows`` (text, toxic, tuning) spell a history and go on with a byte.

    ``m1`` and ``m0`` count words of documents for tuning, ``n1`` and ``n0`` those of others.
    """

    names = ("n1", "n0", "m1", "m0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added() -> tuple[np.ndarray, ...]:
            q, sx, *counts = (np.concatenate(c) for c in zip(*held))
            _, first, which = np.unique(_key(q, sx & 255), return_index=True, return_inverse=True)
            return q[first], sx[first], *(np.bincount(which, n).astype("i8") for n in counts)

        def batch_of(c: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[0].view("i8")), pa.array(c[1].astype("i4")), *map(pa.array, c[2:])], names=["q", "sx", *names])

        for batch, data, offsets in slices(batches, 0):
            w = Words(data, offsets, PLAIN)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.bounds))
            keep = _once(w, doc)
            # each spelling once, with its documents of either class
            _, first, which = np.unique(w.hashes[keep], return_index=True, return_inverse=True)
            kind = (2 * np.asarray(batch.column(2)) + 1 - np.asarray(batch.column(1)))[doc[keep]]
            of, q, sx = spelled(w.only(keep[first]), depth)
            held.append((q, sx, *(np.bincount(which[kind == k], minlength=len(first))[of] for k in range(4))))
            size += len(q)
            if size > _HELD:
                held, size = [added()], 0
                if len(held[0][0]) > _HELD:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(added())

    return rows.mapInArrow(count, "q long, sx int, " + ", ".join(f"{c} long" for c in names))


def histories(rows: DataFrame, depth: int, least: int) -> DataFrame:
    """(q, e): histories of ``least`` words or more, and of each continuation ``sx`` its four counts as in ``counted``."""
    counts = ("n1", "n0", "m1", "m0")
    # dealt out by history once; both groupings stay where they are
    found = counted(rows, depth).repartition("q").groupBy("q", "sx").agg(*[F.sum(c).alias(c) for c in counts])
    found = found.groupBy("q").agg(F.collect_list(F.struct("sx", *counts)).alias("e"))
    return found.where(F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x.n1 + x.n0 + x.m1 + x.m0) >= least)


class Model:
    """Log-probabilities as tables, from ``histories`` with or without what is for tuning.

    ``lowest`` (sx, l) and ``unseen`` (s, l): continuations of two bytes that were met, and any other;
    ``continued`` (q, sx, l1, l0): continuations of histories, by class; ``backoff`` (q, t, b1, b0): what a history adds
    to the lowest one for a byte it was never followed by.
    """

    def __init__(self, found: DataFrame, tuning: bool, depth: int, least: int, discount: float, strength: float):
        self.depth = depth
        d, m = F.lit(discount), F.lit(strength)
        count = lambda x, i: x[f"n{i}"] + x[f"m{i}"] if tuning else x[f"n{i}"]
        e = F.filter(F.transform("e", lambda x: F.struct(x.sx.alias("sx"), count(x, 1).alias("n1"), count(x, 0).alias("n0"))), lambda x: x.n1 + x.n0 > 0)
        total = lambda f: F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + f(x).cast("long"))
        found = found.select("q", e.alias("e"))
        found = found.select("q", "e", total(lambda x: x.n1).alias("h1"), total(lambda x: x.n0).alias("h0"), total(lambda x: x.n1 > 0).alias("t1"), total(lambda x: x.n0 > 0).alias("t0"), F.size("e").alias("t"))
        found = found.where(F.col("h1") + F.col("h0") >= least)
        counts = found.select("*", F.inline("e")).drop("e")
        self.size = found.agg(F.sum("t")).first()[0] or 0
        follows = counts.groupBy(F.shiftright("sx", 8).alias("s"), "sx").agg(F.count("*").alias("c"))
        after = follows.groupBy("s").agg(F.sum("c").alias("cs"), F.count("*").alias("ts"))
        floor = d * F.col("ts") / _SYMBOLS
        # as many as pairs of bytes, and their continuations
        lowest = follows.join(after, "s").select("sx", ((F.greatest(F.col("c") - d, F.lit(0.0)) + floor) / F.col("cs")).alias("low"))
        self.lowest, self.unseen = lowest.select("sx", F.log("low").alias("l")), after.select("s", F.log(floor / F.col("cs")).alias("l"))
        mass = lambda i: (d * F.col(f"t{i}") + m) / (F.col(f"h{i}") + m)
        back = d * F.col("t") / (F.col("h1") + F.col("h0"))
        self.backoff = found.select("q", "t", *[F.log(mass(i) * back).alias(f"b{i}") for i in (1, 0)])
        n = F.col("n1") + F.col("n0")
        shared = F.greatest(n - d, F.lit(0.0)) / (F.col("h1") + F.col("h0")) + back * F.col("low")
        of = lambda i: F.log(F.greatest(F.col(f"n{i}") - d, F.lit(0.0)) / (F.col(f"h{i}") + m) + mass(i) * F.col("shared"))
        self.continued = counts.join(F.broadcast(lowest), "sx").withColumn("shared", shared).select("q", "sx", of(1).alias("l1"), of(0).alias("l0"))


class _Tables:
    """A model's arrays, in the order of histories and continuations, for one task's lookups."""

    def __init__(self, model: Model):
        def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
            t = df.select(*names).toArrow()
            return [t[c].to_numpy() for c in names]

        real = lambda *names: [F.col(c).cast("float").alias(c) for c in names]
        # sorted where they are, so that the driver only takes them in
        self.q, self.t, *self.backoff = columns(model.backoff.orderBy("q").select("q", F.col("t").cast("short"), *real("b1", "b0")), "q", "t", "b1", "b0")
        x = F.col("sx").bitwiseAND(255)
        self.x, *self.continued = columns(model.continued.orderBy("q", x).select(x.cast("short").alias("x"), *real("l1", "l0")), "x", "l1", "l0")
        self.lowest = self._sorted(*columns(model.lowest, "sx", "l"))
        self.unseen = self._sorted(*columns(model.unseen, "s", "l"))
        self.places: np.ndarray | None = None

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], values[order]

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are, and whether they are there."""
        if not len(known):
            return np.zeros(len(keys), "i8"), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def words(self, w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of each word, by the toxic and the ordinary model."""
        if self.places is None:  # a history's number and a continuation's byte in one number, 512 to a history
            kind = "i4" if len(self.q) < 1 << 22 else "i8"
            self.places = np.repeat(np.arange(len(self.q), dtype=kind), self.t) * np.array(512, kind) + self.x.astype(kind)
        of, q, sx = spelled(w, depth)
        history, met = self._find(self.q, q.view("i8"))
        at, hit = np.zeros(len(q), "i8"), np.zeros(len(q), bool)
        at[met], hit[met] = self._find(self.places, (history[met] * 512 + (sx[met] & 255)).astype(self.places.dtype))
        rest = np.flatnonzero(~hit)
        low_at, low = self._find(self.lowest[0], sx[rest])
        s_at, s_met = self._find(self.unseen[0], sx[rest] >> 8)
        base = np.full(len(rest), -np.log(_SYMBOLS))
        base[s_met] = self.unseen[1][s_at[s_met]]
        base[low] = self.lowest[1][low_at[low]]
        out = []
        for continued, backoff in zip(self.continued, self.backoff):
            ll = np.zeros(len(q))
            ll[hit] = continued[at[hit]]
            ll[rest] = base
            back = rest[met[rest]]
            ll[back] += backoff[history[back]]
            out.append(np.bincount(of, ll, len(w.lengths)))
        return tuple(out)


def _mixture(l1: np.ndarray, l0: np.ndarray, share: float) -> np.ndarray:
    return np.logaddexp(np.log1p(-share), np.log(share) + l1 - l0)


def likelihoods(docs: DataFrame, model: Model, share: float, table: int) -> DataFrame:
    """``RESULT`` for each of ``docs`` (row, doc_id, text)."""
    if model.size > table:
        return _joined(docs, model, share)
    known = docs.sparkSession.sparkContext.broadcast(_Tables(model))
    depth = model.depth

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = known.value
        seen = np.zeros(0, "u8"), np.zeros(0), np.zeros(0)
        for batch, data, offsets in slices(batches, 2):
            w = Words(data, offsets, PLAIN)
            n = np.diff(w.bounds)
            doc = np.repeat(np.arange(len(n)), n)
            # each spelling once, for all the words spelled so, and for the slices to come
            h, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
            at, hit = tables._find(seen[0], h)
            l1, l0 = (np.where(hit, x[at] if len(x) else 0.0, 0.0) for x in seen[1:])
            new = ~hit
            l1[new], l0[new] = tables.words(w.only(first[new]), depth)
            merged = [np.concatenate([x, y[new]]) for x, y in zip(seen, (h, l1, l0))] if len(seen[0]) < _KNOWN else [h, l1, l0]
            order = np.argsort(merged[0])
            seen = tuple(x[order] for x in merged)
            keep = _once(w, doc)
            evidence = np.bincount(doc[keep], _mixture(l1, l0, share)[which[keep]], len(n)) / np.sqrt(np.maximum(n, 1))
            nats = [np.bincount(doc, x[which], len(n)) / np.maximum(n, 1) for x in (l1, l0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (evidence, *nats))], names=["row", "doc_id", "evidence", "toxic_nats", "ordinary_nats"])

    return docs.select("row", "doc_id", "text").mapInArrow(look, RESULT)


def _joined(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """The same for models of any size: words are joined with them, and then with the documents that have them."""
    depth = model.depth

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, "u8")
        for _, data, offsets in slices(batches, 0):
            w = Words(data, offsets, PLAIN)
            h, first = np.unique(w.hashes, return_index=True)
            new = ~np.isin(h, seen)
            seen = np.concatenate([seen, h[new]]) if len(seen) < _KNOWN else h
            of, q, sx = spelled(w.only(first[new]), depth)
            i = np.arange(len(of)) - np.searchsorted(of, of)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[new][of].view("i8"), i, q.view("i8"), sx.astype("i4"))], names=["w", "i", "q", "sx"])

    def has(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, 1):
            w = Words(data, offsets, PLAIN)
            n = np.diff(w.bounds)
            doc = np.repeat(np.arange(len(n)), n)
            salt = w.hashes ^ mixed(doc.astype("u8") + np.uint64(1))
            _, first, times = np.unique(salt, return_index=True, return_counts=True)
            of = doc[first]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(w.hashes[first].view("i8")), pa.array(times), pa.array(n[of])], names=["row", "w", "times", "n"])

    # a word's bytes from several tasks are equal rows
    spelled_ = docs.select("text").mapInArrow(words, "w long, i long, q long, sx int").distinct()
    often = spelled_.withColumn("s", F.shiftright("sx", 8)).join(F.broadcast(model.lowest), "sx", "left")
    often = often.join(F.broadcast(model.unseen.withColumnRenamed("l", "l_")), "s", "left").join(model.continued, ["q", "sx"], "left").join(model.backoff.drop("t"), "q", "left")
    base = F.coalesce("l", "l_", F.lit(-float(np.log(_SYMBOLS))))
    of = lambda i: F.sum(F.coalesce(f"l{i}", base + F.coalesce(f"b{i}", F.lit(0.0)))).alias(f"l{i}")
    by_word = written(often.groupBy("w").agg(of(1), of(0)), "toxic_words")
    found = docs.select("row", "text").mapInArrow(has, "row long, w long, times long, n long").join(by_word, "w")
    mixture = F.log(1 - share + share * F.exp(F.col("l1") - F.col("l0")))
    nats = lambda i: (F.sum(F.col("times") * F.col(f"l{i}")) / F.max("n"))
    sums = found.groupBy("row").agg((F.sum(mixture) / F.sqrt(F.max("n"))).alias("evidence"), nats(1).alias("toxic_nats"), nats(0).alias("ordinary_nats"))
    return docs.select("row", "doc_id").join(sums, "row", "left").fillna(0.0, ["evidence", "toxic_nats", "ordinary_nats"]).select(*[x.split()[0] for x in RESULT.split(", ")])


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (evidence, toxic, ordinary) counts."""
    x, n1, n0 = (np.array(c, "f8") for c in zip(*bins)) if bins else (np.zeros(0),) * 3
    if not n1.sum() or not n0.sum():
        share = n1.sum() / (n1.sum() + n0.sum()) if len(x) and (n1.sum() + n0.sum()) else 0.5
        return 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    a, b, scale = 0.0, float(np.log(n1.sum() / n0.sum())), max(1e-9, float(np.sqrt(((n1 + n0) * x * x).sum() / (n1 + n0).sum())))
    z = x / scale
    for _ in range(100):  # Newton steps with a little weight on a flat curve
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, v = n1 - (n1 + n0) * p, (n1 + n0) * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() - 1e-3 * a, g.sum()
        haa, hab, hbb = (v * z * z).sum() + 1e-3, (v * z).sum(), v.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a / scale, b


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, depth: int = 12, least: int = 2, discount: float = 0.75, strength: float = 10.0, share: float = 0.01, table: int = 6_000_000, broadcast_labels: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and what they come from. Labels of the held-out fold are not used."""
    docs = texts(docs).withColumn("row", F.monotonically_increasing_id())
    used = labels.select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("toxic")).where("d IS NOT NULL AND toxic IN (0, 1)")
    used = used.where(remainder(F.col("d"), folds) != held_out_fold)
    # up to a checked number of labels, documents stay where they are; more are joined by a shuffle
    few = used.count() <= broadcast_labels
    tuning = F.pmod(F.xxhash64("d"), F.lit(5)) == 0
    used = used.withColumn("tuning", tuning.cast("int"))
    joined = docs.join(F.broadcast(used) if few else used, F.col("doc_id") == F.col("d"))
    found = written(histories(joined.select("text", "toxic", "tuning"), depth, least), "histories")
    most = Model(found, False, depth, least, discount, strength)
    tuned = joined.where("tuning = 1").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "toxic")
    tuned = written(tuned, "toxic_tuning")
    tuned = likelihoods(tuned, most, share, table).join(tuned.select("row", "toxic"), "row")
    bins = tuned.groupBy(F.round("evidence", 3).alias("x")).agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    a, b = curve(sorted(tuple(r) for r in bins.collect()))
    p = 1 / (1 + F.exp(-(F.lit(a) * F.col("evidence") + F.lit(b))))
    every = Model(found, True, depth, least, discount, strength)
    scored = likelihoods(docs, every, share, table)
    out = scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), p.alias("score"), "evidence", "toxic_nats", "ordinary_nats")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "toxic_nats", "ordinary_nats")
