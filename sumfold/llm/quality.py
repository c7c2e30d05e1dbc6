"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from how its bytes are spelled (shares of
characters and of pairs of kinds of characters), how long its words are and how much of it repeats;
gated attention, learnt from labels of documents alone, weighs the encoded passages, and a
logistic unit scores their weighted sum:

    h = tanh(W x + b),  a = softmax over passages of u (tanh(V h) * sigmoid(G h)),  score = sigmoid(c (sum of a h) + d)

The model is fitted on the driver to the passages of at most ``sample`` labelled documents of ``characters`` together, chosen
by a hash of their id; every passage of every document is scored on the executors.

Defined cases: null and empty texts, and such without words, are one passage without content; rows
of ``labels`` that are null or name no document teach nothing; different labels of a document all
count; without labels of both classes every score is the share of good labels (0.5 without any); equal texts have equal
scores; an empty table gives no rows; further columns are not looked at; a very long text is encoded by one task, which holds
some 100 bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import free, texts
from sumfold.llm.toxicity import remainder
from sumfold.llm.words import SPACED, Words, mixed, slices

PASSAGE = 48
_KINDS = 8


def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """By byte: its class (each mark of punctuation its own) and its kind."""
    fine, kind, n = np.zeros(256, "i8"), np.zeros(256, "i8"), 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fine[b], kind[b] = (0, 0) if b < 192 else (1, 1)
        elif "a" <= c <= "z":
            fine[b] = kind[b] = 2
        elif "A" <= c <= "Z":
            fine[b] = kind[b] = 3
        elif c.isdigit():
            fine[b] = kind[b] = 4
        elif c == " ":
            fine[b] = kind[b] = 5
        else:
            fine[b], kind[b], n = n, 6 if c == "\n" else 7, n + 1
    return fine, kind, n


_FINE, _KIND, _N_FINE = _classes()
WIDTH = _N_FINE + _KINDS * _KINDS + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts' passages, and the range of passages of each text (one at least)."""
    w = Words(data, offsets, SPACED)
    words = np.diff(w.bounds)
    of_doc = np.maximum(1, -(-words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(of_doc)])
    n = int(bounds[-1])
    doc = np.repeat(np.arange(len(words)), of_doc)
    nth = np.arange(n) - bounds[doc]
    first_word = np.minimum(w.bounds[doc] + nth * PASSAGE, w.bounds[doc + 1])
    starts = np.where(nth == 0, offsets[doc], w.starts[np.minimum(first_word, max(0, len(w.starts) - 1))] if len(w.starts) else 0)
    size = np.diff(np.append(starts, len(data)))
    x = np.zeros((n, WIDTH), "f4")
    if len(data):
        at = np.repeat(np.arange(n), size)
        scale = np.maximum(size, 1)[:, None]
        x[:, :_N_FINE] = np.bincount(at * _N_FINE + _FINE[data], minlength=n * _N_FINE).reshape(n, -1) / scale
        kind = _KIND[data]
        pair = at[:-1] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:]
        inner = np.ones(len(data) + 1, bool)
        inner[offsets] = False  # a pair lies in one text
        pair = pair[inner[1 : len(data)]]
        x[:, _N_FINE : _N_FINE + _KINDS**2] = np.bincount(pair, minlength=n * _KINDS**2).reshape(n, -1) / scale
    if len(w.starts):
        in_passage = np.repeat(np.arange(n), np.diff(np.append(first_word, len(w.starts))))
        in_doc = np.repeat(np.arange(len(words)), words)
        count = np.bincount(in_passage, minlength=n)
        many = np.maximum(count, 1)
        share = lambda flags: np.bincount(in_passage[: len(flags)], flags, n) / many
        new = lambda keys: np.isin(np.arange(len(keys)), np.unique(keys, return_index=True)[1], assume_unique=True)
        h, salt = w.hashes, mixed(in_doc.astype("u8") + np.uint64(1))
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (in_doc[1:] == in_doc[:-1])
        g = w.grams(3)
        more = [np.log1p(count), share(w.lengths.astype("f8")) / 8, np.sqrt(share(w.lengths.astype("f8") ** 2)) / 8, share(same)]
        more += [share(new(h ^ mixed(in_passage.astype("u8") + np.uint64(1))).astype("f8")), share(new(h ^ salt).astype("f8"))]
        one = in_doc[2:] == in_doc[: len(g)]  # three words of one text
        more += [share((new(g ^ salt[: len(g)]) & one).astype("f8")) if len(g) else np.zeros(n)]
        x[:, -7:] = np.stack(more, 1)
    return x, bounds


class Model:
    """Gated attention over encoded passages."""

    def __init__(self, hidden: int = 24, gates: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        self.mean, self.scale = np.zeros(WIDTH, "f4"), np.ones(WIDTH, "f4")
        self.p = {"W": init(WIDTH, hidden), "b": np.zeros(hidden, "f4"), "V": init(hidden, gates), "G": init(hidden, gates), "u": init(gates), "c": init(hidden), "d": np.zeros(1, "f4")}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p, at = self.p, bounds[:-1]
        of = np.repeat(np.arange(len(at)), np.diff(bounds))
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * s) @ p["u"]
        e = np.exp(e - np.maximum.reduceat(e, at)[of])
        a = e / np.add.reduceat(e, at)[of]
        bag = np.add.reduceat(a[:, None] * h, at)
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "of": of, "bag": bag, "y": 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.full(len(bounds) - 1, self.constant) if self.constant is not None else self._forward(x, bounds)["y"].astype("f8")

    def attention(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self._forward(x, bounds)["a"]

    def gradient(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of labels ``y``, by parameter."""
        p, f = self.p, self._forward(x, bounds)
        dy = (f["y"] - y) / len(y)
        dbag = dy[:, None] * p["c"]
        dh = f["a"][:, None] * dbag[f["of"]]
        da = (f["h"] * dbag[f["of"]]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, bounds[:-1])[f["of"]])
        dt, ds = de[:, None] * p["u"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["u"] * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["V"].T + ds @ p["G"].T
        dz = dh * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ dz, "b": dz.sum(0), "V": f["h"].T @ dt, "G": f["h"].T @ ds, "u": (f["t"] * f["s"]).T @ de, "c": f["bag"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> "Model":
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        p, r = self.p, np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        n = len(y)
        order = np.zeros(0, "i8")
        for step in range(1, steps + 1):
            if len(order) < min(batch, n):
                order = r.permutation(n)
            pick, order = order[:batch], order[batch:]
            sizes = bounds[pick + 1] - bounds[pick]
            b = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(b[-1]) - np.repeat(b[:-1], sizes) + np.repeat(bounds[pick], sizes)
            g = self.gradient(x[rows], b, y[pick])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():  # Adam
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) + now * decay * p[k]).astype("f4")
        return self


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, sample: int = 4000, characters: int = 50_000_000) -> Model:
    """Fit the model to labelled documents outside the held-out fold, in order of a hash of their ids.

    Only labels that name a document count. At most ``sample`` documents are used, and as many of them as have
    ``characters`` together at most: one that does not fit is passed over, the next ones may. Of rows that repeat an id one is used.
    """
    used = labels.select(F.col("doc_id").alias("d"), F.col("quality").cast("int").alias("quality")).where("d IS NOT NULL AND quality IN (0, 1)")
    used = used.where(remainder(F.col("d"), folds) != held_out_fold).distinct()
    named = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    least = named.where(F.col("n") <= characters).join(used, F.col("doc_id") == F.col("d")).groupBy("d", "quality").agg(F.min(F.struct("h", "n")).alias("x"))
    first = least.select(F.xxhash64("d").alias("o"), "d", "quality", "x.h", "x.n").orderBy("o", "d", "quality").limit(sample)
    picked, total = [], 0
    for r in sorted(first.collect()):  # ``sample`` rows at most
        if total + r["n"] <= characters:
            total += r["n"]
            picked.append((r["d"], r["quality"], r["h"]))
    picked = F.broadcast(docs.sparkSession.createDataFrame(picked, "d long, quality int, h long"))
    chosen = named.join(picked, (F.col("doc_id") == F.col("d")) & (named["h"] == picked["h"])).select("text", "d", "quality").dropDuplicates(["d", "quality"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, 0):
            x, bounds = passages(data, offsets)
            x = x.astype("f2")
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["d", "quality", "x"])

    rows = chosen.mapInArrow(encode, "d long, quality int, x binary").toArrow()
    rows = rows.sort_by([("d", "ascending"), ("quality", "ascending"), ("x", "ascending")])
    bags = [np.frombuffer(b, "f2").reshape(-1, WIDTH) for b in rows["x"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags], dtype="i8")])
    x = np.concatenate(bags).astype("f4") if bags else np.zeros((0, WIDTH), "f4")
    return Model().fit(x, bounds, np.array(rows["quality"].to_pylist(), "f4"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all its columns, and ``score``: how likely the label 1 is. Another column of that name gives way."""
    docs = docs.drop("score")
    of = free(docs.columns, "_scored_text")
    known = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, len(docs_columns)):
            out = batch.drop_columns([of])
            yield out.append_column("score", pa.array(known.value.score(*passages(data, offsets))))

    docs_columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.withColumn(of, F.coalesce("text", F.lit(""))).mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, sample: int = 4000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of the held-out fold are not used."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, folds, held_out_fold, sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
