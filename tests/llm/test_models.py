"""The fitted operators: held-out accuracy, gradients, defined cases; and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumfold.llm import quality, toxicity
from sumfold.llm.words import column_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GOOD = ["the", "of", "river", "winter", "garden", "stone", "letter", "morning", "window", "answer", "paper", "music"]


def corpus(r, n, bad):
    """Texts and labels; a text with label 1 has one passage made by ``bad``."""
    texts, labels = [], []
    for _ in range(n):
        words = [r.choice(GOOD) for _ in range(r.randint(60, 300))]
        y = int(r.random() < 0.4)
        if y:
            at = r.randrange(len(words))
            words[at:at] = bad(r)
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


def test_quality_on_held_out_documents(docs, spark):
    r = random.Random(2)
    texts, junk = corpus(r, 400, lambda r: [f"{r.choice(GOOD).upper()}!!" for _ in range(60)])
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, y in enumerate(junk)] + [(None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs(*texts, extra=True), labels, sample=200).collect()
    assert len(rows) == 400 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in rows)
    held = [x for x in rows if x["held_out"]]
    assert len(held) > 80 and np.mean([x["predicted"] == 1 - junk[x["doc_id"]] for x in held]) > 0.95


def features(text):
    """Of each passage, by plain loops."""
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", text)]
    words = [text[a:b].lower() for a, b in spans]
    heads = list(range(0, len(words), quality.PASSAGE)) or [0]
    out, seen, triples = [], set(), set()
    for k, lo in enumerate(heads):
        hi = min(lo + quality.PASSAGE, len(words))
        begin = 0 if k == 0 else spans[lo][0]
        end = spans[hi][0] if k + 1 < len(heads) else len(text)
        x, n = np.zeros(quality.WIDTH), max(end - begin, 1)
        for i in range(begin, end):
            x[quality._FINE[text[i]]] += 1 / n
            if i + 1 < len(text):
                x[quality._N_FINE + quality._KIND[text[i]] * 8 + quality._KIND[text[i + 1]]] += 1 / n
        w, own = words[lo:hi], set()
        for i in range(lo, hi):
            m = len(w)
            x[-6] += len(words[i]) / 8 / m
            x[-5] += len(words[i]) ** 2 / m
            x[-4] += (i > 0 and words[i] == words[i - 1]) / m
            x[-3] += (words[i] not in own) / m
            x[-2] += (words[i] not in seen) / m
            triple = tuple(words[i : i + 3])
            x[-1] += (len(triple) == 3 and triple not in triples) / m
            own.add(words[i])
            seen.add(words[i])
            triples.add(triple)
        x[-7], x[-5] = math.log1p(len(w)), math.sqrt(x[-5]) / 8
        out.append(x)
    return np.array(out)


def scored(model, x):
    """A document's score from its passages, by plain loops."""
    p, sigmoid = model.p, lambda v: 1 / (1 + math.exp(-v))
    h = [[math.tanh(sum(min(6, max(-6, (r[i] - model.mean[i]) / model.scale[i])) * p["W"][i][j] for i in range(len(r))) + p["b"][j]) for j in range(len(p["b"]))] for r in x]
    dot = lambda v, m, k: sum(a * m[i][k] for i, a in enumerate(v))
    e = [sum(p["u"][k] * math.tanh(dot(v, p["V"], k)) * sigmoid(dot(v, p["G"], k)) for k in range(len(p["u"]))) for v in h]
    total = sum(map(math.exp, e))
    return sigmoid(sum(math.exp(a) / total * sum(c * y for c, y in zip(p["c"], v)) for a, v in zip(e, h)) + p["d"][0])


def test_quality_is_gated_attention(docs, spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["Ab", "c,d", "é!", "99", "ab", "x\n"]) for _ in range(n)) for n in (0, 1, 47, 48, 49, 130)] + ["  ", None]
    model = quality.Model(hidden=5, gates=3)
    model.mean, model.scale = np.full(quality.WIDTH, 0.1, "f4"), np.full(quality.WIDTH, 0.7, "f4")
    found = {x["doc_id"]: x["score"] for x in quality.score(docs(*texts, extra=True), model).collect()}
    for i, t in enumerate(texts):
        x = features((t or "").encode())
        assert quality.passages(*column_bytes(pa.array([t or ""])))[0] == pytest.approx(x, abs=1e-5), i
        assert found[i] == pytest.approx(scored(model, x), abs=1e-5), i
    again = quality.score(docs("a").withColumn("score", F.lit("mine")).withColumn("_scored_text", F.lit(1)), model)
    assert again.columns == ["doc_id", "text", "_scored_text", "score"] and 0 < again.first()["score"] < 1


def test_quality_gradients():
    r = np.random.default_rng(1)
    x, bounds, y = r.standard_normal((7, quality.WIDTH)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    model = quality.Model(hidden=4, gates=3)
    model.p = {k: v.astype("f8") for k, v in model.p.items()}
    loss = lambda: -np.mean(y * np.log(model.score(x, bounds)) + (1 - y) * np.log(1 - model.score(x, bounds)))
    for name, g in model.gradient(x, bounds, y).items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            was, step = model.p[name][at], 1e-6
            model.p[name][at] = was + step
            up = loss()
            model.p[name][at] = was - step
            slope = (up - loss()) / (2 * step)
            model.p[name][at] = was
            assert g[at] == pytest.approx(slope, abs=1e-6), (name, at)


def test_quality_cases(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs(None, "", " \n", "a", "b " * 5000, (None, "a"), (7, "a"), (7, "a")), none).collect()
    assert len(rows) == 8 and all(x["score"] == 0.5 for x in rows)
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    model = quality.Model()
    x, bounds = quality.passages(*column_bytes(pa.array(["", "a b", "", "c " * 100, "a b"])))
    assert bounds.tolist() == [0, 1, 2, 3, 6, 7] and np.isfinite(x).all()
    y = model.score(x, bounds)
    assert y[1] == pytest.approx(y[4]) and y[0] == pytest.approx(y[2])
    assert np.add.reduceat(model.attention(x, bounds), bounds[:-1]) == pytest.approx(np.ones(5), abs=1e-5)


def kneser_ney(train, texts, d, m, share, depth):
    """By plain counting: evidence and both models' log-likelihoods per word of each text."""
    words = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    events = lambda w: [((i > depth, w[max(0, i - depth) : i]), (w[:i][-2:-1], w[:i][-1:]), w[i] if i < len(w) else 0) for i in range(len(w) + 1)]
    n = Counter()
    for t, y in train:
        for w in set(words(t)):
            for h, s, x in events(w):
                n[y, h, s, x] += 1
    often = Counter()
    for (_, h, _, _), c in n.items():
        often[h] += c
    n = Counter({k: c for k, c in n.items() if often[k[1]] > 1})
    seen = {(h, s, x) for _, h, s, x in n}
    follows = Counter((s, x) for _, s, x in seen)
    after = lambda s: [c for (r, _), c in follows.items() if r == s]

    def lowest(s, x):
        c = after(s)
        return (max(follows[s, x] - d, 0) + d * len(c) / 257) / sum(c) if c else 1 / 257

    def p(y, h, s, x):
        of = lambda cs: Counter({k: sum(v for (c, g, _, z), v in n.items() if c in cs and g == h and z == k) for k in {z for _, g, _, z in n if g == h}})
        both, own = of((0, 1)), of((y,))
        total, mine = sum(both.values()), sum(own.values())
        if not total:
            return lowest(s, x)
        shared = (max(both[x] - d, 0) + d * sum(v > 0 for v in both.values()) * lowest(s, x)) / total
        return (max(own[x] - d, 0) + (d * sum(v > 0 for v in own.values()) + m) * shared) / (mine + m)

    out = []
    for t in texts:
        ws = words(t)
        ll = {w: [sum(math.log(p(y, *e)) for e in events(w)) for y in (1, 0)] for w in set(ws)}
        evidence = sum(math.log(1 - share + share * math.exp(a - b)) for a, b in ll.values()) / math.sqrt(max(len(ws), 1))
        out.append((evidence, *(sum(ll[w][k] for w in ws) / max(len(ws), 1) for k in (0, 1))))
    return out


def test_toxicity_is_kneser_ney(docs, spark):
    train = [("zor zorish zor ok", 1), ("Zorer ok, day 9", 0), ("an ok day é", 0), ("aaaaaaaaaaaaaaaa aaa", 1), ("zo", 1)]
    texts = ["zor ok ok ok", "zorish zoru qq zor", "day", "aaaaaaaaaaaaaaaaaaaaaaaa é", "", None, "zor zor", "zor zor"]
    found = toxicity.histories(spark.createDataFrame([(*x, 0) for x in train] + [("tuned zor", 1, 1)], "text string, toxic int, tuning int"), 5, 2)
    model = toxicity.Model(found, False, 5, 2, 0.75, 2.0)
    expected = kneser_ney(train, texts, 0.75, 2.0, 0.1, 5)
    rows = docs(*texts).selectExpr("doc_id AS row", "doc_id", "coalesce(text, '') AS text")
    for table in (1000, 0):  # in arrays, and by joins
        found = {x["doc_id"]: tuple(x)[2:] for x in toxicity.likelihoods(rows, model, 0.1, table).collect()}
        for i, e in enumerate(expected):
            assert found[i] == pytest.approx(e, abs=1e-5), (table, i)


def test_toxicity_on_held_out_documents(docs, spark):
    r = random.Random(4)
    stems = ["grumph", "zorvil", "quackel"]
    texts, toxic = corpus(r, 700, lambda r: [r.choice(stems) + r.choice(["", "ish", "er", "est", "ung"]) for _ in range(6)])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs(*texts, extra=True), labels).collect()
    assert len(rows) == 700 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in rows)
    held = [x for x in rows if x["held_out"]]
    assert len(held) > 80 and np.mean([x["predicted"] == toxic[x["doc_id"]] for x in held]) > 0.95


def test_toxicity_cases(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs(None, "", " \n", "a", "b " * 5000, "x" * 200_000, (None, "a"), (7, "a"), (7, "a"), extra=True), none).collect()
    assert len(rows) == 9 and all(x["score"] == pytest.approx(0.5) for x in rows)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    a, b = toxicity.curve([(-1.0, 1, 99), (1.0, 99, 1)])
    assert 1 / (1 + np.exp(-(a + b))) == pytest.approx(0.99, abs=0.01)


def test_folds(spark):
    import zlib

    from pyspark.sql import functions as F

    rows = spark.range(50).select("id", toxicity.remainder(F.col("id"), 5).alias("r")).collect()
    assert all(x["r"] == zlib.crc32(str(x["id"]).encode()) % 5 for x in rows)


def test_pipeline_by_stages(spark, tmp_path):
    """Each stage's rows against brute force over what the stage before kept."""
    import corpus_pipeline
    from test_packing import check_pieces
    from test_text_operators import expected_groups, expected_hits, expected_lines

    r = random.Random(6)
    texts, junk = corpus(r, 100, lambda r: [f"{r.choice(GOOD).upper()}!!" for _ in range(60)])
    texts = [" ".join(f"{w}{r.randint(0, 99)}" if w.islower() else w for w in t.split()) for t in texts]
    near, passage = texts[0].split(), " ".join(f"b{i}" for i in range(20))
    block = "\n".join(" ".join(f"k{i}{j}" for j in range(20)) for i in range(4))
    texts += [texts[1], " ".join([*near[:-3], "x", "y", "z"]), f"{passage} and more", None, f"{texts[2]}\n{block}\n{block}", f"{texts[3]}\n{block}\nend of it", "w " * 30_000]
    junk += [junk[1], junk[0], 0, 0, 0, 0, 0]
    rows = [(i, t, "en", "s", len(t or ""), 7, 1.5) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, score double"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, y in enumerate(junk)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(x["doc_id"], x["text"]) for x in docs.orderBy("doc_id").collect()]
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        model = quality.train(docs, labels) if not kept else None
        docs = spark.read.parquet(str(tmp_path / name))
        now = {x["doc_id"]: x for x in docs.collect()}
        if name == "quality classifier":
            expected = {i: t for i, t in before if scored(model, features((t or "").encode())) >= 0.5}
            assert abs(len(expected) - junk.count(0)) <= 6
        elif name == "line dedup":
            gone = expected_lines([t for _, t in before], 50)
            assert sum(map(any, gone)) >= 2
            expected = {i: "\n".join(x for x, g in zip((t or "").split("\n"), gs) if not g) if any(gs) else t for (i, t), gs in zip(before, gone) if not gs or not all(gs)}
        elif name == "n-gram Jaccard join":
            expected = {i: t for (i, t), (n, c) in zip(before, expected_groups(before)) if c == i or not n}
        else:
            expected = {i: t for i, t in before if not expected_hits(t, [(0, passage)])[-1]}
        assert {i: x["text"] for i, x in now.items()} == expected, name
        assert all(x["n_lines"] == 7 and x["score"] == 1.5 for x in now.values())
        kept.append(set(now))
    assert kept[0] > kept[1] and kept[2] > kept[3] and 101 not in kept[2]
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), {x["doc_id"]: x["text"] for x in docs.collect()}, "byte_bpe_50k.json", 1, 2048)
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[-1]


def test_a_document_beyond_the_bound_is_passed_over(spark, docs):
    """Whichever comes first by its hash: a text longer than all that may be used does not keep the others out."""
    texts = ["zxq " * 30_000 if i == 7 else ("good plain words here" if i % 2 else "%% $$ 9 ##") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for least in (100_000, 50_000):
        model = quality.train(docs(*texts), labels, characters=least)
        assert model.constant is None
        got = {r["doc_id"]: r["score"] for r in quality.score(docs(*texts), model).collect()}
        assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(40) if i != 7)


def test_labels_of_no_document_take_no_place_in_the_sample(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    few = docs(*[(4000 + i, "good plain words here" if i % 2 else "%% $$ 9 ##") for i in range(40)])
    model = quality.train(few, labels, sample=10)
    assert model.constant is None
    # rows that repeat an id are one document of the sample
    again = few.union(few).union(few)
    assert quality.train(again, labels, sample=10).constant is None
