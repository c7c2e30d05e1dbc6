"""Line dedup, licences, decontamination, n-gram groups and fingerprints against brute force."""

import hashlib
import itertools
import os
import random
import re
from pathlib import Path

import numpy as np
import pytest

from sumfold.llm import decontamination, fingerprints, licenses, line_dedup, ngram_join
from sumfold.llm.license_texts import DIGESTS, TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split("[ \t\n\v\f\r]+", (text or "").translate(LOWER)) if w]


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# line dedup -------------------------------------------------------------------------------------


def expected_lines(texts, least):
    """By brute force: for each text in order, which of its lines lie in a run seen before."""
    seen, out = set(), []
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x]
        gone, new = [False] * len(lines), []
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[a:b] = [True] * (b - a)
                    seen.add(run)
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(docs, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(7)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(12)]
    expected = expected_lines(texts, 6)
    found = {x["doc_id"]: x for x in line_dedup.dedup(docs(*texts, extra=True).coalesce(2), min_words=6).collect()}
    for i, (text, gone) in enumerate(zip(texts, expected)):
        lines = [x for x in text.split("\n") if x]
        assert [x for x in found[i]["text"].split("\n") if x] == [x for x, g in zip(lines, gone) if not g], (seed, i)
        assert (found[i]["n_lines"], found[i]["n_removed"]) == (len(lines), sum(gone))
        assert found[i]["n_chars"] == (len(found[i]["text"]) if any(gone) else 3) and found[i]["row"] == "x"


def test_line_dedup_cases(docs, spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", long, f"intro\n{long}\n\noutro", long, "\n\n", f"{long}x"]
    found = {x["doc_id"]: x["text"] for x in line_dedup.dedup(docs(*texts)).collect()}
    assert found == {0: None, 1: "", 2: long, 3: "intro\noutro", 4: "", 5: "\n\n", 6: f"{long}x"}
    named = docs(long, long).selectExpr("'d' || doc_id AS doc_id", "text", "'a' AS n_lines", "'b' AS _line_dedup_row", "5 AS n_removed")
    assert {(x["doc_id"], x["_line_dedup_row"], x["n_removed"]) for x in line_dedup.dedup(named).collect()} == {("d0", "b", 0), ("d1", "b", 1)}
    huge = "\n".join(f"{i} {long}" for i in range(3000))
    assert [x["n_removed"] for x in line_dedup.dedup(docs(huge, huge)).orderBy("doc_id").collect()] == [0, 3000]
    equal = [x["n_removed"] for x in line_dedup.dedup(docs((1, long), (1, long), (None, long))).collect()]
    assert sorted(equal) == [0, 1, 1]
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# licences ---------------------------------------------------------------------------------------


def test_licenses(docs, spark):
    _, title, mit = TEXTS[0]
    wrapped = re.sub(r"(.{50,60}) ", r"\1\n", mit)
    texts = [
        f"{title}\n\nCopyright (c) 2020 Somebody\n\n{wrapped}".upper(),
        mit.replace('"', "'").replace("sublicense", "sub-license"),
        mit + " And more.",
        "Hello.\nReleased under the  MIT  Licence!\n- SPDX-License-Identifier: Apache-2.0\nbye",
        None,
        "",
        "Released under the MIT License.",
        "Released under the MIT License.",
    ]
    rows = licenses.scan(docs(*texts, extra=True), licenses.default_texts(spark), licenses.default_notices(spark)).collect()
    found = {r["doc_id"]: (r["license"], r["notices"]) for r in rows}
    assert len(rows) == 8
    assert found[0] == ("MIT", "") and found[1] == ("MIT", "") and found[2] == (None, "")
    assert found[3] == (None, "Apache-2.0,MIT") and found[4] == found[5] == (None, "") and found[6] == found[7] == (None, "MIT")
    for options in ({"most_notices": 0}, {"broadcast_texts": 0}):
        again = licenses.scan(docs(*texts), licenses.default_texts(spark), licenses.default_notices(spark), **options).collect()
        assert {r["doc_id"]: (r["license"], r["notices"]) for r in again} == found
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"] for r in rows if r["canonical_sha256"] == empty} == {4, 5}
    twice = licenses.scan(docs((1, "a"), (1, "a"), (1, "b"), (None, "a")), licenses.default_texts(spark), licenses.default_notices(spark))
    assert twice.count() == 4
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), licenses.default_texts(spark), licenses.default_notices(spark)).count() == 0


def test_licenses_as_published(spark):
    folder = "/usr/share/common-licenses"
    names = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl"}
    files = [f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if names.get(f, f) in dict(DIGESTS)]
    rows = [(f, Path(folder, f).read_text().replace("\n", "\r\n").upper()) for f in files]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.default_texts(spark), licenses.default_notices(spark))
    assert {r["doc_id"]: r["license"] for r in found.collect()} == {f: names.get(f, f) for f in files}


# decontamination --------------------------------------------------------------------------------


def expected_hits(text, items):
    w = plain(text)
    hit, ids = set(), set()
    for i, t in items:
        v = plain(t)
        n = min(13, len(v))
        for a in range(len(v) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit.update(range(b, b + n))
                    ids |= {str(i)} if i is not None else set()
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_contamination(docs, spark, seed, broadcast):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "cd", "é", "9", "zz", "Q"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 14, 13, 5, 2, 1, 0))]
    items += [(7, items[0][1]), (8, None), (None, "zz zz zz zz zz zz zz zz zz zz zz zz zz zz"), (10, "zz " * 20)]
    texts = [None, "", "...", items[0][1].upper(), "zz " * 40]
    for _ in range(12):
        a, b = r.choice(items[:3])[1].split(), r.randint(0, 15)
        texts.append(", ".join([word() for _ in range(r.randint(0, 20))] + a[b : b + r.randint(5, 20)] + [word() for _ in range(r.randint(0, 40))]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    options = {} if broadcast else {"broadcast_words": 0}
    found = {x[0]: tuple(x)[1:] for x in decontamination.contamination(docs(*texts, extra=True), bench, **options).collect()}
    assert found == {i: expected_hits(t, items) for i, t in enumerate(texts)}
    kept = {x["doc_id"] for x in decontamination.clean(docs(*texts, extra=True), bench, **options).collect()}
    assert kept == {i for i, t in enumerate(texts) if not expected_hits(t, items)[-1]}


def test_contamination_of_nothing(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(docs("a b", (None, None), (1, "a b")), none).collect()
    assert len(rows) == 3 and not any(r["contaminated"] for r in rows)
    assert decontamination.contamination(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    odd = docs("a b", "c " * 100_000).selectExpr("*", "1 AS _clean_row", "2 AS _clean_text", "3 AS _clean_bad")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for words in (0, 1000):
        assert [tuple(x)[2:] for x in decontamination.clean(odd, item, broadcast_words=words).collect()] == [(1, 2, 3)]


def test_winnowing_keeps_a_hash_of_every_span():
    g = np.array([5, 3, 3, 9, 1, 7, 7, 7, 2], "u8")
    at = set(decontamination.kept(g, 3).tolist())
    assert all(at & set(range(i, i + 3)) for i in range(7))
    assert decontamination.kept(g[:2], 3).tolist() == []


# n-gram groups ----------------------------------------------------------------------------------


def shingles(text, n=5):
    w = spaced(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def expected_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    first = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return [(len(s), first[g]) for s, g in zip(sets, group)]


@pytest.mark.parametrize("share", [1, 100])
@pytest.mark.parametrize("seed", range(2))
def test_groups(docs, monkeypatch, seed, share):
    monkeypatch.setattr(ngram_join, "_FEW", 2)
    r = random.Random(seed)
    texts = []
    for _ in range(5):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.randint(6, 60))]
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 5)}"
            texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(40)]
    for i in range(6):  # neighbours link, the ends do not
        texts.append(" ".join(chain[i * 2 : i * 2 + 30]))
    texts += [None, "", " \n", "short", "Short", "a b c d", "a b c d e", "short one"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    found = ngram_join.groups(ngram_join.numbered(docs(*rows)), fragment_size=200, pivots=1, block=3, frequent_share=share).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == {i: e for (i, _), e in zip(rows, expected_groups(rows))}
    kept = ngram_join.one_of_each(docs(*rows, extra=True)).collect()
    expected = {i for (i, t), (n, c) in zip(rows, expected_groups(rows)) if c == i or not n}
    assert sorted(x["doc_id"] for x in kept) == sorted(expected) and kept[0]["k"] == "y"


def test_groups_cases(docs, spark):
    text = "a b c d e f g h"
    rows = ngram_join.groups(ngram_join.numbered(docs((3, text), (3, text), (None, text), (1, "z"), (None, None)))).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == [("1", 1, "1"), ("3", 4, "3"), ("3", 4, "3"), ("None", 0, "None"), ("None", 4, "3")]
    assert sum(r["stays"] for r in rows) == 3
    assert ngram_join.groups(ngram_join.numbered(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# fingerprints -----------------------------------------------------------------------------------


def test_fingerprints(docs):
    r = random.Random(5)
    texts = [" ".join(r.choice("äbcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 200))) for _ in range(40)]
    texts[3], texts[4], texts[7] = None, "", texts[8]
    rows = {x["doc_id"]: x for x in fingerprints.neighbours(docs(*texts, extra=True).repartition(3), scale=1, parts=7).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        changed = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        x = rows[i]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = shingles(t), shingles(changed), shingles(n)
        j = lambda p, q: len(p & q) / len(p | q) if p and q else float(not p and not q)
        assert x["near_edited"] == pytest.approx(j(a, b)) and x["near_next"] == pytest.approx(j(a, c))
    assert rows[7]["fingerprint"] == rows[8]["fingerprint"] and rows[7]["near_next"] == 1.0


def test_fingerprints_below_the_threshold(docs):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 3, 5, 6, 40, 300, 301, 900)] + ["long " * 20_000]
    hashes: dict[tuple, str] = {}

    def sketch(text):
        for s in shingles(text) - set(hashes):
            hashes[s] = fingerprints.shown(fingerprints.sketches([" ".join(s)], 5, 1)[0])
        own = {hashes[s] for s in shingles(text)}
        low = {h for h in own if int(h, 16) < (1 << 40) // 4}
        return low or set(sorted(own)[:1])

    likeness = lambda a, b: len(a & b) / len(a | b) if a and b else float(a == b)
    rows = {x["doc_id"]: x for x in fingerprints.neighbours(docs(*texts), scale=4).collect()}
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        x = rows[i]
        assert fingerprints.read(x["fingerprint"]) == sketch(t) and fingerprints.read(x["edited_fingerprint"]) == sketch(changed), i
        assert x["near_edited"] == pytest.approx(likeness(sketch(t), sketch(changed))) and x["near_next"] == pytest.approx(likeness(sketch(t), sketch(following)))


def test_fingerprint_cases(docs, spark):
    one = fingerprints.neighbours(docs("a b c")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 5
    ties = fingerprints.neighbours(docs((1, "b b b b b b"), (None, "c"), (1, "a"), (1, "a")), parts=4).collect()
    assert len(ties) == 4
    assert fingerprints.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_estimate_and_merge():
    words = [f"w{i}" for i in range(4000)]
    big, part = " ".join(words), " ".join(words[:1000])
    a, b = fingerprints.sketches([big, part], 5, 4)
    near, contained = fingerprints.likeness(b, a)
    assert contained == pytest.approx(1.0) and near == pytest.approx(0.25, abs=0.05)
    assert fingerprints.read(fingerprints.merged(fingerprints.shown(a), fingerprints.shown(b), 4)) == fingerprints.read(fingerprints.shown(a))
    (tiny,) = fingerprints.sketches(["one two"], 5, 1 << 20)
    assert len(tiny) == 1 and fingerprints.merged(fingerprints.shown(tiny), "", 1 << 20) == fingerprints.shown(tiny)
