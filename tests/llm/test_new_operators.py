"""The digest tree, personal data and vector codes against plain code."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sumfold.llm import merkle, pii, vector_codes

# digest tree ------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    """The root, and for each leaf its (before, after) by level."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // 3 * 3
            ways[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 3])))
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], ways


def plain_proofs(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        ordered = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((ordered, *plain_tree([plain_leaf(r) for r in ordered])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (ordered, subroot, ways), above in zip(trees, upper):
        for r, way in zip(ordered, ways):
            way = way + above
            h = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                h = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for before, after in way:
                h = H(before, h, after)
            out.append((r[0], plain_leaf(r), subroot, root, H(*[a + b for a, b in way]), h, h == root))
    return sorted(out, key=str)


def proofs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    if extra:
        df = df.selectExpr("*", "'x' AS g", "1 AS k", "2L AS pos", "'y' AS leaf", "'z' AS way", "3 AS n", "'t' AS changed", "'r' AS root")
    return sorted(map(tuple, merkle.proofs(df, merkle.without_newlines_in_half()).collect()), key=str)


def test_proofs_of_sources_of_many_sizes(spark):
    sizes = {None: 4, "": 1, "a": 2, "b": 3, "é": 10, "z": 243, "zz": 250, "y": 730}
    rows, i = [], 0
    for s, n in sizes.items():
        for j in range(n):
            i += 1
            # ids far apart, on both sides of zero, so that digits are refined several times
            rows.append(((i * 7919 - 3000) * (10**9 if i % 3 else 1), s, "en", j, f"text {j}\nline" if j % 4 else "plain"))
    assert proofs(spark, rows) == plain_proofs(rows)


def test_proofs_of_ties_nulls_and_repeated_rows(spark):
    rows = [(7, "a", "en", 1, "one\ntwo")] * 40 + [(7, "a", "en", j, f"t{j}\n") for j in range(60)]
    rows += [(None, "a", None, None, None)] * 5 + [(None, "a", "en", 2, "x\n"), (-(2**63), "a", "en", 2, "x"), (2**63 - 1, None, None, 3, "é" * 1000 + "\n")]
    rows += [(12, None, "en", 0, ""), (13, None, "", 0, None), (14, "-", "-", 0, "-")]
    assert proofs(spark, rows, extra=True) == plain_proofs(rows)
    assert proofs(spark, rows[:1]) == plain_proofs(rows[:1])


def test_no_rows_have_no_proof(spark):
    assert proofs(spark, []) == []


def test_a_very_long_text_is_a_leaf(spark):
    rows = [(i, "s", "en", 1, "long line\n" * 400_000 if i == 2 else "short") for i in range(5)]
    assert proofs(spark, rows) == plain_proofs(rows)


def test_ways_lead_to_the_root_and_places_have_no_gap(spark):
    df = spark.createDataFrame([(i * 3, f"s{i % 4}", "en", 1, f"t{i}") for i in range(400)], "doc_id long, source string, lang string, n_chars int, text string")
    rows = merkle.manifest(df).collect()
    for s in range(4):
        own = sorted((r for r in rows if r["source"] == f"s{s}"), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(100)) and [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    assert all(r["leaf"] == r["changed"] for r in rows)


# personal data ----------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_passes(kind, value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def plain_base(text):
    return [(k, m.start(), m.end()) for k, form in enumerate(FORMS.values()) for m in re.finditer(form, text or "") if plain_passes(pii.KINDS[k], m.group())]


def plain_identifiers(text):
    word = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+/-]*+[0-9@](?:[._%+@/-]*+[A-Za-z0-9]++)*+"
    # the forms without what only spares work; an address starts where one can
    forms = [FORMS["email"], r"(?<![0-9])" + FORMS["ip"], r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}", FORMS["phone"]]
    out, end = [], 0
    found = list(re.finditer("|".join(f"(?:{x})" for x in [*forms, word]), text or ""))
    for i, m in enumerate(found):
        before = ("#" if i else "") + text[end : m.start()]
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None]
        end = m.end()
        shown = lambda s: s.lower().translate(str.maketrans("123456789", "000000000")).split()
        left, right = ["^", "^", "^", *shown(before[-pii.BEFORE :])], [*shown(after[: pii.AFTER]), "$"]
        patterns = [f"3 {left[-3]} {left[-2]} {left[-1]}", f"2 {left[-2]} {left[-1]}", f"1 {left[-1]} * {right[0]}"]
        value = m.group()
        kind = next((k for k, n in enumerate(pii.KINDS) if re.fullmatch(FORMS[n], value) and plain_passes(n, value)), None)
        if kind is not None or "@" in value or len(re.sub("[^0-9]", "", value)) >= 4:
            out.append((m.start(), m.end(), value, kind, patterns))
    return out


def plain_possible(kind, value):
    digits = len(re.sub("[^0-9]", "", value))
    return [re.search("[A-Za-z]", value), re.fullmatch("[0-9A-Fa-f.]+", value), 12 <= digits <= 19, 7 <= digits <= 15][kind]


def plain_spans(texts):
    found = [plain_identifiers(t) for t in texts]
    edges, kinds = defaultdict(set), {}
    for row in found:
        for _, _, value, kind, patterns in row:
            if kind is not None:
                kinds[value] = kind
            for p in patterns:
                edges[p].add(value)
    scores = seeds = {(v, k): 1.0 for v, k in kinds.items()}
    for _ in range(pii.ROUNDS):
        counting = {}
        for p, values in edges.items():
            for k in range(4):
                s = sum(scores.get((v, k), 0.0) for v in values)
                if s >= 3 - 1e-9 and s / (len(values) + 0.5) >= 0.8:
                    counting[p, k] = s / (len(values) + 0.5)
        missed = defaultdict(lambda: 1.0)
        for (p, k), c in counting.items():
            for v in edges[p]:
                missed[v, k] *= 1 - c
        scores = dict(seeds)
        for key, m in missed.items():
            scores[key] = max(scores.get(key, 0.0), 1 - m)
    out = []
    for text, row in zip(texts, found):
        base = plain_base(text)
        added = []
        for start, end, value, kind, patterns in row:
            fits = [(-scores[value, k], k) for k in range(4) if kind is None and scores.get((value, k), 0) >= 0.8 and any((p, k) in counting for p in patterns) and plain_possible(k, value)]
            if fits and not any(s < end and start < e for _, s, e in base):
                added.append((min(fits)[1], start, end))
        shown = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == i for k, _, _ in base) for i in range(4)]
        out.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + added)), len(added)))
    return out


def spans(df):
    return {r[0]: tuple(r[1:]) for r in pii.report(pii.spans(df)).collect()}


TEXTS = [
    None,
    "",
    "no data here, 12 of 2024",
    "mail me at a.b+c@mail.example.com, or a@b.c%d@e.f; not a@b nor @x.y",
    "hosts 1.2.3.4 and 300.1.2.3.4 and 1.2.3.4.5.6.7.8 and 001.02.3.255 and 0000000000000000000000001.2.3.4",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111111111 and 4111111111111111 x 4111  1111",
    "call +1 (243) 555-5526 or +49 30 1234567890123456 or +1-2 or +12.34.56.78. now",
    "日本語 a@b.co 🙂 +1 (243) 555-5526 🙂🙂 10.0.0.1é4111111111111111",
    "+1 (243) 555-5526 4111111111111111 10.0.0.1 a@b.co" * 3,
    "1 " * 40 + "1" * 40 + "-" * 5 + "+" * 5 + "@" * 5 + "." * 9,
]


def test_base_spans_and_defined_cases(spark, docs):
    df = docs(*TEXTS, extra=True)
    expected = plain_spans(TEXTS)
    assert spans(df) == {i: e for i, e in enumerate(expected)}
    assert pii.spans(df.limit(0)).count() == 0
    # rows of one id, and of none, are rows of their own
    same = docs((3, TEXTS[3]), (3, TEXTS[4]), (None, TEXTS[3]), (None, TEXTS[3]))
    got = sorted(map(str, (tuple(r) for r in pii.report(pii.spans(same)).collect())))
    assert got == sorted(map(str, ((i, *plain_spans([t])[0]) for i, t in ((3, TEXTS[3]), (3, TEXTS[4]), (None, TEXTS[3]), (None, TEXTS[3])))))


def test_contexts_of_seeds_find_identifiers_without_a_form(spark, docs):
    # twelve addresses after one phrase, and one that no form has; it induces a second pattern, which then finds another
    texts = [f"Some words {i} then please write to user{i}@mail{i}.example.com, thanks" for i in range(12)]
    texts += ["Some words then please write to hidden1234.at.example, thanks", "Copies of it: please write to hidden1234.at.example, thanks"]
    texts += [f"my private address is reader{i}@example.org ok" for i in range(9)] + ["my private address is hidden1234.at.example ok", "my private address is another9876.at.example ok"]
    # a phrase before numbers of every sort finds nothing
    texts += [f"the order number is {4000000 + i} today" for i in range(9)] + [f"the order number is +1 (243) 555-{5526 + i} today" for i in range(4)]
    # copies are one identifier, however many
    texts += ["seen by lone@example.com at 12345678 and"] * 50
    expected = plain_spans(texts)
    got = spans(docs(*texts))
    assert got == {i: e for i, e in enumerate(expected)}
    assert [i for i, e in enumerate(expected) if e[-1]] == [12, 13, 23, 24]
    start = texts[12].index("hidden")
    assert got[12][5] == f"email:{start}:{start + len('hidden1234.at.example')}"


def test_a_very_long_text_is_searched_whole(spark, docs):
    text = "word " * 300_000 + "x" * 500_000 + " " + "7" * 300_000 + " " + "1 " * 100_000 + " " + " ".join(f"u{i}@e.org" for i in range(3000)) + " +1 (243) 555-5526"
    (row,) = pii.report(pii.spans(docs(text))).collect()
    expected = [m.span() for m in re.finditer(r"u[0-9]+@e\.org", text)]
    assert row["n_email"] == 3000 and row["n_phone"] == 1
    assert row["spans"] == ",".join([*[f"email:{s}:{e}" for s, e in expected], f"phone:{len(text) - 17}:{len(text)}"])


# vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) by taking every distance in whole numbers, and the codebooks."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                members[nearest(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])])
        books = new
    found = [(i, l, [nearest(v, p) for p in range(parts)]) for i, l, v in kept]
    by_label = defaultdict(int)
    for _, l, best in found:
        by_label[l] += sum(x for x, _ in best)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), by_label[l], sha) for i, l, best in found], key=str)


def codes(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    if extra:
        df = df.selectExpr("*", "1 AS error", "'x' AS code", "2 AS of", "3 AS part", "4 AS entry")
    return sorted(map(tuple, vector_codes.compressed(df).collect()), key=str)


def test_codes_of_all_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), int(i % 5) if i % 7 else None, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(0, 0.3, (300, 48)))]
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_of_ties_gaps_and_repeated_rows(spark):
    one, two = [0.5] * 32, [0.25, -0.25] * 16
    rows = [(5, 1, one), (5, 1, two), (5, None, one), (None, None, two), (2, 1, None), (3, 1, [None] + one[1:]), (4, 1, [float("nan")] + one[1:]), (6, 1, [float("-inf")] + one[1:])]
    rows += [(100 + i, 2, [x / 8 + i // 2 for x in two]) for i in range(90)] + [(7, 3, [300.0 + i for i in range(32)]), (8, 3, [-1e5] * 32)]
    assert codes(spark, rows, extra=True) == plain_codes(rows)
    assert codes(spark, rows[:1]) == plain_codes(rows[:1])
    assert codes(spark, []) == [] and codes(spark, rows[4:8]) == []


def test_vectors_that_cannot_be_coded_are_errors(spark):
    for rows in ([(1, 1, [0.5] * 32), (2, 1, [0.5] * 48)], [(1, 1, [0.5] * 20)], [(1, 1, [1e30] * 32)]):
        with pytest.raises(Exception, match="one length|components|divide"):
            codes(spark, rows)


def test_bounds_never_drop_the_nearest_and_drop_most():
    r = np.random.default_rng(5)
    for width in (1, 2, 3, 4, 7, 16, 64):
        centres = r.integers(-300, 300, (64, width))
        x = centres[r.integers(0, 64, 2000)] + r.integers(-20, 20, (2000, width))
        x[:100] = centres[r.integers(0, 64, 100)]
        seen = [0, 0]
        index, best = vector_codes.Book(centres).nearest(x, seen)
        every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
        assert width < 4 or seen[1] < 0.3 * seen[0]


def test_codes_name_their_entries(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.3, (100, 32)))], "vec_id long, label int, embedding array<float>")
    books = vector_codes.fitted(df)
    for row in vector_codes.coded(df, books).join(df, "vec_id").collect():
        x = np.floor(np.array(row["embedding"], "f4").astype("f8") * 256).astype("i8")
        assert ((books.decoded(row["code"]) - x) ** 2).sum() == row["error"]
