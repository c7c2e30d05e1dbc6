import zlib
from collections import defaultdict

import numpy as np

from sumfold.llm import orc_tokens, packing
from sumfold.llm.packing import Windows
from sumfold.llm.tokens import Encoder, public_path


def check_pieces(rows, texts, file, end, capacity):
    e = Encoder(public_path(file))
    ids = {i: np.frombuffer(e.encode(t), "<u4").tolist() + [end] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert piece == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(piece) == r["length"] > 0
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, total in [(by_doc[i], len(ids[i])) for i in ids]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total
    for spans in by_sequence.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= capacity
    return by_sequence


def test_windows_fit_best_and_emit_the_fullest():
    w = Windows(10, 2, 3)
    ids = lambda n: b"\0" * 4 * n
    assert list(w.place("a", ids(6))) == [] and list(w.place("b", ids(7))) == []
    # 4 and 3 ids are free: the best fit for 3 is filled and leaves
    assert [p[0] for p in w.place("c", ids(3))] == ["b", "c"]
    assert list(w.place("d", ids(9))) == []
    # 1 id free is less than a cut is worth: the fullest leaves as it is
    assert [p[0] for p in w.place("e", ids(5))] == ["d"]
    # none fits; the fullest has 4 ids free, filled by cutting
    assert [(p[0], len(p[2]) // 4) for p in w.place("f", ids(8))] == [("a", 6), ("f", 4)]
    assert sorted((p[0], p[1]) for p in w.close()) == [("e", 0), ("f", 4)]


def test_pack(docs):
    texts = {0: "one two three", 1: None, 2: "", 3: "lorem ipsum dolor " * 900, 4: "x y z " * 30, 5: "ÄÖ <|endoftext|> 　", 6: "same text", 7: "same text"}
    df = docs(*texts.items(), extra=True).repartition(3)
    rows = packing.pack(df, capacity=64, open_windows=2, min_cut=4, merge_partitions=2).collect()
    by_sequence = check_pieces(rows, texts, "byte_bpe_50k.json", 1, 64)
    filled = [sum(n for _, n in s) for s in by_sequence.values()]
    assert sum(filled) / (64 * len(filled)) > 0.9
    digest = packing.digests(packing.pack(df)).where("doc_id = 1").first()
    assert digest["ids_crc32"] == zlib.crc32((1).to_bytes(4, "little")) and digest["doc_tokens"] == 1


def test_pack_nothing(docs, spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.pack(docs((None, "a"), (None, "a"))).count() == 2


def test_orc_round_trip(docs, spark, tmp_path):
    texts = {5: "one two", 3: None, 9: "", 1: "Ünïcode wörds " * 300, 7: "one two"}
    path = orc_tokens.write(docs(*texts.items(), extra=True), str(tmp_path / "orc"))
    rows = {r["doc_id"]: r for r in orc_tokens.positions(orc_tokens.read(spark, path)).collect()}
    e, at = Encoder(public_path("word_bpe_49k.json")), 0
    for i in sorted(texts):
        ids = e.encode(texts[i]) + (2).to_bytes(4, "little")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {r["doc_id"] for r in orc_tokens.read(spark, path, [3, 7]).collect()} == {3, 7}


def test_orc_order_of_ties_and_nothing(docs, spark, tmp_path):
    path = orc_tokens.write(docs((None, "z"), (2, "b"), (2, "a a"), (2, "b")), str(tmp_path / "a"))
    rows = [tuple(r) for r in orc_tokens.positions(orc_tokens.read(spark, path)).orderBy("start").collect()]
    assert [r[0] for r in rows] == [None, 2, 2, 2] and [r[2] for r in rows] == [2, 3, 2, 2]
    path = orc_tokens.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"))
    assert orc_tokens.positions(orc_tokens.read(spark, path)).count() == 0


def test_orc_metadata(docs, spark, tmp_path):
    """Stripes of one file hold ranges of ids, with row indexes and Bloom filters; a search passes over the others."""
    rows = [(i, " ".join(f"w{i * 7 % 9973}x{j}" for j in range(60))) for i in range(12_000)]
    path = orc_tokens.write(docs(*rows).coalesce(1), str(tmp_path / "orc"), stripe_bytes=1 << 16, row_index_stride=1000)
    orc, conf = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop.conf.Configuration()
    stripes, streams, total = [], set(), 0
    for f in (tmp_path / "orc").glob("*.orc"):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(f)), orc.OrcFile.readerOptions(conf))
        column = 1 + [reader.getSchema().getFieldNames()[i] for i in range(5)].index("doc_id")
        total += reader.getNumberOfRows()
        batches = reader.rows()
        for i, stripe in enumerate(reader.getStripes()):
            statistics = reader.getStripeStatistics()[i].getColumnStatistics()[column]
            stripes.append((statistics.getMinimum(), statistics.getMaximum()))
            found = batches.readStripeFooter(stripe).getStreamsList()
            streams |= {str(x.getKind()) for x in found if x.getColumn() == column}
        batches.close()
    stripes.sort()
    assert total == 12_000 and len(stripes) >= 4
    assert all(a[1] < b[0] for a, b in zip(stripes, stripes[1:]))
    assert "ROW_INDEX" in streams and any(x.startswith("BLOOM_FILTER") for x in streams)
    plan = orc_tokens.read(spark, path, [17])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(doc_id,17)]" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan or "In(doc_id" in plan
    assert [r["doc_id"] for r in orc_tokens.read(spark, path, [17]).collect()] == [17]


def test_long_texts(docs, spark, tmp_path):
    text = "x" * 100_000 + " é word" * 50_000
    df = docs((4, text), (5, "a"))
    ids = {i: Encoder(public_path("word_bpe_49k.json")).encode(t) + (2).to_bytes(4, "little") for i, t in ((4, text), (5, "a"))}
    rows = orc_tokens.positions(orc_tokens.read(spark, orc_tokens.write(df, str(tmp_path / "long")))).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(i, len(x) // 4, zlib.crc32(x)) for i, x in ids.items()]
    check_pieces(packing.pack(df).collect(), {4: text, 5: "a"}, "byte_bpe_50k.json", 1, 2048)
