import math
import random

import numpy as np
import pytest

from networks import DISTANCES, ROADS
from sumfold.functions.binary import digits, log2_exact
from sumfold.functions.semiring import min_plus, sum_product
from sumfold.operators import dft, paths
from sumfold.operators.graph import Digraph, UndirectedGraph
from sumfold.operators.matrix import LabelMismatch, Matrix
from sumfold.plans.elimination import elimination_order
from sumfold.plans.engine import Mode
from sumfold.plans.jointree import JoinForest
from sumfold.plans.triangulation import is_triangulated, triangulated
from sumfold.sources import gr
from sumfold.sources.net import FormatError
from sumfold.sources.sinks import text_table, write_counts, write_dot

PLUS = sum_product("bigint")


def cells(m):
    return {(r["row"], r["col"]): r["__value"] for r in m.df.collect()}


def test_matrix_arithmetic(spark):
    r = random.Random(1)
    n, k, m = 3, 2, 4
    a = [[r.randint(0, 9) for _ in range(k)] for _ in range(n)]
    b = [[r.randint(0, 9) for _ in range(m)] for _ in range(k)]
    x, y = Matrix.from_rows(spark, PLUS, a), Matrix.from_rows(spark, PLUS, b)
    product = np.array(a) @ np.array(b)
    assert cells(x.multiply(y)) == {(i, j): product[i, j] for i in range(n) for j in range(m)}
    assert cells(x.add(x)) == {(i, j): 2 * a[i][j] for i in range(n) for j in range(k)}
    with pytest.raises(LabelMismatch):
        x.add(y)
    with pytest.raises(LabelMismatch):
        y.multiply(y)


def test_matrix_shapes(spark):
    m = Matrix.from_cells(spark, PLUS, [((0, 0), 1), ((0, 1), 2), ((1, 0), 3), ((1, 1), 4), ((1, 1), 5)])
    assert m.find(1, 1) == 5 and m.is_square()
    with pytest.raises(KeyError):
        m.find(2, 0)
    with pytest.raises(LabelMismatch):
        Matrix.from_cells(spark, PLUS, [((0, 0), 1), ((1, 1), 2)])
    assert Matrix.from_cells(spark, PLUS, [((0, 0), 1), ((1, 1), 2)], default=7).find(0, 1) == 7
    assert m.extend(range(3), range(3)).find(2, 2) == 0
    with pytest.raises(LabelMismatch):
        m.project([5], [0])
    blocks = m.blocks()
    assert blocks[0].find(0, 0) == 1 and cells(Matrix.joined(*blocks)) == cells(m)
    with pytest.raises(LabelMismatch):
        m.append_rows(m)
    assert m.append_rows(Matrix.from_cells(spark, PLUS, [((2, 0), 8), ((2, 1), 9)])).find(2, 1) == 9
    new = spark.createDataFrame([(0, 0, 10, 1), (0, 0, 11, 2)], "row bigint, col bigint, __value bigint, nth int")
    assert m.update(new).find(0, 0) == 11
    assert m.map(lambda r, c, v: [v[0] + r]).find(1, 0) == 4
    assert m.all(lambda v: v[0] > 0) and not m.extend(range(3), range(3)).all(lambda v: v[0] > 0)


def test_star(spark):
    r = random.Random(3)
    edges = {(i, j): float(r.randint(0, 9)) for i in range(5) for j in range(5) if r.random() < 0.4}
    expected = {(i, j): 0.0 if i == j else edges.get((i, j), math.inf) for i in range(5) for j in range(5)}
    for k in range(5):
        for i in range(5):
            for j in range(5):
                expected[i, j] = min(expected[i, j], expected[i, k] + expected[k, j])
    df = spark.createDataFrame([(i, j, w) for (i, j), w in edges.items()], "row bigint, col bigint, __value double")
    found = cells(Matrix.of(df, min_plus(), range(5), range(5)).quasi_inverse(spark))
    assert {k: found.get(k, math.inf) for k in expected} == expected
    values = [[0.0, 0.25, 0.0], [0.1, 0.0, 0.3], [0.2, 0.0, 0.5]]
    star = cells(Matrix.from_rows(spark, sum_product(), values).quasi_inverse(spark))
    inverse = np.linalg.inv(np.eye(3) - np.array(values))
    assert all(star[i, j] == pytest.approx(inverse[i, j]) for i in range(3) for j in range(3))


def roads(spark):
    return Digraph.from_adjacency(spark, ROADS)


def test_distances(spark):
    found = {r["id"]: r["distance"] for r in paths.distances(roads(spark), roads(spark).vertices.where("id = 0")).collect()}
    assert [found[i] for i in range(9)] == DISTANCES


def small(spark):
    """Two graphs that share vertices, one vertex that does not reach the target."""
    one = Digraph.from_adjacency(spark, {0: [(1, 2.0)], 1: [(2, 2.0), (2, 1.0)], 2: []})
    other = Digraph.from_adjacency(spark, {3: [(1, 5.0)], 2: [(0, 1.0)], 4: []})
    return [one, other]


@pytest.mark.parametrize("mode", [Mode.FUSION, Mode.MESSAGES])
def test_systems(spark, mode):
    asked = paths.Query((0, 1, 3, 4, 2), 2)
    assert paths.single_target(small(spark), asked, mode) == [3.0, 1.0, 6.0, math.inf, 0.0]


def test_systems_solved(spark):
    asked = paths.Query((0, 1, 3, 4, 2), 2)
    assert paths.single_target_solved(small(spark), asked) == [3.0, 1.0, 6.0, math.inf, 0.0]


def test_decomposition_keeps_the_graph(spark):
    g = roads(spark)
    parts = paths.decomposition(g)
    assert len(parts) > 1
    merged = Digraph.merged(parts)
    assert sorted(map(tuple, merged.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert merged.vertex_count() == 9


def test_graph_operators(spark):
    g = roads(spark)
    assert g.is_undirected() and g.is_connected() and g.edge_count() == 28
    assert not g.has_zero_self_loops() and g.with_self_loops().has_zero_self_loops()
    one_way = Digraph.from_adjacency(spark, {0: [(1, 1.0), (1, 3.0)], 2: [(2, 1.0)], 5: [(6, 1.0)]})
    assert not one_way.is_undirected() and not one_way.is_connected()
    assert one_way.cheapest_edges().edge_count() == 3
    assert sorted(map(tuple, one_way.flipped().edges.collect()))[0] == (1, 0, 1.0)
    near = {r["id"]: r["neighbours"] for r in one_way.neighbours().collect()}
    assert near == {0: [1], 1: [0], 5: [6], 6: [5]}
    ids = spark.createDataFrame([(0,), (1,)], "id bigint")
    assert one_way.induced(ids).edge_count() == 2 and one_way.without(ids).vertex_count() == 3
    assert one_way.outgoing_subgraph(ids).edge_count() == 2
    assert {r["id"]: r["component"] for r in one_way.components().collect()} == {0: 0, 1: 0, 2: 2, 5: 5, 6: 5}


def test_undirected_and_triangulation():
    assert UndirectedGraph().is_complete() and UndirectedGraph([1, 2, 3], [(1, 2), (1, 3), (2, 3)]).is_complete()
    assert not UndirectedGraph([3], [(1, 2)]).is_complete()
    with pytest.raises(ValueError):
        UndirectedGraph([1], [(1, 1)])
    ring = UndirectedGraph(edges=[(i, (i + 1) % 6) for i in range(6)])
    filled, cliques = triangulated(ring)
    assert not is_triangulated(ring) and is_triangulated(filled)
    assert filled.vertices() == ring.vertices() and ring.edges() <= filled.edges() and all(len(c) == 3 for c in cliques)


def test_plans(spark):
    class Labelled:
        def __init__(self, *label):
            self.label = frozenset(label)

    factors = [Labelled("a", "b"), Labelled("b", "c"), Labelled("c", "d"), Labelled("x", "y")]
    forest = JoinForest.build(factors, [{"a", "d"}, {"x"}])
    forest.check()
    assert len(forest.trees()) == 2 and len(forest.trees_with_queries()) == 2
    stats = forest.stats({"a": 2, "b": 2, "c": 2, "d": 2, "x": 3, "y": 5})
    assert sum(stats.valuations) == 4 and stats.variables == 6 and max(stats.widest_frames) == 15
    assert stats.message_cost() > 0 and stats.path_cost() > 0 and stats.fusion_cost() > 0
    assert "digraph" in forest.dot()
    assert elimination_order([f.label for f in factors[:3]], {"a", "d"}) in (["b", "c"], ["c", "b"])


def test_gr_files(spark, tmp_path):
    path = tmp_path / "x.gr"
    path.write_text("c a comment\n\np sp 3 3\na 1 2 5\na 2 3 7\na 1 2 4\n")
    g = gr.read(spark, str(path))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 4.0), (1, 2, 5.0), (2, 3, 7.0)]
    assert gr.read_first(spark, str(path), 1).edge_count() == 1
    gr.write(g, str(tmp_path / "out"))
    assert gr.read(spark, str(tmp_path / "out")).edge_count() == 3
    for bad in ("p sp 4 3\na 1 2 5\n", "p sp 2 1\na 1 2 5\nb\n", "a 1 2 3\n"):
        path.write_text(bad)
        with pytest.raises(FormatError):
            gr.read(spark, str(path))


def test_sinks(spark, tmp_path):
    write_dot(spark, JoinForest([]), str(tmp_path / "dot"))
    write_counts(spark, "q", str(tmp_path / "counts"))
    write_counts(spark, "r", str(tmp_path / "counts"))
    assert spark.read.csv(str(tmp_path / "counts"), header=True).count() == 2
    assert text_table(["a", "b"], [[1, "xyz"]]).split("\n")[2] == "1 | xyz"
    with pytest.raises(ValueError):
        text_table(["a"], [[1, 2]])


@pytest.mark.parametrize("numbers", [[1, 2, 3, 4], [1, 4], [0] * 8, [3.5, -1, 2, 8, 0, 1, -7, 2]])
def test_dft(spark, numbers):
    assert dft.values(spark, numbers) == pytest.approx(list(np.fft.fft(numbers)), abs=1e-8)


def test_dft_by_messages_and_errors(spark):
    assert dft.values(spark, [1, 2, 3, 4], Mode.MESSAGES) == pytest.approx([10, -2 + 2j, -2, -2 - 2j], abs=1e-8)
    for bad in ([1], [1, 2, 3], []):
        with pytest.raises(ValueError):
            dft.values(spark, bad)


def test_binary():
    assert log2_exact(8) == 3 and log2_exact(6) is None and log2_exact(0) is None
    assert digits(6) == [0, 1, 1] and digits(1, 3) == [1, 0, 0]
    with pytest.raises(ValueError):
        digits(8, 3)


def test_windowed_factor_over_a_stream(spark, tmp_path):
    from sumfold.functions.semiring import counting
    from sumfold.streaming.factors import windowed_factor

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-02 00:00:00", "a")]
    df = spark.createDataFrame(rows, "t string, kind string").selectExpr("timestamp(t) AS ts", "kind", "1 AS one")
    df.write.parquet(str(tmp_path / "in"))
    table = windowed_factor(df, counting(), ["kind"], "one")
    assert sorted(r["__value"] for r in table.collect()) == [1, 1, 2]
    stream = windowed_factor(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), counting(), ["kind"], "one")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["__value"] for r in spark.sql("SELECT * FROM windows").collect()) == [1, 2]


def test_dft_of_all_events_zero_padded(spark, tmp_path):
    from sumfold.queries import dft_all_events

    numbers = [math.sin(7 * i) * 100 + i % 13 for i in range(100)]
    spark.createDataFrame(list(enumerate(numbers)), "event_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = dft_all_events(spark, str(tmp_path)).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(128))
    assert [complex(r["re"], r["im"]) for r in rows] == pytest.approx(list(np.fft.fft(numbers, 128)), abs=1e-8)
    for bad in ([], [(-1, 1.0, 0.0)], [(None, 1.0, 0.0)]):
        with pytest.raises(ValueError):
            dft.padded(spark.createDataFrame(bad, "i bigint, re double, im double"))


def test_components_of_all_lines(spark, tmp_path):
    from sumfold.queries import graph_components

    lines = [(1, 1, 1.0), (2, 1, 5.0), (3, 2, 7.0)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = graph_components(spark, str(tmp_path)).collect()
    assert {r["id"]: r["component"] for r in rows} == {1: -2, 2: -2, -2: -2, 3: -3, -3: -3}
