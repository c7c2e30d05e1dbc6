"""Further operators as queries over whole tables, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.functions import radix
from sumfold.functions.scratch import settled, shared_dir
from sumfold.functions.semiring import counting, min_plus, sum_product
from sumfold.operators import paths
from sumfold.operators.bayes import Conditional, probability_table
from sumfold.operators.closed import ClosedSystem
from sumfold.operators.factor import COUNTERS, Factor
from sumfold.operators.graph import Digraph
from sumfold.operators.matrix import Matrix
from sumfold.operators.relation import Relation, answer
from sumfold.plans.engine import Mode, query, solve
from sumfold.sources import gr, net

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that all tasks share."""
    return f"{shared_dir(spark.range(1))}/{uuid.uuid4().hex}"


# factors ----------------------------------------------------------------------------------------


def _flags(spark: SparkSession, sf_dir: str) -> Factor:
    df = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return Factor.of(df, counting(), ["flag", "status"], [F.lit(1)])


_FLAGS = "(SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@_query(f"SELECT l_orderkey AS line, l_linenumber AS nth, n FROM lineitem JOIN {_FLAGS} ON flag = l_returnflag AND status = l_linestatus")
def factor_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's assignment looked up."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("nth"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return _flags(spark, sf_dir).lookups(lines).select("line", "nth", F.col("__value").alias("n"))


@_query(f"SELECT CASE flag WHEN 'R' THEN 'returned' ELSE flag END AS back, status AS state, 2 * n AS n FROM {_FLAGS}")
def factor_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables, values and payloads under other names."""
    f = _flags(spark, sf_dir).rename({"flag": "back", "status": "state"}).map_values("back", {"R": "returned"})
    return f.map_payload(lambda v: [2 * v[0]]).df.withColumnRenamed("__value", "n")


@_query(f"SELECT flag, status, n * CASE flag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 5 END AS n FROM {_FLAGS}")
def factor_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = Factor.from_lists(spark, counting(), [("flag", ["A", "N", "R"])], [2, 3, 5])
    return _flags(spark, sf_dir).combine(weights).checked().df.withColumnRenamed("__value", "n")


@_query("""SELECT CAST(3 AS BIGINT) AS flags, CAST(2 AS BIGINT) AS statuses, false AS neutral, true AS total, 5 * count(*) AS n FROM lineitem""")
def factor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame lengths, neutrality, totality of a factor filled up with zeroes, and a full projection."""
    f = _flags(spark, sf_dir)
    filled = Factor.of(f.df.unionByName(radix.assignments(spark, [("flag", ["A", "N", "R"]), ("status", ["F", "O"])]).select("flag", "status", F.lit(0).alias("__value"))), counting(), ["flag", "status"])
    row = (f.frame_length("flag"), f.frame_length("status"), f.is_identity, filled.is_total())
    total = Factor.from_lists(spark, counting(), [("w", [0, 1])], [2, 3]).combine(filled).project(()).df
    return total.select(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(row, ("bigint", "bigint", "boolean", "boolean"), ("flags", "statuses", "neutral", "total"))], F.col("__value").alias("n"))


@_query("SELECT * FROM (VALUES ('fusion', 2, 2), ('brute force', 2, 1)) AS v(plan, combines, projects)")
def operator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators that a plan over three tables emits."""
    t = lambda name: _read(spark, sf_dir, name)
    one, c = [F.lit(1)], counting()
    tables = [
        Factor.of(t("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation")), c, ["nk", "nation"], one, unique=True),
        Factor.of(t("customer").select(F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("ck")), c, ["nk", "ck"], one, unique=True),
        Factor.of(t("orders").select(F.col("o_custkey").alias("ck")), c, ["ck"], one),
    ]
    rows = []
    for mode in (Mode.FUSION, Mode.BRUTE_FORCE):
        COUNTERS.reset()
        query(tables, ["nation"], mode)
        rows.append((mode.value, COUNTERS.combines, COUNTERS.projects))
    return spark.createDataFrame(rows, "plan string, combines int, projects int")


@_query("SELECT p_brand AS brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS number FROM (SELECT DISTINCT p_brand FROM part)")
def dictionary_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.numbered(_read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")), "brand")


@_query("""SELECT CAST(position AS BIGINT) AS position, ['A', 'N', 'R'][position // 2 + 1] AS flag, ['F', 'O'][position % 2 + 1] AS status, coalesce(n, 0) AS n
FROM range(6) AS r(position) LEFT JOIN (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
ON f = ['A', 'N', 'R'][position // 2 + 1] AND s = ['F', 'O'][position % 2 + 1]""")
def radix_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor laid out flat."""
    flat = radix.assignments(spark, [("flag", ["A", "N", "R"]), ("status", ["F", "O"])])
    return flat.join(_flags(spark, sf_dir).df, ["flag", "status"], "left").select("position", "flag", "status", F.coalesce("__value", F.lit(0)).alias("n"))


# networks ---------------------------------------------------------------------------------------


def _network(spark: SparkSession, sf_dir: str) -> list[Factor]:
    """P(priority), P(flag | priority), P(status | flag), counted from all lines."""
    df = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = df.groupBy(F.col("o_orderpriority").alias("priority"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").cast("double").alias("n"))
    counts, s = settled(counts), sum_product()  # lines are read once

    def given(child: str, *parents: str) -> Factor:
        some, all_ = counts.groupBy(child, *parents).agg(F.sum("n").alias("p")), counts.groupBy(*parents).agg(F.sum("n").alias("q"))
        both = some.join(all_, list(parents)) if parents else some.crossJoin(F.broadcast(all_))  # one row
        return Factor.of(both, s, [child, *parents], [F.col("p") / F.col("q")], unique=True)

    return [given("priority"), given("flag", "priority"), given("status", "flag")]


_ASKED = [
    Conditional.of([("status", "F")], [("flag", "N")]),
    Conditional.of([("flag", "R")], [("status", "F"), ("priority", "1-URGENT")]),
    Conditional.of([("priority", "5-LOW"), ("status", "O")]),
    Conditional.of([("flag", "R")], [("flag", "A")]),
    Conditional.of([("flag", "R")], [("status", "X")]),
]

_NETWORK_SQL = """WITH c AS (SELECT o_orderpriority AS p, l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
p1 AS (SELECT p, sum(n) / (SELECT sum(n) FROM c) AS x FROM c GROUP BY p),
p2 AS (SELECT p, f, sum(n) / sum(sum(n)) OVER (PARTITION BY p) AS x FROM c GROUP BY p, f),
p3 AS (SELECT f, s, sum(n) / sum(sum(n)) OVER (PARTITION BY f) AS x FROM c GROUP BY f, s),
j AS (SELECT p1.p, p2.f, p3.s, p1.x * p2.x * p3.x AS x FROM p1 JOIN p2 ON p1.p = p2.p JOIN p3 ON p2.f = p3.f)
SELECT CAST(q AS BIGINT) AS query, round(v, 8) AS probability FROM (
SELECT 0 AS q, sum(CASE WHEN s = 'F' THEN x ELSE 0 END) / sum(x) AS v FROM j WHERE f = 'N'
UNION ALL SELECT 1, sum(CASE WHEN f = 'R' THEN x ELSE 0 END) / sum(x) FROM j WHERE s = 'F' AND p = '1-URGENT'
UNION ALL SELECT 2, sum(CASE WHEN p = '5-LOW' AND s = 'O' THEN x ELSE 0 END) / sum(x) FROM j
UNION ALL SELECT 3, 0.0 UNION ALL SELECT 4, 0.0)"""


@_query(_NETWORK_SQL)
def bn_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional probabilities of a network, a contradiction and an impossible condition among them."""
    return probability_table(_network(spark, sf_dir), _ASKED).select("query", F.round("probability", 8).alias("probability"))


@_query(_NETWORK_SQL)
def bn_probabilities_by_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_table(_network(spark, sf_dir), _ASKED, Mode.MESSAGES).select("query", F.round("probability", 8).alias("probability"))


@_query("SELECT CAST(i AS BIGINT) AS query, CAST(p AS DOUBLE) AS probability FROM (VALUES (0, 0.4), (1, 0.4), (2, 0.85)) AS v(i, p)")
def net_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network written to a ``.net`` file and read back."""
    text = """net { }
node rain { states = ( "no" "yes" ); }
node wet { states = ( "no" "yes" ); }
potential ( rain ) { data = ( 0.6 0.4 ) ; }
potential ( wet | rain ) { data = ( 0.9 0.1  0.15 0.85 ) ; }"""
    path = _scratch(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    network = net.read(spark, path)
    asked = [Conditional.of([("rain", "yes")]), Conditional.of([("wet", "yes")], []), Conditional.of([("rain", "yes")], [("wet", "yes")])]
    return probability_table(network.factors(spark), asked, frames=network.frames()).select("query", F.round("probability", 8).alias("probability"))


# matrices ---------------------------------------------------------------------------------------


def _sales(spark: SparkSession, sf_dir: str) -> Matrix:
    """Lines by return flag and line number."""
    df = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_linenumber").cast("string").alias("col"), F.lit(1).alias("__value"))
    return Matrix.of(df, counting(), ["A", "N", "R"], [str(i) for i in range(1, 8)])


_SALES = "(SELECT l_returnflag AS row, CAST(l_linenumber AS VARCHAR) AS col, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@_query(f"SELECT row, col, n FROM {_SALES} WHERE row <> 'N' AND col IN ('1', '2')")
def matrix_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended, projected and reshaped."""
    m = _sales(spark, sf_dir).extend(["A", "N", "R", "X"], [str(i) for i in range(1, 10)]).project(["A", "R", "X"], ["1", "2", "9"])
    return m.reshape(["A", "R"], ["1", "2", "3"]).df.withColumnRenamed("__value", "n")


@_query(f"SELECT row, col, n FROM {_SALES}")
def matrix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square matrix in four blocks, and these put together again."""
    return Matrix.joined(*_sales(spark, sf_dir).to_square().blocks()).df.withColumnRenamed("__value", "n")


@_query(f"SELECT row, col, n FROM {_SALES} UNION ALL SELECT 'total', col, sum(n) FROM {_SALES} GROUP BY col")
def matrix_append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sales(spark, sf_dir)
    total = Matrix.of(m.df.withColumn("row", F.lit("total")), counting(), ["total"], m.cols)
    return m.append_rows(total).df.withColumnRenamed("__value", "n")


@_query(f"SELECT row, col, CASE WHEN row = 'A' AND col = '1' THEN 7 ELSE 10 * n END AS n FROM {_SALES}")
def matrix_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells mapped, then one of them updated twice."""
    m = _sales(spark, sf_dir).map(lambda r, c, v: [10 * v[0]])
    return m.update(spark.createDataFrame([("A", "1", 5, 0), ("A", "1", 7, 1)], "row string, col string, __value bigint, nth int")).df.withColumnRenamed("__value", "n")


@_query(f"SELECT (SELECT n FROM {_SALES} WHERE row = 'R' AND col = '3') AS found, (SELECT sum(n) FROM {_SALES} WHERE row = 'N') AS in_row, true AS positive, true AS well_formed, CAST(3 AS BIGINT) AS rows, CAST(7 AS BIGINT) AS cols, false AS square")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked at by cell, row and predicate."""
    m = _sales(spark, sf_dir)
    row = (m.find("R", "3"), m.row("N").agg(F.sum("__value")).first()[0], m.all(lambda v: v[0] > 0), m.is_well_formed(), len(m.rows), len(m.cols), m.is_square())
    return spark.createDataFrame([row], "found bigint, in_row bigint, positive boolean, well_formed boolean, rows bigint, cols bigint, square boolean")


@_query(f"""WITH s AS (SELECT * FROM {_SALES}), g AS (SELECT a.row, b.row AS col, sum(a.n * b.n) AS n FROM s AS a JOIN s AS b ON a.col = b.col GROUP BY 1, 2)
SELECT g.row, s.col, CAST(sum(g.n * s.n) AS DOUBLE) AS n FROM g JOIN s ON g.col = s.row GROUP BY 1, 2""")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of three matrices: M M^T M."""
    m, s = _sales(spark, sf_dir), sum_product()
    m = Matrix.of(m.df, s, m.rows, m.cols)
    turned = Matrix.of(m.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "__value"), s, m.cols, m.rows)
    return Matrix.multiplied([m, turned, m]).df.withColumnRenamed("__value", "n")


@_query("SELECT * FROM (VALUES ('a', 'b', 1.0::DOUBLE), ('a', 'c', 0.0::DOUBLE), ('b', 'b', 0.0::DOUBLE), ('b', 'c', 4.0::DOUBLE)) AS v(row, col, n)")
def matrix_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a default for gaps; of one place the last."""
    m = Matrix.from_cells(spark, min_plus(), [(("a", "b"), 9.0), (("a", "b"), 1.0), (("b", "c"), 4.0)], default=0.0)
    return m.df.withColumnRenamed("__value", "n")


@_query("""SELECT CAST(i AS BIGINT) AS row, CAST(j AS BIGINT) AS col, CASE WHEN i < 2 AND j < 2 THEN '-Infinity' ELSE '0.0' END AS n FROM range(3) AS a(i), range(3) AS b(j) WHERE (i < 2) = (j < 2)""")
def star_of_negative_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle that improves without end has distances of minus infinity."""
    m = Matrix.from_cells(spark, min_plus(), [((0, 1), -2.0), ((1, 0), 1.0), ((2, 2), 5.0)], default=float("inf"))
    return m.quasi_inverse(spark).df.select("row", "col", F.col("__value").cast("string").alias("n"))


# graphs and systems -----------------------------------------------------------------------------


def _trade(spark: SparkSession, sf_dir: str) -> Digraph:
    """Customer's nation to supplier's nation for each line, weighted by quantity."""
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    customer, supplier = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return Digraph.of(df.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_quantity").alias("weight")))


_TRADE = """(SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_LEAST = f"(SELECT src, dst, min(weight) AS weight FROM {_TRADE} GROUP BY 1, 2)"


@_query(f"SELECT src AS id, count(*) AS n, string_agg(dst || ':' || CAST(weight AS INTEGER), ',' ORDER BY dst) AS arcs FROM {_LEAST} GROUP BY 1")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = _trade(spark, sf_dir).cheapest_edges().adjacency()
    shown = F.transform("arcs", lambda a: F.concat(a["dst"].cast("string"), F.lit(":"), a["weight"].cast("int").cast("string")))
    return arcs.where("arcs IS NOT NULL").select("id", F.size("arcs").cast("bigint").alias("n"), F.array_join(shown, ",").alias("arcs"))


@_query(f"SELECT dst AS id, count(*) AS n FROM {_LEAST} GROUP BY 1")
def graph_reverse_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = _trade(spark, sf_dir).cheapest_edges().reverse_adjacency()
    return arcs.where("arcs IS NOT NULL").select("id", F.size("arcs").cast("bigint").alias("n"))


@_query(f"""SELECT 'induced' AS part, src, dst, weight FROM {_LEAST} WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'outgoing', src, dst, weight FROM {_LEAST} WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'without', src, dst, weight FROM {_LEAST} WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def graph_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _trade(spark, sf_dir).cheapest_edges()
    ids = _read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    parts = {"induced": graph.induced(ids), "outgoing": graph.outgoing_subgraph(ids), "without": graph.without(ids)}
    a, b, c = (g.edges.select(F.lit(name).alias("part"), "src", "dst", "weight") for name, g in parts.items())
    return a.unionByName(b).unionByName(c)


@_query(f"""SELECT CAST((SELECT count(*) FROM (SELECT src FROM {_TRADE} UNION SELECT dst FROM {_TRADE})) AS BIGINT) AS vertices, 2 * (SELECT count(*) FROM {_TRADE}) + (SELECT count(*) FROM (SELECT src FROM {_TRADE} UNION SELECT dst FROM {_TRADE})) AS edges,
true AS loops, (SELECT sum(weight) FROM {_TRADE}) * 3 AS weight, true AS connected, false AS empty""")
def graph_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a graph merged with itself at twice the weight, with loops of weight 0."""
    graph = _trade(spark, sf_dir)
    both = Digraph.merged([graph, graph.map_weights(lambda w: 2 * w)]).with_self_loops()
    row = (both.vertex_count(), both.edge_count(), both.has_zero_self_loops(), both.edges.agg(F.sum("weight")).first()[0], both.cheapest_edges().is_connected(), both.is_empty())
    return spark.createDataFrame([row], "vertices bigint, edges bigint, loops boolean, weight double, connected boolean, empty boolean")


@_query(f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, weight FROM {_LEAST}")
def gr_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written to a ``.gr`` file and read back."""
    path = _scratch(spark)
    gr.write(_trade(spark, sf_dir).cheapest_edges(), path)
    return gr.read(spark, path).edges


def _regions(spark: SparkSession, sf_dir: str) -> Digraph:
    """Regions, joined where a nation's number leads to another's."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("bigint").alias("r"))
    other = n.select(F.col("k").alias("k2"), F.col("r").alias("dst"))
    edges = n.join(other, (n["k"] * 3 + 2) % 25 == other["k2"]).select(F.col("r").alias("src"), "dst", (F.col("k") % 7 + 1).cast("double").alias("weight"))
    return Digraph.of(edges).cheapest_edges()


_DISTANCES = """WITH RECURSIVE e AS (SELECT CAST(a.n_regionkey AS BIGINT) AS src, CAST(b.n_regionkey AS BIGINT) AS dst, CAST(min(a.n_nationkey % 7 + 1) AS DOUBLE) AS weight
FROM nation AS a JOIN nation AS b ON (a.n_nationkey * 3 + 2) % 25 = b.n_nationkey GROUP BY 1, 2),
w AS (SELECT CAST(t AS BIGINT) AS target, CAST(t AS BIGINT) AS source, CAST(0 AS DOUBLE) AS d FROM (VALUES (0), (3)) AS v(t)
UNION SELECT w.target, e.src, w.d + e.weight FROM w JOIN e ON e.dst = w.source WHERE w.d < 40)
SELECT target, source, min(d) AS distance FROM w WHERE source <= 4 AND {where} GROUP BY 1, 2"""


def _told(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "target bigint, source bigint, distance double").where("distance < double('inf')")


@_query(_DISTANCES.replace("{where}", "target = 0"))
def single_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to one region, the graph split into systems by its decomposition."""
    return _told(spark, [(0, s, d) for s, d in enumerate(paths.single_target_of(_regions(spark, sf_dir), paths.Query(tuple(range(5)), 0)))])


@_query(_DISTANCES.replace("{where}", "target = 0"))
def single_target_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an inward pass and solution extension."""
    return _told(spark, [(0, s, d) for s, d in enumerate(paths.single_target_solved(paths.decomposition(_regions(spark, sf_dir)), paths.Query(tuple(range(5)), 0)))])


@_query(_DISTANCES.replace("{where}", "true"))
def single_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to two regions over an unsplit graph, by messages."""
    asked = [paths.Query(tuple(range(5)), t) for t in (0, 3)]
    found = paths.single_targets([_regions(spark, sf_dir)], asked, Mode.MESSAGES)
    return _told(spark, [(q.target, s, d) for q, row in zip(asked, found) for s, d in zip(q.sources, row)])


@_query("""WITH c AS (SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS n FROM c)
SELECT f AS row, round(q + q_next * share, 4) AS x FROM (SELECT c.f, c.q, d.q AS q_next, c.n / s.n AS share FROM s, c JOIN c AS d ON (c.f = 'A' AND d.f = 'N') OR (c.f = 'R' AND d.f = 'N'))
UNION ALL SELECT f, round(q, 4) FROM c WHERE f = 'N'""")
def linear_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = M x + b over (+, x): what A and R have and their share of what N has; combined from two systems and solved."""
    lines = _read(spark, sf_dir, "lineitem")
    b = lines.groupBy(F.col("l_returnflag").alias("row")).agg(F.sum("l_quantity").alias("__value"))
    n = lines.count()
    shares = lines.groupBy(F.col("l_returnflag").alias("row")).agg((F.count("*") / n).alias("__value")).where("row <> 'N'").select("row", F.lit("N").alias("col"), "__value")
    system = lambda f: ClosedSystem.of(Matrix(sum_product(), shares.where(F.col("row") == f), frozenset([f, "N"]), frozenset([f, "N"])), b.where(F.col("row") == f))
    both = system("A").combine(system("R")).combine(ClosedSystem.of(Matrix(sum_product(), shares.limit(0), frozenset(["N"]), frozenset(["N"])), b.where("row = 'N'")))
    return both.solution().select("row", F.round("__value", 4).alias("x"))


@_query("""WITH RECURSIVE e AS (SELECT CAST(a.n_regionkey AS BIGINT) AS src, CAST(b.n_regionkey AS BIGINT) AS dst, CAST(min(a.n_nationkey % 7 + 1) AS DOUBLE) AS weight
FROM nation AS a JOIN nation AS b ON (a.n_nationkey * 3 + 2) % 25 = b.n_nationkey GROUP BY 1, 2),
w AS (SELECT CAST(2 AS BIGINT) AS row, CAST(0 AS DOUBLE) AS d UNION SELECT e.src, w.d + e.weight FROM w JOIN e ON e.dst = w.row WHERE w.d < 40) SELECT row, min(d) AS x FROM w GROUP BY 1""")
def closed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables of a (min, +) system by projections to halves, each solved and put together."""
    graph = _regions(spark, sf_dir)
    whole = paths.system(graph, frozenset(range(5)), 2)
    return whole.project([0, 1, 2]).solution().unionByName(whole.project([3, 4, 2]).solution().where("row > 2")).withColumnRenamed("__value", "x")


@_query("""WITH RECURSIVE e AS (SELECT CAST(a.n_regionkey AS BIGINT) AS src, CAST(b.n_regionkey AS BIGINT) AS dst, CAST(min(a.n_nationkey % 7 + 1) AS DOUBLE) AS weight
FROM nation AS a JOIN nation AS b ON (a.n_nationkey * 3 + 2) % 25 = b.n_nationkey GROUP BY 1, 2),
w AS (SELECT CAST(0 AS BIGINT) AS row, CAST(0 AS DOUBLE) AS d UNION SELECT e.src, w.d + e.weight FROM w JOIN e ON e.dst = w.row WHERE w.d < 40) SELECT row, min(d) AS x FROM w GROUP BY 1""")
def solution_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all variables of two systems' sum, node by node of a join tree."""
    graph = _regions(spark, sf_dir)
    halves = [Digraph.of(graph.edges.where(c), graph.vertices) for c in ("src < 2", "src >= 2")]
    return solve([paths.system(g, frozenset(range(5)), 0) for g in halves]).withColumnRenamed("__value", "x")


# relations --------------------------------------------------------------------------------------


@_query("""SELECT p_brand AS brand, n_name AS nation, r_name AS region, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN customer ON o_custkey = c_custkey""")
def relation_of_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of the natural join of seven tables, duplicates kept."""
    t = lambda name, **columns: _read(spark, sf_dir, name).select(*[F.col(c).alias(v) for v, c in columns.items()])
    tables = [t("lineitem", ok="l_orderkey", pk="l_partkey", sk="l_suppkey"), t("orders", ok="o_orderkey", ck="o_custkey", priority="o_orderpriority"), t("part", pk="p_partkey", brand="p_brand"), t("supplier", sk="s_suppkey", nk="s_nationkey"), t("nation", nk="n_nationkey", nation="n_name", rk="n_regionkey"), t("region", rk="r_regionkey", region="r_name"), t("customer", ck="c_custkey")]
    return answer(tables, ["brand", "nation", "region", "priority"])


@_query("SELECT n_name AS nation FROM nation WHERE false")
def relation_with_an_empty_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component without rows leaves nothing of the others; the neutral relation changes nothing."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))
    none = _read(spark, sf_dir, "region").select(F.col("r_name").alias("region")).where("region IS NULL")
    return answer([Relation().combine(Relation(nation)).df, none], ["nation"])
