"""The engine's operators as queries over the star schema, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold import algebra_queries, system_queries
from sumfold.algebra_queries import _TRADE, _flags, _read, _trade
from sumfold.functions.semiring import boolean, counting, max_product, min_plus, sum_product
from sumfold.operators import dft, paths
from sumfold.operators.factor import Factor
from sumfold.operators.graph import Digraph
from sumfold.operators.matrix import Matrix
from sumfold.operators.relation import Relation, answer
from sumfold.plans.engine import Mode, fusion, queries, query
from sumfold.plans.jointree import JoinForest
from sumfold.plans.statistics import rows_of

MONEY = sum_product("decimal(38,4)")


def _rows(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, int]:
    """Rows of tables, from their footers."""
    return rows_of(spark, {name: _read(spark, sf_dir, name) for name in names})


def star(spark: SparkSession, sf_dir: str) -> list[Factor]:
    """Region to lineitem as factors; the last one carries the revenue of an order."""
    t = lambda name: _read(spark, sf_dir, name)
    n = _rows(spark, sf_dir, "nation", "region", "customer", "orders", "lineitem")
    one = [F.lit(1)]
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    nation = Factor.of(t("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), F.col("n_name").alias("nation")), MONEY, ["nk", "rk", "nation"], one, unique=True, rows=n["nation"])
    region = Factor.of(t("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region")), MONEY, ["rk", "region"], one, unique=True, rows=n["region"])
    customer = Factor.of(t("customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("segment")), MONEY, ["ck", "nk", "segment"], one, unique=True, rows=n["customer"])
    orders = Factor.of(t("orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), F.col("o_orderpriority").alias("priority")), MONEY, ["ok", "ck", "priority"], one, unique=True, rows=n["orders"])
    lines = Factor.of(t("lineitem").select(F.col("l_orderkey").alias("ok"), revenue.alias("rev")), MONEY, ["ok"], ["rev"], rows=n["lineitem"])
    return [region, nation, customer, orders, lines]


_STAR_SQL = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_REVENUE_SQL = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4))"


def _named(f: Factor, value: str) -> DataFrame:
    return f.df.withColumnRenamed(f.semiring.payload[0], value)


def sumprod_revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(query(star(spark, sf_dir), ["region"]), "revenue")


def fusion_nation_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(query(star(spark, sf_dir), ["nation", "segment"]), "revenue")


def bruteforce_nation_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(query(star(spark, sf_dir), ["nation", "segment"], Mode.BRUTE_FORCE), "revenue")


def messages_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = ["region", "segment", "priority"]
    found = queries(star(spark, sf_dir), [[d] for d in domains], Mode.MESSAGES)
    parts = [_named(f, "revenue").select(F.lit(d).alias("q"), F.col(d).alias("key"), "revenue") for d, f in zip(domains, found)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _plain(spark: SparkSession, sf_dir: str, semiring, value_of) -> list[Factor]:
    t, n = lambda name: _read(spark, sf_dir, name), _rows(spark, sf_dir, "customer", "orders")
    customer = Factor.of(t("customer").select(F.col("c_custkey").alias("ck"), F.col("c_mktsegment").alias("segment"), value_of("customer").alias("v")), semiring, ["ck", "segment"], ["v"], unique=True, rows=n["customer"])
    orders = Factor.of(t("orders").select(F.col("o_custkey").alias("ck"), F.col("o_orderpriority").alias("priority"), value_of("orders").alias("v")), semiring, ["ck", "priority"], ["v"], rows=n["orders"])
    return [customer, orders]


def count_orders_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(query(_plain(spark, sf_dir, counting(), lambda _: F.lit(1)), ["segment"]), "n")


def minplus_cheapest_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda name: F.col("c_acctbal" if name == "customer" else "o_totalprice")
    return _named(query(_plain(spark, sf_dir, min_plus(), value), ["segment", "priority"]), "cheapest").withColumn("cheapest", F.round("cheapest", 4))


def maxproduct_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda name: F.lit(2.0) if name == "customer" else F.col("o_totalprice")
    return _named(query(_plain(spark, sf_dir, max_product(), value), ["priority"]), "most").withColumn("most", F.round("most", 4))


def bool_nation_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b, n = lambda name: _read(spark, sf_dir, name), boolean(), _rows(spark, sf_dir, "supplier", "lineitem", "part")
    supplier = Factor.of(t("supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("snk")), b, ["sk", "snk"], [F.lit(True)], unique=True, rows=n["supplier"])
    lines = Factor.of(t("lineitem").select(F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk")), b, ["sk", "pk"], [F.lit(True)], rows=n["lineitem"])
    part = Factor.of(t("part").select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("brand")), b, ["pk", "brand"], [F.lit(True)], unique=True, rows=n["part"])
    return _named(query([supplier, lines, part], ["snk", "brand"]), "reached")


def natural_join_project_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = Relation(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk")))
    nation = Relation(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation")))
    return customer.combine(nation).project(["nation"]).df


def counted_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"))
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ck"), F.col("o_orderpriority").alias("priority"))
    return answer([customer, nation, orders], ["nation", "priority"])


def cross_join_disconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counting()
    part = Factor.of(_read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")), c, ["brand"], [F.lit(1)])
    region = Factor.of(_read(spark, sf_dir, "region").select(F.col("r_name").alias("region")), c, ["region"], [F.lit(1)], unique=True)
    return _named(query([part, region], ["brand"], Mode.MESSAGES), "n")


def evidence_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(query(star(spark, sf_dir), ["nation"], evidence={"region": "ASIA", "segment": "BUILDING"}), "revenue")


def bn_joint_flag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    joint = _flags(spark, sf_dir)
    total = joint.project(()).df.select(F.col("__value").alias("total"))
    return joint.df.crossJoin(F.broadcast(total)).select("flag", "status", F.round(F.col("__value") / F.col("total"), 8).alias("p"))  # one row


def bn_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    joint = _flags(spark, sf_dir)
    given = joint.project(["flag"]).df.withColumnRenamed("__value", "total")
    return joint.df.join(given, "flag").select("flag", "status", F.round(F.col("__value") / F.col("total"), 8).alias("p"))


def _segment_matrices(spark: SparkSession, sf_dir: str) -> tuple[Matrix, Matrix]:
    c = counting()
    customer = _read(spark, sf_dir, "customer")
    nations = [str(i) for i in range(25)]
    segments = [r[0] for r in customer.select("c_mktsegment").distinct().orderBy(F.lower("c_mktsegment")).collect()]
    orders = _read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    priorities = [r[0] for r in orders.select("o_orderpriority").distinct().collect()]
    a = Matrix.of(customer.select(F.col("c_nationkey").cast("string").alias("row"), F.col("c_mktsegment").alias("col"), F.lit(1).alias("__value")), c, nations, segments)
    b = Matrix.of(orders.select(F.col("c_mktsegment").alias("row"), F.col("o_orderpriority").alias("col"), F.lit(1).alias("__value")), c, segments, priorities)
    return a, b


def matrix_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _segment_matrices(spark, sf_dir)
    return a.add(a.map(lambda r, c, v: [v[0] * 2])).df.withColumnRenamed("__value", "n")


def matrix_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _segment_matrices(spark, sf_dir)
    return a.multiply(b).df.withColumnRenamed("__value", "n")


def _nation_graph(spark: SparkSession, sf_dir: str) -> Digraph:
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"))
    near = n.select("src", ((F.col("src") + 1) % 25).alias("dst"), (F.col("src") % 7 + 1).cast("double").alias("weight"))
    far = n.select("src", ((F.col("src") * 3 + 2) % 25).alias("dst"), (F.col("src") % 5 + 2).cast("double").alias("weight"))
    return Digraph.of(near.unionByName(far))


def shortest_distance_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _nation_graph(spark, sf_dir)
    return paths.distances(graph, graph.vertices.where("id = 0")).select("id", "distance")


def all_pairs_distance_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _nation_graph(spark, sf_dir)
    edges = graph.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("__value"))
    m = Matrix.of(edges, min_plus(), range(25), range(25))
    return m.quasi_inverse(spark).df.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("__value").alias("distance"))


def graph_flip_min_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).flipped().cheapest_edges().edges


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).neighbours().select("id", F.size("neighbours").cast("bigint").alias("n"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("ids"))


def graph_asymmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).cheapest_edges().asymmetric_edges()


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers, joined by lines."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.lit(1.0).alias("weight"))
    return Digraph.of(lines).components()


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events' values, added up by the last six binary digits of their numbers."""
    events = _read(spark, sf_dir, "events").groupBy((F.col("event_id") % 64).alias("i")).agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("re"))
    return spark.range(64).select(F.col("id").alias("i")).join(events, "i", "left").select("i", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def dft_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of all events' values, folded to 64 samples."""
    out = dft.transform(_profile(spark, sf_dir))
    return out.select("i", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


def dft_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, zero-padded to the next power of two."""
    events = _read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return dft.padded(events)


def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for f in star(spark, sf_dir)[1:4]:
        for variable, frame in f.frames().items():
            part = frame.agg(F.count("*").alias("n")).select(F.lit(variable).alias("variable"), "n")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("variable").agg(F.min("n").alias("n"))


def elimination_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = JoinForest.build(star(spark, sf_dir), [["region"], ["segment"]])
    forest.check()
    s = forest.stats()
    rows = [(i, w, v, n) for i, (w, v, n) in enumerate(zip(s.tree_widths, s.valuations, s.vertices))]
    return spark.createDataFrame(rows, "tree bigint, width bigint, valuations bigint, vertices bigint")


def parts(spark: SparkSession, sf_dir: str) -> list[Factor]:
    """Part, supplier and lineitem, which carries the quantity."""
    t, n = lambda name: _read(spark, sf_dir, name), _rows(spark, sf_dir, "part", "supplier", "lineitem")
    part = Factor.of(t("part").select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("brand")), MONEY, ["pk", "brand"], [F.lit(1)], unique=True, rows=n["part"])
    supplier = Factor.of(t("supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("snk")), MONEY, ["sk", "snk"], [F.lit(1)], unique=True, rows=n["supplier"])
    lines = Factor.of(t("lineitem").select(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("decimal(12,2)").alias("q")), MONEY, ["pk", "sk"], ["q"], rows=n["lineitem"])
    return [part, supplier, lines]


def fusion_lineitem_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(fusion(parts(spark, sf_dir), ["brand", "snk"]), "quantity")


def fan_out(spark: SparkSession, sf_dir: str) -> list[Factor]:
    """The lines of one part, twice over one supplier: joined whole, every pair of a supplier's lines is a row."""
    c, lines, part = counting(), _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    n = _rows(spark, sf_dir, "lineitem", "part")
    out = []
    for i in (1, 2):
        out.append(Factor.of(part.select(F.col("p_partkey").alias(f"pk{i}"), F.col("p_brand").alias(f"brand{i}")), c, [f"pk{i}", f"brand{i}"], [F.lit(1)], unique=True, rows=n["part"]))
        out.append(Factor.of(lines.select(F.col("l_partkey").alias(f"pk{i}"), F.col("l_suppkey").alias("sk")), c, [f"pk{i}", "sk"], [F.lit(1)], rows=n["lineitem"]))
    return out


def brands_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a supplier's lines are of two brands."""
    return _named(query(fan_out(spark, sf_dir), ["brand1", "brand2"]), "n")


QUERIES = {
    f.__name__: f
    for f in (
        sumprod_revenue_by_region,
        fusion_nation_segment,
        bruteforce_nation_segment,
        messages_multi_query,
        count_orders_by_segment,
        minplus_cheapest_by_segment,
        maxproduct_by_priority,
        bool_nation_brand,
        natural_join_project_bag,
        counted_bag,
        cross_join_disconnected,
        evidence_revenue,
        bn_joint_flag_status,
        bn_conditional,
        matrix_add,
        matrix_multiply,
        shortest_distance_nations,
        all_pairs_distance_nations,
        graph_flip_min_edges,
        graph_neighbours,
        graph_asymmetric_edges,
        graph_components,
        dft_events,
        dft_all_events,
        frame_lengths,
        elimination_stats,
        fusion_lineitem_parts,
        brands_by_supplier,
    )
}

_NATION_SQL = """e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS weight FROM nation
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey * 3 + 2) % 25 AS BIGINT), CAST(n_nationkey % 5 + 2 AS DOUBLE) FROM nation)"""



def _components_sql(rounds: int) -> str:
    """Least numbers handed on for as many rounds as the longest way to one needs."""
    steps = "".join(f", c{k + 1} AS (SELECT id, min(c) AS c FROM (SELECT id, c FROM c{k} UNION ALL SELECT e.a, c{k}.c FROM e JOIN c{k} ON c{k}.id = e.b) GROUP BY id)" for k in range(rounds))
    return f"""WITH l AS (SELECT DISTINCT l_partkey AS p, -l_suppkey - 1 AS s FROM lineitem), e AS (SELECT p AS a, s AS b FROM l UNION ALL SELECT s, p FROM l),
c0 AS (SELECT DISTINCT a AS id, a AS c FROM e){steps} SELECT id, c AS component FROM c{rounds}"""


ORACLES = {
    "sumprod_revenue_by_region": f"SELECT r_name AS region, {_REVENUE_SQL} AS revenue {_STAR_SQL} GROUP BY 1",
    "fusion_nation_segment": f"SELECT n_name AS nation, c_mktsegment AS segment, {_REVENUE_SQL} AS revenue {_STAR_SQL} GROUP BY 1, 2",
    "bruteforce_nation_segment": f"SELECT n_name AS nation, c_mktsegment AS segment, {_REVENUE_SQL} AS revenue {_STAR_SQL} GROUP BY 1, 2",
    "messages_multi_query": " UNION ALL ".join(f"SELECT '{q}' AS q, {c} AS key, {_REVENUE_SQL} AS revenue {_STAR_SQL} GROUP BY {c}" for q, c in (("region", "r_name"), ("segment", "c_mktsegment"), ("priority", "o_orderpriority"))),
    "count_orders_by_segment": "SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "minplus_cheapest_by_segment": "SELECT c_mktsegment AS segment, o_orderpriority AS priority, round(min(c_acctbal + o_totalprice), 4) AS cheapest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "maxproduct_by_priority": "SELECT o_orderpriority AS priority, round(max(2 * o_totalprice), 4) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "bool_nation_brand": "SELECT DISTINCT s_nationkey AS snk, p_brand AS brand, true AS reached FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
    "natural_join_project_bag": "SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "counted_bag": "SELECT n_name AS nation, o_orderpriority AS priority FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    "cross_join_disconnected": "SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n FROM part CROSS JOIN region GROUP BY 1",
    "evidence_revenue": f"SELECT n_name AS nation, {_REVENUE_SQL} AS revenue {_STAR_SQL} WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING' GROUP BY 1",
    "bn_joint_flag_status": "SELECT l_returnflag AS flag, l_linestatus AS status, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS p FROM lineitem GROUP BY 1, 2",
    "bn_conditional": "SELECT flag, status, round(n / sum(n) OVER (PARTITION BY flag), 8) AS p FROM (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "matrix_add": "SELECT CAST(c_nationkey AS VARCHAR) AS row, c_mktsegment AS col, CAST(3 * count(*) AS BIGINT) AS n FROM customer GROUP BY 1, 2",
    "matrix_multiply": """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS row, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2),
b AS (SELECT c_mktsegment AS k, o_orderpriority AS col, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT row, col, CAST(sum(a.n * b.n) AS BIGINT) AS n FROM a JOIN b USING (k) GROUP BY 1, 2""",
    "shortest_distance_nations": f"""WITH RECURSIVE {_NATION_SQL}, w AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS d
UNION SELECT e.src, w.d + e.weight FROM w JOIN e ON e.dst = w.id WHERE w.d < 60) SELECT id, min(d) AS distance FROM w GROUP BY 1""",
    "all_pairs_distance_nations": f"""WITH RECURSIVE {_NATION_SQL}, w AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst, CAST(0 AS DOUBLE) AS d FROM nation
UNION SELECT e.src, w.dst, w.d + e.weight FROM w JOIN e ON e.dst = w.src WHERE w.d < 60) SELECT src, dst, min(d) AS distance FROM w GROUP BY 1, 2""",
    "graph_flip_min_edges": f"SELECT dst AS src, src AS dst, min(weight) AS weight FROM {_TRADE} GROUP BY 1, 2",
    "graph_neighbours": f"""SELECT src AS id, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS ids
FROM (SELECT src, dst FROM {_TRADE} WHERE src <> dst UNION SELECT dst, src FROM {_TRADE} WHERE src <> dst) GROUP BY 1""",
    "graph_asymmetric_edges": f"""WITH m AS (SELECT src, dst, min(weight) AS weight FROM {_TRADE} GROUP BY 1, 2)
SELECT src, dst, weight FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.src = m.dst AND o.dst = m.src AND o.weight = m.weight)""",
    "dft_events": """WITH s AS (SELECT event_id % 64 AS n, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS v FROM events GROUP BY 1)
SELECT CAST(k AS BIGINT) AS i, round(sum(v * cos(-2 * pi() * n * k / 64)), 4) + 0.0::DOUBLE AS re, round(sum(v * sin(-2 * pi() * n * k / 64)), 4) + 0.0::DOUBLE AS im
FROM s, generate_series(0, 63) AS g(k) GROUP BY k""",
    "elimination_stats": "SELECT CAST(0 AS BIGINT) AS tree, CAST(2 AS BIGINT) AS width, CAST(5 AS BIGINT) AS valuations, CAST(20 AS BIGINT) AS vertices",
    "graph_components": _components_sql(8),
    "frame_lengths": """SELECT 'nk' AS variable, count(DISTINCT x) AS n FROM (SELECT least((SELECT count(DISTINCT n_nationkey) FROM nation), (SELECT count(DISTINCT c_nationkey) FROM customer)) AS m), (SELECT n_nationkey AS x FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer))
UNION ALL SELECT 'rk', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'nation', count(DISTINCT n_name) FROM nation
UNION ALL SELECT 'ck', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'segment', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'ok', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'priority', count(DISTINCT o_orderpriority) FROM orders""",
    "brands_by_supplier": """WITH b AS (SELECT l_suppkey AS s, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT x.brand AS brand1, y.brand AS brand2, CAST(sum(x.n * y.n) AS BIGINT) AS n FROM b AS x JOIN b AS y ON x.s = y.s GROUP BY 1, 2""",
    "fusion_lineitem_parts": "SELECT p_brand AS brand, s_nationkey AS snk, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
}

QUERIES |= algebra_queries.QUERIES
ORACLES |= algebra_queries.ORACLES
QUERIES |= system_queries.QUERIES
ORACLES |= system_queries.ORACLES
