"""Road graphs in ``.gr`` files: ``c`` comments, ``p sp N M``, and ``a U V W`` for an edge U to V."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.operators.graph import Digraph
from sumfold.sources.net import FormatError

_ARC = r"^a\s+(\d+)\s+(\d+)\s+(-?\d+)\s*$"
_HEAD = r"^p\s+sp\s+(\d+)\s+(\d+)\s*$"


def _arcs(lines: DataFrame) -> DataFrame:
    of = lambda i: F.regexp_extract("value", _ARC, i)
    return lines.where(F.col("value").rlike(_ARC)).select(of(1).cast("bigint").alias("src"), of(2).cast("bigint").alias("dst"), of(3).cast("double").alias("weight"))


def read(spark: SparkSession, path: str) -> Digraph:
    """The whole graph; its numbers of vertices on edges and of edges must be those announced."""
    lines = spark.read.text(path)
    graph = Digraph.of(_arcs(lines))
    heads = lines.where(F.col("value").rlike(_HEAD)).select(*[F.regexp_extract("value", _HEAD, i).cast("bigint") for i in (1, 2)]).take(2)
    odd = lines.where(~F.col("value").rlike(rf"{_ARC}|{_HEAD}|^c(\s.*)?$|^\s*$")).take(1)
    if odd:
        raise FormatError(f"unexpected line {odd[0][0]!r}")
    if len(heads) != 1:
        raise FormatError("one line p sp N M is needed")
    if (graph.vertex_count(), graph.edge_count()) != tuple(heads[0]):
        raise FormatError(f"{graph.vertex_count()} vertices and {graph.edge_count()} edges instead of {heads[0][0]} and {heads[0][1]}")
    return graph


def read_first(spark: SparkSession, path: str, n: int) -> Digraph:
    """The graph of the first ``n`` edges in the file's order, unchecked."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    first = lines.where(F.col("value").rlike(_ARC)).orderBy("_at").limit(n)
    return Digraph.of(_arcs(first))


def write(graph: Digraph, path: str) -> None:
    """The graph as text, its head first; whole weights."""
    head = graph.edges.sparkSession.createDataFrame([(f"p sp {graph.vertex_count()} {graph.edge_count()}",)], "value string")
    arcs = graph.edges.select(F.concat_ws(" ", F.lit("a"), "src", "dst", F.col("weight").cast("bigint")).alias("value"))
    head.unionByName(arcs).write.text(path)
