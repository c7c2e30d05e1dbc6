"""Positions of assignments in a table laid out flat, the first variable varying slowest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def permutations(sizes: Sequence[int]) -> int:
    """How many assignments variables with so many values have."""
    return math.prod(sizes)


def factors(sizes: Sequence[int]) -> list[int]:
    """By variable, how far apart two assignments are that differ by one in it."""
    out, step = [], 1
    for n in reversed(sizes):
        out.append(step)
        step *= n
    return out[::-1]


def index(digits: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The position of an assignment by value numbers."""
    if len(digits) != len(sizes):
        raise ValueError("as many digits as variables are needed")
    return sum((d * F.lit(f) for d, f in zip(digits, factors(sizes))), F.lit(0)).cast("bigint")


def digits(position: Column, sizes: Sequence[int]) -> list[Column]:
    """The value numbers of the assignment at a position."""
    return [F.floor(position / F.lit(f)).cast("bigint") % F.lit(n) for f, n in zip(factors(sizes), sizes)]


def assignments(spark: SparkSession, frames: Sequence[tuple[str, Sequence[Any]]]) -> DataFrame:
    """All assignments of variables' values with their ``position``."""
    sizes = [len(v) for _, v in frames]
    names = digits(F.col("id"), sizes)
    columns = [F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int")).alias(name) for (name, values), at in zip(frames, names)]
    return spark.range(permutations(sizes)).select(F.col("id").alias("position"), *columns)


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct values of a column, numbered from 0 in their order.

    Ranges are counted first, so that no task sees all values.
    """
    from sumfold.functions.scratch import settled

    ordered = settled(values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).collect()  # a row per range
    before, starts = 0, []
    for r in sorted(parts):
        starts.append((r["_part"], r["_first"] - before))
        before += r["_n"]
    table = values.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _shift bigint")
    return ordered.join(F.broadcast(table), "_part").select(column, (F.col("_id") - F.col("_shift")).alias("number"))
