"""What the planner knows of the data: rows of tables, and distinct values of variables by sketches that merge.

A sketch of a variable (HyperLogLog, 2^12 registers, a standard error of about 1.6 %) is a few kilobytes whatever the table has, and those
of parts of a table, or of several tables, are put together by a union. From rows and distinct values the size of a product
is estimated as usual for joins: the product of the rows over, for each shared variable, all but the least of the factors' distinct counts.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.operators.factor import Factor

#: Base-2 logarithm of a sketch's registers.
REGISTERS = 12


def sketch(variable: Column, registers: int = REGISTERS) -> Column:
    """The sketch of a column's values, as an aggregate."""
    return F.hll_sketch_agg(variable.cast("string"), F.lit(registers))


def sketches(df: DataFrame, variables: Collection[str], registers: int = REGISTERS) -> DataFrame:
    """(variable, rows, sketch) of a table: one pass, a row per variable."""
    names = sorted(variables)
    row = df.agg(F.count("*").alias("rows"), *[sketch(F.col(v), registers).alias(f"s{i}") for i, v in enumerate(names)])
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col("rows"), F.col(f"s{i}").alias("sketch")) for i, v in enumerate(names)])
    return row.select(F.explode(each).alias("x")).select("x.*") if names else row.select(F.lit("").alias("variable"), "rows", F.lit(None).cast("binary").alias("sketch")).limit(0)


def merged(tables: Sequence[DataFrame]) -> DataFrame:
    """(variable, rows, sketch) of several tables' or parts' rows together."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy("variable").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(table: DataFrame) -> DataFrame:
    """(variable, rows, distinct) of a table of sketches."""
    return table.select("variable", "rows", F.hll_sketch_estimate("sketch").alias("distinct"))


def rows_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """How many rows each table has, in one job; of files with footers these are all that is read."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return {r["name"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}


@dataclass(frozen=True)
class Statistics:
    """Factors with their rows, and for each variable the distinct values of that factor that has least."""

    factors: list[Factor]
    frames: dict[str, int]
    #: By factor and variable.
    distinct: dict[tuple[int, str], int] = field(default_factory=dict)

    @classmethod
    def of(cls, factors: Sequence[Factor], registers: int = REGISTERS) -> "Statistics":
        """Of all factors, in one job that reads each once; the driver gets a number per factor and variable."""
        parts = [estimates(sketches(f.df, f.label, registers)).select(F.lit(i).alias("nth"), "*") for i, f in enumerate(factors) if not f.is_identity and f.label]
        found = reduce(DataFrame.unionByName, parts).collect() if parts else []
        distinct = {(r["nth"], r["variable"]): max(1, r["distinct"]) for r in found}
        rows = {r["nth"]: float(r["rows"]) for r in found}
        frames: dict[str, int] = {}
        for (_, v), n in distinct.items():
            frames[v] = min(n, frames.get(v, n))
        return cls([replace(f, rows=rows.get(i, 1.0)) for i, f in enumerate(factors)], frames, distinct)


def joined_rows(parts: Sequence[tuple[Collection[str], float]], frames: Mapping[str, int]) -> float:
    """The estimated rows of the natural join of tables (variables, rows)."""
    out = math.prod(max(1.0, rows) for _, rows in parts)
    for v in set().union(*[label for label, _ in parts]):
        counts = sorted(min(frames.get(v, rows), max(1.0, rows)) for label, rows in parts if v in label)
        out /= math.prod(counts[1:])
    return max(1.0, out)


def projected_rows(label: Collection[str], rows: float, frames: Mapping[str, int]) -> float:
    """The estimated rows of a projection to ``label``."""
    return min(rows, math.prod(float(frames.get(v, rows)) for v in label))
