"""Labelled matrices over a semiring as coordinates (row, col, payload); what is absent is zero."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumfold.functions.dense import dense
from sumfold.functions.scratch import settled
from sumfold.functions.semiring import Semiring
from sumfold.operators import blocks


class LabelMismatch(ValueError):
    """The labels of operands do not fit each other."""


@dataclass(frozen=True)
class Matrix:
    semiring: Semiring
    df: DataFrame
    rows: frozenset
    cols: frozenset

    # construction -------------------------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, semiring: Semiring, rows: Collection, cols: Collection) -> "Matrix":
        """Cells (row, col, payload) added up per place."""
        return cls(semiring, df, frozenset(rows), frozenset(cols))._added()

    @classmethod
    def from_cells(cls, spark: SparkSession, semiring: Semiring, cells: Sequence[tuple[tuple, Any]], default: Any = None) -> "Matrix":
        """From ((row, col), value) pairs, of one place the last; a gap is ``default``, and an error without one."""
        last = dict(cells)
        rows, cols = frozenset(r for r, _ in last), frozenset(c for _, c in last)
        if default is None and len(last) != len(rows) * len(cols):
            raise LabelMismatch("not every place has a value")
        if default is not None and default not in (semiring.zero[0], semiring.zero):
            last = {(r, c): last.get((r, c), default) for r in rows for c in cols}
        return cls(semiring, _frame(spark, semiring, last, rows | cols), rows, cols)

    @classmethod
    def from_rows(cls, spark: SparkSession, semiring: Semiring, values: Sequence[Sequence]) -> "Matrix":
        """A plain matrix, labelled by whole numbers from 0."""
        return cls.from_cells(spark, semiring, [((i, j), x) for i, r in enumerate(values) for j, x in enumerate(r)])

    @classmethod
    def unit(cls, spark: SparkSession, semiring: Semiring, labels: Collection) -> "Matrix":
        return cls(semiring, _frame(spark, semiring, {(x, x): semiring.one[0] for x in labels}, labels), frozenset(labels), frozenset(labels))

    # shape --------------------------------------------------------------------------------------

    @property
    def domain(self) -> tuple[frozenset, frozenset]:
        return self.rows, self.cols

    def is_square(self) -> bool:
        return self.rows == self.cols

    def reshape(self, rows: Collection, cols: Collection) -> "Matrix":
        """Other label sets: places that go are dropped, places that come are zero."""
        rows, cols = frozenset(rows), frozenset(cols)
        df = self.df
        df = df if self.rows <= rows else df.where(F.col("row").isin(list(self.rows & rows)))
        df = df if self.cols <= cols else df.where(F.col("col").isin(list(self.cols & cols)))
        return replace(self, df=df, rows=rows, cols=cols)

    def extend(self, rows: Collection, cols: Collection) -> "Matrix":
        if not (self.rows <= set(rows) and self.cols <= set(cols)):
            raise LabelMismatch("an extension has all labels and more")
        return self.reshape(rows, cols)

    def to_square(self) -> "Matrix":
        return self.extend(self.rows | self.cols, self.rows | self.cols)

    def project(self, rows: Collection, cols: Collection) -> "Matrix":
        if not (self.rows >= set(rows) and self.cols >= set(cols)):
            raise LabelMismatch("a projection has no further labels")
        return self.reshape(rows, cols)

    def append_rows(self, other: "Matrix") -> "Matrix":
        """Both matrices' rows, of equal columns; no row is in both."""
        if self.cols != other.cols or self.rows & other.rows:
            raise LabelMismatch("appended rows have the same columns and are others")
        return replace(self, df=self.df.unionByName(other.df), rows=self.rows | other.rows)

    def blocks(self) -> tuple["Matrix", "Matrix", "Matrix", "Matrix"]:
        """Four blocks of a square matrix, the first of half the labels in order, rounded up."""
        if not self.is_square():
            raise LabelMismatch("only square matrices have such blocks")
        order = sorted(self.rows)
        a, b = order[: -(-len(order) // 2)], order[-(-len(order) // 2) :]
        return self.project(a, a), self.project(a, b), self.project(b, a), self.project(b, b)

    @staticmethod
    def joined(a: "Matrix", b: "Matrix", c: "Matrix", d: "Matrix") -> "Matrix":
        """The inverse of ``blocks``."""
        if not (a.rows == b.rows and c.rows == d.rows and a.cols == c.cols and b.cols == d.cols) or a.rows & c.rows or a.cols & b.cols:
            raise LabelMismatch("the blocks are not aligned")
        return Matrix(a.semiring, reduce(DataFrame.unionByName, [x.df for x in (a, b, c, d)]), a.rows | c.rows, a.cols | b.cols)

    def is_well_formed(self) -> bool:
        """Whether every cell is at a place of the labels, and no place has two."""
        known = F.col("row").isin(list(self.rows)) & F.col("col").isin(list(self.cols))
        if not self.df.where(~known | F.col("row").isNull() | F.col("col").isNull()).isEmpty():
            return False
        return self.df.groupBy("row", "col").count().where("count > 1").isEmpty()

    # arithmetic ---------------------------------------------------------------------------------

    def add(self, other: "Matrix") -> "Matrix":
        if self.domain != other.domain:
            raise LabelMismatch("sums need equal labels")
        return replace(self, df=self.df.unionByName(other.df))._added()

    __add__ = add

    def multiply(self, other: "Matrix") -> "Matrix":
        """One equi-join on the inner labels and one grouped sum."""
        if self.cols != other.rows:
            raise LabelMismatch("inner labels differ")
        s = self.semiring
        left = self.df.withColumnRenamed("col", "_inner")
        right = other.df.select(F.col("row").alias("_inner"), "col", *[F.col(p).alias(f"_r{p}") for p in s.payload])
        product = s.mul([F.col(p) for p in s.payload], [F.col(f"_r{p}") for p in s.payload])
        df = left.join(right, "_inner").select("row", "col", *[x.alias(p) for x, p in zip(product, s.payload)])
        return Matrix(s, df, self.rows, other.cols)._added()

    __matmul__ = multiply

    @staticmethod
    def multiplied(factors: Iterable["Matrix"]) -> "Matrix | None":
        """The product of matrices from left to right; of none there is none."""
        factors = list(factors)
        return reduce(Matrix.multiply, factors) if factors else None

    def _added(self) -> "Matrix":
        s = self.semiring
        sums = [x.cast(t).alias(p) for x, t, p in zip(s.add([F.col(p) for p in s.payload]), s.types, s.payload)]
        return replace(self, df=self.df.groupBy("row", "col").agg(*sums))

    def quasi_inverse(self, spark: SparkSession) -> "Matrix":
        """The star M* = 1 + M M*.

        Of semirings with dense blocks in as many rounds as there are blocks of labels (``blocks.star``); of others by eliminating
        one label after another, M + M[.,k] M[k,k]* M[k,.], in joins and grouped sums.
        """
        if not self.is_square():
            raise LabelMismatch("only square matrices have a star")
        if self.semiring.star is None:
            raise ValueError(f"{self.semiring.name} has no star")
        if not self.rows:
            return self
        if dense(self.semiring) is not None:
            labels = spark.createDataFrame([(x,) for x in self.rows], f"label {dict(self.df.dtypes)['row']}")
            return replace(self, df=blocks.star(self.df, self.semiring, labels))
        m = self
        for k in sorted(self.rows):
            m = m.add(m.through(k)).settled()
        return m.add(Matrix.unit(spark, self.semiring, self.rows))

    def with_loops_starred(self) -> "Matrix":
        """With each diagonal payload replaced by its star where it has one."""
        s = self.semiring
        star = s.star([F.col(p) for p in s.payload])
        return replace(self, df=self.df.select("row", "col", *[F.when(F.col("row") == F.col("col"), x.cast(t)).otherwise(F.col(p)).alias(p) for x, t, p in zip(star, s.types, s.payload)]))

    def through(self, k: Any) -> "Matrix":
        """M[.,k] M[k,k]* M[k,.]: a thin column times a thin row."""
        s = self.semiring
        column = self.df.where(F.col("col") == F.lit(k)).select("row", *s.payload)
        row = self.df.where(F.col("row") == F.lit(k)).select("col", *[F.col(p).alias(f"_r{p}") for p in s.payload])
        loop = self.df.where((F.col("row") == F.lit(k)) & (F.col("col") == F.lit(k))).agg(*[F.coalesce(F.max(p), z).alias(p) for p, z in zip(s.payload, s.literal(s.zero))])
        star = loop.select(*[x.cast(t).alias(f"_s{p}") for x, t, p in zip(s.star([F.col(p) for p in s.payload]), s.types, s.payload)])
        # one row
        column = column.crossJoin(F.broadcast(star))
        first = s.mul([F.col(p) for p in s.payload], [F.col(f"_s{p}") for p in s.payload])
        column = column.select("row", *[x.alias(p) for x, p in zip(first, s.payload)])
        both = column.crossJoin(row)
        product = s.mul([F.col(p) for p in s.payload], [F.col(f"_r{p}") for p in s.payload])
        return replace(self, df=both.select("row", "col", *[x.cast(t).alias(p) for x, t, p in zip(product, s.types, s.payload)]))

    def settled(self) -> "Matrix":
        return replace(self, df=settled(self.df))

    # cells --------------------------------------------------------------------------------------

    def find(self, row: Any, col: Any) -> Any:
        if row not in self.rows or col not in self.cols:
            raise KeyError((row, col))
        found = self.df.where((F.col("row") == F.lit(row)) & (F.col("col") == F.lit(col))).select(*self.semiring.payload).first()
        found = self.semiring.zero if found is None else tuple(found)
        return found[0] if len(found) == 1 else found

    def row(self, row: Any) -> DataFrame:
        return self.df.where(F.col("row") == F.lit(row)).drop("row")

    def update(self, cells: DataFrame) -> "Matrix":
        """With the payloads of ``cells`` (row, col, payload, and ``nth`` if a place comes twice: the last counts)."""
        if "nth" in cells.columns:
            by_place = Window.partitionBy("row", "col").orderBy(F.desc("nth"))
            cells = cells.withColumn("_n", F.row_number().over(by_place)).where("_n = 1").drop("_n", "nth")
        rest = self.df.join(cells.select("row", "col"), ["row", "col"], "left_anti")
        return replace(self, df=rest.unionByName(cells))

    def map(self, f: Callable[[Column, Column, Sequence[Column]], Sequence[Column]]) -> "Matrix":
        """Payloads as expressions of row, column and payload; zeroes that are absent stay zero."""
        s = self.semiring
        new = f(F.col("row"), F.col("col"), [F.col(p) for p in s.payload])
        return replace(self, df=self.df.select("row", "col", *[x.cast(t).alias(p) for x, t, p in zip(new, s.types, s.payload)]))

    def all(self, predicate: Callable[[Sequence[Column]], Column]) -> bool:
        """Whether ``predicate`` holds for all cells, absent ones being zero."""
        s = self.semiring
        count, held = self.df.agg(F.count("*"), F.coalesce(F.bool_and(predicate([F.col(p) for p in s.payload])), F.lit(True))).first()
        absent = count < len(self.rows) * len(self.cols)
        return held and (not absent or self.df.sparkSession.range(1).select(predicate(s.literal(s.zero))).first()[0])


def _frame(spark: SparkSession, semiring: Semiring, cells: dict[tuple, Any], labels: Iterable) -> DataFrame:
    kind = "bigint" if all(isinstance(x, int) for x in labels) else "string"
    schema = f"row {kind}, col {kind}, " + ", ".join(f"{p} {t}" for p, t in zip(semiring.payload, semiring.types))
    rows = [(r, c, *(x if isinstance(x, tuple) else (float(x) if semiring.types[0] == "double" else x,))) for (r, c), x in cells.items()]
    return spark.createDataFrame(rows, schema)
