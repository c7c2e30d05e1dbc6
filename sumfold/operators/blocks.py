"""Stars and solutions of linear systems over matrices of dense blocks.

Labels are numbered, and a matrix is a table of blocks (bi, bj, cells) of ``size`` rows and columns. One block of labels is
eliminated after another: with D the star of the pivot block A[k,k],

    R[j] = D A[k,j],    A[k,j] becomes R[j],    A[i,j] becomes A[i,j] + A[i,k] R[j]  for i <> k,

after which A is what is added to 1 in the star. Within a block that is done label by label. So there are as
many rounds as blocks of labels, not as labels; each reads and writes the matrix once. Columns that are a right-hand side
take part like others, and a solution M* B needs no column of M once its block has gone.

The pivot's row and column of blocks go to every task up to ``panel`` bytes each; larger ones are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.functions.dense import Dense, dense
from sumfold.functions.radix import numbered
from sumfold.functions.scratch import settled
from sumfold.functions.semiring import Semiring

#: Rows and columns of a block: half a megabyte of doubles.
SIZE = 256
#: Blocks that a task holds at once, on average.
PER_TASK = 32
#: Bytes of a row of blocks that may be sent to every task.
PANEL = 64 << 20

_BLOCK = "bi int, bj int, cells binary"


class BlockMatrix:
    """``count`` rows, and ``width`` further columns on the right; ``blocks`` has every block."""

    def __init__(self, semiring: Semiring, blocks: DataFrame, count: int, width: int = 0, size: int = SIZE, panel: int = PANEL):
        arithmetic = dense(semiring)
        if arithmetic is None:
            raise ValueError(f"{semiring.name} has no dense blocks with a star")
        self.semiring, self.dense, self.blocks = semiring, arithmetic, blocks
        self.count, self.width, self.size, self.panel = count, width, size, panel

    @property
    def rows(self) -> int:
        """Rows of blocks."""
        return math.ceil(self.count / self.size)

    @property
    def cols(self) -> int:
        return self.rows + math.ceil(self.width / self.size)

    @classmethod
    def of(cls, cells: DataFrame, semiring: Semiring, count: int, width: int = 0, size: int = SIZE, panel: int = PANEL) -> "BlockMatrix":
        """From (i, j, payload), numbers from 0 and each place once; columns from ``count`` on are those on the right."""
        new = cls(semiring, cells, count, width, size, panel)
        d, value = new.dense, semiring.payload[0]
        # columns on the right start a block of their own
        j = F.when(F.col("j") < count, F.col("j")).otherwise(F.col("j") - count + new.rows * size)
        placed = cells.select(F.col("i").alias("i"), j.alias("j"), F.col(value).alias("v"))
        keyed = placed.select(F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"), (F.col("i") % size * size + F.col("j") % size).cast("int").alias("at"), "v")
        every = cells.sparkSession.range(new.rows * new.cols).select(F.floor(F.col("id") / new.cols).cast("int").alias("bi"), (F.col("id") % new.cols).cast("int").alias("bj"), F.lit(None).cast("int").alias("at"), F.lit(None).cast(semiring.types[0]).alias("v"))

        def build(key: tuple, group: pa.Table) -> pa.Table:
            group = group.filter(group["at"].is_valid())
            block = d.zeros(size * size, 1)
            block[group["at"].to_numpy(), 0] = group["v"].to_numpy()
            return pa.table({"bi": pa.array([key[0].as_py()], pa.int32()), "bj": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([block.tobytes()], pa.binary())})

        # a block has as many cells as places
        built = keyed.unionByName(every).groupBy("bi", "bj").applyInArrow(build, _BLOCK)
        # so many blocks a task at most, as batches have no bound in bytes
        new.blocks = built.repartition(math.ceil(new.rows * new.cols / PER_TASK) or 1, "bi", "bj")
        return new

    def _with(self, blocks: DataFrame) -> "BlockMatrix":
        return BlockMatrix(self.semiring, blocks, self.count, self.width, self.size, self.panel)

    # elimination --------------------------------------------------------------------------------

    def eliminated(self, right_only: bool = False) -> "BlockMatrix":
        """After all rounds; with ``right_only`` only the columns on the right are kept."""
        blocks = settled(self.blocks)
        for k in range(self.rows):
            blocks = settled(self._round(blocks, k, k + 1 if right_only else 0))
        return self._with(blocks)

    def _round(self, blocks: DataFrame, k: int, first: int) -> DataFrame:
        d, size = self.dense, self.size
        wide, column = blocks.where(F.col("bj") >= first), blocks.where(F.col("bj") == k)
        sent = self.cols * size * size * np.dtype(d.dtype).itemsize <= self.panel
        # a column of blocks of a checked size, or one block
        sides = {r["bi"]: bytes(r["cells"]) for r in (column if sent else column.where(F.col("bi") == k)).select("bi", "cells").collect()}
        pivot = d.closure(d.read(sides.pop(k), size))

        def row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [d.multiply(pivot, d.read(x, size)).tobytes() for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["bi", "bj", "cells"])

        top, rest = wide.where(F.col("bi") == k).mapInArrow(row, _BLOCK), wide.where(F.col("bi") != k)
        if sent:
            return self._sent(rest, top, sides, k)
        top, side = settled(top), column.where(F.col("bi") != k).select("bi", F.col("cells").alias("side"))
        both = rest.join(side, "bi").join(top.select("bj", F.col("cells").alias("top")), "bj").select("bi", "bj", "cells", "side", "top")

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, s, t = (batch.column(i).to_pylist() for i in (2, 3, 4))
                out = [d.add(d.read(x, size), d.multiply(d.read(y, size), d.read(z, size))).tobytes() for x, y, z in zip(a, s, t)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["bi", "bj", "cells"])

        return both.mapInArrow(update, _BLOCK).unionByName(top)

    def _sent(self, rest: DataFrame, top: DataFrame, sides: dict[int, bytes], k: int) -> DataFrame:
        """The round with the pivot's row and column of blocks, of a checked size, in every task."""
        d, size = self.dense, self.size
        tops = {r["bj"]: bytes(r["cells"]) for r in top.collect()}
        panels = rest.sparkSession.sparkContext.broadcast((tops, sides))

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, sides = panels.value
            for batch in batches:
                i, j, a = (c.to_pylist() for c in batch.columns)
                out = [tops[y] if x == k else d.add(d.read(z, size), d.multiply(d.read(sides[x], size), d.read(tops[y], size))).tobytes() for x, y, z in zip(i, j, a)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["bi", "bj", "cells"])

        own = rest.sparkSession.createDataFrame([(k, j, b"") for j in tops], _BLOCK)
        return rest.unionByName(own).mapInArrow(update, _BLOCK)

    # cells --------------------------------------------------------------------------------------

    def cells(self, unit: bool = False) -> DataFrame:
        """(i, j, payload) of what is not zero; with ``unit`` 1 is added to the diagonal. Columns on the right go on from ``count``."""
        d, size, count, width, rows = self.dense, self.size, self.count, self.width, self.rows
        value, kind = self.semiring.payload[0], self.semiring.types[0]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, data in zip(*(c.to_pylist() for c in batch.columns)):
                    a = d.read(data, size)
                    if unit and bi == bj:
                        a = d.add(a, d.unit(size))
                    i, j = np.nonzero(a != d.zero)
                    v = a[i, j]
                    i, j = i + bi * size, j + bj * size
                    here = (i < count) & ((j < count) if bj < rows else (j < rows * size + width))
                    j = j if bj < rows else j - rows * size + count
                    yield pa.RecordBatch.from_arrays([pa.array(i[here]), pa.array(j[here]), pa.array(v[here])], names=["i", "j", value])

        return self.blocks.select("bi", "bj", "cells").mapInArrow(cut, f"i bigint, j bigint, {value} {kind}")


def _numbered(labels: DataFrame) -> tuple[DataFrame, int]:
    """(label, number) of the distinct labels of a column ``label``, and how many there are."""
    numbers = settled(numbered(labels, "label"))
    return numbers, numbers.count()


def _placed(cells: DataFrame, semiring: Semiring, rows: DataFrame, cols: DataFrame, shift: int = 0) -> DataFrame:
    """(i, j, payload) from (row, col, payload), of one place the sum."""
    out = cells.join(rows.select(F.col("label").alias("row"), F.col("number").alias("i")), "row")
    out = out.join(cols.select(F.col("label").alias("col"), (F.col("number") + shift).alias("j")), "col")
    sums = [x.cast(t).alias(p) for x, t, p in zip(semiring.add([F.col(p) for p in semiring.payload]), semiring.types, semiring.payload)]
    return out.groupBy("i", "j").agg(*sums)


def _labelled(cells: DataFrame, semiring: Semiring, rows: DataFrame, cols: DataFrame, shift: int = 0) -> DataFrame:
    out = cells.join(rows.select(F.col("label").alias("row"), F.col("number").alias("i")), "i")
    out = out.join(cols.select(F.col("label").alias("col"), (F.col("number") + shift).alias("j")), "j")
    return out.select("row", "col", *semiring.payload)


def star(cells: DataFrame, semiring: Semiring, labels: DataFrame | None = None, size: int = SIZE, panel: int = PANEL) -> DataFrame:
    """(row, col, payload) of M* = 1 + M M*, zeros left out, from the cells of M.

    ``labels`` has a column ``label``; by default they are those of the cells. Null labels are left out.
    """
    cells = settled(cells)
    if labels is None:
        labels = cells.select(F.col("row").alias("label")).union(cells.select("col"))
    numbers, count = _numbered(labels)
    m = BlockMatrix.of(_placed(cells, semiring, numbers, numbers), semiring, count, 0, _fitting(size, count), panel)
    return _labelled(m.eliminated().cells(unit=True), semiring, numbers, numbers)


def solution(cells: DataFrame, right: DataFrame, semiring: Semiring, size: int = SIZE, panel: int = PANEL) -> DataFrame:
    """(row, col, payload) of X = M X + B, that is M* B, for all columns of B in one elimination.

    ``right`` has the cells (row, col, payload) of B; its rows are labels of M, its columns are labels of their own.
    """
    cells, right = settled(cells), settled(right)
    numbers, count = _numbered(cells.select(F.col("row").alias("label")).union(cells.select("col")).union(right.select("row")))
    cols, width = _numbered(right.select(F.col("col").alias("label")))
    both = _placed(cells, semiring, numbers, numbers).unionByName(_placed(right, semiring, numbers, cols, count))
    m = BlockMatrix.of(both, semiring, count, width, _fitting(size, count), panel)
    return _labelled(m.eliminated(right_only=True).cells(), semiring, numbers, cols, count)


def _fitting(size: int, count: int) -> int:
    """Blocks no larger than the matrix."""
    return max(1, min(size, count))
