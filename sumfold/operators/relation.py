"""Relations: tables as bags, joined naturally and projected without removing duplicates."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.functions.scratch import settled
from sumfold.functions.semiring import counting
from sumfold.operators.factor import Factor


@dataclass(frozen=True)
class Relation:
    """A bag of rows; ``df`` None is the neutral one (no columns, one row)."""

    df: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> "Relation":
        if any(len(r) != len(columns) for r in rows):
            raise ValueError("a row has not as many values as there are columns")
        return cls(spark.createDataFrame([tuple(r) for r in rows], list(columns)))

    @property
    def label(self) -> frozenset:
        return frozenset(self.df.columns) if self.df is not None else frozenset()

    @property
    def is_identity(self) -> bool:
        return self.df is None

    def combine(self, other: "Relation") -> "Relation":
        """The natural join, columns in order of their names; without shared columns every pair of rows."""
        if self.is_identity or other.is_identity:
            return other if self.is_identity else self
        shared = sorted(self.label & other.label)
        joined = self.df.join(other.df, shared, "inner") if shared else self.df.crossJoin(other.df)
        return Relation(joined.select(*sorted(self.label | other.label)))

    def project(self, domain: Collection[str]) -> "Relation":
        """The columns of ``domain`` in their order, with all rows."""
        return self if self.is_identity else Relation(self.df.select(*[c for c in self.df.columns if c in set(domain)]))

    def counted(self) -> Factor:
        """The same bag as rows with multiplicities, which joins and projects without repeating rows."""
        return Factor.of(self.df.withColumn("__value", F.lit(1)), counting(), self.df.columns)


def expanded(factor: Factor) -> DataFrame:
    """A counted bag's rows, each as often as it counts, in pieces that fit an array."""
    value, piece = factor.semiring.payload[0], 1 << 16
    some = factor.df.where(F.col(value) > 0)
    nth, part = (_free(some.columns, x) for x in ("_nth", "_piece"))
    pieces = some.withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(value) - 1) / piece))))
    size = F.least(F.lit(piece).cast("bigint"), F.col(value) - piece * F.col(part))
    return pieces.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop(value, part, nth)


def _free(columns: Collection[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_tree(labels: Sequence[Collection[str]]) -> list[tuple[int, int]]:
    """(child, parent) of a forest over tables, children before their parents, that hangs together those that share most columns.

    If the natural join is acyclic, this is one of its join trees.
    """
    sets, edges, left = [frozenset(x) for x in labels], [], set(range(len(labels)))
    while left:
        inside = [min(left, key=lambda i: (-len(sets[i]), i))]
        left -= set(inside)
        while True:
            shared, child, parent = max(((len(sets[i] & sets[j]), -i, -j) for i in left for j in inside), default=(0, 0, 0))
            if not shared:
                break
            edges.append((-child, -parent))
            inside.append(-child)
            left.discard(-child)
    return edges[::-1]


def reduced(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """The tables without rows that have no part in their natural join, by semi joins up and down a join tree.

    Up the tree a table loses what its children's keys do not have, down it what its parent's do not; only keys are written. If the join is
    acyclic nothing is left that dangles, otherwise some may be. Tables without a column in common do not reduce each other.
    """
    out, tree = list(tables), join_tree([t.columns for t in tables])
    for ways in (tree, [(parent, child) for child, parent in reversed(tree)]):
        for source, target in ways:
            shared = sorted(set(out[source].columns) & set(out[target].columns))
            keys = settled(out[source].select(*shared).distinct())
            out[target] = out[target].join(keys, shared, "left_semi").select(*out[target].columns)
    return out


def counts(tables: Sequence[DataFrame], columns: Collection[str], reduce: bool = False) -> Factor:
    """How often each assignment of ``columns`` is in the natural join of ``tables``; with ``reduce`` dangling rows go first."""
    from sumfold.plans.engine import query

    return query([Relation(t).counted() for t in (reduced(tables) if reduce else tables)], columns)


def answer(tables: Sequence[DataFrame], columns: Collection[str], reduce: bool = False) -> DataFrame:
    """The bag of ``columns`` in the natural join of ``tables``, counted bucket by bucket.

    Multiplicities are pushed through the joins, so that no intermediate repeats rows.
    """
    return expanded(counts(tables, columns, reduce)).select(*sorted(columns))
