"""Factors: DataFrames with a column per variable and a payload in a semiring.

``combine`` is an equi-join on the shared variables whose payloads are multiplied, ``project`` a
grouped aggregation that adds payloads up; Catalyst picks how either is carried out. The
neutral element is the factor without a DataFrame, elided while plans are built. A factor has
at most one row per assignment of its variables; an assignment without a row has payload zero.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.functions.semiring import Semiring
from sumfold.plans.measures import active

Label = frozenset


@dataclass
class Counters:
    """Operators emitted: combinations of two factors neither of which is neutral, projections that are not no-ops."""

    combines: int = 0
    projects: int = 0

    def reset(self) -> None:
        self.combines = self.projects = 0


COUNTERS = Counters()


@dataclass(frozen=True)
class Factor:
    semiring: Semiring
    df: DataFrame | None = None
    label: Label = field(default=Label())
    #: Rows, as far as the planner can tell.
    rows: float = 1.0
    #: The step of a measured run that this is the output of.
    step: int | None = None

    # construction -------------------------------------------------------------------------------

    @classmethod
    def identity(cls, semiring: Semiring) -> "Factor":
        return cls(semiring)

    @classmethod
    def of(cls, df: DataFrame, semiring: Semiring, variables: Sequence[str], payload: Sequence[Column | str] | None = None, unique: bool = False, rows: float = 1e6) -> "Factor":
        """A factor over ``variables`` of ``df``; rows of one assignment are added up unless they are ``unique``."""
        values = [F.col(p) if isinstance(p, str) else p for p in (payload or semiring.payload)]
        if len(values) != len(semiring.types):
            raise ValueError(f"{semiring.name} has {len(semiring.types)} payload columns, not {len(values)}")
        df = df.select(*variables, *[v.cast(t).alias(p) for v, t, p in zip(values, semiring.types, semiring.payload)])
        new = cls(semiring, df, Label(variables), rows)
        return new if unique else new._grouped(sorted(variables))

    @classmethod
    def from_lists(cls, spark: SparkSession, semiring: Semiring, frames: Sequence[tuple[str, Sequence[Any]]], values: Sequence[Any]) -> "Factor":
        """A total factor from its variables' frames and its payloads, the first variable varying slowest."""
        if len(set(v for v, _ in frames)) != len(frames):
            raise ValueError("a variable is listed twice")
        if len(values) != math.prod(len(f) for _, f in frames):
            raise ValueError(f"{math.prod(len(f) for _, f in frames)} payloads are needed, not {len(values)}")
        names = [v for v, _ in frames]
        payloads = [x if isinstance(x, tuple) else (x,) for x in values]
        rows = [(*a, *p) for a, p in zip(itertools.product(*(f for _, f in frames)), payloads)]
        df = spark.createDataFrame(rows, [*names, *[f"_p{i}" for i in range(len(semiring.types))]])
        return cls.of(df, semiring, names, [f"_p{i}" for i in range(len(semiring.types))], unique=True, rows=len(rows))

    # algebra ------------------------------------------------------------------------------------

    @property
    def is_identity(self) -> bool:
        return self.df is None

    def combine(self, other: "Factor") -> "Factor":
        """The product: a natural join with payloads multiplied."""
        if self.is_identity or other.is_identity:
            return other if self.is_identity else self
        if self.semiring != other.semiring and self.semiring.name != other.semiring.name:
            raise ValueError(f"{self.semiring.name} and {other.semiring.name} do not mix")
        COUNTERS.combines += 1
        s, shared = self.semiring, sorted(self.label & other.label)
        theirs = [f"__right{p}" for p in s.payload]
        right = other.df.withColumnsRenamed(dict(zip(s.payload, theirs)))
        joined = self.df.join(right, shared, "inner") if shared else self.df.crossJoin(right)
        product = s.mul([F.col(p) for p in s.payload], [F.col(p) for p in theirs])
        label = self.label | other.label
        df = joined.select(*sorted(label), *[x.cast(t).alias(p) for x, t, p in zip(product, s.types, s.payload)])
        # as if shared variables were keys of the smaller side
        rows = max(self.rows, other.rows) if shared else self.rows * other.rows
        return Factor(s, df, label, rows).measured("combine", self, other)

    __mul__ = combine

    def project(self, domain: Collection[str]) -> "Factor":
        """Keep the variables of ``domain``; no operation if there are no others."""
        if self.is_identity or self.label <= set(domain):
            return self
        COUNTERS.projects += 1
        return self._grouped(sorted(self.label & set(domain))).measured("project", self)

    def eliminate(self, variables: Collection[str]) -> "Factor":
        return self.project(self.label - set(variables))

    def _grouped(self, keys: list[str]) -> "Factor":
        s = self.semiring
        # cast back: nested sums of decimals widen their type
        sums = s.add([F.col(p) for p in s.payload])
        if not keys:  # a sum of nothing; any other null stays, as of decimals that are too large
            sums = [F.when(F.count("*") == 0, z).otherwise(x) for x, z in zip(sums, s.literal(s.zero))]
        sums = [x.cast(t).alias(p) for x, t, p in zip(sums, s.types, s.payload)]
        df = self.df.groupBy(*keys).agg(*sums) if keys else self.df.agg(*sums)
        return Factor(s, df, Label(keys), self.rows if keys else 1.0)

    def checked(self) -> "Factor":
        """The same factor, after a look for assignments with two rows: an error. ``unique`` is else taken on trust."""
        if not self.is_identity and not self.df.groupBy(*sorted(self.label)).count().where("count > 1").isEmpty():
            raise ValueError("an assignment has two payloads")
        return self

    def measured(self, operator: str, *inputs: "Factor") -> "Factor":
        """The same factor, as a step of the measured run that is under way, if one is."""
        recorder = active()
        if recorder is None or self.is_identity:
            return self
        df, step = recorder.observed(operator, self.label, self.df, [f.step for f in inputs])
        return replace(self, df=df, step=step)

    # access -------------------------------------------------------------------------------------

    def frames(self) -> dict[str, DataFrame]:
        """Each variable's values."""
        return {v: self.df.select(v).distinct() for v in sorted(self.label)}

    def frame_length(self, variable: str) -> int | float:
        return math.inf if self.is_identity else self.df.select(variable).distinct().count()

    def is_total(self) -> bool:
        """Whether every assignment of the variables' values has a row."""
        counts = self.df.agg(F.count("*"), *[F.count_distinct(v) for v in sorted(self.label)]).first()
        return counts[0] == math.prod(counts[1:])

    def lookup(self, assignment: Mapping[str, Any]) -> Any:
        """The payload of a full assignment; zero if all its values are known, else a ``KeyError``."""
        if self.is_identity:
            raise ValueError("the neutral factor has no payloads")
        if set(assignment) != set(self.label):
            raise KeyError(f"an assignment of {sorted(self.label)} is needed")
        match = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in assignment.items()], F.lit(True))
        found = self.df.where(match).select(*self.semiring.payload).first()
        if found is None:
            for k, v in assignment.items():
                if self.df.where(F.col(k) == F.lit(v)).isEmpty():
                    raise KeyError(f"{k} is never {v!r}")
            found = self.semiring.zero
        return found[0] if len(found) == 1 else tuple(found)

    def lookups(self, queries: DataFrame) -> DataFrame:
        """The payload of each row of ``queries``, which has a column for each variable; null if there is none."""
        return queries.join(self.df, sorted(self.label), "left")

    def where(self, evidence: Mapping[str, Any]) -> "Factor":
        """Only assignments that agree with ``evidence`` on the factor's variables."""
        known = {k: v for k, v in evidence.items() if k in self.label}
        if not known or self.is_identity:
            return self
        match = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in known.items()])
        return replace(self, df=self.df.where(match))

    # renaming -----------------------------------------------------------------------------------

    def rename(self, names: Mapping[str, str]) -> "Factor":
        """Other names for variables; two of them must not become one."""
        label = [names.get(v, v) for v in self.label]
        if len(set(label)) != len(label):
            raise ValueError("two variables would have one name")
        return replace(self, df=self.df.withColumnsRenamed(dict(names)), label=Label(label))

    def map_values(self, variable: str, values: Mapping[Any, Any]) -> "Factor":
        """Other names for a variable's values; two of them must not become one."""
        if len(set(values.values())) != len(values):
            raise ValueError("two values would become one")
        table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        return replace(self, df=self.df.withColumn(variable, F.coalesce(table[F.col(variable)], F.col(variable))))

    def map_payload(self, f: Callable[[Sequence[Column]], Sequence[Column]]) -> "Factor":
        new = f([F.col(p) for p in self.semiring.payload])
        return replace(self, df=self.df.select(*sorted(self.label), *[x.cast(t).alias(p) for x, t, p in zip(new, self.semiring.types, self.semiring.payload)]))

    def show(self, n: int = 20) -> None:
        self.df.orderBy(*sorted(self.label)).show(n, truncate=False)


def combine_all(factors: Iterable[Any]) -> Any:
    """The product of one factor or more."""
    return reduce(lambda a, b: a.combine(b), factors)


def show_domain(domain: Collection[str]) -> str:
    return "{" + ", ".join(sorted(domain)) + "}"
