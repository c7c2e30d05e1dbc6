"""Conditional probabilities in Bayesian networks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.operators.factor import Factor
from sumfold.plans.engine import Mode, queries

#: Conditions less likely than this count as impossible.
LEAST = 1e-10


@dataclass(frozen=True)
class Conditional:
    """P(conditioned | conditional), both assignments."""

    conditioned: Mapping[str, Any]
    conditional: Mapping[str, Any]

    @classmethod
    def of(cls, conditioned: Sequence[tuple[str, Any]], conditional: Sequence[tuple[str, Any]] = ()) -> "Conditional":
        for part in (conditioned, conditional):
            if len(dict(part)) != len(part):
                raise ValueError("a variable is assigned twice")
        return cls(dict(conditioned), dict(conditional))

    @property
    def domain(self) -> frozenset:
        return frozenset(self.conditioned) | frozenset(self.conditional)

    def in_conflict(self) -> bool:
        return any(self.conditional.get(k, v) != v for k, v in self.conditioned.items())


def probability_table(network: Sequence[Factor], asked: Sequence[Conditional], mode: Mode = Mode.FUSION, frames: Mapping[str, int] | None = None) -> DataFrame:
    """(query, probability): what each query asks for, by its place in ``asked``; 0 if it contradicts itself or its condition is impossible."""
    domains = list(dict.fromkeys(q.domain for q in asked))
    parts = []
    for d, joint in zip(domains, queries(network, domains, mode, frames=frames)):
        value = F.col(joint.semiring.payload[0])
        # all questions of these variables in one pass over their joint table
        sums = []
        for i, q in ((i, q) for i, q in enumerate(asked) if q.domain == d):
            known = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in q.conditional.items()], F.lit(True))
            holds = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in q.conditioned.items()], known & F.lit(not q.in_conflict()))
            sums.append(F.struct(F.lit(i).cast("bigint").alias("query"), F.sum(F.when(known, value)).alias("all"), F.sum(F.when(holds, value)).alias("both")))
        parts.append(joint.df.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    possible = F.abs(F.col("all")) >= LEAST
    return reduce(DataFrame.unionByName, parts).select("query", F.when(possible, F.coalesce("both", F.lit(0.0)) / F.col("all")).otherwise(0.0).alias("probability"))


def probabilities(network: Sequence[Factor], asked: Sequence[Conditional], mode: Mode = Mode.FUSION, frames: Mapping[str, int] | None = None) -> list[float]:
    """The same as numbers."""
    return [r["probability"] for r in probability_table(network, asked, mode, frames).orderBy("query").collect()] if asked else []
