"""Best assignments: not only the best value of each assignment asked for, but values of all other variables that have it.

For semirings that add by choosing, (min, +) and the like. While variables are eliminated, each projection keeps with a value the choice of the
variable that won it, in the same aggregate. What was chosen is a table by the variables that were left; from the answer back, the last
eliminated variable first, each choice is looked up with those already known. Of choices that are as good the least one is taken.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.functions.scratch import settled
from sumfold.functions.semiring import Semiring
from sumfold.operators.factor import Factor, combine_all
from sumfold.plans.elimination import EliminationOrder
from sumfold.plans.engine import _ready

#: Semirings that choose, and whether the least payload is the best.
CHOOSE_LEAST = {"min_plus": True, "max_plus": False, "max_product": False}


def _rank(semiring: Semiring, value: Column) -> Column:
    """What is least for the best payload."""
    return value if CHOOSE_LEAST[semiring.name] else -value


def chosen(product: Factor, variable: str) -> DataFrame:
    """(other variables, payload, variable): for each assignment of the others the best payload and the variable's value that has it."""
    s = product.semiring
    (value,) = s.payload
    best = F.min(F.struct(_rank(s, F.col(value)).alias("rank"), F.col(variable).alias("choice"))).alias("__best")
    rest = sorted(product.label - {variable})
    table = product.df.groupBy(*rest).agg(best) if rest else product.df.agg(best).where("__best IS NOT NULL")
    return table.select(*rest, _rank(s, F.col("__best.rank")).alias(value), F.col("__best.choice").alias(variable))


def witnesses(factors: Sequence[Factor], domain: Collection[str], evidence: Mapping[str, object] | None = None, frames: Mapping[str, int] | None = None, sized: bool = False) -> DataFrame:
    """(all variables, payload): for each assignment of ``domain`` the best payload of the factors' product, and an assignment that has it.

    Assignments that no factor's rows have are absent. Factors hold one payload per assignment.
    """
    factors = _ready(factors, [domain], evidence)
    semiring = factors[0].semiring
    if semiring.name not in CHOOSE_LEAST:
        raise ValueError(f"{semiring.name} adds up, it does not choose")
    (value,) = semiring.payload
    held, choices = list(factors), []
    for variable in EliminationOrder([f.label for f in factors], domain, frames, [f.rows for f in factors] if sized else None):
        bucket = sorted((f for f in held if variable in f.label), key=lambda f: f.rows)
        product = combine_all(bucket)
        table = settled(chosen(product, variable))  # read by what comes next, and on the way back
        rest = sorted(product.label - {variable})
        choices.append((variable, rest, table))
        held = [f for f in held if variable not in f.label] + [Factor(semiring, table.select(*rest, value), frozenset(rest), product.rows)]
    out = combine_all(sorted(held, key=lambda f: f.rows)).df
    for variable, rest, table in reversed(choices):
        known = table.select(*rest, variable)
        out = out.join(known, rest) if rest else out.crossJoin(F.broadcast(known))  # one row
    return out
