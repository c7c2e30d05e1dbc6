"""Commutative semirings over payload columns.

A payload is one or more columns. ``mul`` turns two payloads into Column expressions, ``add`` turns
a payload into aggregates; both stay in the JVM. ``star`` is the quasi-inverse x* = 1 + x x*,
where a semiring has one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Columns = Sequence[Column]


@dataclass(frozen=True)
class Semiring:
    name: str
    types: tuple[str, ...]
    zero: tuple[Any, ...]
    one: tuple[Any, ...]
    add: Callable[[Columns], list[Column]]
    mul: Callable[[Columns, Columns], list[Column]]
    star: Callable[[Columns], list[Column]] | None = None
    idempotent: bool = False

    @property
    def payload(self) -> tuple[str, ...]:
        """Names of the payload's columns."""
        return ("__value",) if len(self.types) == 1 else tuple(f"__value{i}" for i in range(len(self.types)))

    def literal(self, values: Sequence[Any]) -> list[Column]:
        return [F.lit(v).cast(t) for v, t in zip(values, self.types)]


def _one(f: Callable[[Column], Column]) -> Callable[[Columns], list[Column]]:
    return lambda x: [f(x[0])]


def _two(f: Callable[[Column, Column], Column]) -> Callable[[Columns, Columns], list[Column]]:
    return lambda a, b: [f(a[0], b[0])]


def sum_product(type_: str = "double") -> Semiring:
    """(+, x); the star is 1 / (1 - x)."""
    return Semiring(f"sum_product[{type_}]", (type_,), (0,), (1,), _one(F.sum), _two(lambda a, b: a * b), _one(lambda x: 1 / (1 - x)))


def counting() -> Semiring:
    """Multiplicities: (+, x) over integers."""
    return Semiring("counting", ("bigint",), (0,), (1,), _one(F.sum), _two(lambda a, b: a * b))


def boolean() -> Semiring:
    return Semiring("boolean", ("boolean",), (False,), (True,), _one(F.bool_or), _two(lambda a, b: a & b), _one(lambda x: F.lit(True)), idempotent=True)


def min_plus() -> Semiring:
    """Shortest paths: (min, +); the star is 0, or minus infinity on a negative loop."""
    star = _one(lambda x: F.when(x >= 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    return Semiring("min_plus", ("double",), (float("inf"),), (0.0,), _one(F.min), _two(lambda a, b: a + b), star, idempotent=True)


def max_plus() -> Semiring:
    star = _one(lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
    return Semiring("max_plus", ("double",), (float("-inf"),), (0.0,), _one(F.max), _two(lambda a, b: a + b), star, idempotent=True)


def max_product() -> Semiring:
    """Most likely assignments: (max, x) over numbers that are not negative."""
    return Semiring("max_product", ("double",), (0.0,), (1.0,), _one(F.max), _two(lambda a, b: a * b), idempotent=True)


def complex_sum_product() -> Semiring:
    """(+, x) over complex numbers held as two columns."""
    return Semiring(
        "complex",
        ("double", "double"),
        (0.0, 0.0),
        (1.0, 0.0),
        lambda x: [F.sum(x[0]), F.sum(x[1])],
        lambda a, b: [a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]],
    )
