"""Arithmetic of dense blocks over a semiring, in NumPy: what tasks do with a block of a matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from sumfold.functions.semiring import Semiring


@dataclass(frozen=True)
class Dense:
    """``add`` of two arrays, ``mul`` of two arrays that broadcast, ``star`` of a number; ``zero`` fills what is absent."""

    dtype: str
    zero: float
    one: float
    add: Callable[[np.ndarray, np.ndarray], np.ndarray]
    mul: Callable[[np.ndarray, np.ndarray], np.ndarray]
    star: Callable[[float], float]
    product: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def zeros(self, rows: int, cols: int) -> np.ndarray:
        return np.full((rows, cols), self.zero, self.dtype)

    def unit(self, n: int) -> np.ndarray:
        out = self.zeros(n, n)
        np.fill_diagonal(out, self.one)
        return out

    def multiply(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.product is not None:
            return self.product(a, b)
        out = self.zeros(len(a), b.shape[1])
        with np.errstate(invalid="ignore"):
            for k in range(len(b)):
                out = self.add(out, self.mul(a[:, k, None], b[None, k, :]))
        return out

    def closure(self, a: np.ndarray) -> np.ndarray:
        """a* = 1 + a a*, one label after another."""
        a = a.copy()
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(len(a)):
                first = self.mul(a[:, k, None], np.array(self.star(a[k, k]), self.dtype))
                # zero times anything is zero, minus infinity included
                first = np.where(a[:, k, None] == self.zero, np.array(self.zero, self.dtype), first)
                a = self.add(a, self.mul(first, a[None, k, :]))
        return self.add(a, self.unit(len(a)))

    def read(self, data: bytes, rows: int) -> np.ndarray:
        return np.frombuffer(data, self.dtype).reshape(rows, -1)


def dense(semiring: Semiring) -> Dense | None:
    """The arithmetic of a semiring that has one with a star, else None."""
    # fmin and fmax pass over the NaN of infinity less infinity, which stands for a product with zero
    if semiring.name == "min_plus":
        return Dense("f8", np.inf, 0.0, np.fmin, np.add, lambda x: 0.0 if x >= 0 else -np.inf)
    if semiring.name == "max_plus":
        return Dense("f8", -np.inf, 0.0, np.fmax, np.add, lambda x: 0.0 if x <= 0 else np.inf)
    if semiring.name == "boolean":
        return Dense("?", False, True, np.logical_or, np.logical_and, lambda x: True, lambda a, b: (a.astype("f4") @ b.astype("f4")) > 0)
    if semiring.name == "sum_product[double]":
        return Dense("f8", 0.0, 1.0, np.add, np.multiply, lambda x: 1 / (1 - x), np.matmul)
    return None
