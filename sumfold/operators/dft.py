"""The discrete Fourier transform as a projection query.

With n = sum X_j 2^j and k = sum Y_l 2^l the kernel exp(-2 pi i n k / 2^m) is a product of factors over single
digits X_j, Y_l with j + l < m; summing the X_j out one after another is the fast transform.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.functions.binary import log2_exact
from sumfold.functions.semiring import complex_sum_product
from sumfold.operators.factor import Factor
from sumfold.plans.engine import Mode, query

COMPLEX = complex_sum_product()

#: Binary digits that a task sums out at most: a million samples.
DIGITS = 20


def kernel(spark: SparkSession, m: int, j: int, l: int) -> Factor:  # noqa: E741
    """exp(-2 pi i X_j Y_l / 2^(m - j - l))."""
    angle = -2 * math.pi / 2 ** (m - j - l)
    values = [(math.cos(angle * x * y), math.sin(angle * x * y)) for x in (0, 1) for y in (0, 1)]
    return Factor.from_lists(spark, COMPLEX, [(f"x{j}", (0, 1)), (f"y{l}", (0, 1))], values)


def knowledge(samples: DataFrame, m: int) -> list[Factor]:
    """The samples (i, re, im) by their number's digits, and the kernels."""
    digits = [F.shiftright("i", j).bitwiseAND(1).cast("bigint").alias(f"x{j}") for j in range(m)]
    df = samples.select(*digits, "re", "im")
    first = Factor.of(df, COMPLEX, [f"x{j}" for j in range(m)], ["re", "im"], unique=True, rows=2**m)
    return [first, *[kernel(samples.sparkSession, m, j, l) for j in range(m) for l in range(m - j)]]  # noqa: E741


def transform(samples: DataFrame, mode: Mode = Mode.FUSION) -> DataFrame:
    """(i, re, im): the unnormalised forward transform; the number of samples is a power of two and more than one."""
    n = samples.count()
    m = log2_exact(n)
    if not m:
        raise ValueError(f"the number of samples must be a power of two and more than one, not {n}")
    answer = query(knowledge(samples, m), [f"y{l}" for l in range(m)], mode, frames={f"{v}{i}": 2 for v in "xy" for i in range(m)})  # noqa: E741
    number = sum((F.shiftleft(F.col(f"y{l}"), l) for l in range(m)), F.lit(0))  # noqa: E741
    return answer.df.select(number.cast("bigint").alias("i"), *[F.col(p).alias(x) for p, x in zip(COMPLEX.payload, ("re", "im"))])


def padded(samples: DataFrame, asked: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """(i, re, im): the unnormalised forward transform of ``samples`` at their numbers, any number of them; of ``asked`` (i) only these.

    Numbers without a sample count as zeros, up to the next power of two above the last; several samples of a number
    add up. The digits of n are summed out in a few parts, the leading ones first. With ``d`` digits gone, k the last d digits of the
    output and n = a 2^l + r, where a are the ``p`` digits that go next,

        S'(r, k + 2^d t) = sum over a of S(a 2^l + r, k) exp(-2 pi i a k / 2^(d + p)) exp(-2 pi i a t / 2^p),

    a transform of length 2^p for each r and k, which a task takes whole; p is at most ``digits``. So there is one shuffle for each part,
    two up to 2^(2 ``digits``) samples. Where outputs are asked for, each part passes on only what leads to them. Asked
    numbers beyond the transform are absent from the answer.
    """
    low, high, rows, known = samples.agg(F.min("i"), F.max("i"), F.count("*"), F.count("i")).first()
    if not rows or known < rows or low < 0:
        raise ValueError("samples need whole numbers from 0, and there must be some")
    m = max(1, int(high).bit_length())
    count = max(1 if m == 1 else 2, math.ceil(m / digits))
    parts = [m * (i + 1) // count - m * i // count for i in range(count)]
    df = samples.select(F.col("i").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("k"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    wanted = None if asked is None else asked.select(F.col("i").cast("bigint").alias("k")).where(f"k >= 0 AND k < {2**m}").distinct()
    done = 0
    for part in parts:
        left = m - done - part
        keyed = df.select(_last("n", left).alias("n"), "k", F.shiftright("n", left).alias("a"), "re", "im").groupBy("n", "k")
        if wanted is not None and not left:
            # the outputs that are asked for beside the samples that lead to them
            there = wanted.select(F.lit(0).cast("bigint").alias("n"), _last("k", done).alias("k"), F.shiftright("k", done).alias("t"))
            df = keyed.cogroup(there.groupBy("n", "k")).applyInArrow(_asked_part(part, done), _SCHEMA)
        else:
            df = keyed.applyInArrow(_every_part(part, done), _SCHEMA)
            if wanted is not None:
                df = df.join(wanted.select(_last("k", done + part).alias("k")).distinct(), "k", "left_semi").select("n", "k", "re", "im")
        done += part
    return df.select(F.col("k").alias("i"), "re", "im")


_SCHEMA = "n bigint, k bigint, re double, im double"


def _last(column: str, digits: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << digits) - 1).cast("bigint"))


def _every_part(part: int, done: int) -> Callable:
    def apply(key: tuple, group: pa.Table) -> pa.Table:
        return _summed(key, group, part, done)

    return apply


def _asked_part(part: int, done: int) -> Callable:
    def apply(key: tuple, group: pa.Table, asked: pa.Table) -> pa.Table:
        return _summed(key, group, part, done, asked["t"].to_numpy())

    return apply


def _summed(key: tuple, group: pa.Table, part: int, done: int, asked: np.ndarray | None = None) -> pa.Table:
    """One group's sums over ``part`` digits, for all further digits of the output or those ``asked`` for."""
    n, k = (x.as_py() for x in key)
    if not len(group):
        return pa.table({c: pa.array([], t) for c, t in (("n", pa.int64()), ("k", pa.int64()), ("re", pa.float64()), ("im", pa.float64()))})
    a, size = np.arange(1 << part, dtype="i8"), 1 << (done + part)
    x = np.zeros(1 << part, "c16")
    np.add.at(x, group["a"].to_numpy(), group["re"].to_numpy() + 1j * group["im"].to_numpy())
    y = np.fft.fft(x * np.exp(-2j * np.pi * (a * k % size) / size))
    t = a if asked is None else asked
    return pa.table({"n": pa.array(np.full(len(t), n)), "k": pa.array(k + (t << done)), "re": pa.array(y.real[t]), "im": pa.array(y.imag[t])})


def values(spark: SparkSession, numbers: Sequence[complex], mode: Mode = Mode.FUSION) -> list[complex]:
    """The transform of numbers given on the driver."""
    rows = [(i, float(complex(x).real), float(complex(x).imag)) for i, x in enumerate(numbers)]
    out = transform(spark.createDataFrame(rows, "i bigint, re double, im double"), mode)
    return [complex(r["re"], r["im"]) for r in out.orderBy("i").collect()]
