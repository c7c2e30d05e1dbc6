"""The transform in few parts, and of asked-for outputs, against NumPy."""

import numpy as np
import pytest

from sumfold.operators import dft


def outputs(df, n=None):
    rows = df.collect()
    if n is None:
        return {r["i"]: complex(r["re"], r["im"]) for r in rows}
    assert sorted(r["i"] for r in rows) == list(range(n))
    return np.array([complex(r["re"], r["im"]) for r in sorted(rows, key=lambda r: r["i"])])


def samples(spark, n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=n) + 1j * r.normal(size=n)
    return x, spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "i bigint, re double, im double")


@pytest.mark.parametrize(("n", "digits"), [(1, 20), (2, 20), (3, 20), (64, 20), (100, 20), (100, 3), (100, 1), (1000, 4)])
def test_all_outputs(spark, n, digits):
    x, df = samples(spark, n)
    size = max(2, 1 << (n - 1).bit_length())
    assert np.allclose(outputs(dft.padded(df, digits=digits), size), np.fft.fft(x, size))


@pytest.mark.parametrize("digits", [20, 3])
def test_asked_outputs_only(spark, digits):
    x, df = samples(spark, 200)
    asked = spark.createDataFrame([(i,) for i in (0, 5, 5, 17, 255, 256, -1, None, 128)], "i bigint")
    got = outputs(dft.padded(df, asked, digits))
    expected = np.fft.fft(x, 256)
    assert sorted(got) == [0, 5, 17, 128, 255] and all(np.isclose(got[i], expected[i]) for i in got)
    assert outputs(dft.padded(df, asked.limit(0), digits)) == {}


def test_gaps_count_as_zeros_and_repeated_numbers_add_up(spark):
    df = spark.createDataFrame([(3, 1.0, 0.0), (3, 2.0, -1.0), (900, 0.5, 0.25)], "i bigint, re double, im double")
    x = np.zeros(1024, "c16")
    x[3], x[900] = 3 - 1j, 0.5 + 0.25j
    assert np.allclose(outputs(dft.padded(df), 1024), np.fft.fft(x))
    for rows in ([], [(None, 1.0, 0.0)], [(-1, 1.0, 0.0)]):
        with pytest.raises(ValueError, match="whole numbers"):
            dft.padded(spark.createDataFrame(rows, "i bigint, re double, im double"))


def test_two_exchanges_whatever_the_digits(spark):
    for n in (64, 5000):
        plan = dft.padded(samples(spark, n)[1])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
