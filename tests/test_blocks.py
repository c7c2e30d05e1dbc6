"""Blocked stars and solutions against plain code."""

import numpy as np
import pytest

from sumfold.functions.dense import dense
from sumfold.functions.semiring import boolean, counting, max_plus, min_plus, sum_product
from sumfold.operators import blocks


def plain_star(semiring, a):
    """1 + a + a a + ... by repeated squaring of 1 + a."""
    d = dense(semiring)
    out = d.add(a, d.unit(len(a)))
    for _ in range(len(a)):
        out = d.multiply(out, out)
    return out


def table(spark, a, zero, names=None):
    n = names or list(range(len(a)))
    rows = [(n[i], n[j], a[i, j].item()) for i, j in zip(*np.nonzero(a != zero))]
    kind = "string" if names else "bigint"
    return spark.createDataFrame(rows, f"row {kind}, col {kind}, __value {'boolean' if a.dtype == bool else 'double'}")


def matrix(df, n, d, names=None):
    out = d.zeros(n, n)
    at = {x: i for i, x in enumerate(names)} if names else None
    for r in df.collect():
        out[at[r["row"]] if at else r["row"], at[r["col"]] if at else r["col"]] = r["__value"]
    return out


@pytest.mark.parametrize(("semiring", "size", "panel"), [(min_plus(), 4, blocks.PANEL), (min_plus(), 5, 0), (max_plus(), 256, blocks.PANEL), (boolean(), 6, blocks.PANEL)])
def test_star_in_blocks_of_any_size(spark, semiring, size, panel):
    d, r, n = dense(semiring), np.random.default_rng(1), 13
    there = r.random((n, n)) < 0.15
    a = there if d.dtype == "?" else np.where(there, r.integers(1, 9, (n, n)) * (1.0 if semiring.name == "min_plus" else -1.0), d.zero)
    expected = plain_star(semiring, a)
    got = matrix(blocks.star(table(spark, a, d.zero), semiring, size=size, panel=panel, labels=spark.range(n).selectExpr("id AS label")), n, d)
    assert (got == expected).all()


def test_star_of_numbers_is_the_inverse(spark):
    r, n = np.random.default_rng(2), 11
    a = np.where(r.random((n, n)) < 0.5, r.random((n, n)) / n, 0.0)
    names = [f"l{i:02}" for i in range(n)]
    got = matrix(blocks.star(table(spark, a, 0.0, names), sum_product(), size=4), n, dense(sum_product()), names)
    assert np.allclose(got, np.linalg.inv(np.eye(n) - a))


def test_cycles_that_improve_without_end(spark):
    cells = spark.createDataFrame([(0, 1, -2.0), (1, 0, 1.0), (2, 2, 5.0), (3, 0, 4.0), (2, 4, -1.0)], "row bigint, col bigint, __value double")
    inf = float("inf")
    for size in (2, 8):
        got = {(r["row"], r["col"]): r["__value"] for r in blocks.star(cells, min_plus(), size=size).collect()}
        assert got == {(0, 0): -inf, (0, 1): -inf, (1, 0): -inf, (1, 1): -inf, (2, 2): 0.0, (3, 3): 0.0, (4, 4): 0.0, (3, 0): -inf, (3, 1): -inf, (2, 4): -1.0}


def test_one_elimination_for_many_right_hand_sides(spark):
    r, n, t = np.random.default_rng(3), 14, 9
    for semiring, size, panel in ((min_plus(), 5, 0), (sum_product(), 4, blocks.PANEL)):
        d = dense(semiring)
        a = np.where(r.random((n, n)) < 0.2, r.random((n, n)) / n if d.zero == 0 else r.integers(1, 9, (n, n)).astype(float), d.zero)
        b = np.where(r.random((n, t)) < 0.4, r.integers(1, 9, (n, t)).astype(float), d.zero)
        expected = d.multiply(np.linalg.inv(np.eye(n) - a) if d.zero == 0 else plain_star(semiring, a), b)
        right = spark.createDataFrame([(int(i), f"t{j}", b[i, j].item()) for i, j in zip(*np.nonzero(b != d.zero))], "row bigint, col string, __value double")
        got = d.zeros(n, t)
        for row in blocks.solution(table(spark, a, d.zero), right, semiring, size=size, panel=panel).collect():
            got[row["row"], int(row["col"][1:])] = row["__value"]
        assert np.allclose(got, expected)


def test_nothing_repeated_places_and_null_labels(spark):
    none = spark.createDataFrame([], "row bigint, col bigint, __value double")
    assert blocks.star(none, min_plus()).count() == 0 and blocks.solution(none, none, min_plus()).count() == 0
    cells = spark.createDataFrame([(1, 2, 5.0), (1, 2, 3.0), (None, 2, 1.0), (2, None, 1.0)], "row bigint, col bigint, __value double")
    assert sorted(map(tuple, blocks.star(cells, min_plus()).collect())) == [(1, 1, 0.0), (1, 2, 3.0), (2, 2, 0.0)]
    with pytest.raises(ValueError, match="dense"):
        blocks.star(cells, counting())


def test_rounds_grow_with_blocks_and_not_with_labels(spark):
    def jobs(count, size):
        group = f"blocks-{count}-{size}"
        spark.sparkContext.setJobGroup(group, group)
        blocks.star(spark.range(count - 1).selectExpr("id AS row", "id + 1 AS col", "1D AS __value"), min_plus(), size=size).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    jobs(4, 4)
    assert jobs(24, 8) <= jobs(9, 3) + 2
