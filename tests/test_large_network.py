"""A network as large as the usual benchmark of 37 nodes, against plain elimination."""

import itertools
import math
import random

import pytest

from sumfold.functions.semiring import sum_product
from sumfold.operators.bayes import Conditional, probabilities
from sumfold.operators.factor import Factor
from sumfold.plans.engine import Mode, queries


def net_of(nodes: int, seed: int):
    """A network of as many nodes, of two to four states, each with up to three of the four nodes before it as parents."""
    r = random.Random(seed)
    states = [r.choice((2, 2, 3, 4)) for _ in range(nodes)]
    parents = [sorted(r.sample(range(max(0, i - 4), i), min(i, r.choice((0, 1, 1, 2, 3))))) for i in range(nodes)]
    tables = []
    for i in range(nodes):
        table = {}
        for p in itertools.product(*[range(states[j]) for j in parents[i]]):
            weights = [r.randrange(1, 20) for _ in range(states[i])]
            for x, w in enumerate(weights):
                table[(x, *p)] = w / sum(weights)
        tables.append(((i, *parents[i]), table))
    return states, tables


def plain_joint(states, tables, keep):
    """The joint table of ``keep`` by eliminating one node after another, the last one first."""
    held = list(tables)
    for v in reversed([i for i in range(len(states)) if i not in keep]):
        bucket = [t for t in held if v in t[0]]
        label = tuple(sorted(set().union(*[t[0] for t in bucket]) - {v}))
        new = {}
        for a in itertools.product(*[range(states[j]) for j in label]):
            at = dict(zip(label, a))
            new[a] = sum(math.prod(t[1][tuple(x if j == v else at[j] for j in t[0])] for t in bucket) for x in range(states[v]))
        held = [t for t in held if v not in t[0]] + [(label, new)]
    label = tuple(sorted(keep))
    return {a: math.prod(t[1][tuple(dict(zip(label, a))[j] for j in t[0])] for t in held) for a in itertools.product(*[range(states[j]) for j in label])}


def test_a_network_of_37_nodes_in_every_mode_but_the_whole_join(spark):
    states, tables = net_of(37, 11)
    factors = [Factor.of(spark.createDataFrame([(*a, p) for a, p in t.items()], [*[f"n{j}" for j in label], "p"]), sum_product(), [f"n{j}" for j in label], ["p"], unique=True) for label, t in tables]
    asked = [Conditional.of([("n36", 0)], [("n0", 1)]), Conditional.of([("n20", 1), ("n5", 0)]), Conditional.of([("n36", 1)], [("n0", 1)])]
    expected = []
    for q in asked:
        at = {int(k[1:]): v for k, v in {**q.conditioned, **q.conditional}.items()}
        joint, label = plain_joint(states, tables, set(at)), tuple(sorted(at))
        given = {int(k[1:]): v for k, v in q.conditional.items()}
        holds = lambda a, some: all(dict(zip(label, a))[k] == v for k, v in some.items())  # noqa: B023, E731
        expected.append(sum(p for a, p in joint.items() if holds(a, at)) / sum(p for a, p in joint.items() if holds(a, given)))
    frames = {f"n{i}": n for i, n in enumerate(states)}
    domains = list(dict.fromkeys(q.domain for q in asked))
    for mode in (Mode.FUSION, Mode.MESSAGES):
        assert probabilities(factors, asked, mode, frames) == pytest.approx(expected)
    found = queries(factors, domains, Mode.MESSAGES, frames=frames, threads=4, binary=False)
    for d, f in zip(domains, found):
        label = sorted(int(v[1:]) for v in d)
        joint = plain_joint(states, tables, set(label))
        got = {tuple(r[f"n{i}"] for i in label): r["__value"] for r in f.df.collect()}
        assert got == pytest.approx(joint)
