"""Answers to projection queries over many factors, without their full join.

``query`` and ``queries`` take factors and sets of variables; the answer to a set is the product of
all factors projected to it. Every mode gives the same answer, components that share no variable with
the query included:

* BRUTE_FORCE multiplies everything and projects once;
* FUSION eliminates one variable after another, each right after the product of the factors that mention it;
* MESSAGES passes messages on a binary join tree; each is computed once, however many queries need it.

Plans are built lazily: nothing runs until an answer's DataFrame is acted on, except that the
results of long eliminations are settled now and then, to keep plans short. With ``threads`` messages are computed
right away, each once, as a table that all that need it read; those that do not wait for each other at the same time.
``queries_with_stats`` computes the answers and returns what was measured meanwhile.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from sumfold.functions.scratch import settled
from sumfold.operators.closed import ClosedSystem, extended
from sumfold.operators.factor import COUNTERS, Factor, combine_all
from sumfold.plans.elimination import EliminationOrder
from sumfold.plans.jointree import JoinForest, Stats
from sumfold.plans.measures import Recorder, active, recording

#: Products and projections in one plan before its result is settled.
SETTLE_AFTER = 24


class UnanswerableQuery(ValueError):
    """A query asks for a variable that no factor has."""


class EmptyQuery(ValueError):
    """A query asks for no variable."""


class Mode(Enum):
    BRUTE_FORCE = "brute force"
    FUSION = "fusion"
    MESSAGES = "messages"


def is_covered(factors: Sequence[Any], domain: Collection[str]) -> bool:
    return set(domain) <= set().union(*[f.label for f in factors])


def queries(factors: Sequence[Any], domains: Sequence[Collection[str]], mode: Mode = Mode.FUSION, evidence: Mapping[str, Any] | None = None, frames: Mapping[str, int] | None = None, threads: int = 0, sized: bool = False, binary: bool = True) -> list[Any]:
    """The answer to each of ``domains``.

    ``evidence`` fixes values of variables: factors are filtered before they are joined. ``threads``, for messages, is how many
    are computed at the same time. With ``sized`` plans go by the factors' rows and ``frames``, as ``Statistics.of`` finds them.
    Without ``binary`` messages pass over a forest whose nodes unite all that mention a variable at once.
    """
    factors = _ready(factors, domains, evidence)
    if not domains:
        return []
    if mode is Mode.BRUTE_FORCE:
        whole = combine_all(factors)
        return [whole.project(d) for d in domains]
    if mode is Mode.FUSION:
        return [fusion(factors, d, frames, sized) for d in domains]
    messages = Messages(factors, domains, frames, sized, binary)
    if threads:
        messages.compute(threads)
    return messages.answers()


def _ready(factors: Sequence[Any], domains: Sequence[Collection[str]], evidence: Mapping[str, Any] | None) -> list[Any]:
    """The factors that are not neutral, filtered; an error where a query has no answer."""
    if not all(is_covered(factors, d) for d in domains):
        raise UnanswerableQuery("no factor has a variable that is asked for")
    if not all(domains):
        raise EmptyQuery("a query needs a variable")
    factors = [f for f in factors if not f.is_identity]
    return [f.where(evidence) for f in factors] if evidence else factors


@dataclass(frozen=True)
class Run:
    """Answers with what was measured while they were computed.

    ``recorder`` has the rows of each operator and when each message was computed, ``combines`` and ``projects`` count operators,
    ``forest`` has the measures of the join forest (None by other modes).
    """

    answers: list[Any]
    recorder: Recorder
    combines: int
    projects: int
    forest: Stats | None


def queries_with_stats(factors: Sequence[Any], domains: Sequence[Collection[str]], mode: Mode = Mode.FUSION, evidence: Mapping[str, Any] | None = None, frames: Mapping[str, int] | None = None, threads: int = 4, sized: bool = False) -> Run:
    """The answers to ``domains``, computed now, and the measures of that run.

    Answers are tables; each operator's rows are counted as it runs, once, because what several answers need is a table too.
    """
    before, recorder = replace(COUNTERS), Recorder()
    factors = _ready(factors, domains, evidence)
    with recording(recorder):
        factors = [f.measured("factor") if isinstance(f, Factor) else f for f in factors]
        stats, found = None, []
        if not domains:
            pass
        elif mode is Mode.MESSAGES:
            messages = Messages(factors, domains, frames, sized)
            messages.compute(max(1, threads))
            stats, found = messages.forest.stats(frames), messages.answers()
        elif mode is Mode.BRUTE_FORCE:
            whole = combine_all(factors)
            whole = _settled(whole) if len(domains) > 1 else whole
            found = [whole.project(d) for d in domains]
        else:
            found = [fusion(_once(factors, i), d, frames, sized) for i, d in enumerate(domains)]
        answers = []
        for d, f in zip(domains, found):
            with recorder.timed("answer " + ",".join(sorted(d))):
                answers.append(_settled(f))
    recorder.finish()
    return Run(answers, recorder, COUNTERS.combines - before.combines, COUNTERS.projects - before.projects, stats)


def _once(factors: Sequence[Any], nth: int) -> list[Any]:
    """Factors for a further plan over the same tables: steps of their own, since one observation belongs to one action."""
    recorder = active()
    if nth == 0 or recorder is None:
        return list(factors)
    return [replace(f, step=None).measured("factor") if isinstance(f, Factor) else f for f in factors]


def query(factors: Sequence[Any], domain: Collection[str], mode: Mode = Mode.FUSION, evidence: Mapping[str, Any] | None = None, frames: Mapping[str, int] | None = None, sized: bool = False) -> Any:
    """The answer to one query."""
    return queries(factors, [domain], mode, evidence, frames, sized=sized)[0]


def fusion(factors: Sequence[Any], domain: Collection[str], frames: Mapping[str, int] | None = None, sized: bool = False) -> Any:
    """Eliminate all variables but those of ``domain``, the cheapest first."""
    held = [(f, 1) for f in factors]  # with the operators in each one's plan
    for variable in EliminationOrder([f.label for f in factors], domain, frames, [f.rows for f in factors] if sized else None):
        bucket = sorted((x for x in held if variable in x[0].label), key=lambda x: x[0].rows)
        held = [x for x in held if variable not in x[0].label]
        new = combine_all([f for f, _ in bucket]).eliminate([variable])
        depth = sum(n for _, n in bucket) + 1
        if depth > SETTLE_AFTER:
            new, depth = _settled(new), 1
        held.append((new, depth))
    # scalars, of components without the query's variables, are kept like any other factor
    return combine_all([f for f, _ in sorted(held, key=lambda x: x[0].rows)])


def _settled(f: Any) -> Any:
    return replace(f, df=settled(f.df)) if isinstance(f, Factor) else replace(f, m=f.m.settled(), b=settled(f.b))


class Messages:
    """Messages on a join tree: from s to r, what s and those behind it say about their common variables."""

    def __init__(self, factors: Sequence[Any], domains: Sequence[Collection[str]], frames: Mapping[str, int] | None = None, sized: bool = False, binary: bool = True):
        self.domains = [frozenset(d) for d in domains]
        self.forest = JoinForest.build(factors, list(dict.fromkeys(self.domains)), frames, sized, binary)
        self.neutral = replace(factors[0], **({"df": None, "label": frozenset()} if isinstance(factors[0], Factor) else {"m": None, "b": None}))
        self.sent: dict[tuple[int, int], Any] = {}
        self.depth: dict[tuple[int, int], int] = {}

    def message(self, s: int, r: int) -> Any:
        if (s, r) not in self.sent:
            for edge in self.forest.towards(r):  # those farther away first, so that no call goes deep
                if edge not in self.sent:
                    self._send(*edge)
        return self.sent[s, r]

    def _send(self, s: int, r: int, settle: bool = True) -> None:
        of, to = self.forest.nodes[s], self.forest.nodes[r]
        inward = [k for k in self.forest.neighbours(s) if k != r]
        product = self._product(s, inward)
        out = product if product.is_identity else product.project(of.domain & to.domain)
        # what is passed on as it came has no operator
        came = [of.factor, *[self.sent[k, s] for k in inward]]
        depth = 0 if any(out is f for f in came) and not any(self.depth[k, s] for k in inward) else 1 + sum(self.depth[k, s] for k in inward)
        if settle and depth > SETTLE_AFTER and not out.is_identity:
            out, depth = _settled(out), 1
        self.sent[s, r], self.depth[s, r] = out, depth

    def _product(self, i: int, inward: Sequence[int]) -> Any:
        own = self.forest.nodes[i].factor
        out = self.neutral if own is None else own
        for k in inward:
            out = out.combine(self.message(k, i))
        return out

    def belief(self, i: int) -> Any:
        """The product of a node's factor and all messages to it."""
        return self._product(i, self.forest.neighbours(i))

    def needed(self) -> list[tuple[int, int]]:
        """The messages that the answers take, each after those that it takes itself."""
        tops = [self.forest.query_node(d) for d in self.domains] + [t[-1] for t in self.forest.trees()]
        return list(dict.fromkeys(edge for top in dict.fromkeys(tops) for edge in self.forest.towards(top)))

    def compute(self, threads: int) -> None:
        """Compute all messages that are needed, each once, as a table; at the same time those that do not wait for each other."""
        todo = {(s, r): {(k, s) for k in self.forest.neighbours(s) if k != r} for s, r in self.needed() if (s, r) not in self.sent}
        recorder = active() or Recorder()
        some = next(n.factor for n in self.forest.nodes if n.factor is not None)
        session = (some.df if isinstance(some, Factor) else some.b).sparkSession

        def one(edge: tuple[int, int], out: Any) -> Any:
            # a pool of its own, which a fair scheduler gives its share
            session.sparkContext.setLocalProperty("spark.scheduler.pool", f"message {edge[0]}-{edge[1]}")
            with recorder.timed(f"message {edge[0]}-{edge[1]}"):
                return _settled(out)

        running: dict[Future, tuple[int, int]] = {}
        with ThreadPoolExecutor(threads) as pool:
            while todo or running:
                ready = [e for e, before in todo.items() if before <= self.sent.keys()]
                for s, r in ready:
                    del todo[s, r]
                    self._send(s, r, settle=False)
                    out = self.sent[s, r]
                    if not out.is_identity and self.depth[s, r]:
                        del self.sent[s, r]
                        running[pool.submit(inheritable_thread_target(session)(one), (s, r), out)] = (s, r)
                if running and not any(before <= self.sent.keys() for before in todo.values()):
                    for done in wait(running, return_when=FIRST_COMPLETED).done:
                        edge = running.pop(done)
                        self.sent[edge], self.depth[edge] = done.result(), 0

    def answers(self) -> list[Any]:
        out = []
        for d in self.domains:
            i = self.forest.query_node(d)
            answer = self.belief(i).project(d)
            here = self.forest.root(i)
            for tree in self.forest.trees():
                if self.forest.root(tree[0]) != here:
                    scalar = self.belief(tree[-1]).project(())
                    answer = answer.combine(scalar)
            out.append(answer)
        return out


def solve(systems: Sequence[ClosedSystem], wanted: Collection | None = None) -> DataFrame:
    """Values (row, payload) of all variables of the systems' sum: an inward pass, then extension node by node.

    Each node keeps its system and the messages from below; from the root down, a node's further
    variables follow from those already known, every node included.
    """
    return solve_with_stats(systems, wanted).answers[0]


def solve_with_stats(systems: Sequence[ClosedSystem], wanted: Collection | None = None) -> Run:
    """``solve``, with the measures of the run: operators, the join forest, and when each node was extended."""
    before, recorder = replace(COUNTERS), Recorder()
    systems = [s for s in systems if not s.is_identity]
    if not systems:
        raise UnanswerableQuery("there is no system with a variable")
    if wanted is not None and not is_covered(systems, wanted):
        raise UnanswerableQuery("no system has a variable that is asked for")
    messages = Messages(systems, [], None)
    forest, x, known = messages.forest, None, frozenset()
    for tree in forest.trees():
        for i in reversed(tree):
            node = messages._product(i, forest.nodes[i].children)
            if node.is_identity:
                continue
            if x is None:
                x = node.b.limit(0)
            if node.label <= known:
                continue
            with recorder.timed(f"node {i}"):
                x = settled(x.unionByName(extended(node, x, known)))
            known |= node.label
    return Run([x], recorder, COUNTERS.combines - before.combines, COUNTERS.projects - before.projects, forest.stats())
