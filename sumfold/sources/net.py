"""Bayesian networks in ``.net`` files: nodes with their states, and a table for each.

A table lists its parents' states in the order of the parents, the first one varying slowest and the node
itself fastest. Numbers have a point or an exponent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sumfold.functions.semiring import Semiring, sum_product
from sumfold.operators.factor import Factor

_TOKEN = re.compile(r'"[^"]*"|[A-Za-z_][A-Za-z0-9_]*|-?(?:\d+\.\d*(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+)|[{}()=;|]')
_SKIP = re.compile(r"(?:\s+|--[^\n]*|\{-.*?-\})*", re.S)


class FormatError(ValueError):
    """The text is not of the format."""


@dataclass(frozen=True)
class Potential:
    child: str
    parents: tuple[str, ...]
    values: tuple[float, ...]


@dataclass(frozen=True)
class Network:
    states: dict[str, tuple[str, ...]]
    potentials: tuple[Potential, ...]

    def factors(self, spark: SparkSession, semiring: Semiring | None = None) -> list[Factor]:
        s = semiring or sum_product()
        return [Factor.from_lists(spark, s, [(v, self.states[v]) for v in (*p.parents, p.child)], p.values) for p in self.potentials]

    def frames(self) -> dict[str, int]:
        return {v: len(x) for v, x in self.states.items()}


def _tokens(text: str) -> list[str]:
    out, at = [], _SKIP.match(text).end()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormatError(f"unexpected {text[at : at + 20]!r}")
        out.append(m[0])
        at = _SKIP.match(text, m.end()).end()
    return out


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, *expected: str) -> str:
        token = self.peek()
        if not token or expected and token not in expected:
            raise FormatError(f"{' or '.join(expected) or 'more'} expected, not {token or 'the end'}")
        self.at += 1
        return token

    def all(self, *expected: str) -> None:
        for x in expected:
            self.next(x)

    def until(self, stop: str) -> list[str]:
        out = []
        while self.peek() != stop:
            out.append(self.next())
        self.next(stop)
        return out


def parse(text: str) -> Network:
    r = _Reader(_tokens(text))
    r.all("net", "{", "}")
    states: dict[str, tuple[str, ...]] = {}
    potentials = []
    while r.peek():
        if r.next("node", "potential") == "node":
            name = r.next()
            r.all("{", "states", "=", "(")
            states[name] = tuple(x.strip('"') for x in r.until(")"))
            r.all(";", "}")
        else:
            r.next("(")
            child = r.next()
            parents = tuple(r.until(")")) if r.next("|", ")") == "|" else ()
            r.all("{", "data", "=")
            data, depth = [], 0
            while r.peek() != ";":
                token = r.next()
                depth += {"(": 1, ")": -1}.get(token, 0)
                if token not in "()":
                    data.append(float(token))
            if depth:
                raise FormatError(f"brackets in the table of {child} do not match")
            r.all(";", "}")
            potentials.append(Potential(child, parents, tuple(data)))
    return Network(states, tuple(potentials))


def read(spark: SparkSession, path: str) -> Network:
    """The network in one file, wherever Spark can read it."""
    return parse(spark.read.text(path, wholetext=True).first()[0])
