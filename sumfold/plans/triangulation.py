"""Chordal completions of small graphs of variables."""

from __future__ import annotations

from collections.abc import Iterable

from sumfold.operators.graph import UndirectedGraph


def triangulated(graph: UndirectedGraph, order: Iterable | None = None) -> tuple[UndirectedGraph, list[frozenset]]:
    """The graph with chords added by eliminating vertices in ``order`` (theirs by default), and its maximal cliques."""
    filled, rest, cliques = graph.copy(), graph.copy(), []
    for v in list(order) if order is not None else sorted(graph.vertices()):
        near = sorted(rest.near[v])
        for i, a in enumerate(near):
            for b in near[i + 1 :]:
                if b not in rest.near[a]:
                    rest.add_edge(a, b)
                    filled.add_edge(a, b)
        cliques.append(frozenset([v, *near]))
        rest.remove_vertex(v)
    return filled, [c for c in cliques if not any(c < d for d in cliques)]


def simplicial(graph: UndirectedGraph):
    """A vertex whose neighbours are all neighbours of each other, or None."""
    return next((v for v in sorted(graph.vertices()) if graph.induced(graph.near[v]).is_complete()), None)


def is_triangulated(graph: UndirectedGraph) -> bool:
    rest = graph.copy()
    while rest.vertices():
        v = simplicial(rest)
        if v is None:
            return False
        rest.remove_vertex(v)
    return True
