"""Labelled graphs: molecules as vertices and bonds, chains contracted, text form, and subgraph matching.

A graph is ``(labels, begins, ends, bond labels)``. The reduced form keeps
vertices of degree above two as vertices and turns chains between them into
edges with a path; an edge to 0 is a chain that ends freely.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

from chemlattice.functions.smiles import SINGLE, Molecule, labels, parse

Graph = tuple[list[int], list[int], list[int], list[int]]

# Fixed value: labels from here on are bonds.
FIRST_BOND_LABEL = 200


def regular_graph(m: Molecule) -> Graph:
    return labels(m), list(m.begin), list(m.end), list(m.bond)


def graph_of(smiles: str | None) -> Graph | None:
    m = parse(smiles)
    return regular_graph(m) if m else None


def adjacency(g: Graph) -> list[dict[int, int]]:
    out: list[dict[int, int]] = [{} for _ in g[0]]
    for a, b, k in zip(g[1], g[2], g[3]):
        out[a][b] = out[b][a] = k
    return out


# Reduced form


def reduced_graph(g: Graph) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Kept vertices' labels and edges (source, target or 0, path), numbered from 1, for every component.

    A path holds the labels of the chain's atoms, with the labels of bonds other than single ones between them. A
    component without a vertex of degree above two keeps its first end, or in a ring its first atom.
    """
    near = adjacency(g)
    n = len(g[0])
    kept = [v for v in range(n) if len(near[v]) > 2]
    seen = [False] * n
    for root in range(n):  # components without a branching
        if seen[root]:
            continue
        part, todo = [], [root]
        seen[root] = True
        while todo:
            v = todo.pop()
            part.append(v)
            for w in near[v]:
                if not seen[w]:
                    seen[w] = True
                    todo.append(w)
        if not any(len(near[v]) > 2 for v in part):
            part.sort()
            kept.append(next((v for v in part if len(near[v]) < 2), part[0]))
    kept.sort()
    place = {v: i + 1 for i, v in enumerate(kept)}
    edges: list[tuple[int, int, list[int]]] = []
    used: set[tuple[int, int]] = set()
    for v in kept:
        for w in near[v]:
            if (v, w) in used:
                continue
            used.add((v, w))
            path: list[int] = []
            last, at = v, w
            while True:
                if near[last][at] != SINGLE:
                    path.append(near[last][at])
                if at in place:
                    used.add((at, last))
                    edges.append((place[v], place[at], path))
                    break
                path.append(g[0][at])
                ahead = [x for x in near[at] if x != last]
                if not ahead:
                    edges.append((place[v], 0, path))
                    break
                last, at = at, ahead[0]
    return [g[0][v] for v in kept], edges


def expand(vertices: list[int], edges: list[tuple[int, int, list[int]]]) -> Graph:
    """The regular graph of a reduced one: the inverse of ``reduced_graph`` up to numbering."""
    label, begin, end, bond = list(vertices), [], [], []
    for source, target, path in edges:
        last, kind = source - 1, SINGLE
        for x in path:
            if x >= FIRST_BOND_LABEL:
                kind = x
                continue
            label.append(x)
            begin.append(last)
            end.append(len(label) - 1)
            bond.append(kind)
            last, kind = len(label) - 1, SINGLE
        if target:
            begin.append(last)
            end.append(target - 1)
            bond.append(kind)
    return label, begin, end, bond


# Text form


def to_text(vertices: list[int], edges: list[tuple[int, int, list[int]]]) -> str:
    v = ",".join("{%d}" % x for x in vertices)
    e = ",".join("{%d,%d,[%s]}" % (a, b, ",".join(map(str, p))) for a, b, p in edges)
    return "{[%s],[%s]}" % (v, e)


_TEXT = re.compile(r"\{\[(\{\d+\}(?:,\{\d+\})*)?\],\[((?:\{\d+,\d+,\[[\d,]*\]\})(?:,\{\d+,\d+,\[[\d,]*\]\})*)?\]\}")


def from_text(text: str) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Reads the text form; raises ``ValueError`` on anything else. An empty path is a single bond."""
    m = _TEXT.fullmatch(re.sub(r"\s+", "", text or ""))
    if m is None:
        raise ValueError(f"no graph text: {text!r}")
    vertices = [int(x) for x in re.findall(r"\d+", m.group(1) or "")]
    edges = [(a, b, p) for a, b, p in json.loads("[" + (m.group(2) or "").replace("{", "[").replace("}", "]") + "]")]
    if any(not 0 < a <= len(vertices) or b > len(vertices) for a, b, _ in edges):
        raise ValueError("an edge names a vertex that isn't there")
    return vertices, edges


# Matching


class Pattern:
    """A query graph with its search order worked out once."""

    def __init__(self, g: Graph) -> None:
        self.labels, self.near = g[0], adjacency(g)
        count: dict[int, int] = defaultdict(int)
        for x in g[0]:
            count[x] += 1
        self.count = dict(count)
        order: list[int] = []
        left = set(range(len(g[0])))
        border: set[int] = set()
        while left:  # connected where possible; vertices with many bonds first
            v = min(border or left, key=lambda x: (-sum(w in order for w in self.near[x]), -len(self.near[x]), x))
            order.append(v)
            left.discard(v)
            border = (border | self.near[v].keys()) & left
        self.order = order
        at = {v: i for i, v in enumerate(order)}
        self.before = [[(w, k) for w, k in self.near[v].items() if at[w] < at[v]] for v in order]

    def matches(self, g: Graph, induced: bool = False, anchor: tuple[int, int] | None = None, blocked: frozenset[int] = frozenset()) -> bool:
        """Whether the pattern occurs in ``g``: labels and bonds equal, vertices different.

        ``induced`` also forbids bonds in ``g`` between matched vertices that the pattern lacks. ``anchor`` fixes the
        image of one vertex; ``blocked`` vertices of ``g`` are not used.
        """
        return next(self.mappings(g, induced, anchor, blocked), None) is not None

    def mappings(self, g: Graph, induced: bool = False, anchor: tuple[int, int] | None = None, blocked: frozenset[int] = frozenset()):
        label, near = g[0], adjacency(g)
        by: dict[int, list[int]] = defaultdict(list)
        for v, x in enumerate(label):
            by[x].append(v)
        if any(len(by[x]) < n for x, n in self.count.items()):
            return
        to: dict[int, int] = {}
        used: set[int] = set(blocked)

        def candidates(i: int) -> list[int]:
            v = self.order[i]
            held = self.before[i]
            base = near[to[held[0][0]]] if held else by[self.labels[v]]
            out = []
            for t in base:
                if t in used or label[t] != self.labels[v] or len(near[t]) < len(self.near[v]) or (anchor and anchor[0] == v and anchor[1] != t):
                    continue
                if any(near[t].get(to[w]) != k for w, k in held):
                    continue
                if induced and sum(to[w] in near[t] for w in to) != len(held):
                    continue
                out.append(t)
            return out

        n = len(self.order)
        if not n:
            yield {}
            return
        stack = [candidates(0)]
        while stack:
            v = self.order[len(stack) - 1]
            if v in to:
                used.discard(to.pop(v))
            if not stack[-1]:
                stack.pop()
                continue
            t = stack[-1].pop()
            to[v] = t
            used.add(t)
            if len(stack) == n:
                yield dict(to)
            else:
                stack.append(candidates(len(stack)))


def is_subgraph(query: Graph, target: Graph, induced: bool = False) -> bool:
    """An empty query is in everything; nothing but that is in an empty target."""
    return Pattern(query).matches(target, induced)
