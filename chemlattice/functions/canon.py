"""Canonical forms of many small labelled graphs at once.

All graphs of a batch stand in one set of numpy arrays. Colours are refined
by hashing each vertex with the multiset of its neighbours' colours; the
remaining ties are broken one at a time, each followed by a new refinement.

``certificate`` is a 128-bit digest of the whole graph as numbered by the
final colours. Equal certificates mean isomorphic graphs (up to a collision
of 128 bits). Isomorphic graphs get equal certificates whenever the vertices
that refinement leaves tied are images of each other, which holds for nearly
every molecule; for the rest ``colour_hash``, equal for all isomorphic
graphs, and the exact test :func:`isomorphic` decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 step)."""
    with np.errstate(over="ignore"):
        x = (x + _A).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class GraphBatch:
    """Graphs given as (vertex labels, edge begins, edge ends[, edge labels]) each."""

    def __init__(self, graphs: Sequence[tuple]) -> None:
        self.count = len(graphs)
        self.sizes = np.fromiter((len(g[0]) for g in graphs), np.int64, self.count)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n_edges = np.fromiter((len(g[1]) for g in graphs), np.int64, self.count)
        self.n_edges = n_edges
        self.label = np.fromiter((x for g in graphs for x in g[0]), np.int64, int(self.first[-1])).astype(np.uint64)
        total = int(n_edges.sum())
        shift = np.repeat(self.first[:-1], n_edges)
        self.begin = np.fromiter((x for g in graphs for x in g[1]), np.int64, total) + shift
        self.end = np.fromiter((x for g in graphs for x in g[2]), np.int64, total) + shift
        self.kind = np.fromiter((x for g in graphs for x in g[3]), np.int64, total) if graphs and len(graphs[0]) > 3 else np.zeros(total, np.int64)
        self.graph = np.repeat(np.arange(self.count), self.sizes)
        self.edge_graph = np.repeat(np.arange(self.count), n_edges)

    @classmethod
    def flat(cls, sizes: np.ndarray, label: np.ndarray, n_edges: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> GraphBatch:
        """The same from arrays of all graphs; the edges' ends are numbered through."""
        out = object.__new__(cls)
        out.count, out.sizes, out.n_edges = len(sizes), sizes, n_edges
        out.first = np.concatenate([[0], np.cumsum(sizes)])
        out.label, out.begin, out.end, out.kind = label.astype(np.uint64), begin, end, kind
        out.graph, out.edge_graph = np.repeat(np.arange(out.count), sizes), np.repeat(np.arange(out.count), n_edges)
        return out

    def take(self, which: np.ndarray) -> GraphBatch:
        """Some of the graphs, each as often as it is named."""
        out = object.__new__(GraphBatch)
        out.count, out.sizes, out.n_edges = len(which), self.sizes[which], self.n_edges[which]
        out.first = np.concatenate([[0], np.cumsum(out.sizes)])
        edges = np.concatenate([[0], np.cumsum(self.n_edges)])
        v, e = ranges(self.first[which], out.sizes), ranges(edges[which], out.n_edges)
        shift = np.repeat(out.first[:-1] - self.first[which], out.n_edges)
        out.label, out.begin, out.end, out.kind = self.label[v], self.begin[e] + shift, self.end[e] + shift, self.kind[e]
        out.graph, out.edge_graph = np.repeat(np.arange(out.count), out.sizes), np.repeat(np.arange(out.count), out.n_edges)
        return out

    def components(self) -> tuple[GraphBatch, np.ndarray, np.ndarray]:
        """The connected components as graphs, the graph of each, and the vertices in their order."""
        root = np.arange(len(self.label))
        while True:
            low = np.minimum(root[self.begin], root[self.end])
            new = root.copy()
            np.minimum.at(new, root[self.begin], low)
            np.minimum.at(new, root[self.end], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        order = np.argsort(root, kind="stable")
        place = np.argsort(order)
        roots, number, sizes = np.unique(root, return_inverse=True, return_counts=True)
        own = number[self.begin] if len(self.begin) else np.zeros(0, np.int64)
        e = np.argsort(own, kind="stable")
        out = object.__new__(GraphBatch)
        out.count, out.sizes, out.n_edges = len(roots), sizes, np.bincount(own, minlength=len(roots))
        out.first = np.concatenate([[0], np.cumsum(sizes)])
        out.label, out.begin, out.end, out.kind = self.label[order], place[self.begin[e]], place[self.end[e]], self.kind[e]
        out.graph, out.edge_graph = number[order], own[e]
        return out, self.graph[roots], order


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)


def _order(graph: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Order by graph, then colour, by one key: the graph's number over as many high bits of the colour as there is room for."""
    bits = np.uint64(int(graph[-1]).bit_length() if len(graph) else 0)
    if not bits:
        return np.argsort(colour)
    return np.argsort((graph.astype(np.uint64) << (np.uint64(64) - bits)) | (colour >> bits))


class _Part:
    """Directed edges of some of the graphs, in order of their targets, with a loop at each vertex."""

    def __init__(self, b: GraphBatch, keep: np.ndarray | None) -> None:
        vertices = np.arange(len(b.label)) if keep is None else np.flatnonzero(keep[b.graph])
        place = np.full(len(b.label), -1, np.int64)
        place[vertices] = np.arange(len(vertices))
        e = slice(None) if keep is None else np.flatnonzero(keep[b.edge_graph])
        u, v, k = place[b.begin[e]], place[b.end[e]], b.kind[e]
        own = np.arange(len(vertices))
        source, target = np.concatenate([u, v, own]), np.concatenate([v, u, own])
        kind = np.concatenate([k + 1, k + 1, np.zeros(len(own), np.int64)])
        order = np.argsort(target, kind="stable")
        self.vertices, self.source = vertices, source[order]
        self.kind = mix(kind[order].astype(np.uint64))
        self.start = np.searchsorted(target[order], own)
        self.graph = b.graph[vertices]

    def step(self, colour: np.ndarray) -> np.ndarray:
        if not len(colour):
            return colour
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(mix(colour[self.source] ^ self.kind), self.start) ^ (colour << np.uint64(1)))

    def restrict(self, keep: np.ndarray) -> _Part:
        """The part that has only some of the vertices, whole graphs of them."""
        out = object.__new__(_Part)
        length = np.diff(np.append(self.start, len(self.source)))
        edge = np.repeat(keep, length)
        out.vertices, out.graph = self.vertices[keep], self.graph[keep]
        out.source, out.kind = (np.cumsum(keep) - 1)[self.source[edge]], self.kind[edge]
        out.start = np.cumsum(length[keep]) - length[keep]
        return out

    def refine(self, colour: np.ndarray, every: int = 4) -> np.ndarray:
        """Steps until a graph gets no more colours; how many that are depends on this graph alone."""
        colour = colour.copy()
        part, at = self, np.arange(len(colour))
        before = np.zeros(int(self.graph[-1]) + 1 if len(at) else 0, np.int64)
        while len(at):
            c = colour[at]
            for _ in range(every):
                c = part.step(c)
            colour[at] = c
            order, _ = part.classes(c)
            g, c = part.graph[order], c[order]
            new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
            now = np.bincount(g[new], minlength=len(before))
            keep = (now > before)[part.graph]
            before = now
            if not keep.all():
                part, at = part.restrict(keep), at[keep]
        return colour

    def classes(self, colour: np.ndarray) -> tuple[np.ndarray, int]:
        """Order by (graph, colour), and the number of classes."""
        order = _order(self.graph, colour)
        g, c = self.graph[order], colour[order]
        return order, int(1 + np.count_nonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1]))) if len(c) else 0


def refine(b: GraphBatch, rounds: int | None = None) -> np.ndarray:
    """Stable colours of all vertices, or those after ``rounds`` steps; they do not depend on vertex order."""
    part, colour = _Part(b, None), mix(b.label)
    if rounds is None:
        return part.refine(colour)
    for _ in range(rounds):
        colour = part.step(colour)
    return colour


def _sum_by_graph(b: GraphBatch, values: np.ndarray, graph: np.ndarray) -> np.ndarray:
    out = np.zeros(b.count, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, graph, values)
    return out


def colour_hash(b: GraphBatch, colour: np.ndarray) -> np.ndarray:
    """64 bits for each graph, equal for isomorphic graphs."""
    h = _sum_by_graph(b, mix(colour), b.graph)
    return mix(h ^ mix(b.sizes.astype(np.uint64) * np.uint64(1 << 20) + b.n_edges.astype(np.uint64)))


def discrete(b: GraphBatch, colour: np.ndarray) -> np.ndarray:
    """Colours of which no two vertices of a graph have the same."""
    colour = colour.copy()
    keep = np.ones(b.count, bool)
    rest: np.ndarray | None = None
    while True:
        part = _Part(b, rest)
        c = colour[part.vertices]
        order, _ = part.classes(c)
        g, s = part.graph[order], c[order]
        tie = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) if len(g) else np.zeros(0, bool)
        if not tie.any():
            return colour
        at = np.flatnonzero(tie)
        graphs, first = np.unique(g[at], return_index=True)  # the smallest tied colour of each graph
        chosen = order[at[first]]
        keep = np.zeros(b.count, bool)
        keep[graphs] = True
        if not keep[part.graph].all():
            small = _Part(b, keep)
            chosen = np.searchsorted(small.vertices, part.vertices[chosen])
            part, c = small, colour[small.vertices]
        c = c.copy()
        with np.errstate(over="ignore"):
            c[chosen] = mix(c[chosen] + np.uint64(1))
        colour[part.vertices] = part.refine(c)
        rest = keep


def certificates(b: GraphBatch, colour: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each graph (see the module text)."""
    final = discrete(b, colour)
    order = _order(b.graph, final)
    rank = np.empty(len(final), np.int64)
    rank[order] = np.arange(len(final)) - b.first[b.graph[order]]
    out = np.empty((b.count, 2), np.uint64)
    lo, hi = np.minimum(rank[b.begin], rank[b.end]), np.maximum(rank[b.begin], rank[b.end])
    with np.errstate(over="ignore"):
        for i, salt in enumerate((np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))):
            v = mix(mix(rank.astype(np.uint64) ^ salt) + b.label)
            e = mix(mix((lo * 65536 + hi).astype(np.uint64) + salt) ^ mix(b.kind.astype(np.uint64) + np.uint64(7)))
            h = _sum_by_graph(b, v, b.graph) + mix(_sum_by_graph(b, e, b.edge_graph) ^ salt)
            out[:, i] = mix(h + b.sizes.astype(np.uint64) * salt)
    return out


def _numbered(b: GraphBatch, colour: np.ndarray) -> np.ndarray:
    order = np.lexsort((colour, b.graph))
    rank = np.empty(len(colour), np.int64)
    rank[order] = np.arange(len(colour)) - b.first[b.graph[order]]
    return rank


def _twins(b: GraphBatch, member: np.ndarray) -> np.ndarray:
    """For each graph, whether its ``member`` vertices all hang on one vertex by their only edge; such are images of each other."""
    degree = np.bincount(b.begin, minlength=len(b.label)) + np.bincount(b.end, minlength=len(b.label))
    beside = np.zeros(len(b.label), np.int64)
    beside[b.begin], beside[b.end] = b.end, b.begin
    hold = np.full(b.count, -1, np.int64)
    hold[b.graph[member]] = beside[member]
    out = np.ones(b.count, bool)
    out[b.graph[member[(degree[member] != 1) | (beside[member] != hold[b.graph[member]])]]] = False
    return out


def _least(b: GraphBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vertex numbers of the numbering with the smallest certificate, and that certificate, of each graph.

    Every vertex of a tied class is tried, level by level. Of those that lead to equal certificates, which are images of
    each other, one is followed.
    """
    rank, best = np.empty(len(b.label), np.int64), np.full((b.count, 2), np.iinfo(np.uint64).max, np.uint64)
    which, q, colour = np.arange(b.count), b, refine(b)
    while q.count:
        order = np.lexsort((colour, q.graph))
        g, s = q.graph[order], colour[order]
        at = np.flatnonzero((g[1:] == g[:-1]) & (s[1:] == s[:-1]))
        tied, first = np.unique(g[at], return_index=True)
        is_tied = np.zeros(q.count, bool)
        is_tied[tied] = True
        leaf = np.flatnonzero(~is_tied)
        if len(leaf):
            done = q.take(leaf)
            held = colour[ranges(q.first[leaf], q.sizes[leaf])]
            digest, number = certificates(done, held), _numbered(done, held)
            for i, w in enumerate(which[leaf].tolist()):
                if tuple(digest[i].tolist()) <= tuple(best[w].tolist()):
                    best[w] = digest[i]
                    rank[b.first[w] : b.first[w + 1]] = number[done.first[i] : done.first[i + 1]]
        target = np.zeros(q.count, np.uint64)
        target[tied] = s[at[first]]
        member = np.flatnonzero(is_tied[q.graph] & (colour == target[q.graph]))
        one = np.append(True, q.graph[member][1:] != q.graph[member][:-1])[: len(member)]
        member = member[one | ~_twins(q, member)[q.graph[member]]]
        node = q.graph[member]
        child = q.take(node)
        c = colour[ranges(q.first[node], q.sizes[node])]
        chosen = child.first[:-1] + member - q.first[node]
        with np.errstate(over="ignore"):
            c[chosen] = mix(c[chosen] + np.uint64(1))
        c = _Part(child, None).refine(c)
        keep = np.bincount(node, minlength=q.count)[node] == 1
        several = np.flatnonzero(~keep)
        if len(several):
            digest = certificates(child.take(several), c[ranges(child.first[several], child.sizes[several])])
            o = np.lexsort((digest[:, 1], digest[:, 0], node[several]))
            n, d = node[several][o], digest[o]
            keep[several[o[np.append(True, (n[1:] != n[:-1]) | (d[1:] != d[:-1]).any(axis=1))]]] = True
        kept = np.flatnonzero(keep)
        which, q, colour = which[node[kept]], child.take(kept), c[ranges(child.first[kept], child.sizes[kept])]
    return rank, best


def _copies(b: GraphBatch, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which graphs are plain, and the vertices to be set apart in those, by stable colours.

    The classes of more than one vertex of a graph are joined where they are bound to each other by a matching: each
    vertex of one to its own vertex of the other. In a plain graph such groups are trees of classes, so a group is a number of
    equal copies, and all other bonds lead to all of its copies or to none, but for one class that may be matched within
    itself. Then the copies of each group can be exchanged at will (with a matching in pairs), whatever is done in other
    groups: vertices of one class are images of each other, and a vertex of each group may be set apart at once.
    """
    order = _order(b.graph, colour)
    g, s = b.graph[order], colour[order]
    new = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]))[: len(g)]
    number = np.cumsum(new) - 1
    cell = np.empty(len(g), np.int64)
    cell[order] = number
    size, own = np.bincount(number), g[new]
    plain = np.ones(b.count, bool)
    n = len(size)
    low, high = np.minimum(b.begin, b.end), np.maximum(b.begin, b.end)
    plain[b.edge_graph[low == high]] = False
    pair = np.argsort(low * len(b.label) + high, kind="stable")
    twice = (low[pair][1:] == low[pair][:-1]) & (high[pair][1:] == high[pair][:-1])
    plain[b.edge_graph[pair[1:][twice]]] = False
    x, y = cell[b.begin], cell[b.end]
    e = (size[x] > 1) & (size[y] > 1)
    x, y, k = np.minimum(x, y)[e], np.maximum(x, y)[e], b.kind[e]
    o = np.lexsort((k, y, x))
    x, y, k = x[o], y[o], k[o]
    first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    mixed = ~first[1:] & (k[1:] != k[:-1])
    plain[own[x[1:][mixed]]] = False
    at = np.flatnonzero(first)
    bonds = np.diff(np.append(at, len(x)))
    x, y = x[at], y[at]
    within, whole = x == y, bonds == size[x] * size[y]
    matched = np.where(within, 2 * bonds == size[x], (bonds == size[x]) & (size[x] == size[y]))
    plain[own[x[~matched & (within | ~whole)]]] = False
    tie = ~within & ~whole
    u, v = x[tie], y[tie]
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        to = root.copy()
        np.minimum.at(to, root[u], least)
        np.minimum.at(to, root[v], least)
        to = to[to]
        if (to == root).all():
            break
        root = to
    cells, ties = np.bincount(root, minlength=n), np.bincount(root[u], minlength=n)
    odd = np.bincount(root[x[within & (size[x] > 2)]], minlength=n)
    plain[own[(cells > 0) & ((ties != cells - 1) | (odd > 1))]] = False
    # The least class of a group is its root, as classes are numbered in the order of their colours.
    return plain, order[np.flatnonzero(new)[(root == np.arange(n)) & (size > 1) & plain[own]]]


def _plainly(b: GraphBatch) -> tuple[np.ndarray, np.ndarray]:
    """Colours by which the vertices of the plain graphs (see ``_copies``) are numbered, and which graphs are so."""
    colour = refine(b)
    plain, chosen = _copies(b, colour)
    while len(chosen):
        with np.errstate(over="ignore"):
            colour[chosen] = mix(colour[chosen] + np.uint64(1))
        which = np.unique(b.graph[chosen])
        q = b.take(which)
        v = ranges(b.first[which], q.sizes)
        colour[v] = c = _Part(q, None).refine(colour[v])
        chosen = v[_copies(q, c)[1]]
    return colour, plain


_AT_ONCE = 500  # components whose tied vertices are tried together


def ranks(b: GraphBatch) -> list[np.ndarray]:
    """A canonical numbering of each graph's vertices: isomorphic graphs become equal under it."""
    parts, graph, vertices = b.components()
    digest = np.zeros((parts.count, 2), np.uint64)
    colour, plain = _plainly(parts)
    rank = _numbered(parts, colour)
    several = np.flatnonzero(plain & (np.bincount(graph, minlength=b.count) > 1)[graph])  # only such need to be put in order
    if len(several):
        q = parts.take(several)
        digest[several] = certificates(q, colour[ranges(parts.first[several], q.sizes)])
    rest = np.flatnonzero(~plain)
    for lo in range(0, len(rest), _AT_ONCE):
        some = rest[lo : lo + _AT_ONCE]
        q = parts.take(some)
        rank[ranges(parts.first[some], q.sizes)], digest[some] = _least(q)
    order = np.lexsort((digest[:, 1], digest[:, 0], parts.sizes, graph))
    before = np.empty(parts.count, np.int64)
    before[order] = np.cumsum(parts.sizes[order]) - parts.sizes[order]
    out = np.empty(len(rank), np.int64)
    out[vertices] = rank + before[parts.graph] - b.first[b.graph[vertices]]
    return np.split(out, b.first[1:-1])


def isomorphic(a: tuple, b: tuple) -> bool:
    """Exact test of two labelled graphs (labels, begins, ends[, edge labels])."""
    if len(a[0]) != len(b[0]) or len(a[1]) != len(b[1]) or Counter(a[0]) != Counter(b[0]):
        return False
    batch = GraphBatch([a, b])
    colour = refine(batch)
    n = len(a[0])
    ca, cb = colour[:n].tolist(), colour[n:].tolist()
    if Counter(ca) != Counter(cb):
        return False

    def adjacency(g: tuple) -> list[dict[int, int]]:
        out: list[dict[int, int]] = [{} for _ in g[0]]
        for i, (u, v) in enumerate(zip(g[1], g[2])):
            out[u][v] = out[v][u] = g[3][i] if len(g) > 3 else 0
        return out

    x, y = adjacency(a), adjacency(b)
    size = Counter(ca)
    order: list[int] = []
    seen: set[int] = set()
    for root in sorted(range(n), key=lambda v: size[ca[v]]):  # connected order, rare colours first
        todo = [root] if root not in seen else []
        while todo:
            v = min(todo, key=lambda w: size[ca[w]])
            todo.remove(v)
            if v in seen:
                continue
            seen.add(v)
            order.append(v)
            todo += [w for w in x[v] if w not in seen and w not in todo]
    by: dict[int, list[int]] = {}
    for v, c in enumerate(cb):
        by.setdefault(c, []).append(v)
    to: dict[int, int] = {}
    used: set[int] = set()
    choices: list[list[int]] = []

    def candidates(v: int) -> list[int]:
        done = [w for w in x[v] if w in to]
        base = y[to[done[0]]] if done else by[ca[v]]
        return [t for t in base if t not in used and cb[t] == ca[v] and all(y[t].get(to[w]) == x[v][w] for w in done)]

    if not n:
        return True
    choices.append(candidates(order[0]))
    while choices:
        v = order[len(choices) - 1]
        if v in to:
            used.discard(to.pop(v))
        if not choices[-1]:
            choices.pop()
            continue
        t = choices[-1].pop()
        to[v] = t
        used.add(t)
        if len(choices) == n:
            return True
        choices.append(candidates(order[len(choices)]))
    return False
