"""Columns and fingerprints of many molecular graphs at once.

The graphs of a batch stand in one set of numpy arrays, and a pattern is grown atom by atom in all of them, as a table with
a row for each partial match. The bits are those of ``functions.fingerprints`` for one graph: bonds are those of
``graphs.adjacency`` (of parallel ones the last counts), and an occurrence is a set of atoms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

from chemlattice.functions.canon import GraphBatch, ranges, ranks
from chemlattice.functions.graphs import Graph, Pattern, graph_of
from chemlattice.functions.smiles import AROMATIC_LABEL, DOUBLE, MASS, QUADRUPLE, TRIPLE, VALENCES, Molecule

MOST_ROWS = 1_000_000  # partial matches that are held at once; beyond, the batch is halved
MOST_ATOMS = 8  # of a pattern that is grown in all graphs at once; a larger one could have very many partial matches
SYMMETRIC_ATOMS = 7  # of a pattern of which all symmetries are listed


class TooLarge(Exception):
    """Numbers of an atom beyond those that go into one array."""


class _TooMany(Exception):
    """More partial matches than are held at once."""


def _table(values: dict, rest: float, kind: type) -> np.ndarray:
    out = np.full(256, rest, kind)
    out[list(values)] = list(values.values())
    return out


_ORDER = _table({DOUBLE: 2, TRIPLE: 3, QUADRUPLE: 4}, 1, np.int64)
_VALENCES = np.stack([_table({z: v[i] for z, v in VALENCES.items() if i < len(v)}, 0 if i == 0 else -1, np.int64) for i in range(3)])
_MASS = _table(MASS, np.nan, np.float64)
_AROMATIC = np.arange(256)
_AROMATIC[list(AROMATIC_LABEL)] = list(AROMATIC_LABEL.values())
MOST = 1 << 29  # isotopes, hydrogens and charges beyond are left to plain Python


class FlatMolecules:
    """Molecules with their atoms numbered through, and what ``functions.smiles`` works out for one of them."""

    def __init__(self, molecules: Sequence[Molecule]) -> None:
        self.sizes, self.n_bonds = (np.fromiter((len(m[i]) for m in molecules), np.int64, len(molecules)) for i in (0, 5))
        try:
            z, aromatic, h, q, isotope, begin, end, bond = (np.array(list(chain.from_iterable(m[i] for m in molecules)), np.int64) for i in range(8))
        except OverflowError as e:
            raise TooLarge from e
        if any(len(x) and np.abs(x).max() >= MOST for x in (h, q, isotope)):
            raise TooLarge
        self.first, self.first_bond = (np.concatenate([[0], np.cumsum(x)]) for x in (self.sizes, self.n_bonds))
        shift = np.repeat(self.first[:-1], self.n_bonds)
        self.a, self.b, self.bond = begin, end, bond
        self.begin, self.end = begin + shift, end + shift
        ar = aromatic.astype(bool)
        order, n = _ORDER[bond], len(z)
        used = (np.bincount(self.begin, order, n) + np.bincount(self.end, order, n)).astype(np.int64) + ar
        free = used
        for v in _VALENCES[::-1]:
            free = np.where(v[z] >= used, v[z], free)
        free = np.where(ar & (z != 5) & (z != 6), np.maximum(used, _VALENCES[0][z]), free)
        self.hydrogens = np.where(h >= 0, h, np.maximum(0, free - used))
        self.labels = np.where(ar, _AROMATIC[z], z)
        self.identity = self.labels + 1000 * (self.hydrogens + 32 * (q + 64) + 8192 * isotope)
        mass = np.where(isotope != 0, isotope, _MASS[z]) + self.hydrogens * MASS[1]
        total = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), mass, len(self.sizes))
        self.weights = [None if x != x else round(x, 4) for x in total.tolist()]

    def canonical(self, identity: bool) -> list[str]:
        """``sources.molecules.canonical_key`` of each molecule."""
        label = self.identity if identity else self.labels
        rank = np.concatenate([*ranks(GraphBatch.flat(self.sizes, label, self.n_bonds, self.begin, self.end, self.bond)), np.zeros(0, np.int64)])
        by = np.empty_like(label)
        by[np.repeat(self.first[:-1], self.sizes) + rank] = label
        x, y = rank[self.begin], rank[self.end]
        x, y = np.minimum(x, y), np.maximum(x, y)
        o = np.lexsort((self.bond, y, x, np.repeat(np.arange(len(self.n_bonds)), self.n_bonds)))
        atoms, bonds = list(map(str, by.tolist())), [f"{i}-{j}:{k}" for i, j, k in zip(x[o].tolist(), y[o].tolist(), self.bond[o].tolist())]
        v, e = self.first.tolist(), self.first_bond.tolist()
        return [f"{'.'.join(atoms[v[i] : v[i + 1]])}|{','.join(bonds[e[i] : e[i + 1]])}" for i in range(len(self.sizes))]


class FlatGraphs:
    """Graphs with their atoms numbered through; ``source, target, kind`` are the bonds from both sides, in order, each pair of atoms once."""

    def __init__(self, sizes: np.ndarray, label: np.ndarray, n_bonds: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> None:
        self.count, self.sizes, self.n_bonds = len(sizes), sizes, n_bonds
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.label, self.own = label, (begin, end, kind)
        self.graph = np.repeat(np.arange(self.count), sizes)
        shift = np.repeat(self.first[:-1], n_bonds)
        a, b = begin + shift, end + shift
        self.n = max(1, len(label))
        key = np.stack([a * self.n + b, b * self.n + a], axis=1).ravel()  # both sides of a bond together, so that the last bond stays last
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.append(key[1:] != key[:-1], True)[: len(key)]
        self.key, self.kind = key[last], np.repeat(kind, 2)[order[last]]
        self.source, self.target = self.key // self.n, self.key % self.n
        self.start = np.searchsorted(self.source, np.arange(len(label) + 1))
        self.coded = all(not len(x) or (x.min() >= 0 and x.max() < 1024) for x in (label, kind))  # as all labels of molecules are
        self._by_code: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._cut: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, graphs: Sequence[Graph]) -> FlatGraphs:
        def joined(i: int) -> np.ndarray:
            return np.array([x for g in graphs for x in g[i]], np.int64)

        return cls(np.array([len(g[0]) for g in graphs], np.int64), joined(0), np.array([len(g[1]) for g in graphs], np.int64), joined(1), joined(2), joined(3))

    def part(self, lo: int, hi: int) -> FlatGraphs:
        v = slice(self.first[lo], self.first[hi])
        e = slice(int(self.n_bonds[:lo].sum()), int(self.n_bonds[:hi].sum()))
        return FlatGraphs(self.sizes[lo:hi], self.label[v], self.n_bonds[lo:hi], *(x[e] for x in self.own))

    def one(self, i: int) -> Graph:
        p = self.part(i, i + 1)
        return p.label.tolist(), *(x.tolist() for x in p.own)

    def edges(self, a: int, k: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Sources and targets of the bonds ``k`` from label ``a`` to label ``b``, in order."""
        at = (a, k, b)
        if at not in self._cut:
            if self._by_code is None:
                code = (self.label[self.source] * 1024 + self.label[self.target]) * 1024 + self.kind
                order = np.argsort(code, kind="stable")
                self._by_code = code[order], self.source[order], self.target[order]
            code, source, target = self._by_code
            c = (a * 1024 + b) * 1024 + k
            s = slice(np.searchsorted(code, c), np.searchsorted(code, c, "right"))
            self._cut[at] = source[s], target[s]
        return self._cut[at]

    def bound(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether there is a bond ``k`` from each of ``a`` to the one of ``b`` beside it."""
        if not len(self.key):
            return np.zeros(len(a), bool)
        want = a * self.n + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (self.key[at] == want) & (self.kind[at] == k)


class _Plan:
    """How a pattern is grown: its symmetries as conditions of order, so that of the matches that differ by one only one is kept."""

    def __init__(self, g: Graph) -> None:
        self.pattern = p = Pattern(g)
        self.labels, self.near, n = p.labels, p.near, len(p.labels)
        seen, todo = {0}, [0]
        while todo:
            todo += (new := [w for w in p.near[todo.pop()] if w not in seen])
            seen.update(new)
        self.flat = 0 < n <= MOST_ATOMS and len(seen) == n and all(v not in p.near[v] for v in range(n))
        self.less: list[tuple[int, int]] = []
        self.exact = self.flat and n <= SYMMETRIC_ATOMS
        group = list(p.mappings(g, induced=True)) if self.exact else []
        for v in range(n):
            orbit = {m[v] for m in group}
            self.less += [(v, u) for u in sorted(orbit - {v})]
            group = [m for m in group if m[v] == v]

    def order(self, f: FlatGraphs) -> list[int]:
        """The rarest atom of the batch first, then those that have most bonds to earlier ones."""
        held = {x: int(np.count_nonzero(f.label == x)) for x in set(self.labels)}
        out = [min(range(len(self.labels)), key=lambda v: (held[self.labels[v]], v))]
        while len(out) < len(self.labels):
            out.append(min((v for v in range(len(self.labels)) if v not in out and any(w in out for w in self.near[v])), key=lambda v: (-sum(w in out for w in self.near[v]), held[self.labels[v]], v)))
        return out

    def rows(self, f: FlatGraphs) -> np.ndarray:
        """Matches as columns of atoms, without those that a symmetry of the pattern turns into one another."""
        order = self.order(f)
        at = {v: i for i, v in enumerate(order)}
        cols = [np.flatnonzero(f.label == self.labels[order[0]])]
        for i, v in enumerate(order[1:], 1):
            held = [w for w in self.near[v] if at[w] < i]
            source, target = f.edges(self.labels[held[0]], self.near[held[0]][v], self.labels[v])
            base = cols[at[held[0]]]
            lo = np.searchsorted(source, base)
            size = np.searchsorted(source, base, "right") - lo
            if int(size.sum()) > MOST_ROWS:
                raise _TooMany
            row, new = np.repeat(np.arange(len(base)), size), target[ranges(lo, size)]
            cols = [c[row] for c in cols]
            ok = np.ones(len(new), bool)
            for c in cols:
                ok &= c != new
            for a, b in self.less:
                if v == b and at[a] < i:
                    ok &= cols[at[a]] < new
                elif v == a and at[b] < i:
                    ok &= new < cols[at[b]]
            for w in held[1:]:
                ok &= f.bound(cols[at[w]], new, self.near[w][v])
            cols = [c[ok] for c in [*cols, new]]
        return np.stack(cols)

    def above(self, f: FlatGraphs, counts: Sequence[int]) -> np.ndarray:
        """For each graph and each count whether more different sets of atoms match."""
        if not self.flat or not f.coded:
            return self._slowly(f, counts)
        try:
            rows = self.rows(f)
        except _TooMany:
            if f.count == 1:
                return self._slowly(f, counts)
            half = f.count // 2
            return np.concatenate([self.above(f.part(0, half), counts), self.above(f.part(half, f.count), counts)])
        graph = f.graph[rows[0]]
        found = np.bincount(graph, minlength=f.count)
        if max(counts) and (len(rows) > 2 or not self.exact):  # a set of atoms can match in several ways
            again = (found > min(c for c in counts if c))[graph]
            r = np.sort(rows[:, again], axis=0)
            r = r[:, np.lexsort(r)]
            new = np.append(True, (r[:, 1:] != r[:, :-1]).any(axis=0))[: r.shape[1]]
            sets = np.bincount(f.graph[r[0][new]], minlength=f.count)
            found = np.where(sets > 0, sets, found)
        return found[:, None] > np.asarray(counts)

    def _slowly(self, f: FlatGraphs, counts: Sequence[int]) -> np.ndarray:
        out = np.zeros((f.count, len(counts)), bool)
        enough = max(counts) + 1
        for i in range(f.count):
            seen: set[frozenset[int]] = set()
            for m in self.pattern.mappings(f.one(i)):
                seen.add(frozenset(m.values()))
                if len(seen) >= enough:
                    break
            out[i] = [len(seen) > c for c in counts]
        return out


@lru_cache(maxsize=16)
def _plans(patterns: tuple[tuple[str, int], ...]) -> list[tuple[_Plan, list[int], list[int]]]:
    """A plan for each pattern, the counts to be exceeded, and their bits."""
    held: dict[str, list[tuple[int, int]]] = {}
    for i, (smiles, count) in enumerate(patterns):
        held.setdefault(smiles, []).append((count, i))
    return [(_Plan(graph_of(s)), [c for c, _ in x], [i for _, i in x]) for s, x in held.items()]


def pattern_flags(f: FlatGraphs, n_bits: int, patterns: tuple[tuple[str, int], ...]) -> np.ndarray:
    """``fingerprints.pattern_bits`` of each graph, as a row of flags."""
    out = np.zeros((f.count, n_bits), bool)
    for plan, counts, bits in _plans(patterns):
        out[:, bits] = plan.above(f, counts)
    return out


def torsion_flags(f: FlatGraphs, n_bits: int, bit: Callable[[tuple, int], int]) -> np.ndarray:
    """``fingerprints.torsion_bits`` of each graph, as a row of flags; ``bit`` gives the bit of a code."""
    out = np.zeros((f.count, n_bits), bool)
    degree = np.diff(f.start)
    kinds, kind = np.unique(f.label * (int(degree.max(initial=0)) + 1) + degree, return_inverse=True)  # in the order of label, then degree
    m = int(degree.max(initial=0)) + 1
    once = f.source < f.target
    b, c = f.source[once], f.target[once]
    size = degree[b] * degree[c]
    upto = np.cumsum(size)
    lo = 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MOST_ROWS, "right")))
        row = np.repeat(np.arange(lo, hi), degree[b[lo:hi]])
        a = f.target[ranges(f.start[b[lo:hi]], degree[b[lo:hi]])]
        row, a = row[a != c[row]], a[a != c[row]]
        n = degree[c[row]]
        d = f.target[ranges(f.start[c[row]], n)]
        row, a = np.repeat(row, n), np.repeat(a, n)
        x, y = b[row], c[row]
        ok = (d != x) & (d != a) & (a != x) & (d != y)
        a, x, y, d = (kind[v[ok]] for v in (a, x, y, d))
        k = len(kinds)
        outer, inner, back_outer, back_inner = a * k + x, y * k + d, d * k + y, x * k + a
        turn = (back_outer < outer) | ((back_outer == outer) & (back_inner < inner))
        first, second = np.where(turn, back_outer, outer), np.where(turn, back_inner, inner)
        graph = f.graph[b[row[ok]]]
        pairs, at = np.unique(first * (k * k) + second, return_inverse=True) if k < 50_000 else _pairs(first, second)
        bits = np.empty(len(pairs), np.int64)
        for i, v in enumerate(pairs.tolist()):
            p, q = (v // (k * k), v % (k * k)) if k < 50_000 else v
            code = [int(kinds[z]) for z in (p // k, p % k, q // k, q % k)]
            bits[i] = bit(tuple(z for s in code for z in (s // m, s % m)), n_bits)
        out[graph, bits[at]] = True
        lo = hi
    return out


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.stack([first, second], axis=1), axis=0, return_inverse=True)


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of signed 64-bit words, bit i of word w for flag 64 w + i."""
    n = (flags.shape[1] + 63) // 64
    wide = np.zeros((len(flags), n * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").reshape(len(flags), n).astype(np.int64)
