"""Fingerprints of molecular graphs, and the registry of their kinds.

Path fingerprints set a bit for each labelled path of up to seven atoms: a
pattern's paths are among those of every molecule that holds it, so they are
safe for screening. Pattern fingerprints set a bit where a pattern of the
dictionary occurs more than its count. Atom-pair and torsion fingerprints
serve similarity only, as a ring closure or a longer branch can change their
codes. A molecule that cannot be read has all bits set, so that screening
never loses it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np

from chemlattice.functions.bits import host_words
from chemlattice.functions.flat import FlatGraphs, pattern_flags, torsion_flags
from chemlattice.functions.graphs import Graph, Pattern, adjacency, graph_of

PATH_ATOMS = 7


def _bit(code: tuple, n_bits: int) -> int:
    """A bit for a code, by the first 60 bits of the MD5 of its numbers as text, so that SQL can work it out, too."""
    return int(hashlib.md5(",".join(map(str, code)).encode(), usedforsecurity=False).hexdigest()[:15], 16) % n_bits


@lru_cache(maxsize=1 << 18)
def _path_bit(code: tuple, n_bits: int) -> int:
    return _bit(code, n_bits)


def path_bits(g: Graph, n_bits: int = 1024) -> set[int]:
    """Bits of all simple paths of up to ``PATH_ATOMS`` atoms, each read in its smaller direction."""
    near, label = adjacency(g), g[0]
    out: set[int] = set()
    for root in range(len(label)):
        stack: list[tuple[int, tuple, tuple]] = [(root, (root,), (label[root],))]
        while stack:
            v, path, code = stack.pop()
            back = code[::-1]
            if code <= back:
                out.add(_path_bit(code, n_bits))
            if len(path) < PATH_ATOMS:
                for w, k in near[v].items():
                    if w not in path:
                        stack.append((w, (*path, w), (*code, k, label[w])))
    return out


def atom_pair_bits(g: Graph, n_bits: int = 1024) -> set[int]:
    near, label = adjacency(g), g[0]
    out: set[int] = set()
    for root in range(len(label)):
        dist = {root: 0}
        todo = deque([root])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        for w, d in dist.items():
            if w > root:
                a, b = sorted(((label[root], len(near[root])), (label[w], len(near[w]))))
                out.add(_path_bit((*a, *b, d), n_bits))
    return out


def torsion_bits(g: Graph, n_bits: int = 1024) -> set[int]:
    near, label = adjacency(g), g[0]
    out: set[int] = set()
    for b in range(len(label)):
        for c in near[b]:
            if b < c:
                for a in near[b]:
                    for d in near[c]:
                        if len({a, b, c, d}) == 4:
                            code = tuple((label[x], len(near[x])) for x in (a, b, c, d))
                            out.add(_path_bit(sum(min(code, code[::-1]), ()), n_bits))
    return out


def layered_bits(g: Graph, n_bits: int = 2048) -> set[int]:
    """Paths seen through three layers: their shape alone, with the bonds, and with atoms and bonds. Safe for screening."""
    near, label = adjacency(g), g[0]
    out: set[int] = set()
    for root in range(len(label)):
        stack: list[tuple[int, tuple, tuple, tuple]] = [(root, (root,), (label[root],), ())]
        while stack:
            v, path, code, bonds = stack.pop()
            out.add(_path_bit((1, len(path)), n_bits))
            out.add(_path_bit((2, *min(bonds, bonds[::-1])), n_bits))
            out.add(_path_bit((3, *min(code, code[::-1])), n_bits))
            if len(path) < PATH_ATOMS:
                for w, k in near[v].items():
                    if w not in path:
                        stack.append((w, (*path, w), (*code, k, label[w]), (*bonds, k)))
    return out


def topological_bits(g: Graph, n_bits: int = 2048) -> set[int]:
    """Paths of bonds with the elements they join, aromatic or not, two bits for each path. Safe for screening."""
    element = {128: 6, 129: 7, 130: 8, 131: 15, 132: 16, 133: 33, 134: 34}
    plain: Graph = ([element.get(x, x) for x in g[0]], g[1], g[2], g[3])
    near, label = adjacency(plain), plain[0]
    out: set[int] = set()
    for root in range(len(label)):
        stack: list[tuple[int, tuple, tuple]] = [(root, (root,), (label[root],))]
        while stack:
            v, path, code = stack.pop()
            if len(path) > 1:
                one = min(code, code[::-1])
                out |= {_path_bit((salt, *one), n_bits) for salt in (4, 5)}
            if len(path) < PATH_ATOMS:
                for w, k in near[v].items():
                    if w not in path:
                        stack.append((w, (*path, w), (*code, k, label[w])))
    return out


# Pattern dictionary: SMILES of a pattern and the count that its occurrences must exceed. A bit for each, in order.
PATTERNS = [
    (p, c)
    for p, counts in (
        ("C", (0, 7, 15)), ("c", (0, 5, 11, 17)), ("N", (0, 1, 3)), ("n", (0, 1, 3)), ("O", (0, 1, 3, 5)), ("o", (0,)), ("S", (0, 1)), ("s", (0,)), ("F", (0, 2, 5)), ("Cl", (0, 1)), ("Br", (0, 1)), ("I", (0,)), ("P", (0,)),
        ("C=O", (0, 1, 2)), ("C=C", (0,)), ("C#N", (0,)), ("C#C", (0,)), ("CO", (0, 2)), ("CN", (0, 2)), ("CS", (0,)), ("NC=O", (0, 1)), ("OC=O", (0, 1)), ("S=O", (0, 1)), ("O=S=O", (0,)), ("NS", (0,)), ("N=O", (0,)), ("N=N", (0,)),
        ("c1ccccc1", (0, 1, 2)), ("c1ccncc1", (0, 1)), ("c1ncncc1", (0,)), ("c1cccs1", (0,)), ("c1ccco1", (0,)), ("c1cccn1", (0,)), ("C1CC1", (0,)), ("C1CCC1", (0,)), ("C1CCCC1", (0,)), ("C1CCCCC1", (0,)), ("C1CCNCC1", (0,)), ("C1CNCCO1", (0,)),
        ("cC", (0, 2)), ("cN", (0,)), ("cO", (0,)), ("cS", (0,)), ("cF", (0,)), ("cCl", (0,)), ("cc", (0,)), ("CC", (0, 3)), ("CCC", (0, 3)), ("CC(C)C", (0,)), ("FC(F)F", (0,)),
    )
    for c in counts
]


@lru_cache(maxsize=16)
def _compiled(patterns: tuple[tuple[str, int], ...]) -> list[tuple[Pattern, int]]:
    out = []
    for smiles, count in patterns:
        g = graph_of(smiles)
        if g is None:
            raise ValueError(f"not a readable pattern: {smiles!r}")
        out.append((Pattern(g), count))
    return out


def _occurrences(p: Pattern, g: Graph, enough: int) -> int:
    """Different sets of atoms that match, counted up to ``enough``."""
    seen: set[frozenset[int]] = set()
    for m in p.mappings(g):
        seen.add(frozenset(m.values()))
        if len(seen) >= enough:
            break
    return len(seen)


def pattern_bits(g: Graph, n_bits: int = 0, patterns: tuple[tuple[str, int], ...] = tuple(PATTERNS)) -> set[int]:
    return {i for i, (p, count) in enumerate(_compiled(patterns)) if _occurrences(p, g, count + 1) > count}


@dataclass(frozen=True)
class Kind:
    name: str
    bits: Callable[[Graph, int], set[int]]
    n_bits: int
    screen_safe: bool
    flags: Callable[[FlatGraphs, int], np.ndarray] | None = None  # the same bits for many graphs at once


REGISTRY: dict[str, Kind] = {}


def register_fingerprint(name: str, bits: Callable[[Graph, int], set[int]], n_bits: int, screen_safe: bool = False, flags: Callable[[FlatGraphs, int], np.ndarray] | None = None) -> None:
    """Adds a kind of fingerprint; ``screen_safe`` says that a part never has a bit that the whole lacks."""
    REGISTRY[name] = Kind(name, bits, n_bits, screen_safe, flags)


def register_patterns(name: str, patterns: Iterable[tuple[str, int]]) -> None:
    """Adds a pattern fingerprint from a dictionary of SMILES and counts; bit i is set where pattern i occurs more often."""
    held = tuple((str(s), int(c)) for s, c in patterns)
    _compiled(held)
    register_fingerprint(name, partial(pattern_bits, patterns=held), len(held), True, partial(pattern_flags, patterns=held))


register_fingerprint("GraphPath", path_bits, 1024, True)
register_fingerprint("Pattern", pattern_bits, len(PATTERNS), True, partial(pattern_flags, patterns=tuple(PATTERNS)))
register_fingerprint("AtomPair", atom_pair_bits, 1024)
register_fingerprint("Torsion", torsion_bits, 1024, flags=partial(torsion_flags, bit=_path_bit))
register_fingerprint("Layered", layered_bits, 2048, True)
register_fingerprint("Topological", topological_bits, 2048, True)


def available_fingerprints() -> list[str]:
    return list(REGISTRY)


def fingerprint_words(name: str, g: Graph | None) -> list[int]:
    """Signed words; all bits set where there is no graph; no word at all for an unknown name."""
    kind = REGISTRY.get(name)
    if kind is None:
        return []
    return host_words(kind.bits(g, kind.n_bits) if g is not None else range(kind.n_bits), kind.n_bits)


def partition_name(name: str) -> str:
    """A name fit for a folder: the first ``::`` becomes ``_``."""
    return name.replace("::", "_", 1)
