"""Aromaticity of rings of five and six atoms, whichever way a molecule is written.

A ring is aromatic if each of its atoms can give electrons to a common system
and there are six of them: one for an atom with a double bond inside the ring
system, two for N, O, S and P with a free pair, none for C with a double bond
to O, N or S outside the ring. Atoms written in lower case keep their mark.
Bonds are aromatic within aromatic rings only, so a bond between two rings is
a single one.
"""

from __future__ import annotations

from chemlattice.functions.smiles import AROMATIC, AROMATIC_BOND, DOUBLE, SINGLE, Molecule, hydrogen_count

_FREE_PAIR = {7, 8, 15, 16, 34}
_DRAWN_OUT = {7, 8, 16}


def rings(near: list[dict[int, int]], longest: int = 6) -> list[tuple[int, ...]]:
    """Simple cycles of five up to ``longest`` atoms, each once."""
    out: dict[frozenset[int], tuple[int, ...]] = {}
    for root in range(len(near)):
        stack = [(root, (root,))]
        while stack:
            v, path = stack.pop()
            for w in near[v]:
                if w == root and len(path) >= 5:
                    out.setdefault(frozenset(path), path)
                elif w > root and w not in path and len(path) < longest:
                    stack.append((w, (*path, w)))
    return list(out.values())


def perceive(m: Molecule) -> Molecule:
    """The molecule with aromatic atoms and bonds marked; hydrogens, which are counted before, are written out."""
    n = len(m.number)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, k in zip(m.begin, m.end, m.bond):
        near[a][b] = near[b][a] = k
    found = rings(near) if len(m.begin) >= n or any(m.aromatic) else []
    h = hydrogen_count(m)
    if not found:
        return m._replace(hydrogens=h)
    in_ring = [False] * n
    for r in found:
        for v in r:
            in_ring[v] = True
    aromatic = list(m.aromatic)

    def electrons(v: int, ring: frozenset[int]) -> int | None:
        z = m.number[v]
        if m.aromatic[v]:
            return 1 if z in (5, 6) or (z in (7, 15) and not h[v] and len(near[v]) == 2) else 2
        double = [w for w, k in near[v].items() if k == DOUBLE]
        if len(double) > 1 or any(k not in (SINGLE, DOUBLE, AROMATIC_BOND) for k in near[v].values()):
            return None
        if double:
            if in_ring[double[0]]:
                return 1
            return 0 if z == 6 and m.number[double[0]] in _DRAWN_OUT else None
        if z in _FREE_PAIR and len(near[v]) + h[v] <= 3 and m.charge[v] <= 0:
            return 2
        return {-1: 2, 1: 0}.get(m.charge[v]) if z == 6 and len(near[v]) + h[v] == 3 else None

    bonds: set[tuple[int, int]] = set()
    for r in found:
        given = [electrons(v, frozenset(r)) for v in r]
        if (None not in given and sum(given) == 6) or all(m.aromatic[v] for v in r):
            for v in r:
                aromatic[v] = aromatic[v] or m.number[v] in AROMATIC.values()
            for a, b in zip(r, (*r[1:], r[0])):
                bonds |= {(a, b), (b, a)}
    kind = [AROMATIC_BOND if (a, b) in bonds else SINGLE if k == AROMATIC_BOND else k for a, b, k in zip(m.begin, m.end, m.bond)]
    # A ring of another size that was written as aromatic keeps its bonds.
    kind = [AROMATIC_BOND if k == AROMATIC_BOND and (a, b) not in bonds and _closes(near, a, b, m.aromatic) else new for a, b, k, new in zip(m.begin, m.end, m.bond, kind)]
    return m._replace(aromatic=aromatic, hydrogens=h, bond=kind)


def _closes(near: list[dict[int, int]], a: int, b: int, aromatic: list[bool]) -> bool:
    """Whether a bond lies in some cycle of aromatic atoms."""
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for w in near[v]:
            if aromatic[w] and w not in seen and (v, w) != (a, b):
                if w == b:
                    return True
                seen.add(w)
                todo.append(w)
    return False
