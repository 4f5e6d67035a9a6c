"""SMILES reading: text to a labelled molecular graph.

The reader accepts the public SMILES notation: the organic subset, bracket
atoms with isotope, chirality, hydrogens, charge and class, branches, ring
numbers (``1``-``9`` and ``%nn``), the bond symbols ``- = # $ : / \\`` and
``.`` between components. Valence is not checked. Unreadable text gives
``None`` from :func:`parse` and never raises.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Symbols of the elements in the order of their atomic numbers.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg "
    "Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(ELEMENTS)}
AROMATIC = {"b": 5, "c": 6, "n": 7, "o": 8, "p": 15, "s": 16}

# Vertex labels of aromatic atoms by atomic number; any other atom has its atomic number.
AROMATIC_LABEL = {6: 128, 7: 129, 8: 130, 15: 131, 16: 132, 33: 133, 34: 134}
# Labels of bonds.
SINGLE, AROMATIC_BOND, DOUBLE, TRIPLE, QUADRUPLE = 0, 200, 201, 202, 203

# Standard atomic masses and usual valences used for implicit hydrogens.
MASS = {
    1: 1.008, 3: 6.94, 5: 10.81, 6: 12.011, 7: 14.007, 8: 15.999, 9: 18.998, 11: 22.990, 12: 24.305, 13: 26.982,
    14: 28.085, 15: 30.974, 16: 32.06, 17: 35.45, 19: 39.098, 20: 40.078, 24: 51.996, 25: 54.938, 26: 55.845,
    27: 58.933, 28: 58.693, 29: 63.546, 30: 65.38, 33: 74.922, 34: 78.971, 35: 79.904, 47: 107.87, 50: 118.71,
    53: 126.90, 78: 195.08, 80: 200.59,
}
VALENCES = {5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 15: (3, 5), 16: (2, 4, 6), 9: (1,), 17: (1,), 35: (1,), 53: (1,)}

_TOKEN = re.compile(r"\[([^\[\]]*)\]|(Cl|Br|[BCNOPSFIbcnops])|(%[0-9]{2}|[0-9])|([-=#$:/\\])|([().])|(.)", re.S)
_BRACKET = re.compile(
    r"([0-9]*)([A-Z][a-z]?|[a-z]{1,2})(@(?:@|TH[12]|AL[12]|SP[1-3]|TB[0-9]{1,2}|OH[0-9]{1,2})?)?(H[0-9]*)?"
    r"(\+{1,}|-{1,}|\+[0-9]+|-[0-9]+)?(:[0-9]+)?"
)
_ORDER = {"-": SINGLE, "/": SINGLE, "\\": SINGLE, "=": DOUBLE, "#": TRIPLE, "$": QUADRUPLE, ":": AROMATIC_BOND}


class Molecule(NamedTuple):
    """Atoms in text order; bonds in the order in which they are completed."""

    number: list[int]
    aromatic: list[bool]
    hydrogens: list[int]  # -1: implicit
    charge: list[int]
    isotope: list[int]
    begin: list[int]
    end: list[int]
    bond: list[int]


def key_of(text: str | None) -> str | None:
    """The part before the first space or tab; None stays None."""
    if text is None:
        return None
    return text.split(" ", 1)[0].split("\t", 1)[0]


def _bracket(text: str) -> tuple[int, bool, int, int, int] | None:
    m = _BRACKET.fullmatch(text)
    if m is None:
        return None
    isotope, symbol, _, h, charge, _ = m.groups()
    if symbol in NUMBER:
        number, aromatic = NUMBER[symbol], False
    elif symbol in AROMATIC:
        number, aromatic = AROMATIC[symbol], True
    else:
        return None
    q = 0
    if charge:
        q = (1 if charge[0] == "+" else -1) * (int(charge[1:]) if charge[1:].isdigit() else len(charge))
    return number, aromatic, (int(h[1:] or 1) if h else 0), q, int(isotope or 0)


def parse(text: str | None) -> Molecule | None:
    """Graph of the key of ``text``; None for NULL, empty or unreadable text."""
    if not text:
        return None
    text = key_of(text)
    if not text:
        return None
    number: list[int] = []
    aromatic: list[bool] = []
    hydrogens: list[int] = []
    charge: list[int] = []
    isotope: list[int] = []
    begin: list[int] = []
    end: list[int] = []
    bond: list[int] = []
    last = -1  # atom to which the next one is bound
    pending: int | None = None  # bond symbol that waits for its second atom
    stack: list[int] = []
    rings: dict[int, tuple[int, int | None]] = {}
    opened = False  # right after "(": a branch must hold something

    for bracket, organic, ring, symbol, mark, other in _TOKEN.findall(text):
        if organic or bracket:
            if organic:
                if organic in AROMATIC:
                    number.append(AROMATIC[organic])
                    aromatic.append(True)
                else:
                    number.append(NUMBER[organic])
                    aromatic.append(False)
                hydrogens.append(-1)
                charge.append(0)
                isotope.append(0)
            else:
                a = _bracket(bracket)
                if a is None:
                    return None
                number.append(a[0])
                aromatic.append(a[1])
                hydrogens.append(a[2])
                charge.append(a[3])
                isotope.append(a[4])
            at = len(number) - 1
            if last >= 0:
                begin.append(last)
                end.append(at)
                if pending is None:
                    pending = AROMATIC_BOND if aromatic[last] and aromatic[at] else SINGLE
                bond.append(pending)
            elif pending is not None:
                return None
            last, pending, opened = at, None, False
        elif ring:
            if last < 0 or opened:
                return None
            n = int(ring.lstrip("%"))
            if n in rings:
                other_end, kind = rings.pop(n)
                if other_end == last:
                    return None
                kind = pending if pending is not None else kind
                if kind is None:
                    kind = AROMATIC_BOND if aromatic[last] and aromatic[other_end] else SINGLE
                begin.append(other_end)
                end.append(last)
                bond.append(kind)
            else:
                rings[n] = (last, pending)
            pending = None
        elif symbol:
            if last < 0 or pending is not None:
                return None
            pending, opened = _ORDER[symbol], False
        elif mark == "(":
            if last < 0 or pending is not None:
                return None
            stack.append(last)
            opened = True
        elif mark == ")":
            if not stack or pending is not None or opened:
                return None
            last = stack.pop()
        elif mark == ".":
            if last < 0 or pending is not None or opened:
                return None
            last = -1
        else:
            return None
    if stack or rings or pending is not None or last < 0 or not number:
        return None
    return Molecule(number, aromatic, hydrogens, charge, isotope, begin, end, bond)


def is_readable(text: str | None) -> bool:
    return parse(text) is not None


def labels(m: Molecule) -> list[int]:
    """Vertex labels: atomic number, or the aromatic label where there is one."""
    return [AROMATIC_LABEL.get(z, z) if a else z for z, a in zip(m.number, m.aromatic)]


def hydrogen_count(m: Molecule) -> list[int]:
    """Hydrogens of each atom: as written in brackets, else filled up to the next usual valence."""
    used = [0.0] * len(m.number)
    order = {SINGLE: 1, DOUBLE: 2, TRIPLE: 3, QUADRUPLE: 4, AROMATIC_BOND: 1}
    for a, b, k in zip(m.begin, m.end, m.bond):
        used[a] += order[k]
        used[b] += order[k]
    out = []
    for z, ar, h, u in zip(m.number, m.aromatic, m.hydrogens, used):
        if h >= 0:
            out.append(h)
            continue
        u += 1 if ar else 0
        usual = VALENCES.get(z, (0,))
        free = next((v for v in usual if v >= u), u)
        if ar and z not in (6, 5):
            free = max(u, usual[0]) if u <= usual[0] else u
        out.append(max(0, int(free - u)))
    return out


def molecular_weight(m: Molecule) -> float | None:
    """Sum of atomic masses with hydrogens; None if an element has no mass in the table. Isotopes count by mass number."""
    total = 0.0
    for z, h, i in zip(m.number, hydrogen_count(m), m.isotope):
        if not i and z not in MASS:
            return None
        total += (i or MASS[z]) + h * MASS[1]
    return round(total, 4)


def components(n: int, begin: list[int], end: list[int]) -> list[int]:
    """Component number of each atom, numbered by their first atoms."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(begin, end):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def main_component(m: Molecule) -> tuple[list[int], list[int], list[int]]:
    """Skeleton of the component with most atoms other than hydrogen: elements and the two ends of each bond.

    Explicit hydrogen atoms are left out. Ties go to the component with more
    bonds, then to the larger sorted list of elements, then to the first.
    Parallel bonds count once.
    """
    if 1 in m.number or _several(m):
        n = len(m.number)
        comp = components(n, m.begin, m.end)
        members: dict[int, list[int]] = {}
        for x, c in enumerate(comp):
            if m.number[x] != 1:
                members.setdefault(c, []).append(x)
        if not members:
            return [], [], []
        bonds: dict[int, int] = {}
        for a in m.begin:
            bonds[comp[a]] = bonds.get(comp[a], 0) + 1
        best = max(members, key=lambda c: (len(members[c]), bonds.get(c, 0), sorted(m.number[x] for x in members[c]), -c))
        keep = {x: i for i, x in enumerate(members[best])}
        pairs = dict.fromkeys((min(keep[a], keep[b]), max(keep[a], keep[b])) for a, b in zip(m.begin, m.end) if a in keep and b in keep)
        return [m.number[x] for x in members[best]], [a for a, _ in pairs], [b for _, b in pairs]
    return m.number, m.begin, m.end


def _several(m: Molecule) -> bool:
    """Whether there is more than one component, or a pair of atoms with more than one bond."""
    n, pairs = len(m.number), set(zip(m.begin, m.end))
    if len(pairs) < len(m.begin) or any(a > b and (b, a) in pairs for a, b in pairs):
        return True
    # An atom that no bond leads to from an earlier one begins a component, unless a ring bond joins it later.
    starts = n - len(set(map(max, m.begin, m.end)))
    return starts > 1 and len(set(components(n, m.begin, m.end))) > 1
