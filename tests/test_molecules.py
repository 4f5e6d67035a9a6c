from __future__ import annotations

import random

import pytest

from chemlattice.functions import canon
from chemlattice.functions.fingerprints import PATTERNS, REGISTRY, fingerprint_words, partition_name
from chemlattice.functions.graphs import Pattern, expand, from_text, graph_of, is_subgraph, reduced_graph, to_text
from chemlattice.functions.smiles import is_readable, key_of, main_component, molecular_weight, parse
from chemlattice.sources.molecules import canonical_keys, first_molecule, is_valid_format, parse_molblock, read_molecules, with_molecules

CORPUS = """[Cl-].OC(=O)C(CS)[NH3+]
CC(C)CCC[C@@H](C)[C@H]1CCC2C3CC=C4CC(CC[C@@]4(C)C3CC[C@@]12C)OC(=O)c1ccccc1
CCCC(=O)OC1CC[C@]2(C)C(=CCC3C4CC[C@H]([C@H](C)CCCC(C)C)[C@]4(C)CCC23)C1
ONC1CC(C(O)C1O)[n]2cnc3c(NC4CC4)ncnc23
Nc1ncnc2[n]cnc12
C[Mg]Cl
c1(c2c(cnc1)c(cnn2)N1CC1)Cl
O=C1S/C(=C/c2ccco2)/C(=O)N1C
N#[Cr]
C[Sn](C)(F)F
C1CCC2CCCCC2C1
C1CCCC1C1CCCC1
C%12CC%12
FC(F)(F)c1ccc(cc1)C(C)(C)C""".splitlines()


@pytest.mark.parametrize("text", CORPUS)
def test_corpus_is_readable(text):
    assert is_readable(text)


@pytest.mark.parametrize("text", [None, "", " C", "C(", "C)", "C()C", "(C)C", "C1CC", "C=#C", "=C", "C=", "C=)C", "[Xx]", "[nH", "C]", "[]", "c1ccccc1Q", "se", "C..C", ".C", "C.", "C11", "C(=)C", "[13]", "%12CC"])
def test_unreadable(text):
    assert not is_readable(text)


def test_keys_and_weights():
    assert key_of("CC\tname") == "CC" and key_of("CC name more") == "CC" and key_of(None) is None
    assert molecular_weight(parse("O")) == pytest.approx(18.015, abs=1e-3)
    assert molecular_weight(parse("c1ccccc1")) == pytest.approx(78.114, abs=1e-2)
    assert molecular_weight(parse("[Og]")) is None


def test_main_component_leaves_salts_and_hydrogens_out():
    g = main_component(parse("[Na+].[H]OC(=O)C.Cl"))
    assert sorted(g[0]) == [6, 6, 8, 8] and len(g[1]) == 3
    assert main_component(parse("[H][H]")) == ([], [], [])


def _shuffled(g, seed):
    rng = random.Random(seed)
    n = len(g[0])
    order = list(range(n))
    rng.shuffle(order)
    at = {v: i for i, v in enumerate(order)}
    e = [(at[a], at[b], k) for a, b, k in zip(g[1], g[2], g[3])]
    rng.shuffle(e)
    return [g[0][v] for v in order], [a for a, _, _ in e], [b for _, b, _ in e], [k for _, _, k in e]


def test_certificates_do_not_depend_on_numbering_or_company():
    graphs = [graph_of(s) for s in CORPUS]
    alone = [canon.certificates(b, canon.refine(b))[0].tolist() for b in (canon.GraphBatch([g]) for g in graphs)]
    b = canon.GraphBatch([_shuffled(g, i) for i, g in enumerate(graphs)])
    assert canon.certificates(b, canon.refine(b)).tolist() == alone
    assert len({tuple(c) for c in alone}) == len(graphs)


def test_isomorphism_tells_apart_what_colours_do_not():
    a, b = graph_of("C1CCC2CCCCC2C1"), graph_of("C1CCCC1C1CCCC1")
    h = canon.GraphBatch([a, b])
    c = canon.colour_hash(h, canon.refine(h))
    assert c[0] == c[1], "refinement alone can't tell them apart"
    assert not canon.isomorphic(a, b)
    assert canon.isomorphic(a, _shuffled(a, 3)) and canon.isomorphic(b, _shuffled(b, 4))
    assert len(set(canonical_keys([parse("C1CCC2CCCCC2C1"), parse("C1CCCC1C1CCCC1")]))) == 2


def test_canonical_keys_join_writings():
    one = [parse(s) for s in ("OCC", "CCO", "C(O)C", "[CH3]CO")]
    assert len(set(canonical_keys(one))) == 1
    assert canonical_keys([]) == []
    assert canonical_keys([parse("CC=O")]) != canonical_keys([parse("CCO")])


def test_canonical_keys_join_writings_of_which_tied_atoms_are_no_images():
    assert len(set(canonical_keys([parse("C1CCCCC1.C1CC1"), parse("C1CC1.C1CCCCC1")]))) == 1
    assert len(set(canonical_keys([parse("C1CCCCC1.C1CC1"), parse("C1CCCC1.C1CCC1")]))) == 2
    # The generalised Petersen graph (7, 2): connected, all vertices of one colour, but not images of each other.
    ties = ([6] * 14, [*range(14), *range(7)], [*[(i + 1) % 7 for i in range(7)], *[7 + (i + 2) % 7 for i in range(7)], *range(7, 14)], [1] * 21)
    for g in (ties, *[graph_of(s) for s in CORPUS if graph_of(s)]):
        forms = set()
        for seed in range(8):
            h = _shuffled(g, seed) if seed else g
            r = canon.ranks(canon.GraphBatch([h]))[0].tolist()
            assert sorted(r) == list(range(len(r)))
            forms.add((tuple(x for _, x in sorted(zip(r, h[0]))), tuple(sorted((min(r[a], r[b]), max(r[a], r[b]), k) for a, b, k in zip(h[1], h[2], h[3])))))
        assert len(forms) == 1


@pytest.mark.parametrize("text", CORPUS)
def test_reduced_graph_expands_to_the_regular_one(text):
    g = graph_of(text)
    vertices, edges = reduced_graph(g)
    assert canon.isomorphic(expand(vertices, edges), g)
    assert from_text(to_text(vertices, edges)) == (vertices, [tuple([a, b, p]) for a, b, p in edges])


@pytest.mark.parametrize("text", ["", "{}", "{[{6}],[{1,2,[6]}]}", "{[{6}],[{0,1,[]}]}", "{[6],[]}"])
def test_bad_graph_text(text):
    with pytest.raises(ValueError):
        from_text(text)


def test_graph_text_fixtures():
    assert from_text("{[{6}],[]}") == ([6], [])
    assert from_text("{[{6},{6}], [{1,2,[6,6]},{1,2,[]}]}")[1] == [(1, 2, [6, 6]), (1, 2, [])]


@pytest.mark.parametrize(
    ("query", "target", "mono", "induced"),
    [("CCC", "C1CC1", True, False), ("C(C)C", "C1CC1", True, False), ("CCCC", "C1CCC1", True, False), ("CCC", "C1CCC1", True, True), ("CCCC", "C1CCCC1", True, True), ("C=C", "CC", False, False), ("cc", "CC", False, False), ("C.C", "CC", True, False), ("C.C", "CCC", True, True)],
)
def test_matcher(query, target, mono, induced):
    q, t = graph_of(query), graph_of(target)
    assert is_subgraph(q, t) is mono
    assert is_subgraph(q, t, induced=True) is induced


@pytest.mark.parametrize(
    ("query", "target", "expected"),
    [
        ("{[{6}],[{1,0,[6,6]}]}", "{[{6}],[{1,0,[6,6,6]}]}", True),
        ("{[{6}],[{1,0,[6,6,6]}]}", "{[{6}],[{1,0,[6,6]}]}", False),
        ("{[{6}],[{1,0,[6,6]}]}", "{[{6},{6}],[{1,2,[6,6,6]}]}", True),
        ("{[{6},{6}],[{1,2,[6,6]},{1,2,[6,6]}]}", "{[{6},{6}],[{1,2,[6,6]},{1,2,[6,6]}]}", True),
        ("{[{6},{6}],[{1,2,[6,6]},{1,2,[6,6]}]}", "{[{6},{6}],[{1,2,[6,6]}]}", False),
        ("{[{6}],[{1,0,[6]},{1,0,[6,6]}]}", "{[{6}],[{1,1,[6,6,6,6]}]}", True),
    ],
)
def test_edge_matching_by_anchored_matching(query, target, expected):
    q, t = expand(*from_text(query)), expand(*from_text(target))
    assert Pattern(q).matches(t, anchor=(0, 0)) is expected


def test_used_vertex_blocks_the_chain():
    q, t = expand(*from_text("{[{6}],[{1,0,[6,6,6,6]}]}")), expand(*from_text("{[{6},{6}],[{1,2,[6,6,6]}]}"))
    assert Pattern(q).matches(t, anchor=(0, 0))
    assert not Pattern(q).matches(t, anchor=(0, 0), blocked=frozenset({1}))


def test_screen_safe_fingerprints_never_lose_a_match():
    queries = ["C", "CO", "c1ccccc1", "C=O", "NC=O", "CCC", "cN", "C1CC1"]
    for q in queries:
        for t in CORPUS:
            if is_subgraph(graph_of(q), graph_of(t)):
                for name, kind in REGISTRY.items():
                    if kind.screen_safe:
                        a, b = fingerprint_words(name, graph_of(q)), fingerprint_words(name, graph_of(t))
                        assert all(x & ~y == 0 for x, y in zip(a, b)), (q, t, name)


def test_fingerprints_of_nothing():
    assert sum(bin(w & (2**64 - 1)).count("1") for w in fingerprint_words("Pattern", None)) == len(PATTERNS)
    assert fingerprint_words("unknown", graph_of("C")) == []
    assert partition_name("A::B::C") == "A_B::C"


def test_files(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol\r\nC\tmethane gas\nbad( x\n\nN\n")
    rows = read_molecules(spark, str(tmp_path / "a.smi")).orderBy("position").collect()
    assert [(r["position"], r["smiles"], r["title"]) for r in rows] == [(0, "CCO", "ethanol"), (1, "C", "methane gas"), (2, "bad(", "x"), (3, "", ""), (4, "N", "")]
    assert first_molecule(spark, str(tmp_path / "a.smi")).first()["smiles"] == "CCO"
    got = with_molecules(read_molecules(spark, str(tmp_path / "a.smi"))).orderBy("position").collect()
    assert [r["n_atoms"] for r in got] == [3, 1, None, None, 1]
    with pytest.raises(ValueError):
        read_molecules(spark, str(tmp_path / "a.xyz"))
    assert is_valid_format("x.sdf") and not is_valid_format("x")


MOLBLOCK = """ethanol
  own

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0
    0.0000    0.0000    0.0000 C   0  0
    0.0000    0.0000    0.0000 O   0  0
  1  2  1  0
  2  3  1  0
M  END
"""


def test_sdf(spark, tmp_path):
    assert canonical_keys([parse_molblock(MOLBLOCK)]) == canonical_keys([parse("CCO")])
    assert parse_molblock(None) is None and parse_molblock("x\n\n\nnothing") is None
    (tmp_path / "a.sdf").write_text(MOLBLOCK + "$$$$\n" + MOLBLOCK.replace("ethanol", "again") + "$$$$\n")
    rows = with_molecules(read_molecules(spark, str(tmp_path / "a.sdf"))).orderBy("position").collect()
    assert [(r["title"], r["n_atoms"]) for r in rows] == [("ethanol", 3), ("again", 3)]


def test_added_columns_replace_clashing_ones(spark):
    df = spark.createDataFrame([("CCO", 99, "x"), (None, 1, None)], "smiles string, n_atoms int, title string")
    got = with_molecules(df).orderBy("title").collect()
    assert [(r["title"], r["n_atoms"]) for r in got] == [(None, None), ("x", 3)]


# Pairs of writings, and whether they are one molecule once rings are perceived.
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("c1ccccc1", "C1=CC=CC=C1", True), ("n1cccc2ccccc12", "C1=CC2=CC=CC=C2N=C1", True), ("c1cc[nH]c1", "C1=CNC=C1", True), ("C1CCCCC1", "C1=CC=CC=C1", False), ("C1=CC=CC=CC=C1", "c1ccccc1", False), ("O=c1cc[nH]cc1", "O=C1C=CNC=C1", True), ("C=C1C=CC=CC1", "Cc1ccccc1", False)],
)
def test_rings_are_perceived(a, b, same):
    from chemlattice.functions.aromatic import perceive

    keys = canonical_keys([perceive(parse(a)), perceive(parse(b))])
    assert (keys[0] == keys[1]) == same


def test_keys_tell_charge_isotope_and_hydrogens_apart():
    texts = ["N", "[NH4+]", "[NH2]", "[15NH3]", "[NH2-]"]
    assert len(set(canonical_keys([parse(t) for t in texts]))) == len(texts)
    assert len(set(canonical_keys([parse(t) for t in texts], identity=False))) == 1
    assert canonical_keys([parse("[CH4]")]) == canonical_keys([parse("C")])


def test_shuffled_writings_have_one_key():
    """The atoms of each molecule in another order; several components too."""
    import random

    from chemlattice.functions.smiles import Molecule

    rng = random.Random(4)
    texts = ["C1CCCCC1.C1CC1", "CC(=O)Oc1ccccc1C(=O)O", "C1CC2CCC1CC2.[Na+].[Cl-]", "FC(F)(F)c1ccc(cc1)N1CCOCC1", "C12C3C4C1C5C2C3C45", "c1ccc2ccccc2c1.CCO.CCO"]
    for t in texts:
        m = parse(t)
        keys = set()
        for _ in range(8):
            order = list(range(len(m.number)))
            rng.shuffle(order)
            to = {v: i for i, v in enumerate(order)}
            bonds = [(to[a], to[b], k) if rng.random() < 0.5 else (to[b], to[a], k) for a, b, k in zip(m.begin, m.end, m.bond)]
            rng.shuffle(bonds)
            pick = lambda x: [x[v] for v in order]  # noqa: B023, E731
            keys |= set(canonical_keys([Molecule(pick(m.number), pick(m.aromatic), pick(m.hydrogens), pick(m.charge), pick(m.isotope), [b[0] for b in bonds], [b[1] for b in bonds], [b[2] for b in bonds])]))
        assert keys == set(canonical_keys([m])), t
