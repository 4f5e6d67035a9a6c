"""Columns and fingerprints of many graphs at once against those of one graph."""

import random

from chemlattice.functions import canon, flat
from chemlattice.functions.fingerprints import REGISTRY, fingerprint_words
from chemlattice.functions.graphs import graph_of
from chemlattice.functions.smiles import hydrogen_count, molecular_weight, parse
from chemlattice.operators import substructure
from chemlattice.sources.molecules import canonical_keys, with_molecules

TEXTS = ["C", "[U]", "CC(=O)Oc1ccccc1C(=O)O", "FC(F)(F)c1ccc(cc1)N1CCOCC1", "C1CC1(C)C", "C1CC2CCC1CC2.[Na+].[Cl-]", "CS(=O)(=O)Nc1ccc(cc1)c1ccccc1", "c1ccc2ccccc2c1.CCO.CCO", "C12C3C4C1C5C2C3C45", "[13CH3][NH3+]", "CP(C)(C)(C)C"]


def _odd(n: int) -> list:
    """Graphs with parallel bonds, loops, triangles and several components."""
    rng = random.Random(5)
    out = []
    for _ in range(n):
        k = rng.randint(0, 12)
        m = rng.randint(0, 22) if k else 0
        out.append(([rng.choice([6, 6, 6, 128, 7, 8, 129]) for _ in range(k)], *([rng.randrange(k) for _ in range(m)] for _ in range(2)), [rng.choice([0, 0, 200, 201]) for _ in range(m)]))
    return out


def test_flags_are_those_of_one_graph():
    graphs = [graph_of(t) for t in TEXTS] + _odd(150)
    f = flat.FlatGraphs.of(graphs)
    for name in ("Pattern", "Torsion"):
        kind = REGISTRY[name]
        assert flat.packed(kind.flags(f, kind.n_bits)).tolist() == [fingerprint_words(name, g) for g in graphs], name


def test_too_many_matches_for_one_table(monkeypatch):
    graphs = [graph_of(t) for t in TEXTS] + _odd(40)
    monkeypatch.setattr(flat, "MOST_ROWS", 5)
    f = flat.FlatGraphs.of(graphs)
    for name in ("Pattern", "Torsion"):
        kind = REGISTRY[name]
        assert flat.packed(kind.flags(f, kind.n_bits)).tolist() == [fingerprint_words(name, g) for g in graphs], name


def test_columns_are_those_of_one_molecule():
    mols = [parse(t) for t in TEXTS]
    f = flat.FlatMolecules(mols)
    assert f.hydrogens.tolist() == [h for m in mols for h in hydrogen_count(m)]
    assert f.weights == [molecular_weight(m) for m in mols]
    assert f.canonical(True) == canonical_keys(mols) and f.canonical(False) == canonical_keys(mols, identity=False)


def test_plain_graphs_are_numbered_without_trying_tied_vertices(monkeypatch):
    def tried(b):
        raise AssertionError("tied vertices were tried")

    monkeypatch.setattr(canon, "_least", tried)
    assert len(set(canonical_keys([parse("FC(F)(F)c1ccc(cc1)S(=O)(=O)N"), parse("NS(=O)(=O)c1ccc(C(F)(F)F)cc1")]))) == 1
    assert len(set(canonical_keys([parse("CCN(CC)c1ccccc1.[Cl-]"), parse("[Cl-].c1cccc(c1)N(CC)CC")]))) == 1


def test_rows_without_a_graph_have_all_bits(spark):
    rows = with_molecules(spark.createDataFrame([(1, "C("), (2, "CCO"), (3, None), (4, "[9999999999C]")], "mol_id long, smiles string"))
    held = {r["mol_id"]: r for r in substructure.with_fingerprints(rows, ["Pattern", "Torsion", "GraphPath"]).collect()}
    assert held[1]["canonical"] is None and held[1]["atoms"] is None and held[4]["n_atoms"] == 1
    for name in ("Pattern", "Torsion", "GraphPath"):
        assert list(held[1][f"fp_{name}"]) == list(held[3][f"fp_{name}"]) == fingerprint_words(name, None)
        assert list(held[2][f"fp_{name}"]) == fingerprint_words(name, graph_of("CCO"))
