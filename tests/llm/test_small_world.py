from __future__ import annotations

import random

import numpy as np
import pytest

from chemlattice.functions import canon
from chemlattice.functions.smiles import main_component, parse
from chemlattice.llm import small_world as S

HISTORY = [(1, "CCO"), (2, "c1ccccc1 benzene"), (3, None), (4, ""), (5, "C1CCC2CCCCC2C1"), (6, "bad("), (7, "CCO"), (7, "CCO"), (8, "CC(=O)O.[Na+]"), (9, "[H][H]"), (None, "CCO")]
BATCHES = [
    (101, 1, "OCC"), (102, 1, "C1CCCC1C1CCCC1"), (103, 1, "C1CCCCC1"), (104, 1, "N"), (105, 1, "N x"), (106, 1, None), (107, 1, "bad("), (108, 1, ""),
    (201, 2, "C1CCCC1C2CCCC2"), (202, 2, "N"), (203, 2, "[O-]C(C)=O"), (204, 2, "C2CCC1CCCCC1C2"), (204, 2, "C2CCC1CCCCC1C2"), (205, 2, "[H][H]"), (301, 3, "CCCCl"), (302, 3, "ClCCC"), (401, 4, "CCC[Cl]"), (501, 5, "C(CC)Cl"), (601, 6, "CCCCl"), (None, 6, "CCO"), (700, None, "OCC"),
]
FOUND = {(1, 101), (2, 103), (104, 105), (102, 201), (104, 202), (8, 203), (5, 204), (301, 302), (301, 401), (301, 501), (301, 601), (1, 700)}


def test_repeats(spark):
    h = spark.createDataFrame([(*r, 1, "x") for r in HISTORY], "mol_id long, smiles string, id int, text string").repartition(2)
    b = spark.createDataFrame([(*r, "y", 2) for r in BATCHES], "rec_id long, batch_no int, smiles string, batch string, route int").repartition(3)
    assert {tuple(r) for r in S.repeats(h, b).collect()} == FOUND


def test_empty_tables(spark):
    h = spark.createDataFrame(HISTORY, "mol_id long, smiles string")
    b = spark.createDataFrame(BATCHES, "rec_id long, batch_no int, smiles string")
    assert S.repeats(h, b.limit(0)).count() == 0
    assert {tuple(r) for r in S.repeats(h.limit(0), b).collect()} == {p for p in FOUND if p[0] > 100} | {(101, 700)}


def _chain(rng):
    """A random molecule as text."""
    return "".join(rng.choice(["C", "N", "O", "C(F)", "C(Cl)", "c1ccccc1", "C1CC1", "S"]) for _ in range(rng.randint(6, 14)))


def _other_writing(text, rng):
    """The same skeleton, written from another atom by depth-first search."""
    z, a, b = main_component(parse(text))
    near = [[] for _ in z]
    for x, y in zip(a, b):
        near[x].append(y)
        near[y].append(x)
    symbol = {6: "C", 7: "N", 8: "O", 9: "F", 16: "S", 17: "Cl"}
    for v in near:
        rng.shuffle(v)
    rings, seen, tree = {}, set(), {}

    def walk(v, parent):
        seen.add(v)
        tree[v] = []
        for w in near[v]:
            if w == parent:
                continue
            if w in seen:
                if (w, v) not in rings and (v, w) not in rings:
                    rings[(v, w)] = len(rings) + 1
            else:
                tree[v].append(w)
                walk(w, v)

    root = rng.randrange(len(z))
    walk(root, -1)

    def write(v):
        out = f"[{symbol[z[v]]}]" + "".join(f"%{n + 9:02d}" for e, n in rings.items() if v in e)
        parts = [write(w) for w in tree[v]]
        return out + "".join(f"({p})" for p in parts[:-1]) + (parts[-1] if parts else "")

    return write(root)


def test_many_writings_against_exact_groups(spark):
    rng = random.Random(7)
    texts = list({_chain(rng) for _ in range(1500)})
    history = list(enumerate(texts[:900], 1))
    rows, n = [], 10_000
    for batch in range(1, 7):
        for _ in range(250):
            n += 1
            t = rng.choice(texts)
            rows.append((n, batch, _other_writing(t, rng) if rng.random() < 0.5 else t))
        rows += [(n + i, batch, _other_writing(texts[0], rng)) for i in range(1, 100)]  # one molecule holds a third of all rows
        n += 100
    h = spark.createDataFrame(history, "mol_id long, smiles string")
    b = spark.createDataFrame(rows, "rec_id long, batch_no int, smiles string")
    got = {tuple(r) for r in S.repeats(h, b).collect()}
    graphs = [main_component(parse(t)) for _, t in history] + [main_component(parse(r[2])) for r in rows]
    batch = canon.GraphBatch(graphs)
    cert = [tuple(c) for c in canon.certificates(batch, canon.refine(batch)).tolist()]
    first, want = {}, set()
    for i, c in zip([i for i, _ in history] + [r[0] for r in rows], cert):
        if c in first and i > 9_999:
            want.add((first[c], i))
        first.setdefault(c, i)
    assert got == want, (len(got), len(want), list(got ^ want)[:3])


def test_beam_search_agrees_with_exhaustive_search():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.poisson(rng.uniform(0, 3, S.DIMENSIONS), (300, S.DIMENSIONS)) for _ in range(10)]).astype(np.float32)
    x = np.unique(x, axis=0)
    rng.shuffle(x)
    g = S.SmallWorld(x)
    assert g.tune() >= S.WANTED
    ids, dist = g.search(x)
    assert (dist[:, 0] < 1e-3).mean() > 0.99
    q = x[:300] + rng.normal(0, 0.3, (300, S.DIMENSIONS)).astype(np.float32)
    exact = g._exact(q, x).argmin(axis=1)
    assert (g.search(q, 64)[0][:, 0] == exact).mean() > 0.9


def test_kept_shards_serve_a_later_batch(spark, tmp_path):
    """Calls of one batch each, with numbers that don't matter: what earlier ones brought is found, and live segments stay few."""
    held = S.History(spark, str(tmp_path / "history"))
    with pytest.raises(FileNotFoundError):
        held.catalog()
    held.create(spark.createDataFrame(HISTORY, "mol_id long, smiles string"), expected=30_000)
    found, live = set(), []
    batches = [[r for r in BATCHES if r[1] == n] for n in (1, 2, 3, 4, 5, 6)]
    for rows in batches:
        found |= {tuple(r) for r in held.add(spark.createDataFrame(rows, "rec_id long, batch_no int, smiles string")).collect()}
        live.append(held.catalog().count())
    later = [(900, 9, "C1CCCC1C1CCCC1"), (901, 9, "ClCCC"), (902, 9, "BrCCC"), (903, 9, "CCO")]
    got = {tuple(r) for r in held.add(spark.createDataFrame(later, "rec_id long, batch_no int, smiles string")).collect()}
    assert found == {p for p in FOUND if p[1] != 700} and got == {(102, 900), (301, 901), (1, 903)}
    assert max(live) < 2 * S.COMPACT_AT and len({r["segment"] for r in held.catalog().collect()}) < len(batches)
    assert held.add(spark.createDataFrame([], "rec_id long, batch_no int, smiles string")).count() == 0
    held.vacuum()
    kept = {p.name for p in (tmp_path / "history").iterdir() if p.name.startswith("segment=")}
    assert kept == {f"segment={r['segment']}" for r in held.catalog().collect()}
    again = S.History(spark, str(tmp_path / "history"))
    assert {tuple(r) for r in again.add(spark.createDataFrame([(950, "CCC[Br]")], "rec_id long, smiles string")).collect()} == {(902, 950)}


def test_live_segments_grow_with_the_logarithm():
    sizes: list[int] = [1000]
    most = 0
    for n in range(500):
        sizes.append(1 + n % 7)
        while due := S._due(sizes):
            sizes = [x for i, x in enumerate(sizes) if i not in due] + [sum(sizes[i] for i in due)]
        most = max(most, len(sizes))
    assert most <= (S.COMPACT_AT - 1) * (1 + S._tier(5000)) and sum(sizes) == 1000 + sum(1 + n % 7 for n in range(500))


def test_ids_out_of_the_order_of_batches(spark):
    rows = [(900, 1, "CCCN"), (800, 2, "NCCC"), (850, 3, "CCCN"), (700, None, "C(CC)N"), (950, 1, "CCCP"), (960, 7, "PCCC")]
    b = spark.createDataFrame(rows, "rec_id long, batch_no int, smiles string")
    h = spark.createDataFrame([(1, "O")], "mol_id long, smiles string")
    assert {tuple(r) for r in S.repeats(h, b).collect()} == {(700, 800), (700, 850), (700, 900), (950, 960)}


def test_a_graph_that_beams_do_not_serve_is_searched_exhaustively(monkeypatch):
    monkeypatch.setattr(S, "MAX_BEAM", 1)
    monkeypatch.setattr(S, "ENTRIES", 2)
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 40, (3000, S.DIMENSIONS)).astype(np.float32), axis=0)
    g = S.SmallWorld(x, beam=1)
    g.links[:] = -1  # no way to anything
    assert g.tune() == 1.0 and g.beam == 0
    ids, dist = g.search(x)
    assert (dist[:, 0] == 0).all() and (ids[:, 0] == np.arange(len(x))).all()


def test_recall_counts_exactly(spark):
    h = spark.createDataFrame(HISTORY, "mol_id long, smiles string")
    b = spark.createDataFrame(BATCHES, "rec_id long, batch_no int, smiles string")
    r = S.recall(h, b).first()
    assert (r["n_true"], r["n_found"], r["n_wrong"], r["share_lost"]) == (len(FOUND), len(FOUND), 0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_tiny_graphs(n):
    g = S.SmallWorld(np.eye(max(n, S.DIMENSIONS), S.DIMENSIONS, dtype=np.float32)[:n])
    assert g.tune() == 1.0
    assert (g.search(g.vectors)[1][:, 0] < 1e-3).all()


def test_very_long_molecules_are_near_themselves():
    rng = np.random.default_rng(3)
    vectors = rng.multinomial(24_000, np.full(S.DIMENSIONS, 1 / S.DIMENSIONS), 64).astype(np.float32)
    vectors[:, :4] += 6000  # a few frequent environments
    d = S.SmallWorld._exact(vectors, vectors)
    assert (np.diag(d) == 0).all() and (S.SmallWorld(vectors).search(vectors)[1][:, 0] == 0).all()
