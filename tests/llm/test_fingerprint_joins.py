from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chemlattice.functions.bits import host_words
from chemlattice.llm import multi_index, setjoin
from chemlattice.llm.fingerprints import classes, valid
from chemlattice.session import stage

SCHEMA = "mol_id long, fp_name string, n_bits int, fingerprint array<long>, rep long, part int"


def _data(seed, n, large=False, hot=0):
    rng = np.random.default_rng(seed)
    base = [rng.choice(1024, 40 if not large or i % 2 else 300, replace=False) for i in range(n // 8)]
    sets = {}
    for i in range(n):
        s = set(base[i % len(base)].tolist())
        for x in rng.choice(1024, rng.integers(0, 8)):
            s ^= {int(x)}
        sets[int(i * 3 + 1)] = s
    for i in range(hot):
        sets[50_000 + i] = set(base[0].tolist())
    sets[10**7], sets[10**7 + 1], sets[10**7 + 2] = set(), set(range(1024)), {5}
    return sets


def _table(spark, sets):
    rows = [(i, "Path", 1024, host_words(s, 1024), 7, 7) for i, s in sets.items()]
    i, s = next(iter(sets.items()))
    rows += [(i, "Path", 1024, [*host_words(s, 1024), 0], 1, 1), (10**8, "Path", 1024, None, 1, 1), (None, "Path", 1024, [1], 1, 1), (10**8, "Keys", 192, [1, 2, 3], 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _truth(sets, k=5, least=0.6, t=0.8):
    part = {i: s for i, s in sets.items() if 0 < len(s) < 1024}
    ids = np.array(sorted(part))
    x = np.zeros((len(ids), 1024), np.float32)
    for r, i in enumerate(ids):
        x[r, list(part[i])] = 1
    n = x.sum(axis=1)
    both = x @ x.T
    like = both.astype(np.float64) / (n[:, None] + n[None] - both)
    np.fill_diagonal(like, -1)
    near = set()
    for r in range(len(ids)):
        for c in np.lexsort((ids, -like[r]))[:k]:
            if like[r, c] >= least:
                near.add((min(ids[r], ids[c]), max(ids[r], ids[c])))
    a, b = np.nonzero(like >= t)
    return near, {(ids[i], ids[j]) for i, j in zip(a, b) if i < j}, {int(ids[r]): int((like[r] >= t).sum()) for r in range(len(ids))}


@pytest.mark.parametrize(("seed", "n", "large", "hot"), [(1, 800, False, 0), (2, 500, True, 0), (3, 300, False, 150)])
def test_pairs_and_neighbours(spark, seed, n, large, hot):
    sets = _data(seed, n, large, hot)
    near, pairs, links = _truth(sets)
    t = _table(spark, sets)
    assert {tuple(r) for r in setjoin.similar_pairs(t).collect()} == pairs
    got = {tuple(r) for r in multi_index.neighbour_pairs(t).collect()}
    assert len(got & near) >= 0.98 * len(near) and len(got & near) >= 0.98 * len(got)
    assert {r["mol_id"]: r["n_links"] for r in setjoin.linked_rows(t).collect()} == links


@pytest.mark.parametrize("threshold", [0.5, 0.95, 1.0])
def test_other_thresholds(spark, threshold):
    sets = _data(5, 200, True)
    assert {tuple(r) for r in setjoin.similar_pairs(_table(spark, sets), threshold).collect()} == _truth(sets, t=threshold)[1]


def test_hot_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_ROWS", 10)
    sets = _data(6, 400)
    for i, s in sets.items():  # one rare token in a third of all sets
        if i % 3 == 0 and 0 < len(s) < 1024:
            s.add(1000)
    assert {tuple(r) for r in setjoin.similar_pairs(_table(spark, sets)).collect()} == _truth(sets)[1]


def test_deep_lists(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SHORT", 1)
    sets = _data(8, 150)
    assert {tuple(r) for r in setjoin.similar_pairs(_table(spark, sets)).collect()} == _truth(sets)[1]


@pytest.mark.parametrize(("threshold", "blocks"), [(0.8, False), (0.8, True), (0.5, False)])
def test_small_sets_in_crowded_lists(spark, monkeypatch, threshold, blocks):
    if blocks:
        monkeypatch.setattr(setjoin, "LIST_ROWS", 100)
    core = [1000, 1001, 1002, 1003]  # more frequent than the tokens beside them
    sets = {1: set(core), 2: {*core, 1004}, 3: set(core[:3]), 4: set(core[:2])}
    for i in range(300):
        sets[10 + i] = {i, *core}
        sets[1000 + i] = {i, *core, 1004}
        sets[2000 + i] = {300 + i, 600 + i, *core[:3]}
    assert {tuple(r) for r in setjoin.similar_pairs(_table(spark, sets), threshold).collect()} == _truth(sets, t=threshold)[1]
    assert {r["mol_id"]: r["n_links"] for r in setjoin.linked_rows(_table(spark, sets), threshold).collect()} == _truth(sets, t=threshold)[2]


def _crowded():
    """Sets of which many share seven rare tokens, so that lists stay long at any depth."""
    sets = _data(6, 300)
    rng = np.random.default_rng(0)
    for i in range(60):
        sets[20_000 + i] = {*range(1000, 1007), *range(30), *rng.choice(np.arange(100, 900), 4, replace=False).tolist()}
    first = {frozenset(s): i for i, s in sorted(sets.items(), reverse=True)}
    return {i: set(s) for s, i in first.items()}


def test_lists_are_joined_in_waves_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_ROWS", 10)
    monkeypatch.setattr(setjoin, "HELD", 1)
    monkeypatch.setattr(setjoin, "STEP", 50)
    sets = _crowded()
    written = setjoin.ordered(stage(classes(valid(_table(spark, sets)))))
    tree = setjoin._tree(written, 0.8)
    total = tree.place(0.8)
    assert tree.divided.any() and tree.blocks.max() > 1 and tree.depth.max() == setjoin.DEPTH
    batch = pa.Table.from_pandas(written.toPandas(), schema=setjoin._SETS, preserve_index=False).combine_chunks().to_batches()[0]

    def sent(lo, hi):
        return pa.Table.from_batches(setjoin._send(tree, 0.8, lo, hi)(iter([batch])))

    keys = ("node", "a", "b", "rep")
    rows = lambda t: Counter(zip(*(t[k].to_pylist() for k in keys)))
    whole, apart, pairs, size = rows(sent(0, total)), Counter(), set(), total // 6 + 1
    assert max(whole.values()) == 1
    lists = Counter(k[:3] for k in whole)
    for lo in range(0, total, size):
        wave = sent(lo, lo + size)
        assert wave.num_rows <= size + max(lists.values())
        apart += rows(wave)
        for b in setjoin._join(tree, 0.8)(iter(wave.sort_by([(k, "ascending") for k in keys[:3]]).to_batches(max_chunksize=7))):
            found = list(zip(b["rep_a"].to_pylist(), b["rep_b"].to_pylist()))
            assert len(set(found)) == len(found) and not pairs & set(found)
            pairs |= set(found)
    assert apart == whole and pairs == _truth(sets)[1]


def test_waves_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "WAVE_ROWS", 1)
    sets = _data(6, 300)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in (b.toString() for b in _each(disk.getAllBlocks())) if f.startswith("shuffle_")}
    table, before = _table(spark, sets), held()
    named, pairs = setjoin._linked(table, 0.8)
    tables = 3  # the sums of the counting passes, a few rows each
    assert len({f.split("_")[1] for f in held() - before}) <= tables
    assert len(pairs.inputFiles()) > 4
    assert {tuple(r) for r in setjoin.expand(named, pairs).collect()} == _truth(sets)[1]


def _each(found):
    return (found.apply(i) for i in range(found.size()))


@pytest.mark.parametrize("seed", range(3))
def test_packed_tokens(seed):
    rng = np.random.default_rng(seed)
    rows = [[], [0], [1023], [254], [255], [256], [0, 255, 510, 766, 1023], list(range(1024)), []] + [sorted(rng.choice(1024, n, replace=False).tolist()) for n in rng.integers(0, 60, 50)]
    sizes = np.array([len(x) for x in rows])
    packed = setjoin._packed(np.concatenate(rows).astype(np.int16), sizes)
    for part, want in ((packed, rows), (packed.slice(3, 20), rows[3:23]), (packed.slice(0, 1), rows[:1]), (packed.take(pa.array([4, 4, 1])), [rows[4], rows[4], rows[1]])):
        tokens, n = setjoin._unpacked(part)
        assert n.tolist() == [len(x) for x in want] and tokens.tolist() == [y for x in want for y in x]


def test_hot_centroid_is_split(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PART_ROWS", 20)
    sets = _data(9, 400)
    near = _truth(sets)[0]
    got = {tuple(r) for r in multi_index.neighbour_pairs(_table(spark, sets)).collect()}
    assert len(got & near) >= 0.98 * len(near)


def test_recall_and_exact_search(spark):
    r = multi_index.recall(_table(spark, _data(4, 400)), every=1).first()
    assert r["n_true"] > 1000 and 0 <= r["share_lost"] < 0.05


def test_recall_counts_copies_as_molecules(spark):
    sets = _data(4, 300, hot=60)
    every = 4
    part = {i: s for i, s in sets.items() if 0 < len(s) < 1024}
    like = lambda a, b: len(a & b) / len(a | b)
    asked = [i for i in part if i % every == 0]
    n = sum(min(5, sum(o != i and like(part[i], s) >= 0.6 for o, s in part.items())) for i in asked)
    r = multi_index.recall(_table(spark, sets), every=every).first()
    assert r["n_true"] == n and 0.95 * n <= r["n_found"] <= n


def _visit(d0, d1, k, counts, enough, **options):
    dist = [np.array([d0], np.float32), np.array([d1], np.float32)]
    q, cells = multi_index.traverse(dist, k, counts, enough, **options)
    assert not q.any()
    return cells.tolist()


def test_heap_order(monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_CELLS", 1)
    counts = np.ones(16, np.int32)
    cells = _visit([0.0, 1.0, 2.5, 9.0], [0.0, 2.0, 3.0, 4.0], 4, counts, 16)
    sums = [[0.0, 1.0, 2.5, 9.0][c // 4] + [0.0, 2.0, 3.0, 4.0][c % 4] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == list(range(16))
    counts[:] = 0
    counts[5] = 3
    assert _visit([0.0, 1.0, 5.0, 5.0], [0.0, 1.0, 5.0, 5.0], 4, counts, 1) == [5]


@pytest.mark.parametrize("reach", [1, 2, 8])
def test_far_cells_are_reached(reach):
    """Near centroids that hold nothing don't end a search."""
    counts = np.zeros(64, np.int32)
    counts[[63, 7, 56]] = 5
    d = list(range(8))
    assert _visit(d, d, 8, counts, 15, reach=reach) == [7, 56, 63]
    many = [np.tile(np.arange(8, dtype=np.float32), (50, 1))] * 2
    counts[:50] = 1
    q, cells = multi_index.traverse(many, 8, counts, 20, reach=reach)
    assert np.bincount(q).tolist() == [24] * 50 or (np.bincount(q, weights=counts[cells]) >= 20).all()


def test_empty(spark):
    t = _table(spark, {1: {1}}).limit(0)
    assert setjoin.similar_pairs(t).count() == 0
    assert multi_index.neighbour_pairs(t).count() == 0
    assert setjoin.linked_rows(t).count() == 0
    one = _table(spark, {1: {1, 2}})
    assert multi_index.neighbour_pairs(one).count() == 0 and setjoin.similar_pairs(one).count() == 0
