from __future__ import annotations

import numpy as np

from chemlattice.functions.canon import mix
from chemlattice.llm import bloom


def _hashes(rng, n):
    return [rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2)]


def test_chain_grows_and_keeps_its_bound():
    rng = np.random.default_rng(1)
    chain = bloom.Chain(1e-3, first=256)
    h1, h2 = _hashes(rng, 20000)
    assert chain.seen(h1, h2).mean() < 1e-3
    assert len(chain.layers) > 3
    assert chain.bound < 1e-3
    assert chain.seen(h1, h2).all(), "no false negatives"
    g1, g2 = _hashes(rng, 50000)
    assert chain.contains(mix(g1), mix(g2)).mean() < 1.2e-3


def test_chain_with_hashes_of_one_remainder():
    rng = np.random.default_rng(2)
    h1, h2 = _hashes(rng, 60000)
    h1 = h1 // np.uint64(24) * np.uint64(24)
    chain = bloom.Chain(1e-5)
    assert sum(chain.seen(a, b).sum() for a, b in zip(np.split(h1, 12), np.split(h2, 12))) <= 5
    assert all(x.set <= 0.52 * x.m for x in chain.layers)


def test_order_repeats_nulls_and_second_deliveries(spark):
    rows = [(1, "C x"), (2, "C"), (3, None), (4, ""), (5, "N\tlabel"), (6, "c"), (6, "c"), (7, "N"), (9, "O"), (8, "O"), (None, "O"), (None, "O")]
    lookups = spark.createDataFrame(rows, "lookup_id long, smiles string").repartition(3)
    history = spark.createDataFrame([("N", 1), (None, 1), ("N", 2)], "smiles string, lookup_id int")
    got = sorted(r[0] for r in bloom.seen_before(lookups, history).collect())
    assert got == [2, 5, 7, 9]


def test_many_rows_against_exact(spark):
    lookups = spark.range(150000).selectExpr("id AS lookup_id", "concat('k', pmod(hash(id), 90000)) AS smiles", "1 AS at").repartition(5)
    history = spark.range(60000).selectExpr("concat('k', id * 3) AS smiles")
    out = bloom.error_share(lookups, history, shards=6).collect()[0]
    assert out.n_missed == 0 and out.n_false_seen <= 3 and out.n_lookups == 150000


def test_hot_key_and_state_of_an_earlier_call(spark):
    first = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "lookup_id long, smiles string")
    out = bloom.answers(first, None, shards=4, keep_state=True).cache()
    assert out.where("seen").count() == 199
    state = out.where("layer is not null")
    later = spark.createDataFrame([(1000, "hot"), (1001, "k0"), (1002, "new"), (1003, "new")], "lookup_id long, smiles string")
    got = {r["at"]: r["seen"] for r in bloom.answers(later, None, state, shards=4).collect()}
    assert got[1000] and got[1001] and not got[1002] and got[1003]


def test_empty(spark):
    none = spark.createDataFrame([], "lookup_id long, smiles string")
    assert bloom.seen_before(none, none).count() == 0
