from __future__ import annotations

import numpy as np
import pytest

from chemlattice.functions import bits as B
from chemlattice.operators import search as S
from chemlattice.operators import stats

SCHEMA = "mol_id long, fp_name string, n_bits int, fingerprint array<long>, bits int, score string, query_id string"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    base = [set(rng.choice(192, 14, replace=False).tolist()) for _ in range(12)]
    sets = {}
    for i in range(150):
        s = set(base[i % 12])
        for x in rng.choice(192, rng.integers(0, 4)):
            s ^= {int(x)}
        sets[i] = s
    sets[150], sets[151], sets[152] = set(), set(range(192)), set(base[0])
    return sets


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, "K", 192, B.host_words(s, 192), 0, "x", "y") for i, s in data.items()]
    rows += [(900, "K", 192, None, 0, "", ""), (None, "K", 192, [1], 0, "", ""), (901, "other", 64, [3], 0, "", "")]
    rows += rows[:20]
    rows.append((902, "K", 192, B.host_words(data[3], 192) + [0], 0, "", ""))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else None


def _all(data):
    return data | {902: data[3]}


@pytest.mark.parametrize("strategy", list(S.STRATEGIES))
@pytest.mark.parametrize("t", [0.0, 0.3, 0.75, 1.0])
def test_similarity(table, data, strategy, t):
    q = S.Query(B.host_words(data[3], 192), 192, "K")
    got = {r["mol_id"]: r["score"] for r in S.similar(table, q, t, strategy=strategy).collect()}
    assert got == {i: x for i, s in _all(data).items() if (x := _like(s, data[3])) is not None and x >= t}
    strict = {r["mol_id"] for r in S.similar(table, q, t, strict=True, strategy=strategy).collect()}
    assert strict == {i for i, s in _all(data).items() if (x := _like(s, data[3])) is not None and x > t}


@pytest.mark.parametrize("strategy", list(S.STRATEGIES))
def test_screening(table, data, strategy):
    for want in (set(), set(list(data[3])[:4]), data[3], {0, 191, 64}):
        q = S.Query(B.host_words(want, 192), 192, "K")
        assert {r["mol_id"] for r in S.screen(table, q, strategy).collect()} == {i for i, s in _all(data).items() if want <= s}


def test_order_limits_and_top(table, data):
    q = S.Query(B.host_words(data[3], 192), 192, "K")
    every = sorted(((-_like(s, data[3]), i) for i, s in _all(data).items()))
    assert [(r["mol_id"], r["score"]) for r in S.similar(table, q, 0.0, top=7).collect()] == [(i, -x) for x, i in every[:7]]
    assert [r["mol_id"] for r in S.similar(table, q, 0.0, limit=3).collect()] == [0, 1, 2]
    assert S.screen(table, S.Query([], 192, "K"), limit=4).count() == 4


def test_empty_query_and_table(table, data):
    assert S.similar(table, S.Query([], 192, "K"), 0.0).where("mol_id = 150").count() == 0
    assert S.similar(table.limit(0), S.Query([1], 192, "K"), 0.0).count() == 0
    assert S.screen(table.limit(0), S.Query([1], 192, "K")).count() == 0
    with pytest.raises(ValueError):
        S.screen(table, S.Query([1], 192, "K"), "nothing")


def test_several_kinds(spark):
    df = spark.createDataFrame([(1, "a", 64, [7]), (1, "b", 64, [1]), (2, "a", 64, [7]), (3, "b", 64, [1])], "mol_id long, fp_name string, n_bits int, fingerprint array<long>")
    q = [S.Query([7], 64, "a"), S.Query([1], 64, "b")]
    assert sorted(tuple(r) for r in S.similar_any(df, q, 0.9).collect()) == [(1, 1.0, "a"), (1, 1.0, "b"), (2, 1.0, "a"), (3, 1.0, "b")]
    assert sorted(r[0] for r in S.similar_any(df, q, 0.9, combine="any").collect()) == [1, 2, 3]
    assert [r[0] for r in S.similar_any(df, q, 0.9, combine="all").collect()] == [1]
    assert [r[0] for r in S.screen_all(df, q).collect()] == [1]
    with pytest.raises(ValueError):
        S.similar_any(df, q, 0.9, combine="none")


def test_indexes_agree_with_brute_force(table, data):
    bits = S.splitting_bits(table, 4, "K", 192)
    signed = S.with_signature(table, bits, 192).cache()
    index = S.postings(table, "K").cache()
    for want in (set(), set(list(data[3])[:3]), data[7], {0, 1, 2, 3}):
        q = S.Query(B.host_words(want, 192), 192, "K")
        brute = {r["mol_id"] for r in S.screen(table, q, "brute").collect()}
        assert {r["mol_id"] for r in S.screen_signature(signed, q, bits).collect()} == brute
        assert {r["mol_id"] for r in S.screen_postings(table, index, q).collect()} == brute
    counts = {r["bit"]: (r["n_set"], r["n_clear"], r["imbalance"]) for r in S.bit_counts(table, "K", 192).collect()}
    n = len(_all(data)) + 0
    for b in range(192):
        k = sum(b in s for s in data.values()) + (b in data[3])
        assert counts[b][0] == k and counts[b][2] == abs(counts[b][0] - counts[b][1])
    assert n <= counts[0][0] + counts[0][1] <= n + 1


def test_batches(spark, table, data):
    queries = spark.createDataFrame([(i, B.host_words(data[i], 192)) for i in (0, 3, 150, 151)] + [(9, [])], "query_id int, fingerprint array<long>")
    got = {(r[0], r[1]) for r in S.similar_batch(table, queries, 0.6, "K", 192).collect()}
    assert got == {(q, i) for q in (0, 3, 151) for i, s in _all(data).items() if s and _like(s, data[q]) >= 0.6}
    got = {(r[0], r[1]) for r in S.screen_batch(table, queries, "K", 192).collect()}
    assert got == {(q, i) for q, w in ((0, data[0]), (3, data[3]), (150, set()), (151, data[151]), (9, set())) for i, s in _all(data).items() if w <= s}
    with pytest.raises(ValueError):
        S.screen_batch(table, queries, "K", 192, most=2).count()
    assert S.similar_batch(table, queries.limit(0), 0.6, "K", 192).count() == 0


def test_many_queries_run_in_blocks(spark, table, data, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 30, raising=False)
    monkeypatch.setattr(S, "FEW", 4)
    asked = sorted(i for i, s in data.items() if s)[:100]
    queries = spark.createDataFrame([(i, B.host_words(data[i], 192)) for i in asked], "query_id int, fingerprint array<long>")
    similar = S.similar_batch(table, queries, 0.6, "K", 192)
    assert {(r[0], r[1]) for r in similar.collect()} == {(q, i) for q in asked for i, s in _all(data).items() if s and _like(s, data[q]) >= 0.6}
    screened = S.screen_batch(table, queries, "K", 192)
    assert {(r[0], r[1]) for r in screened.collect()} == {(q, i) for q in asked for i, s in _all(data).items() if data[q] <= s}
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") >= 3 for df in (similar, screened))


def test_plans_push_the_kind_and_stay_generated(spark, tmp_path, table, data):
    table.write.parquet(str(tmp_path / "t"))
    df = S.similar(spark.read.parquet(str(tmp_path / "t")), S.Query(B.host_words(data[3], 192), 192, "K"), 0.8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(fp_name,K)" in plan and "ReadSchema: struct<mol_id:bigint,fp_name:string,fingerprint:array<bigint>>" in plan
    assert "Python" not in plan


def test_running_totals(spark):
    rows = [(i * 7 % 100, float(i)) for i in range(100)] + [(50, 1.0), (50, None)]
    got = stats.running_totals(spark.createDataFrame(rows, "k long, v double").repartition(4), "k", ["v"], parts=5).collect()
    assert len(got) == 102
    for r in got:
        assert r["total_v"] == sum(v or 0 for k, v in rows if k <= r["k"])
    assert stats.running_totals(spark.createDataFrame([], "k long, v double"), "k", ["v"]).count() == 0


def test_bytes():
    assert stats.readable_bytes(999) == "999 bytes" and stats.readable_bytes(1500) == "1.5 KB"


def test_bounds_reach_the_scan_of_an_index(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "Path", 1024, B.host_words(rng.choice(1024, 1 + i % 200, replace=False).tolist(), 1024), -1) for i in range(3000)]
    t = spark.createDataFrame(rows + rows[:5] + [(None, "Path", 1024, [1], 1), (7000, "Path", 1024, None, 1)], "mol_id long, fp_name string, n_bits int, fingerprint array<long>, bits int")
    S.indexed(t, "Path", 1024).write.parquet(str(tmp_path / "index"))
    held = spark.read.parquet(str(tmp_path / "index"))
    assert held.count() == 3000
    q = S.Query(rows[150][3], 1024)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for n in (0.3, 0.7):
        got = S.similar(held, q, n, counted="n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(n" in plan and "LessThanOrEqual(n" in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.similar(t, q, n, strategy="brute").collect()))
    assert "GreaterThanOrEqual(n" in S.screen(held, q, counted="n")._jdf.queryExecution().executedPlan().toString()


def test_a_query_wider_than_the_fingerprint_raises():
    with pytest.raises(ValueError):
        S.Query([0, 0, 0, 1], 192)
    assert S.Query([1, 0, 0, 0], 192).bits == [0] and S.Query([1], 192).words == [1, 0, 0]
