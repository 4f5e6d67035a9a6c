from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chemlattice.functions import bits as B


def test_words_of_five_and_twenty_nine(spark):
    df = spark.createDataFrame([([5], [29])], "a array<long>, b array<long>")
    a, b = B.words("a", 64), B.words("b", 64)
    r = df.select(B.popcount(a).alias("a"), B.popcount(b).alias("b"), B.and_count(a, b).alias("i"), B.or_count(a, b).alias("u"), B.tanimoto(a, b).alias("t"), B.contains(b, a).alias("c"), B.contains(a, b).alias("d")).first()
    assert tuple(r) == (2, 4, 2, 4, 0.5, True, False)


def test_odd_arrays(spark):
    rows = [([-1, None, 3, 7],), ([],), (None,), ([1],), ([0, 0, 0],)]
    df = spark.createDataFrame(rows, "fp array<long>")
    w = B.words("fp", 192)
    got = df.select(B.popcount(w).alias("n"), B.tanimoto(w, w).alias("t"), *[s.alias(f"s{i}") for i, s in enumerate(B.segments(w, 2))]).collect()
    assert [r["n"] for r in got] == [66, 0, 0, 1, 0]
    assert [r["t"] for r in got] == [1.0, None, None, 1.0, None]
    assert [(r["s0"], r["s1"]) for r in got][:1] == [(64, 2)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 191), max_size=60))
def test_host_words_round_trip(bits):
    words = B.host_words(bits, 192)
    assert all(-(2**63) <= w < 2**63 for w in words)
    assert B.host_bits(words, 192) == sorted(set(bits))


def test_likeness_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63, (40, 3), dtype=np.int64) & rng.integers(-(2**63), 2**63, (40, 3), dtype=np.int64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, fp array<long>")
    q = x[0].tolist()
    w = B.words("fp", 192)
    got = {r["i"]: r["t"] for r in df.select("i", B.tanimoto(w, B.literals(q), B.popcount(w), F.lit(int(np.bitwise_count(x[0].view(np.uint64)).sum()))).alias("t")).collect()}
    u = x.view(np.uint64)
    for i in range(40):
        i_n, u_n = np.bitwise_count(u[i] & u[0]).sum(), np.bitwise_count(u[i] | u[0]).sum()
        assert got[i] == i_n / u_n


def test_signature_and_bits(spark):
    df = spark.createDataFrame([(B.host_words([0, 63, 64, 130], 192),)], "fp array<long>")
    w = B.words("fp", 192)
    r = df.select(B.signature(w, [63, 1, 130]).alias("s"), B.has_bit(w, 63).alias("h"), B.has_bit(w, 65).alias("n")).first()
    assert tuple(r) == (5, True, False)
