from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chemlattice.functions import fingerprints
from chemlattice.functions.graphs import graph_of
from chemlattice.session import partition_keys, shared_dir, spread, stage
from chemlattice.sources import sinks
from chemlattice.sources.molecules import edges_by_length, graph_text_column, numbered, parse_graph_text, read_molecules
from chemlattice.streaming import ingest


def test_partition_keys_go_to_partitions_of_their_own(spark):
    keys = partition_keys(spark, 13)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13, "k")
    assert sorted(r[0] for r in df.select(F.spark_partition_id()).collect()) == list(range(13))


def test_stage_and_spread(spark):
    assert shared_dir(spark)
    df = stage(spark.range(100), parts=5)
    assert df.count() == 100 and len(df.inputFiles()) == 5
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_numbers_are_dense_and_in_order(spark):
    df = numbered(spark.range(0, 1000, 1, 7), keep=True)
    assert [(r["id"], r["position"]) for r in df.orderBy("id").collect()] == [(i, i) for i in range(1000)]
    assert numbered(spark.range(0)).count() == 0


def test_graph_text_by_expressions(spark):
    rows = [("{[{6},{6}],[{1,2,[6,6]},{1,0,[]}]}",), ("{[{6}],[]}",), ("nothing",), (None,)]
    df = parse_graph_text(spark.createDataFrame(rows, "graph_text string"))
    got = {r["graph_text"]: r for r in df.select("graph_text", graph_text_column().alias("w"), edges_by_length().alias("e")).collect()}
    assert got[rows[0][0]]["w"] == rows[0][0] and got[rows[1][0]]["w"] == rows[1][0]
    assert got["nothing"]["w"] is None and got[None]["w"] is None
    assert [e["target"] for e in got[rows[0][0]]["e"]] == [2, 0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "mol_id long, note string")
    sinks.write_hits(df, str(tmp_path / "hits"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "hits")).collect()) == ["1\t", "2\tx"]
    sinks.write_smiles(spark.createDataFrame([("C", "methane"), ("N", None), (None, "x")], "smiles string, title string"), str(tmp_path / "out.smi"))
    assert sorted((r["smiles"], r["title"]) for r in read_molecules(spark, str(tmp_path / "out.smi")).collect()) == [("C", "methane"), ("N", "")]
    sinks.write_postings(spark.createDataFrame([(3, 1), (3, 2), (5, 1)], "bit int, mol_id long"), str(tmp_path / "p"))
    assert {(r["bit"], r["mol_id"]) for r in spark.read.schema("mol_id long, bit int").csv(str(tmp_path / "p")).collect()} == {(3, 1), (3, 2), (5, 1)}


def test_own_patterns():
    fingerprints.register_patterns("Own", [("C", 1), ("O", 0)])
    assert fingerprints.fingerprint_words("Own", graph_of("CO")) == [2]
    assert fingerprints.fingerprint_words("Own", graph_of("CCO")) == [3]
    assert "Own" in fingerprints.available_fingerprints()
    with pytest.raises(ValueError):
        fingerprints.register_patterns("Bad", [("C(", 0)])
    del fingerprints.REGISTRY["Own"]


def test_streams_with_watermarks(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("C", t), ("C x", t + dt.timedelta(minutes=1)), (None, t), ("N", t + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "smiles string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("smiles string, at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.first_in_time(stream(), "at").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["key"] for r in spark.table("firsts").collect()) == ["C", "N"]
    q = ingest.arrivals(stream(), "at").writeStream.outputMode("complete").format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n_records"], r["n_keys"]) for r in spark.table("arrivals").collect()) == [(1, 1), (3, 1)]
