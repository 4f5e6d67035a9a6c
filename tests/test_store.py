from __future__ import annotations

import io

import pytest

from chemlattice import service, store
from chemlattice.functions.graphs import graph_of, is_subgraph
from chemlattice.operators import stats, substructure
from chemlattice.sources.molecules import with_molecules
from chemlattice.store import MoleculeStore, RecordingHandler
from chemlattice.streaming import ingest

# Four molecules with their titles, of which the counts below are known.
FOUR = """[Cl-].OC(=O)C(CS)[NH3+] 9976
CC(C)CCC[C@@H](C)[C@H]1CCC2C3CC=C4CC(CC[C@@]4(C)C3CC[C@@]12C)OC(=O)c1ccccc1 9978
CCCC(=O)OC1CC[C@]2(C)C(=CCC3C4CC[C@H]([C@H](C)CCCC(C)C)[C@]4(C)CCC23)C1 9980
CCCCCCCCCC(=O)OC1CC[C@]2(C)C(=CCC3C2CC[C@@]2(C)[C@H](CCC32)[C@H](C)CCCC(C)C)C1 9982
"""


@pytest.fixture(scope="module")
def four(tmp_path_factory):
    p = tmp_path_factory.mktemp("in") / "four.smi"
    p.write_text(FOUR)
    return str(p)


def test_end_to_end(spark, tmp_path, four):
    s = MoleculeStore(spark, str(tmp_path / "db"))
    assert not s.is_loaded and s.count() == 0
    with pytest.raises(FileNotFoundError):
        s.molecules()
    s.create(["GraphPath", "Pattern"])
    with pytest.raises(FileExistsError):
        s.create()
    assert s.count() == 0 and s.exact("C").count() == 0
    assert s.insert_file(four) == (4, 4)
    again = MoleculeStore(spark, str(tmp_path / "db"))
    assert again.count() == 4 and again.fingerprints() == ["GraphPath", "Pattern"]
    assert again.screen("CCC", "GraphPath").count() == 4
    assert again.screen("CCC", ["GraphPath", "Pattern"], limit=2).count() == 2
    assert again.screen("CCC", "Unknown").count() == 0
    assert again.substructure("C").count() == 4
    assert [r["mol_id"] for r in again.quick_substructure("c1ccccc1").collect()] == [1]
    assert again.insert_file(four) == (4, 0)
    assert again.count() == 4
    assert again.insert_file(four, unique=False) == (4, 4)
    assert [r["mol_id"] for r in again.exact("OC(=O)C(CS)[NH3+].[Cl-]").collect()] == [0, 4]
    assert again.exact("OC(=O)C(CS)[NH3+].[Cl-]", last=True).first()["mol_id"] == 4
    assert [r["title"] for r in again.molecules().orderBy("mol_id").collect()] == ["9976", "9978", "9980", "9982"] * 2
    best = again.similar("[Cl-].OC(=O)C(CS)[NH3+]", 0.9).collect()
    assert {(r["mol_id"], r["fp_name"]) for r in best} == {(0, "GraphPath"), (0, "Pattern"), (4, "GraphPath"), (4, "Pattern")} and best[0]["score"] == 1.0
    again.add_fingerprint("AtomPair")
    again.add_fingerprint("Pattern")
    assert again.fingerprints() == ["GraphPath", "Pattern", "AtomPair"]
    assert again.fingerprint_table(["AtomPair"]).count() == 8
    with pytest.raises(ValueError):
        again.quick_substructure("C", "AtomPair")
    info = {r["item"]: r["value"] for r in again.information().collect()}
    assert info["molecules"] == "8" and info["bits of GraphPath"] == "1024"
    assert len(again.record(2).first()["fingerprints"]) == 3
    assert again.record(77).count() == 0
    plan = again.similar("CCO", 0.8, "GraphPath")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bits" in plan and "fp_name=AtomPair" not in plan


def test_broken_insert_is_not_seen(spark, tmp_path, four):
    s = MoleculeStore(spark, str(tmp_path / "db"))
    s.create()
    s.insert_file(four)
    m = s.molecules()
    m.withColumn("mol_id", m["mol_id"] + 10).drop("batch").write.parquet(str(tmp_path / "db/molecules/batch=1"))
    (tmp_path / "db/molecules/batch=1/_SUCCESS").unlink()
    assert s.count() == 4


def test_further_columns(spark, tmp_path, four):
    s = MoleculeStore(spark, str(tmp_path / "db"), columns={"heavy": lambda m: m["mol_weight"] > 300})
    s.create()
    s.insert_file(four)
    assert [r["heavy"] for r in s.molecules().orderBy("mol_id").collect()] == [False, True, True, True]


def test_script_functions(spark, tmp_path, four):
    s = store.open_database(spark, str(tmp_path / "db"))
    s.create()
    s.insert_file(four)
    assert store.exact_structure_search("[Cl-].OC(=O)C(CS)[NH3+]") == 0
    assert store.exact_structure_search("CCO") is None
    assert store.similarity_search("[Cl-].OC(=O)C(CS)[NH3+]", 0.95) == [(0, 1.0)]
    s.screen("C", "Nothing").count()
    assert "Nothing" in store.errors() and store.errors() == "[]"


def test_recording_handler():
    import logging

    second = RecordingHandler(keep=("INFO",))
    first = RecordingHandler(then=second)
    log = logging.getLogger("chemlattice.test")
    log.setLevel(logging.INFO)
    log.addHandler(first)
    log.info("a")
    log.warning("b")
    assert first.counts == {"INFO": 1, "WARNING": 1} and first.drain() == [("WARNING", "b")] and first.drain() == []
    assert second.records == [("INFO", "a")]


def test_store_joins_both_writings_of_a_ring(spark, tmp_path):
    rows = spark.createDataFrame([(0, "c1ccccc1", "a"), (1, "C1=CC=CC=C1", "b"), (2, "C1CCCCC1", "c"), (3, "[NH4+]", "d"), (4, "N", "e"), (5, None, "f"), (6, "C(", "g")], "position long, smiles string, title string")
    s = MoleculeStore(spark, str(tmp_path / "db"))
    s.create(["Pattern"])
    assert s.insert(rows) == (5, 4) and s.insert(rows) == (5, 0)
    assert [r["mol_id"] for r in s.exact("C1=CC=CC=C1").collect()] == [0]
    assert [r["mol_id"] for r in s.substructure("C1=CC=CC=C1").collect()] == [0]
    w = MoleculeStore(spark, str(tmp_path / "w"), aromatic="written")
    w.create(["Pattern"])
    assert w.insert(rows) == (5, 5) and [r["n_inserted"] for r in w.log().collect()] == [5]
    s.add_fingerprint("Layered")
    s.add_fingerprint("Layered")
    assert {r["fp_name"]: r["gen"] for r in s.catalog().collect()} == {"Pattern": 0, "Layered": 1}
    assert s.fingerprint_table(["Layered"]).count() == 4


def test_stream_merges_what_it_has_seen(spark, tmp_path):
    known = spark.createDataFrame([("C",)], "smiles string")
    for i in range(7):
        spark.createDataFrame([(10 * i + j, k) for j, k in enumerate(["C", f"N{i}", f"N{i - 1}", f"O{i // 2}"])], "rec_id long, smiles string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec_id long, smiles string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest_stream(stream, known, str(tmp_path / "out"), str(tmp_path / "cp"), shards=4, every=3)
    got = sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted({f"N{i}" for i in range(-1, 7)} | {f"O{i // 2}" for i in range(7)})
    assert (tmp_path / "out_seen" / "upto=6" / "_SUCCESS").exists()


def test_matchers_agree(spark):
    smiles = ["CC(=O)NC", "NC=O", "c1ccccc1C(N)=O", "CCO", "C1CC1", "C1CCC1", None, "bad(", "N", "O=CNC=O"]
    df = with_molecules(spark.createDataFrame(list(enumerate(smiles)), "mol_id long, smiles string")).cache()
    bonds = substructure.bond_table(df)
    for q in ("NC=O", "CC", "C1CC1", "CCC"):
        want = {i for i, s in enumerate(smiles) if (g := graph_of(s)) and is_subgraph(graph_of(q), g)}
        assert {r["mol_id"] for r in substructure.match(df, q).collect()} == want
        assert {r["mol_id"] for r in substructure.match_relational(bonds, q).collect()} == want
        held = substructure.with_fingerprints(df, ["GraphPath", "Pattern"])
        assert {r["mol_id"] for r in substructure.quick(held.where("atoms is not null"), q).collect()} == want
    batch = substructure.match_batch(df, spark.createDataFrame([(1, "NC=O"), (2, "(("), (3, None)], "query_id int, smiles string"))
    assert {tuple(r) for r in batch.collect()} == {(1, 0), (1, 1), (1, 2), (1, 9)}
    for bad in ("C(", "", None):
        with pytest.raises(ValueError):
            substructure.match(df, bad)
    with pytest.raises(ValueError):
        substructure.match(df, "C", "unknown")
    assert substructure.match(df.limit(0), "C").count() == 0
    hist = {r["n_atoms"]: r["n_molecules"] for r in stats.atom_histogram(df).collect()}
    assert hist[3] == 3 and hist[1] == 1
    degrees = {r["degree"]: r["n_vertices"] for r in stats.degree_histogram(df).collect()}
    assert degrees[0] == 1 and sum(degrees.values()) == sum(len(graph_of(s)[0]) for s in smiles if s and graph_of(s))
    c = stats.counters(df).first()
    assert c["n_graphs"] == 8 and c["n_kept"] + c["n_on_paths"] == c["n_vertices"]


def test_service():
    out = io.StringIO()
    service.serve(io.StringIO("FINGERPRINT\nFINGERPRINT Pattern\nFINGERPRINT None C\nhello\nFINGERPRINT Pattern C(\nFINGERPRINT Pattern C\nEXIT\nFINGERPRINT Pattern C\n"), out)
    lines = out.getvalue().splitlines()
    assert lines[:4] == [service.NO_NAME, service.NO_SMILES, service.NOT_VALID, service.NOT_READ]
    assert len(lines) == 5 and lines[4].endswith("1")
    service.serve(io.StringIO(""), out)
    assert service.bit_string([1, -(2**63)], 128) == "1" + "0" * 126 + "1"


def test_command_line(spark, tmp_path, four, capsys):
    db = str(tmp_path / "db")
    assert service.main([db, "-create", "-insert", four, "-info", "-query", "c1ccccc1"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert "4 read, 4 inserted" in said and said[-1] == "1"
    service.main(["-list-fingerprints"])
    assert "GraphPath" in capsys.readouterr().out


def test_stream_keeps_each_key_once(spark, tmp_path):
    known = spark.createDataFrame([("C x",), (None,)], "smiles string")
    rows = [(1, "C"), (2, "CC a"), (3, None), (4, ""), (5, "CC b"), (6, "N")]
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], "rec_id long, smiles string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("rec_id long, smiles string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest_stream(stream(), known, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["CC", "N"]
    spark.createDataFrame([(7, "N"), (8, "O")], "rec_id long, smiles string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_stream(stream(), known, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["CC", "N", "O"]


def test_insert_leaves_no_shuffled_molecules(spark, tmp_path):
    """What stays of shuffles is narrow: the counting passes' files, not those of whole molecules and fingerprints."""
    import os

    rows = spark.createDataFrame([(i, "C" * (i % 40 + 1) + "c1ccccc1" * (i % 3) + "O", str(i)) for i in range(3000)], "position long, smiles string, title string")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held() -> dict[str, int]:
        files = disk.getAllFiles()
        paths = [files.apply(i).getPath() for i in range(files.size())]
        return {p: os.path.getsize(p) for p in paths if os.path.basename(p).startswith("shuffle_") and os.path.exists(p)}

    before = held()
    s = MoleculeStore(spark, str(tmp_path / "s"))
    s.create(["Pattern"])
    assert s.insert(rows, unique=False) == (3000, 3000)
    s.add_fingerprint("Torsion")
    left = sum(n for p, n in held().items() if p not in before)
    assert left < 120_000, left


def test_stores_take_molecules_as_they_were_read_once(spark, tmp_path, monkeypatch):
    from chemlattice.plans import chemistry, storage

    index = [(1, "C[C@H](N)O", "a"), (1, "C[C@H](N)O", "a"), (2, "CCO", "b"), (3, "OCC", "c"), (4, "C(", "d"), (None, "C", "e")]
    spark.createDataFrame(index, "mol_id long, smiles string, title string").write.parquet(str(tmp_path / "smiles_index.parquet"))
    spark.createDataFrame([(1, "C(C)O", "x"), (2, "N", "y")], "rec_id long, smiles string, title string").write.parquet(str(tmp_path / "smiles_batches.parquet"))
    read = []
    monkeypatch.setattr("chemlattice.store.with_molecules", lambda *a, **k: pytest.fail("read again"))
    monkeypatch.setattr(chemistry, "_parsed", lambda rows, key, f=chemistry._parsed: read.append(key) or f(rows, key))
    assert storage.store_count(spark, str(tmp_path)).collect() == [(3, 3)]
    assert set(read) == {"mol_id", "rec_id"}
