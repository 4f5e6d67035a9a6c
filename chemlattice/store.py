"""A store of molecules in Parquet: create, insert, add fingerprints, look up and search.

Layout under the store's folder (on a cluster a folder that all executors
share): ``molecules/batch=<n>`` with a row for each molecule, ``keys/batch=<n>``
with hashes of its key, and ``fingerprints/fp_name=<name>/gen=<g>/batch=<n>``
with its words. An insert writes ``log/batch=<n>`` last, and only batches with a
complete log count, so an insert that broke off leaves nothing behind that a
reader sees, and can be repeated. The catalog is kept in versions of which the
greatest complete one counts; a fingerprint that is made again gets a new
generation. No file that a reader may have open is ever overwritten.

Rings are taken as perceived (``functions.aromatic``), unless the store is
opened with ``aromatic="written"``. Two molecules are the same if elements,
charges, isotopes, hydrogens and bonds agree; marks of stereo don't count.
"""

from __future__ import annotations

import json
import logging
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chemlattice.functions.aromatic import perceive
from chemlattice.functions.bits import popcount, words
from chemlattice.functions.fingerprints import REGISTRY, available_fingerprints, fingerprint_words, partition_name
from chemlattice.functions.graphs import Graph, regular_graph
from chemlattice.functions.smiles import Molecule, parse
from chemlattice.operators import search, substructure
from chemlattice.operators.stats import readable_bytes
from chemlattice.session import drop_staged, exists, freeing, spread, stage, tasks_for
from chemlattice.sources.molecules import canonical_keys, numbered, read_molecules, with_molecules

log = logging.getLogger("chemlattice")

FEW_KEYS = 1_000_000  # keys of a batch, 16 bytes each, that are sent to the store's keys instead of shuffling those

_MOLECULES = (
    "mol_id long, smiles string, title string, canonical string, n_atoms int, n_bonds int, mol_weight double, atoms array<int>, "
    "bonds array<struct<a:int,b:int,label:int>>, reduced string, batch int"
)
_FINGERPRINTS = "mol_id long, n_bits int, words array<long>, bits int, fp_name string, gen int, batch int"


class RecordingHandler(logging.Handler):
    """Counts messages by level and keeps those of chosen levels; may pass them on to another handler."""

    def __init__(self, keep: tuple[str, ...] = ("WARNING", "ERROR"), then: logging.Handler | None = None) -> None:
        super().__init__()
        self.keep, self.then = set(keep), then
        self.counts: Counter[str] = Counter()
        self.records: list[tuple[str, str]] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.counts[record.levelname] += 1
        if record.levelname in self.keep:
            self.records.append((record.levelname, record.getMessage()))
        if self.then is not None:
            self.then.handle(record)

    def drain(self) -> list[tuple[str, str]]:
        out, self.records = self.records, []
        return out


class MoleculeStore:
    """A handle on a store; methods that read raise ``FileNotFoundError`` where there is none."""

    def __init__(self, spark: SparkSession, path: str, columns: dict | None = None, aromatic: str = "perceived") -> None:
        """``columns`` are further columns by name: functions from the molecule table to a Column."""
        self.spark, self.path, self.columns, self.aromatic = spark, path.rstrip("/"), columns or {}, aromatic

    # Files, through Hadoop's file system so that any shared storage will do

    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")

    def _names(self, name: str) -> list[str]:
        p, fs = self._fs(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _bytes(self, name: str) -> int:
        p, fs = self._fs(name)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def _versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names("catalog") if self._exists(f"catalog/{n}/_SUCCESS"))

    def _write_catalog(self, generations: dict[str, int]) -> None:
        rows = [(i, n, REGISTRY[n].n_bits, REGISTRY[n].screen_safe, g) for i, (n, g) in enumerate(generations.items())]
        df = self.spark.createDataFrame(rows, "position int, fp_name string, n_bits int, screen_safe boolean, gen int")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog/v={max(self._versions(), default=0) + 1}")

    def _generations(self) -> dict[str, int]:
        return {r["fp_name"]: r["gen"] for r in self.catalog().collect()}

    # Definition

    def create(self, fingerprints: str | list[str] = "GraphPath") -> None:
        names = [fingerprints] if isinstance(fingerprints, str) else list(fingerprints)
        for n in names:
            if n not in REGISTRY:
                raise ValueError(f"unknown fingerprint {n}; there are {', '.join(REGISTRY)}")
        if self.is_loaded:
            raise FileExistsError(f"there is a store at {self.path}")
        self._write_catalog(dict.fromkeys(names, 0))

    @property
    def is_loaded(self) -> bool:
        return bool(self._versions())

    def catalog(self) -> DataFrame:
        if not self.is_loaded:
            raise FileNotFoundError(f"no store at {self.path}")
        return self.spark.read.parquet(f"{self.path}/catalog/v={self._versions()[-1]}").orderBy("position")

    def fingerprints(self) -> list[str]:
        return [r["fp_name"] for r in self.catalog().collect()]

    available_fingerprints = staticmethod(available_fingerprints)

    # Contents

    def _batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names("log") if self._exists(f"log/{n}/_SUCCESS"))

    def log(self) -> DataFrame:
        """``batch, n_read, n_inserted, next_id`` of each insert."""
        self.catalog()
        b = self._batches()
        schema = "n_read long, n_inserted long, next_id long, batch int"
        return self.spark.read.option("basePath", f"{self.path}/log").schema(schema).parquet(*[f"{self.path}/log/batch={n}" for n in b]) if b else self.spark.createDataFrame([], schema)

    def _keys(self) -> DataFrame | None:
        paths = [f"{self.path}/keys/batch={n}" for n in self._batches()]
        return self.spark.read.schema("k1 long, k2 long").parquet(*paths) if paths else None

    def molecules(self) -> DataFrame:
        self.catalog()
        b = self._batches()
        if not b:
            return self.spark.createDataFrame([], _MOLECULES)
        df = self.spark.read.option("basePath", f"{self.path}/molecules").schema(_MOLECULES).parquet(*[f"{self.path}/molecules/batch={n}" for n in b])
        return df.withColumns({n: f(df) for n, f in self.columns.items()}) if self.columns else df

    def fingerprint_table(self, names: list[str] | None = None) -> DataFrame:
        """``mol_id, fp_name, n_bits, words, bits`` of the named kinds; other kinds' files are not read."""
        own = self._generations()
        for n in names or []:
            if n not in own:
                raise ValueError(f"the store has no fingerprint {n}")
        paths = [f"{self.path}/fingerprints/fp_name={partition_name(n)}/gen={own[n]}/batch={b}" for n in names or own for b in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], _FINGERPRINTS).drop("batch", "gen")
        return self.spark.read.option("basePath", f"{self.path}/fingerprints").schema(_FINGERPRINTS).parquet(*paths).drop("batch", "gen")

    def count(self) -> int:
        return self.molecules().count() if self.is_loaded else 0

    def record(self, mol_id: int) -> DataFrame:
        """The molecule with its fingerprints; no row where there is none."""
        fps = self.fingerprint_table().where(F.col("mol_id") == mol_id).groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct("fp_name", F.struct("words", "bits")))).alias("fingerprints"))
        return self.molecules().where(F.col("mol_id") == mol_id).join(fps, "mol_id", "left")

    def information(self) -> DataFrame:
        """``item, value``: number of molecules, bytes of each part, width of each fingerprint."""
        rows = [("molecules", str(self.count())), ("bytes of molecules", readable_bytes(self._bytes("molecules")))]
        for r in self.catalog().collect():
            rows += [(f"bits of {r['fp_name']}", str(r["n_bits"])), (f"bytes of {r['fp_name']}", readable_bytes(self._bytes(f"fingerprints/fp_name={partition_name(r['fp_name'])}")))]
        return self.spark.createDataFrame(rows, "item string, value string")

    # Insertion

    def insert_file(self, path: str, unique: bool = True) -> tuple[int, int]:
        return self.insert(read_molecules(self.spark, path), unique)

    def insert(self, rows: DataFrame, unique: bool = True) -> tuple[int, int]:
        """Adds ``position, smiles, title`` rows; gives how many molecules were read and how many inserted.

        With ``unique`` a key that the store or an earlier row has is left out: the first one wins. Unreadable rows are
        never inserted. Ids go on from the greatest one in the store, in the order of the input.
        """
        self.catalog()
        parsed = with_molecules(spread(rows.select("position", "smiles", "title")), aromatic=self.aromatic).where("canonical is not null")
        read = stage(parsed, "insert")
        try:
            return self.insert_read(read, unique)
        finally:
            drop_staged(self.spark, read)

    def insert_read(self, read: DataFrame, unique: bool = True) -> tuple[int, int]:
        """``insert`` of readable rows that already have the columns of ``with_molecules``, with rings taken as this store does.

        They are read several times, so they should come from files. Shuffle files are deleted after each write.
        """
        with freeing(self.spark):
            return self._insert(read, unique)

    def _insert(self, read: DataFrame, unique: bool) -> tuple[int, int]:
        names = self._generations()
        logged = self.log().orderBy(F.desc("batch")).first()
        batch, start = (logged["batch"] + 1, logged["next_id"]) if logged else (0, 0)
        read = read.withColumn("k1", F.xxhash64("canonical")).withColumn("k2", F.xxhash64(F.lit(7), "canonical"))
        n_read = read.count()
        keep = read.select("k1", "k2", "position")  # what is shuffled is narrow
        if unique:
            keep = keep.groupBy("k1", "k2").agg(F.min("position").alias("position"))
            held = self._keys()
            if held is not None:
                asked = keep.select("k1", "k2")
                known = held.join(F.broadcast(asked) if n_read <= FEW_KEYS else asked, ["k1", "k2"], "left_semi").distinct()
                keep = keep.join(known, ["k1", "k2"], "left_anti")
        ordered = keep.select("position").repartitionByRange("position").sortWithinPartitions("position")
        ids = numbered(ordered, "_n", keep=True).select("position", (F.col("_n") + start).alias("mol_id"))
        parts = tasks_for(self.spark, n_read, 20_000)  # stated for both sides, so that the join's tasks are the next steps', too
        new = stage(read.repartition(parts, "position").join(ids.repartition(parts, "position"), "position").drop("position"), "insert")
        n_new = new.count()
        self._write_fingerprints(new, names, batch)
        columns = [c.split(" ")[0] for c in _MOLECULES.split(", ") if c.split(" ")[0] != "batch"]
        new.select(*columns).sort("canonical").write.mode("overwrite").parquet(f"{self.path}/molecules/batch={batch}")
        new.select("k1", "k2").sort("k1").write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        done = self.spark.createDataFrame([(n_read, n_new, start + n_new)], "n_read long, n_inserted long, next_id long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        drop_staged(self.spark, new)
        log.info("read %d, inserted %d", n_read, n_new)
        return n_read, n_new

    def _write_fingerprints(self, molecules: DataFrame, generations: dict[str, int], batch: int) -> None:
        """Words of each kind, sorted by bit count so that files' statistics serve the size bounds."""
        if not generations:
            return
        fps = stage(substructure.with_fingerprints(molecules.select("mol_id", "atoms", "bonds"), list(generations)), "fps")
        for n, g in generations.items():
            k = REGISTRY[n].n_bits
            part = fps.select("mol_id", F.lit(k).alias("n_bits"), F.col(f"fp_{n}").alias("words"), popcount(words(f"fp_{n}", k)).alias("bits"))
            part.sort("bits", "words").write.mode("overwrite").parquet(f"{self.path}/fingerprints/fp_name={partition_name(n)}/gen={g}/batch={batch}")
        drop_staged(self.spark, fps)

    def add_fingerprint(self, name: str) -> None:
        """Works out one kind over all molecules; a kind that is there is made again, in a new generation."""
        if name not in REGISTRY:
            raise ValueError(f"unknown fingerprint {name}; there are {', '.join(REGISTRY)}")
        generations = self._generations()
        held = self.molecules()
        new = generations.get(name, -1) + 1
        with freeing(self.spark):
            for b in self._batches():
                self._write_fingerprints(held.where(F.col("batch") == b), {name: new}, b)
        self._write_catalog(generations | {name: new})

    # Search

    def _molecule(self, smiles: str) -> Molecule:
        m = parse(smiles)
        if m is None:
            raise ValueError(f"not a readable molecule: {smiles!r}")
        return perceive(m) if self.aromatic == "perceived" else m

    def _query(self, smiles: str) -> Graph:
        return regular_graph(self._molecule(smiles))

    def exact(self, smiles: str, last: bool = False) -> DataFrame:
        """``mol_id`` of the same molecule, however written; all of them, or only the last one."""
        hits = self.molecules().where(F.col("canonical") == canonical_keys([self._molecule(smiles)])[0]).select("mol_id")
        return hits.agg(F.max("mol_id").alias("mol_id")).where("mol_id is not null") if last else hits.orderBy("mol_id")

    def _of_kind(self, g: Graph, n: str) -> tuple[DataFrame, search.Query]:
        return self.fingerprint_table([n]).withColumnRenamed("words", "fingerprint"), search.Query(fingerprint_words(n, g), REGISTRY[n].n_bits, n)

    def screen(self, smiles: str, fingerprints: str | list[str], limit: int = 0) -> DataFrame:
        """Molecules that have all bits of the query in each of the named fingerprints. An unknown name: a warning, no hits."""
        names = [fingerprints] if isinstance(fingerprints, str) else fingerprints
        own = self.fingerprints()
        g = self._query(smiles)
        hits = None
        for n in names:
            if n not in own:
                log.warning("the store has no fingerprint %s", n)
                return self.spark.createDataFrame([], "mol_id long")
            part = search.screen(*self._of_kind(g, n), counted="bits")
            hits = part if hits is None else hits.join(part, "mol_id", "left_semi")
        hits = hits.orderBy("mol_id")
        return hits.limit(limit) if limit else hits

    def similar(self, smiles: str, t: float = 0.8, fingerprints: str | list[str] | None = None, strict: bool = False, limit: int = 0) -> DataFrame:
        """``mol_id, score, fp_name``: hits of each named fingerprint (all, by default), best first."""
        names = [fingerprints] if isinstance(fingerprints, str) else fingerprints or self.fingerprints()
        g = self._query(smiles)
        out = None
        for n in names:
            part = search.similar(*self._of_kind(g, n), t, strict, counted="bits").withColumn("fp_name", F.lit(n))
            out = part if out is None else out.unionByName(part)
        out = out.orderBy(F.desc("score"), "mol_id", "fp_name")
        return out.limit(limit) if limit else out

    def substructure(self, smiles: str, algorithm: str = "mono", limit: int = 0) -> DataFrame:
        return substructure.match(self.molecules(), self._query(smiles), algorithm, limit)

    def quick_substructure(self, smiles: str, fingerprints: str | list[str] | None = None, algorithm: str = "mono", limit: int = 0) -> DataFrame:
        """Screens first, tests what is left, and limits last."""
        names = [fingerprints] if isinstance(fingerprints, str) else fingerprints or [n for n in self.fingerprints() if REGISTRY[n].screen_safe]
        for n in names:
            if n in REGISTRY and not REGISTRY[n].screen_safe:
                raise ValueError(f"{n} may lose matches and can't be used for screening")
        rows = self.molecules()
        if names:
            rows = rows.join(self.screen(smiles, names), "mol_id", "left_semi")
        return substructure.match(rows, self._query(smiles), algorithm, limit)


# Functions for scripts, on one open store

_open: dict[str, MoleculeStore] = {}
_recorder = RecordingHandler()
INVALID_INDEX = None


def open_database(spark: SparkSession, path: str) -> MoleculeStore:
    """Opens a store for the functions below; another path takes its place."""
    if _recorder not in log.handlers:
        log.addHandler(_recorder)
    _open["store"] = MoleculeStore(spark, path)
    return _open["store"]


def exact_structure_search(smiles: str) -> int | None:
    r = _open["store"].exact(smiles, last=True).first()
    return r["mol_id"] if r else INVALID_INDEX


def similarity_search(smiles: str, t: float, limit: int = 100_000) -> list[tuple[int, float]]:
    """The best hits as a list, at most ``limit``; all of them, at any number, are what ``MoleculeStore.similar`` gives."""
    return [(r["mol_id"], r["score"]) for r in _open["store"].similar(smiles, t, limit=limit).collect()]


def errors() -> str:
    """Warnings and errors since the last call."""
    return json.dumps(_recorder.drain())


__all__ = ["MoleculeStore", "RecordingHandler", "open_database", "exact_structure_search", "similarity_search", "errors"]
