"""Molecule files as DataFrames, and the molecular columns that are worked out once, at ingest.

Formats go by the file's extension: ``smi``/``smiles``/``can`` (a SMILES, a
space or tab, a title), ``sdf``/``mol`` (V2000 blocks) and ``graphs`` (graph text).
Unreadable records stay as rows without a graph; an unknown extension raises.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chemlattice.functions import canon
from chemlattice.functions.aromatic import perceive
from chemlattice.functions.flat import FlatMolecules, TooLarge
from chemlattice.functions.graphs import Graph, from_text, reduced_graph, regular_graph, to_text
from chemlattice.session import stage
from chemlattice.functions.smiles import AROMATIC_BOND, DOUBLE, NUMBER, SINGLE, TRIPLE, Molecule, hydrogen_count, key_of, labels, molecular_weight, parse

FORMATS = {"smi": "smiles", "smiles": "smiles", "can": "smiles", "sdf": "sdf", "mol": "sdf", "graphs": "graphs"}


def format_of(path: str) -> str | None:
    """The format of a file by its extension; None if it isn't known."""
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower())


def is_valid_format(path: str) -> bool:
    return format_of(path) is not None


def numbered(df: DataFrame, name: str = "position", keep: bool = False) -> DataFrame:
    """Adds a dense 0-based number in the order of the input: partition offsets from one count per partition.

    The input is read twice. A file's partitions are the same each time; for anything else ``keep`` writes them first.
    """
    part = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33))
    part = stage(part, "numbered") if keep else part
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    return part.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """``position, smiles, title`` (and ``molblock`` for sdf, ``graph_text`` for graphs) in file order."""
    kind = format_of(path)
    if kind is None:
        raise ValueError(f"unknown molecule format: {path}")
    if kind == "sdf":
        rows = numbered(spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "").toDF("molblock"))
        return rows.select("position", F.lit(None).cast("string").alias("smiles"), F.trim(F.split("molblock", "\n")[0]).alias("title"), "molblock")
    rows = numbered(spark.read.text(path))
    if kind == "graphs":
        return rows.select("position", F.col("value").alias("graph_text"))
    line = F.regexp_replace("value", r"\r$", "")
    return rows.select("position", F.regexp_extract(line, r"^([^ \t]*)", 1).alias("smiles"), F.regexp_extract(line, r"^[^ \t]*[ \t]+(.*)$", 1).alias("title"))


def first_molecule(spark: SparkSession, path: str) -> DataFrame:
    return read_molecules(spark, path).orderBy("position").limit(1)


def parse_molblock(block: str | None) -> Molecule | None:
    """A V2000 connection table; None where it can't be read."""
    try:
        lines = block.split("\n")
        counts = lines[3]
        n, m = int(counts[0:3]), int(counts[3:6])
        symbols = [lines[4 + i][31:34].strip() for i in range(n)]
        begin, end, bond = [], [], []
        arom = [False] * n
        order = {1: SINGLE, 2: DOUBLE, 3: TRIPLE, 4: AROMATIC_BOND}
        for i in range(m):
            x = lines[4 + n + i]
            a, b, k = int(x[0:3]) - 1, int(x[3:6]) - 1, order[int(x[6:9])]
            if not (0 <= a < n and 0 <= b < n):
                return None
            begin.append(a)
            end.append(b)
            bond.append(k)
            if k == AROMATIC_BOND:
                arom[a] = arom[b] = True
        return Molecule([NUMBER[s] for s in symbols], arom, [-1] * n, [0] * n, [0] * n, begin, end, bond)
    except (AttributeError, IndexError, KeyError, ValueError):
        return None


def _identity(m: Molecule) -> list[int]:
    """Vertex labels that also tell charge, isotope and hydrogens apart; those of an ordinary atom are small numbers."""
    return [x + 1000 * (k + 32 * (q + 64) + 8192 * i) for x, k, q, i in zip(labels(m), hydrogen_count(m), m.charge, m.isotope)]


def canonical_key(g: Graph, rank: list[int]) -> str:
    """Text that two molecules share exactly if they have the same labelled graph: canonical vertices and bonds.

    It isn't a SMILES: labels in canonical order, then bonds as ``a-b:label`` in order.
    """
    by = sorted(range(len(rank)), key=lambda v: rank[v])
    bonds = sorted((min(rank[a], rank[b]), max(rank[a], rank[b]), k) for a, b, k in zip(g[1], g[2], g[3]))
    return ".".join(str(g[0][v]) for v in by) + "|" + ",".join(f"{a}-{b}:{k}" for a, b, k in bonds)


def canonical_keys(molecules: list[Molecule], identity: bool = True) -> list[str]:
    """Keys of many molecules, equal for all writings of one molecule: atoms with charge, isotope and hydrogens, and bonds.

    Without ``identity`` only elements, aromatic marks and bonds count. Marks of stereo never do.
    """
    graphs = [(_identity(m), m.begin, m.end, m.bond) if identity else regular_graph(m) for m in molecules]
    b = canon.GraphBatch(graphs)
    return [canonical_key(g, r.tolist()) for g, r in zip(graphs, canon.ranks(b))] if molecules else []


_ADDED = "canonical string, n_atoms int, n_bonds int, mol_weight double, atoms array<int>, bonds array<struct<a:int,b:int,label:int>>, reduced string"
_ARROW = [
    ("canonical", pa.string()), ("n_atoms", pa.int32()), ("n_bonds", pa.int32()), ("mol_weight", pa.float64()), ("atoms", pa.list_(pa.int32())),
    ("bonds", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("label", pa.int32())]))), ("reduced", pa.string()),
]


def _columns(molecules: list[Molecule], identity: bool) -> list[pa.Array]:
    """The columns of ``_ARROW``."""
    try:
        f = FlatMolecules(molecules)
    except TooLarge:
        graphs = [regular_graph(m) for m in molecules]
        bonds = [[{"a": x, "b": y, "label": k} for x, y, k in zip(*g[1:])] for g in graphs]
        values = (canonical_keys(molecules, identity), [len(g[0]) for g in graphs], [len(g[1]) for g in graphs], [molecular_weight(m) for m in molecules], [g[0] for g in graphs], bonds, [to_text(*reduced_graph(g)) for g in graphs])
        return [pa.array(v, t) for v, (_, t) in zip(values, _ARROW)]
    labels = f.labels.tolist()
    v = f.first.tolist()
    reduced = [to_text(*reduced_graph((labels[v[i] : v[i + 1]], m.begin, m.end, m.bond))) for i, m in enumerate(molecules)]
    bonds = pa.StructArray.from_arrays([x.astype(np.int32) for x in (f.a, f.b, f.bond)], names=["a", "b", "label"])
    atoms = pa.array(f.labels.astype(np.int32))
    return [
        pa.array(f.canonical(identity), pa.string()), pa.array(f.sizes, pa.int32()), pa.array(f.n_bonds, pa.int32()), pa.array(f.weights, pa.float64()), pa.ListArray.from_arrays(f.first.astype(np.int32), atoms),
        pa.ListArray.from_arrays(f.first_bond.astype(np.int32), bonds), pa.array(reduced, pa.string()),
    ]


def with_molecules(df: DataFrame, smiles: str = "smiles", aromatic: str = "written", identity: bool = True) -> DataFrame:
    """Adds canonical key, counts, weight, atoms, bonds and the reduced graph's text; all NULL for unreadable text.

    ``aromatic`` says whether rings are taken as ``written`` or ``perceived`` (see ``functions.aromatic``), so that both
    writings of a ring are one; ``identity`` as in ``canonical_keys``. Other columns pass through; columns of the added names are replaced.
    """
    if aromatic not in ("written", "perceived"):
        raise ValueError("aromatic is written or perceived")
    added = [n for n, _ in _ARROW]
    df = df.drop(*[c for c in df.columns if c in added and c != smiles])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], _ADDED])
    block = "molblock" in df.columns
    at = df.columns.index("molblock" if block else smiles)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                mols = [parse_molblock(x) if block else parse(x) for x in b.column(at).to_pylist()]
                if aromatic == "perceived":
                    mols = [m and perceive(m) for m in mols]
                arrays = _columns([m for m in mols if m is not None], identity)
                if None in mols:
                    place = iter(range(len(mols)))
                    places = pa.array([None if m is None else next(place) for m in mols], pa.int64())
                    arrays = [x.take(places) for x in arrays]
                yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *added])

    return df.mapInArrow(each, schema)


def parse_graph_text(df: DataFrame, column: str = "graph_text") -> DataFrame:
    """Adds ``labels`` and ``edges`` read from graph text; NULL where it can't be read."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "labels array<int>, edges array<struct<source:int,target:int,path:array<int>>>"])
    at = df.columns.index(column)
    edge = pa.list_(pa.struct([("source", pa.int32()), ("target", pa.int32()), ("path", pa.list_(pa.int32()))]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, edges = [], []
            for t in b.column(at).to_pylist():
                try:
                    v, e = from_text(t)
                    labels.append(v)
                    edges.append([{"source": x, "target": y, "path": p} for x, y, p in e])
                except ValueError:
                    labels.append(None)
                    edges.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.list_(pa.int32())), pa.array(edges, edge)], names=[*b.schema.names, "labels", "edges"])

    return df.mapInArrow(each, schema)


def edges_by_length() -> F.Column:
    """The column ``edges``, longest paths first; ties by source, then target."""
    return F.expr("array_sort(edges, (x, y) -> CASE WHEN size(x.path) <> size(y.path) THEN size(y.path) - size(x.path) WHEN x.source <> y.source THEN x.source - y.source ELSE x.target - y.target END)")


def graph_text_column() -> F.Column:
    """Graph text of columns ``labels`` and ``edges``, by expressions alone."""
    v = F.array_join(F.transform("labels", lambda x: F.format_string("{%d}", x)), ",")
    e = F.array_join(F.transform("edges", lambda x: F.format_string("{%d,%d,[%s]}", x["source"], x["target"], F.array_join(x["path"].cast("array<string>"), ","))), ",")
    return F.concat(F.lit("{["), v, F.lit("],["), e, F.lit("]}"))


__all__ = ["read_molecules", "first_molecule", "with_molecules", "format_of", "is_valid_format", "canonical_keys", "parse_graph_text", "graph_text_column", "key_of", "numbered"]
