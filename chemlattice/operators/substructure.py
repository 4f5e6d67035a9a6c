"""Substructure search: relational self-joins, an Arrow matcher, and screen-then-verify.

A target table has ``mol_id, atoms, bonds`` as ``sources.molecules.with_molecules``
gives them. A query matches where its labelled graph occurs in the target
(``mode="mono"``), or occurs without further bonds (``mode="induced"``). Rows
without a graph never match; a query that can't be read raises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.functions.bits import contains, host_words, literals, words
from chemlattice.functions.canon import ranges
from chemlattice.functions.fingerprints import REGISTRY, fingerprint_words
from chemlattice.functions.flat import FlatGraphs, packed
from chemlattice.functions.graphs import Graph, Pattern, graph_of

# Names that callers may use for the one matcher.
ALGORITHMS = {"mono": "mono", "induced": "induced", "regular": "mono", "reduced": "mono", "smarts": "mono"}
AT_ONCE = 10_000  # queries whose graphs are sent to all tasks together
FLAT = 2_000  # targets of which fingerprints are worked out together


def _mode(name: str) -> str:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name}; there are {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name]


def query_graph(smiles: str | Graph) -> Graph:
    """The graph of a query; a graph stays as it is."""
    if isinstance(smiles, tuple):
        return smiles
    g = graph_of(smiles)
    if g is None:
        raise ValueError(f"not a readable molecule: {smiles!r}")
    return g


def _graphs(b: pa.RecordBatch) -> Iterator[Graph | None]:
    """Graphs of a batch's ``atoms`` and ``bonds``, cut from the flat arrays."""
    atoms, bonds = b["atoms"], b["bonds"]
    ok = np.asarray(atoms.is_valid()) & np.asarray(bonds.is_valid())
    ao, bo = atoms.offsets.to_numpy(), bonds.offsets.to_numpy()
    label = atoms.values.to_numpy(zero_copy_only=False)
    x, y, k = (bonds.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    for i in range(b.num_rows):
        if not ok[i]:
            yield None
            continue
        s, e = bo[i], bo[i + 1]
        yield label[ao[i] : ao[i + 1]].tolist(), x[s:e].tolist(), y[s:e].tolist(), k[s:e].tolist()


def _flat(b: pa.RecordBatch) -> tuple[FlatGraphs, np.ndarray]:
    """All graphs of a batch together, and which rows have one; the others count as graphs without atoms."""
    atoms, bonds = b["atoms"], b["bonds"]
    ok = np.asarray(atoms.is_valid()) & np.asarray(bonds.is_valid())
    ao, bo = atoms.offsets.to_numpy().astype(np.int64), bonds.offsets.to_numpy().astype(np.int64)
    sizes, n_bonds = np.where(ok, np.diff(ao), 0), np.where(ok, np.diff(bo), 0)
    label = atoms.values.to_numpy(zero_copy_only=False)[ranges(ao[:-1], sizes)].astype(np.int64)
    e = ranges(bo[:-1], n_bonds)
    return FlatGraphs(sizes, label, n_bonds, *(bonds.values.field(i).to_numpy(zero_copy_only=False)[e].astype(np.int64) for i in range(3))), ok


def match(targets: DataFrame, smiles: str | Graph, algorithm: str = "mono", limit: int = 0) -> DataFrame:
    """``mol_id`` of the targets that hold the query; every target is tested. ``limit`` keeps the first by id."""
    pattern, induced = Pattern(query_graph(smiles)), _mode(algorithm) == "induced"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.fromiter((g is not None and pattern.matches(g, induced) for g in _graphs(b)), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["mol_id"].filter(pa.array(hit))], names=["mol_id"])

    hits = targets.where("mol_id is not null").select("mol_id", "atoms", "bonds").mapInArrow(each, "mol_id long").distinct()
    return hits.orderBy("mol_id").limit(limit) if limit else hits


def quick(targets: DataFrame, smiles: str, fp_names: list[str] | None = None, algorithm: str = "mono", limit: int = 0) -> DataFrame:
    """Screens by stored fingerprints ``fp_<name>`` first and tests what is left; the limit comes last.

    Only kinds marked as safe for screening are used.
    """
    g = query_graph(smiles)
    for name in fp_names or [n for n, k in REGISTRY.items() if k.screen_safe and f"fp_{n}" in targets.columns]:
        if not REGISTRY[name].screen_safe:
            raise ValueError(f"{name} may lose matches and can't be used for screening")
        n = REGISTRY[name].n_bits
        targets = targets.where(contains(words(f"fp_{name}", n), literals(fingerprint_words(name, g))))
    return match(targets, smiles, algorithm, limit)


def with_fingerprints(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``fp_<name>`` columns worked out from ``atoms`` and ``bonds``; a row without a graph has all bits set."""
    for n in names:
        if n not in REGISTRY:
            raise ValueError(f"unknown fingerprint {n}; there are {', '.join(REGISTRY)}")
    df = df.drop(*[f"fp_{n}" for n in names])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`fp_{n}` array<long>" for n in names]])
    kinds = [(REGISTRY[n].bits, REGISTRY[n].n_bits, REGISTRY[n].flags) for n in names]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, FLAT):
                b = whole.slice(lo, FLAT)
                f, ok = _flat(b) if any(flags for _, _, flags in kinds) else (None, None)
                out = []
                for bits, n, flags in kinds:
                    if flags is None:
                        out.append(pa.array([host_words(bits(g, n) if g is not None else range(n), n) for g in _graphs(b)], pa.list_(pa.int64())))
                        continue
                    set_ = flags(f, n)
                    set_[~ok] = True
                    w = packed(set_)
                    out.append(pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *[f"fp_{n}" for n in names]])

    return df.mapInArrow(each, schema)


def match_batch(targets: DataFrame, queries: DataFrame, algorithm: str = "mono") -> DataFrame:
    """``query_id, mol_id`` for a set of queries ``(query_id, smiles)``: one pass over the targets for each ``AT_ONCE`` queries.

    Each query is screened first, by how often its atoms and its bonds with their ends occur: only targets with as many
    of each are matched. The counts of a batch of targets against those of all queries are one comparison of arrays.
    Unreadable queries match nothing.
    """
    held = sorted((r for r in queries.select("query_id", "smiles").where("query_id is not null").distinct().toLocalIterator()), key=lambda r: (r["query_id"], r["smiles"] or ""))
    kind = dict(queries.dtypes)["query_id"]
    patterns = [(r["query_id"], g) for r in held if (g := graph_of(r["smiles"])) is not None]
    out = None
    for lo in range(0, len(patterns), AT_ONCE):
        part = _match_some(targets, patterns[lo : lo + AT_ONCE], _mode(algorithm) == "induced")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return targets.sparkSession.createDataFrame([], f"query_id {kind}, mol_id long")
    return out.select(F.col("query_id").cast(kind).alias("query_id"), "mol_id").distinct()


def _features(g: Graph) -> Counter:
    """Atoms by label, and bonds by their label and those of their ends."""
    out: Counter = Counter(g[0])
    for (a, b), k in {(min(a, b), max(a, b)): k for a, b, k in zip(g[1], g[2], g[3])}.items():  # parallel bonds count once
        x, y = g[0][a], g[0][b]
        out[(min(x, y), k, max(x, y))] += 1
    return out


def _match_some(targets: DataFrame, queries: list[tuple[int, Graph]], induced: bool) -> DataFrame:
    patterns = [(q, Pattern(g)) for q, g in queries]
    counts = [_features(g) for _, g in queries]
    place = {f: i for i, f in enumerate(dict.fromkeys(f for c in counts for f in c))}
    need = np.zeros((len(queries), len(place)), np.int16)
    for i, c in enumerate(counts):
        for f, n in c.items():
            need[i, place[f]] = min(n, 32_000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                graphs, q, m = list(_graphs(b)), [], []
                have = np.zeros((len(graphs), len(place)), np.int16)
                for i, g in enumerate(graphs):
                    for f, n in _features(g).items() if g is not None else ():
                        if f in place:
                            have[i, place[f]] = min(n, 32_000)
                ids = b["mol_id"].to_pylist()
                for j, (qid, p) in enumerate(patterns):
                    used = np.flatnonzero(need[j])
                    for i in np.flatnonzero((have[:, used] >= need[j, used]).all(axis=1)).tolist():
                        if graphs[i] is not None and p.matches(graphs[i], induced):
                            q.append(qid)
                            m.append(ids[i])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(m, pa.int64())], names=["query_id", "mol_id"])

    return targets.where("mol_id is not null").select("mol_id", "atoms", "bonds").mapInArrow(each, "query_id long, mol_id long")


def bond_table(targets: DataFrame) -> DataFrame:
    """Directed bonds ``mol_id, a, b, a_label, b_label, label``, two rows a bond: the table for relational matching."""
    one = targets.where("mol_id is not null").select("mol_id", "atoms", F.explode("bonds").alias("x"))
    pick = lambda i: F.get("atoms", i)
    ab = one.select("mol_id", F.col("x.a").alias("a"), F.col("x.b").alias("b"), pick(F.col("x.a")).alias("a_label"), pick(F.col("x.b")).alias("b_label"), F.col("x.label").alias("label"))
    return ab.unionByName(ab.select("mol_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_label").alias("a_label"), F.col("a_label").alias("b_label"), "label"))


def match_relational(bonds: DataFrame, smiles: str) -> DataFrame:
    """Matching by joins alone: one join of the directed bonds for each bond of the query, all on ``mol_id``.

    As the joins share their key, the bonds are shuffled once. For connected queries with at least one bond.
    """
    g = query_graph(smiles)
    if not g[1]:
        raise ValueError("the query needs a bond")
    p = Pattern(g)
    order = p.order
    held: DataFrame | None = None
    done: list[int] = []
    for i, v in enumerate(order[1:], 1):
        before = p.before[i]
        if not before:
            raise ValueError("the query isn't connected")
        for j, (w, k) in enumerate(before):
            e = bonds.where((F.col("a_label") == p.labels[w]) & (F.col("b_label") == p.labels[v]) & (F.col("label") == k))
            e = e.select("mol_id", F.col("a").alias(f"v{w}"), F.col("b").alias(f"v{v}"))
            if held is None:
                held, done = e, [w, v]
                continue
            held = held.join(e, ["mol_id", f"v{w}"] + ([f"v{v}"] if v in done else []))
            if v not in done:
                for u in done:
                    if p.labels[u] == p.labels[v]:
                        held = held.where(F.col(f"v{u}") != F.col(f"v{v}"))
                done.append(v)
            del j
    return held.select("mol_id").distinct()
