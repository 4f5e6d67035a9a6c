"""Deduplicating new batches against all history, by small-world graph shards.

A molecule is reduced to the skeleton of its main component: atoms by
element, joined or not. It becomes a vector of counts of hashed
neighbourhoods, which does not depend on the writing, so equal molecules
stand at distance zero and similar ones near by.

History is kept in segments. A segment is split into routes by a hash of the
skeleton, so that no kind of molecule makes a route hot, and each route of a segment is a shard: the different
molecules of that part, as a navigable small-world graph over their vectors.
A new batch is parsed once, routed, and looked up in its route's shards by
beam search from several entry points. The width of the beam is doubled until
a sample of searches agrees with exhaustive search in a share ``WANTED``; a shard that
does not come to this with a beam of ``MAX_BEAM`` is searched exhaustively, in blocks. The agreement is
kept with the shard. What the search finds is
reranked exactly: the canonical certificates must agree or else the skeletons
must be isomorphic. The batch then becomes a new segment.

``History`` keeps segments on disk, with a catalog of those that are live. When ``COMPACT_AT``
live segments are of one size (within a factor of ``COMPACT_AT``), they are merged into one, which takes their place
in the catalog. So the number of live segments grows with the logarithm of the history, whatever the batches are
called and however many calls they come in. No batch reads or
builds again what lies in older shards but those of its own routes; a lookup's cost grows with the
logarithm of a shard.

Copies are combined before the shuffle: equal texts are parsed once, and
equal certificates of a batch travel as one row with their smallest id, so a
molecule that makes up a third of all rows is one node.

Defined results: NULL, empty and unreadable texts hold no molecule and never
match; a molecule without atoms other than hydrogen holds none either; rows
delivered twice count once; rows without id are left out, those without a
batch number belong to the last batch; the first id is the smallest, in whichever batch it came; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.functions import canon
from chemlattice.functions.smiles import main_component, parse
from chemlattice.session import exists, slots, stage, tasks_for

DIMENSIONS = 32
NEIGHBOURS = 12
BEAM = 24
MAX_BEAM = 512
ENTRIES = 256
COMPACT_AT = 4
ROUTE_ROWS = 8_000
TUNE = 256
WANTED = 0.999
MARGIN = 2  # lookups take a beam so many times as wide as the sample needed


# Vectors


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts that hold a molecule; their routes, vectors, certificates and colour hashes."""
    graphs, place = [], []
    for i, t in enumerate(texts):
        m = parse(t)
        if m is not None:
            g = main_component(m)
            if g[0]:
                graphs.append(g)
                place.append(i)
    b = canon.GraphBatch(graphs)
    n = len(graphs)
    vector = np.zeros((n, DIMENSIONS), np.float32)
    colour = canon.mix(b.label)
    part = canon._Part(b, None)
    for radius in range(4):
        if radius:
            colour = part.step(colour)
        at = (colour % np.uint64(DIMENSIONS)).astype(np.int64)
        vector += np.bincount(b.graph * DIMENSIONS + at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    colour = part.refine(colour) if n else colour
    hashed = canon.colour_hash(b, colour)
    certificate = canon.certificates(b, colour) if n else np.zeros((0, 2), np.uint64)
    return np.array(place, np.int64), canon.mix(hashed), vector, certificate, hashed


# The graph of one shard


class SmallWorld:
    """Nodes with vectors, each linked to near ones; grown in groups that are searched for and linked at once."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None, beam: int = BEAM, agreement: float = 1.0) -> None:
        """A ``beam`` of 0 stands for exhaustive search."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.beam, self.agreement = beam, agreement
        n = len(vectors)
        self.links = np.full((n, 2 * NEIGHBOURS), -1, np.int32) if links is None else links
        self.distance = np.full((n, 2 * NEIGHBOURS), np.inf, np.float32)
        self.size = 0 if links is None else n
        if links is None and n <= ENTRIES:  # every node would be an entry point: searched whole, without links
            self.size, self.beam = n, 0
        elif links is None:
            self._grow()

    def _entries(self) -> np.ndarray:
        return np.unique(np.linspace(0, self.size - 1, min(self.size, ENTRIES)).astype(np.int64))

    def _grow(self) -> None:
        n = len(self.vectors)
        while self.size < n:
            lo = self.size
            hi = min(n, max(ENTRIES, min(2 * lo, lo + 1024)))
            new = np.arange(lo, hi)
            near = [np.zeros((hi - lo, 0), np.int64)] * 2
            if lo:
                near = self.search(self.vectors[new], max(BEAM, NEIGHBOURS), stop_at_zero=False)
            own = self._exact(self.vectors[new], self.vectors[new])
            own[np.arange(hi - lo), np.arange(hi - lo)] = np.inf
            k = min(NEIGHBOURS, hi - lo - 1)
            ids, dist = near
            if k > 0:
                other = np.argpartition(own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, other + lo], axis=1)
                dist = np.concatenate([dist, np.take_along_axis(own, other, 1)], axis=1)
            self.size = hi
            if ids.shape[1]:
                k = min(NEIGHBOURS, ids.shape[1])
                best = np.argpartition(dist, k - 1, axis=1)[:, :k]
                self._link(np.repeat(new, k), np.take_along_axis(ids, best, 1).ravel(), np.take_along_axis(dist, best, 1).ravel())

    @staticmethod
    def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.float64), b.astype(np.float64)  # whole numbers, of which float32 is too short for squares
        return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)

    def _link(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """Adds links both ways; a node with too many keeps its nearest, and its two oldest as long ways."""
        ok = np.isfinite(d) & (b >= 0)
        a, b, d = a[ok], b[ok], d[ok]
        touched = np.unique(np.concatenate([a, b]))
        held = self.links[touched]
        src = np.concatenate([np.repeat(touched, held.shape[1]), a, b])
        dst = np.concatenate([held.ravel(), b, a]).astype(np.int64)
        dist = np.concatenate([self.distance[touched].ravel(), d, d])
        kept = np.tile(np.arange(held.shape[1]) < 2, len(touched))
        old = np.concatenate([kept, np.zeros(2 * len(a), bool)])
        ok = dst >= 0
        src, dst, dist, old = src[ok], dst[ok], dist[ok], old[ok]
        order = np.lexsort((dist, ~old, dst, src))
        src, dst, dist, old = src[order], dst[order], dist[order], old[order]
        first = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))
        src, dst, dist, old = src[first], dst[first], dist[first], old[first]
        order = np.lexsort((dist, ~old, src))
        src, dst, dist = src[order], dst[order], dist[order]
        new = np.append(True, src[1:] != src[:-1])
        place = np.arange(len(src)) - np.maximum.accumulate(np.where(new, np.arange(len(src)), 0))
        ok = place < self.links.shape[1]
        self.links[touched], self.distance[touched] = -1, np.inf
        self.links[src[ok], place[ok]] = dst[ok]
        self.distance[src[ok], place[ok]] = dist[ok]

    def search(self, queries: np.ndarray, beam: int | None = None, stop_at_zero: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query when it can't be bettered: nodes and squared distances, nearest first."""
        if not (beam or self.beam):
            return self._exhaustive(queries)
        beam = min(beam or self.beam, self.size)
        out_ids, out_dist = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), np.inf, np.float32)
        entries = self._entries()
        for lo in range(0, len(queries), 1024):
            q = np.ascontiguousarray(queries[lo : lo + 1024], np.float32)
            d = self._exact(q, self.vectors[entries])
            k = min(beam, len(entries))
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            ids = np.full((len(q), beam), -1, np.int64)
            dist = np.full((len(q), beam), np.inf, np.float32)
            ids[:, :k], dist[:, :k] = entries[best], np.take_along_axis(d, best, 1)
            order = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            done = ids < 0
            alive = np.arange(len(q))
            while len(alive):
                wait = ~done[alive]
                go = wait.any(axis=1)
                if stop_at_zero:
                    go &= dist[alive, 0] > 1e-3
                alive = alive[go]
                if not len(alive):
                    break
                at = wait[go].argmax(axis=1)  # the nearest node that wasn't opened yet
                done[alive, at] = True
                node = ids[alive, at]
                near = self.links[node].astype(np.int64)
                own = ids[alive]
                fresh = (near >= 0) & ~(near[:, :, None] == own[:, None, :]).any(axis=2)
                r, c = np.nonzero(fresh)
                diff = self.vectors[near[r, c]] - q[alive[r]]
                nd = np.full(near.shape, np.inf, np.float32)
                nd[r, c] = np.einsum("ij,ij->i", diff, diff)
                near = np.where(fresh, near, -1)
                all_ids = np.concatenate([own, near], axis=1)
                all_dist = np.concatenate([dist[alive], nd], axis=1)
                all_done = np.concatenate([done[alive], ~fresh], axis=1)
                order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
                ids[alive] = np.take_along_axis(all_ids, order, 1)
                dist[alive] = np.take_along_axis(all_dist, order, 1)
                done[alive] = np.take_along_axis(all_done, order, 1)
            out_ids[lo : lo + 1024], out_dist[lo : lo + 1024] = ids, dist
        return out_ids, out_dist

    def _exhaustive(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest node of each query, by comparison with all, in blocks."""
        ids, dist = np.full((len(queries), 1), -1, np.int64), np.full((len(queries), 1), np.inf, np.float32)
        for lo in range(0, len(queries), 512):
            for at in range(0, self.size, 8192):
                d = self._exact(queries[lo : lo + 512], self.vectors[at : at + 8192])
                best = d.argmin(axis=1)
                least = d[np.arange(len(d)), best]
                less = least < dist[lo : lo + 512, 0]
                ids[lo : lo + 512, 0][less] = best[less] + at
                dist[lo : lo + 512, 0][less] = least[less]
        return ids, dist

    def tune(self) -> float:
        """Widens the beam until searches for a sample of nodes find what exhaustive search finds; the agreement reached.

        Where the widest beam isn't enough, the graph is searched exhaustively from then on.
        """
        if not self.size or not self.beam:
            return 1.0
        at = np.unique(np.linspace(0, self.size - 1, min(self.size, TUNE)).astype(np.int64))
        q = self.vectors[at]
        nearest = self._exact(q, self.vectors[: self.size]).min(axis=1)
        while True:
            found = self.search(q)[1][:, 0]
            self.agreement = float((found <= nearest + 1e-3).mean())
            if self.agreement >= WANTED:
                return self.agreement
            if self.beam >= min(MAX_BEAM, self.size):
                self.beam, self.agreement = 0, 1.0
                return self.agreement
            self.beam *= 2


class Shard:
    """Different molecules of one route of one segment: certificates, first ids, one text each, and the graph over their vectors."""

    def __init__(self, first: np.ndarray, certificate: np.ndarray, hashed: np.ndarray, text: list[str], vector: np.ndarray, links: np.ndarray | None = None, node: np.ndarray | None = None, beam: int = BEAM, agreement: float = 1.0) -> None:
        self.first, self.certificate, self.hashed, self.text = first, certificate, hashed, text
        # Molecules with one vector share a node.
        if node is None:
            vector, node = np.unique(vector, axis=0, return_inverse=True)
            node = node.ravel()
            order = np.random.default_rng(len(vector)).permutation(len(vector))  # a graph grown in random order has long ways
            place = np.argsort(order)
            vector, node = vector[order], place[node]
        self.node = node.astype(np.int64)
        self.graph = SmallWorld(vector, links, beam, agreement)
        self.by_node = np.argsort(self.node, kind="stable")
        self.start = np.searchsorted(self.node[self.by_node], np.arange(len(vector) + 1))
        if links is None and self.graph.beam:
            self.graph.tune()

    def find(self, vector: np.ndarray, certificate: np.ndarray, hashed: np.ndarray, text: list[str]) -> np.ndarray:
        """First id of the same molecule for each query; -1 where there is none."""
        out = np.full(len(vector), -1, np.int64)
        if not len(self.first) or not len(vector):
            return out
        ids, dist = self.graph.search(vector, MARGIN * self.graph.beam)
        hit = np.flatnonzero(dist[:, 0] <= 1e-3)
        for q in hit:
            node = ids[q, 0]
            rows = self.by_node[self.start[node] : self.start[node + 1]]
            same = (self.certificate[rows] == certificate[q]).all(axis=1)
            for r in rows[~same & (self.hashed[rows] == hashed[q])]:  # exact test where the certificates leave it open
                if canon.isomorphic(main_component(parse(self.text[r])), main_component(parse(text[q]))):
                    out[q] = self.first[r] if out[q] < 0 else min(out[q], self.first[r])
            if same.any():
                f = int(self.first[rows[same]].min())
                out[q] = f if out[q] < 0 else min(out[q], f)
        return out

    @staticmethod
    def merged(shards: list[Shard]) -> Shard:
        """One shard of several, each molecule once with its smallest id."""
        first = np.concatenate([s.first for s in shards])
        cert = np.concatenate([s.certificate for s in shards])
        hashed = np.concatenate([s.hashed for s in shards])
        text = [t for s in shards for t in s.text]
        vector = np.concatenate([s.graph.vectors[s.node] for s in shards])
        order = np.lexsort((first, cert[:, 1], cert[:, 0]))
        c = cert[order]
        keep = order[np.append(True, (c[1:] != c[:-1]).any(axis=1))] if len(order) else order
        return Shard(first[keep], cert[keep], hashed[keep], [text[i] for i in keep], vector[keep])

    def packed(self) -> dict:
        return {"first": self.first.tobytes(), "certificate": self.certificate.tobytes(), "hashed": self.hashed.tobytes(), "text": self.text, "node": self.node.tobytes(), "vectors": self.graph.vectors.tobytes(), "links": self.graph.links.tobytes(), "beam": self.graph.beam, "agreement": self.graph.agreement}

    @classmethod
    def unpacked(cls, r: dict) -> Shard:
        f = lambda k, t: np.frombuffer(r[k], t).copy()
        return cls(f("first", np.int64), f("certificate", np.uint64).reshape(-1, 2), f("hashed", np.uint64), list(r["text"]), f("vectors", np.float32).reshape(-1, DIMENSIONS), f("links", np.int32).reshape(-1, 2 * NEIGHBOURS), f("node", np.int64), int(r["beam"]), float(r["agreement"]))


# On Spark

_MOLECULES = "route int, batch int, id long, text string, c1 long, c2 long, hashed long, vector binary"
_SHARD_SQL = "route int, segment int, n_molecules long, first binary, certificate binary, hashed binary, text array<string>, node binary, vectors binary, links binary, beam int, agreement double"


def _batch(c: str) -> F.Column:
    """Batch number; rows without one come last."""
    return F.coalesce(F.col(c).cast("int"), F.lit(2**31 - 1))


def key_column(c: str) -> F.Column:
    return F.substring_index(F.substring_index(F.col(c).cast("string"), " ", 1), "\t", 1)


def molecules(rows: DataFrame, id_col: str, text_col: str, batch: F.Column, routes: int) -> DataFrame:
    """Each different molecule of each batch with its smallest id, described; and for rows of batches each different text.

    One row for each (batch, certificate): equal texts are combined before parsing, equal certificates after.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                place, route, vector, cert, hashed = describe(b["text"].to_pylist())
                take = pa.array(place)
                c = cert.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((route % np.uint64(routes)).astype(np.int32)), b["batch"].take(take), b["id"].take(take), b["text"].take(take), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(hashed.view(np.int64)), pa.array([v.astype(np.float32).tobytes() for v in vector], pa.binary())],
                    names=["route", "batch", "id", "text", "c1", "c2", "hashed", "vector"],
                )

    keyed = rows.select(F.col(id_col).cast("long").alias("id"), key_column(text_col).alias("text"), batch.cast("int").alias("batch")).where("id is not null and text is not null and text <> ''")
    once = keyed.groupBy("text", "batch").agg(F.min("id").alias("id"))
    return once.select("batch", "id", "text").repartition(tasks_for(rows.sparkSession, rows.count(), 20_000)).mapInArrow(each, _MOLECULES)


def _nodes(g: pd.DataFrame) -> Shard:
    return Shard(g["id"].to_numpy(np.int64), g[["c1", "c2"]].to_numpy(np.int64).view(np.uint64), g["hashed"].to_numpy(np.int64).view(np.uint64), g["text"].tolist(), np.stack([np.frombuffer(v, np.float32) for v in g["vector"]]) if len(g) else np.zeros((0, DIMENSIONS), np.float32))


def _distinct(mols: DataFrame) -> DataFrame:
    """One row for each certificate and batch, with the smallest id; combined before the shuffle."""
    rest = F.min(F.struct("id", "text", "hashed", "vector", "route")).alias("m")
    return mols.groupBy("batch", "c1", "c2").agg(rest).select("batch", "c1", "c2", "m.id", "m.text", "m.hashed", "m.vector", "m.route")


def _as_shards(distinct: DataFrame, routes: int) -> DataFrame:
    """One shard for each route that has molecules."""

    def each(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"route": key[0], "segment": 0, "n_molecules": len(g)} | _nodes(g).packed()])

    return distinct.repartition(routes, "route").groupBy("route").applyInPandas(each, _SHARD_SQL)


def build(history: DataFrame, routes: int, id_col: str = "mol_id", text_col: str = "smiles") -> DataFrame:
    """The shards of a first segment: one row for each route. Write it where later batches find it."""
    return _as_shards(_distinct(molecules(history, id_col, text_col, F.lit(0), routes)), routes)


_FOUND_SQL = "first_id long, batch int, c1 long, c2 long, id long"


def _tier(n: int) -> int:
    """Size class of a shard or segment of n molecules."""
    return int(math.log(max(1, n), COMPACT_AT))


def _due(sizes: list[int]) -> list[int]:
    """Places of what should be merged next: ``COMPACT_AT`` or more of one size class, the smallest first; none if nothing is due."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by.setdefault(_tier(n), []).append(i)
    return next((by[t] for t in sorted(by) if len(by[t]) >= COMPACT_AT), [])


def _looked_up(batch: object, g: pd.DataFrame, s: Shard, first: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"first_id": first, "batch": batch, "c1": g["c1"].to_numpy(), "c2": g["c2"].to_numpy(), "id": s.first})


def absorb(shards: DataFrame, batches: DataFrame, routes: int | None = None) -> DataFrame:
    """Looks up the molecules of batches, in the order of their numbers, in all shards and in one another: ``first_id`` for each.

    ``batches`` is what ``_distinct(molecules(...))`` gives. Each batch becomes a new shard of its routes before the
    next one comes; shards of one size are merged as in ``History``. Where a later batch holds smaller ids, the
    batches before it are looked up in it, too.
    """

    def each(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = [Shard.unpacked(r) for r in old.sort_values("segment").to_dict("records")]
        young: list[Shard] = []
        seen: list[tuple[object, pd.DataFrame, Shard, np.ndarray]] = []
        for batch, g in new.groupby("batch", sort=True):
            s = _nodes(g)
            vector = s.graph.vectors[s.node]
            first = s.first.copy()
            for h in [*held, s, *young]:
                f = h.find(vector, s.certificate, s.hashed, s.text)
                first = np.where((f >= 0) & (f < first), f, first)
            for _, _, t, before in seen:
                if len(t.first) and int(t.first.max()) > int(s.first.min()):  # ids out of the order of batches
                    f = s.find(t.graph.vectors[t.node], t.certificate, t.hashed, t.text)
                    np.copyto(before, f, where=(f >= 0) & (f < before))
            seen.append((batch, g, s, first))
            young.append(s)
            while due := _due([len(x.first) for x in young]):
                young = [*[x for i, x in enumerate(young) if i not in due], Shard.merged([young[i] for i in due])]
        out = [_looked_up(batch, g, s, first) for batch, g, s, first in seen]
        return pd.concat(out) if out else pd.DataFrame(columns=["first_id", "batch", "c1", "c2", "id"])

    if routes:  # stated partitions: shards and batches of a route meet, and no task gets many routes because they are small
        shards, batches = shards.repartition(routes, "route"), batches.repartition(routes, "route")
    return shards.groupBy("route").cogroup(batches.groupBy("route")).applyInPandas(each, _FOUND_SQL)


def _rows_found(batches: DataFrame, mols: DataFrame, found: DataFrame, rec_col: str, batch: F.Column, text_col: str) -> DataFrame:
    """``first_id, rec_id`` of the rows of the batches, from what was found for their molecules."""
    by_text = mols.select("batch", "text", "c1", "c2").join(found.select("first_id", "batch", "c1", "c2"), ["batch", "c1", "c2"]).select("batch", "text", "first_id")
    rows = batches.select(F.col(rec_col).cast("long").alias("rec_id"), key_column(text_col).alias("text"), batch.alias("batch"))
    return rows.join(by_text, ["batch", "text"]).where("first_id < rec_id").select("first_id", "rec_id").distinct()


def _routes(spark, rows: int) -> int:  # noqa: ANN001
    return max(4 * slots(spark), math.ceil(rows / ROUTE_ROWS))


def repeats(history: DataFrame, batches: DataFrame, id_col: str = "mol_id", rec_col: str = "rec_id", batch_col: str = "batch_no", text_col: str = "smiles") -> DataFrame:
    """``first_id, rec_id`` of each row of the batches whose molecule stands in an earlier record."""
    routes = _routes(history.sparkSession, history.count() + batches.count())
    shards = stage(build(history, routes, id_col, text_col), "shards")
    mols = stage(molecules(batches, rec_col, text_col, _batch(batch_col), routes), "batches")
    found = absorb(shards, _distinct(mols), routes=routes)
    return _rows_found(batches, mols, found, rec_col, _batch(batch_col), text_col)


class History:
    """Segments of shards under a folder that all executors share, to which batches are added call by call.

    ``segment=<n>`` holds a shard for each route. The catalog, in versions of which the greatest complete one counts,
    names the live segments with their numbers of molecules, and the number of routes, which is stated once.
    """

    def __init__(self, spark, path: str) -> None:  # noqa: ANN001
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalog")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if exists(self.spark, f"{self.path}/catalog/{n}/_SUCCESS"))

    def catalog(self) -> DataFrame:
        """``segment, n_molecules, routes`` of the live segments; as many rows as a logarithm of the history."""
        v = self._versions()
        if not v:
            raise FileNotFoundError(f"no history at {self.path}")
        return self.spark.read.parquet(f"{self.path}/catalog/v={v[-1]}")

    def _write(self, rows: list[tuple[int, int, int]]) -> None:
        df = self.spark.createDataFrame(rows, "segment int, n_molecules long, routes int")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog/v={max(self._versions(), default=0) + 1}")

    def _segment(self, n: int, shards: DataFrame) -> int:
        """Writes a segment, a file for some routes each; its number of molecules."""
        shards.withColumn("segment", F.lit(n)).sortWithinPartitions("route").write.mode("overwrite").option("parquet.block.size", 1 << 22).parquet(f"{self.path}/segment={n}")
        return self.spark.read.parquet(f"{self.path}/segment={n}").agg(F.coalesce(F.sum("n_molecules"), F.lit(0))).first()[0]

    def create(self, records: DataFrame, id_col: str = "mol_id", text_col: str = "smiles", expected: int = 0) -> None:
        """The first segment. ``expected`` records in all decide how many routes there are."""
        routes = _routes(self.spark, max(expected, records.count()))
        n = self._segment(0, build(records, routes, id_col, text_col))
        self._write([(0, n, routes)])

    def shards(self, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(_SHARD_SQL).parquet(*[f"{self.path}/segment={n}" for n in segments])

    def add(self, batch: DataFrame, rec_col: str = "rec_id", text_col: str = "smiles", compact: bool = True) -> DataFrame:
        """``first_id, rec_id`` of the batch's repeats; the batch becomes a segment, and merging follows if it is due.

        Only shards of the routes that the batch's molecules take are read.
        """
        live = [tuple(r) for r in self.catalog().collect()]
        routes, number = live[0][2], max(int(r[0]) for r in live) + 1
        mols = stage(molecules(batch, rec_col, text_col, F.lit(0), routes), "batch")
        new = _distinct(mols)
        touched = [r["route"] for r in mols.select("route").distinct().collect()]  # at most ``routes`` numbers
        old = self.shards([r[0] for r in live])
        found = stage(absorb(old.where(F.col("route").isin(touched)) if len(touched) < routes else old, new, routes=min(routes, max(1, len(touched)))), "found")
        n = self._segment(number, _as_shards(new, routes))
        self._write([*live, (number, n, routes)])
        if compact:
            self.compact()
        return _rows_found(batch, mols, found, rec_col, F.lit(0), text_col)

    def compact(self) -> int:
        """Merges live segments as long as some are due; how many segments are live then."""
        while True:
            live = [tuple(r) for r in self.catalog().orderBy("segment").collect()]
            due = _due([r[1] for r in live])
            if not due:
                return len(live)
            old, routes = [live[i] for i in due], live[0][2]
            number = max(r[0] for r in live) + 1

            def each(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
                one = Shard.merged([Shard.unpacked(r) for r in g.sort_values("segment").to_dict("records")])
                return pd.DataFrame([{"route": key[0], "segment": 0, "n_molecules": len(one.first)} | one.packed()])

            parts = self.shards([r[0] for r in old]).repartition(routes, "route")
            n = self._segment(number, parts.groupBy("route").applyInPandas(each, _SHARD_SQL))
            self._write([*[r for i, r in enumerate(live) if i not in due], (number, n, routes)])

    def vacuum(self) -> None:
        """Deletes segments that are no longer live; not to be called while others read."""
        live = {r["segment"] for r in self.catalog().collect()}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("segment=") and int(name.split("=")[1]) not in live:
                fs.delete(x.getPath(), True)


def exact_classes(mols: DataFrame) -> DataFrame:
    """Rows of ``molecules`` with the certificate of their class, ``k1, k2``: exact where certificates of one skeleton differ.

    Equal certificates are one skeleton. Of skeletons with equal colour hash and different certificates, which are few, each is tested against
    the classes found so far.
    """

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["c1", "c2"], ignore_index=True)
        graphs = [main_component(parse(t)) for t in g["text"]]
        heads: list[int] = []
        to = []
        for i, x in enumerate(graphs):
            h = next((h for h in heads if canon.isomorphic(graphs[h], x)), None)
            if h is None:
                heads.append(i)
            to.append(i if h is None else h)
        return pd.DataFrame({"c1": g["c1"], "c2": g["c2"], "k1": g["c1"].to_numpy()[to], "k2": g["c2"].to_numpy()[to]})

    kinds = mols.groupBy("hashed", "c1", "c2").agg(F.min("text").alias("text"))
    several = kinds.groupBy("hashed").agg(F.count("*").alias("n")).where("n > 1").select("hashed")
    other = kinds.join(several, "hashed", "left_semi").groupBy("hashed").applyInPandas(each, "c1 long, c2 long, k1 long, k2 long")
    return mols.join(other, ["c1", "c2"], "left").withColumn("k1", F.coalesce("k1", "c1")).withColumn("k2", F.coalesce("k2", "c2"))


def recall(history: DataFrame, batches: DataFrame, id_col: str = "mol_id", rec_col: str = "rec_id", batch_col: str = "batch_no", text_col: str = "smiles") -> DataFrame:
    """One row: true repeats by exact grouping of all records, those found with the right first id, rows given too many, and the share lost."""
    a = molecules(history, id_col, text_col, F.lit(-1), 1).select("id", "batch", "text", "c1", "c2", "hashed")
    b = molecules(batches, rec_col, text_col, _batch(batch_col), 1).select("id", "batch", "text", "c1", "c2", "hashed")
    named = stage(exact_classes(stage(a.unionByName(b), "all")), "classes")
    first = named.groupBy("k1", "k2").agg(F.min("id").alias("first_id"))
    by_text = named.select("text", "k1", "k2").distinct().join(first, ["k1", "k2"]).select("text", "first_id")
    rows = batches.select(F.col(rec_col).cast("long").alias("rec_id"), key_column(text_col).alias("text")).distinct()
    truth = rows.join(by_text, "text").where("first_id < rec_id").select("first_id", "rec_id").distinct().withColumn("true", F.lit(1))
    got = repeats(history, batches, id_col, rec_col, batch_col, text_col).withColumn("got", F.lit(1))
    j = truth.join(got, ["first_id", "rec_id"], "full")
    return j.agg(F.count("true").alias("n_true"), F.count(F.when(F.col("true").isNotNull(), F.col("got"))).alias("n_found"), F.count(F.when(F.col("true").isNull(), F.col("got"))).alias("n_wrong")).select(
        "n_true", "n_found", "n_wrong", F.coalesce(1 - F.try_divide("n_found", "n_true"), F.lit(0.0)).alias("share_lost")
    )
