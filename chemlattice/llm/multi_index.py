"""Most similar fingerprints for every fingerprint, by an inverted multi-index.

The bits, weighted by rarity, are dealt into two halves. A codebook of K
centroids is fitted for each half on a bounded sample (``SAMPLE`` classes,
those with the smallest hashes). Every fingerprint is then filed under the
pair of its nearest centroids, a cell of a K x K grid; K grows with the root of
the number of fingerprints, so that there are ``CELL_ROWS`` for each cell.

A query visits cells in order of the summed distances of the two halves,
until the cells it has met hold ``CANDIDATES`` fingerprints and are ``LEAST_CELLS``, so
that denser data do not narrow the search. The order comes from a heap, which
holds the next cell of each first-half centroid and never sorts the grid; the heaps of a
block of queries are the rows of one array and advance together. Where
the ``REACH`` nearest centroids of the halves do not hold enough, further ones are taken in, up to all.
The fingerprints met are reranked by exact likeness, cell by cell, all queries of a cell
at once. A pair met from either side counts for both.

Work is split by cells: ranges of first-half centroids form parts of about
equal work, as foreseen from a sample of queries. Each part receives its own
fingerprints and the queries that visit it. A centroid with more work than a
part should have gets several: its queries are dealt among them and its rows
copied, and beyond ``PART_ROWS`` its rows are dealt too. Equal fingerprints are one
class throughout, so copies are compared once; the classes' members are
joined to the result at the end.

The codebooks and the counts of the cells, 12 K^2 bytes, are sent to all tasks;
K is at most ``MAX_K``, whatever the size of the data.

Defined results: likeness ties go to the smaller id; see ``fingerprints`` for
rows that take no part; fewer than ``k`` neighbours come out where fewer
reach ``least``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chemlattice.llm.fingerprints import N_BITS, WORDS, classes, matrix, members, unpack, valid
from chemlattice.session import partition_keys, slots, stage, tasks_for

SAMPLE = 20_000
CANDIDATES = 1500
LEAST_CELLS = 24  # filled cells that a query visits at least, however full they are
MAX_K = 1024
CELL_ROWS = 1.4  # fingerprints for each cell of the grid; as they crowd together, most cells are empty and the others hold some twenty times as many
PART_ROWS = 100_000
ROUNDS = 6
WORK_SAMPLE = 2000  # sample queries from which the parts' work is foreseen
REACH = 48  # centroids of each half that a query combines at first
BLOCK = 400_000  # pairs reranked at a time
ASKED = 40_000  # queries of a part that are answered together


class Codebook:
    """Two halves of the weighted bits and their centroids."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        bits = unpack(sample).astype(np.float32)
        share = bits.mean(axis=0) if len(bits) else np.zeros(N_BITS, np.float32)
        weight = np.log(1 / np.maximum(share, 1e-4)).astype(np.float32)
        by_share = np.argsort(-share, kind="stable")
        self.half = [np.sort(by_share[0::2]), np.sort(by_share[1::2])]
        self.weight = [weight[h] for h in self.half]
        self.k = k
        self.centroids = [self._fit(bits[:, h] * w, k) for h, w in zip(self.half, self.weight)]
        self.norms = [(c**2).sum(axis=1) for c in self.centroids]

    @staticmethod
    def _fit(x: np.ndarray, k: int) -> np.ndarray:
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(ROUNDS):
            near = np.concatenate([((c**2).sum(axis=1)[None] - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4000))])
            order = np.argsort(near, kind="stable")
            held, start = np.unique(near[order], return_index=True)
            sums = np.add.reduceat(x[order], start, axis=0)
            c[held] = sums / np.diff(np.append(start, len(x)))[:, None]
        return c

    def distances(self, words: np.ndarray) -> list[np.ndarray]:
        """Squared distances, less the fingerprint's own norm, to the centroids of each half."""
        bits = unpack(words)
        return [n[None] - 2 * ((bits[:, h] * w) @ c.T) for h, w, c, n in zip(self.half, self.weight, self.centroids, self.norms)]


def traverse(dist: list[np.ndarray], k: int, counts: np.ndarray, enough: int, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Query and cell, for filled cells in order of summed distance until they are ``LEAST_CELLS`` and hold ``enough``.

    ``dist`` has the queries' distances to the centroids of each half.
    """
    n = len(dist[0])
    reach = min(reach, k)
    near = [np.argpartition(x, reach - 1, axis=1)[:, :reach] for x in dist]
    near = [np.take_along_axis(i, np.argsort(np.take_along_axis(x, i, 1), axis=1, kind="stable"), 1) for x, i in zip(dist, near)]
    d0, d1 = (np.take_along_axis(x, i, 1).astype(np.float32) for x, i in zip(dist, near))
    d1 = np.concatenate([d1, np.full((n, 1), np.inf, np.float32)], axis=1)
    heap = d0 + d1[:, :1]  # for each first-half centroid, the next cell's distance
    at = np.zeros((n, reach), np.int64)
    who, held, met = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    queries, cells, short = [], [], []
    while len(who):
        row = np.arange(len(who))
        i = heap.argmin(axis=1)
        j = at[row, i]
        gone = ~np.isfinite(heap[row, i])  # all combinations are used up
        if gone.any():
            if reach < k:
                short.append(who[gone])
            who, heap, at, d0, d1, held, met = (x[~gone] for x in (who, heap, at, d0, d1, held, met))
            continue
        cell = near[0][who, i] * k + near[1][who, j]
        c = counts[cell]
        full = c > 0
        queries.append(who[full])
        cells.append(cell[full])
        held, met = held + c, met + full
        at[row, i] = j + 1
        heap[row, i] = d0[row, i] + d1[row, j + 1]
        go = (held < enough) | (met < LEAST_CELLS)
        if not go.all():
            who, heap, at, d0, d1, held, met = (x[go] for x in (who, heap, at, d0, d1, held, met))
    q, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (queries, cells))
    if short:
        again = np.concatenate(short)
        ok = ~np.isin(q, again)
        more = traverse([x[again] for x in dist], k, counts, enough, 4 * reach)
        q, c = np.concatenate([q[ok], again[more[0]]]), np.concatenate([c[ok], more[1]])
    order = np.argsort(q, kind="stable")
    return q[order], c[order]


class Plan:
    """Which parts hold a first-half centroid's rows, and which of them a query visits.

    A centroid's parts form a grid of ``rows`` by ``asks``: a filed row lies in one line of it, a query goes to one
    column, so that each pair of them meets once. Centroids with little work share a part.
    """

    def __init__(self, counts: np.ndarray, k: int, work: np.ndarray, centroids: np.ndarray, at_least: int) -> None:
        self.counts = counts
        load = counts.reshape(k, k).sum(axis=1)
        fair = max(1.0, work.sum() / at_least)
        self.rows = np.maximum(1, -(-load // PART_ROWS)).astype(np.int32)
        self.asks = np.maximum(1, np.ceil(work / self.rows / fair)).astype(np.int32)
        centred = centroids - centroids.mean(axis=0)
        line = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if k > 1 else np.zeros(k)
        self.first = np.zeros(k, np.int32)
        part, held = 0, 0.0
        for c in np.argsort(line, kind="stable"):  # alike centroids, which the same queries visit, get near parts
            many = int(self.rows[c] * self.asks[c])
            if held and (many > 1 or held + work[c] > fair):
                part, held = part + 1, 0.0
            self.first[c] = part
            held += float(work[c])
            if many > 1:
                part, held = part + many, 0.0
        self.parts = part + 1
        self.keys = np.arange(self.parts, dtype=np.int32)


def _work(book: Codebook, sample: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Comparisons by first-half centroid that a sample of queries causes."""
    cells = traverse(book.distances(sample), book.k, counts, enough)[1]
    return 1 + np.bincount(cells // book.k, weights=counts[cells], minlength=book.k)


_ROUTED_SQL = "part int, query boolean, rep long, cell int, cells binary, " + ", ".join(f"{w} long" for w in WORDS)
_ROUTED = pa.schema([("part", pa.int32()), ("query", pa.bool_()), ("rep", pa.int64()), ("cell", pa.int32()), ("cells", pa.binary()), *[(w, pa.int64()) for w in WORDS]])


def _file(book, k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a0, a1 = (d.argmin(axis=1) for d in book.value.distances(matrix(b)))
                yield pa.RecordBatch.from_arrays([b["rep"], pa.array((a0 * k + a1).astype(np.int32)), *[b[w] for w in WORDS]], names=["rep", "cell", *WORDS])

    return each


def _route(book, plan, k: int, enough: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        counts, keys = p.counts, p.keys
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rep, cell = b["rep"].to_numpy(), b["cell"].to_numpy()
                home = cell // k
                copies = p.asks[home]
                filed_row = np.repeat(np.arange(b.num_rows), copies)
                column = np.arange(len(filed_row)) - np.repeat(np.cumsum(copies) - copies, copies)
                h = home[filed_row]
                where = keys[p.first[h] + (rep[filed_row] % p.rows[h]) * p.asks[h] + column]
                asker, met = traverse(book.value.distances(matrix(b)), k, counts, enough)
                h = met // k
                lines = p.rows[h]
                each_line = np.repeat(np.arange(len(met)), lines)
                line = np.arange(len(each_line)) - np.repeat(np.cumsum(lines) - lines, lines)
                h, who = h[each_line], asker[each_line]
                to = p.first[h] + (rep[who] // 7) % p.asks[h] + line * p.asks[h]
                order = np.lexsort((to, who))
                who, to, flat = who[order], to[order], met[each_line][order].astype(np.int32)
                new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (to[1:] != to[:-1]))) if len(who) else np.zeros(0, np.int64)
                row, part = who[new], keys[to[new]]
                cells = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((4 * np.append(new, len(flat))).astype(np.int32)), pa.py_buffer(flat)])
                take, f = pa.array(row, pa.int64()), pa.array(filed_row)
                n, q = len(filed_row), len(row)
                filed = [pa.array(where), pa.array(np.zeros(n, bool)), b["rep"].take(f), b["cell"].take(f), pa.nulls(n, pa.binary()), *[b[w].take(f) for w in WORDS]]
                asked = [pa.array(part, pa.int32()), pa.array(np.ones(q, bool)), b["rep"].take(take), pa.array(np.zeros(q, np.int32)), cells, *[b[w].take(take) for w in WORDS]]
                yield pa.RecordBatch.from_arrays(filed, schema=_ROUTED)
                yield pa.RecordBatch.from_arrays(asked, schema=_ROUTED)

    return each


_PAIR_SQL = "rep long, other long, likeness double"
_PAIR = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("likeness", pa.float64())])


def best(owner: np.ndarray, other: np.ndarray, likeness: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best: greatest likeness, then smallest other."""
    order = np.lexsort((other, -likeness, owner))
    o = owner[order]
    new = np.append(True, o[1:] != o[:-1]) if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0)) if len(o) else np.zeros(0, int)
    return order[np.arange(len(o)) - start < k]


def _rerank(k: int, least: float):
    """Rows of a part in order: what is filed, by cell, then the queries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filed, index, asked, waiting = None, [], None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            p, q = b["part"].to_numpy(), b["query"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(p)]):
                piece = b.slice(lo, hi - lo)
                if p[lo] != part:
                    if asked:
                        yield from _answer(asked, index, k, least)
                    part, filed, index, asked, waiting = p[lo], [], None, [], 0
                if not q[lo]:
                    filed.append((piece["rep"].to_numpy(), piece["cell"].to_numpy(), matrix(piece)))
                    continue
                if index is None:
                    if not filed:
                        continue
                    reps, cells, words = (np.concatenate(x) for x in zip(*filed))
                    held, start = np.unique(cells, return_index=True)
                    index = (reps, np.ascontiguousarray(words.T), np.bitwise_count(words).sum(axis=1, dtype=np.int32), held, np.append(start, len(cells)))
                    filed = []
                asked.append(piece)
                waiting += piece.num_rows
                if waiting >= ASKED:
                    yield from _answer(asked, index, k, least)
                    asked, waiting = [], 0
        if asked:
            yield from _answer(asked, index, k, least)

    return each


def _answer(pieces: list[pa.RecordBatch], index: tuple, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """All queries of each cell against all of its rows, one word of both at a time."""
    b = pa.Table.from_batches(pieces).combine_chunks()
    reps, words, size, held, start = index
    rep = b["rep"].to_numpy()
    own = np.stack([b[w].to_numpy().view(np.uint64) for w in WORDS])
    own_size = np.bitwise_count(own).sum(axis=0, dtype=np.int32)
    lists = [np.frombuffer(x, np.int32) for x in b["cells"].to_pylist()]
    asker = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    wanted = np.concatenate(lists)
    order = np.argsort(wanted, kind="stable")
    asker, wanted = asker[order], wanted[order]
    cells, first = np.unique(wanted, return_index=True)
    at = np.searchsorted(held, cells)
    at[at == len(held)] = 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c, lo, hi in zip(at[held[at] == cells].tolist(), first[held[at] == cells].tolist(), np.append(first[1:], len(wanted))[held[at] == cells].tolist()):
        for s in range(start[c], start[c + 1], BLOCK // 16):
            rows = slice(s, min(s + BLOCK // 16, int(start[c + 1])))
            n = rows.stop - rows.start
            for x in range(lo, hi, max(1, BLOCK // n)):
                who = asker[x : min(hi, x + max(1, BLOCK // n))]
                both = np.zeros((len(who), n), np.uint16)
                for i in range(len(WORDS)):
                    both += np.bitwise_count(own[i, who][:, None] & words[i, rows][None])
                # Likeness of at least ``least``: shared bits are a share of the sum of sizes.
                q, r = np.nonzero(both >= (least / (1 + least)) * (own_size[who][:, None] + size[rows][None]) - 1e-6)
                if len(q):
                    shared = both[q, r].astype(np.float64)
                    like = shared / (own_size[who[q]] + size[rows][r] - shared)
                    ok = (like >= least) & (rep[who[q]] != reps[rows][r])
                    found.append((rep[who[q[ok]]], reps[rows][r[ok]], like[ok]))
    if found:
        a, o, x = (np.concatenate(y) for y in zip(*found))
        for owner, other in ((a, o), (o, a)):
            top = best(owner, other, x, k)
            yield pa.RecordBatch.from_arrays([pa.array(owner[top]), pa.array(other[top]), pa.array(x[top])], schema=_PAIR)


def class_neighbours(cls: DataFrame, k: int = 5, least: float = 0.6, candidates: int = CANDIDATES) -> DataFrame:
    """``rep, other, likeness``: up to k most alike other classes of each class; ``cls`` should be a written table."""
    spark = cls.sparkSession
    n = cls.count()
    grid = max(2, min(MAX_K, math.ceil(math.sqrt(n / CELL_ROWS))))
    head = cls.orderBy("h1", "h2").limit(SAMPLE).select(*WORDS).toPandas()
    if not len(head):
        return spark.createDataFrame([], _PAIR_SQL)
    sample = np.stack([head[w].to_numpy().view(np.uint64) for w in WORDS], axis=1)
    grid = min(grid, max(1, len(sample)))
    codebook = Codebook(sample, grid)
    book = spark.sparkContext.broadcast(codebook)
    filed = stage(cls.select("rep", *WORDS).mapInArrow(_file(book, grid), "rep long, cell int, " + ", ".join(f"{w} long" for w in WORDS)), "cells")  # as many files as it has tasks
    at_cell = filed.groupBy("cell").count().toPandas()  # at most grid^2 rows
    counts = np.zeros(grid * grid, np.int32)
    counts[at_cell["cell"].to_numpy()] = at_cell["count"].to_numpy()
    work = _work(codebook, sample[:: max(1, len(sample) // WORK_SAMPLE)], counts, candidates)
    layout = Plan(counts, grid, work, codebook.centroids[0], 4 * slots(spark))
    layout.keys = np.array(partition_keys(spark, layout.parts), np.int32)
    plan = spark.sparkContext.broadcast(layout)
    routed = filed.mapInArrow(_route(book, plan, grid, candidates), _ROUTED_SQL)
    met = routed.repartition(layout.parts, "part").sortWithinPartitions("part", "query", "cell").mapInArrow(_rerank(k, least), _PAIR_SQL)
    order = Window.partitionBy("rep").orderBy(F.desc("likeness"), "other")
    return met.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def neighbour_pairs(table: DataFrame, k: int = 5, least: float = 0.6, candidates: int = CANDIDATES) -> DataFrame:
    """``mol_id_a, mol_id_b`` with a < b: pairs in which either is among the k most alike others of the other.

    Only others with likeness ``least`` or more count. Recall is that of the index (see ``recall``).
    """
    rows = valid(table)
    mem = stage(members(rows), "members")
    cls = stage(classes(rows), "classes", tasks_for(table.sparkSession, table.count(), 50_000))
    alike = class_neighbours(cls, k, least, candidates)
    return _expand(mem, cls, alike, k)


def _expand(mem: DataFrame, cls: DataFrame, alike: DataFrame, k: int) -> DataFrame:
    """Pairs of molecules from classes."""
    pairs = _nearest(mem, cls, alike, k)
    return pairs.select(F.least("mol_id", "near").alias("mol_id_a"), F.greatest("mol_id", "near").alias("mol_id_b")).distinct()


def _nearest(mem: DataFrame, cls: DataFrame, alike: DataFrame, k: int, every: int = 1) -> DataFrame:
    """``mol_id, near`` of the molecules whose id is divisible by ``every``, from classes.

    A class's k + 1 best members of its own and of its k best classes hold every answer.
    """
    named = mem.join(cls.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "mol_id")
    small = named.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("mol_id"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("other"), F.col("mol_id").alias("near"))
    reach = alike.unionByName(cls.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("likeness")))
    order = Window.partitionBy("rep").orderBy(F.desc("likeness"), "near")
    lists = (
        reach.join(small, "other")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "near"))).alias("best"))  # at most k + 1 entries
        .where((F.size("best") > 1) | (F.element_at("best", 1)["near"] != F.col("rep")))
    )
    own = F.slice(F.filter(F.transform("best", lambda x: x["near"]), lambda x: x != F.col("mol_id")), 1, k)
    return named.where(F.col("mol_id") % every == 0).join(lists, "rep").select("mol_id", F.explode(own).alias("near"))


_EXACT_ROWS = 2048


def exact_class_neighbours(cls: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    """Brute force for a stated set of classes: blocks of queries against all classes, by matrix products."""
    spark = cls.sparkSession
    blocks = max(1, math.ceil(asked.count() / _EXACT_ROWS))
    salts = max(1, math.ceil(2 * slots(spark) / blocks))
    q = asked.select(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("corpus"), "rep", *WORDS)
    c = cls.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("corpus"), "rep", *WORDS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ask = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b["block"].to_numpy().astype(np.int64) * 2**32 + b["salt"].to_numpy()
            corpus = b["corpus"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (corpus[1:] != corpus[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                piece = b.slice(lo, hi - lo)
                if key[lo] != at:
                    at, held, ask = key[lo], [], None
                if not corpus[lo]:
                    held.append((piece["rep"].to_numpy(), matrix(piece)))
                    continue
                if not held:
                    continue
                if ask is None:
                    r, w = (np.concatenate(x) for x in zip(*held))
                    ask = (r, unpack(w).astype(np.float32), np.bitwise_count(w).sum(axis=1))
                for s in range(0, piece.num_rows, 2000):
                    t = piece.slice(s, 2000)
                    w = matrix(t)
                    both = ask[1] @ unpack(w).astype(np.float32).T
                    union = ask[2][:, None] + np.bitwise_count(w).sum(axis=1)[None] - both
                    i, j = np.nonzero(both >= (least - 1e-9) * union)
                    a, o, x = ask[0][i], t["rep"].to_numpy()[j], both[i, j].astype(np.float64) / union[i, j]
                    ok = (x >= least) & (a != o)
                    a, o, x = a[ok], o[ok], x[ok]
                    top = best(a, o, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(a[top]), pa.array(o[top]), pa.array(x[top])], schema=_PAIR)

    met = q.unionByName(c).repartition(blocks * salts, "block", "salt").sortWithinPartitions("block", "salt", "corpus").mapInArrow(each, _PAIR_SQL)
    order = Window.partitionBy("rep").orderBy(F.desc("likeness"), "other")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def recall(table: DataFrame, k: int = 5, least: float = 0.6, every: int = 20) -> DataFrame:
    """One row: true neighbours of the molecules whose id is divisible by ``every``, those found, and the share lost.

    Classes are compared once; copies count as the molecules they are.
    """
    rows = valid(table)
    mem = stage(members(rows), "members")
    cls = stage(classes(rows), "classes", tasks_for(table.sparkSession, table.count(), 50_000))
    asked = cls.join(mem.where(F.col("mol_id") % every == 0).select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    got = _nearest(mem, cls, class_neighbours(cls, k, least), k, every).withColumn("got", F.lit(1))
    truth = _nearest(mem, cls, exact_class_neighbours(cls, asked, k, least), k, every)
    j = truth.join(got, ["mol_id", "near"], "left")
    return j.agg(F.count("*").alias("n_true"), F.count("got").alias("n_found")).select("n_true", "n_found", F.coalesce(1 - F.try_divide("n_found", "n_true"), F.lit(0.0)).alias("share_lost"))
