"""Fingerprint screening and similarity search, with interchangeable pruning strategies.

A fingerprint table has rows ``mol_id, fp_name, n_bits, fingerprint``. Rows
without id or fingerprint take no part; rows delivered twice count once (the
repeated hit is removed after filtering, so the scan itself needs no
shuffle). Results of a search on an empty table are empty. A query without
bits is contained in everything and similar to nothing.

The strategies give the same result and differ in what they let the scan
skip: see ``STRATEGIES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chemlattice.functions import bits as B
from chemlattice.session import spread

SLACK = 1e-9


@dataclass
class Query:
    """A fingerprint to search with."""

    words: list[int]
    n_bits: int
    fp_name: str = "Path"
    bits: list[int] = field(init=False)

    def __post_init__(self) -> None:
        """Missing words are zero, as in a table; a set bit beyond the width is an error."""
        self.words = [int(w or 0) for w in self.words]
        if any(self.words[(self.n_bits + 63) // 64 :]) or (self.n_bits % 64 and len(self.words) * 64 > self.n_bits and self.words[self.n_bits // 64] >> (self.n_bits % 64) not in (0, -1)):
            raise ValueError(f"the query is wider than {self.n_bits} bits")
        self.words = self.words[: (self.n_bits + 63) // 64]
        self.words += [0] * ((self.n_bits + 63) // 64 - len(self.words))
        self.bits = B.host_bits(self.words, self.n_bits)


def of_kind(table: DataFrame, fp_name: str) -> DataFrame:
    return table.where((F.col("fp_name") == fp_name) & F.col("mol_id").isNotNull() & F.col("fingerprint").isNotNull())


def query_of(table: DataFrame, mol_id: int, fp_name: str = "Path") -> Query | None:
    """The fingerprint of one molecule (point lookup), or None."""
    r = of_kind(table, fp_name).where(F.col("mol_id") == mol_id).select("fingerprint", "n_bits").first()
    return Query(list(r["fingerprint"]), int(r["n_bits"]), fp_name) if r else None


# Strategies: predicates that every hit meets and that are cheaper than the full test.

Predicate = Callable[[list[Column], Query, Column], Column | None]


def _no_screen(w: list[Column], q: Query, n: Column) -> Column | None:
    return None


def _popcount_screen(w: list[Column], q: Query, n: Column) -> Column:
    return n >= len(q.bits)


def _segment_screen(w: list[Column], q: Query, n: Column, k: int = 4) -> Column:
    own = B.segments(B.literals(q.words), k)
    out = F.lit(True)
    for have, want in zip(B.segments(w, k), own):
        out = out & (have >= want)
    return out


def popcount_band(bits: Column, n: int, t: float) -> Column:
    """Sizes that can reach likeness t with a fingerprint of n bits."""
    if t <= 0:
        return F.lit(True)
    return bits.between(math.ceil(t * n - SLACK), math.floor(n / t + SLACK))


def _band(w: list[Column], q: Query, n: Column, t: float) -> Column:
    return popcount_band(n, len(q.bits), t)


def _segment_band(w: list[Column], q: Query, n: Column, t: float, k: int = 4) -> Column:
    """Sum of the smaller over sum of the larger segment counts bounds the likeness from above."""
    pairs = list(zip(B.segments(w, k), B.segments(B.literals(q.words), k)))
    low = sum((F.least(a, b) for a, b in pairs), F.lit(0))
    high = sum((F.greatest(a, b) for a, b in pairs), F.lit(0))
    return low >= F.lit(t - SLACK) * high


STRATEGIES: dict[str, tuple[Predicate, Callable[[list[Column], Query, Column, float], Column] | None]] = {
    "brute": (_no_screen, None),
    "popcount": (_popcount_screen, _band),
    "segments": (_segment_screen, _segment_band),
    "mixed": (_popcount_screen, _segment_band),
}


def _strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def _count(w: list[Column], counted: str | None) -> Column:
    return F.col(counted) if counted else B.popcount(w)


def indexed(table: DataFrame, fp_name: str, n_bits: int) -> DataFrame:
    """A table to be searched often: ``mol_id, fp_name, fingerprint, n`` once each, ``n`` the true bit count, sorted by it.

    Written as Parquet, its row groups hold narrow ranges of ``n``, so the bounds of a search (``counted="n"``) reach the scan.
    """
    w = B.words("fingerprint", n_bits)
    rows = of_kind(table, fp_name).select(F.col("mol_id").cast("long").alias("mol_id"), "fp_name", F.array(*w).alias("fingerprint"), B.popcount(w).cast("int").alias("n"))
    return rows.distinct().repartitionByRange("n", "mol_id").sortWithinPartitions("n", "mol_id")


def screen(table: DataFrame, q: Query, strategy: str = "popcount", limit: int = 0, counted: str | None = None) -> DataFrame:
    """``mol_id`` of the molecules whose fingerprint contains the query's; by id, at most ``limit`` (0: all).

    ``counted`` names a column with true bit counts, which the scan can then use to skip row groups; without it they are worked out.
    """
    w = B.words("fingerprint", q.n_bits)
    cheap = _strategy(strategy)[0](w, q, _count(w, counted))
    rows = of_kind(table, q.fp_name)
    rows = rows.where(cheap) if cheap is not None else rows
    hits = rows.where(B.contains(w, B.literals(q.words))).select("mol_id").distinct()
    return hits.orderBy("mol_id").limit(limit) if limit else hits


def screen_all(table: DataFrame, queries: Sequence[Query], strategy: str = "popcount", limit: int = 0, counted: str | None = None) -> DataFrame:
    """Molecules that pass the screen of each of several kinds of fingerprint: their intersection."""
    hits = None
    for q in queries:
        own = screen(table, q, strategy, counted=counted)
        hits = own if hits is None else hits.join(own, "mol_id", "left_semi")
    if hits is None:
        raise ValueError("no query")
    return hits.orderBy("mol_id").limit(limit) if limit else hits


def similar(table: DataFrame, q: Query, t: float = 0.8, strict: bool = False, strategy: str = "popcount", limit: int = 0, top: int = 0, counted: str | None = None) -> DataFrame:
    """``mol_id, score`` of the molecules with likeness of at least (``strict``: above) t.

    ``top`` keeps the best by score, then id; ``limit`` the first by id; ``counted`` as in ``screen``.
    """
    w = B.words("fingerprint", q.n_bits)
    rows = of_kind(table, q.fp_name)
    cheap = _strategy(strategy)[1]
    if cheap is not None and t > 0:
        rows = rows.where(cheap(w, q, _count(w, counted), t))
    score = B.tanimoto(w, B.literals(q.words), _count(w, counted), len(q.bits))
    rows = rows.select("mol_id", score.alias("score"))
    rows = rows.where(F.col("score") > t if strict else F.col("score") >= t).distinct()
    if top:
        return rows.orderBy(F.desc("score"), "mol_id").limit(top)
    return rows.orderBy("mol_id").limit(limit) if limit else rows


def similar_any(table: DataFrame, queries: Sequence[Query], t: float = 0.8, combine: str = "union_all", **options) -> DataFrame:
    """Similarity by several kinds of fingerprint: all hits of each kind, or molecules hit by any or by all of them.

    ``union_all`` gives ``mol_id, score, fp_name``, a row for each kind; ``any`` and ``all`` give ``mol_id, score`` with
    the greatest and the smallest score.
    """
    if not queries:
        raise ValueError("no query")
    out = None
    for q in queries:
        own = similar(table, q, t, **options).withColumn("fp_name", F.lit(q.fp_name))
        out = own if out is None else out.unionByName(own)
    if combine == "union_all":
        return out
    if combine == "any":
        return out.groupBy("mol_id").agg(F.max("score").alias("score"))
    if combine == "all":
        return out.groupBy("mol_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(queries)).drop("n")
    raise ValueError("combine is union_all, any or all")


# Derived columns and tables: what index files are elsewhere.


def postings(table: DataFrame, fp_name: str = "Path") -> DataFrame:
    """The inverted index: ``bit, mol_id`` for each set bit."""
    every = F.expr("flatten(transform(fingerprint, (w, i) -> transform(filter(sequence(0, 63), b -> getbit(coalesce(w, 0L), b) = 1), b -> i * 64 + b)))")
    return spread(of_kind(table, fp_name)).select("mol_id", F.explode(every).alias("bit"), "n_bits").where("bit < n_bits").select("bit", "mol_id").distinct()


def bit_counts(table: DataFrame, fp_name: str = "Path", n_bits: int = 1024) -> DataFrame:
    """``bit, n_set, n_clear, imbalance`` over the different rows: how evenly each bit splits the table.

    Each task adds up its rows' bits in one vector, so no more than ``n_bits`` rows a task are shuffled after the copies are gone.
    """
    k = (n_bits + 63) // 64

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_bits + 1, np.int64)  # the last one counts rows
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                own = np.stack([b[f"w{i}"].to_numpy()[lo : lo + 4000] for i in range(k)], axis=1)
                total[:n_bits] += np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[:n_bits]
                total[n_bits] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bits + 1, dtype=np.int32)), pa.array(total)], names=["bit", "n"])

    w = B.words("fingerprint", n_bits)
    rows = of_kind(table, fp_name).select("mol_id", *[x.alias(f"w{i}") for i, x in enumerate(w)]).distinct().drop("mol_id")
    sums = rows.mapInArrow(each, "bit int, n long").groupBy("bit").agg(F.sum("n").alias("n_set"))
    every = table.sparkSession.range(n_bits + 1).select(F.col("id").cast("int").alias("bit"))
    full = every.join(F.broadcast(sums), "bit", "left").select("bit", F.coalesce("n_set", F.lit(0).cast("long")).alias("n_set"))  # n_bits + 1 rows
    rows_in_all = F.max(F.when(F.col("bit") == n_bits, F.col("n_set"))).over(Window.partitionBy(F.lit(1)))
    return full.withColumn("all", rows_in_all).where(F.col("bit") < n_bits).select("bit", "n_set", (F.col("all") - F.col("n_set")).alias("n_clear"), F.abs(F.col("all") - 2 * F.col("n_set")).alias("imbalance"))


def splitting_bits(table: DataFrame, k: int, fp_name: str = "Path", n_bits: int = 1024) -> list[int]:
    """The k bits that split the table most evenly; ties go to the lower bit."""
    return [r["bit"] for r in bit_counts(table, fp_name, n_bits).orderBy("imbalance", "bit").limit(k).collect()]


def with_signature(table: DataFrame, bits: Sequence[int], n_bits: int = 1024) -> DataFrame:
    """Adds ``sig``, to be written as a partition column: a query visits only the signatures that contain its own."""
    return table.withColumn("sig", B.signature(B.words("fingerprint", n_bits), bits))


def screen_signature(signed: DataFrame, q: Query, bits: Sequence[int]) -> DataFrame:
    """Screening of a table with signatures; the list of admissible ones is a partition filter."""
    own = sum(1 << i for i, b in enumerate(bits) if b in set(q.bits))
    fit = [s for s in range(1 << len(bits)) if s & own == own]
    return screen(signed.where(F.col("sig").isin(fit)), q)


def screen_postings(table: DataFrame, index: DataFrame, q: Query, probe: int = 8) -> DataFrame:
    """Screening by the inverted index: molecules that stand in the posting lists of all the query's bits.

    The lists of the ``probe`` rarest bits are divided; the other bits are verified on the rows themselves, so a
    frequent bit's list is not read. A query without bits contains every molecule.
    """
    if not q.bits:
        return screen(table, q, "brute")
    sizes = index.where(F.col("bit").isin(q.bits)).groupBy("bit").count()
    rare = [r["bit"] for r in sizes.orderBy("count", "bit").limit(probe).collect()]
    if sizes.count() < len(q.bits):
        return screen(table, q, "brute").limit(0)
    hits = index.where(F.col("bit").isin(rare)).groupBy("mol_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("mol_id")
    w = B.words("fingerprint", q.n_bits)
    return of_kind(table, q.fp_name).join(hits, "mol_id", "left_semi").where(B.contains(w, B.literals(q.words))).select("mol_id").distinct()


# Many queries at once


def _stated(queries: DataFrame, n_bits: int) -> DataFrame:
    w = B.words("fingerprint", n_bits)
    return queries.where("query_id is not null").select("query_id", *[x.alias(f"q{i}") for i, x in enumerate(w)], B.popcount(w).alias("q_bits")).distinct()


def _targets(table: DataFrame, fp_name: str, n_bits: int) -> DataFrame:
    w = B.words("fingerprint", n_bits)
    return spread(of_kind(table, fp_name)).select("mol_id", *[x.alias(f"w{i}") for i, x in enumerate(w)], B.popcount(w).alias("bits"))


FEW = 64  # queries up to which a join by sizes serves
BLOCK = 100_000  # queries that are collected and broadcast at once
_ROWS, _QUERIES = 2000, 2048  # rows and queries of one matrix product


def _products(table: DataFrame, queries: DataFrame, fp_name: str, n_bits: int, most: int | None, test: Callable, with_score: bool) -> DataFrame:
    """Meets all rows with a stated set of queries, of any number unless ``most`` is given, ``BLOCK`` at a time."""
    stated = _stated(queries, n_bits)
    count = stated.count() if most is None else stated.limit(most + 1).count()
    if most is not None and count > most:
        raise ValueError(f"more than {most} queries; search in several runs")
    kind = dict(queries.dtypes)["query_id"]
    blocks = max(1, math.ceil(count / BLOCK))
    block = F.pmod(F.xxhash64(*stated.columns), F.lit(blocks))
    hits = [_block_products(table, stated.where(block == i), fp_name, n_bits, test, with_score) for i in range(blocks)]
    out = reduce(DataFrame.unionByName, hits)
    return out.withColumn("query_id", F.col("query_id").cast(kind)) if kind != "bigint" else out


def _block_products(table: DataFrame, stated: DataFrame, fp_name: str, n_bits: int, test: Callable, with_score: bool) -> DataFrame:
    """Meets all rows with one block of queries, which is collected and broadcast, by products of bit matrices.

    ``test(both, rows' sizes, queries' sizes)`` marks the hits of a block. The table isn't shuffled.
    """
    k = (n_bits + 63) // 64
    rows = stated.collect()
    spark = table.sparkSession
    schema = "query_id long, mol_id long" + (", score double" if with_score else "")
    names = ["query_id", "mol_id", *(["score"] if with_score else [])]
    ids = np.array([r["query_id"] for r in rows], np.int64)
    words = np.array([[r[f"q{i}"] for i in range(k)] for r in rows], np.int64).reshape(len(rows), k)
    held = spark.sparkContext.broadcast((ids, words))

    def bits(w: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(len(w), -1), axis=1, bitorder="little").astype(np.float32)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = held.value
        sizes = np.bitwise_count(words.view(np.uint64)).sum(axis=1).astype(np.float64)
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                own = np.stack([b[f"w{i}"].to_numpy() for i in range(k)], axis=1)
                own_size = np.bitwise_count(own.view(np.uint64)).sum(axis=1).astype(np.float64)
                own_bits, mol = bits(own), b["mol_id"].to_numpy()
                for at in range(0, len(ids), _QUERIES):
                    n = sizes[at : at + _QUERIES]
                    both = own_bits @ bits(words[at : at + _QUERIES]).T  # whole numbers below 2^24: exact
                    r, c = np.nonzero(test(both, own_size, n))
                    columns = [pa.array(ids[at + c]), pa.array(mol[r])]
                    if with_score:
                        x = both[r, c].astype(np.float64)
                        columns.append(pa.array(x / (own_size[r] + n[c] - x)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return _targets(table, fp_name, n_bits).mapInArrow(each, schema)


def similar_batch(table: DataFrame, queries: DataFrame, t: float = 0.8, fp_name: str = "Path", n_bits: int = 1024, most: int | None = None) -> DataFrame:
    """``query_id, mol_id, score`` for a set of queries ``(query_id, fingerprint)`` with whole numbers as ids.

    A few queries meet the rows by a join on the sizes that can reach t, each query standing under each size of its
    band; many meet them in blocks (``_products``). Neither shuffles the table.
    """
    if not t > 0:
        raise ValueError("the threshold is above 0")
    q = _stated(queries, n_bits).where("q_bits > 0")
    if q.limit(FEW + 1).count() > FEW:

        def test(both: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
            return (both >= (t / (1 + t)) * (rows[:, None] + n[None]) - 1e-3) & (n[None] > 0)

        return _products(table, queries, fp_name, n_bits, most, test, True).where(F.col("score") >= t).distinct()
    k = (n_bits + 63) // 64
    lo, hi = F.ceil(F.col("q_bits") * t - SLACK).cast("int"), F.least(F.floor(F.col("q_bits") / t + SLACK), F.lit(n_bits)).cast("int")
    q = q.withColumn("bits", F.explode(F.sequence(lo, hi)))
    w, v = [F.col(f"w{i}") for i in range(k)], [F.col(f"q{i}") for i in range(k)]
    score = B.tanimoto(w, v, F.col("bits"), F.col("q_bits"))
    met = _targets(table, fp_name, n_bits).join(F.broadcast(q), "bits")  # at most FEW queries
    return met.select("query_id", "mol_id", score.alias("score")).where(F.col("score") >= t).distinct()


def screen_batch(table: DataFrame, queries: DataFrame, fp_name: str = "Path", n_bits: int = 1024, most: int | None = None) -> DataFrame:
    """``query_id, mol_id`` of the rows that contain each query's bits; queries without bits meet all rows."""

    def test(both: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        return both == n[None]

    return _products(table, queries, fp_name, n_bits, most, test, False).distinct()


def screen_efficiency(screened: DataFrame, verified: DataFrame, by: str = "query_id") -> DataFrame:
    """For each query the rows screened, those verified, and the share of false alarms."""
    v = verified.select(by, "mol_id").distinct().withColumn("ok", F.lit(1))
    return (
        screened.select(by, "mol_id")
        .distinct()
        .join(v, [by, "mol_id"], "left")
        .groupBy(by)
        .agg(F.count("*").alias("n_screened"), F.count("ok").alias("n_verified"))
        .withColumn("false_share", 1 - F.col("n_verified") / F.col("n_screened"))
    )
