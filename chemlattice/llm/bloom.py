"""Has this key been seen before? Scalable Bloom chains over an ordered stream of keys.

A chain is a list of Bloom filters ("layers"). A layer that has reached its
fill threshold is closed and a larger one is opened with a smaller error
rate: capacities grow by ``GROWTH``, error rates shrink by ``TIGHTEN``. The
chance that any layer answers wrongly is at most the sum of the layers'
rates, and that stays below ``error_rate`` however many layers there are.

Work is split by key hash into shards, each with its own chain, and a shard's
rows run through its chain in order of arrival. Before the rows are shuffled
each input task runs its own short-lived chain over its rows in order: a key
that the task itself saw before is answered on the spot, so a key that holds
a third of all rows reaches its shard only once for each task.

Keys are never kept: a chain holds some 35 bits a key at an error rate of
1e-6 and works from two 64-bit hashes.

Defined results: NULL keys and empty keys are never "seen" and are not
remembered; nor are records without id; a record delivered several times under one id counts once; ties
in order do not occur, because the id is the order; keys are compared as
bytes; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemlattice.functions.canon import mix
from chemlattice.session import slots, stage

GROWTH, TIGHTEN, FILL = 2, 0.5, 0.5
#: Keys of the first layer of a shard's chain and of a task's own chain.
FIRST = 1 << 14
#: Rows that one shard may expect; more rows mean more shards.
SHARD_ROWS = 1_000_000


class Layer:
    def __init__(self, capacity: int, rate: float) -> None:
        self.rate = rate
        self.k = max(1, math.ceil(-math.log2(rate)))
        self.m = 64 * math.ceil(capacity * self.k / math.log(2) / 64)
        self.capacity, self.count, self.set = capacity, 0, 0
        self.words = np.zeros(self.m // 64, np.uint64)

    def _at(self, h1: np.ndarray, h2: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            p = (h1 + np.uint64(i) * h2 + np.uint64((i**3 - i) // 6)) % np.uint64(self.m)  # enhanced double hashing
        return (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        alive = np.arange(len(h1))
        for i in range(self.k):
            w, bit = self._at(h1[alive], h2[alive], i)
            alive = alive[(self.words[w] & bit) != 0]
            if not len(alive):
                break
        out = np.zeros(len(h1), bool)
        out[alive] = True
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for i in range(self.k):
            w, bit = self._at(h1, h2, i)
            np.bitwise_or.at(self.words, w, bit)
        self.count += len(h1)
        self.set = int(np.bitwise_count(self.words).sum())

    @property
    def full(self) -> bool:
        return self.count >= self.capacity or self.set >= FILL * self.m

    @property
    def measured_rate(self) -> float:
        """Error rate at the present fill."""
        return (self.set / self.m) ** self.k


class Chain:
    """A growing set of key hashes with a bounded share of false positives and no false negatives."""

    def __init__(self, error_rate: float, first: int = FIRST) -> None:
        self.error_rate, self.first = error_rate, first
        self.layers: list[Layer] = []

    def _open(self) -> Layer:
        i = len(self.layers)
        self.layers.append(Layer(self.first * GROWTH**i, self.error_rate * (1 - TIGHTEN) * TIGHTEN**i))
        return self.layers[-1]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        for layer in reversed(self.layers):
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            out[rest] = layer.contains(h1[rest], h2[rest])
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Adds keys that the chain doesn't hold yet; each stands once."""
        at = 0
        while at < len(h1):
            layer = self.layers[-1] if self.layers and not self.layers[-1].full else self._open()
            take = layer.capacity - layer.count
            layer.add(h1[at : at + take], h2[at : at + take])
            at += take

    def seen(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For keys in order: whether each stood before, here or earlier in the same call. Remembers them all."""
        h1, h2 = mix(h1), mix(h2)  # the shard is a remainder of h1, so its low bits say nothing here
        both = np.empty(len(h1), [("a", np.uint64), ("b", np.uint64)])
        both["a"], both["b"] = h1, h2
        _, first = np.unique(both, return_index=True)
        out = np.ones(len(h1), bool)
        first.sort()
        known = self.contains(h1[first], h2[first])
        out[first] = known
        new = first[~known]
        self.add(h1[new], h2[new])
        return out

    @property
    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.layers)

    @property
    def bound(self) -> float:
        """At most the sum of the layers' rates."""
        return sum(x.rate for x in self.layers)

    def state(self) -> list[dict]:
        return [{"layer": i, "rate": x.rate, "capacity": x.capacity, "n_keys": x.count, "words": x.words.tobytes()} for i, x in enumerate(self.layers)]

    def restore(self, layer: int, rate: float, capacity: int, n_keys: int, words: bytes) -> None:
        x = Layer(capacity, rate)
        x.words = np.frombuffer(words, np.uint64).copy()
        x.count, x.set = n_keys, int(np.bitwise_count(x.words).sum())
        assert layer == len(self.layers), "layers come in order"
        self.layers.append(x)


def key_column(c: Column | str) -> Column:
    """Text before the first space or tab; NULL if that is empty."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.substring_index(F.substring_index(c.cast("string"), " ", 1), "\t", 1)
    return F.when(k != "", k)


def hashes(df: DataFrame, kind: int, order: Column, key: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), order.cast("long").alias("at"), key.alias("k")).where("k is not null and at is not null").select(
        "kind", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2")
    )


_HASHED = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seen", pa.bool_())])
_HASHED_SQL = "kind int, at long, h1 long, h2 long, seen boolean"


def _u64(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).view(np.uint64)


def _in_task(error_rate: float):
    """First pass: a task answers what it saw itself and passes on the rest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = Chain(error_rate), None
        for b in batches:
            if not b.num_rows:
                continue
            at = b["at"].to_numpy()
            kind = b["kind"].to_numpy()
            again = np.zeros(len(at), bool)  # the same record, delivered again
            again[1:] = (at[1:] == at[:-1]) & (kind[1:] == 2)
            again[0] = kind[0] == 2 and at[0] == last
            last = at[-1] if kind[-1] == 2 else None
            rows = np.flatnonzero(~again)
            seen = chain.seen(_u64(b["h1"])[rows], _u64(b["h2"])[rows])
            keep = (kind[rows] == 2) | ~seen  # history has nothing to answer
            rows, seen = rows[keep], seen[keep]
            t = b.take(pa.array(rows))
            h = [pc.if_else(pa.array(seen), pa.scalar(None, pa.int64()), t[c]) for c in ("h1", "h2")]  # an answer needs no hashes
            yield pa.RecordBatch.from_arrays([t["kind"], t["at"], *h, pa.array(seen)], schema=_HASHED)

    return each


_STATE = "shard int, layer int, rate double, capacity long, n_keys long, words binary"
_OUT = pa.schema(
    [("at", pa.int64()), ("seen", pa.bool_()), ("shard", pa.int32()), ("layer", pa.int32()), ("rate", pa.float64()), ("capacity", pa.int64()), ("n_keys", pa.int64()), ("words", pa.binary())]
)
_OUT_SQL = f"at long, seen boolean, {_STATE}"


def _in_shard(error_rate: float, keep_state: bool):
    """Second pass: rows sorted by shard, kind (0 state, 1 history, 2 lookups) and order."""

    def closed(shard: int, chain: Chain) -> Iterator[pa.RecordBatch]:
        if keep_state and chain is not None:
            rows = [x | {"at": None, "seen": None, "shard": shard} for x in chain.state()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain, last = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            s = b["shard"].to_numpy()
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for lo, hi in zip(edges, edges[1:]):
                if s[lo] != shard:
                    yield from closed(shard, chain)
                    shard, chain, last = int(s[lo]), Chain(error_rate), None
                part = b.slice(lo, hi - lo)
                kind = part["kind"].to_numpy()
                for row in part.filter(pa.array(kind == 0)).to_pylist():
                    chain.restore(row["layer"], row["rate"], row["capacity"], row["n_keys"], row["words"])
                part = part.filter(pa.array(kind > 0))
                if not part.num_rows:
                    continue
                at, kind = part["at"].to_numpy(), part["kind"].to_numpy()
                again = np.zeros(len(at), bool)
                again[1:] = (at[1:] == at[:-1]) & (kind[1:] == 2)
                again[0] = kind[0] == 2 and at[0] == last
                last = at[-1] if kind[-1] == 2 else None
                rows = np.flatnonzero(~again)
                seen = chain.seen(_u64(part["h1"])[rows], _u64(part["h2"])[rows])
                ask = kind[rows] == 2
                n = int(ask.sum())
                empty = [pa.nulls(n, f.type) for f in list(_OUT)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(at[rows][ask]), pa.array(seen[ask]), *empty], schema=_OUT)
        yield from closed(shard, chain)

    return each


def answers(lookups: DataFrame, history: DataFrame | None = None, state: DataFrame | None = None, *, lookup_id: str = "lookup_id", key: str = "smiles", history_key: str = "smiles", error_rate: float = 1e-6, shards: int | None = None, keep_state: bool = False) -> DataFrame:
    """``at`` (the lookup's id) and ``seen`` for each lookup with a key; with ``keep_state`` also the chains' layers.

    ``history`` are earlier records, read once to fill the chains; ``state`` are the layers that an earlier call
    gave, so that a later batch costs nothing for what came before but reading the layers. ``shards`` must then be
    the same. Each of the two passes may use half of ``error_rate``.
    """
    spark = lookups.sparkSession
    if shards is None:
        rows = lookups.count() + (history.count() if history is not None else 0)  # from the files' footers
        shards = max(slots(spark), math.ceil(rows / SHARD_ROWS))
    rows = hashes(lookups, 2, F.col(lookup_id), key_column(key))
    own = rows.sortWithinPartitions("at").mapInArrow(_in_task(error_rate / 2), _HASHED_SQL)
    if history is not None:
        own = own.unionByName(hashes(history, 1, F.lit(0), key_column(history_key)).mapInArrow(_in_task(error_rate / 2), _HASHED_SQL))
    own = stage(own, "first-pass")  # both its answers and its rest are needed, and it runs once
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("layer", "int"), ("rate", "double"), ("capacity", "long"), ("n_keys", "long"), ("words", "binary"))]
    # What the first pass answered is a result already, but its keys went on in their first row of the same task.
    local = own.where("kind = 2 and seen").select("at", "seen", *[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], _STATE).schema])
    todo = own.where("not seen").select(shard, "kind", "at", "h1", "h2", *nothing)
    if state is not None:
        todo = todo.unionByName(state.select("shard", F.lit(0).alias("kind"), F.col("layer").cast("long").alias("at"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "layer", "rate", "capacity", "n_keys", "words"))
    done = todo.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "at").mapInArrow(_in_shard(error_rate / 2, keep_state), _OUT_SQL)
    out = local.unionByName(done)
    return out if keep_state else out.select("at", "seen")


def seen_before(lookups: DataFrame, history: DataFrame | None = None, **options) -> DataFrame:
    """``lookup_id`` of each record whose key stood in ``history`` or in an earlier record, once."""
    return answers(lookups, history, **options).where("seen").select(F.col("at").alias("lookup_id")).distinct()


def error_share(lookups: DataFrame, history: DataFrame, **options) -> DataFrame:
    """One row: lookups with a key, wrong answers by exact comparison, their share, and the bound in force."""
    bound = options.get("error_rate", 1e-6)
    asked = lookups.select(F.col("lookup_id").alias("at"), key_column("smiles").alias("k")).where("k is not null").distinct()
    first = (
        asked.select("k", "at")
        .unionByName(history.select(key_column("smiles").alias("k"), F.lit(-1).cast("long").alias("at")).where("k is not null"))
        .groupBy("k")
        .agg(F.min("at").alias("first"))
    )
    truth = asked.join(first, "k").select("at", (F.col("first") < F.col("at")).alias("truly"))
    said = seen_before(lookups, history, **options).select(F.col("lookup_id").alias("at"), F.lit(True).alias("said"))
    j = truth.join(said, "at", "left").withColumn("said", F.coalesce("said", F.lit(False)))
    return j.agg(
        F.count("*").alias("n_lookups"),
        F.sum((F.col("said") & ~F.col("truly")).cast("long")).alias("n_false_seen"),
        F.sum((~F.col("said") & F.col("truly")).cast("long")).alias("n_missed"),
    ).select("n_lookups", "n_false_seen", "n_missed", F.coalesce(F.try_divide(F.col("n_false_seen") + F.col("n_missed"), F.col("n_lookups")), F.lit(0.0)).alias("wrong_share"), F.lit(float(bound)).alias("bound"))
