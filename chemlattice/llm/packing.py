"""Filling containers of fixed capacity with documents, by vector best-fit.

A document's size is its number of tokens in a public tokenizer. A document
longer than a container is cut into full containers and a rest; any other
stays whole. An item (a document or a rest) takes up three things: tokens,
one place among the documents of a container, and attention cost, the square
of its length. A container has a capacity for each: its tokens, a place for
each ``TOKENS_A_DOC`` of them, and ``ATTENTION`` of the square of its tokens, unless
the target states ``max_documents`` or ``attention_budget`` itself. Items are placed in
order of falling length into the container that fits best under every
constraint: the smallest weighted norm of what would be left, or the largest
weighted dot product of item and residual. An item that alone costs more attention than a
container has is whole all the same and gets a container to itself.

Items are dealt over shards of about ``SHARD_ITEMS`` by the hash of their id,
so no shard grows with the data. Containers of a shard that stay emptier than
``REPACK`` are opened again, and their items are packed once more together
with those of ``MERGE`` other shards, until one shard is left or ``ROUNDS``
are over. Nothing is dropped: each token of each document lies in exactly one
container.

Defined results: NULL or empty texts have no tokens and go nowhere; equal
texts are separate items; ties go to the container opened first; targets
without a positive capacity, or NULL, take nothing; other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.session import slots, spread, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 4000
MERGE = 16
ROUNDS = 3
REPACK = 0.97
WEIGHTS = (1.0, 0.05, 0.05)
TARGETS = 1000  # targets that are dealt with in one pass
TOKENS_A_DOC = 16  # a container has a place for a document for each so many tokens of its capacity
ATTENTION = 0.9  # share of the square of its capacity that the squares of a container's documents may add up to


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of each document that has any. The whole text is encoded."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t.as_py())) for t in b["text"]), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n)], names=["doc_id", "n_tokens"])

    rows = spread(docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(each, "doc_id long, n_tokens long").where("n_tokens > 0")


def vector_best_fit(tokens: np.ndarray, capacity: int, max_docs: int, attention: float, weights: tuple = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Container of each item (0, 1, ... in order of opening); items are at most ``capacity`` long."""
    order = np.argsort(-tokens, kind="stable")
    out = np.empty(len(tokens), np.int64)
    w = np.array(weights)
    size = np.array([capacity, max_docs, attention], float)
    free = np.empty((max(16, len(tokens)), 3))  # as shares of the capacities
    opened = 0
    live = np.empty(0, np.int64)
    least = float(tokens.min()) / capacity if len(tokens) else 0.0
    for i in order:
        t = float(tokens[i])
        v = np.array([t, 1.0, t * t]) / size
        best = -1
        if len(live):
            r = free[live]
            ok = np.flatnonzero((r >= v - 1e-9).all(axis=1))
            if len(ok):
                left = r[ok] - v
                score = -(left * left) @ w if rule == "norm" else (r[ok] * v) @ w
                best = int(live[ok[score.argmax()]])
        if best < 0:
            best = opened
            free[best] = 1.0
            opened += 1
            live = np.append(live, best)
        free[best] -= v
        out[i] = best
        if free[best, 0] < least - 1e-12 or free[best, 1] < 1 / max_docs - 1e-12:
            live = live[live != best]
    return out


_PLACED = "target_id int, container_id long, doc_id long, piece_no int, first_token long, n_tokens long, unused_tokens long, capacity long, max_docs long, attention double, shard long"


def capacities(targets: DataFrame, tokens_a_doc: int = TOKENS_A_DOC, attention: float = ATTENTION) -> list[dict]:
    """``target_id, capacity, max_docs, attention`` of the targets that take anything, once each; ids and three numbers a target."""
    stated = [F.col(c).cast(t).alias(c) if c in targets.columns else F.lit(None).cast(t).alias(c) for c, t in (("max_documents", "long"), ("attention_budget", "double"))]
    rows = targets.where("capacity_tokens > 0 and target_id is not null").select("target_id", F.col("capacity_tokens").cast("long").alias("capacity"), *stated).distinct().toLocalIterator()
    out = []
    for r in rows:
        docs = r["max_documents"] if r["max_documents"] is not None else -(-r["capacity"] // tokens_a_doc)
        cost = r["attention_budget"] if r["attention_budget"] is not None else attention * float(r["capacity"]) ** 2
        out.append({"target_id": r["target_id"], "capacity": r["capacity"], "max_docs": max(1, docs), "attention": max(1.0, cost)})
    return sorted(out, key=lambda x: tuple(x.values()))


def _pieces(counts: DataFrame, held: list[dict], shards: int) -> DataFrame:
    """Items of each target: full containers of long documents (shard NULL), and what is to be packed."""
    types = {"target_id": "int", "capacity": "long", "max_docs": "long", "attention": "double"}
    each = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in types.items()]) for r in held]
    t = F.array(*each) if each else F.array().cast("array<struct<target_id:int,capacity:bigint,max_docs:bigint,attention:double>>")
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.when(F.col("n_tokens") % F.col("capacity") == 0, full - 1).otherwise(full)))
    flat = counts.select("doc_id", "n_tokens", F.explode(t).alias("t")).select("doc_id", "n_tokens", *[f"t.{c}" for c in types])
    cut = flat.select(*types, "doc_id", F.col("n_tokens").alias("total"), number.alias("piece_no"))
    first = F.col("piece_no").cast("long") * F.col("capacity")
    size = F.least(F.col("total") - first, F.col("capacity"))
    shard = F.when(size < F.col("capacity"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return cut.select(*types, shard.alias("shard"), "doc_id", "piece_no", first.alias("first_token"), size.alias("n_tokens"))


def _pack(last: bool, round_no: int, weights: tuple, rule: str):
    def each(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        target, shard = key
        g = g.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
        capacity, max_docs, attention = int(g["capacity"].iloc[0]), int(g["max_docs"].iloc[0]), float(g["attention"].iloc[0])
        tokens = g["n_tokens"].to_numpy(np.int64)
        box = vector_best_fit(tokens, capacity, max_docs, attention, weights, rule)
        used = np.bincount(box, weights=tokens).astype(np.int64)
        done = last | (used >= REPACK * capacity)
        # Container numbers: round, shard and place; full containers of long documents have negative ones.
        number = (np.int64(round_no) << 58) | (np.int64(shard) << 26) | box.astype(np.int64)
        return pd.DataFrame(
            {
                "target_id": target, "container_id": np.where(done[box], number, -1), "doc_id": g["doc_id"], "piece_no": g["piece_no"], "first_token": g["first_token"],
                "n_tokens": tokens, "unused_tokens": capacity - used[box], "capacity": capacity, "max_docs": max_docs, "attention": attention, "shard": shard,
            }
        )

    return each


_COLUMNS = ["target_id", "container_id", "doc_id", "piece_no", "first_token", "n_tokens", "unused_tokens"]


def pack(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, weights: tuple = WEIGHTS, rule: str = "norm", tokens_a_doc: int = TOKENS_A_DOC, attention: float = ATTENTION) -> DataFrame:
    """``target_id, container_id, doc_id, piece_no, first_token, n_tokens, unused_tokens`` for each piece.

    ``unused_tokens`` is the room left in the piece's container.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    counts = stage(token_counts(docs, vocabulary), "tokens")
    shards = max(1, math.ceil(counts.count() / SHARD_ITEMS))
    held = capacities(targets, tokens_a_doc, attention)
    out = None
    for lo in range(0, max(1, len(held)), TARGETS):
        part = _pack_some(counts, held[lo : lo + TARGETS], shards, weights, rule)
        out = part if out is None else out.unionByName(part)
    return out


def _pack_some(counts: DataFrame, held: list[dict], shards: int, weights: tuple, rule: str) -> DataFrame:
    items = _pieces(counts, held, shards)
    number = -(F.xxhash64("doc_id", "piece_no").bitwiseAND(F.lit((1 << 62) - 1)) + 2)
    out = items.where("shard is null").select("target_id", number.alias("container_id"), "doc_id", "piece_no", "first_token", "n_tokens", F.lit(0).cast("long").alias("unused_tokens"))
    todo = items.where("shard is not null")
    for r in range(ROUNDS):
        last = r == ROUNDS - 1 or shards == 1
        # Stated partitions: items are a few bytes each, and would else be packed in a single task.
        placed = todo.repartition(max(2 * slots(counts.sparkSession), shards), "target_id", "shard").groupBy("target_id", "shard").applyInPandas(_pack(last, r, weights, rule), _PLACED)
        if not last:
            placed = stage(placed, "placed")
        out = out.unionByName(placed.where("container_id >= 0").select(*_COLUMNS))
        if last:
            break
        todo = placed.where("container_id < 0").select("target_id", "capacity", "max_docs", "attention", F.floor(F.col("shard") / MERGE).alias("shard"), "doc_id", "piece_no", "first_token", "n_tokens")
        shards = math.ceil(shards / MERGE)
    return out


def _with_capacities(rows: DataFrame, held: list[dict]) -> DataFrame:
    """Joins the targets' capacities, a literal table, by ``target_id``."""
    t = rows.sparkSession.createDataFrame([tuple(r.values()) for r in held], "target_id int, capacity long, max_docs long, attention double")
    return rows.join(F.broadcast(t) if len(held) <= 100 * TARGETS else t, "target_id")


def usage(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: pieces, containers, the least number there could be, tokens, unused tokens and their share."""
    boxes = packed.groupBy("target_id", "container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), F.max("unused_tokens").alias("free"))
    by = boxes.groupBy("target_id").agg(F.sum("n").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("free").alias("unused_tokens"))
    return _with_capacities(by, capacities(targets)).select(
        "target_id", "n_pieces", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), "n_tokens", "unused_tokens", (F.col("unused_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share")
    )


def limits(packed: DataFrame, targets: DataFrame, tokens_a_doc: int = TOKENS_A_DOC, attention: float = ATTENTION) -> DataFrame:
    """For each target and constraint: containers in which it is the fullest, those it leaves no room in, and the mean share used.

    ``n_over`` counts containers beyond the capacity: of tokens and places there is none, of attention only those of a single item.
    """
    boxes = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("documents"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost"))
    shares = _with_capacities(boxes, capacities(targets, tokens_a_doc, attention)).select(
        "target_id", F.array(F.col("tokens") / F.col("capacity"), F.col("documents") / F.col("max_docs"), F.col("cost") / F.col("attention")).alias("s")
    )
    names = F.array(*[F.lit(x) for x in ("tokens", "documents", "attention")])
    each = shares.select("target_id", F.array_max("s").alias("most"), F.explode(F.arrays_zip(names.alias("limit"), F.col("s").alias("share"))).alias("x")).select("target_id", "most", "x.limit", "x.share")
    return each.groupBy("target_id", "limit").agg(
        F.count_if(F.col("share") == F.col("most")).alias("n_fullest"), F.count_if(F.col("share") >= 0.999).alias("n_full"), F.count_if(F.col("share") > 1 + 1e-9).alias("n_over"), F.avg("share").alias("mean_share")
    )
