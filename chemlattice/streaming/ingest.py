"""Streams of molecules: similarity against a fixed query, and ingest of new keys in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chemlattice.functions import bits as B
from chemlattice.operators.search import Query
from chemlattice.session import drop_staged, exists, stage


def key_column(c: str) -> F.Column:
    """Text before the first space or tab; NULL if that is empty."""
    k = F.substring_index(F.substring_index(F.col(c).cast("string"), " ", 1), "\t", 1)
    return F.when(k != "", k)


def similar_stream(stream: DataFrame, q: Query, t: float = 0.8) -> DataFrame:
    """Rows of a stream of fingerprints that are like the query; stateless, so it runs in append mode."""
    w = B.words("fingerprint", q.n_bits)
    score = B.tanimoto(w, B.literals(q.words), B.popcount(w), len(q.bits))
    return stream.where((F.col("fp_name") == q.fp_name) & F.col("fingerprint").isNotNull()).select("mol_id", score.alias("score")).where(F.col("score") >= t)


def first_of_keys(rows: DataFrame, order: str, text: str = "smiles") -> DataFrame:
    """The first row of each key, by ``order``; rows without key are left out. The rank is cut before the shuffle."""
    keyed = rows.withColumn("key", key_column(text)).where(F.col("key").isNotNull())
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("_n = 1").drop("_n")


def new_keys(rows: DataFrame, known: DataFrame, order: str, text: str = "smiles") -> DataFrame:
    """``key`` and ``order`` of the rows whose key is neither known nor in an earlier row."""
    held = known.select(key_column(text).alias("key")).where(F.col("key").isNotNull()).distinct()
    return first_of_keys(rows, order, text).select("key", order).join(held, "key", "left_anti")


def first_in_time(stream: DataFrame, time: str, delay: str = "1 day", text: str = "smiles") -> DataFrame:
    """Each key once within the watermark: state is dropped when it is older than ``delay``, so it stays bounded."""
    keyed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("key", key_column(text)).where(F.col("key").isNotNull())
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def arrivals(stream: DataFrame, time: str, every: str = "1 hour", delay: str = "1 hour", text: str = "smiles") -> DataFrame:
    """Records and different keys (approximately) in each span of time, with late records up to ``delay``."""
    keyed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("key", key_column(text)).withWatermark(time, delay)
    return keyed.groupBy(F.window(time, every)).agg(F.count("*").alias("n_records"), F.approx_count_distinct("key").alias("n_keys")).select(F.col("window.start").alias("start"), "n_records", "n_keys")


def ingest_stream(stream: DataFrame, known: DataFrame, target: str, checkpoint: str, order: str = "rec_id", shards: int = 64, every: int = 16):
    """Runs a stream of records to its present end and keeps each new key once, under ``target``.

    What was seen is kept as hashes of keys, in folders by shard of the hash (``target`` with ``_seen`` behind): those of
    ``known`` once, before the first micro-batch, then those of each micro-batch. A micro-batch reads hashes only, of the
    shards that its own keys fall in, and never ``known`` or earlier records again. After ``every`` micro-batches the
    hashes of those are written together, so the number of files stays small. A micro-batch is written under its own
    number, over what an earlier try of it may have left: a repeated one gives the same files.
    """
    spark = stream.sparkSession
    seen = f"{target}_seen"
    h = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")]
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")

    def write(rows: DataFrame, name: str) -> None:
        rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{seen}/{name}")

    if not exists(spark, f"{seen}/known/_SUCCESS"):
        write(known.select(key_column("smiles").alias("key")).where(F.col("key").isNotNull()).distinct().select(*h, shard), "known")

    def held(upto: int) -> list[str]:
        whole = [f"{seen}/upto={n}" for n in range(every, upto + 1, every) if exists(spark, f"{seen}/upto={n}/_SUCCESS")]
        done = max((int(w.rsplit("=", 1)[1]) for w in whole), default=0)
        return [f"{seen}/known", *whole[-1:], *[f"{seen}/batch={i}" for i in range(done, upto)]]

    def each(batch: DataFrame, number: int) -> None:
        keyed = stage(first_of_keys(batch, order).select("key", order, *h, shard), "micro-batch")
        touched = [r["shard"] for r in keyed.select("shard").distinct().collect()]  # at most ``shards``
        old = batch.sparkSession.read.schema("h1 long, h2 long, shard int")
        # Each folder has its own shards; one is read for each, so that a folder without rows does no harm.
        before = None
        for path in held(number):
            part = old.parquet(path).where(F.col("shard").isin(touched)).select("h1", "h2")
            before = part if before is None else before.unionByName(part)
        fresh = keyed.join(before, ["h1", "h2"], "left_anti")
        fresh.select("key", order).write.mode("overwrite").parquet(f"{target}/batch={number}")
        kept = batch.sparkSession.read.schema(fresh.select("key", order).schema).parquet(f"{target}/batch={number}")
        write(kept.select(*h, shard), f"batch={number}")
        if (number + 1) % every == 0:
            parts = [p for p in held(number + 1) if not p.endswith("/known")]
            merged = None
            for path in parts:
                part = old.parquet(path)
                merged = part if merged is None else merged.unionByName(part)
            write(merged, f"upto={number + 1}")
        drop_staged(batch.sparkSession, keyed)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
