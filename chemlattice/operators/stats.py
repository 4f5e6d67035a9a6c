"""Descriptive aggregates over molecules and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chemlattice.session import stage


def atom_histogram(molecules: DataFrame) -> DataFrame:
    """``n_atoms, n_molecules`` of the molecules that can be read."""
    return molecules.where("n_atoms is not null").groupBy("n_atoms").agg(F.count("*").alias("n_molecules"))


def degree_histogram(molecules: DataFrame) -> DataFrame:
    """``degree, n_vertices`` over all atoms. Degrees are counted within a row, so nothing but counts is shuffled."""
    n = F.size("atoms")
    ends = F.flatten(F.transform("bonds", lambda b: F.array(b["a"], b["b"])))
    degrees = F.transform(F.sequence(F.lit(0), n - 1), lambda v: F.size(F.filter(ends, lambda e: e == v)))
    return molecules.where("size(atoms) > 0").select(F.explode(degrees).alias("degree")).groupBy("degree").agg(F.count("*").alias("n_vertices"))


def counters(molecules: DataFrame) -> DataFrame:
    """One row: graphs, vertices, edges, kept vertices of the reduced graphs and atoms on their paths."""
    m = molecules.where("n_atoms is not null")
    kept = F.size(F.regexp_extract_all(F.split("reduced", r"\],\[")[0], F.lit(r"\{\d+\}"), F.lit(0)))
    return m.agg(
        F.count("*").alias("n_graphs"), F.coalesce(F.sum("n_atoms"), F.lit(0)).alias("n_vertices"), F.coalesce(F.sum("n_bonds"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.col("n_atoms") - kept), F.lit(0)).alias("n_on_paths"),
    )


def running_totals(rows: DataFrame, order: str, values: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``total_<value>``: sums over all rows up to each one, by ``order``.

    Works on range partitions: totals of each partition first, then sums within partitions plus what came before, so no
    window holds all rows. Rows with the same order get the total after all of them.
    """
    parts = parts or max(2, rows.sparkSession.sparkContext.defaultParallelism)
    per = rows.groupBy(order).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    cut = stage(per.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")  # read twice: the ranges must stay
    sums = cut.groupBy("_part").agg(*[F.sum(f"_{v}").alias(f"s_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sums.select("_part", *[F.coalesce(F.sum(f"s_{v}").over(before), F.lit(0)).alias(f"b_{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.select(order, "_part", *[F.sum(f"_{v}").over(own).alias(f"o_{v}") for v in values])
    totals = within.join(F.broadcast(base), "_part").select(order, *[(F.coalesce(F.col(f"o_{v}"), F.lit(0)) + F.col(f"b_{v}")).alias(f"total_{v}") for v in values])
    return rows.join(totals, order)


def by_size(rows: DataFrame, size: str, value: str) -> DataFrame:
    """``size, n, total`` of a measured value, such as the seconds that molecules of a size took."""
    return rows.groupBy(size).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def readable_bytes(n: float) -> str:
    """Decimal units."""
    for unit in ("bytes", "KB", "MB", "GB", "TB"):
        if abs(n) < 1000 or unit == "TB":
            return f"{n:g} {unit}" if unit == "bytes" else f"{n:.1f} {unit}"
        n /= 1000
    return ""
