"""Fingerprint rows as fixed columns of words, and classes of equal fingerprints.

Defined results: of an array only the words that ``n_bits`` needs count; a
missing word, a NULL word or a word beyond the end is zero. Rows with a NULL
fingerprint, a NULL id, no bit set or all bits set take no part. Rows
delivered twice count once. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BITS = 1024
N_WORDS = N_BITS // 64
WORDS = [f"w{i}" for i in range(N_WORDS)]


def valid(table: DataFrame, fp_name: str = "Path") -> DataFrame:
    """``mol_id``, the words, ``bits``, and two hashes of the words, for each row that takes part, once."""
    words = [F.coalesce(F.get("fingerprint", F.lit(i)), F.lit(0)).cast("long").alias(w) for i, w in enumerate(WORDS)]
    rows = table.where((F.col("fp_name") == fp_name) & F.col("fingerprint").isNotNull() & F.col("mol_id").isNotNull()).select(F.col("mol_id").cast("long").alias("mol_id"), *words)
    total = F.bit_count(WORDS[0])
    for w in WORDS[1:]:
        total = total + F.bit_count(w)
    return rows.withColumn("bits", total).where(f"bits > 0 and bits < {N_BITS}").withColumn("h1", F.xxhash64(*WORDS)).withColumn("h2", F.xxhash64(F.lit(7), *WORDS))


def members(rows: DataFrame) -> DataFrame:
    """``mol_id, h1, h2`` once each."""
    return rows.select("mol_id", "h1", "h2").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """One row for each different fingerprint: its smallest id ``rep``, words and bit count. Combines before the shuffle."""
    return rows.groupBy("h1", "h2").agg(F.min("mol_id").alias("rep"), *[F.first(w).alias(w) for w in WORDS], F.first("bits").alias("bits"))


def matrix(b: pa.RecordBatch) -> np.ndarray:
    """The words of a batch as one array of rows."""
    out = np.empty((b.num_rows, N_WORDS), np.uint64)
    for i, w in enumerate(WORDS):
        out[:, i] = b[w].to_numpy().view(np.uint64)
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """Bits as bytes, one column for each bit."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits set in both, row by row."""
    return np.bitwise_count(a & b).sum(axis=1, dtype=np.int32)
