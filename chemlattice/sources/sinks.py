"""Where hits and indexes go besides Parquet: plain text, for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_hits(hits: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One line a hit, columns with tabs between them; NULL is empty. Written by all tasks, in the order of the rows in each."""
    names = columns or hits.columns
    hits.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("value")).write.mode(mode).text(path)


def write_smiles(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of SMILES and title, as the molecule reader takes them."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" "), "title")).otherwise(F.lit(""))
    rows.where("smiles is not null").select(F.concat("smiles", title).alias("value")).write.mode(mode).text(path)


def write_postings(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The inverted index as CSV, a folder for each bit. The rows of a bit come from a few tasks, not from all."""
    postings.repartitionByRange("bit", "mol_id").sortWithinPartitions("bit", "mol_id").write.mode(mode).partitionBy("bit").csv(path)
