"""Queries over lines as read: rejects and loaded records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chemlattice.plans import smiles_sql as Q
from chemlattice.session import table
from chemlattice.sources import rejects


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(spark.read.parquet(f"{d}/smi_lines.parquet"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(table(spark, d, "smi_lines"))


QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded}

_FIELD = '"(?:[^"]|"")*"|[^",]*'
_JUDGED = f"""
    line AS (SELECT DISTINCT line_id, CASE WHEN raw[-1] = chr(13) THEN raw[:-2] ELSE raw END AS text FROM smi_lines WHERE line_id IS NOT NULL),
    cut AS (SELECT line_id, text, regexp_full_match(text, '(?s:(?:{_FIELD})(?:,(?:{_FIELD}))*)') AS sound,
        [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END for x in regexp_extract_all(text || ',', '(?s)({_FIELD}),', 1)] AS f FROM line),
    {Q.parsed("SELECT line_id, f[2] AS smiles FROM cut WHERE sound AND len(f) = 5", "line_id", "read")},
    judged AS (SELECT line_id, f, CASE WHEN text IS NULL OR text = '' THEN 'columns' WHEN NOT sound THEN 'quoting' WHEN len(f) <> 5 THEN 'columns' WHEN NOT regexp_full_match(f[1], '[0-9]+') THEN 'mol_id'
        WHEN NOT coalesce(ok, false) THEN 'smiles' WHEN f[4] <> '' AND NOT (regexp_full_match(f[4], '\\+?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') AND regexp_matches(f[4], '^[^eE]*[1-9]')) THEN 'mol_weight'
        WHEN NOT (regexp_full_match(f[5], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND f[5] >= '0001' AND try_cast(f[5] AS DATE) IS NOT NULL) THEN 'registered_on' END AS reason FROM cut LEFT JOIN read USING (line_id))"""
SQL: dict[str, str] = {
    "p4_found": f"WITH {_JUDGED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": f"""WITH {_JUDGED} SELECT line_id, CASE WHEN len(ltrim(f[1], '0')) <= 18 THEN CAST(f[1] AS BIGINT) END AS mol_id, split_part(split_part(f[2], ' ', 1), chr(9), 1) AS smiles,
        f[3] AS title, try_cast(nullif(f[4], '') AS DOUBLE) AS mol_weight, CAST(f[5] AS DATE) AS registered_on FROM judged WHERE reason IS NULL""",
}
