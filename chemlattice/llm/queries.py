"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemlattice.llm import bloom, leaks, multi_index, packing, residue, setjoin, small_world
from chemlattice.plans import smiles_sql as Q
from chemlattice.session import prepared, shared_dir, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return small_world.repeats(table(spark, d, "smiles_index"), table(spark, d, "smiles_batches"))


def p1_live(spark: SparkSession, d: str) -> DataFrame:
    """The same, batch by batch as they arrive: each is looked up in the live segments, becomes one, and those due are merged."""
    batches = table(spark, d, "smiles_batches")
    held = small_world.History(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    held.create(table(spark, d, "smiles_index"), expected=table(spark, d, "smiles_index").count() + batches.count())
    numbers = sorted(r[0] for r in batches.select("batch_no").distinct().collect() if r[0] is not None)  # ten
    out = None
    for n in [*numbers, None]:
        part = batches.where(F.col("batch_no").eqNullSafe(F.lit(n)))
        if n is None and part.limit(1).count() == 0:
            continue
        found = held.add(part)
        out = found if out is None else out.unionByName(found)
    return out


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    return small_world.recall(table(spark, d, "smiles_index"), table(spark, d, "smiles_batches"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bloom.seen_before(table(spark, d, "key_lookups"), table(spark, d, "smiles_index"))


def p2_error_share(spark: SparkSession, d: str) -> DataFrame:
    return bloom.error_share(table(spark, d, "key_lookups"), table(spark, d, "smiles_index"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return multi_index.neighbour_pairs(table(spark, d, "fingerprint_index"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    return multi_index.recall(table(spark, d, "fingerprint_index"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(table(spark, d, "fingerprint_index"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.linked_rows(table(spark, d, "fingerprint_index"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    return packing.usage(packing.pack(table(spark, d, "documents"), targets), targets)


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """What fills the containers: tokens, places for documents, or attention."""
    targets = table(spark, d, "pack_targets")
    return packing.limits(packing.pack(table(spark, d, "documents"), targets), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Leaks from suffix arrays that are built once for an application and kept: what a further test set costs."""
    path = prepared(spark, d, "documents", "suffix-arrays", lambda p: leaks.build(table(spark, d, "documents")).write.parquet(p))
    return leaks.leaked_in(spark.read.parquet(path), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.clean(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "repo", "file_path")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.classify(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.classify(table(spark, d, "documents"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean(table(spark, d, "documents")).select("doc_id", "repo", "file_path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_live": p1_live,
    "p1_recall": p1_recall,
    "p2_found": p2_found,
    "p2_error_share": p2_error_share,
    "p3_found": p3_found,
    "p3_recall": p3_recall,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_pack": p6_pack,
    "p6_usage": p6_usage,
    "p6_limits": p6_limits,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_indexed": p7_indexed,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
    "p8_clean": p8_clean,
}

_KEY = "split_part(split_part(smiles, ' ', 1), chr(9), 1)"
# The fingerprints that take part, and all pairs of them with their likeness.
_SETS = """
    words AS (SELECT DISTINCT mol_id, [coalesce(fingerprint[i], 0) for i in range(1, 17)] AS w FROM fingerprint_index WHERE fp_name = 'Path' AND fingerprint IS NOT NULL AND mol_id IS NOT NULL),
    sized AS (SELECT mol_id, w, CAST(list_sum([bit_count(x) for x in w]) AS INTEGER) AS n FROM words),
    sets AS (SELECT * FROM sized WHERE n > 0 AND n < 1024)"""
_PAIRS = """
    pairs AS (SELECT a, b, shared / CAST(na + nb - shared AS DOUBLE) AS likeness FROM (
        SELECT x.mol_id AS a, y.mol_id AS b, x.n AS na, y.n AS nb, CAST(list_sum([bit_count(x.w[i] & y.w[i]) for i in range(1, 17)]) AS INTEGER) AS shared
        FROM sets x JOIN sets y ON x.mol_id < y.mol_id AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n)))"""
_GRAMS = """
    d AS (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    e AS (SELECT item_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS k FROM d WHERE len(w) >= 13),
    eg AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS k FROM e WHERE len(w) >= 13),
    leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (k))"""

# Skeletons of main components, told apart by refined colours, of all records.
_ALL = "SELECT DISTINCT mol_id AS id, smiles, mol_id || ':0:' || coalesce(smiles, '') AS row FROM smiles_index WHERE mol_id IS NOT NULL UNION SELECT DISTINCT rec_id, smiles, rec_id || ':1:' || coalesce(smiles, '') FROM smiles_batches WHERE rec_id IS NOT NULL"
_SKELETONS = f"""record AS MATERIALIZED ({_ALL}), {Q.parsed("SELECT row, smiles FROM record", "row", "m")}, {Q.directed("m", "row", "mends")}, {Q.components("m", "mends", "row", "part")},
    zs AS MATERIALIZED (SELECT row, unnest(range(len(z)))::INTEGER AS a, unnest(z) AS z FROM m WHERE ok), heavy AS (SELECT row, a, root, z FROM part JOIN zs USING (row, a)),
    nb AS (SELECT e.row, root, count(*) // 2 AS n_bonds FROM mends e JOIN part ON part.row = e.row AND part.a = e.a GROUP BY ALL),
    main AS (SELECT row, root FROM (SELECT row, root, count(*) AS n, list_sort(list(z)) AS zl FROM heavy WHERE z <> 1 GROUP BY ALL) LEFT JOIN nb USING (row, root)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC, coalesce(n_bonds, 0) DESC, zl DESC, root) = 1),
    bone AS MATERIALIZED (SELECT row, a, z FROM heavy JOIN main USING (row, root) WHERE z <> 1),
    joint AS MATERIALIZED (SELECT DISTINCT e.row, e.a, e.b, 0 AS k FROM mends e JOIN bone x ON x.row = e.row AND x.a = e.a JOIN bone y ON y.row = e.row AND y.a = e.b),
    {Q.colours("bone", "joint", "row", "z", "e.k")}, known AS (SELECT id, split_part(row, ':', 2) = '1' AS is_new, shape FROM record JOIN shape USING (row))"""
_REPEATS = f"WITH RECURSIVE {_SKELETONS}, firsts AS (SELECT shape, min(id) AS first_id FROM known GROUP BY shape) SELECT DISTINCT first_id, id AS rec_id FROM known JOIN firsts USING (shape) WHERE is_new AND first_id < id"

SQL: dict[str, str] = {
    "p1_found": _REPEATS,
    "p1_live": _REPEATS,
    "p2_found": f"""
        WITH asked AS (SELECT DISTINCT lookup_id, {_KEY} AS k FROM key_lookups WHERE {_KEY} <> ''),
        earlier AS (SELECT k, min(pos) AS pos FROM (
            SELECT k, lookup_id AS pos FROM asked UNION ALL SELECT {_KEY}, -1 FROM smiles_index WHERE {_KEY} <> '') GROUP BY k)
        SELECT lookup_id FROM asked JOIN earlier USING (k) WHERE earlier.pos < lookup_id""",
    "p3_found": f"""
        WITH {_SETS}, {_PAIRS}, ends AS (SELECT a AS m, b AS o, likeness FROM pairs WHERE likeness >= 0.6 UNION ALL SELECT b, a, likeness FROM pairs WHERE likeness >= 0.6),
        near AS (SELECT m, o FROM ends QUALIFY row_number() OVER (PARTITION BY m ORDER BY likeness DESC, o) <= 5)
        SELECT DISTINCT least(m, o) AS mol_id_a, greatest(m, o) AS mol_id_b FROM near""",
    "p5_found": f"WITH {_SETS}, {_PAIRS} SELECT a AS mol_id_a, b AS mol_id_b FROM pairs WHERE likeness >= 0.8",
    "p5_links": f"""
        WITH {_SETS}, {_PAIRS}, ends AS (SELECT a AS mol_id FROM pairs WHERE likeness >= 0.8 UNION ALL SELECT b FROM pairs WHERE likeness >= 0.8),
        links AS (SELECT mol_id, count(*) AS n FROM ends GROUP BY mol_id)
        SELECT mol_id, min(mol_id) OVER (PARTITION BY w) AS class_id, coalesce(links.n, 0) AS n_links FROM sets LEFT JOIN links USING (mol_id)""",
    "p7_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM leaks",
    "p7_indexed": f"WITH {_GRAMS} SELECT doc_id, item_id FROM leaks",
    # Runs of one diagonal, as word places; bytes are those of the words and of what stands between them.
    "p7_spans": f"""WITH {_GRAMS}, di AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS k FROM d WHERE len(w) >= 13 AND doc_id IN (SELECT doc_id FROM leaks)),
        ei AS (SELECT item_id, unnest(range(1, len(w) - 11)) AS j, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS k FROM e WHERE len(w) >= 13),
        m AS (SELECT DISTINCT doc_id, item_id, i, i - j AS diagonal FROM di JOIN ei USING (k)),
        runs AS (SELECT doc_id, item_id, min(i) AS lo, max(i) + 12 AS hi FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM m) GROUP BY doc_id, item_id, diagonal, run),
        cut AS (SELECT doc_id, [strlen(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] AS n, [strlen(x) for x in regexp_split_to_array(text, '[A-Za-z0-9_]+')] AS gap FROM documents WHERE doc_id IN (SELECT doc_id FROM leaks) AND text IS NOT NULL)
        SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(list_sum(gap[1:lo]) + coalesce(list_sum(n[1:lo - 1]), 0) AS BIGINT) AS first_byte, CAST(list_sum(gap[1:hi]) + list_sum(n[1:hi]) AS BIGINT) AS end_byte, CAST(hi - lo + 1 AS INTEGER) AS n_words FROM runs JOIN cut USING (doc_id)""",
    "p2_error_share": f"SELECT count(*) AS n_lookups, CAST(0 AS BIGINT) AS n_false_seen, CAST(0 AS BIGINT) AS n_missed, CAST(0 AS DOUBLE) AS wrong_share, CAST(1e-6 AS DOUBLE) AS bound FROM (SELECT DISTINCT lookup_id, {_KEY} AS k FROM key_lookups WHERE {_KEY} <> '' AND lookup_id IS NOT NULL)",
    "p7_clean": f"WITH {_GRAMS} SELECT doc_id, repo, file_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
}
