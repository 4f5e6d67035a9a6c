"""Queries on a molecule store that is built from the tables, on molecule files and on streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemlattice.functions.fingerprints import REGISTRY
from chemlattice.operators import search as S
from chemlattice.plans import chemistry as C
from chemlattice.plans import smiles_sql as Q
from chemlattice.plans.searches import file_stream
from chemlattice.session import prepared, shared_dir, table
from chemlattice.sources import sinks
from chemlattice.sources.molecules import first_molecule, read_molecules, with_molecules
from chemlattice.store import MoleculeStore
from chemlattice.streaming import ingest


def _store(spark: SparkSession, d: str, kind: str = "all") -> MoleculeStore:
    """A store of the index: ``all`` keeps repeats, ``unique`` leaves them out and takes in the batches next, ``more`` gets fingerprints later.

    Rings are taken as written, as the SQL does. A store is built once for all queries of an application, and all stores
    take the molecules as they were read once.
    """

    def make(path: str) -> None:
        s = MoleculeStore(spark, path, aromatic="written")
        s.create(["Pattern"])
        s.insert_read(C.records(spark, d, "smiles_index", "mol_id"), unique=kind == "unique")
        if kind == "unique":
            s.insert_read(C.records(spark, d, "smiles_batches", "rec_id"))
        if kind == "more":
            s.add_fingerprint("Torsion")
            s.add_fingerprint("Pattern")

    return MoleculeStore(spark, prepared(spark, d, "smiles_index", f"store-{kind}", make), aromatic="written")


def _first_text(spark: SparkSession, d: str) -> str:
    r = _store(spark, d).molecules().orderBy("mol_id").select("smiles").first()
    return r["smiles"] if r else "C"


def store_insert(spark, d):
    """Molecules read and inserted: the index without repeats, then the batches."""
    return _store(spark, d, "unique").log().select("batch", "n_read", "n_inserted")


def store_insert_all(spark, d):
    return _store(spark, d).log().select("batch", "n_read", "n_inserted", "next_id")


def store_records(spark, d):
    """All records under their new ids."""
    return _store(spark, d).molecules().select("mol_id", "smiles", "title", "n_atoms", "n_bonds")


def store_count(spark, d):
    return spark.createDataFrame([(_store(spark, d).count(), _store(spark, d, "unique").count())], "n_all long, n_unique long")


def store_information(spark, d):
    """Number of molecules and widths of the fingerprints; sizes in bytes are left out."""
    return _store(spark, d).information().where("item not like 'bytes%'")


def store_catalog(spark, d):
    return _store(spark, d, "more").catalog().select("position", "fp_name", "n_bits", "screen_safe", "gen")


def store_record(spark, d):
    """One record with its fingerprint."""
    r = _store(spark, d).record(1)
    bits = F.element_at("fingerprints", "Pattern")["bits"]
    return r.select("mol_id", "smiles", "title", F.size("fingerprints").alias("n_fingerprints"), bits.alias("bits"))


def store_exact(spark, d):
    """The records that are the first one's molecule."""
    return _store(spark, d).exact(_first_text(spark, d))


def store_exact_last(spark, d):
    return _store(spark, d).exact(_first_text(spark, d), last=True)


def store_screen(spark, d):
    return _store(spark, d).screen(C.PATTERN, "Pattern")


def store_similar(spark, d):
    return _store(spark, d).similar(_first_text(spark, d), 0.6, "Pattern")


def store_similar_strict(spark, d):
    return _store(spark, d).similar(_first_text(spark, d), 0.6, "Pattern", strict=True, limit=20)


def store_substructure(spark, d):
    return _store(spark, d).substructure(C.PATTERN)


def store_quick(spark, d):
    return _store(spark, d).quick_substructure(C.PATTERN)


def store_add_fingerprint(spark, d):
    """Rows and set bits of each fingerprint, those that were added later included."""
    return _store(spark, d, "more").fingerprint_table().groupBy("fp_name").agg(F.count("*").alias("n_rows"), F.sum("bits").alias("n_set"))


# Files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_molecules(spark, d):
    """The query molecules written as a SMILES file and read again, in order. The table is of fixed size, so one file holds it."""
    path = f"{_folder(spark, 'file')}.smi"
    rows = table(spark, d, "query_sets").orderBy("query_id").coalesce(1)
    sinks.write_smiles(rows.select("smiles", F.col("set_name").alias("title")), path)
    return read_molecules(spark, path)


def file_first(spark, d):
    path = f"{_folder(spark, 'file')}.smi"
    sinks.write_smiles(table(spark, d, "query_sets").orderBy("query_id").coalesce(1).select("smiles", F.col("set_name").alias("title")), path)
    return first_molecule(spark, path)


def file_graphs(spark, d):
    """Reduced graphs of the query molecules written as a graph file and read again."""
    path = f"{_folder(spark, 'file')}.graphs"
    mols = with_molecules(table(spark, d, "query_sets").select("query_id", "smiles")).where("canonical is not null")
    mols.orderBy("query_id").coalesce(1).select("reduced").write.text(path)
    return read_molecules(spark, path).groupBy().agg(F.count("*").alias("n_graphs"), F.max("position").alias("last"))


def hits_as_text(spark, d):
    """Hits of a screen written as lines, read again."""
    path = _folder(spark, "hits")
    sinks.write_hits(store_screen(spark, d), path)
    return spark.read.text(path)


def postings_as_csv(spark, d):
    """The inverted index of the short fingerprints written as CSV, a folder for each bit, read again."""
    path = _folder(spark, "postings")
    sinks.write_postings(S.postings(table(spark, d, "fingerprint_index"), "Keys"), path)
    return spark.read.schema("mol_id long, bit int").csv(path).select("bit", "mol_id")


# Streams


def _run(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to its present end and gives what it wrote; in mode ``complete`` the last result."""
    base = _folder(spark, "stream")
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    else:
        q = out.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def similar_stream(spark, d):
    """A stream of fingerprints against a fixed query: the fingerprint of the lowest id."""
    t = table(spark, d, "fingerprint_index")
    r = S.of_kind(t, "Path").orderBy("mol_id").select("fingerprint").first()
    q = S.Query(list(r["fingerprint"])[:16] if r else [], 1024)
    return _run(spark, ingest.similar_stream(file_stream(spark, d, "fingerprint_index"), q, 0.3)).distinct()


def first_in_time(spark, d):
    rows = file_stream(spark, d, "smiles_batches").where("received_at is not null")
    return _run(spark, ingest.first_in_time(rows, "received_at", "3650 days").select("key"))


def arrivals(spark, d):
    """Records of each hour, late ones included."""
    rows = file_stream(spark, d, "smiles_batches").where("received_at is not null")
    return _run(spark, ingest.arrivals(rows, "received_at", "1 hour", "3650 days").select(F.col("start").cast("timestamp_ntz").alias("start"), "n_records"), "complete")


QUERIES = {
    f.__name__: f
    for f in (
        store_insert, store_insert_all, store_records, store_count, store_information, store_catalog, store_record, store_exact, store_exact_last, store_screen, store_similar, store_similar_strict,
        store_substructure, store_quick, store_add_fingerprint, file_molecules, file_first, file_graphs, hits_as_text, postings_as_csv, similar_stream, first_in_time, arrivals,
    )
}

# SQL. A store that keeps repeats numbers the readable records in the order of their ids.
_NEW = "named AS (SELECT mol_id, row_number() OVER (ORDER BY mol_id) - 1 AS id FROM mol WHERE ok), title AS (SELECT DISTINCT ON (mol_id) mol_id, smiles, title FROM smiles_index WHERE mol_id IS NOT NULL)"
_PB = C.pattern_bits("mol", "ends", "mol_id", "pb")
_WIDTH = REGISTRY["Pattern"].n_bits
_SAME = f"WITH {C.SHAPE}, {_NEW}, same AS (SELECT id FROM named JOIN shape USING (mol_id) WHERE shape = (SELECT shape FROM shape JOIN named USING (mol_id) WHERE id = 0))"
_SCREEN = f"""WITH RECURSIVE {C.MOL}, {_PB}, {C.query_cte(C.PATTERN)}, {Q.directed('qm', 'query_id', 'qends')}, {C.pattern_bits('qm', 'qends', 'query_id', 'qb')}, {_NEW},
    hit AS (SELECT mol_id FROM pb JOIN qb USING (bit) GROUP BY mol_id HAVING count(*) = (SELECT count(*) FROM qb))"""
_LIKE = f"""WITH RECURSIVE {C.MOL}, {_PB}, {_NEW}, q AS (SELECT bit FROM pb JOIN named USING (mol_id) WHERE id = 0),
    s AS (SELECT named.id AS mol_id, count(q.bit) / CAST(count(*) + (SELECT count(*) FROM q) - count(q.bit) AS DOUBLE) AS score, 'Pattern' AS fp_name FROM pb JOIN named USING (mol_id) LEFT JOIN q USING (bit) GROUP BY named.id)"""
_KEY = "nullif(split_part(split_part(smiles, ' ', 1), chr(9), 1), '')"
_LINE = "lines AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS position, smiles || CASE WHEN coalesce(set_name, '') <> '' THEN ' ' || set_name ELSE '' END AS line FROM query_sets WHERE smiles IS NOT NULL), read AS (SELECT position, regexp_extract(line, '^([^ \\t]*)', 1) AS smiles, regexp_extract(line, '^[^ \\t]*[ \\t]+(.*)$', 1) AS title FROM lines)"
_SETS = "SELECT DISTINCT mol_id, [coalesce(fingerprint[i], 0) for i in range(1, {n})] AS w FROM fingerprint_index WHERE fp_name = '{kind}' AND fingerprint IS NOT NULL AND mol_id IS NOT NULL"
SQL: dict[str, str] = {
    "store_insert": f"""WITH {C.SHAPE}, {C.REC} SELECT 0::INTEGER AS batch, (SELECT count(*) FROM mol WHERE ok) AS n_read, (SELECT count(DISTINCT shape) FROM shape) AS n_inserted
        UNION ALL SELECT 1::INTEGER, (SELECT count(*) FROM rec WHERE ok), (SELECT count(DISTINCT shape) FROM rshape WHERE shape NOT IN (SELECT shape FROM shape))""",
    "store_insert_all": f"WITH {C.MOL} SELECT 0::INTEGER AS batch, count(*) AS n_read, count(*) AS n_inserted, count(*) AS next_id FROM mol WHERE ok",
    "store_records": f"WITH {C.MOL}, {_NEW} SELECT id AS mol_id, smiles, title, len(z)::INTEGER AS n_atoms, len(bonds)::INTEGER AS n_bonds FROM named JOIN title USING (mol_id) JOIN mol USING (mol_id)",
    "store_count": f"WITH {C.SHAPE}, {C.REC} SELECT (SELECT count(*) FROM mol WHERE ok) AS n_all, (SELECT count(*) FROM (SELECT shape FROM shape UNION SELECT shape FROM rshape)) AS n_unique",
    "store_information": f"WITH {C.MOL} SELECT 'molecules' AS item, CAST(count(*) AS VARCHAR) AS value FROM mol WHERE ok UNION ALL SELECT 'bits of Pattern', '{_WIDTH}'",
    "store_catalog": f"SELECT * FROM (VALUES (0, 'Pattern', {_WIDTH}, true, 1), (1, 'Torsion', 1024, false, 0)) v(position, fp_name, n_bits, screen_safe, gen)",
    "store_record": f"""WITH RECURSIVE {C.MOL}, {_PB}, {_NEW} SELECT id AS mol_id, smiles, title, 1::INTEGER AS n_fingerprints, (SELECT count(*)::INTEGER FROM pb WHERE pb.mol_id = named.mol_id) AS bits FROM named JOIN title USING (mol_id) WHERE id = 1""",
    "store_exact": f"{_SAME} SELECT id AS mol_id FROM same",
    "store_exact_last": f"{_SAME} SELECT max(id) AS mol_id FROM same HAVING count(*) > 0",
    "store_screen": f"{_SCREEN} SELECT id AS mol_id FROM hit JOIN named USING (mol_id)",
    "store_similar": f"{_LIKE} SELECT * FROM s WHERE score >= 0.6",
    "store_similar_strict": f"{_LIKE} SELECT * FROM s WHERE score > 0.6 ORDER BY score DESC, mol_id LIMIT 20",
    "store_substructure": f"{C.found(C.PATTERN)}, {_NEW} SELECT DISTINCT id AS mol_id FROM found JOIN named USING (mol_id)",
    "store_quick": f"{C.found(C.PATTERN)}, {_NEW} SELECT DISTINCT id AS mol_id FROM found JOIN named USING (mol_id)",
    "store_add_fingerprint": f"""WITH RECURSIVE tb AS ({C.SQL['torsion_fingerprints']}), pt AS ({C.SQL['pattern_fingerprints']}), b AS (SELECT 'Torsion' AS fp_name, bits FROM tb UNION ALL SELECT 'Pattern', bits FROM pt)
        SELECT fp_name, count(*) AS n_rows, CAST(sum(CASE WHEN bits = '' THEN 0 ELSE len(string_split(bits, ',')) END) AS BIGINT) AS n_set FROM b GROUP BY fp_name""",
    "file_molecules": f"WITH {_LINE} SELECT * FROM read",
    "file_first": f"WITH {_LINE} SELECT * FROM read WHERE position = 0",
    "file_graphs": f"WITH {Q.parsed('SELECT query_id, smiles FROM query_sets', 'query_id', 'qm')} SELECT count(*) AS n_graphs, count(*) - 1 AS last FROM qm WHERE ok",
    "hits_as_text": f"{_SCREEN} SELECT CAST(id AS VARCHAR) AS value FROM hit JOIN named USING (mol_id)",
    "postings_as_csv": f"WITH k AS ({_SETS.format(n=4, kind='Keys')}) SELECT DISTINCT CAST(unnest(list_filter(range(192), lambda b: ((w[b // 64 + 1] >> (b % 64)) & 1) = 1)) AS INTEGER) AS bit, mol_id FROM k",
    "similar_stream": f"""WITH p AS ({_SETS.format(n=17, kind='Path')}), s AS (SELECT mol_id, w, CAST(list_sum([bit_count(x) for x in w]) AS INTEGER) AS n FROM p), q AS (SELECT w AS qw, n AS qn FROM s ORDER BY mol_id LIMIT 1),
        c AS (SELECT mol_id, n + qn AS total, CAST(list_sum([bit_count(w[i] & qw[i]) for i in range(1, 17)]) AS INTEGER) AS common FROM s, q) SELECT mol_id, common / CAST(total - common AS DOUBLE) AS score FROM c WHERE common / nullif(CAST(total - common AS DOUBLE), 0) >= 0.3""",
    "first_in_time": f"SELECT DISTINCT {_KEY} AS key FROM smiles_batches WHERE received_at IS NOT NULL AND {_KEY} IS NOT NULL",
    "arrivals": "SELECT date_trunc('hour', received_at) AS start, count(*) AS n_records FROM smiles_batches WHERE received_at IS NOT NULL GROUP BY 1",
}
