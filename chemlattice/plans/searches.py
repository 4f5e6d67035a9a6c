"""Queries over fingerprints and keys, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemlattice.functions import bits as B
from chemlattice.operators import search as S
from chemlattice.operators import stats
from chemlattice.session import prepared, shared_dir, table
from chemlattice.streaming import ingest

EVERY = 20  # queries of a batch search: rows whose id is divisible by this


KINDS = {"Path": 1024, "Keys": 192}


def _fp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fingerprint_index")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprints with their true bit counts ``n``, sorted by them; built once for all queries of an application."""

    def make(path: str) -> None:
        for kind, width in KINDS.items():
            S.indexed(_fp(spark, d), kind, width).drop("fp_name").write.parquet(f"{path}/fp_name={kind}")

    path = prepared(spark, d, "fingerprint_index", "fingerprints", make)
    return spark.read.schema("mol_id long, fingerprint array<long>, n int, fp_name string").parquet(path)


def _one(t: DataFrame, *kinds: str) -> list[S.Query]:
    """The fingerprints of the lowest id that has one of each kind."""
    held = t.where(F.col("fp_name").isin(*kinds)).groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct("fp_name", "fingerprint"))).alias("by"))  # a few kinds each
    r = held.where(F.size("by") == len(kinds)).orderBy("mol_id").first() if len(kinds) > 1 else t.where(F.col("fp_name") == kinds[0]).orderBy("mol_id").select("mol_id", F.create_map("fp_name", "fingerprint").alias("by")).first()
    return [S.Query(list(r["by"][k]) if r else [], KINDS[k], k) for k in kinds]


def _part(t: DataFrame, *kinds: str, most: int = 4) -> list[S.Query]:
    """A smaller query: for each kind every third set bit of that molecule, the first ``most`` of them."""
    return [S.Query(B.host_words(q.bits[::3][:most], q.n_bits), q.n_bits, q.fp_name) for q in _one(t, *kinds)]


def similarity_search(spark, d):
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.3, counted="n")


def similarity_brute(spark, d):
    """Without index or bounds: what the other plans are measured against."""
    t = _fp(spark, d)
    return S.similar(t, _one(S.of_kind(t, "Path"), "Path")[0], 0.3, strategy="brute")


def similarity_close(spark, d):
    """A high threshold, for which the bounds leave few row groups."""
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.7, counted="n")


def similarity_segments(spark, d):
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.3, strategy="segments", counted="n")


def similarity_strict(spark, d):
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.25, strict=True, strategy="mixed", counted="n")


def similarity_top(spark, d):
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.0, top=25, counted="n")


def similarity_first(spark, d):
    t = _index(spark, d)
    return S.similar(t, _one(t, "Path")[0], 0.2, limit=10, counted="n")


def similarity_union(spark, d):
    t = _index(spark, d)
    return S.similar_any(t, _one(t, "Path", "Keys"), 0.25, counted="n")


def similarity_any(spark, d):
    t = _index(spark, d)
    return S.similar_any(t, _one(t, "Path", "Keys"), 0.25, combine="any", counted="n")


def similarity_all(spark, d):
    t = _index(spark, d)
    return S.similar_any(t, _one(t, "Path", "Keys"), 0.15, combine="all", counted="n")


def _screen(strategy):
    def run(spark, d):
        t = _index(spark, d)
        return S.screen(t, _part(t, "Path")[0], strategy, counted="n")

    return run


def screen_first(spark, d):
    t = _index(spark, d)
    return S.screen(t, _part(t, "Path")[0], limit=5, counted="n")


def screen_several(spark, d):
    t = _index(spark, d)
    return S.screen_all(t, _part(t, "Path", "Keys"), counted="n")


def screen_postings(spark, d):
    """A query of more bits than the rare ones of which the lists are read."""
    t = _index(spark, d)
    lists = prepared(spark, d, "fingerprint_index", "postings", lambda p: S.postings(_fp(spark, d)).sort("bit").write.parquet(p))
    return S.screen_postings(t, spark.read.schema("bit int, mol_id long").parquet(lists), _part(t, "Path", most=12)[0])


def screen_signature(spark, d):
    t = _index(spark, d)

    def make(path: str) -> None:
        bits = S.splitting_bits(_fp(spark, d), 6)
        S.with_signature(t.where("fp_name = 'Path'"), bits).write.partitionBy("sig").parquet(f"{path}/rows")
        spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "at int, bit int").coalesce(1).write.parquet(f"{path}/bits")

    path = prepared(spark, d, "fingerprint_index", "signed", make)
    bits = [r["bit"] for r in spark.read.parquet(f"{path}/bits").orderBy("at").collect()]
    return S.screen_signature(spark.read.parquet(f"{path}/rows"), _part(t, "Path")[0], bits)


def screen_unlike(spark, d):
    """Molecules that pass the screen and aren't similar: a difference of sets."""
    t = _index(spark, d)
    return S.screen(t, _part(t, "Path")[0]).exceptAll(S.similar(t, _one(t, "Path")[0], 0.4).select("mol_id"))


def _queries(t: DataFrame) -> DataFrame:
    return S.of_kind(t, "Path").where(F.col("mol_id") % EVERY == 0).select(F.col("mol_id").alias("query_id"), "fingerprint")


def similarity_batch(spark, d):
    t = _index(spark, d)
    return S.similar_batch(t, _queries(t), 0.7)


def screen_batch(spark, d):
    t = _index(spark, d)
    return S.screen_batch(t, _queries(t))


def bit_counts(spark, d):
    return S.bit_counts(_fp(spark, d))


def postings(spark, d):
    return S.postings(_fp(spark, d))


def segment_counts(spark, d):
    w = B.words("fingerprint", 1024)
    return S.of_kind(_fp(spark, d), "Path").select("mol_id", *[c.cast("int").alias(f"s{i}") for i, c in enumerate(B.segments(w, 5))]).distinct()


def stale_bits(spark, d):
    """Rows whose stored bit count is missing or isn't that of the fingerprint."""
    out = None
    for kind, n in (("Path", 1024), ("Keys", 192)):
        own = S.of_kind(_fp(spark, d), kind).select("mol_id", "fp_name", "bits", B.popcount(B.words("fingerprint", n)).cast("int").alias("counted"))
        out = own if out is None else out.unionByName(own)
    return out.where(~F.col("bits").eqNullSafe(F.col("counted"))).select("mol_id", "fp_name", "counted").distinct()


def next_likeness(spark, d):
    """Likeness of each molecule and the one with the next id."""
    w = B.words("fingerprint", 1024)
    a = S.of_kind(_fp(spark, d), "Path").select("mol_id", *[x.alias(f"a{i}") for i, x in enumerate(w)]).distinct()
    b = a.select((F.col("mol_id") - 1).alias("mol_id"), *[F.col(f"a{i}").alias(f"b{i}") for i in range(16)])
    score = B.tanimoto([F.col(f"a{i}") for i in range(16)], [F.col(f"b{i}") for i in range(16)])
    return a.join(b, "mol_id").select("mol_id", score.alias("score"))


def exact_keys(spark, d):
    """For each lookup the last molecule with its key, character by character, and how many there are."""
    asked = table(spark, d, "key_lookups").select("lookup_id", ingest.key_column("smiles").alias("key")).distinct()
    held = table(spark, d, "smiles_index").select(ingest.key_column("smiles").alias("key"), "mol_id").where("key is not null").groupBy("key")
    return asked.join(held.agg(F.max("mol_id").alias("mol_id"), F.countDistinct("mol_id").alias("n_molecules")), "key").drop("key")


def unique_insert(spark, d):
    """What an insert of the batches would add: keys that aren't in the index, each with its first record."""
    return ingest.new_keys(table(spark, d, "smiles_batches"), table(spark, d, "smiles_index"), "rec_id")


def running_totals(spark, d):
    """Records with a key, and characters of their keys, up to each record."""
    rows = table(spark, d, "smiles_index").select("mol_id", F.length(ingest.key_column("smiles")).cast("long").alias("size")).where("size is not null").distinct()
    return stats.running_totals(rows.withColumn("one", F.lit(1).cast("long")), "mol_id", ["one", "size"]).select("mol_id", "size", F.col("total_one").alias("n_records"), F.col("total_size").alias("n_characters"))


def by_size(spark, d):
    rows = table(spark, d, "smiles_index").select("mol_id", F.length(ingest.key_column("smiles")).alias("size"), "line_pos").where("size is not null and line_pos is not null").distinct()
    return stats.by_size(rows, "size", "line_pos")


def stream_ingest(spark, d):
    """The keys that a stream of the batches adds to the index."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = file_stream(spark, d, "smiles_batches")
    ingest.ingest_stream(stream, table(spark, d, "smiles_index"), f"{base}/keys", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/keys").select("key")


def file_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; the table may be one file or a folder of files."""
    read = spark.readStream.schema(table(spark, d, name).schema)
    file = f"{name}.parquet"
    return read.option("pathGlobFilter", file).parquet(d) if _is_file(spark, f"{d}/{file}") else read.parquet(f"{d}/{file}")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


QUERIES = {
    f.__name__: f
    for f in (
        similarity_search, similarity_brute, similarity_close, similarity_segments, similarity_strict, similarity_top, similarity_first, similarity_union, similarity_any, similarity_all,
        screen_first, screen_several, screen_postings, screen_signature, screen_unlike, similarity_batch, screen_batch, bit_counts, postings, segment_counts, stale_bits,
        next_likeness, exact_keys, unique_insert, running_totals, by_size, stream_ingest,
    )
}
QUERIES |= {f"screen_{s}": _screen(s) for s in S.STRATEGIES}

_KEY = "nullif(split_part(split_part(smiles, ' ', 1), chr(9), 1), '')"


def _bits(words: str) -> str:
    return f"CAST(list_sum([bit_count(x) for x in {words}]) AS INTEGER)"


def _and(a: str, b: str, n: int) -> str:
    return f"CAST(list_sum([bit_count({a}[i] & {b}[i]) for i in range(1, {n + 1})]) AS INTEGER)"


def _words(kind: str, n: int) -> str:
    return f"SELECT DISTINCT mol_id, [coalesce(fingerprint[i], 0) for i in range(1, {n + 1})] AS w FROM fingerprint_index WHERE fp_name = '{kind}' AND fingerprint IS NOT NULL AND mol_id IS NOT NULL"


_BASE = f"""
    p AS ({_words("Path", 16)}), k AS ({_words("Keys", 3)}),
    path AS (SELECT mol_id, w, {_bits("w")} AS n FROM p), keys AS (SELECT mol_id, w, {_bits("w")} AS n FROM k),
    qp AS (SELECT mol_id AS q_id, w AS qw, n AS qn FROM path ORDER BY mol_id LIMIT 1),
    both_id AS (SELECT min(mol_id) AS m FROM path JOIN keys USING (mol_id)),
    bp AS (SELECT w AS qw, n AS qn FROM path WHERE mol_id = (SELECT m FROM both_id)),
    bk AS (SELECT w AS qw, n AS qn FROM keys WHERE mol_id = (SELECT m FROM both_id))"""


def _score(source: str, query: str, n: int) -> str:
    return f"SELECT mol_id, {_and('w', 'qw', n)} / nullif(CAST(n + qn - {_and('w', 'qw', n)} AS DOUBLE), 0) AS score FROM {source}, {query}"


def _thinned(name: str, query: str, n_bits: int, most: int = 4) -> str:
    return f"{name} AS (SELECT bits[1:{3 * most}:3] AS bits FROM (SELECT list_filter(range({n_bits}), lambda b: ((qw[b // 64 + 1] >> (b % 64)) & 1) = 1) AS bits FROM {query}))"


def _holds(source: str, query: str) -> str:
    return f"SELECT DISTINCT mol_id FROM {source}, {query} WHERE len(list_filter({query}.bits, lambda b: ((w[b // 64 + 1] >> (b % 64)) & 1) = 1)) = len({query}.bits)"


_SIM = f"WITH {_BASE}, s AS ({_score('path', 'qp', 16)})"
_TWO = f"WITH {_BASE}, sp AS ({_score('path', 'bp', 16)}), sk AS ({_score('keys', 'bk', 3)})"
_THIN = f"WITH {_BASE}, {_thinned('tp', 'qp', 1024)}, h AS ({_holds('path', 'tp')})"

SQL = {
    "similarity_search": f"{_SIM} SELECT * FROM s WHERE score >= 0.3",
    "similarity_brute": f"{_SIM} SELECT * FROM s WHERE score >= 0.3",
    "similarity_close": f"{_SIM} SELECT * FROM s WHERE score >= 0.7",
    "similarity_segments": f"{_SIM} SELECT * FROM s WHERE score >= 0.3",
    "similarity_strict": f"{_SIM} SELECT * FROM s WHERE score > 0.25",
    "similarity_top": f"{_SIM} SELECT * FROM s WHERE score >= 0 ORDER BY score DESC, mol_id LIMIT 25",
    "similarity_first": f"{_SIM} SELECT * FROM s WHERE score >= 0.2 ORDER BY mol_id LIMIT 10",
    "similarity_union": f"{_TWO} SELECT *, 'Path' AS fp_name FROM sp WHERE score >= 0.25 UNION ALL SELECT *, 'Keys' AS fp_name FROM sk WHERE score >= 0.25",
    "similarity_any": f"{_TWO} SELECT mol_id, max(score) AS score FROM (SELECT * FROM sp UNION ALL SELECT * FROM sk) WHERE score >= 0.25 GROUP BY mol_id",
    "similarity_all": f"{_TWO} SELECT mol_id, least(sp.score, sk.score) AS score FROM sp JOIN sk USING (mol_id) WHERE sp.score >= 0.15 AND sk.score >= 0.15",
    "screen_first": f"{_THIN} SELECT mol_id FROM h ORDER BY mol_id LIMIT 5",
    "screen_several": f"WITH {_BASE}, {_thinned('tp', 'bp', 1024)}, {_thinned('tk', 'bk', 192)}, hp AS ({_holds('path', 'tp')}), hk AS ({_holds('keys', 'tk')}) SELECT mol_id FROM hp JOIN hk USING (mol_id)",
    "screen_unlike": f"{_THIN}, s AS ({_score('path', 'qp', 16)}) SELECT mol_id FROM h EXCEPT SELECT mol_id FROM s WHERE score >= 0.4",
    "similarity_batch": f"""WITH {_BASE}, q AS (SELECT mol_id AS query_id, w AS qw, n AS qn FROM path WHERE mol_id % {EVERY} = 0 AND n > 0)
        SELECT query_id, mol_id, score FROM (SELECT query_id, mol_id, {_and("w", "qw", 16)} AS c, c / CAST(n + qn - c AS DOUBLE) AS score FROM path, q WHERE n BETWEEN ceil(0.7 * qn - 1e-9) AND floor(qn / 0.7 + 1e-9)) WHERE score >= 0.7""",
    "screen_batch": f"""WITH {_BASE}, q AS (SELECT mol_id AS query_id, w AS qw, n AS qn FROM path WHERE mol_id % {EVERY} = 0)
        SELECT query_id, mol_id FROM path, q WHERE n >= qn AND {_and("w", "qw", 16)} = qn""",
    "bit_counts": f"""WITH {_BASE}, b AS (SELECT unnest(list_filter(range(1024), lambda b: ((w[b // 64 + 1] >> (b % 64)) & 1) = 1)) AS bit FROM path), c AS (SELECT bit, count(*) AS n FROM b GROUP BY bit), t AS (SELECT count(*) AS total FROM path)
        SELECT CAST(r.i AS INTEGER) AS bit, coalesce(n, 0) AS n_set, total - coalesce(n, 0) AS n_clear, abs(total - 2 * coalesce(n, 0)) AS imbalance FROM range(1024) r(i) LEFT JOIN c ON c.bit = r.i, t""",
    "postings": f"WITH {_BASE} SELECT DISTINCT CAST(unnest(list_filter(range(1024), lambda b: ((w[b // 64 + 1] >> (b % 64)) & 1) = 1)) AS INTEGER) AS bit, mol_id FROM path",
    "segment_counts": f"WITH {_BASE} SELECT mol_id, " + ", ".join(f"{_bits(f'w[{3 * i + 1}:{3 * i + 3 if i < 4 else 16}]')} AS s{i}" for i in range(5)) + " FROM path",
    "stale_bits": f"""WITH {_BASE}, c AS (SELECT mol_id, 'Path' AS fp_name, n FROM path UNION ALL SELECT mol_id, 'Keys', n FROM keys)
        SELECT DISTINCT mol_id, fp_name, n AS counted FROM c JOIN fingerprint_index f USING (mol_id, fp_name) WHERE f.fingerprint IS NOT NULL AND f.bits IS DISTINCT FROM n""",
    "next_likeness": f"""WITH {_BASE}, j AS (SELECT a.mol_id, a.n AS na, b.n AS nb, {_and("a.w", "b.w", 16)} AS c FROM path a JOIN path b ON b.mol_id = a.mol_id + 1)
        SELECT mol_id, c / nullif(CAST(na + nb - c AS DOUBLE), 0) AS score FROM j""",
    "exact_keys": f"""WITH h AS (SELECT {_KEY} AS key, max(mol_id) AS mol_id, count(DISTINCT mol_id) AS n_molecules FROM smiles_index WHERE {_KEY} IS NOT NULL GROUP BY 1)
        SELECT DISTINCT lookup_id, mol_id, n_molecules FROM (SELECT lookup_id, {_KEY} AS key FROM key_lookups) JOIN h USING (key)""",
    "unique_insert": f"""SELECT key, min(rec_id) AS rec_id FROM (SELECT {_KEY} AS key, rec_id FROM smiles_batches) WHERE key IS NOT NULL
        AND key NOT IN (SELECT {_KEY} FROM smiles_index WHERE {_KEY} IS NOT NULL) GROUP BY key""",
    "running_totals": f"""WITH r AS (SELECT DISTINCT mol_id, CAST(length({_KEY}) AS BIGINT) AS size FROM smiles_index WHERE {_KEY} IS NOT NULL)
        SELECT mol_id, size, CAST(count(*) OVER w AS BIGINT) AS n_records, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS n_characters FROM r WINDOW w AS (ORDER BY mol_id RANGE UNBOUNDED PRECEDING)""",
    "by_size": f"SELECT size, count(*) AS n, CAST(sum(line_pos) AS BIGINT) AS total FROM (SELECT DISTINCT mol_id, CAST(length({_KEY}) AS INTEGER) AS size, line_pos FROM smiles_index WHERE {_KEY} IS NOT NULL AND line_pos IS NOT NULL) GROUP BY size",
    "stream_ingest": f"SELECT DISTINCT {_KEY} AS key FROM smiles_batches WHERE {_KEY} IS NOT NULL AND {_KEY} NOT IN (SELECT {_KEY} FROM smiles_index WHERE {_KEY} IS NOT NULL)",
}
SQL |= {f"screen_{s}": f"{_THIN} SELECT mol_id FROM h" for s in [*S.STRATEGIES, "signature"]}
SQL["screen_postings"] = f"WITH {_BASE}, {_thinned('tp', 'qp', 1024, 12)}, h AS ({_holds('path', 'tp')}) SELECT mol_id FROM h"
