"""Queries over molecules as graphs, with SQL that reads the molecules itself (``smiles_sql``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemlattice import service
from chemlattice.functions.fingerprints import PATTERNS, REGISTRY
from chemlattice.functions.smiles import MASS
from chemlattice.operators import search, stats, substructure
from chemlattice.plans import smiles_sql as Q
from chemlattice.session import prepared, stage, table, tasks_for
from chemlattice.sources.molecules import graph_text_column, parse_graph_text, with_molecules

PATTERN = "c1ccncc1"
SMALL = "NC=O"


def _parsed(rows: DataFrame, key: str) -> DataFrame:
    """Each record once, parsed. The partitions are stated: they are small in bytes, and parsing takes long."""
    once = rows.where(F.col(key).isNotNull()).repartition(tasks_for(rows.sparkSession, rows.count(), 20_000), key).dropDuplicates([key])
    return with_molecules(once).where("canonical is not null")


def _read(spark: SparkSession, d: str, name: str, key: str, *more: str) -> DataFrame:
    """The readable molecules of a table, each record once; parsed once for all queries of an application."""
    df = _parsed(table(spark, d, name).select(key, "smiles", *more), key)
    path = prepared(spark, d, name, "-".join(["molecules", name, *more]), lambda p: df.write.parquet(p))
    return spark.read.schema(df.schema).parquet(path)


def records(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The same as a store takes them in: ``position``, the text, the title and what was read."""
    df = _read(spark, d, name, key, "title")
    return df.select(F.col(key).cast("long").alias("position"), *[c for c in df.columns if c != key])


def _molecules(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "smiles_index", "mol_id", "title")


def _fingerprints(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """The molecules with fingerprints of the kinds, worked out once."""
    df = substructure.with_fingerprints(_molecules(spark, d), list(kinds))
    path = prepared(spark, d, "smiles_index", "fingerprints-" + "-".join(kinds), lambda p: df.write.parquet(p))
    return spark.read.schema(df.schema).parquet(path)


def molecules(spark, d):
    return _molecules(spark, d).select("mol_id", "n_atoms", "n_bonds", "mol_weight")


def graphs(spark, d):
    """Vertex labels and bonds as text."""
    bonds = F.transform("bonds", lambda b: F.concat_ws("-", b["a"], b["b"], b["label"]))
    return _molecules(spark, d).select("mol_id", F.array_join(F.col("atoms").cast("array<string>"), ",").alias("atoms"), F.array_join(bonds, ",").alias("bonds"))


def graph_text(spark, d):
    """Reduced graphs written as text, read, and written again by expressions: the same text, kept vertices and edges."""
    read = parse_graph_text(_molecules(spark, d).select("mol_id", "reduced"), "reduced")
    return read.select("mol_id", (F.col("reduced") == graph_text_column()).alias("same"), F.size("labels").alias("n_kept"), F.size("edges").alias("n_edges"))


def atom_histogram(spark, d):
    return stats.atom_histogram(_molecules(spark, d))


def degree_histogram(spark, d):
    return stats.degree_histogram(_molecules(spark, d))


def graph_counters(spark, d):
    return stats.counters(_molecules(spark, d))


def exact_structures(spark, d):
    """For each record of the batches the first and last molecule of the index that is the same, however written."""
    q = _read(spark, d, "smiles_batches", "rec_id").select("rec_id", "canonical")
    held = _molecules(spark, d).groupBy("canonical").agg(F.min("mol_id").alias("first_mol_id"), F.max("mol_id").alias("last_mol_id"))
    return q.join(held, "canonical").select("rec_id", "first_mol_id", "last_mol_id")


def structure_insert(spark, d):
    """Structures that the batches add to the index: the first record of each new molecule."""
    first = _read(spark, d, "smiles_batches", "rec_id").groupBy("canonical").agg(F.min("rec_id").alias("rec_id"))
    return first.join(_molecules(spark, d).select("canonical"), "canonical", "left_anti").select("rec_id")


def substructure_full(spark, d):
    return substructure.match(_molecules(spark, d), PATTERN)


def substructure_induced(spark, d):
    return substructure.match(_molecules(spark, d), PATTERN, "induced")


def substructure_first(spark, d):
    return substructure.match(_molecules(spark, d), PATTERN, limit=10)


def substructure_joins(spark, d):
    return substructure.match_relational(stage(substructure.bond_table(_molecules(spark, d)), "bonds"), SMALL)


def substructure_batch(spark, d):
    return substructure.match_batch(_molecules(spark, d), table(spark, d, "query_sets"))


def substructure_quick(spark, d):
    return substructure.quick(_fingerprints(spark, d, "Pattern"), PATTERN)


def _bit_text(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Numbers of the set bits as text."""
    n = (REGISTRY[kind].n_bits + 63) // 64 * 64
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.element_at(f"fp_{kind}", (F.floor(i / 64) + 1).cast("int")), i % 64) == 1)
    return _fingerprints(spark, d, kind).select("mol_id", F.array_join(bits.cast("array<string>"), ",").alias("bits"))


def path_fingerprints(spark, d):
    return _bit_text(spark, d, "GraphPath")


def pattern_fingerprints(spark, d):
    return _bit_text(spark, d, "Pattern")


def torsion_fingerprints(spark, d):
    return _bit_text(spark, d, "Torsion")


def atom_pair_fingerprints(spark, d):
    return _bit_text(spark, d, "AtomPair")


def layered_fingerprints(spark, d):
    return _bit_text(spark, d, "Layered")


def topological_fingerprints(spark, d):
    return _bit_text(spark, d, "Topological")


def screen_efficiency(spark, d):
    """For each query: molecules that the pattern fingerprint lets through, those that hold it, and the share of false alarms."""
    held = _fingerprints(spark, d, "Pattern")
    n = REGISTRY["Pattern"].n_bits
    queries = substructure.with_fingerprints(with_molecules(table(spark, d, "query_sets").select("query_id", "smiles")).where("canonical is not null"), ["Pattern"])
    as_table = held.select("mol_id", F.lit("Pattern").alias("fp_name"), F.col("fp_Pattern").alias("fingerprint"))
    screened = search.screen_batch(as_table, queries.select("query_id", F.col("fp_Pattern").alias("fingerprint")), "Pattern", n)
    return search.screen_efficiency(screened, substructure.match_batch(held, table(spark, d, "query_sets")))


def service_answers(spark, d):
    """Answers of the line service to a request for each query."""
    requests = table(spark, d, "query_sets").select(F.concat(F.lit("FINGERPRINT Pattern "), "smiles").alias("value"))
    return service.answers(requests)


def aromatic_writings(spark, d):
    """Pairs of writings of the index's first molecules' ring systems that are one molecule when rings are perceived: a fixed list."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_WRITINGS)], "pair int, a string, b string")
    keys = with_molecules(rows.select("pair", F.explode(F.array("a", "b")).alias("smiles")), aromatic="perceived")
    return keys.groupBy("pair").agg((F.countDistinct("canonical") == 1).alias("same"))


# Two writings each, and whether they are one molecule.
_WRITINGS = [
    ("c1ccccc1", "C1=CC=CC=C1", True), ("c1ccncc1", "C1=CC=NC=C1", True), ("c1cc[nH]c1", "C1=CNC=C1", True), ("c1ccoc1", "O1C=CC=C1", True), ("c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1", True),
    ("c1ccccc1c1ccccc1", "C1=CC=C(C=C1)C1=CC=CC=C1", True), ("C1CCCCC1", "c1ccccc1", False), ("C1=CC=CC1", "c1cc[cH-]c1", False), ("N", "[NH4+]", False), ("C", "[CH4]", True), ("C", "[CH3]", False),
    ("[13CH4]", "C", False), ("OCC.Cl", "Cl.CCO", True), ("C1CCCCC1.C1CC1", "C1CC1.C1CCCCC1", True), ("CC(=O)O", "OC(C)=O", True), ("CC(=O)O", "CC(=O)[O-]", False),
]

QUERIES = {
    f.__name__: f
    for f in (
        molecules, graphs, graph_text, atom_histogram, degree_histogram, graph_counters, exact_structures, structure_insert, substructure_full, substructure_induced,
        substructure_first, substructure_joins, substructure_batch, substructure_quick, path_fingerprints, pattern_fingerprints, torsion_fingerprints, atom_pair_fingerprints,
        layered_fingerprints, topological_fingerprints, screen_efficiency, service_answers, aromatic_writings,
    )
}

# SQL

ONCE = "SELECT DISTINCT ON (mol_id) mol_id, smiles FROM smiles_index WHERE mol_id IS NOT NULL"
_RECORDS = "SELECT DISTINCT ON (rec_id) rec_id, smiles FROM smiles_batches WHERE rec_id IS NOT NULL"
MOL = f"{Q.parsed(ONCE, 'mol_id')}, {Q.directed('mol', 'mol_id')}"
ATOM = f"{MOL}, {Q.atoms('mol', 'ends', 'mol_id')}"
SHAPE = f"{ATOM}, {Q.colours('atom', 'ends', 'mol_id', 'label, h, q, iso', 'e.k')}"
REC = f"{Q.parsed(_RECORDS, 'rec_id', 'rec')}, {Q.directed('rec', 'rec_id', 'rends')}, {Q.atoms('rec', 'rends', 'rec_id', 'ratom')}, {Q.colours('ratom', 'rends', 'rec_id', 'label, h, q, iso', 'e.k', 'rshape')}"
_KEPT = f"""{MOL}, deg AS (SELECT mol_id, a, count(DISTINCT b) AS n FROM ends GROUP BY ALL), {Q.components('mol', 'ends', 'mol_id')},
    vertex AS (SELECT mol_id, part.a, root, coalesce(n, 0) AS n FROM part LEFT JOIN deg USING (mol_id, a)),
    whole AS (SELECT mol_id, root, count(*) FILTER (WHERE n > 2) AS many, count(*) FILTER (WHERE n = 2) AS twos, min(n) AS least, count(*) AS size, sum(n) // 2 AS edges FROM vertex GROUP BY ALL),
    kept AS (SELECT mol_id, sum(greatest(many, 1))::INTEGER AS n_kept, sum(size)::BIGINT AS n_atoms,
        sum(edges - CASE WHEN many = 0 AND least = 2 THEN twos - 1 ELSE twos END)::INTEGER AS n_edges FROM whole GROUP BY mol_id)"""


def query_cte(smiles: str, name: str = "qm") -> str:
    return Q.parsed(f"SELECT 1 AS query_id, '{smiles}' AS smiles", "query_id", name)


def found(smiles: str) -> str:
    return f"WITH RECURSIVE {MOL}, {query_cte(smiles)}, {Q.matches('qm', 'mol', 'ends', 'query_id', 'mol_id')}"


def pattern_bits(mol: str, ends: str, key: str, name: str) -> str:
    """CTE ``name`` of ``key, bit``: bits of the pattern dictionary, each set where a pattern lies in more places than its count."""
    names = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in PATTERNS))}
    texts = "SELECT pattern, smiles FROM (VALUES " + ", ".join(f"({i}, '{p}')" for p, i in names.items()) + ") v(pattern, smiles)"
    bits = "(VALUES " + ", ".join(f"({i}, {names[p]}, {c})" for i, (p, c) in enumerate(PATTERNS)) + ") b(bit, pattern, above)"
    return f"""{Q.parsed(texts, 'pattern', f'{name}_p')}, {Q.matches(f'{name}_p', mol, ends, 'pattern', key, f'{name}_in')},
        {name}_n AS MATERIALIZED (SELECT {key}, pattern, count(DISTINCT list_sort(map)) AS n FROM {name}_in GROUP BY ALL), {name} AS MATERIALIZED (SELECT {key}, bit FROM {name}_n JOIN {bits} USING (pattern) WHERE n > above)"""


def paths(most: int, label: str = "label") -> str:
    """CTE ``path`` of ``mol_id, map, code``: simple paths of up to ``most`` atoms from each atom, labels of atoms and bonds in turn."""
    return f"""lab AS MATERIALIZED (SELECT mol_id, a, {label} AS label FROM atom),
        path AS (SELECT mol_id, [a] AS map, [label] AS code FROM lab UNION ALL SELECT p.mol_id, list_append(p.map, e.b), p.code || [e.k, l.label] FROM path p JOIN ends e ON e.mol_id = p.mol_id AND e.a = p.map[-1]
        JOIN lab l ON l.mol_id = e.mol_id AND l.a = e.b WHERE len(p.map) < {most} AND NOT list_contains(p.map, e.b))"""


def _bit(code: str, n: int) -> str:
    return f"CAST('0x' || substr(md5(array_to_string({code}, ',')), 1, 15) AS BIGINT) % {n}"


def _as_text(source: str) -> str:
    return f"SELECT mol_id, coalesce(array_to_string(list_sort(list(DISTINCT bit) FILTER (WHERE bit IS NOT NULL)), ','), '') AS bits FROM (SELECT mol_id FROM mol WHERE ok) LEFT JOIN ({source}) USING (mol_id) GROUP BY mol_id"


_ONE_WAY = "CASE WHEN code <= list_reverse(code) THEN code ELSE list_reverse(code) END"
_BONDS = "[code[i] for i in range(2, len(code), 2)]"
_PATHS = f"WITH RECURSIVE {ATOM}, {paths(7)}"
_PLAIN = "CASE label WHEN 128 THEN 6 WHEN 129 THEN 7 WHEN 130 THEN 8 WHEN 131 THEN 15 WHEN 132 THEN 16 ELSE label END"
_SETS = "SELECT query_id, smiles FROM query_sets"
_BITS = f"{Q.directed('qm', 'query_id', 'qends')}, {pattern_bits('mol', 'ends', 'mol_id', 'pb')}, {pattern_bits('qm', 'qends', 'query_id', 'qb')}"
_MASSES = ", ".join(f"({z}, {m})" for z, m in MASS.items())
_BATCH = f"{MOL}, {Q.parsed(_SETS, 'query_id', 'qm')}, {Q.matches('qm', 'mol', 'ends', 'query_id', 'mol_id')}"
SQL: dict[str, str] = {
    "molecules": f"""WITH {ATOM}, mass AS (SELECT * FROM (VALUES {_MASSES}) v(z, mass))
        SELECT mol_id, len(any_value(mol.z))::INTEGER AS n_atoms, len(any_value(mol.bonds))::INTEGER AS n_bonds,
            CASE WHEN count(*) = count(coalesce(nullif(atom.iso, 0), mass)) THEN round(sum(coalesce(nullif(atom.iso, 0), mass)::DOUBLE + atom.h * 1.008::DOUBLE), 4) END AS mol_weight
        FROM mol JOIN atom USING (mol_id) LEFT JOIN mass ON mass.z = atom.z WHERE ok GROUP BY mol_id""",
    "graphs": f"WITH {MOL} SELECT mol_id, array_to_string(labels, ',') AS atoms, array_to_string([x.a || '-' || x.b || '-' || x.k for x in bonds], ',') AS bonds FROM mol WHERE ok",
    "graph_text": f"WITH RECURSIVE {_KEPT} SELECT mol_id, true AS same, n_kept, n_edges FROM kept",
    "atom_histogram": f"WITH {MOL} SELECT len(z)::INTEGER AS n_atoms, count(*) AS n_molecules FROM mol WHERE ok GROUP BY 1",
    "degree_histogram": f"WITH {ATOM} SELECT degree::INTEGER AS degree, count(*) AS n_vertices FROM atom GROUP BY 1",
    "graph_counters": f"WITH RECURSIVE {_KEPT} SELECT count(*) AS n_graphs, sum(n_atoms)::BIGINT AS n_vertices, (SELECT sum(len(bonds))::BIGINT FROM mol WHERE ok) AS n_edges, sum(n_kept)::BIGINT AS n_kept, sum(n_atoms - n_kept)::BIGINT AS n_on_paths FROM kept",
    "exact_structures": f"WITH {SHAPE}, {REC} SELECT rec_id, min(mol_id) AS first_mol_id, max(mol_id) AS last_mol_id FROM rshape JOIN shape ON rshape.shape = shape.shape GROUP BY rec_id",
    "structure_insert": f"WITH {SHAPE}, {REC} SELECT min(rec_id) AS rec_id FROM rshape WHERE shape NOT IN (SELECT shape FROM shape) GROUP BY shape",
    "substructure_full": f"{found(PATTERN)} SELECT DISTINCT mol_id FROM found",
    "substructure_quick": f"{found(PATTERN)} SELECT DISTINCT mol_id FROM found",
    "substructure_first": f"{found(PATTERN)} SELECT DISTINCT mol_id FROM found ORDER BY mol_id LIMIT 10",
    "substructure_induced": f"{found(PATTERN)} SELECT DISTINCT mol_id FROM found JOIN mol USING (mol_id) WHERE len(list_filter(bonds, lambda x: list_contains(map, x.a) AND list_contains(map, x.b))) = n_bonds",
    "substructure_joins": f"{found(SMALL)} SELECT DISTINCT mol_id FROM found",
    "substructure_batch": f"WITH RECURSIVE {_BATCH} SELECT DISTINCT query_id, mol_id FROM found",
    "path_fingerprints": f"{_PATHS} {_as_text(f'SELECT DISTINCT mol_id, {_bit(_ONE_WAY, 1024)} AS bit FROM (SELECT DISTINCT mol_id, code FROM path)')}",
    "pattern_fingerprints": f"WITH RECURSIVE {MOL}, {pattern_bits('mol', 'ends', 'mol_id', 'pb')} {_as_text('SELECT * FROM pb')}",
    "torsion_fingerprints": f"""WITH RECURSIVE {ATOM}, {paths(4)}, deg AS (SELECT mol_id, a, degree FROM atom), four AS (SELECT p.mol_id, [l[1].label, l[1].degree, l[2].label, l[2].degree, l[3].label, l[3].degree, l[4].label, l[4].degree] AS f, [l[4].label, l[4].degree, l[3].label, l[3].degree, l[2].label, l[2].degree, l[1].label, l[1].degree] AS r
        FROM (SELECT p.mol_id, p.map, list({{'label': atom.label, 'degree': atom.degree}} ORDER BY list_position(p.map, atom.a)) AS l FROM path p JOIN atom ON atom.mol_id = p.mol_id AND list_contains(p.map, atom.a) WHERE len(p.map) = 4 GROUP BY ALL) p)
        {_as_text(f"SELECT DISTINCT mol_id, {_bit('least(f, r)', 1024)} AS bit FROM four")}""",
    "atom_pair_fingerprints": f"""WITH RECURSIVE {ATOM}, near AS (SELECT mol_id, a, list(DISTINCT b) AS bs FROM ends GROUP BY ALL), adj AS MATERIALIZED (SELECT mol_id, list(coalesce(bs, []) ORDER BY atom.a) AS bs FROM atom LEFT JOIN near USING (mol_id, a) GROUP BY mol_id),
        far AS (SELECT mol_id, a, [a] AS seen, [a] AS front, 0 AS dist FROM atom UNION ALL SELECT mol_id, a, seen || ahead, ahead, dist + 1 FROM (
            SELECT far.*, list_filter(list_distinct(flatten([bs[x + 1] for x in front])), lambda x: NOT list_contains(seen, x)) AS ahead FROM far JOIN adj USING (mol_id)) WHERE len(ahead) > 0),
        met AS (SELECT mol_id, a, unnest(front) AS b, dist FROM far), two AS (SELECT m.mol_id, [x.label, x.degree] AS x, [y.label, y.degree] AS y, dist FROM met m JOIN atom x ON x.mol_id = m.mol_id AND x.a = m.a JOIN atom y ON y.mol_id = m.mol_id AND y.a = m.b WHERE m.a < m.b)
        {_as_text(f"SELECT DISTINCT mol_id, {_bit('(least(x, y) || greatest(x, y) || [dist])', 1024)} AS bit FROM two")}""",
    "layered_fingerprints": f"""{_PATHS}, c AS (SELECT DISTINCT mol_id, code FROM path), layers AS (SELECT mol_id, [1, (len(code) + 1) // 2] AS l FROM c UNION SELECT mol_id, [2] || least({_BONDS}, list_reverse({_BONDS})) FROM c UNION SELECT mol_id, [3] || {_ONE_WAY} FROM c)
        {_as_text(f"SELECT DISTINCT mol_id, {_bit('l', 2048)} AS bit FROM layers")}""",
    "topological_fingerprints": f"""WITH RECURSIVE {ATOM}, {paths(7, _PLAIN)}, c AS (SELECT DISTINCT mol_id, {_ONE_WAY} AS code FROM path WHERE len(map) > 1), salted AS (SELECT mol_id, [4] || code AS l FROM c UNION SELECT mol_id, [5] || code FROM c)
        {_as_text(f"SELECT DISTINCT mol_id, {_bit('l', 2048)} AS bit FROM salted")}""",
    "screen_efficiency": f"""WITH RECURSIVE {_BATCH}, {_BITS}, need AS (SELECT query_id, count(bit) AS n FROM (SELECT query_id FROM qm WHERE ok) LEFT JOIN qb USING (query_id) GROUP BY ALL),
        screened AS (SELECT query_id, mol_id FROM qb JOIN pb USING (bit) JOIN need USING (query_id) GROUP BY query_id, mol_id, n HAVING count(*) = n UNION ALL SELECT query_id, mol_id FROM need, mol WHERE n = 0 AND ok),
        verified AS (SELECT DISTINCT query_id, mol_id, 1 AS one FROM found)
        SELECT query_id, count(*) AS n_screened, count(one) AS n_verified, 1 - count(one) / count(*) AS false_share FROM screened LEFT JOIN verified USING (query_id, mol_id) GROUP BY query_id""",
    "service_answers": f"""WITH RECURSIVE {Q.parsed(_SETS, 'query_id', 'qm')}, {Q.directed('qm', 'query_id', 'qends')}, {pattern_bits('qm', 'qends', 'query_id', 'qb')}, own AS (SELECT query_id, list(bit) AS bits FROM qb GROUP BY ALL)
        SELECT 'FINGERPRINT Pattern ' || smiles AS value, CASE WHEN smiles IS NULL THEN NULL WHEN NOT coalesce(ok, false) THEN 'ERROR Could not read smiles'
            ELSE 'FINGERPRINT ' || array_to_string([CASE WHEN list_contains(coalesce(bits, []), {len(PATTERNS) - 1} - i) THEN '1' ELSE '0' END for i in range({len(PATTERNS)})], '') END AS answer FROM query_sets LEFT JOIN qm USING (query_id) LEFT JOIN own USING (query_id)""",
    "aromatic_writings": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(s).lower()})" for i, (_, _, s) in enumerate(_WRITINGS)) + ") v(pair, same)",
}
