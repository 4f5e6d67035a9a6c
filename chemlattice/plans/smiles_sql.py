"""SQL counterparts of reading molecules: a SMILES reader, components and colours as plain DuckDB SQL.

``parsed`` reads each text by a fold over its tokens, without any code of the engine, so queries over molecules can be
compared with it. ``colours`` refines vertex colours by hashing, with the multiset of neighbours; molecules with one
labelled graph get one hash, and so do those few that refinement alone can't tell apart.
"""

from __future__ import annotations

from chemlattice.functions.smiles import ELEMENTS

_SYMBOLS = "[" + ", ".join(f"'{e}'" for e in ELEMENTS) + "]"
_TOKENS = r"(?s)\[[^\[\]]*\]|Cl|Br|[BCNOPSFIbcnops]|%[0-9]{2}|[0-9]|[-=#$:/\\]|[().]|."
_BRACKET = r"^\[([0-9]*)([A-Z][a-z]?|[a-z]{1,2})(?:@(?:@|TH[12]|AL[12]|SP[1-3]|TB[0-9]{1,2}|OH[0-9]{1,2})?)?(H[0-9]*)?(\++[0-9]*|-+[0-9]*)?(?::[0-9]+)?\]$"
_CHARGE = r"^(\++|-+|\+[0-9]+|-[0-9]+)?$"

KEY = "nullif(split_part(split_part(smiles, ' ', 1), chr(9), 1), '')"

_START = (
    "{'n': 0, 'last': -1, 'pend': -1, 'opened': false, 'ok': true, 'stack': CAST([] AS INTEGER[]), "
    "'rings': CAST([] AS STRUCT(num INTEGER, atom INTEGER, kind INTEGER)[]), 'aro': CAST([] AS BOOLEAN[]), 'bonds': CAST([] AS STRUCT(a INTEGER, b INTEGER, k INTEGER)[])}"
)


def _next(**changes: str) -> str:
    names = ("n", "last", "pend", "opened", "ok", "stack", "rings", "aro", "bonds")
    return "{" + ", ".join(f"'{x}': {changes.get(x, 's.' + x)}" for x in names) + "}"


_KIND = "CASE WHEN s.pend >= 0 THEN s.pend WHEN t.aro AND s.aro[s.last + 1] THEN 200 ELSE 0 END"
_OPEN = "list_filter(s.rings, lambda r: r.num = t.ring)[1]"
_RING_KIND = f"CASE WHEN s.pend >= 0 THEN s.pend WHEN {_OPEN}.kind >= 0 THEN {_OPEN}.kind WHEN s.aro[s.last + 1] AND s.aro[{_OPEN}.atom + 1] THEN 200 ELSE 0 END"
_STEP = f"""CASE
    WHEN NOT s.ok THEN s
    WHEN t.kind = 'atom' AND t.z IS NOT NULL AND (s.last >= 0 OR s.pend < 0) THEN {_next(n="s.n + 1", last="s.n", pend="-1", opened="false", aro="list_append(s.aro, t.aro)", bonds="CASE WHEN s.last >= 0 THEN list_append(s.bonds, {'a': s.last, 'b': s.n, 'k': " + _KIND + "}) ELSE s.bonds END")}
    WHEN t.kind = 'ring' AND s.last >= 0 AND NOT s.opened AND {_OPEN} IS NULL THEN {_next(pend="-1", rings="list_append(s.rings, {'num': t.ring, 'atom': s.last, 'kind': s.pend})")}
    WHEN t.kind = 'ring' AND s.last >= 0 AND NOT s.opened AND {_OPEN}.atom <> s.last THEN {_next(pend="-1", rings="list_filter(s.rings, lambda r: r.num <> t.ring)", bonds="list_append(s.bonds, {'a': " + _OPEN + ".atom, 'b': s.last, 'k': " + _RING_KIND + "})")}
    WHEN t.kind = 'bond' AND s.last >= 0 AND s.pend < 0 THEN {_next(pend="t.bond", opened="false")}
    WHEN t.kind = '(' AND s.last >= 0 AND s.pend < 0 THEN {_next(stack="list_append(s.stack, s.last)", opened="true")}
    WHEN t.kind = ')' AND len(s.stack) > 0 AND s.pend < 0 AND NOT s.opened THEN {_next(last="s.stack[-1]", stack="s.stack[:-2]")}
    WHEN t.kind = '.' AND s.last >= 0 AND s.pend < 0 AND NOT s.opened THEN {_next(last="-1")}
    ELSE {_next(ok="false")} END"""


def parsed(source: str, key: str, name: str = "mol") -> str:
    """CTEs, the last of them ``name`` with ``key, ok, z, aro, h, q, iso, labels, bonds`` for each row of ``source`` (``key, smiles``).

    ``ok`` says whether the text can be read; atoms are numbered from 0 in text order. Atoms of ``bonds`` are numbers, too.
    """
    return f"""
    {name}_tokens AS (SELECT {key}, list_transform(regexp_extract_all({KEY}, '{_TOKENS}'), lambda x: {{
        'kind': CASE WHEN regexp_full_match(x, '\\[[^\\[\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]') THEN 'atom' WHEN regexp_full_match(x, '%?[0-9]+') THEN 'ring' WHEN regexp_full_match(x, '[-=#$:/\\\\]') THEN 'bond' WHEN x IN ('(', ')', '.') THEN x ELSE '?' END,
        'sym': CASE WHEN x[1] <> '[' THEN x WHEN regexp_full_match(x, '{_BRACKET}') AND regexp_full_match(regexp_extract(x, '{_BRACKET}', 4), '{_CHARGE}') THEN regexp_extract(x, '{_BRACKET}', 2) END,
        'h': CASE WHEN x[1] <> '[' THEN -1 WHEN regexp_extract(x, '{_BRACKET}', 3) = '' THEN 0 ELSE coalesce(try_cast(nullif(substr(regexp_extract(x, '{_BRACKET}', 3), 2), '') AS INTEGER), 1) END,
        'iso': coalesce(try_cast(nullif(regexp_extract(x, '{_BRACKET}', 1), '') AS INTEGER), 0),
        'charge': CASE WHEN x[1] = '[' THEN regexp_extract(x, '{_BRACKET}', 4) ELSE '' END,
        'ring': try_cast(ltrim(x, '%') AS INTEGER), 'bond': CASE x WHEN '=' THEN 201 WHEN '#' THEN 202 WHEN '$' THEN 203 WHEN ':' THEN 200 ELSE 0 END}}) AS raw
        FROM ({source}) WHERE {KEY} IS NOT NULL),
    {name}_typed AS (SELECT {key}, list_transform(raw, lambda x: {{'kind': x.kind, 'ring': x.ring, 'bond': x.bond, 'h': x.h, 'iso': x.iso, 'aro': x.sym IN ('b', 'c', 'n', 'o', 'p', 's'),
        'z': CASE WHEN x.sym IN ('b', 'c', 'n', 'o', 'p', 's') THEN list_position({_SYMBOLS}, upper(x.sym)) ELSE nullif(list_position({_SYMBOLS}, x.sym), 0) END,
        'q': CASE WHEN x.charge = '' THEN 0 ELSE (CASE WHEN x.charge[1] = '+' THEN 1 ELSE -1 END) * coalesce(try_cast(substr(x.charge, 2) AS INTEGER), len(x.charge)) END}}) AS toks FROM {name}_tokens),
    {name}_read AS MATERIALIZED (SELECT {key}, list_filter(toks, lambda x: x.kind = '.') AS dots, list_filter(toks, lambda x: x.kind = 'atom') AS atoms, list_reduce(toks, lambda s, t: {_STEP}, {_START}) AS s FROM {name}_typed),
    {name} AS MATERIALIZED (SELECT {key}, len(dots) > 0 AS dotted, s.ok AND len(s.stack) = 0 AND len(s.rings) = 0 AND s.pend < 0 AND s.last >= 0 AS ok, [x.z for x in atoms] AS z, [x.aro for x in atoms] AS aro, [x.h for x in atoms] AS h,
        [x.q for x in atoms] AS q, [x.iso for x in atoms] AS iso, [CASE WHEN x.aro THEN CASE x.z WHEN 6 THEN 128 WHEN 7 THEN 129 WHEN 8 THEN 130 WHEN 15 THEN 131 WHEN 16 THEN 132 ELSE x.z END ELSE x.z END for x in atoms] AS labels, s.bonds AS bonds FROM {name}_read)"""


def directed(mol: str, key: str, name: str = "ends") -> str:
    """CTE of ``key, a, b, k``: each bond of the readable molecules from both sides, parallel ones as often as they stand."""
    return f"""
    {name}_one AS (SELECT {key}, unnest(bonds) AS x FROM {mol} WHERE ok),
    {name} AS MATERIALIZED (SELECT {key}, x.a AS a, x.b AS b, x.k AS k FROM {name}_one UNION ALL SELECT {key}, x.b, x.a, x.k FROM {name}_one)"""


def atoms(mol: str, ends: str, key: str, name: str = "atom") -> str:
    """CTE of ``key, a, z, label, degree, h, q, iso``: each atom of the readable molecules; ``h`` counts hydrogens written or implied."""
    return f"""
    {name}_one AS (SELECT {key}, unnest(range(len(z)))::INTEGER AS a, unnest(z) AS z, unnest(aro) AS aro, unnest(h) AS h, unnest(q) AS q, unnest(iso) AS iso, unnest(labels) AS label FROM {mol} WHERE ok),
    {name}_used AS (SELECT {key}, a, count(*) AS degree, sum(CASE k WHEN 201 THEN 2 WHEN 202 THEN 3 WHEN 203 THEN 4 ELSE 1 END) AS used FROM {ends} GROUP BY ALL),
    {name}_bound AS (SELECT {key}, a, z, aro, h, q, iso, label, coalesce(degree, 0) AS degree, coalesce(used, 0) + CASE WHEN aro THEN 1 ELSE 0 END AS used FROM {name}_one LEFT JOIN {name}_used USING ({key}, a)),
    {name} AS MATERIALIZED (SELECT {key}, a, z, label, degree, q, iso, CASE WHEN h >= 0 THEN h WHEN aro AND z NOT IN (5, 6) THEN greatest(usual[1] - used, 0) ELSE coalesce(list_filter(usual, lambda v: v >= used)[1] - used, 0) END::INTEGER AS h
        FROM (SELECT *, CASE z WHEN 5 THEN [3] WHEN 6 THEN [4] WHEN 7 THEN [3, 5] WHEN 8 THEN [2] WHEN 15 THEN [3, 5] WHEN 16 THEN [2, 4, 6] WHEN 9 THEN [1] WHEN 17 THEN [1] WHEN 35 THEN [1] WHEN 53 THEN [1] ELSE [0] END AS usual FROM {name}_bound))"""


def colours(atom: str, ends: str, key: str, start: str, kind: str, name: str = "shape", rounds: int = 16) -> str:
    """CTE ``name`` of ``key, shape``: a hash of the multiset of refined vertex colours. ``start`` and ``kind`` are the labels of atoms and bonds."""
    out = [f"{name}_0 AS (SELECT {key}, a, hash({start}) AS c FROM {atom})"]
    for i in range(rounds):
        out.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT x.{key}, x.a, hash(any_value(x.c), list_sort(coalesce(list(hash(y.c, {kind})) FILTER (WHERE y.c IS NOT NULL), []))) AS c "
            f"FROM {name}_{i} x LEFT JOIN {ends} e ON e.{key} = x.{key} AND e.a = x.a LEFT JOIN {name}_{i} y ON y.{key} = e.{key} AND y.a = e.b GROUP BY x.{key}, x.a)"
        )
    out.append(f"{name} AS (SELECT {key}, hash(list_sort(list(c))) AS shape FROM {name}_{rounds} GROUP BY {key})")
    return ", ".join(out)


def components(mol: str, ends: str, key: str, name: str = "part") -> str:
    """CTE ``name`` of ``key, a, root``: the least atom that each atom is joined to; only texts with a dot can have several."""
    return f"""
    {name}_dots AS (SELECT DISTINCT {key} FROM {mol} WHERE ok AND dotted),
    {name}_reach AS (SELECT {key}, unnest(range(len(z)))::INTEGER AS a, unnest(range(len(z)))::INTEGER AS b FROM {mol} WHERE {key} IN (SELECT {key} FROM {name}_dots)
        UNION SELECT r.{key}, r.a, e.b FROM {name}_reach r JOIN {ends} e ON e.{key} = r.{key} AND e.a = r.b),
    {name} AS (SELECT {key}, a, min(b) AS root FROM {name}_reach GROUP BY ALL
        UNION ALL SELECT {key}, unnest(range(len(z)))::INTEGER, 0 FROM {mol} WHERE ok AND {key} NOT IN (SELECT {key} FROM {name}_dots))"""


def matches(queries: str, mol: str, ends: str, query_id: str, key: str, name: str = "found") -> str:
    """CTEs, the last of them ``name`` with ``query_id, key, map, n_bonds``: each way in which a query of the CTE ``queries`` lies in a molecule.

    ``queries`` and ``mol`` come from ``parsed``. The atoms of a query are placed in text order, each beside an earlier one.
    Only molecules that have each kind of bond of the query are tried.
    """
    feats = "[(least(labels[x.a + 1], labels[x.b + 1]) * 1000 + greatest(labels[x.a + 1], labels[x.b + 1])) * 1000 + x.k for x in bonds]"
    return f"""
    {name}_q AS MATERIALIZED (SELECT {query_id}, i, labels[i + 1] AS label, list_filter(bonds, lambda x: greatest(x.a, x.b) = i) AS back, len(labels) AS n, len(bonds) AS n_bonds, {feats} AS feats
        FROM (SELECT *, unnest(range(len(labels))) AS i FROM {queries} WHERE ok)),
    {name}_step AS MATERIALIZED (SELECT {query_id}, i, label, least(back[1].a, back[1].b) AS parent, back[1].k AS k, [{{'j': least(x.a, x.b), 'k': x.k}} for x in back[2:]] AS rest FROM {name}_q),
    {name}_mol AS MATERIALIZED (SELECT {key}, labels, list_concat([(x.a * 1000 + x.b) * 1000 + x.k for x in bonds], [(x.b * 1000 + x.a) * 1000 + x.k for x in bonds]) AS keys, {feats} AS feats FROM {mol} WHERE ok),
    {name}_map AS (SELECT q.{query_id}, m.{key}, [a] AS map FROM {name}_q q, (SELECT {key}, feats, unnest(range(len(labels)))::INTEGER AS a, unnest(labels) AS label FROM {name}_mol) m WHERE q.i = 0 AND q.label = m.label AND list_has_all(m.feats, q.feats)
        UNION ALL SELECT p.{query_id}, p.{key}, list_append(p.map, e.b) FROM {name}_map p JOIN {name}_step s ON s.{query_id} = p.{query_id} AND s.i = len(p.map)
        JOIN {name}_mol m ON m.{key} = p.{key} JOIN {ends} e ON e.{key} = p.{key} AND e.a = p.map[s.parent + 1] AND e.k = s.k
        WHERE m.labels[e.b + 1] = s.label AND NOT list_contains(p.map, e.b) AND list_has_all(m.keys, [(p.map[x.j + 1] * 1000 + e.b) * 1000 + x.k for x in s.rest])),
    {name} AS (SELECT p.{query_id}, p.{key}, p.map, n.n_bonds FROM {name}_map p JOIN (SELECT DISTINCT {query_id}, n, n_bonds FROM {name}_q) n ON n.{query_id} = p.{query_id} AND n.n = len(p.map))"""
