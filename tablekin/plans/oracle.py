"""The queries of this package as SQL for DuckDB, written from their definitions and not from their code."""

from __future__ import annotations

from .fixtures import IDS, ORG, select
from .queries import FILE_COLUMNS, NOTE, TYPING

#: Columns of the test tables by type: i integer, d double, t time, s text.
SCHEMA = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}


def _profile(table: str) -> str:
    parts = []
    for k, spec in enumerate(SCHEMA[table].split()):
        name, kind = spec.split(":")
        v = f"nullif({name}, '')" if kind == "s" else name
        label = {"i": "'int'", "t": "'datetime'", "s": "'string'", "d": f"CASE WHEN bool_and({name} = floor({name})) THEN 'int' WHEN bool_or({name} IS NOT NULL) THEN 'float' END"}[kind]
        longest = f"coalesce(max(length({v})), -1)" if kind == "s" else "-1"
        parts.append(
            f"SELECT '{table}' AS node, {k}::BIGINT AS col_index, '{name}' AS column_name, CASE WHEN count({v}) = 0 THEN 'empty' ELSE {label} END AS type, count(*) AS row_count, "
            f"count(*) - count({v}) AS nulls, count(DISTINCT {v}) AS distinct_count, {longest}::BIGINT AS max_length, count(DISTINCT {v}) = count({v}) AND count({v}) > 0 AS is_unique FROM {table}"
        )
    return " UNION ALL ".join(parts)


#: Names that SQL keeps for itself.
_SQL_NAME = {"User": "Users", "Case": "Cases"}
_ORG = "WITH " + ", ".join(f"{_SQL_NAME.get(n, n)} AS ({select(n, table)})" for n, (_, table) in ORG.items())
_VC = _ORG + ", ids AS (" + " UNION ALL ".join(f"SELECT '{n}' AS node, '{c}' AS col, {c} AS value FROM {_SQL_NAME.get(n, n)}" for n, cs in IDS.items() for c in cs) + """),
vc AS (SELECT node, col, value, count(*) AS n FROM ids WHERE value IS NOT NULL GROUP BY ALL),
col AS (SELECT node, col, count(*) AS all_rows, count(value) AS filled, count(DISTINCT value) AS d FROM ids GROUP BY ALL),
tok AS (SELECT node, col, left(value, 3) AS token, sum(n) AS rows FROM vc WHERE length(value) IN (15, 18) GROUP BY ALL),
keytok AS (SELECT node, token FROM tok WHERE col = 'Id' QUALIFY row_number() OVER (PARTITION BY node ORDER BY rows DESC, token) = 1),
shared AS (SELECT tok.* FROM tok JOIN col USING (node, col) WHERE rows >= 0.01 * filled AND col <> 'Id'),
bytoken AS (SELECT s.node, s.col, k.node AS target, s.token FROM shared s JOIN keytok k USING (token)),
byname AS (SELECT * FROM (VALUES ('Asset', 'Product2Id', 'Product2'), ('Case', 'AssetId', 'Asset'), ('Case', 'OwnerId', 'User'), ('Visit__c', 'Site__c', 'Site__c')) AS t(node, col, target)),
cand AS (SELECT node, col, target, max(token) AS token, bool_or(named) AS named FROM (SELECT *, FALSE AS named FROM bytoken UNION ALL SELECT node, col, target, NULL, TRUE FROM byname) GROUP BY ALL),
poly AS (SELECT node, col FROM shared GROUP BY ALL HAVING count(*) > 1),
res AS (SELECT c.node, c.col, c.target, c.token, c.named, sum(v.n)::BIGINT AS total, sum(CASE WHEN k.value IS NOT NULL THEN v.n ELSE 0 END)::BIGINT AS matched
  FROM cand c JOIN vc v ON v.node = c.node AND v.col = c.col AND (c.token IS NULL OR starts_with(v.value, c.token))
  LEFT JOIN vc k ON k.node = c.target AND k.col = 'Id' AND k.value = v.value GROUP BY ALL),
edges AS (SELECT r.node AS from_node, r.col AS from_column, r.target AS to_node, 'Id' AS to_column, CASE WHEN r.node = r.target THEN 'self' ELSE 'lookup' END AS kind,
  CASE WHEN d = filled THEN '1:1' ELSE 'N:1' END AS cardinality,
  round(least(0.70 * matched / total + 0.20 * (r.token IS NOT NULL)::INT + 0.05 * named::INT + 0.05, 0.99), 3) AS confidence,
  floor((2 * matched * 10000 + total) / (2 * total)) / 10000 AS resolve_rate, matched / total >= 0.9 AS verified,
  floor((2 * (all_rows - filled) * 10000 + all_rows) / (2 * all_rows)) / 10000 AS null_pct, CASE WHEN poly.node IS NOT NULL THEN r.node || '.' || r.col END AS polymorphic_group, matched, total,
  concat_ws('; ', CASE WHEN r.token IS NOT NULL THEN 'key prefix ' || r.token || ' matches ' || r.target || '.Id' END, CASE WHEN named THEN 'column name implies ' || r.target END,
    format('{:,}', matched) || '/' || format('{:,}', total) || ' references resolve (' || printf('%.1f', 100.0 * matched / total) || '%)', CASE WHEN poly.node IS NOT NULL THEN 'column references more than one object' END) AS evidence
  FROM res r JOIN col ON col.node = r.node AND col.col = r.col LEFT JOIN poly ON poly.node = r.node AND poly.col = r.col)
"""
_OVERLAP = _VC + """, covers AS (SELECT v.node, v.col, k.node AS target, sum(v.n)::BIGINT AS matched, any_value(filled)::BIGINT AS total, any_value(all_rows) AS all_rows, any_value(d) AS d
  FROM vc v JOIN vc k ON k.col = 'Id' AND k.value = v.value JOIN col ON col.node = v.node AND col.col = v.col WHERE v.col <> 'Id' GROUP BY ALL)
"""
_GENERIC = _OVERLAP + """, c AS (SELECT *, (col, target) IN (('Product2Id', 'Product2'), ('AssetId', 'Asset')) AS named FROM covers WHERE CASE col WHEN 'Product2Id' THEN target = 'Product2' WHEN 'AssetId' THEN target = 'Asset' ELSE matched >= 0.8 * total END)
SELECT node AS from_node, col AS from_column, target AS to_node, 'Id' AS to_column, CASE WHEN node = target THEN 'self' ELSE 'lookup' END AS kind, CASE WHEN d = total THEN '1:1' ELSE 'N:1' END AS cardinality,
  round(0.70 * matched / total + 0.05 * named::INT + 0.05 * (NOT contains(col, '__c'))::INT, 3) AS confidence, floor((2 * matched * 10000 + total) / (2 * total)) / 10000 AS resolve_rate, matched / total >= 0.9 AS verified,
  floor((2 * (all_rows - total) * 10000 + all_rows) / (2 * all_rows)) / 10000 AS null_pct, NULL::VARCHAR AS polymorphic_group, matched, total,
  concat_ws('; ', CASE WHEN named THEN 'column name implies ' || target ELSE 'matched by value overlap only, not by name or prefix' END, format('{:,}', matched) || '/' || format('{:,}', total) || ' references resolve (' || printf('%.1f', 100.0 * matched / total) || '%)') AS evidence
FROM c"""
_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS node, count(*) AS row_count FROM {t}" for t in (*SCHEMA, "embeddings"))


def _resolve(source: str, column: str, target: str, tokens: tuple[str, ...], prelude: str = _ORG, key: str = "Id") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS token, sum(CASE WHEN k.{key} IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) AS total FROM {source} s LEFT JOIN (SELECT DISTINCT {key} FROM {target}) k ON s.{column} = k.{key} "
        f"WHERE s.{column} IS NOT NULL{f' AND starts_with(s.{column}, {t!r})' if t else ''}"
        for t in tokens
    )
    return f"{prelude} SELECT token, coalesce(matched, 0) AS matched, total, CASE WHEN total > 0 THEN floor((2 * matched * 10000 + total) / (2 * total)) / 10000 ELSE 0.0 END AS rate FROM ({rows})"


def _star_edges() -> str:
    pairs = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]
    one = [f"SELECT '{a}' AS from_node, '{c}' AS from_column, '{b}' AS to_node, '{k}' AS to_column, count(s.{c}) AS total, count(t.{k}) AS matched, count(*) AS all_rows, count(DISTINCT s.{c}) AS d FROM {a} s LEFT JOIN {b} t ON s.{c} = t.{k}" for a, c, b, k in pairs]
    return f"""SELECT from_node, from_column, to_node, to_column, 'lookup' AS kind, CASE WHEN d = total THEN '1:1' ELSE 'N:1' END AS cardinality, round(0.70 * matched / total + 0.1, 3) AS confidence,
  floor((2 * matched * 10000 + total) / (2 * total)) / 10000 AS resolve_rate, matched / total >= 0.9 AS verified, floor((2 * (all_rows - total) * 10000 + all_rows) / (2 * all_rows)) / 10000 AS null_pct,
  NULL::VARCHAR AS polymorphic_group, matched, total, 'column name implies ' || to_node || '; ' || format('{{:,}}', matched) || '/' || format('{{:,}}', total) || ' references resolve (' || printf('%.1f', 100.0 * matched / total) || '%)' AS evidence
  FROM ({" UNION ALL ".join(one)})"""


#: The keys of the warehouse tables; the others have none.
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}
_ALL = sorted([*SCHEMA, "embeddings"])


def _mermaid() -> str:
    """Lines by place: tables by name with their key and references in column order, then the edges by falling confidence."""
    refs = {("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("labels", "doc_id")}
    body = ["erDiagram"]
    for t in _ALL:
        names = [x.split(":")[0] for x in SCHEMA.get(t, "").split()]
        shown = [f"    int {c} {'PK' if _KEYS.get(t) == c else 'FK'}" for c in names if _KEYS.get(t) == c or (t, c) in refs]
        body += [f"  {t} {{", *shown, "  }"]
    fixed = ", ".join(f"({k}, {line!r})" for k, line in enumerate(body))
    edges = f"SELECT {len(body)} + row_number() OVER (ORDER BY confidence DESC, from_node, from_column, to_node) - 1 AS line_no, '  ' || to_node || CASE WHEN null_pct < 0.001 THEN ' ||--' ELSE ' |o--' END || CASE cardinality WHEN '1:1' THEN '|| ' ELSE 'o{{ ' END || from_node || ' : \"' || from_column || '\"' AS line FROM ({_star_edges()})"
    return f"SELECT * FROM (VALUES {fixed}) AS f(line_no, line) UNION ALL {edges}"


def _dot() -> str:
    head = ["digraph dependencies {", "  graph [rankdir=LR, nodesep=0.4];", "  node [shape=plain, fontname=monospace];", "  edge [arrowhead=vee, color=gray40];"]
    fixed = ", ".join(f"({k}, {line!r})" for k, line in enumerate(head))
    keys = " ".join(f"WHEN '{t}' THEN ' by {c}'" for t, c in _KEYS.items())
    nodes = f"SELECT {len(head)} + row_number() OVER (ORDER BY node) - 1, '  ' || node || ' [label=\"' || node || ': ' || format('{{:,}}', row_count) || ' rows' || CASE node {keys} ELSE '' END || '\"];' FROM ({_SIZES})"
    at = len(head) + len(_ALL)
    edges = f"SELECT {at} + row_number() OVER (ORDER BY confidence DESC, from_node, from_column, to_node) - 1, '  ' || from_node || ' -> ' || to_node || ' [label=\"' || from_column || ' (' || printf('%.2f', confidence) || ')\", style=solid];' FROM ({_star_edges()})"
    return f"SELECT * FROM (VALUES {fixed}) AS f(line_no, line) UNION ALL {nodes} UNION ALL {edges} UNION ALL SELECT {at} + (SELECT count(*) FROM ({_star_edges()})), '}}'"


_ASSET = list(ORG["Asset"][0])
_SAMPLE = f""", s AS (SELECT * FROM Asset ORDER BY Id LIMIT 500), u AS (SELECT unnest({_ASSET}) AS column_name, unnest([{', '.join(_ASSET)}]) AS v FROM s),
""" + """m AS (SELECT column_name, avg(regexp_full_match(v, '[A-Za-z0-9_\\-]{6,64}')::INT) AS g, avg(regexp_full_match(v, '[A-Za-z0-9]{15}|[A-Za-z0-9]{18}')::INT) AS r,
  avg(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')::INT) AS date_share, avg(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?')::INT) AS time_share
  FROM u WHERE v IS NOT NULL AND v <> '' GROUP BY 1)
SELECT 'generic' AS profile, column_name, g AS id_share, date_share, time_share, g >= 0.95 AS is_id FROM m UNION ALL SELECT 'salesforce', column_name, r, date_share, time_share, r >= 0.9 FROM m"""

_MEMBERS = """(VALUES ('asset', 'one.zip!Asset.csv', 10, 1), ('visit__c', 'one.zip!x/Visit__c.xlsx', 20, 2), ('asset', 'two.zip!Asset.csv', 12, 3), ('visit__c', 'two.zip!Visit__c.XLSX', 20, 2), ('visit__c', 'zip3.zip!visit__c.xlsx', 20, 2), ('case', 'Case.tsv', 5, NULL), ('case', 'd/Case.tsv', 5, NULL)) AS m(object_key, label, size, crc)"""


def _typing() -> str:
    names = ("whole", "fraction", "flag", "mixture", "spaced", "words", "nothing")
    rows = " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS c, nullif({n}, '') AS v FROM t" for k, n in enumerate(names))
    return f"""WITH t AS ({TYPING} nation), u AS ({rows}),
p AS (SELECT k, c, v, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN 'float' WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN v IS NOT NULL THEN 'text' END AS kind FROM u),
y AS (SELECT k, CASE WHEN count(kind) = 0 THEN 'empty' WHEN bool_and(kind = 'bool') THEN 'bool' WHEN bool_and(kind = 'int') THEN 'int' WHEN bool_and(kind IN ('int', 'float')) THEN 'float' ELSE 'string' END AS type FROM p GROUP BY k),
z AS (SELECT p.k, c, v, type, CASE type WHEN 'string' THEN v WHEN 'bool' THEN lower(v) WHEN 'int' THEN try_cast(v AS BIGINT)::VARCHAR WHEN 'float' THEN try_cast(v AS DOUBLE)::VARCHAR END AS x FROM p JOIN y USING (k))
SELECT 'typing' AS node, k::BIGINT AS col_index, c AS column_name, type, count(*) AS row_count, count(*) - count(v) AS nulls, count(DISTINCT x) AS distinct_count, (CASE WHEN type = 'string' THEN max(length(v)) ELSE -1 END)::BIGINT AS max_length, count(DISTINCT x) = count(v) AND count(v) > 0 AS is_unique
FROM z GROUP BY k, c, type"""


def _embeddings() -> str:
    """Without lengths: the two engines write the same vector in texts of different length."""
    types = {"vec_id": "int", "embedding": "string", "label": "int"}
    parts = [f"SELECT 'embeddings' AS node, {k}::BIGINT AS col_index, '{c}' AS column_name, '{t}' AS type, count(*) AS row_count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) = count({c}) AS is_unique FROM embeddings" for k, (c, t) in enumerate(types.items())]
    return " UNION ALL ".join(parts)


def _file() -> str:
    """The profile of orders as a file: empty texts are nulls there, and whole prices don't make a column of floats whole."""
    parts = []
    for k, (name, kind) in enumerate(FILE_COLUMNS.items()):
        v = f"nullif({name}, '')" if kind == "string" else name
        longest = f"max(length({v}))" if kind == "string" else "-1"
        parts.append(f"SELECT 'Orders' AS node, {k}::BIGINT AS col_index, '{name}' AS column_name, '{kind}' AS type, count(*) AS row_count, count(*) - count({v}) AS nulls, count(DISTINCT {v}) AS distinct_count, {longest}::BIGINT AS max_length, count(DISTINCT {v}) = count({v}) AS is_unique FROM f")
    return f"WITH f AS (SELECT *, {NOTE} AS note FROM orders) " + " UNION ALL ".join(parts)


def _merged() -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS c, nullif({n}, '') AS v FROM parts" for k, n in enumerate(_ASSET))
    return f"""{_ORG}, parts AS (SELECT * FROM Asset WHERE Id < '02iA00000000100' UNION ALL BY NAME SELECT * EXCLUDE (InstallDate) FROM Asset WHERE Id >= '02iA00000000100'), u AS ({rows})
SELECT 'Asset' AS node, k::BIGINT AS col_index, c AS column_name, CASE c WHEN 'SerialNumber' THEN 'string' WHEN 'InstallDate' THEN 'datetime' ELSE 'id' END AS type, count(*) AS row_count, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_count,
  coalesce(max(length(v)), -1)::BIGINT AS max_length, count(DISTINCT v) = count(v) AND count(v) > 0 AS is_unique FROM u GROUP BY k, c"""


def oracle_sql() -> dict[str, str]:
    out = {f"column_profile_{t}": _profile(t) for t in SCHEMA}
    out |= {
        "csv_typing": _typing(),
        "csv_file": _file(),
        "csv_file_in_chunks": _file(),
        "column_profile_embeddings": _embeddings(),
        "value_counts_asset_id": f"{_ORG} SELECT AssetId AS value, count(*) AS n FROM Cases WHERE AssetId IS NOT NULL GROUP BY 1",
        "id_tokens_visit": f"{_VC} SELECT CASE col WHEN 'RecordId__c' THEN 0 ELSE 1 END AS col, token, rows::BIGINT AS row_count, row_number() OVER (PARTITION BY col ORDER BY rows DESC, token) AS rank, rows / sum(rows) OVER (PARTITION BY col) AS share FROM tok WHERE node = 'Visit__c' AND col IN ('RecordId__c', 'Campaign__c')",
        "looks_like_id": _ORG + _SAMPLE,
        "resolve_asset_product": _resolve("Asset", "Product2Id", "Product2", ("",)),
        "resolve_case_asset": _resolve("Cases", "AssetId", "Asset", ("", "02i")),
        "resolve_visit_record_by_token": _resolve("Visit__c", "RecordId__c", "Asset", ("", "02i", "500")),
        "resolve_lineitem_part": _resolve("lineitem", "l_partkey", "part", ("",), "", "p_partkey"),
        "overlap_probe": _OVERLAP + "SELECT node AS from_node, col AS from_column, target AS to_node FROM covers WHERE matched >= 0.8 * total",
        "edges_generic": _GENERIC,
        "mermaid_lines": _mermaid(),
        "dot_lines": _dot(),
        "candidates_token": f"{_VC} SELECT node AS from_node, col AS from_column, target AS to_node, token FROM bytoken",
        "candidates_name": f"{_VC} SELECT node AS from_node, col AS from_column, target AS to_node FROM byname",
        "edges_sf": f"{_VC} SELECT * FROM edges",
        "edges_star": _star_edges(),
        "unresolved_sf": f"{_VC} SELECT node, col AS column_name, token, rows::BIGINT AS row_count, 'key prefix ' || token || CASE token WHEN '00G' THEN ' looks like Group, which is not in this extract' WHEN '701' THEN ' looks like Campaign, which is not in this extract' ELSE ' matches no sheet in this extract' END AS reason FROM shared WHERE token NOT IN (SELECT token FROM keytok)",
        "unresolved_star": "SELECT 'events' AS node, 'user_id' AS column_name, NULL::VARCHAR AS token, count(user_id) AS row_count, 'identifier-shaped column with no matching sheet' AS reason FROM events UNION ALL SELECT 'embeddings', 'vec_id', NULL, count(vec_id), 'identifier-shaped column with no matching sheet' FROM embeddings UNION ALL SELECT 'benchmark', 'item_id', NULL, count(item_id), 'identifier-shaped column with no matching sheet' FROM benchmark",
        "polymorphic_groups": f"{_VC} SELECT polymorphic_group, count(*) AS targets, string_agg(to_node, ',' ORDER BY to_node) AS to_nodes FROM edges WHERE polymorphic_group IS NOT NULL GROUP BY 1",
        "merge_parts_asset": _merged(),
        "pick_key_overlapping_parts": f"{_ORG} SELECT 'Asset' AS node, 'Id' AS key, '02i' AS key_token, (SELECT count(*) FROM Asset) + (SELECT count(*) FROM Asset WHERE Id >= '02iA00000000090' AND Id < '02iA00000000100') AS row_count, (SELECT count(DISTINCT Id) FROM Asset) AS distinct_count",
        "pick_key": f"{_VC} SELECT col.node, all_rows AS row_count, 'Id' AS key, token AS key_token FROM col JOIN keytok USING (node) WHERE col = 'Id' UNION ALL SELECT 'labels', count(*), NULL, NULL FROM labels UNION ALL SELECT 'lineitem', count(*), NULL, NULL FROM lineitem UNION ALL SELECT 'events', count(*), NULL, NULL FROM events",
        "dedupe_copies": f"SELECT object_key, label, crc IS NOT NULL AND row_number() OVER (PARTITION BY object_key, crc, size ORDER BY label) > 1 AS is_copy FROM {_MEMBERS}",
        "include_filter": f"SELECT label FROM {_MEMBERS} WHERE object_key IN ('asset', 'visit__c')",
        "include_unmatched": f"SELECT name FROM (VALUES ('asset'), ('visit__c'), ('missing')) AS w(name) WHERE name NOT IN (SELECT object_key FROM {_MEMBERS})",
        "normalise_names": """WITH n AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)
SELECT name, lower(name) || CASE WHEN k % 2 = 1 THEN ' & co' ELSE '' END AS normalised, regexp_replace(CASE WHEN k % 2 = 1 THEN '"x.zip!Data/' || name || ' & Co.XLSX"' ELSE ' d\\' || name || '.csv ' END, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM n""",
        "load_order": f"""{_VC.replace('WITH ', 'WITH RECURSIVE ', 1)}, dep AS (SELECT DISTINCT from_node AS a, to_node AS b FROM edges WHERE from_node <> to_node),
depth AS (SELECT node, 1 AS d FROM keytok UNION SELECT dep.a, depth.d + 1 FROM dep JOIN depth ON dep.b = depth.node)
SELECT max(d)::BIGINT AS layer, node FROM depth GROUP BY node""",
        "cycles": """WITH RECURSIVE e AS (SELECT n_nationkey AS a, CASE WHEN n_nationkey % 5 < 4 THEN n_nationkey + 1 WHEN n_nationkey % 10 = 4 THEN n_nationkey - 2 ELSE n_nationkey - 9 END AS b FROM nation),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT x.a AS node, min(x.b) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT n_nationkey FROM nation) GROUP BY 1 HAVING count(DISTINCT x.b) > 1)
SELECT dense_rank() OVER (ORDER BY low) - 1 AS cycle_no, printf('%03d', node::INT) AS node FROM c""",
        "degree_stats": f"{_VC}, e AS (SELECT from_node, to_node FROM edges WHERE from_node <> to_node) SELECT node, (SELECT count(*) FROM e WHERE from_node = node) AS points_at, (SELECT count(*) FROM e WHERE to_node = node) AS referenced_by FROM (SELECT from_node AS node FROM e UNION SELECT to_node FROM e)",
        "largest_entities": f"SELECT * FROM ({_SIZES}) ORDER BY row_count DESC, node LIMIT 10",
        "extract_totals": f"{_VC} SELECT 6::BIGINT AS sheets, (SELECT sum(all_rows) FROM col WHERE col = 'Id')::BIGINT AS row_count, {sum(len(c) for c, _ in ORG.values())}::BIGINT AS columns, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM shared WHERE token NOT IN (SELECT token FROM keytok)) AS unresolved",
        "scores": """SELECT k AS matched, t AS token, n AS name, s AS suffix, CASE WHEN k = 0 THEN least(c, 0.25) ELSE c END AS confidence, CASE WHEN k = 0 THEN 'name-only' ELSE 'lookup' END AS kind, '1:1' AS cardinality, 0.07 AS null_pct, k >= 18 AS verified
FROM (SELECT *, round(least(0.70 * k / 20 + 0.20 * t::INT + 0.05 * n::INT + 0.05 * s::INT, 0.99), 3) AS c FROM range(21) AS r(k), (VALUES (TRUE), (FALSE)) AS a(t), (VALUES (TRUE), (FALSE)) AS b(n), (VALUES (TRUE), (FALSE)) AS d(s))""",
        "type_widening": """WITH k AS (SELECT unnest(['empty', 'string', 'bool', 'int', 'float', 'date', 'datetime', 'id']) AS t)
SELECT x.t AS a, y.t AS b, CASE WHEN x.t IN ('empty', 'id') AND y.t IN ('empty', 'id') THEN x.t WHEN x.t IN ('empty', 'id') THEN y.t WHEN y.t IN ('empty', 'id') OR x.t = y.t THEN x.t
  WHEN x.t IN ('int', 'float') AND y.t IN ('int', 'float') THEN 'float' WHEN x.t IN ('date', 'datetime') AND y.t IN ('date', 'datetime') THEN 'datetime' ELSE 'string' END AS merged FROM k x, k y""",
        "value_rules": """WITH t AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN o_orderkey || '.50' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'false' WHEN 5 THEN o_orderpriority WHEN 6 THEN ' ' || o_orderkey ELSE '' END AS v FROM orders),
k AS (SELECT v, CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[0-9]+\\.[0-9]+') THEN 'float' WHEN lower(v) IN ('true', 'false') THEN 'bool' ELSE 'str' END AS kind FROM t WHERE v <> '')
SELECT kind, count(*) AS n, count(DISTINCT CASE WHEN kind = 'int' THEN v::BIGINT END) AS ints, count(DISTINCT CASE WHEN kind IN ('int', 'float') THEN v::DOUBLE END) AS floats, count(DISTINCT lower(v)) AS texts FROM k GROUP BY kind""",
    }
    return out
