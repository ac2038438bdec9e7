"""The engine's operators as queries over the test tables, by name."""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..functions.dialects import get
from ..functions.numbers import rounded
from ..operators import cells, combining, ordering, profiling, relating
from ..sinks import diagrams, json_graph, pages
from ..sources import listing
from .analysis import analyze, profile_frames, profile_members
from .fixtures import org, org_table
from .model import Column, Graph, Node

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
STAR = (*TABLES, "embeddings")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_rows(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    rows = [(n.id, k, c.name, c.type, c.rows, c.nulls, c.distinct, -1 if c.max_length is None else c.max_length, c.unique) for n in nodes for k, c in enumerate(n.columns)]
    return spark.createDataFrame(rows, "node string, col_index long, column_name string, type string, row_count long, nulls long, distinct_count long, max_length long, is_unique boolean")


def column_profile(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = profile_frames(spark, {table: load(spark, sf_dir, table)}, get("salesforce"))
        found.release()
        return column_rows(spark, found.nodes)

    return query


#: A text column of each kind, made from nation's keys.
TYPING = """select case n_nationkey % 4 when 0 then '7' when 1 then '07' when 2 then '' else cast(n_nationkey as string) end as whole,
  case n_nationkey % 3 when 0 then '2.5' when 1 then '2.50' else '3' end as fraction,
  case n_nationkey % 3 when 0 then 'true' when 1 then 'TRUE' else 'False' end as flag,
  case n_nationkey % 3 when 0 then 'true' when 1 then '1' else '0' end as mixture,
  case n_nationkey % 3 when 0 then ' 7' when 1 then '7' else '07' end as spaced,
  case n_nationkey % 2 when 0 then '12' else n_name end as words, '' as nothing from """


def csv_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.sql(f"{TYPING} parquet.`{sf_dir}/nation.parquet`")
    found = profile_frames(spark, {"typing": frame}, get("salesforce"), parse_text=True)
    found.release()
    return column_rows(spark, found.nodes)


#: A text of each awkward kind for orders' rows: a lone quote, quotes and commas, lines, nothing.
NOTE = "case o_orderkey % 4 when 0 then '5\" pipe' when 1 then 'a, \"b\"' when 2 then concat('two', chr(10), 'lines', chr(10), 'no. ', cast(o_orderkey as string)) else '' end"
FILE_COLUMNS = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "float", "o_orderpriority": "string", "note": "string"}


def _written(spark: SparkSession, sf_dir: str, chunk: int | None) -> DataFrame:
    """Profile of orders as a CSV file, which the driver writes below the shared folder and removes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.removeprefix('file:').rstrip('/')}/{uuid.uuid4().hex}"
    os.makedirs(folder)
    path = f"{folder}/Orders.csv"
    frame = load(spark, sf_dir, "orders").selectExpr(*list(FILE_COLUMNS)[:-1], f"{NOTE} as note")
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(FILE_COLUMNS)
        for row in frame.toLocalIterator():
            if row.note.startswith("5"):  # as people type it, not as a writer would quote it
                f.write(",".join([*map(str, row[:-1]), row.note]) + "\n")
            else:
                writer.writerow(row)
    try:
        found = profile_members(spark, listing.list_members([path]), get("salesforce"), chunk=chunk)
        found.release()
        return column_rows(spark, found.nodes)
    finally:
        shutil.rmtree(folder, True)


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file read in one piece."""
    return _written(spark, sf_dir, None)


def csv_file_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file cut into chunks of 100 kB, at whose bounds lone quotes and lines inside quotes mislead."""
    return _written(spark, sf_dir, 100_000)


def column_profile_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As column_profile, but for lengths; vectors are profiled as their JSON text."""
    return column_profile("embeddings")(spark, sf_dir).drop("max_length")


def value_counts_asset_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cells.counted(cells.melted(org_table(spark, sf_dir, "Case").where("AssetId is not null").select("AssetId"), 0))
    return counts.select("value", "n")


def id_tokens_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = org_table(spark, sf_dir, "Visit__c").select("RecordId__c", "Campaign__c")
    tokens = profiling.token_counts(cells.counted(cells.melted(frame, 0)))
    total = F.sum("rows").over(W.partitionBy("col"))
    return profiling.top_tokens(tokens.withColumn("share", F.col("rows") / total), ["col"]).select("col", "token", F.col("rows").alias("row_count"), F.col("rank").cast("long").alias("rank"), "share")


def looks_like_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the first 500 assets by key that look like ids or dates."""
    out = []
    for name in ("generic", "salesforce"):
        dialect = get(name)
        frame = org_table(spark, sf_dir, "Asset").orderBy("Id").limit(500)
        signs = profiling.sample_signs(cells.first_values(frame, 0, 500), dialect)
        columns = spark.createDataFrame(list(enumerate(frame.columns)), "col int, column_name string")
        out.append(signs.join(F.broadcast(columns), "col").select(F.lit(name).alias("profile"), "column_name", "id_share", "date_share", "time_share", (F.col("id_share") >= dialect.id_share).alias("is_id")))
    return cells.union(out)


def _counts(frame: DataFrame, node: str, column: str) -> DataFrame:
    rows = frame.select(F.col(column).cast("string").alias("value")).where("value is not null")
    return rows.groupBy(F.lit(node).alias("node"), F.lit(column).alias("column"), "value").agg(F.count("*").alias("n"))


def _resolve(spark: SparkSession, source: tuple[DataFrame, str, str], target: tuple[DataFrame, str, str], tokens: list[str | None]) -> DataFrame:
    (sf, sn, sc), (tf, tn, tc) = source, target
    counts = cells.union([_counts(sf, sn, sc), _counts(tf, tn, tc)])
    node, goal = Node(sn, sn, sn, 0, [Column(sc, "id", 0, 0, 0, True)]), Node(tn, tn, tn, 0, [Column(tc, "id", 0, 0, 0, True)], key=tc)
    wanted = [relating.Candidate(node, node.columns[0], tn, t) for t in tokens]
    got = relating.resolved(counts, [node, goal], wanted)
    rows = [(c.token or "", m, t, rounded(m / t, 4) if t else 0.0) for c, (m, t) in zip(wanted, got, strict=True)]
    return spark.createDataFrame(rows, "token string, matched long, total long, rate double")


def _org_resolve(spark: SparkSession, sf_dir: str, source: str, column: str, target: str, tokens: list[str | None]) -> DataFrame:
    o = org(spark, sf_dir, source, target)
    return _resolve(spark, (o[source], source, column), (o[target], target, "Id"), tokens)


def resolve_asset_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _org_resolve(spark, sf_dir, "Asset", "Product2Id", "Product2", [None])


def resolve_case_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _org_resolve(spark, sf_dir, "Case", "AssetId", "Asset", [None, "02i"])


def resolve_visit_record_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _org_resolve(spark, sf_dir, "Visit__c", "RecordId__c", "Asset", [None, "02i", "500"])


def resolve_lineitem_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, (load(spark, sf_dir, "lineitem"), "lineitem", "l_partkey"), (load(spark, sf_dir, "part"), "part", "p_partkey"), [None])


def overlap_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier column of the org that is no key against every key, at a threshold of 0.8."""
    found = profile_frames(spark, org(spark, sf_dir), get("generic"))
    rows = relating.overlapping(found.ids, found.nodes, relating.sources(found.nodes), 0.8)
    found.release()
    return spark.createDataFrame([r[:3] for r in rows], "from_node string, from_column string, to_node string")


def _candidates(spark: SparkSession, sf_dir: str) -> list[relating.Candidate]:
    dialect = get("salesforce")
    found = profile_frames(spark, org(spark, sf_dir), dialect)
    out, _ = relating.candidates(found.nodes, dialect, 0.01)
    found.release()
    return out


def candidates_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c.node.id, c.column.name, c.target, c.token) for c in _candidates(spark, sf_dir) if c.token is not None]
    return spark.createDataFrame(rows, "from_node string, from_column string, to_node string, token string")


def candidates_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c.node.id, c.column.name, c.target) for c in _candidates(spark, sf_dir) if c.by_name]
    return spark.createDataFrame(rows, "from_node string, from_column string, to_node string")


def sf_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return analyze(spark, org(spark, sf_dir), "salesforce")


def edge_rows(spark: SparkSession, g: Graph) -> DataFrame:
    rows = [(e.from_node, e.from_column, e.to_node, e.to_column, e.kind, e.cardinality, e.confidence, e.resolve_rate, e.verified, e.null_pct, e.group, e.matched, e.total, "; ".join(e.evidence)) for e in g.edges]
    return spark.createDataFrame(rows, "from_node string, from_column string, to_node string, to_column string, kind string, cardinality string, confidence double, resolve_rate double, verified boolean, null_pct double, polymorphic_group string, matched long, total long, evidence string")


def edges_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(spark, sf_graph(spark, sf_dir))


def edges_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(spark, analyze(spark, org(spark, sf_dir), "generic"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return analyze(spark, {t: load(spark, sf_dir, t) for t in STAR}, "star")


def edges_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(spark, star_graph(spark, sf_dir))


def _unresolved(spark: SparkSession, g: Graph) -> DataFrame:
    return spark.createDataFrame([(u.node, u.column, u.token, u.rows, u.reason) for u in g.unresolved], "node string, column_name string, token string, row_count long, reason string")


def unresolved_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unresolved(spark, sf_graph(spark, sf_dir))


def unresolved_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unresolved(spark, star_graph(spark, sf_dir))


def polymorphic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_sf(spark, sf_dir).where("polymorphic_group is not null")
    return edges.groupBy("polymorphic_group").agg(F.count("*").alias("targets"), F.concat_ws(",", F.sort_array(F.collect_list("to_node"))).alias("to_nodes"))


def _halves(spark: SparkSession, sf_dir: str, overlap: int = 0) -> list[DataFrame]:
    """Asset in two parts by key; the second lacks InstallDate and may repeat the last rows of the first."""
    assets = org_table(spark, sf_dir, "Asset")
    second = assets.where(F.col("Id") >= F.format_string("02iA%011d", F.lit(100 - overlap))).drop("InstallDate")
    return [assets.where("Id < '02iA00000000100'"), second]


def merge_parts_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile_frames(spark, {"Asset": _halves(spark, sf_dir)}, get("salesforce"))
    found.release()
    return column_rows(spark, found.nodes)


def pick_key_overlapping_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile_frames(spark, {"Asset": _halves(spark, sf_dir, overlap=10)}, get("salesforce"))
    found.release()
    n = found.nodes[0]
    return spark.createDataFrame([(n.id, n.key, n.key_token, n.rows, n.column(n.key).distinct)], "node string, key string, key_token string, row_count long, distinct_count long")


def pick_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = org(spark, sf_dir) | {t: load(spark, sf_dir, t) for t in ("labels", "lineitem", "events")}
    found = profile_frames(spark, tables, get("salesforce"))
    found.release()
    return spark.createDataFrame([(n.id, n.rows, n.key, n.key_token) for n in found.nodes], "node string, row_count long, key string, key_token string")


def _members() -> list[listing.Member]:
    """Files of an imagined export, two of them copies."""
    listed = [("one.zip!Asset.csv", 10, 1), ("one.zip!x/Visit__c.xlsx", 20, 2), ("two.zip!Asset.csv", 12, 3), ("two.zip!Visit__c.XLSX", 20, 2), ("zip3.zip!visit__c.xlsx", 20, 2), ("Case.tsv", 5, None), ("d/Case.tsv", 5, None)]
    return [listing.Member(label, (label.rpartition("!")[2],) if "!" in label else (), label, size, crc) for label, size, crc in listed]


def dedupe_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, copies = listing.plan_parts(_members())
    rows = [(k, m.label, False) for k, g in groups.items() for m in g] + [(k, x, True) for k, g in copies.items() for x in g]
    return spark.createDataFrame(rows, "object_key string, label string, is_copy boolean")


WANTED = ("Asset", "'visit__c.xlsx'", "Missing")


def include_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = listing.choose(_members(), {listing.norm_name(w) for w in WANTED})
    return spark.createDataFrame([(m.label,) for m in kept], "label string")


def include_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unmatched = listing.choose(_members(), {listing.norm_name(w) for w in WANTED})
    return spark.createDataFrame([(x,) for x in unmatched], "name string")


def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table names as files of an export would have them, normalised and made safe."""
    names = [r.n_name for r in load(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]
    raw = [f'"x.zip!Data/{n} & Co.XLSX"' if k % 2 else f" d\\{n}.csv " for k, n in enumerate(names)]
    return spark.createDataFrame([(n, listing.norm_name(r), listing.safe_name(r)) for n, r in zip(names, raw, strict=True)], "name string, normalised string, safe string")


def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sf_graph(spark, sf_dir)
    return spark.createDataFrame([(k, n) for k, layer in enumerate(g.load_order, 1) for n in layer], "layer long, node string")


#: A graph with two cycles, by arithmetic on nation's keys: n -> n + 1 within fives, every fifth back or on.
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").selectExpr("n_nationkey as a", "case when n_nationkey % 5 < 4 then n_nationkey + 1 when n_nationkey % 10 = 4 then n_nationkey - 2 else n_nationkey - 9 end as b").collect()
    _, found = ordering.cycles_and_layers([f"{r.a:03d}" for r in rows], [(f"{r.a:03d}", f"{r.b:03d}") for r in rows])
    return spark.createDataFrame([(k, n) for k, c in enumerate(found) for n in c], "cycle_no long, node string")


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, out, into) for n, (out, into) in pages.degrees(sf_graph(spark, sf_dir).edges).items()]
    return spark.createDataFrame(rows, "node string, points_at long, referenced_by long")


def largest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cells.union([load(spark, sf_dir, t).select(F.lit(t).alias("node")) for t in STAR]).groupBy("node").agg(F.count("*").alias("row_count"))
    return spark.createDataFrame(pages.largest([tuple(r) for r in sizes.collect()]), "node string, row_count long")  # one row per table


def extract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sf_graph(spark, sf_dir)
    rows = [(len(g.nodes), sum(n.rows for n in g.nodes), sum(len(n.columns) for n in g.nodes), len(g.edges), len(g.unresolved))]
    return spark.createDataFrame(rows, "sheets long, row_count long, columns long, edges long, unresolved long")


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, diagrams.mermaid_lines(star_graph(spark, sf_dir)))


def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, diagrams.dot_lines(star_graph(spark, sf_dir)))


def json_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, json_graph.to_json(sf_graph(spark, sf_dir)).split("\n"))


def docs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sf_graph(spark, sf_dir)
    return spark.createDataFrame(list(pages.Pages(g, pages.Context(generated="2024-01-01")).all().items()), "path string, page string")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, cardinality and null share of hand-made measurements: the scoring rule on its own."""
    rows = []
    for k in range(0, 21):
        for flags in range(8):
            token, name, suffix = bool(flags & 1), bool(flags & 2), bool(flags & 4)
            c = relating.Candidate(Node("a", "a", "a", 100, []), Column("c", "id", 100, 7, 93), "b", "001" if token else None, name)
            e = relating.edge_of(c, "Id", k, 20, suffix, None)
            rows.append((k, token, name, suffix, e.confidence, e.kind, e.cardinality, e.null_pct, e.verified))
    return spark.createDataFrame(rows, "matched long, token boolean, name boolean, suffix boolean, confidence double, kind string, cardinality string, null_pct double, verified boolean")


def type_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["empty", "string", "bool", "int", "float", "date", "datetime", "id"]
    rows = [(a, b, combining.widened([a, b], False)) for a in kinds for b in kinds]
    return spark.createDataFrame(rows, "a string, b string, merged string")


def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing and canonical form of single values, over texts made from order keys."""
    text = """case o_orderkey % 8 when 0 then cast(o_orderkey as string) when 1 then concat('0', cast(o_orderkey as string))
      when 2 then concat(cast(o_orderkey as string), '.50') when 3 then 'TRUE' when 4 then 'false' when 5 then o_orderpriority
      when 6 then concat(' ', cast(o_orderkey as string)) else '' end"""
    v = F.nullif(F.expr(text), F.lit(""))
    kind = values.kind_of_text(F.col("v"))
    rows = load(spark, sf_dir, "orders").select(v.alias("v")).where("v is not null").select(kind.alias("kind"), "v", values.as_int(F.col("v")).alias("i"), values.as_float(F.col("v")).alias("f"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("i").alias("ints"), F.countDistinct("f").alias("floats"), F.countDistinct(F.lower("v")).alias("texts"))


def queries() -> dict[str, Query]:
    named = (
        csv_typing, csv_file, csv_file_in_chunks, column_profile_embeddings, value_counts_asset_id, id_tokens_visit, looks_like_id, resolve_asset_product, resolve_case_asset,
        resolve_visit_record_by_token, resolve_lineitem_part, overlap_probe, candidates_token, candidates_name, edges_sf, edges_generic,
        edges_star, unresolved_sf, unresolved_star, polymorphic_groups, merge_parts_asset, pick_key_overlapping_parts, pick_key,
        dedupe_copies, include_filter, include_unmatched, normalise_names, load_order, cycles, degree_stats, largest_entities,
        extract_totals, mermaid_lines, dot_lines, json_graph_text, docs_pages, scores, type_widening, value_rules,
    )
    return {f"column_profile_{t}": column_profile(t) for t in TABLES} | {f.__name__: f for f in named}
