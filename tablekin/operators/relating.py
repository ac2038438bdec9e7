"""Which columns refer to which tables: candidates by token, name or overlap, measured by one batched semi-join.

Node and column names are schema-sized and live on the driver; values never leave the executors.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialects import Dialect
from ..functions.numbers import VERIFIED_AT, percent, rounded, score, thousands
from ..plans.model import LOOKUP, NAME_ONLY, SELF, Column, Edge, Graph, Node, Unresolved
from .ordering import cycles_and_layers


@dataclass
class Candidate:
    node: Node
    column: Column
    target: str
    token: str | None = None
    by_name: bool = False
    by_overlap: bool = False


def sources(nodes: list[Node]) -> list[tuple[Node, Column]]:
    """Identifier columns that aren't their table's key."""
    return [(n, c) for n in nodes for c in n.columns if c.id_like and c.name != n.key]


def shared_tokens(column: Column, least: float) -> list[tuple[str, int]]:
    """The column's tokens that at least this share of its filled rows have."""
    return [(t, n) for t, n in column.tokens if n / max(column.filled, 1) >= least]


def targets_by_token(nodes: list[Node]) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in nodes:
        if n.key is not None and n.key_token is not None:
            out.setdefault(n.key_token, n.id)
    return out


def targets_by_name(nodes: list[Node], dialect: Dialect) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in nodes:
        low = n.id.lower()
        for alias in (low, low.replace("_", ""), *getattr(dialect, "aliases_of_node", lambda _: [])(n.id)):
            out.setdefault(alias, n.id)
    return out


def candidates(nodes: list[Node], dialect: Dialect, least_share: float) -> tuple[list[Candidate], list[Unresolved]]:
    """Candidates by token and by name, in a fixed order, and the tokens that no table here has."""
    tokens, names = targets_by_token(nodes), targets_by_name(nodes, dialect)
    found: list[Candidate] = []
    outside: list[Unresolved] = []
    for node, column in sources(nodes):
        own: dict[str, Candidate] = {}
        for token, rows in shared_tokens(column, least_share):
            if (target := tokens.get(token)) is not None:
                own.setdefault(target, Candidate(node, column, target)).token = token
            else:
                known = dialect.name_for_token(token)
                reason = f"looks like {known}, which is not in this extract" if known else "matches no sheet in this extract"
                outside.append(Unresolved(node.id, column.name, token, rows, f"key prefix {token} {reason}"))
        base = dialect.reference_base(column.name)
        implied = sorted(dialect.name_aliases(base)) if base is not None else []
        for alias in [*implied, *(t.lower() for t in dialect.builtin_targets(column.name))]:
            if (target := names.get(alias)) is not None:
                own.setdefault(target, Candidate(node, column, target)).by_name = True
        found += own.values()
    return found, outside


def key_values(counts: DataFrame, nodes: list[Node]) -> DataFrame:
    """target, value: the key values of every table whose key is an identifier column."""
    keys = [(n.id, n.key) for n in nodes if n.key is not None and n.column(n.key).id_like]
    listed = counts.sparkSession.createDataFrame(keys, "node string, column string")
    return counts.join(F.broadcast(listed), ["node", "column"]).select(F.col("node").alias("target"), "value")


def resolved(counts: DataFrame, nodes: list[Node], wanted: list[Candidate]) -> list[tuple[int, int]]:
    """(matched, total) rows of each candidate: all of them in one job.

    Counts are of distinct values already, so the join is as large as the identifiers, and it shuffles on target and
    value: a frequent value is one row. The list of candidates is schema-sized.
    """
    if not wanted:
        return []
    spark: SparkSession = counts.sparkSession
    listed = spark.createDataFrame([(k, c.node.id, c.column.name, c.target, c.token) for k, c in enumerate(wanted)], "id int, node string, column string, target string, token string")
    source = counts.join(F.broadcast(listed), ["node", "column"]).where(F.col("token").isNull() | F.col("value").startswith(F.col("token")))
    keys = key_values(counts, nodes).withColumn("hit", F.lit(True))
    sums = source.join(keys, ["target", "value"], "left").groupBy("id").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("matched"), F.sum("n").alias("total"))
    got = {r.id: (r.matched, r.total) for r in sums.collect()}
    return [got.get(k, (0, 0)) for k in range(len(wanted))]


def overlapping(counts: DataFrame, nodes: list[Node], unmatched: list[tuple[Node, Column]], threshold: float) -> list[tuple[str, str, str, int]]:
    """(node, column, target, matched rows) where the target's key covers at least the threshold's share of the column's rows.

    One join on value for all columns and all keys, in place of probing them pair by pair.
    """
    if not unmatched or threshold <= 0:
        return []
    listed = counts.sparkSession.createDataFrame([(n.id, c.name, c.filled) for n, c in unmatched], "node string, column string, filled long")
    source = counts.join(F.broadcast(listed), ["node", "column"])
    hits = source.join(key_values(counts, nodes), "value").groupBy("node", "column", "target").agg(F.sum("n").alias("matched"), F.first("filled").alias("filled"))
    return [(r.node, r.column, r.target, r.matched) for r in hits.where(F.col("matched") >= threshold * F.col("filled")).collect()]


def edge_of(c: Candidate, key: str, matched: int, total: int, suffix: bool, group: str | None) -> Edge:
    rate = matched / total if total else 0.0
    confidence = score(rate, c.token is not None, c.by_name, suffix)
    kind = SELF if c.target == c.node.id else LOOKUP
    if rate == 0:
        kind, confidence = NAME_ONLY, min(confidence, 0.25)
    evidence = [
        f"key prefix {c.token} matches {c.target}.{key}" if c.token is not None else "",
        f"column name implies {c.target}" if c.by_name else "",
        "matched by value overlap only, not by name or prefix" if c.by_overlap else "",
        f"{thousands(matched)}/{thousands(total)} references resolve ({percent(rate, 1)})",
        "column references more than one object" if group else "",
    ]
    return Edge(
        c.node.id, c.column.name, c.target, key, kind, "1:1" if c.column.unique else "N:1", confidence, rounded(rate, 4),
        rounded(c.column.nulls / max(c.column.rows, 1), 4), rate >= VERIFIED_AT, [e for e in evidence if e], group, matched, total,
    )


def infer(counts: DataFrame, nodes: list[Node], dialect: Dialect, min_confidence: float = 0.5, least_share: float = 0.01, overlap: float = 0.8) -> Graph:
    """The graph of nodes. counts: node, column, value, n of identifier columns."""
    found, outside = candidates(nodes, dialect, least_share)
    have = {(c.node.id, c.column.name) for c in found}
    without = [(n, c) for n, c in sources(nodes) if (n.id, c.name) not in have]
    by_id = {n.id: n for n in nodes}
    linkable = lambda c: (t := by_id[c.target]).key is not None and t.column(t.key).id_like
    measurable = [c for c in found if linkable(c)]
    # both are single jobs and neither needs the other
    with ThreadPoolExecutor(2) as pool:
        probing = pool.submit(overlapping, counts, nodes, [] if dialect.integer_ids else without, overlap)
        rates = {id(c): r for c, r in zip(measurable, resolved(counts, nodes, measurable), strict=True)}
        covers: dict[tuple[str, str], dict[str, int]] = {}
        for node, column, target, matched in probing.result():
            covers.setdefault((node, column), {})[target] = matched
    for n, c in without:
        for target in sorted(own := covers.get((n.id, c.name), {}), key=[n.id for n in nodes].index):
            found.append(Candidate(n, c, target, by_overlap=True))
            rates[id(found[-1])] = (own[target], c.filled)
    graph = Graph(nodes, profile=dialect.name)

    groups: dict[tuple[str, str], list[Candidate]] = {}
    for c in found:
        groups.setdefault((c.node.id, c.column.name), []).append(c)
    told: dict[tuple[str, str], list[Unresolved]] = {}
    for u in outside:
        told.setdefault((u.node, u.column), []).append(u)
    for n, c in sources(nodes):
        graph.unresolved += told.get((n.id, c.name), [])
        if (n.id, c.name) not in groups and not c.tokens:
            graph.unresolved.append(Unresolved(n.id, c.name, None, c.filled, "identifier-shaped column with no matching sheet"))

    for c in (c for c in found if id(c) in rates):
        matched, total = rates[id(c)]
        own = groups[c.node.id, c.column.name]
        several = sum(x.token is not None for x in own) > 1 or len(shared_tokens(c.column, least_share)) > 1 or (dialect.is_polymorphic(c.column.name) and len(own) > 1)
        suffix = dialect.reference_base(c.column.name) is not None
        edge = edge_of(c, by_id[c.target].key, matched, total, suffix, f"{c.node.id}.{c.column.name}" if several else None)
        if edge.confidence >= min_confidence:
            graph.edges.append(edge)
    graph.edges.sort(key=lambda e: (-e.confidence, e.from_node, e.from_column, e.to_node))
    graph.load_order, graph.cycles = cycles_and_layers([n.id for n in nodes], [(e.from_node, e.to_node) for e in graph.edges])
    return graph
