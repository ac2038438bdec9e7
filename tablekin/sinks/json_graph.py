"""The graph as JSON, without fields that are empty, zero or false."""

from __future__ import annotations

import json
from typing import Any

from .. import __version__
from ..functions.numbers import rounded
from ..plans.model import Graph, Node

SCHEMA_VERSION = "1.1"
#: Fields whose absence would read as unknown.
KEPT = frozenset({"rows", "confidence", "verified"})
READING_GUIDE = (
    "Each item of nodes[] is a table, each item of edges[] a column that refers to another table's key. "
    "How far to trust an edge: resolve_rate is the authority. It is the share of the column's filled rows whose value was "
    "found in the target's key, counted over the data. verified=true says that at least nine in ten were found: treat such "
    "an edge as fact. confidence says by which signs the target was found, and so a confidence below 1.0 does NOT mean "
    "unverified: a column whose name doesn't speak of its target scores lower though all its values resolve. "
    "kind='name-only' is a guess from names, nothing resolved. A rate in between is a real reference of which some records "
    "are missing here. polymorphic_group joins the edges of one column that refers to several tables. load_order has every "
    "table once, targets before what refers to them; tables listed together in cycles[] refer to each other in a circle "
    "and load as one unit. unresolved[] are references to what this extract doesn't hold; they are no errors. Tables "
    "without rows are left out. A node with parts[] came in several files, which are counted together."
)


def _node(n: Node, refs: dict[tuple[str, str], list[str]]) -> dict[str, Any]:
    columns = []
    for c in n.columns:
        col: dict[str, Any] = {"name": c.name, "type": c.type, "distinct": c.distinct, "nulls_pct": rounded(c.nulls / c.rows, 4) if c.rows else 0.0, "key": c.name == n.key}
        if len(c.tokens) == 1:
            col["token"] = c.tokens[0][0]
        elif c.tokens:
            col["tokens"] = dict(c.tokens)
        if to := refs.get((n.id, c.name)):
            col["ref"] = to if len(to) > 1 else to[0]
        columns.append(col)
    return {
        "id": n.id, "source": n.source, "parts": n.parts if len(n.parts) > 1 else None, "sheet": n.sheet if n.sheet != n.id else None,
        "rows": n.rows, "key": n.key, "key_token": n.key_token, "columns": columns, "warnings": n.warnings,
    }


def lean(x: Any) -> Any:
    """x without blank fields. Blankness is judged before a field's own contents are cleaned; list items stay."""
    if isinstance(x, dict):
        return {k: lean(v) for k, v in x.items() if k in KEPT or v not in (None, "", 0, [], {})}
    return [lean(v) for v in x] if isinstance(x, list) else x


def as_object(g: Graph) -> dict[str, Any]:
    refs: dict[tuple[str, str], list[str]] = {}
    for e in g.edges:
        refs.setdefault((e.from_node, e.from_column), []).append(f"{e.to_node}.{e.to_column}")
    s = g.stats
    stats = s and {
        "sheets": s.sheets, "rows": s.rows, "columns": s.columns, "edges": s.edges, "unresolved": s.unresolved, "files": s.files,
        "split_objects": s.split_objects, "read_seconds": s.read_seconds, "total_seconds": s.total_seconds, "sampled": s.sampled,
        "include_list": s.include_list, "unmatched_include_names": s.unmatched,
    }
    edges = [
        {
            "from": f"{e.from_node}.{e.from_column}", "to": f"{e.to_node}.{e.to_column}", "kind": e.kind, "cardinality": e.cardinality,
            "confidence": e.confidence, "resolve_rate": e.resolve_rate, "verified": e.verified, "null_pct": e.null_pct,
            "polymorphic_group": e.group, "evidence": e.evidence,
        }
        for e in g.edges
    ]
    return lean(
        {
            "schema_version": SCHEMA_VERSION, "generator": f"tablekin {__version__}", "profile": g.profile, "source": g.source, "stats": stats,
            "reading_guide": READING_GUIDE, "load_order": g.load_order, "cycles": g.cycles, "nodes": [_node(n, refs) for n in g.nodes],
            "edges": edges, "unresolved": [{"from": f"{u.node}.{u.column}", "token": u.token, "rows": u.rows, "reason": u.reason} for u in g.unresolved],
        }
    )


def to_json(g: Graph, indent: int = 1) -> str:
    separators = None if indent else (",", ":")
    return json.dumps(as_object(g), ensure_ascii=False, indent=indent or None, separators=separators)
