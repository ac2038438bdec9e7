"""What an analysis finds. All of it is as large as the schema, not as the data."""

from __future__ import annotations

from dataclasses import dataclass, field

LOOKUP, SELF, NAME_ONLY = "lookup", "self", "name-only"


@dataclass
class Column:
    name: str
    type: str
    rows: int
    nulls: int
    distinct: int
    id_like: bool = False
    max_length: int | None = None
    tokens: list[tuple[str, int]] = field(default_factory=list)

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    @property
    def unique(self) -> bool:
        return 0 < self.filled == self.distinct


@dataclass
class Node:
    id: str
    source: str
    sheet: str
    rows: int
    columns: list[Column]
    key: str | None = None
    key_token: str | None = None
    parts: list[str] = field(default_factory=list)
    part_rows: list[int] = field(default_factory=list)
    size: int = 0
    warnings: list[str] = field(default_factory=list)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Edge:
    from_node: str
    from_column: str
    to_node: str
    to_column: str
    kind: str
    cardinality: str
    confidence: float
    resolve_rate: float
    null_pct: float
    verified: bool
    evidence: list[str]
    group: str | None = None
    matched: int = 0
    total: int = 0


@dataclass
class Unresolved:
    node: str
    column: str
    token: str | None
    rows: int
    reason: str


@dataclass
class Stats:
    sheets: int
    rows: int
    columns: int
    edges: int
    unresolved: int
    files: int
    split_objects: int
    read_seconds: float
    total_seconds: float
    sampled: bool = False
    include_list: str | None = None
    unmatched: list[str] = field(default_factory=list)


@dataclass
class Graph:
    nodes: list[Node]
    edges: list[Edge] = field(default_factory=list)
    unresolved: list[Unresolved] = field(default_factory=list)
    profile: str = "generic"
    source: str = ""
    stats: Stats | None = None
    load_order: list[list[str]] = field(default_factory=list)
    cycles: list[list[str]] = field(default_factory=list)
