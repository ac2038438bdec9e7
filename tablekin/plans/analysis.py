"""The passes put together, for frames and for files.

Pass 1 counts the values of every column (one shuffle of partial counts), pass 2 measures all proposed references in
one join. Between them only schema-sized rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.dialects import Dialect, get
from ..operators import cells, combining, profiling, relating
from ..plans.model import Column, Graph, Node
from ..sources.listing import Member, norm_name
from ..sources.member_source import CHUNK, disagreeing, read_cells


@dataclass
class Part:
    """One sheet of one file, or one frame."""

    number: int
    node: str
    source: str
    sheet: str
    header: list[str]
    rows: int
    size: int = 0
    warning: str | None = None
    integer_ids: frozenset[int] = frozenset()


@dataclass
class Profile:
    """Nodes with their statistics, and the value counts of their identifier columns (node, column, value, n)."""

    nodes: list[Node]
    ids: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drop what is cached; call it once the relationships are measured."""
        for df in self.held:
            df.unpersist()


@dataclass
class ColumnFact:
    type: str
    filled: int
    distinct: int
    max_length: int | None = None
    id_like: bool = False


#: The first values of text columns, given which columns must be looked at in full (None: a first look at few rows).
Sampler = Callable[[set[tuple[int, int]] | None], DataFrame]


def sampled_signs(stats: Mapping[tuple[int, int], ColumnFact], samples: Sampler, first: list, dialect: Dialect, n: int) -> dict[tuple[int, int], Row]:
    """The signs of each column's sample. Columns whose first look found too few values are looked at again in full."""
    signs = {(r.part, r.col): r for r in first}
    short = {k for k, f in stats.items() if f.type == "string" and (signs[k].found if k in signs else 0) < min(n, f.filled)}
    if short:
        signs |= {(r.part, r.col): r for r in profiling.sample_signs(samples(short), dialect).collect() if (r.part, r.col) in short}
    return signs


def profiled(
    spark: SparkSession, parts: list[Part], raw: DataFrame, samples: Sampler, dialect: Dialect, sample: int,
    copies: Mapping[str, list[str]] = {}, numbers: DataFrame | None = None, kinds: Mapping[tuple[int, int], str] = {}, parse: bool = True,
) -> Profile:
    """Statistics, merged parts and keys.

    raw: value_counts of text by part and column position, to be parsed or not. numbers: counts of fixed-width values,
    whose kinds are known from the frames. The jobs on text, numbers and samples run side by side.
    """
    held = []
    if parse:
        raw = raw.persist()
        types = spark.createDataFrame(profiling.column_types(raw).collect(), "part int, col int, type string")
        counts = profiling.canonical_counts(raw, types).persist()
        held.append(raw)
    else:
        counts = raw.select("part", "col", "value", "n", "length", F.lit("string").alias("type")).persist()
    held.append(counts)
    values_ = counts.select("part", "col", "value", "n")
    own = {p.number: p for p in parts}
    with ThreadPoolExecutor(3) as pool:
        looking = pool.submit(profiling.sample_signs(samples(None), dialect).collect)
        texts = pool.submit(profiling.column_stats(counts).collect)
        counted = []
        if numbers is not None:
            if dialect.integer_ids or len({p.node.lower() for p in parts}) < len(parts):  # else they are read once only
                numbers = numbers.persist()
                held.append(numbers)
                values_ = values_.union(cells.as_text(numbers))
            counted = profiling.number_stats(numbers).collect()
        stats = {(r.part, r.col): ColumnFact(r.type, r.filled, r.distinct, r.longest if r.type == "string" else None) for r in texts.result()}
        first = looking.result()
    signs = sampled_signs(stats, samples, first, dialect, sample)
    for k, f in stats.items():
        if f.type == "string" and k in signs:
            f.type, f.id_like = profiling.text_type(signs[k].id_share, signs[k].date_share, signs[k].time_share, dialect)
    for r in counted:
        kind = kinds[r.part, r.col]
        stats[r.part, r.col] = ColumnFact("int" if kind == "float" and r.all_whole else kind, r.filled, r.distinct)
    for (part, col), f in stats.items():
        f.id_like = f.id_like or (f.type == "int" and col in own[part].integer_ids)

    def is_id(part: int, col: int) -> bool:
        return stats[part, col].id_like

    # names and parts as a small table: from here on values are known by node and column name
    groups: dict[str, list[Part]] = {}
    for p in parts:
        groups.setdefault(p.node.lower(), []).append(p)
    places = [(p.number, k, min(g, key=lambda q: q.source).node, name, is_id(p.number, k) if (p.number, k) in stats else False, len(g) > 1) for g in groups.values() for p in g for k, name in enumerate(p.header)]
    listed = spark.createDataFrame(places, "part int, col int, node string, column string, id boolean, split boolean")
    named = values_.join(F.broadcast(listed), ["part", "col"])
    ids = named.where("id").select("node", "column", "value", "n")
    split = any(len(g) > 1 for g in groups.values())
    if split:  # the same value may come in several parts
        ids = ids.groupBy("node", "column", "value").agg(F.sum("n").alias("n"))
    ids = ids.persist()
    held.append(ids)
    distinct: dict[str, dict[str, int]] = {}
    if split:
        for r in named.where("split").groupBy("node", "column").agg(F.countDistinct("value").alias("d")).collect():
            distinct.setdefault(r.node, {})[r.column] = r.d
    tokens: dict[str, dict[str, list[tuple[str, int]]]] = {}
    if dialect.typed_ids:
        per_value = ids.select(F.lit(0).alias("part"), F.col("node"), F.col("column"), "value", "n").where(F.length("value").isin(15, 18))
        per_token = per_value.groupBy("node", "column", F.substring("value", 1, 3).alias("token")).agg(F.sum("n").alias("rows"))
        for r in sorted(profiling.top_tokens(per_token, ["node", "column"]).collect(), key=lambda r: r["rank"]):
            tokens.setdefault(r.node, {}).setdefault(r.column, []).append((r.token, r["rows"]))

    nodes = []
    for _, group in sorted(groups.items()):
        own_nodes = []
        for p in sorted(group, key=lambda p: p.source):
            columns = []
            for k, name in enumerate(p.header):
                r = stats.get((p.number, k))
                if r is None:
                    columns.append(Column(name, "empty", p.rows, p.rows, 0))
                else:
                    toks = tokens.get(min(group, key=lambda q: q.source).node, {}).get(name, []) if is_id(p.number, k) else []
                    columns.append(Column(name, r.type, p.rows, p.rows - r.filled, r.distinct, is_id(p.number, k), r.max_length, toks))
            node = Node(p.node, p.source, p.sheet, p.rows, columns, part_rows=[p.rows], size=p.size)
            if p.warning:
                node.warnings.append(p.warning)
            own_nodes.append(node)
        node = own_nodes[0] if len(own_nodes) == 1 else combining.united(own_nodes, distinct.get(own_nodes[0].id, {}), tokens.get(own_nodes[0].id, {}))
        node = combining.keyed(node, own_nodes, dialect)
        for label in sorted({x for p in group for x in copies.get(norm_name(p.source), ())}):
            node.warnings.append(f"skipped {label}: an identical copy of another part")
        nodes.append(node)
    return Profile(nodes, ids, held)


def frame_parts(tables: Mapping[str, DataFrame | list[DataFrame]], dialect: Dialect) -> tuple[list[Part], list[DataFrame]]:
    parts, frames = [], []
    for name, given in tables.items():
        several = given if isinstance(given, list) else [given]
        for k, frame in enumerate(several):
            ints = frozenset(j for j, (c, t) in enumerate(frame.dtypes) if dialect.integer_ids and t in ("int", "bigint", "smallint", "tinyint") and dialect.integer_id(c, name))
            parts.append(Part(len(parts), name, f"{name}#{k + 1}" if len(several) > 1 else name, name, frame.columns, 0, integer_ids=ints))
            frames.append(frame)
    return parts, frames


def profile_frames(spark: SparkSession, tables: Mapping[str, DataFrame | list[DataFrame]], dialect: Dialect, sample: int = 500, parse_text: bool = False) -> Profile:
    """Profile frames by name; a list of frames under one name is an object split over several parts."""
    parts, frames = frame_parts(tables, dialect)
    pairs = list(zip(parts, frames, strict=True))
    sizes = cells.union([f.select(F.lit(p.number).alias("part")) for p, f in pairs]).groupBy("part").count()
    with ThreadPoolExecutor(1) as pool:  # beside the plans that follow
        counting = pool.submit(sizes.collect)
        raw = cells.union([cells.text_counts(f, p.number, parse_text) for p, f in pairs])
        numbers = cells.union([cells.number_counts(f, p.number) for p, f in pairs])
        rows = {r.part: r["count"] for r in counting.result()}
    for p in parts:
        p.rows = rows.get(p.number, 0)
        p.warning = None if p.rows else combining.EMPTY
    kinds = {(p.number, k): cells.number_kind(c.dataType) for p, f in pairs for k, c in enumerate(f.schema.fields) if cells.is_number(c.dataType)}

    def samples(short: set[tuple[int, int]] | None) -> DataFrame:
        if short is None:
            return cells.union([cells.first_values(f, p.number, sample, most_rows=2 * sample) for p, f in pairs])
        return cells.union([cells.first_values(f, p.number, sample, {c for q, c in short if q == p.number}) for p, f in pairs if any(q == p.number for q, _ in short)])

    return profiled(spark, parts, raw, samples, dialect, sample, numbers=numbers, kinds=kinds, parse=parse_text)


def analyze(spark: SparkSession, tables: Mapping[str, DataFrame | list[DataFrame]], profile: str | Dialect = "generic", min_confidence: float = 0.5, overlap: float = 0.8, sample: int = 500, parse_text: bool = False) -> Graph:
    """The relationships between frames."""
    dialect = get(profile) if isinstance(profile, str) else profile
    found = profile_frames(spark, tables, dialect, sample, parse_text)
    graph = relating.infer(found.ids, [n for n in found.nodes if n.rows], dialect, min_confidence, overlap=overlap)
    found.release()
    return graph


#: Kinds of rows that tell of a file and hold none of its values.
NOTES = ("header", "rows", "trim", "span", "error")


def counted_members(read: DataFrame) -> DataFrame:
    """What the reader counted piece by piece, added up; its notes as they are."""
    notes = F.col("kind").isin(*NOTES)
    value = values.compact(F.col("value"))
    return read.groupBy("member", "sheet", "col", F.when(notes, F.col("row")).alias("row"), F.col("kind"), F.when(notes, F.col("value")).otherwise(value).alias("value")).agg(
        F.sum("n").alias("n"), F.max(F.length("value")).alias("length"), F.sum(F.when(F.col("later"), 0).otherwise(F.col("times"))).alias("times"), F.sum("times").alias("all_times"), F.first("sheet_name", True).alias("sheet_name")
    )


def profile_members(spark: SparkSession, members: list[Member], dialect: Dialect, copies: Mapping[str, list[str]] = {}, max_rows: int | None = None, sample: int = 500, chunk: int = CHUNK) -> Profile:
    """Profile the files of an export. Each is read once; cells are counted as they come."""
    merged = counted_members(read_cells(spark, members, max_rows, sample, chunk)).persist()
    told = merged.where(F.col("kind").isin(*NOTES)).collect()
    spans: dict[int, list[tuple[int, int]]] = {}
    for r in told:
        if r.kind == "span":
            spans.setdefault(r.member, []).append((r.row, int(r.value)))
    if again := disagreeing(spans):  # their chunks were not cut between records
        whole = counted_members(read_cells(spark, members, max_rows, sample, None, again))
        merged = merged.where(~F.col("member").isin(*again)).unionByName(whole).persist()
        told = merged.where(F.col("kind").isin(*NOTES)).collect()
    notes = F.col("kind").isin(*NOTES)
    errors = {r.member: r.value for r in told if r.kind == "error"}
    headers: dict[tuple[int, int], dict[int, str]] = {}
    info: dict[tuple[int, int], tuple[str, int]] = {}
    trims: dict[tuple[int, int], tuple[int, int]] = {}
    for r in told:
        if r.member in errors:
            continue
        if r.kind == "header":
            headers.setdefault((r.member, r.sheet), {})[r.col] = r.value
        elif r.kind == "rows":
            name, rows = info.get((r.member, r.sheet), (r.sheet_name, 0))
            info[r.member, r.sheet] = (name, rows + r.row * r.n)  # chunks of a file tell their own
        elif r.kind == "trim":
            trims[r.member, r.sheet] = (r.col, r.row)
    parts, keys = [], []
    per_member: dict[int, int] = {}
    for m, _ in info:
        per_member[m] = per_member.get(m, 0) + 1
    for k, m in enumerate(members):
        if k in errors:
            stem = dialect.node_name(m.base_name, "", 1)
            parts.append(Part(len(parts), stem, m.label, stem, [], 0, m.size, f"unreadable: {errors[k]}"))
            continue
        for (member, sheet), (name, rows) in sorted(info.items()):
            if member != k:
                continue
            header = [h for _, h in sorted(headers.get((member, sheet), {}).items())]
            first, last = trims.get((member, sheet), (0, len(header)))
            number = len(parts)
            parts.append(Part(number, dialect.node_name(m.base_name, name, per_member[k]), m.label, name, header[first:last], rows, m.size, None if rows and header else combining.EMPTY))
            keys.append((member, sheet, number, first, last))
    listed = spark.createDataFrame(keys, "member int, sheet int, part int, first int, last int")
    data = merged.where(~notes).join(F.broadcast(listed), ["member", "sheet"]).withColumn("col", F.col("col") - F.col("first"))
    raw = data.select("part", "col", "kind", "value", "n", "length")

    def samples(short: set[tuple[int, int]] | None) -> DataFrame:
        times = F.col("times" if short is None else "all_times")
        return data.where((times > 0) & F.col("kind").isin("text", "str")).select("part", "col", "value", times.alias("times"))

    found = profiled(spark, parts, raw, samples, dialect, sample, copies)
    found.held.append(merged)
    return found
