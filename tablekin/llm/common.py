"""Shared helpers: reading tables, the shared folder, Arrow mapping, joins by measured size, labels, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the word rule `[^\x20\x09-\x0D]+` has it; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only if it was counted and holds no more rows than this.
BROADCAST_ROWS = 20_000
#: Rows handled at a time inside a Python worker, which bounds what it holds besides the Arrow batch.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor reaches.

    Where the setting is empty a folder in the session's warehouse is used, on one machine only: on a cluster it might
    be a folder of each executor's own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders written inside each open scratch(), innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for kept ones, which are the surrounding scratch's if there is one."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    owners = _OPEN[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[..., dict | None], schema: str, rows: int = SLICE) -> DataFrame:
    """Apply fn to slices of at most `rows` rows; fn takes the columns as Python lists and returns columns by name."""
    names = df.columns
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*[part.column(i).to_pylist() for i in range(len(names))])
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return arrow_map(df, run, schema)


#: Rows and bytes of an Arrow batch at most; the session's own settings are kept where they are smaller.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with small batches, whose workers give freed memory back to the system when a task ends.

    The session's batch limits are lowered and stay so: Spark reads them when the job runs, not here.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what Python and Arrow have freed but keep to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def count_upto(df: DataFrame, most: int) -> int:
    return df.limit(most + 1).count()


def merged(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join of two tables that grow with the input.

    Without the hint Spark broadcasts whatever it takes to be below its threshold. It takes a written table to be as
    large as its compressed files and an exploded one as large as before, so that the driver may have to hold
    millions of rows.
    """
    return rows.join(other.hint("merge"), on, how)


def joined(rows: DataFrame, written: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join to a written table: by broadcast if it was counted and is small, else merged."""
    return rows.join(F.broadcast(written), on, how) if count_upto(written, BROADCAST_ROWS) <= BROADCAST_ROWS else merged(rows, written, on, how)


def lookup_join(rows: DataFrame, small: DataFrame, on: str, how: str = "left", salt: Column | None = None, salts: int = 32) -> DataFrame:
    """Join rows to small (one row per key) on a key that may be hot.

    small is counted first. Up to BROADCAST_ROWS rows it is broadcast; beyond that both sides are shuffled with a
    salt, so that one hot key is dealt to `salts` tasks. Null keys match nothing.
    """
    if count_upto(small, BROADCAST_ROWS) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    by = salt if salt is not None else F.rand(7)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return merged(left, right, [on, "_salt"], how).drop("_salt")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no training may use: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int]) -> tuple[list[str], list[int], tuple[int, int]]:
    """At most per_class labelled texts of class 0 and of class 1, in hash order of the id, held-out rows excluded, and
    the numbers of labelled ids of both classes.

    The bound is a documented parameter of the classifiers, so the labels side of the join has a fixed bound too, and a
    document that comes many times is brought to the driver once: equal ids are reduced before, to one text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.col("doc_id"), F.lit(label))
    parts = [known.where(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class[y]) for y in (0, 1)]
    few = parts[0].unionByName(parts[1])
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toArrow().sort_by("doc_id")
    return rows.column("text").to_pylist(), rows.column("y").to_pylist(), (sizes.get(0, 0), sizes.get(1, 0))


def local_forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest (node, root) of the pairs, each tree hung from its smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


class Forest:
    """Trees over rows of one task, joined by arrays of links: work on links inside a tree is vectorised away."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.parent = ids, np.arange(len(ids))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up

    def pairs(self) -> tuple[list[int], list[int]]:
        """(ids, roots) of all rows that aren't their tree's smallest id."""
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.parent, self.ids)
        root = least[self.parent]
        at = np.flatnonzero(root != self.ids)
        return self.ids[at].tolist(), root[at].tolist()


def _shrunk(edges: DataFrame) -> DataFrame:
    """Each partition's edges as a spanning forest, in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = local_forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([r for _, r in forest], pa.int64())})

    return arrow_map(edges.select("a", "b"), run, "a long, b long")


def _round(state: DataFrame) -> tuple[tuple, DataFrame]:
    """One large-star and one small-star step; what tells whether anything changed, and the new edges."""
    with scratch(state.sparkSession):
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = stored(down.groupBy("a").agg(F.min("b").alias("m")))
        small = joined(down, low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small, keep=True)
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
    return tuple(told), after


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node reached.

    Alternates the large-star and small-star steps of map-reduce component finding. A step is a minimum per node (with
    map-side combining) and a join back, so a hub's edges are never gathered in one task: the minimum is combined
    before the shuffle, and the join back is by broadcast for few nodes, or else of two written tables, whose large
    partitions Spark can split. Each step is written to the shared folder.
    Self loops are ignored; nodes without edges don't appear.
    """
    state = stored(_shrunk(edges.where("a <> b and a is not null and b is not null")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        now, state = _round(state)
        if now[0] == now[2] and before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
