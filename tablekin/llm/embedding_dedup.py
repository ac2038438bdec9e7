"""Near-duplicate vectors: an exact range join in the metric of angles.

1. Equal vectors form a class; its smallest id stands for it, with the number of copies.
2. Pivots cut space into cells: a vector's home is the pivot with the largest cosine. How many pivots there are follows
   from a bounded sample: the number at which the estimated work (vectors sent and pairs compared) is least.
3. Boundary replication: let x have home i. For every pivot j, x lies on i's side of the plane midway between i and j.
   By the triangle inequality a vector y within angle t of x is no further than t beyond that plane, so y has to be
   compared in cell i only if y . (j - i) / |j - i| <= sin t for all j. A pair is compared in its smaller home only.
4. Cells join independently. A cell is cut into chunks of bounded size, and a task compares two chunks: a product in
   single precision with a safe margin finds candidates, their cosines are then taken in double precision.
5. Links are not written out: a task returns each vector's number of links and a spanning forest.

Vectors scattered in many dimensions lie near all borders: no pivot tells them apart, and an exact join has to compare
a constant share of all pairs. Then few pivots and large chunks keep the vectors sent in proportion to the input up to
16 * MOST_CHUNK vectors; the comparisons grow with the square.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, and so do rows
with a null id (their component_id is null) and vectors of different lengths with each other; very long vectors are
compared whole; repeated rows count as further copies; rows with equal ids and different vectors count each, under the
common id; ties go to the smaller id or cell; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, arrow_map, components, give_back, lookup_join, scratch, stored, table

COSINE = 0.9
#: The numbers of pivots tried, and the vectors they are tried on.
PIVOTS, SAMPLE = (4, 16, 64, 256, 1024), 1024
#: Vectors in a chunk: a sixteenth of all within these bounds. A task holds two chunks.
LEAST_CHUNK, MOST_CHUNK = 1 << 14, 1 << 16
MARGIN = 1e-5


def chunk_size(n: int) -> int:
    return max(LEAST_CHUNK, min(n // 16, MOST_CHUNK))


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id and raw: the vector as little-endian doubles, null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat = np.asarray(pc.fill_null(pc.cast(vectors.flatten(), pa.float64()), math.nan), np.float64)
            size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
            ends = np.cumsum(size)
            raw = []
            for end, n in zip(ends.tolist(), size.tolist(), strict=True):
                v = flat[end - n : end] + 0.0  # no negative zeros
                good = n and np.isfinite(v).all() and (top := np.abs(v).max()) > 0 and np.isfinite(top)
                raw.append(v.astype("<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    return arrow_map(embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), run, "vec_id long, raw binary")


def unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chosen_pivots(classes: DataFrame, n: int, cosine: float) -> dict[int, np.ndarray]:
    """Unit pivots by vector size (in bytes), of a bounded sample in hash order: at most max(PIVOTS) + SAMPLE vectors."""
    rows = classes.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(max(PIVOTS) + SAMPLE).select("raw").collect()
    by: dict[int, list[bytes]] = {}
    for r in rows:
        by.setdefault(len(r.raw), []).append(bytes(r.raw))
    out = {}
    for size, raws in by.items():
        x, own = unit(raws), n * len(raws) / len(rows)
        tried = [k for k in PIVOTS if 2 * k <= len(x)] or [1]
        test = x[-min(len(x), SAMPLE) :]
        out[size] = x[: min(tried, key=lambda k: work(test, x[:k], own, size, chunk_size(n), cosine))]
    return out


def work(test: np.ndarray, pivots: np.ndarray, n: float, size: int, chunk: int, cosine: float) -> float:
    """About how many seconds of sending and comparing n vectors of size bytes cost, by a sample of them."""
    home, guest = homes_and_guests(test, pivots, cosine)
    own = np.bincount(home, minlength=len(pivots)) * n / len(test)
    more = guest.sum(axis=0) * n / len(test)
    a, b = np.ceil(own / chunk), np.ceil(more / chunk)
    sent = (own * (a + b) + more * a).sum()
    return sent * size / 1e8 + (own * (own / 2 + more)).sum() * size / 4 / 1e10


def homes_and_guests(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector and, as a matrix, the smaller cells in which it has to be compared too."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    reach = math.sqrt(1 - cosine * cosine) + 1e-9
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0)) if len(pivots) <= 64 else np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    guest = np.zeros(near.shape, bool)
    for i in range(len(pivots)):
        rows = np.flatnonzero(home > i)
        if len(rows):
            over = near[rows] - near[rows, i : i + 1] <= reach * gap[i] + 1e-9
            guest[rows, i] = over.all(axis=1)
    return home, guest


def routed(classes: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """rep, copies, raw, home and guests: cell names hold the vector's length, so that lengths never mix."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most max(PIVOTS) vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raws = part.column(2).to_pylist()
                home, guests = [""] * len(raws), [[] for _ in raws]
                by: dict[int, list[int]] = {}
                for k, raw in enumerate(raws):
                    by.setdefault(len(raw), []).append(k)
                for size, rows in by.items():
                    if size not in shared.value:
                        for k in rows:
                            home[k] = f"{size}:0"
                        continue
                    h, g = homes_and_guests(unit([raws[k] for k in rows]), shared.value[size], cosine)
                    for k, cell, row in zip(rows, h.tolist(), g, strict=True):
                        home[k], guests[k] = f"{size}:{cell}", [f"{size}:{c}" for c in np.flatnonzero(row)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.string()), pa.array(guests, pa.list_(pa.string()))], names=["rep", "copies", "raw", "home", "guests"])

    return arrow_map(classes.select("rep", "copies", "raw"), run, "rep long, copies long, raw binary, home string, guests array<string>")


def tiled(rows: DataFrame, chunk: int) -> DataFrame:
    """cell, a, b, second, rep, copies, raw: each vector in every task that compares it, second if it is on b's side.

    A task is a chunk of a cell's own vectors against itself (b = a), a later chunk (b > a) or a chunk of guests
    (b < 0). Cells are few (at most one per pivot and vector length), so their sizes are collected.
    """
    sizes = rows.select(F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("g"))), F.transform("guests", lambda c: F.struct(c.alias("cell"), F.lit(1).alias("g"))))).alias("e")).groupBy("e.cell", "e.g").count()
    chunks = {(r.cell, r.g): -(-r["count"] // chunk) for r in sizes.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for k, (rep, home, guests) in enumerate(zip(*(part.column(j).to_pylist() for j in (0, 3, 4)), strict=True)):
                    spread = rep * 0x9E3779B97F4A7C15 % (1 << 64) >> 20
                    n, own = many[home, 0], spread % many[home, 0]
                    out += [(k, home, min(own, c), max(own, c), c < own) for c in range(n)]
                    out += [(k, home, own, -1 - c, False) for c in range(many.get((home, 1), 0))]
                    for cell in guests:
                        if (cell, 0) in many:
                            c = -1 - spread % many[cell, 1]
                            out += [(k, cell, a, c, True) for a in range(many[cell, 0])]
                for first in range(0, len(out), 4096):
                    take, cell, a, b, second = zip(*out[first : first + 4096], strict=True)
                    got = part.take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(second), *got.columns[:3]], names=["cell", "a", "b", "second", "rep", "copies", "raw"])

    return arrow_map(rows, run, "cell string, a long, b long, second boolean, rep long, copies long, raw binary")


def compared(tiles: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links of the forest (n null) and, with b null, numbers of linked vectors to be added up."""

    def compare(rows: pa.Table) -> pa.Table:
        give_back()  # what earlier tiles of this task held
        rows = rows.combine_chunks()
        reps, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        alone = rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
        x = unit(rows.column("raw").to_pylist())
        small = x.astype(np.float32)
        second = np.array(rows.column("second").to_pylist(), bool)
        left = np.flatnonzero(~second)
        right = left if alone else np.flatnonzero(second)
        counts, forest = np.zeros(len(reps), np.int64), Forest(reps)
        for at in range(0, len(left), 512):
            rows_ = left[at : at + 512]
            p, q = np.nonzero(small[rows_] @ small[right].T >= cosine - MARGIN)
            p, q = rows_[p], right[q]
            if alone:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 1 << 16):
                i, j = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                sure = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[sure], j[sure]
                counts += np.bincount(i, copies[j], len(reps)).astype(np.int64) + np.bincount(j, copies[i], len(reps)).astype(np.int64)
                forest.link(i, j)
        nodes, roots = forest.pairs()
        at = np.flatnonzero(counts)
        return pa.table({"a": pa.array(nodes + reps[at].tolist(), pa.int64()), "b": pa.array(roots + [None] * len(at), pa.int64()), "n": pa.array([None] * len(nodes) + counts[at].tolist(), pa.int64())})

    return tiles.groupBy("cell", "a", "b").applyInArrow(compare, "a long, b long, n long")


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    with scratch(embeddings.sparkSession):
        rows = stored(prepared(embeddings).withColumn("key", F.sha2("raw", 256)), keep=True)
        known = rows.where("raw is not null and vec_id is not null")
        classes = stored(known.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("raw").alias("raw")))
        n = classes.count()
        homes = stored(routed(classes, chosen_pivots(classes, n, cosine), cosine))
        found = stored(compared(tiled(homes, chunk_size(n)), cosine))
        links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        groups = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
        judged = classes.select("key", "rep", "copies").join(links.join(groups, "rep", "left"), "rep", "left")
        judged = stored(judged.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), keep=True)
    out = lookup_join(rows.select("vec_id", "key"), judged, "key", salt=F.col("vec_id"))
    alone = F.col("vec_id").isNull() | F.col("component").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
