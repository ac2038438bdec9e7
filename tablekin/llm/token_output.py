"""Token ids on disk: frequency ranks in a byte-aligned code of one to four bytes, lengths in separate control bytes.

Format, a folder of three Parquet tables, so that any store Spark reaches can hold it:
  vocab     rank, id, n       ids of the corpus by falling frequency; a text's ids are stored as ranks
  blocks    part, block, ...  runs of documents in ascending doc_id order: the ids of the documents (doc_ids), how many
                              tokens each has (counts), control (two bits per token: bytes - 1, four to a byte, the
                              first in the low bits) and data (the ranks' low bytes, little-endian, without gaps)
  manifest  part, n, start    how many tokens a part has and how many the parts before it have
Decoding is by table: a control byte gives four lengths, their running sum gives each rank's place in the data.

Defined cases: a null text counts as empty (the end id only); a null doc_id sorts first; repeated rows are written
each; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, lookup_join, shared_folder, table
from .tokens import TOKEN_SLICE, default_path, loaded

END_ID = 2
BLOCK_TOKENS = 1 << 18
#: Lengths of the four numbers that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def packed(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    four = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    four[: len(code)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that packed() took."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(n, "<u4")
    for k in range(4):
        out |= np.where(size > k, raw[begin + k], 0).astype("<u4") << np.uint32(8 * k)
    return out


def encoded(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and compressed 32-bit ids; the last row of each task has the task's counts of ids instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, squeeze = loaded(path), zstandard.ZstdCompressor(level=1)
        end, counts = np.array([end_id], "<u4"), np.zeros(max(ids.vocabulary, end_id + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOKEN_SLICE):
                part = batch.slice(at, TOKEN_SLICE)
                rows = [np.concatenate([x, end]) for x in ids(part.column(1).to_pylist())]
                counts += np.bincount(np.concatenate(rows), minlength=len(counts))
                small = [squeeze.compress(_narrow(x)) for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(small, pa.binary()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([squeeze.compress(counts.tobytes())], pa.binary())], names=["doc_id", "ids", "counts"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, counts binary")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where all fit, else in four; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def vocabulary(counts: DataFrame) -> list[tuple[int, int]]:
    """(id, n) by falling frequency, then id. At most one entry per id of the tokenizer, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unzip = None, zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                one = np.frombuffer(unzip.decompress(raw), np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = arrow_map(counts.select("counts").where("counts is not null"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r.id, r.n) for r in rows), key=lambda x: (-x[1], x[0]))


_BLOCKS = "part int, block int, first long, n long, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"


def _blocks(rows: DataFrame, ranks) -> DataFrame:
    """Rows (doc_id, ids) of each partition, already in order, as blocks."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unzip, rank = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), ranks.value
        block = first = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, docs, parts
            control, data = packed(rank[np.concatenate(parts)])
            row = [part, block, first, held, docs, [len(p) for p in parts], control, data]
            block, first, held, docs, parts = block + 1, first + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = _wide(unzip.decompress(raw.as_py()))
                docs.append(doc)
                parts.append(one)
                held += len(one)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return arrow_map(rows, run, _BLOCKS)


def write(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the token files of documents (doc_id, text) to a new folder."""
    spark = documents.sparkSession
    raw = shared_folder(spark)
    encoded(documents, tokenizer or default_path(), end_id).write.parquet(raw)
    read = spark.read.schema("doc_id long, ids binary, counts binary").parquet(raw)
    vocab = vocabulary(read)
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(vocab)], "rank int, id long, n long").coalesce(1).write.parquet(f"{folder}/vocab")
    rank = np.zeros(max((i for i, _ in vocab), default=0) + 1, "<u4")
    rank[[i for i, _ in vocab]] = np.arange(len(vocab), dtype="<u4")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read.where("ids is not null").select("doc_id", "ids").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    _blocks(rows, spark.sparkContext.broadcast(rank)).write.parquet(f"{folder}/blocks")
    sizes = sorted(spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n")).collect())  # one row per file
    start, manifest = 0, []
    for part, size in sizes:
        manifest.append((part, size, start))
        start += size
    spark.createDataFrame(manifest, "part int, n long, start long").coalesce(1).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, fn, schema: str) -> DataFrame:
    """fn(doc_ids, starts, list of id arrays) -> columns by name, applied to each block of the files."""
    ids = np.array([r.id for r in spark.read.parquet(f"{folder}/vocab").orderBy("rank").select("id").collect()], "<u4")
    shared = spark.sparkContext.broadcast(ids)
    blocks = lookup_join(spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks"), spark.read.schema("part int, n long, start long").parquet(f"{folder}/manifest").select("part", "start"), "part", "inner", salt=F.col("block"))
    names = [x.split()[0] for x in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, counts, control, data, first, start, n = (batch.column(j)[k].as_py() for j in range(7))
                tokens = shared.value[unpacked(control, data, n)]
                ends = np.cumsum(counts)
                got = fn(docs, (start + first + ends - counts).tolist(), np.split(tokens, ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(got[c], type=target.field(c).type) for c in names], schema=target)

    return arrow_map(blocks.select("doc_ids", "counts", "control", "data", "first", "start", "n"), run, schema)


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the ids of every document in the files."""
    return read(spark, folder, lambda docs, starts, ids: {"doc_id": docs, "start": starts, "ids": [x.tolist() for x in ids]}, "doc_id long, start long, ids array<bigint>")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write(table(spark, sf_dir, "documents"), folder)

    def digest(docs: list, starts: list, ids: list[np.ndarray]) -> dict:
        return {"doc_id": docs, "start": starts, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}

    return read(spark, folder, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
