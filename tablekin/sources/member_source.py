"""A Spark data source over the files of an export: cells as Arrow batches, a partition for each file or chunk of one.

Plain CSV and TSV files beyond CHUNK bytes are cut. A cut may fall inside quotes: a first job counts each chunk's
quotes, and the parity of the count before a chunk is taken for the state in which it starts. A lone quote inside an
unquoted field misleads that guess, so it is checked: each chunk notes where its first record starts and where the
first one behind it does. The first chunk starts right, and a chunk that starts where the one before it ended is right
too. Files whose chunks disagree anywhere are read again in one piece (see disagreeing).

Rows: member, sheet, sheet_name, col, row, kind, value, n, times, later. The reader counts equal values itself, as far as
its memory allows: n rows hold the value, and times of them are among the column's first values in row order. later
marks chunks after the first. Besides values there are notes: `header` (a column's name), `rows` (how many rows the
sheet has, in row), `trim` (col: first column that is data, row: the one after the last), `span` (of a chunk: row: where
it begins, value: where it ends, both in bytes) and `error` (what went wrong; the file's other rows then don't count).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .listing import Member
from .readers import Sheet, count_quotes, head_of_csv, read_csv_chunk, read_member

SCHEMA = "member int, sheet int, sheet_name string, col int, row long, kind string, value string, n long, times long, later boolean"
_ARROW = pa.schema([("member", pa.int32()), ("sheet", pa.int32()), ("sheet_name", pa.string()), ("col", pa.int32()), ("row", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("n", pa.int64()), ("times", pa.int64()), ("later", pa.bool_())])
CHUNK = 128 << 20
#: Different values that a reader holds before it passes them on.
HELD = 200_000


class MemberPartition(InputPartition):
    def __init__(self, number: int, path: str, chain: tuple[str, ...], chunk: list | None = None):
        super().__init__(number)
        self.number, self.path, self.chain, self.chunk = number, path, chain, chunk

    def sheets(self, max_rows: int | None) -> Iterator[Sheet]:
        if self.chunk is None:
            return read_member(self.path, self.chain, max_rows)
        return read_csv_chunk(self.path, *self.chunk)

    @property
    def later(self) -> bool:
        return self.chunk is not None and not self.chunk[-1]


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.members = json.loads(options["members"])
        self.max_rows = int(options["maxRows"]) if options.get("maxRows") else None
        self.sample = int(options.get("sample") or 500)

    def partitions(self):
        return [MemberPartition(n, path, tuple(chain), chunk) for n, path, chain, chunk in self.members]

    def read(self, partition: MemberPartition) -> Iterator[pa.RecordBatch]:
        member, later = partition.number, partition.later

        def batch(rows: int, **columns: object) -> pa.RecordBatch:
            """Lists as they are, single values repeated."""
            given = {"member": member, "later": later, "n": 1, "times": 0} | columns
            arrays = [pa.array(v if isinstance(v := given.get(f.name), list) else [v] * rows, f.type) for f in _ARROW]
            return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

        try:
            for k, sheet in enumerate(partition.sheets(self.max_rows)):
                width = len(sheet.header)
                if width and not later:
                    yield batch(width, sheet=k, sheet_name=sheet.name, col=list(range(width)), kind="header", value=sheet.header)
                counts: dict[tuple[int, str], dict[str, int]] = {}
                first: dict[tuple[int, str], dict[str, int]] = {}
                met, held = [0] * width, 0

                def flush(k: int = k, counts: dict = counts, first: dict = first) -> Iterator[pa.RecordBatch]:
                    for key, found in counts.items():
                        early = first.get(key)
                        times = [early.get(v, 0) for v in found] if early else 0
                        yield batch(len(found), sheet=k, col=key[0], kind=key[1], value=list(found), n=list(found.values()), times=times)
                    counts.clear()
                    first.clear()

                for c, _, kind, value in sheet.cells:
                    own = counts.setdefault((c, kind), {})
                    if (n := own.get(value)) is None:
                        own[value] = 1
                        held += 1
                    else:
                        own[value] = n + 1
                    if met[c] < self.sample:
                        met[c] += 1
                        early = first.setdefault((c, kind), {})
                        early[value] = early.get(value, 0) + 1
                    if held >= HELD:
                        yield from flush()
                        held = 0
                yield from flush()
                yield batch(1, sheet=k, sheet_name=sheet.name, row=sheet.rows, kind="rows")
                if sheet.last is not None:
                    yield batch(1, sheet=k, sheet_name=sheet.name, col=sheet.first, row=sheet.last, kind="trim")
                if sheet.span is not None:
                    yield batch(1, sheet=k, row=sheet.span[0], kind="span", value=str(sheet.span[1]))
        except Exception as e:  # one unreadable file must not end the run
            if partition.chunk is not None:  # a wrong start may be why: let the whole file tell
                yield batch(1, sheet=0, row=-1, kind="span", value="-1")
                return
            yield batch(1, sheet=0, kind="error", value=f"{type(e).__name__}: {e}")


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablekin_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def chunks(spark: SparkSession, members: list[Member], chunk: int) -> dict[int, list[list]]:
    """For each large plain text file its chunks: separator, header, start, end, quoted, first."""
    cuts: list[tuple[int, str, int, int]] = []
    heads = {}
    for k, m in enumerate(members):
        if m.chain or m.size <= chunk or not m.path.lower().endswith((".csv", ".tsv")):
            continue
        separator = "," if m.path.lower().endswith(".csv") else "\t"
        if (head := head_of_csv(m.path, separator)) is not None:
            heads[k] = (separator, *head)
            bounds = [head[1], *range(head[1] + chunk, m.size, chunk), m.size]
            cuts += [(k, m.path, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    if not cuts:
        return {}

    def quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, path, a, b = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(count_quotes, path, a, b), pa.int64())], names=["k", "start", "n"])

    listed = spark.createDataFrame(cuts, "k int, path string, start long, end long").repartition(len(cuts))
    counted = {(r.k, r.start): r.n for r in listed.mapInArrow(quotes, "k int, start long, n long").collect()}  # one row per chunk
    out: dict[int, list[list]] = {}
    open_ = 0
    for k, _, a, b in cuts:
        own = out.setdefault(k, [])
        open_ = 0 if not own else open_
        separator, header, _ = heads[k]
        own.append([separator, header, a, b, bool(open_ & 1), not own])
        open_ += counted[k, a]
    return out


def disagreeing(spans: dict[int, list[tuple[int, int]]]) -> set[int]:
    """The members of whose chunks some doesn't begin where the one before it ends. spans: (begin, end) by member."""
    out = set()
    for member, own in spans.items():
        own = sorted(own)
        if own[0][0] < 0 or any(a[1] != b[0] for a, b in zip(own, own[1:], strict=False)):
            out.add(member)
    return out


def read_cells(spark: SparkSession, members: list[Member], max_rows: int | None = None, sample: int = 500, chunk: int | None = CHUNK, only: set[int] | None = None) -> DataFrame:
    """The cells of all members, or of some by number, largest file first. Without a chunk size no file is cut."""
    spark.dataSource.register(MemberSource)
    cut = chunks(spark, members, chunk) if max_rows is None and chunk is not None else {}
    order = sorted(((k, m) for k, m in enumerate(members) if only is None or k in only), key=lambda x: -x[1].size)
    listed = json.dumps([(k, m.path, m.chain, c) for k, m in order for c in cut.get(k, [None])])
    return spark.read.format("tablekin_members").option("members", listed).option("maxRows", "" if max_rows is None else str(max_rows)).option("sample", str(sample)).load()
