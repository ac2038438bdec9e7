"""Best-fit packing of token pieces into sequences, after a Martello-Toth reduction.

Only the number of pieces of each length matters to where they can go, and lengths run from 1 to the capacity: so the
packing is solved once, on a table of at most `capacity` counts, and its answer is a short list of rules such as
"pieces 40 to 99 of length 300 go to sequences 7 to 66 at offset 512". Executors number the pieces of each length
(a count per task and a running sum over tasks, not one ordered stream) and look their place up.

Reduction. For the longest remaining piece w, a set holding w that dominates every other set holding w is fixed for
good: w alone if nothing fits beside it; w with its exact complement; w with the longest piece that fits if no two
pieces fit beside it. Fixing such sets loses no sequence. What no rule decides is packed best-fit decreasing.

Defined cases: a null text counts as empty and gives a piece of the end id alone; repeated rows are packed each; ties
go by task and position; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, stored, table
from .tokens import TOKEN_SLICE, default_path, loaded

CAPACITY = 2048
END_ID = 0


@dataclass
class Plan:
    """rules[length]: (first rank, count, first sequence, offset), ascending by first rank."""

    capacity: int
    rules: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.rules.setdefault(length, []).append((first, count, sequence, offset))
        self.used[length] = first + count

    def fix(self, lengths: tuple[int, ...], count: int) -> None:
        """count new sequences that hold these lengths one after another, and nothing more."""
        offset = 0
        for x in lengths:
            self.place(x, count, self.sequences, offset)
            offset += x
        self.sequences += count


def _smallest(left: list[int], counts: dict[int, int], w: int) -> list[int]:
    """The two smallest pieces besides one of length w."""
    out: list[int] = []
    for x in left:
        out += [x] * min(2, counts[x] - (x == w))
        if len(out) >= 2:
            break
    return out[:2]


def reduced(plan: Plan, counts: dict[int, int]) -> dict[int, int]:
    """Fix dominating sets in the plan, in rounds until no more is found; the counts that no rule decides."""
    counts = {k: v for k, v in counts.items() if v}
    left = sorted(counts)

    def take(x: int, m: int) -> None:
        counts[x] -= m
        if not counts[x]:
            del counts[x]
            left.pop(bisect.bisect_left(left, x))

    before = -1
    while left and plan.sequences != before:
        before = plan.sequences
        for w in left[::-1]:
            while w in counts and (partner := dominating(left, counts, w, plan.capacity)) is not None:
                if not partner:
                    plan.fix((w,), counts[w])
                    take(w, counts[w])
                    continue
                k = partner[0]
                m = counts[w] // 2 if k == w else min(counts[w], counts[k])
                plan.fix((w, k), m)
                take(w, m)
                take(k, m)
    return counts


def dominating(left: list[int], counts: dict[int, int], w: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside a piece of length w in a set that dominates all others with it: nothing, one length, or unknown."""
    room = capacity - w
    small = _smallest(left, counts, w)
    if not small or small[0] > room:
        return ()
    at = bisect.bisect_right(left, room) - 1
    if left[at] == w and counts[w] == 1:
        at -= 1  # it can't be its own partner; small has shown that another fits
    if left[at] == room or len(small) < 2 or sum(small) > room:
        return (left[at],)
    return None


def best_fit(plan: Plan, counts: dict[int, int]) -> None:
    """Best-fit decreasing, whole groups of alike sequences at a time."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    sizes: list[int] = []

    def add(r: int, sequence: int, m: int) -> None:
        if r and m:
            if r not in room:
                room[r] = []
                bisect.insort(sizes, r)
            room[r].append((sequence, m))

    def fill(r: int, sequence: int, m: int, w: int, t: int) -> None:
        for j in range(t):
            plan.place(w, m, sequence, plan.capacity - r + j * w)
        add(r - t * w, sequence, m)

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect.bisect_left(sizes, w)
            if at < len(sizes):
                r = sizes[at]
                sequence, m = room[r].pop()
                if not room[r]:
                    del room[r]
                    sizes.pop(at)
            else:
                r, sequence, m = plan.capacity, plan.sequences, -(-n // (plan.capacity // w))
                plan.sequences += m
            t = r // w
            full = min(m, n // t)
            rest = min(n - full * t, t) if full < m else 0
            if full:
                fill(r, sequence, full, w, t)
            if rest:
                fill(r, sequence + full, 1, w, rest)
            add(r, sequence + full + (rest > 0), m - full - (rest > 0))
            n -= full * t + rest


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    best_fit(plan, reduced(plan, counts))
    return plan


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task and the piece's rank there among its length.

    with_ids adds the ids themselves (little-endian 32-bit integers), for writing sequences.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, task, seen = loaded(path), np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, TOKEN_SLICE):
                part = batch.slice(at, TOKEN_SLICE)
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), ids(part.column(1).to_pylist()), strict=True):
                    raw = raw.tobytes() + end
                    for k, first in enumerate(range(0, len(raw), 4 * capacity)):
                        one = raw[first : first + 4 * capacity]
                        n = len(one) // 4
                        rows.append((doc, k, first // 4, n, zlib.crc32(one), task, seen[n], one))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(names)], types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, schema)


def assigned(cut: DataFrame, plan: Plan, counts: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset. counts: task, length, n."""
    before = counts.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    rows = cut.join(before, ["task", "length"])
    tables = {k: np.array(v, np.int64).T for k, v in plan.rules.items()}
    shared = cut.sparkSession.sparkContext.broadcast(tables)  # a few rules per length, whatever the corpus
    names = [c for c in cut.columns if c not in ("task", "rank")]
    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy() + batch.column(2).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    first, _, seq, off = rules[int(length[at[0]])]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return arrow_map(rows.select(F.col("length").alias("_l"), F.col("rank").alias("_r"), F.col("before").alias("_b"), *names), run, schema)


def packed(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    cut = stored(pieces(documents, tokenizer or default_path(), capacity, end_id, with_ids))
    counts = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    return assigned(cut, solve(total, capacity), counts)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
