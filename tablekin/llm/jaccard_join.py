"""Near-duplicate documents: a similarity join on word shingles by a min-hash LSH forest with exact verification.

1. Every document becomes its set of five-word shingles. Equal sets form a class; its smallest doc_id stands for it.
2. The representatives' min-hash signatures are paths in TREES tries. Every representative queries all tries: its
   prefixes begin deep and are shortened, the least crowded ones first, until a neighbour at the least similarity
   would be met with the target recall (shingles.shortened). What it matches are the nodes where its prefixes end, with
   all that is below them. Crowds are counts per node, combined before the shuffle; no node is ever gathered.
3. Members of a matched node are tied to its smallest id. Ties connect representatives to candidate groups. Groups are
   cut into blocks of bounded size; two blocks of a large group meet only if some matched node has members in both. A
   block, or a pair of blocks, is one task's work.
4. There the exact intersections of all pairs are counted, by an inverted index for rare shingles and a matrix product
   for frequent ones. Links are not written out: a task returns each document's number of links and a spanning forest.
5. The forests' connected components are the groups of near duplicates.

Words are what ASCII white space separates, taken as they are. A text of one to four words is one shingle.

Defined cases: a null or empty text has no shingles and links with nothing; a row with a null doc_id gets no class and
no links and is kept; a very long text is shingled whole; repeated rows count as further copies of their class; rows
with equal ids and different texts are judged each by its own text under the common id, and where such an id stands for
two classes its text of least set key is compared; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Forest, arrow_map, components, give_back, joined, lookup_join, merged, scratch, stored, table
from .shingles import DEPTH, LEAST, RECALL, SIMILARITY, Shingler, prefixes, shortened, signature

#: Representatives in a block; a task compares at most two blocks.
BLOCK = 256
FREQUENT = 24


def key_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, set_key (of the shingle set, null if there is none) and by trie the shortest prefix and what is below it."""
    names = ["doc_id", "set_key", "prefixes", "below"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingled(x) for x in part.column(1).to_pylist()]
                tries = [prefixes(signature(s)) if len(s) else (None, None) for s in sets]
                columns = [pa.array([x if x is None else x.view(np.int64) for x in side], pa.list_(pa.int64())) for side in zip(*tries, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(key_of, sets), pa.binary()), *columns], names=names)

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, set_key binary, prefixes array<bigint>, below array<bigint>")


def forest_nodes(reps: DataFrame) -> DataFrame:
    """rep, trie, depth, node, n, low: the nodes on each representative's paths from LEAST to DEPTH that hold n > 1 of them
    (at LEAST), with the smallest of them. reps: rep, prefixes, below. Most documents share no prefix and drop out first."""
    entries = reps.select("rep", F.posexplode("prefixes").alias("trie", "p"))
    shared = entries.groupBy("p").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("p")
    paths = stored(merged(entries, shared, "p"))
    paths = merged(paths, reps.select("rep", "below"), "rep").withColumn("b", F.element_at("below", F.col("trie") + 1))
    steps = [F.struct(F.lit(LEAST).alias("depth"), F.col("p").alias("node")), F.struct(F.lit(LEAST + 1).alias("depth"), F.xxhash64("p", F.shiftrightunsigned("b", 32)).alias("node")), F.struct(F.lit(DEPTH).alias("depth"), F.xxhash64("p", F.col("b"), F.lit(DEPTH)).alias("node"))]
    levels = stored(paths.select("rep", "trie", F.explode(F.array(*steps)).alias("s")).select("rep", "trie", "s.*"))
    crowds = levels.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low"))
    return stored(merged(levels, crowds, "node"))


def matched_nodes(nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """node: where some representative's shortened prefixes end with others below. A representative has at most TREES
    paths of three nodes, which bounds what is gathered for it."""
    own = nodes.groupBy("rep").agg(F.collect_list(F.struct("trie", "depth", "n", "node")).alias("paths")).select("paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[int] = set()
            for paths in batch.column(0).to_pylist():
                crowds: dict[int, dict[int, int]] = {}
                for x in paths:
                    crowds.setdefault(x["trie"], {})[x["depth"]] = x["n"]
                ends = shortened(crowds, similarity, recall)
                found.update(x["node"] for x in paths if x["n"] > 1 and ends[x["trie"]] == x["depth"])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["node"])

    return arrow_map(own, run, "node long").distinct()


def candidate_groups(reps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """rep, block, a, b: the tiles (pairs of blocks) in which each representative is compared, from its own block.

    reps: rep, prefixes, below. Representatives that no query matches don't appear.
    """
    nodes = forest_nodes(reps)
    ties = stored(merged(nodes, matched_nodes(nodes, similarity, recall), "node", "left_semi").select(F.col("node").alias("p"), "rep", "low"))
    groups = components(ties.select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b"))
    groups = stored(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    placed = stored(lookup_join(groups, sizes, "grp", "inner", salt=F.col("rep")))
    few = F.col("n") <= BLOCK
    total = placed.where(few).count()
    bins = max(1, -(-total // BLOCK))
    # small groups share bins; no two blocks of theirs need to meet
    small = placed.where(few).select("rep", F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("block"), F.lit(None).cast("long").alias("grp"))
    # large groups: members tied to the same smallest id stay together, up to the size of a block
    large = placed.where(~few).select("rep", "grp", "n")
    hub = ties.groupBy("rep").agg(F.min("low").alias("hub"))
    large = merged(large, hub, "rep")
    hubs = large.groupBy("hub").agg(F.count("*").alias("h"))
    large = lookup_join(large, hubs, "hub", "inner", salt=F.col("rep")).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("h") / BLOCK)))
    block = F.concat_ws(":", F.col("grp").cast("string"), F.pmod(F.xxhash64("hub", "part"), F.ceil(F.col("n") / BLOCK)).cast("string"))
    large = stored(large.select("rep", F.xxhash64(block).alias("block"), "grp"))
    # which blocks meet: one row per node and block, so a crowded node gives a row per BLOCK members
    inside = stored(merged(ties.select("p", "rep"), large.select("rep", "block"), "rep").select("p", "block").distinct())
    meets = stored(merged(inside.select("p", F.col("block").alias("a")), inside.select("p", F.col("block").alias("b")), "p").where("a < b").select("a", "b").distinct())
    tiles = meets.select(F.col("a").alias("block"), "a", "b").union(meets.select(F.col("b").alias("block"), "a", "b"))
    own = large.select("rep", "block").withColumn("a", F.col("block")).withColumn("b", F.col("block"))
    crossed = merged(large.select("rep", "block"), tiles, "block")
    out = own.select("rep", "block", "a", "b").union(crossed.select("rep", "block", "a", "b"))
    return out.union(small.select("rep", "block", F.col("block").alias("a"), F.col("block").alias("b")))


def shingle_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, copies and the shingles of each representative in wanted (rep, set_key, copies), once."""
    texts = merged(documents.select(F.col("doc_id").cast("long").alias("rep"), "text"), wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                sets = [shingled(x) for x in part.column(1).to_pylist()]
                same = [key_of(s) == key for s, key in zip(sets, part.column(2).to_pylist(), strict=True)]
                columns = [part.column(0), part.column(3), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "copies", "shingles"]).filter(pa.array(same, pa.bool_()))

    return arrow_map(texts.select("rep", "text", "set_key", "copies"), run, "rep long, copies long, shingles binary").dropDuplicates(["rep"])


def verified(documents: DataFrame, tiles: DataFrame, copies: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, n): links of the forest (n null) and, with b null, numbers of linked documents to be added up.

    tiles: rep, block, a, b. copies: rep, set_key, copies.
    """
    wanted = merged(copies.groupBy("rep").agg(F.min(F.struct("set_key", "copies")).alias("c")).select("rep", "c.*"), tiles.select("rep").distinct(), "rep")
    sets = stored(shingle_sets(documents, wanted))
    spread = merged(tiles, sets, "rep").select("a", "b", (F.col("block") != F.col("a")).alias("second"), "rep", "copies", "shingles")
    share = Fraction(similarity).limit_denominator(10_000)

    def compare(rows: pa.Table) -> pa.Table:
        give_back()  # what earlier tiles of this task held
        rows = rows.combine_chunks()
        reps, copies_ = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        side = np.array(rows.column("second").to_pylist(), bool)
        cross = rows.column("a")[0].as_py() != rows.column("b")[0].as_py()
        hit = linked([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")], share)
        if cross:
            hit &= side[:, None] != side[None, :]
        counts = hit @ copies_
        at = np.flatnonzero(counts)
        x, y = np.nonzero(np.triu(hit))
        forest = Forest(reps)
        forest.link(x, y)
        nodes, roots = forest.pairs()
        a, b, n = nodes + reps[at].tolist(), roots + [None] * len(at), [None] * len(nodes) + counts[at].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return spread.groupBy("a", "b").applyInArrow(compare, "a long, b long, n long")


def linked(sets: list[np.ndarray], share: Fraction) -> np.ndarray:
    """Which pairs of different sets have intersection / union >= share, as a matrix of booleans."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate([first, [len(flat)]]))
    common = np.zeros((n, n), np.int64)
    often = df > FREQUENT
    column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), df)
    for at in range(0, int(often.sum()), 4096):
        rows = np.flatnonzero((column >= at) & (column < at + 4096))
        dense = np.zeros((n, min(4096, int(often.sum()) - at)), np.float32)
        dense[owner[rows], column[rows] - at] = 1
        common += (dense @ dense.T).astype(np.int64)
    rare = np.repeat(~often & (df > 1), df)
    flat, owner = flat[rare], owner[rare]
    for d in range(1, FREQUENT):
        if len(flat) <= d:
            break
        same = flat[d:] == flat[:-d]
        if not same.any():
            break
        pair = owner[:-d][same] * n + owner[d:][same]
        add = np.bincount(pair, minlength=n * n).reshape(n, n)
        common += add + add.T
    union = size[:, None] + size[None, :] - common
    hit = common * share.denominator >= union * share.numerator
    np.fill_diagonal(hit, False)
    return hit


def jaccard_join(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, component_id and kept of every document.

    class_id: the smallest doc_id with the same shingles. n_links: how many other documents are at least so similar.
    component_id: the smallest doc_id reachable by links. kept: the document is its component's smallest.
    """
    with scratch(documents.sparkSession):
        signs = stored(signatures(documents), keep=True)
        known = signs.where("set_key is not null and doc_id is not null")
        classes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        reps = joined(known, classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"])
        reps = stored(reps.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "prefixes", "below"))
        tiles = stored(candidate_groups(reps, similarity, recall))
        found = stored(verified(documents, tiles, classes.select("rep", "set_key", "copies"), similarity))
        links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        groups = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
        judged = merged(classes, merged(links, groups, "rep", "left"), "rep", "left")
        judged = stored(judged.select("set_key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), keep=True)
    out = lookup_join(signs.select("doc_id", "set_key"), judged, "set_key", salt=F.col("doc_id"))
    alone = F.col("doc_id").isNull() | F.col("rep").isNull()
    pick = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c))
    component = pick("component")
    return out.select("doc_id", pick("rep").alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents with one of each group left, the one with the smallest doc_id. Of repeated rows (equal id and text)
    one is left; rows with a null id can't be judged and all stay."""
    judged = jaccard_join(documents, similarity, recall).where(~F.col("kept")).select("doc_id").distinct()
    left = merged(documents.where("doc_id is not null"), judged, "doc_id", "left_anti").select(documents.columns).dropDuplicates(["doc_id", "text"])
    return left.union(documents.where("doc_id is null"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
