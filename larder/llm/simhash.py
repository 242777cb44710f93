"""SimHash near-dedup: vantage-point trees over 64-bit fingerprints, exact within a few differing bits.

Fingerprints that differ in at most r bits agree on one 32-bit half up to r // 2 bits. So two forests, one per
half, are searched with that small radius. A tree of vantage points, fitted on a bounded sample of
fingerprints and sized by their count, deals every fingerprint to its home shard; the triangle bound tells
which other shards can hold a half within the radius, and the fingerprint visits those as well. Inside a
shard the same splitting goes on until a block is small, and full distances are counted there. The sample
shapes the shards only: no pair depends on it.

A shard reports a spanning forest of its links, never all pairs, so a large group of near copies costs as
many rows as it has members. Components then come from repeated contraction of the links: every node
joins the neighbour with the smallest round-dependent hash, which leaves a constant fraction of nodes per
round.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; equal texts share a fingerprint and hence a component; a null id never names a
component unless all ids of it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import free_name, hashed_sample, lower_ascii, whole, windows, words
from larder.session import materialise

SHINGLE, MAX_BITS = 3, 3
SAMPLE = 50_000  # fingerprints the shard trees are fitted on
SHARD = 20_000  # fingerprints a shard should hold at home
BLOCK = 256  # fingerprints compared directly


def shingle_hashes(w: Column, width: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of the word column ``w``, repeats included."""
    n = F.size(w)
    joined = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(width)]))
    return F.when(n >= width, windows(w, n, width, joined)).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


#: For each byte, its eight bits as the eight bytes of a number: up to 255 of them add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
PIECE = 1 << 15  # hashes counted together


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per row, the bits set in over half of its hashes; rows are consecutive runs of ``hashes``."""
    sizes = np.diff(ends)
    counts = np.zeros((len(sizes), 64), np.int64)
    for low in range(int(ends[0]), int(ends[-1]), PIECE):
        high = min(low + PIECE, int(ends[-1]))
        first, last = np.searchsorted(ends, low, "right") - 1, np.searchsorted(ends, high, "left")
        begin, stop = np.maximum(ends[first:last], low), np.minimum(ends[first + 1 : last + 1], high)
        full = np.flatnonzero(stop > begin)
        begin, parts = begin[full] - low, -(-(stop - begin)[full] // 255)
        at = np.cumsum(parts) - parts
        cuts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(at, parts))
        lanes = LANES[hashes[low:high].view(np.uint8)].reshape(-1, 8)
        summed = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8)
        counts[first + full] += np.add.reduceat(summed, at, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """The other columns of ``docs`` with the fingerprint as a signed 64-bit number."""
    keep = [c for c in docs.columns if c != text]
    columns = [F.col(f"`{c}`") for c in keep]
    # The words are a column of their own: inside the window function they must not be split again.
    split = docs.select(*columns, words(lower_ascii(whole(F.col(f"`{text}`")))).alias("~words"))
    hashed = split.select(*columns, shingle_hashes(F.col("~words"), width).alias(name))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(keep))
            ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = pa.array(majority(values, ends).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema=batch.schema.set(len(keep), pa.field(name, pa.int64())))

    return hashed.mapInArrow(run, T.StructType([*hashed.schema.fields[:-1], T.StructField(name, T.LongType())]))


def halves(fp: np.ndarray, half: int) -> np.ndarray:
    return ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose(values: np.ndarray, seed: int) -> tuple[int, int] | None:
    """A vantage point of ``values`` and the distance that cuts them most evenly; None where none cuts."""
    best = None
    for k in range(3):
        point = values[(seed * 7919 + k * 104729) % len(values)]
        counts = np.bincount(near(values, point), minlength=33).cumsum()
        cut = int(np.argmin(np.abs(counts * 2 - len(values))))
        if 0 < counts[cut] < len(values) and (best is None or abs(counts[cut] * 2 - len(values)) < best[0]):
            best = (abs(counts[cut] * 2 - len(values)), int(point), cut)
    return None if best is None else best[1:]


def grow(values: np.ndarray, leaf: int, seed: int = 1):
    """A tree ``(point, cut, inner, outer)`` over a sample of halves; None is a shard."""
    if len(values) <= leaf or (split := choose(values, seed)) is None:
        return None
    inner = near(values, np.uint32(split[0])) <= split[1]
    return (*split, grow(values[inner], leaf, 2 * seed), grow(values[~inner], leaf, 2 * seed + 1))


def deal(tree, values: np.ndarray, radius: int, rows: np.ndarray, home: np.ndarray, name: int = 1):
    """(shard, rows, at home) for every shard that can hold a value within ``radius`` of a row's value."""
    if not len(rows):
        return
    if tree is None:
        yield name, rows, home
        return
    point, cut, inner, outer = tree
    d = near(values[rows], np.uint32(point)).astype(np.int64)
    to_inner, to_outer = d - radius <= cut, d + radius > cut
    yield from deal(inner, values, radius, rows[to_inner], home[to_inner] & (d[to_inner] <= cut), 2 * name)
    yield from deal(outer, values, radius, rows[to_outer], home[to_outer] & (d[to_outer] > cut), 2 * name + 1)


class Forest:
    """Union-find over array positions, by whole arrays of links."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while not np.array_equal(up := self.root[r], r):
            r = up
        self.root[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            apart = lo != hi
            a, b = hi[apart], lo[apart]
            if len(a):
                np.minimum.at(self.root, a, b)


def search(fp: np.ndarray, home: np.ndarray, half: int, bits: int, forest: Forest) -> None:
    """Join every home row of a shard with every row within ``bits`` whose half lies within ``bits // 2``."""
    values = halves(fp, half)
    stack = [(np.arange(len(fp)), home, 1)]
    while stack:
        rows, own, seed = stack.pop()
        at = rows[own]
        if not len(at):
            continue
        split = None if len(at) <= BLOCK else choose(values[at], seed)
        if split is None:
            for a in range(0, len(at), BLOCK):
                for b in range(0, len(rows), 1 << 14):
                    i, j = np.nonzero(near(fp[at[a : a + BLOCK]][:, None], fp[rows[b : b + (1 << 14)]][None, :]) <= bits)
                    i, j = at[a + i], rows[b + j]
                    forest.join(i[i != j], j[i != j])
            continue
        point, cut = split
        d = near(values[rows], np.uint32(point)).astype(np.int64)
        for child, side, inside in ((0, d - bits // 2 <= cut, d <= cut), (1, d + bits // 2 > cut, d > cut)):
            stack.append((rows[side], (own & inside)[side], (2 * seed + child) % 1_000_003))


def links(nodes: DataFrame, name: str = "fingerprint", bits: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within ``bits`` of each other."""
    spark = nodes.sparkSession
    total = nodes.count()
    chosen = hashed_sample(nodes.select(name), sample, total, name)
    taken = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)
    leaf = max(int(shard * len(taken) / max(total, 1)), 8)
    trees = [grow(halves(taken, h), leaf) for h in (0, 1)]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                every = np.arange(len(fp))
                for shard_name, rows, home in deal(trees[half], halves(fp, half), bits // 2, every, np.ones(len(fp), bool)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard_name * 2 + half, np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def inside(key, group):
        import pandas as pd

        fp = group["fp"].to_numpy().view(np.uint64)
        forest = Forest(len(fp))
        search(fp, group["home"].to_numpy(bool), int(key[0]) & 1, bits, forest)
        rows = np.arange(len(fp))
        root = forest.find(rows)
        joined = rows != root
        return pd.DataFrame({"a": fp[rows[joined]].view(np.int64), "b": fp[root[joined]].view(np.int64)})

    placed = nodes.select(name).mapInArrow(place, "shard bigint, fp bigint, home boolean")
    return placed.groupBy("shard").applyInPandas(inside, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): one root per connected component."""
    edges = materialise(edges)
    label = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        step = materialise(best.select("node", F.least("m", rank("node"))["v"].alias("next")))
        left = edges.join(step.select(F.col("node").alias("a"), F.col("next").alias("na")), "a")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("next").alias("nb")), "b").filter("na <> nb")
        label = step.withColumnRenamed("next", "root") if label is None else label.join(step.select(F.col("node").alias("root"), "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        label = materialise(label)
        edges = materialise(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(rows: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The other columns of ``rows`` (doc_id, text, ...) with fp, its component's root and component_id, the smallest id of the component."""
    printed = materialise(fingerprints(rows, "text", "fp", width))
    nodes = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(nodes, "fp", bits))
    rooted = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return printed.join(materialise(named), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links; one row per row."""
    found = labelled(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width, bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id, a missing id last.

    An id that occurs in several components keeps a row in each where it is the smallest. Of rows of one id in one component
    the one whose text, then whole row, hashes smallest stays.
    """
    id_mark, text_mark, place = (free_name(docs, n) for n in ("id_mark", "text_mark", "place"))
    own = F.col(f"`{doc_id}`")
    # The two marks find a row again: rows with both equal have one component.
    marks = {id_mark: F.xxhash64(own.isNull(), own), text_mark: F.xxhash64(whole(F.col(f"`{text}`")))}
    marked = docs.withColumns(marks)
    rows = marked.select(own.alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(id_mark).alias("~i"), F.col(text_mark).alias("~t"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "~t", "~i"))
    keepers = labelled(rows, width, bits).groupBy("root").agg(first.alias("k")).select(F.col("k.~i").alias(id_mark), F.col("k.~t").alias(text_mark))
    kept = marked.join(keepers.distinct(), [id_mark, text_mark], "left_semi")
    order = Window.partitionBy(id_mark, text_mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
