"""Quality classifier: a generalised additive model with pairwise interactions, grown by cyclic boosting.

Rounds go over the features in turn; each fits a tree of at most four leaves on that feature's bins to the
present gradient and adds it to the feature's lookup table. The strongest pairs then get tables of their
own, grown by trees with one cut on each axis. A score is the sum of table entries of a row's bins.

Features are counts over the whole text. The fit is bounded by ``SAMPLE`` labelled rows, chosen by a hash of
their ids; every document is scored.

Defined cases: null and empty texts have all features zero and a score; with labels of one kind only, or
none, the tables stay empty and every score is the smoothed share of ones; repeated documents are scored each; texts
of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import hashed_sample, whole, words
from larder.session import materialise

SAMPLE = 20_000
FEATURES = ("log_chars", "log_words", "word_size", "symbols", "bars", "bangs", "capitals", "distinct", "adjacent", "digits", "lines", "stops")
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 8, 8, 40
THRESHOLD = 0.3
#: Byte classes whose counts make the features.
CLASSES = (b"#$%&*<>", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", b".,;:?")


def class_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per row of consecutive byte runs: its bytes in each class."""
    out = np.zeros((len(ends) - 1, len(CLASSES)), np.int64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        body, at = data[ends[0] : ends[-1]], ends[:-1][full] - ends[0]
        for k, members in enumerate(CLASSES):
            table = np.zeros(256, np.uint8)
            table[list(members)] = 1
            out[full, k] = np.add.reduceat(table[body], at, dtype=np.int64)
    return out


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``x``, the features of the whole text."""
    keep = [c for c in docs.columns if c != text]
    own = [F.col(f"`{c}`") for c in keep]
    split = docs.select(*own, whole(F.col(f"`{text}`")).alias("~text"), words(whole(F.col(f"`{text}`"))).alias("~w"))
    same: Column = F.filter("~w", lambda w, i: w == F.get(F.col("~w"), i + 1))
    counted = split.select(*own, F.struct(F.char_length("~text").alias("chars"), F.size("~w").alias("n"), F.size(F.array_distinct("~w")).alias("distinct"), F.size(same).alias("adjacent")).alias("~c"), "~text")
    counted = counted.select(*own, "~c.chars", "~c.n", "~c.distinct", "~c.adjacent", "~text")
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k = len(keep)
            chars, n, distinct, adjacent = (batch.column(k + i).to_numpy(zero_copy_only=False).astype(float) for i in range(4))
            body = batch.column(k + 4).cast(pa.large_binary())
            ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1] if len(body) else np.zeros(1, np.int64)
            data = np.frombuffer(body.buffers()[2], np.uint8) if len(body) and body.buffers()[2] else np.zeros(0, np.uint8)
            c = class_counts(data, ends).astype(float)
            per_char, per_word = np.maximum(chars, 1), np.maximum(n, 1)
            x = np.column_stack([
                np.log1p(chars), np.log1p(n), (chars - n) / per_word, c[:, 0] / per_char, c[:, 1] / per_char, c[:, 2] / per_char, c[:, 3] / np.maximum(c[:, 3] + c[:, 4], 1),
                distinct / per_word, adjacent / per_word, c[:, 5] / per_char, c[:, 6] / per_char, c[:, 7] / per_char]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], lists], names=[*keep, "x"])

    return counted.mapInArrow(run, out)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> int | None:
    """The cut of ordered bins with the largest gain, as the first bin of the right side."""
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Leaf values per bin of a tree with at most two levels of cuts."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    first = _cut(g, h, ridge)
    if first is not None:
        for a, b in ((0, first), (first, len(g))):
            second = _cut(g[a:b], h[a:b], ridge)
            for lo, hi in ((a, b),) if second is None else ((a, a + second), (a + second, b)):
                out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 4.0) -> tuple[float, np.ndarray]:
    """The best table with one cut on each axis, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a = (cg[:-1, :-1], ch[:-1, :-1])
    b = (cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1])
    c = (cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1])
    d = (cg[-1, -1] - a[0] - b[0] - c[0], ch[-1, -1] - a[1] - b[1] - c[1])
    gain = sum(x**2 / (y + ridge) for x, y in (a, b, c, d))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    for part, rows, columns in ((a, slice(0, i + 1), slice(0, j + 1)), (b, slice(0, i + 1), slice(j + 1, None)), (c, slice(i + 1, None), slice(0, j + 1)), (d, slice(i + 1, None), slice(j + 1, None))):
        out[rows, columns] = part[0][i, j] / (part[1][i, j] + ridge)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


class Gam:
    """Bin edges, one table per feature, and tables of pairs."""

    def __init__(self, base: float, edges: list, tables: list, coarse: list, pairs: dict):
        self.base, self.edges, self.tables, self.coarse, self.pairs = base, edges, tables, coarse, pairs

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        wide = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for j in {j for pair in self.pairs for j in pair}}
        for (i, j), table in self.pairs.items():
            out += table[wide[i], wide[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Gam:
        share = (y.sum() + 0.5) / (len(y) + 1)
        base = float(np.log(share / (1 - share)))
        p = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(p)]
        coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(p)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        model = cls(base, edges, tables, coarse, {})
        if not 0 < y.sum() < len(y):
            return model
        bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(p)]
        f = np.full(len(y), base)
        for _ in range(ROUNDS):
            for j in range(p):
                q = 1 / (1 + np.exp(-f))
                step = RATE * _tree(np.bincount(bins[j], y - q, len(tables[j])), np.bincount(bins[j], q * (1 - q), len(tables[j])))
                tables[j] += step
                f += step[bins[j]]
        wide = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(p)]

        def grid(i, j):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            q, at = 1 / (1 + np.exp(-f)), wide[i] * shape[1] + wide[j]
            return np.bincount(at, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(at, q * (1 - q), shape[0] * shape[1]).reshape(shape)

        able = [(i, j) for i in range(p) for j in range(i) if len(coarse[i]) and len(coarse[j])]
        chosen = sorted(able, key=lambda ij: (-_quadrants(*grid(*ij))[0], ij))[:PAIRS]
        model.pairs = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                step = RATE * _quadrants(*grid(i, j))[1]
                model.pairs[i, j] += step
                f += step[wide[i], wide[j]]
        return model


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out ids are not learned from."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = materialise(features(slim).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))))
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("y")).filter("y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    learn = rows.filter(~F.col("held_out")).join(known, "doc_id").dropDuplicates(["doc_id"])
    taken = hashed_sample(learn.select("doc_id", "x", "y"), sample, learn.count(), "doc_id").collect()
    taken.sort(key=lambda r: r.doc_id)
    model = Gam.fit(np.array([r.x for r in taken], float).reshape(len(taken), len(FEATURES)), np.array([r.y > 0 for r in taken], float))
    out = T.StructType([*[rows.schema[c] for c in ("doc_id", "held_out")], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", "held_out", "x").mapInArrow(run, out)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
