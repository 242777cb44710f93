"""Toxicity by classifier chains: linear models in sequence, each fed the probabilities of those before it.

Texts become counts of a learned vocabulary of words and word beginnings. A chain has one logistic model per
category; model k sees the vocabulary and the probabilities of categories 1 to k-1. For training these are
out-of-fold predictions, so a later model learns from probabilities as uncertain as those it will meet.

The labels know one kind, toxic. The earlier categories come from the labelled sample: a toxic document is openly
abusive if it holds one of the ``TELLING`` terms that set toxic documents of its language apart most, as counted in the
other folds, so no document names its own terms; it is veiled if it holds none. Languages only split that count; a score
reads nothing but the text.

Training is bounded by ``SAMPLE`` labelled documents, chosen by a hash of their ids, and by ``TERMS`` terms;
scoring reads every document, however long, whole.

Defined cases: null and empty texts have no terms; a category without both kinds of labels scores 0
everywhere, so that without positive labels nothing is rejected; labels that are null, or of unknown
documents, are left out; repeated labels of an id count by their largest value; repeated documents are
scored each; without the language column all documents count as of one language; an empty table gives an empty
result; a result whose name the input has already is lengthened by an underscore.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import free_name, hashed_sample, whole
from larder.session import materialise

SAMPLE = 12_000  # labelled documents a chain is fitted on
TERMS = 300  # terms of the vocabulary
LEAST = 4  # labelled documents a term must occur in
STARTS = (4, 5, 6, 7, 8)  # lengths of word beginnings
FOLDS = 4
CLEAN_LOSS = 0.002  # share of clean labelled documents that the threshold may reject, out of fold
TELLING, APART = 12, 3.0  # terms per language that make a toxic document an open one, and the gap they need, in deviations
CATEGORIES = ("open_abuse", "veiled_abuse", "toxic")


def letters(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}]+"), "")


def terms_of(words: Column) -> Column:
    """Distinct words, and beginnings of longer words marked by a star."""

    def starts(size: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.char_length(w) > size), lambda w: F.concat(F.substring(w, 1, size), F.lit("*")))

    return F.array_distinct(F.concat(words, *[starts(k) for k in STARTS]))


def gates_of(terms) -> frozenset:
    """The first letters of all terms: other words need no further look."""
    return frozenset(t.rstrip("*")[: STARTS[0]] for t in terms)


def vector(text: str, terms: dict[str, int], gates: frozenset) -> np.ndarray:
    """Logarithms of each term's occurrences, then of its occurrences per hundred words."""
    import regex

    found, words = np.zeros(len(terms), np.float32), regex.findall(r"\p{L}+", text.lower())
    for word in words:
        if word[: STARTS[0]] in gates:
            for term in (word, *(word[:size] + "*" for size in STARTS if size < len(word))):
                k = terms.get(term)
                if k is not None:
                    found[k] += 1
    return np.log1p(np.concatenate([found, found * (100 / max(len(words), 1))]))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 2.0) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic model, by accelerated descent along scaled gradients."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1], np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32) ** 0.5
    scale = 1 / (0.25 * (weight[:, None] * x * x).sum(0) * 6 + ridge)
    look, before = w, w
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * np.r_[look[:-1], 0].astype(np.float32)
        w = look - scale * gradient
        look, before = w + (k / (k + 3)) * (w - before), w
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """One model per category, in order."""

    def __init__(self, models: list, threshold: float):
        self.models, self.threshold = models, threshold

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.models)), np.float32)
        for k, w in enumerate(self.models):
            if w is not None:
                out[:, k] = probability(np.hstack([x, out[:, :k]]), w)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        """``labels`` has a column per category; the last one sets the threshold, out of fold."""
        models, blind = [], np.zeros(labels.shape, np.float32)
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(np.float32)
            if not 0 < y.sum() < len(y):
                models.append(None)
                continue
            full = np.hstack([x, blind[:, :k]])
            for f in range(FOLDS):
                out = fold == f
                if out.any() and 0 < y[~out].sum() < (~out).sum():
                    blind[out, k] = probability(full[out], logistic(full[~out], y[~out]))
            models.append(logistic(full, y))
        clean = blind[labels[:, -1] == 0, -1]
        threshold = max(0.5, float(np.quantile(clean, 1 - CLEAN_LOSS))) if len(clean) else 0.5
        return cls(models, min(threshold, 0.999))


def counted(labelled: DataFrame) -> DataFrame:
    """(lang, term) with the documents and toxic documents that hold it, over all and per fold."""
    by_fold = [agg for f in range(FOLDS) for agg in (F.count_if(F.col("fold") == f).alias(f"n{f}"), F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0)).alias(f"bad{f}"))]
    exploded = labelled.select("lang", "fold", "y", F.explode(terms_of(F.array_distinct("words"))).alias("term"))
    return exploded.groupBy("lang", "term").agg(F.count("*").alias("n"), F.sum("y").alias("bad"), *by_fold)


def gap(n: Column, bad: Column, share: Column) -> Column:
    """How many deviations more toxic documents hold a term than its frequency lets expect."""
    return (bad - n * share) / F.sqrt(n * share * (1 - share) + 1)


def telling_terms(each: DataFrame, labelled: DataFrame) -> dict[tuple, frozenset]:
    """Per (language, fold), the terms that tell toxic documents of the other folds apart; ``TELLING`` of each at most."""
    sizes = labelled.groupBy("lang").agg(*[F.count_if(F.col("fold") != f).alias(f"all{f}") for f in range(FOLDS)], *[F.sum(F.when(F.col("fold") != f, F.col("y")).otherwise(0)).alias(f"toxic{f}") for f in range(FOLDS)])
    joined = each.join(sizes, each.lang.eqNullSafe(sizes.lang)).drop(sizes.lang)
    rest = [(F.col("n") - F.col(f"n{f}"), F.col("bad") - F.col(f"bad{f}"), (F.col(f"toxic{f}") + 0.5) / (F.col(f"all{f}") + 1)) for f in range(FOLDS)]
    scores = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), n.alias("n"), gap(n, bad, share).alias("gap")) for f, (n, bad, share) in enumerate(rest)]))
    rows = joined.select("lang", "term", scores.alias("s")).filter((F.col("s.n") >= LEAST) & (F.col("s.gap") >= APART))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "s.fold").orderBy(F.col("s.gap").desc(), "term"))).filter(F.col("place") <= TELLING)
    found: dict[tuple, set] = {}
    for r in best.select("lang", "s.fold", "term").collect():
        found.setdefault((r["lang"], r["fold"]), set()).add(r["term"])
    return {key: frozenset(terms) for key, terms in found.items()}


def holds(text: str, telling: frozenset, gates: frozenset) -> bool:
    """Whether a text has one of the terms."""
    import regex

    near = (w for w in regex.findall(r"\p{L}+", text.lower()) if w[: STARTS[0]] in gates)
    return any(w in telling or any(size < len(w) and w[:size] + "*" in telling for size in STARTS) for w in near)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, lang: str = "lang") -> tuple[dict[str, int], Chain]:
    """The vocabulary and the fitted chain."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = hashed_sample(known, sample, known.count(), "id")
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), letters(F.col(f"`{text}`")).alias("words"), whole(F.col(f"`{text}`")).alias("text"), language.alias("lang"))
    # `chosen` has at most `sample` rows of two numbers. Of rows with one id the smallest text trains.
    labelled = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang", "words")).alias("d"))
    labelled = materialise(labelled.select("id", "y", "d.*", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")))
    each = materialise(counted(labelled))
    size = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    overall = each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= LEAST)
    best = overall.orderBy(gap(F.col("n"), F.col("bad"), (F.lit(size.bad) + 0.5) / F.lit(size.n + 1)).desc(), "term").limit(TERMS)
    telling = telling_terms(each, labelled)
    terms = {t: k for k, t in enumerate(dict.fromkeys([*sorted(frozenset().union(*telling.values())), *[r.term for r in best.collect()]]))}
    gates = gates_of(terms)

    def vectors(frames):
        import pandas as pd

        for got in frames:
            found = [vector(t, terms, gates) for t in got["text"]]
            own = [telling.get((None if pd.isna(g) else g, f), frozenset()) for g, f in zip(got["lang"], got["fold"])]
            seen = [holds(t, o, gates_of(o)) for t, o in zip(got["text"], own)]
            yield pd.DataFrame({"id": got["id"], "y": got["y"], "fold": got["fold"], "open": seen, "at": [np.flatnonzero(v) for v in found], "value": [v[v > 0] for v in found]})

    kind = labelled.schema["id"].dataType.simpleString()
    rows = labelled.select("id", "y", "fold", "lang", "text").mapInPandas(vectors, f"id {kind}, y int, fold int, open boolean, at array<int>, value array<float>").orderBy("id").collect()
    x = np.zeros((len(rows), 2 * len(terms)), np.float32)
    for k, r in enumerate(rows):
        x[k, r["at"]] = r["value"]
    y = np.array([r["y"] for r in rows], int)
    seen = np.array([r["open"] for r in rows], bool)
    fold = np.array([r["fold"] for r in rows], int)
    return terms, Chain.fit(x, np.column_stack([(y > 0) & seen, (y > 0) & ~seen, y > 0]) if len(rows) else np.zeros((0, 3), bool), fold)


def score(docs: DataFrame, terms: dict[str, int], chain: Chain, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The other columns of ``docs``, a probability per category and ``rejected``."""
    keep = [c for c in docs.columns if keep_text or c != text]
    gates = gates_of(terms)
    names = [free_name(docs, n) for n in (*[f"p_{c}" for c in CATEGORIES], "rejected")]
    out = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.DoubleType()) for n in names[:-1]], T.StructField(names[-1], T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = []
            for a in range(0, len(texts), 1024):
                x = np.stack([vector(t, terms, gates) for t in texts[a : a + 1024]])
                found.append(chain.predict(x))
            p = np.vstack(found) if found else np.zeros((0, len(CATEGORIES)))
            arrays = [*batch.columns[:-1], *[pa.array(p[:, k].astype(float)) for k in range(len(CATEGORIES))], pa.array(p[:, -1] > chain.threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    return docs.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{text}`")).alias("~text")).mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every document with its category probabilities and whether it is rejected."""
    terms, chain = train(docs, labels, doc_id, text, lang=lang)
    return score(docs, terms, chain, text)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rejected rows."""
    terms, chain = train(docs, labels, doc_id, text, lang=lang)
    rejected = free_name(docs, "rejected")
    return score(docs, terms, chain, text, keep_text=True).filter(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])
