"""Robust multivariate outliers: minimum covariance determinant per language and source.

Each document becomes a vector of transformed text statistics. For every (language, source) the half of
the rows with the smallest covariance determinant is sought by concentration steps from several starts,
the estimate is reweighted, and rows far from it by Mahalanobis distance are rejected.

One concentration step is one aggregation: squared distances under the present estimate fall into
fixed bins, counts and integer moments add up per (group, start, bin) on the map side, and running sums
over the bins of a group give the moments of its nearest half. A group that holds a third of all rows is
a few thousand partial sums, no rows are gathered, and integer moments make the result independent of
the order of rows.

Groups of fewer than ``min_group`` rows are judged together with the small groups of their language, and
small languages together. Null language or source is a value of its own.

A statistic that is the same in half of a group (most texts repeat no line) has no spread there that could
tell ordinary from far. Its spread is then taken from the group's own rows that are near by the other
statistics, at their 0.95 quantile, and squared it is added to the diagonal of the group's covariances. What
19 in 20 of these rows show is ordinary; ``FLOOR`` only keeps statistics without any spread invertible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.text import GAP, shielded, total, whole, windows, words
from larder.session import materialise

SYMBOLS = r"[#*$%&|<>]"
SCALE = 1000  # statistics are kept as integers of thousandths
#: Least standard deviation of each transformed statistic, for invertibility: of a share, 0.02 lets 1 % pass.
FLOOR = (0.01, 0.01, 0.02, 0.02, 0.02)
SHARES = (2, 3, 4)  # the statistics that are roots of a share, on one scale
NEAR = 2.5  # robust deviations within which a row is near
TAIL, TAIL_SD = (19, 20), 1.96  # quantile of the spread of a statistic that half of the rows share, in deviations
LIMIT = 60.0  # no transformed statistic lies beyond it
#: Chi-squared quantiles at five degrees of freedom (fixed values): median, 0.975 and 0.9999.
CHI_HALF, CHI_MOST, CHI_FAR = 4.3515, 12.8325, 25.7448
STARTS = ("spread", "signs", "ranks")
BINS = 64  # per unit of log distance


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    body, w, n = whole(F.col(f"`{text}`")), F.col("~w"), F.col("~n")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    base = docs.select(*keep, words(body).alias("~w"), F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).alias("n_symbols"), F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0).alias("~lines"))
    base = base.withColumn("~n", F.size(w))
    # Sorted by hash, equal windows stand side by side; their positions, sorted, cover min(3, step) words each.
    base = base.withColumn("~h", F.sort_array(windows(w, n, 3, lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))))
    h = F.col("~h")
    base = base.withColumn("~p", F.sort_array(F.transform(F.filter(h, lambda x, k: (x["h"] == F.get(h, k - 1)["h"]) | (x["h"] == F.get(h, k + 1)["h"])), lambda x: x["i"])))
    p = F.col("~p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return base.select(
        *keep, n.cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long"),
        (F.size("~lines") - F.size(F.array_distinct("~lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics on scales where ordinary documents are roughly symmetric, in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.least(F.col("n_dup_lines") / n, F.lit(1.0))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.round(F.least(c, F.lit(LIMIT)) * SCALE).cast("long") for c in raw]


def distance(x: list[Column], mean: list[Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution through a Cholesky factor."""
    z: list[Column] = []
    for j in range(len(x)):
        rest = total([x[j] - mean[j], *[-chol[j, k] * z[k] for k in range(j)]])
        z.append(rest / chol[j, j])
    return total([c * c for c in z])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(p) for k in range(j + 1)]


def _moments(p: int) -> list[Column]:
    """Integer sums over rows: count, each statistic, each product."""
    return [F.count("*").alias("n"), *[F.sum(f"x{j}").alias(f"s{j}") for j in range(p)], *[F.sum((F.col(f"x{j}") * F.col(f"x{k}")).cast("decimal(38,0)")).alias(f"q{j}_{k}") for j, k in _pairs(p)]]


def _estimate(sums: DataFrame, p: int, inflate: float, keys: list[str]) -> DataFrame:
    """Mean, Cholesky factor of the covariance times ``inflate`` with f{j} squared added, and its log determinant, per row of sums."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{j}").cast("double") / n for j in range(p)]
    frame = sums.select(*keys, *[(mean[j] / SCALE).alias(f"m{j}") for j in range(p)], *[
        ((F.col(f"q{j}_{k}").cast("double") / n - mean[j] * mean[k]) / (SCALE * SCALE) * inflate + (F.col(f"f{j}") * F.col(f"f{j}") if j == k else F.lit(0.0))).alias(f"c{j}_{k}") for j, k in _pairs(p)])
    for j, k in _pairs(p):  # row by row, each entry from those before it
        rest = total([F.col(f"c{j}_{k}"), *[-F.col(f"l{j}_{i}") * F.col(f"l{k}_{i}") for i in range(k)]])
        frame = frame.withColumn(f"l{j}_{k}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if j == k else rest / F.col(f"l{k}_{k}"))
    det = total([2 * F.log(F.col(f"l{j}_{j}")) for j in range(p)])
    return frame.select(*keys, *[f"m{j}" for j in range(p)], *[f"l{j}_{k}" for j, k in _pairs(p)], det.alias("logdet"))


def _distance(p: int) -> Column:
    return distance([F.col(f"x{j}") / SCALE for j in range(p)], [F.col(f"m{j}") for j in range(p)], {(j, k): F.col(f"l{j}_{k}") for j, k in _pairs(p)})


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * BINS).cast("int")


def _nearest_half(binned: DataFrame, p: int, keys: list[str]) -> DataFrame:
    """Moments of the nearest half of each group from its per-bin moments: whole bins up to the middle row."""
    names = [c for c in binned.columns if c not in (*keys, "bin")]
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = binned.select(*keys, "bin", *[F.sum(c).over(run).alias(c) for c in names], F.sum("n").over(Window.partitionBy(*keys)).alias("~all"))
    reached = upto.filter(F.col("n") * 2 >= F.col("~all"))
    return reached.groupBy(*keys).agg(F.min_by(F.struct(*names), "bin").alias("s")).select(*keys, "s.*")


def _quantile(table: DataFrame, value: str, name: str, share: tuple[int, int] = (1, 2)) -> DataFrame:
    """The least value per group and statistic up to which ``share`` of the ``n`` rows lie."""
    run = Window.partitionBy("g", "j").orderBy(value)
    marked = table.withColumns({"~upto": F.sum("n").over(run.rangeBetween(Window.unboundedPreceding, 0)), "~all": F.sum("n").over(Window.partitionBy("g", "j"))})
    return marked.filter(F.col("~upto") * share[1] >= F.col("~all") * share[0]).groupBy("g", "j").agg(F.min(value).alias(name))


def _starts(vectors: DataFrame, p: int) -> DataFrame:
    """Median m{j}, robust spread d{j} and floor f{j} of every statistic per group.

    Quantiles come from one histogram per group and statistic, so they are exact to a thousandth.
    """
    long = vectors.select("g", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("x")) for j in range(p)])).alias("v")).select("g", "v.*")
    hist = materialise(long.groupBy("g", "j", "x").agg(F.count("*").alias("n")))
    centre = _quantile(hist, "x", "centre")
    off = hist.join(centre, ["g", "j"]).withColumn("off", F.abs(F.col("x") - F.col("centre"))).groupBy("g", "j", "off").agg(F.sum("n").alias("n"))
    both = centre.join(_quantile(off, "off", "spread"), ["g", "j"])
    wide = materialise(both.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for c in ("centre", "spread") for j in range(p)]))
    # Statistics without a spread in half of the rows take it from the rows that the other statistics call near.
    offs = [F.abs(F.col(f"x{j}") - F.col(f"centre{j}")) for j in range(p)]
    near = vectors.join(wide.filter(F.least(*[F.col(f"spread{j}") for j in range(p)]) == 0), "g")
    for j in range(p):
        near = near.filter((F.col(f"spread{j}") == 0) | (offs[j] <= NEAR * 1.4826 * F.col(f"spread{j}")))
    flat = near.select("g", F.explode(F.filter(F.array(*[F.struct(F.lit(j).alias("j"), F.when(F.col(f"spread{j}") == 0, offs[j]).alias("off")) for j in range(p)]), lambda v: v["off"].isNotNull())).alias("v")).select("g", "v.*")
    tail = _quantile(flat.groupBy("g", "j", "off").agg(F.count("*").alias("n")), "off", "tail", TAIL)
    tails = tail.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col("tail") / (TAIL_SD * SCALE))).alias(f"t{j}") for j in range(p)])
    # A share is not held to less than half of what the most variable of the flat shares shows.
    most = F.greatest(F.lit(0.0), *[F.col(f"t{j}") for j in SHARES])
    floors = [F.greatest(F.lit(FLOOR[j]), F.col(f"t{j}"), *([F.when(F.col(f"t{j}").isNotNull(), most / 2)] if j in SHARES else [])) for j in range(p)]
    joined = wide.join(tails, "g", "left").select("*", *[f.alias(f"f{j}") for j, f in enumerate(floors)])
    return materialise(joined.select("g", *[(F.col(f"centre{j}") / SCALE).alias(f"m{j}") for j in range(p)], *[F.greatest(F.col(f"spread{j}") * 1.4826 / SCALE, F.col(f"f{j}")).alias(f"d{j}") for j in range(p)], *[f"f{j}" for j in range(p)]))


def _first_estimates(vectors: DataFrame, centre: DataFrame, p: int) -> DataFrame:
    z = [(F.col(f"x{j}") / SCALE - F.col(f"m{j}")) / F.col(f"d{j}") for j in range(p)]
    size = F.greatest(F.sqrt(total([c * c for c in z])), F.lit(1e-9))
    ways = {"spread": None, "signs": [c / size for c in z], "ranks": [F.tanh(c) for c in z]}
    scored = vectors.join(centre, "g")
    # Scores are rounded to integers as well, so their sums do not depend on the order of rows.
    cross = scored.groupBy("g").agg(*[F.sum(F.round(v[j] * v[k] * 10**6).cast("long")).alias(f"{name}{j}_{k}") for name, v in ways.items() if v for j, k in _pairs(p)])
    cross = cross.join(centre, "g")
    out = None
    for name, v in ways.items():
        frame = cross.select("g", F.lit(name).alias("start"), *[f"m{j}" for j in range(p)], *[
            ((F.lit(1.0 if j == k else 0.0) if v is None else F.col(f"{name}{j}_{k}") / F.sqrt(F.greatest(F.col(f"{name}{j}_{j}").cast("double") * F.col(f"{name}{k}_{k}"), F.lit(1.0))) * (1.0 if j == k else 0.95)) * F.col(f"d{j}") * F.col(f"d{k}") + F.lit(1e-6 if j == k else 0.0)).alias(f"c{j}_{k}") for j, k in _pairs(p)])
        for j, k in _pairs(p):
            rest = total([F.col(f"c{j}_{k}"), *[-F.col(f"l{j}_{i}") * F.col(f"l{k}_{i}") for i in range(k)]])
            frame = frame.withColumn(f"l{j}_{k}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if j == k else rest / F.col(f"l{k}_{k}"))
        frame = frame.select("g", "start", *[f"m{j}" for j in range(p)], *[f"l{j}_{k}" for j, k in _pairs(p)])
        out = frame if out is None else out.unionByName(frame)
    return materialise(out)


def mcd(vectors: DataFrame, p: int, first_steps: int = 2, more_steps: int = 4) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate per group ``g`` of integer vectors x0..x{p-1}.

    Every start takes ``first_steps`` concentration steps; the one with the smallest determinant in a
    group takes ``more_steps`` further ones.
    """
    centre = _starts(vectors, p)
    floors = centre.select("g", *[f"f{j}" for j in range(p)])
    now = _first_estimates(vectors, centre, p)
    for step in range(first_steps + more_steps):
        near = vectors.join(now.drop("logdet"), "g").withColumn("bin", _bin(_distance(p)))
        half = _nearest_half(near.groupBy("g", "start", "bin").agg(*_moments(p)), p, ["g", "start"])
        now = _estimate(half.join(floors, "g"), p, 1.0, ["g", "start"])
        if step == first_steps - 1:
            now = now.groupBy("g").agg(F.min_by(F.struct(*[c for c in now.columns if c != "g"]), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
        now = materialise(now)
    # Consistency at the normal model for the half, then one reweighting at the 0.975 quantile.
    half_factor, most_factor = 0.5 / _chi7(CHI_HALF), 0.975 / _chi7(CHI_MOST)
    inner = vectors.join(now.drop("logdet", "start"), "g").filter(_distance(p) <= CHI_MOST * half_factor)
    return materialise(_estimate(inner.groupBy("g").agg(*_moments(p)).join(floors, "g"), p, most_factor, ["g"]).drop("logdet"))


def _chi7(x: float) -> float:
    """Chi-squared distribution function at seven degrees of freedom, two more than the statistics."""
    h = x / 2
    return math.erf(math.sqrt(h)) - sum(h**a * math.exp(-h) / math.gamma(a + 1) for a in (0.5, 1.5, 2.5))


@shielded("text", "lang", "source")
def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = 200, far: float = CHI_FAR) -> DataFrame:
    """The other columns of ``docs``, its statistics, base_failed, the distance and kept.

    kept is false where base_failed, else whether the squared distance is at most ``far``. An empty table
    gives an empty result; equal rows get equal verdicts; an empty text has no words and fails the base; texts of any
    length are read whole; a result whose name the input has already is lengthened by an underscore.
    """
    stats = materialise(text_statistics(docs, text).withColumn("base_failed", base_failed()))
    lang_of, source_of = F.col(f"`{lang}`"), F.col(f"`{source}`")
    p = len(FLOOR)
    counts = stats.groupBy(lang_of.alias("~lang"), source_of.alias("~source")).agg(F.count("*").alias("~rows"))
    small = F.sum(F.when(F.col("~rows") < min_group, F.col("~rows"))).over(Window.partitionBy("~lang"))
    known = F.when(F.col("~rows") >= min_group, F.to_json(F.struct(F.lit(1).alias("k"), "~lang", "~source")))
    groups = materialise(counts.select("~lang", "~source", known.when(small >= min_group, F.to_json(F.struct(F.lit(2).alias("k"), "~lang"))).otherwise(F.lit("rest")).alias("g")))
    placed = stats.join(groups, lang_of.eqNullSafe(F.col("~lang")) & source_of.eqNullSafe(F.col("~source"))).drop("~lang", "~source")
    vectors = placed.select("*", *[c.alias(f"x{j}") for j, c in enumerate(transformed())])
    vectors = materialise(vectors)
    # Documents that fail the base rules are not what a group is estimated from.
    fit = mcd(vectors.filter(~F.col("base_failed")).select("g", *[f"x{j}" for j in range(p)]), p)
    judged = vectors.join(fit, "g", "left").withColumn("distance", _distance(p))
    keep = ~F.col("base_failed") & F.coalesce(F.col("distance") <= far, F.lit(True))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", keep.alias("kept"))
