"""Personal data by candidate gradient boosting, in DataFrame operations throughout.

High-recall generators propose spans, overlapping ones included: every raw match of the four base patterns,
whether it passes its check or not, and looser shapes (spelled-out addresses, numbers without a country
code, long hexadecimal addresses). Boosted trees judge each span by format and context features, and a
threshold per generator, calibrated on rows the trees have not seen, selects what is added. Base spans that
pass their check are always kept.

The trees learn from all candidates, and the thresholds are set on all that were held back; candidates that look
alike to them are counted, so that the training grows with what differs. ``sample`` names a number of candidates, chosen
by a hash, for a quick trial. Private are base spans that pass, what
overlaps one, and base spans rewritten into the loose form of their kind in the same context; base matches
that failed are not. A loose match elsewhere may be either: each weighs ``UNKNOWN``, and all together
at most as much of the private ones of their generator. The trees do not see the generator nor what the checks look at.

Positions are code points. A pattern's matches and the gaps between them are read in two passes of the same
pattern; running sums of their lengths are the positions.

Defined cases: null and empty texts have no spans; without candidates of both kinds of outcome nothing is
added; repeated documents are judged row by row; texts of any length are read whole; an empty table gives an empty
result; a result whose name the input has already is lengthened by an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.text import free_name, hashed_sample, shielded, whole
from larder.session import materialise, spread

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.97  # wanted of added base matches on the calibration rows
RECALL = 0.95  # wanted of loose forms of private spans on the calibration rows
UNKNOWN = 0.1  # weight of a loose match of unknown kind, and of all of a generator against its private ones
TREES, DEPTH = 8, 3
CONTEXT = 24  # characters before a span
SPAN = "struct<start:int,kind:int,end:int>"
FEATURES = ("kind", "generator", "size", "digits", "letters", "blanks", "dots", "dashes", "ats", "plus", "parens", "longest", "luhn", "small_parts", "after_word", "before_word", "line_start", "cue")
INPUTS = tuple(n for n in FEATURES if n not in ("generator", "digits", "luhn", "small_parts"))
CUES = r"(?i)(mail|phone|call|tel|fax|mobile|card|visa|account|server|host|addr|contact|\bip\b)[^\n]*$"


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind in texts that hold ``needs``; the first four are the base."""

    kind: str
    pattern: str
    needs: str


# The base patterns may only start where a longer run would not, or right after a match; and what cannot
# match otherwise is never given back. Both leave the matches as they are and keep the time linear.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Generator("card", r"[0-9](?:[\x20-]?+[0-9])++", ""),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    Generator("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+[\[(]at[\])] ?+[A-Za-z0-9-]++(?: ?+(?:[\[(]dot[\])]|\.) ?+[A-Za-z0-9-]++)++", "at"),
    Generator("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,7}+", ":"),
    Generator("phone", r"(?<![0-9])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9])", ""),
)
BASE = 4
LOOSE = {0: 4, 1: 5, 3: 6}  # the loose generator of a base one


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts doubled."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


SMALL_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def _passes(generator: int, match: Column) -> Column:
    """Whether a raw match of a base pattern is a span."""
    size = F.length(_digits(match))
    return {0: F.lit(True), 1: match.rlike(SMALL_PARTS), 2: F.when(size.between(14, 19), luhn(_digits(match))).otherwise(False), 3: size.between(10, 15)}.get(generator, F.lit(False))


def _proposals(text: Column, number: int) -> Column:
    """(start, match, before, after) of every match of a generator."""
    g = GENERATORS[number]
    pattern = F.lit(g.pattern)
    gaps, found = F.split(text, g.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size"), m.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before")))
    nexts = F.transform(F.slice(gaps, F.lit(2), F.size(found)), lambda gap: F.left(gap, F.lit(1)))
    start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,match:string,before:string>>)").alias("out"))
    placed = F.aggregate(both, start, lambda a, x: F.struct((a["end"] + x["gap"] + x["size"]).alias("end"), F.concat(a["out"], F.array(F.struct((a["end"] + x["gap"]).alias("start"), x["match"].alias("match"), x["before"].alias("before")))).alias("out")))["out"]
    listed = F.zip_with(placed, nexts, lambda p, after: F.struct(p["start"].alias("start"), F.lit(KINDS.index(g.kind)).alias("kind"), F.lit(number).alias("generator"), p["match"].alias("match"), p["before"].alias("before"), after.alias("after")))
    likely = text.contains(g.needs) if g.needs else F.lit(True)
    return F.when(likely & text.rlike(g.pattern), listed).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,generator:int,match:string,before:string,after:string>>)"))


def candidates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` without the text, a row key, and all proposals of the row; stored, as it is read several times."""
    key = free_name(docs, "row_key")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    body = docs.select(*keep, F.monotonically_increasing_id().alias(key), whole(F.col(f"`{text}`")).alias("~text"))
    body = body.withColumn("~any", F.col("~text").rlike("[0-9]") | F.col("~text").contains("@") | F.col("~text").contains("at"))
    found = F.concat(*[_proposals(F.col("~text"), k) for k in range(len(GENERATORS))])
    return materialise(body.select(*keep, key, F.xxhash64("~text").alias("~source"), F.when(F.col("~any"), found).otherwise(F.slice(found, 1, 0)).alias("~found"))), key


def described(rows: DataFrame) -> DataFrame:
    """Format and context features of exploded proposals ``c``, as doubles, with ``base``."""
    m, before = F.col("c.match"), F.col("c.before")
    digits = _digits(m)

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    base = F.lit(False)
    for k in range(BASE):
        base = F.when(F.col("c.generator") == k, _passes(k, m)).otherwise(base)
    made = {
        "kind": F.col("c.kind"), "generator": F.col("c.generator"), "size": F.length(m), "digits": F.length(digits), "letters": count("[A-Za-z]+"), "blanks": count("[ ]+"), "dots": count("[.]+"),
        "dashes": count("[-]+"), "ats": count("[@]+"), "plus": m.startswith("+"), "parens": count("[()]+"), "longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length)),
        "luhn": F.when(F.length(digits).between(2, 24), luhn(digits)).otherwise(False), "small_parts": m.rlike(SMALL_PARTS), "after_word": before.rlike(r"[\p{L}\p{N}]$"),
        "before_word": F.col("c.after").rlike(r"[\p{L}\p{N}]"), "line_start": before.rlike("\n$") | (F.col("c.start") == 0), "cue": before.rlike(CUES),
    }
    return rows.withColumns({"base": base, **{f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}})


def rewritten(c: Column) -> Column:
    """A passed base span ``c`` in the loose form of its kind, one of several by a hash; null for cards."""
    m, way = c["match"], F.pmod(F.xxhash64(F.lit("form"), c), F.lit(4))  # apart from the hash that deals out calibration rows

    def one_of(*ways: Column) -> Column:
        return F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])

    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    mail = [F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", " [dot] "))]
    groups = F.array_join(F.transform(F.split(m, "[.]"), lambda part: F.lower(F.hex(part.cast("long")))), ":")
    number = F.right(_digits(m), F.lit(10))
    parts = F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 4)
    phone = [F.concat(F.lit(a), parts[0], F.lit(b), parts[1], F.lit(d), parts[2]) for a, b, d in (("(", ") ", "-"), ("", "-", "-"), ("", " ", " "), ("", ".", "."))]
    match = F.when(c["generator"] == 0, one_of(*mail)).when(c["generator"] == 1, F.when(way < 2, groups).otherwise(F.concat(groups, F.lit(":"), groups))).when(c["generator"] == 3, one_of(*phone))
    number_of = F.lit(None).cast("int")
    for base, loose in LOOSE.items():
        number_of = F.when(c["generator"] == base, F.lit(loose)).otherwise(number_of)
    return F.when(match.isNotNull(), c.withField("match", match).withField("generator", number_of))


def examples(each: DataFrame, sample: int | None) -> DataFrame:
    """Training rows out of described candidates: ``unseen`` for calibration, label, whether it is ``sure``, the features, and how many candidates are alike (``n``)."""
    names = [f"f_{n}" for n in FEATURES]
    # A base span that begins up to a span's start and ends behind it, or begins inside it, has characters of it.
    order = Window.partitionBy("key").orderBy("span.start")
    reach = F.max(F.when(F.col("base"), F.col("span.end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("base"), F.col("span.start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    meets = F.coalesce(reach > F.col("span.start"), F.lit(False)) | F.coalesce(following < F.col("span.end"), F.lit(False))
    told = each.select("mark", "source", "key", "span", "base", "c", *names).withColumn("label", (F.col("base") | meets).cast("double"))
    if sample is not None:
        # By the proposal and its text, so the choice does not follow the layout of files.
        told = materialise(hashed_sample(told, sample, each.count(), "mark", "source"))
    loose = described(told.filter("base").select("mark", rewritten(F.col("c")).alias("c")).filter("c IS NOT NULL"))
    told = told.select("mark", "label", ((F.col("label") > 0) | (F.col("f_generator") < BASE)).alias("sure"), *names)
    every = told.unionByName(loose.select("mark", F.lit(1.0).alias("label"), F.lit(True).alias("sure"), *names))
    unseen = (F.pmod("mark", F.lit(4)) == 0).alias("unseen")  # calibration rows
    return materialise(every.select(unseen, "label", "sure", *names).groupBy("unseen", "label", "sure", *names).agg(F.count("*").cast("double").alias("n")))


def spans(docs: DataFrame, text: str = "text", sample: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` without the text, its row key, ``base`` and ``spans``: arrays of (start, kind, end) in order."""
    found, key = candidates(docs, text)
    each = materialise(described(found.select(F.col(key).alias("key"), F.col("~source").alias("source"), F.explode("~found").alias("c"))).select(
        "key", "source", "c", F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), (F.col("c.start") + F.char_length("c.match")).alias("end")).alias("span"), F.xxhash64("c").alias("mark"), "base", *[f"f_{n}" for n in FEATURES]))
    assembler = VectorAssembler(inputCols=[f"f_{n}" for n in INPUTS], outputCol="features")
    taken = examples(each, sample)
    fit, rest = taken.filter("NOT unseen"), taken.filter("unseen")
    yes = F.sum(F.col("label") * F.col("n"))
    kinds = fit.agg(F.coalesce(yes, F.lit(0.0)).alias("yes"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    added = None
    if 0 < kinds.yes < kinds.n:
        weight = F.lit(1.0)
        for r in fit.groupBy("f_generator").agg(yes.alias("yes"), F.sum(F.when(~F.col("sure"), F.col("n")).otherwise(0.0)).alias("unknown")).collect():
            if r.unknown:
                weight = F.when(~F.col("sure") & (F.col("f_generator") == r.f_generator), UNKNOWN * min(1.0, max(r.yes, 1.0) / r.unknown)).otherwise(weight)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1, minInstancesPerNode=5, weightCol="weight").fit(spread(assembler.transform(fit).select("features", "label", (weight * F.col("n")).alias("weight"))))
        judge = lambda df: model.transform(assembler.transform(df)).withColumn("p", vector_to_array("probability")[1])
        # Per base generator, the lowest score from which on the wanted share of calibration rows is right; what loose
        # matches of unknown kind are is not known, so per loose one the score that the wanted share of private rows has.
        tested = judge(rest).select("f_generator", F.round("p", 3).alias("p"), "label", "n").groupBy("f_generator", "p").agg(F.sum("n").alias("n"), yes.alias("yes")).collect()
        limits = {}
        for g in range(len(GENERATORS)):
            rows = sorted((r for r in tested if r.f_generator == g), key=lambda r: -r.p)
            n = yes = 0
            for r in rows:
                if g >= BASE and yes >= RECALL * sum(r.yes for r in rows):
                    break
                n, yes = n + r.n, yes + r.yes
                if g >= BASE or yes >= PRECISION * n:
                    limits[g] = r.p
        chosen = F.lit(False)
        for g, limit in limits.items():
            chosen = chosen | ((F.col("f_generator") == g) & (F.round("p", 3) >= max(limit, 0.5)))
        added = judge(each.filter(~F.col("base")).drop("c")).filter(chosen).select("key", "span")
    base = each.filter("base").select("key", "span", F.lit(True).alias("own"))
    all_spans = base if added is None else base.unionByName(added.withColumn("own", F.lit(False)))
    per_row = all_spans.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("own"), F.col("span")))).alias("base"), F.sort_array(F.array_distinct(F.collect_list("span"))).alias("spans"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    out = found.drop("~found", "~source").join(per_row.withColumnRenamed("key", key), key, "left")
    return out.withColumns({"base": F.coalesce("base", none), "spans": F.coalesce("spans", none)}), key


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@shielded("text")
def report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The other columns of ``docs``, counts of base spans per kind, their hash, and all spans."""
    out, key = spans(docs, text, **options)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return out.select(*keep, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A row is found again by its id and the hash of its text.
    """
    own = docs.withColumn("~hash", F.xxhash64(whole(F.col(f"`{text}`"))))
    slim = own.select(F.col(f"`{doc_id}`").alias("~id"), F.col("~hash"), F.col(f"`{text}`").alias("~body"))
    out, key = spans(slim, "~body", **options)
    marked = materialise(out.filter(F.size("spans") > 0).groupBy("~id", "~hash").agg(F.first("spans").alias("~spans")).withColumnsRenamed({"~id": "~id2", "~hash": "~hash2"}))
    body, names = F.col(f"`{text}`"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # Runs of overlapping spans: (kind, start, end), grown from left to right.
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    merged = F.aggregate("~spans", empty, lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.get(a, F.size(a) - 1)["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
        F.get(a, F.size(a) - 1)["start"].alias("start"), F.get(a, F.size(a) - 1)["kind"].alias("kind"), F.greatest(s["end"], F.get(a, F.size(a) - 1)["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))))
    joined = own.join(marked, own["~hash"].eqNullSafe(marked["~hash2"]) & own[doc_id].eqNullSafe(marked["~id2"]), "left").withColumn("~merged", merged)
    runs = F.col("~merged")
    pieces = F.transform(runs, lambda s, i: F.concat(F.substring(body, F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))), F.get(names, s["kind"])))
    tail = F.substring(body, F.get(runs, F.size(runs) - 1)["end"] + 1, F.char_length(body))
    clean = F.when(F.col("~spans").isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
