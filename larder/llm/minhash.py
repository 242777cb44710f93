"""MinHash near-dedup: bottom-k sketches from one hash function, exact Jaccard over word pairs.

A document's set holds the hashes of its distinct shingles; the k smallest are its sketch. Copies (equal sets)
become one node. Inverted lists of retained values propose pairs: a list is keyed by a run of neighbouring values
of a sketch, since single values of common shingles would give lists that grow with the corpus. Up to k values
similar sets always share a run, as the few values they do not share cannot break up the rest: of four values where
the union has 16 or more, of three or two in smaller unions. Larger sets use runs of three and must share three of
them, which similar ones fail to do with a probability near 1e-8 at the threshold itself and far less above it. The
union sketch then estimates the similarity, and exact counts on the full sets confirm every link.

A list never becomes all pairs of its members. Its most connected member leads it; every node is compared with its
best leader first, then with its other leaders where the component still differs. What is in one component needs no
further comparison. Members outside the leader's component are compared with the rest of a short list one by one; in a
long list only their differences from the leader are looked at: sets x and y that lie dx and dy values from it, but
at most t from each other, share (dx + dy - t) / 2 of those values, and as x is no link of the leader that is more than
half of dy. So they meet in lists of the rarest differences, where what both have left must still allow a link, and a
group of near copies costs a few pairs a member. A set that must share three runs leaves the two longest of its long lists.

Defined cases: a null or wordless text has the empty set, links with nothing and is its own component; one
word is one shingle; repeated rows share a set and hence a component; a null id never names a component unless
all ids of it are null; ``kept`` compares null-safely; long texts are read whole; an empty table gives an empty
result. Only the two named columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.simhash import components
from larder.llm.text import lower_ascii, whole, windows, words
from larder.session import materialise

SKETCH = 64  # retained values
SIMILARITY = 80  # per cent
SLACK = 30  # per cent points an estimate may lie below the threshold
#: The least union in which two sets that are 80 per cent alike share a run of so many neighbouring values: of u values at most u // 5 lie apart.
RUNS = {2: 5, 3: 6, 4: 16}
LONG_RUN, LONG_SHARED = 3, 3  # beyond the sketch: values in a run, runs that must be shared
FEW_PAIRS = 200  # pairs of a list that are compared one by one
NONE = "array<bigint>"


def shingle_set(w: Column, width: int) -> Column:
    """Sorted distinct hashes of the ``width``-word shingles; the whole sequence where there are fewer words."""
    n = F.size(w)
    each = windows(w, n, width, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(width)]))
    return F.sort_array(F.array_distinct(F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast(NONE))))


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``text`` replaced by ``set``; the words are a column of their own, so they are split once."""
    rest = [c for c in docs.columns if c != "text"]
    split = docs.select(*rest, words(lower_ascii(F.col("text"))).alias("w"))
    return split.select(*rest, shingle_set(F.col("w"), width).alias("set"))


def run_keys(sketch: Column, n: Column, k: int) -> Column:
    """The list keys of a sketch: hashes of runs of neighbouring values. Smaller sets than four values link with equal ones only."""
    size, most = F.size(sketch), F.floor(n * 100 / 80)  # the largest union with a similar set
    runs = lambda width: windows(sketch, size, width, lambda i: F.xxhash64(F.lit(width), *[F.get(sketch, i + (j - 1)) for j in range(width)]))
    upto = {2: RUNS[3] - 1, 3: RUNS[4] - 1, 4: k}  # the largest own size that may need the width
    needed = {width: (n <= upto[width]) & (most >= RUNS[width]) for width in RUNS}
    needed[LONG_RUN] = needed[LONG_RUN] | (most > k)
    return F.flatten(F.array(*[F.when(needed[width], runs(width)).otherwise(F.array().cast(NONE)) for width in RUNS]))


def similar_size(a: str, b: str, similarity: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def estimate(a: Column, b: Column, k: int) -> Column:
    """Per cent of the union sketch of two sketches that both hold. The one-row transform makes union and intersection once a pair."""
    both = F.struct(F.slice(F.sort_array(F.array_union(a, b)), 1, k).alias("union"), F.array_intersect(a, b).alias("common"))
    share = lambda r: F.size(F.filter(r["common"], lambda v: v <= F.element_at(r["union"], -1))) * 100 / F.size(r["union"])
    return F.get(F.transform(F.array(both), share), F.lit(0))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, similarity: int) -> DataFrame:
    """Those of ``pairs`` (x, y) that are links: sizes, union sketch, then the full sets."""
    printed = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    near = pairs.join(printed("x"), "x").join(printed("y"), "y").filter(similar_size("nx", "ny", similarity))
    near = materialise(near.filter(estimate(F.col("sx"), F.col("sy"), k) >= similarity - SLACK).select("x", "y", "nx", "ny"))
    full = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"f{s}"))
    # 100 * common >= similarity * (nx + ny - common), with the count written once.
    same = F.size(F.array_intersect("fx", "fy")) * (100 + similarity) >= (F.col("nx") + F.col("ny")) * similarity
    return near.join(full("x"), "x").join(full("y"), "y").filter(same).select(F.col("x").alias("a"), F.col("y").alias("b"))


def labelled(df: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of ``column``; a node without links is its own."""
    roots = label.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(roots, column, "left").withColumn(name, F.coalesce(name, column))


def differences(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (x, y) that may be links out of ``members`` (lead, node, root, outside): those with a rare difference from their leader in common."""
    sizes = nodes.select("node", "n")
    full = sets.join(sizes, "node")
    with_sets = members.join(full.select("node", F.col("n"), F.col("set")), "node").join(full.select(F.col("node").alias("lead"), F.col("n").alias("ln"), F.col("set").alias("ls")), "lead")
    apart = F.concat(F.array_except("set", "ls"), F.array_except("ls", "set"))
    f = (100 - similarity) / (100 + similarity)
    bounds = with_sets.select("lead", "node", "root", "outside", "n", "ln", apart.alias("apart")).withColumn("d", F.size("apart")).withColumns({
        "as_outside": F.col("d") - F.greatest(F.ceil((F.col("d") - f * (F.col("n") + F.col("ln"))) / 2 - 1e-9), F.lit(1)) + 1,
        "as_any": F.col("d") - F.floor((F.col("d") + f * (F.col("ln") - F.col("n"))) / 2 - 1e-9)})
    # The members of a leader come out of the join in one task; dealt anew, their differences spread over all tasks.
    each = bounds.repartition("lead", "node").select("lead", "node", "root", "outside", "n", "d", "as_outside", "as_any", F.explode("apart").alias("key"))
    each = each.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("lead", "key"))).filter("held > 1")
    total = Window.partitionBy("lead", "node")
    place = F.col("d") - F.count(F.lit(1)).over(total) + F.row_number().over(total.orderBy("held", "key"))  # values that one member has alone come first
    placed = materialise(each.withColumn("place", place).filter("place <= as_any OR (outside AND place <= as_outside)").drop("held"))
    left = placed.filter("outside AND place <= as_outside").select("lead", "key", F.col("node").alias("x"), F.col("root").alias("cx"), F.col("n").alias("nx"), (F.col("d") - F.col("place")).alias("rx"), F.col("d").alias("dx"))
    right = placed.filter("place <= as_any").select("lead", "key", F.col("node").alias("y"), F.col("root").alias("cy"), F.col("n").alias("ny"), (F.col("d") - F.col("place")).alias("ry"), F.col("d").alias("dy"))
    # At their first common value a pair can share that one and what either has left, so a link meets this there.
    enough = (F.least("rx", "ry") + 1) * 2 * (100 + similarity) >= (F.col("dx") + F.col("dy")) * (100 + similarity) - (F.col("nx") + F.col("ny")) * (100 - similarity)
    return left.join(right, ["lead", "key"]).filter((F.col("cx") != F.col("cy")) & similar_size("nx", "ny", similarity) & enough).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def links(nodes: DataFrame, sets_of, k: int = SKETCH, similarity: int = SIMILARITY, few: int = FEW_PAIRS) -> DataFrame:
    """Links (a, b) that connect exactly the similar ones of ``nodes`` (node, n, sketch); ``sets_of(frame of nodes)`` has their full sets."""
    listed = nodes.select("node", "n", F.explode(run_keys(F.col("sketch"), F.col("n"), k)).alias("key"))
    listed = materialise(listed.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("members > 1"))
    weight = listed.groupBy("node").agg(F.sum("members").alias("weight"))
    listed = materialise(listed.select("key", "node", "n").join(weight, "node"))
    sets = materialise(sets_of(listed.select("node").distinct()))
    leaders = listed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"), F.col("lead.weight").alias("lead_weight"))
    led = materialise(listed.join(leaders, "key").filter("node <> lead").groupBy(F.col("node").alias("x"), F.col("lead").alias("y")).agg(F.max("lead_weight").alias("weight")))

    first = led.groupBy("x").agg(F.max(F.struct("weight", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
    found = materialise(confirmed(first, nodes, sets, k, similarity))
    apart = labelled(labelled(led.select("x", "y"), label := components(found), "x", "cx"), label, "y", "cy").filter("cx <> cy").select("x", "y")
    found = materialise(found.union(confirmed(apart, nodes, sets, k, similarity)))

    # Whoever is outside its leader's component may be linked with another member.
    label = components(found)
    members = labelled(labelled(listed.select("key", "node", "n").join(leaders.select("key", "lead"), "key"), label, "node", "root"), label, "lead", "main")
    members = members.withColumn("outside", F.col("root") != F.col("main"))
    mixed = members.groupBy("key").agg((F.count_if("outside").cast("long") * F.count(F.lit(1))).alias("pairs"), F.count(F.lit(1)).alias("members")).filter("pairs > 0")
    # A set all of whose links share three lists does without its two longest of the long ones: the shortest that a link shares is kept by both.
    own = Window.partitionBy("node")
    mixed = members.join(mixed, "key").withColumn("long", F.col("pairs") > few)
    mixed = materialise(mixed.withColumns({"longs": F.count_if("long").over(own), "place": F.row_number().over(own.orderBy(F.desc("long"), F.desc("members"), F.desc("key")))}))
    short, long = mixed.filter("NOT long"), mixed.filter(F.col("long") & ((F.col("place") >= LONG_SHARED) | (F.col("n") * similarity <= 100 * k)))
    outside = short.filter("outside").select("key", F.col("node").alias("x"), F.col("root").alias("cx"), F.col("n").alias("nx"), F.col("longs").alias("lx"))
    every = short.select("key", F.col("node").alias("y"), F.col("root").alias("cy"), F.col("n").alias("ny"), F.col("longs").alias("ly"), "outside")
    # Both outside: the pair comes twice, once is enough.
    crossing = outside.join(every, "key").filter((F.col("cx") != F.col("cy")) & similar_size("nx", "ny", similarity) & (~F.col("outside") | (F.col("x") < F.col("y"))))
    # A pair that is kept in no long list meets in every short one it shares; two at most of the long ones are left out.
    crossing = crossing.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("nx", "ny")).alias("least"), F.min(F.least("lx", "ly")).alias("longs"))
    crossing = crossing.filter((F.col("shared") + F.least(F.col("longs"), F.lit(LONG_SHARED - 1)) >= LONG_SHARED) | (F.col("least") <= k)).select("x", "y")
    around = long.filter("node <> lead").select("lead", "node", "root", "outside").distinct()
    crossing = crossing.union(differences(around, nodes, sets, similarity)).distinct()
    tried = led.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return found.union(confirmed(crossing.join(tried, ["x", "y"], "left_anti"), nodes, sets, k, similarity))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, similarity: int = SIMILARITY, k: int = SKETCH, few: int = FEW_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (it is this row's id); one row per row."""
    if not 80 <= similarity <= 100:
        raise ValueError("runs of neighbouring values are shared for certain from 80 per cent on")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text"))
    marked = texts.withColumns({"p": F.xxhash64("text"), "q": F.xxhash64(F.lit(1), "text")})
    printed = with_sets(marked, width).select("doc_id", "p", "q", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("s"), F.xxhash64(F.lit(1), "set").alias("t"), F.slice("set", 1, k).alias("sketch"))
    printed = materialise(printed)
    # A node stands for the rows with one set; the row with the smallest id tells where to find its text.
    nodes = printed.filter("n > 0").groupBy("s", "t").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "p", "q")).alias("at"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        at = nodes.join(wanted, "node", "left_semi").select("node", *[F.col(f"at.{c}").alias(f"at_{c}") for c in ("doc_id", "p", "q")])
        here = marked.join(at, marked.doc_id.eqNullSafe(at.at_doc_id) & (marked.p == at.at_p) & (marked.q == at.at_q))
        return with_sets(here.groupBy("node").agg(F.min("text").alias("text")), width)

    rooted = labelled(nodes, components(links(nodes, sets_of, k, similarity, few)), "node", "root")
    rooted = materialise(rooted.select("s", "t", "root", "least"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "t", "component_id")
    full = printed.filter("n > 0").join(named, ["s", "t"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = printed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
