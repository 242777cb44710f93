"""Periodic runs, MinHash components and ns-bounds against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import minhash, ns_kmeans, pii, queries, runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


# -- periodic runs ---------------------------------------------------------------------------------------


def plain_runs(words, least=24, fold=3):
    """Every period on its own: stretches of equal words at that distance, smallest period first."""
    found = {}
    for q in range(1, len(words) // fold + 1):
        equal = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        begin = None
        for i, same in enumerate(equal):
            if same and begin is None:
                begin = i
            if not same and begin is not None:
                length = i + q - begin
                if length >= max(least, fold * q):
                    found.setdefault((begin, length), q)
                begin = None
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tailed(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_texts():
    rng = random.Random(5)
    some = lambda k, n: [rng.choice("abcdefghijklmnop"[:k]) for _ in range(n)]
    texts = ["a " * n for n in (1, 23, 24, 25, 400)]
    texts += [" ".join(some(2, n)) for n in (30, 60, 200)] + [" ".join(some(1, 40) + ["x"] + some(1, 40))]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = some(rng.randint(1, 14), rng.randint(1, 40))
            repeated = unit * rng.randint(1, 7)
            parts += some(14, rng.randint(0, 30)) + repeated + unit[: rng.randint(0, len(unit))]
            if rng.random() < 0.3 and parts:
                parts[rng.randrange(len(parts))] = "zz"
        texts.append(rng.choice(["  ", "\n", " \t"]).join(parts))
    block = some(14, 700)
    texts += [" ".join(block * 4 + some(14, 50)), " ".join((["a"] * 50 + ["b"]) * 9), "é \x1c\x85 é \x1c\x85 " * 20, "  " * 30]
    return texts


def test_runs_of_all_kinds():
    texts = run_texts()
    found, kept = runs.analysed(pa.array(texts), 24, 3)
    for text, got, left in zip(texts, found.to_pylist(), kept.to_pylist()):
        words = WORD.findall(text)
        expected = plain_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in got] == expected
        assert left == collapsed(words, expected)


def test_transform_finds_the_sum_of_squared_differences():
    rng = np.random.default_rng(3)
    t = rng.integers(0, 1 << 20, 4000)
    squares = np.concatenate([[0], np.cumsum((t * t % runs.PRIME).astype(np.uint64))]).astype(np.uint64)
    for size in (8, 64, 256):
        at = np.array([0, size, 5 * size])
        got = runs.differences(t, squares, at, size, size, runs.Transform(2 * size))
        for row, b in zip(got, at):
            assert [int(v) for v in row] == [int(((t[b : b + size] - t[b + size + k : b + 2 * size + k]) ** 2).sum()) % runs.PRIME for k in range(size)]


def test_false_proposals_are_refused():
    t = np.array([1, 2] * 20 + [9] + [1, 2] * 20)
    assert runs.confirmed(t, np.array([0]), np.array([81]), np.array([2]), 24, 3).T.tolist() == [[0, 40, 2], [41, 81, 2]]


def test_long_periodic_texts_stay_fast():
    words = ("a " * 60_000 + "b ") * 3
    found, kept = runs.analysed(pa.array([words]), 24, 3)
    assert [tuple(r.values()) for r in found.to_pylist()[0]] == [(0, 60000, 1), (0, 180003, 60001), (60001, 60000, 1), (120002, 60000, 1)]
    assert kept[0].as_py() == "a b"


def test_periodic_query(spark, odd, docs, tmp_path):
    table = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    expected, seen = [], {}
    for doc_id, text in table.collect():
        words = tailed(doc_id, text)
        if (key := tuple(words)) not in seen:
            seen[key] = [(0, len(words), 1)] if len(words) > 50_000 else plain_runs(words)  # the long text is one word
        found = seen[key]
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc_id, len(found), *best, found and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapsed(words, found))))
    assert got == sorted(expected, key=repr)


def test_runs_of_an_empty_table(none):
    assert runs.find_runs(none).collect() == []


# -- MinHash ---------------------------------------------------------------------------------------------


def plain_components(rows, similarity=80):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append(set(zip(words, words[1:])) if len(words) > 1 else set(words))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        near = {j for v in s for j in at.get(v, ())}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= similarity * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
        for v in s:
            at.setdefault(v, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i))
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def near_texts():
    """Small sets at the threshold, chains, a hub with copies that are near the hub only, a common passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows, doc_id = [], 0

    def add(words):
        nonlocal doc_id
        rows.append((doc_id, " ".join(words)))
        doc_id += 1

    for size in range(1, 16):
        for _ in range(12):
            base = [word() for _ in range(size)]
            add(base)
            add(base + [word()])
            add([word()] + base)
    hub = [word() for _ in range(300)]
    add(hub)
    for _ in range(60):
        copy = list(hub)
        for k in rng.sample(range(1, 299), 14):
            copy[k] = word()
        add(copy)
    other = [word() for _ in range(150)]  # copies that lie just outside the hub, some of them alike
    add(other)
    for k in range(40):
        copy = list(other)
        for at in rng.sample(range(1, 149), 14 + k % 5):
            copy[at] = word()
        add(copy)
        if k % 4 == 0:
            copy[rng.randrange(1, 149)] = word()
            add(copy)
    chain = [word() for _ in range(200)]
    for _ in range(40):
        chain = chain[6:] + [word() for _ in range(6)]
        add(chain)
    passage = [word() for _ in range(80)]
    for _ in range(50):
        add(passage + [word() for _ in range(rng.randint(15, 60))])
    rng.shuffle(rows)
    return rows


def test_similar_sets_always_share_a_run():
    """The widths of the lists against the worst places for the values that two sets do not share."""
    for union in range(5, 400):
        apart = union // 5
        longest = -(-(union - apart) // (apart + 1))
        width = max(w for w, least in minhash.RUNS.items() if union >= least)
        assert longest >= width


@pytest.mark.parametrize("few", [10**9, 0])
def test_components(spark, few):
    """Pairs outside a leader's component, compared one by one or by their differences from the leader."""
    rows = near_texts()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), few=few)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(rows)


def test_components_of_documents(docs, odd):
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id is null or doc_id <> 6"))
    got = minhash.near_duplicates(table.withColumn("component_id", F.lit(1)).withColumn("n", F.lit("x")))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components([tuple(r) for r in table.collect()])


def test_components_of_odd_rows(spark, none):
    assert minhash.near_duplicates(none).collect() == []
    rows = [(None, "p q r"), (None, "P q  r"), (3, None), (4, ""), (5, "one"), (5, "one"), (6, "ONE"), (5, "un like"), (7, "w " * 200_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 2, None, True), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (5, 1, 5, True), (7, 1, 7, True)], key=repr)
    with pytest.raises(ValueError):
        minhash.near_duplicates(none, similarity=70)


# -- ns-bounds -------------------------------------------------------------------------------------------


def plain_clusters(x, ids, k, rounds):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), tuple(x[i])))
    centroids = np.array([x[i] for i in order[:k]])
    nearest = lambda: ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        cluster = nearest().argmin(axis=1)
        centroids = np.array([x[cluster == j].sum(axis=0) // (cluster == j).sum() if (cluster == j).any() else centroids[j] for j in range(len(centroids))])
    d = nearest()
    return d.argmin(axis=1), d.min(axis=1), centroids


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (300, 6)), rng.normal(2, 0.4, (200, 6)), np.repeat(rng.normal(1, 1, (3, 6)), 40, axis=0), rng.integers(-2, 2, (80, 6)) / 2])
    ids = [int(i) for i in range(len(x))]
    rows = [(i, [float(v) for v in r], 5) for i, r in zip(ids, x)]
    odd = [(9001, None, 0), (9002, [1.0] * 5, 0), (9003, [1.0] * 5 + [None], 0), (9004, [1.0] * 5 + [float("nan")], 0), (9005, [float("inf")] + [1.0] * 5, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, cluster int")
    got = {r["vec_id"]: r for r in ns_kmeans.inertia(ns_kmeans.cluster(df, dims=6, k=7, rounds=6)).collect()}
    cluster, distance, centroids = plain_clusters(np.floor(x * 1024).astype(np.int64), ids, 7, 6)
    assert sorted(got) == ids
    for i in ids:
        assert (got[i]["cluster"], got[i]["distance"], got[i]["centroid"]) == (cluster[i], distance[i], centroids[cluster[i]].tolist())
        assert got[i]["inertia"] == distance.sum() and got[i]["cluster_inertia"] == distance[cluster == cluster[i]].sum()


def test_bounds_spare_distances_and_stay_exact():
    """Over rounds of moving centroids the assignment equals a full scan and most distances are never counted."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-50, 50, (400, 8)) + 900 * c for c in range(6)])
    history = np.array([[x[i * 400] for i in range(6)]])
    cluster, counted, since, cost = np.full(len(x), -1, np.int32), np.zeros((len(x), 6), np.int64), np.zeros((len(x), 6), np.int32), []
    for turn in range(8):
        cost.append(ns_kmeans.assign(x, cluster, counted, since, history, every=turn == 7))
        full = ((x[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all()
        if turn == 7:
            assert (counted[np.arange(len(x)), cluster] == full.min(axis=1)).all()
        history = np.concatenate([history, [[x[cluster == j].sum(axis=0) // (cluster == j).sum() for j in range(6)]]])
    assert cost[0] >= 6 * len(x) and max(cost[2:7]) < len(x) // 2


def test_displacement_is_of_the_whole_way():
    there_and_back = np.array([[[0, 0]], [[30, 40]], [[0, 0]]])
    assert ns_kmeans.displacement(there_and_back).ravel().tolist() == [0.0, 50.0, 0.0]


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-0.5, 0.25])], "vec_id bigint, embedding array<float>")
    got = ns_kmeans.cluster(two, dims=2, k=8, rounds=3).collect()
    assert sorted(r["distance"] for r in got) == [0, 0, 0] and [-512, 256] in [r["x"] for r in got]
    assert ns_kmeans.inertia(ns_kmeans.cluster(two.limit(0), dims=2)).collect() == []
    with pytest.raises(Exception, match="or more"):
        ns_kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>"), dims=2).collect()


def test_personal_data_is_learnt_from_every_candidate(spark):
    """No candidate is left out of training and calibration, and a private one is any that shares characters with a base span."""
    texts = ["call 201-555-0123 or +1 201 555 0123, not 4111 1111 1111 1112" + " or 301 555 0199" * (k % 5) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, key = pii.candidates(docs)
    each = pii.described(found.select(F.col(key).alias("key"), F.col("~source").alias("source"), F.explode("~found").alias("c"))).select(
        "key", "source", "c", F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), (F.col("c.start") + F.char_length("c.match")).alias("end")).alias("span"), F.xxhash64("c").alias("mark"), "base", *[f"f_{n}" for n in pii.FEATURES])
    rows = pii.examples(each, None)
    spans = [r.asDict(True) for r in each.select("key", "span", "base").collect()]
    own = [(s["key"], s["span"]["start"], s["span"]["end"]) for s in spans if s["base"]]
    private = sum(s["base"] or any(k == s["key"] and a < s["span"]["end"] and s["span"]["start"] < b for k, a, b in own) for s in spans)
    loose = each.filter("base AND f_generator IN (0, 1, 3)").count()
    assert rows.agg(F.sum("n")).first()[0] == len(spans) + loose and rows.filter("unseen").count()
    assert rows.agg(F.sum(F.col("n") * F.col("label"))).first()[0] == private + loose


def test_chunks_are_not_shuffled_to_meet_their_positions(spark):
    """With a text far beyond the broadcast limit, the positions still join where the chunks lie."""
    import random

    import public_tokenizers

    from larder.llm import bytebpe

    dice = random.Random(5)
    texts = ["".join(dice.choice("abcdefghij klmnop qrstuv wxyz 0123456789 .,") for _ in range(120_000)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
        found = bytebpe.encode(docs, path, public_tokenizers.PATTERN, step=3_000, overlap=300)
        plan = found._jdf.queryExecution().executedPlan().toString()
        ids = {r["doc_id"]: r["ids"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with open(path, "rb") as file:
        codec = bytebpe.Codec(file.read(), public_tokenizers.PATTERN)
    assert ids == {i: codec.encode(t) for i, t in enumerate(texts)}
    assert "SortMergeJoin" not in plan


def test_differences_propose_what_may_still_be_a_link(spark):
    """Near members hold four values their leader lacks; members far off hold them too, but lie too far apart to be links."""
    rng = random.Random(4)
    lead = list(range(150))
    hot = [1_000, 1_001, 1_002, 1_003]
    sets = {0: lead} | {k: sorted({*lead, *hot, 2_000 + k}) for k in range(1, 41)}
    for k in range(41, 81):
        sets[k] = sorted({*rng.sample(lead, 110), *hot, *(10_000 + 100 * k + j for j in range(40))})
    sets[81] = sorted({*sets[80]} - {min(sets[80])})
    members = [(0, k, 0 if k < 41 else k, k > 40) for k in sets if k]
    nodes = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "node bigint, n int")
    full = spark.createDataFrame([(k, s) for k, s in sets.items()], "node bigint, set array<bigint>")
    pairs = {tuple(r) for r in minhash.differences(spark.createDataFrame(members, "lead bigint, node bigint, root bigint, outside boolean"), nodes, full, 80).collect()}
    like = lambda a, b: 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})
    wanted = {(x, y) for x in sets for y in sets if 0 < x < y and y > 40 and like(sets[x], sets[y])}
    assert wanted and wanted <= pairs and len(pairs) < 40
