"""Operators on documents against plain Python."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import bytebpe, decontaminate, outliers, pii, repair, simhash
from larder.session import scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
ITEM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pairs(*frames):
    return [(r["doc_id"], r["text"]) for f in frames for r in f.select("doc_id", "text").collect()]


def same(df, expected):
    assert sorted(map(repr, df)) == sorted(map(repr, expected))


# -- quality rules ---------------------------------------------------------------------------------------


def statistics(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics(odd, docs):
    got = outliers.text_statistics(odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))).collect()
    same([tuple(r) for r in got], [(i, *statistics(t)) for i, t in pairs(odd, docs)])


def test_planted_outliers_and_clean_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(80, 400)), "en", "a" if i % 3 else "b") for i in range(1200)]
    rows += [(5000 + i, " ".join(w + "###$$$" for w in text(150).split()), "en", "a") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[5000 + i] for i in range(40))
    assert sum(got[i] for i in range(1200)) >= 1197


def test_bars_after_every_word_are_far(spark):
    """A statistic that is 0 in most texts takes its spread from the group, not from a constant."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(80, 400))), "en", "a") for i in range(900)]
    for i in range(900, 1000):  # ordinary texts that repeat a passage
        w = text(rng.randint(100, 300))
        rows.append((i, " ".join(w + w[:10]), "en", "a"))
    rows += [(5000 + i, " | ".join(text(120)), "en", "a") for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[5000 + i] for i in range(30))
    assert sum(got[i] for i in range(1000)) >= 995


def test_estimate_is_the_concentrated_half(spark):
    """After the last step, the kept half is the nearest half of its own estimate."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(3, 0.5, (400, 5)), rng.normal(9, 0.3, (120, 5))])
    rows = [("g", *[int(v * 1000) for v in r]) for r in x]
    fit = outliers.mcd(spark.createDataFrame(rows, "g string, " + ", ".join(f"x{j} bigint" for j in range(5))), 5).first()
    assert all(abs(fit[f"m{j}"] - 3) < 0.15 for j in range(5))


def test_quality_rules_odd(odd, none):
    assert outliers.quality_rules(odd).count() == odd.count()
    assert outliers.quality_rules(none).count() == 0


# -- personal data ---------------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    def passes(kind, m):
        digits = re.sub(r"\D", "", m, flags=re.A)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, pattern) in enumerate(BASE) for m in re.finditer(pattern, text or "") if passes(kind, m[0]))


def spell(spans):
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)


def private_texts():
    rng = random.Random(7)
    bits = ["a@b.c", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12", "+1 2 3 4 5 6 7 8 9 0",
            "é🙂", " ", "\n", "x", ".", "@", "+", "-", "9", "me [at] host [dot] org", "me(at)host.org", "fe80:0:0:1:2", "555 123 4567", "name%x@host-1.example.com.", "1234567890123"]
    return [(100 + k, "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 14)))) for k in range(250)]


def test_base_spans(spark, odd):
    rows = private_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    for r in pii.report(df.withColumn("body", F.col("text"))).collect():
        expected = base_spans(r["body"])
        assert r["base_sha256"] == hashlib.sha256(spell(expected).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in expected) for k in range(4)]
        assert {s for s in spell(expected).split(",") if s} <= set(r["spans"].split(","))


def test_redaction(spark):
    rows = [*private_texts(), (1, None), (2, "nothing here"), (2, "nothing here")]
    got = pii.redact(spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, base bigint")).collect()
    assert len(got) == len(rows)
    for r in got:
        before = next(t for i, t in rows if i == r["doc_id"])
        assert (r["text"] is None) == (before is None)
        assert not any(before[a:b] in r["text"] for a, k, b in base_spans(before) if k < 1)
        if before is not None and not re.search(r"[0-9@]|at", before):
            assert r["text"] == before


def test_loose_forms_are_added(spark):
    """Spelled-out addresses and numbers go although the sample holds them; numbers of a table stay."""
    rng = random.Random(11)
    pick = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted, plain = [], [], []
    for k in range(1500):
        rows.append((k, f"{pick(6)} mail {pick(5)}@{pick(5)}.org or call +1 (2{digits(2)}) {digits(3)}-{digits(4)} {pick(5)}, ref {digits(7)} and 300.{digits(2)}.1.1 {pick(4)}"))
    for k in range(1500, 1800):
        planted.append((k, f"{pick(5)} [at] {pick(5)} [dot] org", f"(2{digits(2)}) {digits(3)}-{digits(4)}"))
        rows.append((k, f"{pick(6)} mail {planted[-1][1]} or call {planted[-1][2]} {pick(5)}"))
    for k in range(1800, 2400):
        plain.append((k, f"{digits(2)} {digits(3)} {digits(3)}"))
        rows.append((k, f"{pick(6)}\n{plain[-1][1]}\n{pick(5)}"))
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert np.mean([mail not in got[k] for k, mail, _ in planted]) >= 0.9
    assert np.mean([phone not in got[k] for k, _, phone in planted]) >= 0.9
    assert np.mean([number in got[k] for k, number in plain]) >= 0.9


def test_long_runs_take_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 300_000), (3, "a@" + "b." * 100_000), (4, "+1" + " " * 200_000)], "doc_id bigint, text string")
    assert pii.report(df).count() == 4


# -- decontamination -------------------------------------------------------------------------------------


def contaminated(rows, items, width=10):
    known = {}
    for i, t in items:
        w = ITEM.findall((t or "").translate(LOWER))
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            known.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes = {len(k) for k in known}
    out = []
    for i, t in rows:
        w, hit, found = ITEM.findall((t or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaks(spark):
    items = [(1, "one two three"), (2, "Two three four FIVE six seven eight nine ten eleven"), (2, "Two three four FIVE six seven eight nine ten eleven"), (3, None), (4, ""), (5, "école Été"), (6, "one two three"), (None, "été")]
    texts = [(10, "zero one, two - three! four five six seven eight nine ten eleven twelve"), (11, "école Été"), (12, "école été"), (13, "one two four"), (14, "x" + "one two three"), (15, "three one two three one two three")]
    return spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(texts, "doc_id bigint, text string"), items, texts


@pytest.mark.parametrize("set_windows", [200_000, 1])
def test_contamination(leaks, odd, set_windows):
    bench, texts, items, rows = leaks
    df = texts.unionByName(odd.select("doc_id", "text"))
    got = decontaminate.contamination(df, bench, set_windows=set_windows).collect()
    same([tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got], contaminated(pairs(df), items))


def test_removal(leaks, odd):
    bench, texts, items, rows = leaks
    df = texts.unionByName(odd.select("doc_id", "text"))
    bad = {r[0] for r in contaminated(pairs(df), items) if r[-1]}
    same([tuple(r) for r in decontaminate.decontaminate(df, bench).collect()], [p for p in pairs(df) if p[0] not in bad])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert cut[10] == "zero twelve" and cut[13] == "one two four" and cut[11] == ""
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0


# -- near copies -----------------------------------------------------------------------------------------


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    counts = Counter(b for p in parts for b in _bits(p))
    return sum(1 << b for b, n in counts.items() if 2 * n > len(parts))


def _bits(part, memo={}):  # noqa: B006
    if part not in memo:
        h = xxhash.xxh64_intdigest(part, 42)
        memo[part] = [b for b in range(64) if h >> b & 1]
    return memo[part]


def reached(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_near_copies(spark, odd, docs):
    rng = random.Random(2)
    base = [rng.choice("the of and to in red blue green tree house".split()) + str(rng.randint(0, 50)) for _ in range(400)]
    near = [(1000 + k, " ".join(w if rng.random() > 0.004 else "changed" for w in base)) for k in range(120)]
    df = spark.createDataFrame(near, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text")).unionByName(docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = [(i, fingerprint(t)) for i, t in pairs(df)]
    root = reached({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = simhash.near_duplicates(df).collect()
    same([tuple(r) for r in got], [(i, f"{f:016x}", least.get(root[f])) for i, f in rows])
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(least.values()) and kept.count(None) == 1


def test_one_id_with_unlike_texts(spark):
    """Only near copies go: an id's other texts stay, and rows without an id go where a copy has one."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "x y z", "a"), (1, "x y z", "b"), (1, "other words here entirely", "c"), (2, long, "d"), (None, long, "e"), (None, "alone without an id", "f"), (None, "alone without an id", "f"), (3, "x y z", "g")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, text_hash string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "alone without an id"), (1, "other words here entirely"), (1, "x y z"), (2, long)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "text_hash"}


def test_small_shards_lose_no_link(spark):
    """Many tiny shards and a dense ball: the same components as all pairs."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"), shard=40, sample=200)
    label = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    root = reached(prints)
    groups, expected = {}, {}
    for f, (s,) in zip(prints, signed):
        groups.setdefault(label.get(s, s), set()).add(f)
        expected.setdefault(root[f], set()).add(f)
    same(map(sorted, groups.values()), map(sorted, expected.values()))


def test_long_chain_of_links(spark):
    chain = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert simhash.components(chain).select("root").distinct().count() == 1


def test_near_copies_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# -- token ids -------------------------------------------------------------------------------------------


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, odd, docs):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    expected = []
    e = encoding()
    for i, t in pairs(df):
        ids = e.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same([tuple(r) for r in bytebpe.encode(df, RANKS, PATTERN, digest=True).collect()], expected)
    chunked = bytebpe.encode(df, RANKS, PATTERN, step=700, overlap=20)
    back = bytebpe.decode(chunked, RANKS, PATTERN).collect()
    same([(r["doc_id"], bytes(r["bytes"])) for r in back], [(i, (t or "").encode()) for i, t in pairs(df)])


def test_chunks_of_one_text_are_encoded_apart(spark, none):
    """Ids of long texts equal the library's, whether chunks meet or one pre-token spans them; clashing columns stay."""
    rng, e = random.Random(6), encoding()
    words = ["the", "naïve", "x1", "  ", "\n\n", "don't", "🙂🙂", "中文", "!!!", "3.14", "\t"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (400, 701, 3000)] + ["y" * 2500, "a b " * 300 + "z" * 1500 + " c d" * 300, "é" * 700 + "ab", " " * 1500, "k " * 350 + "qq"]
    df = spark.createDataFrame([(k, t, "kept", k) for k, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    got = bytebpe.encode(df, RANKS, PATTERN, step=700, overlap=20)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_"]
    assert {r["doc_id"]: (list(r["ids_"]), r["ids"], r["n_tokens"]) for r in got.collect()} == {k: (e.encode_ordinary(t), "kept", k) for k, t in enumerate(texts)}
    assert bytebpe.encode(none, RANKS, PATTERN, digest=True).count() == 0


def test_long_texts_take_linear_time():
    """Stitching and meeting four times the text takes about four times as long."""
    codec, took = bytebpe.Codec(open(RANKS, "rb").read(), PATTERN), []
    for size in (1 << 20, 1 << 22):
        text = ("some words 12 and more, " * (size // 24 + 1))[:size]
        begin = time.process_time()
        chunks = [(o, text[o : o + 24_512], codec.starts(text[o : o + 24_512], o, o + 24_512 >= size)) for o in range(0, size, 24_000) if not o or size - o > 512]
        assert "".join(codec.stitch(chunks)) == text
        took.append(time.process_time() - begin)
    assert took[1] <= 6 * took[0] + 0.5


def test_stitching_equals_whole_text():
    codec, e, rng = bytebpe.Codec(open(RANKS, "rb").read(), PATTERN), encoding(), random.Random(1)
    signs = ["a", "b", " ", "  ", "\n", "'", "re", "ll", "'s", "1", "é", " ", "　", "\x1c", "\x85", "中", "🙂", "!", "\t", "the ", "\r\n", "́"]
    for _ in range(1500):
        text = "".join(rng.choice(signs[: rng.randint(1, len(signs))]) for _ in range(rng.randint(1, 120)))
        step, overlap = rng.randint(5, 30), rng.randint(1, 12)
        parts = [(o, text[o : o + step + overlap]) for o in range(0, len(text), step) if not o or len(text) - o > overlap]
        chunks = [(o, p, codec.starts(p, o, o + step + overlap >= len(text))) for o, p in parts]
        assert [i for p in codec.stitch(chunks) for i in codec.piece(p)] == e.encode_ordinary(text)


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 3000))
        ids = rng.integers(0, int(rng.integers(1, 8)), n).astype(np.uint32)
        starts = np.unique(np.r_[0, rng.integers(0, n + 1, 5), n])
        symbols, at, left, right, lengths = repair.compress(ids, starts)
        shard = repair.Shard({"doc_ids": range(len(starts) - 1), "id_starts": starts, "symbol_starts": at, "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.tobytes()})
        assert (shard.all_ids() == ids).all() and (lengths == [len(repair.expand(np.array([repair.BASE + k]), left, right)) for k in range(len(left))]).all()
        for k in range(len(starts) - 1):
            own = ids[starts[k] : starts[k + 1]]
            a = int(rng.integers(0, len(own)))
            b = int(rng.integers(a + 1, len(own) + 1))
            assert (shard.ids(k, a, b) == own[a:b]).all()


def test_repair_file(spark, odd, docs):
    from tokenizers import Tokenizer

    model = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(model)
    special = [(9, "a  b <|endoftext|> İ ﬁ Å \x0b it's"), (10, "hello <|endoftext|> world <|startoftext|>"), (11, "x<|endoftext|>y <|ENDOFTEXT|> <|endoftext|"), (12, "<|startoftext|><|endoftext|>"), (13, "é<|endoftext|>é\ue000 a<|endoftext|>")]
    df = docs.select("doc_id", "text").filter("doc_id > 20").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(special, "doc_id bigint, text string"))
    path = scratch_path(spark, "tokens")
    repair.write(df, model, path, shard=20_000)
    got = sorted((tuple(r) for r in repair.read(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0))
    at, expected = 0, []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    assert tokenizer.encode(special[1][1], add_special_tokens=False).ids == [3306, 49407, 1002, 49406]


def test_repair_uses_up_its_symbols():
    """Rounds go on until no pair is frequent: one round's grammar is a plain search's, however many rounds it takes."""
    ids = np.tile(np.arange(7, dtype=np.uint32), 5000)
    symbols, _, left, right, lengths = repair.compress(ids, np.array([0, len(ids)]))
    assert len(symbols) < 40 and lengths.max() > 1000 and len(left) < 60


def test_repair_refuses_large_vocabularies(tmp_path):
    model = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    model["added_tokens"].append(dict(model["added_tokens"][0], id=repair.BASE, content="<|more|>"))
    with pytest.raises(ValueError, match="vocabulary"):
        repair.Words(json.dumps(model))


def test_repair_empty(spark, none):
    path = scratch_path(spark, "tokens")
    repair.write(none, public_tokenizers.path("word_bpe_49k.json"), path)
    assert repair.read(spark, path).count() == 0


# -- clashing columns ------------------------------------------------------------------------------------


def test_clashing_columns_come_through(spark):
    """Columns named like results or parts of the work are returned unchanged, results beside them under longer names."""
    names = ["g", "x0", "m0", "n_words", "distance", "kept", "base_failed", "spans", "base", "n_email", "key", "n_hit", "hits"]
    rows = [(k, "write to a@b.org or +1 234 567 8901 about one two three four five six seven eight nine ten " * (k + 1), "en", "s", *names) for k in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    for found, new in ((outliers.quality_rules(df), {"n_words_", "distance_", "kept_", "base_failed_"}), (pii.report(df), {"n_email_", "spans_"}), (decontaminate.contamination(df, items), {"n_words_", "n_hit_"})):
        assert set(names) | new <= set(found.columns)
        got = found.collect()
        assert len(got) == 4 and all(r[n] == n for r in got for n in names)
    assert pii.report(df.limit(0)).count() == 0


def test_added_spans_do_not_follow_the_files(spark):
    """The trees' sample is chosen by what the candidates are, whatever partitions they come in."""
    rows = private_texts() + [(1000 + k, f"call (201) 555-{1000 + k} or mail me{k} [at] host{k % 7} [dot] org, not +1 201 555 {2000 + k}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    few, many = ({r["doc_id"]: r["spans"] for r in pii.report(df.repartition(n), sample=100).collect()} for n in (1, 7))
    assert few == many


def test_rules_are_expanded_once(monkeypatch):
    """A record's ids are taken from one expansion of its rules, not from one of every symbol, and pre-tokens are learnt in one piece."""
    ids = np.array([5, 6, 7, 8] * 4_000 + [9, 9, 9] * 50, np.uint32)
    starts = np.array([0, 7, 7, len(ids)])
    symbols, at, left, right, lengths = repair.compress(ids, starts)
    shard = repair.Shard({"doc_ids": range(3), "id_starts": starts, "symbol_starts": at, "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.tobytes()})
    seen = []
    expand = repair.expand
    monkeypatch.setattr(repair, "expand", lambda s, *rules: seen.append(len(s)) or expand(s, *rules))
    assert (shard.all_ids() == ids).all() and seen == [len(left)]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        words = repair.Words(file.read())
    added = []
    add = words.piece_ids.add
    monkeypatch.setattr(words.piece_ids, "add", lambda *a: added.append(len(a[1])) or add(*a))
    texts = [" ".join(f"w{chr(97 + a)}{chr(97 + b)}'s{chr(98 + c)}." for a in range(20) for b in range(10) for c in range(10)), "", "Ünde\x0bso  <|endoftext|> 12"]
    got, cuts = words.encode(texts)
    assert len(added) == 1
    for text, a, b in zip(texts, cuts, cuts[1:]):
        assert got[a:b].tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, repair.END]


def test_empty_record():
    none = np.zeros(0, np.int64)
    symbols, at, left, right, lengths = repair.compress(none, np.array([0]))
    shard = repair.Shard({"doc_ids": [], "id_starts": np.array([0]), "symbol_starts": at, "left": b"", "right": b"", "lengths": b"", "symbols": symbols.tobytes()})
    assert len(shard.all_ids()) == 0
