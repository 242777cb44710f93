"""Trained operators, pages and conversations: held-out accuracy and round trips."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, htmltree, quality_gam, toxicity

LARGER = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    """Held-out accuracy in every language, and a chain whose earlier categories have positives in each."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = labels.filter("doc_id % 4 = 0")
    terms, chain = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    rows = toxicity.score(docs.join(held, "doc_id"), terms, chain).groupBy("lang", "toxic").agg(F.avg(F.col("rejected").cast("int")).alias("rate"), F.count("*").alias("n"), F.max("p_open_abuse").alias("open"), F.max("p_veiled_abuse").alias("veiled")).collect()
    total = {t: sum(r["rate"] * r["n"] for r in rows if r["toxic"] == t) / sum(r["n"] for r in rows if r["toxic"] == t) for t in (0, 1)}
    assert total[1] >= 0.93 and total[0] <= 0.005
    assert all(w is not None for w in chain.models)
    assert all(r["rate"] >= 0.8 and r["open"] > 0.5 for r in rows if r["toxic"] == 1)
    assert max(r["veiled"] for r in rows) > 0.2


def test_toxicity_in_one_language(spark):
    """A chain of three fitted models from documents that hold no English word."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").filter("lang <> 'en'"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    terms, chain = toxicity.train(docs.drop("lang"), labels)
    assert all(w is not None for w in chain.models)


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4)).astype(np.float32)
    first, last = x[:, 0] > 0.5, (x[:, 0] > 0.5) & (x[:, 1] > 0.3)
    chain = toxicity.Chain.fit(x, np.column_stack([first, last]), np.arange(300) % 4)
    assert len(chain.models[0]) == 5 and len(chain.models[1]) == 6
    assert ((chain.predict(x)[:, 0] > 0.5) == first).mean() > 0.95


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 0), (5, None), (77, 1), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.classify(odd, labels).filter("NOT rejected").count() == odd.count()
    assert toxicity.classify(none, labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    clashing = odd.withColumns({"rejected": F.lit("x"), "p_toxic": F.lit(1)})
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns
    assert {"rejected", "rejected_", "p_toxic_"} <= set(toxicity.classify(clashing, labels).columns)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = quality_gam.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert right >= 0.93 and all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_unknown_documents_take_no_place(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    unknown = spark.range(10**9, 10**9 + 400_000).select(F.col("id").alias("doc_id"), F.lit(1).cast(labels.schema["quality"].dataType).alias("quality"))
    few, many = ({r["doc_id"]: r["score"] for r in quality_gam.classify(docs, each).collect()} for each in (labels, labels.unionByName(unknown)))
    assert few == many


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.Gam.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    assert np.isfinite(quality_gam.Gam.fit(x, np.ones(3000)).score(x)).all()


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id bigint, quality int")
    assert quality_gam.classify(odd, labels).count() == odd.count()
    assert quality_gam.classify(none, labels).count() == 0


def test_class_counts():
    texts = ["aB|!!", "", "é#1\n", "..."]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = quality_gam.class_counts(np.frombuffer(data, np.uint8), ends)
    assert got.tolist() == [[sum(b in c for b in t.encode()) for c in quality_gam.CLASSES] for t in texts]


# -- pages -------------------------------------------------------------------------------------------------


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5, -1, 7])
    depth = np.array([0, 1, 1, 2, 2, 2, 3, 0, 1])
    kind = np.array([1, 0, 2, 1, 0, 2, 1, 0, 0])
    x, model = rng.normal(size=(9, 3)), htmltree.Model(rng.normal(size=3), rng.normal(size=(3, 2, 2)))
    weight = np.zeros((9, 2))
    for code in range(2**9):
        y = [code >> k & 1 for k in range(9)]
        w = np.exp(sum(float(x[k] @ model.weights) * y[k] for k in range(9)) + sum(model.edge[kind[k], y[p], y[k]] for k, p in enumerate(parent) if p >= 0))
        for k in range(9):
            weight[k, y[k]] += w
    assert np.allclose(model.marginals(x, kind, parent, depth), weight[:, 1] / weight.sum(1))


def masked(source):
    """The page with neutral blocks in place of named ones, and no class, id or role."""
    import re

    return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(nav|article|footer|header|aside|section|main|form)\b", r"<\1div", source, flags=re.I), flags=re.I)


def test_edges_decide_pages_without_names(spark):
    """Trained on half the pages, the model finds the articles of the others after their names are gone; without its edges it does not."""
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "html")
    model = htmltree.train(pages.filter("page_id % 2 = 0"))
    held = [r["html"] for r in pages.filter("page_id % 2 = 1").collect()]
    right = {}
    for name, judge in (("whole", model), ("without edges", htmltree.Model(model.weights, np.zeros_like(model.edge)))):
        right[name] = []
        for source in held:
            own, bare = htmltree.parse(source), htmltree.parse(masked(source))
            truth = [t for t, y in zip(own.text, htmltree.own_labels(own)) if t is not None and y]
            x = htmltree.features(bare)
            _, parent, depth = htmltree.forest([np.array(bare.parent)])
            got = [t for t, q in zip(bare.text, judge.marginals(x, htmltree.kinds(x), parent, depth)) if t is not None and q > 0.5]
            right[name].append(got == truth)
    assert np.mean(right["whole"]) >= 0.97 and np.mean(right["without edges"]) <= 0.5


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="sidebar"><p>A sidebar sentence that is long enough to look like text.</p></div><article class=post><h2>A &lt;title&gt; &amp; more</h2>
<p>First paragraph,\n with <b>bold<i> text</b> and a line<br>break, long enough to count.<p>Second&nbsp;paragraph, unclosed, and long enough to count too.
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --><ul><li>one thing that is listed here</ul><div class="comments"><p>Reader: I liked this very much, indeed I did.</p></div></article>
<form><label>Mail</label><input name=a></form><div class="cookie-notice">We use cookies on this site, all the time.</div><footer>&copy; all rights</footer>"""


def test_page(spark, none):
    pages = spark.read.parquet(f"{LARGER}/pages.parquet")
    model = htmltree.train(pages)
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<p>" * 3000 + "deep", "x"), (5, "no markup < at all", "x"), (5, "<a b='", "x"), (6, "<div " * 2000, "x")], "page_id bigint, html string, tag string")
    got = {r["page_id"]: r["text"] for r in htmltree.extract(df, model).collect()}
    assert got[1] == "A <title> & more\n\nFirst paragraph, with bold text and a line break, long enough to count.\n\nSecond paragraph, unclosed, and long enough to count too.\n\none thing that is listed here"
    assert got[2] == got[3] == ""
    assert htmltree.main_text(df.limit(0)).count() == 0
    clashing = htmltree.main_text(df.withColumnsRenamed({"tag": "text"}).withColumn("n_chars", F.lit("y")))
    assert clashing.columns == ["page_id", "text", "n_chars", "text_", "n_chars_"] and {r["text"] for r in clashing.collect()} == {"x"}


def test_few_marked_pages_all_train(spark):
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "html").orderBy("page_id").limit(30)
    others = spark.range(10**6, 10**6 + 100_000).select(F.col("id").alias("page_id"), F.lit("<p>no mark</p>").alias("html"))
    few, many = htmltree.train(pages), htmltree.train(pages.unionByName(others))
    assert np.allclose(few.weights, many.weights) and np.allclose(few.edge, many.edge)


def test_articles_of_the_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{LARGER}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltree.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


# -- conversations -----------------------------------------------------------------------------------------

SIGNS = ["\\", "<", ">", "\n", "g", "n", "</turn>", "<turn user>", "a", "é🙂", "\\### Assistant: </turn> ok", ""]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 6)))
    role = lambda: rng.choice(["user", "assistant", "assistant", "system", "<x>\\n\n\\g", None])
    rows = [(c, k, role(), text()) for c in range(80) for k in range(rng.randint(1, 9))]
    return rows + [(None, 0, "user", "no id"), (900, 0, "user", "no reply"), (901, 0, "assistant", "")] + [(902, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]


def test_chat_round_trip(spark, talks):
    written = chat.examples(spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digest(written).collect()}
    for conv in {t[0] for t in talks}:
        turns = sorted(((t[1], t[2] or "", t[3] or "") for t in talks if t[0] == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    masks = written.filter("conv_id = 902").collect()
    assert len(masks) == 150 and all(m["formatted"][m["loss_start"] : m["loss_end"]] == f"turn {2 * m['example'] - 1}" for m in masks)


def test_chat_empty(spark):
    assert chat.digest(chat.examples(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
