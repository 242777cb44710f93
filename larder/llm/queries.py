"""The registered queries of this subpackage, each over its whole table, with comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bytebpe, chat, decontaminate, htmltree, minhash, ns_kmeans, outliers, pii, quality_gam, repair, runs, simhash, toxicity
from larder.llm.text import whole, words
from larder.session import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return outliers.quality_rules(docs).drop("lang", "source")


@query("op4_benchmark_decontamination", sql=r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p0, p0 + least(len(w), 10) - 1), ' ') AS part
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p0 FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT k, size, p0, array_to_string(list_slice(w, p0, p0 + size - 1), ' ') AS part
       FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p0 FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT k, dw.p0, dw.size, item_id FROM dw JOIN bw USING (size, part)),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(p0, p0 + size)) AS p FROM hit) GROUP BY k),
item AS (SELECT k, string_agg(i, ',' ORDER BY i) AS ids, count(*) AS n_items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN item USING (k)
""")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, folder, "benchmark").select("item_id", "text"))


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bytebpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


#: A conversation whose texts hold control strings of chat templates.
TRICKY = r"\### Assistant: </turn> ok"


@query("op10_chat_formatting", sql=r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 16 + length(replace(replace(role, '\', '\\'), '<', '<\')) + length(replace(replace(text, '\', '\\'), '<', '<\')) AS chars FROM t),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prefix, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""")
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat.digest(materialise(chat.examples(turns.unionByName(tricky))))


@query("op6_toxicity_chain")
def toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels").select("doc_id", "toxic")).drop("lang")


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.classify(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality"))


@query("op2_pii_boosting")
def pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_repair_tokens")
def repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "repair")
    repair.write(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return repair.read(spark, path)


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltree.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op11_ns_bounds_clustering", sql=ns_kmeans.comparison_sql())
def ns_bounds_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = ns_kmeans.inertia(ns_kmeans.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256).alias("centroid_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The contract's texts: one document in ten, by the checksum of its id, ends in copies of some of its words. A null id has no checksum."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", whole(F.col("text")).alias("text"), F.when(mark % 10 == 0, words(whole(F.col("text")))).alias("w"), F.floor(mark / 10).cast("long").alias("g"))
    placed = marked.withColumn("a", F.col("g") % F.nullif(F.size("w"), F.lit(0)))
    placed = placed.withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("long"))
    source = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    tailed = F.array_join(F.transform("w", source), " ")
    return placed.select("doc_id", F.when(F.size("w") > 0, tailed).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.find_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_minhash_near_dedup", sql=r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM d),
n AS MATERIALIZED (SELECT row_number() OVER () AS node, g, len(g) AS size, least FROM (SELECT g, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g)),
p AS MATERIALIZED (SELECT node, size, unnest(g) AS v FROM n),
links AS MATERIALIZED (SELECT x, y FROM (SELECT a.node AS x, b.node AS y, a.size AS nx, b.size AS ny, count(*) AS c FROM p a JOIN p b ON a.v = b.v AND a.node < b.node
    AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size) GROUP BY 1, 2, 3, 4) WHERE 100 * c >= 80 * (nx + ny - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(root, node) AS (SELECT node, node FROM n UNION SELECT r.root, e.y FROM reach r JOIN edges e ON e.x = r.node),
component AS (SELECT r.root AS node, min(n.least) AS component_id FROM reach r JOIN n ON n.node = r.node GROUP BY 1)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN doc_id ELSE component_id END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN len(s.g) = 0 THEN doc_id ELSE component_id END AS kept
FROM s LEFT JOIN n ON s.g = n.g LEFT JOIN component USING (node)
""")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
