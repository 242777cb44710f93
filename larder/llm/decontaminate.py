"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Windows of the benchmark are hashed. As long as their number and bytes stay under ``set_windows`` and
``set_bytes`` the hashes travel with the plan as a hash set and every document is scanned in place;
beyond that bound every window of every document becomes a row and meets the benchmark in an ordinary
join. Either way a hash hit counts only once its words are equal to the window's.

Defined cases: null or wordless texts and items give no window; a null id of an item makes its windows
hit without being listed; repeated items and equal windows of several items are listed once each; an
empty benchmark hits nothing; repeated documents are judged row by row; texts of any length are read whole; a
result whose name the input has already is lengthened by an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.text import free_name, lower_ascii, shielded, whole
from larder.session import materialise

WIDTH = 10
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(whole(text)), SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """One row per distinct window: its words, their number, its hash and end hash, and the items that hold it."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), item_words(F.col(f"`{text}`")).alias("words")).withColumn("n", F.size("words"))
    cut = items.filter("n > 0").select("item", F.least("n", F.lit(width)).alias("size"), "words", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1)))).alias("at"))
    cut = cut.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("part"))
    return cut.groupBy("part", "size").agg(F.collect_set("item").alias("items")).select("part", "size", "items", F.xxhash64("part").alias("hash"), ends_hash(F.col("part"), F.lit(1), F.col("size")).alias("ends"))


def ends_hash(items: Column, at: Column, size: Column) -> Column:
    """Hash of a window's first and last word: cheap to rule most windows out with."""
    return F.xxhash64(F.get(items, at - 1), F.get(items, at + size - 2))


def _scan(size: int, ends: list[int], hashes: list[int]) -> Column:
    """Windows of ``size`` words whose hashes are in the set. The set is written as SQL text: one call, whatever its length."""
    end_set, hash_set = (", ".join(f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)" for h in chosen) for chosen in (ends, hashes))
    positions = f"if(`~n` >= {size}, sequence(1, `~n` - {size - 1}), cast(array() as array<int>))"
    first_last = f"xxhash64(get(`~words`, at - 1), get(`~words`, at + {size - 2}))"
    found = f"filter({positions}, at -> {first_last} IN ({end_set}) AND xxhash64(slice(`~words`, at, {size})) IN ({hash_set}))"
    return F.expr(f"transform({found}, at -> named_struct('at', at, 'size', {size}, 'part', slice(`~words`, at, {size})))")


def _every(words: Column, n: Column, size: int) -> Column:
    """All windows of ``size`` words."""
    positions = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(positions, lambda at: F.struct(at.alias("at"), F.lit(size).alias("size"), F.slice(words, at, F.lit(size)).alias("part")))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   width: int = WIDTH, set_windows: int = 200_000, set_bytes: int = 16 << 20) -> tuple[DataFrame, str, str]:
    """``docs`` without their text, plus ``key``, ``n_words`` and the verified hits ``(at, size, items)`` of each row.

    Returns the frame and the names of the key and the hits column.
    """
    spark = docs.sparkSession
    known = materialise(benchmark_windows(benchmark, item_id, item_text, width))
    size = known.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.concat_ws(" ", "part")) + 16 * F.size("items")).alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    small = size.rows <= set_windows and (size.bytes or 0) <= set_bytes
    key, hits = free_name(docs, "row_key"), free_name(docs, "hits")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    base = docs.select(*keep, F.monotonically_increasing_id().alias(key), item_words(F.col(f"`{text}`")).alias("~words")).withColumn("~n", F.size("~words"))
    if small:
        sets = {r.size: (r.ends, r.hashes) for r in known.groupBy("size").agg(F.collect_set("ends").alias("ends"), F.collect_set("hash").alias("hashes")).collect()} if size.rows else {}
        found = [_scan(s, *sets[s]) for s in size.sizes]
        cands = F.flatten(F.array(*found)) if found else F.expr("array()").cast("array<struct<at:int,size:int,part:array<string>>>")
    else:
        # The join sees every window; the distinct sizes are at most `width`.
        cands = F.flatten(F.array(*[_every(F.col("~words"), F.col("~n"), s) for s in size.sizes]))
    scanned = base.select(*keep, key, F.col("~n").cast("long").alias("n_words"), cands.alias("~cands"))
    if small:
        scanned = materialise(scanned)
    rows = scanned.select(F.col(key), F.explode("~cands").alias("c")).select(key, "c.at", "c.size", "c.part", F.xxhash64("c.part").alias("hash"))
    window = known.select("hash", F.col("part").alias("known_part"), "items")
    verified = rows.join(F.broadcast(window) if small else window, "hash").filter(F.col("part") == F.col("known_part"))
    per_row = verified.groupBy(key).agg(F.collect_list(F.struct("at", "size", "items")).alias(hits))
    return scanned.drop("~cands").join(per_row, key, "left"), key, hits


def hit_positions(hits: Column) -> Column:
    """The 1-based positions of all hit words."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(hits, F.array()), lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


@shielded("text")
def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per document: its other columns, n_words, n_hit, n_items, items_sha256 and contaminated."""
    marked, key, hits = benchmark_hits(docs, benchmark, text, **options)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(f"`{hits}`"), F.array()), lambda h: F.transform(h["items"], lambda i: i.cast("string"))))))
    out = marked.withColumns({"n_hit": F.size(hit_positions(F.col(f"`{hits}`"))).cast("long"), "~items": items})
    out = out.withColumns({"n_items": F.size("~items").cast("long"), "items_sha256": F.sha2(F.array_join("~items", ","), 256), "contaminated": F.col("n_hit") > 0})
    return out.drop("~items", key, hits)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without their hit words.

    With spans, a hit word goes together with the characters up to the next word. A row is found again by
    its id and the hash of its text, so equal rows share one verdict; a null id is matched as a value.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    mark, hash_name = free_name(docs, "hit_words"), free_name(docs, "text_hash")
    own = docs.withColumn(hash_name, F.xxhash64(whole(F.col(f"`{text}`"))))
    slim = own.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.col(hash_name))
    marked, key, hits = benchmark_hits(slim, benchmark, text, **options)
    bad = marked.filter(F.col(f"`{hits}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("~id"), F.col(hash_name).alias("~hash")).agg(F.first(hit_positions(F.col(f"`{hits}`"))).alias(mark))
    bad = materialise(bad)  # a known size lets Spark broadcast a short list rather than move every text
    same = own[doc_id].eqNullSafe(bad["~id"]) & (own[hash_name] == bad["~hash"])
    if remove == "documents":
        return own.join(bad, same, "left_anti").drop(hash_name)
    body = F.col(f"`{text}`")
    gaps, raw = F.split(body, RAW_WORD, -1), F.regexp_extract_all(body, F.lit(f"({RAW_WORD})"), 1)
    rest = F.transform(raw, lambda w, i: F.when(F.array_contains(mark, i + 1), "").otherwise(F.concat(w, F.get(gaps, i + 1))))
    out = own.join(bad, same, "left").withColumn(text, F.when(F.col(mark).isNull(), body).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(rest, ""))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
