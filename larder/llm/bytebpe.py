"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than ``step`` characters is cut once into plain pieces; a chunk is a piece and the first characters
of the next, its overlap. Chunks are pre-tokenised in parallel tasks. Neighbours are stitched at the first position in
the overlap at which both begin a pre-token: the pattern looks only to the right, so from there on they
agree. A chunk finds that position by itself, as it holds the next one's beginning, and sends it on; then
every chunk encodes the pre-tokens between its two positions, so the tasks share a long text. A chunk's last
characters are not trusted, as the pattern looks ahead. Where an overlap has no common position (one very long
pre-token), the chunks of that text are stitched in one task, where the pattern runs on from the last trusted
position until it meets the next chunk's. Shorter texts are a single chunk, whose stitching is empty, and are encoded
where they are read. The work is linear in the length of a text.

Decoding joins the raw bytes of the ids. The rank file is read on the driver and travels with the job.

Defined cases: null and empty texts have no ids; any text, of any length, survives the round trip; repeated rows
are encoded each; an empty table gives an empty result; a result whose name the input has already is lengthened by
an underscore.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import free_name, whole
from larder.session import materialise

STEP, OVERLAP = 24_000, 512
AHEAD = 3  # characters to the right that may change where a pre-token ends
CACHE = 200_000  # pieces remembered by a task


class Codec:
    """Encodes and decodes by a rank file and a pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("shipped", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)

    def piece(self, text: str) -> list[int]:
        ids = self.cache.get(text)
        if ids is None:
            ids = self.encode(text)
            if len(self.cache) < CACHE:
                self.cache[text] = ids
        return ids

    def starts(self, text: str, offset: int, last: bool) -> list[int]:
        """Where pre-tokens begin, and the end of the last trusted one."""
        limit = len(text) if last else len(text) - AHEAD
        found = [0]
        for match in self.split.finditer(text):
            if match.end() > limit:
                break
            found.append(match.end())
        return [offset + p for p in found]

    def meeting(self, text: str, piece: int) -> int:
        """The first position from ``piece`` on where this chunk and the next, which begins there, both begin a pre-token; -1 if none."""
        own = self.starts(text, 0, False)
        both = set(self.starts(text[piece:], piece, False))
        return next((p for p in own[bisect_left(own, piece) :] if p in both), -1)

    def between(self, text: str, begin: int, end: int) -> list[int]:
        """The ids of the pre-tokens from ``begin`` to ``end``, both of which begin one."""
        ids: list[int] = []
        for match in self.split.finditer(text, begin):
            if match.start() >= end:
                break
            ids += self.piece(match[0])
        return ids

    def stitch(self, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
        """The pre-tokens of a text from its chunks ``(offset, text, starts)`` in order."""
        text = "".join(c[1][: chunks[i + 1][0] - c[0]] if i + 1 < len(chunks) else c[1] for i, c in enumerate(chunks))
        cuts = list(chunks[0][2])
        for offset, _, starts in chunks[1:]:
            own = set(starts)
            k = next((i for i in range(bisect_left(cuts, offset), len(cuts)) if cuts[i] in own), None)
            if k is None:  # run on from the last trusted position until the next chunk's agree, or its end
                while cuts[-1] not in own or cuts[-1] < offset:
                    match = self.split.match(text, cuts[-1])
                    if match is None:
                        break
                    cuts.append(match.end())
                k = len(cuts) - 1
            if cuts[k] in own:
                joint = cuts[k]
                del cuts[k:]
                cuts += starts[bisect_left(starts, joint) :]
        if cuts[-1] < len(text):
            for match in self.split.finditer(text, cuts[-1]):
                cuts.append(match.end())
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _digest(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
IDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", digest: bool = False, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of ``docs`` and ``ids``; with ``digest``, n_tokens and the two hashes of a round trip instead."""
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    keep = [c for c in docs.columns if c != text]
    made = [T.StructField(free_name(docs, f.name), f.dataType) for f in (DIGEST if digest else IDS)]
    out = T.StructType([*[docs.schema[c] for c in keep], *made])
    body = whole(F.col(f"`{text}`"))
    columns = [F.col(f"`{c}`") for c in keep]

    codecs: list[Codec] = []  # one per task: the function is unpacked anew for each

    def own_codec() -> Codec:
        if not codecs:
            codecs.append(Codec(ranks, pattern))
        return codecs[0]

    def result(codec: Codec, ids) -> tuple:
        return _digest(codec, list(ids)) if digest else (list(ids),)

    def frame(left, found):
        import pandas as pd

        return pd.concat([left, pd.DataFrame(found, columns=[f.name for f in made], index=left.index)], axis=1)

    def short(frames):
        codec = own_codec()
        for got in frames:
            yield frame(got.iloc[:, :-1], [result(codec, codec.encode(t)) for t in got.iloc[:, -1]])

    def meet(frames):
        codec = own_codec()
        for got in frames:
            got["~meet"] = [-1 if last else codec.meeting(t, step) for t, last in zip(got["~part"], got["~last"])]
            yield got

    def part_ids(frames):
        codec = own_codec()
        for got in frames:
            ends = [len(t) if last else end for t, last, end in zip(got["~part"], got["~last"], got["~meet"])]
            got["~ids"] = [codec.between(t, int(a), int(b)) for t, a, b in zip(got["~part"], got["~begin"], ends)]
            yield got.drop(columns=["~part", "~last", "~meet", "~begin"])

    def whole_text(_, got):
        codec = own_codec()
        got = got.sort_values("~k")
        chunks = [(k * step, t, codec.starts(t, k * step, last)) for k, t, last in zip(got["~k"], got["~part"], got["~last"])]
        ids = [i for p in codec.stitch(chunks) for i in codec.piece(p)]
        return frame(got.iloc[:1][keep], [result(codec, ids)])

    def finish(frames):
        codec = own_codec()
        for got in frames:
            yield frame(got.iloc[:, :-1], [result(codec, ids) for ids in got.iloc[:, -1]])

    small = docs.filter(F.char_length(body) <= step).select(*columns, body.alias("~text")).mapInPandas(short, out)
    long = docs.filter(F.char_length(body) > step).select(F.monotonically_increasing_id().alias("~row"), *columns, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("~pieces"))
    # A last piece no longer than the overlap lies wholly in the chunk before it.
    count = F.size("~pieces") - F.when(F.char_length(F.element_at("~pieces", -1)) <= overlap, 1).otherwise(0)
    chunk = F.transform(F.slice("~pieces", F.lit(1), F.greatest(count, F.lit(1))), lambda p, k: F.struct(
        k.alias("k"), F.concat(p, F.substring(F.coalesce(F.get("~pieces", k + 1), F.lit("")), 1, overlap)).alias("part"), (k >= count - 1).alias("last")))
    chunks = long.select("~row", *columns, F.explode(chunk).alias("c")).select("~row", *columns, F.col("c.k").alias("~k"), F.col("c.part").alias("~part"), F.col("c.last").alias("~last"))
    met = T.StructType([*chunks.schema.fields, T.StructField("~meet", T.LongType())])
    # Stored: each chunk is looked at from two sides, and the row numbers must not change in between.
    chunks = materialise(chunks.repartition("~row", "~k").mapInPandas(meet, met))
    # The positions without the text, stored apart: the planner sees their true size, and no chunk is shuffled to meet them.
    places = materialise(chunks.select("~row", "~k", "~last", "~meet"))
    apart = places.filter(~F.col("~last") & (F.col("~meet") < 0)).select("~row").distinct()
    begins = places.select("~row", (F.col("~k") + 1).alias("~k"), (F.col("~meet") - step).alias("~begin"))
    placed = chunks.join(apart, "~row", "left_anti").join(begins, ["~row", "~k"], "left").fillna(0, ["~begin"])
    order = ["~row", *keep, "~k", "~part", "~last", "~meet", "~begin"]
    encoded = placed.select(*[F.col(f"`{c}`") for c in order]).mapInPandas(part_ids, T.StructType([*[chunks.schema[c] for c in ("~row", *keep, "~k")], T.StructField("~ids", T.ArrayType(T.IntegerType()))]))
    # A row for each long text: its other columns with the first chunk, the ids of all chunks in order.
    rest = F.min_by(F.struct(F.lit(0).alias("~none"), *columns), "~k").alias("~rest")
    rows = encoded.groupBy("~row").agg(rest, F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("~k", "~ids"))), lambda c: c["~ids"])).alias("~ids"))
    joined = rows.select(*[F.col(f"`~rest`.`{c}`").alias(c) for c in keep], "~ids").mapInPandas(finish, out)
    return small.union(joined).union(chunks.join(apart, "~row", "left_semi").groupBy("~row").applyInPandas(whole_text, out))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """The other columns of ``docs`` and the raw bytes of its ids; null ids give no bytes."""
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    keep = [c for c in docs.columns if c != ids]

    def run(frames):
        codec = Codec(ranks, pattern)
        for got in frames:
            left = got[keep].copy()
            left[name] = [codec.decode([] if i is None else list(i)) for i in got[ids]]
            yield left

    ordered = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`"))
    return ordered.mapInPandas(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.BinaryType())]))
