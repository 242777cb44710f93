"""Re-Pair grammar compression of token ids, per shard.

Documents are put in ascending id order by a range shuffle and tokenised; every shard of about
``SHARD`` ids becomes one record of the output table: frequent neighbouring pairs are replaced by
nonterminals again and again, no pair reaching over the end of a document. A record holds the rules, the
expansion length of every rule, the compressed symbols and where each document begins among the symbols and
among the ids, so any range of ids of a document is decoded from its own symbols alone.

A round replaces many pairs at once: taken from the most frequent on, each symbol may be a left or a right
part, not both, so no two occurrences overlap; a pair of equal symbols takes its run two by two.

The record format is a Parquet table, so writing is atomic and a lost task is written again:
``shard`` (order), ``doc_ids``, ``id_starts`` and ``symbol_starts`` (one more than documents), ``left``, ``right``
and ``lengths`` (little-endian unsigned 32 bits, one per rule), ``symbols`` (little-endian unsigned 16 bits).
Symbols from ``BASE`` on are rules.

Defined cases: null and empty texts are the end id alone; null ids come first; rows of one id are ordered by
the hash of their text; an empty table gives an empty output.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import whole

BASE = 49_408  # first symbol that is a rule; ids lie below
RULES = 65_536 - BASE
SHARD = 2_000_000
PER_ROUND, LEAST = 4_096, 8
END = 1
CACHE = 800_000  # distinct parts a worker process remembers
MARK = "\ue000"  # stands alone between words that are encoded together

RECORD = T.StructType([
    T.StructField("first_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("id_starts", T.ArrayType(T.LongType())), T.StructField("symbol_starts", T.ArrayType(T.LongType())),
    T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("symbols", T.BinaryType())])


def _occurrences(seq: np.ndarray, inner: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rule numbers of all replaceable pairs. ``inner``: the next symbol is of the same document."""
    lefts, rights = np.unique(left), np.unique(right)
    row, column = np.zeros(BASE + RULES, np.int16), np.zeros(BASE + RULES, np.int16)
    row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
    table = np.full((len(lefts) + 1, len(rights) + 1), -1, np.int16)
    table[row[left], column[right]] = np.arange(len(left))
    rows, columns = row[seq[:-1]], column[seq[1:]]
    at = np.flatnonzero((rows > 0) & (columns > 0) & inner)
    rule = table[rows[at], columns[at]]
    at, rule = at[rule >= 0], rule[rule >= 0]
    same = seq[at] == seq[at + 1]
    if same.any():  # of a run of equal symbols, the pairs at even steps from its start
        run = at[same]
        begin = np.r_[True, np.diff(run) != 1]
        step = run - np.maximum.accumulate(np.where(begin, run, 0))
        keep = np.ones(len(at), bool)
        keep[np.flatnonzero(same)[step % 2 == 1]] = False
        at, rule = at[keep], rule[keep]
    return at, rule


def compress(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol starts, left, right, lengths) of the ids of consecutive documents."""
    seq, starts = ids.astype(np.uint32), starts.astype(np.int64)
    left, right, lengths = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.ones(BASE, np.uint32)
    while True:  # until no pair is frequent or the symbols are used up
        room = min(PER_ROUND, RULES - len(left))
        if len(seq) < 2 or room <= 0:
            break
        inner = np.ones(len(seq) - 1, bool)
        edges = starts[1:-1] - 1
        inner[edges[(edges >= 0) & (edges < len(inner))]] = False
        pairs = (seq[:-1] << np.uint32(16) | seq[1:])[inner]  # symbols take sixteen bits
        pairs.sort()
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, int)
        many = np.diff(np.r_[first, len(pairs)])
        able = np.flatnonzero(many >= LEAST)
        if not len(able):
            break
        able = able[np.argsort(-many[able], kind="stable")[: 2 * room]]
        role: dict[int, int] = {}
        chosen = []
        for key in pairs[first[able]].tolist():
            a, b = key >> 16, key & 0xFFFF
            if a == b:
                if a not in role:
                    role[a] = 2
                    chosen.append((a, b))
            elif role.get(a, 0) == 0 and role.get(b, 1) == 1:
                role[a], role[b] = 0, 1
                chosen.append((a, b))
            if len(chosen) == room:
                break
        new = np.array(chosen, np.uint32)
        at, rule = _occurrences(seq, inner, new[:, 0], new[:, 1])
        seq[at] = rule.astype(np.uint32) + np.uint32(BASE + len(left))
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        starts = starts - np.searchsorted(at + 1, starts)
        left, right = np.r_[left, new[:, 0]], np.r_[right, new[:, 1]]
        lengths = np.r_[lengths, lengths[new[:, 0]] + lengths[new[:, 1]]]
    return seq.astype("<u2"), starts, left, right, lengths[BASE:]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols."""
    seq = symbols.astype(np.uint32)
    while len(seq) and (big := seq >= BASE).any():
        size = np.where(big, 2, 1)
        end = np.cumsum(size)
        out = np.repeat(seq, size)
        rule = seq[big] - BASE
        out[end[big] - 2], out[end[big] - 1] = left[rule], right[rule]
        seq = out
    return seq


class Shard:
    """Random access to a record."""

    def __init__(self, record):
        self.doc_ids, self.id_starts, self.symbol_starts = (np.asarray(record[c]) for c in ("doc_ids", "id_starts", "symbol_starts"))
        self.left, self.right, self.lengths = (np.frombuffer(record[c], "<u4") for c in ("left", "right", "lengths"))
        self.symbols = np.frombuffer(record["symbols"], "<u2")

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document, from the symbols that cover them only."""
        own = self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]].astype(np.int64)
        stop = int(self.id_starts[k + 1] - self.id_starts[k]) if stop is None else stop
        ends = np.cumsum(np.where(own >= BASE, self.lengths[np.maximum(own - BASE, 0)] if len(self.lengths) else 1, 1))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(own[a:b], self.left, self.right)[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        """The ids of all documents: every rule is expanded once, then each symbol takes what it stands for."""
        rules = len(self.left)
        flat = np.concatenate([np.arange(BASE, dtype=np.uint32), expand(np.arange(BASE, BASE + rules, dtype=np.uint32), self.left, self.right)])
        size = np.ones(BASE + rules, np.int32)
        size[BASE:] = self.lengths
        first = np.cumsum(size, dtype=np.int64) - size
        sizes = size[self.symbols]
        ends = np.cumsum(sizes, dtype=np.int64)
        # Where a symbol's ids lie in ``flat``, less where they go; added to the places they go to.
        return flat[np.repeat(first[self.symbols] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codes(defaultdict):
    """Codes 0, 1, 2 ... of keys in the order they are first asked for."""

    def __init__(self):
        super().__init__(itertools.count().__next__)
        self.known = 0

    def taken(self) -> list[str]:
        """The keys that are new since the last call, in the order of their codes."""
        fresh = list(itertools.islice(reversed(self), len(self) - self.known))[::-1]
        self.known = len(self)
        return fresh


class Ragged:
    """Growing lists of numbers under codes 0, 1, 2 ..."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``codes`` one after another, and where each ends (one more than codes)."""
        size = self.ends[codes + 1] - self.ends[codes]
        run = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.ends[codes] - run[:-1], size) + np.arange(run[-1])], run


#: Parts of these characters (ASCII and Latin letters, without the one whose lower case is two characters) are
#: unchanged by the tokenizer's composition step.
ODD = r"[^\n!-~\u00c0-\u012f\u0131-\u024f]"
#: The tokenizer's own pre-token pattern (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Words:
    """Token ids of texts through the ids of their distinct space-separated parts.

    The tokenizer drops white space and never merges across it, so a text's ids are its parts' ids in order.
    Parts of plain characters are cut into pre-tokens, and distinct pre-tokens are encoded many at a time, as
    each closes with an end-of-word token. Other parts, and parts that hold the text of a special token, which the
    library reads as that token, are encoded whole, a marker between them.
    """

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        # The same model for pre-tokens as they are: only cut at spaces.
        settings = json.loads(model)
        steps = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, settings["pre_tokenizer"]["pretokenizers"][-1]]
        self.plain = Tokenizer.from_str(json.dumps(settings | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "post_processor": None, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= BASE:
            raise ValueError(f"ids from {BASE} on are rules; the vocabulary needs ids up to {max(vocabulary.values())}")
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if any(not t or regex.search(r"\s", t) for t in special):
            raise ValueError("a special token with white space reaches over the parts of a text")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.odd, self.pretokens = regex.compile("|".join([ODD, *map(regex.escape, special)])), regex.compile(PRETOKEN + r"|\n")
        self.mark = self._alone(MARK)
        self.clear()

    def clear(self) -> None:
        self.parts, self.pieces = Codes(), Codes()
        self.part_ids, self.piece_ids = Ragged(), Ragged()
        self.closer = self.pieces["\n"]
        self.pieces.taken()
        self.piece_ids.add(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joined(self, tokenizer, words: list[str], between: str):
        groups = [words[a : a + 500] for a in range(0, len(words), 500)]
        encoded = tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        return [(g, np.array(e.ids, np.int64)) for g, e in zip(groups, encoded)]

    def _learn_pieces(self, words: list[str]) -> None:
        found, sizes = [], []
        for group, ids in self._joined(self.plain, words, " "):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group) and (not len(ids) or ends[-1] == len(ids)):
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [self._alone(w) for w in group]
                found.append(np.array([i for e in each for i in e], np.int64))
                sizes.append(np.array([len(e) for e in each], np.int64))
        if found:
            self.piece_ids.add(np.concatenate(found), np.concatenate(sizes))

    def _marked(self, words: list[str]) -> list[list[int]]:
        out, width = [], len(self.mark)
        for group, ids in self._joined(self.tokenizer, words, f" {MARK} "):
            hit = np.ones(max(len(ids) - width + 1, 0), bool)
            for j, m in enumerate(self.mark):
                hit &= ids[j : j + len(hit)] == m
            cut = np.flatnonzero(hit)
            starts, stops = [0, *(cut + width).tolist()], [*cut.tolist(), len(ids)]
            out += [ids[a:b].tolist() for a, b in zip(starts, stops)] if len(starts) == len(group) else [self._alone(w) for w in group]
        return out

    def _learn(self, fresh: list[str]) -> None:
        """The ids of ``fresh`` under the next codes: a part's ids are its pieces' ids, odd parts are encoded whole."""
        text = "\n".join(fresh)
        ends = np.cumsum([len(p) + 1 for p in fresh])
        odd = np.unique(np.searchsorted(ends, [m.start() for m in self.odd.finditer(text)], "right")).tolist()
        if odd:
            aside = set(odd)
            text = "\n".join("" if k in aside else p for k, p in enumerate(fresh))
        # One pass over all parts; a new line is a piece that closes a part and has no ids.
        found = self.pretokens.findall(text.lower() + "\n")
        codes = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        self._learn_pieces(self.pieces.taken())
        ids, run = self.piece_ids.take(codes)
        sizes = np.diff(run[np.concatenate([[0], np.flatnonzero(codes == self.closer) + 1])])
        if odd:
            usual = [fresh[k] for k in odd if MARK not in fresh[k]]
            known = dict(zip(usual, self._marked(usual)))
            more = [np.array(known[fresh[k]] if fresh[k] in known else self._alone(fresh[k]), np.int64) for k in odd]
            starts = np.concatenate([[0], np.cumsum(sizes)])[odd]
            sizes[odd] = [len(m) for m in more]
            ids = np.insert(ids, np.repeat(starts, sizes[odd]), np.concatenate(more))
        self.part_ids.add(ids, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the end id, and where each text's begin (one more than texts)."""
        if len(self.parts) > CACHE:
            self.clear()
        code = self.parts.__getitem__
        rows = []
        for text in texts:  # one text at a time, so that its parts are looked up while they are fresh
            parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            rows.append(np.fromiter(map(code, parts), np.int64, len(parts)))
        fresh = self.parts.taken()
        if fresh:
            self._learn(fresh)
        flat, run = self.part_ids.take(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        cuts = run[np.cumsum([0, *map(len, rows)])[1:]]
        return np.insert(flat, cuts, END).astype(np.uint32), np.concatenate([[0], cuts + np.arange(1, len(rows) + 1)])


def worker_words(model: str) -> Words:
    """The words of this worker process, kept from task to task: functions come by value, so a module of its own holds them."""
    import sys
    import types

    held = sys.modules.setdefault("_larder_worker_words", types.ModuleType("_larder_worker_words"))
    if getattr(held, "model", None) != model:
        held.model, held.words = model, Words(model)
    return held.words


def write(docs: DataFrame, model_path: str, path: str, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> None:
    """Tokenise and compress ``docs`` into the record table at ``path``."""
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    body = whole(F.col(f"`{text}`"))
    ordered = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        import pyarrow as pa

        words, number = worker_words(model), 0
        kept: list = []
        size = 0

        def record(part: int):
            nonlocal kept, size, number
            ids = np.concatenate([k[1] for k in kept])
            counts = np.concatenate([np.diff(k[2]) for k in kept])
            starts = np.r_[0, np.cumsum(counts)]
            doc_ids = [i for k in kept for i in k[0]]
            symbols, symbol_starts, left, right, lengths = compress(ids, starts)
            row = {"first_id": doc_ids[0], "part": part, "block": number, "n_ids": len(ids), "doc_ids": doc_ids, "id_starts": starts, "symbol_starts": symbol_starts,
                   "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.tobytes()}
            number, kept, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=out)

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(doc_ids):  # about four million characters at a time
                b = max(int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + 4_000_000)), a + 1)
                ids, starts = words.encode(texts[a:b])
                kept.append((doc_ids[a:b], ids, starts))
                size += len(ids)
                if size >= shard:
                    yield record(part)
                a = b
        if kept:
            yield record(part)

    import pyarrow as pa

    out = pa.schema([("first_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("id_starts", pa.list_(pa.int64())), ("symbol_starts", pa.list_(pa.int64())),
                     ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])
    ordered.mapInArrow(run, RECORD).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the records at ``path``."""
    records = spark.read.schema(RECORD).parquet(path)
    # Where each shard's ids begin: those of the range partitions before its own (a row per partition), then of the shards before it there.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = records.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(parts, "part").select("part", "block", (F.col("start") + F.col("inside")).alias("before"))
    placed = records.join(before, ["part", "block"]).select("before", *[f.name for f in RECORD if f.name not in ("first_id", "part", "block", "n_ids")])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
                shard = Shard(row)
                ids = shard.all_ids().astype("<u4")
                starts = shard.id_starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["before"], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
