"""Periodic run detection by block convolution: every maximal stretch of words that repeats with a short period.

Words become numbers and the texts of a batch one sequence with a unique mark after each text. For the scales
L = 8, 16, 32, ... the sequence is cut into blocks of L. A number theoretic transform, exact in integers, gives the sum of
squared differences between a block and every place of the window after it: S(block) + S(place) - 2 * correlation.
Scale 8 looks at distances 1 to 15, scale L at L to 2L - 1. A run of period q and length max(24, 3q) or more holds
a whole block of its scale and that block's copy q words on, so every run is found. Neighbouring blocks with one
distance form a seed, which is extended to both sides by bisection over hashes. What is long enough is compared word
by word, so neither a multiple of the prime nor equal hashes do harm. Of the periods of one stretch the smallest
stays: from three periods on the others are its multiples.

Two exact rules spare transforms: a block with a word that does not come again within 2L words has no copy there;
and a block whose window lies inside a known run of period up to L can only find that run again.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text; repeated rows are
treated alike; a text of any length is one sequence (batches are cut by their bytes, not by rows), so memory
follows the longest text; a null id is an id like any other; an empty table gives an empty result. Only the two
named columns are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.text import whole

LEAST, FOLD = 24, 3  # words, periods
BASE = 8  # words of the smallest block: LEAST words hold a block, its copy and the way to the next block
SLICE = 4 << 20  # bytes of text looked at together; a longer text is alone
CELLS = 1 << 19  # numbers transformed together
PRIME, GENERATOR = 15 * 2**27 + 1, 31  # the transform's field and a generator of its units


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 ... base ** (count - 1) modulo the prime, by doubling."""
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, PRIME))
        out[done : 2 * done] = out[: min(done, count - done)] * step % np.uint64(PRIME)
        done *= 2
    return out


class Transform:
    """Number theoretic transforms of the rows of a matrix with ``size`` (a power of two) columns."""

    def __init__(self, size: int):
        self.size, self.prime = size, np.uint64(PRIME)
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        self.there, self.back = powers(root, max(size // 2, 1)), powers(pow(root, -1, PRIME), max(size // 2, 1))
        self.scale = np.uint64(pow(size, -1, PRIME))

    def forward(self, a: np.ndarray) -> np.ndarray:
        """The spectrum in bit-reversed order, in place; products of spectra need no other order."""
        half = self.size // 2
        while half:
            v = a.reshape(-1, 2, half)
            apart = (v[:, 0] + (self.prime - v[:, 1])) * self.there[:: self.size // (2 * half)] % self.prime
            v[:, 0] += v[:, 1]
            v[:, 0] %= self.prime
            v[:, 1] = apart
            half //= 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        """The rows of a spectrum in bit-reversed order, in place."""
        half = 1
        while half < self.size:
            v = a.reshape(-1, 2, half)
            turned = v[:, 1] * self.back[:: self.size // (2 * half)] % self.prime
            v[:, 1] = (v[:, 0] + (self.prime - turned)) % self.prime
            v[:, 0] = (v[:, 0] + turned) % self.prime
            half *= 2
        a *= self.scale
        a %= self.prime
        return a


def differences(t: np.ndarray, squares: np.ndarray, at: np.ndarray, size: int, offset: int, transform: Transform) -> np.ndarray:
    """(block, lag): sum of squared differences, modulo the prime, of the block at ``at`` and the words ``offset + lag`` on; lags 0 to size - 1."""
    p = np.uint64(PRIME)
    block = t[at[:, None] + np.arange(size)].astype(np.uint64)
    spread = np.zeros((len(at), 2 * size), np.uint64)
    spread[:, 0] = block[:, 0]
    spread[:, size + 1 :] = block[:, :0:-1]  # reversed, so that the product of spectra correlates
    window = t[at[:, None] + (offset + np.arange(2 * size))].astype(np.uint64)
    product = transform.forward(spread) * transform.forward(window) % p
    correlation = transform.backward(product)[:, :size]
    place = (at + offset)[:, None] + np.arange(size)
    both = (squares[at + size] - squares[at])[:, None] + (squares[place + size] - squares[place])
    return (both + 2 * (p - correlation)) % p


def seeds(t: np.ndarray, squares: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of every copy of a block of ``size`` words in its scale's distances."""
    transform, found = Transform(2 * size), []
    for offset in (0, size) if size == BASE else (size,):
        rows = max(CELLS // (2 * size), 1)
        for start in range(0, len(blocks), rows):
            at = blocks[start : start + rows]
            row, lag = np.nonzero(differences(t, squares, at, size, offset, transform) == 0)
            keep = offset + lag > 0
            found.append((at[row[keep]], offset + lag[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class Prints:
    """Polynomial hashes of all stretches of a sequence: equal stretches never differ, so an extension is never too short."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, t: np.ndarray):
        self.power = np.full(len(t) + 1, self.BASE)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        mixed = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.power[:-1])])

    def equal(self, at: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[at]) * self.power[distance] == self.sums[end + distance] - self.sums[at + distance]

    def reach(self, place: np.ndarray, distance: np.ndarray, back: bool) -> np.ndarray:
        """The end of the words from ``place`` on, or the start of those before it, that equal the words ``distance`` on; by bisection."""
        sure = place.copy()
        limit = np.zeros(len(place), np.int64) if back else len(self.sums) - 1 - distance
        while (sure != limit).any():
            middle = (sure + limit) // 2 if back else (sure + limit + 1) // 2
            same = self.equal(middle, place, distance) if back else self.equal(place, middle, distance)
            sure = np.where(same, middle, sure)
            limit = np.where(same, limit, middle + 1 if back else middle - 1)
        return sure


def confirmed(t: np.ndarray, low: np.ndarray, high: np.ndarray, period: np.ndarray, least: int, fold: int):
    """The long enough stretches of ``period`` inside [low, high), word by word: what hashes and residues say is only a proposal."""
    out = []
    for a, b, q in zip(low.tolist(), high.tolist(), period.tolist()):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], t[a : b - q] == t[a + q : b], [False]])))
        out += [(a + s, a + e + q, q) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - s + q >= max(least, fold * q)]
    return np.array(out, np.int64).reshape(-1, 3).T


def smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per stretch, with its smallest period, by start and end."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def stretches(numbers: np.ndarray, longest: int, least: int = LEAST, fold: int = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence whose texts end in unique marks; ``longest`` is the longest text."""
    n, far = len(numbers), 2 * longest + 64
    room = 4 * max(longest, BASE) + 4 * BASE
    t = np.concatenate([numbers, np.arange(room) + numbers.max(initial=0) + 1]).astype(np.int64)  # no two numbers of the tail are equal
    order = np.argsort(numbers, kind="stable")
    again = np.full(-(-n // BASE) * BASE, far, np.int64)
    same = numbers[order[1:]] == numbers[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    prints = Prints(t)
    squares = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t * t % PRIME).astype(np.uint64), out=squares[1:])
    start = end = period = np.empty(0, np.int64)
    worst, size = again.reshape(-1, BASE).max(axis=1), BASE  # per block, the longest way to a word's next occurrence
    while size * fold <= max(longest, least):
        known = np.zeros(len(worst) + 1, np.int64)  # blocks whose window lies inside a run
        low, high = -(-start // size), np.maximum((end - 3 * size) // size + 1, -(-start // size))
        np.add.at(known, np.minimum(low, len(worst)), 1)
        np.add.at(known, np.minimum(high, len(worst)), -1)
        blocks = np.flatnonzero((worst < 2 * size) & (known.cumsum()[:-1] == 0)) * size
        place, distance = seeds(t, squares, blocks, size)
        order = np.lexsort((place, distance))
        place, distance = place[order], distance[order]
        head = np.ones(len(place), bool)
        head[1:] = (distance[1:] != distance[:-1]) | (place[1:] != place[:-1] + size)
        tail = np.append(head[1:], True) if len(head) else head
        distance, low, high = distance[head], place[head], place[tail] + size
        low, high = prints.reach(low, distance, True), prints.reach(high, distance, False) + distance
        long = high - low >= np.maximum(least, fold * distance)
        proved = confirmed(t, low[long], high[long], distance[long], least, fold)
        start, end, period = smallest(*(np.concatenate(x) for x in zip((start, end, period), proved)))
        worst = np.append(worst, [far] * (len(worst) % 2)).reshape(-1, 2).max(axis=1)
        size *= 2
    return start, end, period


def number_words(texts):
    """(words, their offsets per text, sequence of numbers with a mark after each text, place of each text in it) of an Arrow array of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(texts)
    words, ends = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[ends].astype(np.int64)
    words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    places = offsets[:-1] + np.arange(len(texts))
    numbers = np.empty(len(words) + len(texts), np.int64)
    marks = offsets[1:] + np.arange(len(texts))
    numbers[marks] = len(coded.dictionary) + np.arange(len(texts))
    inside = np.ones(len(numbers), bool)
    inside[marks] = False
    numbers[inside] = coded.indices.to_numpy(zero_copy_only=False)
    return words, offsets, numbers, places, inside


def analysed(texts, least: int, fold: int):
    """(runs, collapsed texts) of an Arrow array of texts without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, offsets, numbers, places, inside = number_words(texts)
    start, end, period = stretches(numbers, int(np.diff(offsets).max(initial=0)), least, fold)
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = np.searchsorted(places, start, "right") - 1
    bounds = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
    runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start - places[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]))
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = (change.cumsum()[:-1] == 0)[inside]
    left = np.concatenate([[0], np.cumsum(kept)])[offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept))), " ")
    return runs, collapsed


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed (the words outside all repeats, joined by one space)."""
    if least < LEAST or fold < FOLD:
        raise ValueError(f"blocks are sized for runs of {LEAST} words and {FOLD} periods or more")
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            first = 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE, "right")), first + 1)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *analysed(part.column("text"), least, fold)], names=["doc_id", "runs", "collapsed"])
                first = last

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run that repeats most often, by exact comparison of length / period; ties: smallest start, then period. Null where there is none."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, nothing, better)


def listing(runs: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
