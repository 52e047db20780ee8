"""Packing of tokenised documents into sequences by a configuration linear program.

1. Map tasks tokenise whole texts, cut documents longer than a sequence into pieces, and
   number the pieces of each length within the task. The pieces (no ids, a CRC of them) are
   written as a table.
2. The histogram of lengths, at most one row for each length up to the sequence's, goes to
   the driver. There the linear program over configurations (multisets of lengths that fit
   a sequence) is solved by multiplicative weights: lengths have prices, a knapsack dynamic
   program finds the dearest configuration through each length that lags behind, and prices
   of lengths that lag rise while those of lengths covered too often fall.
3. The fractional solution is rounded down to whole sequences, best-filled configurations
   first; what is left is packed by best fit over the histogram.
4. The plan (configurations with multiplicities; its size depends on the sequence's length,
   not on the input) goes to the tasks, which look up the sequence of the g-th piece of
   each length. Numbers g come from the counts by task, so that no length, however common,
   meets in one task.

Cases: a null text counts as empty; an empty document is its end id alone. Rows that repeat
a doc_id are documents of their own. Null ids stay null. Empty tables give empty results.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, written

SEQUENCE, END_ID = 4096, 1


# -- tokens ---------------------------------------------------------------------------------

class WordEncoder:
    """Ids of the lower-casing word BPE, whole texts, through a bounded cache of its words' ids.

    The tokenizer splits a text into words before it merges, so a text's ids are its words'
    ids in a row. Texts with characters outside Latin letters (and those with special
    tokens) are given to the tokenizer whole.
    """

    #: Characters on which Python's and the tokenizer's normalisation and classes agree.
    OTHER = re.compile("[^\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]")
    LETTERS = "a-z\xdf-\xf6\xf8-\xffā-ž"
    #: The tokenizer's alternatives; those for letters and digits start unlike the others and may come first.
    WORDS = re.compile(f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9{LETTERS}]+")

    def __init__(self, path: str, words: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids of the words met lately, and of those met before them: words still in use move over, others go.
        self.most, self.cache, self.older = words, {}, {}
        #: Ids that end a word; all words end in one, and no other id of theirs does.
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True

    @staticmethod
    def packed(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.OTHER.search(text) or "<|" in text:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = self.WORDS.findall(text.lower())
        if new := set(words).difference(self.cache):
            if len(self.cache) + len(new) > self.most:
                self.older, self.cache, new = self.cache, {}, set(words)
            for w in new & self.older.keys():
                self.cache[w] = self.older[w]
            self._add(sorted(new.difference(self.cache)))
        return b"".join(map(self.cache.__getitem__, words))

    def _add(self, new: list[str]) -> None:
        """Encodes new words in one go: spaces part words, and each word's ids end with one that ends a word."""
        if new:
            ids = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.is_end[ids]) + 1
            raw, at = self.packed(ids), 0
            for w, end in zip(new, (4 * ends).tolist(), strict=True):
                self.cache[w] = raw[at:end]
                at = end


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """A Python worker's encoder; it lives as long as the worker."""
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(path: str, sequence: int):
    def run(batches):
        encoder, part, seen = encoder_of(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = memoryview(encoder.encode(text or "") + encoder.packed([END_ID]))
                for piece, start in enumerate(range(0, len(raw) // 4, sequence)):
                    n = min(sequence, len(raw) // 4 - start)
                    rows.append((doc, piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


# -- the plan --------------------------------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price of at most c tokens, and the index of a length to take first (-1: none), for each c."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], first[c] = best[c - 1], -2  # -2: as for c - 1
        if n := fits[c]:
            worth = best[c - lengths[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[c]:
                best[c], first[c] = worth[k], k
    return best, first


def _filled(i: int, lengths: np.ndarray, first: np.ndarray, down: np.ndarray, capacity: int) -> Counter:
    """The best configuration through length i."""
    found, left = Counter({i: 1}), capacity - int(lengths[i])
    while (c := int(down[left])) > 0:
        k = int(first[c])
        found[k] += 1
        left = c - int(lengths[k])
    return found


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 16, rate: float = 0.6) -> tuple[dict, float]:
    """A fractional cover {((index, copies), ...): sequences} of the demand, and a lower bound by the prices.

    After round r every length is covered to r / rounds of its demand.
    """
    prices = lengths / capacity
    cover, use, bound = np.zeros(len(lengths)), {}, 0.0
    for r in range(1, rounds + 1):
        best, first = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ demand) / best[capacity])
        down = np.where(first == -2, 0, np.arange(capacity + 1))
        down[first == -1] = 0
        down = np.maximum.accumulate(down)
        target = demand * (r / rounds)
        for i in np.argsort(-lengths):
            if (behind := target[i] - cover[i]) > 1e-9:
                counts = _filled(int(i), lengths, first, down, capacity)
                step = behind / counts[int(i)]
                for k, a in counts.items():
                    cover[k] += a * step
                key = tuple(sorted(counts.items(), reverse=True))
                use[key] = use.get(key, 0.0) + step
        prices = prices * np.exp(rate * np.clip(1 - cover / np.maximum(target, 1e-9), -1, 1))
    return use, bound


def pack_histogram(histogram: dict[int, int], capacity: int = SEQUENCE) -> tuple[list[tuple[Pattern, int]], float]:
    """[(pattern, sequences)] that hold exactly the pieces of the histogram, and the program's lower bound."""
    if not histogram:
        return [], 0.0
    lengths = np.array(sorted(histogram))
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    use, bound = solve(lengths, left.astype(float), capacity)
    plan: Counter = Counter()
    for key, x in sorted(use.items(), key=lambda u: (-sum(int(lengths[k]) * a for k, a in u[0]), u[0])):
        full = sum(int(lengths[k]) * a for k, a in key) == capacity
        n = min(int(np.ceil(x)) if full else int(x), *(int(left[k]) // a for k, a in key))
        if n > 0:
            plan[tuple((int(lengths[k]), a) for k, a in key)] += n
            for k, a in key:
                left[k] -= a * n
    for pattern, n in best_fit({int(x): int(n) for x, n in zip(lengths, left) if n}, capacity):
        plan[pattern] += n
    return list(plan.items()), max(bound, float(sum(x * n for x, n in histogram.items())) / capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: bins that look alike are handled together."""
    gaps: list[int] = []  # sorted, those with bins
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(gap, pattern, n):
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if (i := bisect_left(gaps, length)) < len(gaps):
                gap = gaps[i]
                pattern, m = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(i)
                most = min(gap // length, n)
                if most * m <= n:
                    copies, taken = most, m
                else:
                    copies = max(1, n // m)
                    taken = min(m, n // copies)
                    put(gap, pattern, m - taken) if m > taken else None
                put(gap - copies * length, pattern + ((length, copies),), taken)
                n -= copies * taken
            else:
                copies = capacity // length
                if n // copies:
                    put(capacity - copies * length, ((length, copies),), n // copies)
                if n % copies:
                    put(capacity - (n % copies) * length, ((length, n % copies),), 1)
                n = 0
    return [x for group in bins.values() for x in group]


def lookup_table(plan: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first slot, copies in a sequence, first sequence, offset of the first copy)."""
    rows: dict[int, list] = {}
    slots, sequence = Counter(), 0
    for pattern, n in plan:
        offset = 0
        for length, copies in pattern:
            rows.setdefault(length, []).append((slots[length], copies, sequence, offset))
            slots[length] += n * copies
            offset += length * copies
        sequence += n
    return {x: np.array(r, dtype=np.int64) for x, r in rows.items()}


def _placed(table):
    def run(batches):
        rows = table.value
        for batch in slices(batches):
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                found = rows[int(x)]
                e = found[np.searchsorted(found[:, 0], rank[own], side="right") - 1]
                i = rank[own] - e[:, 0]
                sequence[own] = e[:, 2] + i // e[:, 1]
                offset[own] = e[:, 3] + (i % e[:, 1]) * x
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(read.mapInArrow(_pieces(tokenizer_path, sequence), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan, _ = pack_histogram(histogram, sequence)
    table = spark.sparkContext.broadcast(lookup_table(plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("nth")).cast("long").alias("_rank")
    )
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
