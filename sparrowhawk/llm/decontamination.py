"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into windows of WINDOW characters that overlap by half, and of SHORT
characters, one each STRIDE; the last of each size is at the item's end. Items of fewer than
WINDOW characters are one window of their own beside those. A window is leaked in a text if a
region of the text is within its edit budget, BUDGET of its characters, whatever its size. So a passage of SHORT + STRIDE - 1 = 55
characters or more, from anywhere in an item, holds a whole window. A leaked region shares at
least ``w - q + 1 - k q`` of the window's w - q + 1 q-grams (k: the edits), and these lie
within k diagonals (text position less window position). So:

1. Every text is scanned for the items' q-grams; hits are counted in overlapping bands of
   diagonals of the whole item, and items whose bands could not hold any window are dropped.
2. The hits left are dealt to the windows that have them, and counted in overlapping bands of
   2 k diagonals, stepping by k, so that one band has all the diagonals of a region. Bands
   with fewer hits than the bound are dropped; no region within the budget is lost.
3. The others are verified: alignment of the window with the text, restricted to the band
   and k diagonals on either side, with free ends in the text.

Characters: lower case, runs of white space are one space. The q-grams are hashed from one
byte for each character, alignment compares whole code points.

Items of fewer than MIN_ITEM characters, which few edits would turn into something else, are
looked for as they are, as whole words, by an automaton in the same scan.

The benchmark is a stated query set, whose size is looked at first. It is collected and scanned
for in blocks of about BLOCK_CHARS characters, one after the other: a block's matches are a
written table, and its tables are released, before the next is collected.

Cases: null texts and items, and empty ones, have no matches. Repeated items match alike. A row
is told by doc_id and text: rows that repeat both are one document, rows that repeat a doc_id
with other text are documents of their own, also in ``drop_leaked``; a null doc_id is one like
any other. A null item_id is not looked for. Empty tables give empty results; other columns, whatever their
names, are not looked at. Texts of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, written

#: With q = 7 every window of MIN_ITEM characters or more shares a q-gram with a region within its budget.
Q, WINDOW, SHORT, STRIDE, BUDGET, MIN_ITEM = 7, 80, 48, 8, 0.1, 24
#: q-grams are read as 64-bit words and cut to q bytes.
WIDTH, CUT = 8, np.uint64((1 << 8 * Q) - 1)
BLOCK_CHARS = 1_000_000
#: Slots for each q-gram in the table that rules out most others at once; characters scanned together.
SLOTS, SCAN_CHARS = 64, 1 << 21
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and a byte of each for the q-grams (the same for characters below 256)."""
    try:
        one = np.frombuffer(text.encode("latin-1"), np.uint8)
        return one, one
    except UnicodeEncodeError:
        full = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return full, ((full ^ (full >> 8) ^ (full >> 16)) & 0xFF).astype(np.uint8)


def qgrams(one: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, q-grams as 64-bit words) of all q-grams of bytes, in WIDTH parts."""
    many = len(one) - Q + 1
    padded = np.concatenate([one, np.zeros(WIDTH, np.uint8)])
    out = []
    for s in range(min(WIDTH, max(0, many))):
        n = (many - s + WIDTH - 1) // WIDTH
        out.append((np.arange(n) * WIDTH + s, padded[s : s + n * WIDTH].view("<u8") & CUT))
    return out


def sizes(length: int) -> list[tuple[int, int]]:
    """The sizes of an item's windows, and from how many characters to how many they start."""
    whole = [(min(length, WINDOW), WINDOW // 2)]
    return whole + [(SHORT, STRIDE)] if length > SHORT else whole


def cut(length: int) -> list[tuple[int, int]]:
    """Starts and ends of the windows of an item: those of each size, the last at the item's end."""
    return [(s, s + size) for size, step in sizes(length) for s in [*range(0, length - size, step), length - size]]


@dataclass
class Matcher:
    """The windows of benchmark items, and the items' q-grams with where they occur."""

    items: list[tuple[int, str]]

    def __post_init__(self):
        #: Short items by text.
        self.short: dict[str, list[int]] = {}
        for item, text in sorted(set(self.items)):
            if 0 < len(text) < MIN_ITEM:
                self.short.setdefault(text, []).append(item)
        self.windows: list[tuple[int, int, int]] = []  # item's id, windows of the item, start in the item
        patterns, self.k, self.need = [], [], []
        grams, owner, place = [], [], []
        every = sorted(x for x in set(self.items) if len(x[1]) >= MIN_ITEM)
        #: By item and size of its windows: the size, the first window, how many (0: none), the step.
        self.families = np.tile(np.array([0, 0, 0, 1], np.int64), (len(every), 2, 1))
        self.least = np.zeros(len(every), np.int64)
        for number, (item, text) in enumerate(every):
            full, one = codes(text)
            full, first = full.astype(np.uint32), len(self.windows)
            for at, g in qgrams(one):
                grams.append(g)
                owner.append(np.full(len(g), number))
                place.append(at)
            spans = cut(len(text))
            for i, (size, step) in enumerate(sizes(len(text))):
                self.families[number, i] = size, len(self.windows), sum(e - s == size for s, e in spans), step
                for s, e in spans:
                    if e - s == size:
                        k = int(BUDGET * size)
                        self.windows.append((item, len(spans), s))
                        patterns.append(full[s:e])
                        self.k.append(k)
                        self.need.append(size - Q + 1 - k * Q)
            self.least[number] = min(self.need[first:])
        self.k, self.need = np.array(self.k, np.int64), np.array(self.need, np.int64)
        self.starts = np.array([s for _, _, s in self.windows], np.int64)
        self.longest = max((len(t) for _, t in every), default=0)
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.patterns = np.zeros((len(patterns), int(self.length.max(initial=0))), np.uint32)
        for i, p in enumerate(patterns):
            self.patterns[i, : len(p)] = p
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = (np.concatenate(owner) if grams else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if grams else np.zeros(0, np.int64))[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        bits = min(26, max(16, (SLOTS * len(self.grams)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.grams * FACTOR) >> self.shift] = True

    def hits(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions and gram numbers of the q-grams that windows have."""
        found = []
        for place, g in qgrams(one) if len(self.grams) else ():
            at = np.flatnonzero(self.table[(g * FACTOR) >> self.shift])
            n = np.searchsorted(self.grams, g[at])
            n[n == len(self.grams)] = 0
            same = self.grams[n] == g[at]
            found.append((place[at[same]], n[same]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def exact(self, text: str) -> list[tuple[int, int, int]]:
        """(item, start, end) of the short items that stand in the text as whole words."""
        if not self.short:
            return []
        if not hasattr(self, "automaton"):
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for short, ids in self.short.items():
                self.automaton.add_word(short, (len(short), ids))
            self.automaton.make_automaton()
        inside = lambda i, j: 0 <= i and j < len(text) and text[i].isalnum() and text[j].isalnum()
        found = []
        for last, (n, ids) in self.automaton.iter(text):
            s, e = last - n + 1, last + 1
            if not inside(s - 1, s) and not inside(e - 1, e):
                found += [(item, s, e) for item in ids]
        return found

    def dense(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text positions, items and places in these of the q-grams in bands that could hold a window."""
        at, gram = self.hits(one)
        n = self.count[gram]
        entry = np.repeat(self.first[gram] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        at, item, place = np.repeat(at, n), self.owner[entry], self.place[entry]
        step = max(1, int(BUDGET * WINDOW))  # as wide as the most edits of any window
        span = (len(one) + self.longest) // step + 3
        keys, back, counts = np.unique(item * span + (at - place + self.longest) // step, return_inverse=True, return_counts=True)
        after = np.zeros(len(keys), np.int64)
        after[:-1] = np.where(np.diff(keys) == 1, counts[1:], 0)
        before = np.zeros(len(keys), np.int64)
        before[1:] = np.where(np.diff(keys) == 1, counts[:-1], 0)
        ok = (counts + np.maximum(before, after) >= self.least[keys // span])[back]
        return at[ok], item[ok], place[ok]

    def candidates(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands that meet the bound; diagonals count from -WINDOW."""
        at, item, place = self.dense(one)
        found = []
        for size, first, many, step in np.moveaxis(self.families[item], 0, 2):  # windows that have the place: from low to high
            low = np.minimum(-(-np.maximum(place - size + Q, 0) // step), many - 1)
            high = np.where(place >= self.starts[first + many - 1], many - 1, place // step)
            n = np.where(many > 0, high - low + 1, 0)
            hit = np.repeat(np.arange(len(at)), n)
            found.append((hit, (first + low)[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)))
        hit, window = (np.concatenate(x) for x in zip(*found))
        diagonal = at[hit] - place[hit] + self.starts[window] + WINDOW
        step = np.maximum(self.k, 1)[window]
        band = diagonal // step
        span = len(one) + 2 * WINDOW + 2
        key = np.concatenate([window * span + band, window * span + band - 1])  # band >= 0 as diagonal >= 0; -1 is a band too
        keys, counts = np.unique(key + 1, return_counts=True)
        window, band = (keys - 1) // span, (keys - 1) % span
        # band -1 of a window would look like the last one of the window before
        wrapped = band == span - 1
        window, band = np.where(wrapped, window + 1, window), np.where(wrapped, -1, band)
        ok = counts >= self.need[window]
        return window[ok], band[ok] * np.maximum(self.k, 1)[window[ok]] - WINDOW

    def align(self, full: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least edits of each window against the text about its band, and where in the text that ends."""
        edits, ends = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        shapes = self.length[window] * (WINDOW + 1) + self.k[window]
        for shape in np.unique(shapes):
            own = np.flatnonzero(shapes == shape)
            w, k = divmod(int(shape), WINDOW + 1)
            start = diagonal[own] - k
            wide = 4 * max(k, 1)
            c = np.arange(wide, dtype=np.int16)
            pattern = self.patterns[window[own], :w]
            p = start[:, None] + np.arange(wide + w)
            text = np.where((p >= 0) & (p < len(full)), full[np.clip(p, 0, len(full) - 1)].astype(np.uint32), np.uint32(0xFFFFFFFF))
            last = np.zeros((len(own), wide), np.int16)  # by diagonal, after j characters of the window
            for j in range(w):
                now = last + (text[:, j : j + wide] != pattern[:, j : j + 1])
                now[:, :-1] = np.minimum(now[:, :-1], last[:, 1:] + 1)
                last = np.minimum.accumulate(now - c, axis=1) + c
            best = last.argmin(axis=1)
            edits[own] = last[np.arange(len(own)), best]
            ends[own] = start + best + w
        return edits, ends

    def find(self, text_codes: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(window, edits, start, end) of the windows leaked, the best of each window and place."""
        full, one = text_codes
        window, diagonal = self.candidates(one)
        if not len(window):
            return []
        out = []
        for i in range(0, len(window), 4096):
            w, d = window[i : i + 4096], diagonal[i : i + 4096]
            edits, ends = self.align(full, w, d)
            ok = edits <= self.k[w]
            out += zip(w[ok].tolist(), edits[ok].tolist(), (ends - self.length[w])[ok].tolist(), ends[ok].tolist())
        return out


RESULT = "doc_id long, text_hash long, item_id long, windows int, matched int, edits int, start long, end long"


#: Between texts that are scanned together: more characters than any window's edits, so that no region goes from one to the next.
GAP = "\0" * (int(BUDGET * WINDOW) + 1)
NAMES = ["doc_id", "text_hash", "item_id", "windows", "matched", "edits", "start", "end"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _scan(matcher):
    def flush(m: Matcher, docs: list, texts: list[str]):
        joined = GAP.join(texts)
        bounds = np.cumsum([len(t) + len(GAP) for t in texts])
        found: dict = {}

        def place(s, e):
            """The text that the region lies in, and s and e in it; a region may begin in the gap before its text."""
            i = int(np.searchsorted(bounds, max((s + e) // 2, 0), side="right"))
            base = int(bounds[i]) - len(texts[i]) - len(GAP)
            return i, max(0, s - base), min(e - base, len(texts[i]))

        for w, e, s, t in m.find(codes(joined)):
            i, s, t = place(s, t)
            item, n, _ = m.windows[w]
            found.setdefault((i, item, n), {}).setdefault(w, []).append((e, s, t))
        for item, s, t in m.exact(joined):
            i, s, t = place(s, t)
            found.setdefault((i, item, 1), {}).setdefault(-1, [(0, s, t)])
        rows = []
        for (i, item, n), hit in found.items():
            every = [x for v in hit.values() for x in v]
            rows.append((*docs[i], item, n, len(hit), sum(min(v)[0] for v in hit.values()), min(x[1] for x in every), max(x[2] for x in every)))
        columns = list(zip(*rows)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], names=NAMES)

    def run(batches):
        m = matcher.value
        docs, texts, size = [], [], 0
        for batch in slices(batches):
            for doc, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text := normalised(text):
                    docs.append((doc, hashed))
                    texts.append(text)
                    size += len(text)
                if size >= SCAN_CHARS:
                    yield flush(m, docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield flush(m, docs, texts)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document (doc_id and text) and item of which a window is leaked in it.

    doc_id, item_id, windows (of the item), matched (of these), edits (least, summed over the
    matched), start and end (of the matched regions, in the normalised text).
    """
    return _found(docs, benchmark, block_chars).drop("text_hash")


def _found(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(Matcher([(r["item_id"], normalised(r["text"])) for r in rows]))
        found = read.mapInArrow(_scan(sent), RESULT)
        if blocks > 1:
            found = written(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionAll(found)
    return out.dropDuplicates(["doc_id", "text_hash", "item_id"])


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak a window of the benchmark, told by doc_id and text; all columns stay."""
    gone = _found(docs, benchmark).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")
