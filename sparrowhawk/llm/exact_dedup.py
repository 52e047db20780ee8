"""Exact deduplication by an extendible-hash index on shared files.

Three steps:

1. Map tasks normalise every text (the characters of ``[\\x20\\x09-\\x0D]`` are deleted),
   and combine the equal texts they meet, so that a text that fills a third of the table
   leaves each task once.
2. Owner tasks get the distinct texts by range of the hash key, owner after owner. The number
   of owners follows the number of rows, so that an owner has some OWNER_TEXTS texts at any
   size; its extendible-hash index is in memory only until the next owner's begins: a
   directory over the key's next bits that doubles when a bucket is overfull at full depth,
   buckets that split by one bit, and chains for different texts with one key. Texts lie in
   heap segments on the shared folder; a key that is present is compared byte for byte
   against the chain's texts there. A finished index goes to the shared folder too: a page
   for each bucket, and the directory, from which ``find_copies`` looks other documents up
   by range reads of single pages.
3. The groups found are joined to the documents by digest.

A task that is lost is run again: it writes to files named anew, and only what a finished
task returned is used.

``drop_copies`` goes by rows (doc_id and text): another row that bears the doc_id of a dropped
copy stays.

Cases: a null text counts as empty; empty texts are equal to each other and to texts of
white space only. Of equal texts the one with the most code points in the original stays,
then the smallest doc_id (null ids last). Rows that repeat a doc_id with equal texts are
one document: they are kept or dropped together, and group_size counts rows. Empty tables
give empty results. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import open_store, shared_path, shuffle_partitions, slices, written

SPACE = b" \t\n\x0b\x0c\r"
MASK = (1 << 64) - 1
#: Distinct texts of an owner, about; bits of owners at least.
OWNER_TEXTS, OWNER_BITS = 16_384, 12


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


def code_points(text: bytes | None) -> int:
    return len((text or b"").decode("utf-8", "replace"))


def better(a: tuple, b: tuple) -> tuple:
    """The (code points, doc_id) that stays."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


class Heap:
    """Append-only store of byte strings: compressed blocks in segment files on the shared folder."""

    def __init__(self, uri: str, block: int = 1 << 18, segment: int = 1 << 23, cached: int = 48):
        self.fs, self.base = open_store(uri)
        self.fs.create_dir(self.base, recursive=True)
        self.block, self.segment, self.cached = block, segment, cached
        self.codec = pa.Codec("lz4")
        self.parts: list[bytes] = []
        self.open = 0  # bytes in the block that is being filled
        self.pending = b""  # sealed blocks of the segment that is being filled
        self.blocks: list[tuple[int, int, int, int]] = []  # segment, offset, compressed size, size
        self.segments = 0
        self.cache: OrderedDict[int, bytes] = OrderedDict()

    def add(self, data: bytes) -> tuple[int, int]:
        """Where data lies: block and offset."""
        if self.open and self.open + len(data) > self.block:
            self._seal()
        at = (len(self.blocks), self.open)
        self.parts.append(data)
        self.open += len(data)
        return at

    def _seal(self) -> None:
        raw = b"".join(self.parts)
        packed = self.codec.compress(raw, asbytes=True)
        self.blocks.append((self.segments, len(self.pending), len(packed), len(raw)))
        self.pending += packed
        self.parts, self.open = [], 0
        if len(self.pending) >= self.segment:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            with self.fs.open_output_stream(f"{self.base}/heap-{self.segments}") as out:
                out.write(self.pending)
            self.segments += 1
            self.pending = b""

    def close(self) -> None:
        """Writes what is left, and the places of the blocks."""
        if self.open:
            self._seal()
        self.flush()
        with self.fs.open_output_stream(f"{self.base}/heap-blocks", compression=None) as out:
            out.write(np.array(self.blocks, "<i8").tobytes())

    @classmethod
    def stored(cls, uri: str) -> Heap:
        """A closed heap, for reading."""
        heap = cls(uri)
        with heap.fs.open_input_file(f"{heap.base}/heap-blocks") as file:
            heap.blocks = [tuple(b) for b in np.frombuffer(file.read(), "<i8").reshape(-1, 4).tolist()]
        heap.segments = heap.blocks[-1][0] + 1 if heap.blocks else 0
        return heap

    def read(self, at: tuple[int, int], size: int) -> bytes:
        n, offset = at
        if n == len(self.blocks):
            if len(self.parts) > 1:
                self.parts = [b"".join(self.parts)]
            return self.parts[0][offset : offset + size] if self.parts else b""
        raw = self.cache.get(n)
        if raw is None:
            segment, start, packed, full = self.blocks[n]
            if segment == self.segments:
                data = self.pending[start : start + packed]
            else:
                with self.fs.open_input_file(f"{self.base}/heap-{segment}") as file:
                    data = file.read_at(packed, start)
            raw = self.codec.decompress(data, full, asbytes=True)
            self.cache[n] = raw
            if len(self.cache) > self.cached:
                self.cache.popitem(last=False)
        else:
            self.cache.move_to_end(n)
        return raw[offset : offset + size]


class Bucket:
    __slots__ = ("depth", "chains")

    def __init__(self, depth: int):
        self.depth, self.chains = depth, {}


class Index:
    """Extendible hashing over the bits of a 64-bit key that follow the owner's prefix."""

    def __init__(self, heap: Heap, prefix: int, capacity: int, bits: int):
        self.heap, self.prefix, self.capacity = heap, prefix, capacity
        self.most = bits - prefix  # bits there are to split by
        self.depth = 0
        self.directory = [Bucket(0)]
        self.doublings = 0

    def _bits(self, key: int, depth: int) -> int:
        return ((key << self.prefix) & MASK) >> (64 - depth) if depth else 0

    def put(self, key: int, digest: bytes, data: bytes, best: tuple, n: int) -> None:
        bucket = self.directory[self._bits(key, self.depth)]
        chain = bucket.chains.get(key)
        if chain is not None:
            for entry in chain:
                if entry["size"] == len(data) and self.heap.read(entry["at"], len(data)) == data:
                    entry["best"] = better(entry["best"], best)
                    entry["n"] += n
                    return
        entry = {"digest": digest, "at": self.heap.add(data), "size": len(data), "best": best, "n": n}
        if chain is not None:
            chain.append(entry)
            return
        bucket.chains[key] = [entry]
        while len(bucket.chains) > self.capacity and bucket.depth < self.most:
            bucket = self._split(bucket, key)

    def _split(self, bucket: Bucket, key: int) -> Bucket:
        if bucket.depth == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
            self.doublings += 1
        depth = bucket.depth + 1
        halves = Bucket(depth), Bucket(depth)
        for k, chain in bucket.chains.items():
            halves[self._bits(k, depth) & 1].chains[k] = chain
        first = self._bits(key, depth - 1) << (self.depth - depth + 1)
        width = 1 << (self.depth - depth)
        for side in (0, 1):
            for i in range(first + side * width, first + (side + 1) * width):
                self.directory[i] = halves[side]
        return halves[self._bits(key, depth) & 1]

    def distinct(self) -> list[Bucket]:
        """The buckets in the order of their first slot."""
        return list({id(b): b for b in self.directory}.values())

    def entries(self):
        """(key, entry) of all entries."""
        for bucket in self.distinct():
            for key, chain in bucket.chains.items():
                for entry in chain:
                    yield key, entry


#: An entry in a page: key, digest, block and offset in the heap, size, whether there is an id, the id, rows.
ENTRY = struct.Struct("<Q32sIIQ?qq")


class Pages:
    """Finished indexes in one file: pages of buckets, and behind them each owner's directory.

    A directory is: bits split by before it, depth, number of pages, the page of every slot, and
    each page's place and length. ``written`` has the place and length of the owners' directories.
    """

    def __init__(self, heap: Heap):
        self.out = heap.fs.open_output_stream(f"{heap.base}/pages", compression=None)
        self.at = 0
        self.written: dict[int, tuple[int, int]] = {}

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, owner: int, index: Index) -> None:
        buckets = index.distinct()
        number = {id(b): i for i, b in enumerate(buckets)}
        places = []
        for b in buckets:
            rows = [ENTRY.pack(k, e["digest"], *e["at"], e["size"], e["best"][1] is not None, e["best"][1] or 0, e["n"]) for k, chain in b.chains.items() for e in chain]
            places.append(self._write(b"".join(rows)))
        head = np.array([index.prefix, index.depth, len(buckets), *(number[id(b)] for b in index.directory), *(x for p in places for x in p)], "<i8")
        self.written[owner] = self._write(head.tobytes())


class StoredIndex:
    """An owner's finished index: a look-up reads one page, and of the heap the texts whose key and size are equal."""

    def __init__(self, heap: Heap, at: int, length: int):
        self.heap = heap
        self.file = heap.fs.open_input_file(f"{heap.base}/pages")
        head = np.frombuffer(self.file.read_at(length, at), "<i8")
        self.prefix, self.depth, pages = head[:3].tolist()
        slots = 1 << self.depth
        self.slots, self.places = head[3 : 3 + slots], head[3 + slots :].reshape(pages, 2)

    def get(self, key: int, data: bytes) -> tuple[int | None, int] | None:
        """(doc_id that stays, rows) of an equal text, or None."""
        slot = ((key << self.prefix) & MASK) >> (64 - self.depth) if self.depth else 0
        at, length = self.places[self.slots[slot]].tolist()
        for k, _, block, offset, size, has, doc, n in ENTRY.iter_unpack(self.file.read_at(length, at)):
            if k == key and size == len(data) and self.heap.read((block, offset), size) == data:
                return (doc if has else None), n
        return None


COMBINED = "owner int, key long, digest binary, norm binary, points long, doc_id long, n long"
GROUPS = "owner int, base string, at long, length long, digest binary, keep_id long, n long"


def _key(digest: bytes, key_bits: int) -> int:
    return int.from_bytes(digest[:8], "big") & (MASK << (64 - key_bits) & MASK)


def _combiner(owner_bits: int, key_bits: int, most: int = 24 << 20):
    def run(batches):
        have: dict[bytes, list] = {}
        held = 0

        def out():
            rows = list(have.items())
            have.clear()
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                keys = [_key(d, key_bits) for d, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k >> (64 - owner_bits) for k in keys], pa.int32()),
                        pa.array([k - (1 << 64) if k >> 63 else k for k in keys], pa.int64()),
                        pa.array([d for d, _ in part], pa.binary()),
                        pa.array([v[0] for _, v in part], pa.binary()),
                        pa.array([v[1][0] for _, v in part], pa.int64()),
                        pa.array([v[1][1] for _, v in part], pa.int64()),
                        pa.array([v[2] for _, v in part], pa.int64()),
                    ],
                    names=["owner", "key", "digest", "norm", "points", "doc_id", "n"],
                )

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                norm = normalised(text)
                digest = hashlib.sha256(norm).digest()
                best = (code_points(text), doc)
                entry = have.get(digest)
                if entry is not None and entry[0] == norm:
                    entry[1] = better(entry[1], best)
                    entry[2] += 1
                    continue
                have[digest] = [norm, best, 1]
                held += len(norm) + 400
                if held > most:
                    yield from out()
                    held = 0
        yield from out()

    return run


def _owner(folder: str, owner_bits: int, key_bits: int, capacity: int):
    """Rows come sorted by owner. What an owner has is returned once its index is stored."""

    def run(batches):
        base = f"{folder}/{uuid.uuid4().hex}"  # an attempt that is run again never meets the lost one's files
        heap = pages = index = now = None

        def stored():
            pages.add(now, index)
            entries = [e for _, e in index.entries()]
            at, length = pages.written[now]
            for i in range(0, len(entries), 4096):
                part = entries[i : i + 4096]
                columns = [[now] * len(part), [base] * len(part), [at] * len(part), [length] * len(part), [e["digest"] for e in part], [e["best"][1] for e in part], [e["n"] for e in part]]
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["owner", "base", "at", "length", "digest", "keep_id", "n"])

        for batch in slices(batches):
            for owner, key, digest, norm, points, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                if heap is None:
                    heap = Heap(base)
                    pages = Pages(heap)
                if owner != now:
                    if index is not None:
                        yield from stored()
                    now, index = owner, Index(heap, owner_bits, capacity, key_bits)
                index.put(key & MASK, digest, norm, (points, doc), n)
        if heap is not None:
            yield from stored()
            pages.out.close()
            heap.close()

    return run


def _digests(batches):
    for batch in slices(batches):
        digests = pa.array([hashlib.sha256(normalised(x)).digest() for x in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], names=["doc_id", "text_hash", "digest"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def owner_bits_for(docs: DataFrame) -> int:
    """Bits of owners so that one has OWNER_TEXTS texts or so; the count reads no column of a Parquet table."""
    return max(OWNER_BITS, (docs.count() // OWNER_TEXTS).bit_length())


def build_index(docs: DataFrame, folder: str, capacity: int = 64, owner_bits: int | None = None, key_bits: int = 64) -> DataFrame:
    """Builds the index below folder; returns its written table of the distinct texts.

    Columns: digest, keep_id, n; owner, base, at, length: where the owner's directory lies.
    capacity: distinct keys a bucket holds before it splits. owner_bits: the key's first bits
    that make the owner ranges. key_bits below 64 makes keys collide, for tests of chaining.
    """
    bits = owner_bits or owner_bits_for(docs)
    combined = _rows(docs).select("doc_id", "text").mapInArrow(_combiner(bits, key_bits), COMBINED)
    dealt = combined.repartition(shuffle_partitions(docs.sparkSession), "owner").sortWithinPartitions("owner")
    return written(dealt.mapInArrow(_owner(folder, bits, key_bits, capacity), GROUPS), "exact-groups")


def _found(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, digest, keep_id, n of every row."""
    groups = build_index(docs, shared_path(docs.sparkSession, "exact-index"), **options)
    many = groups.where("n > 1").select(F.col("digest").alias("d"), "keep_id", "n")
    rows = _rows(docs).mapInArrow(_digests, "doc_id long, text_hash long, digest binary")
    joined = rows.join(many, rows["digest"] == many["d"], "left")  # a hot digest is split by AQE: many has each once
    keep = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", "text_hash", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Options as in build_index."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return _found(docs, **options).select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are not kept, told by doc_id and text; all columns stay."""
    gone = _found(docs, **options).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"].cast("binary")) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")


def find_copies(docs: DataFrame, groups: DataFrame, owner_bits: int, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, n of the documents whose text a built index has; groups as build_index returned it, bits as it was built with.

    For documents that come later: texts go to the owners' stored indexes, and each is looked up
    by a range read of one page and compared byte for byte. keep_id and n are the index's.
    """
    where = groups.groupBy(F.col("owner").alias("_owner")).agg(F.first(F.struct("base", "at", "length")).alias("_place"))

    def keyed(batches):
        for batch in slices(batches):
            norm = [normalised(x) for x in batch.column(1).to_pylist()]
            keys = [_key(hashlib.sha256(x).digest(), key_bits) for x in norm]
            columns = [batch.column(0), pa.array([k >> (64 - owner_bits) for k in keys], pa.int32()), pa.array([k - (1 << 64) if k >> 63 else k for k in keys], pa.int64()), pa.array(norm, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "owner", "key", "norm"])

    def look(batches):
        last, index = None, None
        for batch in slices(batches):
            found = []
            for doc, key, norm, place in zip(*(c.to_pylist() for c in batch.columns)):
                if place != last:
                    last, index = place, StoredIndex(Heap.stored(place["base"]), place["at"], place["length"])
                if hit := index.get(key & MASK, norm):
                    found.append((doc, *hit))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc_id", "keep_id", "n"])

    rows = _rows(docs).select("doc_id", "text").mapInArrow(keyed, "doc_id long, owner int, key long, norm binary")
    placed = rows.join(where, rows["owner"] == where["_owner"]).select("doc_id", "key", "norm", "_place").sortWithinPartitions("_place")
    return placed.mapInArrow(look, "doc_id long, keep_id long, n long")
