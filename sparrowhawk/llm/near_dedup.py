"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text is the weighted set of its word shingles (WORDS words; the weight is how often one
occurs). Weighted sets are compared by weighted Jaccard similarity, and two different texts
are linked at THRESHOLD or more. Groups are the connected components of the links.

Signatures: every element has a region, as wide as its weight and as high as the ranks go,
that hashed darts fall on at unit rate by area; so a text's darts up to a rank theta are about
``theta * weight`` in number. The region is made of strips of width one; of the last, where a
weight isn't whole, only that part counts, and darts beyond it are dropped (``strips``). A dart
has a rank and one of K coordinates, and each coordinate keeps its earliest dart. Theta starts
at K ln K + 2 K darts and grows until every coordinate has one. Two texts agree in a coordinate
with the probability of their similarity. A signature takes time in proportion to the text's
length plus K ln K, not to their product.

Steps:

1. Map tasks make signatures, once for equal texts (equal words) within a task; equal texts
   are combined by digest and stand for one class, with a number of its own, from here on.
2. Bands of ROWS coordinates give bucket keys. Every bucket links its members to a leader,
   the member that meets most others over all bands; so a group of n costs n pairs, not n².
   Pairs whose sizes alone rule the threshold out are dropped before any elements travel.
3. Pairs are verified exactly on their elements. Components of the verified links follow by
   alternating large-star and small-star steps.
4. In buckets that still hold several components, the pairs not yet compared are looked at,
   but for texts that cannot reach the threshold with any of the bucket's members because
   too much of their weight lies in elements that no other one has. No pair that shares a
   bucket and reaches the threshold is left out by this.

A pair at similarity s shares no bucket with probability (1 - s**ROWS)**BANDS, 1e-4 at 0.8.

Cases: null texts, and texts without a word, have no elements and are each a group of their
own. A text shorter than a shingle is one element. Texts whose words are equal in order (case
and punctuation don't count) have the same elements and are always one group. A row is told by
doc_id and text: rows that repeat both are one document, rows that repeat a doc_id with other
text are documents of their own, each linked by its own text. group_id is the least doc_id of a
group (null ids last), so two groups can bear one number only where a doc_id repeats with
other text; group_key, the digest of the text that stays, tells those apart (null for a
document without words). Empty tables give empty results; other columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import GOLDEN, discard, mix64, shared_path, slices, working_area, written

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 32
K = ROWS * BANDS
WORD = re.compile(r"\w+")


# -- elements and signatures ------------------------------------------------------------------

def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def elements(words: list[str], n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit unit elements of a text: a shingle that occurs c times gives c of them.

    Weighted Jaccard similarity of two texts is the plain one of their unit elements.
    """
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    m = max(1, len(words) - n + 1)
    s = np.zeros(m, np.uint64)
    for i in range(min(n, len(words))):
        s = mix64(s * GOLDEN + h[i : i + m] + np.uint64(i))
    s.sort()
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    nth = np.arange(m) - np.repeat(new, np.diff(np.r_[new, m]))
    if nth.any():
        s = np.where(nth > 0, mix64(s + nth.astype(np.uint64) * GOLDEN), s)
        s.sort()
    return s


def strips(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strips of width one of elements' regions, sorted, and how much of each counts: 1, or the rest of a weight that isn't whole.

    For whole weights these are the unit elements that ``elements`` makes of repeated shingles.
    """
    many = np.ceil(weights).astype(np.int64)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    cover = np.minimum(1.0, np.repeat(weights, many) - nth)
    s = np.repeat(elements, many)
    s = np.where(nth > 0, mix64(s + nth.astype(np.uint64) * GOLDEN), s)
    order = np.argsort(s, kind="stable")
    return s[order], cover[order]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(sets: list[np.ndarray], k: int = K, covers: list[np.ndarray] | None = None) -> np.ndarray:
    """DartMinHash signatures (len(sets) x k, uint64) of sets of strips; rows of empty sets are 0.

    covers: how much of each strip counts (all, if not given). All sets are handled together:
    each strip holds its next dart, and those whose rank is below their set's theta are thrown
    and move on.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), k), np.uint64)
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    weight = sizes if covers is None else np.array([c.sum() for c in covers])
    cover = None if covers is None else np.concatenate(covers)
    theta = (k * np.log(k) + 2 * k) / np.where(sizes > 0, weight, 1)
    least = np.full(len(sets) * k, np.inf)
    state = mix64(element ^ GOLDEN)
    rank = -np.log(_unit(state))  # of the element's next dart: gaps of a unit-rate Poisson process
    active = np.arange(len(element))
    flat = out.reshape(-1)
    while True:
        while len(active := active[rank[active] <= theta[owner[active]]]):
            dart = mix64(state[active] + np.uint64(0xD1B54A32D192ED03))
            at = owner[active] * k + (dart % np.uint64(k)).astype(np.int64)
            r = rank[active]
            inside = r if cover is None else np.where(_unit(mix64(dart ^ GOLDEN)) < cover[active], r, np.inf)
            np.minimum.at(least, at, inside)
            won = np.isfinite(inside) & (inside == least[at])
            flat[at[won]] = dart[won]
            state[active] = mix64(state[active] + GOLDEN)
            rank[active] = r - np.log(_unit(state[active]))
        short = np.isinf(least).reshape(len(sets), k).any(axis=1) & (sizes > 0)
        if not short.any():
            return out
        theta[short] *= 1.5
        active = np.flatnonzero(short[owner])


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Bucket keys (n x bands, int64) of signatures."""
    rows = signature.shape[1] // bands
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for i in range(rows):
        key = mix64(key * GOLDEN + signature[:, i::rows][:, :bands])
    return key.view(np.int64)


def _chunks(rows: list, most: int = 200_000):
    part, size = [], 0
    for x in rows:
        part.append(x)
        size += len(x[1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


SIGNED = "doc_id long, text_hash long, digest binary, size int, bands array<long>"


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def _sign(batches):
    """bands are null for a digest that this task has met; digest and bands are null for texts without elements."""
    met: OrderedDict[bytes, None] = OrderedDict()
    for batch in slices(batches):
        n = batch.num_rows
        digests, sizes, bands, fresh = [None] * n, [0] * n, [None] * n, []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if not (words := words_of(text)):
                continue
            digest = digests[i] = digest_of(words)
            sizes[i] = max(1, len(words) - WORDS + 1)
            if digest not in met:
                met[digest] = None
                fresh.append((i, elements(words)))
                if len(met) > 200_000:
                    met.popitem(last=False)
        for part in _chunks(fresh):
            keys = bands_of(signatures([e for _, e in part]))
            for (i, _), row in zip(part, keys):
                bands[i] = row
        made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_hash", "digest", "size", "bands"])


#: Bits of the filter of ids that lets a task skip texts in no bucket: its size doesn't depend on the input.
FILTER_BITS = 1 << 23


def _filter_slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS).cast("long"))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS hashed doc_ids, as bytes. A full one lets all pass, and a join decides."""
    slot = _filter_slot("doc_id")
    words = ids.select((slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        bitmap[r["w"]] = r["b"]
    return bitmap.view(np.uint8)


def elements_of(read: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, elements of the classes wanted (id, digest, doc_id of a row that has the text)."""
    bitmap = read.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches):
        for batch in slices(batches):
            slot = batch.column(1).to_numpy(zero_copy_only=False)
            found = batch.filter(pa.array((bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            if found.num_rows:
                words = [w for t in found.column(0).to_pylist() if (w := words_of(t))]
                made = [pa.array([digest_of(w) for w in words], pa.binary()), pa.array([elements(w).tobytes() for w in words], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["digest", "elements"])

    maybe = read.select("text", _filter_slot("doc_id").alias("slot")).mapInArrow(run, "digest binary, elements binary")
    return maybe.join(wanted.select("id", "digest"), "digest").select("id", "elements").dropDuplicates(["id"])


# -- links --------------------------------------------------------------------------------------

def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at the threshold or more; sets: id, elements. A member of many pairs is split by AQE."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))

    def check(batches):
        for batch in slices(batches):
            ea, eb = batch.column(2), batch.column(3)
            last, set_a, ok = None, None, []
            for x, y in zip(ea, eb):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, set_a = x, np.frombuffer(x, np.uint64)
                set_b = np.frombuffer(y, np.uint64)
                low, high = sorted((len(set_a), len(set_b)))
                ok.append(low >= threshold * high and similarity(set_a, set_b) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
    return joined.mapInArrow(check, "a long, b long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, root) of every id of the edges (a, b) but roots themselves; root is the component's least id.

    Alternating large-star and small-star steps, until no edge changes; each round is a written
    table that replaces the one before. Rounds grow with the logarithm of a component's length;
    more than given raise, as what there is then would not be the components. Aggregates combine
    on the map side, so that a hub is no burden.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # large-star leaves edges from greater to smaller ids
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        before, edges = edges, written(small.where("a <> b").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, group_id (the least doc_id of its group), kept (it is the one that stays), group_key."""
    return _grouped(docs, threshold).select("doc_id", "group_id", "kept", F.lower(F.hex("stays")).alias("group_key"))


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_hash, group_id, kept, stays (digest of the group's text that stays) of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = written(read.mapInArrow(_sign, SIGNED), "signed")
    # The row that stands for a class: least doc_id, null last. Numbers are made once, as the table is written.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    grouped = signed.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    classes = written(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    at = shared_path(spark, "roots")
    with working_area(spark, "near-links"):
        roots = written(_roots(read, classes, threshold), "roots", at)

    placed = classes.join(roots, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("best"))
    groups = placed.join(best, "root").select("digest", F.col("best.first").alias("keep"), F.col("best.digest").alias("stays"))
    rows = signed.select("doc_id", "text_hash", "digest").join(groups, "digest", "left")
    alone = F.col("digest").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash")))
    return rows.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("group_id"), kept.alias("kept"), "stays")


def _roots(read: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """id, root of the classes that have links to others of lesser number."""
    # Buckets of two classes or more; the leader is the member that meets most others over all bands.
    # Counts and leaders are tables, so that a join's both sides come straight from an exchange and AQE can split a hot bucket.
    entries = classes.select("id", "size", F.explode("bands").alias("key"))
    counts = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = written(entries.join(counts, "key"), "shared")
    discard(counts)
    weight = written(shared.groupBy("id").agg(F.sum("n").alias("w")), "weight")
    ranked = shared.join(weight, "id").select("key", "id", "size", "w")
    lead = F.max_by(F.struct("id", "size"), F.struct("w", -F.col("id")))
    leaders = written(ranked.groupBy("key").agg(lead.alias("lead")).select("key", F.col("lead.id").alias("leader"), F.col("lead.size").alias("leader_size")), "leaders")
    members = written(shared.join(leaders, "key").select("key", "id", "n", "size", "leader", "leader_size"), "members")
    discard(shared, weight, leaders)

    ids = members.select("id").distinct()
    sets = written(elements_of(read, classes.select("id", "digest", F.col("first.doc_id").alias("doc_id")).join(ids, "id", "left_semi")), "elements")

    near = F.least("size", "leader_size") >= threshold * F.greatest("size", "leader_size") - 1e-9
    pairs = members.where((F.col("id") != F.col("leader")) & near).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(pairs, sets, threshold), "links")
    roots = components(links)
    open_ = _open_buckets(members, roots, sets, threshold)
    if open_ is not None:
        more = written(verified(_remaining(open_, threshold), sets, threshold), "links")
        if not more.isEmpty():
            roots = components(links.unionAll(more))
    return roots


def _open_buckets(members: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """key, id, leader, root, apart, size, parts, most of members of buckets in which some aren't with the leader; None if there is no such bucket.

    parts: in each of PARTS hash parts, how many of a text's elements some other such member
    has; most: their sum. A text with less than threshold of its weight cannot reach the
    threshold with any of them and is left out. apart: its component isn't the leader's.
    """
    placed = written(members.where("n > 2").join(roots, "id", "left").select("key", "id", "leader", F.coalesce("root", "id").alias("root")), "placed")
    leading = written(placed.where("id = leader").select("key", F.col("root").alias("leading")), "leading")
    placed = written(placed.join(leading, "key").withColumn("apart", F.col("root") != F.col("leading")), "placed")
    broken = written(placed.where("apart").select("key").distinct(), "broken")
    open_ = written(placed.join(broken, "key", "left_semi"), "open")
    if open_.isEmpty():
        return None
    asked = sets.join(open_.select("id").distinct(), "id", "left_semi")
    common = asked.mapInArrow(_explode, "id long, element long").groupBy("element").agg(F.count("*").alias("c"), F.min("id").alias("only"))
    part = F.pmod("element", F.lit(PARTS).cast("long")).cast("int")
    alone = common.where("c = 1").groupBy(F.col("only").alias("id"), part.alias("part")).agg(F.count("*").cast("int").alias("n"))
    alone = alone.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("alone"))  # PARTS entries at most
    able = asked.mapInArrow(_part_sizes, "id long, size int, parts array<int>").join(alone, "id", "left")
    own = lambda i: F.coalesce(F.try_element_at("alone", i), F.lit(0))
    able = able.select("id", "size", F.when(F.col("alone").isNull(), F.col("parts")).otherwise(F.transform("parts", lambda n, i: n - own(i))).alias("parts"))
    able = able.withColumn("most", F.aggregate("parts", F.lit(0), lambda x, n: x + n))
    return written(open_.join(able.where(F.col("most") >= threshold * F.col("size") - 1e-9), "id"), "able")


def _remaining(open_: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a bucket but neither a component nor (with a leader) a comparison, and that could reach the threshold."""
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("id", "root", "apart", "size", "parts", "most", "keys")]
    keys = open_.groupBy("id").agg(F.collect_set("key").alias("keys"))  # a text has BANDS keys at most
    rows = open_.where("id <> leader").join(keys, "id")
    # What the two have in common at most, over all and part by part, and whether that would do.
    enough = lambda both: both * (1 + threshold) >= threshold * (F.col("size_a") + F.col("size_b")) - 1e-9
    by_part = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, n: x + n)
    reach = enough(F.least("most_a", "most_b")) & enough(by_part)
    # A pair is made once: in the first bucket that it shares, and by id if both are apart.
    once = F.expr("(not apart_b or id_a < id_b) and key = array_min(array_intersect(keys_a, keys_b))")
    pairs = rows.where("apart").select("key", *side("a")).join(rows.select("key", *side("b")), "key")
    pairs = pairs.where((F.col("root_a") != F.col("root_b")) & reach & once)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


#: Hash parts in which two texts' elements are counted to bound what they have in common.
PARTS = 64


def _part_sizes(batches):
    for batch in slices(batches):
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        parts = [np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(parts, pa.list_(pa.int32()))], names=["id", "size", "parts"])


def _explode(batches):
    for batch in slices(batches):
        ids, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(ids), 256):
            parts = [np.frombuffer(s, np.int64) for s in sets[i : i + 256]]
            owner = np.repeat(np.array(ids[i : i + 256], np.int64), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(parts))], names=["id", "element"])


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group; all columns stay. Rows go by doc_id and text, so that another row of the doc_id stays."""
    gone = _grouped(docs, threshold).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")
