import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sparrowhawk.llm import exact_dedup as X

from .helpers import EDGE, documents, sentence


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "key_bits": 3, "owner_bits": 1}])
def test_edge_cases_and_chained_collisions(spark, options):
    rows = EDGE + [(100 + i, f"text {i % 30}" + " " * (i % 3)) for i in range(120)]
    got = X.exact_groups(documents(spark, rows), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_columns_stay(spark):
    empty = documents(spark, [(1, "x")]).where("false")
    assert X.exact_groups(empty).count() == 0
    docs = documents(spark, EDGE)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in brute(EDGE) if r[3]}


def test_drop_goes_by_row(spark):
    """An id with two texts loses the one that is a copy, in any order of rows."""
    rows = [(5, "other"), (7, "unique"), (7, "other"), (None, "other"), (None, "alone"), (9, None), (9, " "), (2, "")]
    want = sorted([(5, "other"), (7, "unique"), (None, "alone"), (9, " "), (9, None)], key=str)
    for given_rows in (rows, rows[::-1]):
        assert sorted(((r["doc_id"], r["text"]) for r in X.drop_copies(documents(spark, given_rows)).collect()), key=str) == want


@pytest.mark.parametrize("options", [{"owner_bits": 12}, {"owner_bits": 1, "key_bits": 3, "capacity": 2}])
def test_stored_index_answers_for_later_documents(spark, tmp_path, options):
    rows = EDGE + [(100 + i, f"text {i % 30}" + " " * (i % 3)) for i in range(120)]
    groups = X.build_index(documents(spark, rows), f"file://{tmp_path}/index", **options)
    later = [(1000, "text 3"), (1001, "t e x t 3"), (1002, "not there"), (1003, None), (None, sentence(40)), (1004, "x" * 49_999)]
    got = X.find_copies(documents(spark, later), groups, options["owner_bits"], options.get("key_bits", 64)).collect()
    have = {h: (k, n) for _, k, n, _, h in brute(rows)}
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *have[norm(t)]) for i, t in later if norm(t) in have), key=str)


def test_owners_follow_the_rows(spark):
    assert X.owner_bits_for(spark.range(10)) == X.OWNER_BITS
    assert X.owner_bits_for(spark.range(X.OWNER_TEXTS << 13)) == 14


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=80), st.integers(1, 6), st.integers(4, 64))
def test_index_splits_chains_and_compares_bytes(tmp_path_factory, texts, capacity, bits):
    heap = X.Heap(f"file://{tmp_path_factory.mktemp('heap')}", block=16, segment=40, cached=2)
    index = X.Index(heap, 0, capacity, bits)
    for n, t in enumerate(texts):
        digest = hashlib.sha256(t).digest()
        key = int.from_bytes(digest[:8], "big") >> (64 - bits) << (64 - bits)
        index.put(key, digest, t, (len(t), n), 1)
    found = {e["digest"]: (e["n"], e["best"][1]) for _, e in index.entries()}
    assert found == {hashlib.sha256(t).digest(): (texts.count(t), texts.index(t)) for t in texts}
    assert len(index.directory) == 1 << index.depth
    for slot, bucket in enumerate(index.directory):
        for key in bucket.chains:
            assert index._bits(key, index.depth) == slot or bucket.depth < index.depth and index._bits(key, bucket.depth) == slot >> (index.depth - bucket.depth)


def test_heap_reads_what_it_wrote(tmp_path):
    heap = X.Heap(f"file://{tmp_path}/h", block=100, segment=300, cached=1)
    items = [bytes([i]) * (i * 7 % 90) for i in range(100)]
    at = [heap.add(x) for x in items]
    heap.close()
    assert [heap.read(a, len(x)) for a, x in zip(at, items)] == items
    assert pa.Codec.is_available("lz4")
