"""Snapshots against one another: findings, components, hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F


def baseline_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """rule_id, file, snippet, status of findings: resolved, remaining (both of the base), or introduced.

    A finding of the base remains if its rule is still found in its file, whatever the line;
    a current one is introduced if its rule was not found in its file.
    """
    loose, columns = ["rule_id", "file"], ["rule_id", "file", "snippet"]
    both = base.select(*columns, F.lit(True).alias("_base")).unionByName(current.select(*columns, F.lit(False).alias("_base")))
    w = Window.partitionBy(*loose)
    seen = both.withColumns({"_was": F.bool_or("_base").over(w), "_is": F.bool_or(~F.col("_base")).over(w)})
    status = F.when(F.col("_base"), F.when(F.col("_is"), "remaining").otherwise("resolved")).when(~F.col("_was"), "introduced")
    return seen.select(*columns, status.alias("status")).where("status is not null")


def trend(base: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Counts of resolved, new and persisted keys, and whether it gets better."""
    b, c = base.select(key).distinct().withColumn("_b", F.lit(1)), current.select(key).distinct().withColumn("_c", F.lit(1))
    both = b.join(c, key, "full_outer")
    out = both.agg(
        F.count_if(F.col("_c").isNull()).alias("resolved"), F.count_if(F.col("_b").isNull()).alias("new"), F.count_if(F.col("_b").isNotNull() & F.col("_c").isNotNull()).alias("persisted")
    )
    return out.withColumn("improving", F.col("resolved") > F.col("new"))


def component_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """name, from_version, to_version, change (added, removed, changed) of components (name, version)."""
    b, h = base.select("name", F.col("version").alias("from_version")), head.select("name", F.col("version").alias("to_version"))
    j = b.withColumn("_b", F.lit(1)).join(h.withColumn("_h", F.lit(1)), "name", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(~F.col("from_version").eqNullSafe(F.col("to_version")), "changed")
    return j.withColumn("change", change).where("change is not null").select("name", "from_version", "to_version", "change")


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, hash, changed of files (path, content) against hashes of the last run (path, hash)."""
    now = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    was = cache.select("path", F.col("hash").alias("_was"))
    return now.join(was, "path", "left").select("path", "hash", (~F.col("hash").eqNullSafe(F.col("_was"))).alias("changed"))


def integrity(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status (intact, modified, missing) of a manifest (path, hash) against files (path, hash)."""
    j = manifest.join(actual.select("path", F.col("hash").alias("_now")), "path", "left")
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("hash"), "modified").otherwise("intact")
    return j.select("path", status.alias("status"))


GENESIS = "GENESIS"


def link_hash(previous: Column, content: Column) -> Column:
    """An entry's hash: over the hash before it and its own content, so that a changed entry changes all later hashes."""
    return F.sha2(F.concat(previous, F.lit("\n"), F.coalesce(content, F.lit(""))), 256)


def hash_chain(entries: DataFrame, key: list[str], order: list[str], content: Column) -> DataFrame:
    """entries with previous_hash (GENESIS first) and hash, by key in the given order (null content counts as empty).

    A hash depends on all before it, so that a key's entries are folded one after the other: in
    the order of a sort that may spill, batch by batch, with one hash in memory. Keys are in
    parallel; a single key is one task's work, as a chain can't be cut.
    """
    names = [f"`{c}`" for c in entries.columns]
    rows = entries.select(F.struct(*names).alias("row"), F.coalesce(content, F.lit("")).alias("content"), F.xxhash64(*key).alias("at"), F.struct(*key).alias("key"), F.struct(*order).alias("order"))
    sorted_ = rows.repartition("at").sortWithinPartitions("at", "key", "order").select("row", "content", F.to_json("key").alias("key"))

    def fold(batches):
        now, last = None, GENESIS
        for pdf in batches:
            before, own = [], []
            for k, c in zip(pdf["key"], pdf["content"]):
                if k != now:
                    now, last = k, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}\n{c}".encode("utf-8", "replace")).hexdigest()
                own.append(last)
            yield pdf.drop(columns=["content", "key"]).assign(previous_hash=before, hash=own)

    kept = sorted_.schema["row"].dataType.simpleString()
    made = sorted_.select(F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), "content", "key").mapInPandas(fold, "row string, previous_hash string, hash string")
    return made.select(F.from_json("row", kept).alias("row"), "previous_hash", "hash").select("row.*", "previous_hash", "hash")


def verify_chain(entries: DataFrame, key: list[str], order: list[str], content: Column | None = None) -> DataFrame:
    """entries with link_ok (previous_hash is the hash of the entry before) and, given content, hash_ok (hash is that of both)."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = entries.withColumn("link_ok", F.col("previous_hash") == F.lag("hash", 1, GENESIS).over(w))
    return df.withColumn("hash_ok", F.col("hash") == link_hash(F.col("previous_hash"), content)) if content is not None else df


def audit_summary(entries: DataFrame, kind: str, ts: str) -> DataFrame:
    """Per kind: number, first and last time, seconds between."""
    return entries.groupBy(kind).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))).alias("duration_us")
    )


def last_entries(entries: DataFrame, order: str, n: int) -> DataFrame:
    return entries.orderBy(F.desc(order)).limit(n)
