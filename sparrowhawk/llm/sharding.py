"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards; a node weighs as much as its shards together. A row
descends: at each level every child throws a weighted hash draw, ``-ln(u) / weight`` with u
hashed from the child's name and the row's id, and the least draw wins. A change of weights
moves rows only between the changed node and its siblings, on the path from the root: other
subtrees keep what they hold. ``tree_for`` adds every shard beyond the base as a region of
its own, so that it takes rows only into itself (law ``key``).

Cases: a null text has size 8 and the CRC of empty bytes; a null id is hashed as its own
key. Rows that repeat an id go to the same shard and get slots of their own. Slots run from
0 without gaps in each shard, by id within a hash bucket. Empty tables give empty results;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: {region: {rack: {shard: weight}}}
Tree = dict[int, dict[int, dict[int, float]]]

#: Hash buckets per shard: slots are counted in each and put behind one another. The table
#: of counts has at most this number of rows a shard, whatever the input's size.
SLOT_BUCKETS = 1024


def tree_for(shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0 to base - 1 in regions of racks x per_rack; each further shard in a region of its own."""
    tree: Tree = {}
    for shard in range(shards):
        if shard < base:
            region, place = divmod(shard, racks * per_rack)
            rack = place // per_rack
        else:
            region, rack = base + shard, 0
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _hashed(text: Column) -> Column:
    """52 bits of a string's MD5 as a double."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def _nodes(children: dict, name: str = "") -> Column:
    """A level as an array of (name, weight, what lies below); literals only, folded once by Catalyst."""
    weight = lambda x: float(sum(map(weight, x.values()))) if isinstance(x, dict) else float(x)
    return F.array(
        *[
            F.struct(
                F.lit(f"{name}{c}").alias("name"),
                F.lit(weight(x)).alias("weight"),
                (_nodes(x, f"{name}{c}/") if isinstance(x, dict) else F.lit(c)).alias("below"),
            )
            for c, x in children.items()
        ]
    )


def shard_of(tree: Tree, key: Column) -> Column:
    """The shard that a row of this (string) key descends to."""
    def draw(node):
        u = (_hashed(F.concat(node["name"], F.lit("|"), key)) + 0.5) / float(1 << 52)
        return F.struct((-F.ln(u) / node["weight"]).alias("draw"), node["below"].alias("below"))

    at = _nodes(tree)
    for _ in ("region", "rack", "shard"):
        at = F.array_min(F.transform(at, draw))["below"]
    return at


def slots(df: DataFrame, shard: str, order: list[str], bucket_of: str) -> DataFrame:
    """df with slot, gapless from 0 within each shard.

    Rows are numbered in hash buckets of each shard (no task gets a whole shard), and each
    bucket starts where the one before ends. The counts are at most SLOT_BUCKETS a shard.
    """
    df = df.withColumn("_bucket", (_hashed(F.concat(F.lit("slot|"), F.col(bucket_of))) % SLOT_BUCKETS).cast("int"))
    counts = df.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)) - 1)
    return ranked.join(starts, [shard, "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_start")


def assign(docs: DataFrame, shards: int = 24, base: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key"),
    )
    key = F.col("_key")
    rows = rows.withColumns({"shard": shard_of(tree_for(shards, base), key), "grown_shard": shard_of(tree_for(shards + 1, base), key)})
    rows = slots(rows, "shard", ["_key", "size", "text_crc32"], "_key")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def oracle_sql(shards: int = 24, base: int = 24) -> str:
    """DuckDB SQL for assign: one row for each node of the trees, least draw by arg_min, CRC-32 by table."""
    def leaves(n):
        w = lambda x: sum(map(w, x.values())) if isinstance(x, dict) else x
        t = tree_for(n, base)
        return ", ".join(f"({g}, {w(t[g])}, {c}, {w(t[g][c])}, {s}, {x})" for g in t for c in t[g] for s, x in t[g][c].items())

    u = lambda name: f"((('0x' || substr(md5({name} || '|' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r})"
    draw = lambda name, weight: f"(-ln({u(name)}) / {weight})"

    def down(t):
        return f"""
{t}r AS (SELECT k, arg_min(g, {draw('g::VARCHAR', 'gw')}) g FROM keys, (SELECT DISTINCT g, gw FROM {t}) GROUP BY k),
{t}a AS (SELECT k, r.g, arg_min(c, {draw("(r.g::VARCHAR || '/' || c)", 'cw')}) c FROM {t}r r JOIN (SELECT DISTINCT g, c, cw FROM {t}) x ON x.g = r.g GROUP BY k, r.g),
{t}s AS (SELECT k, arg_min(s, {draw("(a.g::VARCHAR || '/' || a.c || '/' || s)", 'sw')}) s FROM {t}a a JOIN {t} x ON x.g = a.g AND x.c = a.c GROUP BY k)"""

    return f"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))),
docs AS (SELECT doc_id, coalesce(text, '') txt, coalesce(doc_id::VARCHAR, 'null') k, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
hexed AS (SELECT *, hex(encode(txt)) h FROM docs),
crcs AS (SELECT doc_id, txt, k, size, CASE WHEN size = 8 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda v, b: xor(v >> 8, t[xor(v & 255, b) + 1]))) END AS text_crc32 FROM hexed, crc),
keys AS (SELECT DISTINCT k FROM docs),
base(g, gw, c, cw, s, sw) AS (VALUES {leaves(shards)}),
grown(g, gw, c, cw, s, sw) AS (VALUES {leaves(shards + 1)}),{down('base')},{down('grown')}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, b.s::INTEGER AS shard, g.s::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY b.s ORDER BY ('0x' || substr(md5('slot|' || k), 1, 13))::BIGINT % {SLOT_BUCKETS}, k, size, text_crc32) - 1 AS slot
FROM crcs JOIN bases b USING (k) JOIN growns g USING (k)"""
