"""Call and import graphs: what reaches a sink, in bounded passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df by checkpoint, where the context has a folder for it or the session names one; cached on one machine without either."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined() and (root := sc.getConf().get("spark.checkpoint.dir")):
        sc.setCheckpointDir(root)
    return df.checkpoint() if sc._jsc.sc().getCheckpointDir().isDefined() else df.cache()


def reaches(calls: DataFrame, sinks: DataFrame, passes: int = 8, tags: list[str] = ()) -> DataFrame:
    """(id, *tags, hops): nodes from which a sink (id, *tags) is reached within so many calls (src, dst); hops is the least number, 0 for sinks.

    Only the newly reached ones are joined in each pass; the sinks' tags travel along.
    """
    found = front = cut(sinks.select("id", *tags, F.lit(0).alias("hops")).distinct())
    for n in range(1, passes + 1):
        new = calls.join(front, calls["dst"] == front["id"]).select(F.col("src").alias("id"), *tags, F.lit(n).alias("hops")).distinct()
        front = cut(new.join(found.select("id", *tags), ["id", *tags], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def resolve_exports(exports: DataFrame, passes: int = 6) -> DataFrame:
    """(file, name, home, local): exports (file, name, from_file, from_name; null from_file: own) followed through re-exports."""
    own = exports.where("from_file is null").select("file", "name", F.col("file").alias("home"), F.coalesce("from_name", "name").alias("local"))
    found, front = own, own
    again = exports.where("from_file is not null")
    for _ in range(passes):
        f = front.select(F.col("file").alias("from_file"), F.col("name").alias("from_name"), "home", "local")
        front = again.join(f, ["from_file", "from_name"]).select("file", "name", "home", "local").join(found.select("file", "name"), ["file", "name"], "left_anti").distinct()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
