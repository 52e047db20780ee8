"""Small tables with what can go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near the river bank".split()


def sentence(n, start=0):
    return " ".join(WORDS[(start + 7 * i + i * i) % len(WORDS)] + str((start + i) % 13) for i in range(n))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text[, lang]); extra columns bear names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("n", "key", "id", "digest", "kept", "group_id", "shard", "slot", "size", "keep_id", "length", "part", "block", "a", "b", "d", "_key", "_gone_id"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "one  "), (7, sentence(40)), (8, sentence(40)), (9, "x" * 50_000), (None, "no id"), (10, "ünï çødé ☃ 字"), (7, sentence(40))]
