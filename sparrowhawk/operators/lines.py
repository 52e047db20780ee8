"""Files as lines: explode, context, and what is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_comment, lines

#: Folders that are not scanned, and what is.
SKIPPED_DIRS = ["node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage", "vendor", "__pycache__", ".venv", "venv", ".cache", "out"]
EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte", "py", "rb", "go", "java", "php", "json", "yml", "yaml", "env", "sh", "sql",
    "html", "tf", "rs", "kt", "swift", "c", "cpp", "h", "cs", "dart", "scala", "ex", "exs", "astro", "toml",
]
BASENAMES = ["Dockerfile", "docker-compose.yml", "Jenkinsfile", ".npmrc"]
MAX_FILE, LONG_LINE, SNIFFED = 2 * 1024 * 1024, 4000, 8000


def scannable(path: Column, length: Column, dirs=SKIPPED_DIRS, extensions=EXTENSIONS, basenames=BASENAMES) -> Column:
    """Whether a file is scanned, by its path and length alone; pushed below the read of its content."""
    base = F.element_at(F.split(path, "/"), -1)
    skipped = F.exists(F.array(*map(F.lit, dirs)), lambda d: F.concat(F.lit("/"), path).contains(F.concat(F.lit("/"), d, F.lit("/"))))
    ext = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    return (length <= MAX_FILE) & ~skipped & (ext.isin(*extensions) | base.isin(*basenames) | base.startswith(".env"))


def is_binary(content: Column) -> Column:
    """Whether a NUL is among the first bytes of a binary column."""
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(bytearray(b"\0")))


def explode_lines(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """file, line (from 1), text."""
    return files.select(file, F.posexplode(lines(F.col(content))).alias("_pos", "text")).select(file, (F.col("_pos") + 1).alias("line"), "text")


def code_lines(rows: DataFrame) -> DataFrame:
    """Lines that are neither too long nor comments only."""
    return rows.where((F.length("text") <= LONG_LINE) & ~is_comment(F.col("text")))


def near(test: Column, file: str, before: int, after: int) -> Column:
    """Whether the test holds on any line from `before` lines above to `after` below, within a file."""
    around = Window.partitionBy(file).orderBy("line").rowsBetween(-before, after)
    return F.max(test.cast("int")).over(around) == 1


#: What marks a line's surroundings as deliberate.
DELIBERATE = r"(?:eslint-disable|@ts-ignore|istanbul ignore|coverage ignore)"


def safe_context(rows: DataFrame, file: str = "file") -> DataFrame:
    """rows with safe: a deliberate mark within three lines on either side."""
    from ..functions.text import matches

    return rows.withColumn("safe", near(matches(F.col("text"), DELIBERATE), file, 3, 3))
