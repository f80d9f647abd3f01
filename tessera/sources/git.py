"""Git trees and status texts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_status(status: DataFrame, line: str) -> DataFrame:
    """Rows of ``git status --porcelain`` lines: path, state (dirty, untracked, deleted, renamed), previous_path.

    Quotes around names are taken off. Lines that are too short, or null, are left out.
    """
    code, rest = F.substring(line, 1, 2), F.expr(f"substring({line}, 4)")
    bare = lambda c: F.regexp_replace(c, r'^"(.*)"$', "$1")
    state = F.when(code == "??", "untracked").when(code.contains("R"), "renamed").when(code.contains("D"), "deleted").otherwise("dirty")
    arrow = rest.contains(" -> ")
    path = F.when(arrow, F.regexp_extract(rest, r" -> (.*)$", 1)).otherwise(rest)
    previous = F.when(arrow, bare(F.regexp_extract(rest, r"^(.*?) -> ", 1)))
    return status.where(F.length(line) > 3).select(bare(path).alias("path"), state.alias("state"), previous.alias("previous_path"))


def tree_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root``: path relative to it, size, digest and bytes, read by the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace(F.col("path"), rf"^(?:file:)?/*{root.strip('/')}/", "")
    return f.select(path.alias("path"), F.col("length").alias("content_bytes"), F.sha2("content", 256).alias("content_sha256"), "content")


def corpus_stats(files: DataFrame) -> DataFrame:
    """Files, non-empty lines of code files, and package.json files of a tree (path, contents)."""
    code = F.col("path").rlike(r"\.(ts|tsx|js|jsx|mts|cts)$")
    lines = F.size(F.filter(F.split(F.coalesce("contents", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(code, lines)), F.lit(0)).alias("lines"), F.count_if(F.col("path").rlike(r"(^|/)package\.json$")).alias("packages"))
