"""A seeded corpus of source files, the same for one seed at any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that names are made of.
WORDS = ["session", "token", "queue", "ledger", "route", "parser", "index", "cache"]


def corpus(spark: SparkSession, packages: int, files_per_package: int, seed: int = 7) -> DataFrame:
    """path, contents and content_sha256 of ``packages`` x ``files_per_package`` files that import each other."""
    n = spark.range(packages * files_per_package)
    pick = lambda salt: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))
    package = F.floor(F.col("id") / files_per_package)
    number = F.col("id") % files_per_package
    d = n.select("id", package.alias("p"), number.alias("n"), pick("a").alias("a"), pick("b").alias("b"))
    name = F.concat("a", F.initcap("b"), F.col("n"))
    path = F.concat(F.lit("packages/p"), "p", F.lit("/src/f"), "n", F.lit(".ts"))
    link = F.when(F.col("n") > 0, F.concat(F.lit("import * as before from './f"), F.col("n") - 1, F.lit("';\n"))).otherwise("")
    contents = F.concat(link, F.lit("export function "), name, F.lit("(rows: any[], limit = "), F.col("id") % 97, F.lit(") {\n  return rows.slice(0, limit);\n}\n"))
    return d.select(path.alias("path"), contents.alias("contents")).withColumn("content_sha256", F.sha2("contents", 256))
