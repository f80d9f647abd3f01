"""Snapshot-keyed stores as partitioned parquet, and JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotStore:
    """One fact table partitioned by ``snapshot_id``. Writing a snapshot replaces its partition alone; reading prunes to it."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, facts: DataFrame) -> None:
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self.path)

    def read(self, snapshot_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if snapshot_id is None else df.where(F.col("snapshot_id") == snapshot_id)

    def counts(self) -> DataFrame:
        return self.read().groupBy("snapshot_id").agg(F.count("*").alias("rows"))

    def problems(self) -> list[str]:
        """Columns that differ from the expected schema, by name and type; an empty list is a healthy store."""
        if self.schema is None:
            return []
        have = {f.name: f.dataType.simpleString() for f in self.read().schema if f.name != "snapshot_id"}
        want = {f.name: f.dataType.simpleString() for f in self.schema if f.name != "snapshot_id"}
        return [f"{n}: {have.get(n)} for {want.get(n)}" for n in sorted(have.keys() | want.keys()) if have.get(n) != want.get(n)]


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of a JSON file (one document or lines); what does not fit the schema is null."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """A sink for results: ``jsonl``, ``csv`` (with a header) or ``parquet``."""
    w = df.write.mode("overwrite")
    {"jsonl": w.json, "csv": w.option("header", "true").csv, "parquet": w.parquet}[kind](path)
