"""Source files that do not parse: a verdict per file, rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import extension
from tessera.llm import syntax

KEYS = ["repo_id", "snapshot_id", "path"]
OUT = "repo_id string, snapshot_id string, path string, extension string, valid boolean, first_error string, first_line int, errors array<struct<line:int,column:int,what:string>>"
_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("column", pa.int32()), ("what", pa.string())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ext = b.column("extension").to_pylist()
        valid, errors = [], []
        for e, text in zip(ext, b.column("contents"), strict=True):
            text = text.as_py()
            ok = syntax.accepts(text, e)
            valid.append(ok)
            errors.append([] if ok else [{"line": n, "column": c, "what": w} for n, c, w in syntax.errors(text, e)] or [{"line": 1, "column": 1, "what": "not accepted"}])
        first = [x[0] if x else {"what": None, "line": None} for x in errors]
        yield pa.RecordBatch.from_arrays(
            [b.column(k) for k in KEYS]
            + [b.column("extension"), pa.array(valid, pa.bool_()), pa.array([x["what"] for x in first], pa.string()), pa.array([x["line"] for x in first], pa.int32()), pa.array(errors, _ERRORS)],
            names=[*KEYS, "extension", "valid", "first_error", "first_line", "errors"],
        )


def judged(files: DataFrame) -> DataFrame:
    """Every file of the six extensions with its verdict, all errors and the first one.

    Files are judged where they lie, by content and extension alone. Empty texts, comments only and a leading byte order
    mark are valid. Null contents, null paths and other extensions are left out. A file delivered again comes out as often.
    """
    f = files.select(*KEYS, "contents", extension(F.col("path")).alias("extension")).where(F.col("contents").isNotNull() & F.col("extension").isin(*syntax.EXTENSIONS))
    return f.mapInArrow(_judge, OUT)


def invalid_files(files: DataFrame) -> DataFrame:
    """The files that are not valid, each once: key, extension, first_error, first_line, the number of errors and all of them by place.

    A file delivered again with other contents has the errors of all its contents.
    """
    bad = judged(files).where("not valid").groupBy(*KEYS, "extension").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("x"))
    return bad.select(*KEYS, "extension", F.col("x")[0]["what"].alias("first_error"), F.col("x")[0]["line"].alias("first_line"), F.size("x").alias("errors"), F.col("x").alias("all_errors"))


def rates(files: DataFrame, inspections: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repo_id and language, with the rate that the parse flags tell.

    The flag is that of the file's inspection (latest by parsed_at among those with its digest). The language is that inspection's,
    else that of the path's latest one, else the extension. A null repo_id or digest meets a null one. A file delivered again counts once; it counts as invalid if any of its rows is.
    """
    digest = lambda df: (F.lower("content_sha256") if "content_sha256" in df.columns else F.lit(None).cast("string")).alias("sha")
    kept = files.where("contents is not null").select(*KEYS, extension(F.col("path")).alias("extension"), F.lit(None).cast("boolean").alias("valid"), digest(files)).where(F.col("extension").isin(*syntax.EXTENSIONS))
    verdicts = judged(files).select(*KEYS, "extension", "valid", F.lit(None).cast("string").alias("sha"))
    v = verdicts.unionByName(kept).groupBy(*KEYS, "extension").agg(F.min("valid").alias("valid"), F.max("sha").alias("sha"))
    i = inspections.where("path is not null").select(F.col("repo_id").alias("_ts_r"), F.col("path").alias("_ts_p"), digest(inspections).alias("_ts_s"), "language", "parse_succeeded", F.struct("parsed_at", "artifact_id").alias("at"))
    told = i.groupBy("_ts_r", "_ts_p", "_ts_s").agg(F.max_by(F.struct("language", "parse_succeeded"), "at").alias("t"))
    named = i.groupBy("_ts_r", "_ts_p").agg(F.max_by("language", "at").alias("path_language"))
    same = F.col("repo_id").eqNullSafe(F.col("_ts_r")) & (F.col("path") == F.col("_ts_p"))
    both = v.join(told, same & F.col("sha").eqNullSafe(F.col("_ts_s")), "left").drop("_ts_r", "_ts_p", "_ts_s").join(named, same, "left")
    out = both.groupBy("repo_id", F.coalesce("t.language", "path_language", "extension").alias("language")).agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid_files"), F.count_if(F.col("t.parse_succeeded") == False).alias("flagged_files"))  # noqa: E712
    return out.withColumn("invalid_rate", F.col("invalid_files") / F.col("files")).withColumn("accepted_rate", 1 - F.col("invalid_rate"))
