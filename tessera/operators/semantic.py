"""Chunks, the embedding cache, exact cosine search and hybrid reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import similarity_score, stable_digest, terms, token_estimate
from tessera.operators.eligibility import chunk_kind_of_path

# Points of the rerank signals, limits of a search, size of a file's header chunk.
TEXT_HIT, PATH_HIT, SYMBOL_HIT, PACKAGE_HIT = 2500, 3500, 4500, 1750
KIND_BASE, KIND_HIT = 2000, 500
EXPORTED, DEFAULT_EXPORT = 900, 1500
PRIORS = {"route_file": (3000, ["route"]), "config_file": (2500, ["config", "policy"]), "test_file": (2500, ["test"])}
HEADER_LENGTH = 4096


def file_chunks(files: DataFrame, key: list[str], header: int = HEADER_LENGTH) -> DataFrame:
    """One chunk per file: its id, kind by path, header text, token estimate and digest. Null contents make no chunk."""
    text = F.substring("contents", 1, header)
    c = files.where("contents is not null").select(*key, chunk_kind_of_path(F.col("path")).alias("chunk_kind"), text.alias("text"), F.sha2("contents", 256).alias("content_sha"))
    digest = stable_digest(F.col("path"), F.lit("-"), F.col("chunk_kind"), F.lit("-"), F.col("content_sha"), F.lit("1"))
    return c.select(F.concat(F.lit("chunk-"), F.substring(digest, 1, 16)).alias("chunk_id"), *key, "chunk_kind", token_estimate(F.col("text")).alias("token_estimate"), F.octet_length("text").alias("text_bytes"), F.sha2("text", 256).alias("text_digest"))


def symbol_chunks(files: DataFrame, symbols: DataFrame, key: list[str]) -> DataFrame:
    """One chunk per symbol, and the file's own chunk where a file has no symbol. ``symbols``: key, symbol_id, kind, text."""
    per = symbols.select(*key, "symbol_id", F.lit("symbol").alias("chunk_kind"), "text")
    digest = stable_digest(F.col("path"), F.lit("-"), F.col("chunk_kind"), F.col("symbol_id"), F.sha2("text", 256), F.lit("1"))
    mine = per.select(F.concat(F.lit("chunk-"), F.substring(digest, 1, 16)).alias("chunk_id"), *key, "chunk_kind", token_estimate(F.col("text")).alias("token_estimate"), F.octet_length("text").alias("text_bytes"), F.sha2("text", 256).alias("text_digest"))
    rest = files.join(symbols.select(*key).distinct(), key, "left_anti")
    return mine.unionByName(file_chunks(rest, key))


def cache_key(text_digest: Column, provider: str = "fixture", model: str = "fixture-1", config: str = "-") -> Column:
    return stable_digest(F.lit("chunk"), F.lit(provider), F.lit(model), F.lit(config), text_digest)


def cache_split(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``inputs`` with ``hit``: whether the cache has the key. The cache may hold a key more than once; a null key is a miss."""
    have = cache.select(F.col(key).alias("_ts_k")).where("_ts_k is not null").distinct()
    j = inputs.join(have, F.col(key) == F.col("_ts_k"), "left")
    return j.withColumn("hit", F.col("_ts_k").isNotNull()).drop("_ts_k")


# Who the built-in provider says it is; its digest seeds the vectors.
FIXTURE_IDENTITY = ("deterministic_fixture", "fixture", "1", "-", "document")


def fixture_vector(text: str, dimensions: int, identity: tuple = FIXTURE_IDENTITY) -> list[float]:
    """A deterministic vector of length 1 in single precision: digests of identity, text and a counter as hex text, four of its bytes a number from -1 to 1."""
    values = np.empty(0, np.float32)
    block = 0
    while len(values) < dimensions:
        parts = "".join(f"{p}\0" for p in (*identity, text, block))
        raw = np.frombuffer(hashlib.sha256(parts.encode()).hexdigest().encode(), "<u4")
        values = np.concatenate((values, raw.astype(np.float32) / np.float32(4294967295) * np.float32(2) - np.float32(1)))
        block += 1
    values = values[:dimensions]
    norm = np.sqrt((values * values).sum(dtype=np.float32))
    return (values / norm if norm > np.finfo(np.float32).eps else values).tolist()


def embed(chunks: DataFrame, text: str, out: str = "vector", dimensions: int = 64) -> DataFrame:
    """``chunks`` with a vector per text by the built-in provider, in Arrow batches; null texts have no vector."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: fixture_vector(t, dimensions) if t is not None else None)

    return chunks.withColumn(out, vectors(F.col(text)))


def embed_missing(inputs: DataFrame, cache: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """New cache rows (key, vector): one for each distinct missing key."""
    missing = cache_split(inputs, cache, key).where(~F.col("hit") & F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("_ts_text"))
    return embed(missing, "_ts_text", "vector", dimensions).select(key, "vector")


def validate_vectors(vectors: DataFrame, chunks: DataFrame, dimensions: int) -> DataFrame:
    """Counts of what an index must not have: duplicate ids, wrong dimensions, vectors without a chunk, chunks without a vector."""
    v = vectors.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions).alias("bad"), F.lit(1).alias("v"))
    j = v.join(chunks.select("chunk_id", F.lit(1).alias("c")).distinct(), "chunk_id", "full_outer")
    return j.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong_dimensions"), F.count_if(F.col("c").isNull()).alias("without_chunk"), F.count_if(F.col("v").isNull()).alias("without_vector"))


def scan_top(candidates: DataFrame, query: Column, vector: str, limit: int, tie: list[str]) -> DataFrame:
    """The ``limit`` candidates most similar to one query vector (a literal in the plan, so nothing is shuffled but the top rows)."""
    return candidates.withColumn("score", similarity_score(F.col(vector), query)).orderBy(F.desc("score"), *tie).limit(limit)


def _blocks(df: DataFrame, id_: str, vector: str, dim: int, rows: int, name: str) -> DataFrame:
    """``df`` packed: one row per ``rows`` vectors, their ids and numbers (double precision, length 1; 0 where there is no length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                length = np.sqrt((x * x).sum(1, keepdims=True))
                unit = np.where(length > 0, x / np.where(length > 0, length, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_units"])

    v = F.col(vector)
    fine = df.where(F.col(id_).isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return fine.select(F.col(id_).cast("bigint").alias("id"), v.alias("v")).mapInArrow(run, f"{name}_ids array<bigint>, {name}_units binary")


def block_search(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, dim: int, block: int = 2048) -> DataFrame:
    """The ``k`` rows most similar to each query vector, exactly: query_id, ``id_``, score (0 .. 1,000,000), rank; ties by ``id_``.

    Rows and queries are packed into blocks; each pair of blocks is one matrix product, of which only the best of each query go on, so what is
    shuffled are k rows per query and block. Vectors of another length, or with null or NaN, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q, r_ids, r in zip(*(b.column(c) for c in ("q_ids", "q_units", "r_ids", "r_units")), strict=True):
                queries_, ids = np.array(q_ids.as_py()), np.array(r_ids.as_py())
                mine, theirs = (np.frombuffer(x.as_py(), np.float64).reshape(-1, dim) for x in (q, r))
                score = np.floor((np.clip(mine @ theirs.T, -1, 1) + 1) * 500000 + 0.5).astype(np.int64)
                score[~(mine.any(1)[:, None] & theirs.any(1)[None])] = 0
                take = min(k, len(ids))
                by_id = np.argsort(ids, kind="stable")
                best = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :take]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries_, take)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], names=["query_id", id_, "score"])

    # a stated set of queries against all rows, in blocks
    pairs = _blocks(rows, id_, vector, dim, block, "r").crossJoin(_blocks(queries, id_, vector, dim, block, "q"))
    near = pairs.mapInArrow(run, f"query_id bigint, {id_} bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, query: str, bonus: bool = True) -> DataFrame:
    """``candidates`` (semantic_score, text, path, symbol_name, package_name, symbol_kind, is_exported, is_default_export, chunk_kind)
    with the points of every signal, and score = semantic_score + points (only with ``bonus``). Null fields give no points."""
    q = terms(F.lit(query))
    hits = lambda c: F.size(F.array_intersect(q, terms(F.coalesce(F.col(c), F.lit("")))))
    kind_hits = hits("symbol_kind")
    c = candidates.withColumns(
        {
            "text_points": hits("text") * TEXT_HIT,
            "path_points": hits("path") * PATH_HIT,
            "symbol_points": hits("symbol_name") * SYMBOL_HIT,
            "package_points": hits("package_name") * PACKAGE_HIT,
            "kind_points": F.when(kind_hits > 0, KIND_BASE + KIND_HIT * kind_hits).otherwise(0),
            "export_points": F.when(F.col("is_default_export"), DEFAULT_EXPORT).when(F.col("is_exported"), EXPORTED).otherwise(0),
        }
    )
    prior = F.lit(0)
    for kind, (points, words) in PRIORS.items():
        prior = F.when((F.col("chunk_kind") == kind) & F.arrays_overlap(q, F.array(*map(F.lit, words))), points).otherwise(prior)
    c = c.withColumn("prior_points", prior)
    names = ["text_points", "path_points", "symbol_points", "package_points", "kind_points", "export_points", "prior_points"]
    total = sum((F.col(n) for n in names), F.lit(0))
    return c.withColumn("score", F.col("semantic_score") + (total if bonus else F.lit(0)))


def top_reranked(reranked: DataFrame, limit: int) -> DataFrame:
    return reranked.orderBy(F.desc("score"), F.desc("semantic_score"), "path", "chunk_kind", "chunk_id").limit(limit)
