"""Filling fixed-capacity containers with items, best fit decreasing.

Items go to shards by a hash of their key, about ``SHARD_ITEMS`` to a shard, so a shard's size is bounded whatever the
data; each shard is packed alone by best fit decreasing. A segment tree over remaining capacities finds the
tightest open container in logarithmic time. With so many items to a shard, the containers left open at
its end are a vanishing part of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, with_tokens
from tessera.plans.lineage import cut

SHARD_ITEMS = 200_000
MOST_KINDS = 1000


class Remaining:
    """A segment tree over remaining capacities 0..capacity: which of them some open container has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << int(capacity).bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, container: int) -> None:
        stack = self.open[remaining]
        stack.append(container)
        if len(stack) == 1:
            tree, i = self.tree, remaining + self.leaves
            while i and not tree[i]:
                tree[i] = 1
                i >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes an open container with the least remaining capacity of at least ``size``."""
        tree, leaves = self.tree, self.leaves
        i = size + leaves
        if not tree[i]:
            while True:
                if i & 1 == 0 and tree[i + 1]:
                    i += 1
                    break
                i >>= 1
                if i <= 1:
                    return None
            while i < leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - leaves
        stack = self.open[remaining]
        container = stack.pop()
        if not stack:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return remaining, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; ``sizes`` must be at most ``capacity``. Equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    open_ = Remaining(capacity)
    count = 0
    for k in order.tolist():
        size = int(sizes[k])
        found = open_.take_tightest(size)
        if found is None:
            remaining, container = capacity, count
            count += 1
        else:
            remaining, container = found
        bins[k] = container
        open_.put(remaining - size, container)
    return bins


def pack(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The container of every document, or piece of a document above the capacity, for each container kind.

    Sizes are tokens of the given public tokenizer. A document longer than the capacity is cut into token
    ranges of exactly the capacity and a rest; no other document is split. A null or empty text has no tokens and
    lies in a container with room left (or one of its own). A doc_id delivered again counts once, with its longest text;
    null ids are left out. ``capacities`` is a parameter table (checked: at most ``MOST_KINDS`` rows); kinds with a
    capacity under 1 or null are left out, of several capacities of one kind the smallest counts. Result:
    container_kind, container_id, doc_id, piece_index, token_start, tokens, capacity_tokens.
    """
    kinds = capacities.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} container kinds")
    sized = with_tokens(documents.where("doc_id is not null").select("doc_id", "text"), "text", "_ts_n", vocabulary).groupBy("doc_id").agg(F.max("_ts_n").alias("_ts_n"))
    sized = cut(sized)
    each = F.array(*[F.struct(F.lit(k.container_kind).alias("container_kind"), F.lit(int(k.c)).alias("capacity_tokens")) for k in sorted(kinds)]) if kinds else F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    per = sized.select("doc_id", "_ts_n", F.explode(each).alias("k")).select("doc_id", "_ts_n", "k.*")
    c = F.col("capacity_tokens")
    pieces = per.withColumn("piece_index", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_ts_n") / c), F.lit(1)).cast("int") - 1)))
    pieces = pieces.withColumn("token_start", F.col("piece_index").cast("bigint") * c).withColumn("tokens", F.least(c.cast("bigint"), F.col("_ts_n") - F.col("token_start")).cast("int"))
    smallest = min((int(k.c) for k in kinds), default=1)
    items = sized.agg(F.sum(F.greatest(F.ceil(F.col("_ts_n") / smallest), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(items) // shard_items))
    pieces = pieces.withColumn("_ts_shard", F.pmod(F.xxhash64("doc_id", "piece_index"), F.lit(shards)).cast("int"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, shard = key[0], int(key[1]), key[2]
        rows = rows.sort_values(["doc_id", "piece_index"], kind="stable")
        bins = best_fit_decreasing(rows["tokens"].to_numpy(), capacity)
        return pd.DataFrame(
            {"container_kind": kind, "container_id": [f"{kind}-{shard}-{b}" for b in bins], "doc_id": rows["doc_id"], "piece_index": rows["piece_index"], "token_start": rows["token_start"], "tokens": rows["tokens"], "capacity_tokens": capacity}
        )

    out = "container_kind string, container_id string, doc_id bigint, piece_index int, token_start bigint, tokens int, capacity_tokens int"
    return pieces.groupBy("container_kind", "capacity_tokens", "_ts_shard").applyInPandas(one, out)


def fill(packed: DataFrame) -> DataFrame:
    """Per container kind: containers, tokens, share of the capacity that is used, and the least containers any packing needs."""
    cap = F.max("capacity_tokens")
    return packed.groupBy("container_kind").agg(
        cap.alias("capacity_tokens"),
        F.count_distinct("container_id").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.ceil(F.sum("tokens") / cap).alias("least_containers"),
    ).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
