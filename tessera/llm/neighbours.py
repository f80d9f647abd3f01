"""Most similar vectors for every vector, by a forest of sorted hash strings.

Each tree gives a vector a long bit string (signs of random projections) and keeps all strings in sorted order: range
partitions of (tree, string). A task holds a run of the sorted array. It descends: the run is halved at the next bit
until a subtree is small enough to compare all its members, so a dense region gets long prefixes and a sparse one short;
where a subtree comes out small it ascends again, joined with the neighbours that share the next shorter prefix. Candidates of
all trees are merged and the best kept. Balance comes from the sorted order itself: equal strings are ordered by a random
projection, another one in each tree, so no prefix, however crowded, enlarges a task; members that share a whole string
are parted by new planes through their own centre. Copies of one vector are collapsed before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut
from tessera.plans.ordered import running_totals

BITS = 63
RUN = 1 << 16
SLICE = 512
# What share of the neighbours of the stated similarity all trees may miss; how similar the ten nearest are
# taken to be where no least similarity is given.
MISS = 0.01
FAR = 0.5
# Fixed value: how far a similarity from vectors of one byte a number may be off.
COARSE = 0.006
# Fixed value: how many times k a list may hold before better numbers are asked.
CROWD = 8


def trees_for(rows: int, most: int, similarity: float, miss: float = MISS) -> int:
    """How many trees miss at most ``miss`` of the pairs of this similarity among so many vectors.

    Two vectors share a bit with probability 1 - angle / pi, and a subtree if they share all bits of its prefix, which are
    log2(rows / most) and at most about one more, as subtrees come out between half and full. The edge of a run cuts a subtree.
    """
    if rows <= most:
        return 1
    depth = math.ceil(math.log2(rows / most)) + 1
    same = (1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi) ** depth * (1 - min(0.5, most / RUN))
    return 1 if same >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-same))


def planes(seed: int, trees: int, dim: int) -> np.ndarray:
    """The random directions of all trees, the same in every worker."""
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS)).astype(np.float32)


def subtrees(strings: np.ndarray, most: int, least: int) -> list[tuple[int, int]]:
    """Cuts a sorted run of strings into prefix subtrees of at most ``most`` members; small ones are joined up to that size.

    Members that share all bits and are more than ``most`` stay one block; ``parted`` cuts it.
    """
    cuts: list[tuple[int, int]] = []
    stack = [(0, len(strings), BITS - 1)]
    while stack:
        lo, hi, bit = stack.pop()
        if hi - lo <= most or bit < 0:
            cuts.append((lo, hi))
            continue
        ones = (strings[lo:hi] >> bit) & 1
        mid = lo + int(np.searchsorted(ones, 1))
        for part in ((mid, hi), (lo, mid)):
            if part[0] < part[1]:
                stack.append((*part, bit - 1))
    joined: list[tuple[int, int]] = []
    for lo, hi in sorted(cuts):
        if joined and hi - joined[-1][0] <= most and (hi - lo < least or joined[-1][1] - joined[-1][0] < least):
            joined[-1] = (joined[-1][0], hi)
        else:
            joined.append((lo, hi))
    return joined


def parted(unit: np.ndarray, most: int, seed: int) -> list[np.ndarray]:
    """Cuts a crowd that one string holds into parts of at most ``most`` by planes through the centre of what is to be cut, halving at the median."""
    rng = np.random.default_rng(seed)
    parts, stack = [], [np.arange(len(unit))]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            parts.append(at)
            continue
        x = unit[at]
        order = np.argsort((x - x.mean(0)) @ rng.standard_normal(unit.shape[1]).astype(np.float32), kind="stable")
        half = len(at) // 2
        stack += [at[order[:half]], at[order[half:]]]
    return parts


def within_k(group: np.ndarray, value: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Which rows, sorted by group and falling value, are among their group's first k or less than ``slack`` below the k-th."""
    first = np.searchsorted(group, group, side="left")
    keep = np.arange(len(group)) - first < k
    if slack and len(group):
        keep |= value >= value[np.minimum(first + k - 1, len(group) - 1)] - slack
    return keep


def best_in(unit: np.ndarray, k: int, least_similarity: float, slack: float = 0.0, fine: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a subtree its ``k`` most similar others of at least the given similarity, and all others less than ``slack``
    below the k-th: rows, others, similarities.

    Yields in slices of rows, so that the similarities of a slice and not of the whole subtree are held. ``fine`` takes them from
    distances to the centre of the subtree, which tell near copies apart, and gives them less 1.
    """
    m = len(unit)
    if fine:
        unit = unit - unit.mean(0)
        squares = (unit * unit).sum(1)
        least_similarity -= 1.0
    take = min(k, m - 1)
    if take < 1:
        return
    for lo in range(0, m, SLICE):
        sim = unit[lo : lo + SLICE] @ unit.T
        if fine:
            sim -= (squares[lo : lo + SLICE, None] + squares) / 2
        n = len(sim)
        sim[np.arange(n), np.arange(lo, lo + n)] = -4.0
        if least_similarity > (-2.0 if fine else -1.0):
            row, col = np.nonzero(sim >= least_similarity)
            value = sim[row, col]
            order = np.lexsort((-value, row))
            row, col, value = row[order], col[order], value[order]
            keep = within_k(row, value, k, slack)
            row, col, value = row[keep], col[keep], value[keep]
        else:
            parts = m // 32
            if parts > take:
                # the k-th greatest of the parts' maxima is no more than the k-th greatest of all, and found much faster
                tops = sim[:, : 32 * parts].reshape(n, 32, parts).max(1)
                floor = np.partition(tops, parts - take, axis=1)[:, parts - take]
                row, col = np.nonzero(sim >= floor[:, None] - slack)
                value = sim[row, col]
                order = np.lexsort((-value, row))
                row, col, value = row[order], col[order], value[order]
                keep = within_k(row, value, k, slack)
                row, col, value = row[keep], col[keep], value[keep]
            else:
                col = np.argpartition(sim, m - take, axis=1)[:, m - take :].ravel()
                row = np.repeat(np.arange(n), take)
                value = sim[row, col]
        if len(row):
            yield row + lo, col, value


def pack(unit: np.ndarray, form: str) -> list[bytes]:
    """Unit vectors in single (``fine``) or half precision, or (``compact``) in one byte a number with a scale of its own for each vector."""
    if form != "compact":
        return [r.tobytes() for r in unit.astype(np.float32 if form == "fine" else np.float16)]
    scale = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
    small = np.round(unit / scale).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, small, strict=True)]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """What ``pack`` wrote, as float32."""
    if not packed:
        return np.empty((0, dim), np.float32)
    data = b"".join(packed)
    if len(packed[0]) in (2 * dim, 4 * dim):
        return np.frombuffer(data, np.float16 if len(packed[0]) == 2 * dim else np.float32).reshape(-1, dim).astype(np.float32)
    table = np.frombuffer(data, np.uint8).reshape(-1, dim + 4)
    return table[:, 4:].view(np.int8).astype(np.float32) * table[:, :4].copy().view(np.float32)


def _encode(dim: int, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            grid = np.round(x * 1e5).astype(np.int32)
            groups = [hashlib.md5(r.tobytes(), usedforsecurity=False).digest() for r in grid]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(groups, pa.binary()), pa.array(pack(x, form), pa.binary())], names=["chunk_id", "grp", "packed"])

    return run


def _strings(dim: int, trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = planes(seed, trees, dim)
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            x = unpack(b.column("packed").to_pylist(), dim)
            strings, places = np.empty((len(x), trees), np.int64), np.empty((len(x), trees), np.float32)
            for t in range(trees):
                across = x @ directions[:, t * BITS : (t + 1) * BITS]
                strings[:, t] = (across > 0) @ weights
                places[:, t] = across[:, 0]  # where equal strings lie in this tree's order
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), trees).cast(pa.list_(kind)) for v, kind in ((strings, pa.int64()), (places, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "strings", "places"])

    return run


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _search(dim: int, k: int, least_similarity: float, most: int, slack: float, fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def leaf(unit: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
            crowded = False
            for row, col, value in best_in(unit, k, least_similarity, slack, fine):
                own, counts = np.unique(row, return_counts=True)
                if slack and counts.max() > CROWD * k:
                    # too alike for these numbers: who is nearest must come from better ones, for the whole subtree
                    crowded = True
                    few = np.repeat(counts <= CROWD * k, counts)
                    own, col, value, counts = own[counts <= CROWD * k], col[few], value[few], counts[counts <= CROWD * k]
                yield pa.RecordBatch.from_arrays([pa.array(part[own]), _lists(part[col], counts, pa.int64()), _lists(value, counts, pa.float32())], names=["node", "others", "similarities"])
            if crowded:
                one = np.ones(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), _lists(-one, one, pa.int64()), _lists(4.0 * one, one, pa.float32())], names=["node", "others", "similarities"])

        def work() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            tree, strings, nodes = (t.column(c).to_numpy() for c in ("tree", "string", "node"))
            unit = unpack(t.column("packed").to_pylist(), dim)
            edges = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
            for a, z in zip(edges, edges[1:], strict=False):
                for lo, hi in subtrees(strings[a:z], most, most // 4):
                    if hi - lo <= most:
                        yield from leaf(unit[a + lo : a + hi], nodes[a + lo : a + hi])
                        continue
                    for at in parted(unit[a + lo : a + hi], most, int(tree[a])):
                        yield from leaf(unit[a + lo + at], nodes[a + lo + at])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 2 * RUN:  # only where one string is shared by very many
                yield from work()
                held, size = [], 0
        if held:
            yield from work()

    return run


def _merge(k: int, slack: float):
    """Merges the lists of all trees: rows come sorted by node; a node's lists may continue in the next batch."""

    def best(node: np.ndarray, other: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((-value, other, node))
        node, other, value = node[order], other[order], value[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
        node, other, value = node[new], other[new], value[new]
        order = np.lexsort((other, -value, node))
        node, other, value = node[order], other[order], value[order]
        keep = within_k(node, value, k, slack)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(other[keep]), pa.array(value[keep])], names=["node", "other", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        held = none
        for b in batches:
            if b.num_rows == 0:
                continue
            counts = b.column("others").value_lengths().to_numpy()
            now = np.repeat(b.column("node").to_numpy(), counts), b.column("others").flatten().to_numpy(), b.column("similarities").flatten().to_numpy()
            node, other, value = (np.concatenate(x) for x in zip(held, now, strict=True))
            whole = node != node[-1]
            if whole.any():
                yield best(node[whole], other[whole], value[whole])
            held = node[~whole], other[~whole], value[~whole]
        if len(held[0]):
            yield best(*held)

    return run


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """chunk_id and vector of chunks with ``dim`` finite numbers, not all zero. A chunk delivered again counts once (the least vector)."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.where("chunk_id is not null and vector is not null").where((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0))
    return fine.groupBy("chunk_id").agg(F.min("vector").alias("vector"))


def nearest(usable: DataFrame, k: int = 10, least_similarity: float = -1.0, trees: int = 10, most: int = 2048, seed: int = 11, dim: int = 64, form: str = "half") -> DataFrame:
    """The ``k`` most similar other chunks of every chunk, as far as the forest meets them: chunk_id, other_id, similarity.

    Similarities come from half-precision unit vectors (error below 0.001), from single precision around the centre of each subtree
    (``fine``), or (``compact``) from one byte a number (below ``COARSE``) at half the shuffle; then all that may be among the k by their true
    similarity are kept, so more than k, and where that is more than ``CROWD`` times k the members of the subtree are searched once more in the
    fine form. With ``least_similarity`` only neighbours of about that much are kept, which are then
    the first ones of the k. There are at least ``trees`` trees, and more where ``trees_for`` asks for them: for so many chunks,
    at ``least_similarity``, or at ``FAR`` without one. Copies (equal after scaling to length 1, to five digits) are one vector in the forest; in the
    result each copy has its copies, in the order of their ids, before others.
    """
    e = cut(usable.mapInArrow(_encode(dim, form), "chunk_id string, grp binary, packed binary"))
    slack = 2 * COARSE if form == "compact" else 0.0
    first = e.groupBy("grp").agg(F.min(F.struct("chunk_id", "packed")).alias("r"), F.count("*").alias("n"))
    reps = first.select(F.monotonically_increasing_id().alias("node"), "grp", "n", "r.chunk_id", "r.packed")
    merged, reps = _forest(reps, e.count(), k, least_similarity, trees, most, seed, dim, slack, form == "fine")
    if slack:
        crowd = merged.where("other < 0").select("node").distinct()
        merged = merged.where("other >= 0").select("node", "other", "similarity")
        crowd_ids = cut(reps.join(crowd, "node").select("chunk_id"))
        dense = crowd_ids.count()
        if dense:
            better = usable.join(crowd_ids, "chunk_id", "left_semi").mapInArrow(_encode(dim, "fine"), "chunk_id string, grp binary, packed binary")
            again = better.join(reps.select("node", "chunk_id"), "chunk_id").select("node", "grp", F.lit(1).cast("bigint").alias("n"), "chunk_id", "packed")
            found, _ = _forest(again, dense, k, least_similarity, trees, most, seed + 1, dim, 0.0, True)
            merged = merged.unionByName(found).groupBy("node", "other").agg(F.max("similarity").alias("similarity"))
    names = reps.select("node", "chunk_id", "n")
    pairs = merged.join(names, "node").join(names.select(F.col("node").alias("other"), F.col("chunk_id").alias("other_id")), "other").select("chunk_id", "other_id", "similarity", "n")
    many = reps.where("n > 1").select("grp", "chunk_id")
    return _with_copies(pairs, e.select("chunk_id", "grp"), many, k, slack)


def _forest(reps: DataFrame, size: int, k: int, least_similarity: float, trees: int, most: int, seed: int, dim: int, slack: float, fine: bool) -> tuple[DataFrame, DataFrame]:
    """Searches the forest of ``reps``: merged lists (node, other, similarity) and ``reps`` with strings. An ``other`` of -1 marks a node of a crowd."""
    trees = max(trees, trees_for(size, most, least_similarity if least_similarity > -1.0 else FAR))
    reps = cut(reps.mapInArrow(_strings(dim, trees, seed), "node bigint, grp binary, n bigint, chunk_id string, packed binary, strings array<bigint>, places array<float>"))
    rows = reps.count() * trees
    spread = reps.select("node", "packed", F.posexplode(F.arrays_zip("strings", "places")).alias("tree", "s")).select("node", "packed", "tree", F.col("s.strings").alias("string"), F.col("s.places").alias("place"))
    runs = spread.repartitionByRange(max(1, -(-rows // RUN)), "tree", "string", "place").sortWithinPartitions("tree", "string", "place", "node")
    # one row per node and tree, its neighbours as lists of numbers: what is shuffled stays small
    met = runs.select("tree", "string", "node", "packed").mapInArrow(_search(dim, k, least_similarity, most, slack, fine), "node bigint, others array<bigint>, similarities array<float>")
    merged = met.repartition(F.col("node")).sortWithinPartitions("node").mapInArrow(_merge(k, slack), "node bigint, other bigint, similarity float")
    merged = cut(merged.withColumn("similarity", F.col("similarity") + 1)) if fine else cut(merged)
    return merged, reps


def _best(met: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """The k best of each chunk's candidates, and those less than ``slack`` below the k-th."""
    if slack:
        w = Window.partitionBy("chunk_id").orderBy(F.desc("similarity"), F.asc("other_id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        kth = met.withColumn("_ts_k", F.nth_value("similarity", k).over(w))
        return kth.where(F.col("_ts_k").isNull() | (F.col("similarity") >= F.col("_ts_k") - slack)).drop("_ts_k")
    w = Window.partitionBy("chunk_id").orderBy(F.desc("similarity"), F.asc("other_id"))
    return met.withColumn("_ts_n", F.row_number().over(w)).where(F.col("_ts_n") <= k).drop("_ts_n")


def _with_copies(pairs: DataFrame, members: DataFrame, many: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """Brings the copies back: each member of a group of copies meets the group's first k + 1 members and those of the neighbours.

    Members are numbered by a distributed rank, so a group with a third of all rows is no single task.
    """
    copies = members.join(many.select("grp", F.col("chunk_id").alias("rep")), "grp")
    numbered = cut(running_totals(copies, ["rep"], [F.asc("chunk_id")], None, "_ts_t", "nth").select("rep", "chunk_id", "nth"))
    heads = numbered.where(F.col("nth") <= k + 1)
    within = numbered.join(heads.select("rep", F.col("chunk_id").alias("other_id")), "rep").where("chunk_id <> other_id").select("chunk_id", "other_id", F.lit(1.0).cast("float").alias("similarity"))
    # neighbours of the group, given to each member; then each neighbour that is a group, given as its first members
    p = pairs.select(F.col("chunk_id").alias("rep"), "other_id", "similarity", "n")
    # an inner join, for adaptive execution splits a hot group on either side of one; single vectors need none
    mine = p.where("n > 1").join(numbered.select("rep", "chunk_id"), "rep").select("chunk_id", F.col("other_id").alias("rep"), "similarity")
    mine = mine.unionByName(p.where("n = 1").select(F.col("rep").alias("chunk_id"), F.col("other_id").alias("rep"), "similarity"))
    theirs = mine.join(heads.select("rep", F.col("chunk_id").alias("head")), "rep", "left").select("chunk_id", F.coalesce("head", "rep").alias("other_id"), "similarity")
    return _best(within.unionByName(theirs), k, slack)


def similar_pairs(vectors: DataFrame, k: int = 10, least_similarity: float = 0.9, dim: int = 64, **forest) -> DataFrame:
    """Pairs of chunks of at least the given cosine similarity where one is among the k most similar of the other.

    The forest proposes pairs from compact vectors, with a margin for their error at the threshold and at the k-th; the pairs'
    similarity is then computed from the vectors themselves in double precision, and only then each chunk's are cut to k. Result: chunk_id_a < chunk_id_b, similarity; each pair once. Unusable vectors take no part.
    """
    usable = usable_vectors(vectors, dim)
    near = nearest(usable, k, least_similarity - COARSE, dim=dim, form="compact", **({"trees": 8, "most": 4096} | forest))
    pairs = cut(near.select(F.least("chunk_id", "other_id").alias("chunk_id_a"), F.greatest("chunk_id", "other_id").alias("chunk_id_b")).distinct())
    wanted = pairs.select(F.explode(F.array("chunk_id_a", "chunk_id_b")).alias("chunk_id")).distinct()
    own = usable.join(wanted, "chunk_id", "left_semi")
    a = own.select(F.col("chunk_id").alias("chunk_id_a"), F.col("vector").alias("va"))
    b = own.select(F.col("chunk_id").alias("chunk_id_b"), F.col("vector").alias("vb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    cosine = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va"))) / F.sqrt(dot(F.col("vb"), F.col("vb")))
    exact = pairs.join(a, "chunk_id_a").join(b, "chunk_id_b").select("chunk_id_a", "chunk_id_b", cosine.alias("similarity")).where(F.col("similarity") >= least_similarity)
    sides = F.explode(F.array(F.struct(F.col("chunk_id_a").alias("chunk_id"), F.col("chunk_id_b").alias("other_id")), F.struct(F.col("chunk_id_b").alias("chunk_id"), F.col("chunk_id_a").alias("other_id"))))
    best = _best(exact.select(sides.alias("x"), "similarity").select("x.*", "similarity"), k)
    return best.select(F.least("chunk_id", "other_id").alias("chunk_id_a"), F.greatest("chunk_id", "other_id").alias("chunk_id_b"), "similarity").distinct()
