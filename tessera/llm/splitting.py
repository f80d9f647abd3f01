"""Splitting oversized items at natural boundaries.

Every place where a text may be cut is a boundary with a rank (end of a top-level block, end of a line, end of a
token, between two characters). Each boundary is joined to its farthest legal successor: the last boundary that a piece
starting ``overlap`` bytes before it can reach within the limit. Squaring the successor tables (pointer
doubling) then marks every cut on the greedy path from byte 0 in a logarithmic number of vector steps, for all texts of
an Arrow batch at once. A text never leaves its row, so nothing is shuffled but the finished piece positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import extension

CHAR, TOKEN, LINE, BLOCK = 0, 1, 2, 3
KEYS = ["repo_id", "snapshot_id", "path"]
OUT = "repo_id string, snapshot_id string, path string, content_id bigint, piece_index int, pieces int, start_byte bigint, end_byte bigint, cut_rank int, piece string"


def ranks(data: np.ndarray) -> np.ndarray:
    """For each byte position p > 0, the rank of a cut before byte p; -1 inside a character."""
    n = len(data)
    rank = np.full(n, CHAR, np.int8)
    rank[(data & 0xC0) == 0x80] = -1
    before = data[:-1]
    token = np.isin(before, np.frombuffer(b" \t;,{}()[]|", np.uint8))
    rank[1:][token & (rank[1:] >= 0)] = TOKEN
    line = before == 10
    rank[1:][line] = LINE
    # a line that starts without indentation, with something other than a closing bracket, begins a block
    opens = line & ~np.isin(data[1:], np.frombuffer(b" \t\r\n)]}", np.uint8))
    rank[1:][opens] = BLOCK
    return rank


def successors(rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundary positions and, for each, the index of its farthest legal successor.

    A piece after boundary b starts at b - overlap (at 0 for the first) and may hold ``limit`` bytes.
    Of the successors in reach, a block start in the last half of the piece is taken before a line end, a
    line end before a token end, and any of them before a bare character.
    """
    n = len(rank)
    # bare character cuts matter only where no token ends within reach; a grid of them keeps the table small
    usable = np.flatnonzero(rank >= TOKEN)
    usable = usable[usable > 0]
    gaps = np.diff(np.concatenate(([0], usable, [n])))
    step = max(1, (limit - overlap) // 8)
    if (gaps > step).any():
        grid = np.arange(step, n, step)
        for _ in range(3):
            inside = rank[grid] < 0
            grid = np.where(inside, grid - 1, grid)
        usable = np.union1d(usable, grid[(grid > 0) & (rank[grid] >= 0)])
    pos = np.concatenate(([0], usable, [n])).astype(np.int64)
    r = np.concatenate(([BLOCK], rank[usable], [BLOCK])).astype(np.int8)
    starts = np.maximum(pos - overlap, 0)
    reach = starts + limit
    best = np.searchsorted(pos, reach, side="right") - 1
    for least, share in ((TOKEN, 0.0), (LINE, 0.25), (BLOCK, 0.5)):
        idx = np.flatnonzero(r >= least)
        at = idx[np.searchsorted(pos[idx], reach, side="right") - 1]
        # progress: beyond the boundary itself, and far enough for the piece not to shrink to its overlap
        good = (pos[at] > np.maximum(pos, starts + overlap)) & (pos[at] - starts >= share * limit)
        best = np.where(good, at, best)
    end = len(pos) - 1
    best = np.where(reach >= n, end, best)
    best[end] = end
    return pos, np.maximum(best, np.minimum(np.arange(len(pos)) + 1, end))


def on_path(succ: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks all nodes reachable from ``begins`` along ``succ`` by squaring the successor table."""
    marked = np.zeros(len(succ), bool)
    marked[begins] = True
    jump = succ
    while True:
        # with the table for 2^k steps, the nodes marked within 2^k steps give those within 2^(k+1)
        new = np.zeros_like(marked)
        new[jump[marked]] = True
        grown = marked | new
        squared = jump[jump]
        if (grown == marked).all() and (squared == jump).all():
            return marked
        marked, jump = grown, squared


def cut_texts(texts: list[bytes], limits: np.ndarray, overlaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start, end and rank of the end cut, for all pieces of all texts; an empty text is one empty piece."""
    tables, base = [], 0
    all_pos, all_succ, begins, ends, owner, all_rank = [], [], [], [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        if len(data) == 0:
            pos, succ, rk = np.zeros(2, np.int64), np.array([1, 1]), np.full(2, BLOCK, np.int8)
        else:
            rank = ranks(data)
            pos, succ = successors(rank, int(limits[i]), int(overlaps[i]))
            rk = np.where((pos > 0) & (pos < len(data)), rank[np.minimum(pos, len(data) - 1)], BLOCK)
        all_pos.append(pos)
        all_succ.append(succ + base)
        all_rank.append(rk)
        begins.append(base)
        ends.append(base + len(pos) - 1)
        owner.append(np.full(len(pos), i))
        base += len(pos)
        tables.append(len(pos))
    pos, succ, who, rk = map(np.concatenate, (all_pos, all_succ, owner, all_rank))
    is_end = np.zeros(base, bool)
    is_end[ends] = True
    chosen = np.flatnonzero(on_path(succ, np.array(begins)) & ~is_end)
    to = succ[chosen]
    over = overlaps[who[chosen]]
    start = np.where(pos[chosen] == 0, 0, np.maximum(pos[chosen] - over, 0))
    for k, (s, w) in enumerate(zip(start, who[chosen], strict=True)):
        text = texts[w]
        while 0 < s < len(text) and text[s] & 0xC0 == 0x80:  # never starts inside a character
            s += 1
        start[k] = s
    return who[chosen], start, pos[to], rk[to]


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows == 0:
            continue
        texts = [t.encode() for t in b.column("contents").to_pylist()]
        limits, overlaps = b.column("max_bytes").to_numpy(), b.column("overlap_bytes").to_numpy()
        who, start, end, rank = cut_texts(texts, limits, overlaps)
        count = np.bincount(who, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        index = np.arange(len(who)) - first[who]
        take = pa.array(who)
        yield pa.RecordBatch.from_arrays(
            [b.column(k).take(take) for k in KEYS]
            + [b.column("content_id").take(take), pa.array(index, pa.int32()), pa.array(count[who], pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(rank, pa.int32())]
            + [pa.array([texts[w][s:e].decode() for w, s, e in zip(who, start, end, strict=True)], pa.string())],
            names=[*KEYS, "content_id", "piece_index", "pieces", "start_byte", "end_byte", "cut_rank", "piece"],
        )


def split_oversized(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every file whose contents in UTF-8 have more bytes than its extension allows.

    Result: the key, content_id (tells apart different contents under one key), piece_index from 0, pieces,
    start_byte, end_byte (exclusive), cut_rank (0 character .. 3 block) and the text. Pieces cover the
    file in order, none exceeds max_bytes, and each starts overlap_bytes before the end of the one before it
    (up to 3 bytes later where that would split a character). Sizes are measured, content_bytes is not believed. Null
    contents, extensions without a limit and null limits are left out; a limit under 8 bytes or an overlap of less than 8 bytes
    under the limit is an error where a file meets it; a null overlap is 0; of several limits for one extension the smallest counts. A file
    delivered again with the same contents comes out once. ``limits`` has one row per extension and is aggregated by it.
    """
    lim = limits.groupBy(F.lower("extension").alias("_ts_ext")).agg(F.min("max_bytes").alias("max_bytes"), F.min_by("overlap_bytes", "max_bytes").alias("overlap_bytes")).where("max_bytes is not null")
    overlap = F.greatest(F.coalesce("overlap_bytes", F.lit(0)), F.lit(0))
    told = F.concat(F.lit("no pieces can be cut for ."), "_ts_ext", F.lit(": max_bytes must be 8 at least and overlap_bytes 8 less than that"))
    lim = lim.withColumn("overlap_bytes", F.when((F.col("max_bytes") >= 8) & (overlap <= F.col("max_bytes") - 8), overlap).otherwise(F.raise_error(told).cast("bigint")))
    f = files.select(*KEYS, "contents", extension(F.col("path")).alias("_ts_ext")).where("contents is not null")
    big = f.join(lim, "_ts_ext").where(F.octet_length("contents") > F.col("max_bytes"))
    big = big.select(*KEYS, "contents", F.xxhash64("contents").alias("content_id"), "max_bytes", "overlap_bytes")
    return big.mapInArrow(_split_batches, OUT)


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` without those of files delivered again; the shuffle carries positions, the text once per task."""
    return pieces.dropDuplicates([*KEYS, "content_id", "piece_index"])
