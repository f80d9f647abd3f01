"""The watch stream: debounced, coalesced file events, as a batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.ordered import running_totals

# What two events on one path come to; pairs that are not named come to the later event. "" is nothing.
MERGED = {
    ("created", "modified"): "created",
    ("created", "removed"): "",
    ("modified", "modified"): "modified",
    ("modified", "removed"): "removed",
    ("removed", "created"): "modified",
    ("removed", "modified"): "modified",
    ("renamed", "modified"): "renamed",
    ("renamed", "removed"): "removed",
}
KIND_RANK = {"created": 0, "modified": 1, "removed": 2, "renamed": 3}
DEBOUNCE_MS, MOST_PENDING = 100, 256


def merge_kinds(first: str | None, second: str) -> str:
    return second if not first else MERGED.get((first, second), second)


def _merge(a: Column, b: Column) -> Column:
    out = F.when((a == ""), b)
    for (x, y), z in MERGED.items():
        out = out.when((a == x) & (b == y), F.lit(z))
    return out.otherwise(b)


def debounce(events: DataFrame, key: list[str], at: str, kind: str, order: str, gap: str) -> DataFrame:
    """Sessions of events per key that are at most ``gap`` apart, each come to one event: key, first_at, last_at, events, kind.

    A session whose events cancel out has an empty kind. Events without time or kind are left out. Only the kinds of a
    session are held together, in time order.
    """
    e = events.where(F.col(at).isNotNull() & F.col(kind).isNotNull())
    s = e.groupBy(*key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(order).alias("o"), F.col(kind).alias("k")))).alias("ks"))
    folded = F.aggregate("ks", F.lit(""), lambda a, x: _merge(a, x["k"]))
    return s.select(*key, "first_at", "last_at", "events", folded.alias("kind"))


def flush_order(events: DataFrame, scope: list[str]) -> DataFrame:
    """``events`` (path, previous_path, kind) with ``sequence`` from 1: by path, previous path and the rank of the kind. A scope of any size is numbered in pieces."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_RANK.items() for x in p]), F.col("kind"))
    numbered = running_totals(events.withColumn("_ts_kind", rank), scope, [F.asc("path"), F.asc_nulls_first("previous_path"), F.asc("_ts_kind")], None, "_ts_total", "sequence")
    return numbered.drop("_ts_kind", "_ts_total").withColumn("sequence", F.col("sequence").cast("int"))


STATE = "path string, previous_path string, kind string, last_ms bigint"
OUT = "repo_id string, path string, previous_path string, kind string, dropped bigint"


class Pending:
    """What is pending in one repository: path -> (previous_path, kind, last_ms). New paths beyond ``most`` are dropped and counted."""

    def __init__(self, rows: list[tuple] | None = None, most: int = MOST_PENDING):
        self.rows = {r[0]: (r[1], r[2], r[3]) for r in rows or []}
        self.most, self.dropped = most, 0

    def add(self, path: str, previous: str | None, kind: str, ms: int) -> None:
        if kind == "renamed" and previous in self.rows:
            # what was pending under the old name goes with the file
            older, was, _ = self.rows.pop(previous)
            if was == "created":
                kind, previous = "created", None
            elif was == "renamed":
                previous = older
        if path not in self.rows and len(self.rows) >= self.most:
            self.dropped += 1
            return
        older, was, _ = self.rows.get(path, (None, None, 0))
        merged = merge_kinds(was, kind)
        if merged == "":
            self.rows.pop(path, None)
        else:
            self.rows[path] = (previous if kind == "renamed" else older, merged, ms)

    def take_quiet(self, now: int, gap: int) -> list[tuple]:
        """Removes and returns the paths that have been quiet for ``gap``, in flush order."""
        quiet = [(p, v[0], v[1]) for p, v in self.rows.items() if now - v[2] >= gap]
        for p, *_ in quiet:
            del self.rows[p]
        return sorted(quiet, key=lambda r: (r[0], r[1] or "", KIND_RANK.get(r[2], 9)))


def coalesce_stream(events: DataFrame, gap_ms: int = DEBOUNCE_MS, most: int = MOST_PENDING) -> DataFrame:
    """A streaming (or batch) DataFrame of events (repo_id, path, previous_path, kind, at_ms) debounced per repository.

    Renames join two paths, so the state is kept per repository, not per path; it holds at most ``most`` paths. Time is the
    events' own millisecond clock within a batch; what stays quiet is let go by a processing-time timeout.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*[list(c) for c in state.get], strict=True)) if state.exists else []
        pending, out = Pending(rows, most), []
        if state.hasTimedOut:
            out = pending.take_quiet(1 << 62, gap_ms)
        else:
            new = pd.concat(list(batches)).sort_values(["at_ms", "path"], kind="stable")
            for r in new.itertuples(index=False):
                out += pending.take_quiet(int(r.at_ms), gap_ms)
                pending.add(r.path, r.previous_path if isinstance(r.previous_path, str) else None, r.kind, int(r.at_ms))
        if pending.rows:
            state.update(([*pending.rows], *[list(c) for c in zip(*pending.rows.values(), strict=True)]))
            state.setTimeoutDuration(max(gap_ms, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"repo_id": [key[0]] * len(out), "path": [r[0] for r in out], "previous_path": [r[1] for r in out], "kind": [r[2] for r in out], "dropped": [pending.dropped] * len(out)})

    usable = events.where("path is not null and kind is not null and at_ms is not null")
    state_type = "path array<string>, previous_path array<string>, kind array<string>, last_ms array<bigint>"
    return usable.groupBy("repo_id").applyInPandasWithState(update, OUT, state_type, "append", GroupStateTimeout.ProcessingTimeTimeout)
