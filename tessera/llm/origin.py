"""Generated, minified or vendored source files.

Linear support-vector classifiers, one for each origin (emitted by a tool, minified or bundled, copied from a third party,
data saved as code), on hashed character n-grams of the body and on path components.
Labels of the bounded training sample come from giveaways: notices in the head, licence banners with a version, line shape,
the share of literals. Head and tail comments are masked in the features, so that the classifiers learn what such code looks like
and find copies whose notice is gone. A part of the repositories is kept for validation: nothing of them is learned or relabelled, and the report is
against the labels that their giveaways gave them. In the others, hand-written files that a first round clearly takes for an origin get that label in the next, doubtful ones none.

The model is a pair of small dense matrices, sent to the executors with the function; every file is then scored where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["repo_id", "snapshot_id", "path"]
ORIGINS = ["generated", "minified", "vendored", "data"]
BUCKETS = 1 << 16
SAMPLE_ROWS = 5000
#: Files above this size are scored but not learned from, which bounds the bytes of the sample.
SAMPLE_FILE_BYTES = 1 << 15
TURNS = 3
HEAD = re.compile(r"﻿?\s*(?:(?://[^\n]*|/\*[\s\S]*?\*/|#![^\n]*)\s*)+")
COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")

# Giveaways that label the sample, and what takes them back.
NOTICE = re.compile(r"(?i)auto-?\s?generated|@generated|\bgenerated (?:by|from|with|file|code)\b|code generated|(?:produced|emitted|created|written) (?:automatically )?by \w+ \d|do not (?:edit|modify|change)|manual (?:edits|changes) will be|(?:changes|edits) will be (?:lost|overwritten)|regenerate instead|machine[- ](?:written|generated|made)|derived from \S+\.\w+|automatisch (?:erstellt|generiert|erzeugt)|nicht von hand|generado (?:automáticamente|por)|no (?:editar|modificar|edite)|^\s*(?://|\*)\s*source: \S+\.(?:proto|graphql|json|ya?ml)")
TAKEN_BACK = re.compile(r"(?i)\bonce (?:auto-?)?generated|(?:were|was|used to be) (?:once )?(?:auto-?)?generated|(?:written|maintained|kept) by hand|no longer generated|hand-?written|not generated")
LICENCE = re.compile(r"(?i)licen[cs]ed?\b|copyright|\(c\)|@license|@preserve|\bMIT\b|\bBSD\b|\bISC\b|apache|permission")
VERSION = re.compile(r"\bv?\d+\.\d+\.\d+\b")
INTERNAL = re.compile(r"(?i)internal use|all rights reserved by the .* team|license in the repository root")
COMPILED = re.compile(r"Object\.defineProperty\(exports, ?\"__esModule\"|__webpack_require__|\bsourceMappingURL=|__importDefault|__awaiter|_interopRequire")
LITERAL = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`|(?<![\w$])[\d.][\w.]*|\b(?:true|false|null|undefined)\b")


def split_head(text: str) -> tuple[str, str]:
    """The comments before the first code and after the last, and what lies between."""
    m = HEAD.match(text)
    head, body = (m.group(), text[m.end() :]) if m else ("", text)
    end = len(body.rstrip())
    while end > 0:
        begin = body.rfind("\n", 0, end) + 1
        line = body[begin:end].strip()
        if line and not line.startswith(("//", "/*", "*")):
            break
        end = max(begin - 1, 0)
    tail = body[end:]
    return (head + tail, body[:end]) if tail.strip() else (head, body)


def weak_label(path: str, text: str) -> str | None:
    """An origin, ``hand`` or None (not told by giveaways)."""
    head, body = split_head(text)
    if NOTICE.search(head) and not TAKEN_BACK.search(head):
        return "generated"
    size = len(body)
    lines = body.count("\n") + 1
    bare = LITERAL.sub("", body) if size > 300 else body
    names = sum(c.isalpha() for c in bare)
    if size > 400 and names < 0.06 * size:
        return "data"
    if size > 250 and size / lines > 160 and names > 0.1 * size:
        blanks = bare.count(" ") + bare.count("\n") + bare.count("\t")
        if blanks < 0.12 * max(len(bare), 1):
            return "minified"
    if COMPILED.search(body):
        return "generated"
    if LICENCE.search(head) and VERSION.search(head) and not INTERNAL.search(head):
        return "vendored"
    if re.search(r"(?i)(?:^|/)(?:vendor|vendors|third[_-]party|node_modules|external|dist|generated|__generated__|gen|static|public|bundle|minify|assets|data|fixtures)/|\.min\.|\.gen\.|\.generated\.|_pb\.", path):
        return None
    return "hand"


# ---- features -----------------------------------------------------------------------------------------------------

_MULTIPLIER = np.array([1, 31, 961, 29791, 923521], np.uint32)


class Features:
    """Hashed features of one text as an array of distinct bucket numbers; a scratch table makes them distinct without a sort."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.seen = np.zeros(buckets, bool)

    def ngrams(self, text: str, sizes: tuple[int, ...]) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
        seen, mask = self.seen, np.uint32(self.buckets - 1)
        h = None
        for n in range(1, max(sizes) + 1):
            if len(data) < n:
                break
            tail = data[n - 1 :]
            h = tail.astype(np.uint32) if h is None else h[: len(tail)] * np.uint32(0x01000193) + tail
            if n in sizes:
                k = h ^ (h >> np.uint32(15))
                seen[(k * np.uint32(2654435761 + 2 * n) >> np.uint32(9)) & mask] = True
        at = np.flatnonzero(seen)
        seen[at] = False
        return at

    def words(self, words: list[str]) -> np.ndarray:
        return np.unique(np.array([zlib.crc32(w.encode()) & (self.buckets - 1) for w in words], np.int64)) if words else np.empty(0, np.int64)


def path_words(path: str) -> list[str]:
    """Folders and the parts of the file name after its first, without names that only this repository has."""
    parts = path.lower().split("/")
    name = parts[-1].split(".")
    return [f"dir:{p}" for p in parts[2:-1]] + [f"ext:{x}" for x in name[1:]] + [f"tail:{x}" for x in re.findall(r"_pb|-min|_min|\.gen|\.bundle|\.min", parts[-1])]


def body_features(f: Features, path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    return f.ngrams(split_head(text)[1], (3, 5)), f.words(path_words(path))


# ---- training -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    body: np.ndarray  # buckets x origins
    words: np.ndarray
    body_bias: np.ndarray
    report: dict = field(default_factory=dict)


def train_svm(rows: list[np.ndarray], y: np.ndarray, buckets: int, c: float = 4.0, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """L2-loss linear support-vector classifiers by dual coordinate descent, one per column of ``y`` (+1, -1).

    Rows are sets of buckets, scaled to length 1; a last coordinate is the bias. Rows that did not move in a full round are
    left out of the next two. Returns weights and biases.
    """
    n, k = y.shape
    w = np.zeros((buckets, k), np.float32)
    bias = np.zeros(k)
    alpha = np.zeros((n, k))
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    rng = np.random.default_rng(seed)
    # the rarer class of a column weighs more
    positive = np.maximum((y > 0).sum(0), 1)
    soft = 1 / (2 * c * np.where(y > 0, np.sqrt(np.maximum(n - positive, 1) / positive), 1.0))
    moved = np.ones(n, bool)
    for turn in range(rounds):
        full = turn % 3 == 0
        for i in rng.permutation(n if full else np.flatnonzero(moved)):
            at, s, now = rows[i], scale[i], alpha[i]
            margin = (w[at].sum(0) * s + bias) * y[i]
            new = np.maximum(now - (margin - 1 + now * soft[i]) / (2.0 + soft[i]), 0.0)
            step = (new - now) * y[i]
            most = np.abs(step).max()
            moved[i] = most > 1e-3
            if most > 1e-6:
                alpha[i] = new
                w[at] += (step * s).astype(np.float32)
                bias += step
    return w, bias


def train(sample: list[tuple[str, str, str]], buckets: int = BUCKETS, holdout: int = 5) -> Model:
    """Trains on (repo_id, path, contents); one repository in ``holdout`` is kept for validation."""
    f = Features(buckets)
    label = [weak_label(p, t) for _, p, t in sample]
    kept = [i for i, x in enumerate(label) if x is not None]
    body = {i: body_features(f, sample[i][1], sample[i][2]) for i in kept}
    rows = {i: np.concatenate((b, w + buckets)) for i, (b, w) in body.items()}
    y = {i: np.array([1.0 if label[i] == o else -1.0 for o in ORIGINS]) for i in kept}
    check = {i for i in kept if zlib.crc32(f"split:{sample[i][0]}".encode()) % holdout == 0}
    learn = [i for i in kept if i not in check]
    model = Model(np.zeros((buckets, 4)), np.zeros((buckets, 4)), np.full(4, -1.0))
    if not any(label[i] != "hand" for i in learn) or not any(label[i] == "hand" for i in learn):
        return model
    trained = learn
    for turn in range(TURNS):
        w, bias = train_svm([rows[i] for i in trained], np.array([y[i] for i in trained]), 2 * buckets)
        if turn == TURNS - 1:
            break
        # copies without a notice were taken for people's work by the giveaways: those that clearly look like an origin
        # get its label, doubtful ones are left out; repositories kept for validation are not touched
        trained = []
        for i in learn:
            if label[i] == "hand":
                margins = w[rows[i]].sum(0) / np.sqrt(max(len(rows[i]), 1)) + bias
                top = margins.max()
                if -0.75 <= top <= 0.0:
                    continue
                now = ORIGINS[int(margins.argmax())] if top > 0.0 else "hand"
                y[i] = np.array([1.0 if now == o else -1.0 for o in ORIGINS])
            trained.append(i)
    model.body, model.words, model.body_bias = w[:buckets], w[buckets:], bias
    hit = {i: (w[rows[i]].sum(0) / np.sqrt(max(len(rows[i]), 1)) + bias).max() > 0 for i in check}
    true = {i: label[i] != "hand" for i in check}
    tp = sum(hit[i] and true[i] for i in check)
    model.report = {"validated": len(check), "precision": tp / max(1, sum(hit.values())), "recall": tp / max(1, sum(true.values())), "learned": len(trained)}
    return model


def score(model: Model, f: Features, path: str, text: str) -> np.ndarray:
    """Margins of the classifiers."""
    b, w = body_features(f, path, text)
    return (model.body[b].sum(0) + model.words[w].sum(0)) / np.sqrt(max(len(b) + len(w), 1)) + model.body_bias


def take_sample(files: DataFrame, rows: int = SAMPLE_ROWS, file_bytes: int = SAMPLE_FILE_BYTES) -> list[tuple[str, str, str]]:
    """About ``rows`` files, those with the least hashes of their keys, as (repo_id, path, contents); the same at any partitioning.

    The bound of the hash follows from the number of rows, which needs no column, so the texts are read once. No more than ``2 * rows``
    rows of at most ``file_bytes`` come to the driver.
    """
    n = files.count()
    if n == 0:
        return []
    near = F.pmod(F.xxhash64(*KEYS), F.lit(1 << 30)) <= min(1 << 30, int(rows / n * (1 << 30)) + 1)
    got = files.where(near & F.octet_length("contents").between(1, file_bytes)).select("repo_id", "path", "contents").limit(2 * rows).collect()
    return sorted({(r.repo_id or "", r.path or "", r.contents) for r in got})


def _classify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(len(model.body))
        m = Model(model.body.astype(np.float32), model.words.astype(np.float32), model.body_bias)
        for b in batches:
            origin, margin = [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("contents"), strict=True):
                text = text.as_py()
                if not text:
                    origin.append("hand")
                    margin.append(None)
                    continue
                s = score(m, f, path or "", text)
                k = int(s.argmax())
                origin.append(ORIGINS[k] if s[k] > 0 else "hand")
                margin.append(float(s[k]))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in KEYS] + [pa.array(origin, pa.string()), pa.array(margin, pa.float64())], names=[*KEYS, "origin", "margin"])

    return run


def classified(files: DataFrame, model: Model | None = None) -> DataFrame:
    """Every file with its origin (``hand`` or one of ORIGINS) and the largest margin.

    Null and empty contents are hand-written with margin null. Files delivered again come out once, with the largest margin.
    Without positive or without negative labels in the sample all files count as hand-written.
    """
    m = model or train(take_sample(files))
    scored = files.select(*KEYS, "contents").mapInArrow(_classify(m), "repo_id string, snapshot_id string, path string, origin string, margin double")
    return scored.groupBy(*KEYS).agg(F.max(F.struct("margin", "origin")).alias("x")).select(*KEYS, "x.origin", "x.margin")
