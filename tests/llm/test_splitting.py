"""Pieces of oversized files."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting

FILES = "repo_id string, snapshot_id string, path string, contents string, piece string"
LIMITS = "language string, extension string, max_bytes bigint, overlap_bytes bigint"


def walk(succ, begin):
    out, at = [begin], begin
    while succ[at] != at:
        at = succ[at]
        out.append(at)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n;{}é漢🙂", max_size=400), st.integers(16, 60), st.integers(0, 7))
def test_pieces_cover_and_fit(text, limit, overlap):
    data = text.encode()
    who, start, end, _ = splitting.cut_texts([data], np.array([limit]), np.array([overlap]))
    pieces = sorted(zip(start.tolist(), end.tolist(), strict=True))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    joined = b""
    for k, (s, e) in enumerate(pieces):
        assert e - s <= limit
        data[s:e].decode()
        if k:
            before = pieces[k - 1][1]
            assert before - overlap <= s <= min(before, before - overlap + 3)
            assert e > before
        joined += data[len(joined) : e]
    assert joined == data


def test_doubling_is_the_greedy_walk():
    text = ("line of code();\n" * 9 + "\nexport function f() {\n  return 1;\n}\n") * 40
    pos, succ = splitting.successors(splitting.ranks(np.frombuffer(text.encode(), np.uint8)), 300, 20)
    assert sorted(np.flatnonzero(splitting.on_path(succ, np.array([0])))) == walk(succ, 0)


def test_cuts_lie_at_blocks_or_lines():
    text = ("function f() {\n  call();\n}\n\n") * 200
    _, _, _, rank = splitting.cut_texts([text.encode()], np.array([1000]), np.array([50]))
    assert set(rank.tolist()) == {splitting.BLOCK}
    _, _, _, rank = splitting.cut_texts([("x" * 5000).encode()], np.array([1000]), np.array([50]))
    assert set(rank.tolist()) <= {splitting.CHAR, splitting.BLOCK}


def test_rows_of_any_kind(spark, rows):
    big, odd = "a = 1;\n" * 100, "é" * 300
    f = [("r", "s", "a.ts", big, "x"), ("r", "s", "a.ts", big, "x"), ("r", "s", "b.ts", odd, "x"), ("r", "s", "c.ts", "", "x"), ("r", "s", "d.ts", None, "x"), ("r", "s", "e.md", big, "x"), (None, None, "f.TS", big, "x"), ("r", "s", None, big, "x"), ("r", "s", "g.ts", "x" * 512, "x")]
    lim = spark.createDataFrame([("ts", "ts", 512, 60), ("ts", "ts", 900, 1), ("md", "md", None, 1), (None, None, 5, None)], LIMITS)
    got = splitting.distinct_pieces(splitting.split_oversized(spark.createDataFrame(f, FILES), lim))
    out = rows(got.groupBy("repo_id", "path").count())
    assert [r[:2] for r in out] == [("r", "a.ts"), ("r", "b.ts"), (None, "f.TS")]
    whole = {r.path: r.end_byte for r in got.where("piece_index = pieces - 1").collect()}
    assert whole == {"a.ts": 700, "b.ts": 600, "f.TS": 700}
    assert splitting.split_oversized(spark.createDataFrame([], FILES), lim).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_many_texts_at_once(n):
    texts = [f"t{i};\n".encode() * (50 * i) for i in range(n + 1)]
    who, start, end, _ = splitting.cut_texts(texts, np.full(n + 1, 64), np.full(n + 1, 4))
    for i, t in enumerate(texts):
        assert end[who == i].max() == len(t) and start[who == i].min() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(7, 0), (100, 93), (100, 200)])
def test_limits_that_cannot_be_kept_are_errors(spark, limit, overlap):
    files = spark.createDataFrame([("r", "s", "a.ts", "a = 1;\n" * 100, "x")], FILES)
    with pytest.raises(Exception, match="no pieces can be cut"):
        splitting.split_oversized(files, spark.createDataFrame([("ts", "ts", limit, overlap)], LIMITS)).count()


@pytest.mark.parametrize("text", ["word " * 900, "é" * 2000, "let a = b + c;\n" * 300])
def test_large_overlaps_are_kept(text):
    data = text.encode()
    for limit, overlap in ((100, 92), (64, 40), (16, 8)):
        _, start, end, _ = splitting.cut_texts([data], np.array([limit]), np.array([overlap]))
        assert (end - start).max() <= limit and end[-1] == len(data)
        assert all(e - overlap <= s <= e - overlap + 3 or s == 0 for s, e in zip(start[1:].tolist(), end[:-1].tolist(), strict=True))
