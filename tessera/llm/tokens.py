"""Token counts of a public tokenizer, counted where the text lies."""

from __future__ import annotations

import base64
import functools
import os
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(vocabulary: str):
    """The tokenizer of ``vocabulary`` (one base64 token and its rank per line), loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The tokenizer's own splitter overflows its stack in long runs of white space; such texts are split here, by the same pattern.
_LONG_BLANK = re.compile(r"\s{1000}")


@functools.cache
def _splitter():
    import regex

    return regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def count_text(text: str, vocabulary: str) -> int:
    """Tokens of ``text``, whole: the same count as the tokenizer's own, at any length."""
    enc = encoder(vocabulary)
    if _LONG_BLANK.search(text):
        return sum(len(enc._core_bpe.encode_single_piece(m.group().encode("utf-8", "replace"))) for m in _splitter().finditer(text))
    return len(enc.encode_ordinary(text))


def with_tokens(df: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of column ``text``; null and empty texts have 0."""

    @F.pandas_udf("long")
    def tokens(s: pd.Series) -> pd.Series:
        return pd.Series([count_text(t, vocabulary) if t else 0 for t in s], dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))
