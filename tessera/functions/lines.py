"""Lines, columns and byte offsets of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_table(files: DataFrame, key: list[str], contents: str = "contents") -> DataFrame:
    """One row per line: key, line (from 1), start_byte, end_byte (without the line feed). An empty text has one empty line; null has none.

    Line feeds are found with one look at a text's bytes, in Arrow batches, so a file of any number of lines takes time in proportion and no line is shuffled.
    """
    some = files.where(F.col(contents).isNotNull()).select(*key, F.col(contents).alias("_ts_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, line, start, end = [], [], [], []
            for i, text in enumerate(b.column("_ts_text")):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                feeds = np.flatnonzero(data == 10)
                who.append(np.full(len(feeds) + 1, i))
                line.append(np.arange(1, len(feeds) + 2))
                start.append(np.concatenate(([0], feeds + 1)))
                end.append(np.concatenate((feeds, [len(data)])))
            if who:
                take = pa.array(np.concatenate(who))
                numbers = [pa.array(np.concatenate(x), pa.int32()) for x in (line, start, end)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in key), *numbers], names=[*key, "line", "start_byte", "end_byte"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.select(*key).schema)
    return some.mapInArrow(run, f"{kept}, line int, start_byte int, end_byte int")


def line_of(contents: Column, byte: Column) -> Column:
    """The line (from 1) of a byte offset; offsets beyond the end lie in the last line. For ASCII-only texts bytes are characters."""
    before = F.substring(F.encode(contents, "UTF-8"), F.lit(1), F.greatest(byte, F.lit(0)))
    return F.length(before) - F.length(F.unhex(F.regexp_replace(F.regexp_replace(F.hex(before), "(..)", "$1 "), "0A | ", ""))) + 1


def leading_comment(contents: Column, line: Column) -> Column:
    """The run of ``//`` lines, or the ``/* */`` block, directly above a line (from 1); empty where there is none."""
    above = F.transform(F.slice(F.split(contents, "\n"), F.lit(1), F.greatest(line - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    text = F.array_join(above, "\n")
    run = F.regexp_extract(text, r"((?:^|\n)//[^\n]*(?:\n//[^\n]*)*)\z", 1)
    block = F.regexp_extract(text, r"(?s)(/\*(?:(?!\*/).)*\*/)\z", 1)
    return F.trim(F.regexp_replace(F.when(run != "", run).otherwise(block), r"^\n", ""))


def cut_to_bytes(text: Column, most: Column) -> Column:
    """Texts cut to at most so many bytes of UTF-8, never inside a character; null stays null."""

    @F.pandas_udf("string")
    def cut(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or len(x) * 4 <= m else x.encode()[: int(m)].decode("utf-8", "ignore") for x, m in zip(t, n, strict=True)])

    return cut(text, most)
