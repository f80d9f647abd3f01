"""Globs as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """``*`` matches any run of characters, slashes too (so ``**`` means the same); ``?`` matches one character."""
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"(?s{'i' if ignore_case else ''})^{body}$"


def matches_any(text: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """Whether ``text`` matches one of ``globs``; no globs match everything, a null text matches none."""
    if not globs:
        return F.lit(True)
    one = F.lit(False)
    for g in globs:
        one = one | text.rlike(glob_regex(g, ignore_case))
    return F.coalesce(one, F.lit(False))
