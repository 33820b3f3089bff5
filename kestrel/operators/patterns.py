"""Pattern tables over texts, behind an index of the literals that their patterns need.

Whether a text holds a literal is a plain search, some twenty times as fast as a regular expression
that finds nothing.  Most texts hold none of a pattern's literals, so its expression never runs there.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Pattern(NamedTuple):
    """needs: every text that the pattern matches holds one of these, in lower case if fold; none: the pattern runs on all texts."""

    name: str
    regex: str
    needs: tuple[str, ...] = ()
    fold: bool = False


def shortest(regex: str) -> str:
    """A pattern that matches in the same texts and looks at less: repetitions at its ends count once.

    Only the forms `[...]+` at the start and `[...]+` or `{n,}` at the end are changed.
    """
    regex = re.sub(r"^(\[[^\]\\]*\])\+(?![+?])", r"\1", regex)
    regex = re.sub(r"(?<!\\)(\[[^\]\\]*\])\+$", r"\1", regex)
    return re.sub(r"(\[[^\]]*\])\{(\d+),\}$", r"\1{\2}", regex)


def matches(text: Column, pattern: Pattern | tuple, low: Column | None = None) -> Column:
    """Whether the pattern matches; low is the text in lower case, if it is at hand."""
    pattern = Pattern(*pattern)
    hit = text.rlike(shortest(pattern.regex))
    if not pattern.needs:
        return hit
    where = (F.lower(text) if low is None else low) if pattern.fold else text
    return reduce(lambda a, b: a | b, (where.contains(x) for x in pattern.needs)) & hit


def first_match(text: Column, patterns: list[Pattern | tuple], default: str | None = None, low: Column | None = None) -> Column:
    """Name of the first pattern of an ordered table that matches (J10, Q8); one native expression."""
    out = F.coalesce(*(F.when(matches(text, p, low), p[0]) for p in patterns))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def all_matches(files: DataFrame, patterns: list[Pattern | tuple], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern) for every pattern that matches."""
    folded = any(Pattern(*p).fold for p in patterns)
    rows = files.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.lower(text).alias("_low")] if folded else []))
    hits = F.array(*(F.when(matches(F.col("_text"), p, F.col("_low") if folded else None), F.lit(p[0])) for p in patterns))
    return rows.select(F.col("_key").alias(key), F.explode(F.array_compact(hits)).alias("pattern"))
