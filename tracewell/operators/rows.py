"""Flattened tables cut into rows where anchors stand, without a character lost."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewell.functions import text as T


def looks_flattened(text: Column) -> Column:
    """One line with two pipes or more: rows of a table run together."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return ~bare.contains("\n") & (F.length(bare) - F.length(F.translate(bare, "|", "")) >= 2)


def _stands(text: str, words: list[str]) -> Iterator[tuple[int, int]]:
    """Where words stand one after another with any or no white space between them, from left to right without overlaps.

    By plain search: anchors differ from row to row, and a pattern for each would have to be compiled."""
    first, rest = words[0], words[1:]
    at = text.find(first)
    while at >= 0:
        end = at + len(first)
        for word in rest:
            while text[end : end + 1].isspace():
                end += 1
            if not text.startswith(word, end):
                at = text.find(first, at + 1)
                break
            end += len(word)
        else:
            yield at, end
            at = text.find(first, end)


def anchor_places(text: str, anchors: list[str]) -> list[int]:
    """Where rows begin: the most anchors that can stand one after another in their order, each as early as that allows.

    White space in an anchor stands for any or none. All places of all anchors are candidates; the longest chain that rises in
    both anchor and place is found as a longest rising sequence, anchors that don't fit are left out.
    """
    candidates = []
    for k, anchor in enumerate(anchors):
        words = (anchor or "").split()
        if words:
            # later places first, so that a chain takes one place of an anchor
            candidates += [(start, end, k) for start, end in _stands(text, words)][::-1]
    ends: list[int] = []  # the least end of a chain of each length
    chains: list[int] = []
    before: list[int] = []
    for i, (start, end, _) in enumerate(candidates):
        n = bisect_left(ends, start + 1)  # chains that end at or before this start
        before.append(chains[n - 1] if n else -1)
        if n == len(ends):
            ends.append(end)
            chains.append(i)
        elif end < ends[n]:
            ends[n], chains[n] = end, i
    out, i = [], chains[-1] if chains else -1
    while i >= 0:
        out.append(candidates[i][0])
        i = before[i]
    return out[::-1]


def rows_at(text: str, anchors: list[str]) -> list[str]:
    body = text.strip()
    places = anchor_places(body, anchors)
    if len(places) < 2:
        return [body] if body else []
    cuts = [0, *places[1:], len(body)]  # what stands before the first anchor stays with its row
    return [piece for a, b in zip(cuts, cuts[1:], strict=False) if (piece := body[a:b].strip())]


@F.pandas_udf(ArrayType(StringType()))
def _rows(text: pd.Series, anchors: pd.Series) -> pd.Series:
    return pd.Series([rows_at(t or "", list(a) if a is not None else []) for t, a in zip(text, anchors, strict=True)])


def split_rows(text: Column, anchors: Column) -> Column:
    """Rows of a text that begin where its anchors stand, or the text as one row where fewer than two do or a character would be
    lost. Null and blank texts have no row; null anchors are none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    rows = _rows(body, anchors)
    whole = F.when(F.length(body) > 0, F.array(body)).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(rows) >= 2) & T.conserved(body, rows), rows).otherwise(whole)
