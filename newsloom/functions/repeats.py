r"""Shortening of repeated units in texts of any length.

The pattern ``(.+?)\1{2,}`` replaced by ``$1`` takes quadratic time. Here the
stretches of a text that consist of three or more copies of a unit are found first,
in O(n log n): a unit of p characters that is repeated three times covers two whole
blocks of the grid of step p, so only equal neighbouring blocks of that grid are
extended to both sides. Blocks are compared by the ranks of their substrings of a
power of two characters, which are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.session import bound_batches, ship_package


def _next_ranks(ranks: np.ndarray, half: int) -> np.ndarray:
    """Ranks of the substrings twice as long; ``half`` is the length ranked so far."""
    pairs = ranks[:-half].astype(np.int64) << 32 | ranks[half:]
    return np.unique(pairs, return_inverse=True)[1]


def _extended(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """How many characters agree from ``left`` and ``right`` on: ahead (step 1) or before them (step -1)."""
    length = np.zeros(len(left), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        ranks, size = levels[j], 1 << j
        a, b = (left + length, right + length) if step > 0 else (left - length - size, right - length - size)
        inside = (a >= 0) & (b < len(ranks))
        same = inside.copy()
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        length += same * size
    return length


def triple_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal stretches of three or more copies of a unit that is no repetition itself."""
    n = len(codes)
    ranks = np.unique(codes, return_inverse=True)[1]
    levels, found, size = [], [], 1
    reach = np.zeros(n + 1, np.int64)
    while 3 * size <= n and len(ranks) > size:
        levels.append(ranks)
        periods = np.arange(size, min(2 * size - 1, n // 3) + 1)
        blocks = n // periods - 1
        p = np.repeat(periods, blocks)
        k = np.arange(len(p)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        a = k * p
        equal = (ranks[a] == ranks[a + p]) & (ranks[a + p - size] == ranks[a + 2 * p - size])
        # Two blocks inside a stretch of a shorter unit repeat that unit, which comes first.
        equal &= reach[a] < a + 2 * p
        p, k = p[equal], k[equal]
        if len(p):
            opens = np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1] + 1)]
            closes = np.r_[opens[1:], True]
            q, first, last = p[opens], k[opens] * p[opens], (k[closes] + 1) * p[closes]
            start = first - _extended(levels, first, first + q, -1)
            end = last + q + _extended(levels, last, last + q, 1)
            long = end - start >= 3 * q
            found.append((start[long], end[long], q[long]))
            np.maximum.at(reach, start[long], end[long])
            reach = np.maximum.accumulate(reach)
        ranks = _next_ranks(ranks, size)
        size *= 2
        if len(ranks) == 0 or ranks.max() + 1 == len(ranks):
            break  # no substring of this length occurs twice
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def shorten(text: str) -> str:
    """One copy of every unit repeated three or more times: leftmost first, shortest unit first."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, ends, periods = triple_runs(codes)
    if not len(starts):
        return text
    unit, stop = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for i in np.argsort(-periods, kind="stable"):
        begins = slice(starts[i], ends[i] - 3 * periods[i] + 1)
        unit[begins], stop[begins] = periods[i], ends[i]
    places = np.flatnonzero(unit)
    out, at, next_place = [], 0, 0
    while next_place < len(places):
        i = int(places[next_place])
        p = int(unit[i])
        out.append(text[at : i + p])
        at = i + (int(stop[i]) - i) // p * p
        next_place = int(np.searchsorted(places, at))
    return "".join(out) + text[at:]


def shorten_repeats(text: Column) -> Column:
    """:func:`shorten` as a column function; null stays null.

    Memory is about log2(m) numbers of eight bytes per character of one text, m
    being the length of its longest substring that occurs twice, and ten more.
    """
    ship_package(SparkSession.active())
    bound_batches(SparkSession.active())

    @F.pandas_udf(StringType())
    def shortened(texts: pd.Series) -> pd.Series:
        return texts.map(shorten, na_action="ignore")

    return shortened(text)
