"""Periodic runs of words, found by probing harmonic grids.

A stretch of period p and length 2p or more makes p or more words in a row equal the words p later, so one of the grid
points 0, p, 2p, ... is among them. Testing the grids of all periods takes n + n/2 + n/3 + ... tests; the few points
that pass are extended to both sides, up to the next point of their grid, and neighbours that meet are one run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid points tested, and words compared, at a time.
MOST_CELLS = 1 << 20
#: Up to so many grid points periods are probed together, multiples of one another among them.
FEW_CELLS = 1 << 13

SCHEMA = "struct<n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string>"


def _agreeing(ids: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words after (``step`` 1) or before (-1) each place equal those a period later: a period less one at most.

    Compared in chunks that double in width, with what still agrees.
    """
    most = np.minimum(period - 1, len(ids) - 1 - at - period if step > 0 else at)
    same = np.zeros(len(at), np.int64)
    rows, width = np.flatnonzero(most > 0), 8
    while len(rows):
        going = []
        for k in range(0, len(rows), max(1, MOST_CELLS // width)):
            r = rows[k : k + max(1, MOST_CELLS // width)]
            far = same[r, None] + np.arange(1, width + 1)
            valid = far <= most[r, None]
            place = np.where(valid, at[r, None] + step * far, at[r, None])
            equal = valid & (ids[place] == ids[place + period[r, None]])
            n = np.where(equal.all(1), width, equal.argmin(1))
            same[r] += n
            going.append(r[(n == width) & (same[r] < most[r])])
        rows, width = np.concatenate(going), min(2 * width, 1 << 12)
    return same


def _within(key: np.ndarray, n: int, lo: int, hi: int, found: np.ndarray) -> np.ndarray:
    """Which grid points (keys ``period * n + at``, ascending) lie, with their counterpart, in a run of a divisor of their period.

    Their own stretch is that run again, or too short.
    """
    start, length, period = found
    first = -(-lo // period)
    count = np.maximum(np.minimum(hi - 1, length - 1) // period - first + 1, 0)
    run = np.repeat(np.arange(len(count)), count)
    multiple = period[run] * (first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    depth = np.zeros(len(key) + 1, np.int64)
    np.add.at(depth, np.searchsorted(key, multiple * n + start[run]), 1)
    np.add.at(depth, np.searchsorted(key, multiple * n + start[run] + length[run] - multiple), -1)
    return np.cumsum(depth)[:-1] > 0


def _probe(ids: np.ndarray, lo: int, hi: int, found: np.ndarray, least: int) -> np.ndarray:
    """Maximal stretches of the periods from ``lo`` to below ``hi``, without those within ``found``: start, length, period."""
    n = len(ids)
    periods = np.arange(lo, hi)
    count = (n - 1) // periods
    period = np.repeat(periods, count)
    at = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
    hit = np.flatnonzero(ids[at] == ids[at + period])
    at, period = at[hit], period[hit]
    if len(at) and found.shape[1]:
        new = ~_within(period * n + at, n, lo, hi, found)
        at, period = at[new], period[new]
    after, before = _agreeing(ids, at, period, 1), _agreeing(ids, at, period, -1)
    meets = (period[1:] == period[:-1]) & (at[1:] - at[:-1] == period[:-1]) & (after[:-1] == period[:-1] - 1)
    head, tail = np.flatnonzero(np.append(True, ~meets)[: len(at)]), np.flatnonzero(np.append(~meets, True)[: len(at)])
    start, period = at[head] - before[head], period[head]
    length = at[tail] + after[tail] + 1 - start + period
    long = length >= np.maximum(least, 2 * period)
    return np.stack([start, length, period])[:, long]


def runs(ids: np.ndarray, least: int = 12) -> np.ndarray:
    """``start, length, period`` (rows) of all maximal runs of ``least`` or more and of two periods or more, by start, then period.

    Periods go up, so a run of the smallest period stands before its multiples; those have the same start and length.
    """
    n, lo = len(ids), 1
    found = np.zeros((3, 0), np.int64)
    while n >= least and lo <= n // 2:
        hi = min(2 * lo, n // 2 + 1, lo + max(1, MOST_CELLS // (n // lo)))
        if n * (1 + np.log(n / lo)) <= FEW_CELLS:
            hi = n // 2 + 1
        found = np.concatenate([found, _probe(ids, lo, hi, found, least)], axis=1)
        lo = hi
    start, length, period = found = found[:, np.lexsort(found[[2, 1, 0]])]
    same = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    found = found[:, np.append(True, ~same)[: len(start)]]
    return found[:, np.lexsort(found[[2, 0]])]


def text_runs(text: bytes | None, least: int) -> tuple[int, np.ndarray, bytes]:
    """Number of words, runs, and the words outside repeats joined by one space."""
    words = text.split() if text else []  # of bytes: at \x20 and \x09 to \x0D, nothing else
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    found = runs(ids, least)
    if found.shape[1]:
        start, length, period = found
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
    return len(ids), found, b" ".join(words)


def find(text: Column, least: int = 12) -> Column:
    """Column of a text's words ``[^\\x20\\x09-\\x0D]+``: their number, their periodic runs, and the text without repeats.

    A run is a stretch of words with smallest period p, of ``least`` words and 2p or more, that neither neighbour
    extends. ``collapsed`` has the words that no run contains after its first p words, with one space between. Null and
    empty texts have no words, no runs and an empty ``collapsed``. Each row is judged by itself, so repeated rows,
    ties and other columns change nothing; whole texts are read, in memory in proportion to the text.
    """

    def run(texts: pa.Array) -> pa.Array:
        counts, found, collapsed = [], [], []
        for x in texts:
            n, r, words = text_runs(x.as_py(), least)
            counts.append(n)
            found.append(r)
            collapsed.append(words)
        each = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        offsets = np.cumsum([0, *(r.shape[1] for r in found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in each], ["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, SCHEMA).asNondeterministic()(text.cast("binary"))


def longest(found: Column) -> Column:
    """Of a column of runs the longest as a struct; of equal ones that of the smallest start, then period; null if there is none."""
    best = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(found) > 0, F.struct(best["start"].alias("start"), (-best["l"]).alias("length"), best["period"].alias("period")))
