"""Periodic runs of words: Karp-Miller-Rosenberg names of power-of-two blocks, grid candidates and extension by names.

Words get exact names by dictionary. A name of level k stands for 2**k consecutive words of one text, and names of level
k + 1 are made from pairs of names of level k; blocks that occur once in their text need none and get -1, so levels thin
out fast in ordinary texts. How far two places of a text agree is read off the levels from the highest to the lowest, each
of them adding its power of two if the names are equal.

In a run of period q and at least EXPONENT periods, words q apart agree over (EXPONENT - 1) * q places. So one of the
places that are multiples of (EXPONENT - 2) * q begins q words that agree with the next q, and their blocks of the greatest
power of two within q have equal names. These candidates, some n * ln(n) / 2 of n words, are looked up in vectors; the few
with equal names are extended to both sides. No hashes and no suffixes are compared or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Least words and least periods of a run.
LEAST_LENGTH = 6
EXPONENT = 4
#: Candidates that are looked up at once.
BLOCK = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words raw[start:end], which hold every byte of raw that is no space, as strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[tk.solid(raw)]))


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal names for equal keys, -1 for keys that occur once."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count[name] > 1, name, -1).astype(np.int32)


def levels(words: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Names of the 2**k words from every place, for every k at which any text repeats a block; one place more holds -1.

    words are numbers of words, row the texts they belong to. Names of different texts differ.
    """
    n = len(words)
    if not n:
        return []
    out, size = [], 1
    at, names = np.arange(n), _named(row.astype(np.int64) * (int(words.max()) + 1) + words)
    while (names >= 0).any():
        level = np.full(n + 1, -1, np.int32)
        level[at] = names
        out.append(level)
        at = at[names >= 0]
        at = at[at + size < n]
        # blocks of other texts have other names, so only a pair across a border is left out here
        at = at[(level[at + size] >= 0) & (row[at] == row[np.minimum(at + size, n - 1)])]
        names = _named(level[at].astype(np.int64) * (n + 1) + level[at + size]) if len(at) else np.zeros(0, np.int32)
        size *= 2
    return out


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from a and b on (or before them) agree; a < b."""
    reach, last = np.zeros(len(a), np.int64), len(names[0]) - 1
    for k in range(len(names) - 1, -1, -1):
        x, y = (a - reach - (1 << k), b - reach - (1 << k)) if back else (a + reach, b + reach)
        found = names[k][np.where(x < 0, last, np.minimum(x, last))]
        reach += ((found >= 0) & (found == names[k][np.where(y < 0, last, np.minimum(y, last))])).astype(np.int64) << k
    return reach


def _candidates(level: np.ndarray, low: int, high: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) with equal names at place and place + period, for periods low to high, BLOCK looked up at once."""
    n = len(level) - 1
    q = np.arange(low, min(high, n - 1) + 1)
    # places 0, step, 2 * step, ... before n - q
    each = (n - q - 1) // ((exponent - 2) * q) + 1
    upto = np.concatenate([[0], np.cumsum(each)])
    for first in range(0, int(upto[-1]), BLOCK):
        number = np.arange(first, min(first + BLOCK, int(upto[-1])))
        which = np.searchsorted(upto, number, "right") - 1
        period = q[which]
        place = (number - upto[which]) * (exponent - 2) * period
        name = level[place]
        hit = (name >= 0) & (name == level[place + period])
        if hit.any():
            yield place[hit], period[hit]


def find(words: np.ndarray, row: np.ndarray, longest: int, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period; longest is the number of words of the longest text.

    A stretch whose smallest period divides another comes with that other as well; the smallest is kept.
    """
    names = levels(words, row)
    found = [np.zeros((3, 0), np.int64)]
    for k, level in enumerate(names):
        made = [np.zeros((3, 0), np.int64)]
        for place, period in _candidates(level, 1 << k, min((2 << k) - 1, longest // exponent), exponent):
            start, end = place - _agree(names, place, place + period, True), place + period + _agree(names, place, place + period, False)
            long = end - start >= np.maximum(least, exponent * period)
            made.append(_smallest(np.stack([start[long], end[long], period[long]])))
        found = [_smallest(np.concatenate(found + made, axis=1))]
    start, end, period = found[0]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs (start, end, period) with equal ends, the one of the smallest period."""
    runs = runs[:, np.lexsort(runs[::-1])]
    keep = np.ones(runs.shape[1], bool)
    keep[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return runs[:, keep]


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row.

    runs are the stretches of least or more words and exponent (3 or more) or more of their smallest periods that no
    neighbouring word extends, by start, then period; start counts words from 0. collapsed is the text's words joined by one
    space, without those that any run contains after its first period. Rows are taken one by one, so repeated rows and ids
    and null ids stay as they are. A null, empty or wordless text has no runs and an empty collapsed text; an empty table
    gives an empty result; other columns do not matter, whatever their names. A text is read whole by one task, in some
    70 bytes of memory per byte of text besides 4 bytes per word and level; others share slices of half a megabyte.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                offsets, raw = tk.buffers(part.column("text"))
                row, starts, ends = tk.words(offsets, raw)
                words = word_array(raw, starts, ends)
                del starts, ends, raw
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                start, end, period = find(numbers, row, int(np.diff(first).max(initial=0)), least, exponent)
                of = row[start]
                at = np.searchsorted(of, np.arange(part.num_rows + 1))
                rows = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
                cover = np.zeros(len(row) + 1, np.int32)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, end, -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                each = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(row[kept], np.arange(part.num_rows + 1))), words.take(pa.array(kept)))
                collapsed = pc.binary_join(each, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), rows), collapsed.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    sent = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return sent.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
