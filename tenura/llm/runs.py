"""Periodic runs of words, found with a difference-cover index of longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends. `runs` wants at least `least` (4) periods and `length` (6) words of it; `kept`
is the text without the repetitions: of each run the first q words stay.

How a batch of documents is searched:
* Words become numbers; the documents of a batch stand one after the other, each after a mark of its
  own, so no extension crosses a document.
* Only suffixes at positions whose remainder modulo 31 lies in a difference cover are sorted: by their
  first 31 words, then by doubling, which stays inside the sample. Their common prefixes go into a
  sparse table of minima. For any two positions some shift below 31 takes both to the sample: fewer
  than 31 words are compared one by one, the rest is one range minimum.
* A run of period p matches itself, p words later, on at least (least - 1) * p positions, so the
  positions that are multiples of that number meet every such run. Over all p this grid is a harmonic
  sum, n ln n / 3 points; a point whose word differs from the word p later is passed over, the others are
  extended to both sides.
* A stretch found with several periods has the smallest of them (Fine and Wilf).

One pass, no shuffle; a document is one row and is searched whole. Memory follows the batch (about
128 thousand words) or the longest document.

Defined cases: null, empty and blank texts have no words and no runs, `kept` is empty; fewer than
`length` words: no runs; repeated rows and null ids come back once for each row; an empty table gives
no rows; columns named in `keep` that clash with an output name come back with `_input` appended.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.texts import clear_of, small_batches

LEAST, LENGTH = 4, 6
BATCH_WORDS = 1 << 17
GRID_POINTS = 1 << 18

# A perfect difference set modulo 31, every remainder is a difference of two of its members.
CYCLE = 31
COVER = np.array([1, 5, 11, 24, 25, 27])


def _shifts() -> np.ndarray:
    """shift[a, b]: the least s that takes remainders a and b into the cover at once."""
    inside = np.isin((np.arange(CYCLE)[:, None] + np.arange(CYCLE)) % CYCLE, COVER)  # [remainder, shift]
    return np.argmax(inside[:, None, :] & inside[None, :, :], axis=2)


SHIFT = _shifts()


class Extensions:
    """How far the sequence agrees with itself from two positions on; its last value must be unique."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.codes = np.concatenate((codes + 1, np.zeros(CYCLE, codes.dtype)))
        self.at = np.flatnonzero(np.isin(np.arange(n) % CYCLE, COVER))  # sampled positions
        self.index = np.full(n + 1, -1)
        self.index[self.at] = np.arange(len(self.at))
        levels = [self._first_ranks()]
        while len(self.at) and levels[-1].max() < len(self.at) - 1:
            levels.append(self._doubled(levels[-1], CYCLE << (len(levels) - 1)))
        self.rank = levels[-1]
        self.minima = self._minima(levels)

    def _first_ranks(self) -> np.ndarray:
        """Ranks of the sampled positions by their next 31 words, several words packed in one key."""
        bits = max(1, int(self.codes.max()).bit_length())
        width = max(1, 62 // bits)
        keys = []
        for a in range(0, CYCLE, width):
            key = np.zeros(len(self.at), np.int64)
            for t in range(a, min(a + width, CYCLE)):
                key = key << bits | self.codes[self.at + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(order), bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh)
        return rank

    def _moved(self, index: np.ndarray, step: int) -> np.ndarray:
        """Indexes of the sampled positions `step` (a multiple of 31) further; -1 beyond the end."""
        return self.index[np.minimum(self.at[index] + step, len(self.index) - 1)]

    def _doubled(self, rank: np.ndarray, step: int) -> np.ndarray:
        after = self._moved(np.arange(len(rank)), step)
        follow = np.where(after >= 0, rank[after] + 1, 0)
        return np.unique(rank * (len(rank) + 1) + follow, return_inverse=True)[1]

    def _minima(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Sparse table over the common prefixes of neighbours in suffix order."""
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            live = np.flatnonzero((a >= 0) & (b >= 0))
            live = live[levels[k][a[live]] == levels[k][b[live]]]
            common[live] += CYCLE << k
            a[live], b[live] = self._moved(a[live], CYCLE << k), self._moved(b[live], CYCLE << k)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        common[live] += self._steps(self.at[a[live]], self.at[b[live]], np.full(len(live), CYCLE))
        table = [common]
        while 2 << (len(table) - 1) <= len(common):
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def _steps(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, compared one by one, at most `most` (31 or fewer)."""
        same = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(CYCLE):
            live = live[most[live] > t]
            live = live[self.codes[i[live] + t] == self.codes[j[live] + t]]
            if not len(live):
                break
            same[live] += 1
        return same

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair i < j."""
        shift = SHIFT[i % CYCLE, j % CYCLE]
        out = self._steps(i, j, shift)
        on = np.flatnonzero((out == shift) & (j + shift < len(self.index) - 1))
        a, b = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        span = high - low
        level = np.frexp(span.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            table = self.minima[k]
            out[on[own]] += np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def _grid(total: int, most: int, least: int, length: int):
    """(positions, periods) of the harmonic grid in pieces of about GRID_POINTS."""
    periods = np.arange(1, most + 1)
    steps = np.maximum((least - 1) * periods, length - periods)
    counts = -(-total // steps)
    upto = np.cumsum(counts)
    a = 0
    while a < most:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - counts[a] + GRID_POINTS, side="right")))
        own = counts[a:b]
        first = np.repeat(np.cumsum(own) - own, own)
        yield (np.arange(own.sum()) - first) * np.repeat(steps[a:b], own), np.repeat(periods[a:b], own)
        a = b


def found_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, length: int = LENGTH) -> np.ndarray:
    """Rows (document, start in it, length, period) in order; document d has codes[bounds[d]:bounds[d + 1]]."""
    sizes = np.diff(bounds)
    most = int(sizes.max() // least) if len(sizes) else 0
    if most < 1:
        return np.zeros((0, 4), np.int64)
    own = int(codes.max()) + 1
    n_docs = len(sizes)
    line = np.empty(len(codes) + n_docs + 1, np.int64)  # mark, document, mark, document, ..., mark
    marks = bounds + np.arange(n_docs + 1)
    inside = np.ones(len(line), bool)
    inside[marks] = False
    line[marks] = own + np.arange(n_docs + 1)
    line[inside] = codes
    left = np.repeat(sizes, sizes + 1)  # words of the document at each place; its mark is the place before it
    left = np.append(left, 0)
    ahead, behind = None, None
    parts = []
    total = len(line)
    for i, p in _grid(total, most, least, length):
        fits = np.flatnonzero((i + p < total) & (left[i] >= least * p))
        fits = fits[line[i[fits]] == line[i[fits] + p[fits]]]
        if not len(fits):
            continue
        i, p = i[fits], p[fits]
        if ahead is None:
            ahead, behind = Extensions(line), Extensions(line[::-1].copy())
        further = ahead.common(i, i + p)
        back = behind.common(total - i - p, total - i)
        size = back + further + p
        long = size >= np.maximum(length, least * p)
        parts.append(np.stack((i[long] - back[long], size[long], p[long]), axis=1))
    if not parts:
        return np.zeros((0, 4), np.int64)
    rows = np.unique(np.concatenate(parts), axis=0)  # by start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # the smallest period of each stretch
    rows = rows[first]
    doc = np.searchsorted(marks, rows[:, 0], side="right") - 1
    rows = np.column_stack((doc, rows[:, 0] - marks[doc] - 1, rows[:, 1], rows[:, 2]))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _dropped(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    begin = bounds[rows[:, 0]] + rows[:, 1]
    np.add.at(edge, begin + rows[:, 3], 1)
    np.add.at(edge, begin + rows[:, 2], -1)
    return np.cumsum(edge)[:-1] > 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _result(batch: pa.RecordBatch, words: list[list[bytes]], keep: tuple[str, ...], least: int, length: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    place = count()
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter((numbers.setdefault(x, next(place)) for w in words for x in w), np.int64, int(sizes.sum()))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    rows = found_runs(codes, bounds, least, length)
    offsets = np.searchsorted(rows[:, 0], np.arange(len(words) + 1)).astype(np.int32)
    gone = _dropped(rows, bounds) if len(rows) else None
    kept = []
    for d, own in enumerate(words):
        if offsets[d] < offsets[d + 1]:
            stays = np.flatnonzero(~gone[bounds[d] : bounds[d + 1]]).tolist()
            own = [own[k] for k in stays]
        kept.append(b" ".join(own))
    flat = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    out = [batch.column("key"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), flat).cast(RUNS), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(out + [batch.column(c) for c in keep], ["key", "n_words", "runs", "kept", *keep])


def _searched(keep: tuple[str, ...], least: int, length: int):
    def run(batches):
        for batch in small_batches(batches):
            words = [t.split() if t else [] for t in batch.column("text").to_pylist()]
            a, total = 0, 0
            for b, own in enumerate(words):
                if b > a and total + len(own) > BATCH_WORDS:
                    yield _result(batch.slice(a, b - a), words[a:b], keep, least, length)
                    a, total = b, 0
                total += len(own)
            if a < len(words):
                yield _result(batch.slice(a), words[a:], keep, least, length)

    return run


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: int = LEAST, length: int = LENGTH) -> DataFrame:
    """One row per document: key, n_words, runs (start, length, period; by start, then period) of at least
    `least` periods and `length` words, kept (UTF-8 of the words left, joined by one space).
    """
    if least < 2:
        raise ValueError("a run has at least two periods")
    names = clear_of(keep, {"key", "n_words", "runs", "kept", "text"})
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *(F.col(c).alias(a) for c, a in zip(keep, names)))
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary"
    schema += "".join(f", `{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(_searched(tuple(names), least, length), schema)


def strongest(found: str = "runs"):
    """The run of greatest length / period, compared exactly; the first of equals, null if there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(
        found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(more(best, r), r).otherwise(best)
    )
