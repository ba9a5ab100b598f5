"""Numpy kernels over batches of texts, and the slicing of tables by document order.

Words are runs of bytes other than `\\x20` and `\\x09-\\x0D`. A word's hash comes from prefix sums
of byte * base**position modulo 2**64, so a batch is hashed without a loop over its words.
"""

from __future__ import annotations

import bisect
import itertools
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.sampling import bounded_by_hash

CHUNK_BYTES = 1 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size; size is a power of two."""
    up = np.full(size, base, np.uint64)
    up[0] = 1
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(1 << 16, 1 << (max(size, 1) - 1).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(BYTE_BASE))


def chunks(sizes: list[int], limit: int = CHUNK_BYTES):
    """Consecutive index ranges whose sizes add up to `limit` or that hold one item."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(batches, rows: int = 1_000):
    """The record batches in pieces of at most `rows` rows (views, no copies): fewer texts are Python
    objects at one time.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more)."""
    parts, counts = [], []
    for a, b in chunks([len(t) for t in texts]):
        data = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        parts.append(span_hashes(data + np.uint8(1), starts, ends, BYTE_BASE))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
        counts.append(np.diff(np.searchsorted(starts, begins)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def window_hashes(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `length` words inside one text, and their first words' indexes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.arange(n)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    first = first[first + length <= ends]
    out = []
    for a in range(0, len(first), CHUNK_BYTES):  # bounded temporaries and power tables
        own = first[a : a + CHUNK_BYTES]
        low = own[0]
        out.append(span_hashes(words[low : own[-1] + length], own - low, own - low + length, WORD_BASE))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def clear_of(names: tuple[str, ...] | list[str], taken: set[str]) -> list[str]:
    """Names under which carried columns come back: one that an operator uses itself gets `_input`."""
    out: list[str] = []
    for name in names:
        while name in taken or name in out:
            name += "_input"
        out.append(name)
    return out


# ---- slices: consecutive ranges of the document order -------------------------------------------
MAX_KNOTS, SAMPLED = 4_096, 32


def sampled_ids(df: DataFrame, key: str, size: Column, n: int, bound: int) -> DataFrame:
    """(key, count) of about `bound` of the `n` rows, those with a small hash of id and size: the same in every run."""
    hashed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(key), size).alias("hash"))
    return bounded_by_hash(hashed, F.col("hash"), n, bound).groupBy("key").count()


def borders(df: DataFrame, key: str, size: Column, n: int, parts: int) -> list:
    """Ids that cut `n` rows into about equal `parts`. A sampled id comes to the driver once, and nothing else of its rows."""
    ids = sorted(tuple(r) for r in sampled_ids(df, key, size, n, SAMPLED * parts).collect())
    ends = list(itertools.accumulate(count for _, count in ids))
    return [ids[bisect.bisect_right(ends, i * ends[-1] // parts)][0] for i in range(1, parts)] if ids else []


class Slices:
    """A monotone map from an id to a slice number below `count`, about equal in rows.

    At most 4096 sampled ids are the borders, taken from 32 times as many on the driver; whole numbers stay
    exact at any size. Beyond that number of slices the id is cut linearly between two of them. Null ids belong to slice 0.
    """

    def __init__(self, knots: list, fine: int) -> None:
        self.knots, self.fine, self.high = knots, fine, None
        self.count = max(1, len(knots)) * fine

    @classmethod
    def of(cls, df: DataFrame, key: str, size: Column, target: int, most: int | None = None) -> Slices:
        """Slices of about `target` units of the summed `size`; larger ones where that makes over `most`."""
        row = df.agg(F.sum(size).alias("total"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
        wanted = max(1, math.ceil((row.total or 0) / target))
        wanted = wanted if most is None else min(wanted, most)
        if row.low is None or row.low == row.high or wanted == 1:
            return cls([], 1)
        coarse = min(wanted, MAX_KNOTS)
        made = cls(sorted({row.low, *borders(df, key, size, row.n, coarse)}), math.ceil(wanted / coarse))
        made.high = row.high
        return made

    def number(self, key: Column) -> Column:
        if not self.knots:
            return F.lit(0)
        whole = all(isinstance(k, int) for k in self.knots)
        kind = "bigint" if whole else "double"
        knots = F.array(*(F.lit(k) for k in self.knots)).cast(f"array<{kind}>")
        ends = [*self.knots[1:], self.high]
        widths = F.array(*(F.lit(float(b - a + (1 if whole and i == len(ends) - 1 else 0)) or 1.0) for i, (a, b) in enumerate(zip(self.knots, ends))))
        steps = [1 << k for k in reversed(range(len(self.knots).bit_length()))]
        reached = lambda at, step: F.coalesce(F.get(knots, at + step) <= key, F.lit(False))
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
        exact = "decimal(20,0)" if whole else "double"
        beyond = (key.cast(exact) - F.get(knots, at).cast(exact)).cast("double")
        part = F.floor(beyond / F.get(widths, at) * self.fine)
        part = F.least(F.greatest(part, F.lit(0)), F.lit(self.fine - 1))
        return F.coalesce(at * self.fine + part, F.lit(0)).cast("int")
