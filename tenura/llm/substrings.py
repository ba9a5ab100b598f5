"""Removal of repeated passages with fixed-block anchors.

A window is `window` (20) consecutive words of one document. Blocks of half that length (10 words)
at word positions 0, 10, 20, ... are indexed; every window contains such a block whole. All rolling
10-word spans probe that index. Where a span and a block elsewhere agree, the windows around are
compared by their 20-word hashes, and windows that follow each other are extended to the maximal
repeat. A word goes if a window around it starts earlier too: in a smaller id, or earlier in the same
document; windows are judged on the input.

How it is dealt out: documents are cut into slices, which are consecutive ranges of ids of about
8 MB (`Slices`), so "earlier" between slices is a comparison of slice numbers. A slice sends each
distinct span once (48 bits, packed by hash range), whatever its number of copies, so a passage that
a third of all documents share costs one entry for each slice. A hash range answers each slice with
the spans that hit; in a second exchange the same is done with the windows around those hits. The
words themselves are shuffled once and read three times. Spans compare on 48 bits only to find
candidates; windows compare on 64.

Defined cases: null and empty texts have no words; rows with one id are ordered by text, null ids come
first; fewer than 20 words: nothing is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.texts import Slices, clear_of, window_hashes, word_hashes

WINDOW = 20
SLICE_BYTES = 8 << 20
RANGE_WORDS = 1 << 19  # probes that a hash range receives, about


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a slice in document order, null ids first."""
    keys = [("key", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def words_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t or b"" for t in table.column("text").to_pylist()])


def packed(values: np.ndarray) -> dict[str, bytes]:
    """Sorted values as two planes; the upper one compresses well."""
    return {"low": values.astype("<u4").tobytes(), "high": (values >> np.uint64(32)).astype("<u4").tobytes()}


def unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4") | np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(32)


def ranges(values: np.ndarray, bits: int, width: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the sorted `width`-bit values by their upper `bits` bits."""
    if not bits:
        return [(0, 0, len(values))] if len(values) else []
    edges = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits))
    edges = np.append(edges, len(values))
    return [(int(i), int(edges[i]), int(edges[i + 1])) for i in np.flatnonzero(np.diff(edges))]


SENT = "range int, slice int, low binary, high binary, block binary, more binary"
SENT_SCHEMA = pa.schema([("range", pa.int32()), ("slice", pa.int32()), *((n, pa.binary()) for n in ("low", "high", "block", "more"))])
REPLY = "slice int, low binary, high binary"
REPLY_SCHEMA = pa.schema([("slice", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


def contains(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return sorted_values[at] == asked


def send(number: int, values: np.ndarray, block: np.ndarray, more: np.ndarray, bits: int, width: int) -> pa.Table:
    rows = [
        {"range": r, "slice": number, **packed(values[a:b]), "block": np.packbits(block[a:b]).tobytes(), "more": np.packbits(more[a:b]).tobytes()}
        for r, a, b in ranges(values, bits, width)
    ]
    return pa.Table.from_pylist(rows, SENT_SCHEMA)


def probe(half: int, bits: int):
    """Each slice sends its distinct spans: whether one is an indexed block, and whether it repeats."""

    def run(key, table):
        words, bounds = words_of(ordered(table))
        spans, first = window_hashes(words, bounds, half)
        spans >>= np.uint64(16)
        begins = np.repeat(bounds[:-1], np.diff(bounds))
        indexed = np.unique(spans[(first - begins[first]) % half == 0])
        values, counts = np.unique(spans, return_counts=True)
        return send(key[0].as_py(), values, contains(indexed, values), counts > 1, bits, 48)

    return run


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, their rows' numbers, and both marks, sorted by value and then by slice."""
    table = table.sort_by("slice")
    parts = [unpacked(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist())]
    sizes = [len(p) for p in parts]
    marks = [
        np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column(c).to_pylist(), sizes)]).astype(bool)
        for c in ("block", "more")
    ]
    values, owner = np.concatenate(parts), np.repeat(table.column("slice").to_numpy(), sizes)
    order = np.argsort(values, kind="stable")
    return values[order], owner[order], marks[0][order], marks[1][order]


def reply(values: np.ndarray, owner: np.ndarray) -> pa.Table:
    rows = []
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
    for a, b in zip(edges[:-1], edges[1:]):
        rows.append({"slice": int(owner[a]), **packed(values[a:b])})
    return pa.Table.from_pylist(rows, REPLY_SCHEMA)


def hits(key, table):
    """The spans that occur twice or more, once at least as an indexed block."""
    values, owner, block, more = gathered(table)
    start = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(values))))
    times = np.add.reduceat(1 + more.astype(np.int64), start)
    hot = (times > 1) & np.logical_or.reduceat(block, start)
    return reply(values[hot[group]], owner[hot[group]])


def later(key, table):
    """For each window the slices after the first one that has it."""
    values, owner, _, _ = gathered(table)
    again = np.concatenate(([False], values[1:] == values[:-1]))
    return reply(values[again], owner[again])


def replied(table: pa.Table) -> np.ndarray:
    parts = [unpacked(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def verify(window: int, bits: int):
    """Each slice sends the distinct windows around its hits."""
    half = window // 2

    def run(key, docs, found):
        if not docs.num_rows or not found.num_rows:
            return SENT_SCHEMA.empty_table()
        words, bounds = words_of(ordered(docs))
        spans, first = window_hashes(words, bounds, half)
        hit = np.zeros(len(words) + 2, np.int64)
        hit[first + 1] = contains(replied(found), spans >> np.uint64(16))
        sums = np.cumsum(hit)
        windows, at = window_hashes(words, bounds, window)
        near = sums[at + window - half + 1] > sums[at]
        values, counts = np.unique(windows[near], return_counts=True)
        return send(key[0].as_py(), values, np.zeros(len(values), bool), counts > 1, bits, 64)

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove(window: int, keep: tuple[str, ...], untouched: bool):
    def run(key, docs, found):
        table = ordered(docs)
        given = table.column("text").to_pylist()
        texts = [t or b"" for t in given]
        words, bounds = word_hashes(texts)
        windows, at = window_hashes(words, bounds, window)
        first = np.zeros(len(windows), bool)
        first[np.unique(windows, return_index=True)[1]] = True
        again = at[~first | contains(replied(found), windows)]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        n_words, n_removed, spans, kept = [], [], [], []
        for whole, text, a, b in zip(given, texts, bounds[:-1], bounds[1:]):
            own = gone[a:b]
            runs = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            words_here = text.split()
            for x, y in reversed(list(zip(runs[0::2], runs[1::2]))):
                del words_here[x:y]
            n_words.append(b - a)
            n_removed.append(int(own.sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(runs[0::2], runs[1::2])])
            kept.append(whole if untouched and not runs else b" ".join(words_here))
        out = [table.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, SPANS)]
        out += [pa.array(kept, pa.binary()), *(table.column(c) for c in keep)]
        return pa.Table.from_arrays(out, ["key", "n_words", "n_removed", "spans", "kept", *keep])

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, untouched: bool = False) -> DataFrame:
    """One row per document: key, n_words, n_removed, spans (maximal runs of removed words), kept
    (UTF-8 of the kept words joined by one space; if `untouched`, a text that loses nothing as it is)
    and the columns named in `keep` (with `_input` appended where a name is taken).
    """
    if window % 2:
        raise ValueError("the window must be even")
    names = clear_of(keep, {"key", "n_words", "n_removed", "spans", "kept", "slice", "text"})
    half = window // 2
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    slices = Slices.of(docs, key, size, SLICE_BYTES)
    ranges_wanted = max(1, slices.count * SLICE_BYTES // 6 // RANGE_WORDS)
    bits = (ranges_wanted - 1).bit_length()
    rows = docs.select(slices.number(F.col(key)).alias("slice"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *(F.col(c).alias(a) for c, a in zip(keep, names)))
    found = rows.groupBy("slice").applyInArrow(probe(half, bits), SENT).groupBy("range").applyInArrow(hits, REPLY)
    around = rows.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(verify(window, bits), SENT)
    known = around.groupBy("range").applyInArrow(later, REPLY)
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    schema += "".join(f", `{c}` {kinds[c]}" for c in names)
    return rows.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(remove(window, tuple(names), untouched), schema)
