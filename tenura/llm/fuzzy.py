"""Context-triggered piecewise hashes of documents and their likeness.

A rolling hash over seven bytes ends a chunk wherever it is -1 modulo the block size; each chunk gives
one of 64 letters, and a fingerprint is `size:letters:letters`, at the block size and at twice that
size. The block size is the smallest of 3, 6, 12, ... that gives about 64 chunks or fewer, halved only
while a text has hardly any chunks (`FEW`), so texts of about one length have compatible sizes. Signatures are never cut. Two fingerprints are compared by
edit distance, after repetitions are brought down to three copies, where their block sizes are equal or one is twice the other, and only if they share a
run of letters (`RUN`, or half a shorter signature), which unrelated texts hardly do: likeness is 1 - distance / longer length, else 0.

`edited_neighbours` sets each document beside the next one in descending order of id without a global
sort: documents go to slices of the id order; the first row of each slice (its highest id) is sent to
the slice before as well, so each slice has every successor it needs. Spark sorts inside its tasks, and
Python walks over the sorted rows with one document in hand, so a slice may be of any size; there are
at most `MOST_SLICES` (65 536), whose heads (one id each) come to the driver.

Defined cases: null is read as empty; empty texts have the fingerprint `3::` and are alike to each
other (1) and to nothing else (0); rows with one id are ordered by text, null ids come last; a single
document is its own next one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.texts import BYTE_BASE, Slices, mixed, small_batches, span_hashes

SMALLEST, CHUNKS, FEW, SPAN, RUN = 3, 64, 8, 7, 5
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
MOST_SLICES = 1 << 16


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the seven bytes that end there."""
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)))
    out = np.zeros(len(data), np.uint32)
    for k in range(SPAN):
        out = out * np.uint32(0x01000193) + padded[k : k + len(data)]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def chunk_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of consecutive chunks; data is taken in blocks so that temporaries stay bounded."""
    starts = np.concatenate(([0], ends[:-1]))
    out = np.zeros(len(ends), np.uint64)
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(len(data), a + BLOCK_BYTES)
        own = np.flatnonzero((starts < b) & (ends > a))
        low, high = np.maximum(starts[own], a) - a, np.minimum(ends[own], b) - a
        out[own] = mixed(out[own] * np.uint64(BYTE_BASE) + span_hashes(data[a:b] + np.uint8(1), low, high, BYTE_BASE))
    return out


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{SMALLEST}::"
    source = np.frombuffer(data, np.uint8)
    trigger = np.concatenate([rolling(source[max(0, a - SPAN + 1) : a + BLOCK_BYTES])[min(a, SPAN - 1) :] for a in range(0, len(source), BLOCK_BYTES)])
    size = SMALLEST
    while size * CHUNKS < len(source):
        size *= 2

    def letters(block: int) -> bytes:
        ends = np.flatnonzero(trigger % np.uint32(block) == block - 1) + 1
        if not len(ends) or ends[-1] != len(source):
            ends = np.append(ends, len(source))
        return LETTERS[(chunk_hashes(source, ends) >> np.uint64(58)).astype(np.int64)].tobytes()

    first = letters(size)
    second = letters(2 * size)
    while size > SMALLEST and len(first) < FEW:
        size //= 2
        first, second = letters(size), first
    return f"{size}:{first.decode()}:{second.decode()}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is the bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    top, full = 1 << (len(b) - 1), (1 << len(b)) - 1
    up, down, distance = full, 0, len(b)
    for c in a:
        same = at.get(c, 0)
        zero = ((same & up) + up ^ up) | same | down
        plus, minus = down | ~(zero | up) & full, up & zero
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up, down = minus | ~(zero | plus) & full, plus & zero
    return distance


def share_run(a: str, b: str) -> bool:
    run = min(RUN, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in runs for i in range(len(b) - run + 1))


REPEATED = re.compile(r"(.{1,64}?)\1{3,}", re.S)


def shortened(signature: str) -> str:
    """At most three copies of what a signature repeats; a periodic text may have a chunk in every period."""
    return REPEATED.sub(r"\1\1\1", signature)


def alike(a: str, b: str) -> float:
    """Likeness of two signatures of one block size, without the repetitions of either."""
    if a == b:
        return 1.0
    a, b = shortened(a), shortened(b)
    if not a or not b or not share_run(a, b):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    m, a, aa = one.split(":")
    n, b, bb = other.split(":")
    m, n = int(m), int(n)
    if not a or not b:
        return 0.0
    if m == n:
        return max(alike(a, b), alike(aa, bb))
    if m == 2 * n:
        return alike(a, bb)
    return alike(aa, b) if n == 2 * m else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fingerprint string")


def edit(text: str, following: str) -> str:
    """`text` with its last third replaced by as much of the beginning of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, guests last, then in document order: each row beside the one after it."""
    number, first, here, out = None, "", None, []

    def close(following: str) -> str:
        """Describe the row in hand; returns the fingerprint of the text that follows."""
        key, text, own = here
        changed, after = edit(text, following).encode(), fingerprint(following.encode())
        own = own or fingerprint(text.encode())
        edited = fingerprint(changed)
        out.append((key, len(text), hashlib.sha256(changed).hexdigest(), own, edited, likeness(own, edited), likeness(own, after)))
        return after

    for batch in small_batches(batches, 256):
        kind = batch.schema.field("key").type
        rows = zip(*(batch.column(c).to_pylist() for c in ("slice", "guest", "key", "text")))
        for at, guest, key, text in rows:
            after = None
            if at != number:
                if here is not None:  # no guest came: the whole table is one slice
                    close(first)
                number, first = at, text
            elif here is not None:
                after = close(text)
            here = None if guest else (key, text, after)
        yield packed(out, kind)
        out.clear()
    if here is not None:
        close(first)
        yield packed(out, kind)


def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    slices = Slices.of(docs, key, size, SLICE_BYTES, MOST_SLICES)
    rows = docs.select(slices.number(F.col(key)).alias("slice"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    # The head of a slice is the guest of the next slice above it that has rows.
    heads = {r.slice: r.head for r in rows.groupBy("slice").agg(F.max("key").alias("head")).collect()}
    above = dict(zip(sorted(heads), [*sorted(heads)[1:], min(heads)])) if len(heads) > 1 else {}
    if not above:
        dealt = rows.withColumn("guest", F.lit(False))
    else:
        known = range(slices.count)
        head = F.element_at(F.lit([heads.get(s) for s in known]).cast(f"array<{kind}>"), F.col("slice") + 1)
        to = F.element_at(F.lit([above.get(s, -1) for s in known]).cast("array<int>"), F.col("slice") + 1)
        copies = F.when(F.col("key").eqNullSafe(head), F.array(F.col("slice"), to)).otherwise(F.array("slice"))
        dealt = rows.select("key", "text", F.posexplode(copies).alias("copy", "slice")).select("slice", "key", "text", (F.col("copy") > 0).alias("guest"))
    ordered = dealt.repartition("slice").sortWithinPartitions("slice", "guest", F.desc_nulls_last("key"), "text")
    return ordered.mapInArrow(walk, f"key {kind}, {RESULT}")
