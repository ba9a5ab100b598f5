"""SimHash near-duplicates by vantage-point trees.

Fingerprint: lower-cased (A-Z) whole text, words `[^\\x20\\x09-\\x0D]+`, 4-word shingles with
repeats, XXH64 (seed 42) of each; a bit is 1 if it is set in over half of the hashes. A text without
words has fingerprint zero.

Links: two fingerprints within `radius` bits. The 64 bits are cut into three fields, so linked
fingerprints are within `radius // 3` in at least one field. For each field a vantage-point tree is
grown over a bounded sample: an inner node holds a vantage value and the median distance to it. All
distinct fingerprints go to the one shard (leaf) they belong to, and as visitors to each further
shard that the triangle inequality cannot rule out, i.e. those whose border is within the field's
radius. Inside a shard the tree goes on in numpy; pairs are checked on all 64 bits. A shard returns
a spanning forest of its links, never all pairs, and components are found from those forests.

`near_copies` and `keep_one` are for the wider question of similar texts: 384-bit fingerprints, shards by halves of their
fields, and exact Jaccard similarity of the pairs found.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows with
one id count once; null ids take part in nothing and come back with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.components import components
from tenura.llm.storage import materialise
from tenura.llm.texts import BYTE_BASE, WORD_BASE, chunks, mixed, small_batches, span_hashes, window_hashes, word_hashes

SHINGLE = 4
FIELDS = ((0, 21), (21, 21), (42, 22))  # first bit, number of bits
SAMPLE = 1 << 22  # fingerprints from which the shards' trees are grown, at most
SHARD_ROWS = 8_192
MAX_DEPTH = 18  # 262 144 shards a field, from 2 * 10**9 distinct fingerprints on; each has 16 sampled ones at least
LEAF_PAIRS = 1 << 16
BLOCK = 1 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    take = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[take - 1 :])], "<u8")
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BLOCK >> 6):  # bounded, whatever the text's length
        bits = np.unpackbits(hashes[a : a + (BLOCK >> 6)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    ones = votes * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp has the 64 bits of the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def field(fps: np.ndarray, number: int) -> np.ndarray:
    low, bits = FIELDS[number]
    return (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


# ---- the shards' tree ---------------------------------------------------------------------------
def grow(values: np.ndarray, depth: int) -> list | None:
    """[vantage, border, inner tree, outer tree], or None for a leaf."""
    if depth == 0 or len(values) < 2:
        return None
    best = None
    for vantage in values[:: max(1, len(values) // 8)][:8]:  # the evenest of some vantage values
        far = distance(values, vantage)
        border = int(np.median(far))
        for cut in (border - 1, border):
            inner = int((far <= cut).sum())
            if 0 < inner < len(values) and (best is None or abs(2 * inner - len(values)) < best[0]):
                best = (abs(2 * inner - len(values)), vantage, cut, far)
    if best is None:
        return None
    _, vantage, border, far = best
    return [vantage, border, grow(values[far <= border], depth - 1), grow(values[far > border], depth - 1)]


def shards_of(tree: list | None, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): each value's own shard and those that its ball of `reach` may touch."""
    out, number = [], 0

    def walk(node, rows: np.ndarray, home: np.ndarray) -> None:
        nonlocal number
        if node is None:
            out.append((rows, np.full(len(rows), number), home))
            number += 1
            return
        vantage, border, inner, outer = node
        far = distance(values[rows], vantage)
        within = far <= border
        near, beyond = far - reach <= border, far + reach > border
        walk(inner, rows[near], home[near] & within[near])
        walk(outer, rows[beyond], home[beyond] & ~within[beyond])

    walk(tree, np.arange(len(values)), np.ones(len(values), bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def leaves(tree: list | None) -> int:
    return 1 if tree is None else leaves(tree[2]) + leaves(tree[3])


# ---- inside a shard -----------------------------------------------------------------------------
class Forest:
    """Components of numbered nodes, joined in blocks of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def search(fps: np.ndarray, part: np.ndarray, points: np.ndarray, visitors: np.ndarray, reach: int, radius: int, forest: Forest) -> None:
    """Join every point with the visitors within `radius`; a vantage-point tree over the points."""
    todo = [(points, visitors, 0)]
    while todo:
        points, visitors, tries = todo.pop()
        if not len(points) or not len(visitors):
            continue
        if len(points) * len(visitors) > LEAF_PAIRS and tries < 4:
            vantage = part[points[(len(points) * (2 * tries + 1)) // 8]]
            far = distance(part[points], vantage)
            border = int(np.median(far))
            border -= bool((far <= border).all())
            within = far <= border
            if not within.any():
                todo.append((points, visitors, tries + 1))
                continue
            seen = distance(part[visitors], vantage)
            todo.append((points[within], visitors[seen - reach <= border], 0))
            todo.append((points[~within], visitors[seen + reach > border], 0))
            continue
        step = max(1, BLOCK // len(visitors))
        for a in range(0, len(points), step):
            own = points[a : a + step]
            i, j = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[visitors][None, :]) <= radius)
            forest.join(own[i], visitors[j])


def shard_links(radius: int):
    def run(key, table):
        number, reach = key[0].as_py(), radius // len(FIELDS)
        fps = table.column("fp").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        forest = Forest(len(fps))
        search(fps, field(fps, number), np.flatnonzero(home), np.arange(len(fps)), reach, radius, forest)
        hung = np.flatnonzero(forest.root != np.arange(len(fps)))
        return pa.table({"a": node[hung], "b": node[forest.root[hung]]})

    return run


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): forests that connect the nodes (node, fp; fp distinct) within `radius` bits."""
    n = nodes.count()
    depth = min(MAX_DEPTH, max(0, (max(1, n) // SHARD_ROWS).bit_length()))
    sample = min(SAMPLE, 64 << depth)
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    known = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    trees = [grow(field(known, i), depth) for i in range(len(FIELDS))]
    reach = radius // len(FIELDS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i, tree in enumerate(trees):
                rows, shard, home = shards_of(tree, field(fps, i), reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), i, np.int32)), pa.array(shard.astype(np.int32)),
                     batch.column("node").take(pa.array(rows)), batch.column("fp").take(pa.array(rows)), pa.array(home)],
                    ["field", "shard", "node", "fp", "home"],
                )

    dealt = nodes.select("node", "fp").mapInArrow(deal, "field int, shard int, node long, fp long, home boolean")
    return dealt.groupBy("field", "shard").applyInArrow(shard_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id reachable by links."""
    prints = materialise(fingerprints(docs, key, text), "simhash")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(near_links(nodes, radius), "a", "b")
    by_fp = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(by_fp, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- near copies by exact Jaccard similarity ----------------------------------------------------
# A 64-bit fingerprint within 4 bits finds hardly any pair of similarity 0.8 (10 bits apart on average), so
# near copies have wide fingerprints: 6 words of 64 bits, 18 fields of 21 or 22 bits. A pair of similarity J differs in
# a share acos(2 J / (1 + J)) / pi of its bits, and some field is within 1 bit with a probability of 0.95 at J = 0.8, 0.99 at
# 0.85 and 0.999 at 0.9. Shards by halves of a field: two rows a field for each text, at any size, where visitors of the
# trees above grow faster than the table.
WIDE = 6
WIDE_SHINGLE = 5
WIDE_REACH = 1
WIDE_DEPTH = 10  # bits of the smaller half: 1 024 shards a half, of SHARD_ROWS nodes up to 8 * 10**6 nodes and larger beyond
WIDE_RADIUS = 80  # of 384 bits: the mean at J = 0.8 and three standard deviations; closer pairs are verified
LEAST = 0.8


def wide_fields(prints: np.ndarray, number: int) -> np.ndarray:
    return field(prints[:, number // len(FIELDS)], number % len(FIELDS))


def wide_prints(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, WIDE) words; text t has shingles[bounds[t]:bounds[t + 1]], one at least."""
    out = np.zeros((len(bounds) - 1, WIDE), np.uint64)
    for word in range(WIDE):
        hashes = mixed(shingles + np.uint64(0x9E3779B97F4A7C15 * (word + 1) % 2**64))
        votes = np.zeros((len(bounds) - 1, 64), np.int64)
        for a in range(0, len(hashes), BLOCK >> 6):
            b = min(len(hashes), a + (BLOCK >> 6))
            bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
            starts = np.maximum(bounds[first:last], a) - a
            votes[first:last] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        ones = votes * 2 > np.diff(bounds)[:, None]
        out[:, word] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingles_of(texts: list[bytes], width: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles with their bounds, and those of all words with their bounds."""
    words, bounds = word_hashes([t.lower() for t in texts])
    shingles, first = window_hashes(words, bounds, width)
    return shingles, np.searchsorted(first, bounds), words, bounds


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, t0, t1, fp): 128 bits of the word sequence, and the wide fingerprint (null for fewer words than a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts]):
                shingles, at, words, bounds = shingles_of(texts[a:b])
                spans = [span_hashes(words, bounds[:-1], bounds[1:], base).view(np.int64) for base in (BYTE_BASE, WORD_BASE)]
                long = np.flatnonzero(np.diff(at))
                fp: list[bytes | None] = [None] * (b - a)
                if len(long):
                    prints = wide_prints(shingles, np.append(at[:-1][long], at[-1]))
                    for i, own in zip(long.tolist(), prints):
                        fp[i] = own.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, spans), pa.array(fp, pa.binary())], ["doc_id", "t0", "t1", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t0 long, t1 long, fp binary")


class LinkedForest(Forest):
    """Components that remember the links by which they grew: a spanning forest of them."""

    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.links: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            high, low = np.maximum(x, y), np.minimum(x, y)
            hung, at = np.unique(high, return_index=True)  # each root hangs once, on a smaller one
            self.links.append(np.stack((a[at], b[at]), axis=1))
            self.root[hung] = low[at]
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def wide_search(prints: np.ndarray, part: np.ndarray, points: np.ndarray, visitors: np.ndarray, forest: LinkedForest) -> None:
    """As `search`, over wide fingerprints; in each block of pairs the nearest are linked first."""
    todo = [(points, visitors, 0)]
    while todo:
        points, visitors, tries = todo.pop()
        if not len(points) or not len(visitors):
            continue
        if len(points) * len(visitors) > LEAF_PAIRS and tries < 4:
            vantage = part[points[(len(points) * (2 * tries + 1)) // 8]]
            far = distance(part[points], vantage)
            border = int(np.median(far))
            border -= bool((far <= border).all())
            within = far <= border
            if not within.any():
                todo.append((points, visitors, tries + 1))
                continue
            seen = distance(part[visitors], vantage)
            todo.append((points[within], visitors[seen - WIDE_REACH <= border], 0))
            todo.append((points[~within], visitors[seen + WIDE_REACH > border], 0))
            continue
        step = max(1, BLOCK // len(visitors))
        for a in range(0, len(points), step):
            own = points[a : a + step]
            i, j = np.nonzero(np.bitwise_count(part[own][:, None] ^ part[visitors][None, :]) <= WIDE_REACH)
            i, j = own[i], visitors[j]
            apart = forest.root[i] != forest.root[j]  # what is connected needs no further link
            i, j = i[apart], j[apart]
            far = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
            order = np.argsort(far, kind="stable")
            order = order[far[order] <= WIDE_RADIUS]
            for few in np.array_split(order, 8):  # nearest eighths first
                forest.join(i[few], j[few])


def half_shards(values: np.ndarray, bits: int, half: int, depth: int) -> np.ndarray:
    """Shard of each field value by its lower or upper half. Values within one bit agree in one half at least."""
    low = bits // 2
    own, size = (values & np.uint64((1 << low) - 1), low) if half == 0 else (values >> np.uint64(low), bits - low)
    spread = own * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << size) - 1)  # one to one; frequent values part
    return (spread >> np.uint64(size - depth)).astype(np.int32)


def wide_links(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) to be verified; of each shard a spanning forest of its near pairs.

    A node goes to two shards a field, one for each half of the field's bits, whatever the number of nodes; to one
    where a field has one shard.
    """
    n = nodes.count()
    depth = min(WIDE_DEPTH, max(0, (max(1, n) // SHARD_ROWS).bit_length()))

    def prints_of(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WIDE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 5_000):
            prints = prints_of(batch.column("fp"))
            for i in range(WIDE * len(FIELDS)):
                for half in range(2 if depth else 1):
                    shard = half_shards(wide_fields(prints, i), FIELDS[i % len(FIELDS)][1], half, depth) * 2 + half
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(prints), i, np.int32)), pa.array(shard.astype(np.int32)), batch.column("node"), batch.column("fp")],
                        ["field", "shard", "node", "fp"],
                    )

    def shard(key, table):
        prints = prints_of(table.column("fp"))
        node, every = table.column("node").to_numpy(), np.arange(table.num_rows)
        forest = LinkedForest(len(node))
        wide_search(prints, wide_fields(prints, key[0].as_py()), every, every, forest)
        links = np.concatenate(forest.links) if forest.links else np.zeros((0, 2), np.int64)
        a, b = node[links[:, 0]], node[links[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = nodes.select("node", "fp").mapInArrow(deal, "field int, shard int, node long, fp binary")
    return dealt.groupBy("field", "shard").applyInArrow(shard, "a long, b long").distinct()


def jaccard_of(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts."""
    sets = []
    for texts in (left, right):
        shingles, at, _, _ = shingles_of(texts)
        sets.append([np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:])])
    common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], float)
    return common / np.maximum(np.array([len(x) + len(y) for x, y in zip(*sets)]) - common, 1)


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """The pairs whose texts have a Jaccard similarity of `least` over five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            left, right = (batch.column(c).to_pylist() for c in ("x", "y"))
            near = np.concatenate([jaccard_of(left[a:b], right[a:b]) >= least - 1e-12 for a, b in chunks([len(x) + len(y) for x, y in zip(left, right)])])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    texts = texts.join(asked, "node", "left_semi").groupBy("node").agg(F.max("t").alias("t"))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b")
    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of each row: equal word sequences, and texts with a Jaccard similarity of `least` over
    five-word shingles (A-Z lower-cased), found by wide fingerprints and verified. component_id is the
    smallest id reachable; a null id has none. Rows of one id should have one text; the greatest counts.
    """
    made = materialise(described(docs, key, text), "wide-simhash")
    same = ["t0", "t1"]
    nodes = materialise(made.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp")), "wide-nodes")
    pairs = materialise(wide_links(nodes.where("fp is not null")), "wide-pairs")
    found = components(verified(pairs, docs, key, text, least), "a", "b")
    by_text = nodes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    joined = made.join(by_text, same, "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents without their near copies: of each component of `near_copies` the smallest id stays.

    Rows with a null id are kept. Of several rows with one id one stays where they are equal.
    """
    groups = near_copies(docs, least=least)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
