"""Forests and boosted trees of many fits, grown together: one pass over binned rows for each level of all of them.

Spark ML fits one model a time and walks every tree for every row. Here the rows are binned once (numbers by Spark's
own rule, a label is a slot of two bins), kept as blocks of arrays, and a pass adds up the histograms of all fits.
Splits, impurities, minimum rows, the weight of a first boosted tree, log loss and the merging of leaves that say the
same are those of Spark ML; boosted trees without subsampling are its trees. Bootstrap weights (Poisson), row shares
and the columns of a node are hash draws of row, tree and node, so partitioning changes no forest.

Histograms of forests are added and split by tree, in tasks; the driver holds the trees. Those of boosted trees have
a few thousand numbers a fit. Margins of boosted rows stay with the blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.operators import many
from tenura.sources.files import scratch

BLOCK_ROWS = 50_000
LEAST_SAMPLE = 10_000  # Spark's: rows whose values give the borders of bins, or all rows where there are fewer
SHORT_LINEAGE = 50  # rounds of boosting between two writings of the blocks
FEW_PARTITIONS = 64  # more are added up in two steps
NOWHERE = 255  # border of a leaf: every row stays left
MOST_BINS, DEEPEST = 127, 20  # a bin and a class fit a byte; a tree is kept complete
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Fit:
    """What a Spark estimator asks for."""

    part: many.Part
    boosted: bool
    trees: int
    depth: int
    least: int
    columns: int
    step: float
    share: float
    bins: int
    gain: float
    seed: int

    @property
    def nodes(self) -> int:
        return self.trees << (self.depth + 1)


def asked(part: many.Part, estimator, slots: int) -> Fit:
    boosted = isinstance(estimator, GBTClassifier)
    trees = estimator.getMaxIter() if boosted else estimator.getNumTrees()
    if not 1 <= estimator.getMaxDepth() <= DEEPEST or estimator.getMaxBins() > MOST_BINS:
        raise ValueError(f"trees have 1 to {DEEPEST} levels and {MOST_BINS} bins at most")
    columns = _columns(estimator.getFeatureSubsetStrategy(), slots, 1 if boosted else trees)
    return Fit(
        part, boosted, trees, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), columns, estimator.getStepSize() if boosted else 1.0,
        estimator.getSubsamplingRate(), estimator.getMaxBins(), estimator.getMinInfoGain(), estimator.getSeed(),
    )


def _columns(strategy: str, slots: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": slots, "sqrt": math.ceil(math.sqrt(slots)), "log2": max(1, math.ceil(math.log2(slots))), "onethird": math.ceil(slots / 3)}
    if strategy in named:
        return named[strategy]
    return min(slots, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * slots)


# ---- draws -----------------------------------------------------------------------------------------
def _mixed(*numbers: int) -> int:
    out = 0x9E3779B97F4A7C15
    for x in numbers:
        out = ((out ^ (x & _MASK)) * 0xBF58476D1CE4E5B9) & _MASK
        out = ((out ^ (out >> 31)) * 0x94D049BB133111EB) & _MASK
        out ^= out >> 29
    return out


def _hashed(values: np.ndarray, *numbers: int) -> np.ndarray:
    z = (values ^ np.uint64(_mixed(*numbers))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def _poisson_table() -> np.ndarray:
    """Poisson(1) counts by the first 16 bits of a draw."""
    cumulated = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cumulated, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


POISSON = _poisson_table()


def _times(hashes: np.ndarray, fit: Fit, tree: int) -> np.ndarray:
    """How often each row is in a forest's tree; for a share of rows, 0 or 1."""
    z = _hashed(hashes, fit.seed, tree)
    if fit.boosted:
        return ((z >> np.uint64(11)).astype(np.float64) * 2.0**-53 < fit.share).astype(np.uint8)
    return POISSON[z >> np.uint64(48)]


def _subsets(fit: Fit, slots: int, tree: int, nodes: np.ndarray) -> np.ndarray:
    """(nodes, columns) slots that each node may split by; all in their order where none is left out."""
    if fit.columns >= slots:
        return np.tile(np.arange(slots), (len(nodes), 1))
    u = _hashed((nodes[:, None] * slots + np.arange(slots)).astype(np.uint64), fit.seed, tree, 1)
    return np.argsort(u, axis=1, kind="stable")[:, : fit.columns]


# ---- binned rows -----------------------------------------------------------------------------------
def borders(values: np.ndarray, most: int) -> np.ndarray:
    """Spark's borders between bins of a continuous column: midpoints, at most `most`, about equal counts between."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride = len(values) / (most + 1)
    out, current, target = [], int(counts[0]), stride
    for i in range(1, len(distinct)):
        before, current = current, current + int(counts[i])
        if abs(before - target) < abs(current - target):
            out.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(out)


def _row_hash(encoded: many.Encoded):
    return F.xxhash64("key", "y", "x", "codes", *encoded.folds)


def _matrix(x: np.ndarray, codes: np.ndarray, scale: many.Scale, encoded: many.Encoded) -> np.ndarray:
    """(rows, slots): medians for missing numbers, then a 0/1 slot for each label."""
    ends = [*encoded.starts, encoded.slots][1:]
    hot = [codes[:, [j]] == np.arange(b - a) for j, (a, b) in enumerate(zip(encoded.starts, ends, strict=True))]
    return np.hstack([np.where(np.isnan(x), scale.median, x), *hot]).astype(np.float64)


def _borders(encoded: many.Encoded, scaled: dict[many.Part, many.Scale], fits: Sequence[Fit]) -> dict[tuple[many.Part, int], list[np.ndarray]]:
    """Borders of every slot for each training part and number of bins; one pass collects the rows that give them."""
    wanted = list(dict.fromkeys((f.part, f.bins) for f in fits))
    share = {w: max(w[1] * w[1], LEAST_SAMPLE) / max(scaled[w[0]].n, 1.0) for w in wanted}
    u = F.shiftrightunsigned(F.xxhash64(F.lit(fits[0].seed), _row_hash(encoded)), 11) * 2.0**-53
    sample = encoded.rows.withColumn("u", u).where(F.col("u") < max(share.values()))
    table = sample.select("u", *encoded.folds, "x", "codes").toArrow()
    n = table.num_rows
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(n, len(encoded.numeric))
    codes, drawn = np.array(table.column("codes").to_pylist(), np.int32).reshape(n, len(encoded.starts)), table.column("u").to_numpy()
    folds = {c: table.column(c).to_numpy() for c in encoded.folds}
    out = {}
    for part, bins in wanted:
        rows = many._inside(part, folds, n) & (drawn < share[part, bins])
        values = _matrix(x[rows], codes[rows], scaled[part], encoded)
        most = int(min(bins, max(scaled[part].n, 1.0))) - 1
        out[part, bins] = [borders(values[:, j], most) for j in range(values.shape[1])]
    return out


def _binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _blocks(encoded: many.Encoded, scaled: dict, cuts: dict, tasks: int, drawn: bool) -> RDD:
    """Blocks of training rows, kept: for each training part hashes if rows are drawn, classes, bins (rows, slots) and
    numbers of labels (0 unknown)."""
    light = many._light(encoded)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK_ROWS - n)
                held, n, at = [*held, piece], n + piece.num_rows, at + piece.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(pieces):
        batch = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        x, codes, y, folds = many._arrays(batch, light)
        hashes = batch.column("h").to_numpy().astype(np.int64).view(np.uint64)
        out = {}
        for part, bins in cuts:
            inside = many._inside(part, folds, len(x))
            values = _matrix(x[inside], codes[inside], scaled[part], light)
            own = hashes[inside] if drawn else None
            out[part, bins] = (own, (y[inside] > 0).astype(np.uint8), _binned(values, cuts[part, bins]), codes[inside].astype(np.int16) + 1)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out, 5)], pa.binary())], ["block"])

    rows = encoded.rows.withColumn("h", _row_hash(encoded)).coalesce(tasks)
    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


# ---- trees -------------------------------------------------------------------------------------------
class Trees:
    """Complete trees in heap order (root 1): slot and border number of each node, and what its rows say."""

    def __init__(self, fit: Fit):
        self.fit = fit
        size = 2 << fit.depth
        self.slot = np.zeros((fit.trees, size), np.int16)
        self.cut = np.full((fit.trees, size), NOWHERE, np.uint8)
        self.value = np.zeros((fit.trees, size))
        self.empty = 0  # trees without rows

    def spread(self, tree: int) -> None:
        """Below a leaf, its value everywhere."""
        for level in range(self.fit.depth):
            at = np.arange(1 << level, 2 << level)
            leaf = at[self.cut[tree, at] == NOWHERE]
            self.value[tree, 2 * leaf] = self.value[tree, 2 * leaf + 1] = self.value[tree, leaf]


def _walk(flat: np.ndarray, at: np.ndarray, slot: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Heap places, after some levels, of rows that begin at places `at` of the flat bins."""
    node = np.ones(len(at), np.int64)
    for level in range(levels):
        right = flat.take(at + slot[1] if level == 0 else at + slot.take(node)) > cut.take(node)
        node += node
        node += right
    return node


def _best(gain: np.ndarray, subsets: np.ndarray, splits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of the column in its subset, border) of the first largest gain of each node; place -1 for a leaf."""
    n, k, bins = gain.shape
    gain = np.where(np.arange(bins) < splits[subsets][:, :, None], gain, -np.inf).reshape(n, -1)
    top = gain.argmax(axis=1)
    found = gain[np.arange(n), top]
    return np.where((found > 0) & (found >= least), top, -1), top // bins, top % bins


# ---- forests ----------------------------------------------------------------------------------------
def _packed(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts that are not 0: gaps between their places, in the narrowest type."""
    at = np.flatnonzero(h)
    gaps, counts = np.diff(at, prepend=0), h[at]
    narrow = lambda v: v.astype(np.min_scalar_type(int(v.max())) if len(v) else np.uint8)
    return len(h), narrow(gaps), narrow(counts)


def _forest_level(blocks: RDD, plans: dict, level: int, cuts: dict, spark) -> list:
    """Splits of one level: (fit, tree, slots, borders, counts here, on the left); histograms are added by tree."""
    sent = spark.sparkContext.broadcast(plans)
    count = {key: np.array([len(c) for c in own]) for key, own in cuts.items()}

    def partial(some):
        for block in some:
            for f, (fit, trees) in sent.value.items():
                hashes, y, bins, _ = block[fit.part, fit.bins]
                slots, width = bins.shape[1], int(count[fit.part, fit.bins].max(initial=0)) + 1
                flat = (2 * bins + y[:, None]).ravel()  # a bin and a class in one number
                for t, (slot, cut, place, subsets) in trees.items():
                    times = _times(hashes, fit, t)
                    rows = np.flatnonzero(times)
                    node = place.take(_walk(flat, rows * slots, slot, 2 * cut.astype(np.int16) + 1, level) - (1 << level))
                    live = node >= 0
                    if not live.all():
                        rows, node = rows[live], node[live]
                    if not len(rows):
                        continue
                    at, cell = rows * slots, node * (2 * width)
                    weight, size = times.take(rows).astype(np.float64), len(subsets) * 2 * width
                    own = [column[0] if len(subsets) == 1 else column.take(node) for column in np.ascontiguousarray(subsets.T)]
                    h = [np.bincount(cell + flat.take(at + column), weight, size) for column in own]
                    yield (f, t), _packed(np.concatenate(h).astype(np.int64))

    def split(pairs):
        sums: dict = {}
        for key, (size, gaps, counts) in pairs:
            total = sums.setdefault(key, np.zeros(size))
            total[np.cumsum(gaps, dtype=np.int64)] += counts
        for (f, t), total in sums.items():
            fit, trees = sent.value[f]
            subsets = trees[t][3]
            own = count[fit.part, fit.bins]
            left = total.reshape(fit.columns, len(subsets), -1, 2).transpose(1, 0, 2, 3).cumsum(axis=2)
            whole = left[:, :1, -1:]
            right = whole - left
            nl, nr, n = left.sum(-1), right.sum(-1), whole.sum(-1)
            with np.errstate(divide="ignore", invalid="ignore"):
                impure = lambda c, m: 1.0 - ((c / m[..., None]) ** 2).sum(-1)
                gain = impure(whole, n) - nl / n * impure(left, nl) - nr / n * impure(right, nr)
            gain = np.where((nl >= max(fit.least, 1)) & (nr >= max(fit.least, 1)), gain, -np.inf)
            place, j, border = _best(gain, subsets, own, fit.gain)
            who = np.arange(len(subsets))
            yield f, t, np.where(place < 0, -1, subsets[who, j]), border, whole[:, 0, 0], left[who, j, border]

    parts = blocks.getNumPartitions()
    keyed = blocks.mapPartitions(partial).partitionBy(max(parts, spark.sparkContext.defaultParallelism), lambda key: key[0] * 1_000_003 + key[1])
    found = keyed.mapPartitions(split).collect()
    sent.unpersist()
    return found


def _forests(blocks: RDD, fits: Sequence[Fit], cuts: dict, slots: int, spark) -> list[Trees]:
    out = [Trees(fit) for fit in fits]
    counts = [np.zeros((*trees.value.shape, 2)) for trees in out]
    active = {(f, t): np.array([1]) for f, fit in enumerate(fits) for t in range(fit.trees)}
    for level in range(max(fit.depth for fit in fits)):
        plans: dict = {}
        for (f, t), nodes in active.items():
            place = np.full(1 << level, -1, np.int64)
            place[nodes - (1 << level)] = np.arange(len(nodes))
            trees = out[f]
            plan = (trees.slot[t, : 1 << level], trees.cut[t, : 1 << level], place, _subsets(fits[f], slots, t, nodes))
            plans.setdefault(f, (fits[f], {}))[1][t] = plan
        if not plans:
            break
        left_over, active = active, {}
        for f, t, slot, border, here, left in _forest_level(blocks, plans, level, cuts, spark):
            nodes, trees, own = left_over[f, t], out[f], counts[f][t]
            own[nodes] = here
            inner = slot >= 0
            split = nodes[inner]
            trees.slot[t, split], trees.cut[t, split] = slot[inner], border[inner]
            own[2 * split], own[2 * split + 1] = left[inner], here[inner] - left[inner]
            if level + 1 < fits[f].depth:
                below = np.sort(np.concatenate([2 * split, 2 * split + 1]))
                below = below[own[below].min(axis=1) > 0]  # one class: a leaf
                if len(below):
                    active[f, t] = below
    for trees, own in zip(out, counts, strict=True):
        _merge_alike(trees, own)
        n = own.sum(-1)
        trees.value = np.divide(own[:, :, 1], n, out=np.zeros_like(n), where=n > 0)
        trees.empty = int((n[:, 1] == 0).sum())
        for t in range(trees.fit.trees):
            trees.spread(t)
    return out


def _merge_alike(trees: Trees, counts: np.ndarray) -> None:
    """As Spark does: two leaves that predict the same class become one."""
    says = counts[:, :, 1] > counts[:, :, 0]
    for level in range(trees.fit.depth - 1, -1, -1):
        at = np.arange(1 << level, 2 << level)
        leaf = lambda nodes: (trees.cut[:, nodes] == NOWHERE)
        same = ~leaf(at) & leaf(2 * at) & leaf(2 * at + 1) & (says[:, 2 * at] == says[:, 2 * at + 1])
        trees.cut[:, at] = np.where(same, NOWHERE, trees.cut[:, at])


# ---- boosted trees ------------------------------------------------------------------------------------
def _added(sums: RDD) -> np.ndarray:
    add = lambda a, b: a + b
    return sums.reduce(add) if sums.getNumPartitions() <= FEW_PARTITIONS else sums.treeReduce(add)


def _boosted(blocks: RDD, fits: Sequence[Fit], cuts: dict, light: many.Encoded, spark) -> list[Trees]:
    """All fits go round by round; a block keeps the margin of each fit's rows.

    Of two children the smaller one's rows are added up; the other has the rest of its parent.
    """
    out, slots = [Trees(fit) for fit in fits], light.slots
    splits = [np.array([len(c) for c in cuts[fit.part, fit.bins]]) for fit in fits]
    widths = [max(int(s.max(initial=0)) + 1, 2) for s in splits]
    ends = [*light.starts, slots][1:]

    def begun(block):
        return block, [np.zeros(len(block[fit.part, fit.bins][1])) for fit in fits]

    def moved(last, step):
        def run(state):
            block, margins = state
            new = []
            for f, (fit, margin) in enumerate(zip(fits, margins, strict=True)):
                if f in last:
                    bins = block[fit.part, fit.bins][2]
                    slot, cut, value = last[f]
                    margin = margin + step[f] * value.take(_walk(bins.ravel(), np.arange(len(bins)) * slots, slot, cut, fit.depth))
                new.append(margin)
            return block, new

        return run

    def sums_of(number, level, plans):
        def run(states):
            total = {f: np.zeros((3, plan[3], slots, widths[f])) for f, plan in plans.items()}
            for block, margins in states:
                for f, (slot, cut, place, n) in plans.items():
                    fit, width = fits[f], widths[f]
                    hashes, y, bins, codes = block[fit.part, fit.bins]
                    rows, margin = np.arange(len(y)), margins[f]
                    node = place.take(_walk(bins.ravel(), rows * slots, slot, cut, level) - (1 << level))
                    live = node >= 0
                    if fit.share < 1.0:
                        live &= _times(hashes, fit, number) > 0
                    if not live.all():
                        rows = np.flatnonzero(live)
                        node, y, margin, bins, codes = (v.take(rows, axis=0) for v in (node, y, margin, bins, codes))
                    sign = 2.0 * y - 1.0
                    target = sign if number == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
                    for k, weight in enumerate((None, target)):
                        own = total[f][k]
                        for j in range(len(light.numeric)):
                            own[:, j] += np.bincount(node * width + bins[:, j], weight, n * width).reshape(n, width)
                        for c, (start, end) in enumerate(zip(light.starts, ends, strict=True)):
                            size = end - start + 1
                            of = np.bincount(node * size + codes[:, c], weight, n * size).reshape(n, size)
                            own[:, start:end, 1] += of[:, 1:]
                            own[:, start:end, 0] += of.sum(axis=1, keepdims=True) - of[:, 1:]
                    total[f][2, :, 0, 0] += np.bincount(node, target * target, n)  # of the node; no split depends on a bin's own
            yield np.concatenate([total[f].ravel() for f in plans])

        return run

    state = blocks.map(begun)
    last: dict = {}
    for number in range(max(fit.trees for fit in fits)):
        going = [f for f, fit in enumerate(fits) if number < fit.trees]
        before = state
        if number:
            state = state.map(moved(last, {f: 1.0 if number == 1 else fits[f].step for f in last}))
            if number % SHORT_LINEAGE == 0:
                path = scratch(spark, "margins")
                state.saveAsPickleFile(path, 1)
                state = spark.sparkContext.pickleFile(path)
            state.persist(StorageLevel.MEMORY_AND_DISK)
        active = {f: np.array([1]) for f in going}
        above: dict = {f: {} for f in going}
        for level in range(max(fits[f].depth for f in going)):
            plans, wanted = {}, {}
            for f, nodes in active.items():
                sums = above[f]
                small = [v for v in nodes if v == 1 or sums[v] < sums[v ^ 1] or (sums[v] == sums[v ^ 1] and v % 2 == 0)]
                place = np.full(1 << level, -1, np.int64)
                place[np.array(small) - (1 << level)] = np.arange(len(small))
                wanted[f] = small
                plans[f] = (out[f].slot[number, : 1 << level], out[f].cut[number, : 1 << level], place, len(small))
            if not plans:
                break
            found, at = _added(state.mapPartitions(sums_of(number, level, plans))), 0
            if level == 0 and before.is_cached:
                before.unpersist()
            nodes_of, active = active, {}
            for f, small in wanted.items():
                fit, nodes = fits[f], nodes_of[f]
                size = 3 * len(small) * slots * widths[f]
                sums = found[at : at + size].reshape(3, len(small), slots, widths[f])
                at += size
                given = {v: sums[:, i] for i, v in enumerate(small)}
                parents = above[f].get("sums", {})
                whole = {v: given[v] if v in given else parents[v >> 1] - given[v ^ 1] for v in nodes.tolist()}
                below, counts = _boosted_level(out[f], number, nodes, np.stack(list(whole.values()), axis=1), _subsets(fit, slots, number, nodes), splits[f])
                if level + 1 < fit.depth and len(below):
                    active[f], above[f] = below, counts | {"sums": whole}
        for f in going:
            out[f].spread(number)
        last = {f: (out[f].slot[number], out[f].cut[number], out[f].value[number]) for f in going}
    if state.is_cached:
        state.unpersist()
    return out


def _boosted_level(trees: Trees, number: int, nodes: np.ndarray, sums: np.ndarray, subsets: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, dict]:
    """Splits these nodes by largest gain in variance, or leaves them; gives their children and rows of each."""
    fit, who = trees.fit, np.arange(len(nodes))
    left_n, left_s = (s[who[:, None], subsets].cumsum(axis=2) for s in sums[:2])
    n, s = left_n[:, :1, -1:], sums[1, :, 0].sum(axis=-1)[:, None, None]
    square = sums[2, :, 0, 0]
    right_n, right_s = n - left_n, s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_s * left_s / left_n + right_s * right_s / right_n - s * s / n) / n
        mean = np.where(n > 0, s / n, 0.0)[:, 0, 0]
        spread = np.where(n[:, 0, 0] > 0, square / n[:, 0, 0] - mean * mean, 0.0)
    least = max(fit.least, 1)
    # a gain below the rounding of its terms is none
    gain = np.where((left_n >= least) & (right_n >= least) & (gain > 1e-15 * np.abs(spread)[:, None, None]), gain, -np.inf)
    place, j, border = _best(gain, subsets, splits, fit.gain)
    trees.value[number, nodes] = mean
    inner = place >= 0
    split = nodes[inner]
    trees.slot[number, split], trees.cut[number, split] = subsets[who, j][inner], border[inner]
    pick = lambda v: v[who, j, border][inner]
    trees.value[number, 2 * split], trees.value[number, 2 * split + 1] = pick(left_s) / pick(left_n), pick(right_s) / pick(right_n)
    counts = {**dict(zip((2 * split).tolist(), pick(left_n), strict=True)), **dict(zip((2 * split + 1).tolist(), pick(right_n), strict=True))}
    return np.sort(np.concatenate([2 * split, 2 * split + 1])), counts


# ---- together ----------------------------------------------------------------------------------------
def scores(encoded: many.Encoded, names: Sequence[str], fits: Sequence[Fit], rows_per_task: int) -> DataFrame:
    """(modele, repetition, pli, key, y, p) of the rows that each fit's training part leaves out, from fits of one kind."""
    spark, light = encoded.rows.sparkSession, many._light(encoded)
    scaled = many.scales(encoded, list(dict.fromkeys(f.part for f in fits)))
    cuts = _borders(encoded, scaled, fits)
    tasks = max(1, math.ceil(max(scaled[f.part].n for f in fits) / rows_per_task))
    blocks = _blocks(encoded, scaled, cuts, tasks, any(not f.boosted or f.share < 1.0 for f in fits))
    grown = _boosted(blocks, fits, cuts, light, spark) if fits[0].boosted else _forests(blocks, fits, cuts, light.slots, spark)
    blocks.unpersist()
    sent = spark.sparkContext.broadcast(grown)
    kinds = dict(encoded.rows.dtypes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            x, codes, y, folds = many._arrays(whole, light)
            held = {}
            for name, trees in zip(names, sent.value, strict=True):
                part, bins = trees.fit.part, trees.fit.bins
                if (part, bins) not in held:
                    out = np.flatnonzero(~many._inside(part, folds, len(x)))
                    held = {(part, bins): (out, _binned(_matrix(x[out], codes[out], scaled[part], light), cuts[part, bins]).ravel())}
                out, flat = held[part, bins]
                n = len(out)
                if not n:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n), pa.array(np.full(n, light.folds.index(part.fold), np.int32)),
                        pa.array(np.full(n, part.value, np.int32)), whole.column("key").take(pa.array(out)), pa.array(y[out].astype(np.int32)),
                        pa.array(_probability(trees, flat, np.arange(n) * light.slots)),
                    ],
                    ["modele", "repetition", "pli", "key", "y", "p"],
                )

    return encoded.rows.coalesce(tasks).mapInArrow(run, f"modele string, repetition int, pli int, key {kinds['key']}, y int, p double")


def _probability(trees: Trees, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    fit, total = trees.fit, np.zeros(len(at))
    for t in range(fit.trees):
        said = trees.value[t].take(_walk(flat, at, trees.slot[t], trees.cut[t], fit.depth))
        total += said if not fit.boosted or t == 0 else fit.step * said
    if fit.boosted:
        return 1.0 - 1.0 / (1.0 + np.exp(2.0 * total))
    return total / max(fit.trees - trees.empty, 1)
