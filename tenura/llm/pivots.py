"""Embedding near-duplicates with a pivot-permutation index.

A bounded sample of the vectors gives `PIVOTS` reference points. Each vector is described by its
nearest pivots in order (`PREFIX` of them); vectors within 18 degrees of each other have much of that
prefix in common. Inverted lists are kept for every set of `SHARED` pivots of a prefix, so two vectors
meet in a list if their prefixes share that many pivots; a pair is taken only in the first list that
both are in, hence once. Pairs that meet are verified by their cosine in double precision.

Lists may be as long as the table (copies, tight groups): a list of more than `BLOCK` vectors is cut
into blocks, and each pair of blocks is a cell of its own, so no cell grows with the data. Equal vectors
are one entry with a count before any list is made. A group returns link counts by vector and a
spanning forest, not its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and neither do vectors of different lengths; rows with one id are separate vectors of which
n_links counts each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.components import components
from tenura.llm.simhash import Forest
from tenura.llm.storage import materialise

SAMPLE = 4_096
PIVOTS = 64
PREFIX = 5
SHARED = 3
BLOCK = 512
GROUP_ROWS = 8_192  # entries of many short lists that are verified together
THRESHOLD = 0.95


def matrix(column) -> np.ndarray:
    """The vectors of a list column without nulls as rows of doubles."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that nothing overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def chosen_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the vector least alike to those taken."""
    if not len(sample):
        return sample
    taken = [0]
    nearest = sample @ sample[0]
    while len(taken) < min(count, len(sample)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[taken[-1]])
    return sample[taken]


def prefixes(rows: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first."""
    alike = rows @ pivots.T
    length = min(length, alike.shape[1])
    part = np.argpartition(-alike, length - 1, axis=1)[:, :length]
    order = np.take_along_axis(-alike, part, 1).argsort(1, kind="stable")
    return np.take_along_axis(part, order, 1)


def usable(key: Column, v: Column) -> Column:
    """Whether a row can link at all."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(key.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def lists_of(prefix: Column) -> Column:
    """All sets of `SHARED` pivots of a prefix, as sorted arrays."""
    ordered, out = F.array_sort(prefix), None
    for m in range(SHARED, PREFIX + 1):
        sets = F.array(*(F.array(*(F.element_at(ordered, i + 1) for i in c)) for c in combinations(range(m), SHARED)))
        out = F.when(F.size(prefix) == m, sets) if out is None else out.when(F.size(prefix) == m, sets)
    return out


def list_pairs(threshold: float, shared: int):
    """Verify the pairs of a group of cells; a cell is one list or two blocks of a long one."""

    def run(key, table):
        cell, block, left, right, node, times = (table.column(c).to_numpy() for c in ("cell", "block", "left", "right", "node", "times"))
        v = unit(matrix(table.column("v")))
        prefix, lists = (matrix(table.column(c)).astype(np.int64) for c in ("prefix", "list"))
        names, entry = np.unique(node, return_inverse=True)  # a vector may be in several cells
        links, forest = np.zeros(len(names), np.int64), Forest(len(names))
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=~cell[order][:1], append=~cell[order][-1:]))
        for s, e in zip(edges[:-1], edges[1:]):
            own = order[s:e]
            one = left[own[0]] == right[own[0]]
            a = own[block[own] == left[own]]
            b = own[block[own] == right[own]]
            if not len(a) or not len(b) or (one and len(a) < 2):
                continue
            i, j = np.nonzero(v[a] @ v[b].T >= threshold)
            i, j = a[i], b[j]
            if one:
                i, j = i[node[i] < node[j]], j[node[i] < node[j]]
            # the first list of a pair is that of the lowest pivots that both have
            both = np.where((prefix[i][:, :, None] == prefix[j][:, None, :]).any(2), prefix[i], np.iinfo(np.int64).max)
            first = (np.sort(both, 1)[:, :shared] == lists[i]).all(1) & (lists[i] == lists[j]).all(1)
            i, j = i[first], j[first]
            np.add.at(links, entry[i], times[j])
            np.add.at(links, entry[j], times[i])
            forest.join(entry[i], entry[j])
        some = np.flatnonzero(links)
        return pa.table({"node": names[some], "n": links[some], "root": names[forest.root[some]]})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    fine = usable(F.col("id"), F.col("v"))
    sized = rows.where(fine).withColumn("d", F.size("v"))
    equal = sized.groupBy("d", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("times"))
    nodes = materialise(equal, "pivots")
    n = nodes.count()
    keep = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < ((1 << 30) if n <= SAMPLE else (1 << 30) * SAMPLE // n)
    seen: dict[int, list] = {}
    for r in nodes.where(keep).select("d", "v").orderBy(F.xxhash64("v"), "v").limit(2 * SAMPLE).collect():
        seen.setdefault(r.d, []).append(r.v)
    pivots = {d: chosen_pivots(unit(np.array(v, float)), PIVOTS) for d, v in seen.items()}
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("d").to_numpy()
            prefix: list = [[]] * len(size)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                known = shared_pivots.value.get(int(d), shared_pivots.value[min(shared_pivots.value)])
                if known.shape[1] == d and len(known) >= SHARED:
                    found = prefixes(unit(matrix(batch.column("v").take(pa.array(at)))), known, PREFIX)
                else:  # a length that the sample missed, or too few pivots: one list for all
                    found = np.tile(np.arange(SHARED), (len(at), 1))
                for i, p in zip(at, found.tolist()):
                    prefix[i] = p
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "v", "node", "times")), pa.array(prefix, pa.list_(pa.int32()))], ["d", "v", "node", "times", "prefix"])

    kind = dict(nodes.dtypes)["v"]
    described = materialise(nodes.select("d", "v", "node", "times").mapInArrow(describe, f"d int, v {kind}, node long, times long, prefix array<int>"), "pivots-prefix")
    posted = described.select("node", "times", "v", "prefix", "d", F.explode(lists_of(F.col("prefix"))).alias("list"))
    long = described.select("d", F.explode(lists_of(F.col("prefix"))).alias("list")).groupBy("d", "list").count().where(F.col("count") > 1)
    long = materialise(long, "pivots-lists")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = posted.join(long.select("d", "list", blocks.alias("blocks")), ["d", "list"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("left"), F.greatest(own, k).alias("right")))
    dealt = dealt.withColumn("block", own).withColumn("pair", F.explode(met)).select("list", "pair.left", "pair.right", "d", "block", "node", "times", "v", "prefix")
    entries = long.agg(F.sum(F.col("count") * blocks)).first()[0] or 0
    cell = F.xxhash64("list", "left", "right")
    group = F.pmod(cell, F.lit(1 + entries // GROUP_ROWS))
    dealt = dealt.withColumn("cell", cell).withColumn("group", group)
    found = dealt.groupBy("d", "group").applyInArrow(list_pairs(threshold, SHARED), "node long, n long, root long")
    found = materialise(found, "pivots-links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.where("node <> root"), "node", "root")
    per_node = nodes.select("d", "v", "node", "times").join(counted, "node", "left").join(groups, "node", "left")
    per_vector = per_node.select("d", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = sized.join(per_vector, ["d", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
