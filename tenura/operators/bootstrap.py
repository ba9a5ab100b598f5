"""Bootstrap intervals of classifier metrics without a row for each row and draw.

Every row gets a Poisson(1) weight in each draw, from a hash of its seed and the draw's number, so neither partitioning nor a
lost executor changes it. Rows are cut into slices by decreasing score. A task goes through its slice in blocks of rows x
draws and keeps one number a draw: sums of weights, squared errors and hits. Areas also need the weights of all higher scores:
these are running sums over slices, one array of draws each, and a second pass adds the areas inside the slices. Equal
scores count as one step of the curve; the first and the last score of a slice may go on in another one, so their
sums are kept apart and added up by score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.operators.metrics import metrics_at
from tenura.operators.ordering import sliced

METRICS = ["pr_auc", "roc_auc", "brier", "rappel", "precision", "part_signalee"]
BLOCK = 1 << 20  # weights held at once


def _poisson() -> np.ndarray:
    """P(weight < 1), P(weight < 2), ... of a Poisson(1) weight."""
    out, term, total = [], float(np.exp(-1.0)), 0.0
    for k in range(1, 12):
        total += term
        out.append(total)
        term /= k
    return np.array(out)


POISSON = _poisson()


def hashed(seeds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Uniform numbers of each seed and draw, from mixed bits."""
    x = seeds.astype(np.uint64) + draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def portable(seeds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Uniform numbers of small seeds that plain integer arithmetic can repeat elsewhere."""
    return ((seeds * 7919 + draws * 104729 + (seeds % 89 + 1) * (draws % 97 + 1) * 31) % 100003) / 100003.0


Uniform = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _blocks(seeds: np.ndarray, draws: int, uniform: Uniform, block: int):
    """(from, to, weights) over blocks of rows."""
    numbers = np.arange(1, draws + 1, dtype=np.int64)[None, :]
    step = max(1, block // draws)
    for a in range(0, len(seeds), step):
        u = uniform(seeds[a : a + step, None], numbers)
        yield a, min(len(seeds), a + step), np.searchsorted(POISSON, u.ravel(), side="right").reshape(u.shape).astype(np.int64)


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (decreasing), labels and seeds of a slice."""
    p, y, seed = (table.column(c).to_numpy() for c in ("p", "y", "seed"))
    order = np.argsort(-p, kind="stable")
    return p[order], y[order], seed[order]


SUMS = "slice int, part int, score double, n array<long>, pos array<long>, sq array<double>, tp array<long>, fp array<long>"


def _sums(draws: int, threshold: float, uniform: Uniform, block: int):
    """Sums of a slice's first score (part 0), of what lies between (part 1) and of its last score (part 2)."""

    def run(key, table):
        p, y, seed = _ordered(table)
        first, last = p == p[0], (p == p[-1]) & (p[-1] < p[0])
        parts = [first, ~first & ~last, last]
        kept = [{name: np.zeros(draws, np.float64 if name == "sq" else np.int64) for name in ("n", "pos", "sq", "tp", "fp")} for _ in parts]
        for a, b, w in _blocks(seed, draws, uniform, block):
            t, gap, flagged = y[a:b], (y[a:b] - p[a:b]) ** 2, p[a:b] >= threshold
            for own, sums in zip(parts, kept):
                rows = np.flatnonzero(own[a:b])
                if len(rows):
                    wr = w[rows]
                    sums["n"] += wr.sum(axis=0)
                    sums["pos"] += t[rows] @ wr
                    sums["sq"] += gap[rows] @ wr
                    sums["tp"] += (t[rows] * flagged[rows]) @ wr
                    sums["fp"] += ((1 - t[rows]) * flagged[rows]) @ wr
        out = [{"slice": key[0].as_py(), "part": i, "score": float(p[-1] if i == 2 else p[0]), **s} for i, (own, s) in enumerate(zip(parts, kept)) if own.any()]
        kinds = [("slice", pa.int32()), ("part", pa.int32()), ("score", pa.float64()), *((c, pa.list_(pa.float64() if c == "sq" else pa.int64())) for c in ("n", "pos", "sq", "tp", "fp"))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


def _areas(draws: int, uniform: Uniform, block: int):
    """The areas' sums over the scores between the first and the last of a slice."""

    def run(key, table, before):
        roc, pr = np.zeros(draws), np.zeros(draws)
        if table.num_rows and before.num_rows:
            p, y, seed = _ordered(table)
            inner = (p < p[0]) & (p > p[-1])
            p, y, seed = p[inner], y[inner], seed[inner]
            n, pos = (np.array(before.column(c)[0].as_py(), np.int64) for c in ("n_before", "pos_before"))
            held_n, held_pos = np.zeros(draws, np.int64), np.zeros(draws, np.int64)  # of a score that the block cuts
            for a, b, w in _blocks(seed, draws, uniform, block):
                start = np.flatnonzero(np.diff(p[a:b], prepend=np.nan) != 0)
                gn, gp = np.add.reduceat(w, start, axis=0), np.add.reduceat(w * y[a:b, None], start, axis=0)
                gn[0] += held_n
                gp[0] += held_pos
                whole = len(start) - (b < len(p) and p[b] == p[b - 1])
                held_n, held_pos = (gn[-1], gp[-1]) if whole < len(start) else (np.zeros(draws, np.int64),) * 2
                gn, gp = gn[:whole], gp[:whole]
                upto_n, upto_pos = n + np.cumsum(gn, axis=0), pos + np.cumsum(gp, axis=0)
                roc += ((gn - gp) * (upto_pos - gp / 2.0)).sum(axis=0)
                pr += (gp * np.divide(upto_pos, upto_n, out=np.zeros(upto_n.shape), where=upto_n > 0)).sum(axis=0)
                if whole:
                    n, pos = upto_n[-1], upto_pos[-1]
        return pa.table({"roc": pa.array([roc]), "pr": pa.array([pr])})

    return run


def bootstrap_draws(
    df: DataFrame, threshold: float, seed: Column, score: str = "p", target: str = "y", draws: int = 1000, uniform: Uniform = hashed,
    block: int = BLOCK,
) -> DataFrame:
    """(tirage, metrics) of each draw; `seed` is a whole number that tells rows apart."""
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    rows = sliced(known.select(F.col(score).cast("double").alias("p"), F.col(target).cast("int").alias("y"), seed.cast("long").alias("seed")), ["p", "seed"], ["p"])
    sums = rows.groupBy("_slice").applyInArrow(_sums(draws, threshold, uniform, block), SUMS)
    each = sums.select("slice", "part", "score", F.posexplode(F.arrays_zip("n", "pos", "sq", "tp", "fp")).alias("tirage", "s")).select("slice", "part", "score", "tirage", "s.*")
    # one step for each boundary score and for each interior, which follows its slice's first score
    step = F.when(F.col("part") == 1, 1).otherwise(0).alias("step")
    steps = each.groupBy("tirage", "score", step).agg(
        F.max(F.when(F.col("part") == 1, F.col("slice"))).alias("slice"), *[F.sum(c).alias(c) for c in ("n", "pos", "sq", "tp", "fp")]
    )
    upto = Window.partitionBy("tirage").orderBy(F.desc("score"), "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"n_upto": F.sum("n").over(upto), "pos_upto": F.sum("pos").over(upto)})
    inner = steps.where("step = 1").groupBy("slice").agg(
        *[F.transform(F.sort_array(F.collect_list(F.struct("tirage", (F.col(f"{c}_upto") - F.col(c)).alias("v")))), lambda s: s["v"]).alias(f"{c}_before") for c in ("n", "pos")]
    )  # an array of draws for each slice
    areas = rows.groupBy("_slice").cogroup(inner.groupBy("slice")).applyInArrow(_areas(draws, uniform, block), "roc array<double>, pr array<double>")
    inside = areas.select(F.posexplode(F.arrays_zip("roc", "pr")).alias("tirage", "a")).groupBy("tirage").agg(F.sum("a.roc").alias("_roc"), F.sum("a.pr").alias("_pr"))
    edge = F.col("step") == 0
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    per = steps.groupBy("tirage").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("n", "pos", "sq", "tp", "fp")],
        F.sum(F.when(edge, neg * (F.col("pos_upto") - pos / 2.0))).alias("_roc0"),
        F.sum(F.when(edge, pos * F.coalesce(F.try_divide("pos_upto", "n_upto"), F.lit(0.0)))).alias("_pr0"),
    ).join(inside, "tirage")
    n, pos, tp, fp = (F.col(c) for c in ("n", "pos", "tp", "fp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.where((pos > 0) & (pos < n)).select(
        (F.col("tirage") + 1).alias("tirage"),
        ((F.col("_pr0") + F.col("_pr")) / pos).alias("pr_auc"),
        ((F.col("_roc0") + F.col("_roc")) / (pos * (n - pos))).alias("roc_auc"),
        (F.col("sq") / n).alias("brier"), (tp / pos).alias("rappel"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"), ((tp + fp) / n).alias("part_signalee"),
    )


def bootstrap_metrics(
    df: DataFrame, threshold: float, key: str, score: str = "p", target: str = "y", draws: int = 1000, level: float = 0.95,
    seed: int = 42, seeds: Column | None = None, uniform: Uniform = hashed,
) -> DataFrame:
    """(metrique, valeur, ic_bas, ic_haut): percentile intervals over the draws.

    Poisson weights approximate multinomial resampling. Draws with a single class are left out. `seeds` replaces
    the hash of the key.
    """
    own = F.xxhash64(F.col(key).cast("string"), F.lit(seed)) if seeds is None else seeds
    per = bootstrap_draws(df, threshold, own, score, target, draws, uniform)
    tail = (1 - level) / 2
    spread = per.unpivot(["tirage"], METRICS, "metrique", "v").groupBy("metrique").agg(F.percentile("v", [tail, 1 - tail]).alias("q"))
    point = metrics_at(df, threshold, score, target).select(*METRICS).unpivot([], METRICS, "metrique", "valeur")
    return point.join(spread, "metrique").select("metrique", "valeur", F.col("q")[0].alias("ic_bas"), F.col("q")[1].alias("ic_haut"))
