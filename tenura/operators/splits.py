"""Stratified splits and folds, decided by a keyed order and never by partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions import maths
from tenura.operators.ordering import quantile_row, row_ranks
from tenura.sources.files import materialise


def _positions(
    df: DataFrame, stratum: str, key: str, order: Column
) -> DataFrame:
    """Adds _rank (1.. within the stratum) and _size."""
    ranked = row_ranks(
        df.withColumn("_order", order), ["_order", key], "_rank", [stratum]
    )
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    return ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s", "_order")


def stratified_split(
    df: DataFrame,
    target: str,
    key: str,
    fraction: float = 0.8,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Adds `part`: train or test, with exact shares in every class."""
    placed = _positions(
        df, target, key, maths.uniform(F.col(key), seed) if order is None else order
    )
    inside = F.col("_rank") <= F.bround(fraction * F.col("_size"))
    return placed.withColumn("part", F.when(inside, "train").otherwise("test")).drop("_rank", "_size")


def quartile_stratified_split(
    df: DataFrame,
    target: str,
    key: str,
    fraction: float = 0.8,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """The same inside each quartile of a numeric target."""
    edges = quantile_row(df, target, [0.25, 0.5, 0.75])
    stratum = F.size(F.filter("q", lambda e: e < F.col(target)))
    placed = df.crossJoin(edges).withColumn("strate", stratum).drop("q")
    return stratified_split(placed, "strate", key, fraction, seed, order)


def repeated_stratified_folds(
    df: DataFrame,
    target: str,
    key: str,
    folds: int = 5,
    repeats: int = 1,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Adds pli_0..pli_{repeats-1}: position in a keyed order, modulo the number of folds.

    Rows are written between repetitions: ranking reads them several times, so one plan of all repetitions would
    read `df` a number of times that multiplies with each.
    """
    out = df
    for r in range(repeats):
        if r:
            out = materialise(out, "repetition")
        draw = maths.uniform(F.col(key), seed + r) if order is None else (order * (r + 1)) % 10007
        placed = _positions(out, target, key, draw)
        out = placed.withColumn(f"pli_{r}", ((F.col("_rank") - 1) % folds).cast("int")).drop(
            "_rank", "_size"
        )
    return out
