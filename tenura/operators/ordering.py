"""Ordered computations that never need all rows in one task.

Ranks, running totals and exact quantiles are built from one step: cut the rows into slices of the
order, sum inside each slice, add the totals of earlier slices. The cuts come from one sample (the rows
with the smallest hashes, so it is the same sample under any partitioning, and no count is needed) and
travel as an array column. There is one plan for every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions import sizing

SAMPLED = 32  # rows of the sample for each slice


def _sort(order: Sequence[str], descending: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc() for c in order]


def _reversed(column: str, kind: str) -> list[Column]:
    """Ascending columns with the order of a descending one: nulls last, NaN first, larger first."""
    c = F.col(column)
    if kind in ("double", "float"):
        return [c.isNull(), ~F.isnan(c), -c]
    if kind == "date":
        return [c.isNull(), -F.unix_date(c)]
    if kind.startswith("timestamp"):
        return [c.isNull(), -F.unix_micros(c.cast("timestamp"))]
    if kind == "boolean":
        return [c.isNull(), ~c]
    if kind.startswith("decimal"):
        return [c.isNull(), -c]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return [c.isNull(), -c.cast("decimal(20,0)")]
    raise TypeError(f"{column}: descending order of {kind} is not supported")


def _place(df: DataFrame, order: Sequence[str], descending: Sequence[str]) -> Column:
    """A struct that sorts as the rows do."""
    kinds, fields = dict(df.dtypes), []
    for c in order:
        fields += _reversed(c, kinds[c]) if c in descending else [F.col(c)]
    return F.struct(*[f.alias(f"_{i}") for i, f in enumerate(fields)])


def sliced(df: DataFrame, order: Sequence[str], descending: Sequence[str]) -> DataFrame:
    """Rows with `_slice`, ascending in the order, in as many slices as there are shuffle partitions."""
    slices = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = _place(df, order, descending)
    # The hash is of whole rows: where `df` ends in an exchange, the sample reads that same exchange.
    few = df.select(place.alias("_p"), F.xxhash64(*df.columns).alias("_h")).orderBy("_h").limit(SAMPLED * slices)
    points = few.agg(F.sort_array(F.collect_list("_p")).alias("_a"))
    at = [F.get("_a", F.floor(F.size("_a") * F.lit(i) / slices).cast("int")) for i in range(1, slices)]
    cuts = points.select(F.filter(F.array(*at), lambda p: p.isNotNull()).alias("_cuts")) if at else points.select(F.slice("_a", 1, 0).alias("_cuts"))
    steps = [1 << k for k in reversed(range(max(1, slices.bit_length())))]

    def further(position: Column, step: Column) -> Column:
        reached = F.coalesce(F.get("_cuts", position + step - 1) <= place, F.lit(False))
        return F.when(reached, position + step).otherwise(position)

    number = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)  # binary search
    return df.crossJoin(F.broadcast(cuts)).withColumn("_slice", number).drop("_cuts").repartition("_slice")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    keys: Sequence[str] = (),
    descending: Sequence[str] = (),
    previous: str | None = None,
) -> DataFrame:
    """Add inclusive running totals over `order` within `keys`.

    `order` must be unique within `keys` for a reproducible result. `previous` names a column
    for the preceding value of the (single, ascending) order column.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    cut = sliced(df, [*keys, *order], descending)
    # Both branches below read the one exchange by slice; a recomputed slice number is the same.
    within = Window.partitionBy(*keys, "_slice").orderBy(*_sort(order, descending))
    inside = cut.withColumns({name: F.sum(c).over(within.rowsBetween(*upto)) for name, c in totals.items()})
    if previous is not None:
        inside = inside.withColumn(previous, F.lag(order[0]).over(within))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(upto[0], -1)
    offsets = (
        cut.groupBy(*keys, "_slice")
        .agg(
            *[F.sum(c).alias(f"_sum_{name}") for name, c in totals.items()],
            F.max(order[0]).alias("_max"),
        )
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_slice").alias("_key__slice"),
            *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in totals],
            F.max("_max").over(before).alias("_max_before"),
        )
    )
    on = None
    for k in [*keys, "_slice"]:
        same = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        on = same if on is None else on & same
    shifted = {
        name: F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.col(name) for name in totals
    }
    if previous is None:
        return inside.join(offsets, on).withColumns(shifted).select(*df.columns, *totals)
    shifted[previous] = F.coalesce(previous, "_max_before")
    return inside.join(offsets, on).withColumns(shifted).select(*df.columns, *totals, previous)


def row_ranks(
    df: DataFrame,
    order: Sequence[str],
    name: str = "rang",
    keys: Sequence[str] = (),
    descending: Sequence[str] = (),
) -> DataFrame:
    """Number the rows 1, 2, … in `order` (unique within `keys`)."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, keys, descending)


def top_k(
    df: DataFrame, order: Sequence[str], k: int, descending: Sequence[str] = (), rank: str = "rang"
) -> DataFrame:
    """First k rows with their rank; a bounded top-k, or a distributed ranking for a large k."""
    if k <= sizing.BROADCAST_ROWS:
        ordering = _sort(order, descending)
        best = df.orderBy(*ordering).limit(max(k, 0))
        return best.withColumn(
            rank, F.row_number().over(Window.partitionBy().orderBy(*ordering)).cast("bigint")
        )
    return row_ranks(df, order, rank, descending=descending).where(F.col(rank) <= k)


def long_format(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    name: str = "variable",
    value: str = "valeur",
    cast: str = "double",
) -> DataFrame:
    """One row per (row, column) with a non-null value; `keep` columns are carried."""
    projected = df.select(*keep, *[F.col(c).cast(cast).alias(c) for c in columns])
    return projected.unpivot(list(keep), list(columns), name, value).where(
        F.col(value).isNotNull()
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n): rows, or the sum of `weight`, of each distinct value."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(n.alias("n"))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of `value` per `keys`, as an array column `q`.

    A row counts `weight` times (a whole number), once without it.
    """
    present = df.where(F.col(value).isNotNull())
    counts = value_counts(present, keys, value, weight)
    ranked = running_totals(counts, [value], {"_upto": F.col("n")}, keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    placed = (
        ranked.join(sizes, list(keys)) if keys else ranked.crossJoin(F.broadcast(sizes))
    )

    def at(position: Column) -> Column:
        inside = (F.col("_upto") - F.col("n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    picks, parts = [], []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_size") - 1)
        picks += [at(F.floor(position)).alias(f"_lo{i}"), at(F.ceil(position)).alias(f"_hi{i}")]
        exact = F.lit(float(p)) * (F.col("_size") - 1)
        fraction = exact - F.floor(exact)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        parts.append(F.when(fraction > 0, low + (high - low) * fraction).otherwise(low))
    picked = placed.groupBy(*keys, "_size").agg(*picks)
    return picked.select(*keys, F.array(*parts).alias("q"))


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Quantiles of several columns at once: (keys, variable, q)."""
    return quantiles(long_format(df, columns, keys), "valeur", probs, [*keys, "variable"])


def quantile_row(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One-row frame with array `q`, safe to broadcast."""
    return F.broadcast(quantiles(df, value, probs))


def mid_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n, rang): average rank of each distinct value."""
    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    ranked = running_totals(counts, [value], {"_upto": F.col("n")}, keys)
    rank = F.col("_upto") - (F.col("n") - 1) / 2.0
    return ranked.select(*keys, value, "n", rank.alias("rang"))
