"""Shared statistics: contingency, chi-square, rank statistics, multiple-testing corrections.

Every statistic is written as sums over distinct values or levels, so that one grouped pass
with map-side combining is enough and a hot value costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions import maths, text
from tenura.operators.ordering import running_totals


def contingency(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long cross-table with marginals: (keys, a, b, n, n_a, n_b, total)."""
    cells = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*keys, a, b)
        .agg(F.count("*").alias("n"))
    )
    n_a = cells.groupBy(*keys, a).agg(F.sum("n").alias("n_a"))
    n_b = cells.groupBy(*keys, b).agg(F.sum("n").alias("n_b"))
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = cells.join(n_a, [*keys, a]).join(n_b, [*keys, b])
    return out.join(totals, list(keys)) if keys else out.crossJoin(F.broadcast(totals))


def _corrected(chi2: Column, inverse_expected: Column, two_by_two: Column) -> Column:
    """Yates: in a 2x2 table all four gaps are equal, so the gap follows from chi2 itself."""
    gap = F.sqrt(chi2 / inverse_expected)
    shrunk = gap - F.least(F.lit(0.5), gap)
    return F.when(two_by_two, shrunk * shrunk * inverse_expected).otherwise(chi2)


def chi_square(cells: DataFrame, a: str, b: str, keys: Sequence[str] = (), yates: bool = True):
    """(keys, n, lignes, colonnes, ddl, chi2, v_cramer) from the output of `contingency`.

    Empty cells add nothing to sum(O²/E), so they need not exist as rows.
    """
    per = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.count_distinct(a).alias("lignes"),
        F.count_distinct(b).alias("colonnes"),
        F.sum(F.col("n") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("s"),
    )
    rows = cells.select(*keys, a, "n_a").distinct().groupBy(*keys)
    cols = cells.select(*keys, b, "n_b").distinct().groupBy(*keys)
    inv_a = rows.agg(F.sum(1.0 / F.col("n_a")).alias("inv_a"))
    inv_b = cols.agg(F.sum(1.0 / F.col("n_b")).alias("inv_b"))
    if keys:
        per = per.join(inv_a, list(keys)).join(inv_b, list(keys))
    else:
        per = per.crossJoin(F.broadcast(inv_a)).crossJoin(F.broadcast(inv_b))
    return _finish_chi2(
        per.withColumn("raw", F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1.0))), keys, yates
    )


def _finish_chi2(per: DataFrame, keys: Sequence[str], yates: bool) -> DataFrame:
    enough = (F.col("lignes") >= 2) & (F.col("colonnes") >= 2)
    chi2 = F.col("raw")
    if yates:
        inverse = F.col("n") * F.col("inv_a") * F.col("inv_b")
        chi2 = _corrected(chi2, inverse, (F.col("lignes") == 2) & (F.col("colonnes") == 2))
    smallest = F.least(F.col("lignes"), F.col("colonnes")) - 1
    return per.select(
        *keys,
        "n",
        "lignes",
        "colonnes",
        ((F.col("lignes") - 1) * (F.col("colonnes") - 1)).alias("ddl"),
        F.when(enough, chi2).otherwise(0.0).alias("chi2"),
        F.when(enough, F.sqrt(chi2 / (F.col("n") * smallest))).otherwise(0.0).alias("v_cramer"),
    )


def chi_square_binary(
    levels: DataFrame, keys: Sequence[str], n: str = "n", pos: str = "pos", yates: bool = True
) -> DataFrame:
    """Chi-square of level x binary outcome from per-level counts; one grouped pass."""
    size, p = F.col(n).cast("double"), F.col(pos).cast("double")
    q = size - p
    per = levels.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.count("*").alias("lignes"),
        F.sum(pos).cast("double").alias("P"),
        F.sum(F.col(n) - F.col(pos)).cast("double").alias("Q"),
        F.sum(p * p / size).alias("sp"),
        F.sum(q * q / size).alias("sq"),
        F.sum(1.0 / size).alias("inv_a"),
    )
    both = (F.col("P") > 0) & (F.col("Q") > 0)
    raw = F.col("n") * (F.try_divide("sp", "P") + F.try_divide("sq", "Q") - 1.0)
    return _finish_chi2(
        per.withColumns(
            {
                "colonnes": F.when(both, 2).otherwise(1).cast("bigint"),
                "raw": F.greatest(F.lit(0.0), F.when(both, raw).otherwise(0.0)),
                "inv_b": F.when(both, 1.0 / F.col("P") + 1.0 / F.col("Q")).otherwise(1.0),
            }
        ),
        keys,
        yates,
    )


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    return chi_square(contingency(df, a, b), a, b, yates=yates)


def rank_statistics(
    df: DataFrame,
    value: str,
    target: str,
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(keys, n, n_pos, n_neg, auc, u, z): Mann-Whitney from distinct values, ties included."""
    present = df.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    w = F.lit(1) if weight is None else F.col(weight)
    counts = present.groupBy(*keys, value).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(target)).cast("bigint").alias("pos")
    )
    return rank_statistics_of_counts(counts, value, keys)


def rank_statistics_of_counts(
    counts: DataFrame, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Same, from one row (keys, value, n, pos) per distinct value."""
    ranked = running_totals(
        counts, [value], {"neg_upto": F.col("n") - F.col("pos")}, keys
    )
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    per = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum(pos * (F.col("neg_upto") - neg / 2.0)).alias("u"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n, n1 = F.col("n").cast("double"), F.col("n_pos").cast("double")
    n0 = n - n1
    usable = (n1 > 0) & (n0 > 0)
    variance = n1 * n0 / 12.0 * ((n + 1.0) - F.try_divide(F.col("ties"), n * (n - 1.0)))
    gap = F.greatest(F.lit(0.0), F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5)
    return per.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        F.col("n_pos").cast("bigint").alias("n_pos"),
        n0.cast("bigint").alias("n_neg"),
        F.when(usable, F.col("u") / (n1 * n0)).alias("auc"),
        "u",
        F.when(usable & (variance > 0), gap / F.sqrt(variance)).alias("z"),
    )


def benjamini_hochberg(df: DataFrame, p: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values; `df` is a report of a few rows per key, one row per test."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p))
    size = F.count(p).over(Window.partitionBy(*keys))
    step = Window.partitionBy(*keys).orderBy(F.col("_rank").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    scaled = df.withColumn("_rank", rank).withColumn("_m", size)
    adjusted = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(step)
    return scaled.withColumn(out, F.least(F.lit(1.0), adjusted)).drop("_rank", "_m")


def holm(df: DataFrame, p: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values; `df` is a report of a few rows per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p))
    size = F.count(p).over(Window.partitionBy(*keys))
    step = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    scaled = df.withColumn("_rank", rank).withColumn("_m", size)
    adjusted = F.max(F.col(p) * (F.col("_m") - F.col("_rank") + 1)).over(step)
    return scaled.withColumn(out, F.least(F.lit(1.0), adjusted)).drop("_rank", "_m")


def wilson_rates(
    df: DataFrame, level: str, target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, level, effectif, n_churn, taux_churn, ic_bas, ic_haut)."""
    present = df.where(F.col(level).isNotNull() & F.col(target).isNotNull())
    per = present.groupBy(*keys, level).agg(
        F.count("*").alias("effectif"), F.sum(target).cast("bigint").alias("n_churn")
    )
    low, high = maths.wilson(F.col("n_churn"), F.col("effectif"))
    return per.withColumns(
        {"taux_churn": F.col("n_churn") / F.col("effectif"), "ic_bas": low, "ic_haut": high}
    )


def sniff_numeric(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(colonne, part_numerique, numerique): share of filled values in plain number notation."""
    shares = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).agg(
        *[F.try_divide(F.count_if(text.is_plain_number(c)), F.count(c)).alias(c) for c in columns]
    )
    long = shares.unpivot([], list(columns), "colonne", "part_numerique")
    return long.withColumn(
        "numerique", F.coalesce(F.col("part_numerique") > threshold, F.lit(False))
    )
