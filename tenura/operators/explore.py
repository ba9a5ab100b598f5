"""Exploratory statistics as grouped plans over long-format data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions import maths, pvalues
from tenura.functions.text import normalise
from tenura.operators import primitives
from tenura.operators.ordering import (
    column_quantiles,
    long_format,
    mid_ranks,
    quantile_row,
    quantiles,
    running_totals,
)
from tenura.params import HYPOTHESES, THRESHOLDS, TOP_OF_DISTRIBUTION


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    n, pos = F.count(target), F.coalesce(F.sum(target), F.lit(0)).cast("bigint")
    return df.agg(n.alias("n"), pos.alias("n_churn")).select(
        "n",
        "n_churn",
        (F.col("n") - F.col("n_churn")).alias("n_fideles"),
        F.try_divide("n_churn", "n").alias("prevalence"),
        ((F.col("n") - F.col("n_churn")) / F.greatest("n_churn", F.lit(1))).alias(
            "ratio_desequilibre"
        ),
    )


# --- numeric summaries ---------------------------------------------------------------------


def tukey_fences(
    df: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(variable, q1, mediane, q3, bas, haut): one small row per column."""
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select(
        "variable",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("mediane"),
        F.col("q")[2].alias("q3"),
    ).withColumns({"bas": F.col("q1") - spread, "haut": F.col("q3") + spread})


def numeric_summary(
    df: DataFrame, columns: Sequence[str], target: str
) -> DataFrame:
    """Moments, quartiles, Tukey outliers and the target rate inside and outside them.

    Two passes: quartiles first, then one grouped pass against the broadcast fences.
    """
    fences = F.broadcast(tukey_fences(df, columns))
    long = (
        df.select(F.col(target).cast("double").alias("_y"),
                  *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["_y"], list(columns), "variable", "valeur")
        .join(fences, "variable")
    )
    x = F.col("valeur")
    outlier = (x < F.col("bas")) | (x > F.col("haut"))
    per = long.groupBy("variable").agg(
        F.count("valeur").alias("n"),
        F.count_if(x.isNull()).alias("n_manquants"),
        F.avg("valeur").alias("moyenne"),
        F.any_value("mediane").alias("mediane"),
        F.stddev_samp("valeur").alias("ecart_type"),
        F.min("valeur").alias("min"),
        F.max("valeur").alias("max"),
        F.any_value("q1").alias("q1"),
        F.any_value("q3").alias("q3"),
        F.skewness("valeur").alias("g1"),
        F.kurtosis("valeur").alias("g2"),
        F.count_if(outlier).alias("n_outliers_iqr"),
        F.avg(F.when(outlier, F.col("_y"))).alias("taux_cible_outliers"),
        F.avg(F.when(~outlier, F.col("_y"))).alias("taux_cible_hors_outliers"),
    )
    distinct = (
        long_format(df, columns)
        .groupBy("variable", "valeur").agg(F.lit(1).alias("_"))
        .groupBy("variable").agg(F.count("*").alias("n_distinctes"))
    )
    return (
        per.join(F.broadcast(distinct), "variable", "left")
        .withColumns(
            {
                "n_distinctes": F.coalesce("n_distinctes", F.lit(0)),
                "asymetrie": maths.adjusted_skew(F.col("g1"), F.col("n")),
                "kurtosis_exces": maths.adjusted_kurtosis(F.col("g2"), F.col("n")),
            }
        )
        .drop("g1", "g2")
    )


def extreme_profile(summary: DataFrame, min_outliers: int = 30) -> DataFrame:
    """Gap in points between outliers and the rest, shown only when outliers are many."""
    gap = 100 * (F.col("taux_cible_outliers") - F.col("taux_cible_hors_outliers"))
    return summary.select(
        "variable",
        "asymetrie",
        F.col("n_outliers_iqr").alias("n_outliers"),
        F.col("taux_cible_outliers").alias("churn_outliers"),
        F.col("taux_cible_hors_outliers").alias("churn_autres"),
        F.when(F.col("n_outliers_iqr") >= min_outliers, gap).alias("ecart_points"),
    )


# --- categorical summaries -----------------------------------------------------------------


def categorical_summary(df: DataFrame, columns: Sequence[str], rare: int = 10) -> DataFrame:
    """Cardinality before and after normalisation, spellings, rare levels, mode."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "colonne", "brut"
    )
    raw = long.groupBy("colonne", "brut").agg(F.count("*").alias("n"))
    filled = F.col("brut").isNotNull()
    norms = (
        raw.groupBy("colonne", normalise(F.col("brut")).alias("norme"))
        .agg(
            F.sum("n").alias("n"),
            F.count("brut").alias("ecritures"),
            F.count_if(filled & (F.col("n") < rare)).alias("rares"),
        )
    )
    known = F.col("norme").isNotNull()
    n = F.when(known, F.col("n"))
    per = norms.groupBy("colonne").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_manquants"),
        F.sum("ecritures").alias("cardinalite"),
        F.count("norme").alias("cardinalite_normalisee"),
        F.sum("rares").alias("n_modalites_rares"),
        F.count_if(known & (F.col("n") < rare)).alias("n_rares_normalisees"),
        F.min(
            F.when(known, F.struct((-F.col("ecritures")).alias("k"), "norme"))
        ).alias("eclatee"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("k"), "norme"))).alias("top"),
    )
    # only the spellings of one label per column are listed
    burst = F.broadcast(per.select("colonne", F.col("eclatee.norme").alias("_norme")))
    spelled = F.transform(
        F.array_sort(F.collect_list("brut")),
        lambda v: F.concat(F.lit("«"), F.replace(v, F.lit(" "), F.lit("␣")), F.lit("»")),
    )
    examples = (
        raw.join(burst, "colonne").where(normalise(F.col("brut")) == F.col("_norme"))
        .groupBy("colonne").agg(spelled.alias("exemple"))
    )
    per = per.join(F.broadcast(examples), "colonne", "left")
    variants = F.col("cardinalite") - F.col("cardinalite_normalisee")
    return per.select(
        "colonne",
        "n",
        "n_manquants",
        "cardinalite",
        "cardinalite_normalisee",
        variants.alias("variantes_typographiques"),
        F.when(variants > 0, F.array_join("exemple", " / "))
        .otherwise("")
        .alias("exemple_variantes"),
        "n_modalites_rares",
        "n_rares_normalisees",
        F.coalesce("top.norme", F.lit("")).alias("mode"),
        F.coalesce(F.try_divide(-100.0 * F.col("top.k"), F.col("n")), F.lit(0.0)).alias(
            "frequence_mode_pct"
        ),
    )


def uniformity_test(df: DataFrame, columns: Sequence[str], with_p: bool = True) -> DataFrame:
    """Chi-square goodness of fit to equal shares, per column."""
    long = df.select(*[normalise(F.col(c)).alias(c) for c in columns]).unpivot(
        [], list(columns), "colonne", "niveau"
    )
    counts = long.where("niveau IS NOT NULL").groupBy("colonne", "niveau").agg(
        F.count("*").alias("c")
    )
    c = F.col("c").cast("double")
    per = counts.groupBy("colonne").agg(
        F.count("*").alias("n_modalites"),
        F.sum("c").alias("n"),
        F.min("c").alias("lo"),
        F.max("c").alias("hi"),
        F.sum(c * c).alias("ss"),
    )
    k, n = F.col("n_modalites"), F.col("n")
    out = per.select(
        "colonne",
        "n_modalites",
        (1.0 / k).alias("part_uniforme"),
        (F.col("lo") / n).alias("part_min"),
        (F.col("hi") / n).alias("part_max"),
        F.when(k >= 2, F.col("ss") * k / n - n).alias("chi2"),
    )
    if not with_p:
        return out
    return out.withColumn("p_valeur", pvalues.chi2_p(F.col("chi2"), F.col("n_modalites") - 1))


def rate_by_level(df: DataFrame, level: str, target: str) -> DataFrame:
    return primitives.wilson_rates(df, level, target)


def rate_by_level_with_missing(df: DataFrame, level: str, target: str) -> DataFrame:
    label = F.coalesce(F.col(level).cast("string"), F.lit("manquant"))
    return df.groupBy(label.alias("niveau")).agg(
        F.count("*").alias("effectif"), F.avg(F.col(target).cast("double")).alias("taux_churn")
    )


def level_profile(
    df: DataFrame,
    level: str,
    target: str,
    variables: Sequence[str],
    condition: Column,
) -> DataFrame:
    """Rate, interval, medians of several variables and the share of a condition per level."""
    rates = primitives.wilson_rates(df, level, target)
    known = df.where(F.col(level).isNotNull())
    medians = (
        column_quantiles(known, variables, [0.5], [level])
        .groupBy(level)
        .pivot("variable", list(variables))
        .agg(F.first(F.col("q")[0]))
    )
    share = known.groupBy(level).agg(F.avg(condition.cast("int")).alias("part_condition"))
    return rates.join(medians, level).join(share, level)


def _level_counts(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(variable, niveau, n, pos) over rows where both are present."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "variable string, niveau string, n bigint, pos bigint"
        )
    long = df.select(
        F.col(target).cast("int").alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns]
    ).unpivot(["_y"], list(columns), "variable", "niveau")
    return (
        long.where("niveau IS NOT NULL AND _y IS NOT NULL")
        .groupBy("variable", "niveau")
        .agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
    )


def categorical_association(
    df: DataFrame, columns: Sequence[str], target: str, with_p: bool = True
) -> DataFrame:
    """Cramér's V of each column with the target; all columns in one grouped pass."""
    stats = primitives.chi_square_binary(_level_counts(df, columns, target), ["variable"])
    out = stats.select(
        F.col("variable").alias("colonne"), F.col("lignes").alias("n_modalites"), "ddl", "chi2",
        "v_cramer",
    )
    if not with_p:
        return out
    tested = out.withColumn("p_value_brute", pvalues.chi2_p(F.col("chi2"), F.col("ddl")))
    adjusted = primitives.benjamini_hochberg(tested, "p_value_brute", "p_value_bh")
    return adjusted.withColumn("significatif_bh", F.col("p_value_bh") < THRESHOLDS.alpha)


# --- rank-based association ----------------------------------------------------------------


def univariate_auc(
    df: DataFrame, columns: Sequence[str], target: str
) -> DataFrame:
    """(variable, n, n_pos, n_neg, auc, u, z) for every numeric column, one grouped plan."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "variable string, n bigint, n_pos bigint, n_neg bigint, auc double, u double, z double",
        )
    long = long_format(df, columns, [target])
    return primitives.rank_statistics(long, "valeur", target, ["variable"])


def mann_whitney(
    df: DataFrame, columns: Sequence[str], target: str
) -> DataFrame:
    """U of the positive class and its two-sided p-value (normal, tie and continuity corrected)."""
    stats = univariate_auc(df, columns, target)
    return stats.withColumn("p_value", pvalues.normal_p(F.col("z")))


def discriminating_power(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    with_p: bool = True,
) -> DataFrame:
    """Symmetrised AUC of numbers and Cramér's V of categories, strongest first."""
    aucs = univariate_auc(df, numeric, target).where(
        (F.col("n") >= 20) & F.col("auc").isNotNull()
    )
    left = aucs.select(
        "variable",
        F.lit("numerique").alias("type"),
        F.greatest("auc", 1 - F.col("auc")).alias("association"),
        F.col("z").alias("statistique"),
        F.lit(0).cast("bigint").alias("ddl"),
    )
    chi = primitives.chi_square_binary(_level_counts(df, categorical, target), ["variable"])
    right = chi.where("n >= 20").select(
        "variable",
        F.lit("categorielle").alias("type"),
        F.col("v_cramer").alias("association"),
        F.col("chi2").alias("statistique"),
        "ddl",
    )
    both = left.unionByName(right)
    if not with_p:
        return both
    tested = both.withColumn(
        "p_value_brute",
        F.when(F.col("type") == "numerique", pvalues.normal_p(F.col("statistique"))).otherwise(
            pvalues.chi2_p(F.col("statistique"), F.col("ddl"))
        ),
    )
    adjusted = primitives.benjamini_hochberg(tested, "p_value_brute", "p_value_bh")
    return adjusted.withColumn("significatif_bh", F.col("p_value_bh") < THRESHOLDS.alpha)


# --- correlations --------------------------------------------------------------------------


def centres(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of each column over its finite values; 0 where it has none."""
    value = [F.col(c).cast("double") for c in columns]
    finite = [F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for v in value]
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) over pairwise-complete rows for all a < b.

    Values are taken as distances from their column's mean (one aggregate of k numbers before),
    so columns far from zero lose no digits; a correlation does not depend on the shift.
    Each task adds up k x k matrices of its own rows; only k² numbers per task are shuffled.
    """
    names = list(columns)
    means = centres(df, names)
    upper = np.triu_indices(len(names), 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((6, len(names), len(names)))
        for frame in batches:
            x = frame.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            acc += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pd.DataFrame(
            {
                "i": upper[0].astype("int32"),
                "j": upper[1].astype("int32"),
                **{f"m{k}": acc[k][upper] for k in range(6)},
            }
        )

    centred = [(F.col(c).cast("double") - F.lit(means[c])).alias(c) for c in names]
    parts = df.select(*centred).mapInPandas(
        partial, "i int, j int, " + ", ".join(f"m{k} double" for k in range(6))
    )
    label = F.array(*[F.lit(c) for c in names])
    sums = parts.groupBy("i", "j").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(6)])
    return sums.select(
        F.element_at(label, F.col("i") + 1).alias("a"),
        F.element_at(label, F.col("j") + 1).alias("b"),
        F.col("m0").cast("bigint").alias("n"),
        F.col("m1").alias("sa"),
        F.col("m2").alias("sb"),
        F.col("m3").alias("saa"),
        F.col("m4").alias("sbb"),
        F.col("m5").alias("sab"),
    )


def _r_from_sums() -> Column:
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return F.when((n > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(variable_1, variable_2, n, correlation) for pairs with |r| >= threshold."""
    pairs = pair_moments(df, columns).where("n > 1")
    out = pairs.select(
        F.col("a").alias("variable_1"),
        F.col("b").alias("variable_2"),
        "n",
        _r_from_sums().alias("correlation"),
    )
    return out.where(F.abs("correlation") >= threshold)


def spearman_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """(variable_1, variable_2, n, rho) from weighted ranks of distinct value pairs."""
    both = [
        df.select(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        ).where("x IS NOT NULL AND y IS NOT NULL")
        for a, b in pairs
    ]
    long = both[0]
    for part in both[1:]:
        long = long.unionByName(part)
    cells = long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("w"))
    rx = mid_ranks(long, "x", ["a", "b"]).select("a", "b", "x", F.col("rang").alias("rx"))
    ry = mid_ranks(long, "y", ["a", "b"]).select("a", "b", "y", F.col("rang").alias("ry"))
    ranked = cells.join(rx, ["a", "b", "x"]).join(ry, ["a", "b", "y"])
    w, p, q = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("a", "b").agg(
        F.sum("w").alias("n"),
        F.sum(w * p).alias("sa"),
        F.sum(w * q).alias("sb"),
        F.sum(w * p * p).alias("saa"),
        F.sum(w * q * q).alias("sbb"),
        F.sum(w * p * q).alias("sab"),
    )
    return sums.select(
        F.col("a").alias("variable_1"), F.col("b").alias("variable_2"), "n",
        _r_from_sums().alias("rho"),
    )


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, vif): diagonal of the inverse of the k x k correlation matrix."""
    names = list(columns)
    rows = correlation_pairs(df, names).collect()
    matrix = np.eye(len(names))
    for row in rows:
        i, j = names.index(row["variable_1"]), names.index(row["variable_2"])
        matrix[i, j] = matrix[j, i] = row["correlation"]
    diagonal = np.diag(np.linalg.pinv(matrix))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(names, diagonal, strict=True)],
        "variable string, vif double",
    )


# --- hypotheses ----------------------------------------------------------------------------


def quantile_flag(
    df: DataFrame, column: str, q: float = 0.75, out: str | None = None
) -> DataFrame:
    """1 when the value reaches the quantile, 0 below, null when missing."""
    edge = quantile_row(df, column, [q]).select(F.col("q")[0].alias("_edge"))
    flag = (F.col(column).cast("double") >= F.col("_edge")).cast("int")
    return df.crossJoin(edge).withColumn(out or f"{column}_haut", flag).drop("_edge")


def hypothesis_tests(
    df: DataFrame,
    target: str,
    hypotheses: Sequence[tuple[str, str, str]] = HYPOTHESES,
    top: Sequence[str] = TOP_OF_DISTRIBUTION,
    with_p: bool = True,
) -> DataFrame:
    """Each hypothesis in long format: medians (or shares) by class, AUC, Holm, verdict."""
    kept = [h for h in hypotheses if h[1] in df.columns]
    # the quantile is taken over rows where the target is known, as the test itself
    work = df.where(F.col(target).isNotNull())
    values: dict[str, str] = {}
    for hid, variable, _ in kept:
        if hid in top:
            work = quantile_flag(work, variable, 0.75, f"_{hid}")
            values[hid] = f"_{hid}"
        else:
            values[hid] = variable
    long = work.select(
        F.col(target).cast("int").alias("_y"),
        *[F.col(values[h]).cast("double").alias(h) for h, _, _ in kept],
    ).unpivot(["_y"], [h for h, _, _ in kept], "id", "x")
    long = long.where("x IS NOT NULL")
    stats = primitives.rank_statistics(long, "x", "_y", ["id"])
    medians = quantiles(long, "x", [0.5], ["id", "_y"])
    means = long.groupBy("id", "_y").agg(F.avg("x").alias("m"))
    centre = F.when(F.col("id").isin(*top), F.col("m")).otherwise(F.col("q")[0])
    centres = (
        medians.join(means, ["id", "_y"])
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("_y") == 1, centre)).alias("mediane_churn"),
            F.max(F.when(F.col("_y") == 0, centre)).alias("mediane_non_churn"),
        )
    )
    meta = F.create_map(
        *[
            x
            for h, v, s in kept
            for x in (F.lit(h), F.struct(F.lit(v).alias("variable"), F.lit(s).alias("sens")))
        ]
    )
    auc = F.col("auc")
    rows = stats.join(centres, "id").select(
        "id",
        meta[F.col("id")]["variable"].alias("variable"),
        meta[F.col("id")]["sens"].alias("sens_attendu"),
        F.when(F.col("id").isin(*top), "part >= quantile").otherwise("mediane").alias("mesure"),
        "mediane_churn",
        "mediane_non_churn",
        F.when(auc > 0.5, "+").when(auc < 0.5, "-").otherwise("=").alias("sens_observe"),
        F.when(meta[F.col("id")]["sens"] == "+", auc).otherwise(1.0 - auc).alias("auc_orientee"),
        "z",
    )
    if not with_p:
        return rows
    tested = rows.withColumn("p_value_brute", pvalues.normal_p(F.col("z")))
    adjusted = primitives.holm(tested, "p_value_brute", "p_value_holm")
    verdict = (
        F.when(~(F.col("p_value_holm") < THRESHOLDS.alpha), "non concluante")
        .when(F.col("sens_observe") == F.col("sens_attendu"), "confirmee")
        .otherwise("infirmee")
    )
    return adjusted.withColumn("verdict", verdict)


# Ratio -> (raw column it should beat, expected direction).
RATIOS = {
    "taux_utilisation_sieges": ("utilisateurs_actifs", "-"),
    "taux_couverture_fonctionnelle": ("fonctionnalites_utilisees", "-"),
    "intensite_usage_par_utilisateur": ("heures_usage_30j", "-"),
    "arpu_par_siege": ("revenu_mensuel_recurrent_eur", "-"),
    "intensite_support": ("tickets_support_90j", "+"),
}


def ratio_vs_raw_auc(
    df: DataFrame,
    target: str,
    ratios: Mapping[str, tuple[str, str]] = RATIOS,
) -> DataFrame:
    """Oriented AUC of each ratio against that of its raw column, and the ratio's gaps."""
    columns = sorted({*ratios, *[raw for raw, _ in ratios.values()]})
    aucs = univariate_auc(df, columns, target).select("variable", "auc", "n")
    total = df.agg(F.count("*").alias("total"))
    meta = df.sparkSession.createDataFrame(
        [(r, raw, sign) for r, (raw, sign) in ratios.items()],
        "ratio string, variable_brute string, sens string",
    )
    side = F.broadcast(aucs)
    a = side.select(F.col("variable").alias("ratio"), F.col("auc").alias("a"), "n")
    b = side.select(F.col("variable").alias("variable_brute"), F.col("auc").alias("b"))
    oriented = lambda c: F.when(F.col("sens") == "+", F.col(c)).otherwise(1 - F.col(c))
    joined = meta.join(a, "ratio").join(b, "variable_brute").crossJoin(F.broadcast(total))
    return joined.select(
        "ratio",
        "variable_brute",
        oriented("a").alias("auc_ratio"),
        oriented("b").alias("auc_brute"),
        (1 - F.col("n") / F.col("total")).alias("manquants"),
    )


# --- portfolio -----------------------------------------------------------------------------


def portfolio_by_quartile(
    df: DataFrame, revenue: str, target: str
) -> DataFrame:
    """One row per revenue quartile and a Total row, from one rollup."""
    known = df.select(
        F.col(revenue).cast("double").alias("mrr"), F.col(target).cast("double").alias("y")
    ).where("mrr IS NOT NULL AND y IS NOT NULL")
    edges = quantile_row(known, "mrr", [0.25, 0.5, 0.75])
    placed = known.crossJoin(edges).select(
        "mrr",
        "y",
        F.when(F.col("mrr") <= F.col("q")[0], "Q1")
        .when(F.col("mrr") <= F.col("q")[1], "Q2")
        .when(F.col("mrr") <= F.col("q")[2], "Q3")
        .otherwise("Q4")
        .alias("quartile"),
    )
    money = F.col("mrr").cast("decimal(28,6)")
    per = placed.rollup("quartile").agg(
        F.count("*").alias("comptes"),
        F.min("mrr").alias("mrr_min"),
        F.max("mrr").alias("mrr_max"),
        (F.sum(money) * 12).cast("double").alias("revenu_annuel"),
        F.avg("y").alias("taux_churn"),
        (F.sum(F.when(F.col("y") == 1, money)) * 12).cast("double").alias("revenu_partants"),
    )
    labelled = placed.select("mrr", F.explode(F.array("quartile", F.lit("Total"))).alias("quartile"))
    medians = quantiles(labelled, "mrr", [0.5], ["quartile"])
    total = F.max(F.when(F.col("quartile") == "Total", F.col("revenu_annuel"))).over(
        Window.partitionBy()
    )
    named = per.withColumn("quartile", F.coalesce("quartile", F.lit("Total")))
    return named.join(medians, "quartile").select(
        "quartile",
        "comptes",
        "mrr_min",
        "mrr_max",
        F.col("q")[0].alias("mrr_median"),
        "revenu_annuel",
        F.try_divide(F.col("revenu_annuel"), total).alias("part_du_revenu"),
        "taux_churn",
        F.coalesce("revenu_partants", F.lit(0.0)).alias("revenu_partants"),
    )


def concentration_curve(
    df: DataFrame, revenue: str, target: str | None = None
) -> DataFrame:
    """One row per distinct revenue, largest first: share of rows and of revenue held so far.

    Rows with equal revenue share one point, so the curve is the same and needs no tie order.
    """
    known = df.where(F.col(revenue).isNotNull())
    if target is not None:
        known = known.where(F.col(target).isNotNull())
    value = F.col(revenue).cast("decimal(18,6)").alias("revenu")
    counts = known.groupBy(value).agg(F.count("*").alias("n"))
    amount = (F.col("n") * F.col("revenu")).cast("decimal(28,6)")
    ranked = running_totals(
        counts, ["revenu"], {"rang": F.col("n"), "cumul": amount}, (), ["revenu"]
    )
    totals = counts.agg(F.sum("n").alias("n_total"), F.sum(amount).alias("total"))
    return ranked.crossJoin(F.broadcast(totals)).select(
        F.col("revenu").cast("double").alias("revenu"),
        "n",
        "rang",
        (F.col("rang") / F.col("n_total")).alias("part_comptes"),
        (F.col("cumul").cast("double") / F.col("total").cast("double")).alias("part_revenu"),
    )


def top_share(
    df: DataFrame, revenue: str, share: float = 0.2, target: str | None = None,
) -> DataFrame:
    """One row: share of revenue held by the largest `share` of rows."""
    curve = concentration_curve(df, revenue, target)
    totals = curve.agg(
        F.sum("n").alias("n_total"), F.sum(F.col("n") * F.col("revenu")).alias("total")
    )
    rank = F.ceil(F.lit(share) * F.col("n_total"))
    hit = (F.col("rang") >= rank) & (F.col("rang") - F.col("n") < rank)
    inside = F.col("part_revenu") - (F.col("rang") - rank) * F.col("revenu") / F.col("total")
    return curve.crossJoin(F.broadcast(totals)).where(hit).select(inside.alias("part_top"))


def rate_by_quarter(df: DataFrame, date: str, target: str, min_size: int = 30) -> DataFrame:
    known = df.where(F.col(date).isNotNull())
    return known.groupBy(F.trunc(date, "quarter").alias("trimestre")).agg(
        F.avg(F.col(target).cast("double")).alias("taux_churn"),
        F.count("*").alias("effectif"),
        (F.count("*") >= min_size).alias("fiable"),
    )


def temporal_split_check(
    df: DataFrame, date: str, target: str, tenure: str, q: float = 0.8
) -> DataFrame:
    """(cote, n, taux_churn, anciennete_mediane) before and after the date quantile."""
    day = df.withColumn("_day", F.unix_date(F.col(date)))
    edge = quantile_row(day, "_day", [q]).select(F.col("q")[0].alias("_edge"))
    side = F.when(F.col("_day") <= F.col("_edge"), "avant").when(
        F.col("_day") > F.col("_edge"), "apres"
    )
    placed = day.crossJoin(edge).withColumn("cote", side).where("cote IS NOT NULL")
    rates = placed.groupBy("cote").agg(
        F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("taux_churn")
    )
    medians = column_quantiles(placed, [tenure], [0.5], ["cote"])
    return rates.join(medians, "cote").select(
        "cote", "n", "taux_churn", F.col("q")[0].alias("anciennete_mediane")
    )


def revenue_vs_catalogue(
    df: DataFrame, selected: Column
) -> DataFrame:
    """One row: MRR / (seats x list price), range of selected rows against p1-p99 of all."""
    ratio = maths.ratio(
        F.col("revenu_mensuel_recurrent_eur"),
        F.col("sieges_souscrits") * F.col("prix_mensuel_par_siege_eur"),
    )
    rated = df.select(ratio.alias("ratio"), selected.alias("retenu"))
    edges = quantile_row(rated, "ratio", [0.01, 0.99])
    chosen = F.when(F.col("retenu"), F.col("ratio"))
    span = rated.agg(F.min(chosen).alias("retenus_min"), F.max(chosen).alias("retenus_max"))
    return span.crossJoin(edges).select(
        "retenus_min", "retenus_max", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99")
    )


def levels_off_average(df: DataFrame, level: str, target: str) -> DataFrame:
    """Levels whose Wilson interval lies wholly on one side of the overall rate."""
    overall = df.agg(F.avg(F.col(target).cast("double")).alias("moyenne"))
    rated = primitives.wilson_rates(df, level, target).crossJoin(F.broadcast(overall))
    side = F.when(F.col("ic_bas") > F.col("moyenne"), "au-dessus").when(
        F.col("ic_haut") < F.col("moyenne"), "au-dessous"
    )
    return rated.select(level, "taux_churn", "moyenne", side.alias("position")).where(
        "position IS NOT NULL"
    )


def rate_near_anniversary(df: DataFrame, tenure: str, target: str) -> DataFrame:
    """One row: target rate close to (<=2 months) and far from (>=9) the anniversary."""
    months = F.pmod(12 - F.pmod(F.col(tenure), F.lit(12)), F.lit(12))
    y = F.col(target).cast("double")
    return df.agg(
        F.avg(F.when(months <= 2, y)).alias("taux_proche"),
        F.avg(F.when(months >= 9, y)).alias("taux_loin"),
        F.count_if(months <= 2).alias("n_proche"),
        F.count_if(months >= 9).alias("n_loin"),
    )


def additive_or_multiplicative(df: DataFrame, value: str, revenue: str) -> DataFrame:
    """One row: correlation of two amounts in euros and in logs, over positive rows."""
    positive = df.where((F.col(value) > 0) & (F.col(revenue) > 0))
    return positive.agg(
        maths.pearson(F.col(value), F.col(revenue)).alias("r_euros"),
        maths.pearson(F.log(value), F.log(revenue)).alias("r_logs"),
    )
