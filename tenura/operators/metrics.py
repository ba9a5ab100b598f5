"""Model evaluation from distinct scores: curves, thresholds, calibration, fairness, errors.

A curve has one point per distinct score, so rows are compressed to (score, n, pos) first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions import maths
from tenura.functions.text import normalise
from tenura.operators import primitives
from tenura.operators.ordering import quantile_row, running_totals
from tenura.params import THRESHOLDS


def score_table(
    df: DataFrame,
    score: str = "p",
    target: str = "y",
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(keys, seuil, n, pos, n_upto, pos_upto) by decreasing score, ties in one row."""
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    w = F.lit(1) if weight is None else F.col(weight)
    counts = known.groupBy(*keys, F.col(score).alias("seuil")).agg(
        F.sum(w).cast("bigint").alias("n"), F.sum(w * F.col(target)).cast("bigint").alias("pos")
    )
    return running_totals(
        counts, ["seuil"], {"n_upto": F.col("n"), "pos_upto": F.col("pos")}, keys, ["seuil"]
    )


def _with_totals(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = table.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("pos").alias("positifs"))
    return table.join(totals, list(keys)) if keys else table.crossJoin(F.broadcast(totals))


def roc_curve(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, seuil, fpr, tpr) of a score table."""
    full = _with_totals(table, keys)
    return full.select(
        *keys,
        "seuil",
        F.try_divide(
            F.col("n_upto") - F.col("pos_upto"), F.col("total") - F.col("positifs")
        ).alias("fpr"),
        F.try_divide("pos_upto", "positifs").alias("tpr"),
    )


def pr_curve(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    full = _with_totals(table, keys)
    return full.select(
        *keys,
        "seuil",
        (F.col("pos_upto") / F.col("n_upto")).alias("precision"),
        F.try_divide("pos_upto", "positifs").alias("rappel"),
    )


def areas(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, positifs, roc_auc, pr_auc).

    Trapezoids of the ROC curve and steps of the PR curve only need each point's own counts
    and running totals, so no look-back over neighbours is needed.
    """
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    per = table.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positifs"),
        F.sum(neg * (F.col("pos_upto") - pos / 2.0)).alias("_roc"),
        F.sum(pos * (F.col("pos_upto") / F.col("n_upto"))).alias("_pr"),
    )
    p = F.col("positifs").cast("double")
    q = F.col("n") - p
    return per.select(
        *keys,
        "n",
        "positifs",
        F.when((p > 0) & (q > 0), F.col("_roc") / (p * q)).alias("roc_auc"),
        F.when(p > 0, F.col("_pr") / p).alias("pr_auc"),
    )


def confusion(df: DataFrame, pred: Column, target: str = "y", keys: Sequence[str] = ()):
    """(keys, vn, fp, fn, vp) and their percentages, present even when a class is absent."""
    y, flag = F.col(target), pred.cast("int")
    per = df.groupBy(*keys).agg(
        F.count_if((y == 0) & (flag == 0)).alias("vn"),
        F.count_if((y == 0) & (flag == 1)).alias("fp"),
        F.count_if((y == 1) & (flag == 0)).alias("fn"),
        F.count_if((y == 1) & (flag == 1)).alias("vp"),
    )
    total = F.col("vn") + F.col("fp") + F.col("fn") + F.col("vp")
    return per.withColumns(
        {f"{c}_pct": 100.0 * F.try_divide(c, total) for c in ("vn", "fp", "fn", "vp")}
    )


def brier(df: DataFrame, score: str = "p", target: str = "y", keys: Sequence[str] = ()):
    gap = F.col(score) - F.col(target)
    mean = F.avg(F.col(target).cast("double"))
    return df.groupBy(*keys).agg(
        F.avg(gap * gap).alias("brier"), (mean * (1 - mean)).alias("brier_reference")
    )


def calibration_curve(
    df: DataFrame,
    score: str = "p",
    target: str = "y",
    n_bins: int = 10,
) -> DataFrame:
    """Quantile bins: mean score and observed rate; bins that hold no row are absent.

    A score equal to an edge belongs to the bin below it; rows without a score belong to none.
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = quantile_row(df, score, probs)
    placed = df.where(F.col(score).isNotNull()).crossJoin(edges).withColumn(
        "bin", F.size(F.filter("q", lambda e: e < F.col(score))).cast("bigint")
    )
    return placed.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.avg(score).alias("proba_moyenne"),
        F.avg(F.col(target).cast("double")).alias("taux_observe"),
    )


def metrics_at(
    df: DataFrame,
    threshold: float | Column,
    score: str = "p",
    target: str = "y",
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """One row per key: areas, precision, recall, F1, specificity, Brier, flagged share.

    Everything comes from the score table: the squared error of a score is a function of
    (score, n, pos) too.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    table = score_table(df, score, target, keys, weight)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    s = F.col("seuil")
    neg = n - pos
    flagged = s >= limit
    per = table.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(pos).alias("p"),
        F.sum(neg * (F.col("pos_upto") - pos / 2.0)).alias("_roc"),
        F.sum(pos * (F.col("pos_upto") / F.col("n_upto"))).alias("_pr"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        F.coalesce(F.sum(F.when(flagged, pos)), F.lit(0.0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, neg)), F.lit(0.0)).alias("fp"),
    )
    n, p, tp, fp = (F.col(c) for c in ("n", "p", "tp", "fp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = (p > 0) & (n - p > 0)
    return per.select(
        *keys,
        F.when(p > 0, F.col("_pr") / p).alias("pr_auc"),
        F.when(both, F.col("_roc") / (p * (n - p))).alias("roc_auc"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"),
        zero(F.try_divide(tp, p)).alias("rappel"),
        zero(F.try_divide(2 * tp, tp + fp + p)).alias("f1"),
        zero(F.try_divide(n - p - fp, n - p)).alias("specificite"),
        (F.col("_sq") / n).alias("brier"),
        ((tp + fp) / n).alias("part_signalee"),
    )


def fairness_by_group(
    df: DataFrame,
    attributes: Sequence[str],
    threshold: float | Column,
    score: str = "p",
    target: str = "y",
    min_positives: int = THRESHOLDS.fairness_min_positives,
) -> DataFrame:
    """Per attribute and normalised level: rates, calibration gap, AUC, TPR, FPR."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    long = df.select(
        F.col(score).alias("_p"),
        F.col(target).cast("int").alias("_y"),
        (F.col(score) >= limit).cast("int").alias("_d"),
        *[F.coalesce(normalise(F.col(a)), F.lit("inconnu")).alias(a) for a in attributes],
    ).unpivot(["_p", "_y", "_d"], list(attributes), "attribut", "modalite")
    y, p, d = F.col("_y"), F.col("_p"), F.col("_d")
    keys = ["attribut", "modalite"]
    per = long.groupBy(*keys).agg(
        F.count("*").alias("effectif"),
        F.sum(y).alias("churners"),
        F.avg(y).alias("taux_churn_reel"),
        F.avg(p).alias("proba_moyenne"),
        F.avg(F.when(y == 1, d)).alias("tpr"),
        F.avg(F.when(y == 0, d)).alias("fpr"),
    )
    aucs = primitives.rank_statistics(long, "_p", "_y", keys).select(
        *keys, F.col("auc").alias("roc_auc")
    )
    return per.join(aucs, keys, "left").withColumns(
        {
            "ecart_calibration": F.col("proba_moyenne") - F.col("taux_churn_reel"),
            "interpretable": F.col("churners") >= min_positives,
        }
    )


def fairness_cut(
    df: DataFrame, score: str = "p", target: str = "y"
) -> float:
    """Threshold that flags as many rows as there are positives: quantile 1 - prevalence."""
    rate = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return float(quantile_row(df, score, [1 - rate]).first()["q"][0])


def fairness_review(
    by_group: DataFrame,
    max_tpr_gap: float = THRESHOLDS.fairness_tpr_gap,
    max_calibration: float = THRESHOLDS.fairness_calibration_gap,
) -> DataFrame:
    """One row per attribute over its interpretable levels."""
    tpr, cal = F.max("tpr") - F.min("tpr"), F.max(F.abs("ecart_calibration"))
    per = by_group.where("interpretable").groupBy("attribut").agg(
        tpr.alias("ecart_tpr"),
        F.min(F.struct("tpr", "modalite")).alias("_worst"),
        F.min("roc_auc").alias("roc_auc_min"),
        cal.alias("ecart_calibration_max"),
    )
    return per.select(
        "attribut",
        "ecart_tpr",
        F.col("_worst.modalite").alias("moins_detectee"),
        "roc_auc_min",
        "ecart_calibration_max",
        (
            (F.col("ecart_tpr") > max_tpr_gap) | (F.col("ecart_calibration_max") > max_calibration)
        ).alias("revue_requise"),
    )


def _segment(threshold: float | Column, score: str, target: str) -> Column:
    flagged = F.col(score) >= threshold
    return (
        F.when((F.col(target) == 1) & ~flagged, "FN")
        .when((F.col(target) == 0) & flagged, "FP")
        .when((F.col(target) == 1) & flagged, "VP")
        .otherwise("VN")
    )


def error_segments(
    df: DataFrame,
    threshold: float | Column,
    numeric: Sequence[str],
    score: str = "p",
    target: str = "y",
) -> DataFrame:
    """(segment, n, proba_moyenne, mean of each numeric column)."""
    return df.groupBy(_segment(threshold, score, target).alias("segment")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("proba_moyenne"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in numeric],
    )


def error_level_shares(
    df: DataFrame,
    threshold: float | Column,
    columns: Sequence[str],
    score: str = "p",
    target: str = "y",
) -> DataFrame:
    """(segment, colonne, niveau, n, part): share of each level inside its segment."""
    long = df.select(
        _segment(threshold, score, target).alias("segment"), *[F.col(c) for c in columns]
    ).unpivot(["segment"], list(columns), "colonne", "niveau")
    counts = (
        long.where("niveau IS NOT NULL")
        .groupBy("segment", "colonne", "niveau")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("segment", "colonne").agg(F.sum("n").alias("total"))
    joined = counts.join(F.broadcast(totals), ["segment", "colonne"])
    return joined.withColumn("part", F.col("n") / F.col("total")).drop("total")


def standardised_gap(
    df: DataFrame,
    threshold: float | Column,
    numeric: Sequence[str],
    other: str = "VP",
    top: int = 8,
    score: str = "p",
    target: str = "y",
) -> DataFrame:
    """(variable, ecart): (mean of misses - mean of `other`) / std, largest first, top few."""
    long = df.select(
        _segment(threshold, score, target).alias("segment"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
    ).unpivot(["segment"], list(numeric), "variable", "x")
    per = long.groupBy("variable").agg(
        F.avg(F.when(F.col("segment") == "FN", F.col("x"))).alias("fn"),
        F.avg(F.when(F.col("segment") == other, F.col("x"))).alias("autre"),
        F.stddev_samp("x").alias("s"),
    )
    gap = F.try_divide(F.col("fn") - F.col("autre"), F.col("s"))
    ranked = per.select("variable", gap.alias("ecart")).where("ecart IS NOT NULL")
    return ranked.orderBy(F.abs("ecart").desc(), "variable").limit(top)


# --- thresholds ----------------------------------------------------------------------------


def threshold_for_recall(
    df: DataFrame,
    recall: float = THRESHOLDS.vigilance_recall,
    score: str = "p",
    target: str = "y",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Highest threshold whose recall reaches the aim, with what it flags, ties included."""
    full = _with_totals(score_table(df, score, target, keys), keys)
    reached = F.col("pos_upto") / F.col("positifs") >= recall - 1e-12
    hit = F.struct("seuil", "n_upto", "pos_upto", "total", "positifs")
    best = full.where(F.col("positifs") > 0).groupBy(*keys).agg(
        F.max(F.when(reached, hit)).alias("b")
    )
    return best.select(
        *keys,
        F.col("b.seuil").alias("seuil"),
        (F.col("b.pos_upto") / F.col("b.positifs")).alias("recall"),
        (F.col("b.pos_upto") / F.col("b.n_upto")).alias("precision"),
        (F.col("b.n_upto") / F.col("b.total")).alias("part_signalee"),
        F.col("b.n_upto").alias("n_signales"),
        (F.col("b.positifs") - F.col("b.pos_upto")).alias("n_faux_negatifs"),
    )


def threshold_stability(
    df: DataFrame,
    fold: str,
    n_folds: int,
    recall: float = THRESHOLDS.vigilance_recall,
    score: str = "p",
    target: str = "y",
) -> DataFrame:
    """(pli, seuil, recall_tenu): threshold set without a fold, recall measured on it."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold))
    learning = df.select(score, target, F.explode(others).alias("pli"))
    limits = threshold_for_recall(learning, recall, score, target, ["pli"]).select(
        "pli", "seuil"
    )
    held = df.join(F.broadcast(limits), F.col(fold) == F.col("pli"))
    caught = F.avg(F.when(F.col(target) == 1, (F.col(score) >= F.col("seuil")).cast("int")))
    return held.groupBy("pli", "seuil").agg(caught.alias("recall_tenu"))


def cohort_alert(
    df: DataFrame,
    cohort: str,
    reference_share: float,
    score: str = "p",
    target: str = "y",
) -> DataFrame:
    """Per cohort: PR-AUC against its floors, share of red alerts against the reference."""
    per = areas(score_table(df, score, target, [cohort]), [cohort])
    red = df.groupBy(cohort).agg(
        F.avg((F.col(score) >= THRESHOLDS.red_alert).cast("int")).alias("part_alerte_rouge")
    )
    points = 100 * (F.col("part_alerte_rouge") - reference_share)
    pr = F.col("pr_auc")
    return per.join(red, cohort).select(
        cohort,
        "n",
        "pr_auc",
        F.when(pr < THRESHOLDS.pr_auc_critical, "critique")
        .when(pr < THRESHOLDS.pr_auc_min, "comite")
        .otherwise("ok")
        .alias("alerte_pr_auc"),
        "part_alerte_rouge",
        points.alias("ecart_points"),
        (F.abs(points) > THRESHOLDS.rollback_points).alias("retour_arriere"),
    )


# --- regression ----------------------------------------------------------------------------


def regression_metrics(
    df: DataFrame, truth: str = "y", pred: str = "yhat", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, n, rmse, mae, r2, n_non_positives)."""
    gap = F.col(truth) - F.col(pred)
    per = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.var_pop(F.col(truth).cast("double")).alias("v"),
        F.count_if(F.col(pred) <= 0).alias("n_non_positives"),
    )
    return per.select(
        *keys,
        "n",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.try_divide("mse", "v")).alias("r2"),
        "n_non_positives",
    )


def select_value_model(results: DataFrame, baseline: str, model: str = "modele") -> DataFrame:
    """Adds conformity against the baseline and marks the best conforming model."""
    reference = results.where(F.col(model) == baseline).select(F.col("mae").alias("_mae"))
    judged = results.crossJoin(F.broadcast(reference)).withColumn(
        "gain_mae", 1 - F.try_divide("mae", "_mae")
    )
    conforming = (
        (F.col("r2") >= THRESHOLDS.value_r2_min)
        & (F.col("gain_mae") >= THRESHOLDS.value_mae_gain_min)
        & (F.col("r2") <= THRESHOLDS.value_r2_leak)
        & (F.col("n_non_positives") == 0)
    )
    judged = judged.withColumn("conforme", conforming).drop("_mae")
    best = judged.where("conforme").agg(F.max_by(model, "r2").alias("_best"))
    return (
        judged.crossJoin(F.broadcast(best))
        .withColumn("champion", maths.is_true(F.col(model) == F.col("_best")))
        .drop("_best")
    )


def error_of_large_accounts(
    df: DataFrame, truth: str = "y", pred: str = "yhat", q: float = 0.9
) -> DataFrame:
    edge = quantile_row(df, truth, [q]).select(F.col("q")[0].alias("seuil"))
    gap = F.abs(F.col(truth) - F.col(pred))
    return df.crossJoin(edge).groupBy("seuil").agg(
        F.avg(gap).alias("mae"),
        F.avg(F.when(F.col(truth) >= F.col("seuil"), gap)).alias("mae_gros_comptes"),
        F.count_if(F.col(pred) <= 0).alias("n_non_positives"),
    )

