"""Nightly scoring and retraining jobs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators import economics, features, many, metrics, ml
from tenura.operators.splits import repeated_stratified_folds, stratified_split
from tenura.params import THRESHOLDS
from tenura.sources.files import materialise, publish_scores


def score_accounts(
    df: DataFrame, scorer: ml.LogisticScorer, watch: float, key: str, mrr: str
) -> DataFrame:
    """Published columns plus the three main reasons; the model is applied once, to a written table."""
    explained = scorer.score_and_explain(df).select(
        F.col(key).alias("id"), "p", F.col(mrr).cast("double").alias("mrr"), "facteurs"
    )
    explained = materialise(explained, "scored")
    decided = economics.decide(explained, watch)
    reasons = explained.select(
        F.col("id").alias("client_id"),
        *[F.get("facteurs", F.lit(i))["libelle"].alias(f"facteur_{i + 1}") for i in range(3)],
    )
    return decided.join(reasons, "client_id")


def account_sheets(
    df: DataFrame, scorer: ml.LogisticScorer, watch: float, key: str, mrr: str,
    actions: dict[str, str], otherwise: str,
) -> DataFrame:
    """One sheet per account: level, value, factors for and against, suggested action."""
    x = ml.vector_to_array("features")
    raw = ml.vector_to_array("rawPrediction")[1] - scorer.correction
    original = F.struct(*[F.col(c) for c in df.columns])
    ready = (
        scorer.features(df.withColumn("_row", original))
        .withColumn("_c", ml.linear_contributions(x, scorer.coefficients, scorer.means))
        .withColumn("p", 1.0 / (1.0 + F.exp(-raw)))
    )
    risk = ml.top_factors(F.col("_c"), scorer.names, 3, "_row")
    shield = ml.top_factors(F.col("_c"), scorer.names, 2, "_row", sign=-1)
    sheet = ready.select(
        key,
        F.bround("p", 4).alias("proba_churn"),
        economics.risk_level(F.col("p"), watch).alias("niveau_risque"),
        F.bround(economics.value_at_risk(F.col("p"), F.coalesce(mrr, F.lit(0.0))), 2).alias(
            "valeur_risque_eur"
        ),
        risk.alias("facteurs_churn"),
        shield.alias("facteurs_protection"),
    )
    dominant = F.coalesce(
        F.get("facteurs_churn", F.lit(0))["variable"],
        F.get("facteurs_protection", F.lit(0))["variable"],
    )
    return sheet.withColumn("action_preventive", ml.preventive_action(dominant, actions, otherwise))


def nightly_scoring(
    gold: DataFrame,
    scorer: ml.LogisticScorer,
    watch: float,
    path: str,
    date_ref: str,
    force: bool = False,
    key: str = "client_id",
    mrr: str = "revenu_mensuel_recurrent_eur",
    denied: Sequence[str] = ("churn", "sante_compte_fin_periode", "valeur_vie_client_eur"),
) -> DataFrame:
    """Score, publish one date with its summary, return the summary; a published date is left alone.

    Columns that must not enter a score (identifiers, outcomes, suspected leaks) go first.
    """
    check_contract(gold, scorer)
    allowed = [c for c in gold.columns if c not in denied]
    scores = materialise(score_accounts(gold.select(*allowed), scorer, watch, key, mrr), "nightly")
    publish_scores(scores, path, date_ref, force, summary=economics.score_summary(scores))
    published = gold.sparkSession.read.parquet(path).where(F.col("date_ref") == date_ref)
    return economics.score_summary(published)


def retrain(
    df: DataFrame, label: str, key: str, champion_pr_auc: float | None = None, seed: int = 42,
    least: float = THRESHOLDS.pr_auc_min,
) -> tuple[ml.LogisticScorer, DataFrame]:
    """Split, out-of-fold threshold, fit, evaluate on held rows, gate.

    The gate asks for the minimum PR-AUC and no clear loss against the champion. The folds' models are fitted together.
    """
    split = materialise(stratified_split(df, label, key, seed=seed), "retrain")
    train = split.where("part = 'train'").drop("part")
    test = split.where("part = 'test'").drop("part")
    numeric, categorical = ml.default_inputs(train, label, key)
    folds = materialise(repeated_stratified_folds(train, label, key), "retrain-folds")  # encoding reads them once for each label column
    encoded = many.encode(folds, label, key, numeric, categorical, ["pli_0"])
    scored = many.held_out_scores(encoded, many.fit(encoded, many.fold_specs(["pli_0"], 5)))
    watch = metrics.threshold_for_recall(scored.select("y", "p")).first()["seuil"]
    scorer = ml.fit_logistic(train, label, numeric, categorical)
    held = scorer.score(test).select(F.col(label).alias("y"), "p")
    report = metrics.metrics_at(held, watch).withColumn("seuil", F.lit(watch))
    if champion_pr_auc is not None:
        least = max(least, champion_pr_auc - THRESHOLDS.promotion_tolerance)
    return scorer, report.withColumn("promu", F.col("pr_auc") >= least)


# --- stored models -------------------------------------------------------------------------


def save_model(scorer: ml.LogisticScorer, report: DataFrame, path: str) -> None:
    """Store the fitted pipeline with its threshold, metrics and column contract under a new `path`.

    A model that the gate of its report refuses is not stored. The card is written last, so a folder without one
    holds no model.
    """
    row = report.first()
    if not row["promu"]:
        raise ValueError(f"the gate refuses this model: PR-AUC {row['pr_auc']:.4f}")
    spark = report.sparkSession
    scorer.model.write().save(f"{path}/pipeline")
    card = {
        "seuil": row["seuil"], "pr_auc": row["pr_auc"], "roc_auc": row["roc_auc"], "names": scorer.names,
        "numeric": scorer.numeric, "categorical": scorer.categorical, "coefficients": scorer.coefficients,
        "intercept": scorer.intercept, "correction": scorer.correction, "means": scorer.means,
    }
    spark.createDataFrame([(json.dumps(card),)], "card string").coalesce(1).write.parquet(f"{path}/card")


def load_model(spark: SparkSession, path: str) -> tuple[ml.LogisticScorer, float]:
    """(scorer, threshold) of a stored model."""
    card = json.loads(spark.read.parquet(f"{path}/card").first()["card"])
    scorer = ml.LogisticScorer(
        model=PipelineModel.load(f"{path}/pipeline"), names=[(c, level) for c, level in card["names"]],
        **{k: card[k] for k in ("numeric", "categorical", "coefficients", "intercept", "correction", "means")},
    )
    return scorer, card["seuil"]


def check_contract(df: DataFrame, scorer: ml.LogisticScorer) -> None:
    """Raise where a column of the model is absent, or a number of it is text."""
    kinds = dict(df.dtypes)
    absent = [c for c in (*scorer.numeric, *scorer.categorical) if c not in kinds]
    text = [c for c in scorer.numeric if kinds.get(c) == "string"]
    if absent or text:
        raise ValueError(f"the model's columns do not fit: absent {absent}, text instead of numbers {text}")


def score_requests(requests: DataFrame, scorer: ml.LogisticScorer, catalogue: DataFrame, watch: float):
    """Batch or streaming requests to probability, decision, value and messages."""
    enriched = features.request_features(requests, catalogue)
    marked = enriched.withColumns(
        {"champs_imputes": features.imputed_fields(), "signaux": features.risk_signals()}
    )
    scored = scorer.score(marked)
    mrr = F.col("revenu_mensuel_recurrent_eur").cast("double")
    return scored.withColumns(
        {
            "decision": economics.risk_level(F.col("p"), watch),
            "valeur_a_risque_eur": F.bround(economics.value_at_risk(F.col("p"), mrr), 2),
        }
    )
