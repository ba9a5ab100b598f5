"""Queries of model evaluation over the pseudo-score of the account view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import bootstrap, metrics
from tenura.plans.accounts import accounts
from tenura.queries.exploration import rounded
from tenura.queries.registry import query
from tenura.queries.twins import ACC, auc_ctes

S = ACC + ", s AS (SELECT client_id AS id, churn AS y, p, revenu_mensuel_recurrent_eur AS mrr, k FROM accounts)"
NUMERIC = ("anciennete_mois", "sieges_souscrits", "csat", "tickets_support_90j", "retards_paiement_12m")
ATTRIBUTES = ("pays", "taille_entreprise", "secteur")


def scored(spark, folder):
    """(id, y, p, mrr, k): the decision sample, aligned by key."""
    return accounts(spark, folder).select(
        F.col("client_id").alias("id"),
        F.col("churn").alias("y"),
        "p",
        F.col("revenu_mensuel_recurrent_eur").alias("mrr"),
        "k",
    )


def curve_ctes(source: str = "s", keys: str = "") -> str:
    """CTE cu(keys, seuil, n, pos, n_upto, pos_upto, total, positifs)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""ct AS (SELECT {k}p AS seuil, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY {k}p),
    cu AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS n_upto, CAST(sum(pos) OVER w AS DOUBLE) AS pos_upto,
      CAST(sum(n) OVER ({part}) AS DOUBLE) AS total, CAST(sum(pos) OVER ({part}) AS DOUBLE) AS positifs
      FROM ct WINDOW w AS ({part} ORDER BY seuil DESC ROWS UNBOUNDED PRECEDING))"""


@query("roc_curve", f"""{S}, {curve_ctes()} SELECT seuil, round((n_upto - pos_upto) / (total - positifs), 6) AS fpr,
  round(pos_upto / positifs, 6) AS tpr FROM cu""")
def roc_curve(spark, folder):
    table = metrics.score_table(scored(spark, folder))
    return rounded(metrics.roc_curve(table), "fpr", "tpr")


@query("pr_curve", f"""{S}, {curve_ctes()} SELECT seuil, round(pos_upto / n_upto, 6) AS precision,
  round(pos_upto / positifs, 6) AS rappel FROM cu""")
def pr_curve(spark, folder):
    table = metrics.score_table(scored(spark, folder))
    return rounded(metrics.pr_curve(table), "precision", "rappel")


_AREAS = """ar AS (SELECT {k} CAST(max(total) AS BIGINT) AS n, CAST(max(positifs) AS BIGINT) AS positifs,
  sum((fp_upto - fp_before) * (pos_upto + pos_before) / 2) / (max(positifs) * (max(total) - max(positifs))) AS roc_auc,
  sum((pos_upto - pos_before) / positifs * pos_upto / n_upto) AS pr_auc FROM (SELECT *, n_upto - pos_upto AS fp_upto,
    coalesce(lag(pos_upto) OVER ({p} ORDER BY seuil DESC), 0) AS pos_before,
    coalesce(lag(n_upto - pos_upto) OVER ({p} ORDER BY seuil DESC), 0) AS fp_before FROM cu) {g})"""
AREAS = _AREAS.format(k="", p="", g="")


@query("areas", f"{S}, {curve_ctes()}, {AREAS} SELECT n, positifs, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM ar")
def areas(spark, folder):
    table = metrics.score_table(scored(spark, folder))
    return rounded(metrics.areas(table), "roc_auc", "pr_auc")


@query(
    "confusion",
    S + """, c AS (SELECT count(*) FILTER (y = 0 AND p < 0.2) AS vn, count(*) FILTER (y = 0 AND p >= 0.2) AS fp,
      count(*) FILTER (y = 1 AND p < 0.2) AS fn, count(*) FILTER (y = 1 AND p >= 0.2) AS vp, count(*) AS t FROM s)
    SELECT vn, fp, fn, vp, round(100.0 * vn / CAST(t AS DOUBLE), 6) AS vn_pct, round(100.0 * fp / CAST(t AS DOUBLE), 6) AS fp_pct,
      round(100.0 * fn / CAST(t AS DOUBLE), 6) AS fn_pct, round(100.0 * vp / CAST(t AS DOUBLE), 6) AS vp_pct FROM c""",
)
def confusion(spark, folder):
    out = metrics.confusion(scored(spark, folder), F.col("p") >= 0.2)
    return rounded(out, "vn_pct", "fp_pct", "fn_pct", "vp_pct")


_EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10))


@query(
    "calibration_curve",
    S + f""", e AS (SELECT [{_EDGES}] AS q FROM s),
    b AS (SELECT s.*, len(list_filter(q, lambda x: x < p)) AS bin FROM s, e)
    SELECT bin, count(*) AS n, round(avg(p), 6) AS proba_moyenne, round(avg(y), 6) AS taux_observe FROM b GROUP BY bin""",
)
def calibration_curve(spark, folder):
    out = metrics.calibration_curve(scored(spark, folder))
    return rounded(out, "proba_moyenne", "taux_observe")


@query("brier", S + " SELECT round(avg(power(p - y, 2)), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS brier_reference FROM s")
def brier(spark, folder):
    return rounded(metrics.brier(scored(spark, folder)), "brier", "brier_reference")


@query(
    "metrics_at",
    f"""{S}, {curve_ctes()}, {AREAS}, m AS (SELECT CAST(count(*) FILTER (p >= 0.2 AND y = 1) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (p >= 0.2 AND y = 0) AS DOUBLE) AS fp, CAST(sum(y) AS DOUBLE) AS pp, count(*) AS n,
      avg(power(p - y, 2)) AS b FROM s)
    SELECT round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(tp / (tp + fp), 6) AS precision,
      round(tp / pp, 6) AS rappel, round(2 * tp / (tp + fp + pp), 6) AS f1,
      round((m.n - pp - fp) / (m.n - pp), 6) AS specificite, round(b, 6) AS brier, round((tp + fp) / m.n, 6) AS part_signalee
    FROM m, ar""",
)
def metrics_at(spark, folder):
    out = metrics.metrics_at(scored(spark, folder), 0.2)
    return rounded(out, *out.columns)


@query("bootstrap_metrics")
def bootstrap_metrics(spark, folder):
    return bootstrap.bootstrap_metrics(scored(spark, folder), 0.2, "id")


_DRAWS = 200
_WEIGHTS = " + ".join(f"CAST(u >= {c!r} AS INT)" for c in bootstrap.POISSON.tolist())


@query(
    "bootstrap_intervals",
    f"""{S}, u AS (SELECT id, y, p, b, ((k * 7919 + b * 104729 + (k % 89 + 1) * (b % 97 + 1) * 31) % 100003) / 100003.0::DOUBLE AS u
      FROM s, range(1, {_DRAWS + 1}) t(b)), w AS (SELECT *, {_WEIGHTS} AS w FROM u),
    g AS (SELECT b, p, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * y) AS DOUBLE) AS pos FROM w GROUP BY b, p),
    c AS (SELECT *, sum(n) OVER o AS nu, sum(pos) OVER o AS pu FROM g WINDOW o AS (PARTITION BY b ORDER BY p DESC)),
    d AS (SELECT b, sum(pos) AS pos, sum(n) AS n, sum((n - pos) * (pu - pos / 2)) AS roc, sum(CASE WHEN nu > 0 THEN pos * pu / nu ELSE 0 END) AS pr,
      sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) AS sq, sum(CASE WHEN p >= 0.2 THEN pos ELSE 0 END) AS tp,
      sum(CASE WHEN p >= 0.2 THEN n - pos ELSE 0 END) AS fp FROM c GROUP BY b),
    m AS (SELECT pr / pos AS pr_auc, roc / (pos * (n - pos)) AS roc_auc, sq / n AS brier, tp / pos AS rappel, tp / (tp + fp) AS precision,
      (tp + fp) / n AS part_signalee FROM d WHERE pos > 0 AND pos < n),
    l AS (UNPIVOT m ON pr_auc, roc_auc, brier, rappel, precision, part_signalee INTO NAME metrique VALUE v)
    SELECT metrique, round(quantile_cont(v, 0.025), 6) AS ic_bas, round(quantile_cont(v, 0.975), 6) AS ic_haut FROM l GROUP BY metrique""",
)
def bootstrap_intervals(spark, folder):
    """The same with draws that plain integer arithmetic can repeat."""
    out = bootstrap.bootstrap_metrics(
        scored(spark, folder), 0.2, "id", draws=_DRAWS, seeds=F.col("k"), uniform=bootstrap.portable
    )
    return rounded(out.drop("valeur"), "ic_bas", "ic_haut")


_LONG = " UNION ALL ".join(
    f"SELECT '{a}' AS attribut, coalesce(lower(trim({a})), 'inconnu') AS modalite, churn AS y, p AS v, p >= 0.2 AS d FROM accounts"
    for a in ATTRIBUTES
)
_FAIR = f"""{ACC}, long AS (SELECT *, attribut || '/' || modalite AS variable FROM ({_LONG})), {auc_ctes()},
  eq AS (SELECT attribut, modalite, count(*) AS effectif, CAST(sum(y) AS BIGINT) AS churners, avg(y) AS taux_churn_reel,
    avg(v) AS proba_moyenne, avg(CAST(d AS INT)) FILTER (y = 1) AS tpr, avg(CAST(d AS INT)) FILTER (y = 0) AS fpr,
    max(auc) AS roc_auc, avg(v) - avg(y) AS ecart_calibration, sum(y) >= 15 AS interpretable
    FROM long JOIN auc USING (variable) GROUP BY attribut, modalite)"""


@query(
    "fairness_by_group",
    _FAIR + " SELECT attribut, modalite, effectif, churners, interpretable, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in
        ("taux_churn_reel", "proba_moyenne", "tpr", "fpr", "roc_auc", "ecart_calibration")) + " FROM eq",
)
def fairness_by_group(spark, folder):
    out = metrics.fairness_by_group(
        accounts(spark, folder), ATTRIBUTES, 0.2, target="churn", min_positives=15
    )
    return rounded(out, "taux_churn_reel", "proba_moyenne", "tpr", "fpr", "roc_auc", "ecart_calibration")


@query(
    "fairness_review",
    _FAIR + """ SELECT attribut, round(max(tpr) - min(tpr), 6) AS ecart_tpr, arg_min(modalite, (tpr, modalite)) AS moins_detectee,
      round(min(roc_auc), 6) AS roc_auc_min, round(max(abs(ecart_calibration)), 6) AS ecart_calibration_max,
      max(tpr) - min(tpr) > 0.15 OR max(abs(ecart_calibration)) > 0.05 AS revue_requise
    FROM eq WHERE interpretable GROUP BY attribut""",
)
def fairness_review(spark, folder):
    by_group = metrics.fairness_by_group(
        accounts(spark, folder), ATTRIBUTES, 0.2, target="churn", min_positives=15
    )
    out = metrics.fairness_review(by_group)
    return rounded(out, "ecart_tpr", "roc_auc_min", "ecart_calibration_max")


_SEG = """, g AS (SELECT *, CASE WHEN churn = 1 AND p < 0.2 THEN 'FN' WHEN churn = 0 AND p >= 0.2 THEN 'FP'
  WHEN churn = 1 THEN 'VP' ELSE 'VN' END AS segment FROM accounts)"""


@query(
    "error_segments",
    ACC + _SEG + " SELECT segment, count(*) AS n, round(avg(p), 6) AS proba_moyenne, "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in NUMERIC) + " FROM g GROUP BY segment",
)
def error_segments(spark, folder):
    out = metrics.error_segments(accounts(spark, folder), F.lit(0.2), NUMERIC, target="churn")
    return rounded(out, "proba_moyenne", *NUMERIC)


@query(
    "error_level_shares",
    ACC + _SEG + ", l AS (" + " UNION ALL ".join(
        f"SELECT segment, '{c}' AS colonne, {c} AS niveau FROM g WHERE {c} IS NOT NULL" for c in ("plan", "pays")
    ) + """) SELECT segment, colonne, niveau, count(*) AS n,
      round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY segment, colonne) AS DOUBLE), 6) AS part
    FROM l GROUP BY segment, colonne, niveau""",
)
def error_level_shares(spark, folder):
    out = metrics.error_level_shares(accounts(spark, folder), F.lit(0.2), ["plan", "pays"], target="churn")
    return rounded(out, "part")


@query(
    "standardised_gap",
    ACC + _SEG + " SELECT variable, round(ecart, 6) AS ecart FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, (avg({c}) FILTER (segment = 'FN') - avg({c}) FILTER (segment = 'VP')) "
        f"/ stddev_samp({c}) AS ecart FROM g" for c in NUMERIC
    ) + ") ORDER BY abs(ecart) DESC, variable LIMIT 3",
)
def standardised_gap(spark, folder):
    out = metrics.standardised_gap(accounts(spark, folder), F.lit(0.2), NUMERIC, top=3, target="churn")
    return rounded(out, "ecart")


def recall_sql(keys: str = "", recall: float = 0.8) -> str:
    """SELECT of the threshold for a recall, from cu."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}max(seuil) AS seuil, arg_max(pos_upto / positifs, seuil) AS recall,
      arg_max(pos_upto / n_upto, seuil) AS precision, arg_max(n_upto / total, seuil) AS part_signalee,
      CAST(arg_max(n_upto, seuil) AS BIGINT) AS n_signales,
      CAST(arg_max(positifs - pos_upto, seuil) AS BIGINT) AS n_faux_negatifs
    FROM cu WHERE pos_upto / positifs >= {recall} - 1e-12 {g}"""


@query(
    "threshold_for_recall",
    f"{S}, {curve_ctes()}, t AS ({recall_sql()}) SELECT seuil, round(recall, 6) AS recall, "
    "round(precision, 6) AS precision, round(part_signalee, 6) AS part_signalee, n_signales, n_faux_negatifs FROM t",
)
def threshold_for_recall(spark, folder):
    out = metrics.threshold_for_recall(scored(spark, folder))
    return rounded(out, "recall", "precision", "part_signalee")


@query(
    "threshold_stability",
    f"""{S}, f AS (SELECT s.*, CAST(k % 5 AS INT) AS fold FROM s), ex AS (SELECT f.y, f.p, t.pli FROM f
      JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS pli) t ON fold <> pli),
    {curve_ctes("ex", "pli")}, t AS ({recall_sql("pli")})
    SELECT pli, seuil, round(avg(CAST(p >= seuil AS INT)) FILTER (y = 1), 6) AS recall_tenu
    FROM f JOIN t ON fold = pli GROUP BY pli, seuil""",
)
def threshold_stability(spark, folder):
    folded = scored(spark, folder).withColumn("fold", (F.col("k") % 5).cast("int"))
    out = metrics.threshold_stability(folded, "fold", 5)
    return rounded(out, "recall_tenu")


@query(
    "cohort_alert",
    ACC + """, s AS (SELECT taille_entreprise, churn AS y, p FROM accounts), """
    + curve_ctes("s", "taille_entreprise") + ", "
    + _AREAS.format(k="taille_entreprise,", p="PARTITION BY taille_entreprise", g="GROUP BY taille_entreprise")
    + """, r AS (SELECT taille_entreprise, avg(CAST(p >= 0.6 AS INT)) AS r FROM s GROUP BY 1)
    SELECT taille_entreprise, n, round(pr_auc, 6) AS pr_auc, CASE WHEN pr_auc < 0.6 THEN 'critique' WHEN pr_auc < 0.65
      THEN 'comite' ELSE 'ok' END AS alerte_pr_auc, round(r, 6) AS part_alerte_rouge,
      round(100 * (r - 0.05), 6) AS ecart_points, abs(100 * (r - 0.05)) > 10 AS retour_arriere
    FROM ar JOIN r USING (taille_entreprise)""",
)
def cohort_alert(spark, folder):
    out = metrics.cohort_alert(
        accounts(spark, folder), "taille_entreprise", 0.05, target="churn"
    )
    return rounded(out, "pr_auc", "part_alerte_rouge", "ecart_points")


# two simple predictions of the account value stand in for models
_PRED = """, v AS (SELECT valeur_vie_client_eur AS y, revenu_mensuel_recurrent_eur * fonctionnalites_utilisees * 10 AS a,
  CAST(120000 AS DOUBLE) AS b FROM accounts WHERE valeur_vie_client_eur IS NOT NULL AND revenu_mensuel_recurrent_eur IS NOT NULL),
 l AS (SELECT 'usage' AS modele, y, a AS yhat FROM v UNION ALL SELECT 'constante', y, b FROM v),
 m AS (SELECT modele, count(*) AS n, sqrt(avg(power(y - yhat, 2))) AS rmse, avg(abs(y - yhat)) AS mae,
   1 - avg(power(y - yhat, 2)) / var_pop(y) AS r2, count(*) FILTER (yhat <= 0) AS n_non_positives FROM l GROUP BY modele)"""


def _predictions(spark, folder):
    df = accounts(spark, folder).where(
        "valeur_vie_client_eur IS NOT NULL AND revenu_mensuel_recurrent_eur IS NOT NULL"
    )
    usage = F.col("revenu_mensuel_recurrent_eur") * F.col("fonctionnalites_utilisees") * 10
    pairs = F.array(
        F.struct(F.lit("usage").alias("modele"), usage.alias("yhat")),
        F.struct(F.lit("constante").alias("modele"), F.lit(120000.0).alias("yhat")),
    )
    return df.select(F.col("valeur_vie_client_eur").alias("y"), F.explode(pairs).alias("m")).select(
        "y", "m.modele", "m.yhat"
    )


@query(
    "regression_metrics",
    ACC + _PRED + " SELECT modele, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, n_non_positives FROM m",
)
def regression_metrics(spark, folder):
    out = metrics.regression_metrics(_predictions(spark, folder), keys=["modele"])
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2")


@query(
    "select_value_model",
    ACC + _PRED + """, j AS (SELECT *, 1 - mae / (SELECT mae FROM m WHERE modele = 'constante') AS gain FROM m)
    SELECT modele, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, n_non_positives,
      round(gain, 6) AS gain_mae, r2 >= 0.5 AND gain >= 0.3 AND r2 <= 0.99 AND n_non_positives = 0 AS conforme,
      coalesce(modele = (SELECT arg_max(modele, r2) FROM j WHERE r2 >= 0.5 AND gain >= 0.3 AND r2 <= 0.99
        AND n_non_positives = 0), false) AS champion FROM j""",
)
def select_value_model(spark, folder):
    results = metrics.regression_metrics(_predictions(spark, folder), keys=["modele"])
    out = metrics.select_value_model(results, "constante")
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2", "gain_mae")


@query(
    "error_of_large_accounts",
    ACC + _PRED + """, u AS (SELECT y, a, quantile_cont(y, 0.9) OVER () AS q FROM v)
    SELECT round(q, 4) AS seuil, round(avg(abs(y - a)), 4) AS mae,
      round(avg(abs(y - a)) FILTER (y >= q), 4) AS mae_gros_comptes, count(*) FILTER (a <= 0) AS n_non_positives
    FROM u GROUP BY q""",
)
def error_of_large_accounts(spark, folder):
    usage = _predictions(spark, folder).where("modele = 'usage'")
    out = metrics.error_of_large_accounts(usage)
    return rounded(out, "seuil", "mae", "mae_gros_comptes", digits=4)
