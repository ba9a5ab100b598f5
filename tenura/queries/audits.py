"""Queries of the leakage and decoy audit and of drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import drift, leakage
from tenura.operators.economics import risk_level
from tenura.plans.accounts import DECOYS, NUMERIC, accounts
from tenura.queries.exploration import rounded
from tenura.queries.registry import query
from tenura.queries.twins import ACC, auc_ctes, binary_chi2_ctes, levels_sql, long_sql
from tenura.sources.tables import table

SCANNED_NUM = (*NUMERIC, "sante_compte_fin_periode")
SCANNED_CAT = ("commentaire_csm", "secteur", "plan", *DECOYS)


@query(
    "leak_scan",
    f"""{ACC}, lv AS ({levels_sql("accounts", SCANNED_CAT)}),
    enc AS (SELECT l.variable, pos / CAST(n AS DOUBLE) AS v, a.y FROM lv l JOIN
      ({long_sql("accounts", SCANNED_CAT, "churn AS y", "VARCHAR")}) a ON a.variable = l.variable AND a.v = l.niveau),
    long AS ({long_sql("accounts", SCANNED_NUM)} UNION ALL SELECT variable, v, y FROM enc), {auc_ctes()}
    SELECT variable AS colonne, CASE WHEN variable IN ({", ".join(f"'{c}'" for c in SCANNED_CAT)}) THEN 'categorielle'
      ELSE 'numerique' END AS type, round(greatest(auc, 1 - auc), 4) AS auc_univariee,
      CASE WHEN variable IN ({", ".join(f"'{c}'" for c in SCANNED_CAT)}) THEN '-' WHEN auc >= 0.5 THEN 'hausse'
      ELSE 'baisse' END AS sens, round(1 - n / CAST((SELECT count(*) FROM accounts) AS DOUBLE), 6) AS part_manquants,
      greatest(auc, 1 - auc) >= 0.85 AS suspecte_fuite FROM auc WHERE n >= 50 AND auc IS NOT NULL""",
)
def leak_scan(spark, folder):
    out = leakage.leak_scan(
        accounts(spark, folder), "churn", SCANNED_NUM, SCANNED_CAT
    )
    return rounded(out, "part_manquants")


def eta_sql(cat: str, num: str, source: str = "accounts") -> str:
    return (
        f"(SELECT CASE WHEN max(st) > 0 THEN sqrt(least(1, sum(ng * power(mg - m, 2)) / max(st))) ELSE 0 END FROM "
        f"(SELECT {cat}, count(*) AS ng, avg({num}) AS mg FROM {source} WHERE {cat} IS NOT NULL AND {num} IS NOT NULL GROUP BY 1) "
        f"CROSS JOIN (SELECT avg({num}) AS m, var_pop({num}) * count(*) AS st FROM {source} WHERE {cat} IS NOT NULL AND {num} IS NOT NULL))"
    )


@query(
    "correlation_ratio",
    f"""{ACC} SELECT 'commentaire_csm' AS categorie, 'heures_usage_30j' AS nombre,
      count(*) FILTER (commentaire_csm IS NOT NULL AND heures_usage_30j IS NOT NULL) AS n,
      count(DISTINCT commentaire_csm) AS niveaux,
      round({eta_sql("commentaire_csm", "heures_usage_30j")}, 6) AS eta FROM accounts""",
)
def correlation_ratio(spark, folder):
    out = leakage.correlation_ratio(accounts(spark, folder), "commentaire_csm", "heures_usage_30j")
    return rounded(out, "eta")


# screened columns: the decoys and a noisy copy of the tenure; references as below
_REF_NUM = ("anciennete_mois", "connexions_30j", "csat")
_REF_CAT = ("taille_entreprise", "plan")
_COPY = "anciennete_mois * 3 + k % 5"


def v_scalar(a: str, b: str, source: str = "w") -> str:
    """Scalar subquery: Yates-corrected V of two columns."""
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    shrink = "CASE WHEN r = 2 AND c = 2 THEN least(0.5, abs(o - e)) ELSE 0 END"
    return f"""(SELECT sqrt(sum(power(abs(o - e) - {shrink}, 2) / e) / (max(n) * (least(max(r), max(c)) - 1))) FROM
      (SELECT coalesce(o, 0) AS o, na * nb / CAST(n AS DOUBLE) AS e, n,
        (SELECT count(DISTINCT {a}) FROM {source} WHERE {both}) AS r, (SELECT count(DISTINCT {b}) FROM {source} WHERE {both}) AS c
       FROM (SELECT {a} AS a, count(*) AS na FROM {source} WHERE {both} GROUP BY 1)
       CROSS JOIN (SELECT {b} AS b, count(*) AS nb FROM {source} WHERE {both} GROUP BY 1)
       LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {both} GROUP BY 1, 2) USING (a, b)
       CROSS JOIN (SELECT count(*) AS n FROM {source} WHERE {both})))"""


def _redundancy_sql() -> str:
    rows = [f"SELECT 'copie' AS colonne, '{r}' AS jumelle, abs(corr(copie, {r})) AS v, '|r| Pearson' AS m FROM w"
            for r in _REF_NUM]
    rows += [f"SELECT 'copie', '{c}', {eta_sql(c, 'copie', 'w')}, 'eta'" for c in _REF_CAT]
    for d in DECOYS:
        rows += [f"SELECT '{d}', '{r}', {eta_sql(d, r, 'w')}, 'eta'" for r in _REF_NUM]
        rows += [f"SELECT '{d}', '{c}', {v_scalar(d, c)}, 'V de Cramér'" for c in _REF_CAT]
    return f"""w AS (SELECT *, {_COPY} AS copie FROM accounts), pairs AS ({" UNION ALL ".join(rows)}),
    best AS (SELECT colonne, max(v) AS max_redondance, arg_max(jumelle, v) AS variable_jumelle,
      arg_max(m, v) AS mesure_redondance FROM pairs WHERE v > 0 GROUP BY colonne)"""


@query(
    "max_redundancy",
    f"{ACC}, {_redundancy_sql()} SELECT colonne, round(max_redondance, 6) AS max_redondance, variable_jumelle, "
    "mesure_redondance FROM best",
)
def max_redundancy(spark, folder):
    df = accounts(spark, folder).withColumn("copie", F.expr(_COPY))
    return rounded(leakage.max_redundancy(df, ["copie"], DECOYS, _REF_NUM, _REF_CAT), "max_redondance")


@query(
    "screen_decoys",
    f"""{ACC}, {_redundancy_sql()}, long AS ({long_sql("w", ["copie"])}), {auc_ctes()},
    lv AS ({levels_sql("accounts", DECOYS)}), {binary_chi2_ctes()},
    po AS (SELECT variable AS colonne, 'numerique' AS type, greatest(auc, 1 - auc) AS association, z AS statistique,
      CAST(0 AS BIGINT) AS ddl FROM auc UNION ALL
      SELECT variable, 'categorielle', v_cramer, chi2, CAST(ddl AS BIGINT) FROM chi)
    SELECT colonne, type, round(association, 6) AS association, round(statistique, 6) AS statistique, ddl,
      round(max_redondance, 6) AS max_redondance, variable_jumelle, mesure_redondance FROM po JOIN best USING (colonne)""",
)
def screen_decoys(spark, folder):
    df = accounts(spark, folder).withColumn("copie", F.expr(_COPY))
    out = leakage.screen_decoys(
        df, "churn", ["copie"], DECOYS, _REF_NUM, _REF_CAT, with_p=False
    )
    return rounded(out, "association", "statistique", "max_redondance")


@query("screen_decoys_verdict")
def screen_decoys_verdict(spark, folder):
    df = accounts(spark, folder).withColumn("copie", F.expr(_COPY))
    return leakage.screen_decoys(
        df, "churn", ["copie"], DECOYS, _REF_NUM, _REF_CAT
    )


def _mid(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "lifetime_value_nature",
    ACC + f""", r AS (SELECT valeur_vie_client_eur AS v, CAST(anciennete_mois AS DOUBLE) AS t,
      revenu_mensuel_recurrent_eur AS m, churn AS y FROM accounts WHERE valeur_vie_client_eur IS NOT NULL
      AND anciennete_mois IS NOT NULL AND revenu_mensuel_recurrent_eur IS NOT NULL),
    g AS (SELECT ln(v) AS lv, ln(t) AS lt, ln(m) AS lm FROM r WHERE v > 0 AND t > 0 AND m > 0),
    c AS (SELECT var_pop(lm) AS smm, var_pop(lt) AS stt, covar_pop(lm, lt) AS smt, covar_pop(lm, lv) AS smv,
      covar_pop(lt, lv) AS stv FROM g),
    e AS (SELECT (stt * smv - smt * stv) / (smm * stt - smt * smt) AS em,
      (smm * stv - smt * smv) / (smm * stt - smt * smt) AS ea FROM c),
    rk AS (SELECT {_mid("v / m")} AS ra, {_mid("y")} AS rb FROM r),
    b AS (SELECT count(*) AS n, corr(v, t) AS ra, corr(v, m) AS rm, corr(v, m * t) AS rx,
      avg(CAST(v > m * t AS INT)) AS share, quantile_cont(CASE WHEN m * t <> 0 THEN v / (m * t) END, 0.5) AS med,
      quantile_cont(v / m, 0.05) AS p05, quantile_cont(v / m, 0.5) AS p50, quantile_cont(v / m, 0.95) AS p95 FROM r)
    SELECT n, round(ra, 6) AS r_anciennete, round(rm, 6) AS r_mrr, round(rx, 6) AS r_mrr_x_anciennete,
      round(share, 6) AS part_clv_sup_cumul, round(med, 6) AS ratio_cumul_median, round(em, 6) AS elasticite_mrr,
      round(ea, 6) AS elasticite_anciennete, round(p05, 6) AS mois_mrr_p05, round(p50, 6) AS mois_mrr_p50,
      round(p95, 6) AS mois_mrr_p95, round((SELECT corr(ra, rb) FROM rk), 6) AS rho_mois_churn,
      CASE WHEN share <= 0.1 AND ea >= 0.7 THEN 'realisee' WHEN share >= 0.5 AND ea < 0.5 THEN 'prospective'
      ELSE 'indeterminee' END AS nature_clv FROM b, e""",
)
def lifetime_value_nature(spark, folder):
    out = leakage.lifetime_value_nature(accounts(spark, folder))
    return rounded(out, *[c for c in out.columns if c not in ("n", "nature_clv")])


@query("lifetime_value_p_values")
def lifetime_value_p_values(spark, folder):
    nature = leakage.lifetime_value_nature(accounts(spark, folder))
    return leakage.lifetime_value_p_values(nature)


@query(
    "lifetime_value_by_class",
    ACC + """ SELECT churn, count(*) AS n, round(avg(valeur_vie_client_eur), 4) AS clv_moyenne,
      round(quantile_cont(valeur_vie_client_eur, 0.5), 4) AS clv_mediane,
      round(quantile_cont(revenu_mensuel_recurrent_eur, 0.5), 4) AS mrr_median FROM accounts
    WHERE valeur_vie_client_eur IS NOT NULL AND revenu_mensuel_recurrent_eur IS NOT NULL GROUP BY churn""",
)
def lifetime_value_by_class(spark, folder):
    out = leakage.lifetime_value_by_class(accounts(spark, folder))
    return rounded(out, "clv_moyenne", "clv_mediane", "mrr_median", digits=4)


# evidence tables for the verdict, one row per country: every figure is derived from the accounts
_EVIDENCE = """, ev AS (SELECT pays AS colonne, avg(churn) > 0.33 AS significatif_bh, avg(p) * 2 AS max_redondance,
    min(plan) AS variable_jumelle, avg(p) / 40 AS ic95_haut, avg(churn) / 40 AS delta_pr_auc,
    avg(churn) / 40 < 0.0085 AS negligeable, count(*) AS n FROM accounts WHERE pays IS NOT NULL GROUP BY pays),
  jn AS (SELECT e.colonne, significatif_bh, max_redondance, variable_jumelle, CASE WHEN n % 4 <> 0 THEN ic95_haut END AS ic,
    CASE WHEN n % 5 <> 0 THEN negligeable END AS neg FROM ev e)"""


@query(
    "decoy_verdict",
    ACC + _EVIDENCE + """ SELECT colonne, significatif_bh AS association_significative,
      coalesce(ic < 0.01, false) AS permutation_negligeable, coalesce(neg, false) AS drop_negligeable,
      round(max_redondance, 4) AS max_redondance, variable_jumelle,
      CASE WHEN coalesce(ic < 0.01, false) AND max_redondance >= 0.7 THEN 'REDONDANT'
        WHEN NOT significatif_bh AND coalesce(ic < 0.01, false) AND coalesce(neg, false) THEN 'LEURRE'
        WHEN significatif_bh OR NOT coalesce(ic < 0.01, false) THEN 'UTILE' ELSE 'AMBIGU' END AS verdict FROM jn""",
)
def decoy_verdict(spark, folder):
    evidence = accounts(spark, folder).where("pays IS NOT NULL").groupBy(F.col("pays").alias("colonne")).agg(
        (F.avg("churn") > 0.33).alias("significatif_bh"),
        (F.avg("p") * 2).alias("max_redondance"),
        F.min("plan").alias("variable_jumelle"),
        (F.avg("p") / 40).alias("ic95_haut"),
        (F.avg("churn") / 40).alias("delta_pr_auc"),
        (F.avg("churn") / 40 < 0.0085).alias("negligeable"),
        F.count("*").alias("n"),
    )
    return leakage.decoy_verdict(
        evidence, evidence.where("n % 4 <> 0"), evidence.where("n % 5 <> 0")
    )


# --- drift on events: first against second half of the period ------------------------------

WATCHED = ("value", "k", "user_id")
_EVENTS = """WITH e AS (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS user_id,
  ts < TIMESTAMP '2024-01-16 00:00:00' AS ref FROM events),
  l AS (SELECT 'value' AS variable, value * CASE WHEN ref THEN 1 ELSE 1.1 END AS v, ref FROM e UNION ALL
    SELECT 'k', k, ref FROM e UNION ALL SELECT 'user_id', user_id, ref FROM e)"""


def halves(spark, folder):
    """Reference and current half; the current values are scaled so that one column drifts."""
    events = table(spark, folder, "events").select(
        "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "user_id"
    )
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    current = events.where(F.col("ts") >= cut).withColumn("value", F.col("value") * 1.1)
    return events.where(F.col("ts") < cut), current


_PROBS = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))
_PSI = f""", q AS (SELECT variable, [{_PROBS}] AS q FROM l WHERE ref GROUP BY 1),
  ed AS (SELECT variable, list_concat(list_concat([q[1] - 1e-9], q[2:10]), [q[11] + 1e-9]) AS ed FROM q),
  b AS (SELECT l.variable, ref, CASE WHEN v = ed[11] THEN 9 ELSE len(list_filter(ed, lambda x: x <= v)) - 1 END AS bin
    FROM l JOIN ed USING (variable)),
  t AS (SELECT variable, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc,
    count(*) FILTER (NOT ref AND bin NOT BETWEEN 0 AND 9) AS oob FROM b GROUP BY 1),
  c AS (SELECT variable, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b GROUP BY 1, 2),
  bins AS (SELECT variable, i AS bin, ed[i + 1] AS borne_inf, ed[i + 2] AS borne_sup,
    greatest(coalesce(r, 0) / CAST(nr AS DOUBLE), 1e-6) AS a, greatest(coalesce(c.c, 0) / CAST(nc AS DOUBLE), 1e-6) AS k, oob
    FROM ed CROSS JOIN range(10) g(i) JOIN t USING (variable) LEFT JOIN c ON c.variable = ed.variable AND c.bin = i)"""


@query(
    "psi_bins",
    _EVENTS + _PSI + """ SELECT variable, bin, round(borne_inf, 6) AS borne_inf, round(borne_sup, 6) AS borne_sup,
      round(a, 6) AS p_reference, round(k, 6) AS p_courant, round((k - a) * ln(k / a), 6) AS psi_bin,
      oob AS n_hors_bornes FROM bins""",
)
def psi_bins(spark, folder):
    ref, cur = halves(spark, folder)
    out = drift.psi_bins(ref, cur, WATCHED)
    return rounded(out, "borne_inf", "borne_sup", "p_reference", "p_courant", "psi_bin")


@query(
    "psi",
    _EVENTS + _PSI + """, s AS (SELECT variable, sum((k - a) * ln(k / a)) AS psi, max(oob) AS o FROM bins GROUP BY 1)
    SELECT variable, round(psi, 6) AS psi, o AS n_hors_bornes, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2
      THEN 'attention' ELSE 'derive_significative' END AS interpretation FROM s""",
)
def psi(spark, folder):
    ref, cur = halves(spark, folder)
    return rounded(drift.psi(drift.psi_bins(ref, cur, WATCHED)), "psi")


_CUM = """, vc AS (SELECT variable, v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM l GROUP BY 1, 2),
  cm AS (SELECT *, sum(r) OVER w / CAST(sum(r) OVER (PARTITION BY variable) AS DOUBLE) AS f,
    sum(c) OVER w / CAST(sum(c) OVER (PARTITION BY variable) AS DOUBLE) AS g,
    CAST(sum(r) OVER (PARTITION BY variable) AS BIGINT) AS nr, CAST(sum(c) OVER (PARTITION BY variable) AS BIGINT) AS nc
    FROM vc WINDOW w AS (PARTITION BY variable ORDER BY v ROWS UNBOUNDED PRECEDING))"""


@query(
    "ks_two_sample",
    _EVENTS + _CUM + " SELECT variable, max(nr) AS n_reference, max(nc) AS n_courant, round(max(abs(f - g)), 6) AS statistique "
    "FROM cm GROUP BY variable",
)
def ks_two_sample(spark, folder):
    ref, cur = halves(spark, folder)
    return rounded(drift.ks_two_sample(ref, cur, WATCHED, with_p=False), "statistique")


@query("drift_audit")
def drift_audit(spark, folder):
    ref, cur = halves(spark, folder)
    return drift.drift_audit(ref, cur, WATCHED)


_REPORT = _CUM + """, ld AS (SELECT *, lead(v) OVER (PARTITION BY variable ORDER BY v) - v AS dx FROM cm),
  ds AS (SELECT variable, coalesce(sum(abs(f - g) * dx), 0) AS w FROM ld GROUP BY 1),
  sm AS (SELECT variable, stddev_pop(v) FILTER (ref) AS sd, avg(v) FILTER (ref) AS ma, avg(v) FILTER (NOT ref) AS mb FROM l GROUP BY 1),
  rp AS (SELECT variable, w / greatest(sd, 0.001) AS d, ma, mb FROM ds JOIN sm USING (variable))"""


@query(
    "drift_report",
    _EVENTS + _REPORT + """ SELECT variable, 'wasserstein' AS mesure, round(d, 6) AS distance, d >= 0.1 AS derive,
      CAST(0 AS DOUBLE) AS manquants_reference, CAST(0 AS DOUBLE) AS manquants_courant,
      round(ma, 5) AS moyenne_reference, round(mb, 5) AS moyenne_courant FROM rp""",
)
def drift_report(spark, folder):
    ref, cur = halves(spark, folder)
    out = rounded(drift.drift_report(ref, cur, WATCHED), "distance")
    return rounded(out, "moyenne_reference", "moyenne_courant", digits=5)


@query(
    "drift_overview",
    _EVENTS + _REPORT + """ SELECT count(*) AS n_colonnes, count(*) FILTER (d >= 0.1) AS n_derives,
      round(avg(CAST(d >= 0.1 AS INT)), 6) AS part_derives, avg(CAST(d >= 0.1 AS INT)) > 0.5 AS derive_globale FROM rp""",
)
def drift_overview(spark, folder):
    ref, cur = halves(spark, folder)
    return rounded(drift.drift_overview(drift.drift_report(ref, cur, WATCHED)), "part_derives")


# portable draws for the twins: a function of the key that both engines compute alike
_U, _V = "(k * 7919 % 10007 + 1) / CAST(10009 AS DOUBLE)", "(k * 6007 % 10009 + 1) / CAST(10011 AS DOUBLE)"
_NORMAL = f"sqrt(-2.0 * ln({_U})) * cos(CAST(6.283185307179586 AS DOUBLE) * {_V})"


def _poisson_sql() -> str:
    """Inverse of the Poisson(2) distribution function, by increasing cumulative probability."""
    steps, cumulative, term = [], 0.0, 0.1353352832366127
    for k in range(12):
        cumulative += term
        steps.append(f"WHEN {_U} >= CAST('{cumulative!r}' AS DOUBLE) THEN {k + 1}")
        term *= 2.0 / (k + 1)
    return f"CASE {' '.join(reversed(steps))} ELSE 0 END"


_POISSON = _poisson_sql()


def _scenario(name: str, columns: tuple[str, ...]):
    def run(spark, folder):
        u = (F.col("k") * 7919 % 10007 + 1) / F.lit(10009.0)
        v = (F.col("k") * 6007 % 10009 + 1) / F.lit(10011.0)
        whole = F.floor("revenu_mensuel_recurrent_eur")
        df = accounts(spark, folder).withColumn("revenu_mensuel_recurrent_eur", whole)
        out = drift.scenario_transform(df, name, "k", uniforms=(u, v))
        return rounded(out.select("client_id", *columns), *columns, digits=5)

    return run


query(
    "scenario_adoption",
    ACC + f""" SELECT client_id, round(CASE WHEN taux_adoption_pct IS NOT NULL THEN least(greatest(taux_adoption_pct - 20
      + ({_NORMAL}) * 5, 0), 100) END, 5) AS taux_adoption_pct,
      round_even(greatest(connexions_30j * (0.4 + 0.3 * {_U}), 0), 0) AS connexions_30j FROM accounts""",
)(_scenario("adoption_chute", ("taux_adoption_pct", "connexions_30j")))
query(
    "scenario_segment",
    ACC + f""" SELECT client_id, CASE WHEN {_U} < 0.3 THEN 50 + floor(150 * {_V}) ELSE CAST(sieges_souscrits AS DOUBLE) END
      AS sieges_souscrits, CASE WHEN {_U} < 0.3 THEN 5 + floor(15 * {_V}) ELSE CAST(utilisateurs_actifs AS DOUBLE) END
      AS utilisateurs_actifs, round(CASE WHEN {_U} < 0.3 THEN 5000 + 15000 * {_V} ELSE floor(revenu_mensuel_recurrent_eur) END, 5)
      AS revenu_mensuel_recurrent_eur FROM accounts""",
)(_scenario("nouveau_segment", ("sieges_souscrits", "utilisateurs_actifs", "revenu_mensuel_recurrent_eur")))
query(
    "scenario_tenure",
    ACC + f""" SELECT client_id, round(CASE WHEN anciennete_mois IS NOT NULL THEN greatest(anciennete_mois * 0.5
      + ({_NORMAL}) * 3, 0) END, 5) AS anciennete_mois FROM accounts""",
)(_scenario("anciennete_rajeunissement", ("anciennete_mois",)))
query(
    "scenario_support",
    ACC + f""" SELECT client_id, round(greatest(tickets_support_90j * CAST(2.5 AS DOUBLE) + {_POISSON}, 0), 5) AS tickets_support_90j,
      round(CASE WHEN delai_reponse_support_h IS NOT NULL THEN greatest(delai_reponse_support_h * 3 - 10 * ln(1 - {_V}), 0) END, 5)
      AS delai_reponse_support_h FROM accounts""",
)(_scenario("support_degradation", ("tickets_support_90j", "delai_reponse_support_h")))


@query(
    "output_drift",
    ACC + """, d AS (SELECT CASE WHEN p >= 0.6 THEN 'ALERTE_ROUGE' WHEN p >= 0.4 THEN 'SURVEILLANCE' ELSE 'OK' END AS decision,
      k % 3 AS h FROM accounts),
    s AS (SELECT decision, count(*) FILTER (h = 0) / CAST((SELECT count(*) FROM d WHERE h = 0) AS DOUBLE) AS a,
      count(*) FILTER (h <> 0) / CAST((SELECT count(*) FROM d WHERE h <> 0) AS DOUBLE) AS b FROM d GROUP BY 1)
    SELECT decision, round(a, 6) AS part_avant, round(b, 6) AS part_apres, round(100 * (b - a), 6) AS ecart_points,
      decision = 'ALERTE_ROUGE' AND abs(100 * (b - a)) > 10 AS retour_arriere FROM s""",
)
def output_drift(spark, folder):
    decided = accounts(spark, folder).select(risk_level(F.col("p")).alias("decision"), (F.col("k") % 3).alias("h"))
    out = drift.output_drift(decided.where("h = 0"), decided.where("h <> 0"))
    return rounded(out, "part_avant", "part_apres", "ecart_points")
