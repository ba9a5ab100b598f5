"""Queries of exploratory statistics over the account view, labels, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import explore, features, ordering, primitives, references
from tenura.params import HYPOTHESES
from tenura.plans.accounts import DECOYS, NUMERIC, accounts, accounts_sql
from tenura.queries.registry import query
from tenura.queries.twins import (
    ACC,
    auc_ctes,
    binary_chi2_ctes,
    levels_sql,
    long_sql,
    wilson_sql,
)
from tenura.sources.tables import table

MEASURES = ("anciennete_mois", "sieges_souscrits", "csat", "derniere_connexion_jours",
            "revenu_mensuel_recurrent_eur", "nb_integrations")
LEVELS = ("taille_entreprise", "commentaire_csm", "plan", *DECOYS)
LOW, HIGH = wilson_sql("sum(churn)", "count(*)")


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "target_distribution",
    ACC
    + """ SELECT count(*) AS n, CAST(sum(churn) AS BIGINT) AS n_churn,
      CAST(count(*) - sum(churn) AS BIGINT) AS n_fideles, round(avg(churn), 6) AS prevalence,
      round((count(*) - sum(churn)) / CAST(sum(churn) AS DOUBLE), 6) AS ratio_desequilibre FROM accounts""",
)
def target_distribution(spark, folder):
    out = explore.target_distribution(accounts(spark, folder), "churn")
    return rounded(out, "prevalence", "ratio_desequilibre")


_FENCE_CTE = f""", l AS ({long_sql("accounts", MEASURES)}),
  f AS (SELECT variable, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1),
  o AS (SELECT l.*, q1, q3, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS out
    FROM l JOIN f USING (variable))"""
_SUMMARY = """SELECT variable, count(*) AS n, (SELECT count(*) FROM accounts) - count(*) AS n_manquants,
    count(DISTINCT v) AS n_distinctes, avg(v) AS moyenne, quantile_cont(v, 0.5) AS mediane,
    stddev_samp(v) AS ecart_type, min(v) AS min, max(v) AS max, max(q1) AS q1, max(q3) AS q3,
    skewness(v) AS asymetrie, kurtosis(v) AS kurtosis_exces,
    count(*) FILTER (out) AS n_outliers_iqr, avg(y) FILTER (out) AS taux_cible_outliers,
    avg(y) FILTER (NOT out) AS taux_cible_hors_outliers FROM o GROUP BY variable"""
_FLOATS = ("moyenne", "mediane", "ecart_type", "min", "max", "q1", "q3", "asymetrie", "kurtosis_exces",
           "taux_cible_outliers", "taux_cible_hors_outliers")


@query(
    "numeric_summary",
    f"{ACC}{_FENCE_CTE}, s AS ({_SUMMARY}) SELECT variable, n, n_manquants, n_distinctes, n_outliers_iqr, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in _FLOATS) + " FROM s",
)
def numeric_summary(spark, folder):
    df = accounts(spark, folder)
    out = explore.numeric_summary(df, MEASURES, "churn")
    return rounded(out, *_FLOATS, digits=5)


@query(
    "extreme_profile",
    f"""{ACC}{_FENCE_CTE}, s AS ({_SUMMARY}) SELECT variable, round(asymetrie, 5) AS asymetrie,
    n_outliers_iqr AS n_outliers, round(taux_cible_outliers, 6) AS churn_outliers,
    round(taux_cible_hors_outliers, 6) AS churn_autres, round(CASE WHEN n_outliers_iqr >= 30 THEN
    100 * (taux_cible_outliers - taux_cible_hors_outliers) END, 5) AS ecart_points FROM s""",
)
def extreme_profile(spark, folder):
    summary = explore.numeric_summary(accounts(spark, folder), MEASURES, "churn")
    out = rounded(explore.extreme_profile(summary), "churn_outliers", "churn_autres")
    return rounded(out, "asymetrie", "ecart_points", digits=5)


_CATS = ("secteur", "pays", "plan")


@query(
    "categorical_summary",
    ACC + ", l AS (" + long_sql("accounts", _CATS, "1 AS y", "VARCHAR") + f"""),
    raw AS (SELECT variable, v, count(*) AS n FROM l GROUP BY ALL),
    nrm AS (SELECT variable, lower(trim(v)) AS norme, CAST(sum(n) AS BIGINT) AS n, count(*) AS e,
      count(*) FILTER (n < 10) AS rares,
      string_agg('«' || replace(v, ' ', '␣') || '»', ' / ' ORDER BY v) AS ex FROM raw GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, norme) AS rt,
      row_number() OVER (PARTITION BY variable ORDER BY e DESC, norme) AS re FROM nrm)
    SELECT variable AS colonne, CAST(sum(n) AS BIGINT) AS n,
      CAST((SELECT count(*) FROM accounts) - sum(n) AS BIGINT) AS n_manquants,
      CAST(sum(e) AS BIGINT) AS cardinalite, count(*) AS cardinalite_normalisee,
      CAST(sum(e) - count(*) AS BIGINT) AS variantes_typographiques,
      CASE WHEN sum(e) > count(*) THEN max(ex) FILTER (re = 1) ELSE '' END AS exemple_variantes,
      CAST(sum(rares) AS BIGINT) AS n_modalites_rares, count(*) FILTER (n < 10) AS n_rares_normalisees,
      max(norme) FILTER (rt = 1) AS mode,
      round(100.0 * max(n) / CAST(sum(n) AS DOUBLE), 6) AS frequence_mode_pct FROM top GROUP BY variable""",
)
def categorical_summary(spark, folder):
    return rounded(explore.categorical_summary(accounts(spark, folder), _CATS), "frequence_mode_pct")


@query(
    "uniformity_test",
    ACC + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, CAST(count(*) AS DOUBLE) AS c FROM accounts WHERE {c} IS NOT NULL "
        f"GROUP BY lower(trim({c}))" for c in (*DECOYS, "plan")
    ) + """), t AS (SELECT colonne, sum(c) AS n, CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY 1)
    SELECT colonne, CAST(max(k) AS BIGINT) AS n_modalites, round(max(1 / k), 6) AS part_uniforme,
      round(min(c / n), 6) AS part_min, round(max(c / n), 6) AS part_max,
      round(sum(power(c - n / k, 2) / (n / k)), 6) AS chi2 FROM c JOIN t USING (colonne) GROUP BY colonne""",
)
def uniformity_test(spark, folder):
    out = explore.uniformity_test(accounts(spark, folder), (*DECOYS, "plan"), with_p=False)
    return rounded(out, "part_uniforme", "part_min", "part_max", "chi2")


@query(
    "rate_by_level",
    f"""WITH j AS (SELECT lang, toxic AS churn FROM labels JOIN documents USING (doc_id))
    SELECT lang, count(*) AS effectif, CAST(sum(churn) AS BIGINT) AS n_churn, round(avg(churn), 6) AS taux_churn,
      round({LOW}, 6) AS ic_bas, round({HIGH}, 6) AS ic_haut FROM j GROUP BY lang""",
)
def rate_by_level(spark, folder):
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "lang"), "doc_id"
    )
    return rounded(explore.rate_by_level(joined, "lang", "toxic"), "taux_churn", "ic_bas", "ic_haut")


@query(
    "wilson_interval",
    f"""{ACC} SELECT pays, count(*) AS effectif, CAST(sum(churn) AS BIGINT) AS n_churn,
      round(avg(churn), 6) AS taux_churn, round({LOW}, 6) AS ic_bas, round({HIGH}, 6) AS ic_haut
    FROM accounts WHERE pays IS NOT NULL GROUP BY pays""",
)
def wilson_interval(spark, folder):
    out = primitives.wilson_rates(accounts(spark, folder), "pays", "churn")
    return rounded(out, "taux_churn", "ic_bas", "ic_haut")


@query(
    "rate_by_level_with_missing",
    ACC + """ SELECT coalesce(CAST(csat AS VARCHAR), 'manquant') AS niveau, count(*) AS effectif,
      round(avg(churn), 6) AS taux_churn FROM accounts GROUP BY 1""",
)
def rate_by_level_with_missing(spark, folder):
    out = explore.rate_by_level_with_missing(accounts(spark, folder), "csat", "churn")
    return rounded(out, "taux_churn")


@query(
    "level_profile",
    f"""{ACC} SELECT commentaire_csm, count(*) AS effectif, CAST(sum(churn) AS BIGINT) AS n_churn,
      round(avg(churn), 6) AS taux_churn, round({LOW}, 6) AS ic_bas, round({HIGH}, 6) AS ic_haut,
      round(quantile_cont(CAST(heures_usage_30j AS DOUBLE), 0.5), 6) AS heures_usage_30j,
      round(quantile_cont(CAST(csat AS DOUBLE), 0.5), 6) AS csat,
      round(avg(CAST(sante_compte_fin_periode = 0 AS INT)), 6) AS part_condition
    FROM accounts WHERE commentaire_csm IS NOT NULL GROUP BY commentaire_csm""",
)
def level_profile(spark, folder):
    out = explore.level_profile(
        accounts(spark, folder), "commentaire_csm", "churn", ["heures_usage_30j", "csat"],
        F.col("sante_compte_fin_periode") == 0,
    )
    return rounded(out, "taux_churn", "ic_bas", "ic_haut", "heures_usage_30j", "csat", "part_condition")


_CHI = ACC + ", lv AS (" + levels_sql("accounts", LEVELS) + "), " + binary_chi2_ctes()


@query(
    "categorical_association",
    _CHI + """ SELECT variable AS colonne, lignes AS n_modalites, CAST(ddl AS BIGINT) AS ddl,
      round(chi2, 6) AS chi2, round(v_cramer, 6) AS v_cramer FROM chi""",
)
def categorical_association(spark, folder):
    out = explore.categorical_association(accounts(spark, folder), LEVELS, "churn", with_p=False)
    return rounded(out, "chi2", "v_cramer")


@query("categorical_association_tests")
def categorical_association_tests(spark, folder):
    return explore.categorical_association(accounts(spark, folder), LEVELS, "churn")


@query(
    "chi_square",
    _CHI + """ SELECT variable, n, lignes, CAST(2 AS BIGINT) AS colonnes, CAST(ddl AS BIGINT) AS ddl,
      round(chi2, 6) AS chi2, round(v_cramer, 6) AS v_cramer FROM chi""",
)
def chi_square(spark, folder):
    levels = explore._level_counts(accounts(spark, folder), LEVELS, "churn")
    return rounded(primitives.chi_square_binary(levels, ["variable"]), "chi2", "v_cramer")


_AUC = f"{ACC}, long AS ({long_sql('accounts', NUMERIC)}), {auc_ctes()}"


@query(
    "univariate_auc",
    _AUC + " SELECT variable, n, n_pos, n_neg, round(auc, 6) AS auc, round(u, 1) AS u, round(z, 6) AS z FROM auc",
)
def univariate_auc(spark, folder):
    out = explore.univariate_auc(accounts(spark, folder), NUMERIC, "churn")
    return rounded(rounded(out, "auc", "z"), "u", digits=1)


@query(
    "mann_whitney",
    f"{ACC}, long AS ({long_sql('accounts', ('csat', 'p'))}), {auc_ctes()}"
    " SELECT variable, n, n_pos, n_neg, round(auc, 6) AS auc, round(u, 1) AS u, round(z, 6) AS z FROM auc",
)
def mann_whitney(spark, folder):
    out = explore.mann_whitney(accounts(spark, folder), ["csat", "p"], "churn")
    return rounded(rounded(out.drop("p_value"), "auc", "z"), "u", digits=1)


@query(
    "discriminating_power",
    f"""{_AUC}, lv AS ({levels_sql("accounts", LEVELS)}), {binary_chi2_ctes()}
    SELECT variable, 'numerique' AS type, round(greatest(auc, 1 - auc), 6) AS association,
      round(z, 6) AS statistique, CAST(0 AS BIGINT) AS ddl FROM auc WHERE n >= 20 AND auc IS NOT NULL
    UNION ALL SELECT variable, 'categorielle', round(v_cramer, 6), round(chi2, 6), CAST(ddl AS BIGINT) FROM chi""",
)
def discriminating_power(spark, folder):
    out = explore.discriminating_power(
        accounts(spark, folder), NUMERIC, LEVELS, "churn", with_p=False
    )
    return rounded(out, "association", "statistique")


@query("discriminating_power_tests")
def discriminating_power_tests(spark, folder):
    df = accounts(spark, folder)
    return explore.discriminating_power(df, NUMERIC, LEVELS, "churn")


_PAIRED = ("anciennete_mois", "sieges_souscrits", "utilisateurs_actifs", "connexions_30j",
           "heures_usage_30j", "csat", "revenu_mensuel_recurrent_eur")
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"corr({a}, {b}) AS r FROM accounts"
    for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]
)


@query(
    "correlation_pairs",
    f"{ACC}, p AS ({_PAIRS_SQL}) SELECT variable_1, variable_2, n, round(r, 6) AS correlation FROM p "
    "WHERE abs(r) >= 0.1",
)
def correlation_pairs(spark, folder):
    return rounded(explore.correlation_pairs(accounts(spark, folder), _PAIRED, 0.1), "correlation")


_RANKED = (("connexions_30j", "sieges_souscrits"), ("heures_usage_30j", "csat"),
           ("anciennete_mois", "nb_integrations"))


def _midrank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "spearman_pairs",
    ACC + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM "
        f"(SELECT {_midrank(a)} AS ra, {_midrank(b)} AS rb FROM accounts WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in _RANKED
    ),
)
def spearman_pairs(spark, folder):
    out = explore.spearman_pairs(accounts(spark, folder), _RANKED)
    return rounded(out.withColumn("n", F.col("n").cast("bigint")), "rho")


@query(
    "mid_rank",
    ACC + f""" SELECT csat, count(*) AS n, max(rk) AS rang FROM (SELECT csat, CAST({_midrank('csat')} AS DOUBLE) AS rk
    FROM accounts WHERE csat IS NOT NULL) GROUP BY csat""",
)
def mid_rank(spark, folder):
    return ordering.mid_ranks(accounts(spark, folder), "csat")


@query("vif")
def vif(spark, folder):
    return explore.vif(accounts(spark, folder), _PAIRED)


@query(
    "vif_of_two",
    f"""{ACC}, r AS (SELECT 1 / (1 - pow(corr(sieges_souscrits, utilisateurs_actifs), 2)) AS v FROM accounts)
    SELECT 'sieges_souscrits' AS variable, round(v, 6) AS vif FROM r
    UNION ALL SELECT 'utilisateurs_actifs', round(v, 6) FROM r""",
)
def vif_of_two(spark, folder):
    """Two columns, where the inverse of the correlation matrix has a closed form."""
    return rounded(explore.vif(accounts(spark, folder), ["sieges_souscrits", "utilisateurs_actifs"]), "vif")


_TESTED = tuple(h for h in HYPOTHESES if h[0] in ("H2", "H4", "H5", "H6", "H7", "H13", "H14"))


def _hypothesis_sql() -> str:
    parts = []
    for hid, c, _ in _TESTED:
        value = f"CAST({c} AS DOUBLE)"
        if hid == "H13":
            value = (f"CASE WHEN {c} >= (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) FROM accounts) "
                     "THEN 1.0 ELSE 0.0 END")  # fmt: skip
        parts.append(f"SELECT '{hid}' AS variable, CAST({value} AS DOUBLE) AS v, churn AS y FROM accounts "
                     f"WHERE {c} IS NOT NULL")  # fmt: skip
    meta = ", ".join(f"('{h}', '{c}', '{s}')" for h, c, s in _TESTED)
    centre = "CASE WHEN variable = 'H13' THEN avg(v) FILTER (y = {0}) ELSE quantile_cont(v, 0.5) FILTER (y = {0}) END"
    return f"""{ACC}, long AS ({" UNION ALL ".join(parts)}), {auc_ctes()},
    ce AS (SELECT variable, {centre.format(1)} AS m1, {centre.format(0)} AS m0 FROM long GROUP BY variable),
    meta(variable, col, sens) AS (VALUES {meta})
    SELECT variable AS id, col AS variable, sens AS sens_attendu,
      CASE WHEN variable = 'H13' THEN 'part >= quantile' ELSE 'mediane' END AS mesure,
      round(m1, 6) AS mediane_churn, round(m0, 6) AS mediane_non_churn,
      CASE WHEN auc > 0.5 THEN '+' WHEN auc < 0.5 THEN '-' ELSE '=' END AS sens_observe,
      round(CASE WHEN sens = '+' THEN auc ELSE 1 - auc END, 6) AS auc_orientee, round(z, 6) AS z
    FROM auc JOIN ce USING (variable) JOIN meta USING (variable)"""


@query("hypothesis_tests", _hypothesis_sql())
def hypothesis_tests(spark, folder):
    out = explore.hypothesis_tests(
        accounts(spark, folder), "churn", _TESTED, with_p=False
    )
    return rounded(out, "mediane_churn", "mediane_non_churn", "auc_orientee", "z")


@query("hypothesis_verdicts")
def hypothesis_verdicts(spark, folder):
    df = features.business_features(accounts(spark, folder))
    return explore.hypothesis_tests(df, "churn")


_RATIO_DEFS = {
    "taux_utilisation_sieges": "CASE WHEN sieges_souscrits > 0 THEN utilisateurs_actifs / CAST(sieges_souscrits AS DOUBLE) END",
    "taux_couverture_fonctionnelle": "fonctionnalites_utilisees / CAST(fonctionnalites_total AS DOUBLE)",
    "intensite_usage_par_utilisateur": "CASE WHEN utilisateurs_actifs > 0 THEN heures_usage_30j / utilisateurs_actifs END",
    "arpu_par_siege": "CASE WHEN sieges_souscrits > 0 THEN revenu_mensuel_recurrent_eur / sieges_souscrits END",
    "intensite_support": "CASE WHEN anciennete_mois > 0 THEN tickets_support_90j / CAST(anciennete_mois AS DOUBLE) END",
}
_RATIO_COLS = sorted({*explore.RATIOS, *[raw for raw, _ in explore.RATIOS.values()]})


@query(
    "ratio_vs_raw_auc",
    f"""{ACC}, feats AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in _RATIO_DEFS.items())} FROM accounts),
    long AS ({long_sql("feats", _RATIO_COLS)}), {auc_ctes()},
    meta(ratio, variable_brute, sens) AS (VALUES {", ".join(f"('{r}', '{b}', '{s}')" for r, (b, s) in explore.RATIOS.items())})
    SELECT ratio, variable_brute, round(CASE WHEN sens = '+' THEN a.auc ELSE 1 - a.auc END, 6) AS auc_ratio,
      round(CASE WHEN sens = '+' THEN b.auc ELSE 1 - b.auc END, 6) AS auc_brute,
      round(1 - a.n / CAST((SELECT count(*) FROM accounts) AS DOUBLE), 6) AS manquants
    FROM meta JOIN auc a ON a.variable = ratio JOIN auc b ON b.variable = variable_brute""",
)
def ratio_vs_raw_auc(spark, folder):
    df = features.business_features(accounts(spark, folder))
    out = explore.ratio_vs_raw_auc(df, "churn")
    return rounded(out, "auc_ratio", "auc_brute", "manquants")


_QUARTILES = """q AS (SELECT quantile_cont(mrr, 0.25) AS a, quantile_cont(mrr, 0.5) AS b,
  quantile_cont(mrr, 0.75) AS c FROM k)"""


@query(
    "portfolio_by_quartile",
    ACC + f""", k AS (SELECT revenu_mensuel_recurrent_eur AS mrr, churn AS y FROM accounts
      WHERE revenu_mensuel_recurrent_eur IS NOT NULL), {_QUARTILES},
    p AS (SELECT mrr, y, CASE WHEN mrr <= a THEN 'Q1' WHEN mrr <= b THEN 'Q2' WHEN mrr <= c THEN 'Q3' ELSE 'Q4' END
      AS quartile FROM k, q),
    g AS (SELECT coalesce(quartile, 'Total') AS quartile, count(*) AS comptes, min(mrr) AS mrr_min, max(mrr) AS mrr_max,
      quantile_cont(mrr, 0.5) AS mrr_median, sum(mrr) * 12 AS revenu_annuel, avg(y) AS taux_churn,
      coalesce(sum(mrr) FILTER (y = 1), 0) * 12 AS revenu_partants FROM p GROUP BY ROLLUP (quartile))
    SELECT quartile, comptes, round(mrr_min, 4) AS mrr_min, round(mrr_max, 4) AS mrr_max,
      round(mrr_median, 4) AS mrr_median, round(revenu_annuel, 2) AS revenu_annuel,
      round(revenu_annuel / max(revenu_annuel) OVER (), 6) AS part_du_revenu, round(taux_churn, 6) AS taux_churn,
      round(revenu_partants, 2) AS revenu_partants FROM g""",
)
def portfolio_by_quartile(spark, folder):
    out = explore.portfolio_by_quartile(
        accounts(spark, folder), "revenu_mensuel_recurrent_eur", "churn"
    )
    out = rounded(out, "part_du_revenu", "taux_churn")
    out = rounded(out, "mrr_min", "mrr_max", "mrr_median", digits=4)
    return rounded(out, "revenu_annuel", "revenu_partants", digits=2)


@query(
    "concentration_curve",
    """WITH c AS (SELECT CAST(o_totalprice AS DECIMAL(18,6)) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(v AS DOUBLE) AS revenu, n, CAST(sum(n) OVER w AS BIGINT) AS rang,
      round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (), 6) AS part_comptes,
      round(CAST(sum(n * v) OVER w AS DOUBLE) / CAST(sum(n * v) OVER () AS DOUBLE), 6) AS part_revenu
    FROM c WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)""",
)
def concentration_curve(spark, folder):
    out = explore.concentration_curve(table(spark, folder, "orders"), "o_totalprice")
    return rounded(out, "part_comptes", "part_revenu")


@query(
    "top_share",
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS k,
      count(*) OVER () AS n, sum(o_totalprice) OVER () AS t FROM orders)
    SELECT round(sum(v) FILTER (k <= ceil(0.2 * n)) / max(t), 6) AS part_top FROM r""",
)
def top_share(spark, folder):
    return rounded(explore.top_share(table(spark, folder, "orders"), "o_totalprice"), "part_top")


@query(
    "rate_by_quarter",
    ACC + """ SELECT CAST(date_trunc('quarter', date_souscription) AS DATE) AS trimestre,
      round(avg(churn), 6) AS taux_churn, count(*) AS effectif, count(*) >= 30 AS fiable
    FROM accounts WHERE date_souscription IS NOT NULL GROUP BY 1""",
)
def rate_by_quarter(spark, folder):
    return rounded(explore.rate_by_quarter(accounts(spark, folder), "date_souscription", "churn"), "taux_churn")


@query(
    "temporal_split_check",
    ACC + """, d AS (SELECT date_diff('day', DATE '1970-01-01', date_souscription) AS d, churn, anciennete_mois
      FROM accounts WHERE date_souscription IS NOT NULL),
    e AS (SELECT quantile_cont(CAST(d AS DOUBLE), 0.8) AS e FROM d)
    SELECT CASE WHEN d <= e THEN 'avant' ELSE 'apres' END AS cote, count(*) AS n, round(avg(churn), 6) AS taux_churn,
      round(quantile_cont(CAST(anciennete_mois AS DOUBLE), 0.5), 6) AS anciennete_mediane FROM d, e GROUP BY 1""",
)
def temporal_split_check(spark, folder):
    out = explore.temporal_split_check(
        accounts(spark, folder), "date_souscription", "churn", "anciennete_mois"
    )
    return rounded(out, "taux_churn", "anciennete_mediane")


_CATALOGUE = references.values_sql(references.PLANS, references.PLAN_COLUMNS)


@query(
    "revenue_vs_catalogue",
    f"""{ACC}, r AS (SELECT CASE WHEN sieges_souscrits * prix_mensuel_par_siege_eur > 0 THEN
      revenu_mensuel_recurrent_eur / (sieges_souscrits * prix_mensuel_par_siege_eur) END AS r,
      p >= 0.5 AS s FROM accounts a JOIN {_CATALOGUE} c ON lower(trim(a.plan)) = lower(c.plan))
    SELECT round(min(r) FILTER (s), 6) AS retenus_min, round(max(r) FILTER (s), 6) AS retenus_max,
      round(quantile_cont(r, 0.01), 6) AS p01, round(quantile_cont(r, 0.99), 6) AS p99 FROM r""",
)
def revenue_vs_catalogue(spark, folder):
    df = features.join_catalogue(accounts(spark, folder), references.catalogue(spark))
    out = explore.revenue_vs_catalogue(df, F.col("p") >= 0.5)
    return rounded(out, "retenus_min", "retenus_max", "p01", "p99")


@query(
    "levels_off_average",
    f"""{ACC}, w AS (SELECT commentaire_csm, avg(churn) AS t, {LOW} AS lo, {HIGH} AS hi FROM accounts
      WHERE commentaire_csm IS NOT NULL GROUP BY 1), m AS (SELECT avg(churn) AS m FROM accounts)
    SELECT commentaire_csm, round(t, 6) AS taux_churn, round(m, 6) AS moyenne,
      CASE WHEN lo > m THEN 'au-dessus' ELSE 'au-dessous' END AS position FROM w, m WHERE lo > m OR hi < m""",
)
def levels_off_average(spark, folder):
    out = explore.levels_off_average(accounts(spark, folder), "commentaire_csm", "churn")
    return rounded(out, "taux_churn", "moyenne")


@query(
    "rate_near_anniversary",
    ACC + """, a AS (SELECT (12 - anciennete_mois % 12) % 12 AS m, churn FROM accounts)
    SELECT round(avg(churn) FILTER (m <= 2), 6) AS taux_proche, round(avg(churn) FILTER (m >= 9), 6) AS taux_loin,
      count(*) FILTER (m <= 2) AS n_proche, count(*) FILTER (m >= 9) AS n_loin FROM a""",
)
def rate_near_anniversary(spark, folder):
    out = explore.rate_near_anniversary(accounts(spark, folder), "anciennete_mois", "churn")
    return rounded(out, "taux_proche", "taux_loin")


@query(
    "additive_or_multiplicative",
    ACC + """ SELECT round(corr(valeur_vie_client_eur, revenu_mensuel_recurrent_eur), 6) AS r_euros,
      round(corr(ln(valeur_vie_client_eur), ln(revenu_mensuel_recurrent_eur)), 6) AS r_logs FROM accounts
    WHERE valeur_vie_client_eur > 0 AND revenu_mensuel_recurrent_eur > 0""",
)
def additive_or_multiplicative(spark, folder):
    out = explore.additive_or_multiplicative(
        accounts(spark, folder), "valeur_vie_client_eur", "revenu_mensuel_recurrent_eur"
    )
    return rounded(out, "r_euros", "r_logs")


@query(
    "quantile_flag",
    ACC + """, q AS (SELECT quantile_cont(CAST(csat AS DOUBLE), 0.75) AS e FROM accounts)
    SELECT client_id, csat, CAST(csat >= e AS INTEGER) AS csat_haut FROM accounts, q""",
)
def quantile_flag(spark, folder):
    df = accounts(spark, folder).select("client_id", "csat")
    return explore.quantile_flag(df, "csat")


# p-values of the two corrections: a rational function of the data, one per country
_PVALUES = """, pv AS (SELECT pays, avg(p) * avg(churn) / 4 AS p_value FROM accounts
  WHERE pays IS NOT NULL GROUP BY pays), rk AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r,
  count(*) OVER () AS m FROM pv)"""


def _p_by_country(spark, folder):
    known = accounts(spark, folder).where("pays IS NOT NULL")
    return known.groupBy("pays").agg((F.avg("p") * F.avg("churn") / 4).alias("p_value"))


@query(
    "benjamini_hochberg",
    ACC + _PVALUES + """ SELECT pays, round(p_value, 6) AS p_value, round(least(1, min(p_value * m / r)
      OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_ajustee FROM rk""",
)
def benjamini_hochberg(spark, folder):
    out = primitives.benjamini_hochberg(_p_by_country(spark, folder), "p_value", "p_ajustee")
    return rounded(out, "p_value", "p_ajustee")


@query(
    "holm",
    ACC + _PVALUES + """ SELECT pays, round(p_value, 6) AS p_value, round(least(1, max(p_value * (m - r + 1))
      OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS p_ajustee FROM rk""",
)
def holm(spark, folder):
    return rounded(primitives.holm(_p_by_country(spark, folder), "p_value", "p_ajustee"), "p_value", "p_ajustee")


@query(
    "coverage_of_fallback",
    f"""WITH {accounts_sql()} SELECT coalesce(lower(trim(pays)), '(manquant)') AS libelle, count(*) AS n FROM accounts
    WHERE pays IS NULL OR lower(trim(pays)) NOT IN ({", ".join("'" + c[0].lower() + "'" for c in references.COUNTRIES)})
    GROUP BY 1""",
)
def coverage_of_fallback(spark, folder):
    return features.fallback_coverage(accounts(spark, folder), "pays", references.countries(spark))
