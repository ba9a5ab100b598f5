"""Queries of features, enrichment joins and the gold table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions.text import normalise
from tenura.operators import features, quality, references
from tenura.params import SUSPECTED_DECOYS
from tenura.plans.accounts import NUMERIC, accounts
from tenura.plans.gold import build_gold
from tenura.plans.raw import NUMBERS, date_sql, number_sql, raw_accounts, raw_sql, strip_sql
from tenura.queries.data_quality import NULLED
from tenura.queries.exploration import rounded
from tenura.queries.registry import query
from tenura.queries.twins import ACC

PLANS = references.values_sql(references.PLANS, references.PLAN_COLUMNS)
SECTORS = references.values_sql(
    [(n.lower(), c, g) for n, c, g in references.SECTORS]
    + [(a, c, g) for a, t in references.SECTOR_ALIASES.items() for n, c, g in references.SECTORS if n == t],
    ("cle", "churn_sectoriel", "dynamique"),
)
COUNTRIES = references.values_sql(
    [(c[0].lower(), *c[1:]) for c in references.COUNTRIES], ("cle_pays", "zone", "francais", "heures")
)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"


FEATURES = {
    "taux_utilisation_sieges": _ratio("utilisateurs_actifs", "sieges_souscrits"),
    "surdimensionnement": "CASE WHEN sieges_souscrits - utilisateurs_actifs IS NOT NULL THEN "
    "CAST(greatest(sieges_souscrits - utilisateurs_actifs, 0) AS DOUBLE) END",
    "intensite_usage_par_utilisateur": _ratio("heures_usage_30j", "utilisateurs_actifs"),
    "connexions_par_utilisateur": _ratio("connexions_30j", "utilisateurs_actifs"),
    "taux_couverture_fonctionnelle": _ratio("fonctionnalites_utilisees", "fonctionnalites_total"),
    "arpu_par_siege": _ratio("revenu_mensuel_recurrent_eur", "sieges_souscrits"),
    "recence_normalisee": _ratio("derniere_connexion_jours", "(anciennete_mois * 30)"),
    "compte_dormant": "coalesce(derniere_connexion_jours > 30, false)",
    "pression_support": _ratio("tickets_support_90j", "utilisateurs_actifs"),
    "intensite_support": _ratio("tickets_support_90j", "anciennete_mois"),
    "tranche_anciennete": "CASE WHEN anciennete_mois <= -0.001 THEN NULL WHEN anciennete_mois <= 2 THEN 'onboarding' "
    "WHEN anciennete_mois <= 12 THEN 'installation' WHEN anciennete_mois IS NOT NULL THEN 'mature' END",
    "tranche_integrations": "CASE WHEN nb_integrations < 0 THEN NULL WHEN nb_integrations <= 0 THEN 'aucune' "
    "WHEN nb_integrations <= 3 THEN 'faible' WHEN nb_integrations <= 8 THEN 'moderee' "
    "WHEN nb_integrations IS NOT NULL THEN 'forte' END",
    "csat_manquant": "csat IS NULL",
    "heures_usage_30j_manquant": "heures_usage_30j IS NULL",
    "delai_reponse_support_h_manquant": "delai_reponse_support_h IS NULL",
}
REBUILT = (
    "coalesce(taux_adoption_pct, CASE WHEN sieges_souscrits > 0 AND utilisateurs_actifs IS NOT NULL THEN "
    "least(greatest(CAST(100 AS DOUBLE) * utilisateurs_actifs / sieges_souscrits, 0), 100) END)"
)
FEATURE_LIST = ", ".join(f"{e} AS {c}" for c, e in FEATURES.items())
CATALOGUE_EXTRA = """1 - CASE WHEN prix_mensuel_par_siege_eur * sieges_souscrits > 0 THEN
  revenu_mensuel_recurrent_eur / (prix_mensuel_par_siege_eur * sieges_souscrits) END AS remise_consentie,
  CASE WHEN sieges_souscrits > 0 AND utilisateurs_actifs IS NOT NULL THEN
    CASE WHEN CAST(utilisateurs_actifs AS DOUBLE) / sieges_souscrits >= 0.9 THEN 'sous-dimensionne'
    WHEN CAST(utilisateurs_actifs AS DOUBLE) / sieges_souscrits < 0.5 THEN 'sur-dimensionne' ELSE 'adapte' END END
    AS adequation_plan"""
SECTOR_EXTRA = """coalesce(churn_sectoriel, CAST(7.0 AS DOUBLE)) AS taux_churn_median_saas_pct,
  coalesce(dynamique, 'moderee') AS dynamique_croissance,
  taux_adoption_pct - (CAST(100 AS DOUBLE) - coalesce(churn_sectoriel, CAST(7.0 AS DOUBLE))) AS ecart_adoption_secteur"""
COUNTRY_EXTRA = """coalesce(zone, 'autre') AS zone_reglementaire, coalesce(francais, false) AS langue_support_fr,
  coalesce(heures, 0) AS decalage_horaire_paris_h"""
PLAN_JOIN = f"LEFT JOIN (SELECT lower(plan) AS cle_plan, * EXCLUDE (plan) FROM {PLANS}) ON lower(trim(plan)) = cle_plan"
SECTOR_JOIN = f"LEFT JOIN {SECTORS} ON lower(trim(secteur)) = cle"
COUNTRY_JOIN = f"LEFT JOIN {COUNTRIES} ON lower(trim(pays)) = cle_pays"
CHAIN = (
    f"SELECT * EXCLUDE (cle_plan, cle, cle_pays, churn_sectoriel, dynamique, zone, francais, heures), "
    f"{CATALOGUE_EXTRA}, {SECTOR_EXTRA}, {COUNTRY_EXTRA} FROM (SELECT *, {FEATURE_LIST} FROM base) "
    f"{PLAN_JOIN} {SECTOR_JOIN} {COUNTRY_JOIN}"
)


@query(
    "rebuild_adoption_rate",
    f"{ACC} SELECT client_id, {REBUILT} AS taux_adoption_pct FROM accounts",
)
def rebuild_adoption_rate(spark, folder):
    rebuilt = features.rebuild_adoption_rate(accounts(spark, folder))
    return rebuilt.select("client_id", "taux_adoption_pct")


@query(
    "rebuilt_count",
    ACC + """ SELECT count(*) FILTER (taux_adoption_pct IS NULL AND sieges_souscrits > 0
      AND utilisateurs_actifs IS NOT NULL) AS n_combles FROM accounts""",
)
def rebuilt_count(spark, folder):
    return features.rebuilt_count(accounts(spark, folder))


@query(
    "adoption_consistency",
    ACC + """, g AS (SELECT CASE WHEN sieges_souscrits > 0 THEN abs(CAST(100 AS DOUBLE) * utilisateurs_actifs
      / sieges_souscrits - floor(taux_adoption_pct / 3) * 3) END AS g FROM accounts)
    SELECT count(g) AS n_comparables, round(avg(g), 6) AS ecart_moyen_pts, round(max(g), 6) AS ecart_max_pts,
      count(*) FILTER (g > 1) AS n_incoherences,
      round(count(*) FILTER (g > 1) / CAST(count(g) AS DOUBLE), 6) AS part_incoherences FROM g""",
)
def adoption_consistency(spark, folder):
    # the declared rate is coarsened so that some rows disagree
    df = accounts(spark, folder).withColumn("taux_adoption_pct", F.floor(F.col("taux_adoption_pct") / 3) * 3)
    out = features.adoption_consistency(df)
    return rounded(out, "ecart_moyen_pts", "ecart_max_pts", "part_incoherences")


@query("business_features", f"""{ACC} SELECT client_id, {", ".join(
    f"{e} AS {c}" for c, e in FEATURES.items())} FROM accounts""")
def business_features(spark, folder):
    return features.business_features(accounts(spark, folder)).select("client_id", *FEATURES)


@query(
    "tenure_and_integration_bands",
    ACC + f""" SELECT {FEATURES["tranche_anciennete"]} AS tranche_anciennete,
      {FEATURES["tranche_integrations"]} AS tranche_integrations, count(*) AS n FROM accounts GROUP BY 1, 2""",
)
def bands(spark, folder):
    df = accounts(spark, folder)
    return df.groupBy(
        features.tenure_band(F.col("anciennete_mois")).alias("tranche_anciennete"),
        features.integration_band(F.col("nb_integrations")).alias("tranche_integrations"),
    ).agg(F.count("*").alias("n"))


@query(
    "gap_to_group_reference",
    ACC + """ SELECT client_id, csat - CASE taille_entreprise WHEN 'PME' THEN CAST(3.5 AS DOUBLE)
      WHEN 'GE' THEN CAST(2 AS DOUBLE) END AS ecart_csat_taille_entreprise FROM accounts""",
)
def gap_to_group_reference(spark, folder):
    df = accounts(spark, folder).select("client_id", "taille_entreprise", "csat")
    gap = features.gap_to_group_reference(df, {"PME": 3.5, "GE": 2.0}, "taille_entreprise", "csat")
    return gap.select("client_id", "ecart_csat_taille_entreprise")


@query(
    "join_catalogue",
    f"{ACC} SELECT client_id, prix_mensuel_par_siege_eur, sla_reponse_h, support_dedie, "
    f"{CATALOGUE_EXTRA} FROM accounts {PLAN_JOIN}",
)
def join_catalogue(spark, folder):
    out = features.join_catalogue(accounts(spark, folder), references.catalogue(spark))
    kept = ("client_id", "prix_mensuel_par_siege_eur", "sla_reponse_h", "support_dedie",
            "remise_consentie", "adequation_plan")
    return out.select(*kept)


@query("enrich_by_sector", f"{ACC} SELECT client_id, {SECTOR_EXTRA} FROM accounts {SECTOR_JOIN}")
def enrich_by_sector(spark, folder):
    out = features.enrich_by_sector(accounts(spark, folder))
    return out.select(
        "client_id", "taux_churn_median_saas_pct", "dynamique_croissance", "ecart_adoption_secteur"
    )


@query("enrich_by_country", f"{ACC} SELECT client_id, {COUNTRY_EXTRA} FROM accounts {COUNTRY_JOIN}")
def enrich_by_country(spark, folder):
    out = features.enrich_by_country(accounts(spark, folder))
    return out.select("client_id", "zone_reglementaire", "langue_support_fr", "decalage_horaire_paris_h")


_LABEL_COLUMNS = [c for c in (
    "client_id", "secteur", "pays", "taille_entreprise", "plan", "couleur_theme_interface",
    "code_datacenter", "groupe_experimentation", "commentaire_csm")]
_GOLD_BASE = (
    f"WITH {raw_sql()}, cleaned AS (SELECT DISTINCT {NULLED} FROM raw), typed AS ("
    + number_sql("cleaned", list(NUMBERS), [*_LABEL_COLUMNS, "date_souscription"])
    + f"), capped AS (SELECT {', '.join(_LABEL_COLUMNS)}, {date_sql('date_souscription')} AS date_souscription, "
    + ", ".join(
        {
            "utilisateurs_actifs": "CASE WHEN utilisateurs_actifs IS NOT NULL THEN "
            "least(greatest(utilisateurs_actifs, 0), sieges_souscrits) END AS utilisateurs_actifs",
            "taux_adoption_pct": "CASE WHEN taux_adoption_pct IS NOT NULL THEN "
            "least(greatest(taux_adoption_pct, 0), 100) END AS taux_adoption_pct",
        }.get(c, c)
        for c in NUMBERS
    )
    + f" FROM typed), base AS (SELECT * REPLACE ({REBUILT} AS taux_adoption_pct) FROM capped)"
)
@query(
    "build_gold",
    _GOLD_BASE + f" {CHAIN}",
)
def gold(spark, folder):
    return build_gold(raw_accounts(spark, folder), references.catalogue(spark))


@query(
    "table_parity",
    ACC + """ SELECT unnest(['compte_dormant', 'csat', 'secteur']) AS colonne,
      unnest([CAST(0 AS BIGINT), (SELECT count(*) FROM accounts WHERE k % 43 = 0 AND k % 13 <> 0),
        (SELECT count(*) FROM accounts WHERE k % 4 IN (2, 3) AND k % 23 <> 0)]) AS n_differences""",
)
def table_parity(spark, folder):
    """The gold path from dirty text against the request path from typed columns."""
    typed = accounts(spark, folder).withColumn("secteur", normalise(F.col("secteur")))
    from_text = build_gold(raw_accounts(spark, folder), references.catalogue(spark))
    from_text = from_text.withColumn("secteur", F.lower("secteur"))
    return quality.table_parity(
        from_text, features.business_features(typed), "client_id", ["compte_dormant", "csat", "secteur"]
    )


@query(
    "normalise_categories",
    f"WITH {raw_sql()} SELECT client_id, lower({strip_sql('secteur')}) AS secteur, lower({strip_sql('plan')}) AS plan "
    "FROM raw",
)
def normalise_categories(spark, folder):
    raw = raw_accounts(spark, folder).select("client_id", "secteur", "plan")
    return features.normalise_categories(raw, ["secteur", "plan"])


def _learned(spark, folder):
    df = accounts(spark, folder)
    return df.where("k % 5 <> 0"), df


@query(
    "group_aggregate",
    ACC + """, tr AS (SELECT * FROM accounts WHERE k % 5 <> 0),
    g AS (SELECT pays, quantile_cont(CAST(csat AS DOUBLE), 0.5) AS m FROM tr WHERE pays IS NOT NULL GROUP BY pays)
    SELECT client_id, coalesce(m, (SELECT quantile_cont(CAST(csat AS DOUBLE), 0.5) FROM tr)) AS csat_median_par_pays
    FROM accounts LEFT JOIN g USING (pays)""",
)
def group_aggregate(spark, folder):
    train, df = _learned(spark, folder)
    fitted = features.fit_group_aggregate(train, "pays", "csat", "median")
    out = features.apply_group_aggregate(df, fitted, "pays", "csat_median_par_pays")
    return out.select("client_id", "csat_median_par_pays")


@query(
    "gap_to_group",
    ACC + """, tr AS (SELECT * FROM accounts WHERE k % 5 <> 0),
    g AS (SELECT lower(trim(secteur)) AS s, avg(heures_usage_30j) AS m FROM tr WHERE secteur IS NOT NULL GROUP BY 1)
    SELECT client_id, round(heures_usage_30j - coalesce(m, (SELECT avg(heures_usage_30j) FROM tr)), 6)
      AS ecart_heures_usage_30j_secteur FROM accounts LEFT JOIN g ON lower(trim(secteur)) = s""",
)
def gap_to_group(spark, folder):
    train, df = _learned(spark, folder)
    out = features.gap_to_group(train, df, "secteur", "heures_usage_30j", "mean")
    name = "ecart_heures_usage_30j_secteur"
    return rounded(out.select("client_id", name), name)


_SKEWED = ("revenu_mensuel_recurrent_eur", "derniere_connexion_jours", "churn", "anciennete_mois",
           "tickets_support_90j", "nb_integrations")


@query(
    "skewed_columns",
    ACC + ", tr AS (SELECT * FROM accounts WHERE k % 5 <> 0) " + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, round(CASE WHEN count(DISTINCT {c}) > 2 THEN skewness({c}) ELSE 0 END, 5) "
        f"AS asymetrie, count(DISTINCT {c}) > 2 AND skewness({c}) > 1 AS a_transformer FROM tr"
        for c in _SKEWED
    ),
)
def skewed_columns(spark, folder):
    train, _ = _learned(spark, folder)
    return rounded(features.skewed_columns(train, _SKEWED), "asymetrie", digits=5)


@query(
    "signed_log_skewed",
    ACC + ", tr AS (SELECT * FROM accounts WHERE k % 5 <> 0), s AS (SELECT "
    + ", ".join(f"count(DISTINCT {c}) > 2 AND skewness({c}) > 1 AS {c}" for c in _SKEWED)
    + " FROM tr) SELECT client_id, " + ", ".join(
        f"CASE WHEN s.{c} THEN round(sign(a.{c}) * ln(1 + abs(a.{c})), 6) ELSE CAST(a.{c} AS DOUBLE) END AS {c}"
        for c in _SKEWED
    ) + " FROM accounts a, s",
)
def signed_log_skewed(spark, folder):
    train, df = _learned(spark, folder)
    out = features.signed_log_skewed(train, df, _SKEWED).select("client_id", *_SKEWED)
    logged = ("derniere_connexion_jours", "tickets_support_90j", "nb_integrations")
    return rounded(out, *logged).withColumns({c: F.col(c).cast("double") for c in _SKEWED})


@query(
    "impute_by_median",
    ACC + """ SELECT client_id, coalesce(revenu_mensuel_recurrent_eur,
      (SELECT quantile_cont(revenu_mensuel_recurrent_eur, 0.5) FROM accounts)) AS revenu_mensuel_recurrent_eur
    FROM accounts""",
)
def impute_by_median(spark, folder):
    df = accounts(spark, folder).select("client_id", "revenu_mensuel_recurrent_eur")
    return features.impute_by_median(df, "revenu_mensuel_recurrent_eur")


_MODEL = [*NUMERIC, "secteur", "pays", "taille_entreprise", "plan"]


@query(
    "prepare_features",
    f"{ACC}, base AS (SELECT * REPLACE ({REBUILT} AS taux_adoption_pct) FROM accounts) "
    f"SELECT k, {', '.join(_MODEL)}, {FEATURE_LIST} FROM base",
)
def prepare_features(spark, folder):
    df = accounts(spark, folder).drop("p", "t0")
    return features.prepare_features(df, SUSPECTED_DECOYS)


@query(
    "regression_features",
    f"{ACC} SELECT k, {', '.join(_MODEL)}, couleur_theme_interface, code_datacenter, groupe_experimentation FROM accounts",
)
def regression_features(spark, folder):
    return features.regression_features(accounts(spark, folder).drop("p", "t0"))


@query("monitoring_reference", f"{ACC} SELECT k, {', '.join(NUMERIC)}, p FROM accounts")
def monitoring_reference(spark, folder):
    return features.monitoring_reference(accounts(spark, folder))


@query(
    "rule_baseline",
    ACC + """ SELECT client_id, CAST(coalesce(derniere_connexion_jours > 30, false) OR coalesce(csat <= 2, false)
      AS INTEGER) AS regle FROM accounts""",
)
def rule_baseline(spark, folder):
    df = accounts(spark, folder)
    return df.select("client_id", features.rule_baseline(df).alias("regle"))


_REQUEST = [name for name, *_ in quality.REQUEST_CONTRACT]


@query(
    "request_features",
    f"{ACC}, base AS (SELECT client_id, {', '.join(REBUILT + ' AS taux_adoption_pct' if c == 'taux_adoption_pct' else c for c in _REQUEST)} "
    f"FROM accounts) {CHAIN}",
)
def request_features(spark, folder):
    requests = accounts(spark, folder).select("client_id", *_REQUEST)
    return features.request_features(requests, references.catalogue(spark))


_EMPTY = sorted(f for f in quality.NULLABLE_FIELDS if f not in quality.RECOMPUTED_FIELDS)


@query(
    "imputed_fields",
    f"{ACC} SELECT client_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _EMPTY) + ") AS champs_imputes FROM accounts",
)
def imputed_fields(spark, folder):
    df = accounts(spark, folder)
    return df.select("client_id", F.array_join(features.imputed_fields(), ",").alias("champs_imputes"))


@query(
    "risk_signals",
    ACC + """, s AS (SELECT client_id, list_filter([
      CASE WHEN derniere_connexion_jours > 30 THEN 'inactivité élevée (' || derniere_connexion_jours || ' j sans connexion)' END,
      CASE WHEN csat <= 2 THEN 'satisfaction faible (CSAT = ' || csat || '.0)' END,
      CASE WHEN retards_paiement_12m > 0 THEN 'retards de paiement (' || retards_paiement_12m || ' sur 12 mois)' END,
      CASE WHEN taux_adoption_pct < 30 THEN 'adoption faible (' || CAST(round_even(taux_adoption_pct, 0) AS BIGINT) || ' %)' END,
      CASE WHEN tickets_support_90j > 5 THEN 'volume élevé de tickets (' || tickets_support_90j || ' sur 90 jours)' END,
      CASE WHEN fonctionnalites_utilisees / CAST(fonctionnalites_total AS DOUBLE) < 0.33 THEN
        'couverture fonctionnelle faible (' || CAST(round_even(100 * (fonctionnalites_utilisees
          / CAST(fonctionnalites_total AS DOUBLE)), 0) AS BIGINT) || '%)' END], lambda x: x IS NOT NULL) AS l FROM accounts)
    SELECT client_id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], ' | ')
      ELSE 'aucun signal négatif identifié' END AS signaux FROM s""",
)
def risk_signals(spark, folder):
    df = accounts(spark, folder)
    return df.select("client_id", F.array_join(features.risk_signals(), " | ").alias("signaux"))
