"""Fixed reference tables, small by construction and therefore safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (plan, price per seat, included features, SLA hours, storage GB, dedicated support).
PLANS = (
    ("Starter", 15, 10, 24, 50, "non"),
    ("Pro", 30, 20, 12, 250, "non"),
    ("Business", 50, 30, 8, 1000, "oui"),
    ("Enterprise", 80, 40, 4, 2000, "oui"),
)
PLAN_COLUMNS = (
    "plan",
    "prix_mensuel_par_siege_eur",
    "fonctionnalites_incluses",
    "sla_reponse_h",
    "quota_stockage_go",
    "support_dedie",
)

# Fixed values: (sector, median churn in %, growth class).
SECTORS = (
    ("Technologie", 4.5, "forte"),
    ("Finance", 6.0, "moderee"),
    ("Santé", 5.0, "forte"),
    ("Industrie", 7.5, "stable"),
    ("Services", 6.5, "moderee"),
    ("Commerce", 8.0, "moderee"),
    ("Éducation", 5.5, "forte"),
    ("Immobilier", 9.0, "stable"),
    ("Télécommunications", 10.0, "stable"),
    ("Médias", 8.5, "contraction"),
    ("Logistique", 7.0, "moderee"),
    ("Énergie", 6.0, "forte"),
)
SECTOR_FALLBACK = (7.0, "moderee")
SECTOR_ALIASES = {"tech": "Technologie"}

# Fixed values: (country, regulatory zone, French-language support, hours from Paris).
COUNTRIES = (
    ("France", "ue_rgpd", True, 0),
    ("Allemagne", "ue_rgpd", False, 0),
    ("Espagne", "ue_rgpd", False, 0),
    ("Italie", "ue_rgpd", False, 0),
    ("Pays-Bas", "ue_rgpd", False, 0),
    ("Belgique", "ue_rgpd", True, 0),
    ("Portugal", "ue_rgpd", False, 0),
    ("Suède", "ue_rgpd", False, 0),
    ("Pologne", "ue_rgpd", False, 0),
    ("Autriche", "ue_rgpd", False, 0),
    ("Danemark", "ue_rgpd", False, 0),
    ("Finlande", "ue_rgpd", False, 0),
    ("Suisse", "hors_ue", True, 0),
    ("Royaume-Uni", "hors_ue", False, 0),
    ("États-Unis", "us_ccpa", False, -6),
    ("Canada", "hors_ue", True, -6),
    ("Australie", "hors_ue", False, 9),
    ("Japon", "hors_ue", False, 8),
    ("Brésil", "hors_ue", False, -4),
    ("Inde", "hors_ue", False, 5),
)
COUNTRY_FALLBACK = ("autre", False, 0)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS,
        "plan string, prix_mensuel_par_siege_eur int, fonctionnalites_incluses int, "
        "sla_reponse_h int, quota_stockage_go int, support_dedie string",
    )


def sectors(spark: SparkSession) -> DataFrame:
    """(cle, taux_churn_median_saas_pct, dynamique_croissance), aliases included."""
    rows = [(name.lower(), churn, growth) for name, churn, growth in SECTORS]
    rows += [
        (alias, churn, growth)
        for alias, target in SECTOR_ALIASES.items()
        for name, churn, growth in SECTORS
        if name == target
    ]
    return spark.createDataFrame(
        rows, "cle string, taux_churn_median_saas_pct double, dynamique_croissance string"
    )


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name.lower(), zone, french, hours) for name, zone, french, hours in COUNTRIES],
        "cle string, zone_reglementaire string, langue_support_fr boolean, "
        "decalage_horaire_paris_h int",
    )


def values_sql(rows, names) -> str:
    """VALUES list of one of the tables above, for the SQL twins."""

    def literal(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(names)}))"
