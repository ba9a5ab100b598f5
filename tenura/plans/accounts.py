"""The account view: one row per customer, derived from the star-schema tables.

Features use orders up to a cut date, the label uses later orders, so the label is not a
function of the features. The DuckDB text of the same view is in `accounts_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.params import DAYS_PER_MONTH
from tenura.sources.tables import table

HORIZON_DAYS = 270

# Countries given to the first nation keys; other nations keep their name.
COUNTRIES = (
    "France", "Allemagne", "Espagne", "Italie", "Pays-Bas", "Belgique", "Portugal", "Suède",
    "Pologne", "Autriche", "Danemark", "Finlande", "Suisse", "Royaume-Uni", "États-Unis",
    "Canada", "Australie", "Japon", "Brésil", "Inde",
)

# Sector given to each market segment; the last one has no reference row.
SECTORS = {
    "AUTOMOBILE": "Industrie",
    "BUILDING": "Immobilier",
    "FURNITURE": "Commerce",
    "MACHINERY": "tech",
    "HOUSEHOLD": "Divers",
}

THEMES = ("clair", "sombre", "bleu", "vert", "contraste")

NUMERIC = (
    "anciennete_mois",
    "sieges_souscrits",
    "utilisateurs_actifs",
    "taux_adoption_pct",
    "connexions_30j",
    "heures_usage_30j",
    "fonctionnalites_total",
    "fonctionnalites_utilisees",
    "nb_integrations",
    "derniere_connexion_jours",
    "tickets_support_90j",
    "delai_reponse_support_h",
    "csat",
    "retards_paiement_12m",
    "revenu_mensuel_recurrent_eur",
)
CATEGORICAL = ("secteur", "pays", "taille_entreprise", "plan")
DECOYS = ("couleur_theme_interface", "code_datacenter", "groupe_experimentation")


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _pick(index: str, values: tuple[str, ...]) -> str:
    return f"element_at(array({_quoted(values)}), CAST({index} + 1 AS INT))"


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their line counts; lines are pre-aggregated on the join key."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr("count(*) AS n_lines"),
            F.expr("count_if(l_returnflag <> 'R') AS n_kept"),
            F.expr("sum(l_quantity) AS quantity"),
        )
    )
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS price",
        "CAST(o_orderdate AS DATE) AS d",
    )
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")


def cut_date(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the date that separates features from label."""
    last = table(spark, folder, "orders").agg(F.expr("CAST(max(o_orderdate) AS DATE) AS last"))
    return last.selectExpr(f"date_sub(last, {HORIZON_DAYS}) AS t0")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer: features from orders up to the cut, label from later ones."""
    facts = order_facts(spark, folder).crossJoin(F.broadcast(cut_date(spark, folder)))
    return facts.groupBy("o_custkey").agg(
        *[
            F.expr(e)
            for e in (
                "max(t0) AS t0",
                "min(d) FILTER (WHERE d <= t0) AS first",
                "max(d) FILTER (WHERE d <= t0) AS last",
                "count_if(d <= t0) AS n_past",
                "count_if(d > t0) AS n_future",
                "count_if(d <= t0 AND o_orderstatus = 'F') AS n_late",
                "count_if(d <= t0 AND o_orderpriority = '1-URGENT') AS n_urgent",
                "sum(n_lines) FILTER (WHERE d <= t0) AS seats",
                "sum(n_kept) FILTER (WHERE d <= t0) AS users",
                "sum(quantity) FILTER (WHERE d <= t0) AS quantity",
                "CAST(sum(price) FILTER (WHERE d <= t0) AS DOUBLE) AS spent",
            )
        ]
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    activity = table(spark, folder, "events").groupBy("user_id").agg(F.expr("count(*) AS n_events"))
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    base = (
        table(spark, folder, "customer")
        .join(_history(spark, folder), F.expr("c_custkey = o_custkey"), "left")
        .join(activity, F.expr("c_custkey = user_id"), "left")
        .join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"), "left")
        .selectExpr(
            "*",
            "c_custkey AS k",
            "seats - users AS returned",
            "coalesce(n_past, 0) AS past",
            "coalesce(n_future, 0) AS future",
            "10 + 5 * (c_custkey % 3) AS total",
            "CAST(floor(date_diff(t0, last) / 4D) AS BIGINT) AS recency",
            "CASE c_mktsegment "
            + " ".join(f"WHEN '{source}' THEN '{label}'" for source, label in SECTORS.items())
            + " END AS sector",
            f"CASE WHEN c_nationkey < {len(COUNTRIES)} "
            f"THEN {_pick(f'c_nationkey % {len(COUNTRIES)}', COUNTRIES)} ELSE n_name END AS country",
        )
    )
    return base.selectExpr(
        "k",
        "concat('CLI-', lpad(CAST(k AS STRING), 12, '0')) AS client_id",
        "first AS date_souscription",
        "CASE WHEN k % 23 <> 0 THEN CASE k % 4 WHEN 0 THEN sector WHEN 1 THEN lower(sector) "
        "WHEN 2 THEN concat(' ', sector) ELSE concat(sector, ' ') END END AS secteur",
        "CASE WHEN k % 27 <> 0 THEN country END AS pays",
        "CASE WHEN c_acctbal < 0 THEN 'TPE' WHEN c_acctbal < 3000 THEN 'PME' "
        "WHEN c_acctbal < 7000 THEN 'ETI' ELSE 'GE' END AS taille_entreprise",
        _pick("k % 4", ("Starter", "pro", " BUSINESS", "Enterprise ")) + " AS plan",
        f"CAST(round(date_diff(t0, first) / {DAYS_PER_MONTH}D) AS BIGINT) AS anciennete_mois",
        "seats AS sieges_souscrits",
        "users AS utilisateurs_actifs",
        "CASE WHEN k % 20 <> 0 AND seats > 0 THEN 100D * users / seats END AS taux_adoption_pct",
        "past * 3 + coalesce(n_events, 0) AS connexions_30j",
        "CASE WHEN k % 17 <> 0 THEN quantity / 10D END AS heures_usage_30j",
        "total AS fonctionnalites_total",
        "least(total, past) AS fonctionnalites_utilisees",
        "CASE WHEN k % 29 <> 0 THEN coalesce(n_urgent, 0) END AS nb_integrations",
        "recency AS derniere_connexion_jours",
        "coalesce(returned, 0) AS tickets_support_90j",
        "CASE WHEN k % 7 <> 0 AND returned > 0 THEN (returned * 37) % 48 + 0.5D END "
        "AS delai_reponse_support_h",
        "CASE WHEN k % 13 <> 0 THEN 1 + k % 5 END AS csat",
        "CASE WHEN k % 19 <> 0 THEN coalesce(n_late, 0) % 8 END AS retards_paiement_12m",
        "CASE WHEN k % 33 <> 0 AND past > 0 THEN spent / past / 100D END "
        "AS revenu_mensuel_recurrent_eur",
        "spent / 10D AS valeur_vie_client_eur",
        _pick("k * 7919 % 5", THEMES) + " AS couleur_theme_interface",
        "concat('DC', CAST(k * 104729 % 7 AS STRING)) AS code_datacenter",
        "CASE WHEN k * 31 % 2 = 0 THEN 'A' ELSE 'B' END AS groupe_experimentation",
        "CASE WHEN k % 11 <> 0 THEN CASE WHEN future = 0 THEN 'risque de depart' "
        "WHEN future = 1 THEN 'a surveiller' ELSE 'client satisfait' END END AS commentaire_csm",
        "future AS sante_compte_fin_periode",
        "CASE WHEN future = 0 THEN 1 ELSE 0 END AS churn",
        "coalesce(recency, 0) / (coalesce(recency, 0) + 60D) AS p",
        "t0",
    )


def _pick_sql(index: str, values: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({index} + 1 AS INTEGER))"


def accounts_sql() -> str:
    """WITH clause (no leading WITH) that defines `accounts` in DuckDB."""
    k = "c_custkey"
    sector = " ".join(f"WHEN c_mktsegment = '{s}' THEN '{v}'" for s, v in SECTORS.items())
    sector = f"(CASE {sector} END)"
    countries = _pick_sql(f"(c_nationkey % {len(COUNTRIES)})", COUNTRIES)
    recency = "CAST(floor((t0 - last) / 4.0) AS BIGINT)"
    return f"""
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag <> 'R') AS n_kept,
         sum(l_quantity) AS quantity
  FROM lineitem GROUP BY l_orderkey),
cut AS (SELECT CAST(max(o_orderdate) AS DATE) - {HORIZON_DAYS} AS t0 FROM orders),
facts AS (
  SELECT o.*, l.*, t0, CAST(o_orderdate AS DATE) AS d,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CAST(o_orderdate AS DATE) <= t0 AS past
  FROM orders o LEFT JOIN lines l ON o_orderkey = l_orderkey CROSS JOIN cut),
history AS (
  SELECT o_custkey, max(t0) AS t0, min(d) FILTER (past) AS first, max(d) FILTER (past) AS last,
    count(*) FILTER (past) AS n_past, count(*) FILTER (NOT past) AS n_future,
    count(*) FILTER (past AND o_orderstatus = 'F') AS n_late,
    count(*) FILTER (past AND o_orderpriority = '1-URGENT') AS n_urgent,
    CAST(sum(n_lines) FILTER (past) AS BIGINT) AS seats,
    CAST(sum(n_kept) FILTER (past) AS BIGINT) AS users,
    sum(quantity) FILTER (past) AS quantity,
    CAST(sum(price) FILTER (past) AS DOUBLE) AS spent
  FROM facts GROUP BY o_custkey),
activity AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id),
accounts AS (
  SELECT {k} AS k,
    'CLI-' || lpad(CAST({k} AS VARCHAR), 12, '0') AS client_id,
    first AS date_souscription,
    CASE WHEN {k} % 23 <> 0 THEN CASE {k} % 4 WHEN 0 THEN {sector} WHEN 1 THEN lower({sector})
      WHEN 2 THEN ' ' || {sector} ELSE {sector} || ' ' END END AS secteur,
    CASE WHEN {k} % 27 <> 0 THEN CASE WHEN c_nationkey < {len(COUNTRIES)}
      THEN {countries} ELSE n_name END END AS pays,
    CASE WHEN c_acctbal < 0 THEN 'TPE' WHEN c_acctbal < 3000 THEN 'PME'
      WHEN c_acctbal < 7000 THEN 'ETI' ELSE 'GE' END AS taille_entreprise,
    {_pick_sql(f"({k} % 4)", ("Starter", "pro", " BUSINESS", "Enterprise "))} AS plan,
    CAST(round((t0 - first) / {DAYS_PER_MONTH}) AS BIGINT) AS anciennete_mois,
    seats AS sieges_souscrits, users AS utilisateurs_actifs,
    CASE WHEN {k} % 20 <> 0 AND seats > 0
      THEN CAST(100.0 AS DOUBLE) * users / seats END AS taux_adoption_pct,
    coalesce(n_past, 0) * 3 + coalesce(n_events, 0) AS connexions_30j,
    CASE WHEN {k} % 17 <> 0 THEN quantity / CAST(10 AS DOUBLE) END AS heures_usage_30j,
    10 + 5 * ({k} % 3) AS fonctionnalites_total,
    least(10 + 5 * ({k} % 3), coalesce(n_past, 0)) AS fonctionnalites_utilisees,
    CASE WHEN {k} % 29 <> 0 THEN coalesce(n_urgent, 0) END AS nb_integrations,
    {recency} AS derniere_connexion_jours,
    coalesce(seats - users, 0) AS tickets_support_90j,
    CASE WHEN {k} % 7 <> 0 AND seats - users > 0
      THEN CAST(((seats - users) * 37) % 48 + 0.5 AS DOUBLE) END AS delai_reponse_support_h,
    CASE WHEN {k} % 13 <> 0 THEN 1 + {k} % 5 END AS csat,
    CASE WHEN {k} % 19 <> 0 THEN coalesce(n_late, 0) % 8 END AS retards_paiement_12m,
    CASE WHEN {k} % 33 <> 0 AND n_past > 0
      THEN spent / n_past / CAST(100 AS DOUBLE) END AS revenu_mensuel_recurrent_eur,
    spent / CAST(10 AS DOUBLE) AS valeur_vie_client_eur,
    {_pick_sql(f"({k} * 7919 % 5)", THEMES)} AS couleur_theme_interface,
    'DC' || CAST({k} * 104729 % 7 AS VARCHAR) AS code_datacenter,
    CASE WHEN {k} * 31 % 2 = 0 THEN 'A' ELSE 'B' END AS groupe_experimentation,
    CASE WHEN {k} % 11 <> 0 THEN CASE WHEN coalesce(n_future, 0) = 0 THEN 'risque de depart'
      WHEN n_future = 1 THEN 'a surveiller' ELSE 'client satisfait' END END AS commentaire_csm,
    coalesce(n_future, 0) AS sante_compte_fin_periode,
    CASE WHEN coalesce(n_future, 0) = 0 THEN 1 ELSE 0 END AS churn,
    CAST(coalesce({recency}, 0) AS DOUBLE) / (coalesce({recency}, 0) + 60.0) AS p,
    t0
  FROM customer
  LEFT JOIN history ON c_custkey = o_custkey
  LEFT JOIN activity ON c_custkey = user_id
  LEFT JOIN nation ON c_nationkey = n_nationkey)"""
