"""The raw export: the account view written as dirty text, with exact copies of some rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenura.params import MISSING_MARKERS
from tenura.plans.accounts import accounts, accounts_sql

NUMBERS = (
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
    "valeur_vie_client_eur",
    "sante_compte_fin_periode",
    "churn",
)
LABELS = (
    "client_id",
    "secteur",
    "pays",
    "taille_entreprise",
    "plan",
    "couleur_theme_interface",
    "code_datacenter",
    "groupe_experimentation",
    "commentaire_csm",
)
COLUMNS = (*LABELS, "date_souscription", *NUMBERS)


def _fixed(cents: str, separator: str = ".") -> str:
    """Amount in cents written with two decimals."""
    return (
        f"concat(CAST(({cents}) div 100 AS STRING), '{separator}', "
        f"lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"
    )


def _whole(c: str) -> str:
    return f"coalesce(CAST({c} AS STRING), '')"


def _texts() -> dict[str, str]:
    """Spark SQL expression of each raw text column."""
    texts = {
        "date_souscription": "coalesce(CASE k % 3 WHEN 0 THEN date_format(date_souscription, 'yyyy-MM-dd') "
        "WHEN 1 THEN date_format(date_souscription, 'dd/MM/yyyy') "
        "ELSE date_format(date_souscription, 'dd MMM yyyy') END, '')",
        "utilisateurs_actifs": "coalesce(CAST(CASE WHEN k % 41 = 0 THEN utilisateurs_actifs + 50 "
        "ELSE utilisateurs_actifs END AS STRING), '')",
        "taux_adoption_pct": f"CASE WHEN rate IS NULL THEN 'n/a' WHEN k % 20 < 6 THEN {_fixed('rate', ',')} "
        f"WHEN k % 20 < 10 THEN concat({_fixed('rate')}, ' %') "
        f"WHEN k % 20 = 10 THEN {_fixed('rate + 10000')} ELSE {_fixed('rate')} END",
        "heures_usage_30j": f"CASE WHEN hours IS NULL THEN '-' WHEN k % 5 = 0 THEN concat({_fixed('hours')}, ' h') "
        f"ELSE {_fixed('hours')} END",
        "derniere_connexion_jours": "CASE WHEN derniere_connexion_jours IS NULL THEN 'ND' "
        f"WHEN k % 6 = 0 THEN concat({_whole('derniere_connexion_jours')}, 'j') "
        f"ELSE {_whole('derniere_connexion_jours')} END",
        "tickets_support_90j": f"CASE WHEN k % 37 = 0 THEN '-3' ELSE {_whole('tickets_support_90j')} END",
        "csat": f"CASE WHEN csat IS NULL THEN 'NR' WHEN k % 43 = 0 THEN '7' ELSE {_whole('csat')} END",
        "retards_paiement_12m": "CASE WHEN retards_paiement_12m IS NULL THEN ' N/A ' "
        f"ELSE {_whole('retards_paiement_12m')} END",
        "revenu_mensuel_recurrent_eur": "CASE WHEN mrr IS NULL THEN '' WHEN k % 60 = 5 THEN 'n/c' "
        f"WHEN k % 6 = 1 THEN {_fixed('mrr', ',')} WHEN k % 6 = 2 THEN concat({_fixed('mrr', ',')}, ' €') "
        f"WHEN k % 6 = 3 THEN concat('€', {_fixed('mrr')}) WHEN k % 6 = 4 AND mrr >= 100000 THEN "
        "concat(CAST(mrr div 100000 AS STRING), decode(unhex('C2A0'), 'UTF-8'), "
        "lpad(CAST((mrr div 100) % 1000 AS STRING), 3, '0'), '.', lpad(CAST(mrr % 100 AS STRING), 2, '0')) "
        f"ELSE {_fixed('mrr')} END",
        "delai_reponse_support_h": f"coalesce({_fixed('delay')}, '')",
        "valeur_vie_client_eur": f"coalesce({_fixed('lifetime')}, '')",
    }
    texts |= {c: _whole(c) for c in NUMBERS if c not in texts}
    return texts | {c: f"coalesce({c}, '')" for c in LABELS}


def raw_accounts(spark: SparkSession, folder: str) -> DataFrame:
    cents = {
        "rate": "taux_adoption_pct",
        "hours": "heures_usage_30j",
        "mrr": "revenu_mensuel_recurrent_eur",
        "delay": "delai_reponse_support_h",
        "lifetime": "valeur_vie_client_eur",
    }
    source = accounts(spark, folder).selectExpr(
        "*", *[f"CAST(floor({c} * 100) AS BIGINT) AS {n}" for n, c in cents.items()]
    )
    texts = _texts()
    once = source.selectExpr("k", *[f"{texts[c]} AS {c}" for c in COLUMNS])
    twice = once.selectExpr("*", "explode(CASE WHEN k % 100 = 7 THEN array(1, 2) ELSE array(1) END)")
    return twice.select(*COLUMNS)


def _fixed_sql(cents: str, separator: str = ".") -> str:
    return f"(({cents}) // 100)::VARCHAR || '{separator}' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


def raw_sql() -> str:
    """CTEs `accounts` and `raw` for DuckDB."""
    rate = "CAST(floor(taux_adoption_pct * 100) AS BIGINT)"
    hours = "CAST(floor(heures_usage_30j * 100) AS BIGINT)"
    mrr = "CAST(floor(revenu_mensuel_recurrent_eur * 100) AS BIGINT)"
    delay = "CAST(floor(delai_reponse_support_h * 100) AS BIGINT)"
    value = "CAST(floor(valeur_vie_client_eur * 100) AS BIGINT)"
    whole = lambda c: f"coalesce({c}::VARCHAR, '')"
    columns = {
        "date_souscription": "coalesce(CASE k % 3 WHEN 0 THEN strftime(date_souscription, '%Y-%m-%d') "
        "WHEN 1 THEN strftime(date_souscription, '%d/%m/%Y') "
        "ELSE strftime(date_souscription, '%d %b %Y') END, '')",
        "utilisateurs_actifs": "coalesce((CASE WHEN k % 41 = 0 THEN utilisateurs_actifs + 50 "
        "ELSE utilisateurs_actifs END)::VARCHAR, '')",
        "taux_adoption_pct": f"CASE WHEN taux_adoption_pct IS NULL THEN 'n/a' "
        f"WHEN k % 20 < 6 THEN {_fixed_sql(rate, ',')} WHEN k % 20 < 10 THEN {_fixed_sql(rate)} || ' %' "
        f"WHEN k % 20 = 10 THEN {_fixed_sql(rate + ' + 10000')} ELSE {_fixed_sql(rate)} END",
        "heures_usage_30j": f"CASE WHEN heures_usage_30j IS NULL THEN '-' "
        f"WHEN k % 5 = 0 THEN {_fixed_sql(hours)} || ' h' ELSE {_fixed_sql(hours)} END",
        "derniere_connexion_jours": "CASE WHEN derniere_connexion_jours IS NULL THEN 'ND' WHEN k % 6 = 0 "
        "THEN derniere_connexion_jours::VARCHAR || 'j' ELSE derniere_connexion_jours::VARCHAR END",
        "tickets_support_90j": f"CASE WHEN k % 37 = 0 THEN '-3' ELSE {whole('tickets_support_90j')} END",
        "csat": "CASE WHEN csat IS NULL THEN 'NR' WHEN k % 43 = 0 THEN '7' ELSE csat::VARCHAR END",
        "retards_paiement_12m": "CASE WHEN retards_paiement_12m IS NULL THEN ' N/A ' "
        "ELSE retards_paiement_12m::VARCHAR END",
        "revenu_mensuel_recurrent_eur": f"CASE WHEN revenu_mensuel_recurrent_eur IS NULL THEN '' "
        f"WHEN k % 60 = 5 THEN 'n/c' WHEN k % 6 = 1 THEN {_fixed_sql(mrr, ',')} "
        f"WHEN k % 6 = 2 THEN {_fixed_sql(mrr, ',')} || ' €' WHEN k % 6 = 3 THEN '€' || {_fixed_sql(mrr)} "
        f"WHEN k % 6 = 4 AND {mrr} >= 100000 THEN ({mrr} // 100000)::VARCHAR || chr(160) "
        f"|| lpad((({mrr} // 100) % 1000)::VARCHAR, 3, '0') || '.' || lpad(({mrr} % 100)::VARCHAR, 2, '0') "
        f"ELSE {_fixed_sql(mrr)} END",
        "delai_reponse_support_h": f"coalesce({_fixed_sql(delay)}, '')",
        "valeur_vie_client_eur": f"coalesce({_fixed_sql(value)}, '')",
    }
    columns |= {c: whole(c) for c in NUMBERS if c not in columns}
    columns |= {c: f"coalesce({c}, '')" for c in LABELS}
    body = ", ".join(f"{columns[c]} AS {c}" for c in COLUMNS)
    return (
        f"{accounts_sql()}, raw AS (SELECT {body} FROM accounts "
        f"UNION ALL SELECT {body} FROM accounts WHERE k % 100 = 7)"
    )


# --- SQL twins of the text functions -------------------------------------------------------


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def markers_sql() -> str:
    return ", ".join(f"'{m}'" for m in MISSING_MARKERS)


def number_sql(table_name: str, columns: list[str], keep: list[str]) -> str:
    """SELECT that coerces `columns` of a text table: <c> (value) and <c>_s (status)."""
    shape = r"'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"

    def steps(c: str) -> list[str]:
        return [
            f"{strip_sql(c)} AS a_{c}",
            rf"regexp_replace({strip_sql(c)}, '[\x{{00A0}}\x{{202F}}]', '', 'g') AS b_{c}",
        ]

    first = ", ".join(s for c in columns for s in steps(c))
    second = ", ".join(
        f"a_{c}, "
        + rf"regexp_replace({strip_sql(f'''regexp_replace(b_{c}, '[€$£%]', '', 'g')''')}, "
        + rf"'([0-9])\s*(h|j|min)$', '\1', 'i') AS c_{c}"
        for c in columns
    )
    third = ", ".join(
        f"a_{c}, regexp_replace(CASE WHEN contains(c_{c}, ',') AND contains(c_{c}, '.') THEN "
        f"CASE WHEN instr(reverse(c_{c}), '.') < instr(reverse(c_{c}), ',') "
        f"THEN replace(c_{c}, ',', '') ELSE replace(replace(c_{c}, '.', ''), ',', '.') END "
        f"WHEN regexp_full_match(c_{c}, '[0-9]{{1,3}},[0-9]{{3}}') THEN replace(c_{c}, ',', '') "
        rf"ELSE replace(c_{c}, ',', '.') END, '([0-9])\s+([0-9])', '\1\2', 'g') AS d_{c}"
        for c in columns
    )
    final = ", ".join(
        f"CASE WHEN a_{c} IS NULL OR lower(a_{c}) IN ({markers_sql()}) THEN NULL "
        f"WHEN regexp_full_match(a_{c}, {shape}) THEN TRY_CAST(a_{c} AS DOUBLE) "
        f"WHEN regexp_full_match(d_{c}, {shape}) THEN TRY_CAST(d_{c} AS DOUBLE) END AS {c}, "
        f"CASE WHEN a_{c} IS NULL OR lower(a_{c}) IN ({markers_sql()}) THEN 'manquant' "
        f"WHEN regexp_full_match(a_{c}, {shape}) THEN 'direct' "
        f"WHEN regexp_full_match(d_{c}, {shape}) THEN 'repare' ELSE 'irrecuperable' END AS {c}_s"
        for c in columns
    )
    kept = "".join(f"{c}, " for c in keep)
    return (
        f"SELECT {kept}{final} FROM (SELECT {kept}{third} FROM (SELECT {kept}{second} FROM "
        f"(SELECT {kept}{first} FROM {table_name})))"
    )


def date_sql(c: str) -> str:
    """The three formats that occur in `raw`, day first."""
    t = strip_sql(c)
    return (
        f"coalesce(TRY_STRPTIME({t}, '%Y-%m-%d'), TRY_STRPTIME({t}, '%d/%m/%Y'), "
        f"TRY_STRPTIME({t}, '%d %b %Y'))::DATE"
    )


def deliver(spark, folder: str, path: str) -> str:
    """Write the export as delivered CSV files; spaces around labels are part of the text."""
    (raw_accounts(spark, folder).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("escape", '"').csv(path))
    return path
