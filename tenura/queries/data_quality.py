"""Queries over the raw export: scans, profiling, cleaning, rules, missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions import text
from tenura.operators import primitives, quality, references
from tenura.params import MISSING_MARKERS
from tenura.plans import raw as raw_plan
from tenura.plans.accounts import CATEGORICAL, NUMERIC, accounts, accounts_sql
from tenura.plans.raw import NUMBERS, number_sql, raw_accounts, raw_sql
from tenura.queries.registry import query
from tenura.sources import files
from tenura.sources.tables import table

RAW = f"WITH {raw_sql()}"
ACC = f"WITH {accounts_sql()}"
ALL_RAW = ", ".join(raw_plan.COLUMNS)
COERCED = [
    "utilisateurs_actifs",
    "taux_adoption_pct",
    "heures_usage_30j",
    "derniere_connexion_jours",
    "csat",
    "retards_paiement_12m",
    "revenu_mensuel_recurrent_eur",
]
STRIPPED = raw_plan.strip_sql


def _null_markers(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({raw_plan.markers_sql()}) THEN {c} END"


NULLED = ", ".join(f"{_null_markers(c)} AS {c}" for c in raw_plan.COLUMNS)


@query(
    "scan_raw_text",
    f"{RAW} SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in raw_plan.COLUMNS) + " FROM raw",
)
def scan_raw_text(spark, folder):
    """The export as delivered, read by the scanner: all text, gaps empty."""
    return files.scan_raw_text(spark, raw_plan.deliver(spark, folder, files.scratch(spark, "raw")))


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, folder):
    return files.scan_parquet_or_csv(spark, f"{folder}/customer.parquet")


@query("null_out_markers", f"{RAW} SELECT {NULLED} FROM raw")
def null_out_markers(spark, folder):
    return quality.null_out_markers(raw_accounts(spark, folder), MISSING_MARKERS)


_PROFILED = ("secteur", "plan", "pays", "csat", "taux_adoption_pct", "revenu_mensuel_recurrent_eur")
@query(
    "profile",
    RAW
    + ", sources AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS colonne, {c} AS valeur FROM raw" for c in _PROFILED)
    + "), parsed AS ("
    + number_sql("(SELECT *, valeur AS texte FROM sources)", ["valeur"], ["colonne", "texte"])
    + """), counts AS (SELECT colonne, texte AS brut, count(*) AS n, any_value(valeur) AS v,
        any_value(valeur_s) AS s FROM parsed GROUP BY colonne, texte),
    tops AS (SELECT colonne, string_agg(brut, ' | ' ORDER BY rang) AS top3_valeurs FROM (
        SELECT *, row_number() OVER (PARTITION BY colonne ORDER BY n DESC, brut) AS rang
        FROM counts) WHERE rang <= 3 GROUP BY colonne),
    per AS (SELECT colonne, CAST(sum(n) AS BIGINT) AS n, count(*) AS card, min(v) AS lo, max(v) AS hi,
        coalesce(sum(n) FILTER (v IS NOT NULL), 0)
          / nullif(CAST(sum(n) FILTER (s <> 'manquant') AS DOUBLE), 0) > 0.8 AS num
        FROM counts GROUP BY colonne)
    SELECT colonne, 'string' AS type, n AS nb_non_nuls, CAST(0.0 AS DOUBLE) AS taux_manquants,
      card AS cardinalite, top3_valeurs, CASE WHEN num THEN lo END AS min,
      CASE WHEN num THEN hi END AS max, num AS numerique_en_texte
    FROM per JOIN tops USING (colonne)""",
)
def profile(spark, folder):
    return quality.profile(raw_accounts(spark, folder).select(*_PROFILED))


@query(
    "duplicate_report",
    RAW
    + f""", g AS (SELECT client_id, count(*) AS c FROM raw GROUP BY {ALL_RAW}),
    k AS (SELECT sum(c) AS lignes, coalesce(sum(c) FILTER (c > 1), 0) AS exact FROM g GROUP BY client_id)
    SELECT CAST(sum(lignes) AS BIGINT) AS nb_total_lignes,
      CAST(sum(exact) AS BIGINT) AS nb_doublons_exacts,
      CAST(coalesce(sum(lignes) FILTER (lignes > 1), 0) AS BIGINT) AS nb_doublons_cle_metier,
      CAST(coalesce(sum(lignes - exact) FILTER (lignes > 1), 0) AS BIGINT)
        AS nb_doublons_cle_metier_non_exacts FROM k""",
)
def duplicate_report(spark, folder):
    return quality.duplicate_report(raw_accounts(spark, folder), "client_id")


@query(
    "duplicate_examples",
    RAW
    + """, k AS (SELECT client_id, count(*) AS lignes FROM raw GROUP BY client_id HAVING count(*) > 1
      ORDER BY client_id LIMIT 10)
    SELECT 'exact' AS nature, client_id, lignes FROM k UNION ALL
    SELECT 'cle', client_id, lignes FROM k""",
)
def duplicate_examples(spark, folder):
    return quality.duplicate_examples(raw_accounts(spark, folder), "client_id")


@query("drop_exact_duplicates", f"{RAW} SELECT DISTINCT {ALL_RAW} FROM raw")
def drop_exact_duplicates(spark, folder):
    return quality.drop_exact_duplicates(raw_accounts(spark, folder))


@query(
    "coerce_number",
    RAW + ", c AS (" + number_sql("raw", COERCED, ["client_id"]) + ") SELECT client_id, "
    + ", ".join(f"{c}, {c}_s" for c in COERCED) + " FROM c",
)
def coerce_number(spark, folder):
    raw = raw_accounts(spark, folder)
    parsed = raw.select("client_id", *[text.coerce_number(c).alias(c) for c in COERCED])
    return parsed.select(
        "client_id",
        *[F.col(f"{c}.value").alias(c) for c in COERCED],
        *[F.col(f"{c}.status").alias(f"{c}_s") for c in COERCED],
    )


@query(
    "coercion_report",
    RAW + ", c AS (" + number_sql("raw", list(NUMBERS), []) + ") "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS colonne, count(*) FILTER ({c}_s = 'direct') AS nb_directes,
        count(*) FILTER ({c}_s = 'repare') AS nb_reparees,
        count(*) FILTER ({c}_s = 'manquant') AS nb_manquants,
        count(*) FILTER ({c}_s = 'irrecuperable') AS nb_irrecuperables FROM c"""
        for c in NUMBERS
    ),
)
def coercion_report(spark, folder):
    return quality.coercion_report(raw_accounts(spark, folder), NUMBERS)


@query(
    "numeric_text_columns",
    RAW + ", c AS (" + number_sql("raw", list(raw_plan.COLUMNS), []) + ") "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS colonne, round(count({c}) / nullif(CAST(count(*)
        FILTER ({c}_s <> 'manquant') AS DOUBLE), 0), 6) AS part_numerique,
        coalesce(count({c}) / nullif(CAST(count(*) FILTER ({c}_s <> 'manquant') AS DOUBLE), 0)
        > 0.8, false) AS numerique FROM c"""
        for c in raw_plan.COLUMNS
    ),
)
def numeric_text_columns(spark, folder):
    found = quality.numeric_text_columns(raw_accounts(spark, folder))
    return found.withColumn("part_numerique", F.round("part_numerique", 6))


_SLASH = STRIPPED("date_souscription")
_SLASHED = (
    rf"regexp_full_match({_SLASH}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')"
)
_SLASH_CTE = f""", s AS (SELECT count(*) FILTER ({_SLASHED}) AS nb_barres,
  count(*) FILTER ({_SLASHED} AND TRY_CAST(split_part({_SLASH}, '/', 1) AS INT) > 12) AS nb_premier,
  count(*) FILTER ({_SLASHED} AND TRY_CAST(split_part({_SLASH}, '/', 2) AS INT) > 12) AS nb_second,
  count(*) FILTER ({_SLASHED} AND TRY_CAST(split_part({_SLASH}, '/', 1) AS INT) <= 12
    AND TRY_CAST(split_part({_SLASH}, '/', 2) AS INT) <= 12) AS nb_ambigues FROM raw)"""


@query(
    "slash_convention",
    RAW + _SLASH_CTE
    + """ SELECT CASE WHEN nb_barres = 0 THEN '' WHEN nb_second > 0 AND nb_premier = 0
    THEN 'MM/DD/YYYY' ELSE 'DD/MM/YYYY' END AS convention, * FROM s""",
)
def slash_convention(spark, folder):
    return quality.slash_convention(raw_accounts(spark, folder), "date_souscription")


@query(
    "parse_dates",
    f"{RAW} SELECT client_id, {raw_plan.date_sql('date_souscription')} AS date_souscription FROM raw",
)
def parse_dates(spark, folder):
    raw = raw_accounts(spark, folder).select("client_id", "date_souscription")
    return quality.parse_dates(raw, ["date_souscription"])


@query(
    "date_report",
    RAW + _SLASH_CTE
    + f""", f AS (SELECT count(*) FILTER ({_SLASH} <> '') AS filled,
      count(TRY_STRPTIME({_SLASH}, '%Y-%m-%d')) AS a, count(TRY_STRPTIME({_SLASH}, '%d/%m/%Y')) AS b,
      count(TRY_STRPTIME({_SLASH}, '%d %b %Y')) AS c FROM raw)
    SELECT 'date_souscription' AS colonne,
      CASE WHEN a >= b AND a >= c THEN '%Y-%m-%d' WHEN b >= c THEN '%d/%m/%Y' ELSE '%d %b %Y' END
        AS format_detecte,
      '%Y-%m-%d : ' || a || ' | %d/%m/%Y : ' || b || ' | %d %b %Y : ' || c AS repartition_formats,
      'DD/MM/YYYY' AS convention_retenue, a + b + c AS nb_parsees, nb_ambigues,
      filled - a - b - c AS nb_irrecuperables FROM f, s""",
)
def date_report(spark, folder):
    return quality.date_report(raw_accounts(spark, folder), ["date_souscription"])


_IMPLIED = (
    "date_diff('day', DATE '1970-01-01', date_souscription) * CAST(86400.0 AS DOUBLE) "
    "+ CAST(anciennete_mois AS DOUBLE) * CAST(30.44 * 86400.0 AS DOUBLE)"
)
_REFERENCE = f""", r AS (SELECT CAST(DATE '1970-01-01' + CAST(floor(quantile_cont({_IMPLIED}, 0.5)
  / 86400.0) AS INT) AS DATE) AS date_reference FROM accounts)"""


@query("estimate_reference_date", ACC + _REFERENCE + " SELECT * FROM r")
def estimate_reference_date(spark, folder):
    return quality.estimate_reference_date(accounts(spark, folder))


@query(
    "tenure_diagnosis",
    ACC + _REFERENCE
    + f""", i AS (SELECT {_IMPLIED} AS s, anciennete_mois, date_souscription FROM accounts)
    SELECT date_reference,
      CAST(DATE '1970-01-01' + CAST(floor(min(s) / 86400.0) AS INT) AS DATE) AS implicite_min,
      CAST(DATE '1970-01-01' + CAST(floor(max(s) / 86400.0) AS INT) AS DATE) AS implicite_max,
      CAST(floor((max(s) - min(s)) / 86400.0) AS BIGINT) AS etendue_jours,
      CAST(floor((quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) / 86400.0) AS BIGINT) AS iqr_jours,
      bool_and(anciennete_mois % 1 = 0) AS anciennete_entiere,
      max(date_souscription) AS date_souscription_max FROM i, r GROUP BY date_reference""",
)
def tenure_diagnosis(spark, folder):
    return quality.tenure_diagnosis(accounts(spark, folder))


@query(
    "tenure_gaps",
    ACC + _REFERENCE
    + """ SELECT CAST(anciennete_mois - round_even(date_diff('day', date_souscription, date_reference)
        / 30.44, 0) AS BIGINT) AS ecart_mois, count(*) AS n FROM accounts, r
    WHERE anciennete_mois IS NOT NULL GROUP BY 1""",
)
def tenure_gaps(spark, folder):
    df = accounts(spark, folder)
    return quality.tenure_gaps(df, quality.estimate_reference_date(df))


_RULED = [
    "taux_adoption_pct", "csat", "churn", "sieges_souscrits", "utilisateurs_actifs",
    "connexions_30j", "derniere_connexion_jours", "tickets_support_90j",
]
_RULES = [
    ("taux_adoption_pct hors [0, 100]", "taux_adoption_pct",
     "taux_adoption_pct < 0 OR taux_adoption_pct > 100"),
    ("csat hors [1, 5]", "csat", "csat < 1 OR csat > 5"),
    ("churn hors {0, 1}", "churn", "churn NOT IN (0, 1)"),
    *[(f"{c} < 0", c, f"{c} < 0") for c in _RULED
      if c not in ("taux_adoption_pct", "csat", "churn")],
    ("utilisateurs_actifs > sieges_souscrits", "utilisateurs_actifs / sieges_souscrits",
     "utilisateurs_actifs > sieges_souscrits"),
    ("taux_adoption_pct incoherent (ecart > 1 point)",
     "taux_adoption_pct / utilisateurs_actifs / sieges_souscrits",
     "sieges_souscrits > 0 AND abs(taux_adoption_pct - 100 * utilisateurs_actifs / sieges_souscrits) > 1"),
    ("connexions_30j > 0 et derniere_connexion_jours > 30",
     "connexions_30j / derniere_connexion_jours",
     "connexions_30j > 0 AND derniere_connexion_jours > 30"),
]
_TYPED = RAW + ", typed AS (" + number_sql("raw", _RULED, ["client_id"]) + ")"


@query(
    "impossible_values",
    _TYPED + " " + " UNION ALL ".join(
        f"""SELECT '{rule}' AS regle, '{c}' AS colonne_ou_paire,
        count(*) FILTER ({p}) AS nb_lignes_concernees, count(*) FILTER ({p}) > 0 AS violee FROM typed"""
        for rule, c, p in _RULES
    ),
)
def impossible_values(spark, folder):
    return quality.impossible_values(raw_accounts(spark, folder).select("client_id", *_RULED))


@query(
    "impossible_values_tenure",
    ACC + _REFERENCE
    + """, m AS (SELECT date_souscription > date_reference AS late, abs(anciennete_mois - round_even(
      date_diff('day', date_souscription, date_reference) / 30.44, 0)) > 3 AS off FROM accounts, r)
    SELECT 'date_souscription > date_reference' AS regle, 'date_souscription' AS colonne_ou_paire,
      count(*) FILTER (late) AS nb_lignes_concernees, count(*) FILTER (late) > 0 AS violee FROM m
    UNION ALL SELECT 'anciennete_mois incoherente (ecart > 3 mois)',
      'anciennete_mois / date_souscription', count(*) FILTER (off), count(*) FILTER (off) > 0 FROM m
    UNION ALL SELECT 'anciennete_mois < 0', 'anciennete_mois',
      count(*) FILTER (anciennete_mois < 0), count(*) FILTER (anciennete_mois < 0) > 0 FROM accounts""",
)
def impossible_values_tenure(spark, folder):
    df = accounts(spark, folder).select("anciennete_mois", "date_souscription")
    return quality.impossible_values(df, quality.estimate_reference_date(df))


@query(
    "impossible_examples",
    _TYPED + " SELECT regle, CAST(rang AS INTEGER) AS rang, client_id FROM (SELECT *, row_number() "
    "OVER (PARTITION BY regle ORDER BY client_id) AS rang FROM ("
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS regle, client_id FROM typed WHERE {p}" for rule, c, p in _RULES
    )
    + ")) WHERE rang <= 3",
)
def impossible_examples(spark, folder):
    source = raw_accounts(spark, folder).select("client_id", *_RULED)
    return quality.impossible_examples(source, "client_id")


@query(
    "cap_impossible_values",
    _TYPED
    + """ SELECT client_id, CASE WHEN sieges_souscrits IS NOT NULL THEN greatest(sieges_souscrits, 0) END
        AS sieges_souscrits,
      CASE WHEN utilisateurs_actifs IS NOT NULL THEN least(greatest(utilisateurs_actifs, 0),
        greatest(sieges_souscrits, 0)) END AS utilisateurs_actifs,
      CASE WHEN taux_adoption_pct IS NOT NULL THEN least(greatest(taux_adoption_pct, 0), 100) END
        AS taux_adoption_pct,
      CASE WHEN tickets_support_90j IS NOT NULL THEN greatest(tickets_support_90j, 0) END
        AS tickets_support_90j FROM typed""",
)
def cap_impossible_values(spark, folder):
    kept = ["sieges_souscrits", "utilisateurs_actifs", "taux_adoption_pct", "tickets_support_90j"]
    return quality.cap_impossible_values(raw_accounts(spark, folder).select("client_id", *kept))


_GAPPED = ("csat", "heures_usage_30j", "delai_reponse_support_h")


@query(
    "missing_indicators",
    ACC + " SELECT client_id, " + ", ".join(f"{c}, {c} IS NULL AS {c}_manquant" for c in _GAPPED)
    + " FROM accounts",
)
def missing_indicators(spark, folder):
    return quality.missing_indicators(accounts(spark, folder).select("client_id", *_GAPPED), _GAPPED)


def v_sql(source: str, a: str, b: str, yates: bool) -> str:
    """CTEs c, t, s ending in s(n, lignes, colonnes, chi2) for one pair of columns."""
    d = "abs(o - e)"
    term = f"power({d} - CASE WHEN r = 2 AND k = 2 THEN least(0.5, {d}) ELSE 0 END, 2) / e"
    if not yates:
        term = f"power({d}, 2) / e"
    return f"""base AS (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    ra AS (SELECT a, count(*) AS na FROM base GROUP BY a), rb AS (SELECT b, count(*) AS nb FROM base GROUP BY b),
    obs AS (SELECT a, b, count(*) AS o FROM base GROUP BY a, b),
    grid AS (SELECT coalesce(o, 0) AS o, CAST(na AS DOUBLE) * nb / (SELECT count(*) FROM base) AS e,
      (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS k
      FROM ra CROSS JOIN rb LEFT JOIN obs USING (a, b)),
    s AS (SELECT CAST((SELECT count(*) FROM base) AS BIGINT) AS n, max(r) AS lignes, max(k) AS colonnes,
      sum({term}) AS chi2 FROM grid)"""


def _v_query(a: str, b: str, yates: bool) -> str:
    return (
        f"{ACC}, {v_sql('accounts', a, b, yates)} SELECT n, lignes, colonnes, "
        "(lignes - 1) * (colonnes - 1) AS ddl, round(chi2, 6) AS chi2, "
        "round(sqrt(chi2 / (n * (least(lignes, colonnes) - 1))), 6) AS v_cramer FROM s"
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("chi2", "v_cramer")})


@query("cramers_v", _v_query("taille_entreprise", "code_datacenter", True))
def cramers_v(spark, folder):
    return _rounded(primitives.cramers_v(accounts(spark, folder), "taille_entreprise", "code_datacenter"))


@query("cramers_v_two_by_two", _v_query("groupe_experimentation", "churn", True))
def cramers_v_two_by_two(spark, folder):
    return _rounded(primitives.cramers_v(accounts(spark, folder), "groupe_experimentation", "churn"))


@query("cramers_v_uncorrected", _v_query("groupe_experimentation", "churn", False))
def cramers_v_uncorrected(spark, folder):
    df = accounts(spark, folder)
    return _rounded(primitives.cramers_v(df, "groupe_experimentation", "churn", yates=False))


@query(
    "contingency",
    ACC
    + """, b AS (SELECT taille_entreprise, commentaire_csm FROM accounts WHERE commentaire_csm IS NOT NULL)
    SELECT DISTINCT taille_entreprise, commentaire_csm,
      count(*) OVER (PARTITION BY taille_entreprise, commentaire_csm) AS n,
      count(*) OVER (PARTITION BY taille_entreprise) AS n_a,
      count(*) OVER (PARTITION BY commentaire_csm) AS n_b, count(*) OVER () AS total FROM b""",
)
def contingency(spark, folder):
    return primitives.contingency(accounts(spark, folder), "taille_entreprise", "commentaire_csm")


@query(
    "binary_association",
    ACC
    + """ SELECT 'anciennete_mois' AS autre, round(abs(corr(CAST(csat IS NULL AS INT),
      anciennete_mois)), 6) AS force FROM accounts
    UNION ALL SELECT 'taille_entreprise', (SELECT round(sqrt(sum(power(o - e, 2) / e) / max(n)), 6) FROM (
      SELECT na * nb / CAST(n AS DOUBLE) AS e, coalesce(o, 0) AS o, n FROM
      (SELECT taille_entreprise AS t, count(*) AS na FROM accounts GROUP BY 1)
      CROSS JOIN (SELECT csat IS NULL AS m, count(*) AS nb FROM accounts GROUP BY 1)
      LEFT JOIN (SELECT taille_entreprise AS t, csat IS NULL AS m, count(*) AS o FROM accounts GROUP BY 1, 2)
        USING (t, m) CROSS JOIN (SELECT count(*) AS n FROM accounts)))""",
)
def binary_association(spark, folder):
    df = accounts(spark, folder)
    mask = F.col("csat").isNull()
    parts = [
        quality.binary_association(df, mask, c).select(
            F.lit(c).alias("autre"), F.round("force", 6).alias("force")
        )
        for c in ("anciennete_mois", "taille_entreprise")
    ]
    return parts[0].unionByName(parts[1])


_READY = ("client_id", "secteur", "plan", "csat", "date_souscription", "taux_adoption_pct")


@query(
    "association_ready",
    RAW + ", c AS (" + number_sql("raw", list(_READY), []) + "), n AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, count({c}) / CAST(count(*) AS DOUBLE) > 0.8 AS num FROM c" for c in _READY
    )
    + "), u AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, count(DISTINCT {c}) > 100 OR count(DISTINCT {c}) "
        f"/ CAST(count({c}) AS DOUBLE) > 0.5 AS crowded FROM raw"
        for c in _READY
    )
    + ") SELECT colonne, CASE WHEN num THEN 'numerique' ELSE 'categorielle' END AS nature, "
    "num OR NOT crowded AS retenue FROM n JOIN u USING (colonne)",
)
def association_ready(spark, folder):
    return quality.association_ready(
        raw_accounts(spark, folder).select(*_READY, "churn"), "churn"
    )


@query(
    "orphan_keys",
    "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)",
)
def orphan_keys(spark, folder):
    return quality.orphan_keys(
        table(spark, folder, "events"), table(spark, folder, "orders"), "user_id", "o_custkey"
    )


@query(
    "strict_subset_check",
    """WITH e AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    f AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)
    SELECT true AS memes_colonnes, (SELECT count(*) FROM (FROM e EXCEPT ALL FROM f)) AS lignes_absentes,
      (SELECT count(DISTINCT o_orderkey) FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f))
        AS cles_absentes,
      (SELECT count(*) FROM e) AS n_extrait, (SELECT count(*) FROM f) AS n_complet,
      (SELECT count(*) FROM e) < (SELECT count(*) FROM f) AS sous_ensemble_strict""",
)
def strict_subset_check(spark, folder):
    full = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    extract = full.where("o_orderstatus = 'F'").drop("o_orderstatus")
    return quality.strict_subset_check(extract, full.drop("o_orderstatus"), "o_orderkey")


@query(
    "label_normalisation_report",
    ACC + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, count(DISTINCT {c}) AS modalites_brutes, "
        f"count(DISTINCT lower(trim({c}))) AS modalites_normalisees FROM accounts"
        for c in CATEGORICAL
    ),
)
def label_normalisation_report(spark, folder):
    return quality.label_normalisation_report(accounts(spark, folder), CATEGORICAL)


@query(
    "pii_scan",
    r"""SELECT 'text' AS colonne, count(text) AS n_renseignes, count(DISTINCT text) AS n_distincts,
      min(length(text)) AS longueur_min, max(length(text)) AS longueur_max,
      count(*) FILTER (regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]+')) AS n_email,
      count(*) FILTER (regexp_matches(text, '(?:\+\d{1,3}[\s.]?)?\d(?:[\s.-]?\d{2}){4}')) AS n_telephone
    FROM documents""",
)
def pii_scan(spark, folder):
    return quality.pii_scan(table(spark, folder, "documents"), ["text"])


@query(
    "column_provenance",
    ACC + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, '{t}' AS type, round(avg(CAST({c} IS NULL AS INT)), 4) "
        f"AS taux_manquants, '{o}' AS origine FROM accounts"
        for c, t, o in (
            ("client_id", "string", "brut"),
            ("secteur", "string", "brut"),
            ("csat", "bigint", "brut"),
            ("p", "double", "feature"),
        )
    ),
)
def column_provenance(spark, folder):
    df = accounts(spark, folder).select("client_id", "secteur", "csat", "p")
    return quality.column_provenance(df, {c: "brut" for c in raw_plan.COLUMNS})


@query(
    "functional_dependency",
    ACC + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, max(n) AS max_valeurs_par_cle FROM (SELECT count(DISTINCT {c}) AS n "
        "FROM accounts WHERE pays IS NOT NULL GROUP BY pays)"
        for c in ("taille_entreprise", "plan", "groupe_experimentation")
    ),
)
def functional_dependency(spark, folder):
    return quality.functional_dependency(
        accounts(spark, folder), "pays", ["taille_entreprise", "plan", "groupe_experimentation"]
    )


_FIELDS = [name for name, *_ in quality.REQUEST_CONTRACT]
_MANDATORY = {name for name, _, _, m in quality.REQUEST_CONTRACT if m}


@query(
    "contract_nullability",
    ACC + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS champ, {str(c in _MANDATORY).lower()} AS obligatoire, "
        f"round(avg(CAST({c} IS NULL AS INT)), 6) AS taux_manquants, "
        f"{'count(*) = count(' + c + ')' if c in _MANDATORY else 'true'} AS conforme FROM accounts"
        for c in _FIELDS
    ),
)
def contract_nullability(spark, folder):
    return quality.contract_nullability(accounts(spark, folder))


@query(
    "incomplete_share",
    ACC + " SELECT round(avg(CAST(" + " OR ".join(f"{c} IS NULL" for c in _FIELDS)
    + " AS INT)), 6) AS part_incompletes FROM accounts",
)
def incomplete_share(spark, folder):
    share = quality.incomplete_share(accounts(spark, folder))
    return share.select(F.round("part_incompletes", 6).alias("part_incompletes"))


def _reasons_sql() -> str:
    parts = []
    for name, low, high, required in quality.REQUEST_CONTRACT:
        if required:
            parts.append(f"CASE WHEN {name} IS NULL THEN '{name} manquant' END")
        if low is not None:
            parts.append(f"CASE WHEN {name} < {low} OR {name} > {high} THEN '{name} hors bornes' END")
    return f"concat_ws('; ', {', '.join(parts)})"


@query(
    "validate_requests",
    ACC + f" SELECT client_id, {_reasons_sql()} AS motifs, {_reasons_sql()} = '' AS valide FROM accounts",
)
def validate_requests(spark, folder):
    checked = quality.validate_requests(accounts(spark, folder))
    return checked.select("client_id", F.array_join("motifs", "; ").alias("motifs"), "valide")


_MISSING_NUM = ("anciennete_mois", "sieges_souscrits", "connexions_30j", "csat")
_MISSING_CAT = ("taille_entreprise", "commentaire_csm")
_MISSING_COLS = ("csat", "heures_usage_30j", "anciennete_mois", "sieges_souscrits",
                 "connexions_30j", "taille_entreprise", "commentaire_csm")


def _missing_sql() -> str:
    forces = []
    for c in _MISSING_COLS:
        for o in _MISSING_NUM:
            if o != c:
                forces.append(
                    f"SELECT '{c}' AS colonne, '{o}' AS autre, coalesce(CASE WHEN count({o}) >= 10 AND "
                    f"min({c} IS NULL) <> max({c} IS NULL) THEN abs(corr(CAST({c} IS NULL AS INT), {o})) "
                    f"END, 0) AS force FROM (SELECT * FROM accounts WHERE {o} IS NOT NULL)"
                )
        for o in _MISSING_CAT:
            if o != c:
                forces.append(
                    f"SELECT '{c}', '{o}', coalesce((SELECT CASE WHEN max(nn) > 0 AND max(nn) < max(n) THEN "
                    f"sqrt(sum(power(o - e, 2) / e) / max(n)) END FROM (SELECT na * nb / CAST(n AS DOUBLE) AS e, "
                    f"coalesce(o, 0) AS o, n, nn FROM (SELECT {o} AS t, count(*) AS na FROM accounts WHERE {o} IS NOT "
                    f"NULL GROUP BY 1) CROSS JOIN (SELECT {c} IS NULL AS m, count(*) AS nb FROM accounts WHERE {o} "
                    f"IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT {o} AS t, {c} IS NULL AS m, count(*) AS o FROM "
                    f"accounts WHERE {o} IS NOT NULL GROUP BY 1, 2) USING (t, m) CROSS JOIN (SELECT count(*) AS n, "
                    f"count(*) FILTER ({c} IS NULL) AS nn FROM accounts WHERE {o} IS NOT NULL))), 0)"
                )
    links = " UNION ALL ".join(
        f"""SELECT '{c}' AS colonne, count(*) AS n, count(*) FILTER ({c} IS NULL) AS m,
        count(*) FILTER (churn = 1) AS p, count(*) FILTER (churn = 1 AND {c} IS NULL) AS a,
        avg(churn) FILTER ({c} IS NULL) AS rm, avg(churn) FILTER ({c} IS NOT NULL) AS rf FROM accounts"""
        for c in _MISSING_COLS
    )
    return f"""{ACC}, forces AS ({" UNION ALL ".join(forces)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY colonne ORDER BY force DESC, autre) AS rang FROM forces),
    links AS ({links})
    SELECT colonne, round(CAST(m AS DOUBLE) / n, 4) AS taux_manquants,
      round(CASE WHEN m < n THEN power(abs(a - CAST(m AS DOUBLE) * p / n) - least(0.5, abs(a - CAST(m AS DOUBLE) * p / n)), 2)
        * n * (CAST(1 AS DOUBLE) / m + CAST(1 AS DOUBLE) / (n - m)) * (CAST(1 AS DOUBLE) / p + CAST(1 AS DOUBLE) / (n - p)) END, 6) AS chi2_cible,
      round(rm, 4) AS taux_churn_si_manquant, round(rf, 4) AS taux_churn_si_renseigne,
      round(max(force), 6) AS association_max
    FROM links JOIN ranked USING (colonne) WHERE m > 0 GROUP BY ALL"""


@query("missingness_report", _missing_sql())
def missingness_report(spark, folder):
    df = accounts(spark, folder).select(*_MISSING_COLS, "churn")
    report = quality.missingness_report(df, "churn", _MISSING_NUM, _MISSING_CAT, with_p=False)
    return report.drop("top3_associations").withColumns(
        {c: F.round(c, 6) for c in ("chi2_cible", "association_max")}
    )


@query("missingness_mechanism")
def missingness_mechanism(spark, folder):
    df = accounts(spark, folder).select(*NUMERIC, "taille_entreprise", "commentaire_csm", "churn")
    return quality.missingness_report(df, "churn", NUMERIC, ["taille_entreprise", "commentaire_csm"])


@query(
    "sniff_numeric",
    RAW + " " + " UNION ALL ".join(
        rf"""SELECT '{c}' AS colonne, round(avg(CAST(regexp_full_match({STRIPPED(c)},
        '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AS INT)), 6) AS part_numerique,
        avg(CAST(regexp_full_match({STRIPPED(c)}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
        AS INT)) > 0.5 AS numerique FROM raw"""
        for c in ("secteur", "csat", "taux_adoption_pct", "heures_usage_30j")
    ),
)
def sniff_numeric(spark, folder):
    found = primitives.sniff_numeric(
        raw_accounts(spark, folder), ["secteur", "csat", "taux_adoption_pct", "heures_usage_30j"]
    )
    return found.withColumn("part_numerique", F.round("part_numerique", 6))
