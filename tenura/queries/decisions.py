"""Queries of decision economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import economics
from tenura.queries.evaluation import S, curve_ctes, recall_sql, scored
from tenura.queries.exploration import rounded
from tenura.queries.registry import query

VAR = "p * mrr * CAST(12 AS DOUBLE) * CAST(0.72 AS DOUBLE)"
EV = f"({VAR} * CAST({{r}} AS DOUBLE) - CAST(110 AS DOUBLE))"
DEFAULT_EV = EV.format(r=0.3)
MULT = "CAST(12 * 0.72 AS DOUBLE)"


def filtered(spark, folder):
    """The sample without missing revenue, as the evaluation report uses."""
    return scored(spark, folder).where("mrr IS NOT NULL")


F_ = S + ", f AS (SELECT * FROM s WHERE mrr IS NOT NULL)"


@query(
    "prioritise",
    S + f""", v AS (SELECT id, p, mrr, {DEFAULT_EV} AS ev FROM s), r AS (SELECT id, row_number() OVER (ORDER BY ev DESC, id) AS rang
      FROM v WHERE ev > 0), b AS (SELECT * FROM r WHERE rang <= 45)
    SELECT id, round(ev, 4) AS valeur_attendue, rang AS rang_priorite,
      CASE WHEN rang IS NOT NULL THEN 'Contacter' WHEN ev > 0 THEN 'Action automatisée' ELSE 'Veille' END AS action_cs
    FROM v LEFT JOIN b USING (id)""",
)
def prioritise(spark, folder):
    out = economics.prioritise(scored(spark, folder))
    return rounded(out.select("id", "valeur_attendue", "rang_priorite", "action_cs"), "valeur_attendue", digits=4)


@query("value_at_risk", S + f" SELECT id, round({VAR}, 4) AS valeur_a_risque FROM s")
def value_at_risk(spark, folder):
    df = scored(spark, folder)
    return df.select("id", F.round(economics.value_at_risk(F.col("p"), F.col("mrr")), 4).alias("valeur_a_risque"))


@query("expected_value", S + f" SELECT id, round({DEFAULT_EV}, 4) AS valeur_attendue FROM s")
def expected_value(spark, folder):
    df = scored(spark, folder)
    return df.select("id", F.round(economics.expected_value(F.col("p"), F.col("mrr")), 4).alias("valeur_attendue"))


@query(
    "select_under_capacity",
    S + f""", v AS (SELECT id, {DEFAULT_EV} AS ev FROM s) SELECT id, round(ev, 4) AS valeur_attendue,
      row_number() OVER (ORDER BY ev DESC, id) AS rang FROM v WHERE ev > 0 ORDER BY ev DESC, id LIMIT 45""",
)
def select_under_capacity(spark, folder):
    valued = economics._valued(scored(spark, folder), economics.ECONOMICS)
    out = economics.select_under_capacity(valued, 45)
    return rounded(out.select("id", "valeur_attendue", "rang"), "valeur_attendue", digits=4)


@query(
    "risk_level",
    S + """ SELECT id, CASE WHEN p >= 0.6 THEN 'ALERTE_ROUGE' WHEN p >= 0.4 THEN 'SURVEILLANCE' ELSE 'OK' END AS niveau FROM s""",
)
def risk_level(spark, folder):
    return scored(spark, folder).select("id", economics.risk_level(F.col("p")).alias("niveau"))


_GRID = F_ + f""", g AS (SELECT i, i / CAST(199 AS DOUBLE) AS seuil FROM range(200) t(i)),
  c AS (SELECT i, seuil, coalesce(sum(y * (mrr * {MULT} * CAST(0.3 AS DOUBLE) - 110) - (1 - y) * 110), 0) AS gain, count(p) AS n,
    coalesce(sum(y), 0) AS tp FROM g LEFT JOIN f ON p >= seuil GROUP BY i, seuil)"""


@query(
    "gain_by_threshold",
    _GRID + """ SELECT i, seuil, round(gain, 2) AS gain_net_eur, n AS n_alertes,
      round(CASE WHEN n > 0 THEN tp / CAST(n AS DOUBLE) ELSE 0 END, 6) AS precision,
      round(tp / CAST(max(tp) OVER () AS DOUBLE), 6) AS rappel FROM c""",
)
def gain_by_threshold(spark, folder):
    out = economics.gain_by_threshold(filtered(spark, folder))
    return rounded(rounded(out, "precision", "rappel"), "gain_net_eur", digits=2)


@query("best_threshold", _GRID + " SELECT i, seuil, round(gain, 2) AS gain_net_eur FROM c ORDER BY gain DESC, i LIMIT 1")
def best_threshold(spark, folder):
    best = economics.best_threshold(economics.gain_by_threshold(filtered(spark, folder)))
    return rounded(best.select("i", "seuil", "gain_net_eur"), "gain_net_eur", digits=2)


@query(
    "lift_curve",
    S + """, r AS (SELECT id, row_number() OVER w AS k, sum(y) OVER w AS hits, count(*) OVER () AS n, sum(y) OVER () AS t
      FROM s WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING))
    SELECT k AS n_comptes, id, round(100.0 * k / CAST(n AS DOUBLE), 6) AS pct_contactes,
      round(100.0 * hits / CAST(t AS DOUBLE), 6) AS pct_churners_captures,
      round((100.0 * hits / CAST(t AS DOUBLE)) / (100.0 * k / CAST(n AS DOUBLE) + 1e-9), 5) AS lift FROM r""",
)
def lift_curve(spark, folder):
    out = economics.lift_curve(scored(spark, folder))
    return rounded(rounded(out, "pct_contactes", "pct_churners_captures"), "lift", digits=5)


@query("precision_at_k", S + " SELECT round(avg(y), 6) AS precision FROM (SELECT y FROM s ORDER BY p DESC, id LIMIT 45)")
def precision_at_k(spark, folder):
    return rounded(economics.precision_at_k(scored(spark, folder), 45), "precision")


def top_sql(order: str, k: int, rate: float = 0.3, source: str = "f") -> str:
    """Selected rows (id, y, mrr, rang) under one ranking."""
    if order == "valeur_attendue":
        ev = EV.format(r=rate)
        return (f"SELECT id, y, mrr, row_number() OVER (ORDER BY {ev} DESC, id) AS rang FROM {source} WHERE {ev} > 0 "
                f"QUALIFY rang <= {k}")  # fmt: skip
    column = "p" if order == "proba" else "mrr"
    return f"SELECT id, y, mrr, row_number() OVER (ORDER BY {column} DESC, id) AS rang FROM {source} QUALIFY rang <= {k}"


def balance_sql(selected: str, rate: str = "0.3", presence: str = "1") -> str:
    gain = f"coalesce(sum(mrr * y), 0) * {presence} * {MULT} * CAST({rate} AS DOUBLE) - count(*) * 110.0"
    return f"{gain} AS gain FROM ({selected})"


def _ranking_sql(order: str) -> str:
    return f"""SELECT '{order}' AS classement, count(*) AS n_contactes, CAST(sum(y) AS BIGINT) AS n_churners,
      round(avg(y), 6) AS precision, round(sum(mrr * y), 2) AS mrr_churners_couverts,
      round(sum(mrr * y) * {MULT} * CAST(0.3 AS DOUBLE), 2) AS valeur_sauvee, CAST(count(*) * 110 AS DOUBLE) AS cout_gestes,
      round(sum(mrr * y) * {MULT} * CAST(0.3 AS DOUBLE) - count(*) * 110, 2) AS gain_net,
      round((sum(mrr * y) * {MULT} * CAST(0.3 AS DOUBLE) - count(*) * 110) / CAST(count(*) * 110 AS DOUBLE), 6) AS roi
    FROM ({top_sql(order, 45)})"""


def _money(df):
    return rounded(
        rounded(df, "precision", "roi"), "mrr_churners_couverts", "valeur_sauvee", "gain_net", digits=2
    )


@query("gain_under_capacity", F_ + " " + _ranking_sql("valeur_attendue"))
def gain_under_capacity(spark, folder):
    return _money(economics.gain_under_capacity(filtered(spark, folder)))


@query("compare_rankings", F_ + " " + " UNION ALL ".join(_ranking_sql(o) for o in economics.RANKINGS))
def compare_rankings(spark, folder):
    return _money(economics.compare_rankings(filtered(spark, folder)))


_RATES = (0.2, 0.25, 0.3, 0.35, 0.4)


def _gap_ctes(source: str = "f", k: int = 45, name: str = "gp") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {r} AS r, (SELECT {balance_sql(top_sql('valeur_attendue', k, r, source), str(r))}) AS m, "
        f"(SELECT {balance_sql(top_sql('mrr', k, r, source), str(r))}) AS b"
        for r in _RATES
    )
    return f"{name} AS ({rows})"


_ATTRIBUTABLE = """SELECT round(max(m) FILTER (r = 0.3), 2) AS gain_modele, round(max(b) FILTER (r = 0.3), 2) AS gain_reference,
  round(max(m - b) FILTER (r = 0.3), 2) AS gain_attribuable, round(min(m - b), 2) AS gain_attribuable_min,
  round(max(m - b), 2) AS gain_attribuable_max FROM gp"""


@query("attributable_gain", f"{F_}, {_gap_ctes()} {_ATTRIBUTABLE}")
def attributable_gain(spark, folder):
    out = economics.attributable_gain(filtered(spark, folder))
    return rounded(out, *out.columns, digits=2)


def _year_sql(name: str, rate: float = 0.3, spread: bool = False, k: int = 45) -> str:
    presence = "(1 - (mois - 1) / CAST(12 AS DOUBLE))" if spread else "1"

    def monthly(order: str) -> str:
        return (f"SELECT CAST(ceil(rang / CAST({k} AS DOUBLE)) AS BIGINT) AS mois, CAST(sum(y) AS BIGINT) AS c, sum(mrr * y) AS cov, "
                f"count(*) AS n FROM ({top_sql(order, k * 12, rate)}) GROUP BY 1")  # fmt: skip

    gain = f"coalesce({{t}}.cov, 0) * {presence} * {MULT} * CAST({rate} AS DOUBLE) - coalesce({{t}}.n, 0) * 110"
    return f"""{name} AS (SELECT mois, coalesce(a.c, 0) AS n_churners_modele, coalesce(b.c, 0) AS n_churners_reference,
      {gain.format(t="a")} AS gm, {gain.format(t="b")} AS gr FROM (SELECT CAST(i AS BIGINT) AS mois FROM range(1, 13) t(i))
      LEFT JOIN ({monthly("valeur_attendue")}) a USING (mois) LEFT JOIN ({monthly("mrr")}) b USING (mois))"""


@query(
    "gain_over_year",
    f"""{F_}, {_year_sql("yr")} SELECT mois, n_churners_modele, n_churners_reference, round(gm, 2) AS gain_net_modele,
      round(gr, 2) AS gain_net_reference, round(gm - gr, 2) AS gain_attribuable,
      round(sum(gm - gr) OVER (ORDER BY mois ROWS UNBOUNDED PRECEDING), 2) AS gain_attribuable_cumule FROM yr""",
)
def gain_over_year(spark, folder):
    out = economics.gain_over_year(filtered(spark, folder))
    return rounded(
        out, "gain_net_modele", "gain_net_reference", "gain_attribuable", "gain_attribuable_cumule", digits=2
    )


@query(
    "yearly_attributable",
    f"""{F_}, {_year_sql("yr")}, {_year_sql("sp", spread=True)},
    {", ".join(_year_sql(f"y{i}", r) for i, r in enumerate(_RATES))},
    al AS ({" UNION ALL ".join(f"SELECT sum(gm - gr) AS a FROM y{i}" for i in range(5))})
    SELECT round((SELECT gm - gr FROM yr WHERE mois = 1), 2) AS premier_mois, round((SELECT sum(gm - gr) FROM yr), 2) AS annuel,
      round((SELECT min(a) FROM al), 2) AS annuel_min, round((SELECT max(a) FROM al), 2) AS annuel_max,
      round((SELECT sum(gm - gr) FROM sp), 2) AS annuel_departs_etales""",
)
def yearly_attributable(spark, folder):
    out = economics.yearly_attributable(filtered(spark, folder))
    return rounded(out, *out.columns, digits=2)


@query(
    "gain_concentration",
    f"""{F_}, e AS (SELECT quantile_cont(mrr, 0.99) AS q FROM f), w AS (SELECT f.* FROM f, e WHERE NOT mrr > q), {_gap_ctes("w")},
    c AS (SELECT id, mrr * y * {MULT} * CAST(0.3 AS DOUBLE) - 110 AS c FROM ({top_sql("valeur_attendue", 45)})),
    d AS (SELECT c, row_number() OVER (ORDER BY c DESC, id) AS r FROM c)
    SELECT round((SELECT sum(c) FILTER (r <= 5) / sum(c) FROM d), 6) AS part_top, round((SELECT q FROM e), 4) AS seuil_mrr,
      (SELECT count(*) FROM f, e WHERE mrr > q) AS n_exclus,
      round((SELECT m - b FROM gp WHERE r = 0.3), 2) AS gain_attribuable_sans_gros""",
)
def gain_concentration(spark, folder):
    out = economics.gain_concentration(filtered(spark, folder))
    out = rounded(rounded(out, "part_top"), "seuil_mrr", digits=4)
    return rounded(out, "gain_attribuable_sans_gros", digits=2)


@query(
    "capacity_sensitivity",
    F_ + " " + " UNION ALL ".join(
        f"""SELECT CAST({r} AS DOUBLE) AS taux_succes, CAST({k} AS BIGINT) AS capacite, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_churners,
        round(coalesce(sum(mrr * y), 0) * {MULT} * CAST({r} AS DOUBLE) - count(*) * 110, 2) AS gain_net_eur,
        round(coalesce((coalesce(sum(mrr * y), 0) * {MULT} * CAST({r} AS DOUBLE) - count(*) * 110)
          / nullif(CAST(count(*) * 110 AS DOUBLE), 0), 0), 6) AS roi FROM ({top_sql("valeur_attendue", k, r)})"""
        for r in _RATES for k in (15, 30, 45, 60, 90, 120)
    ),
)
def capacity_sensitivity(spark, folder):
    out = economics.capacity_sensitivity(filtered(spark, folder))
    return rounded(rounded(out, "roi"), "gain_net_eur", digits=2)


_LEVEL = """SELECT '{name}' AS niveau, max(seuil) AS seuil, count(*) FILTER ({k}) AS n_comptes,
  round(count(*) FILTER ({k}) / CAST(count(*) AS DOUBLE), 6) AS part_portefeuille,
  CAST(coalesce(sum(y) FILTER ({k}), 0) AS BIGINT) AS n_churners,
  round(coalesce(sum(y) FILTER ({k}), 0) / CAST(sum(y) AS DOUBLE), 6) AS recall,
  round(coalesce(sum(y) FILTER ({k}) / CAST(count(*) FILTER ({k}) AS DOUBLE), 0), 6) AS precision,
  count(*) FILTER (y = 1 AND NOT ({k})) AS n_faux_negatifs,
  round(coalesce(sum(mrr) FILTER (y = 1 AND NOT ({k})), 0) * CAST(8.64 AS DOUBLE), 2) AS valeur_faux_negatifs_eur,
  {gain} AS gain_net_eur FROM wm"""


@query(
    "two_level_table",
    f"""{F_}, {curve_ctes("f")}, t AS ({recall_sql()}), fl AS (SELECT f.*, seuil FROM f, t WHERE p >= seuil),
    cl AS ({top_sql("valeur_attendue", 45, 0.3, "fl")}), wm AS (SELECT f.*, seuil, id IN (SELECT id FROM cl) AS called FROM f, t)
    {_LEVEL.format(name="vigilance", k="p >= seuil", gain="CAST(NULL AS DOUBLE)")} UNION ALL
    {_LEVEL.format(name="appels", k="called", gain="round((SELECT " + balance_sql("SELECT * FROM cl") + "), 2)")}""",
)
def two_level_table(spark, folder):
    out = economics.two_level_table(filtered(spark, folder))
    out = rounded(out, "part_portefeuille", "recall", "precision")
    return rounded(out, "valeur_faux_negatifs_eur", "gain_net_eur", digits=2)


@query(
    "score_summary",
    S + f""", v AS (SELECT id, p, mrr, {DEFAULT_EV} AS ev, {VAR} AS var FROM s),
    r AS (SELECT id FROM v WHERE ev > 0 ORDER BY ev DESC, id LIMIT 45)
    SELECT count(*) AS n_comptes, count(*) FILTER (p >= 0.6) AS nb_alertes_rouges,
      count(*) FILTER (p >= 0.4 AND p < 0.6) AS nb_surveillances, count(*) FILTER (p < 0.4) AS nb_ok,
      count(*) FILTER (id IN (SELECT id FROM r)) AS nb_a_contacter,
      count(*) FILTER (ev > 0 AND id NOT IN (SELECT id FROM r)) AS nb_actions_automatisees,
      round(sum(round_even(var, 2)), 2) AS valeur_totale_a_risque_eur,
      count(mrr) AS nb_comptes_valorises, count(*) - count(mrr) AS nb_comptes_sans_mrr FROM v""",
)
def score_summary(spark, folder):
    scores = economics.decide(scored(spark, folder))
    return rounded(economics.score_summary(scores), "valeur_totale_a_risque_eur", digits=2)
