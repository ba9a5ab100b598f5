"""Decision economics: value at risk, priorities under capacity, gains.

Ranked selections are bounded top-k plans. Only the lift curve is a full ranking.
A frame of accounts carries `id`, `y` (left or not), `p` (score) and `mrr`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions import sizing
from tenura.operators import metrics
from tenura.operators.ordering import quantile_row, running_totals, top_k
from tenura.params import ECONOMICS, THRESHOLDS, Economics

RANKINGS = ("valeur_attendue", "proba", "mrr")


def value_at_risk(p: Column, mrr: Column, eco: Economics = ECONOMICS) -> Column:
    return p * mrr * float(eco.horizon_months) * eco.gross_margin


def expected_value(
    p: Column,
    mrr: Column,
    eco: Economics = ECONOMICS,
    success: float | Column | None = None,
    cost: float | None = None,
) -> Column:
    rate = eco.success_rate if success is None else success
    return value_at_risk(p, mrr, eco) * rate - (eco.action_cost if cost is None else cost)


def risk_level(p: Column, watch: float | Column = THRESHOLDS.watch) -> Column:
    low = watch if isinstance(watch, Column) else F.lit(float(watch))
    red = F.greatest(F.lit(THRESHOLDS.red_alert), low)
    return F.when(p >= red, "ALERTE_ROUGE").when(p >= low, "SURVEILLANCE").otherwise("OK")


def _valued(df: DataFrame, eco: Economics, **kw) -> DataFrame:
    return df.withColumn("valeur_attendue", expected_value(F.col("p"), F.col("mrr"), eco, **kw))


def select_under_capacity(
    df: DataFrame, k: int, value: str = "valeur_attendue", key: str = "id"
) -> DataFrame:
    """Top k rows by strictly positive value, ties by key, with their rank."""
    return top_k(df.where(F.col(value) > 0), [value, key], k, [value])


def prioritise(df: DataFrame, k: int | None = None, eco: Economics = ECONOMICS) -> DataFrame:
    """Every account with its expected value, rank 1..k and action.

    The ranked list is joined back, so the whole table is never sorted.
    """
    k = eco.capacity if k is None else k
    valued = _valued(df, eco)
    best = select_under_capacity(valued, k).select("id", F.col("rang").alias("rang_priorite"))
    joined = valued.join(sizing.broadcast_if_small(best, k), "id", "left")
    action = (
        F.when(F.col("rang_priorite").isNotNull(), "Contacter")
        .when(F.col("valeur_attendue") > 0, "Action automatisée")
        .otherwise("Veille")
    )
    return joined.withColumn("action_cs", action)


# --- gains ---------------------------------------------------------------------------------


def gain_by_threshold(
    df: DataFrame, n: int = 200, eco: Economics = ECONOMICS, success: float | None = None
) -> DataFrame:
    """Net gain, alerts, precision and recall at n evenly spaced thresholds in [0, 1].

    A row is flagged at every threshold up to its score, so it is counted once, at the last
    threshold it reaches, and the n buckets are summed from the top.
    """
    rate = eco.success_rate if success is None else success
    step = n - 1
    p, y = F.col("p"), F.col("y")
    guess = F.floor(p * step)
    grid = lambda i: i / float(step)
    # the product may round across a grid point: compare with the grid value itself
    last = (
        F.when((guess + 1 <= step) & (p >= grid(guess + 1)), guess + 1)
        .when(p < grid(guess), guess - 1)
        .otherwise(guess)
    )
    gain = y * (F.col("mrr") * (eco.revenue_multiple * rate) - eco.action_cost) - (
        1 - y
    ) * eco.action_cost
    buckets = df.groupBy(F.least(last, F.lit(step)).cast("bigint").alias("i")).agg(
        F.sum(gain.cast("decimal(28,6)")).alias("g"),
        F.count("*").alias("n"),
        F.sum(y).cast("bigint").alias("tp"),
    )
    thresholds = df.sparkSession.range(n).withColumnRenamed("id", "i")
    filled = thresholds.join(F.broadcast(buckets), "i", "left")
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.max("tp_upto").over(Window.partitionBy())
    sums = filled.select(
        "i",
        F.coalesce(F.sum("g").over(above), F.lit(0)).cast("double").alias("gain_net_eur"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_alertes"),
        F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp_upto"),
    )
    return sums.select(
        "i",
        grid(F.col("i")).alias("seuil"),
        "gain_net_eur",
        "n_alertes",
        F.coalesce(F.try_divide("tp_upto", "n_alertes"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp_upto", total), F.lit(0.0)).alias("rappel"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """First threshold with the highest gain."""
    return curve.orderBy(F.col("gain_net_eur").desc(), "i").limit(1)


def lift_curve(df: DataFrame) -> DataFrame:
    """One row per rank by decreasing score: contacted %, captured %, lift."""
    known = df.select("id", "p", "y")
    ranked = running_totals(
        known,
        ["p", "id"],
        {"n_comptes": F.lit(1).cast("bigint"), "_hits": F.col("y").cast("bigint")},
        (),
        ["p"],
    )
    totals = known.agg(F.count("*").alias("_n"), F.sum("y").alias("_pos"))
    contacted = 100.0 * F.col("n_comptes") / F.col("_n")
    captured = 100.0 * F.col("_hits") / F.greatest("_pos", F.lit(1))
    return ranked.crossJoin(F.broadcast(totals)).select(
        "n_comptes",
        "id",
        contacted.alias("pct_contactes"),
        captured.alias("pct_churners_captures"),
        (captured / (contacted + 1e-9)).alias("lift"),
    )


def precision_at_k(df: DataFrame, k: int) -> DataFrame:
    """One row; k <= 0 gives 0, k beyond the table uses the whole table."""
    best = top_k(df, ["p", "id"], max(k, 0), ["p"])
    return best.agg(F.coalesce(F.avg(F.col("y").cast("double")), F.lit(0.0)).alias("precision"))


def _selection(
    df: DataFrame, ranking: str, k: int, eco: Economics, success: float | None = None,
    cost: float | None = None,
) -> DataFrame:
    if ranking not in RANKINGS:
        raise ValueError(f"unknown ranking {ranking!r}, expected one of {RANKINGS}")
    if ranking == "valeur_attendue":
        return select_under_capacity(_valued(df, eco, success=success, cost=cost), k)
    column = "p" if ranking == "proba" else "mrr"
    return top_k(df, [column, "id"], k, [column])


def _balance(
    selected: DataFrame,
    eco: Economics,
    success: float | Column | None = None,
    cost: float | None = None,
    keys: Sequence[str] = (),
    presence: Column | None = None,
) -> DataFrame:
    """Contacted, churners, precision, covered revenue, saved value, cost, gain, ROI."""
    rate = F.lit(eco.success_rate) if success is None else success
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    price = eco.action_cost if cost is None else cost
    y = F.col("y").cast("double")
    covered = F.sum((F.col("mrr") * y).cast("decimal(28,6)"))
    per = selected.groupBy(*keys).agg(
        F.count("*").alias("n_contactes"),
        F.coalesce(F.sum(y), F.lit(0.0)).cast("bigint").alias("n_churners"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("precision"),
        F.coalesce(covered, F.lit(0)).cast("double").alias("mrr_churners_couverts"),
    )
    share = F.lit(1.0) if presence is None else presence
    saved = F.col("mrr_churners_couverts") * share * eco.revenue_multiple * rate
    return (
        per.withColumn("valeur_sauvee", saved)
        .withColumn("cout_gestes", F.col("n_contactes") * F.lit(float(price)))
        .withColumn("gain_net", F.col("valeur_sauvee") - F.col("cout_gestes"))
        .withColumn("roi", F.coalesce(F.try_divide("gain_net", "cout_gestes"), F.lit(0.0)))
    )


def gain_under_capacity(
    df: DataFrame,
    ranking: str = "valeur_attendue",
    k: int | None = None,
    eco: Economics = ECONOMICS,
    success: float | None = None,
    cost: float | None = None,
) -> DataFrame:
    chosen = _selection(df, ranking, eco.capacity if k is None else k, eco, success, cost)
    balance = _balance(chosen, eco, success, cost)
    return balance.select(F.lit(ranking).alias("classement"), "*")


def compare_rankings(df: DataFrame, k: int | None = None, eco: Economics = ECONOMICS) -> DataFrame:
    out = gain_under_capacity(df, RANKINGS[0], k, eco)
    for ranking in RANKINGS[1:]:
        out = out.unionByName(gain_under_capacity(df, ranking, k, eco))
    return out


def _rates(df: DataFrame, rates: Sequence[float]) -> DataFrame:
    rows = [(float(r),) for r in rates]
    return df.sparkSession.createDataFrame(rows, "taux_succes double")


def _by_rate(df: DataFrame, k: int, eco: Economics, rates: Sequence[float]) -> DataFrame:
    """(taux_succes, modele, reference): net gains for several success rates.

    The expected value is an increasing affine map of p x mrr, so the order is the same at
    every rate and only the positive cut moves: one top-k serves all rates.
    """
    side = F.broadcast(_rates(df, rates))
    value = F.col("p") * F.col("mrr")
    model = top_k(df.withColumn("_v", value).where("_v > 0"), ["_v", "id"], k, ["_v"])
    kept = model.crossJoin(side).where(
        expected_value(F.col("p"), F.col("mrr"), eco, success=F.col("taux_succes")) > 0
    )
    a = _balance(kept, eco, F.col("taux_succes"), keys=["taux_succes"]).select(
        "taux_succes", F.col("gain_net").alias("modele")
    )
    reference = _selection(df, "mrr", k, eco).crossJoin(side)
    b = _balance(reference, eco, F.col("taux_succes"), keys=["taux_succes"]).select(
        "taux_succes", F.col("gain_net").alias("reference")
    )
    none = F.lit(0.0)
    return side.join(a, "taux_succes", "left").join(b, "taux_succes", "left").select(
        "taux_succes",
        F.coalesce("modele", none).alias("modele"),
        F.coalesce("reference", none).alias("reference"),
    )


def attributable_gain(
    df: DataFrame, k: int | None = None, eco: Economics = ECONOMICS,
    rates: Sequence[float] | None = None,
) -> DataFrame:
    """One row: gain of the model over ranking by revenue, with its range over rates."""
    k = eco.capacity if k is None else k
    rates = list(eco.success_range if rates is None else rates)
    per = _by_rate(df, k, eco, sorted({*rates, eco.success_rate}))
    gap = F.col("modele") - F.col("reference")
    at = F.col("taux_succes") == eco.success_rate
    inside = F.col("taux_succes").isin([float(r) for r in rates])
    return per.agg(
        F.max(F.when(at, F.col("modele"))).alias("gain_modele"),
        F.max(F.when(at, F.col("reference"))).alias("gain_reference"),
        F.max(F.when(at, gap)).alias("gain_attribuable"),
        F.min(F.when(inside, gap)).alias("gain_attribuable_min"),
        F.max(F.when(inside, gap)).alias("gain_attribuable_max"),
    )


def _yearly(
    df: DataFrame, k: int, months: int, eco: Economics, rates: Sequence[float]
) -> DataFrame:
    """(taux_succes, mois, ...) for every rate, from one ranking per side.

    The model's order does not depend on the rate, only its positive cut does, and the cut
    keeps a prefix, so ranks stay valid.
    """
    side = F.broadcast(_rates(df, rates))
    month = F.ceil(F.col("rang") / k)
    scored = df.withColumn("_v", F.col("p") * F.col("mrr"))
    model = top_k(scored.where("_v > 0"), ["_v", "id"], k * months, ["_v"]).crossJoin(side)
    model = model.where(
        expected_value(F.col("p"), F.col("mrr"), eco, success=F.col("taux_succes")) > 0
    )
    reference = top_k(scored, ["mrr", "id"], k * months, ["mrr"]).crossJoin(side)
    kept = model.withColumn("_side", F.lit("modele")).unionByName(
        reference.withColumn("_side", F.lit("reference"))
    )
    per = (
        kept.withColumn("mois", month)
        .groupBy("taux_succes", "mois")
        .agg(
            *[
                f(F.when(F.col("_side") == name, c)).alias(f"{what}_{name}")
                for name in ("modele", "reference")
                for what, f, c in (
                    ("n", F.count, F.lit(1)),
                    ("n_churners", F.sum, F.col("y").cast("bigint")),
                    ("cov", F.sum, (F.col("mrr") * F.col("y")).cast("decimal(28,6)")),
                )
            ]
        )
    )
    calendar = df.sparkSession.range(1, months + 1).withColumnRenamed("id", "mois")
    filled = side.crossJoin(calendar).join(per, ["taux_succes", "mois"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def gain(name: str, share: Column) -> Column:
        saved = zero(f"cov_{name}").cast("double") * share * eco.revenue_multiple
        return saved * F.col("taux_succes") - zero(f"n_{name}") * eco.action_cost

    present = 1.0 - (F.col("mois") - 1) / float(months)
    one = F.lit(1.0)
    return filled.select(
        "taux_succes",
        "mois",
        *[zero(f"n_churners_{n}").alias(f"n_churners_{n}") for n in ("modele", "reference")],
        *[gain(n, one).alias(f"gain_net_{n}") for n in ("modele", "reference")],
        *[gain(n, present).alias(f"etale_{n}") for n in ("modele", "reference")],
    )


def gain_over_year(
    df: DataFrame,
    k: int | None = None,
    months: int = 12,
    eco: Economics = ECONOMICS,
    success: float | None = None,
    spread: bool = False,
) -> DataFrame:
    """Month m takes ranks (m-1)k+1..mk of one ranking; model against revenue order."""
    rate = eco.success_rate if success is None else success
    rows = _yearly(df, eco.capacity if k is None else k, months, eco, [rate])
    prefix = "etale" if spread else "gain_net"
    gain = F.col("gain_net_modele") - F.col("gain_net_reference")
    upto = Window.orderBy("mois").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.select(
            "mois",
            "n_churners_modele",
            "n_churners_reference",
            F.col(f"{prefix}_modele").alias("gain_net_modele"),
            F.col(f"{prefix}_reference").alias("gain_net_reference"),
        )
        .withColumn("gain_attribuable", gain)
        .withColumn("gain_attribuable_cumule", F.sum("gain_attribuable").over(upto))
    )


def yearly_attributable(
    df: DataFrame, k: int | None = None, months: int = 12, eco: Economics = ECONOMICS,
    rates: Sequence[float] | None = None,
) -> DataFrame:
    """One row: first month, yearly sum, its range over rates, and the spread scenario."""
    rates = [float(r) for r in (eco.success_range if rates is None else rates)]
    rows = _yearly(
        df, eco.capacity if k is None else k, months, eco, sorted({*rates, eco.success_rate})
    )
    gap = F.col("gain_net_modele") - F.col("gain_net_reference")
    per = rows.groupBy("taux_succes").agg(
        F.sum(F.when(F.col("mois") == 1, gap)).alias("premier"),
        F.sum(gap).alias("annuel"),
        F.sum(F.col("etale_modele") - F.col("etale_reference")).alias("etale"),
    )
    at = F.col("taux_succes") == eco.success_rate
    inside = F.col("taux_succes").isin(rates)
    return per.agg(
        F.max(F.when(at, F.col("premier"))).alias("premier_mois"),
        F.max(F.when(at, F.col("annuel"))).alias("annuel"),
        F.min(F.when(inside, F.col("annuel"))).alias("annuel_min"),
        F.max(F.when(inside, F.col("annuel"))).alias("annuel_max"),
        F.max(F.when(at, F.col("etale"))).alias("annuel_departs_etales"),
    )


def gain_concentration(
    df: DataFrame,
    k: int | None = None,
    n_top: int = 5,
    q: float = 0.99,
    eco: Economics = ECONOMICS,
) -> DataFrame:
    """One row: share of the gain from the best few, gain without the largest accounts."""
    k = eco.capacity if k is None else k
    per = _selection(df, "valeur_attendue", k, eco).withColumn(
        "c",
        F.col("mrr") * F.col("y") * eco.revenue_multiple * eco.success_rate - eco.action_cost,
    )
    order = F.row_number().over(Window.orderBy(F.col("c").desc(), "id"))
    share = per.withColumn("r", order).agg(
        F.coalesce(
            F.try_divide(F.sum(F.when(F.col("r") <= n_top, F.col("c"))), F.sum("c")), F.lit(0.0)
        ).alias("part_top")
    )
    edge = quantile_row(df, "mrr", [q]).select(F.col("q")[0].alias("seuil_mrr"))
    marked = df.crossJoin(edge)
    large = F.coalesce(F.col("mrr") > F.col("seuil_mrr"), F.lit(False))
    excluded = marked.agg(F.count_if(large).alias("n_exclus"))
    rest = attributable_gain(marked.where(~large).drop("seuil_mrr"), k, eco)
    return share.crossJoin(edge).crossJoin(excluded).crossJoin(
        rest.select(F.col("gain_attribuable").alias("gain_attribuable_sans_gros"))
    )


def capacity_sensitivity(
    df: DataFrame,
    rates: Sequence[float] | None = None,
    capacities: Sequence[int] | None = None,
    eco: Economics = ECONOMICS,
) -> DataFrame:
    """Gain and ROI over success rate x capacity, from one ranking."""
    rates = eco.success_range if rates is None else rates
    capacities = eco.capacity_range if capacities is None else capacities
    ranked = top_k(
        df.withColumn("_v", F.col("p") * F.col("mrr")).where("_v > 0"),
        ["_v", "id"],
        max(capacities),
        ["_v"],
    )
    grid = _rates(df, rates).crossJoin(
        df.sparkSession.createDataFrame([(int(c),) for c in capacities], "capacite bigint")
    )
    side = F.broadcast(grid)
    kept = ranked.crossJoin(side).where(
        (F.col("rang") <= F.col("capacite"))
        & (expected_value(F.col("p"), F.col("mrr"), eco, success=F.col("taux_succes")) > 0)
    )
    keys = ["taux_succes", "capacite"]
    per = _balance(kept, eco, F.col("taux_succes"), keys=keys)
    return (
        side.join(per, keys, "left")
        .na.fill(0)
        .select(*keys, "n_churners", F.col("gain_net").alias("gain_net_eur"), "roi")
    )


def two_level_table(
    df: DataFrame,
    k: int | None = None,
    recall: float = THRESHOLDS.vigilance_recall,
    eco: Economics = ECONOMICS,
) -> DataFrame:
    """Level 1 flagged by the recall threshold, level 2 the calls inside level 1."""
    k = eco.capacity if k is None else k
    limit = F.broadcast(metrics.threshold_for_recall(df, recall).select("seuil"))
    watched = df.crossJoin(limit)
    flagged = _valued(watched.where(F.col("p") >= F.col("seuil")), eco)
    calls = select_under_capacity(flagged, k)
    gain = _balance(calls, eco).select("gain_net")
    side = sizing.broadcast_if_small(calls.select("id", F.lit(True).alias("_called")), k)
    marked = watched.join(side, "id", "left")
    y, mrr = F.col("y"), F.col("mrr").cast("decimal(28,6)")

    def level(name: str, kept: Column) -> DataFrame:
        caught = F.sum(F.when(kept, y).otherwise(0)).cast("bigint")
        missed = (y == 1) & ~kept
        return marked.groupBy("seuil").agg(
            F.lit(name).alias("niveau"),
            F.count_if(kept).alias("n_comptes"),
            (F.count_if(kept) / F.count("*")).alias("part_portefeuille"),
            caught.alias("n_churners"),
            F.try_divide(caught, F.sum(y)).alias("recall"),
            F.coalesce(F.try_divide(caught, F.count_if(kept)), F.lit(0.0)).alias("precision"),
            F.count_if(missed).alias("n_faux_negatifs"),
            (
                F.coalesce(F.sum(F.when(missed, mrr)), F.lit(0)).cast("double")
                * eco.revenue_multiple
            ).alias("valeur_faux_negatifs_eur"),
        )

    one = level("vigilance", F.col("p") >= F.col("seuil")).withColumn(
        "gain_net_eur", F.lit(None).cast("double")
    )
    two = level("appels", F.col("_called").isNotNull()).crossJoin(
        F.broadcast(gain.select(F.col("gain_net").alias("gain_net_eur")))
    )
    return one.unionByName(two)


# --- scores --------------------------------------------------------------------------------


def score_summary(scores: DataFrame) -> DataFrame:
    """One row of counts per decision and action, and value on valued accounts only."""
    valued = F.col("mrr_disponible")
    amount = F.when(valued, F.col("valeur_a_risque_eur")).cast("decimal(28,6)")
    return scores.agg(
        F.count("*").alias("n_comptes"),
        F.count_if(F.col("decision") == "ALERTE_ROUGE").alias("nb_alertes_rouges"),
        F.count_if(F.col("decision") == "SURVEILLANCE").alias("nb_surveillances"),
        F.count_if(F.col("decision") == "OK").alias("nb_ok"),
        F.count_if(F.col("action_cs") == "Contacter").alias("nb_a_contacter"),
        F.count_if(F.col("action_cs") == "Action automatisée").alias("nb_actions_automatisees"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("valeur_totale_a_risque_eur"),
        F.count_if(valued).alias("nb_comptes_valorises"),
        F.count_if(~valued).alias("nb_comptes_sans_mrr"),
    )


def decide(df: DataFrame, watch: float = THRESHOLDS.watch, eco: Economics = ECONOMICS) -> DataFrame:
    """Score frame (id, p, mrr) to the published columns, without model reasons."""
    ranked = prioritise(df, eco=eco)
    known = F.col("mrr").isNotNull()
    return ranked.select(
        F.col("id").alias("client_id"),
        F.bround("p", 4).alias("probabilite_churn"),
        risk_level(F.col("p"), watch).alias("decision"),
        F.bround(value_at_risk(F.col("p"), F.col("mrr"), eco), 2).alias("valeur_a_risque_eur"),
        known.alias("mrr_disponible"),
        F.lit(float(watch)).alias("seuil_applique"),
        F.bround("valeur_attendue", 2).alias("valeur_attendue_geste_eur"),
        "rang_priorite",
        "action_cs",
    )
