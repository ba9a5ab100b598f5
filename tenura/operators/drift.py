"""Drift between a reference and a current table, all columns in one grouped plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions import maths, pvalues
from tenura.operators.ordering import column_quantiles, long_format, running_totals
from tenura.params import THRESHOLDS

EDGE = 1e-9
FLOOR = 1e-6


def _sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, valeur, cote): cote 0 for the reference, 1 for the current table."""
    a = long_format(reference, columns).withColumn("cote", F.lit(0))
    return a.unionByName(long_format(current, columns).withColumn("cote", F.lit(1)))


def _value_table(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    previous: str | None = None,
) -> DataFrame:
    """Distinct values with both cumulative counts; the common frame of KS and Wasserstein."""
    counts = _sides(reference, current, columns).groupBy("variable", "valeur").agg(
        F.count_if(F.col("cote") == 0).alias("r"), F.count_if(F.col("cote") == 1).alias("c")
    )
    ranked = running_totals(
        counts,
        ["valeur"],
        {"r_upto": F.col("r"), "c_upto": F.col("c")},
        ["variable"],
        previous=previous,
    )
    totals = counts.groupBy("variable").agg(
        F.sum("r").alias("n_r"), F.sum("c").alias("n_c"), F.count("*").alias("n_valeurs")
    )
    return ranked.join(F.broadcast(totals), "variable")


def psi_bins(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    n_bins: int = 10,
) -> DataFrame:
    """Per variable and bin: bounds, both shares and the bin's share of the index.

    Edges are quantiles of the reference, computed first (n_bins + 1 numbers per column).
    Bins are closed on the left, the last one on both sides. Values outside the edges count
    in the denominator and in no bin.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = column_quantiles(reference, columns, probs)
    edges = q.select(
        "variable",
        F.transform(
            "q",
            lambda e, i: F.when(i == 0, e - EDGE).when(i == n_bins, e + EDGE).otherwise(e),
        ).alias("edges"),
    )
    at = F.size(F.filter("edges", lambda e: e <= F.col("valeur"))) - 1
    last = F.col("valeur") == F.element_at("edges", -1)
    placed = (
        _sides(reference, current, columns)
        .groupBy("variable", "valeur")
        .agg(F.count_if(F.col("cote") == 0).alias("r"), F.count_if(F.col("cote") == 1).alias("c"))
        .join(F.broadcast(edges), "variable")
        .withColumn("bin", F.when(last, n_bins - 1).otherwise(at))
    )
    inside = F.col("bin").between(0, n_bins - 1)
    counts = placed.where(inside).groupBy("variable", "bin").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c")
    )
    totals = placed.groupBy("variable").agg(
        F.sum("r").alias("n_r"),
        F.sum("c").alias("n_c"),
        F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("n_hors_bornes"),
    )
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    filled = grid.join(totals, "variable").join(counts, ["variable", "bin"], "left")

    def share(k: str, n: str) -> Column:
        part = F.coalesce(F.try_divide(F.col(k), F.col(n)), F.lit(0.0))
        return F.greatest(part, F.lit(FLOOR))

    a, b = share("r", "n_r"), share("c", "n_c")
    return filled.select(
        "variable",
        F.col("bin").cast("bigint").alias("bin"),
        F.col("edges")[F.col("bin")].alias("borne_inf"),
        F.col("edges")[F.col("bin") + 1].alias("borne_sup"),
        a.alias("p_reference"),
        b.alias("p_courant"),
        ((b - a) * F.log(b / a)).alias("psi_bin"),
        "n_hors_bornes",
    )


def psi(bins: DataFrame) -> DataFrame:
    """(variable, psi, n_hors_bornes, interpretation)."""
    per = bins.groupBy("variable").agg(
        F.sum("psi_bin").alias("psi"), F.max("n_hors_bornes").alias("n_hors_bornes")
    )
    verdict = (
        F.when(F.col("psi") < THRESHOLDS.psi_stable, "stable")
        .when(F.col("psi") < THRESHOLDS.psi_attention, "attention")
        .otherwise("derive_significative")
    )
    return per.withColumn("interpretation", verdict)


def ks_two_sample(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    with_p: bool = True,
) -> DataFrame:
    """(variable, n_reference, n_courant, statistique[, p_value, derive_detectee]).

    The p-value is asymptotic.
    """
    table = _value_table(reference, current, columns)
    gap = F.abs(F.col("r_upto") / F.col("n_r") - F.col("c_upto") / F.col("n_c"))
    per = table.where("n_r > 0 AND n_c > 0").groupBy("variable").agg(
        F.max("n_r").alias("n_reference"),
        F.max("n_c").alias("n_courant"),
        F.max(gap).alias("statistique"),
    )
    if not with_p:
        return per
    tested = per.withColumn(
        "p_value",
        pvalues.ks_p(F.col("statistique"), F.col("n_reference"), F.col("n_courant")),
    )
    return tested.withColumn("derive_detectee", F.col("p_value") < THRESHOLDS.alpha)


def drift_audit(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """PSI and KS per watched column; alert when either one drifts."""
    a = psi(psi_bins(reference, current, columns))
    b = ks_two_sample(reference, current, columns)
    alert = (F.col("interpretation") == "derive_significative") | F.col("derive_detectee")
    return a.join(b, "variable").withColumn("alerte", alert)


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    limit: float = 0.1,
    few_values: int = 5,
) -> DataFrame:
    """Every column: distance between both sides, drift flag, gaps and means.

    Wasserstein distance over the reference spread; Jensen-Shannon for few distinct values.
    """
    table = _value_table(reference, current, columns, previous="avant")
    f, g = F.col("r_upto") / F.col("n_r"), F.col("c_upto") / F.col("n_c")
    # area between the curves on [avant, valeur): both are flat there, at their earlier level
    f0 = (F.col("r_upto") - F.col("r")) / F.col("n_r")
    g0 = (F.col("c_upto") - F.col("c")) / F.col("n_c")
    area = F.abs(f0 - g0) * (F.col("valeur") - F.col("avant"))
    p, q = F.col("r") / F.col("n_r"), F.col("c") / F.col("n_c")
    m = (p + q) / 2.0
    term = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(
        q > 0, q * F.log(q / m)
    ).otherwise(0.0)
    distances = table.where("n_r > 0 AND n_c > 0").groupBy("variable").agg(
        F.max("n_valeurs").alias("n_valeurs"),
        F.coalesce(F.sum(area), F.lit(0.0)).alias("w"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term) / 2.0)).alias("js"),
        F.max(F.abs(f - g)).alias("ks"),
    )

    def summary(df: DataFrame, side: str) -> DataFrame:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            [], list(columns), "variable", "x"
        )
        return long.groupBy("variable").agg(
            F.avg(F.col("x").isNull().cast("int")).alias(f"manquants_{side}"),
            F.avg("x").alias(f"moyenne_{side}"),
            F.stddev_pop("x").alias(f"_sd_{side}"),
        )

    joined = distances.join(summary(reference, "reference"), "variable").join(
        summary(current, "courant"), "variable"
    )
    few = F.col("n_valeurs") <= few_values
    score = F.when(few, F.col("js")).otherwise(
        F.col("w") / F.greatest(F.col("_sd_reference"), F.lit(0.001))
    )
    return joined.select(
        "variable",
        F.when(few, "jensen_shannon").otherwise("wasserstein").alias("mesure"),
        score.alias("distance"),
        (score >= limit).alias("derive"),
        "manquants_reference",
        "manquants_courant",
        "moyenne_reference",
        "moyenne_courant",
    )


def drift_overview(report: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: share of drifting columns and the global verdict (more than half)."""
    part = F.avg(F.col("derive").cast("int"))
    return report.agg(
        F.count("*").alias("n_colonnes"),
        F.count_if("derive").alias("n_derives"),
        part.alias("part_derives"),
        (part > share).alias("derive_globale"),
    )


# --- what-if tables ------------------------------------------------------------------------

SCENARIOS = ("adoption_chute", "nouveau_segment", "anciennete_rajeunissement", "support_degradation")


def scenario_transform(
    df: DataFrame,
    name: str,
    key: str,
    intensity: float = 1.0,
    seed: int = 42,
    uniforms: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Deterministic what-if table: draws depend on the row key, never on partitioning.

    `uniforms` replaces the two keyed draws, for example by a portable function of the key.
    """
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}, expected one of {SCENARIOS}")
    u, v = uniforms or (maths.uniform(F.col(key), seed), maths.uniform(F.col(key), seed + 1))
    u = F.greatest(u, F.lit(1e-12))
    normal = F.sqrt(-2.0 * F.log(u)) * F.cos(6.283185307179586 * v)
    have = set(df.columns)
    x = lambda c: F.col(c).cast("double")
    i = float(intensity)
    new: dict[str, Column] = {}
    if name == "adoption_chute":
        new["taux_adoption_pct"] = maths.clip(
            x("taux_adoption_pct") - 20 * i + normal * (5 * i), 0, 100.0
        )
        factor = F.pow(0.4 + 0.3 * u, F.lit(i))
        new["connexions_30j"] = F.bround(maths.clip(x("connexions_30j") * factor, low=0))
    elif name == "nouveau_segment":
        chosen = u < 0.3 * i
        new["sieges_souscrits"] = F.when(chosen, 50 + F.floor(150 * v)).otherwise(
            x("sieges_souscrits")
        )
        new["utilisateurs_actifs"] = F.when(chosen, 5 + F.floor(15 * v)).otherwise(
            x("utilisateurs_actifs")
        )
        new["revenu_mensuel_recurrent_eur"] = F.when(chosen, 5000 + 15000 * v).otherwise(
            x("revenu_mensuel_recurrent_eur")
        )
    elif name == "anciennete_rajeunissement":
        new["anciennete_mois"] = maths.clip(
            x("anciennete_mois") * (1 - 0.5 * i) + normal * 3.0, low=0
        )
    else:
        # Poisson(2) by inversion, exponential(10) by inverse transform
        poisson, cumulative, term = F.lit(0), 0.0, 0.1353352832366127
        for k in range(12):
            cumulative += term
            poisson = F.when(u >= cumulative, F.lit(k + 1)).otherwise(poisson)
            term *= 2.0 / (k + 1)
        new["tickets_support_90j"] = maths.clip(
            x("tickets_support_90j") * (1 + 1.5 * i) + poisson, low=0
        )
        wait = -10.0 * F.log(F.greatest(1.0 - v, F.lit(1e-12)))
        new["delai_reponse_support_h"] = maths.clip(
            x("delai_reponse_support_h") * (1 + 2.0 * i) + wait, low=0
        )
    return df.withColumns({c: e.cast("double") for c, e in new.items() if c in have})


def output_drift(
    previous: DataFrame,
    current: DataFrame,
    decision: str = "decision",
    points: float = THRESHOLDS.rollback_points,
) -> DataFrame:
    """(decision, shares, gap in points, rollback flag) between two score dates."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(decision).agg(F.count("*").alias("n"))
        total = F.broadcast(counts.agg(F.sum("n").alias("t")))
        return counts.crossJoin(total).select(decision, (F.col("n") / F.col("t")).alias(name))

    joined = shares(previous, "part_avant").join(shares(current, "part_apres"), decision, "full")
    filled = joined.na.fill(0.0, ["part_avant", "part_apres"])
    gap = 100 * (F.col("part_apres") - F.col("part_avant"))
    rollback = (F.col(decision) == "ALERTE_ROUGE") & (F.abs(gap) > points)
    return filled.withColumns({"ecart_points": gap, "retour_arriere": rollback})
