"""Leakage and decoy audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions import maths, pvalues
from tenura.operators import explore, primitives
from tenura.operators.ordering import column_quantiles, quantile_row
from tenura.params import THRESHOLDS

# Signatures of a realised and of a prospective lifetime value.
REALISED_MAX_SHARE, REALISED_MIN_ELASTICITY = 0.10, 0.70
PROSPECTIVE_MIN_SHARE, PROSPECTIVE_MAX_ELASTICITY = 0.50, 0.50


def leak_scan(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    threshold: float = THRESHOLDS.leak_auc,
    min_rows: int = 50,
) -> DataFrame:
    """Univariate AUC of every column; text is encoded by the mean target of its level.

    `sniff_numeric` tells which text columns are numbers.
    """
    known = df.where(F.col(target).isNotNull())
    numbers = explore.univariate_auc(known, numeric, target).select(
        "variable", F.lit("numerique").alias("type"), "n", "auc"
    )
    # a level's rows share one encoded value, so levels are the distinct values
    encoded = (
        explore._level_counts(known, categorical, target)
        .withColumn("taux", F.col("pos") / F.col("n"))
        .groupBy("variable", "taux")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    )
    labels = primitives.rank_statistics_of_counts(encoded, "taux", ["variable"]).select(
        "variable", F.lit("categorielle").alias("type"), "n", "auc"
    )
    total = F.broadcast(known.agg(F.count("*").alias("total")))
    both = numbers.unionByName(labels).where((F.col("n") >= min_rows) & F.col("auc").isNotNull())
    score = F.greatest("auc", 1 - F.col("auc"))
    direction = (
        F.when(F.col("type") == "categorielle", "-")
        .when(F.col("auc") >= 0.5, "hausse")
        .otherwise("baisse")
    )
    return both.crossJoin(total).select(
        F.col("variable").alias("colonne"),
        "type",
        F.round(score, 4).alias("auc_univariee"),
        direction.alias("sens"),
        (1 - F.col("n") / F.col("total")).alias("part_manquants"),
        (score >= threshold).alias("suspecte_fuite"),
    )


def _eta(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(categorie, nombre, n, niveaux, eta) for every pair, one pass over levels.

    Numbers stay wide while categories are unpivoted, so rows grow with the categories only.
    """
    means = explore.centres(df, list(numeric))  # squares of distances from the mean keep their digits
    numbers = [(F.col(c).cast("double") - F.lit(means[c])).alias(f"_n_{c}") for c in numeric]
    levels = (
        df.select(*numbers, *[F.col(c).cast("string").alias(c) for c in categorical])
        .unpivot([f"_n_{c}" for c in numeric], list(categorical), "categorie", "niveau")
        .where("niveau IS NOT NULL")
        .groupBy("categorie", "niveau")
        .agg(
            *[
                F.struct(
                    F.count(f"_n_{c}").alias("n"),
                    F.sum(f"_n_{c}").alias("s"),
                    F.sum(F.col(f"_n_{c}") * F.col(f"_n_{c}")).alias("ss"),
                ).alias(c)
                for c in numeric
            ]
        )
        .unpivot(["categorie", "niveau"], list(numeric), "nombre", "m")
        .where("m.n > 0")
    )
    n, s, ss = F.col("m.n"), F.col("m.s"), F.col("m.ss")
    per = levels.groupBy("categorie", "nombre").agg(
        F.sum(n).alias("n"),
        F.count("*").alias("niveaux"),
        F.sum(s * s / n).alias("between"),
        F.sum(s).alias("s"),
        F.sum(ss).alias("ss"),
    )
    centre = F.col("s") * F.col("s") / F.col("n")
    share = F.when(
        F.col("ss") - centre > 0, (F.col("between") - centre) / (F.col("ss") - centre)
    ).otherwise(0.0)
    eta = F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    return per.select("categorie", "nombre", "n", "niveaux", eta.alias("eta"))


def correlation_ratio(df: DataFrame, category: str, number: str) -> DataFrame:
    return _eta(df, [category], [number])


def _v_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(a, b, n, lignes, colonnes, v_cramer) for every pair of categories."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(a).cast("string").alias("va"),
                F.col(b).cast("string").alias("vb"),
            )
            for a in left
            for b in right
            if a != b
        ]
    )
    long = df.select(F.explode(pairs).alias("x")).select("x.*")
    cells = primitives.contingency(long, "va", "vb", ["a", "b"])
    return primitives.chi_square(cells, "va", "vb", ["a", "b"])


def max_redundancy(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ref_numeric: Sequence[str],
    ref_categorical: Sequence[str],
    max_levels: int = 50,
    min_rows: int = 20,
) -> DataFrame:
    """(colonne, max_redondance, variable_jumelle, mesure) against all reference columns.

    |r| for two numbers, eta for a number and a category, Cramér's V for two categories.
    """
    parts: list[DataFrame] = []

    def add(frame: DataFrame, value: str, label: str) -> None:
        parts.append(
            frame.select("colonne", "jumelle", "n", F.col(value).alias("v"), F.lit(label).alias("m"))
        )

    if numeric and ref_numeric:
        pairs = explore.correlation_pairs(df, [*numeric, *ref_numeric])
        both = pairs.where(
            F.col("variable_1").isin(*numeric) & F.col("variable_2").isin(*ref_numeric)
        )
        add(
            both.select(
                F.col("variable_1").alias("colonne"),
                F.col("variable_2").alias("jumelle"),
                "n",
                F.abs("correlation").alias("v"),
            ),
            "v",
            "|r| Pearson",
        )
    if numeric and ref_categorical:
        eta = _eta(df, ref_categorical, numeric).where(F.col("niveaux") <= max_levels)
        add(
            eta.select(
                F.col("nombre").alias("colonne"), F.col("categorie").alias("jumelle"), "n", "eta"
            ),
            "eta",
            "eta",
        )
    if categorical and ref_numeric:
        eta = _eta(df, categorical, ref_numeric)
        add(
            eta.select(
                F.col("categorie").alias("colonne"), F.col("nombre").alias("jumelle"), "n", "eta"
            ),
            "eta",
            "eta",
        )
    if categorical and ref_categorical:
        v = _v_pairs(df, categorical, ref_categorical).where(F.col("colonnes") <= max_levels)
        add(
            v.select(F.col("a").alias("colonne"), F.col("b").alias("jumelle"), "n", "v_cramer"),
            "v_cramer",
            "V de Cramér",
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    usable = union.where((F.col("n") >= min_rows) & (F.col("v") > 0))
    best = usable.groupBy("colonne").agg(
        F.max(F.struct("v", "jumelle", F.col("m").alias("mesure"))).alias("b")
    )
    return best.select(
        "colonne",
        F.col("b.v").alias("max_redondance"),
        F.col("b.jumelle").alias("variable_jumelle"),
        F.col("b.mesure").alias("mesure_redondance"),
    )


def screen_decoys(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ref_numeric: Sequence[str],
    ref_categorical: Sequence[str],
    threshold: float = THRESHOLDS.redundancy,
    with_p: bool = True,
) -> DataFrame:
    """Association, redundancy and a provisional verdict per suspected column."""
    power = explore.discriminating_power(
        df, numeric, categorical, target, with_p
    ).withColumnRenamed("variable", "colonne")
    twins = max_redundancy(df, numeric, categorical, ref_numeric, ref_categorical)
    joined = power.join(twins, "colonne", "left").withColumns(
        {
            "max_redondance": F.coalesce("max_redondance", F.lit(0.0)),
            "variable_jumelle": F.coalesce("variable_jumelle", F.lit("")),
        }
    )
    if not with_p:
        return joined
    verdict = (
        F.when(F.col("max_redondance") >= threshold, "redondant")
        .when(F.col("significatif_bh"), "potentiellement utile")
        .otherwise("leurre probable")
    )
    return joined.withColumn("verdict_provisoire", verdict)


def lifetime_value_nature(
    df: DataFrame,
    value: str = "valeur_vie_client_eur",
    tenure: str = "anciennete_mois",
    revenue: str = "revenu_mensuel_recurrent_eur",
    target: str = "churn",
) -> DataFrame:
    """One row: is the lifetime value realised or prospective?

    Elasticities solve the two-regressor normal equations from covariances, as expressions.
    """
    v, t, m = (F.col(c).cast("double") for c in (value, tenure, revenue))
    rows = df.select(
        v.alias("v"), t.alias("t"), m.alias("m"), F.col(target).cast("int").alias("y")
    ).dropna()
    positive = (F.col("v") > 0) & (F.col("t") > 0) & (F.col("m") > 0)
    lv, lt, lm = (F.when(positive, F.log(c)) for c in ("v", "t", "m"))
    product = F.col("m") * F.col("t")
    ratio = F.try_divide(F.col("v"), product)
    base = rows.agg(
        F.count("*").alias("n"),
        maths.pearson(F.col("v"), F.col("t")).alias("r_anciennete"),
        maths.pearson(F.col("v"), F.col("m")).alias("r_mrr"),
        maths.pearson(F.col("v"), product).alias("r_mrr_x_anciennete"),
        F.avg((F.col("v") > product).cast("int")).alias("part_clv_sup_cumul"),
        F.var_pop(lm).alias("smm"),
        F.var_pop(lt).alias("stt"),
        F.covar_pop(lm, lt).alias("smt"),
        F.covar_pop(lm, lv).alias("smv"),
        F.covar_pop(lt, lv).alias("stv"),
    )
    det = F.col("smm") * F.col("stt") - F.col("smt") * F.col("smt")
    e_mrr = F.try_divide(F.col("stt") * F.col("smv") - F.col("smt") * F.col("stv"), det)
    e_age = F.try_divide(F.col("smm") * F.col("stv") - F.col("smt") * F.col("smv"), det)
    ratios = rows.select(ratio.alias("ratio"), F.try_divide("v", "m").alias("mois"), "y")
    quantiles = quantile_row(ratios, "mois", [0.05, 0.5, 0.95])
    middle = quantile_row(ratios, "ratio", [0.5]).select(F.col("q")[0].alias("rm"))
    rho = explore.spearman_pairs(ratios, [("mois", "y")]).select(
        F.col("rho").alias("rho_mois_churn")
    )
    share, age = F.col("part_clv_sup_cumul"), F.col("elasticite_anciennete")
    nature = (
        F.when((share <= REALISED_MAX_SHARE) & (age >= REALISED_MIN_ELASTICITY), "realisee")
        .when((share >= PROSPECTIVE_MIN_SHARE) & (age < PROSPECTIVE_MAX_ELASTICITY), "prospective")
        .otherwise("indeterminee")
    )
    out = base.crossJoin(quantiles).crossJoin(middle).crossJoin(F.broadcast(rho))
    return out.select(
        "n",
        "r_anciennete",
        "r_mrr",
        "r_mrr_x_anciennete",
        "part_clv_sup_cumul",
        F.col("rm").alias("ratio_cumul_median"),
        e_mrr.alias("elasticite_mrr"),
        e_age.alias("elasticite_anciennete"),
        *[F.col("q")[i].alias(f"mois_mrr_{n}") for i, n in enumerate(("p05", "p50", "p95"))],
        "rho_mois_churn",
    ).withColumn("nature_clv", nature)


def lifetime_value_p_values(nature: DataFrame) -> DataFrame:
    """Adds two-sided p-values to the correlations of `lifetime_value_nature`."""
    return nature.withColumns(
        {
            f"p_{c}": pvalues.pearson_p(F.col(r), F.col("n"))
            for c, r in (
                ("anciennete", "r_anciennete"),
                ("mrr", "r_mrr"),
                ("mrr_x_anciennete", "r_mrr_x_anciennete"),
                ("mois_churn", "rho_mois_churn"),
            )
        }
    )


def lifetime_value_by_class(
    df: DataFrame,
    value: str = "valeur_vie_client_eur",
    revenue: str = "revenu_mensuel_recurrent_eur",
    target: str = "churn",
) -> DataFrame:
    rows = df.where(F.col(value).isNotNull() & F.col(revenue).isNotNull())
    medians = (
        column_quantiles(rows, [value, revenue], [0.5], [target])
        .groupBy(target)
        .agg(
            *[
                F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(n)
                for c, n in ((value, "clv_mediane"), (revenue, "mrr_median"))
            ]
        )
    )
    means = rows.groupBy(target).agg(F.count("*").alias("n"), F.avg(value).alias("clv_moyenne"))
    return means.join(medians, target)


def decoy_verdict(
    screen: DataFrame,
    permutation: DataFrame,
    drop: DataFrame,
    redundancy: float = THRESHOLDS.redundancy,
    negligible_permutation: float = 0.01,
) -> DataFrame:
    """Three evidence tables to one verdict per column.

    screen: colonne, significatif_bh, max_redondance, variable_jumelle;
    permutation: colonne, ic95_haut; drop: colonne, delta_pr_auc, negligeable.
    """
    joined = screen.select(
        "colonne", "significatif_bh", "max_redondance", "variable_jumelle"
    ).join(
        permutation.select("colonne", "ic95_haut"), "colonne", "left"
    ).join(drop.select("colonne", "delta_pr_auc", "negligeable"), "colonne", "left")
    linked = maths.is_true(F.col("significatif_bh"))
    idle = maths.is_true(F.col("ic95_haut") < negligible_permutation)
    unneeded = maths.is_true(F.col("negligeable"))
    twin = F.coalesce("max_redondance", F.lit(0.0))
    verdict: Column = (
        F.when(idle & (twin >= redundancy), "REDONDANT")
        .when(~linked & idle & unneeded, "LEURRE")
        .when(linked | ~idle, "UTILE")
        .otherwise("AMBIGU")
    )
    return joined.select(
        "colonne",
        linked.alias("association_significative"),
        idle.alias("permutation_negligeable"),
        unneeded.alias("drop_negligeable"),
        F.round(twin, 4).alias("max_redondance"),
        F.coalesce("variable_jumelle", F.lit("")).alias("variable_jumelle"),
        verdict.alias("verdict"),
    )
