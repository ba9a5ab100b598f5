"""Projections, business features and enrichment joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions import maths, sizing
from tenura.functions.text import normalise
from tenura.operators import references
from tenura.operators.ordering import column_quantiles, quantile_row
from tenura.operators.quality import NULLABLE_FIELDS, RECOMPUTED_FIELDS, is_numeric, is_text
from tenura.params import (
    DENIED_COLUMNS,
    SUSPECTED_DECOYS,
    THRESHOLDS,
    UNMODELLED_COLUMNS,
)

ADOPTION = ("taux_adoption_pct", "utilisateurs_actifs", "sieges_souscrits")


def _number(df: DataFrame, c: str) -> Column:
    """Numeric column, or null where the table has no such column."""
    return F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")


def _recomputed_rate(df: DataFrame) -> Column:
    return maths.ratio(
        100 * _number(df, "utilisateurs_actifs"), _number(df, "sieges_souscrits")
    )


def rebuild_adoption_rate(df: DataFrame) -> DataFrame:
    """Fill a missing rate from users and seats, within [0, 100]; never overwrite."""
    if not set(ADOPTION) <= set(df.columns):
        return df
    filled = maths.clip(_recomputed_rate(df), 0, 100.0)
    return df.withColumn(
        "taux_adoption_pct", F.coalesce(_number(df, "taux_adoption_pct"), filled)
    )


def rebuilt_count(df: DataFrame) -> DataFrame:
    gap = F.col("taux_adoption_pct").isNull() & _recomputed_rate(df).isNotNull()
    return df.agg(F.count_if(gap).alias("n_combles"))


def adoption_consistency(df: DataFrame, limit: float = THRESHOLDS.adoption_gap_points) -> DataFrame:
    """One row comparing the declared rate with 100 x users / seats."""
    gap = F.abs(_recomputed_rate(df) - _number(df, "taux_adoption_pct"))
    n, bad = F.count(gap), F.count_if(gap > limit)
    return df.agg(
        n.alias("n_comparables"),
        F.avg(gap).alias("ecart_moyen_pts"),
        F.max(gap).alias("ecart_max_pts"),
        bad.alias("n_incoherences"),
        F.try_divide(bad, n).alias("part_incoherences"),
    )


def tenure_band(months: Column) -> Column:
    """Right-closed bands; below the first bound the band is null."""
    return (
        F.when(months <= -0.001, F.lit(None).cast("string"))
        .when(months <= 2, "onboarding")
        .when(months <= 12, "installation")
        .when(months.isNotNull(), "mature")
    )


def integration_band(n: Column) -> Column:
    return (
        F.when(n <= -0.001, F.lit(None).cast("string"))
        .when(n <= 0, "aucune")
        .when(n <= 3, "faible")
        .when(n <= 8, "moderee")
        .when(n.isNotNull(), "forte")
    )


def business_features(df: DataFrame) -> DataFrame:
    """Ratios, flags, bands and missing indicators, all in one projection."""
    df = rebuild_adoption_rate(df)
    num = lambda c: _number(df, c)
    seats, users = num("sieges_souscrits"), num("utilisateurs_actifs")
    tenure, recency = num("anciennete_mois"), num("derniere_connexion_jours")
    tickets = num("tickets_support_90j")
    new = {
        "taux_utilisation_sieges": maths.ratio(users, seats),
        "surdimensionnement": maths.clip(seats - users, low=0),
        "intensite_usage_par_utilisateur": maths.ratio(num("heures_usage_30j"), users),
        "connexions_par_utilisateur": maths.ratio(num("connexions_30j"), users),
        "taux_couverture_fonctionnelle": maths.ratio(
            num("fonctionnalites_utilisees"), num("fonctionnalites_total")
        ),
        "arpu_par_siege": maths.ratio(num("revenu_mensuel_recurrent_eur"), seats),
        "recence_normalisee": maths.ratio(recency, tenure * 30),
        "compte_dormant": maths.is_true(recency > THRESHOLDS.inactivity_days),
        "pression_support": maths.ratio(tickets, users),
        "intensite_support": maths.ratio(tickets, tenure),
        "tranche_anciennete": tenure_band(tenure),
        "tranche_integrations": integration_band(num("nb_integrations")),
    }
    for c in ("csat", "heures_usage_30j", "delai_reponse_support_h"):
        if c in df.columns:
            new[f"{c}_manquant"] = F.col(c).isNull()
    return df.withColumns(new)


def gap_to_group_reference(
    df: DataFrame, medians: Mapping[str, float] | None, group: str = "secteur", value: str = "csat"
) -> DataFrame:
    """value - supplied group reference; no column when no reference is given."""
    if not medians or group not in df.columns or value not in df.columns:
        return df
    reference = df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in medians.items()], "_g string, _ref double"
    )
    side = sizing.broadcast_if_small(reference, len(medians))
    joined = df.join(side, F.col(group) == F.col("_g"), "left")
    gap = F.col(value).cast("double") - F.col("_ref")
    return joined.withColumn(f"ecart_{value}_{group}", gap).drop("_g", "_ref")


def join_catalogue(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Left join on the plan label, then agreed discount and fit of the plan."""
    extra = [c for c in catalogue.columns if c != "plan"]
    side = catalogue.select(normalise(F.col("plan")).alias("_plan"), *extra)
    key = normalise(F.col("plan")) if "plan" in df.columns else F.lit(None).cast("string")
    joined = df.join(sizing.broadcast_if_counted(side), key == F.col("_plan"), "left").drop("_plan")
    seats = _number(joined, "sieges_souscrits")
    use = maths.ratio(_number(joined, "utilisateurs_actifs"), seats)
    list_price = _number(joined, "prix_mensuel_par_siege_eur") * seats
    return joined.withColumns(
        {
            "remise_consentie": 1.0
            - maths.ratio(_number(joined, "revenu_mensuel_recurrent_eur"), list_price),
            "adequation_plan": F.when(use >= 0.9, "sous-dimensionne")
            .when(use < 0.5, "sur-dimensionne")
            .when(use.isNotNull(), "adapte"),
        }
    )


def enrich_by_sector(df: DataFrame) -> DataFrame:
    if "secteur" not in df.columns:
        return df
    side = F.broadcast(references.sectors(df.sparkSession))
    joined = df.join(side, normalise(F.col("secteur")) == F.col("cle"), "left").drop("cle")
    churn, growth = references.SECTOR_FALLBACK
    out = joined.withColumns(
        {
            "taux_churn_median_saas_pct": F.coalesce("taux_churn_median_saas_pct", F.lit(churn)),
            "dynamique_croissance": F.coalesce("dynamique_croissance", F.lit(growth)),
        }
    )
    if "taux_adoption_pct" in df.columns:
        reference = 100.0 - F.col("taux_churn_median_saas_pct")
        out = out.withColumn(
            "ecart_adoption_secteur", F.col("taux_adoption_pct").cast("double") - reference
        )
    return out


def enrich_by_country(df: DataFrame) -> DataFrame:
    if "pays" not in df.columns:
        return df
    side = F.broadcast(references.countries(df.sparkSession))
    joined = df.join(side, normalise(F.col("pays")) == F.col("cle"), "left").drop("cle")
    zone, french, hours = references.COUNTRY_FALLBACK
    return joined.withColumns(
        {
            "zone_reglementaire": F.coalesce("zone_reglementaire", F.lit(zone)),
            "langue_support_fr": F.coalesce("langue_support_fr", F.lit(french)),
            "decalage_horaire_paris_h": F.coalesce("decalage_horaire_paris_h", F.lit(hours)),
        }
    )


def fallback_coverage(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(libelle, n): rows per label that has no reference row and takes the fallback."""
    label = normalise(F.col(column))
    return (
        df.select(label.alias("libelle"))
        .groupBy("libelle")
        .agg(F.count("*").alias("n"))
        .join(sizing.broadcast_if_counted(known.select("cle")), F.col("libelle") == F.col("cle"), "left_anti")
        .select(F.coalesce("libelle", F.lit("(manquant)")).alias("libelle"), "n")
    )


def normalise_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: normalise(F.col(c)) for c in columns})


# --- statistics learned on one table and applied to another ---------------------------------

_STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def fit_group_aggregate(
    train: DataFrame, group: str, value: str, statistic: str = "median"
) -> tuple[DataFrame, DataFrame]:
    """((groupe, reference) per group, one-row global reference)."""
    pairs = train.select(F.col(group).alias("groupe"), F.col(value).cast("double").alias("v"))
    known = pairs.where("groupe IS NOT NULL")
    if statistic == "median":
        per = column_quantiles(known, ["v"], [0.5], ["groupe"])
        per = per.select("groupe", F.col("q")[0].alias("reference"))
        overall = quantile_row(pairs, "v", [0.5]).select(F.col("q")[0].alias("globale"))
        return per, overall
    if statistic not in _STATISTICS:
        raise ValueError(f"statistic {statistic!r} not in {['median', *_STATISTICS]}")
    f = _STATISTICS[statistic]
    return (
        known.groupBy("groupe").agg(f("v").alias("reference")),
        pairs.agg(f("v").alias("globale")),
    )


def apply_group_aggregate(
    df: DataFrame, fitted: tuple[DataFrame, DataFrame], group: str, out: str
) -> DataFrame:
    """Group reference, or the global one for an unknown or missing group."""
    per, overall = fitted
    joined = df.join(per, df[group] == per["groupe"], "left").crossJoin(F.broadcast(overall))
    reference = F.coalesce("reference", "globale")
    return joined.withColumn(out, reference).drop("groupe", "reference", "globale")


def gap_to_group(
    train: DataFrame,
    df: DataFrame,
    group: str,
    value: str,
    statistic: str = "median",
    out: str | None = None,
) -> DataFrame:
    """value - aggregate of its normalised group learned on `train`."""
    key = "_groupe"
    label = normalise(F.col(group))
    fitted = fit_group_aggregate(train.withColumn(key, label), key, value, statistic)
    applied = apply_group_aggregate(df.withColumn(key, label), fitted, key, "_reference")
    gap = F.col(value).cast("double") - F.col("_reference")
    return applied.withColumn(out or f"ecart_{value}_{group}", gap).drop(key, "_reference")


def skewed_columns(
    train: DataFrame, columns: Sequence[str], threshold: float = THRESHOLDS.skew_log
) -> DataFrame:
    """(colonne, asymetrie, a_transformer): adjusted skew over the limit, not binary."""

    def measured(c: str) -> Column:
        x = F.col(c).cast("double")
        skew = maths.adjusted_skew(maths.nan_to_null(F.skewness(x)), F.count(x))
        return F.struct(
            F.coalesce(skew, F.lit(0.0)).alias("asymetrie"),
            # three distinct values exist when some value lies strictly between min and max
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
        ).alias(c)

    bounds = train.agg(*[measured(c) for c in columns])
    inner = train.crossJoin(F.broadcast(bounds.select(*[F.col(c).alias(f"_{c}") for c in columns])))
    between = inner.agg(
        *[
            F.struct(
                F.first(f"_{c}.asymetrie").alias("asymetrie"),
                F.coalesce(
                    F.bool_or((F.col(c) > F.col(f"_{c}.lo")) & (F.col(c) < F.col(f"_{c}.hi"))),
                    F.lit(False),
                ).alias("plus_de_deux"),
            ).alias(c)
            for c in columns
        ]
    )
    long = between.unpivot([], list(columns), "colonne", "m").select("colonne", "m.*")
    asymmetry = F.when(F.col("plus_de_deux"), F.col("asymetrie")).otherwise(0.0)
    return long.select(
        "colonne",
        asymmetry.alias("asymetrie"),
        (asymmetry > threshold).alias("a_transformer"),
    )


def signed_log_skewed(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed log of the columns found skewed on `train`; the choice is made here."""
    found = skewed_columns(train, columns).where("a_transformer").select("colonne").collect()
    return df.withColumns({r[0]: maths.signed_log(F.col(r[0]).cast("double")) for r in found})


def impute_by_median(
    df: DataFrame, column: str, train: DataFrame | None = None
) -> DataFrame:
    median = quantile_row(train if train is not None else df, column, [0.5])
    joined = df.crossJoin(median.select(F.col("q")[0].alias("_median")))
    filled = F.coalesce(F.col(column).cast("double"), F.col("_median"))
    return joined.withColumn(column, filled).drop("_median")


# --- model inputs --------------------------------------------------------------------------


def model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns a model may see; a denied column is an error."""
    denied = sorted(set(df.columns) & set(DENIED_COLUMNS))
    if denied:
        raise ValueError(f"denied columns reach the model: {denied}")
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    categorical = [c for c in df.columns if is_text(df, c) and c not in UNMODELLED_COLUMNS]
    return numeric, categorical


def prepare_features(df: DataFrame, excluded: Sequence[str] = SUSPECTED_DECOYS) -> DataFrame:
    """Business features without denied, excluded and date columns."""
    featured = business_features(df)
    kept = featured.drop(*DENIED_COLUMNS, *excluded, *UNMODELLED_COLUMNS)
    model_columns(kept)
    return kept


def regression_features(df: DataFrame, target: str = "valeur_vie_client_eur") -> DataFrame:
    return df.drop(*DENIED_COLUMNS, *UNMODELLED_COLUMNS, target)


def monitoring_reference(df: DataFrame) -> DataFrame:
    """Numeric columns without denied and decoy ones."""
    kept = df.drop(*DENIED_COLUMNS, *SUSPECTED_DECOYS)
    return kept.select(*[c for c in kept.columns if is_numeric(kept, c)])


def rule_baseline(df: DataFrame) -> Column:
    """1 when long inactive or unhappy; a missing or absent column triggers nothing."""
    flag = F.lit(False)
    if "derniere_connexion_jours" in df.columns:
        flag = flag | maths.is_true(
            F.col("derniere_connexion_jours") > THRESHOLDS.inactivity_days
        )
    if "csat" in df.columns:
        flag = flag | maths.is_true(F.col("csat") <= THRESHOLDS.low_csat)
    return flag.cast("int")


def request_features(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The gold feature chain applied to incoming requests."""
    enriched = join_catalogue(business_features(df), catalogue)
    return enrich_by_country(enrich_by_sector(enriched))


def imputed_fields(
    fields: Sequence[str] = NULLABLE_FIELDS, exact: Sequence[str] = RECOMPUTED_FIELDS
) -> Column:
    """Sorted array of the nullable fields a request leaves empty."""
    named = sorted(f for f in fields if f not in exact)
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in named]))


def risk_signals() -> Column:
    """Up to three ordered messages; a missing field never triggers one."""
    col = F.col
    last, csat = col("derniere_connexion_jours"), col("csat")
    late, rate = col("retards_paiement_12m"), col("taux_adoption_pct")
    tickets = col("tickets_support_90j")
    coverage = maths.ratio(col("fonctionnalites_utilisees"), col("fonctionnalites_total"))

    def text(pattern: str, *args: Column) -> Column:
        return F.format_string(pattern, *args)

    signals = F.array_compact(
        F.array(
            F.when(
                last > THRESHOLDS.inactivity_days,
                text("inactivité élevée (%d j sans connexion)", last.cast("bigint")),
            ),
            F.when(
                csat <= THRESHOLDS.low_csat,
                text("satisfaction faible (CSAT = %.1f)", csat.cast("double")),
            ),
            F.when(late > 0, text("retards de paiement (%d sur 12 mois)", late.cast("bigint"))),
            F.when(
                rate < 30,
                text("adoption faible (%d %%)", F.bround(rate.cast("double")).cast("bigint")),
            ),
            F.when(
                tickets > 5,
                text("volume élevé de tickets (%d sur 90 jours)", tickets.cast("bigint")),
            ),
            F.when(
                coverage < 0.33,
                text(
                    "couverture fonctionnelle faible (%d%%)",
                    F.bround(coverage * 100).cast("bigint"),
                ),
            ),
        )
    )
    none = F.array(F.lit("aucun signal négatif identifié"))
    return F.when(F.size(signals) > 0, F.slice(signals, 1, 3)).otherwise(none)
