"""Data quality: profiling, cleaning, business rules, missingness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions import maths, text
from tenura.operators import primitives
from tenura.operators.ordering import quantile_row
from tenura.params import DAYS_PER_MONTH, POSITIVE_COLUMNS, POSITIVE_PREFIXES, THRESHOLDS

SECONDS_PER_DAY = 86400.0


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def as_number(df: DataFrame, column: str) -> Column:
    """Number of a column, typed or still hand-written text."""
    return text.number(column) if is_text(df, column) else F.col(column).cast("double")


def as_date(df: DataFrame, column: str) -> Column:
    return text.parse_date(column) if is_text(df, column) else F.col(column).cast("date")


def null_out_markers(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Exact text markers become null in every text column; nothing is stripped or lowered."""
    listed = ", ".join("'" + m.replace("'", "\\'") + "'" for m in markers)
    return df.selectExpr(
        *[
            f"CASE WHEN `{c}` NOT IN ({listed}) THEN `{c}` END AS `{c}`" if is_text(df, c) else f"`{c}`"
            for c in df.columns
        ]
    )


# --- profile -------------------------------------------------------------------------------


def profile(df: DataFrame, top: int = 3, numeric_share: float = 0.80) -> DataFrame:
    """One row per column, from the counts of distinct values in long form."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = [c for c in df.columns if is_numeric(df, c)]
    textual = [c for c in df.columns if is_text(df, c)]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "colonne", "valeur"
    )
    counts = long.groupBy("colonne", "valeur").agg(F.count("*").alias("n"))
    filled = F.col("valeur").isNotNull()
    counts = counts.withColumns(
        {
            "nombre": F.when(F.col("colonne").isin(*numeric), F.col("valeur").cast("double"))
            .when(F.col("colonne").isin(*textual), text.number("valeur")),
            "marqueur": F.col("colonne").isin(*textual) & text.is_marker("valeur"),
        }
    )
    per = counts.groupBy("colonne").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("nb_non_nuls"),
        F.count("valeur").alias("cardinalite"),
        F.sum(F.when(filled & ~F.col("marqueur"), F.col("n"))).alias("renseignees"),
        F.sum(F.when(F.col("nombre").isNotNull(), F.col("n"))).alias("numeriques"),
        F.min("nombre").alias("lo"),
        F.max("nombre").alias("hi"),
    )
    by_count = Window.partitionBy("colonne").orderBy(F.col("n").desc(), "valeur")
    best = (
        counts.where(filled)
        .withColumn("rang", F.row_number().over(by_count))
        .where(F.col("rang") <= top)
        .groupBy("colonne")
        .agg(F.array_sort(F.collect_list(F.struct("rang", "valeur"))).alias("tops"))
    )
    stored_as_text = F.col("colonne").isin(*textual) & (
        F.coalesce(F.try_divide("numeriques", "renseignees"), F.lit(0.0)) > numeric_share
    )
    has_range = F.col("colonne").isin(*numeric) | stored_as_text
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return per.join(best, "colonne", "left").select(
        "colonne",
        kind[F.col("colonne")].alias("type"),
        "nb_non_nuls",
        F.round(1 - F.col("nb_non_nuls") / F.col("n"), 4).alias("taux_manquants"),
        "cardinalite",
        F.coalesce(F.array_join("tops.valeur", " | "), F.lit("")).alias("top3_valeurs"),
        F.when(has_range, F.col("lo")).alias("min"),
        F.when(has_range, F.col("hi")).alias("max"),
        stored_as_text.alias("numerique_en_texte"),
    )


# --- duplicates ----------------------------------------------------------------------------


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows in exact-copy groups, in key groups, and in key groups but not copies."""
    n, copied = F.col("_copies"), F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0)
    per_key = _copies(df).groupBy(key).agg(F.sum(n).alias("rows"), F.sum(copied).alias("exact"))
    repeated = F.col("rows") > 1
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("nb_total_lignes"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("nb_doublons_exacts"),
        F.coalesce(F.sum(F.when(repeated, F.col("rows"))), F.lit(0)).alias(
            "nb_doublons_cle_metier"
        ),
        F.coalesce(F.sum(F.when(repeated, F.col("rows") - F.col("exact"))), F.lit(0)).alias(
            "nb_doublons_cle_metier_non_exacts"
        ),
    )


def duplicate_examples(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Up to n keys of each kind of duplicate, smallest keys first."""
    per_key = _copies(df).groupBy(key).agg(
        F.sum("_copies").alias("lignes"), F.max("_copies").alias("copies")
    )
    exact = per_key.where(F.col("copies") > 1).orderBy(key).limit(n)
    keyed = per_key.where(F.col("lignes") > 1).orderBy(key).limit(n)
    return exact.select(F.lit("exact").alias("nature"), key, "lignes").unionByName(
        keyed.select(F.lit("cle").alias("nature"), key, "lignes")
    )


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Fail if a key repeats; returns df unchanged."""
    repeated = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {[r[0] for r in repeated]}")
    return df


# --- coercion ------------------------------------------------------------------------------


def coerce_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: as_number(df, c) for c in present})


def text_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, valeur): the columns as text, one below the other, gaps included.

    A text expression is then compiled once instead of once per column.
    """
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "colonne", "valeur"
    )


def every_column(per: DataFrame, columns: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """`per` with a row of zeros for each column that had no row at all."""
    names = per.sparkSession.createDataFrame([(c,) for c in columns], "colonne string")
    joined = F.broadcast(names).join(per, "colonne", "left")
    return joined.select("colonne", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts])


def coercion_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of the four coercion statuses per column, in one aggregate."""
    present = [c for c in columns if c in df.columns]
    states = text_values(df, present).select("colonne", text.coercion_status("valeur").alias("statut"))
    names = {"direct": "nb_directes", "repare": "nb_reparees", "manquant": "nb_manquants",
             "irrecuperable": "nb_irrecuperables"}
    per = states.groupBy("colonne").agg(
        *[F.count_if(F.col("statut") == s).alias(name) for s, name in names.items()]
    )
    return every_column(per, present, list(names.values()))


def numeric_text_columns(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(colonne, part_numerique, numerique) for text columns, measured after repair."""
    columns = [c for c in df.columns if is_text(df, c)]
    read = text_values(df, columns).select(
        "colonne", text.number("valeur").alias("nombre"), text.is_marker("valeur").alias("marque")
    )
    per = read.groupBy("colonne").agg(
        F.count("nombre").alias("n_num"), F.count_if(~F.col("marque")).alias("n")
    )
    share = F.try_divide("n_num", "n")
    return every_column(per, columns, ["n_num", "n"]).select(
        "colonne", share.alias("part_numerique"), maths.is_true(share > threshold).alias("numerique")
    )


def coerce_auto_columns(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Coerce the text columns found numeric; the choice is one aggregate, made here."""
    found = numeric_text_columns(df, threshold).where("numerique").select("colonne").collect()
    return coerce_numeric_columns(df, [r[0] for r in found])


# --- dates ---------------------------------------------------------------------------------


def _slash_parts(c: Column) -> tuple[Column, Column, Column]:
    stripped = text.strip(c)
    slashed = stripped.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    first = F.when(slashed, F.split_part(stripped, F.lit("/"), F.lit(1)).try_cast("int"))
    second = F.when(slashed, F.split_part(stripped, F.lit("/"), F.lit(2)).try_cast("int"))
    return slashed, first, second


def _slash_counts(c: Column) -> Column:
    slashed, first, second = _slash_parts(c)
    return F.struct(
        F.count_if(slashed).alias("nb_barres"),
        F.count_if(first > 12).alias("nb_premier"),
        F.count_if(second > 12).alias("nb_second"),
        F.count_if((first <= 12) & (second <= 12)).alias("nb_ambigues"),
    )


def _month_first(counts: str) -> Column:
    return (F.col(f"{counts}.nb_second") > 0) & (F.col(f"{counts}.nb_premier") == 0)


def slash_convention(df: DataFrame, column: str) -> DataFrame:
    """One row: how slash dates of the column are read, and how many are ambiguous."""
    return df.agg(_slash_counts(F.col(column)).alias("s")).select(
        F.when(F.col("s.nb_barres") == 0, "")
        .when(_month_first("s"), "MM/DD/YYYY")
        .otherwise("DD/MM/YYYY")
        .alias("convention"),
        "s.*",
    )


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each value in its own format; the slash reading is settled per column beforehand."""
    textual = [c for c in columns if c in df.columns and is_text(df, c)]
    if not textual:
        return df
    flags = df.agg(*[_slash_counts(F.col(c)).alias(c) for c in textual]).select(
        *[_month_first(c).alias(f"_month_first_{c}") for c in textual]
    )
    joined = df.crossJoin(F.broadcast(flags))
    parsed = {c: text.parse_date(c, f"`_month_first_{c}`") for c in textual}
    return joined.withColumns(parsed).select(*df.columns)


def date_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per text column; both slash readings are counted, the right one kept."""
    names = [name for name, _ in text.DATE_FORMATS]

    def measured(c: str) -> Column:
        day_first = text.date_format_used(c, month_first=False)
        month_first = text.date_format_used(c, month_first=True)
        filled = text.strip(F.col(c)) != ""
        return F.struct(
            _slash_counts(F.col(c)).alias("s"),
            F.count_if(filled).alias("filled"),
            F.array(*[F.count_if(day_first == n) for n in names]).alias("day"),
            F.array(*[F.count_if(month_first == n) for n in names]).alias("month"),
        ).alias(c)

    wide = df.agg(*[measured(c) for c in columns])
    long = wide.unpivot([], list(columns), "colonne", "m").select("colonne", "m.*")
    chosen = F.when(_month_first("s"), F.col("month")).otherwise(F.col("day"))
    formats = F.array(*[F.lit(n) for n in names])
    pairs = F.filter(F.arrays_zip(formats.alias("f"), F.col("counts").alias("n")),
                     lambda x: x["n"] > 0)
    best = F.element_at(formats, F.array_position("counts", F.array_max("counts")).cast("int"))
    dominant = F.when(F.array_max("counts") > 0, best).otherwise("%Y-%m-%d")
    parsed = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    convention = (
        F.when(F.col("s.nb_barres") == 0, dominant)
        .when(_month_first("s"), "MM/DD/YYYY")
        .otherwise("DD/MM/YYYY")
    )
    return long.withColumn("counts", chosen).select(
        "colonne",
        dominant.alias("format_detecte"),
        F.array_join(
            F.transform(pairs, lambda x: F.concat(x["f"], F.lit(" : "), x["n"].cast("string"))),
            " | ",
        ).alias("repartition_formats"),
        convention.alias("convention_retenue"),
        parsed.alias("nb_parsees"),
        F.col("s.nb_ambigues").alias("nb_ambigues"),
        (F.col("filled") - parsed).alias("nb_irrecuperables"),
    )


# --- tenure and business rules -------------------------------------------------------------


def _implied_seconds(df: DataFrame) -> Column:
    """Extraction instant implied by subscription date + declared tenure, in seconds."""
    days = F.unix_date(as_date(df, "date_souscription"))
    months = as_number(df, "anciennete_mois")
    return days * SECONDS_PER_DAY + months * (DAYS_PER_MONTH * SECONDS_PER_DAY)


def _to_day(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / SECONDS_PER_DAY).cast("int"))


def estimate_reference_date(df: DataFrame) -> DataFrame:
    """One row: median implied extraction date, the robust reference for tenure checks."""
    implied = df.select(_implied_seconds(df).alias("s"))
    return quantile_row(implied, "s", [0.5]).select(
        _to_day(F.col("q")[0]).alias("date_reference")
    )


def impossible_rules(
    df: DataFrame, reference: Column | None = None, tolerance: int = 3
) -> list[tuple[str, str, Column]]:
    """(rule, columns, predicate) for every rule whose columns are present."""
    have = set(df.columns)
    num = lambda c: as_number(df, c)
    rules: list[tuple[str, str, Column]] = []
    for c, low, high in (("taux_adoption_pct", 0, 100), ("csat", 1, 5)):
        if c in have:
            rules.append((f"{c} hors [{low}, {high}]", c, (num(c) < low) | (num(c) > high)))
    if "churn" in have:
        rules.append(("churn hors {0, 1}", "churn", ~num("churn").isin(0.0, 1.0)))
    rules += [(f"{c} < 0", c, num(c) < 0) for c in positive_columns(df.columns)]
    for low, high in (
        ("utilisateurs_actifs", "sieges_souscrits"),
        ("fonctionnalites_utilisees", "fonctionnalites_total"),
    ):
        if {low, high} <= have:
            rules.append((f"{low} > {high}", f"{low} / {high}", num(low) > num(high)))
    if {"taux_adoption_pct", "utilisateurs_actifs", "sieges_souscrits"} <= have:
        expected = maths.ratio(100 * num("utilisateurs_actifs"), num("sieges_souscrits"))
        rules.append(
            (
                "taux_adoption_pct incoherent (ecart > 1 point)",
                "taux_adoption_pct / utilisateurs_actifs / sieges_souscrits",
                F.abs(num("taux_adoption_pct") - expected) > 1,
            )
        )
    if {"connexions_30j", "derniere_connexion_jours"} <= have:
        rules.append(
            (
                "connexions_30j > 0 et derniere_connexion_jours > 30",
                "connexions_30j / derniere_connexion_jours",
                (num("connexions_30j") > 0) & (num("derniere_connexion_jours") > 30),
            )
        )
    if reference is not None and {"anciennete_mois", "date_souscription"} <= have:
        start = as_date(df, "date_souscription")
        months = F.bround(F.date_diff(reference, start) / DAYS_PER_MONTH)
        gap = F.abs(num("anciennete_mois") - months)
        rules.append(("date_souscription > date_reference", "date_souscription", start > reference))
        rules.append(
            (
                f"anciennete_mois incoherente (ecart > {tolerance} mois)",
                "anciennete_mois / date_souscription",
                gap > tolerance,
            )
        )
    return rules


def impossible_values(
    df: DataFrame, reference: DataFrame | None = None, tolerance: int = 3
) -> DataFrame:
    """Every rule with the number of rows that break it; one aggregate for all rules.

    `reference` is a one-row frame with `date_reference`.
    """
    at = None if reference is None else F.col("date_reference")
    rules = impossible_rules(df, at, tolerance)
    source = df if reference is None else df.crossJoin(F.broadcast(reference))
    wide = source.agg(*[F.count_if(p).alias(f"r{i}") for i, (_, _, p) in enumerate(rules)])
    names = F.create_map(
        *[
            F.lit(x) if isinstance(x, str) else x
            for i, (rule, columns, _) in enumerate(rules)
            for x in (f"r{i}", F.struct(F.lit(rule).alias("regle"), F.lit(columns).alias("c")))
        ]
    )
    long = wide.unpivot([], wide.columns, "id", "nb_lignes_concernees")
    return long.select(
        names[F.col("id")]["regle"].alias("regle"),
        names[F.col("id")]["c"].alias("colonne_ou_paire"),
        "nb_lignes_concernees",
        (F.col("nb_lignes_concernees") > 0).alias("violee"),
    )


def impossible_examples(
    df: DataFrame, key: str, reference: DataFrame | None = None, n: int = 3
) -> DataFrame:
    """Up to n keys per broken rule, smallest keys first."""
    at = None if reference is None else F.col("date_reference")
    source = df if reference is None else df.crossJoin(F.broadcast(reference))
    broken = F.array_compact(
        F.array(*[F.when(p, F.lit(rule)) for rule, _, p in impossible_rules(df, at)])
    )
    first = Window.partitionBy("regle").orderBy(key)
    return (
        source.select(key, F.explode(broken).alias("regle"))
        .withColumn("rang", F.row_number().over(first))
        .where(F.col("rang") <= n)
        .select("regle", "rang", key)
    )


def tenure_diagnosis(
    df: DataFrame, reference: DataFrame | None = None
) -> DataFrame:
    """One row: spread of implied extraction dates and whether tenure is in whole months."""
    implied = df.select(_implied_seconds(df).alias("s"))
    quartiles = quantile_row(implied, "s", [0.25, 0.5, 0.75])
    months = as_number(df, "anciennete_mois")
    span = df.agg(
        F.min(_implied_seconds(df)).alias("lo"),
        F.max(_implied_seconds(df)).alias("hi"),
        F.coalesce(F.bool_and(months % 1 == 0), F.lit(True)).alias("anciennete_entiere"),
        F.max(as_date(df, "date_souscription")).alias("date_souscription_max"),
    )
    joined = span.crossJoin(quartiles)
    median = _to_day(F.col("q")[1])
    if reference is not None:
        joined = joined.crossJoin(F.broadcast(reference))
        median = F.col("date_reference")
    return joined.select(
        median.alias("date_reference"),
        _to_day(F.col("lo")).alias("implicite_min"),
        _to_day(F.col("hi")).alias("implicite_max"),
        F.floor((F.col("hi") - F.col("lo")) / SECONDS_PER_DAY).alias("etendue_jours"),
        F.floor((F.col("q")[2] - F.col("q")[0]) / SECONDS_PER_DAY).alias("iqr_jours"),
        "anciennete_entiere",
        "date_souscription_max",
    )


def tenure_gaps(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(ecart_mois, n): declared minus recomputed tenure."""
    joined = df.crossJoin(F.broadcast(reference))
    days = F.date_diff("date_reference", as_date(df, "date_souscription"))
    gap = as_number(df, "anciennete_mois") - F.bround(days / DAYS_PER_MONTH)
    return (
        joined.select(gap.cast("bigint").alias("ecart_mois"))
        .where("ecart_mois IS NOT NULL")
        .groupBy("ecart_mois")
        .agg(F.count("*").alias("n"))
    )


def positive_columns(columns: Sequence[str]) -> list[str]:
    return [
        c for c in columns if c.lower() in POSITIVE_COLUMNS or c.lower().startswith(POSITIVE_PREFIXES)
    ]


def cap_impossible_values(df: DataFrame, positive: Sequence[str] | None = None) -> DataFrame:
    """Negatives to 0, adoption rate to [0, 100], users to at most seats; null stays null."""
    floored = positive_columns(df.columns) if positive is None else list(positive)
    capped = {c: maths.clip(as_number(df, c), low=0) for c in floored}
    if "taux_adoption_pct" in df.columns:
        capped["taux_adoption_pct"] = maths.clip(as_number(df, "taux_adoption_pct"), 0, 100.0)
    if {"utilisateurs_actifs", "sieges_souscrits"} <= set(df.columns):
        seats = capped.get("sieges_souscrits", as_number(df, "sieges_souscrits"))
        users = maths.clip(as_number(df, "utilisateurs_actifs"), low=0)
        capped["utilisateurs_actifs"] = maths.clip(users, high=seats)
    return df.withColumns(capped)


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_manquant": F.col(c).isNull() for c in present})


# --- missingness ---------------------------------------------------------------------------


def binary_association(df: DataFrame, mask: Column, other: str) -> DataFrame:
    """One row `force`: |point-biserial r| for a number, Cramér's V for a category."""
    flagged = df.select(mask.cast("int").alias("m"), F.col(other).alias("o")).where("o IS NOT NULL")
    if is_numeric(df, other):
        r = F.abs(maths.pearson(F.col("m"), F.col("o")))
        ok = (F.count("*") >= 10) & (F.min("m") != F.max("m"))
        return flagged.agg(F.coalesce(F.when(ok, r), F.lit(0.0)).alias("force"))
    levels = flagged.groupBy("o").agg(F.count("*").alias("n"), F.sum("m").alias("pos"))
    v = primitives.chi_square_binary(levels, [], yates=False)
    return v.select(F.when(F.col("n") >= 10, F.col("v_cramer")).otherwise(0.0).alias("force"))


def association_ready(
    df: DataFrame, target: str, max_levels: int = 100, max_unique: float = 0.5
) -> DataFrame:
    """(colonne, nature, retenue): how each column enters association measures.

    Text that is >80 % numeric is a number; near-unique text is left out.
    """
    others = [c for c in df.columns if c != target]
    textual = [c for c in others if is_text(df, c)]
    dated = [c for c in others if not is_text(df, c) and not is_numeric(df, c)]

    # one row per distinct value of a column; the repair of a number runs on these only
    values = text_values(df, others).groupBy("colonne", "valeur").agg(F.count("*").alias("n"))
    readable = F.col("colonne").isin(*textual) & text.number("valeur").isNotNull()
    filled = F.col("valeur").isNotNull()
    per = values.groupBy("colonne").agg(
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(readable, F.col("n")).otherwise(0)).alias("n_num"),
        F.count("valeur").alias("levels"),
    )
    long = every_column(per, others, ["n", "n_num", "levels"])
    typed = [c for c in others if c not in textual and c not in dated]
    number = F.col("colonne").isin(*typed) | (
        F.coalesce(F.try_divide("n_num", "n"), F.lit(0.0)) > 0.80
    )
    crowded = (F.col("levels") > max_levels) | (
        F.coalesce(F.try_divide("levels", "n"), F.lit(0.0)) > max_unique
    )
    return long.select(
        "colonne",
        F.when(number, "numerique").otherwise("categorielle").alias("nature"),
        (number | ~crowded).alias("retenue"),
    )


def _gap(c: str) -> Column:
    return F.col(c).isNull().cast("int")


def _gap_with_numbers(df: DataFrame, gappy: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(colonne, autre, force): |point-biserial r| from group means.

    r = (m1 - m0) / s * sqrt(n1 n0) / n, so one grouped pass serves every gap column.
    """
    moments = (
        df.select(
            *[_gap(c).alias(f"_gap_{c}") for c in gappy],
            *[F.col(c).cast("double").alias(c) for c in numeric],
        )
        .unpivot([f"_gap_{c}" for c in gappy], list(numeric), "autre", "x")
        .where("x IS NOT NULL")
        .groupBy("autre")
        .agg(
            F.count("*").alias("n"),
            F.sum("x").alias("sx"),
            F.stddev_pop("x").alias("sd"),
            *[
                F.struct(
                    F.sum(f"_gap_{c}").alias("n1"),
                    F.sum(F.col("x") * F.col(f"_gap_{c}")).alias("s1"),
                ).alias(c)
                for c in gappy
            ],
        )
        .unpivot(["autre", "n", "sx", "sd"], list(gappy), "colonne", "m")
        .select("*", "m.*")
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    shift = F.try_divide("s1", n1) - F.try_divide(F.col("sx") - F.col("s1"), n0)
    r = F.try_divide(F.abs(shift) * F.sqrt(n1.cast("double") * n0), F.col("n") * F.col("sd"))
    force = F.coalesce(F.when(F.col("n") >= 10, r), F.lit(0.0))
    return moments.select("colonne", "autre", force.alias("force"))


def _gap_with_categories(
    df: DataFrame, gappy: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """(colonne, autre, force): uncorrected Cramér's V, one grouped pass over levels."""
    levels = (
        df.select(
            *[_gap(c).alias(f"_gap_{c}") for c in gappy],
            *[F.col(c).cast("string").alias(c) for c in categorical],
        )
        .unpivot([f"_gap_{c}" for c in gappy], list(categorical), "autre", "niveau")
        .where("niveau IS NOT NULL")
        .groupBy("autre", "niveau")
        .agg(F.count("*").alias("n"), *[F.sum(f"_gap_{c}").alias(c) for c in gappy])
        .unpivot(["autre", "niveau", "n"], list(gappy), "colonne", "pos")
    )
    chi = primitives.chi_square_binary(levels, ["colonne", "autre"], yates=False)
    force = F.when(F.col("n") >= 10, F.col("v_cramer")).otherwise(0.0)
    return chi.select("colonne", "autre", force.alias("force"))


def missingness_report(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    with_p: bool = True,
) -> DataFrame:
    """Mechanism of missingness per column that has gaps.

    Two passes whatever the number of columns: one wide aggregate for the target link and the
    numeric associations, one grouped pass over levels for the categorical ones. `numeric` and
    `categorical` are the columns kept by `association_ready`.
    """
    columns = [c for c in df.columns if c != target]
    y = F.coalesce(F.col(target).cast("int"), F.lit(0))

    gappy = [c for c in columns if df.schema[c].nullable]
    miss = F.col("g")
    links = (
        df.select(y.alias("y"), F.col(target).cast("double").alias("t"),
                  *[_gap(c).alias(c) for c in gappy])
        .unpivot(["y", "t"], gappy, "colonne", "g")
        .groupBy("colonne")
        .agg(
            F.count("*").alias("n"),
            F.sum(miss).alias("n_miss"),
            F.sum("y").alias("pos"),
            F.sum(miss * F.col("y")).alias("pos_miss"),
            F.avg(F.when(miss == 1, F.col("t"))).alias("rate_miss"),
            F.avg(F.when(miss == 0, F.col("t"))).alias("rate_full"),
        )
        .where("n_miss > 0")
    )
    parts = []
    if numeric:
        parts.append(_gap_with_numbers(df, gappy, numeric))
    if categorical:
        parts.append(_gap_with_categories(df, gappy, categorical))
    forces = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    forces = forces.where("colonne <> autre")
    best = Window.partitionBy("colonne").orderBy(F.col("force").desc(), "autre")
    top = (
        forces.withColumn("rang", F.row_number().over(best))
        .where("rang <= 3")
        .groupBy("colonne")
        .agg(
            F.max("force").alias("assoc_max"),
            F.array_sort(
                F.collect_list(F.when(F.col("force") > 0, F.struct("rang", "autre", "force")))
            ).alias("tops"),
        )
    )
    # 2x2 table: gap/no gap against target 1/0
    n, m = F.col("n").cast("double"), F.col("n_miss").cast("double")
    p, a = F.col("pos").cast("double"), F.col("pos_miss").cast("double")
    both = (m < n) & (p > 0) & (p < n)
    gap_cell = F.abs(a - m * p / n)
    shrunk = gap_cell - F.least(F.lit(0.5), gap_cell)
    inverse = n * (1.0 / m + F.try_divide(F.lit(1.0), n - m)) * (
        F.try_divide(F.lit(1.0), p) + F.try_divide(F.lit(1.0), n - p)
    )
    rows = links.join(top, "colonne", "left").select(
        "colonne",
        F.round(m / n, 4).alias("taux_manquants"),
        F.when(both, shrunk * shrunk * inverse).alias("chi2_cible"),
        F.round("rate_miss", 4).alias("taux_churn_si_manquant"),
        F.round("rate_full", 4).alias("taux_churn_si_renseigne"),
        F.array_join(
            F.transform(
                "tops",
                lambda x: F.concat(x["autre"], F.lit("="), F.format_number(x["force"], 3)),
            ),
            ", ",
        ).alias("top3_associations"),
        F.coalesce("assoc_max", F.lit(0.0)).alias("association_max"),
    )
    if not with_p:
        return rows
    from tenura.functions.pvalues import chi2_p

    tested = rows.withColumn("p_value_cible", chi2_p(F.col("chi2_cible"), F.lit(1.0)))
    linked = maths.is_true(F.col("p_value_cible") < THRESHOLDS.alpha)
    strong = F.col("association_max")
    mechanism = F.when(linked, "MNAR").when(strong >= 0.15, "MAR").otherwise("MCAR")
    confidence = (
        F.when(linked & (F.col("p_value_cible") < 0.01), "elevee")
        .when(linked, "moderee")
        .when(strong > 0.3, "elevee")
        .when(strong > 0.2, "moderee")
        .when(strong >= 0.15, "faible")
        .when(F.col("taux_manquants") > 0.3, "faible")
        .otherwise("moderee")
    )
    advice = (
        F.when(linked, "indicateur de manquance puis imputation par mediane ou mode")
        .when(strong >= 0.15, "imputation conditionnelle aux variables associees")
        .otherwise("imputation simple ; supprimer la colonne au-dela de 50 % de manquants")
    )
    return tested.withColumns(
        {
            "lien_cible_significatif": linked,
            "mecanisme_propose": mechanism,
            "confiance": confidence,
            "recommandation": advice,
        }
    )


# --- table checks --------------------------------------------------------------------------


def strict_subset_check(sample: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """One row: is `sample` a strict subset of `full`, by row and by key?"""
    same = set(sample.columns) == set(full.columns)
    absent = (
        sample.exceptAll(full.select(*sample.columns)).agg(F.count("*").alias("lignes_absentes"))
        if same
        else sample.agg(F.count("*").alias("lignes_absentes"))
    )
    keys = (
        sample.select(key).distinct().join(full.select(key), key, "left_anti")
        .agg(F.count("*").alias("cles_absentes"))
    )
    sizes = sample.agg(F.count("*").alias("n_extrait")).crossJoin(
        full.agg(F.count("*").alias("n_complet"))
    )
    joined = absent.crossJoin(keys).crossJoin(sizes)
    return joined.select(
        F.lit(same).alias("memes_colonnes"),
        "lignes_absentes",
        "cles_absentes",
        "n_extrait",
        "n_complet",
        (
            F.lit(same)
            & (F.col("lignes_absentes") == 0)
            & (F.col("cles_absentes") == 0)
            & (F.col("n_extrait") < F.col("n_complet"))
        ).alias("sous_ensemble_strict"),
    )


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct labels of the fact with no row in the dimension."""
    right = dim.select(F.col(dim_key or key).alias(key))
    return fact.select(key).where(F.col(key).isNotNull()).distinct().join(right, key, "left_anti")


def label_normalisation_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, modalites_brutes, modalites_normalisees)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "colonne", "brut"
    )
    return (
        long.where("brut IS NOT NULL")
        .groupBy("colonne", "brut")
        .agg(F.lit(1).alias("_"))
        .groupBy("colonne", text.normalise(F.col("brut")).alias("norme"))
        .agg(F.count("*").alias("n"))
        .groupBy("colonne")
        .agg(F.sum("n").alias("modalites_brutes"), F.count("*").alias("modalites_normalisees"))
    )


# Patterns of personal data.
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "telephone": r"(?:\+\d{1,3}[\s.]?)?\d(?:[\s.-]?\d{2}){4}",
}


def pii_scan(
    df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] = PII_PATTERNS
) -> DataFrame:
    """Per text column: filled, distinct labels, lengths, values matching each pattern."""
    long = df.select(*columns).unpivot([], list(columns), "colonne", "texte")
    present = long.where("texte IS NOT NULL")
    size = F.char_length("texte")
    return present.groupBy("colonne").agg(
        F.count("*").alias("n_renseignes"),
        F.count_distinct(F.sha2("texte", 256)).alias("n_distincts"),
        F.min(size).cast("bigint").alias("longueur_min"),
        F.max(size).cast("bigint").alias("longueur_max"),
        *[F.count_if(F.col("texte").rlike(p)).alias(f"n_{n}") for n, p in patterns.items()],
    )


def column_provenance(df: DataFrame, origins: Mapping[str, str]) -> DataFrame:
    """(colonne, type, taux_manquants, origine) for every column."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "colonne", "taux_manquants")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    meta = F.create_map(
        *[
            x
            for c in df.columns
            for x in (
                F.lit(c),
                F.struct(
                    F.lit(kinds[c]).alias("type"), F.lit(origins.get(c, "feature")).alias("origine")
                ),
            )
        ]
    )
    return long.select(
        "colonne",
        meta[F.col("colonne")]["type"].alias("type"),
        F.round("taux_manquants", 4).alias("taux_manquants"),
        meta[F.col("colonne")]["origine"].alias("origine"),
    )


def _canonical(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return F.round(F.col(c).cast("double"), 9).cast("string")
    return F.col(c).cast("string")


def table_parity(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(colonne, n_differences) after a key join; rows on one side only count as different."""
    left = a.select(F.col(key).alias("_k"), *[_canonical(a, c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(key).alias("_k"), *[_canonical(b, c).alias(f"b_{c}") for c in columns])
    joined = left.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), "_k", "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    wide = joined.agg(
        *[
            F.count_if(alone | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c)
            for c in columns
        ]
    )
    return wide.unpivot([], list(columns), "colonne", "n_differences")


def functional_dependency(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(colonne, max_valeurs_par_cle): 1 means the key determines the column."""
    long = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string") for c in columns]).unpivot(
        ["_k"], list(columns), "colonne", "valeur"
    )
    return (
        long.where("valeur IS NOT NULL AND _k IS NOT NULL")
        .groupBy("_k", "colonne", "valeur")
        .agg(F.lit(1).alias("_"))
        .groupBy("_k", "colonne")
        .agg(F.count("*").alias("n"))
        .groupBy("colonne")
        .agg(F.max("n").alias("max_valeurs_par_cle"))
    )


# Request contract (field, low, high, mandatory); None means no numeric bound.
REQUEST_CONTRACT = (
    ("anciennete_mois", 0, 240, True),
    ("sieges_souscrits", 1, 10_000, True),
    ("utilisateurs_actifs", 0, 10_000, True),
    ("connexions_30j", 0, 10_000, True),
    ("fonctionnalites_total", 0, 500, True),
    ("fonctionnalites_utilisees", 0, 500, True),
    ("derniere_connexion_jours", 0, 3_650, True),
    ("tickets_support_90j", 0, 1_000, True),
    ("taille_entreprise", None, None, True),
    ("plan", None, None, True),
    ("taux_adoption_pct", 0, 100, False),
    ("heures_usage_30j", 0, 10_000, False),
    ("nb_integrations", 0, 100, False),
    ("delai_reponse_support_h", 0, 8_760, False),
    ("csat", 1, 5, False),
    ("retards_paiement_12m", 0, 120, False),
    ("revenu_mensuel_recurrent_eur", 0, 1_000_000, False),
    ("secteur", None, None, False),
    ("pays", None, None, False),
)
NULLABLE_FIELDS = tuple(name for name, _, _, required in REQUEST_CONTRACT if not required)
RECOMPUTED_FIELDS = ("taux_adoption_pct",)


def contract_nullability(df: DataFrame, contract: Sequence[tuple] = REQUEST_CONTRACT) -> DataFrame:
    """(champ, obligatoire, taux_manquants, conforme): a mandatory field must have no gap."""
    fields = [name for name, *_ in contract if name in df.columns]
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in fields])
    required = [name for name, _, _, mandatory in contract if mandatory]
    long = wide.unpivot([], fields, "champ", "taux_manquants")
    mandatory = F.col("champ").isin(*required)
    return long.select(
        "champ",
        mandatory.alias("obligatoire"),
        F.round("taux_manquants", 6).alias("taux_manquants"),
        (~mandatory | (F.col("taux_manquants") == 0)).alias("conforme"),
    )


def incomplete_share(df: DataFrame, contract: Sequence[tuple] = REQUEST_CONTRACT) -> DataFrame:
    """One row: share of rows with at least one field missing."""
    fields = [name for name, *_ in contract if name in df.columns]
    any_gap = F.lit(False)
    for c in fields:
        any_gap = any_gap | F.col(c).isNull()
    return df.agg(F.avg(any_gap.cast("int")).alias("part_incompletes"))


def validate_requests(df: DataFrame, contract: Sequence[tuple] = REQUEST_CONTRACT) -> DataFrame:
    """Adds `motifs` (array of reasons) and `valide`."""
    reasons = []
    for name, low, high, required in contract:
        c = F.col(name)
        if required:
            reasons.append(F.when(c.isNull(), F.lit(f"{name} manquant")))
        if low is not None:
            reasons.append(F.when((c < low) | (c > high), F.lit(f"{name} hors bornes")))
    checked = df.withColumn("motifs", F.array_compact(F.array(*reasons)))
    return checked.withColumn("valide", F.size("motifs") == 0)
