from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tenura.functions import pvalues
from tenura.operators import drift, economics, explore, features, leakage, metrics, ml, primitives, quality


def test_select_under_capacity_skips_null_and_negative(spark):
    df = spark.createDataFrame([(0, 5.0), (1, -1.0), (2, None), (3, 50.0), (4, 10.0)], "id int, valeur_attendue double")
    assert [r.id for r in economics.select_under_capacity(df, 2).orderBy("rang").collect()] == [3, 4]
    assert [r.id for r in economics.select_under_capacity(df, 10).orderBy("rang").collect()] == [3, 4, 0]
    assert economics.select_under_capacity(df, 0).count() == 0


def test_prioritise_ranks_and_actions(spark):
    rows = [(0, 0.9, 50.0), (1, 0.5, 5000.0), (2, 0.01, 100.0), (3, 0.6, None)]
    got = economics.prioritise(spark.createDataFrame(rows, "id int, p double, mrr double")).orderBy("id").collect()
    assert [r.rang_priorite for r in got] == [2, 1, None, None]
    assert [r.action_cs for r in got] == ["Contacter", "Contacter", "Veille", "Veille"]


def test_threshold_for_recall(spark):
    rows = list(zip([1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.4, 0.3, 0.1], strict=True))
    row = metrics.threshold_for_recall(spark.createDataFrame(rows, "y int, p double"), 0.6).first()
    assert row.seuil == 0.7
    assert (round(row.precision, 6), row.part_signalee, row.n_faux_negatifs) == (round(2 / 3, 6), 0.5, 1)


def test_precision_at_k_edges(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.1)], "id int, y int, p double")
    assert [economics.precision_at_k(df, k).first()[0] for k in (0, 1, 99)] == [0.0, 1.0, 0.5]


def test_unknown_ranking_raises(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 10.0)], "id int, y int, p double, mrr double")
    with pytest.raises(ValueError):
        economics.gain_under_capacity(df, "hasard")


def test_alerts_fall_with_the_threshold(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") * 7 % 200 / 199.0).alias("p"),
        (F.col("id") % 90 + 10.0).alias("mrr"),
    )
    curve = economics.gain_by_threshold(df).orderBy("i").collect()
    alerts = [r.n_alertes for r in curve]
    assert len(curve) == 200 and alerts == sorted(alerts, reverse=True)
    for r in curve[:: 20]:
        assert r.n_alertes == df.where(F.col("p") >= r.seuil).count()


def test_holm_and_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.02)], "i int, p double")
    assert [round(r.a, 6) for r in primitives.holm(df, "p", "a").orderBy("i").collect()] == [0.04, 0.03, 0.04]
    assert [round(r.a, 6) for r in primitives.benjamini_hochberg(df, "p", "a").orderBy("i").collect()] == [0.04, 0.03, 0.03]


def test_group_aggregate_is_learned_on_train_only(spark):
    train = spark.createDataFrame([("A", 100.0), ("A", 200.0), ("B", 300.0), ("B", 400.0)], "s string, v double")
    test = spark.createDataFrame([("A", 1000.0), ("B", 4000.0), ("Z", 1.0), (None, 1.0)], "s string, v double")
    fitted = features.fit_group_aggregate(train, "s", "v")
    got = {r.s: r.m for r in features.apply_group_aggregate(test, fitted, "s", "m").collect()}
    assert got == {"A": 150.0, "B": 350.0, "Z": 250.0, None: 250.0}


@pytest.mark.parametrize(
    ("schema", "row", "rule"),
    [
        ("csat double", (6.0,), "csat hors [1, 5]"),
        ("churn int", (2,), "churn hors {0, 1}"),
        ("revenu_mensuel_recurrent_eur double", (-5.0,), "revenu_mensuel_recurrent_eur < 0"),
        ("fonctionnalites_utilisees int, fonctionnalites_total int", (12, 10), "fonctionnalites_utilisees > fonctionnalites_total"),
        ("connexions_30j int, derniere_connexion_jours int", (4, 45), "connexions_30j > 0 et derniere_connexion_jours > 30"),
        ("taux_adoption_pct double, utilisateurs_actifs int, sieges_souscrits int", (90.0, 5, 10), "taux_adoption_pct incoherent (ecart > 1 point)"),
    ],
)
def test_each_rule_is_triggered(spark, schema, row, rule):
    report = quality.impossible_values(spark.createDataFrame([row], schema)).where("violee").collect()
    assert [r.regle for r in report] == [rule]


def test_tenure_gaps(spark):
    import datetime

    day = datetime.date(2023, 1, 1)
    df = spark.createDataFrame([(day, m) for m in (12, 24, 6)], "date_souscription date, anciennete_mois int")
    reference = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "date_reference date")
    got = {r.ecart_mois: r.n for r in quality.tenure_gaps(df, reference).collect()}
    assert got == {-6: 1, 0: 1, 12: 1}


def test_assert_unique_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int")
    with pytest.raises(ValueError):
        quality.assert_unique_key(df, "id")
    quality.assert_unique_key(df.where("v = 1"), "id")


def test_missingness_mechanisms(spark):
    base = spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("churn"),
        (F.col("id") * 7919 % 997).cast("double").alias("mrr"),
        (F.col("id") * 6007 % 991).cast("double").alias("u"),
    )
    df = base.select(
        "churn", "mrr",
        F.when(F.col("churn") == 0, F.col("u")).alias("csat"),
        F.when(F.col("mrr") <= 700, F.col("u")).alias("score"),
        F.when(F.col("u") > 250, F.col("u")).alias("hasard"),
    )
    report = quality.missingness_report(df, "churn", ["mrr"], [])
    got = {r.colonne: r.mecanisme_propose for r in report.collect()}
    assert got == {"csat": "MNAR", "score": "MAR", "hasard": "MCAR"}


def test_leak_scan_flags_a_copy_of_the_target(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("churn"),
        (F.col("id") % 2 * 10 + F.col("id") % 3).alias("copie"),
        (F.col("id") * 37 % 101).alias("bruit"),
        F.when(F.col("id") % 2 == 1, "x").otherwise("y").alias("parfaite"),
        F.lit("z").alias("constante"),
    )
    got = {r.colonne: r.suspecte_fuite for r in leakage.leak_scan(df, "churn", ["copie", "bruit"], ["parfaite", "constante"]).collect()}
    assert got == {"copie": True, "bruit": False, "parfaite": True, "constante": False}


def test_lifetime_value_signatures(spark):
    base = spark.range(500).select(
        (F.col("id") * 7919 % 500 + 50.0).alias("revenu_mensuel_recurrent_eur"),
        (F.col("id") * 6007 % 60 + 1.0).alias("anciennete_mois"),
        (F.col("id") % 3 == 0).cast("int").alias("churn"),
        (F.col("id") * 104729 % 100 / 100.0).alias("u"),
    )
    m, t, u = F.col("revenu_mensuel_recurrent_eur"), F.col("anciennete_mois"), F.col("u")
    realised = base.withColumn("valeur_vie_client_eur", m * t * (0.8 + 0.19 * u))
    prospective = base.withColumn("valeur_vie_client_eur", m * (40 + 40 * u))
    assert leakage.lifetime_value_nature(realised).first()["nature_clv"] == "realisee"
    assert leakage.lifetime_value_nature(prospective).first()["nature_clv"] == "prospective"


def test_drift_of_a_table_with_itself_is_zero(spark):
    df = spark.range(200).select((F.col("id") * 37 % 101).cast("double").alias("v"))
    assert drift.psi(drift.psi_bins(df, df, ["v"])).first()["psi"] == 0.0
    row = drift.drift_audit(df, df.withColumn("v", F.col("v") + 80), ["v"]).first()
    assert row.alerte and row.n_hors_bornes > 0
    assert not drift.drift_overview(drift.drift_report(df, df, ["v"])).first()["derive_globale"]


def test_scenario_does_not_depend_on_partitioning(spark):
    df = spark.range(100).select("id", (F.col("id") + 0.0).alias("taux_adoption_pct"), F.col("id").alias("connexions_30j"))
    once = drift.scenario_transform(df, "adoption_chute", "id").orderBy("id").collect()
    again = drift.scenario_transform(df.repartition(7), "adoption_chute", "id").orderBy("id").collect()
    assert once == again
    with pytest.raises(ValueError):
        drift.scenario_transform(df, "inconnu", "id")


def test_p_values():
    assert abs(pvalues.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(pvalues.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(pvalues.chi2_sf(18.307038, 10) - 0.05) < 1e-6
    assert abs(pvalues.student_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(pvalues.kolmogorov_sf(1.358099) - 0.05) < 1e-5
    assert pvalues.wilcoxon_greater([1, 2, 3, 4, 5]) == 1 / 32
    assert math.isclose(pvalues.wilcoxon_greater([-1, -2, 3]), 0.625)


def test_longest_prefix_names_the_source_column():
    columns = ["plan", "plan_tarif", "csat"]
    assert ml.source_column("plan_tarif_pro", columns) == ("plan_tarif", "pro")
    assert ml.source_column("csat", columns) == ("csat", None)
    assert ml.source_column("autre", columns) == ("autre", None)


def test_contributions_add_up_to_the_logit(spark):
    df = spark.range(300).select(
        F.col("id"), (F.col("id") * 37 % 60).alias("derniere"), (1 + F.col("id") * 13 % 5).alias("csat"),
        F.when(F.col("id") % 3 == 0, "Starter").otherwise("Pro").alias("plan"),
    )
    signal = F.col("derniere") / 20 - F.col("csat") / 2 + F.when(F.col("plan") == "Starter", 1).otherwise(0)
    df = df.withColumn("y", (signal + F.col("id") * 29 % 7 / 4 > 1.2).cast("int"))
    scorer = ml.fit_logistic(df, "y", ["derniere", "csat"], ["plan"])
    x = ml.vector_to_array("features")
    parts = ml.linear_contributions(x, scorer.coefficients, scorer.means)
    raw = ml.vector_to_array("rawPrediction")[1]
    rows = scorer.features(df).select(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v).alias("s"), raw.alias("r")).collect()
    offsets = {round(r.r - r.s, 6) for r in rows}
    assert len(offsets) == 1
    scored = scorer.score(df).agg(F.avg("p").alias("p"), F.avg("y").alias("y")).first()
    assert abs(scored.p - scored.y) < 0.05
    unseen = df.limit(1).withColumn("plan", F.lit("Nouveau"))
    assert scorer.score(unseen).first()["p"] is not None


def test_denied_column_raises(spark):
    with pytest.raises(ValueError):
        features.model_columns(spark.createDataFrame([(1, 2)], "churn int, csat int"))


def test_hypothesis_verdicts(spark):
    df = spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("churn"),
        (50 - 15 * (F.col("id") % 2) + F.col("id") * 37 % 20).alias("usage"),
        (F.col("id") * 6007 % 97).alias("tickets"),
    )
    rows = explore.hypothesis_tests(df, "churn", [("A", "usage", "-"), ("B", "usage", "+"), ("C", "tickets", "+")], ())
    got = {r.id: r.verdict for r in rows.collect()}
    assert got == {"A": "confirmee", "B": "infirmee", "C": "non concluante"}


def test_correlations_far_from_zero(spark):
    from tenura.operators import explore, leakage

    base = spark.range(2_000).select(
        (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("e")
    )
    near = base.select("x", (F.col("x") + F.col("e")).alias("y"), F.col("e").cast("string").alias("g"))
    far = near.select(*[(F.col(c) + 1e9).alias(c) for c in ("x", "y")], "g")
    one, other = (explore.correlation_pairs(df, ["x", "y"]).first()["correlation"] for df in (near, far))
    assert abs(one - other) < 1e-9 and one > 0.9
    eta = [leakage.correlation_ratio(df, "g", "y").first()["eta"] for df in (near, far)]
    assert abs(eta[0] - eta[1]) < 1e-7


def test_manifest_digests_whole_files(spark, tmp_path):
    import hashlib

    from tenura.sources import files

    long_line = b"x" * 200_000
    cases = {
        "a.csv": b"a;b\r\n1;2\r\n", "b.csv": "\ufeffé,b\n1,2".encode(), "c.csv": "é|b|c\n".encode("latin-1"),
        "e.csv": b"one\n\n\nlast", "f.csv": b"\n".join([long_line] * 60) + b"\n",
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1_000_000)  # files in several splits
    try:
        rows = files.source_manifest(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.chemin.rsplit("/", 1)[1]: r for r in rows}
    for name, content in cases.items():
        assert (got[name].sha256, got[name].taille_octets) == (hashlib.sha256(content).hexdigest(), len(content))
    assert [got[n].nb_lignes for n in sorted(cases)] == [2, 2, 1, 4, 60]
    assert (got["a.csv"].separateur, got["a.csv"].nb_colonnes) == (";", 2)
    assert got["c.csv"].encodage == "latin-1" and got["b.csv"].encodage == "utf-8-sig"


def test_one_class_cannot_be_fitted(spark):
    from tenura.operators import ml

    df = spark.range(10).select(F.lit(0).alias("y"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="both classes"):
        ml.fit_logistic(df, "y", ["x"], [])


def test_account_sheets_name_variables_for_the_business(spark):
    from tenura.operators import ml

    row = spark.sql("SELECT struct(3 AS csat, CAST(NULL AS INT) AS plan) AS _row")
    labels = row.select(ml.factor_label("csat", "_row").alias("a"), ml.factor_label("plan", "_row").alias("b")).first()
    assert tuple(labels) == ("Satisfaction client (CSAT, sur 5) : 3", "Plan : non renseigné")


def test_rows_without_a_score_are_in_no_bin(spark):
    from tenura.operators import metrics

    df = spark.createDataFrame([(None, 1), (0.1, 0), (0.9, 1)], "p double, y int")
    assert metrics.calibration_curve(df, n_bins=2).agg(F.sum("n")).first()[0] == 2
