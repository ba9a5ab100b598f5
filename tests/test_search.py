"""Comparison and random search: shared folds, keyed draws, successive elimination."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions import maths
from tenura.operators import many, metrics, ml, search, splits
from tenura.plans import scoring
from tenura.sources import files

NUMERIC, LABELS = ["a", "b"], ["c"]
SMALL_TREES = {
    "foret": {"arbres": 6, "profondeur": 3, "lignes_min": 2, "colonnes": "sqrt"},
    "arbres_boostes": {"profondeur": 2, "pas": 0.2, "tours": 3, "lignes_min": 2, "part_lignes": 1.0, "part_colonnes": 1.0},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(500):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("xyz")
        made.append((i, int(rng.random() < 1 / (1 + np.exp(-(2 * a - b + (c == "x"))))), a if i % 11 else None, b, c, i % 3, (i // 3) % 3))
    return spark.createDataFrame(made, "k int, y int, a double, b double, c string, f0 int, f1 int").cache()


def test_fold_metrics_equal_one_fold_at_a_time(rows):
    got = search.cross_validate_logistic(rows, "y", "k", NUMERIC, LABELS, ["f0", "f1"], 3).collect()
    assert sorted((r.repetition, r.pli) for r in got) == [(r, i) for r in range(2) for i in range(3)]
    row = next(r for r in got if (r.repetition, r.pli) == (1, 2))
    scorer = ml.fit_logistic(rows.where("f1 <> 2"), "y", NUMERIC, LABELS, max_iter=2_000, tol=1e-14)
    single = metrics.metrics_at(scorer.score(rows.where("f1 = 2")), 0.5).first()
    for c in ("pr_auc", "roc_auc", "rappel", "precision", "brier"):
        assert row[c] == pytest.approx(single[c], abs=1e-9)


def test_candidates_share_folds_and_learn(rows):
    plain = {"hasard": (F.col("k") * 7919 % 101) / 101.0, "regle": (F.col("a") > 0).cast("double")}
    scores = search.compare_models(rows, "y", "k", NUMERIC, LABELS, ["f0"], plain, 3, parameters=SMALL_TREES).collect()
    by = {m: np.mean([r.pr_auc for r in scores if r.modele == m]) for m in {r.modele for r in scores}}
    assert len(scores) == 15 and set(by) == {"hasard", "regle", "logistique", "foret", "arbres_boostes"}
    assert by["logistique"] > by["hasard"] + 0.2 and by["foret"] > by["hasard"] + 0.1 and by["arbres_boostes"] > by["hasard"] + 0.1


def test_tree_scores_cover_what_the_part_leaves_out(rows):
    encoded = many.encode(rows, "y", "k", NUMERIC, LABELS, ["f0"])
    jobs = [search.Job(f"t{i}", many.Part("f0", i), search.estimator("foret", SMALL_TREES["foret"])) for i in (2, 0)]
    got = search.tree_scores(encoded, jobs, threads=2).collect()
    assert {(r.modele, r.pli) for r in got} == {("t2", 2), ("t0", 0)}
    assert sorted(r.key for r in got) == [r.k for r in rows.where("f0 <> 1").orderBy("k").collect()]


def test_draws_stay_in_their_space_and_repeat():
    for family in search.SPACES:
        assert search.drawn(family, 0) == search.DEFAULTS[family]
        trials = [search.drawn(family, t) for t in range(1, 200)]
        assert trials == [search.drawn(family, t) for t in range(1, 200)]
        for name, (kind, *bounds) in search.SPACES[family].items():
            values = [t[name] for t in trials]
            if kind == "choice":
                assert set(values) == set(bounds)
            else:
                assert bounds[0] <= min(values) < max(values) <= bounds[1]
                assert kind != "step" or all((v - bounds[0]) % bounds[2] == 0 for v in values)
    assert search.drawn("foret", 3, 1) != search.drawn("foret", 3, 2)


SCHEDULE = ((6, 1), (3, 2), (2, 3))


def quick(family, trial, seed):
    return search.drawn(family, trial, seed) if family == "logistique" else SMALL_TREES[family] | {"profondeur": 1 + trial % 3}


def test_search_gives_every_trial_and_equal_budgets(rows):
    run = lambda df: search.random_search(df, "y", "k", NUMERIC, LABELS, "f0", schedule=SCHEDULE, draw=quick).collect()
    got = run(rows)
    for family in ("logistique", "arbres_boostes"):
        own = [r for r in got if r.famille == family]
        assert [r.essai for r in own] == list(range(6)) and sorted(r.n_plis for r in own) == [1, 1, 1, 2, 3, 3]
        assert own[0].par_defaut and own[0].n_plis == 3 and sum(r.meilleur for r in own) == 1
        best = next(r for r in own if r.meilleur)
        assert best.pr_auc_moyenne == max(r.pr_auc_moyenne for r in own if r.n_plis == 3)
        assert json.loads(own[2].parametres) == quick(family, 2, 42)
    again = {(r.famille, r.essai): (r.n_plis, round(r.pr_auc_moyenne, 6)) for r in run(rows.repartition(11)) if r.famille == "logistique"}
    assert again == {(r.famille, r.essai): (r.n_plis, round(r.pr_auc_moyenne, 6)) for r in got if r.famille == "logistique"}
    with pytest.raises(ValueError):
        search.random_search(rows, "y", "k", NUMERIC, LABELS, "f0", schedule=((3, 2), (6, 3)))


def test_drop_test_and_leak_experiment_equal_refits(rows):
    split = rows.withColumn("part", F.when(F.col("k") % 4 == 0, "test").otherwise("train")).withColumn("noise", (F.col("k") * 31 % 17).cast("double"))
    split = split.withColumn("copy", F.col("y") + (F.col("k") % 3) / 10.0)
    got = {r.colonne: r for r in search.drop_column_importance(split, "y", "k", ["a", "b", "noise"], LABELS).collect()}
    assert set(got) == {"a", "b", "c", "noise"} and got["noise"].negligeable and not got["a"].negligeable
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    scorer = ml.fit_logistic(train, "y", ["b", "noise"], LABELS, max_iter=2_000, tol=1e-14)
    single = metrics.metrics_at(scorer.score(test), 0.5).first()
    assert got["a"].pr_auc == pytest.approx(single.pr_auc, abs=1e-9)
    leak = search.leak_experiment(split, "y", "k", NUMERIC, "copy").first()
    assert leak.roc_auc_avec > 0.99 and leak.delta_roc_auc == pytest.approx(leak.roc_auc_avec - leak.roc_auc_sans)


def test_imbalance_arms(rows):
    few = rows.where("y = 0 OR k % 4 = 0")
    got = {r.approche: r for r in search.imbalance_comparison(few, "y", "k", NUMERIC, LABELS, "f0", 3).collect()}
    assert set(got) == {"ponderee", "ponderee_corrigee", "replication"}
    assert abs(got["ponderee_corrigee"].ecart_calibration) < 0.05 < got["ponderee"].ecart_calibration
    assert got["replication"].ecart_calibration > 0.05
    assert got["ponderee"].pr_auc == pytest.approx(got["ponderee_corrigee"].pr_auc, abs=0.02)  # the shift differs from fold to fold


def test_a_stored_model_scores_as_the_fitted_one(spark, rows):
    df = rows.select("k", "y", "a", "b", "c")
    scorer, report = scoring.retrain(df, "y", "k", least=0.5)
    path = files.scratch(spark, "stored")
    scoring.save_model(scorer, report, path)
    loaded, watch = scoring.load_model(spark, path)
    assert watch == report.first()["seuil"] and loaded.names == scorer.names and loaded.means == scorer.means
    fitted = {r.k: r.p for r in scorer.score(df).collect()}
    assert {r.k: r.p for r in loaded.score(df).collect()} == fitted
    reasons = lambda s: {r.k: r.facteurs for r in s.score_and_explain(df).collect()}
    assert reasons(loaded) == reasons(scorer)
    with pytest.raises(ValueError, match="absent"):
        scoring.check_contract(df.drop("a"), loaded)
    with pytest.raises(ValueError, match="text"):
        scoring.check_contract(df.withColumn("a", F.col("a").cast("string")), loaded)


def test_the_gate_refuses_a_weak_model(spark, rows):
    scorer, report = scoring.retrain(rows.select("k", "y", "a", "b", "c"), "y", "k", champion_pr_auc=1.5)
    assert not report.first()["promu"]
    path = files.scratch(spark, "refused")
    with pytest.raises(ValueError, match="gate"):
        scoring.save_model(scorer, report, path)
    with pytest.raises(Exception):  # noqa: B017 - nothing was stored
        scoring.load_model(spark, path)


def test_permutation_importance_pairs_two_keyed_orders_in_a_plan_of_one_size(rows, spark):
    df = rows.select("k", "y", "a", "b", "c")
    score = lambda d: d.withColumn("p", 1 / (1 + F.exp(F.col("b") - 2 * F.coalesce("a", F.lit(0.0)))))
    sizes = []
    for repeats in (2, 9):
        out = ml.permutation_importance(df, score, "y", "k", ["a", "b", "c"], repeats, seed=3)
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("Window"))
    assert sizes[0] == sizes[1]
    got = {r.variable: r for r in ml.permutation_importance(df, score, "y", "k", ["a", "b", "c"], 3, seed=3).collect()}
    draws = [maths.uniform(F.col("k"), 3 + i).alias(f"d{i}") for i in range(6)]
    given = df.select("*", *draws).collect()

    def precision(values):
        scored = sorted(((1 / (1 + np.exp(b - 2 * (a or 0.0))), y) for a, b, y in values), reverse=True)
        hits = np.cumsum([y for _, y in scored])
        return sum(hits[i] / (i + 1) for i, (_, y) in enumerate(scored) if y) / hits[-1]

    base = precision([(r.a, r.b, r.y) for r in given])
    for column in ("a", "b", "c"):
        drops = []
        for r in range(3):
            here, there = (sorted(given, key=lambda x: x[f"d{2 * r + i}"]) for i in (0, 1))
            swapped = [(o.a if column == "a" else x.a, o.b if column == "b" else x.b, x.y) for x, o in zip(here, there)]
            drops.append(base - precision(swapped))
        assert got[column].importance == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[column].ecart_type == pytest.approx(np.std(drops, ddof=1), abs=1e-9)


def test_retraining_encodes_written_folds(rows, monkeypatch):
    plans, real = [], many.encode
    monkeypatch.setattr(many, "encode", lambda df, *args: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *args))
    _, report = scoring.retrain(rows.select("k", "y", "a", "b", "c"), "y", "k", least=0.0)
    assert report.first().promu and plans and "Window" not in plans[0] and "Relation" in plans[0]


def test_repetitions_rank_written_rows_in_plans_of_one_size(rows):
    df, sizes = rows.select("k", "y", "a"), []
    for repeats in (1, 3):
        out = splits.repeated_stratified_folds(df, "y", "k", 4, repeats, seed=9)
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("Window"))
    assert sizes[0] == sizes[1]
    given = df.select("*", *[maths.uniform(F.col("k"), 9 + r).alias(f"d{r}") for r in range(3)]).collect()
    got = {x.k: x for x in out.collect()}
    assert len(got) == 500 and all((x.y, x.a) == (got[x.k].y, got[x.k].a) for x in given)
    for r in range(3):
        for y in (0, 1):
            placed = sorted((x[f"d{r}"], x.k) for x in given if x.y == y)
            assert [got[k][f"pli_{r}"] for _, k in placed] == [i % 4 for i in range(len(placed))]


def test_fits_and_scores_of_the_same_parts_share_their_preprocessing(rows, monkeypatch):
    passes, real = [], many._summed
    monkeypatch.setattr(many, "_summed", lambda rows, partial: passes.append(partial.__qualname__) or real(rows, partial))
    encoded = many.encode(rows, "y", "k", NUMERIC, LABELS, ["f0"])
    specs = many.fold_specs(["f0"], 3)
    many.held_out_scores(encoded, many.fit(encoded, specs)).collect()
    assert sum("scales" in name for name in passes) == 1
    whole = many.scales(encoded, [many.Part("f0", 1), many.Part()])  # a part met before and a new one
    assert sum("scales" in name for name in passes) == 2 and set(whole) == {many.Part("f0", 1), many.Part()}
    assert whole[many.Part()].n == 500 and whole[many.Part("f0", 1)].n == rows.where("f0 <> 1").count()
