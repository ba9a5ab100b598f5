"""Forests and boosted trees grown together: Spark ML's boosted trees, keyed forests, shared passes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tenura.operators import many, metrics, search, trees

FOREST = {"arbres": 40, "profondeur": 4, "lignes_min": 2, "colonnes": "sqrt"}
BOOSTED = {"profondeur": 3, "pas": 0.2, "tours": 5, "lignes_min": 5, "part_lignes": 1.0, "part_colonnes": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    made = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.expovariate(1.0), rng.choice("xyz")
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * a - b + (c == "x")))))
        made.append((i, y, a if i % 11 else None, b, float(i % 7), c, i % 3))
    return spark.createDataFrame(made, "k int, y int, a double, b double, d double, c string, f0 int").cache()


def encoded(rows):
    return many.encode(rows, "y", "k", ["a", "b", "d"], ["c"], ["f0"])


def by_spark(enc, part, estimator):
    """What Spark ML's own fit of the same rows says of those left out."""
    scale = many.scales(enc, [part])[part]
    x = [F.when(F.isnan(F.col("x")[j]), F.lit(float(m))).otherwise(F.col("x")[j]) for j, m in enumerate(scale.median)]
    x += [(F.col("codes")[0] == k).cast("double") for k in range(enc.slots - enc.starts[0])]
    ready = enc.rows.withColumn("features", array_to_vector(F.array(*x)))
    scored = estimator.fit(ready.where(part.holds()).coalesce(1)).transform(ready.where(~part.holds()))
    return scored.select("key", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


@pytest.mark.parametrize("changes", [{}, {"lignes_min": 60, "profondeur": 2, "pas": 0.05}])
def test_boosted_trees_are_those_of_spark(rows, changes):
    estimator, part = search.estimator("arbres_boostes", BOOSTED | changes), many.Part("f0", 1)
    expected = {r.key: r.p for r in by_spark(encoded(rows), part, estimator).collect()}
    for df in (rows, rows.repartition(5)):
        got = {r.key: r.p for r in search.tree_scores(encoded(df), [search.Job("t", part, estimator)]).collect()}
        assert set(got) == set(expected) and all(got[k] == pytest.approx(p, abs=1e-9) for k, p in expected.items())


@pytest.mark.parametrize("changes", [{}, {"colonnes": "log2", "profondeur": 6, "lignes_min": 8}])
def test_forests_do_not_depend_on_partitioning_and_score_as_those_of_spark(rows, changes):
    estimator, part = search.estimator("foret", FOREST | changes), many.Part("f0", 0)
    one, other = (search.tree_scores(encoded(df), [search.Job("t", part, estimator)]).select("key", "y", "p") for df in (rows.coalesce(1), rows.repartition(6)))
    got = {r.key: r.p for r in one.collect()}
    assert got == {r.key: pytest.approx(r.p, abs=1e-12) for r in other.collect()}
    expected = by_spark(encoded(rows), part, estimator).cache()
    ours, theirs = metrics.metrics_at(one.select("y", "p"), 0.5).first(), metrics.metrics_at(expected.select("y", "p"), 0.5).first()
    assert ours.roc_auc == pytest.approx(theirs.roc_auc, abs=0.02) and ours.brier == pytest.approx(theirs.brier, abs=0.01)
    pairs = np.array([(got[r.key], r.p) for r in expected.collect()])
    assert np.corrcoef(pairs.T)[0, 1] > 0.97


@pytest.mark.parametrize(("family", "parameters"), [("foret", FOREST | {"arbres": 5}), ("arbres_boostes", BOOSTED | {"tours": 3})])
def test_more_fits_take_no_more_jobs(spark, rows, family, parameters):
    enc, jobs = encoded(rows), []
    many.scales(enc, [many.Part("f0", i) for i in range(3)])
    for n in (1, 3):
        spark.sparkContext.setJobGroup(f"{family}-{n}", "")
        search.tree_scores(enc, [search.Job(str(i), many.Part("f0", i), search.estimator(family, parameters)) for i in range(n)])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{family}-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] == jobs[0]


def test_groups_are_of_one_kind_and_hold_every_fit(monkeypatch):
    make = lambda family, p: trees.asked(many.Part("f0", 0), search.estimator(family, p), 6)
    fits = [make("foret", FOREST | {"profondeur": d}) for d in (3, 9, 5)] + [make("arbres_boostes", BOOSTED)]
    monkeypatch.setattr(search, "NODES", fits[1].nodes)
    assert search._groups(fits) == [[3], [1], [2, 0]]


def test_alike_leaves_merge_upwards():
    grown = trees.Trees(trees.asked(many.Part(), search.estimator("foret", FOREST | {"arbres": 1, "profondeur": 2}), 4))
    grown.cut[0, [1, 2, 3]] = 4
    counts = np.zeros((1, 8, 2))
    counts[0, [4, 5, 6, 7]] = [[9, 1], [6, 4], [5, 5], [1, 9]]  # a tie says the first class
    trees._merge_alike(grown, counts)
    assert (grown.cut[0, 1:4] == [4, trees.NOWHERE, 4]).all()


def test_borders_are_midpoints_and_about_equal_counts():
    assert trees.borders(np.array([1.0, 1.0, 4.0, 2.0]), 31).tolist() == [1.5, 3.0]
    assert trees.borders(np.zeros(5), 31).tolist() == []
    assert trees.borders(np.arange(100.0), 3).tolist() == [24.5, 49.5, 74.5]


def test_rows_without_keys_and_rows_that_come_twice(spark, rows):
    odd = rows.unionByName(rows).withColumn("k", F.when(F.col("k") % 3 > 0, F.lit(None).cast("int")).otherwise(F.col("k")))
    jobs = [search.Job(f, many.Part("f0", 2), search.estimator(f, p)) for f, p in (("foret", FOREST), ("arbres_boostes", BOOSTED))]
    got = search.tree_scores(encoded(odd), jobs)
    assert got.count() == 2 * odd.where("f0 = 2").count() and got.where("p IS NULL OR p < 0 OR p > 1").count() == 0
    assert got.where("p BETWEEN 0.4 AND 0.6").count() < got.count() / 2


def test_the_trials_of_a_rung_grow_together(rows, monkeypatch):
    sizes, real = [], trees.scores
    monkeypatch.setattr(trees, "scores", lambda enc, names, *args: sizes.append(len(names)) or real(enc, names, *args))
    draw = lambda family, trial, seed: FOREST | {"arbres": 3, "profondeur": 1 + trial}
    got = search.random_search(rows, "y", "k", ["a", "b", "d"], ["c"], "f0", families=("foret",), schedule=((4, 1), (2, 3)), draw=draw).collect()
    assert sizes == [4, 4] and sorted(r.n_plis for r in got) == [1, 1, 3, 3]  # 4 trials on a fold, then 2 on two more
