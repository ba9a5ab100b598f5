"""Many logistic models in shared passes: single fits, any partitioning, odd columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import many, ml

NUMERIC, LABELS, FOLDS = ["a", "b"], ["c"], ["f0", "f1"]


def made(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(20, 8), rng.expovariate(0.2), rng.choice(["Pro ", "pro", "basic", None, "rare" if i < 3 else "pro"])
        y = int(rng.random() < 1 / (1 + np.exp(-(0.1 * (a - 24) - 0.2 * b + (c == "basic")))))
        rows.append((i, y, a if rng.random() > 0.1 else None, b, c, i % 5, (i * 7 + i // 5) % 4))
    return spark.createDataFrame(rows, "k int, y int, a double, b double, c string, f0 int, f1 int")


@pytest.fixture(scope="module")
def rows(spark):
    return made(spark).cache()


def test_coefficients_equal_single_fits(rows):
    encoded = many.encode(rows, "y", "k", NUMERIC, LABELS, FOLDS)
    specs = [many.Spec(many.Part("f0", 2)), many.Spec(many.Part("f1", 3), c=0.05, balanced=False), many.Spec(many.Part(), c=30.0)]
    for model in many.fit(encoded, specs):
        train = rows.where(model.spec.part.holds())
        single = ml.fit_logistic(train, "y", NUMERIC, LABELS, c=model.spec.c, balanced=model.spec.balanced, max_iter=2_000, tol=1e-14)
        expected = dict(zip(single.names, single.coefficients, strict=True))
        got = dict(zip(encoded.names, model.coefficients.tolist(), strict=True))
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())
        assert all(abs(v) < 1e-12 for k, v in got.items() if k not in expected)
        assert model.intercept == pytest.approx(single.intercept, abs=1e-6) and model.steps < 15


def test_held_out_scores_equal_single_fits(rows):
    encoded = many.encode(rows, "y", "k", NUMERIC, LABELS, FOLDS)
    models = many.fit(encoded, many.fold_specs(["f1"], 4, name="x"))
    got = {(r.key): (r.pli, r.p) for r in many.held_out_scores(encoded, models).collect()}
    assert len(got) == rows.count()
    for fold in (0, 3):
        scorer = ml.fit_logistic(rows.where(F.col("f1") != fold), "y", NUMERIC, LABELS, max_iter=2_000, tol=1e-14)
        for r in scorer.score(rows.where(F.col("f1") == fold)).collect():
            assert got[r.k] == (fold, pytest.approx(r.p, abs=1e-7))


def test_same_models_under_any_partitioning(rows):
    specs = many.fold_specs(["f0"], 5)
    one = many.fit(many.encode(rows.coalesce(1), "y", "k", NUMERIC, LABELS, FOLDS), specs)
    other = many.fit(many.encode(rows.repartition(13), "y", "k", NUMERIC, LABELS, FOLDS), specs)
    for a, b in zip(one, other, strict=True):
        assert np.abs(a.coefficients - b.coefficients).max() < 1e-9


def test_columns_left_out_equal_a_fit_without_them(rows):
    specs = [many.Spec(many.Part(), without=frozenset({"b", "c"})), many.Spec(many.Part(), without=frozenset({"a"}))]
    without, no_a = many.fit(many.encode(rows, "y", "k", NUMERIC, LABELS, FOLDS), specs)
    (only,) = many.fit(many.encode(rows, "y", "k", ["a"], [], FOLDS), [many.Spec(many.Part())])
    assert without.coefficients[0] == pytest.approx(only.coefficients[0], abs=1e-9) and not without.coefficients[1:].any()
    assert no_a.coefficients[0] == 0 and no_a.coefficients[1] != 0


def test_odd_columns(spark, rows):
    odd = rows.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(3.0), "c": F.lit(None).cast("string")})
    (model,) = many.fit(many.encode(odd, "y", "k", NUMERIC, LABELS, FOLDS), [many.Spec(many.Part(), balanced=False)])
    assert not model.coefficients[:2].any()
    rate = rows.agg(F.avg("y")).first()[0]
    assert model.intercept + model.coefficients[2] == pytest.approx(np.log(rate / (1 - rate)), abs=1e-6)
    with pytest.raises(ValueError, match="both classes"):
        many.fit(many.encode(rows.where("y = 1"), "y", "k", NUMERIC, LABELS), [many.Spec(many.Part())])
    wide = rows.withColumn("c", F.concat(F.lit("v"), F.col("k")))
    with pytest.raises(ValueError, match="slots"):
        grown = wide.unionByName(wide.withColumn("c", F.concat("c", F.lit("w"))))
        many.encode(grown, "y", "k", NUMERIC, LABELS)


def test_a_separable_table_settles(spark):
    rows = spark.createDataFrame([(i, int(i > 50), float(i)) for i in range(100)], "k int, y int, a double")
    (model,) = many.fit(many.encode(rows, "y", "k", ["a"], []), [many.Spec(many.Part(), c=1e4)])
    assert model.coefficients[0] > 10
