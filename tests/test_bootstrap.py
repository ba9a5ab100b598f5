"""Bootstrap: equal to weights drawn row by row, with ties across slices, under any number of slices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import bootstrap


@pytest.fixture(scope="module")
def rows(spark):
    """Few distinct scores, one of them with half of the rows, beside many."""
    p = F.when(F.col("id") % 2 == 0, 0.5).when(F.col("id") % 5 == 0, (F.col("id") % 7) / 10.0).otherwise((F.col("id") * 37 % 199) / 199.0)
    y = F.when(F.col("id") % 29 == 0, F.lit(None)).otherwise((F.col("id") * 13 % 3 == 0).cast("int"))
    return spark.range(500).select("id", p.alias("p"), y.alias("y")).cache()


def brute(p, y, w, limit):
    order = np.argsort(-p, kind="stable")
    p, y, w = p[order], y[order], w[order]
    n, pos = w.sum(), (w * y).sum()
    roc = pr = upto_n = upto_pos = 0.0
    for s in dict.fromkeys(p.tolist()):
        own = p == s
        gn, gp = w[own].sum(), (w * y)[own].sum()
        upto_n, upto_pos = upto_n + gn, upto_pos + gp
        roc += (gn - gp) * (upto_pos - gp / 2)
        pr += gp * upto_pos / upto_n if upto_n else 0
    hit = p >= limit
    tp, flagged = (w * y * hit).sum(), (w * hit).sum()
    return pr / pos, roc / (pos * (n - pos)), (w * (y - p) ** 2).sum() / n, tp / pos, tp / flagged, flagged / n


@pytest.mark.parametrize("uniform", [bootstrap.hashed, bootstrap.portable])
@pytest.mark.parametrize(("slices", "block"), [(1, 1 << 20), (6, 1 << 20), (6, 100), (40, 7)])
def test_draws_equal_weights_row_by_row(spark, rows, slices, block, uniform):
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    got = {r.tirage: tuple(r)[1:] for r in bootstrap.bootstrap_draws(rows, 0.4, F.col("id"), draws=12, uniform=uniform, block=block).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", asked)
    known = [r for r in rows.collect() if r.y is not None]
    p, y, ids = (np.array([r[c] for r in known]) for c in ("p", "y", "id"))
    weights = np.searchsorted(bootstrap.POISSON, uniform(ids[:, None], np.arange(1, 13)[None, :]), side="right")
    assert got == {b + 1: pytest.approx(brute(p, y, weights[:, b], 0.4), abs=1e-9) for b in range(12)}


def test_weights_are_poisson():
    u = bootstrap.hashed(np.arange(20_000)[:, None] * 7, np.arange(1, 21)[None, :])
    w = np.searchsorted(bootstrap.POISSON, u, side="right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_intervals_hold_the_point_and_one_class_is_left_out(spark, rows):
    for r in bootstrap.bootstrap_metrics(rows, 0.4, "id", draws=200).collect():
        assert r.ic_bas <= r.valeur <= r.ic_haut
    assert bootstrap.bootstrap_draws(rows.where("y = 1"), 0.4, F.col("id"), draws=5).count() == 0
    assert bootstrap.bootstrap_draws(rows.where("id < 0"), 0.4, F.col("id"), draws=5).count() == 0
