"""The ordered plan must give the same in one slice and in many, hot values included, and what plain windows give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tenura.functions import sizing
from tenura.operators import drift, economics, explore, metrics, ordering, primitives

SLICES = (1, 7, 40)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    v = F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 37 % 101)
    return spark.range(400).select(
        F.col("id"),
        v.cast("double").alias("v"),
        (F.col("id") % 4).alias("g"),
        (F.col("id") * 13 % 5 == 0).cast("int").alias("y"),
        (F.col("id") * 17 % 31 / 31.0).alias("p"),
        (F.col("id") * 7 % 50 + 100.0).alias("mrr"),
    )


@pytest.fixture
def both(spark, monkeypatch):
    """Rows of a result under several numbers of slices; with many, top-k takes the plan for a large k."""
    asked = spark.conf.get("spark.sql.shuffle.partitions")

    def run(build, keys):
        out = []
        for slices in SLICES:
            spark.conf.set("spark.sql.shuffle.partitions", slices)
            monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3 if slices == SLICES[-1] else 100_000)
            rows = [tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in build().collect()]
            out.append(sorted(rows, key=str))
        assert all(rows == out[0] for rows in out)
        assert len(out[0]) >= keys
        return out[0]

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", asked)


def test_quantiles(skewed, both):
    rows = both(lambda: ordering.quantiles(skewed, "v", [0, 0.1, 0.5, 0.73, 1], ["g"]), 4)
    assert len(rows) == 4


def test_quantiles_match_linear_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert list(ordering.quantiles(df, "v", [0.25, 0.5, 0.75]).first()["q"]) == [1.75, 2.5, 4.75]


def test_row_ranks(skewed, both):
    both(lambda: ordering.row_ranks(skewed, ["v", "id"], descending=["v"]), 400)


def test_top_k(skewed, both):
    both(lambda: ordering.top_k(skewed, ["v", "id"], 50, ["v"]).select("id", "rang"), 50)


def test_rank_statistics(skewed, both):
    both(lambda: primitives.rank_statistics(skewed, "v", "y", ["g"]), 4)


def test_curves(skewed, both):
    both(lambda: metrics.areas(metrics.score_table(skewed)), 1)
    both(lambda: metrics.threshold_for_recall(skewed, 0.6), 1)
    both(lambda: economics.lift_curve(skewed.withColumn("id", F.col("id"))), 400)


def test_drift(skewed, both):
    other = skewed.withColumn("v", F.col("v") * 1.2)
    both(lambda: drift.drift_report(skewed, other, ["v", "mrr"]), 2)
    both(lambda: drift.psi_bins(skewed, other, ["v"]), 10)


def test_spearman(skewed, both):
    both(lambda: explore.spearman_pairs(skewed, [("v", "mrr")]), 1)


def plain_totals(rows, order, keys):
    out, sums = {}, {}
    for r in sorted(rows, key=order):
        k = tuple(r[c] for c in keys)
        sums[k] = sums.get(k, 0) + 1
        out[r["id"]] = sums[k]
    return out


def test_ranks_equal_a_sort(spark):
    """Nulls, NaN, negative and equal values, every type that is sorted downwards; a key with a third of the rows."""
    made = spark.range(300).selectExpr(
        "id", "IF(id % 3 = 0, 'hot', concat('k', id % 7)) AS k",
        "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') ELSE (id * 31 % 23) - 11.5D END AS d",
        "IF(id % 13 = 0, NULL, (id * 7 % 29) * 300000000000000000 - 4000000000000000000) AS n",
        "IF(id % 11 = 0, NULL, date_add(date'2024-01-01', CAST(id % 9 AS INT))) AS t", "id % 2 = 0 AS b",
        "CAST(id % 5 AS DECIMAL(10,2)) AS m", "timestamp_micros(id * 1000003 % 77) AS ts", "concat('s', id % 6) AS s",
    )
    rows = made.collect()

    def key_of(c, down):
        def key(r):
            v = r[c]
            if v is None:
                return (1 if down else 0, 0)
            v = v.timestamp() if c == "ts" else v.toordinal() if c == "t" else v
            nan = v != v
            if down:
                return (0, 0 if nan else 1, 0 if nan else -v)
            return (1, 1 if nan else 0, 0 if nan else v)

        return key

    for c in ("d", "n", "t", "b", "m", "ts"):
        for down in (True, False):
            part = key_of(c, down)
            expected = plain_totals(rows, lambda r: (part(r), r["id"]), ["k"])
            got = ordering.row_ranks(made, [c, "id"], keys=["k"], descending=[c] if down else []).select("id", "rang").collect()
            assert {r.id: r.rang for r in got} == expected, (c, down)
    with pytest.raises(TypeError):
        ordering.row_ranks(made, ["s", "id"], descending=["s"])


def test_every_slice_gets_rows_and_one_exchange_carries_them(spark, skewed):
    sliced = ordering.sliced(skewed, ["v", "id"], [])
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 4 * sum(sizes) / len(sizes)
    empty = skewed.where("id < 0")
    assert ordering.row_ranks(empty, ["v", "id"]).count() == 0
    assert ordering.quantiles(empty, "v", [0.5]).collect() == []
