"""Plan shapes and the SQL twins."""

from __future__ import annotations

import os

import oracle
import pytest
from conftest import SF_CHECK, SF_SMALL

from tenura.queries.catalogue import ORACLES, QUERIES

# TENURA_CHECK=full compares the twins at sf0.01, the default run at sf0.001.
FULL = os.environ.get("TENURA_CHECK") == "full"
FOLDER = SF_CHECK if FULL else SF_SMALL
TWINS = [n for n in QUERIES if n in ORACLES]


@pytest.fixture(scope="session")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_twin(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == []


@pytest.mark.parametrize(
    "name", ["prioritise", "build_gold", "leak_scan", "fairness_by_group", "drift_report", "request_features"]
)
def test_no_python_rows_and_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_reference_tables_are_broadcast(spark):
    plan = QUERIES["request_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3


def test_scans_are_pruned(spark):
    from tenura.sources import files

    scanned = files.scan_parquet_or_csv(spark, f"{FOLDER}/customer.parquet")
    wanted = scanned.select("c_custkey", "c_mktsegment", "c_acctbal").where("c_acctbal > 0")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in plan
    assert "c_name" not in plan


def test_publishing_is_idempotent(spark):
    from tenura.sources import files

    path = files.scratch(spark, "publish")
    first = spark.range(3)
    assert files.publish_scores(first, path, "2024-01-01")
    assert not files.publish_scores(spark.range(9), path, "2024-01-01")
    assert files.publish_scores(spark.range(5), path, "2024-01-02")
    assert spark.read.parquet(path).count() == 8
    assert files.publish_scores(spark.range(1), path, "2024-01-01", force=True)
    assert spark.read.parquet(path).count() == 6
