from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tenura.queries.service import prediction_events
from tenura.sources import files
from tenura.sources.tables import SCHEMAS, table
from tenura.streaming import monitoring

from conftest import SF_SMALL


def test_closed_windows_equal_the_batch(spark):
    stream = prediction_events(monitoring.read_events(spark, SF_SMALL, SCHEMAS["events"]))
    path = files.scratch(spark, "test-rates")
    got = monitoring.run_to_table(monitoring.decision_rates(stream), path, "append")
    batch = monitoring.decision_rates(prediction_events(table(spark, SF_SMALL, "events")))
    last = batch.agg(F.max("fin")).first()[0]
    closed = batch.where(F.col("fin") < last - datetime.timedelta(minutes=20))
    assert closed.exceptAll(got).count() == 0
    assert got.exceptAll(batch).count() == 0


def test_late_rows_are_dropped(spark):
    folder = files.scratch(spark, "late")
    schema = "ts timestamp_ntz, decision string"
    base = datetime.datetime(2024, 1, 1, 12, 0)
    minutes = lambda *m: [(base + datetime.timedelta(minutes=x), "OK") for x in m]
    target = files.scratch(spark, "late-out")
    for rows in (minutes(0, 60), minutes(1), minutes(120), minutes(121, 180)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = monitoring.request_rates(spark.readStream.schema(schema).parquet(folder))
        out = monitoring.run_to_table(stream, target, "append")
    starts = {r.debut for r in out.collect()}
    assert base in starts
    # the row of minute 1 came after the watermark had passed it
    assert base + datetime.timedelta(minutes=1) not in starts


def test_streaming_alerts_are_a_part_of_the_batch_ones(spark):
    events = prediction_events(table(spark, SF_SMALL, "events"))
    ticks = monitoring.mean_latency_ticks(events, "decision")
    batch = {(r.service, r.fin) for r in monitoring.sustained_alerts(ticks, 40.0).collect()}
    folder = files.scratch(spark, "ticks")
    ticks.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(ticks.schema).parquet(folder)
    out = monitoring.run_to_table(
        monitoring.sustained_alerts_stream(stream, 40.0), files.scratch(spark, "alerts"), "append"
    )
    assert {(r.service, r.fin.replace(tzinfo=None)) for r in out.collect()} == batch


def test_silences_cross_midnight(spark):
    t = datetime.datetime(2024, 1, 1, 23, 50)
    rows = [(t,), (t + datetime.timedelta(minutes=30),), (t + datetime.timedelta(minutes=30, seconds=20),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = monitoring.silences(df, 60).collect()
    assert [(r.depuis, r.duree_s) for r in got] == [(t, 1800.0)]


START = datetime.datetime(2024, 1, 1, 12, 0)


def at(*seconds):
    return [(START + datetime.timedelta(seconds=x),) for x in seconds]


def test_silences_of_a_stream_with_late_rows(spark):
    """Several batches, rows out of order and late: closed silences equal the batch ones, alerts come by the timer."""
    folder, target = files.scratch(spark, "silent"), files.scratch(spark, "silent-out")
    batches = [
        at(0, 30, 400),  # a silence from 30 to 400 as it seems
        at(200, 900),  # a late row that counts: now 30-200, 200-400, 400-900
        at(950, 2_000),  # 950-2000 open
        at(100),  # too late: its minute is closed
        at(2_010, 5_000),
        at(5_010, 9_000),
    ]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)
        stream = monitoring.silences_stream(spark.readStream.schema("ts timestamp_ntz").parquet(folder), 120)
        out = monitoring.run_to_table(stream, target, "append")
    rows = out.collect()
    off = lambda t: (t.replace(tzinfo=None) - START).total_seconds()
    ended = sorted((off(r.depuis), off(r.jusqu_a)) for r in rows if r.jusqu_a is not None)
    seen = spark.createDataFrame([r for b in batches for r in b if b != at(100)], "ts timestamp_ntz")
    batch = sorted((off(r.depuis), off(r.jusqu_a)) for r in monitoring.silences(seen, 120).collect())
    closed = [g for g in batch if g[1] < 9_000 - 600 - 60]
    assert ended == closed and (200.0, 400.0) in ended and (950.0, 2_000.0) in ended and (2_010.0, 5_000.0) in ended
    alerts = sorted(off(r.depuis) for r in rows if r.jusqu_a is None)
    assert 5_010.0 in alerts and set(alerts) <= {g[0] for g in batch}


def test_sketches_of_ticks_merge_within_the_stated_error(spark):
    rows = spark.range(60_000).selectExpr(
        "CAST(timestamp_seconds(1704110400 + id % 700) AS TIMESTAMP_NTZ) AS ts", "IF(id % 97 = 0, NULL, pow(CAST(id * 7919 % 60000 AS DOUBLE), 1.5)) AS latence"
    )
    checked = monitoring.within_rank_error(monitoring.latency_quantiles(rows), rows).collect()
    assert len(checked) > 30 and all(r.dans_erreur for r in checked)
    wrong = monitoring.latency_quantiles(rows).withColumn("p95", F.col("p50"))
    assert not any(r.dans_erreur for r in monitoring.within_rank_error(wrong, rows).collect())
    ticks = monitoring.latency_sketches(rows)
    assert ticks.count() == 24  # one state a tick, not ten a row


def test_a_replayed_batch_changes_nothing(spark):
    folder = files.scratch(spark, "publish")
    source = f"{folder}/in"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source).withColumn("p", F.col("id") / 100)
        out = monitoring.publish_stream(stream, folder)
    assert sorted(r.id for r in out.collect()) == list(range(30))
    again = spark.range(20, 30).withColumn("p", F.col("id") / 100)  # as after a crash between write and commit
    monitoring.publish_batch(again, f"{folder}/table", 2)
    assert sorted(tuple(r) for r in monitoring.published(spark, f"{folder}/table", out.schema).collect()) == [(i, i / 100) for i in range(30)]


def test_exact_latency_quantiles_share_events_between_windows(spark, monkeypatch):
    rows = spark.range(5_000).selectExpr(
        "IF(id % 501 = 0, NULL, CAST(timestamp_micros(1704110395000000 + id * id % 9000 * 1000000 - IF(id = 7, 1800000000000000, 0)) AS TIMESTAMP_NTZ)) AS ts",
        "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 83 = 0 THEN -0D ELSE CAST(id * 7919 % 601 AS DOUBLE) / 7 END AS latence",
    ).cache()
    assert monitoring._dealt(rows, "latence").count() < 1.3 * rows.count()  # not once for each of ten windows
    given = {}
    for r in rows.where("ts IS NOT NULL").collect():
        tick = math.floor((r.ts - datetime.datetime(1970, 1, 1)).total_seconds() / 30)
        for start in range(tick - 9, tick + 1):
            given.setdefault(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=30 * start), []).append(r.latence)
    expected = {}
    for start, all_values in given.items():
        values = sorted((v + 0.0 for v in all_values if v is not None), key=lambda v: (math.isnan(v), v))
        if values:
            places = [p * (len(values) - 1) for p in (0.5, 0.95, 0.99)]
            ends = [(values[math.floor(x)], values[math.ceil(x)], x - math.floor(x)) for x in places]
            expected[start] = (len(all_values), [a + (b - a) * f if f > 0 else a for a, b, f in ends])
    for limit in (1 << 20, 0, 80):  # in blocks, in ordered slices, and both
        monkeypatch.setattr(monitoring, "BLOCK_ROWS", limit)
        got = {r.debut: r for r in monitoring.latency_quantiles_exact(rows).collect()}
        assert got.keys() == expected.keys()
        for start, (n, q) in expected.items():
            r = got[start]
            assert r.n == n and r.fin - r.debut == datetime.timedelta(minutes=5)
            assert [r.p50, r.p95, r.p99] == pytest.approx(q, nan_ok=True)
