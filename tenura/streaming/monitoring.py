"""Service monitoring over prediction events.

Every function is written once and takes a batch or a streaming frame with an event time
`ts`; the watermark does nothing in batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.operators.ordering import quantiles

WATERMARK = "10 minutes"
TICK_SECONDS = 30


def _timed(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _bounds() -> list[Column]:
    return [
        F.col("window.start").cast("timestamp_ntz").alias("debut"),
        F.col("window.end").cast("timestamp_ntz").alias("fin"),
    ]


def _windowed(
    events: DataFrame, seconds: int, keys: list[str], sums: dict[str, Column]
) -> DataFrame:
    """(window, keys, sums) over windows of `seconds` every tick.

    In batch, events are added up by tick first and only these sums are spread over the windows
    around them. A stream keeps one state per open window; the watermark drops closed ones.
    """
    length, tick = f"{seconds} seconds", f"{TICK_SECONDS} seconds"
    if events.isStreaming:
        grouped = _timed(events).groupBy(F.window("ts", length, tick), *keys)
        return grouped.agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ticks = timed.groupBy(F.window("ts", tick).alias("_tick"), *keys).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    starts = F.array(*[
        F.col("_tick.start") - F.make_dt_interval(secs=F.lit(i * TICK_SECONDS))
        for i in range(seconds // TICK_SECONDS)
    ])
    spread = ticks.select(F.explode(starts).alias("_start"), *keys, *sums)
    ended = F.col("_start") + F.make_dt_interval(secs=F.lit(seconds))
    grouped = spread.groupBy("_start", *keys).agg(*[F.sum(n).alias(n) for n in sums])
    window = F.struct(F.col("_start").alias("start"), ended.alias("end")).alias("window")
    return grouped.select(window, *keys, *sums)


def decision_rates(events: DataFrame, decision: str = "decision") -> DataFrame:
    """Predictions per decision and second over 5 minutes, every 30 seconds."""
    counts = _windowed(events, 300, [decision], {"n": F.lit(1).cast("bigint")})
    return counts.select(*_bounds(), decision, "n", (F.col("n") / 300.0).alias("debit_s"))


def missing_field_counts(events: DataFrame, fields: str = "champs_imputes") -> DataFrame:
    """Requests received without a field, per field and hour."""
    exploded = _timed(events).select("ts", F.explode(fields).alias("champ"))
    counts = exploded.groupBy(F.window("ts", "1 hour"), "champ").agg(F.count("*").alias("n"))
    return counts.select(*_bounds(), "champ", "n")


def request_rates(events: DataFrame) -> DataFrame:
    counts = _windowed(events, 60, [], {"n": F.lit(1).cast("bigint")})
    return counts.select(*_bounds(), "n", (F.col("n") / 60.0).alias("debit_s"))


LATENCY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _latency_columns() -> list[Column]:
    return [F.col("q")[i].alias(name) for i, name in enumerate(LATENCY_PROBS)]


SKETCH_SIZE = 1_000
RANK_ERROR = 0.01  # of a sketch of that size: 0.3 % at 99 % confidence, a third of this


def latency_sketches(events: DataFrame, latency: str = "latence") -> DataFrame:
    """(tick, n, sketch): one mergeable sketch of the latencies of each 30-second tick.

    A stream holds one state for each open tick, whatever the number of windows around it.
    """
    known = _timed(events).where(F.col(latency).isNotNull())
    sketch = F.kll_sketch_agg_double(F.col(latency).cast("double"), SKETCH_SIZE)
    return known.groupBy(F.window("ts", f"{TICK_SECONDS} seconds").alias("tick")).agg(F.count("*").alias("n"), sketch.alias("sketch"))


def merged_quantiles(ticks: DataFrame) -> DataFrame:
    """(debut, fin, n, p50, p95, p99) over 5 minutes every 30 seconds, from the ticks' sketches."""
    around = F.window(F.window_time("tick"), "5 minutes", f"{TICK_SECONDS} seconds")
    merged = ticks.groupBy(around).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in LATENCY_PROBS.items()]
    return merged.select(*_bounds(), "n", *q)


def latency_quantiles(events: DataFrame, latency: str = "latence") -> DataFrame:
    """p50, p95, p99 over 5 minutes within RANK_ERROR of their rank; for streams and batches."""
    return merged_quantiles(latency_sketches(events, latency))


def within_rank_error(quantiles: DataFrame, events: DataFrame, latency: str = "latence", error: float = RANK_ERROR) -> DataFrame:
    """(debut, fin, n, dans_erreur): whether each quantile's true rank in its window is within `error` of the one asked."""
    counted = _windowed(events.where(F.col(latency).isNotNull()), 300, [latency], {"n": F.lit(1).cast("bigint")})
    values = counted.select(*_bounds(), F.col(latency).alias("_v"), F.col("n").alias("_n"))
    both = quantiles.join(values, ["debut", "fin"])
    below = lambda name, op: F.sum(F.when(op(F.col("_v"), F.col(name)), F.col("_n")).otherwise(0))
    ranks = []
    for name in LATENCY_PROBS:
        ranks += [below(name, lambda a, b: a < b).alias(f"lt_{name}"), below(name, lambda a, b: a <= b).alias(f"le_{name}")]
    per = both.groupBy("debut", "fin", "n").agg(F.sum("_n").alias("_all"), *ranks)
    good = F.col("_all") == F.col("n")
    for name, p in LATENCY_PROBS.items():
        slack = F.lit(error) * F.col("n") + 1
        good = good & (F.col(f"lt_{name}") <= p * F.col("n") + slack) & (F.col(f"le_{name}") >= p * F.col("n") - slack)
    return per.select("debut", "fin", "n", good.alias("dans_erreur"))


BLOCK_WINDOWS = 60  # windows that one group answers
BLOCK_ROWS = 1 << 20  # a block with more rows is left to the distributed plan
WINDOW_TICKS = 300 // TICK_SECONDS


def _dealt(events: DataFrame, latency: str) -> DataFrame:
    """(_block, _tick, _v): an event once for each block whose windows reach its tick, 1.15 times in the mean."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.lit(TICK_SECONDS * 1_000_000)
    tick = F.expr("(_m - pmod(_m, _s)) div _s")
    rows = events.select(micros.alias("_m"), step.alias("_s"), F.col(latency).cast("double").alias("_v")).where("_m IS NOT NULL")
    rows = rows.select(tick.alias("_tick"), "_v")
    block = lambda c: F.floor(c / BLOCK_WINDOWS).cast("bigint")
    blocks = F.array_distinct(F.array(block(F.col("_tick") - (WINDOW_TICKS - 1)), block(F.col("_tick"))))
    return rows.select(F.explode(blocks).alias("_block"), "_tick", "_v")


def _block_quantiles(key: tuple, table: pa.Table) -> pa.Table:
    """(_start, n, q) of the windows of a block, by selection inside each."""
    table = table.sort_by("_tick")
    ticks, column = table.column("_tick").to_numpy(), table.column("_v")
    known, values = pc.is_valid(column).to_numpy(), pc.fill_null(column, 0.0).to_numpy() + 0.0  # no negative zero
    first = key[0].as_py() * BLOCK_WINDOWS
    starts = np.arange(first, first + BLOCK_WINDOWS)
    rows = []
    for start, a, b in zip(starts, np.searchsorted(ticks, starts), np.searchsorted(ticks, starts + WINDOW_TICKS)):
        own = values[a:b][known[a:b]]
        if not len(own):
            continue
        places = [p * (len(own) - 1) for p in LATENCY_PROBS.values()]
        own = np.partition(own, sorted({int(f(x)) for x in places for f in (math.floor, math.ceil)}))
        q = []
        for x in places:
            low, high, part = float(own[math.floor(x)]), float(own[math.ceil(x)]), x - math.floor(x)
            q.append(low + (high - low) * part if part > 0 else low)
        rows.append({"_start": int(start), "n": int(b - a), "q": q})
    return pa.Table.from_pylist(rows, pa.schema([("_start", pa.int64()), ("n", pa.int64()), ("q", pa.list_(pa.float64()))]))


def latency_quantiles_exact(
    events: DataFrame, latency: str = "latence"
) -> DataFrame:
    """The same, exact, in batch; a window of any size stays distributed.

    Windows overlap ten times, so events are not copied to each: they go to blocks of consecutive windows, which
    share them. Blocks of more than BLOCK_ROWS are answered by ordered slices of the values.
    """
    dealt = _dealt(events, latency)
    found = dealt.groupBy("_block").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS).collect()  # a row for each such block
    hot = [r["_block"] for r in found]
    small = dealt.where(~F.col("_block").isin(hot)) if hot else dealt
    per = small.groupBy("_block").applyInArrow(_block_quantiles, "_start bigint, n bigint, q array<double>")
    begin = F.timestamp_micros(F.col("_start") * (TICK_SECONDS * 1_000_000))
    window = F.struct(begin.alias("start"), (begin + F.make_dt_interval(secs=F.lit(300))).alias("end"))
    out = per.select(window.alias("window"), "n", "q")
    if hot:
        start = F.floor(F.unix_micros("window.start") / (TICK_SECONDS * 1_000_000 * BLOCK_WINDOWS)).cast("bigint")
        near = events.where(_reaches(hot))
        placed = _windowed(near, 300, [latency], {"n": F.lit(1).cast("bigint")}).where(start.isin(hot))
        q = quantiles(placed, latency, list(LATENCY_PROBS.values()), ["window"], "n")
        counts = placed.groupBy("window").agg(F.sum("n").alias("n"))
        out = out.unionByName(counts.join(q, "window").select("window", "n", "q"))
    return out.select(*_bounds(), "n", *_latency_columns())


def _reaches(blocks: list[int]) -> Column:
    """Events that windows of these blocks hold."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = TICK_SECONDS * 1_000_000 * BLOCK_WINDOWS
    block = lambda m: F.floor(m / width).cast("bigint")
    return block(micros).isin(blocks) | block(micros - (300 - TICK_SECONDS) * 1_000_000).isin(blocks)


def error_ratios(events: DataFrame, is_error: Column) -> DataFrame:
    failed = F.when(is_error, 1).otherwise(0).cast("bigint")
    per = _windowed(events, 300, [], {"n": F.lit(1).cast("bigint"), "n_erreurs": failed})
    return per.select(*_bounds(), "n", (F.col("n_erreurs") / F.col("n")).alias("part_erreurs"))


def mean_latency_ticks(events: DataFrame, service: str, latency: str = "latence") -> DataFrame:
    """(service, fin, moyenne): 5-minute mean at every 30-second tick."""
    per = _timed(events).groupBy(F.window("ts", "5 minutes", "30 seconds"), service).agg(
        F.avg(latency).alias("moyenne")
    )
    return per.select(
        F.col(service).alias("service"), F.col("window.end").alias("fin"), "moyenne"
    )


def sustained_alerts(ticks: DataFrame, limit: float, hold_seconds: int = 300) -> DataFrame:
    """Batch: ticks at which the mean has stayed above the limit for the hold time.

    Runs of consecutive ticks are found per service; their number grows with time, not data.
    """
    seconds = F.unix_timestamp("fin")
    by_time = Window.partitionBy("service").orderBy("fin")
    high = ticks.where(F.col("moyenne") > limit).withColumn("_s", seconds)
    fresh = F.coalesce((F.col("_s") - F.lag("_s").over(by_time)) > TICK_SECONDS, F.lit(True))
    runs = high.withColumn("_run", F.sum(fresh.cast("int")).over(by_time))
    since = F.min("fin").over(Window.partitionBy("service", "_run"))
    fired = runs.withColumn("depuis", since).where(
        F.col("_s") - F.unix_timestamp("depuis") >= hold_seconds
    )
    return fired.select(
        "service",
        F.col("fin").cast("timestamp_ntz").alias("fin"),
        F.col("depuis").cast("timestamp_ntz").alias("depuis"),
    )


def sustained_alerts_stream(ticks: DataFrame, limit: float, hold_seconds: int = 300) -> DataFrame:
    """Streaming: the same alerts from closed windows, with one small state per service."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("fin")
        fired = []
        for end, mean in zip(rows["fin"], rows["moyenne"], strict=True):
            now = int(end.timestamp())
            if mean > limit:
                if since is None or now - last > TICK_SECONDS:
                    since = now
                last = now
                if now - since >= hold_seconds:
                    fired.append((key[0], end, pd.Timestamp(since, unit="s")))
            else:
                since = None
        state.update((since, last))
        yield pd.DataFrame(fired, columns=["service", "fin", "depuis"])

    return ticks.groupBy("service").applyInPandasWithState(
        follow,
        "service string, fin timestamp, depuis timestamp",
        "since long, last long",
        "append",
        "NoTimeout",
    )


def silences(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(depuis, jusqu_a, duree_s): stretches longer than `seconds` without any event.

    Events are reduced to the first and last of each minute before neighbours are compared.
    """
    if seconds < 60:
        raise ValueError("seconds must be at least 60: a shorter gap can lie inside a minute")
    minute = F.date_trunc("minute", F.col("ts"))
    per = events.groupBy(minute.alias("m")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return _gaps(per, seconds)


def _by_minute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last event of each service and minute in a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.append_column("minute", pc.floor_temporal(table.column("ts"), unit="minute"))
        per = table.group_by(["service", "minute"]).aggregate([("ts", "min"), ("ts", "max")])
        yield from per.select(["service", "ts_min", "ts_max"]).rename_columns(["service", "lo", "hi"]).to_batches()


MINUTE = 60_000_000  # microseconds


class _Silence:
    """What a service's stream has shown: the last event of closed minutes, and the open minutes in order."""

    def __init__(self, seconds: int, last: int | None, alerted: bool, minutes: dict[int, tuple[int, int]]) -> None:
        self.limit, self.last, self.alerted, self.minutes = seconds * 1_000_000, last, alerted, minutes
        self.found: list[tuple[int, int | None]] = []

    def add(self, lo: int, hi: int) -> None:
        minute = lo - lo % MINUTE
        low, high = self.minutes.get(minute, (lo, hi))
        self.minutes[minute] = min(low, lo), max(high, hi)

    def advance(self, watermark: int) -> None:
        """Close the minutes that end by the watermark; every event before it is known."""
        for minute in sorted(self.minutes):
            lo, hi = self.minutes[minute]
            self._alert(min(watermark, lo))
            if minute + MINUTE > watermark:
                return
            if self.last is not None and lo - self.last > self.limit:
                self.found.append((self.last, lo))
            self.last, self.alerted = hi if self.last is None else max(self.last, hi), False
            del self.minutes[minute]
        self._alert(watermark)

    def _alert(self, known: int) -> None:
        """No event until `known`: an open silence if that is too long."""
        if self.last is not None and not self.alerted and known - self.last > self.limit:
            self.found.append((self.last, None))
            self.alerted = True

    def due(self) -> int | None:
        """When to look again without new events."""
        ends = [m + MINUTE for m in self.minutes]
        if self.last is not None and not self.alerted:
            ends.append(self.last + self.limit + 1_000)
        return min(ends, default=None)


SILENCE_STATE = "last long, alerted boolean, minutes array<long>, lows array<long>, highs array<long>"


def silences_stream(events: DataFrame, seconds: int = 60, service: Column | None = None) -> DataFrame:
    """(service, depuis, jusqu_a, duree_s) of a stream of events, per service (one without a column).

    A stretch longer than `seconds` without an event comes twice: as an alert without an end as soon as the
    watermark shows it, by an event-time timer if nothing arrives; and with its end once that minute is
    closed. Late rows count until the watermark passes them. Tasks reduce their events to the first and last of each
    minute before the shuffle, and a service's state holds the open minutes only.
    """
    if seconds < 60:
        raise ValueError("seconds must be at least 60: a shorter gap can lie inside a minute")
    named = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.lit("service") if service is None else service).alias("service"))
    reduced = named.where(F.col("ts").isNotNull()).mapInArrow(_by_minute, "service string, lo timestamp, hi timestamp")

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, alerted, minutes, lows, highs = state.get if state.exists else (None, False, [], [], [])
        known = _Silence(seconds, last, alerted, dict(zip(minutes, zip(lows, highs))))
        if not state.hasTimedOut:
            for rows in frames:
                for lo, hi in zip(rows["lo"], rows["hi"], strict=True):
                    known.add(lo.value // 1_000, hi.value // 1_000)
        watermark = state.getCurrentWatermarkMs()
        known.advance(watermark * 1_000)
        at = sorted(known.minutes)
        state.update((known.last, known.alerted, at, [known.minutes[m][0] for m in at], [known.minutes[m][1] for m in at]))
        due = known.due()
        if due is not None:
            state.setTimeoutTimestamp(max(-(-due // 1_000), watermark + 1))
        stamp = lambda t: pd.NaT if t is None else pd.Timestamp(t, unit="us")
        rows = [(key[0], stamp(a), stamp(b), None if b is None else (b - a) / 1e6) for a, b in known.found]
        yield pd.DataFrame(rows, columns=["service", "depuis", "jusqu_a", "duree_s"]).astype({"depuis": "datetime64[us]", "jusqu_a": "datetime64[us]", "duree_s": "float64"})

    return reduced.withWatermark("hi", WATERMARK).groupBy("service").applyInPandasWithState(
        follow, "service string, depuis timestamp, jusqu_a timestamp, duree_s double", SILENCE_STATE, "append", "EventTimeTimeout"
    )


def _gaps(per: DataFrame, seconds: int) -> DataFrame:
    """Gaps between minutes; days are compared apart and joined at their edges."""
    day = F.to_date("m")
    within = Window.partitionBy("day").orderBy("m")
    before = F.lag("hi").over(within)
    marked = per.withColumn("day", day).withColumn("avant", before)
    days = per.groupBy(day.alias("day")).agg(F.max("hi").alias("last"))
    edge = Window.orderBy("day")
    previous = days.withColumn("veille", F.lag("last").over(edge)).select("day", "veille")
    joined = marked.join(F.broadcast(previous), "day").withColumn(
        "avant", F.coalesce("avant", "veille")
    )
    length = (F.unix_micros(F.col("lo").cast("timestamp"))
              - F.unix_micros(F.col("avant").cast("timestamp"))) / 1e6
    return joined.select(
        F.col("avant").alias("depuis"), F.col("lo").alias("jusqu_a"), length.alias("duree_s")
    ).where(F.col("duree_s") > seconds)


# --- running streams -----------------------------------------------------------------------


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "events.parquet"):
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def publish_batch(batch: DataFrame, target: str, number: int) -> None:
    """Write one micro-batch under its number. A batch that is delivered again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{target}/lot={number}")


def published(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of all published batches, each once."""
    return spark.read.schema(schema).parquet(f"{target}/lot=*")


def publish_stream(stream: DataFrame, folder: str) -> DataFrame:
    """Publish what is available through the idempotent sink; exactly once, also after a restart between the write
    of a batch and its commit."""
    target = f"{folder}/table"
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(lambda batch, number: publish_batch(batch, target, number)).start().awaitTermination()
    return published(stream.sparkSession, target, stream.schema)


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Process what is available and return the result table written under `folder`.

    In complete mode each micro-batch replaces the table; in append mode it adds to it.
    """
    target, state = f"{folder}/table", f"{folder}/checkpoint"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", state)
    if mode == "append":
        query = writer.format("parquet").start(target)
    else:
        query = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(target)
        ).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
