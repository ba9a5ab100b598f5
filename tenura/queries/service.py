"""Queries over prediction events, files and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import economics, references
from tenura.plans.gold import build_gold
from tenura.plans.raw import deliver, raw_sql
from tenura.queries.decisions import DEFAULT_EV
from tenura.queries.evaluation import S, scored
from tenura.queries.exploration import rounded
from tenura.queries.registry import query
from tenura.sources import files
from tenura.sources.tables import SCHEMAS, table
from tenura.streaming import monitoring


def events(spark, folder):
    """Prediction events: the event type as decision, the value as latency."""
    return prediction_events(table(spark, folder, "events"))


def prediction_events(df):
    k = F.get_json_object("props", "$.k").cast("int")
    fields = F.array_compact(
        F.array(
            F.when(k % 2 == 0, F.lit("csat")),
            F.when(k % 3 == 0, F.lit("heures_usage_30j")),
            F.when(k % 5 == 0, F.lit("pays")),
        )
    )
    return df.select(
        "ts", F.col("event_type").alias("decision"), F.col("value").alias("latence"),
        fields.alias("champs_imputes"),
    )


def windows_sql(seconds: int, step: int = 30) -> str:
    n = seconds // step
    return f"""w AS (SELECT e.*, make_timestamp((epoch_us(ts) // {step * 1000000} - i) * {step * 1000000}) AS debut
      FROM events e, range({n}) t(i)), ww AS (SELECT *, debut + INTERVAL {seconds} SECOND AS fin FROM w)"""


def closed(sql: str) -> str:
    """The windows that a stream has closed at the end of its input: those behind the watermark."""
    return f"SELECT * FROM ({sql}) q WHERE fin <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def streamed(spark, folder, name: str, result):
    """The closed windows of a running stream over the events, in append mode."""
    stream = prediction_events(monitoring.read_events(spark, folder, SCHEMAS["events"]))
    return monitoring.run_to_table(result(stream), files.scratch(spark, name), "append")


FIVE = f"WITH {windows_sql(300)}"
_DECISIONS = FIVE + """ SELECT debut, fin, event_type AS decision, count(*) AS n, round(count(*) / CAST(300 AS DOUBLE), 6) AS debit_s
  FROM ww GROUP BY ALL"""


@query("decision_rates", _DECISIONS)
def decision_rates(spark, folder):
    return rounded(monitoring.decision_rates(events(spark, folder)), "debit_s")


@query("decision_rates_stream", closed(_DECISIONS))
def decision_rates_stream(spark, folder):
    return streamed(spark, folder, "decision-rates", lambda e: rounded(monitoring.decision_rates(e), "debit_s"))


_MISSING = """WITH x AS (SELECT ts, unnest(list_filter([CASE WHEN k % 2 = 0 THEN 'csat' END, CASE WHEN k % 3 = 0 THEN
      'heures_usage_30j' END, CASE WHEN k % 5 = 0 THEN 'pays' END], lambda x: x IS NOT NULL)) AS champ
      FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
    SELECT date_trunc('hour', ts) AS debut, date_trunc('hour', ts) + INTERVAL 1 HOUR AS fin, champ, count(*) AS n
    FROM x GROUP BY ALL"""


@query("missing_field_counts", _MISSING)
def missing_field_counts(spark, folder):
    return monitoring.missing_field_counts(events(spark, folder))


_REQUESTS = f"WITH {windows_sql(60)} SELECT debut, fin, count(*) AS n, round(count(*) / CAST(60 AS DOUBLE), 6) AS debit_s FROM ww GROUP BY ALL"


@query("request_rates", _REQUESTS)
def request_rates(spark, folder):
    return rounded(monitoring.request_rates(events(spark, folder)), "debit_s")


@query("missing_field_counts_stream", closed(_MISSING))
def missing_field_counts_stream(spark, folder):
    return streamed(spark, folder, "missing-fields", monitoring.missing_field_counts)


@query("request_rates_stream", closed(_REQUESTS))
def request_rates_stream(spark, folder):
    return streamed(spark, folder, "request-rates", lambda e: rounded(monitoring.request_rates(e), "debit_s"))


@query(
    "latency_quantiles",
    FIVE + """ SELECT debut, fin, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS p50,
      round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99 FROM ww GROUP BY ALL""",
)
def latency_quantiles(spark, folder):
    out = monitoring.latency_quantiles_exact(events(spark, folder))
    return rounded(out, "p50", "p95", "p99", digits=5)


@query(
    "latency_quantiles_stream",
    closed(FIVE + " SELECT debut, fin, count(*) AS n, true AS dans_erreur FROM ww WHERE value IS NOT NULL GROUP BY ALL"),
)
def latency_quantiles_stream(spark, folder):
    """The stream's quantiles, held against the exact ranks of the same windows."""
    found = streamed(spark, folder, "latency", monitoring.latency_quantiles)
    return monitoring.within_rank_error(found, events(spark, folder))


_ERRORS = FIVE + """ SELECT debut, fin, count(*) AS n, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6)
      AS part_erreurs FROM ww GROUP BY ALL"""


@query("error_ratios", _ERRORS)
def error_ratios(spark, folder):
    out = monitoring.error_ratios(events(spark, folder), F.col("decision") == "error")
    return rounded(out, "part_erreurs")


@query("error_ratios_stream", closed(_ERRORS))
def error_ratios_stream(spark, folder):
    failed = F.col("decision") == "error"
    return streamed(spark, folder, "error-ratios", lambda e: rounded(monitoring.error_ratios(e, failed), "part_erreurs"))


_LIMIT = 40.0
_ALERTS = FIVE + f""", m AS (SELECT event_type AS service, fin, avg(value) AS m FROM ww GROUP BY ALL),
  h AS (SELECT *, coalesce(fin - lag(fin) OVER (PARTITION BY service ORDER BY fin) > INTERVAL 30 SECOND, true) AS fresh
    FROM m WHERE m > {_LIMIT}),
  r AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY service ORDER BY fin) AS run FROM h),
  s AS (SELECT service, fin, min(fin) OVER (PARTITION BY service, run) AS depuis FROM r)
  SELECT * FROM s WHERE fin - depuis >= INTERVAL 5 MINUTE"""


@query("sustained_alerts", _ALERTS)
def sustained_alerts(spark, folder):
    ticks = monitoring.mean_latency_ticks(events(spark, folder), "decision")
    return monitoring.sustained_alerts(ticks, _LIMIT)


@query("sustained_alerts_stream")
def sustained_alerts_stream(spark, folder):
    """Two chained streams: closed windows to a table, then the state over that table."""
    stream = prediction_events(monitoring.read_events(spark, folder, SCHEMAS["events"]))
    path = files.scratch(spark, "ticks")
    ticks = monitoring.run_to_table(monitoring.mean_latency_ticks(stream, "decision"), path, "append")
    closed = spark.readStream.schema(ticks.schema).parquet(f"{path}/table")
    alerts = monitoring.sustained_alerts_stream(closed, _LIMIT)
    return monitoring.run_to_table(alerts, files.scratch(spark, "alerts"), "append")


@query(
    "silences",
    """WITH g AS (SELECT lag(ts) OVER (ORDER BY ts) AS depuis, ts AS jusqu_a FROM events)
    SELECT depuis, jusqu_a, round((epoch_us(jusqu_a) - epoch_us(depuis)) / 1e6, 6) AS duree_s FROM g
    WHERE epoch_us(jusqu_a) - epoch_us(depuis) > 600 * 1000000""",
)
def silences(spark, folder):
    return rounded(monitoring.silences(events(spark, folder), 600), "duree_s")


@query(
    "silences_stream",
    """WITH g AS (SELECT lag(ts) OVER (ORDER BY ts) AS depuis, ts AS jusqu_a FROM events)
    SELECT depuis, jusqu_a, round((epoch_us(jusqu_a) - epoch_us(depuis)) / 1e6, 6) AS duree_s FROM g
    WHERE epoch_us(jusqu_a) - epoch_us(depuis) > 600 * 1000000
      AND date_trunc('minute', jusqu_a) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def silences_stream(spark, folder):
    """The silences that have ended, from a running stream; its open alerts have no end yet."""
    found = streamed(spark, folder, "silences", lambda e: monitoring.silences_stream(e, 600))
    ended = found.where(F.col("jusqu_a").isNotNull())
    return ended.select(F.col("depuis").cast("timestamp_ntz"), F.col("jusqu_a").cast("timestamp_ntz"), F.round("duree_s", 6).alias("duree_s"))


# --- files ---------------------------------------------------------------------------------


@query(
    "csv_round_trip",
    f"WITH {raw_sql()} SELECT client_id, plan, csat, revenu_mensuel_recurrent_eur FROM raw",
)
def csv_round_trip(spark, folder):
    """The raw export written as CSV and scanned back as text, empties kept."""
    scanned = files.scan_raw_text(spark, deliver(spark, folder, files.scratch(spark, "raw")))
    return scanned.select("client_id", "plan", "csat", "revenu_mensuel_recurrent_eur")


@query(
    "csv_quoted_text",
    """SELECT CAST(c_custkey AS VARCHAR) AS cle, 'dit "' || c_name || '", vite' || chr(10) || 'fin' AS note,
      c_mktsegment AS segment FROM customer""",
)
def csv_quoted_text(spark, folder):
    """Values with quotes, delimiters and line breaks come back whole, on one row each."""
    path = files.scratch(spark, "quoted")
    note = F.concat(F.lit('dit "'), F.col("c_name"), F.lit('", vite\nfin'))
    made = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("cle"), note.alias("note"), F.col("c_mktsegment").alias("segment")
    )
    made.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.scan_raw_text(spark, path)


@query(
    "source_manifest",
    """SELECT ';' AS separateur, 2 AS nb_colonnes, 'utf-8-sig' AS encodage, count(*) AS nb_lignes,
      CAST(sum(length(CAST(c_custkey AS VARCHAR)) + 1 + length(c_name) + 1) AS BIGINT) AS taille_octets,
      sha256(string_agg(CAST(c_custkey AS VARCHAR) || ';' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256
    FROM customer""",
)
def source_manifest(spark, folder):
    """The customer table written as one delimited file, then inventoried."""
    path = files.scratch(spark, "manifest")
    delivered = table(spark, folder, "customer").select("c_custkey", "c_name").repartitionByRange(1, "c_custkey")
    delivered.sortWithinPartitions("c_custkey").write.option("delimiter", ";").csv(path)
    manifest = files.source_manifest(spark, [path])
    return manifest.select("separateur", "nb_colonnes", "encodage", "nb_lignes", "taille_octets", "sha256")


@query(
    "write_gold",
    f"""WITH {raw_sql()} SELECT count(DISTINCT client_id) AS nb_lignes, CAST(56 AS BIGINT) AS nb_colonnes,
      count(*) - count(DISTINCT client_id) AS doublons_supprimes, 'nuit' AS note, true AS empreintes FROM raw""",
)
def write_gold(spark, folder):
    """From the delivered files to the gold table: scanned as text, copies removed, keys checked."""
    delivered = deliver(spark, folder, files.scratch(spark, "gold-raw"))
    raw = files.materialise(files.scan_raw_text(spark, delivered), "raw")
    gold = build_gold(raw, references.catalogue(spark), check_key="client_id")
    path = files.scratch(spark, "gold")
    sources = files.source_manifest(spark, [delivered])
    meta = files.write_gold(gold, path, sources=sources, n_raw=raw.count(), note="nuit")
    kept = spark.read.json(f"{path}_sources").agg(F.bool_and(F.length("sha256") == 64).alias("empreintes"))
    return meta.select("nb_lignes", "nb_colonnes", "doublons_supprimes", "note").crossJoin(F.broadcast(kept))


@query(
    "publish_scores",
    S + f""", v AS (SELECT id, {DEFAULT_EV} AS ev FROM s), r AS (SELECT id FROM v WHERE ev > 0 ORDER BY ev DESC, id LIMIT 45)
    SELECT DATE '2024-01-31' AS date_ref, CASE WHEN id IN (SELECT id FROM r) THEN 'Contacter' WHEN ev > 0
      THEN 'Action automatisée' ELSE 'Veille' END AS action_cs, count(*) AS n FROM v GROUP BY ALL""",
)
def publish_scores(spark, folder):
    path = files.scratch(spark, "scores")
    scores = economics.decide(scored(spark, folder))
    files.publish_scores(scores, path, "2024-01-31")
    files.publish_scores(scores.limit(0), path, "2024-01-31")  # the date exists: left alone
    return spark.read.parquet(path).groupBy("date_ref", "action_cs").agg(F.count("*").alias("n"))


@query(
    "write_predictions_csv",
    S + """ SELECT id, round_even(p, 4) AS probabilite_churn, CAST(p >= 0.4 AS INTEGER) AS decision,
      CAST(0.4 AS DOUBLE) AS seuil FROM s""",
)
def write_predictions_csv(spark, folder):
    path = files.scratch(spark, "predictions") + ".csv"
    return files.write_predictions_csv(scored(spark, folder), path, 0.4)
