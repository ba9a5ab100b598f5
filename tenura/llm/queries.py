"""One thin query for each operator of this folder, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import (
    fuzzy, html, language, licenses, mixing, phrases, pieces, pivots, runs, simhash, storage, substrings, token_files, toxicity,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, folder))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MODEL = "piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode(documents(spark, folder).select("doc_id", "text"), public_tokenizers.path(MODEL))
    return coded.select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.learned_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select(
        F.col("key").alias("doc_id"), toxicity.held_out(F.col("key")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op4_document_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.edited_neighbours(documents(spark, folder)).withColumnRenamed("key", "doc_id")


OP5_SQL = """
WITH RECURSIVE fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = least.a)::BIGINT AS n_links, c AS component_id, a = c AS kept FROM least
"""


@query("op5_embedding_near_dedup", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    shares = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_rows", "tokens", *shares, "rate")


OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM words WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM later
), marks AS (
    SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE
           [w[k] FOR k IN generate_series(1, len(w)) IF NOT list_contains(js, k)] END, ' ')) AS kept_sha256
FROM words LEFT JOIN marks USING (doc_id)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeats(documents(spark, folder))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sql() -> str:
    """Every document against every template, without bands."""
    rows = ", ".join(
        f"('{name}', {licenses.length_of(text)}, {licenses.step_of(licenses.length_of(text))}, {len(licenses.template_shingles(text))}, '{s}')"
        for name, text in licenses.TEMPLATES.items() for s in licenses.template_shingles(text)
    )
    return rf"""
WITH templates(license, length, step, size, s) AS (VALUES {rows}), worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
    FROM documents WHERE text IS NOT NULL
), placed AS (
    SELECT doc_id, i AS pos, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 5)) AS i FROM worded WHERE len(w) >= 5)
), hits AS (
    SELECT doc_id, license, size, pos, s,
        unnest(generate_series(greatest(0, floor((pos + 4 - length) / step)::INT), (pos // step)::INT)) AS win
    FROM placed JOIN templates USING (s)
), windows AS (
    SELECT doc_id, license, win, min(pos) AS pos, count(DISTINCT s) / any_value(size) AS share FROM hits GROUP BY ALL
    HAVING count(DISTINCT s) >= 0.8 * any_value(size) - 1e-9
)
SELECT doc_id, license, min(pos)::BIGINT AS first_word, count(*)::BIGINT AS n_windows, max(share)::DOUBLE AS containment
FROM windows GROUP BY ALL
"""


@query("op8_license_scan", op8_sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = language.identify(docs.select("doc_id", "text"), language.learned_model(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_html_extraction")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))


TOKENS = "byte_bpe_50k.json"


@query("op11_token_files")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    written = storage.new_folder(spark, "token-ids")
    token_files.write(documents(spark, folder), written, public_tokenizers.path(TOKENS))
    placed = token_files.positions(token_files.digests(spark, written), token_files.metadata(spark, written))
    return placed.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def planted(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 ends in 0 repeat a stretch of their words up to the end."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(F.col("h") / 10)
    a = g % F.size("w")
    period = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))
    tail = F.expr("transform(sequence(a, size(w) - 1), i -> w[CAST(a + (i - a) % q AS INT)])")
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    chosen = (F.col("h") % 10 == 0) & (F.size("w") > 0)
    some = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    some = some.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", g).withColumn("a", F.when(chosen, a)).withColumn("q", F.when(chosen, period))
    return some.select("doc_id", F.when(chosen, edited).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.runs(planted(documents(spark, folder).select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", runs.strongest()).select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), phrases AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
    FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k)
    GROUP BY ALL
), sizes AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, part, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS part FROM candidates) c
    JOIN phrases x ON x.lang = c.lang AND x.k = part AND x.phrase = array_to_string(c.w[1:part], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.k = c.k - part AND y.phrase = array_to_string(c.w[part + 1:c.k], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN sizes USING (lang)
WHERE k = 3 OR NOT coalesce(100 * most >= 50 * a, false)
QUALIFY rank <= 2000
"""


@query("op13_phrases", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = phrases.collocations(documents(spark, folder))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
