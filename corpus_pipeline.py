"""A training-corpus pipeline over `documents`: each stage works on all that the one before it kept.

language ID         documents that it rejects go: no letter, no text, or no language likelier than `LEAST_SCORE`
SimHash near-dedup  of each group of near copies (Jaccard similarity of 0.8 or more over five words) the smallest doc_id stays
substring dedup     repeated passages are cut out; a document of which nothing is left goes
mixing              each document is taken as often as its fitted rate says, in expectation: a hash of its id draws
SentencePiece       ids, their number, byte spans and digests of what stays

All but the last return the columns of `documents`; a shortened text has its n_chars counted anew.

Defined cases: null and empty texts, and texts without letters, go in the first stage; repeated rows and ties count as near
copies, of which one stays; rows with a null id pass the second and fourth stage; an empty table passes every stage empty;
columns of any other name are carried, also where a stage uses that name inside.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import language, mixing, pieces, simhash, substrings
from tenura.llm.storage import materialise

LEAST_SCORE = 0.4
# Parts of each domain's tokens that the mixture takes.
MULTIPLES = {"high": 1.0, "low": 0.95, "toxic": 0.05}
MODEL = "piece_bpe_32k.model"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learned_model(docs)
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # no name can clash
    found = language.identify(plain, model, text=f"_{docs.columns.index('text')}")
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # no name can clash
    found = substrings.repeats(docs.withColumnsRenamed(others), keep=tuple(others.values()), untouched=True)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    back = [F.col(a).alias(c) for c, a in others.items()]
    left = left.select(F.col("key").alias("doc_id"), F.col("kept").cast("string").alias("text"), *back, (F.col("n_removed") > 0).alias("_cut"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.when(F.col("_cut"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(docs, labels, multiples=MULTIPLES)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs, public_tokenizers.path(MODEL), keep=("lang", "source"))
    return coded.select(
        F.col("key").alias("doc_id"), "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identified),
    ("SimHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

# The fitted classifiers, SimHash and SentencePiece have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
