"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each task counts the hashed n-grams of its labelled texts per language; the counts are summed by
Spark and become one matrix of log-probabilities (languages x buckets), which is broadcast. Texts are
scored in batches: the n-grams of a batch are the sparse rows, whose matrix rows numpy gathers and sums.

Defined cases: a text that is null or has no letter gets `und` with score 0, as does every text when
nothing could be learned; ties go to the language that sorts first; a language with few texts is
learned like any other; rows with null id are never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.texts import chunks, clear_of, code_points, small_batches

LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 15
SIZES = (2, 3)
CHUNK_CHARS = 1 << 19
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def buckets_of(texts: list[str], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the buckets of all n-grams of the lower-cased texts, in text order, and
    the texts' numbers. Runs of characters that are no letters count as one blank; no n-gram spans
    two texts.
    """
    lowered = [t.lower() for t in texts]
    line = code_points(" " + " ".join(lowered) + " ")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.concatenate((owner[:1], owner))  # the first blank; later ones end one text and begin the next
    letter = letters()[line]
    keep = np.flatnonzero(letter | np.concatenate(([True], letter[:-1])))
    line, owner, letter = np.where(letter, line, 0x20)[keep].astype(np.uint64), owner[keep], letter[keep]
    out, rolling = [], line
    for size in range(2, max(SIZES) + 1):
        rolling = rolling[: len(line) - size + 1] * np.uint64(0x100000001B3) + line[size - 1 :]
        if size in SIZES:
            own = owner[size - 1 : size - 1 + len(rolling)]
            blank = ~letter[: len(rolling)]
            fits = (owner[: len(rolling)] == own) | blank & (owner[1 : 1 + len(rolling)] == own)
            inner = rolling[fits]
            inner ^= inner >> np.uint64(29)
            inner *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(((inner >> np.uint64(33)) % np.uint64(buckets), own[fits]))
    return out


class Model:
    """Languages in order, the log-probabilities (buckets x languages), and those of the languages."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray) -> None:
        self.languages, self.logs, self.priors = languages, logs, priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not self.languages:
            return names, scores
        for a, b in chunks([len(texts[i]) for i in known], CHUNK_CHARS):
            own = known[a:b]
            sums = np.tile(self.priors, (len(own), 1))
            for bucket, row in buckets_of([texts[i] for i in own], len(self.logs)):
                first = np.flatnonzero(np.diff(row, prepend=-1))  # the rows are in order
                if len(first):
                    sums[row[first]] += np.add.reduceat(self.logs[bucket], first, axis=0)
            best = sums.argmax(1)
            odds = np.exp(sums - sums.max(1, keepdims=True))
            scores[own] = 1 / odds.sum(1)
            for i, k in zip(own, best):
                names[i] = self.languages[k]
        return names, scores


def learn(rows: DataFrame, text: str, label: str, buckets: int = BUCKETS, smoothing: float = 0.1) -> Model:
    """Fit on all rows with a label and a text; only summed counts leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], texts[lang]))],
                    ["lang", "bucket", "n"],
                )
            sums.clear()

        for batch in small_batches(batches):
            labels = np.array(batch.column(1).to_pylist(), object)
            whole = batch.column(0).to_pylist()
            for lang in sorted(set(labels)):
                own = [whole[i] for i in np.flatnonzero(labels == lang)]
                for a, b in chunks([len(t) for t in own], CHUNK_CHARS):
                    if lang not in sums:
                        sums[lang], texts[lang] = np.zeros(buckets, np.int64), 0
                    for bucket, _ in buckets_of(own[a:b], buckets):
                        sums[lang] += np.bincount(bucket.astype(np.int64), minlength=buckets)
                    texts[lang] += b - a
            if len(sums) > 256:
                yield from given()
        yield from given()

    labelled = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # languages x buckets at most
    langs = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(langs))
    logs, priors = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    for i, lang in enumerate(languages):
        own = langs == lang
        at, c = bucket[own], n[own]
        logs[i, at[at >= 0]] = c[at >= 0]
        priors[i] = c[at < 0].sum()
    used = max(1, int((logs.sum(0) > 0).sum()))
    logs = np.log(logs + smoothing) - np.log(logs.sum(1, keepdims=True) + smoothing * used)
    return Model(languages, np.ascontiguousarray(logs.T), np.log(priors / max(1, priors.sum())))


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the language and its posterior added under `names`; input columns of
    those names get `_input`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores)], [*batch.schema.names, *names]
            )

    rows = docs.toDF(*clear_of(docs.columns, set(names)))
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def learned_model(docs: DataFrame) -> Model:
    return learn(docs.where(~held_out(F.col("doc_id"))), "text", "lang")
