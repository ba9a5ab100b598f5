"""Toxicity scores from a counterfactually regularised classifier.

Features of a text are the words (runs of letters, lower-cased) that occur in it and their beginnings
of 4, 5 and 6 letters, as 64-bit hashes. Their document frequencies by label are counted by Spark over
the training rows; features whose association with the label is plain (chi-square) enter a logistic
regression. Identity terms in the labelled sentences are swapped for other terms of their group, and
left out; the square of the score change that this causes is added to the loss, so that a group's
mention alone moves no score.

Training rows are a bounded sample (`fit_rows`) of the labelled rows, chosen by a hash of the id: the
labels that are broadcast, and the rows that the driver fits on, are bounded by it. All texts are
scored whole.

Defined cases: null and empty texts have no features and score the model's base rate; without labelled
rows, or with one label only, every score is that label's smoothed share; repeated rows count as often
as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.language import letters
from tenura.llm.sampling import bounded_sample
from tenura.llm.storage import materialise
from tenura.llm.texts import BYTE_BASE, chunks, code_points, small_batches, span_hashes

FIT_ROWS = 50_000
MAX_FEATURES = 16_384
LEAST_CHI_SQUARE = 12.0
LEAST_DOCUMENTS = 2
BEGINNINGS = (4, 5, 6)
CHUNK_CHARS = 1 << 19
FILTER_BITS = 20

# Groups of identity terms; a term is swapped for the next one of its group. Fixed values.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("mother", "father"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "able"), ("old", "young"),
    ("muslimisch", "christlich", "jüdisch"), ("frau", "mann"), ("frauen", "männer"), ("schwul", "hetero", "lesbisch"),
    ("musulman", "chrétien", "juif"), ("femme", "homme"), ("femmes", "hommes"), ("noir", "blanc"),
    ("musulmán", "cristiano", "judío"), ("mujer", "hombre"), ("mujeres", "hombres"), ("negro", "blanco"),
)
SENTENCES = regex.compile(r"[^.!?\n]+[.!?\n]*")


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word and word beginning, in no particular order, with repeats."""
    lowered = [t.lower() for t in texts]
    line = code_points(" " + " ".join(lowered) + " ")
    letter = letters()[line]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    owner = np.searchsorted(begins, starts, side="right") - 1
    hashes, owners = [span_hashes(line, starts, ends, BYTE_BASE)], [owner]
    for size in BEGINNINGS:
        longer = ends - starts > size
        hashes.append(span_hashes(line, starts[longer], starts[longer] + size, BYTE_BASE) ^ np.uint64(size))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def present(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each text."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    first = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])))[: len(hashes)]
    return hashes[first], owners[first]


class Vocabulary:
    """The selected features; most others are ruled out by a bit table that fits a cache."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, text number), each once."""
        hashes, owners = features_of(texts)
        maybe = self.table[hashes >> np.uint64(64 - FILTER_BITS)]
        hashes, owners = hashes[maybe], owners[maybe]
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        pairs = np.unique(owners[known] * len(self.hashes) + at[known])
        return pairs % len(self.hashes), pairs // len(self.hashes)


def swaps(groups: tuple[tuple[str, ...], ...]) -> tuple[regex.Pattern | None, dict[str, str]]:
    to = {term.lower(): group[(i + 1) % len(group)].lower() for group in groups for i, term in enumerate(group)}
    if not to:
        return None, to
    return regex.compile(r"(?<!\p{L})(?:" + "|".join(sorted(map(regex.escape, to), key=len, reverse=True)) + r")(?!\p{L})", regex.I), to


def swapped_sentences(text: str, pattern: regex.Pattern | None, to: dict[str, str]) -> list[tuple[str, str]]:
    """The sentences with identity terms, each with the terms swapped and with the terms left out."""
    if pattern is None or not pattern.search(text):
        return []
    found = [s for s in SENTENCES.findall(text) if pattern.search(s)]
    swapped = [(s, pattern.sub(lambda m: to[m[0].lower()], s)) for s in found]
    return swapped + [(s, pattern.sub("", s)) for s in found]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    base: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
            number, owner = self.vocabulary.find(texts[a:b])
            out[a:b] += np.bincount(owner, self.weights[number], b - a) if len(number) else 0
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_weights(feature, row, labels, swap_feature, swap_row, swap_sign, n_features: int, ridge: float, fairness: float, swap_count=1.0) -> tuple[np.ndarray, float]:
    """Logistic regression with ridge and swap penalties, by Newton steps with conjugate gradients.

    swap_count says how often each swap occurs; equal ones need one row.
    """
    n, n_swaps = len(labels), int(swap_row.max()) + 1 if len(swap_row) else 0
    theta = np.zeros(n_features + 1)  # the last one is the base
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    theta[-1] = np.log(rate / (1 - rate))

    def forward(t):
        return t[-1] + np.bincount(row, t[feature], n)

    def back(r):
        return np.append(np.bincount(feature, r[row], n_features), r.sum())

    def penalty(t):
        out = ridge * t
        out[-1] = 1e-6 * t[-1]
        if n_swaps:
            change = swap_count * np.bincount(swap_row, swap_sign * t[swap_feature], n_swaps)
            out[:-1] += fairness * np.bincount(swap_feature, swap_sign * change[swap_row], n_features)
        return out

    for _ in range(25):
        p = 1 / (1 + np.exp(-forward(theta)))
        gradient = back(p - labels) + penalty(theta)
        if np.abs(gradient).max() < 1e-6 * n:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, rest = np.zeros_like(theta), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(60):
            bent = back(curve * forward(way)) + penalty(way)
            along = size / max(way @ bent, 1e-300)
            step, rest = step + along * way, rest - along * bent
            new = rest @ rest
            if new < 1e-10 * (gradient @ gradient):
                break
            way, size = rest + new / size * way, new
        theta = theta + step * min(1.0, 8 / max(np.abs(step).max(), 1e-12))
    return theta[:-1], float(theta[-1])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column, and the row of each."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def learn(
    rows: DataFrame, text: str, label: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, ridge: float = 1.0, fairness: float = 10.0
) -> Model:
    """Fit on `rows` (text, label 0/1), whose number the caller bounds."""
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for value in (0, 1):
                own = [texts[i] for i in np.flatnonzero(labels == value)]
                for a, b in chunks([len(t) for t in own], CHUNK_CHARS):
                    hashes, n = np.unique(present(*features_of(own[a:b]))[0], return_counts=True)
                    n = n.astype(np.int64)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(none if value else n), pa.array(n if value else none)], ["feature", "n0", "n1"])

    totals = rows.agg(F.sum(F.lit(1) - F.col("label")).alias("n0"), F.sum("label").alias("n1")).first()
    n0, n1 = totals.n0 or 0, totals.n1 or 0
    if not n0 or not n1:
        rate = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), float(np.log(rate / (1 - rate))))
    counts = rows.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    inside, n = F.col("n0") + F.col("n1"), float(n0 + n1)
    gap = F.col("n1") * n - inside * float(n1)
    chi = gap * gap / (inside * (F.lit(n) - inside) * (float(n1) * n0)) * n
    chosen = counts.where((inside >= LEAST_DOCUMENTS) & (inside < n)).select("feature", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI_SQUARE)
    chosen = chosen.orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES).collect()
    vocabulary = Vocabulary(np.array([r.feature for r in chosen], np.int64).view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, to = swaps(groups)
        names = ["label", "features", "swap", "sign"]
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in small_batches(batches):
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
                number, owner = shared.value.find(texts[a:b])
                edges = np.searchsorted(owner, np.arange(b - a + 1))
                out += [(labels[a + i], number[edges[i] : edges[i + 1]].tolist(), [], []) for i in range(b - a)]
            for t in texts:
                for sentence, other in swapped_sentences(t, pattern, to):
                    number, owner = shared.value.find([sentence, other])
                    was, now = set(number[owner == 0].tolist()), set(number[owner == 1].tolist())
                    if was ^ now:
                        out.append((-1, [], sorted(was ^ now), [1 if f in now else -1 for f in sorted(was ^ now)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    # the penalty needs each distinct score change once, with its count: their number does not follow that of the texts
    every = rows.mapInArrow(rows_of, "label int, features array<int>, swap array<int>, sign array<int>")
    every = materialise(every, "toxicity-rows")
    table = every.where("label >= 0").select("label", "features").toArrow()
    changes = every.where("label < 0").groupBy("swap", "sign").agg(F.count(F.lit(1)).alias("n")).orderBy("swap", "sign").toArrow()
    number, row = flat(table.column("features"))
    swap, swap_row = flat(changes.column("swap"))
    sign, _ = flat(changes.column("sign"))
    weights, base = fit_weights(
        number, row, table.column("label").to_numpy().astype(float), swap, swap_row, sign.astype(float), len(vocabulary.hashes), ridge, fairness,
        changes.column("n").to_numpy().astype(float),
    )
    return Model(vocabulary, weights, base)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = shared.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, score double")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def learned_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = bounded_sample(known, "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return learn(materialise(rows, "toxicity"), "text", "toxic")
