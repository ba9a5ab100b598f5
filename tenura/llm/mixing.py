"""Mixing to target token weights with soft domain membership, in DataFrame operations only.

1. A classifier is fitted on the labelled table: document frequencies of words by domain over a bounded
   sample of labelled rows (`fit_rows`), naive Bayes over the presence and absence of the words whose association with a domain is
   plain (at most `MAX_WORDS` of them; the bound makes the broadcast safe).
2. Every document gets posteriors p(domain), from all distinct words of its whole text: words are
   exploded, met with the broadcast words, and summed by document before the shuffle.
3. Nonnegative rates r(document) are fitted by projected gradient so that the expected token totals
   S(k) = sum r t p(k) match the targets T(k): the loss is sum (S(k) - T(k))**2 / A(k) / 2 with A(k) the
   expected tokens at hand. In the metric weighted by tokens the step is
   r <- max(0, r - sum_k p(k) (S(k) - T(k)) / A(k)), for which a step of 1 is safe. One round is one
   aggregate of as many numbers as there are domains; the table of posteriors is narrow and is read
   back from the shared folder, and rates are written again every `ROUNDS_A_WRITE` rounds.

The token budget, unless given, is the largest one that repeats no domain: min A(k) / weight(k).

Defined cases: documents without words have no tokens and rate 1 is fitted by nothing, they keep it;
rows with one id and one text are one document whose tokens count once for each row; a domain without
labelled rows keeps a smoothed prior; targets that cannot be met are met as closely as least squares
allows; without any tokens all rates stay 1.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.sampling import bounded_sample
from tenura.llm.storage import materialise

DOMAINS = ("high", "low", "toxic")
WEIGHTS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
FIT_ROWS = 20_000
MAX_WORDS = 4_096
LEAST_DOCUMENTS = 3
LEAST_CHI_SQUARE = 30.0
SMOOTHING = 0.5
MAX_ROUNDS = 60
ROUNDS_A_WRITE = 10
TOLERANCE = 1e-4
WORD_GAP = r"[\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The number of the domain that a labelled row belongs to."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def word_weights(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, list[float]]:
    """(word, w0, w1, ...): evidence of each chosen word for each domain; and the evidence of a text without any."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    known = known.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known, "doc_id", fit_rows)), "doc_id")
    seen = rows.select("domain", F.explode(F.concat(F.array_distinct(words_of(F.col("text"))), F.array(F.lit("")))).alias("word"))
    per_domain = [F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(len(DOMAINS))]
    counts = materialise(seen.groupBy(F.xxhash64("word").alias("word")).agg(*per_domain).where(add([F.col(f"n{k}") for k in range(len(DOMAINS))]) >= LEAST_DOCUMENTS), "mixing-words")
    every = counts.where(F.col("word") == F.xxhash64(F.lit(""))).first()  # the empty word is in every document
    totals = [every[f"n{k}"] if every else 0 for k in range(len(DOMAINS))]
    n = sum(totals)
    inside = add([F.col(f"n{k}") for k in range(len(DOMAINS))])
    gaps = [F.col(f"n{k}") * float(n) - inside * float(t) for k, t in enumerate(totals) if 0 < t < n]
    if not gaps:
        empty = counts.where(F.lit(False)).select("word", *(F.lit(0.0).alias(f"w{k}") for k in range(len(DOMAINS))))
        return empty, _log_shares(totals)
    chi = [g * g / (inside * (F.lit(float(n)) - inside) * (float(t) * (n - t))) * n for g, t in zip(gaps, [t for t in totals if 0 < t < n])]
    chosen = counts.where(inside < n).withColumn("chi", F.greatest(*chi) if len(chi) > 1 else chi[0]).where(F.col("chi") >= LEAST_CHI_SQUARE)
    chosen = chosen.orderBy(F.desc("chi"), "word").limit(MAX_WORDS)
    share = (inside + SMOOTHING) / (n + 2 * SMOOTHING)
    own = [(F.col(f"n{k}") + 2 * SMOOTHING * share) / (t + 2 * SMOOTHING) for k, t in enumerate(totals)]
    absent = [F.log((F.lit(1.0) - o) / (F.lit(1.0) - share)) for o in own]  # evidence of a word's absence
    weights = [(F.log(o / share) - a).alias(f"w{k}") for k, (o, a) in enumerate(zip(own, absent))]
    missing = chosen.agg(*(F.coalesce(F.sum(a), F.lit(0.0)).alias(f"b{k}") for k, a in enumerate(absent))).first()
    return chosen.select("word", *weights), [p + b for p, b in zip(_log_shares(totals), missing)]


def _log_shares(totals: list[int]) -> list[float]:
    return [math.log((t + SMOOTHING) / (sum(totals) + SMOOTHING * len(totals))) for t in totals]


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, digest, n_rows, tokens, p0, p1, ...): one row for each id and text; digest is the text's hash."""
    weights, priors = word_weights(docs, labels, fit_rows)
    words = words_of(F.col("text"))
    base = docs.select("doc_id", F.xxhash64("text").alias("digest"), words.alias("words"))
    # the empty word carries the row itself: the priors, and the number of all words
    each = base.select("doc_id", "digest", F.size("words").alias("size"), F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("word"))
    keyed = each.select("doc_id", "digest", F.when(F.col("word") == "", F.col("size")).alias("size"), F.xxhash64("word").alias("word"))
    bias = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("word"), *(F.lit(p).alias(f"w{k}") for k, p in enumerate(priors)))
    met = keyed.join(F.broadcast(weights.union(bias)), "word")
    ks = range(len(DOMAINS))
    summed = met.groupBy("doc_id", "digest").agg(
        F.count("size").alias("n_rows"), F.max("size").alias("size"), *(F.sum(f"w{k}").alias(f"e{k}") for k in ks)
    )
    evidence = [F.col(f"e{k}") / F.col("n_rows") for k in ks]
    top = F.greatest(*evidence)
    odds = [F.exp(e - top) for e in evidence]
    tokens = (F.col("size") * F.col("n_rows")).cast("double")
    return summed.select("doc_id", "digest", "n_rows", tokens.alias("tokens"), *((o / add(odds)).alias(f"p{k}") for k, o in enumerate(odds)))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, fit_rows: int = FIT_ROWS, multiples: dict[str, float] | None = None) -> DataFrame:
    """The table of `posteriors` with `rate`. `multiples` gives targets as parts of the tokens at hand instead of weights."""
    weights = WEIGHTS if weights is None else weights
    total = sum(weights.get(d, 0.0) for d in DOMAINS)
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be nonnegative and not all zero")
    shares = [weights.get(d, 0.0) / total for d in DOMAINS]
    ks = range(len(DOMAINS))
    now = materialise(posteriors(docs, labels, fit_rows).withColumn("rate", F.lit(1.0)), "mixing")
    sums = [F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)).alias(f"s{k}") for k in ks]
    row = now.agg(*sums).first()
    at_hand = [max(row[f"s{k}"], 1e-9) for k in ks]
    if sum(row) == 0:
        return now
    if multiples is not None:
        parts = [a * multiples.get(d, 0.0) for a, d in zip(at_hand, DOMAINS)]
        budget, shares = sum(parts), [p / sum(parts) for p in parts]
    if budget is None:
        budget = min(a / s for a, s in zip(at_hand, shares) if s > 0)
    targets = [s * budget for s in shares]
    written, last = 0, None
    for number in range(1, MAX_ROUNDS + 1):
        gap = [row[f"s{k}"] - t for k, t in zip(ks, targets)]
        loss = sum(g * g / a for g, a in zip(gap, at_hand))
        if max(map(abs, gap)) <= TOLERANCE * budget or (last is not None and loss >= last * (1 - 1e-6)):
            break
        last = loss
        slope = add([F.col(f"p{k}") * (g / a) for k, g, a in zip(ks, gap, at_hand)])
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))
        if number - written >= ROUNDS_A_WRITE:
            now, written = materialise(now, "mixing"), number
        row = now.agg(*sums).first()
    return now


def copies_of(rate: Column, key: Column) -> Column:
    """How often a document is taken: `rate` in expectation, drawn by a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


def resample(docs: DataFrame, labels: DataFrame, **targets) -> DataFrame:
    """The documents, each taken as often as its rate says. Rows with a null id are taken once.

    Columns of any name come back as they are.
    """
    rates = mix(docs.select("doc_id", "text"), labels, **targets).where("doc_id is not null").select(F.col("doc_id").alias("id"), "digest", "rate")
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # no name can clash
    key, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    joined = plain.join(rates, (key == F.col("id")) & (F.xxhash64(text) == F.col("digest")), "left")
    taken = F.coalesce(copies_of(F.col("rate"), key), F.lit(1))
    copies = joined.where(taken > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), taken)))
    return copies.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
