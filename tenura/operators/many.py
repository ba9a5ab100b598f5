"""Many logistic models from the same rows: one pass over the data for each Newton step of all of them.

Cross-validation, a penalty search and a drop-column test fit the same kind of model again and again on
overlapping rows. Here a model is a training part (all rows, or all but one fold), class weights, a
penalty and a set of columns; a task adds up loss, gradient and Gram matrix of every model over its rows,
one grouped sum adds the tasks, and the driver solves systems of the number of slots. What reaches the
driver is models x slots^2 numbers, whatever the number of rows.

Preprocessing is that of each training part (medians, means, sample deviations), applied inside the pass; a
label that a training part lacks has a slot of zeros there, so its coefficient stays 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.text import normalise
from tenura.sources.files import materialise

MOST_SLOTS = 1_000  # a Gram matrix is dense; beyond this a label column needs another encoding
CELLS = 1 << 22  # values held at once while a batch is added up


@dataclass(frozen=True)
class Part:
    """Training rows: those whose `fold` column is not `value`; all rows without a column."""

    fold: str | None = None
    value: int = -1

    def holds(self) -> Column:
        return F.lit(True) if self.fold is None else F.col(self.fold) != self.value


@dataclass(frozen=True)
class Spec:
    """One model: inverse penalty `c`, classes weighted to equal mass or not, or positives counted as often as it
    takes to match the negatives; whether the intercept is moved back to the base rate; source columns left out."""

    part: Part
    c: float = 1.0
    balanced: bool = True
    replicated: bool = False
    corrected: bool = True
    without: frozenset[str] = frozenset()
    name: str = ""


@dataclass
class Encoded:
    """Written rows: key, y, folds, x (numbers, NaN where missing), codes (numbers of labels, -1 unknown)."""

    rows: DataFrame
    key: str
    folds: list[str]
    numeric: list[str]
    levels: list[tuple[str, str]]
    starts: list[int] = field(default_factory=list)
    scales: dict[Part, Scale] = field(default_factory=dict)  # of the parts met so far

    @property
    def names(self) -> list[tuple[str, str | None]]:
        return [(c, None) for c in self.numeric] + list(self.levels)

    @property
    def slots(self) -> int:
        return len(self.numeric) + len(self.levels)


@dataclass
class Model:
    spec: Spec
    coefficients: np.ndarray
    intercept: float
    correction: float
    steps: int


@dataclass
class Scale:
    """Preprocessing of a training part."""

    n: float
    positives: float
    median: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def matrix(self, x: np.ndarray, codes: np.ndarray, encoded_starts: Sequence[int], slots: int) -> np.ndarray:
        out = np.zeros((len(x), slots + 1))
        d = x.shape[1]
        filled = np.where(np.isnan(x), self.median, x) - self.mean
        np.divide(filled, self.deviation, out=out[:, :d], where=self.deviation > 0)
        for j, start in enumerate(encoded_starts):
            known = np.flatnonzero(codes[:, j] >= 0)
            out[known, start + codes[known, j]] = 1.0
        out[:, slots] = 1.0
        return out


def encode(
    df: DataFrame, label: str, key: str, numeric: Sequence[str], categorical: Sequence[str], folds: Sequence[str] = ()
) -> Encoded:
    """Write the rows once, with labels as numbers; at most MOST_SLOTS slots."""
    room = MOST_SLOTS - len(numeric)
    levels: list[tuple[str, str]] = []
    starts, codes = [], []
    text = {c: F.coalesce(normalise(F.col(c)), F.lit("inconnu")) for c in categorical}
    for c in categorical:
        found = sorted(r[0] for r in df.select(text[c].alias("v")).distinct().limit(room - len(levels) + 1).collect())
        if len(levels) + len(found) > room:
            raise ValueError(f"{c}: more than {MOST_SLOTS} slots; encode this column otherwise")
        starts.append(len(numeric) + len(levels))
        levels += [(c, v) for v in found]
        at = F.array_position(F.array(*[F.lit(v) for v in found]), text[c]) if found else F.lit(0)
        codes.append((at - 1).cast("int"))
    rows = df.select(
        F.col(key).alias("key"), F.col(label).cast("double").alias("y"), *folds,
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in numeric]).cast("array<double>").alias("x"),
        F.array(*codes).cast("array<int>").alias("codes"),
    ).where(F.col("y").isNotNull())
    return Encoded(materialise(rows, "encoded"), key, list(folds), list(numeric), levels, starts)


def _arrays(batch: pa.RecordBatch, encoded: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy().reshape(n, len(encoded.numeric))
    codes = batch.column("codes").flatten().to_numpy().reshape(n, len(encoded.starts))
    return x, codes, batch.column("y").to_numpy(), {c: batch.column(c).to_numpy() for c in encoded.folds}


def _inside(part: Part, folds: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.ones(n, bool) if part.fold is None else folds[part.fold] != part.value


def _summed(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """Sum of `partial`'s vectors by number, added in tasks first."""
    sums = rows.mapInArrow(partial, "number int, v array<double>").groupBy("number")
    total = vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    return {r["number"]: np.array(r["v"]) for r in sums.agg(total).collect()}


def _emitted(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for number, v in sums.items():  # one vector at a time: a row has slots^2 numbers
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["number", "v"])


def _light(encoded: Encoded) -> Encoded:
    """What tasks need: everything but the DataFrame."""
    return Encoded(None, encoded.key, encoded.folds, encoded.numeric, encoded.levels, encoded.starts)


def scales(encoded: Encoded, parts: Sequence[Part]) -> dict[Part, Scale]:
    """Preprocessing of every training part; what fits and scores have in common is worked out once."""
    new = [part for part in dict.fromkeys(parts) if part not in encoded.scales]
    if new:
        encoded.scales |= _scales(encoded, new)
    return {part: encoded.scales[part] for part in parts}


def _scales(encoded: Encoded, parts: Sequence[Part]) -> dict[Part, Scale]:
    """Medians of every training part in one aggregate, then means and deviations in one pass."""
    d = len(encoded.numeric)
    wanted = []
    for i, part in enumerate(parts):
        wanted += [F.count_if(part.holds()).alias(f"n{i}"), F.sum(F.when(part.holds(), F.col("y"))).alias(f"p{i}")]
        for j in range(d):
            value = F.when(part.holds() & ~F.isnan(F.col("x")[j]), F.col("x")[j])
            wanted.append(F.percentile_approx(value, 0.5, 10_000).alias(f"m{i}_{j}"))
    row = encoded.rows.agg(*wanted).first()
    medians = {part: np.array([row[f"m{i}_{j}"] or 0.0 for j in range(d)]) for i, part in enumerate(parts)}
    light = _light(encoded)

    def partial(batches):
        sums = {i: np.zeros(2 * d) for i in range(len(parts))}
        for batch in batches:
            x, _, _, folds = _arrays(batch, light)
            for i, part in enumerate(parts):
                away = np.nan_to_num(x[_inside(part, folds, len(x))] - medians[part])  # a missing value is the median
                sums[i][:d] += away.sum(axis=0)
                sums[i][d:] += (away * away).sum(axis=0)
        yield from _emitted(sums)

    moments = _summed(encoded.rows, partial) if d else {}
    out = {}
    for i, part in enumerate(parts):
        n, positives = float(row[f"n{i}"] or 0), float(row[f"p{i}"] or 0)
        s1, s2 = (moments[i][:d], moments[i][d:]) if i in moments else (np.zeros(d), np.zeros(d))
        shift = s1 / max(n, 1.0)
        spread = np.sqrt(np.maximum(s2 - n * shift * shift, 0.0) / max(n - 1.0, 1.0))
        out[part] = Scale(n, positives, medians[part], medians[part] + shift, spread)
    return out


def _weights(spec: Spec, scale: Scale) -> tuple[float, float, float]:
    """Weights of positive and negative rows, and what balancing adds to the intercept."""
    if scale.positives in (0.0, scale.n):
        raise ValueError("a classifier needs rows of both classes in every training part")
    if spec.replicated:
        return max(1.0, float(round((scale.n - scale.positives) / scale.positives))), 1.0, 0.0
    if not spec.balanced:
        return 1.0, 1.0, 0.0
    w1, w0 = scale.n / (2.0 * scale.positives), scale.n / (2.0 * (scale.n - scale.positives))
    return w1, w0, math.log(w1 / w0) if spec.corrected else 0.0


def fit(encoded: Encoded, specs: Sequence[Spec], tolerance: float = 1e-8, most_steps: int = 60) -> list[Model]:
    """Ridge-penalised logistic regressions of all `specs`, by Newton steps that share their passes."""
    parts = list(dict.fromkeys(s.part for s in specs))
    scaled = scales(encoded, parts)
    slots, light = encoded.slots, _light(encoded)
    size = slots + 1
    weights = [_weights(s, scaled[s.part]) for s in specs]
    free = [np.array([i for i, (c, _) in enumerate(encoded.names) if c not in s.without] + [slots]) for s in specs]
    penalty = np.append(np.ones(slots), 0.0)
    beta = [np.zeros(size) for _ in specs]
    step = [np.zeros(size) for _ in specs]
    best = [math.inf] * len(specs)
    taken = [0] * len(specs)
    live = set(range(len(specs)))
    by_part = {part: [m for m, s in enumerate(specs) if s.part == part] for part in parts}

    def sums_of(now: dict[int, np.ndarray]):
        def partial(batches):
            sums = {m: np.zeros(1 + size + size * size) for m in now}
            for whole in batches:
                rows = max(1, CELLS // size)
                for a in range(0, whole.num_rows, rows):
                    x, codes, y, folds = _arrays(whole.slice(a, rows), light)
                    for part in parts:
                        wanted = [m for m in by_part[part] if m in now]
                        if not wanted:
                            continue
                        inside = _inside(part, folds, len(x))
                        z, t = scaled[part].matrix(x[inside], codes[inside], light.starts, slots), y[inside]
                        for m in wanted:
                            eta = z @ now[m]
                            w = np.where(t > 0, weights[m][0], weights[m][1])
                            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                            own = sums[m]
                            own[0] += (w * (np.logaddexp(0.0, eta) - t * eta)).sum()
                            own[1 : 1 + size] += z.T @ (w * (t - p))
                            own[1 + size :] += (z.T @ (z * (w * p * (1.0 - p))[:, None])).ravel()
            yield from _emitted(sums)

        return partial

    for _ in range(most_steps):
        if not live:
            break
        found = _summed(encoded.rows, sums_of({m: beta[m] for m in live}))
        for m in sorted(live):
            ridge = penalty / specs[m].c
            loss = found[m][0] + 0.5 * (ridge * beta[m] ** 2).sum()
            if loss > best[m] + 1e-9 * abs(best[m]):  # too far: half the step back
                step[m] /= 2.0
                beta[m] = beta[m] - step[m]
                continue
            best[m] = loss
            taken[m] += 1
            gradient = found[m][1 : 1 + size] - ridge * beta[m]
            curve = found[m][1 + size :].reshape(size, size) + np.diag(ridge)
            own = free[m]
            move = np.zeros(size)
            move[own] = np.linalg.lstsq(curve[np.ix_(own, own)], gradient[own], rcond=None)[0]
            step[m] = move
            beta[m] = beta[m] + move
            if np.abs(move).max() < tolerance:
                live.discard(m)
    if live:
        raise RuntimeError(f"{len(live)} models did not settle in {most_steps} steps")
    return [Model(s, beta[m][:slots], float(beta[m][slots]), weights[m][2], taken[m]) for m, s in enumerate(specs)]


def held_out_scores(encoded: Encoded, models: Sequence[Model]) -> DataFrame:
    """(modele, repetition, pli, key, y, p): each row by every model whose training part leaves it out.

    `repetition` is the place of the fold column; p has the intercept moved back to the base rate.
    """
    parts = list(dict.fromkeys(m.spec.part for m in models))
    scaled, light, slots = scales(encoded, parts), _light(encoded), encoded.slots
    kinds = dict(encoded.rows.dtypes)

    def run(batches):
        for whole in batches:
            rows = max(1, CELLS // (slots + 1))
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                x, codes, y, folds = _arrays(batch, light)
                for part in parts:
                    held = np.flatnonzero(~_inside(part, folds, len(x)))
                    if not len(held):
                        continue
                    z = scaled[part].matrix(x[held], codes[held], light.starts, slots)
                    key = batch.column("key").take(pa.array(held))
                    for m in models:
                        if m.spec.part != part:
                            continue
                        eta = z @ np.append(m.coefficients, m.intercept) - m.correction
                        n = len(held)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([m.spec.name] * n), pa.array(np.full(n, light.folds.index(part.fold), np.int32)),
                                pa.array(np.full(n, part.value, np.int32)), key, pa.array(y[held].astype(np.int32)),
                                pa.array(1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))),
                            ],
                            ["modele", "repetition", "pli", "key", "y", "p"],
                        )

    return encoded.rows.mapInArrow(run, f"modele string, repetition int, pli int, key {kinds['key']}, y int, p double")


def fold_specs(folds: Sequence[str], n_folds: int, **options) -> list[Spec]:
    """One model for each fold of each repetition."""
    return [Spec(Part(f, i), **options) for f in folds for i in range(n_folds)]
