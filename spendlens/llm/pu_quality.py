"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents marked good) and unlabelled text (every document, its label unseen)
fit a linear model of text statistics by minimising the non-negative unbiased risk
  prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])
with the logistic loss, for which loss(g) - loss(-g) = -g, so that the risk inside the bound is
convex and Newton steps settle it in a few passes. The class prior is estimated first: a classifier
of positives against unlabelled ranks the texts, and the prior is the smallest ratio, over the top
parts of the ranking, of the unlabelled share to the positive share (with a margin for chance).
Every pass sums over all documents in Spark; the driver sees sums of fixed size only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import stored

#: Statistics of a text of this many bytes count half as far from the mean as those of a very long one.
HALF_BYTES = 150
PASSES_PRIOR, PASSES_RISK = 8, 14
#: Pull of the weights to zero, and what is added to it over the number of positives.
RIDGE, RIDGE_FEW = 1e-3, 2.0
#: Parts of the score range in the histograms of the prior's estimate.
BINS = 1000
#: Bytes compressed at a time.
PIECE = 1 << 20
#: Partial sums left for the driver, whatever the number of tasks.
PARTIALS = 8

_KIND = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_c.islower() and _b < 128, _c.isupper() and _b < 128, _c.isdigit() and _b < 128, _c in " \t\r\x0b\x0c", _c == "\n",
                 _c in ".,;:?'\"-", _b < 128 and _c.isprintable() and not _c.isalnum() and _c not in " .,;:?'\"-", _b >= 128]
_VOWELS = np.isin(np.arange(256), list(b"aeiouAEIOU")).astype(float)
_TAIL = re.compile(r"[^\w\s.,;:?'\")\]-][^\w\s]*(?=\s|$)")


def packed_bytes(raw: np.ndarray) -> int:
    """Size of all bytes when compressed, which go through in pieces and are not kept."""
    packer = zlib.compressobj(1)
    return sum(len(packer.compress(raw[at:at + PIECE])) for at in range(0, len(raw), PIECE)) + len(packer.flush())


def statistics(text: str) -> np.ndarray:
    """What the model knows of a text; all zeros, but for a mark of emptiness, when it has no words."""
    out = np.zeros(WIDTH)
    words = text.split()
    if not words:
        out[0] = 1
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    share = kinds @ _KIND / len(raw)
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct, most = len(counts), max(counts.values())
    same = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1e-9, share[0] + share[1])
    tails = len(_TAIL.findall(text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[1:21] = [
        np.log1p(n), np.log(distinct + 1) / np.log(n + 1), most / n, (most / n) ** 0.5, same / max(1, n - 1), (same / max(1, n - 1)) ** 0.5,
        upper / n, (upper / n) ** 0.5, alpha / n, tails / n, (tails / n) ** 0.5, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        np.log((pairs + 1) / n + 1), np.log(len(raw) / n), np.log(max(map(len, words))), share[1] / letters, kinds @ _VOWELS / len(raw) / letters,
        (share[6] * 10) ** 0.5, packed_bytes(raw) / len(raw) if len(raw) > 200 else 0.5]
    out[21:29] = share
    # far from usual text in one way is enough: marks that a sum of small differences can't outweigh
    out[29:35] = [upper / n > 0.4, same / max(1, n - 1) > 0.3, tails / n > 0.3, alpha / n < 0.35, most / n > 0.3 and n > 20, share[6] > 0.05]
    out[35] = len(raw) / (len(raw) + HALF_BYTES)
    return out


WIDTH = 36


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts]).reshape(-1, WIDTH)


@dataclass
class Model:
    """A linear model of standardised statistics; ``weights`` end with the constant."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -5, 5) * np.where(x[:, :1] > 0, 1, x[:, -1:])
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.weights)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def feature_table(docs: DataFrame, positives: DataFrame, key: str, text: str) -> DataFrame:
    """(key, positive boolean, fold 0 or 1, x array<float>) for every row, written to the shared folder."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.text_slices(batch, "text"):
                x = matrix(part.column("text").to_pylist()).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    trusted = positives.select(F.col(f"`{key}`").alias("key")).where("key is not null").distinct().withColumn("positive", F.lit(True))
    return stored(rows.mapInArrow(known, f"key {kind}, x array<float>").join(trusted, "key", "left")
                  .select("key", F.coalesce("positive", F.lit(False)).alias("positive"), F.pmod(F.xxhash64("key"), F.lit(2)).alias("fold"), "x"),
                  "statistics")


def _total(table: DataFrame, part, size: int) -> np.ndarray:
    """The sum of ``part(x, positive, fold)``, a vector of ``size``, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)
                total += part(x, batch.column("positive").to_numpy(zero_copy_only=False).astype(bool), batch.column("fold").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = table.select("positive", "fold", "x").mapInArrow(partial, "v binary").repartition(PARTIALS).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r.v) for r in sums), np.zeros(size))


def _solve(hessian: np.ndarray, gradient: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(hessian + ridge * np.eye(len(gradient)), gradient)


def estimate_prior(table: DataFrame, model: Model, n_pos: float, n_all: float, ridge: float) -> float:
    """The share of positives among all texts, from classifiers of positives against all.

    Two models are fitted in the same passes, each on one half of the rows; each ranks the other
    half, so that what a model remembers of its own positives does not lower the estimate.
    """
    d = WIDTH + 1
    models, moved = [model, model], 1.0
    for _ in range(PASSES_PRIOR):
        def part(x, positive, fold, models=tuple(models)):
            out = []
            for k, m in enumerate(models):
                z, own = m.inputs(x[fold == k]), positive[fold == k]
                p = sigmoid(z @ m.weights)
                h = p * (1 - p)
                # each text counts as unlabelled, a positive once more as positive; both sides weigh the same
                zp, pp, hp = z[own], p[own], h[own]
                g = z.T @ p / n_all - zp.T @ (1 - pp) / n_pos
                out += [2 * g, 2 * ((z * h[:, None]).T @ z / n_all + (zp * hp[:, None]).T @ zp / n_pos).ravel()]
            return np.concatenate(out)

        got = _total(table, part, 2 * (d + d * d)).reshape(2, -1)
        moved = 0.0
        for k, m in enumerate(models):
            step = _solve(got[k, d:].reshape(d, d), got[k, :d] + ridge * m.weights, ridge)
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            models[k], moved = Model(m.center, m.scale, m.weights - step, 0), max(moved, np.abs(step).max())
        if moved < 1e-3:
            break

    def histogram(x, positive, fold, models=tuple(models)):
        out = np.zeros((2, BINS))
        for k, m in enumerate(models):
            at = np.minimum((m.score(x[fold != k]) * BINS).astype(int), BINS - 1)
            out[0] += np.bincount(at, minlength=BINS)
            out[1] += np.bincount(at[positive[fold != k]], minlength=BINS)
        return out.ravel()

    counts = _total(table, histogram, 2 * BINS)
    above_all, above_pos = (np.cumsum(c[::-1]) for c in (counts[:BINS], counts[BINS:]))
    margin = np.sqrt(np.log(40) / 2) * (n_all ** -0.5 + n_pos ** -0.5)
    enough = above_pos >= max(1, 0.2 * n_pos)
    bound = (above_all / n_all + margin) / np.maximum(above_pos / n_pos, 1e-12)
    best = int(np.argmin(np.where(enough, bound, np.inf)))
    return float(np.clip(above_all[best] / n_all / (above_pos[best] / n_pos), 0.01, 0.99))


def fit(table: DataFrame) -> Model:
    """The model of a :func:`feature_table`; without positives one that scores every text 1."""
    first = _total(table, lambda x, positive, fold: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), positive.sum()]]), 2 * WIDTH + 2)
    n_all, n_pos = first[-2:]
    start = np.zeros(WIDTH + 1)
    if not n_pos:
        start[-1] = 500
        return Model(np.zeros(WIDTH), np.ones(WIDTH), start, 1.0)
    center = first[:WIDTH] / n_all
    scale = np.sqrt(np.maximum(first[WIDTH:2 * WIDTH] / n_all - center ** 2, 0))
    scale[scale < 1e-6] = 1
    model = Model(center, scale, start, 0)
    ridge = RIDGE + RIDGE_FEW / n_pos
    prior = estimate_prior(table, model, n_pos, n_all, ridge)
    start = start.copy()
    start[-1] = np.log(prior / (1 - prior))
    model, d = Model(center, scale, start, prior), WIDTH + 1
    for _ in range(PASSES_RISK):
        def part(x, positive, fold, m=model):
            z = m.inputs(x)
            g = z @ m.weights
            p = sigmoid(g)
            zp, gp = z[positive], g[positive]
            return np.concatenate([
                z.T @ p / n_all, zp.sum(0) / n_pos, zp.T @ sigmoid(gp) / n_pos, [loss(-g).sum() / n_all, loss(-gp).sum() / n_pos],
                ((z * (p * (1 - p))[:, None]).T @ z / n_all).ravel()])

        got = _total(table, part, 3 * d + 2 + d * d)
        unlabelled, positive, positive_as_negative = got[:d], got[d:2 * d], got[2 * d:3 * d]
        negative_risk = got[3 * d] - prior * got[3 * d + 1]
        hessian = got[3 * d + 2:].reshape(d, d)
        if negative_risk < 0:  # the bound holds: climb back until the estimate is not negative
            step = -0.5 * _solve(hessian, unlabelled - prior * positive_as_negative, ridge)
        else:
            step = _solve(hessian, unlabelled - prior * positive + ridge * model.weights, ridge)
        step *= min(1.0, 2.0 / np.abs(step).max()) if step.any() else 1
        model = Model(center, scale, model.weights - step, prior)
        if np.abs(step).max() < 1e-3:
            break
    return model


def trusted_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the trusted positives: quality 1, and crc32(key as text) mod 4 not 2 (those rows are held out)."""
    return labels.where((F.col("quality") == 1) & (held_out(F.col(key)) == F.lit(False))).select(key)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, for tables with any other columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix([t if isinstance(t, str) else "" for t in texts])))

    return score(text)


def quality_scores(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, prior) for every row: the chance that the text is good, and the estimated class prior.

    positives holds the keys of trusted positives. Null, empty and blank texts score like a text
    without words. Repeated and null keys each keep their row; rows with a null key are unlabelled.
    No documents: no rows. No positives: nothing can be learnt and every score is 1. Other columns
    are not read.
    """
    table = feature_table(docs, positives, key, text)
    model = fit(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(x))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return table.select("key", "x").mapInArrow(score, f"key {kind}, score double") \
        .select(F.col("key").alias(key), "score", F.lit(model.prior).alias("prior"))


def fitted(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model alone, for :func:`score_column`."""
    return fit(feature_table(docs, positives, key, text))
