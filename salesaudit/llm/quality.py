"""A quality classifier from positives and unlabelled text: the non-negative unbiased risk is minimised."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.shared import ROW, numbered, saved, whole_text

# Bytes whose share of a text is a feature of its own or as a class.
MARKS = tuple(b".,!?|:;-'\"") + tuple(b"$#%&*@=<>/\\")
STEPS = 12
RIDGE = 1e-3
SCORE_BINS = 1000
LEAST_TAIL = 0.1  # of the positives that a tail must hold for the class prior to be read from it

Batches = Iterator[pd.DataFrame]


def features(text: str) -> np.ndarray:
    """What a text looks like, whatever its language: shares of kinds of characters, repetition, lengths."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256) / max(1, len(data))
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n_words = max(1, len(words))
    runs = set(zip(words, words[1:], words[2:], strict=False))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(not word[-1].isalnum() for word in words)
    capital = sum(word[0].isupper() for word in words)
    letters = sum(map(len, words))
    shares = [
        counts[65:91].sum(),
        counts[48:58].sum(),
        counts[128:].sum(),
        counts[:9].sum() + counts[14:32].sum() + counts[127],
        counts[list(MARKS[10:])].sum(),
        *counts[list(MARKS[:10])],
        1 - len(set(words)) / n_words,
        1 - len(runs) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        again / n_words,
        marked / n_words,
        capital / n_words,
    ]
    lengths = [np.log1p(len(words)), np.log1p(len(lines)), np.log1p(letters / n_words), np.log1p(max(map(len, words), default=0))]
    found = np.sqrt(np.maximum(np.array(shares), 0))
    return np.concatenate(([1.0], found, found * found, lengths)).astype(np.float32)


WIDTH = len(features(""))


def _described(texts: pd.Series) -> pd.Series:
    return pd.Series([features(text).tobytes() for text in texts])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sums(rows: DataFrame, summed: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (x, positive) of a vector that each task sums up for its own."""

    def task(batches: Batches) -> Batches:
        total = np.zeros(size)
        for batch in batches:
            total += summed(_matrix(batch["x"]), batch["positive"].to_numpy(bool))
        yield pd.DataFrame({"place": np.arange(size), "value": total})

    sums = rows.select("x", "positive").mapInPandas(task, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(size)
    for row in sums.collect():  # one number per place of the vector
        found[row["place"]] = row["value"]
    return found


class Model:
    """Weights over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, np.zeros(WIDTH)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights


def _standardised(rows: DataFrame) -> tuple[Model, float, float]:
    """A model without weights, the number of positives and of unlabelled rows."""

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return np.concatenate(([positive.sum(), (~positive).sum()], x.sum(axis=0), (x * x).sum(axis=0)))

    sums = _sums(rows, moments, 2 + 2 * WIDTH)
    n = max(1.0, sums[0] + sums[1])
    mean = sums[2 : 2 + WIDTH] / n
    scale = np.sqrt(np.maximum(sums[2 + WIDTH :] / n - mean * mean, 1e-8))
    mean[0], scale[0] = 0.0, 1.0
    return Model(mean, scale), sums[0], sums[1]


def _curvature(z: np.ndarray, p: np.ndarray, weight: float) -> np.ndarray:
    return (z * (weight * p * (1 - p))[:, None]).T @ z


def fit(rows: DataFrame, model: Model, positives: float, unlabelled: float, prior: float | None) -> None:
    """Sets the model's weights by Newton steps, each one pass over all ``rows``.

    With a class prior the logistic non-negative unbiased risk is minimised:
    prior * E_P loss(f) + max(0, E_U loss(-f) - prior * E_P loss(-f)). While the
    part in max() is below 0, a step goes up that part instead. Without a prior
    positives are told from unlabelled rows, both weighing the same.
    """
    square = WIDTH * WIDTH

    def parts(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = model.standard(x)
        f = z @ model.weights
        p = 1 / (1 + np.exp(-f))
        own, rest = z[positive], z[~positive]
        p_own, p_rest = p[positive], p[~positive]
        return np.concatenate(
            (
                own.sum(axis=0),
                (own * p_own[:, None]).sum(axis=0),
                (rest * p_rest[:, None]).sum(axis=0),
                _curvature(own, p_own, 1.0).ravel(),
                _curvature(rest, p_rest, 1.0).ravel(),
                [_soft(f[positive]).sum(), _soft(f[~positive]).sum()],
            )
        )

    for _ in range(STEPS):
        sums = _sums(rows, parts, 3 * WIDTH + 2 * square + 2)
        mean_p, up_p, up_u = (sums[i * WIDTH : (i + 1) * WIDTH] / n for i, n in enumerate((positives, positives, unlabelled)))
        bend_p, bend_u = (
            sums[3 * WIDTH + i * square : 3 * WIDTH + (i + 1) * square].reshape(WIDTH, WIDTH) / n
            for i, n in enumerate((positives, unlabelled))
        )
        loss_p, loss_u = sums[-2] / positives, sums[-1] / unlabelled
        if prior is None:
            slope, bend = up_u + up_p - mean_p, bend_u + bend_p
        elif loss_u - prior * loss_p >= 0:
            # loss(f) - loss(-f) = -f for the logistic loss, so the risk is linear in the positives.
            slope, bend = up_u - prior * mean_p, bend_u
        else:
            slope, bend = -(up_u - prior * up_p), bend_u + prior * bend_p
        slope = slope + RIDGE * model.weights
        step = np.linalg.solve(bend + RIDGE * np.eye(WIDTH), slope)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-4:
            break


def estimated_prior(rows: DataFrame, model: Model, positives: float, unlabelled: float) -> float:
    """The share of positives among unlabelled rows.

    In each tail of the model's scores the unlabelled rows hold at least the
    prior times what the positives hold; the smallest ratio over all tails, with
    two standard errors as allowance, bounds the prior from above.
    """

    def bins(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((SCORE_BINS / (1 + np.exp(-model.margin(x)))).astype(int), SCORE_BINS - 1)
        return np.concatenate([np.bincount(at[kind], minlength=SCORE_BINS) for kind in (positive, ~positive)])

    sums = _sums(rows, bins, 2 * SCORE_BINS)
    tail_p = np.cumsum(sums[:SCORE_BINS][::-1]) / positives
    tail_u = np.cumsum(sums[SCORE_BINS:][::-1]) / unlabelled
    enough = tail_p >= LEAST_TAIL
    error = np.sqrt(tail_u * (1 - np.minimum(tail_u, 1)) / unlabelled) + np.sqrt(tail_p * (1 - np.minimum(tail_p, 1)) / positives)
    ratio = (tail_u[enough] + 2 * error[enough]) / tail_p[enough]
    return float(np.clip(ratio.min(), 0.01, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per row of ``docs``: row, doc_id, score, predicted, prior.

    Trusted positives are rows where ``learn`` holds and the label is 1, the
    unlabelled ones those where it holds and no label is known. Labels of 0 are
    not used: which share of the unlabelled rows is good is estimated. The model
    is linear in features of the whole text; every learning row enters each
    pass, as sums that the tasks make, and only sums reach the driver.

    An id with several labels takes the highest; a row without id has none. NULL
    texts are empty and get a score like any other. If there are no positives or
    no unlabelled rows, every score is 0.5.
    """
    known = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label).alias("label")).filter("label IS NOT NULL")
    described = F.pandas_udf(_described, "binary")(whole_text(text)).alias("x")
    rows = numbered(docs, F.col(id_column).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), described)
    described = saved(rows, "features")
    learning = described.filter("learn").join(known, "doc_id", "left")
    learning = saved(
        learning.filter("label IS NULL OR label = 1").select("x", F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive")), "learning"
    )
    model, positives, unlabelled = _standardised(learning)
    prior = 0.5
    if positives and unlabelled:
        fit(learning, model, positives, unlabelled, None)
        prior = estimated_prior(learning, model, positives, unlabelled)
        model.weights = np.zeros(WIDTH)
        fit(learning, model, positives, unlabelled, prior)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-model.margin(_matrix(x)))))

    found = described.select(ROW, "doc_id", scored("x").alias("score"))
    return found.select(ROW, "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("prior"))
