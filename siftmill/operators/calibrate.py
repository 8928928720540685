"""Temperature scaling and model inference over logits tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scoring import log_softmax, softmax
from siftmill.operators.lineage import cut

LOGITS = ["logit_safe", "logit_dangerous", "logit_unsure"]
GOLD_CLASS = {"benign": 0, "dangerous": 1, "ambiguous": 2}


def nll_grid(df: DataFrame, temperatures: list[float]) -> DataFrame:
    """Mean negative log-likelihood at every temperature, in one job: (t, nll)."""
    rows = df.select(*LOGITS, "y").withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    return rows.groupBy("t").agg(F.avg(-log_softmax([F.col(c) / F.col("t") for c in LOGITS], F.col("y"))).alias("nll"))


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 33, rounds: int = 4) -> float:
    """Bounded minimum over log T by a grid that narrows each round; one job a round."""
    a, b = log(low), log(high)
    best = 0.0
    for _ in range(rounds):
        grid = np.linspace(a, b, points)
        rows = nll_grid(df, [exp(x) for x in grid]).collect()
        best = log(min(rows, key=lambda r: (r["nll"], r["t"]))["t"])
        step = (b - a) / (points - 1)
        a, b = max(log(low), best - step), min(log(high), best + step)
    return exp(best)


def probabilities(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    p = softmax([F.col(c) / F.lit(float(temperature)) for c in LOGITS])
    return df.withColumns({"p_safe": p[0], "p_dangerous": p[1], "p_unsure": p[2]})


def infer_logits(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(id, logits) from a model loaded once per worker: ``load()`` gives texts -> (n, 3)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = np.asarray(model(part["text"].tolist()), float)
                if got.shape != (len(part), 3):
                    raise ValueError(f"the model gave {got.shape} for {len(part)} texts")
                yield pd.DataFrame({"id": part["id"], **{c: got[:, k] for k, c in enumerate(LOGITS)}})

    return df.select("id", "text").mapInPandas(run, "id string, logit_safe double, logit_dangerous double, logit_unsure double")


#: The regularisation weights that are tried.
C_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


class _Descent:
    """Limited-memory BFGS for one of several functions that are evaluated together: ``asks`` is
    the point to evaluate next, ``told`` takes its value and gradient."""

    def __init__(self, size: int, memory: int = 12):
        self.x, self.f, self.g = np.zeros(size), np.inf, np.zeros(size)
        self.way, self.step, self.memory = np.zeros(size), 1.0, memory
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = False

    def asks(self) -> np.ndarray:
        return self.x + self.step * self.way

    def told(self, f: float, g: np.ndarray, tolerance: float) -> None:
        if self.done:
            return
        if not f <= self.f + 1e-4 * self.step * (self.g @ self.way):
            self.step /= 2
            self.done = self.step < 1e-12
            return
        moved, turned = self.step * self.way, g - self.g
        if np.isfinite(self.f) and moved @ turned > 1e-12:
            self.pairs = [*self.pairs, (moved, turned)][-self.memory :]
        self.x, self.f, self.g = self.x + moved, f, g
        self.done = np.abs(g).max() <= tolerance
        way, kept = -g, []
        for s, y in reversed(self.pairs):
            kept.append((s @ way) / (s @ y))
            way = way - kept[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), k in zip(self.pairs, reversed(kept)):
            way = way + (k - (y @ way) / (s @ y)) * s
        self.way = way
        self.step = 1.0 if self.pairs else 1.0 / max(1.0, np.linalg.norm(g))


def _summed(rows: DataFrame, points: np.ndarray, gradients: bool, shards: int = 16) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Losses, their gradients and the rows' number at several weight matrices (point, class,
    feature; the last is the intercept), in one pass over ``rows`` (features, target). Each
    task sums its own rows; sums are added up in ``shards`` tasks before the driver."""
    n_points, classes, width = points.shape
    size = n_points * classes * width if gradients else 0

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, grad, n = np.zeros(n_points), np.zeros((n_points, classes, width)), 0
        for pdf in frames:
            if pdf.empty:
                continue
            x = np.stack(pdf["features"]).astype(float)
            x, t = np.column_stack([x, np.ones(len(x))]), np.stack(pdf["target"]).astype(float)
            n += len(x)
            for k, w in enumerate(points):
                z = x @ w.T
                z -= z.max(axis=1, keepdims=True)
                logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
                loss[k] -= (t * logp).sum()
                if gradients:
                    grad[k] += (np.exp(logp) * t.sum(axis=1, keepdims=True) - t).T @ x
        yield pd.DataFrame({"made": [np.concatenate([[float(n)], loss, grad.ravel()[:size]])]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"made": [np.stack(pdf["made"]).sum(0)]})

    parts = rows.mapInPandas(partial, "made array<double>").withColumn("shard", F.spark_partition_id() % shards)
    got = np.sum([r["made"] for r in parts.groupBy("shard").applyInPandas(lambda pdf: added(pdf), "made array<double>").collect()], axis=0)
    return got[1 : 1 + n_points], got[1 + n_points :].reshape(points.shape) if gradients else None, float(got[0])


def _fitted(rows: DataFrame, grid: tuple[float, ...], classes: int, width: int, rounds: int, tolerance: float) -> np.ndarray:
    """Weights (C, class, feature) that minimise C * loss + |w|^2 / 2, intercepts free, for every C
    of the grid in lockstep: a round is one pass over the rows."""
    runs = [_Descent(classes * width) for _ in grid]
    free = np.ones((classes, width))
    free[:, -1] = 0
    for _ in range(rounds):
        points = np.stack([r.asks() for r in runs]).reshape(len(grid), classes, width)
        loss, grad, n = _summed(rows, points, True)
        for run, c, w, f, g in zip(runs, grid, points, loss, grad):
            run.told(c * f + ((w * free) ** 2).sum() / 2, (c * g + w * free).ravel(), tolerance * max(1.0, c * n))
        if all(r.done for r in runs):
            break
    return np.stack([r.x for r in runs]).reshape(len(grid), classes, width)


def train_linear(df: DataFrame, features: str = "embedding", target: str = "target", grid: tuple[float, ...] = C_GRID, dev: str = "is_dev", rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float, dict[float, float]]:
    """Multinomial logistic regression on dense vectors with soft targets (an array of class
    weights): of all values of C, fitted together on the rows outside the dev fold, that of
    the least mean dev loss, fitted again on all rows. Returns (weights per class with
    the intercept last, chosen C, dev loss of each C)."""
    rows = cut(df.select(F.col(features).cast("array<double>").alias("features"), F.col(target).cast("array<double>").alias("target"), F.col(dev).alias("dev")))
    first = rows.select(F.size("features").alias("d"), F.size("target").alias("k")).first()
    if first is None:
        raise ValueError("no rows to train on")
    width, classes = first["d"] + 1, first["k"]
    weights = _fitted(rows.where("not dev").drop("dev"), grid, classes, width, rounds, tolerance)
    loss, _, n = _summed(rows.where("dev").drop("dev"), weights, False)
    losses = {c: float(f / max(n, 1)) for c, f in zip(grid, loss)}
    best = min(grid, key=lambda c: (losses[c], c))
    return _fitted(rows.drop("dev"), (best,), classes, width, rounds, tolerance)[0], best, losses


def linear_logits(df: DataFrame, weights: np.ndarray, features: str = "embedding") -> DataFrame:
    """``df`` plus the logits of a linear model, as plain expressions."""

    def dot(w: np.ndarray) -> Column:
        each = F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(x)) for x in w[:-1]]), lambda a, b: a * b)
        return F.aggregate(each, F.lit(float(w[-1])), lambda s, v: s + v)

    return df.withColumns({name: dot(w) for name, w in zip(LOGITS, weights)})
