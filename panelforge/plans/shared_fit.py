"""Logistic regressions of many conditions over shared passes.

Newton's method for all conditions at once: a pass over the data gives, for every condition that
hasn't converged, the gradient and the curvature of its weighted log-loss as one block of
(features + 1) x (features + 2) numbers; rows without a label of a condition are masked there.  Tasks
emit one block a condition, blocks are added in a tree, and the driver solves the small systems.  So an
iteration is one scan whatever the number of conditions, and about ten of them do.

Features are scaled per condition with the moments of its own training rows, and classes have
balanced weights, as in a fit of one condition alone; the coefficients are equal to its.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import SplitSpec
from ..operators.columns import complete_cases
from ..operators.split import split_column
from ..session import cut_lineage

FAN_IN = 64
ROWS = 4096      # rows a task multiplies at once


@dataclass
class Fitted:
    """Per condition: feature names, moments, coefficients over scaled features and intercept."""
    feats: list[str]
    targets: list[str]
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    iterations: int
    spec: SplitSpec


def _rows(df: DataFrame, feats: list[str], targets: list[str], spec: SplitSpec, side: str) -> DataFrame:
    """(id, wave, x, y) of complete cases of one side; y holds NULL for missing labels."""
    d = complete_cases(df, feats).filter(split_column(spec=spec) == side)
    return d.select("id", "wave", F.array(*[F.col(c).cast("double") for c in feats]).alias("x"),
                    F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))


def _matrices(batch: pa.RecordBatch, feats: int, targets: int):
    def matrix(name, width):
        c = batch.column(name)
        off = c.offsets.to_numpy()
        return c.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).reshape(-1, width)
    x, y = matrix("x", feats), matrix("y", targets)
    for a in range(0, len(x), ROWS):
        yield x[a:a + ROWS], y[a:a + ROWS]


def _summed(rows: DataFrame, make, feats: int, targets: int, tree: bool) -> dict[int, np.ndarray]:
    """Blocks that ``make(x, y)`` yields as (condition, block), added up over the table by condition, in groups
    of ``FAN_IN`` tasks first if ``tree``."""

    def run(batches):
        from pyspark import TaskContext
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for x, y in _matrices(b, feats, targets):
                for t, block in make(x, y):
                    total[t] = total.get(t, 0.0) + block
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.int32()),
                                          pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in total.values()], pa.binary())],
                                         names=["part", "t", "block"])

    def add(pdf):
        pdf = pdf.sort_values("part")      # always added in the same order
        block = sum(np.frombuffer(b, np.float64) for b in pdf["block"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "t": [int(pdf["t"].iloc[0])], "block": [block.tobytes()]})

    schema = "part int, t int, block binary"
    made = rows.select("x", "y").mapInArrow(run, schema)
    if tree:
        made = made.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part", "t").applyInPandas(add, schema)
    got: dict[int, np.ndarray] = {}
    for r in sorted(made.collect(), key=lambda r: (r["t"], r["part"])):     # a block a condition and 64 tasks
        got[r["t"]] = got.get(r["t"], 0.0) + np.frombuffer(r["block"], np.float64)
    return got


def fit_conditions(df: DataFrame, feats: list[str], targets: list[str], spec: SplitSpec = SplitSpec(), max_iter: int = 50,
                   tol: float = 1e-8) -> Fitted:
    """Coefficients of all conditions from complete cases of the training waves.  A condition without
    training rows is an error; one with a single class gets its base rate.  ``max_iter`` bounds the passes; where classes can
    be parted, coefficients grow until the loss falls no more."""
    feats = list(dict.fromkeys(feats))
    rows = cut_lineage(_rows(df, feats, targets, spec, "train"), "conditions")
    tasks = rows.select(F.spark_partition_id().alias("part")).distinct().count()
    if not tasks:
        raise ValueError(f"no training rows in waves {spec.train[0]}-{spec.train[1]}")
    k, m = len(feats), len(targets)
    shape = k, m, tasks > FAN_IN

    def moments(x, y):
        for t in range(m):
            own = ~np.isnan(y[:, t])
            z = x[own]
            yield t, np.concatenate([[own.sum(), (y[own, t] == 1).sum()], z.sum(0)])

    sums = _summed(rows, moments, *shape)
    none = [targets[t] for t in range(m) if not sums[t][0]]
    if none:
        raise ValueError(f"no training rows for {none}")
    n, pos = (np.array([sums[t][i] for t in range(m)]) for i in (0, 1))
    mean = np.stack([sums[t][2:] / n[t] for t in range(m)])

    def spread(x, y):     # about the mean, as sums of squares lose digits
        for t in range(m):
            yield t, ((x[~np.isnan(y[:, t])] - mean[t]) ** 2).sum(0)

    around = _summed(rows, spread, *shape)
    std = np.stack([np.sqrt(around[t] / n[t]) for t in range(m)])
    std[std == 0] = 1.0
    mixed = (pos > 0) & (pos < n)
    one, zero = n / (2 * np.maximum(pos, 1)), n / (2 * np.maximum(n - pos, 1))
    beta = np.zeros((m, k + 1))                       # the intercept last
    beta[~mixed, k] = np.where(pos[~mixed] > 0, 30.0, -30.0)
    active, before, best = set(np.nonzero(mixed)[0].tolist()), np.full(m, np.inf), beta.copy()
    passes = 0
    step = np.zeros_like(beta)
    while active and passes < max_iter:
        now, at = beta.copy(), sorted(active)

        def newton(x, y):
            for t in at:
                own = ~np.isnan(y[:, t])
                z = np.column_stack([(x[own] - mean[t]) / std[t], np.ones(own.sum())])
                u, label = z @ now[t], y[own, t] == 1
                p, w = 1 / (1 + np.exp(-np.clip(u, -500, 500))), np.where(label, one[t], zero[t])
                loss = (w * (np.logaddexp(0, u) - label * u)).sum()
                yield t, np.concatenate([[loss], z.T @ (w * (p - label)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

        blocks = _summed(rows, newton, *shape)
        passes += 1
        for t in at:
            loss, grad, curve = blocks[t][0] / n[t], blocks[t][1:k + 2] / n[t], blocks[t][k + 2:].reshape(k + 1, k + 1) / n[t]
            if not loss <= before[t] + 1e-12:         # too far: half the step
                step[t] /= 2
                beta[t] = best[t] - step[t]
                if np.abs(step[t]).max() < 1e-10:
                    beta[t] = best[t]
                    active.discard(t)
                continue
            fell, before[t], best[t] = before[t] - loss, loss, beta[t].copy()
            if np.abs(grad).max() < tol or fell < 1e-12:
                active.discard(t)
                continue
            step[t] = np.linalg.lstsq(curve + 1e-12 * np.eye(k + 1), grad, rcond=None)[0]
            beta[t] = best[t] - step[t]
    beta = best
    return Fitted(feats, list(targets), mean, std, beta[:, :k], beta[:, k], passes, spec)


def score_conditions(df: DataFrame, fitted: Fitted) -> DataFrame:
    """(task, id, wave, label, prob) of the labelled validation rows of every condition, in one pass."""
    rows = _rows(df, fitted.feats, fitted.targets, fitted.spec, "val")
    names, k, m = fitted.targets, len(fitted.feats), len(fitted.targets)
    schema = df.select(F.lit("").alias("task"), "id", "wave", F.lit(0).alias("label"), F.lit(0.0).alias("prob")).schema

    def run(batches):
        for b in batches:
            first = 0
            for x, y in _matrices(b, k, m):
                for t in range(m):
                    own = np.nonzero(~np.isnan(y[:, t]))[0]
                    u = ((x[own] - fitted.mean[t]) / fitted.std[t]) @ fitted.coef[t] + fitted.intercept[t]
                    at = pa.array(own + first)
                    yield pa.RecordBatch.from_arrays([pa.array([names[t]] * len(own), pa.string()), b.column("id").take(at), b.column("wave").take(at),
                                                      pa.array(y[own, t].astype(np.int32)), pa.array(1 / (1 + np.exp(-np.clip(u, -500, 500))))],
                                                     names=["task", "id", "wave", "label", "prob"])
                first += len(x)

    return rows.mapInArrow(run, schema)
