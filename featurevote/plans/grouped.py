"""Logistic regressions of many batches, folds and penalties at once, one scan for each Newton step.

Rows belong to parts (batches or folds) and a model learns from some of the parts. Every step sums, for
all models in one pass, the gradient and the weighted outer products of the rows; each task adds up its
own rows first and sends one small matrix for each model. A model's next weights are solved in a task
of its own. The driver holds weights only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.functions.labels import stable_batch
from featurevote.functions.vectors import linear_score
from featurevote.operators.ranking import auc_roc
from featurevote.values import CV_FOLDS


@dataclass(frozen=True)
class PartModel:
    """A model to fit: its name, the parts that it learns from, its L2 penalty."""

    name: str
    parts: frozenset
    reg_param: float


@dataclass(frozen=True)
class Fitted:
    """A fitted model; ``weights`` are the intercept, then the coefficients."""

    model: PartModel
    weights: np.ndarray
    n_rows: int = 0
    gradient: float = float("inf")  # the largest part of the penalized loss's gradient
    steps: int = 0
    # For the search: penalty of each weight, the weights before the last step and their loss.
    penalties: np.ndarray | None = field(default=None, repr=False)
    before: np.ndarray | None = field(default=None, repr=False)
    loss: float = field(default=float("inf"), repr=False)

    @property
    def intercept(self) -> float:
        return float(self.weights[0])

    @property
    def coefficients(self) -> list[float]:
        return [float(w) for w in self.weights[1:]]


def batch_models(batches: Sequence, reg_params: Sequence[float]) -> list[PartModel]:
    """One model for each batch and penalty, learning from that batch alone."""
    return [PartModel(f"batch_{b}_reg_{r:g}", frozenset([b]), r) for b in batches for r in reg_params]


def fold_models(folds: int, reg_params: Sequence[float]) -> list[PartModel]:
    """One model for each fold and penalty, learning from all other folds."""
    every = frozenset(range(folds))
    return [PartModel(f"fold_{f}_reg_{r:g}", every - {f}, r) for f in range(folds) for r in reg_params]


def _sums(rows: DataFrame, width: int, fits: Sequence[Fitted]) -> DataFrame:
    """(model, line, sums): for each model the outer products' lines, then a line with the gradient, the
    loss and the number of rows. One scan; each task sends its totals."""
    learners = [(m, f.model.parts, f.weights) for m, f in enumerate(fits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = np.empty((batch.num_rows, width + 1))
            x[:, 0], x[:, 1:] = 1.0, values.reshape(batch.num_rows, width)
            y = batch.column(2).to_numpy(zero_copy_only=False)
            part = np.array(batch.column(0).to_pylist())
            for m, parts, weights in learners:
                mine = np.isin(part, list(parts))
                if not mine.any():
                    continue
                xm, ym = x[mine], y[mine]
                z = xm @ weights
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                total = totals.setdefault(m, np.zeros((width + 2, width + 3)))
                total[:-1, :-2] += xm.T @ (xm * (p * (1 - p))[:, None])
                total[-1, :-2] += xm.T @ (p - ym)
                total[-1, -2] += np.sum(np.logaddexp(0.0, z) - ym * z)
                total[-1, -1] += len(ym)
        for m, total in totals.items():
            lines = pa.array(total.reshape(-1))
            offsets = pa.array(np.arange(0, total.size + 1, width + 3, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(width + 2, m, dtype=np.int32)),
                    pa.array(np.arange(width + 2, dtype=np.int32)),
                    pa.ListArray.from_arrays(offsets, lines),
                ],
                names=["model", "line", "sums"],
            )

    partial = rows.mapInArrow(run, "model int, line int, sums array<double>")
    summed = partial.groupBy("model", "line").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return summed.select("model", "line", vector_to_array("sums").alias("sums"))


def _next(fit: Fitted, lines: np.ndarray, standardize: bool) -> Fitted:
    """One Newton step from the sums at the present weights, or half a step back if the loss has grown."""
    outer, slope = lines[:-1, :-2], lines[-1, :-2]
    loss_sum, n = lines[-1, -2], lines[-1, -1]
    if fit.penalties is None:
        # At weights of zero every row weighs a quarter, so the same sums hold the features' variances.
        scale = np.ones(len(slope))
        if standardize:
            mean, square = 4 * outer[0] / n, 4 * np.diag(outer) / n
            scale = np.maximum(square - mean**2, 0.0) * n / max(n - 1, 1)
        penalties = fit.model.reg_param * scale
        penalties[0] = 0.0
        fit = replace(fit, penalties=penalties)
    w, pen = fit.weights, fit.penalties
    loss = loss_sum / n + 0.5 * float(pen @ (w * w))
    gradient = slope / n + pen * w
    size = float(np.max(np.abs(gradient)))
    if fit.before is not None and loss > fit.loss + 1e-12 * abs(fit.loss):
        return replace(fit, weights=(w + fit.before) / 2, gradient=float("inf"), steps=fit.steps + 1, n_rows=int(n))
    curvature = outer / n + np.diag(pen)
    # Least squares, as a feature without any spread leaves the matrix singular.
    step = np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]
    return replace(
        fit, weights=w - step, before=w, loss=loss, gradient=size, steps=fit.steps + 1, n_rows=int(n)
    )


def fit_grid(
    rows: DataFrame,
    models: Sequence[PartModel],
    part: str | Column = "batch",
    features: str = "features",
    label: str = "label",
    standardize: bool = True,
    tol: float = 1e-9,
    max_steps: int = 50,
) -> list[Fitted]:
    """All models, fitted to the minimum of mean log loss + reg_param / 2 * sum of squared coefficients.

    ``standardize`` measures coefficients in deviations of their features over the model's rows, as
    MLlib does by default. Features are arrays of one width, without missing values; labels are 0 and 1.
    A model is done when no part of its gradient exceeds ``tol``; done models leave the scan. One that
    is not done after ``max_steps`` scans raises an error, as do models without rows.

    Each scan sends a matrix of (width + 1) squared numbers for each model and task, so this is for up to
    some hundred features; for wider ones use ``train.fit_per_batch``. Read ``rows`` from a written table.
    """
    part_col = F.col(part) if isinstance(part, str) else part
    slim = rows.select(
        part_col.alias("part"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")
    )
    first = slim.select(F.size("x").alias("width")).first()
    if first is None:
        raise ValueError("there are no rows to learn from")
    width = first["width"]
    fits = [Fitted(m, np.zeros(width + 1)) for m in models]
    for _ in range(max_steps):
        open_ = [i for i, f in enumerate(fits) if f.gradient > tol]
        if not open_:
            return fits
        asked = [fits[i] for i in open_]
        for i, fit in zip(open_, _stepped(_sums(slim, width, asked), asked, standardize)):
            if fit is None:
                raise ValueError(f"{fits[i].model.name} has no rows to learn from")
            # The gradient is that of the weights before the step; keep those once they are good enough.
            fits[i] = replace(fit, weights=fit.before) if fit.gradient <= tol else fit
    late = [f.model.name for f in fits if f.gradient > tol]
    if late:
        raise ValueError(f"not at the minimum after {max_steps} steps: {late}")
    return fits


def _stepped(sums: DataFrame, fits: Sequence[Fitted], standardize: bool) -> list[Fitted | None]:
    """The models after one step, each solved in a task; what comes back is as long as the weights."""
    known = dict(enumerate(fits))

    def solve(key, lines):
        ordered = np.array(lines.sort_values("line")["sums"].tolist())
        fit = _next(known[key[0]], ordered, standardize)
        none = None if fit.before is None else fit.before.tolist()
        return pd.DataFrame(
            {
                "model": [key[0]], "n": [fit.n_rows], "gradient": [fit.gradient], "loss": [fit.loss],
                "weights": [fit.weights.tolist()], "penalties": [fit.penalties.tolist()], "before": [none],
            }
        )

    schema = (
        "model int, n bigint, gradient double, loss double, "
        "weights array<double>, penalties array<double>, before array<double>"
    )
    found: list[Fitted | None] = [None] * len(fits)
    for r in sums.groupBy("model").applyInPandas(solve, schema).collect():
        fit = fits[r["model"]]
        found[r["model"]] = replace(
            fit,
            weights=np.array(r["weights"]),
            n_rows=r["n"],
            gradient=r["gradient"],
            loss=r["loss"],
            steps=fit.steps + 1,
            penalties=np.array(r["penalties"]),
            before=None if r["before"] is None else np.array(r["before"]),
        )
    return found


def weight_rows(spark: SparkSession, fits: Sequence[Fitted]) -> DataFrame:
    """(model, reg_param, n_rows, position, weight) of all models; position 0 is the intercept."""
    rows = [
        (f.model.name, f.model.reg_param, f.n_rows, i, float(w)) for f in fits for i, w in enumerate(f.weights)
    ]
    return spark.createDataFrame(rows, "model string, reg_param double, n_rows bigint, position int, weight double")


def score_grid(
    rows: DataFrame, fits: Sequence[Fitted], keep: Sequence[str], part: str, features: str = "features", own: bool = False
) -> DataFrame:
    """(keep..., model, reg_param, score): every row by the models that did not learn from its part (or,
    with ``own``, that did), in one scan."""
    cells = [
        F.when(
            F.col(part).isin(list(f.model.parts)) if own else ~F.col(part).isin(list(f.model.parts)),
            F.struct(
                F.lit(f.model.name).alias("model"),
                F.lit(f.model.reg_param).alias("reg_param"),
                linear_score(F.col(features), f.coefficients, f.intercept).alias("score"),
            ),
        )
        for f in fits
    ]
    asked = F.filter(F.array(*cells), lambda cell: cell.isNotNull())
    return rows.select(*keep, F.inline(asked))


def cross_validate_grid(
    rows: DataFrame,
    key: str,
    reg_params: Sequence[float] = (0.01, 0.1),
    folds: int = CV_FOLDS,
    features: str = "features",
    label: str = "label",
) -> DataFrame:
    """(reg_param, mean_auc): for each penalty the mean over the folds of the AUC on the fold left out.

    All folds and penalties are fitted together, and all rows left out are scored and ranked together.
    Folds follow from the key, so reruns agree.
    """
    folded = rows.withColumn("fold", stable_batch(F.col(key), folds, first=0))
    fits = fit_grid(folded, fold_models(folds, reg_params), "fold", features, label)
    scored = score_grid(folded, fits, [label], "fold", features)
    by_model = auc_roc(scored, label=label, by=["model", "reg_param"])
    return by_model.groupBy("reg_param").agg(F.avg("auc_roc").alias("mean_auc"))
