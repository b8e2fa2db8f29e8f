"""Least squares and logistic fits from sums of products: one aggregate a pass, solved by elimination over arrays inside the plan.

Features are standardised by their mean and population deviation. The sums over rows of all products of two features are the upper
triangle of a small symmetric matrix; they are one row, which an expression turns into the solution. Only that row's numbers, as many
as there are features, pass through the driver. Several noisy observations of one row of features need no rows of their own: a row
stands for ``levels`` observations and holds their sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.session import cut_lineage


@dataclass(frozen=True)
class Fitted:
    """Weights of the features as plain numbers, so that scoring is column arithmetic and no model goes into a plan."""

    weights: dict[str, float]
    intercept: float
    steps: list[tuple[int, float, float]] = field(default_factory=list)  # of an iterated fit: step, greatest slope, loss

    def margin(self) -> Column:
        return sum((F.col(f).cast("double") * w for f, w in self.weights.items()), start=F.lit(self.intercept))


@dataclass(frozen=True)
class Moments:
    rows: int
    mean: list[float]
    spread: list[float]

    def standardised(self, features: list[str]) -> list[Column]:
        """Columns z0, z1, ...; a feature that does not vary is 0."""
        return [
            ((F.col(f).cast("double") - m) / s if s else F.lit(0.0)).alias(f"z{k}")
            for k, (f, m, s) in enumerate(zip(features, self.mean, self.spread, strict=True))
        ]

    def fitted(self, features: list[str], weights: list[float], intercept: float, steps: list | None = None) -> Fitted:
        """The same plane over the features as they are."""
        plain = [w / s if s else 0.0 for w, s in zip(weights, self.spread, strict=True)]
        shift = sum(w * m for w, m in zip(plain, self.mean, strict=True))
        return Fitted(dict(zip(features, plain, strict=True)), intercept - shift, steps or [])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def moments(rows: DataFrame, features: list[str], *sums: str) -> tuple[Moments, list[float]]:
    """Moments of the features, and the sums of further columns."""
    columns = [F.col(f).cast("double") for f in features]
    row = rows.agg(
        F.count(F.lit(1)), F.array(*[F.avg(c) for c in columns]), F.array(*[F.stddev_pop(c) for c in columns]), *[F.sum(s) for s in sums]
    ).first()
    known = [x or 0.0 for x in row[1]], [x or 0.0 for x in row[2]]
    return Moments(row[0], *known), [x or 0.0 for x in row[3:]]


AT_ONCE = 80  # sums of one aggregate; one of more than a hundred columns is no compiled code


def packed_sums(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """One row with the array ``sums``: of h zi zj for all i <= j, of zi g for all i, and of further expressions."""
    entries = [f"h*z{i}*z{j}" for i in range(size) for j in range(i, size)] + [f"z{i}*g" for i in range(size)] + list(more)
    parts = None
    for k in range(0, len(entries), AT_ONCE):
        own = ",".join(f"sum({e})" for e in entries[k : k + AT_ONCE])
        part = rows.agg(F.expr(f"named_struct('at', {k}, 's', array({own}))").alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.flatten(F.sort_array(F.collect_list("part"))["s"]).alias("sums"))  # a few parts


def equations(sums: Column, size: int, penalty: list[float], pull: list[float]) -> Column:
    """The rows of the system: sums of products with the penalty on the diagonal, and the right-hand side less the pull."""
    last = size * (size + 1) // 2

    def place(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return (low * size - F.floor(low * (low - 1) / 2) + high - low).cast("int")

    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    on, off = F.lit(penalty), F.lit(pull)
    return F.transform(numbers, lambda i: F.concat(
        F.transform(numbers, lambda j: F.get(sums, place(i, j)) + F.when(i == j, F.get(on, i)).otherwise(0.0)),
        F.array(F.get(sums, (i + last).cast("int")) - F.get(off, i)),
    ))


def solution(matrix: Column, size: int) -> Column:
    """Solution of a positive definite system by elimination: each step of the fold clears one column of all other rows."""

    def cleared(rows: Column, k: Column) -> Column:
        pivot = F.transform(F.get(rows, k), lambda x: x / F.get(F.get(rows, k), k))
        return let(pivot, lambda own: F.transform(rows, lambda row, i: F.when(i == k, own).otherwise(
            F.zip_with(row, own, lambda x, y: x - F.get(row, k) * y)
        )))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, cleared)
    return F.transform(solved, lambda row: F.get(row, F.lit(size)))


def ridge(rows: DataFrame, features: list[str], label: str, alpha: float, levels: int = 1) -> Fitted:
    """Least squares on standardised features with ``alpha`` on the diagonal and a free intercept; ``label`` is the sum of a row's levels.

    The features have mean 0, so the intercept is the label's mean and not part of the system.
    """
    scale, (total,) = moments(rows, features, label)
    if not scale.rows:
        return Fitted(dict.fromkeys(features, 0.0), 0.0)
    mean, size = total / (levels * scale.rows), len(features)
    held = rows.select(*scale.standardised(features), (F.col(label) - mean * levels).alias("g"), F.lit(float(levels)).alias("h"))
    weights = packed_sums(held, size).select(solution(equations(F.col("sums"), size, [alpha] * size, [0.0] * size), size)).first()[0]
    return scale.fitted(features, weights, mean)


def logistic(rows: DataFrame, features: list[str], label: str, alpha: float, levels: int = 1, iterations: int = 30, tolerance: float = 1e-11) -> Fitted:
    """Logistic fit with a penalty of ``alpha`` / 2 times the squared weights of the standardised features, by Newton steps.

    Each pass is one aggregate at the current weights: slopes, curvature and loss. A step that raised the loss is halved; the fit ends
    where no slope exceeds ``tolerance`` for each observation. ``label`` counts a row's levels that are true. One that has not ended after
    ``iterations`` passes is an error.
    """
    scale, (true,) = moments(rows, features, label)
    total, size = levels * scale.rows, len(features) + 1
    if not total or true in (0, total):
        share = min(max(true / max(total, 1), 1e-6), 1 - 1e-6)
        return Fitted(dict.fromkeys(features, 0.0), _log_odds(share))
    held = cut_lineage(rows.select(
        *scale.standardised(features), F.lit(1.0).alias(f"z{size - 1}"), F.col(label).cast("double").alias("y")
    ))
    penalty, steps = [alpha] * len(features) + [0.0], []
    weights, loss, move = [0.0] * len(features) + [_log_odds(true / total)], float("inf"), [0.0] * size
    margin = "+".join(f"z{k}*w[{k}]" for k in range(size))
    for step in range(1, iterations + 1):
        # the weights are one array value, so the code of a pass is that of the first
        seen = held.withColumn("w", F.lit(weights)).withColumn("m", F.expr(margin)).withColumn("p", F.expr("1D/(exp(-m)+1D)"))
        seen = seen.withColumn("h", F.expr(f"p*(1D-p)*{levels}")).withColumn("g", F.expr(f"y-p*{levels}"))
        # log(1 + e^m) without overflow
        sums = packed_sums(seen, size, f"(greatest(m, 0D)+log1p(exp(-abs(m))))*{levels}-m*y")
        pull = [p * w for p, w in zip(penalty, weights, strict=True)]
        row = sums.select(
            solution(equations(F.col("sums"), size, penalty, pull), size).alias("move"), F.get("sums", F.size("sums") - 1).alias("loss"),
            F.slice("sums", -1 - size, size).alias("slopes"),
        ).first()
        now = row["loss"] + sum(p * w * w for p, w in zip(penalty, weights, strict=True)) / 2
        slope = max(abs(g - p) for g, p in zip(row["slopes"], pull, strict=True))
        steps.append((step, slope, now))
        if slope <= tolerance * total:
            return scale.fitted(features, weights[:-1], weights[-1], steps)
        if now > loss * (1 + 1e-12):
            move = [m / 2 for m in move]
            weights = [w - m for w, m in zip(weights, move, strict=True)]
            continue
        loss, move = now, row["move"]
        weights = [w + m for w, m in zip(weights, move, strict=True)]
    raise ValueError(f"the logistic fit has not converged after {iterations} passes")


def _log_odds(share: float) -> float:
    return math.log(share / (1 - share))
