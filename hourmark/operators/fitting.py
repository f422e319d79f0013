"""Models fitted from sums: every scan yields the sums of all folds, the driver solves small systems.

A fold's sums taken off the total are the sums of all other folds, so one scan
fits every leave-one-fold-out model at once. Linear models need a single
scan (Gram matrices by built-in aggregates). Huber and quantile models
reweight rows by the current fit; each iteration is one scan that sums gradient
and curvature per fold in NumPy blocks inside the tasks. What reaches the driver
is fixed by the number of folds, features and levels, never by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.session import ship_package

#: Rows of a block in a task.
BLOCK_ROWS = 8192
#: The fold number of a model that sees every row.
ALL = -1


def scan_sums(df: DataFrame, columns: Sequence[str], sums: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Element-wise total of ``sums(block)`` over all blocks of rows; ``block`` has a column per name.

    Tasks add up their blocks and hand on one vector each; rows with a null or NaN are left out.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            block = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(batch.num_columns)])
            block = block[~np.isnan(block).any(axis=1)]
            for k in range(0, len(block), BLOCK_ROWS):
                total += sums(block[k : k + BLOCK_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "part array<double>")
    rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(length)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


@dataclass(frozen=True)
class LinearFit:
    """Intercept and coefficients, the rows they come from and the residual sum of squares."""

    features: tuple[str, ...]
    values: tuple[float, ...]
    rows: int
    rss: float

    def column(self) -> Column:
        parts = [F.lit(v) * F.col(f) for f, v in zip(self.features, self.values[1:], strict=True)]
        return reduce(lambda a, b: a + b, parts, F.lit(self.values[0]))


def fold_sums(df: DataFrame, fold: str | None, features: Sequence[str], label: str) -> dict[int, np.ndarray]:
    """Per fold the matrix of sums of products of (1, features, label): one aggregation for all folds.

    Rows with a null among them are left out. Each fold adds one row on the driver.
    """
    names = [*features, label]
    complete = df.dropna(subset=names)
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    key = F.lit(ALL) if fold is None else F.col(fold)
    rows = complete.groupBy(key.cast("int").alias("fold")).agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    found = {}
    for r in rows:
        m = np.zeros((len(terms), len(terms)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        found[r["fold"]] = m
    return found


def solve_sums(sums: np.ndarray, features: Sequence[str], ridge: float = 0.0) -> LinearFit:
    """Least squares from a matrix of sums; collinear features share their effect (least norm), scaled and centred first."""
    n = sums[0, 0]
    if n <= 0:
        return LinearFit(tuple(features), (math.nan,) * (len(features) + 1), 0, math.nan)
    means = sums[0, 1:] / n
    centred = sums[1:, 1:] - n * np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centred), 0))
    flat = scale <= 1e-12 * np.sqrt(np.maximum(np.diag(sums)[1:], 1e-300))
    unit = np.where(flat, 1.0, scale)
    c = centred / np.outer(unit, unit)
    c[flat, :] = c[:, flat] = 0.0
    inner = c[:-1, :-1] + ridge * np.eye(len(features))
    b = np.linalg.pinv(inner, rcond=1e-11, hermitian=True) @ c[:-1, -1] * unit[-1] / unit[:-1]
    b[flat[:-1]] = 0.0
    rss = float(centred[-1, -1] - 2 * b @ centred[:-1, -1] + b @ centred[:-1, :-1] @ b)
    return LinearFit(tuple(features), (float(means[-1] - b @ means[:-1]), *map(float, b)), int(n), max(0.0, rss))


def leave_one_out_fits(sums: Mapping[int, np.ndarray], features: Sequence[str], ridge: float = 0.0) -> dict[int, LinearFit]:
    """Per fold the fit on all other folds: the total less the fold's own sums."""
    total = sum(sums.values())
    return {k: solve_sums(total - own, features, ridge) for k, own in sums.items()}


def predicted(df: DataFrame, fits: Mapping[int, LinearFit], fold: str | None, out: str) -> DataFrame:
    """Each row by the model of its fold, as a plain column expression; null where a feature or the model is missing."""
    if fold is None:
        return df.withColumn(out, fits[ALL].column())
    value = F.lit(None).cast("double")
    for k, fit in fits.items():
        value = F.when((F.col(fold) == k) & F.lit(fit.rows > 0), fit.column()).otherwise(value)
    return df.withColumn(out, value)


def cross_fit_linear(df: DataFrame, fold: str, features: Sequence[str], label: str, out: str = "prediction", ridge: float = 0.0) -> DataFrame:
    """Out-of-fold predictions of least squares for all folds from one scan and one shuffle."""
    return predicted(df, leave_one_out_fits(fold_sums(df, fold, features, label), features, ridge), fold, out)


def huber_fits(
    df: DataFrame, fold: str | None, features: Sequence[str], label: str, epsilon: float = 1.35, iterations: int = 50, tolerance: float = 1e-9
) -> dict[int, LinearFit]:
    """Iteratively reweighted least squares under Huber loss, all leave-one-fold-out models per scan.

    The loss turns linear at ``epsilon`` times the residual deviation of the plain fit on the same rows.
    """
    sums = fold_sums(df, fold, features, label)
    fits = leave_one_out_fits(sums, features) if fold is not None else {k: solve_sums(s, features) for k, s in sums.items()}
    models = [k for k in sorted(fits) if fits[k].rows > 0]
    if not models:
        return fits
    width = len(features) + 2
    delta = {k: epsilon * math.sqrt(fits[k].rss / fits[k].rows) for k in models}
    columns = [*features, label, *([fold] if fold is not None else [])]
    for _ in range(iterations):
        now = {k: np.array(fits[k].values) for k in models}

        def weighted(block: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(block)), block[:, : width - 1]])
            out = []
            for k in models:
                own = x if fold is None else x[block[:, width - 1] != k]
                r = np.abs(own[:, -1] - own[:, :-1] @ now[k])
                w = np.minimum(1.0, delta[k] / np.maximum(r, 1e-300))
                out.append((own * w[:, None]).T @ own)
            return np.concatenate([m.ravel() for m in out])

        parts = scan_sums(df, columns, weighted, len(models) * width * width).reshape(len(models), width, width)
        moved = 0.0
        for k, m in zip(models, parts, strict=True):
            fit = solve_sums(m, features)
            fits[k] = LinearFit(fit.features, fit.values, fits[k].rows, fits[k].rss)
            moved = max(moved, float(np.max(np.abs(np.array(fit.values) - now[k]) / (1e-12 + np.abs(now[k]).max()))))
        if moved < tolerance:
            break
    return fits


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass(frozen=True)
class QuantileFits:
    """Linear median and positive steps away from it per level: quantiles cannot cross.

    ``weights[k]`` has a row per level over (1, standardised features) for the
    model that never saw fold ``k``; ``centre`` and ``scale`` end with the label's.
    """

    features: tuple[str, ...]
    levels: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: Mapping[int, np.ndarray]
    losses: tuple[float, ...]

    def columns(self, fold: str | None) -> Column:
        """An array of the levels' quantiles in rising order, as a column expression; null where a feature or the model is missing."""
        x = F.array(F.lit(1.0), *[(F.col(f) - F.lit(c)) / F.lit(s) for f, c, s in zip(self.features, self.centre, self.scale)])
        model = F.lit(None).cast("array<array<double>>")
        for k, w in self.weights.items():
            own = F.array(*[F.array(*map(F.lit, map(float, row))) for row in w])
            model = own if fold is None else F.when(F.col(fold) == k, own).otherwise(model)
        middle = len(self.levels) // 2
        z = F.transform(model, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        soft = F.transform(z, lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))
        median = F.array(F.get(z, F.lit(middle)))
        walk = lambda steps, sign: F.aggregate(steps, median, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + sign * v)))
        above = walk(F.slice(soft, middle + 2, len(self.levels)), 1.0)
        below = walk(F.reverse(F.slice(soft, 1, middle)), -1.0)
        whole = F.concat(F.reverse(F.slice(below, 2, len(self.levels))), above)
        known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in self.features], F.lit(True))
        return F.when(known, F.transform(whole, lambda v: F.lit(self.centre[-1]) + F.lit(self.scale[-1]) * v))


def _smoothed_sums(block: np.ndarray, weights: np.ndarray, levels: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Gauss-Newton curvature of the smoothed pinball loss; ``block`` is (1, features, label)."""
    x, y = block[:, :-1], block[:, -1]
    n_levels, p = weights.shape
    middle = n_levels // 2
    z = x @ weights.T
    soft, slope = _softplus(z), 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    q = np.empty_like(z)
    q[:, middle] = z[:, middle]
    for j in range(middle + 1, n_levels):
        q[:, j] = q[:, j - 1] + soft[:, j]
    for j in range(middle - 1, -1, -1):
        q[:, j] = q[:, j + 1] - soft[:, j]
    u = y[:, None] - q
    inside = np.abs(u) < width
    loss = np.where(u >= 0, levels * u, (levels - 1) * u)
    loss = np.where(inside, levels * u + (width - u) ** 2 / (4 * width), loss)
    pull = -np.where(inside, levels - (width - u) / (2 * width), np.where(u > 0, levels, levels - 1))
    bend = inside / (2 * width)
    # how level k moves with the weights of level j
    reach = np.zeros((n_levels, n_levels))
    reach[:, middle] = 1
    for j in range(n_levels):
        reach[j:, j] = 1 if j > middle else reach[j:, j]
        reach[: j + 1, j] = -1 if j < middle else reach[: j + 1, j]
    own = slope.copy()
    own[:, middle] = 1
    gradient = ((pull @ reach) * own).T @ x
    curvature = np.empty((n_levels, p, n_levels, p))
    for a in range(n_levels):
        for b in range(a, n_levels):
            both = reach[:, a] * reach[:, b]
            part = np.zeros((p, p))
            if both.any():
                w = (bend @ both) * own[:, a] * own[:, b]
                part = (x * w[:, None]).T @ x
            curvature[a, :, b, :] = part
            curvature[b, :, a, :] = part.T
    return float(loss.sum()), gradient, curvature.reshape(n_levels * p, n_levels * p)


def quantile_fits(
    df: DataFrame, fold: str | None, features: Sequence[str], label: str, levels: Sequence[float],
    widths: Sequence[float] = (0.3, 0.1, 0.03), iterations: int = 8, ridge: float = 1e-4,
) -> QuantileFits:
    """Pinball-loss fits of all levels and all leave-one-fold-out models, one scan per iteration.

    The loss is smoothed over ``widths`` label deviations, narrower step by step;
    each step takes up to ``iterations`` damped Gauss-Newton moves, accepted only
    where the loss falls. The middle level is linear in the features, every other
    one adds a positive step to its neighbour.
    """
    levels_ = np.array(sorted(levels), float)
    names = [*features, label]
    facts = df.dropna(subset=names).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]
    ).first()
    n_levels, p = len(levels_), len(features) + 1
    if not facts["n"]:
        return QuantileFits(tuple(features), tuple(map(float, levels_)), (0.0,) * p, (1.0,) * p, {}, ())
    centre = np.array([facts[f"m{i}"] for i in range(p)])
    scale = np.array([facts[f"s{i}"] or 1.0 for i in range(p)])
    models = [ALL] if fold is None else sorted(r[0] for r in df.select(F.col(fold).cast("int")).dropna().distinct().collect())
    normal, middle = NormalDist(), n_levels // 2
    start = np.zeros((n_levels, p))
    for j in range(n_levels):
        if j != middle:
            near = j - 1 if j > middle else j + 1
            gap = abs(normal.inv_cdf(levels_[j]) - normal.inv_cdf(levels_[near]))
            start[j, 0] = math.log(math.expm1(max(gap, 1e-3)))
    size = 1 + n_levels * p + (n_levels * p) ** 2
    columns = [*names, *([fold] if fold is not None else [])]

    def scan(weights: Mapping[int, np.ndarray], width: float) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        def sums(block: np.ndarray) -> np.ndarray:
            rows = np.column_stack([np.ones(len(block)), (block[:, :p] - centre) / scale])
            out = []
            for k in models:
                loss, gradient, curvature = _smoothed_sums(rows if fold is None else rows[block[:, p] != k], weights[k], levels_, width)
                out += [[loss], gradient.ravel(), curvature.ravel()]
            return np.concatenate(out)

        total = scan_sums(df, columns, sums, size * len(models)).reshape(len(models), size)
        penalty = np.ones((n_levels, p)) * ridge * facts["n"]
        penalty[:, 0] = 0
        found = {}
        for k, row in zip(models, total, strict=True):
            g = row[1 : 1 + n_levels * p] + (penalty * (weights[k] - start)).ravel()
            h = row[1 + n_levels * p :].reshape(n_levels * p, -1) + np.diag(penalty.ravel())
            found[k] = (row[0] + float((penalty * (weights[k] - start) ** 2).sum()) / 2, g, h)
        return found

    best = {k: start.copy() for k in models}
    history: list[float] = []
    for width in widths:
        state = scan(best, width)
        damp = {k: 1e-2 for k in models}
        for _ in range(iterations):
            tried = {}
            for k in models:
                _, g, h = state[k]
                diagonal = np.diag(h) + 1e-6 * facts["n"]
                tried[k] = best[k] - np.linalg.solve(h + np.diag(damp[k] * diagonal + 1e-9 * facts["n"]), g).reshape(n_levels, p)
            after = scan(tried, width)
            gained = 0.0
            for k in models:
                if after[k][0] < state[k][0]:
                    gained = max(gained, (state[k][0] - after[k][0]) / max(state[k][0], 1e-300))
                    best[k], state[k], damp[k] = tried[k], after[k], damp[k] / 4
                else:
                    damp[k] *= 8
                    gained = max(gained, 1e-3)
            history.append(sum(s[0] for s in state.values()))
            if gained < 1e-4:
                break
    return QuantileFits(tuple(features), tuple(map(float, levels_)), tuple(map(float, centre)), tuple(map(float, scale)), best, tuple(history))
