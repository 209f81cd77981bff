"""Fitting a mixture of deltas to reach curves on every point, as one Spark plan.

Model: share reached at ``g`` impressions per person is
``R(g) = sum_i alpha_i * (1 - exp(-x_i * g))`` with ``alpha_i, x_i >= 0``.

A least-squares fit needs its points only through sums.  The axis of ``g`` is cut into octaves
``[2**e, 2**(e+1))``.  Inside one octave every model curve, whatever its rates, is to rounding a polynomial
of degree ``DEGREE`` in ``s = 2 * (g / 2**e - 1) - 1``, so the sums of ``T_k(s)`` for ``k <= 2 * DEGREE``
(Chebyshev polynomials, whose products are sums of others) and of ``r * T_k(s)`` for ``k <= DEGREE`` hold
all that the fit can ask of the octave's points.  Octaves do not depend on the curve's range: a longer log
adds octaves and takes no rate away.

1. each curve point becomes ``g = impression / population``, ``r = reach / population``;
2. the sums are hash-aggregated by (segment, octave, k): partial sums before the shuffle, no group of
   points, no point left out, whatever the length or skew of a curve.  Terms are summed as pairs of whole
   numbers (multiples of ``2**-26`` and ``2**-52``), so a sum is the same in every order and a fit does
   not depend on how the points are partitioned;
3. one row per curve (a few dozen octaves of ``2 * DEGREE + 1`` sums) is solved in NumPy: normal equations
   per octave, a start from the best sets of rates on a log-spaced grid with linear amplitudes, then damped
   Gauss-Newton steps to a tolerance.

Pool elimination: start with ``n_deltas`` pools; keep the fit if one pool is left or every rate exceeds
``min_rate`` (no two rates coincide and no amplitude is nil), otherwise, or if the solver does not converge, drop one pool.
A curve that not even one pool fits raises.  A pool whose curve is complete at the first point of the axis
(rate of ``UNTOLD / smallest g`` or more) has no rate that the points could tell: the fit raises if fewer
pools do not fit the curve as well.  Results are right-aligned in zero-padded arrays of length ``n_deltas`` (kept pools
in ascending rate order).

Output: ``[demos], population, alphas, rates, n_fitted, rmse`` (rmse in people, over all points).
Segments are matched NULL-safe; a segment without a census row raises.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachkit.sources.schema import as_list, join_null_safe, require_columns

# The solver runs in Python workers: ship this module's code with the task, so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the fit procedure: solver evaluation cap and the smallest rate
# a kept pool may have.
MAX_EVALUATIONS = 5000
MIN_RATE = 0.01
# Degree of the polynomials that stand for model curves inside an octave: exp(-x * g) is represented to
# about 1e-13, for any rate x.
DEGREE = 16
SATURATED = 18.0  # 1 - exp(-SATURATED) is 1 to the fit's accuracy: rates end at SATURATED / smallest g
UNTOLD = 16.0  # rate * smallest g from which on the points cannot tell a rate
NIL = 1e-9  # share of the summed amplitudes up to which a pool is none
GRID = 32  # rates tried for a start, log-spaced
# Sums of whole numbers: terms up to 1 in multiples of 2**-26, the rest in multiples of 2**-52.
UNIT = float(2 ** 26)
STARTS = 6  # best sets of grid rates that are polished
# Convergence: an accepted step lowers the squared error by less than FTOL
# (relative) or moves the parameters by less than XTOL (relative).
FTOL = 1e-14
XTOL = 1e-12
EXACT = 1e-24  # squared error, relative, that is rounding
# Two pools whose rates agree to this relative tolerance describe the same curve
# (and the same VID distribution) as one pool with their summed amplitude.
MERGE_RTOL = 1e-3


class CurveSums:
    """Least squares against one curve, from the sums of its octaves: ``octave`` (e), ``t[o, k]`` of
    ``T_k(s)`` for k <= 2 * DEGREE, ``rt[o, k]`` of ``r * T_k(s)`` for k <= DEGREE; ``rr`` of ``r * r`` over
    all ``n`` points, ``least`` the smallest positive g."""

    def __init__(self, octave: np.ndarray, t: np.ndarray, rt: np.ndarray, rr: float, n: int, least: float):
        m = DEGREE
        i = np.arange(m + 1)
        angle = np.pi * (i + 0.5) / (m + 1)
        to_coefficients = np.cos(np.outer(i, angle)) * (2.0 / (m + 1))
        to_coefficients[0] *= 0.5
        b, y = [], []
        for own_t, own_rt in zip(t, rt, strict=True):
            gram = 0.5 * (own_t[i[:, None] + i[None, :]] + own_t[np.abs(i[:, None] - i[None, :])])
            w, v = np.linalg.eigh(gram)
            keep = w > max(w[-1], 0.0) * 1e-14
            root, v = np.sqrt(w[keep]), v[:, keep]
            # |values of f at the octave's points - r|^2 = |A c - y|^2 + rest for f with coefficients c
            y.append((v.T @ own_rt) / root)
            b.append((v * root).T @ to_coefficients)  # values at the nodes -> residual space
        self.blocks = b
        self.y = np.concatenate(y) if y else np.zeros(0)
        self.rest = max(rr - float(self.y @ self.y), 0.0)
        self.n = n
        self.g = np.exp2(octave.astype(float))[:, None] * (1.0 + (np.cos(angle)[None, :] + 1.0) / 2.0)
        self.top = float(self.g.max()) if len(octave) else 1.0
        self.steepest = SATURATED / least if least > 0 else np.inf

    def _residual_space(self, values: np.ndarray) -> np.ndarray:
        """Values at the nodes [octave, node, column] as columns of the residual space."""
        return np.concatenate([b @ v for b, v in zip(self.blocks, values, strict=True)])

    def columns(self, rates: np.ndarray) -> np.ndarray:
        """Residual-space column of ``1 - exp(-x g)`` for every rate."""
        return self._residual_space(-np.expm1(-self.g[:, :, None] * rates))

    def slopes(self, rates: np.ndarray) -> np.ndarray:
        return self._residual_space(self.g[:, :, None] * np.exp(-self.g[:, :, None] * rates))

    def starts(self, m: int) -> list[np.ndarray]:
        """Parameters (amplitudes, rates) of the best sets of m grid rates, amplitudes linear and
        non-negative.  More than three rates extend the best smaller sets."""
        low = max(MIN_RATE / 4, 0.02 / self.top)
        grid = np.geomspace(low, max(self.steepest, 4 * low), GRID)
        p = self.columns(grid)
        q, h = p.T @ p, p.T @ self.y
        sets = np.array(list(itertools.combinations(range(GRID), min(m, 3))))
        for size in range(sets.shape[1], m + 1):
            if size > sets.shape[1]:
                best = sets[np.argsort(self._errors(sets, q, h)[0], kind="stable")[:4 * STARTS]]
                sets = np.array(sorted({tuple(sorted((*s, k))) for s in best.tolist() for k in range(GRID) if k not in s}))
            if size == m:
                break
        errors, amplitudes = self._errors(sets, q, h)
        order = np.argsort(errors, kind="stable")[:STARTS]
        return [np.concatenate([np.maximum(amplitudes[o], 0.0), grid[sets[o]]]) for o in order]

    def _errors(self, sets, q, h):
        """(squared error up to a constant, amplitudes) of each set; a negative amplitude counts against it."""
        ridge = 1e-13 * np.trace(q) * np.eye(sets.shape[1])
        qs, hs = q[sets[:, :, None], sets[:, None, :]], h[sets]
        a = np.linalg.solve(qs + ridge, hs[:, :, None])[:, :, 0]
        clipped = np.maximum(a, 0.0)
        error = np.einsum("si,sij,sj->s", clipped, qs, clipped) - 2.0 * np.einsum("si,si->s", clipped, hs)
        return error, a

    def solve(self, p0: np.ndarray, max_eval: int = MAX_EVALUATIONS) -> tuple[np.ndarray, float] | None:
        """Damped Gauss-Newton steps from p0 with parameters held in their bounds; None if the
        evaluations run out before it converges.  Ends early when two rates merge."""
        m = len(p0) // 2
        ceiling = np.concatenate([np.full(m, np.inf), np.full(m, self.steepest)])
        p = np.clip(p0, 0.0, ceiling)
        res = self.columns(p[m:]) @ p[:m] - self.y
        sse, damping, evals = float(res @ res), 1e-3, 1
        while True:
            jac = np.hstack([self.columns(p[m:]), self.slopes(p[m:]) * p[:m]])
            free = np.linalg.norm(jac, axis=0) > 0  # a pool without amplitude has no slope
            scale = np.where(free, np.linalg.norm(jac, axis=0), 1.0)
            moved = None
            while moved is None:
                if evals >= max_eval:
                    return None
                # damped least squares by an augmented system: no squared condition number
                system = np.vstack([jac / scale, np.sqrt(damping) * np.eye(2 * m)])
                step = np.linalg.lstsq(system, np.concatenate([-res, np.zeros(2 * m)]), rcond=None)[0] / scale
                cand = np.clip(p + step, 0.0, ceiling)
                cres = self.columns(cand[m:]) @ cand[:m] - self.y
                csse = float(cres @ cres)
                evals += 1
                if np.isfinite(csse) and csse < sse:
                    gain, moved = sse - csse, float(np.linalg.norm((cand - p) / np.maximum(np.abs(p), 1e-6)))
                    p, res, sse, damping = cand, cres, csse, max(damping / 5.0, 1e-15)
                elif damping > 1e10:
                    return p, sse  # no step lowers the error: a minimum to rounding
                else:
                    damping *= 4.0
            if gain <= FTOL * sse or moved <= XTOL or sse <= EXACT * max(float(self.y @ self.y), 1e-300):
                return p, sse
            if m > 1 and merged(p[m:]):
                return p, sse


def merged(rates: np.ndarray) -> bool:
    x = np.sort(rates)
    return bool(np.any(np.diff(x) <= MERGE_RTOL * np.maximum(x[1:], 1e-300)))


def fit_sums(sums: CurveSums, n_deltas: int, min_rate: float = MIN_RATE,
             max_eval: int = MAX_EVALUATIONS) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(alphas, rates, pools kept, squared error over all points) with pool elimination."""
    nil = EXACT * 1e6 * max(float(sums.y @ sums.y), 1e-300)
    untold = None  # squared error of a fit with a pool whose rate cannot be told
    for m in range(n_deltas, 0, -1):
        fits = [f for f in (sums.solve(p, max_eval) for p in sums.starts(m)) if f is not None]
        if not fits:
            continue
        p, sse = min(fits, key=lambda f: f[1])
        real = p[:m] > NIL * p[:m].sum()
        if m > 1 and (real & (p[m:] >= sums.steepest * (UNTOLD / SATURATED))).any():
            untold = sse if untold is None else min(untold, sse)
        elif m == 1 or (np.all(real) and np.all(p[m:] > min_rate) and not merged(p[m:])):
            if untold is not None and sse > 1.0001 * untold + nil:
                raise ValueError("a pool is complete at the curve's first point: its rate cannot be told; "
                                 "give points at fewer impressions per person or fewer deltas")
            order = np.argsort(p[m:], kind="stable")
            pad = np.zeros(n_deltas - m)
            return np.concatenate([pad, p[:m][order]]), np.concatenate([pad, p[m:][order]]), m, sse + sums.rest
    raise ValueError("the curve cannot be fitted, not even with one delta")


def fit_curve(g, r, n_deltas: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Fit one curve given by its points (the sums are built locally)."""
    g, r = np.asarray(g, float), np.asarray(r, float)
    if len(g) == 0:
        raise ValueError("the curve has no points")
    return fit_sums(sums_of_points(g, r), n_deltas)


def sums_of_points(g: np.ndarray, r: np.ndarray) -> CurveSums:
    """The octave sums of one curve's points."""
    some = g > 0
    own = np.floor(np.log2(g[some]))
    angle = np.arccos(np.clip(2.0 * (g[some] / np.exp2(own) - 1.0) - 1.0, -1.0, 1.0))
    octave, at = np.unique(own, return_inverse=True)
    t = np.array([np.bincount(at, weights=np.cos(k * angle)) for k in range(2 * DEGREE + 1)]).T
    rt = np.array([np.bincount(at, weights=r[some] * np.cos(k * angle)) for k in range(DEGREE + 1)]).T
    return CurveSums(octave, t, rt, float(r @ r), len(g), float(g[some].min()) if some.any() else 0.0)


def _points(reach: DataFrame, population, demos: list[str]) -> DataFrame:
    """``[demos], population, g, r`` of every curve point."""
    pts = reach.select(*demos, "impression", "reach")
    if isinstance(population, DataFrame):
        require_columns(population, [*demos, "population"])
        pops = population.groupBy(*demos).agg(F.sum("population").cast("bigint").alias("population"))
        if demos:
            found = join_null_safe(pts, pops, demos, "left")
            missing = F.raise_error(F.lit("a segment of the reach table has no census row"))
            pts = found.withColumn("population", F.coalesce("population", missing.cast("bigint")))
        else:  # without demos the population is one value: a scalar subquery
            pts = pts.withColumn("population", pops.select("population").scalar())
    else:
        pts = pts.withColumn("population", F.lit(int(population)).cast("bigint"))
    pts = pts.where(F.col("impression").isNotNull() & F.col("reach").isNotNull())
    return pts.select(*demos, "population", F.try_divide(F.col("impression").cast("double"), "population").alias("g"),
                      F.try_divide(F.col("reach").cast("double"), "population").alias("r"))


def _whole_sums(name: str, value) -> list:
    """Two sums of whole numbers that make up the sum of ``value``: the same in every order."""
    high = F.floor(value * UNIT)
    low = F.rint((value * UNIT - high) * UNIT).cast("bigint")
    return [F.sum(high).alias(f"{name}_high"), F.sum(low).alias(f"{name}_low")]


def curve_sums(points: DataFrame, demos: list[str]) -> DataFrame:
    """One row per curve: ``[demos], population, sums`` (array of octave, k, n, least and the parts of rr, t
    and rt)."""
    # points without impressions lie in an octave of their own: the model is 0 there
    octave = F.when(F.col("g") > 0, F.floor(F.log2("g")).cast("int"))
    placed = points.withColumn("octave", octave)
    share = F.when(F.col("g") > 0, 2.0 * (F.col("g") / F.pow(F.lit(2.0), F.col("octave")) - 1.0) - 1.0).otherwise(F.lit(1.0))
    angled = placed.withColumn("angle", F.acos(F.least(F.greatest(share, F.lit(-1.0)), F.lit(1.0))))
    waves = angled.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * DEGREE)))).withColumn(
        "wave", F.cos(F.col("k") * F.col("angle")))
    r_wave = F.when(F.col("k") <= DEGREE, F.col("r") * F.col("wave")).otherwise(F.lit(0.0))
    rr = F.when(F.col("k") == 0, F.col("r") * F.col("r")).otherwise(F.lit(0.0))
    per_k = waves.groupBy(*demos, "population", "octave", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("g").alias("least"), *_whole_sums("t", F.col("wave")),
        *_whole_sums("rt", r_wave), *_whole_sums("rr", rr))
    # 2 * DEGREE + 1 rows per octave
    fields = ["octave", "k", "n", "least", *[f"{x}_{part}" for x in ("t", "rt", "rr") for part in ("high", "low")]]
    return per_k.groupBy(*demos, "population").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sums"))


def _curve(entries: list) -> CurveSums:
    """The curve of one row of ``curve_sums``."""
    sums: dict[tuple, dict] = {(e["octave"], e["k"]): e for e in entries}

    def value(e, name):
        if e[f"{name}_high"] is None or e[f"{name}_low"] is None:
            raise ValueError("a curve has no usable points (is its population 0?)")
        return e[f"{name}_high"] / UNIT + e[f"{name}_low"] / UNIT / UNIT

    first = [e for (_, k), e in sums.items() if k == 0]
    octave = np.array(sorted(o for o, k in sums if k == 0 and o is not None), float)
    t = np.array([[value(sums[o, k], "t") for k in range(2 * DEGREE + 1)] for o in octave]).reshape(len(octave), 2 * DEGREE + 1)
    rt = np.array([[value(sums[o, k], "rt") for k in range(DEGREE + 1)] for o in octave]).reshape(len(octave), DEGREE + 1)
    rr = sum(sorted(value(e, "rr") for e in first))
    positive = [e["least"] for e in first if e["octave"] is not None]
    return CurveSums(octave, t, rt, rr, sum(e["n"] for e in first), min(positive, default=0.0))


def fit_mixture_of_deltas(reach: DataFrame, population, n_deltas: int = 3, demo_cols=None) -> DataFrame:
    """Fit every curve of a reach table (see module doc).

    ``population`` is a number (total curve) or a census DataFrame with the demo
    columns and ``population`` (summed per segment, matched on the demos).
    """
    demos = as_list(demo_cols)
    require_columns(reach, [*demos, "impression", "reach"])
    sums = curve_sums(_points(reach, population, demos), demos)
    schema = T.StructType(
        [reach.schema[c] for c in demos]
        + [T.StructField("population", T.LongType()),
           T.StructField("alphas", T.ArrayType(T.DoubleType())),
           T.StructField("rates", T.ArrayType(T.DoubleType())),
           T.StructField("n_fitted", T.IntegerType()),
           T.StructField("rmse", T.DoubleType())]
    )
    n = int(n_deltas)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                if len(row["sums"]) == 0 or pd.isna(row["population"]):
                    raise ValueError("a curve has no usable points (is its population 0?)")
                curve = _curve(row["sums"])
                alphas, rates, m, sse = fit_sums(curve, n)
                rows.append([*(row[c] for c in demos), int(row["population"]), alphas.tolist(), rates.tolist(), m,
                             float(np.sqrt(sse / curve.n) * row["population"])])
            yield pd.DataFrame(rows, columns=schema.names)

    return sums.mapInPandas(solve, schema)
