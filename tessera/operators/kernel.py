"""Linear models over random cosine features that are formed in the tasks and never stored.

A pass over the rows hands on one loss and one gradient a partition, so neither memory nor shuffle
knows the number of features times rows. All classes share a pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tessera.session import written

STEP = 1 << 15               # features formed at once, so that they stay in a core's cache
EPSILON = 1.35               # residuals beyond so many scales count linearly
MEMORY = 10
SEARCH = 20


def projection(width: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.normal(0.0, math.sqrt(2 * gamma), (width, size)),
            rng.uniform(0.0, 2 * math.pi, size))


def cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``sqrt(2 / n) cos(x w + b)``, n being the number of features.

    NumPy's own cosine of doubles takes a core several times as long as this sum of 11 terms, whose
    error stays at the rounding of the angles.
    """
    out = np.empty((len(x), len(b)))
    w, b, rows = w / (2 * math.pi), b / (2 * math.pi), step_rows(len(b))
    square, whole = np.empty((2, min(rows, len(x)), len(b)))
    for at in range(0, len(x), rows):
        z = np.matmul(x[at:at + rows], w, out=out[at:at + rows])
        u, v = square[:len(z)], whole[:len(z)]
        z += b
        np.rint(z, out=v)
        z -= v                                # turns, between -1/2 and 1/2
        np.abs(z, out=z)
        np.subtract(0.25, z, out=z)           # cos(2 pi t) = sin(2 pi (1/4 - |t|))
        np.multiply(z, z, out=u)
        np.multiply(u, _SINE[-1], out=v)
        for c in _SINE[-2:0:-1]:
            v += c
            v *= u
        v += _SINE[0]
        v *= math.sqrt(2.0 / len(b))
        z *= v
    return out


def step_rows(size: int) -> int:
    return max(16, STEP // size)


#: Of sin(2 pi x) / x in powers of x squared, for |x| up to 1/4: the rest is below 1e-17.
_SINE = [(-1) ** i * (2 * math.pi) ** (2 * i + 1) / math.factorial(2 * i + 1) for i in range(11)]


def descend(x: np.ndarray, most: int, tol: float) -> Generator:
    """Limited-memory BFGS with a weak Wolfe search: yields points, is sent (value, gradient).

    Ends when the gradient or the fall of five steps is small, or where no step falls, and returns
    the last point.
    """
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    past = [f]
    for _ in range(most):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        d, kept = -g, []
        for s, y in reversed(steps):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        if g @ d >= 0:
            d, steps = -g, []
        slope, low, high, best = g @ d, 0.0, math.inf, None
        t = 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(g))
        for _ in range(SEARCH):
            at = x + t * d
            fn, gn = yield at
            if not fn <= f + 1e-4 * t * slope:
                high = t
            else:
                best = at, fn, gn
                if gn @ d >= 0.9 * slope:
                    break
                low = t
            t = (low + high) / 2 if high < math.inf else 2 * low
        if best is None:
            break
        s, y = best[0] - x, best[2] - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps, (s, y)][-MEMORY:]
        x, f, g = best
        past.append(f)
        if len(past) > 5 and past[-6] - f <= tol * abs(f):
            break
    return x


def newton(x: np.ndarray, most: int, tol: float) -> Generator:
    """Newton steps, halved until the value falls and the last number stays above 0: yields points,
    is sent (value, gradient, second derivatives)."""
    f, g, h = yield x
    for _ in range(most):
        step = -np.linalg.lstsq(h, g, rcond=1e-12)[0]
        for halves in range(SEARCH):
            at = x + step / 2**halves
            if at[-1] <= 0:
                continue
            fn, gn, hn = yield at
            if fn <= f + 1e-4 * (g @ step) / 2**halves:
                break
        else:
            break
        fall, x, f, g, h = f - fn, at, fn, gn, hn
        if fall <= tol * abs(f):
            break
    return x


def together(runs: dict[int, Generator], values: Callable) -> list[np.ndarray]:
    """Run several descents, one call of ``values({number: point})`` a step for all."""
    out, asked = {}, {i: next(run) for i, run in runs.items()}
    while asked:
        got, ahead = values(asked), {}
        for i in asked:
            try:
                ahead[i] = runs[i].send(got[i])
            except StopIteration as end:
                out[i] = end.value
        asked = ahead
    return [out[i] for i in runs]


def _hinge(z, w, y, numbers, points):
    """Sums of hinge losses of classes against the others, a row each, with their gradients."""
    sign = np.where(y[:, None] == numbers, 1.0, -1.0)
    left = 1.0 - sign * (z @ points[:, :-1].T + points[:, -1])
    on = np.where(left > 0, -sign * w[:, None], 0.0)
    return np.c_[w @ np.maximum(left, 0.0), on.T @ z, on.sum(0)]


def _huber(z, w, y, point):
    """Sum of Huber losses with their scale (which comes last), gradient and second derivatives."""
    scale = point[-1]
    z = np.c_[z, np.ones(len(z))]
    r = y - z @ point[:-1]
    near = np.abs(r) <= EPSILON * scale
    loss = np.where(near, scale + r * r / scale,
                    scale + 2 * EPSILON * np.abs(r) - scale * EPSILON**2) / 2
    pull = np.where(near, -r / scale, -EPSILON * np.sign(r)) * w
    by_scale = np.where(near, 1 - (r / scale) ** 2, 1 - EPSILON**2) / 2
    on = w * near
    cross = (r * on) @ z / scale**2
    second = np.block([[(z * on[:, None]).T @ z / scale, cross[:, None]],
                       [cross[None], np.array([[(r * r) @ on / scale**3]])]])
    return np.r_[loss @ w, pull @ z, by_scale @ w, second.ravel()]


class KernelMargins(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                    DefaultParamsWritable):
    """Linear scores of random cosine features: one number, or a vector with one a class (of two
    classes the negative score and the score)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "classes, 0 for a number", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "by score and feature", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "one a score", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, gamma: float = 1.0, size: int = 128, seed: int = 42, classes: int = 0,
                 weights: list | None = None, offsets: list | None = None,
                 inputCol: str = "features", outputCol: str = "rawPrediction"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(gamma=1.0, size=128, seed=42, classes=0, inputCol="features",
                         outputCol="rawPrediction")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed, classes, weights, offsets = (self.getOrDefault(p) for p in (
            "gamma", "size", "seed", "classes", "weights", "offsets"))

        @F.pandas_udf("array<double>")
        def scores(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy()).astype(float)
            out = cosines(x, *projection(x.shape[1], gamma, size, seed)) @ np.reshape(
                weights, (-1, size)).T + np.array(offsets)
            return pd.Series(list(np.c_[-out, out] if classes == 2 else out))

        found = scores(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(),
                                  array_to_vector(found) if classes else found[0])


class KernelLinear(Estimator, HasFeaturesCol):
    """Fits the hinge loss of each class against the rest, or for ``classes`` 0 the Huber loss with
    its scale, both with a squared penalty of the weights of standardised features."""

    gamma, size, seed, classes = (KernelMargins.gamma, KernelMargins.size, KernelMargins.seed,
                                  KernelMargins.classes)
    reg = Param(Params._dummy(), "reg", "penalty", TypeConverters.toFloat)
    most = Param(Params._dummy(), "most", "steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least relative fall", TypeConverters.toFloat)
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "weight column or nothing", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of the scores", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, gamma: float = 1.0, size: int = 128, seed: int = 42, classes: int = 0,
                 reg: float = 0.0, most: int = 100, tol: float = 1e-6, label: str = "label",
                 weight: str = "", output: str = "rawPrediction", featuresCol: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(gamma=1.0, size=128, seed=42, classes=0, reg=0.0, most=100, tol=1e-6,
                         label="label", weight="", output="rawPrediction", featuresCol="features")

    def _fit(self, dataset: DataFrame) -> KernelMargins:
        gamma, size, seed, classes, reg, most, tol, weight = (self.getOrDefault(p) for p in (
            "gamma", "size", "seed", "classes", "reg", "most", "tol", "weight"))
        def packed(batches):
            # A batch is one row of bytes: later passes get it as it is.
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(
                        v.to_numpy(zero_copy_only=False), dtype=float).tobytes()], pa.binary())
                        for v in (b.column("x").flatten(), b.column("y"), b.column("w"))], list("xyw"))

        data = written(dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"),
            F.col(self.getOrDefault("label")).cast("double").alias("y"),
            F.col(weight).cast("double").alias("w") if weight else F.lit(1.0).alias("w")).mapInArrow(
            packed, "x binary, y binary, w binary"), "kernel")

        def total(part: Callable) -> np.ndarray:
            """Sum of ``part(features, weights, labels)`` over all rows."""
            def run(batches):
                out = None
                for b in batches:
                    for row in zip(*(b.column(c) for c in "xyw")):
                        x, y, w = (np.frombuffer(v.as_py()) for v in row)
                        x = x.reshape(len(y), -1)
                        wave, rows = projection(x.shape[1], gamma, size, seed), step_rows(size)
                        for at in range(0, len(x), rows):
                            s = slice(at, at + rows)
                            got = part(cosines(x[s], *wave), w[s], y[s])
                            out = got if out is None else out + got
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])
            return data.mapInArrow(run, "s binary").rdd.map(
                lambda r: np.frombuffer(bytes(r["s"]))).treeReduce(lambda a, b: a + b)

        first = data.select("x", "y").first()
        if first is None:
            raise ValueError("no rows to learn from")
        first = np.frombuffer(bytes(first["x"])).reshape(len(first["y"]) // 8, -1)[:1]
        # Features meet the weights standardised; what has no spread keeps no weight.
        middle = cosines(first, *projection(first.shape[1], gamma, size, seed))[0]
        sums = total(lambda z, w, y: np.r_[w.sum(), w @ (z - middle), w @ (z - middle) ** 2,
                                           w @ y, w @ y**2])
        n = sums[0]
        mean = sums[1:size + 1] / n
        spread = np.sqrt(np.maximum(sums[size + 1:-2] / n - mean**2, 0.0) * (n / max(n - 1, 1.0)))
        mean += middle
        scale = np.divide(1.0, spread, out=np.zeros(size), where=spread > 1e-12)
        tail = 1 if classes else 2
        wide = size + tail
        penalty = reg * np.r_[np.ones(size), np.zeros(tail)]

        def values(points: dict) -> dict:
            found = {}
            if classes:
                # The points meet the features as they are, with the scaling on their side.
                numbers, at = np.array(list(points)), np.array(list(points.values()))
                at[:, :size] *= scale
                at[:, size] -= at[:, :size] @ mean
                sums = np.array(total(lambda z, w, y: _hinge(z, w, y, numbers, at).ravel())).reshape(
                    len(points), -1)
                sums[:, 1:-1] = (sums[:, 1:-1] - sums[:, -1:] * mean) * scale
                found = dict(zip(points, sums))
            for i, p in {} if classes else points.items():
                found[i] = total(lambda z, w, y: _huber((z - mean) * scale, w, y, p))
            out = {}
            for i, p in points.items():
                row = found[i] / n
                second = [] if classes else [row[wide + 1:].reshape(wide, wide) + np.diag(penalty)]
                out[i] = (row[0] + (penalty * p) @ p / 2, row[1:wide + 1] + penalty * p, *second)
            return out

        if classes:
            numbers = [1] if classes == 2 else list(range(classes))
            runs = {i: descend(np.zeros(wide), most, tol) for i in numbers}
        else:
            level = sums[-2] / n
            about = math.sqrt(max(sums[-1] / n - level**2, 0.0)) or 1.0
            runs = {0: newton(np.r_[np.zeros(size), level, about], most, tol)}
        found = together(runs, values)
        weights = np.array([p[:size] * scale for p in found])
        offsets = np.array([p[size] for p in found]) - weights @ mean
        return KernelMargins(gamma=gamma, size=size, seed=seed, classes=classes,
                             weights=weights.ravel().tolist(), offsets=offsets.tolist(),
                             inputCol=self.getFeaturesCol(), outputCol=self.getOrDefault("output"))
