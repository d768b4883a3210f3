"""Membership functions and partitions of numeric columns, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = {2: ["low", "high"], 3: ["low", "medium", "high"], 5: ["very_low", "low", "medium", "high", "very_high"]}


def default_labels(n: int) -> list[str]:
    return LABELS.get(n, [f"l{k + 1}" for k in range(n)])


def _rising(peaks: Sequence[float]) -> list[float]:
    peaks = [float(p) for p in peaks]
    if any(b <= a for a, b in zip(peaks, peaks[1:])):
        raise ValueError("peaks must be strictly increasing")
    return peaks


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 up to ``a``, 1 from ``b`` to ``c``, 0 from ``d``; sides may be vertical, shoulders infinite."""
    if not a <= b <= c <= d:
        raise ValueError("a trapezoid needs a <= b <= c <= d")
    up = F.lit(1.0) if a == -math.inf else (F.when(x < a, 0.0).when(x < b, (x - a) / (b - a)).otherwise(1.0) if b > a else F.when(x < a, 0.0).otherwise(1.0))
    down = F.lit(1.0) if d == math.inf else (F.when(x > d, 0.0).when(x > c, (d - x) / (d - c)).otherwise(1.0) if d > c else F.when(x > d, 0.0).otherwise(1.0))
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(up, down))


def triangular_partition(x: Column, peaks: Sequence[float]) -> list[Column]:
    """One degree per peak; neighbours sum to 1, the outer ones keep 1 beyond their peaks."""
    p = _rising(peaks)
    return [trapezoid(x, p[k - 1] if k else -math.inf, p[k], p[k], p[k + 1] if k + 1 < len(p) else math.inf) for k in range(len(p))]


def trapezoid_partition(x: Column, peaks: Sequence[float]) -> list[Column]:
    """Cores reach a quarter of the gap to each side of a peak."""
    p = _rising(peaks)
    cores = [((p[k] - (p[k] - p[k - 1]) / 4) if k else -math.inf, (p[k] + (p[k + 1] - p[k]) / 4) if k + 1 < len(p) else math.inf) for k in range(len(p))]
    return [trapezoid(x, cores[k - 1][1] if k else -math.inf, cores[k][0], cores[k][1], cores[k + 1][0] if k + 1 < len(p) else math.inf) for k in range(len(p))]


def gaussian(x: Column, centre: float, sigma: float) -> Column:
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return F.when(x.isNotNull() & ~F.isnan(x), F.exp(-0.5 * F.pow((x - centre) / sigma, 2)))


def gaussian_partition(x: Column, peaks: Sequence[float]) -> list[Column]:
    """Sigmas such that neighbours of mean spacing cross at one half."""
    p = _rising(peaks)
    spacing = (p[-1] - p[0]) / max(len(p) - 1, 1) or 1.0
    return [gaussian(x, centre, spacing / (2 * math.sqrt(2 * math.log(2)))) for centre in p]


PARTITIONS = {"triangular": triangular_partition, "trapezoidal": trapezoid_partition, "gaussian": gaussian_partition}


def automatic_peaks(frame: DataFrame, column: str, n_labels: int = 3, method: str = "uniform") -> list[float]:
    """Peaks between the extremes (uniform), at quantiles, or at centres of k-means begun at quantiles."""
    x = F.col(column).cast("double")
    shares = [k / (n_labels - 1) for k in range(n_labels)] if n_labels > 1 else [0.5]
    rows = frame.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if method == "uniform":
        low, high = rows.agg(F.min("x"), F.max("x")).first()
        peaks = [] if low is None else [low + (high - low) * s for s in shares]
    elif method in ("quantile", "kmeans"):
        peaks = rows.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0] or []
    else:
        raise ValueError(f"unknown method {method!r}")
    if method == "kmeans":
        counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).persist()
        for _ in range(100):
            distance = F.array(*[F.struct(F.abs(F.col("x") - p).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(peaks)])
            found = {r["k"]: r["c"] for r in counted.select("x", "n", F.array_min(distance)["k"].alias("k")).groupBy("k").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("c")).collect()}
            new = [found.get(k, p) for k, p in enumerate(peaks)]
            if max((abs(a - b) for a, b in zip(new, peaks)), default=0) < 1e-12:
                break
            peaks = new
        counted.unpersist()
    if not peaks:
        raise ValueError(f"column {column!r} has no values")
    if any(b <= a for a, b in zip(peaks, peaks[1:])):
        raise ValueError(f"column {column!r}: repeated peaks, ask for fewer labels")
    return peaks


def fuzzify(frame: DataFrame, partitions: Mapping[str, Sequence[float]], membership: str = "triangular", labels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``frame`` with a column ``attribute_label`` of degrees per label."""
    columns = []
    for column, peaks in partitions.items():
        names = (labels or {}).get(column) or default_labels(len(peaks))
        columns += [d.alias(f"{column}_{n}") for d, n in zip(PARTITIONS[membership](F.col(column).cast("double"), peaks), names)]
    return frame.select("*", *columns)


def auto_fuzzify(frame: DataFrame, columns: Sequence[str], n_labels: int = 3, method: str = "uniform", membership: str = "triangular") -> DataFrame:
    return fuzzify(frame, {c: automatic_peaks(frame, c, n_labels, method) for c in columns}, membership)


def fuzzy_transactions(frame: DataFrame, columns: Sequence[str], min_degree: float = 0.0) -> Column:
    """Array of ``(item, degree)`` structs of the degrees above ``min_degree``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("degree")) for c in columns])
    return F.filter(pairs, lambda s: s["degree"] > min_degree)


# -- alpha levels ----------------------------------------------------------------------------------


def alpha_levels(p: int) -> list[float]:
    """1, (p-1)/p, ..., 1/p."""
    if p < 1:
        raise ValueError("the number of levels must be positive")
    return [k / p for k in range(p, 0, -1)]


def alpha_weights(p: int) -> list[float]:
    return [1 / p] * len(alpha_levels(p))


def alpha_cuts(degree: Column, p: int) -> Column:
    """1 or 0 per level."""
    return F.array(*[F.when(degree >= level, 1).otherwise(0) for level in alpha_levels(p)])


def weighted_alpha_aggregate(values: Column, weights: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def fuzzy_support(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x) / F.size(levels)
