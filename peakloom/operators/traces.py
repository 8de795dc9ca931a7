"""Preparation of whole traces: features, smoothing plans, backgrounds, decompositions, peaks, training records.

A trace of a few thousand points is one row of arrays (pattern_id, xs, ys), see as_arrays(); all steps are column
expressions on them (functions/arrays.py), as their windows differ by trace. Windows at every point and the small least-squares
fit of a series through some ninety nodes are numpy kernels on the arrays of a batch. Nothing passes from one trace to another, so the job grows with the number of
traces alone. Patterns of fewer than five points have no peaks, a flat background and plan 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from peakloom.functions import arrays as A
from peakloom.functions.arrays import fixed
from peakloom.operators.signal import as_arrays, by_x, interpolate, on_grid, own, snip_arrays
from peakloom.operators.storage import written

NO_PEAKS = f"CAST(array() AS {A.PEAKS.simpleString()})"


def _div(c: Column, k: int) -> Column:
    return F.floor(c / k).cast("int")


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def described(traces: DataFrame, values: str = "ys") -> DataFrame:
    """Adds n, step and noise of the values to rows (pattern_id, xs, ys)."""
    return fixed(traces, n=F.size(values), step=A.median_step(F.col("xs")), noise=A.noise(F.col(values)))


def well_formed(trace: DataFrame, least: int = 16) -> DataFrame:
    """Points with finite x and y of patterns that have `least` of them."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return trace.where(finite("x") & finite("y")).withColumn("__n", F.count("*").over(own())).where(F.col("__n") >= least).drop("__n")


def signature(trace: DataFrame) -> DataFrame:
    """(pattern_id, n, first_y, last_y, p10, p50, p99): enough to tell that a trace has changed."""
    q = F.expr("percentile(y, array(0.1, 0.5, 0.99))")
    g = trace.groupBy("pattern_id").agg(F.count("*").alias("n"), F.min_by("y", "x").alias("first_y"), F.max_by("y", "x").alias("last_y"), q.alias("q"))
    return g.select("pattern_id", "n", "first_y", "last_y", *(F.round(F.col("q")[i], 3).alias(p) for i, p in enumerate(("p10", "p50", "p99"))))


# -- features and plans --------------------------------------------------------------------------------------

FEATURES = ("points", "step", "span", "noise", "noise_ratio", "peaks", "density", "peak_width", "broad_share", "narrow_share", "slope", "curvature", "hump", "oversmooth_risk")


@dataclass(frozen=True)
class FeaturePolicy:
    """Constants of the signal features (fixed values): widths in degrees, shares of the intensity span."""

    trend: float = 1.4
    floor: float = 0.7
    floor_percent: float = 22.0
    base: float = 3.0
    prominence_noise: float = 4.0
    prominence_span: float = 0.018
    apart: float = 0.10
    widest: float = 2.0
    broad: float = 0.55
    narrow: float = 0.16


def features(traces: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """(pattern_id, the FEATURES): size and noise of a trace, its peaks above a smooth trend, the shape of its lower support."""
    p, y, step, n = policy, F.col("ys"), F.col("step"), F.col("n")
    rows = described(traces)
    rows = fixed(rows, span=F.greatest(A.quantile(y, 0.99) - A.quantile(y, 0.01), F.lit(1.0)), length=F.greatest(F.element_at("xs", -1) - F.get("xs", 0), step))
    trend = A.gaussian_filter(y, F.greatest(A.odd_points(p.trend, step, 9, F.greatest(F.lit(9), _div(n, 3))) / 7.0, F.lit(1.0)))
    low = A.rank_filter(y, p.floor_percent, A.odd_points(p.floor, step, 9, F.greatest(F.lit(9), _div(n, 4))))
    base = A.gaussian_filter(low, F.greatest(A.odd_points(p.base, step, 21, F.greatest(F.lit(21), _div(n, 2))) / 8.0, F.lit(2.0)))
    enough = F.size("ys") >= 3
    rows = fixed(rows.where(enough), rest=F.zip_with("ys", trend, lambda a, b: F.greatest(a - b, F.lit(0.0))), base=base)
    peaks = A.find_peaks(F.col("rest"), F.greatest(p.prominence_noise * F.col("noise"), p.prominence_span * F.col("span"), F.lit(1.0)), A.points(p.apart, step, 3), A.points(p.widest, step, 5))
    rows = fixed(rows, wide=F.transform(peaks, lambda k: k["width"] * F.col("step")), steep=A.gradient(F.col("base")))
    wide, total = F.col("wide"), F.size("wide")
    share = lambda cond: F.coalesce(F.size(F.filter(wide, cond)) / F.nullif(total, F.lit(0)), F.lit(0.0))
    upper = lambda c: A.quantile(F.transform(c, lambda v: F.abs(v)), 0.95)
    density, ratio = total / F.greatest(F.col("length") / 10, F.lit(1.0)), _clip(F.col("noise") / F.col("span"), 0.0, 1.0)
    narrow = share(lambda w: w < p.narrow)
    whole = rows.select(
        "pattern_id", n.alias("points"), "step", "span", "noise", ratio.alias("noise_ratio"), total.alias("peaks"), density.alias("density"), F.coalesce(A.quantile(wide, 0.5), F.lit(0.0)).alias("peak_width"),
        share(lambda w: w > p.broad).alias("broad_share"), narrow.alias("narrow_share"), (upper(F.col("steep")) * F.col("length") / F.col("span")).alias("slope"),
        (upper(A.gradient(F.col("steep"))) * F.col("length") * F.col("length") / F.col("span")).alias("curvature"), ((F.array_max("base") - A.quantile(F.col("base"), 0.1)) / F.col("span")).alias("hump"),
        _clip(0.55 * narrow + 0.35 * F.least(density / 1.4, F.lit(1.0)) + 0.10 * (1 - ratio), 0.0, 1.0).alias("oversmooth_risk"),
    )
    least = dict.fromkeys(FEATURES, 0.0) | {"step": 0.03, "span": 1.0, "noise": 1.0, "noise_ratio": 1.0, "oversmooth_risk": 1.0}
    small = traces.where(~enough).select("pattern_id", F.size("ys").alias("points"), *((F.lit(0) if c == "peaks" else F.lit(least[c])).alias(c) for c in FEATURES[1:]))
    return whole.unionByName(small)


def smoothing_plan() -> list[Column]:
    """method, window, sigma and passes of the smoothing that the features of a trace ask for."""
    odd = lambda c: c + 1 - c % 2
    points = lambda width, least, most: odd(F.least(F.greatest(F.round(width / F.greatest("step", F.lit(1e-6))).cast("int"), F.lit(least)), F.lit(most)))
    most = points(F.lit(0.22), 5, 21)
    most = F.when(F.col("peak_width") > 0, F.least(most, points(F.col("peak_width") * 0.45, 5, 21))).otherwise(most)
    window = points(F.lit(0.08), 5, 11) + F.when(F.col("noise_ratio") > 0.055, 4).when(F.col("noise_ratio") > 0.030, 2).otherwise(0)
    window = window - F.when((F.col("density") > 0.85) | (F.col("narrow_share") > 0.45), 2).otherwise(0) - F.when(F.col("oversmooth_risk") > 0.65, 2).otherwise(0)
    tiny = F.col("points") < 9
    rough = (F.col("noise_ratio") > 0.085) & (F.col("density") < 0.35)
    return [
        F.when(~tiny & rough, "gaussian").otherwise("savgol").alias("method"), F.when(tiny, 5).otherwise(odd(F.greatest(F.least(window, most), F.lit(5)))).alias("window"),
        F.when(~tiny & rough, 0.35).otherwise(0.2).alias("sigma"), F.when(~tiny & (F.col("noise_ratio") > 0.12) & (F.col("narrow_share") < 0.35), 2).otherwise(1).alias("passes"),
    ]


SELECTOR_FEATURES = ("log_points", "step", "noise_ratio", "density", "peak_width", "broad_share", "narrow_share", "slope", "curvature", "hump", "oversmooth_risk")


def selected_profile(found: DataFrame, weights: DataFrame, least: float = 0.42) -> DataFrame:
    """(pattern_id, profile, confidence): the decomposition profile by a linear softmax over the features.

    weights has a row a feature and one named 'bias': (feature, mean, std, w array a profile). Below the least confidence,
    and with no weights at all, it is profile 1.
    """
    rows = found.withColumn("log_points", F.log1p("points"))
    long = rows.select("pattern_id", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in SELECTOR_FEATURES), F.struct(F.lit("bias").alias("feature"), F.lit(1.0).alias("v")))).alias("f"))
    terms = long.select("pattern_id", "f.*").join(F.broadcast(weights), "feature")  # a dozen rows
    terms = terms.withColumn("z", F.when(F.col("feature") == "bias", 1.0).otherwise((F.col("v") - F.col("mean")) / F.col("std")))
    logits = terms.select("pattern_id", F.posexplode("w").alias("profile", "x"), "z").groupBy("pattern_id", "profile").agg(F.sum(F.col("x") * F.col("z")).alias("logit"))
    w = Window.partitionBy("pattern_id")
    p = F.exp(F.col("logit") - F.max("logit").over(w))
    best = logits.withColumn("confidence", p / F.sum(p).over(w)).groupBy("pattern_id").agg(F.max_by(F.struct("profile", "confidence"), F.struct("confidence", -F.col("profile"))).alias("b"))
    confidence = F.coalesce("b.confidence", F.lit(0.0))
    return found.select("pattern_id").join(best, "pattern_id", "left").select("pattern_id", F.when(confidence >= least, F.col("b.profile")).otherwise(1).alias("profile"), confidence.alias("confidence"))


# -- backgrounds ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class EnvelopePolicy:
    """Constants of the envelope (fixed values): widths in degrees, percentiles, multiples of the noise."""

    small: float = 0.45
    broad: float = 2.8
    floor_percent: float = 18.0
    broad_percent: float = 32.0
    cap_percent: float = 48.0
    floor_noise: float = 2.0
    cap_noise: float = 1.8
    edge: float = 1.2
    edge_percent: float = 26.0
    edge_smooth: float = 3.0
    edge_noise: float = 1.5
    edge_share: float = 0.16
    edge_least: float = 6.0
    edge_most: float = 12.0
    last: float = 0.65
    last_percent: float = 62.0
    last_noise: float = 2.0


def envelope(traces: DataFrame, values: str = "ys", policy: EnvelopePolicy = EnvelopePolicy()) -> DataFrame:
    """Adds baseline: a broad low percentile, smoothed, between a floor and a cap of local percentiles, passing over into a
    local low percentile towards both ends, and nowhere above a last cap."""
    p, y, n, step, noise = policy, F.col("y_"), F.col("n_"), F.col("step_"), F.col("noise_")
    most = lambda k, least: F.greatest(F.lit(least), _div(n, k))
    rows = fixed(traces, y_=F.col(values), n_=F.size(values), step_=A.median_step(F.col("xs")), noise_=A.noise(F.col(values)))
    rows = fixed(
        rows, small_=A.odd_points(p.small, step, 9, most(8, 9)), broad_=A.odd_points(p.broad, step, 31, most(2, 31)), margin_=F.greatest(p.cap_noise * noise, F.lit(1.0)),
        wide_=F.greatest(_clip(p.edge_share * F.greatest(F.element_at("xs", -1) - F.get("xs", 0), step), p.edge_least, p.edge_most), step),
    )
    nodes = F.least(F.lit(21), F.greatest(F.lit(7), _div(F.col("broad_"), 5)))
    rows = fixed(
        rows, floor_=A.rank_filter(y, p.floor_percent, F.col("small_")), cap_=A.rank_filter(y, p.cap_percent, F.col("small_")),
        broad_low_=A.gaussian_filter(A.rank_filter(y, p.broad_percent, F.col("broad_")), F.greatest(F.col("broad_") / 8.0, F.lit(2.0))),
        edge_=A.gaussian_filter(A.rank_filter(y, p.edge_percent, A.odd_points(p.edge, step, 9, most(5, 9))), F.greatest(A.odd_points(p.edge_smooth, step, 21, most(3, 21)) / 7.0, F.lit(2.0))),
        last_=A.rank_filter(y, p.last_percent, A.odd_points(p.last, step, 9, most(6, 9))), lowest_=F.when(F.array_min("y_") >= 0, 0.0).otherwise(A.quantile(y, 0.005)),
    )
    between = F.zip_with(F.zip_with("broad_low_", "cap_", lambda b, c: F.least(b, c + F.col("margin_"))), "floor_", lambda b, f: F.greatest(b, f - F.greatest(p.floor_noise * noise, F.lit(1.0))))
    rows = fixed(rows, mid_=A.rank_filter(between, 50.0, nodes + 1 - nodes % 2), side_=F.zip_with("edge_", "y_", lambda e, v: F.least(e, v + F.greatest(p.edge_noise * noise, F.lit(1.0)))))
    x0, x1 = F.get("xs", 0), F.element_at("xs", -1)

    def share(inward: Column) -> Column:
        t = inward / F.col("wide_")
        return F.when(t < 1, 1 - t * t * (3 - 2 * t)).otherwise(0.0)

    def blended(x: Column, i: Column) -> Column:
        left, right, side = share(x - x0), share(x1 - x), F.get("side_", i)
        first = F.get("mid_", i) * (1 - left) + side * left
        return F.when(n < 25, F.get("mid_", i)).otherwise(first * (1 - right) + side * right)

    rows = fixed(rows, blend_=F.transform("xs", blended))
    capped = F.zip_with("blend_", "last_", lambda b, c: F.greatest(F.least(b, c + F.greatest(p.last_noise * noise, F.lit(1.0))), F.col("lowest_")))
    flat = F.transform("y_", lambda _: F.array_min("y_"))
    return rows.select(*traces.columns, F.when(n < 5, flat).otherwise(capped).alias("baseline"))


@dataclass(frozen=True)
class SeriesPolicy:
    """Constants of the robust series (fixed values): nodes, percentiles and weights, limits of distrust."""

    bins: int = 90
    least_bins: int = 18
    points_a_bin: int = 80
    percent: float = 0.38
    edge_percent: float = 0.55
    edge_weight: float = 8.0
    tip_weight: float = 25.0
    rounds: int = 8
    above: float = 0.8
    above_trust: float = 0.35
    below: float = 2.0
    below_trust: float = 0.65


def _percentile(values: np.ndarray, q: float) -> float:
    """The percentile of sorted values by linear interpolation."""
    place = (len(values) - 1) * q
    low = int(place)
    return float(values[low]) if low == place else float((low + 1 - place) * values[low] + (place - low) * values[low + 1])


def series_nodes(xs: np.ndarray, ys: np.ndarray, policy: SeriesPolicy = SeriesPolicy()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, fast): nodes of a trace on -1 to 1: a low percentile of each bin, and percentiles of both ends and tips."""
    p, n = policy, len(xs)
    u = 2 * (xs - xs[0]) / (xs[-1] - xs[0]) - 1
    bins = min(p.bins, max(p.least_bins, n // p.points_a_bin))
    inner = np.flatnonzero(u < 1)
    place = np.floor((u[inner] + 1) / 2 * bins).astype(int)
    order = np.lexsort((ys[inner], place))
    counts, sums = np.bincount(place), np.bincount(place, weights=u[inner])
    nodes, start, by_value = [], 0, ys[inner][order]
    for count, total in zip(counts.tolist(), sums.tolist(), strict=True):
        if count:
            nodes.append((total / count, _percentile(by_value[start : start + count], p.percent), 1.0, False))
            start += count
    edge, tip = max(8, n // 40), max(5, n // 180)
    for part, side in ((slice(0, tip), -1.0), (slice(max(n - tip, 0), n), 1.0)):
        nodes.append((side, _percentile(np.sort(ys[part]), 0.5), p.tip_weight, True))
    for part in (slice(0, edge), slice(max(n - edge, 0), n)):
        nodes.append((float(np.cumsum(u[part])[-1]) / len(u[part]), _percentile(np.sort(ys[part]), p.edge_percent), p.edge_weight, False))
    columns = zip(*sorted(nodes, key=lambda k: (k[0], k[2])), strict=True)
    return tuple(np.array(c) for c in columns)


def robust_series(u: np.ndarray, v: np.ndarray, w: np.ndarray, fast: np.ndarray, degree: int, policy: SeriesPolicy = SeriesPolicy()) -> np.ndarray:
    """Chebyshev coefficients through nodes; those far above or below the fit count less in the next round, fast ones never."""
    trust, degree = np.ones(len(u)), min(degree, len(u) - 2)
    basis, known = np.polynomial.chebyshev.chebvander(u, degree), {}
    for _ in range(policy.rounds):
        key = trust.tobytes()
        if key not in known:  # the trust often comes back, and the fit with it
            left = (basis.T * (w * trust)).T
            scale = np.sqrt(np.square(left).sum(0))
            known[key] = np.linalg.lstsq(left / scale, v * (w * trust), len(u) * np.finfo(float).eps)[0] / scale
        fit = known[key]
        off = v - basis @ fit
        spread = max(1.4826 * float(np.median(np.abs(off))), 1.0)
        trust = np.where(off > policy.above * spread, policy.above_trust, np.where(off < -policy.below * spread, policy.below_trust, 1.0))
        trust[fast] = 1.0
    return fit


def fitted_series(xs: Column, values: Column, degrees: tuple[int, ...]) -> Column:
    """Structs (degree, coefficients) of the robust series through values at xs; null for fewer than five points or no range."""

    @F.arrow_udf(ArrayType(A.VALUES))
    def solve(places: pa.Array, heights: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(A.lists(places), A.lists(heights), strict=True):
            enough = x is not None and y is not None and len(y) >= 5 and x[-1] > x[0]
            nodes = series_nodes(x, y) if enough else None
            found.append([robust_series(*nodes, d).tolist() for d in degrees] if enough else None)
        return pa.array(found, pa.list_(pa.list_(pa.float64())))

    return F.arrays_zip(F.array(*(F.lit(d) for d in degrees)).alias("degree"), solve(xs, values).alias("coefficients"))


@F.arrow_udf(A.VALUES)
def series_values(xs: pa.Array, coefficients: pa.Array) -> pa.Array:
    """A Chebyshev series over the range of xs, by Clenshaw's recurrence; null without coefficients."""

    def at(x: np.ndarray, series: np.ndarray) -> np.ndarray:
        u = 2 * (x - x[0]) / (x[-1] - x[0]) - 1
        a = b = np.zeros(len(x))
        for c in series[:0:-1]:
            a, b = 2 * u * a - b + c, a
        return series[0] + u * a - b

    rows = zip(A.lists(xs), A.lists(coefficients), strict=True)
    return pa.array([None if x is None or c is None else at(x, c) for x, c in rows], pa.list_(pa.float64()))


def with_series(traces: DataFrame, values: str, degree: int, name: str) -> DataFrame:
    """Adds the robust series through the values under a name; the 15th percentile where a trace is too short for one."""
    rows = fixed(traces, c_=F.get(fitted_series(F.col("xs"), F.col(values), (degree,)), F.lit(0))["coefficients"])
    level = F.coalesce(A.quantile(F.col(values), 0.15), F.lit(0.0))
    flat = A.let(level, lambda q: F.transform(values, lambda _: q))
    return rows.withColumn(name, F.coalesce(series_values(F.col("xs"), F.col("c_")), flat)).drop("c_")


def chebyshev_baseline(traces: DataFrame, degree: int = 10) -> DataFrame:
    """(pattern_id, baseline): a robust Chebyshev series of the degree."""
    return with_series(traces, "ys", degree, "baseline").select("pattern_id", "baseline")


def halo_support(rows: DataFrame, support: Column, smooth: Column) -> Column:
    """The smoothed 8th percentile of what lies above baseline in rows with n and step."""
    rest = F.zip_with("ys", "baseline", lambda y, b: F.greatest(y - b, F.lit(0.0)))
    return A.gaussian_filter(A.rank_filter(rest, 8.0, A.odd_points(support, F.col("step"), 21, F.col("n"))), F.greatest(smooth / F.col("step"), F.lit(2.0)))


def halo(traces: DataFrame, degree: int = 3, support: float = 7.0, smooth: float = 4.0) -> DataFrame:
    """(pattern_id, halo): the smooth amorphous share above the envelope; 0 for traces of fewer than 15 points."""
    rows = described(envelope(traces))
    rows = rows.withColumn("low", halo_support(rows, F.lit(support), F.lit(smooth)))
    rows = with_series(rows.select("pattern_id", "xs", "n", "low"), "low", min(max(degree, 2), 10), "s")
    return rows.select("pattern_id", F.transform("s", lambda v: F.when(F.col("n") >= 15, F.greatest(v, F.lit(0.0))).otherwise(0.0)).alias("halo"))


def peak_suppressed(traces: DataFrame, reach: float = 0.36, least_share: float = 0.18) -> DataFrame:
    """(pattern_id, base): the trace with straight lines under its peaks, never above itself, for the estimate of backgrounds.

    A trace of fewer than twelve points, or one that peaks cover nearly whole, stays what it is.
    """
    y, step = F.col("ys"), F.col("step")
    rows = fixed(described(traces), span=F.greatest(A.quantile(y, 0.99) - A.quantile(y, 0.05), F.lit(1.0)), reach=A.points(reach, step, 2))
    rows = fixed(rows, tops=A.find_peaks(y, F.greatest(4.5 * F.col("noise"), 0.025 * F.col("span"), F.lit(1.0)), A.points(0.10, step, 3)))
    rows = fixed(rows.where(F.size("ys") > 0), under=F.transform("xs", lambda _, i: F.exists("tops", lambda t: F.abs(t["i"] - i) <= F.col("reach"))))
    free = lambda c: F.filter(c, lambda _, i: ~F.get("under", i))
    rows = fixed(rows, line=A.interpolated(free("xs"), free("ys"), F.col("xs")), free=F.size(free("xs")))
    kept = (F.col("n") < 12) | (F.col("free") < F.greatest(F.lit(8), F.floor(least_share * F.col("n"))))
    filled = F.transform("ys", lambda v, i: F.when(kept | ~F.get("under", i), v).otherwise(F.least(F.get("line", i), v)))
    return rows.select("pattern_id", filled.alias("base"))


@dataclass(frozen=True)
class Profile:
    """Widths of a decomposition in degrees, and its low percentile (fixed values)."""

    support: float
    percentile: float
    support_smoothing: float
    broad_clip: float
    broad_smoothing: float


PROFILES = (Profile(16.0, 5.0, 4.5, 6.0, 4.5), Profile(12.0, 7.0, 3.5, 5.0, 3.8), Profile(9.0, 8.0, 2.8, 4.0, 3.0), Profile(7.0, 10.0, 2.0, 3.2, 2.4))


def decompose(traces: DataFrame, profile: Profile = PROFILES[1]) -> DataFrame:
    """(pattern_id, background, broad, crystalline, artifacts): instrument background, broad scattering, sharp signal, outliers.

    Outliers stand out from the median of five points around them and are bridged; the exponential branch of low angles is
    not among the backgrounds. The three curves add up to the bridged trace; traces of fewer than five points are all sharp.
    """
    p, y, n, step, noise = profile, F.col("ys"), F.col("n"), F.col("step"), F.col("noise")
    rows = fixed(described(traces), off=F.zip_with("ys", A.rank_filter(y, 50.0, F.lit(5)), lambda a, b: F.abs(a - b)))
    rows = fixed(rows, limit=F.greatest(10 * noise, A.quantile(F.col("off"), 0.998)))
    rows = fixed(rows, bad=F.transform("off", lambda v: (n >= 7) & (v > F.col("limit"))))
    rows = fixed(rows, good=F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("bad", i)))

    def bridged(v: Column, i: Column) -> Column:
        left, right = F.array_max(F.filter("good", lambda g: g < i)), F.array_min(F.filter("good", lambda g: g > i))
        line = lambda e: F.get(y, e["a"]) + (F.get(y, e["b"]) - F.get(y, e["a"])) * (i - e["a"]) / F.greatest(e["b"] - e["a"], F.lit(1))
        return F.when(F.get("bad", i) & (F.size("good") >= 2), A.let(F.struct(F.coalesce(left, right).alias("a"), F.coalesce(right, left).alias("b")), line)).otherwise(v)

    rows = fixed(rows, clean=F.transform(y, bridged))
    clean = F.col("clean")
    low = A.rank_filter(clean, min(max(p.percentile, 1.0), 30.0), A.odd_points(p.support, step, 41, F.greatest(F.lit(41), _div(2 * n, 3))))
    rows = fixed(rows, base=A.gaussian_filter(low, F.greatest(p.support_smoothing / step, F.lit(3.0))), floor=A.rank_filter(clean, 18.0, A.odd_points(1.2, step, 21, F.greatest(F.lit(21), _div(n, 5)))), bound=A.quantile(clean, 0.002) - 2 * noise)
    rows = fixed(rows, background=F.zip_with("base", "floor", lambda b, f: F.greatest(F.least(b, f - 0.4 * noise), F.col("bound"))))
    above = F.zip_with("clean", "background", lambda a, b: a - b)
    smooth = A.gaussian_filter(A.rank_filter(above, 18.0, A.odd_points(p.broad_clip, step, 11, F.greatest(F.lit(11), _div(n, 12)))), F.greatest(p.broad_smoothing / step, F.lit(2.0)))
    rows = fixed(rows, broad=F.transform(smooth, lambda v: F.greatest(v, F.lit(0.0))))
    short, zero = n < 5, F.transform(y, lambda _: F.lit(0.0))
    sharp = F.zip_with(F.zip_with("clean", "background", lambda a, b: a - b), "broad", lambda a, b: a - b)
    return rows.select(
        "pattern_id", F.when(short, zero).otherwise(F.col("background")).alias("background"), F.when(short, zero).otherwise(F.col("broad")).alias("broad"),
        F.when(short, y).otherwise(sharp).alias("crystalline"), F.col("bad").alias("artifacts"),
    )


#: Backgrounds that are tried, and degrees, supports and smoothings of the halo on top (fixed values).
TRIAL_BASES = ("snip", "series", "envelope")
TRIAL_DEGREES, TRIAL_SCALES = (2, 3, 4, 5), ((5.0, 3.0), (7.0, 4.0), (9.0, 5.0))


def choose_background(traces: DataFrame) -> DataFrame:
    """(pattern_id, base, degree, support, smoothing, score, baseline): of all trials, the background of least objective, the first of equals.

    A trial is a base curve with a halo on top: a row a trace, base and scale. The bases are SNIP, a series of degree 6 and the
    envelope. Traces of fewer than 15 points are left out.
    """
    long = described(traces.where(F.size("ys") >= 15))
    y, step, n, noise = F.col("ys"), F.col("step"), F.col("n"), F.col("noise")
    smooth = lambda percent, width, sigma: A.gaussian_filter(A.rank_filter(y, percent, A.odd_points(width, step, 5, n)), F.greatest(sigma / step, F.lit(2.0)))
    rows = fixed(long, span=F.greatest(A.quantile(y, 0.99) - A.quantile(y, 0.01), F.lit(1.0)), floor=smooth(12.0, 1.2, 0.6), support_curve=smooth(18.0, 5.0, 2.0), edge=F.greatest(F.lit(5), _div(n, 12)))
    rows = with_series(envelope(rows).withColumnRenamed("baseline", "envelope"), "ys", 6, "series").withColumn("snip", snip_arrays(y, 24))
    # the trials and the chosen curve read it, so it is written once
    rows = written(rows)
    bases = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("base"), F.col(name).alias("baseline")) for k, name in enumerate(TRIAL_BASES)))
    every = rows.withColumn("b", F.explode(bases)).select("*", "b.*").drop("b", *TRIAL_BASES)
    median = lambda a: A.quantile(a, 0.5)
    gap = F.zip_with("baseline", "floor", lambda b, f: b - f)
    every = fixed(every, gap=gap)
    ends = (F.abs(median(F.slice("gap", F.lit(1), F.col("edge")))) + F.abs(median(F.slice("gap", n - F.col("edge") + 1, F.col("edge"))))) / 2
    every = fixed(every, own_cost=2.2 * median(F.transform("gap", lambda v: F.abs(v))) + 2.5 * ends).drop("gap", "floor", "edge")
    scales = F.explode(F.array(*(F.struct(F.lit(a).alias("support"), F.lit(b).alias("smoothing")) for a, b in TRIAL_SCALES)))
    trials = every.withColumn("scale", scales).select("*", "scale.*").drop("scale")
    fits = lambda rows: fitted_series(F.col("xs"), halo_support(rows, F.col("support"), F.col("smoothing")), TRIAL_DEGREES)
    total = F.zip_with("baseline", series_values(F.col("xs"), F.col("coefficients")), lambda b, h: b + F.greatest(h, F.lit(0.0)))
    trials = trials.withColumn("fit", F.explode(fits(trials))).select("*", "fit.*").drop("fit")
    trials = fixed(trials, total=total)
    over = F.aggregate(F.zip_with("total", "ys", lambda t, v: F.greatest(t - v - noise, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v) / n
    bent = A.quantile(F.transform(A.differences(A.differences(F.col("total"))), lambda v: F.abs(v)), 0.95) / F.col("span")
    cost = F.col("own_cost") + 1.5 * median(F.zip_with("total", "support_curve", lambda t, b: F.abs(t - b))) + 8.0 * over
    trials = fixed(trials, score=cost / F.col("span") + 0.8 * bent + 0.003 * F.col("k") + 0.006 * (F.col("degree") - 2))
    # only numbers meet; the chosen trial's curve is made again from its trace
    best = F.min_by(F.struct("base", "degree", "support", "smoothing", "score"), F.struct(F.round("score", 9), "k", "degree", "support"))
    chosen = trials.groupBy("pattern_id").agg(best.alias("b")).select("pattern_id", "b.*").join(rows, "pattern_id")
    chosen = chosen.withColumn("baseline", F.coalesce(*(F.when(F.col("base") == name, F.col(name)) for name in TRIAL_BASES)))
    of_degree = F.filter(fits(chosen), lambda f: f["degree"] == F.col("degree"))
    chosen = chosen.withColumn("coefficients", F.get(of_degree, F.lit(0))["coefficients"]).withColumn("total", total)
    return chosen.select("pattern_id", "base", "degree", "support", "smoothing", "score", F.col("total").alias("baseline"))


# -- peaks ---------------------------------------------------------------------------------------------------


def default_width(traces: DataFrame, values: str = "ys") -> DataFrame:
    """Adds width: the median width of clear peaks of corrected traces, between 0.05 and 0.35; 0.18 without any."""
    y, step = F.col("v_"), F.col("s_")
    rows = fixed(traces, v_=F.col(values), s_=A.median_step(F.col("xs")), e_=A.noise(F.col(values)))
    high = F.greatest(5 * F.col("e_"), 0.04 * A.quantile(y, 0.95), F.lit(1.0))
    peaks = F.when((F.size(y) >= 5) & (F.array_max(y) > 0), A.find_peaks(y, high, A.points(0.11, step, 3), A.points(1.4, step, 5))).otherwise(F.expr(NO_PEAKS))
    rows = fixed(rows, w_=A.quantile(F.transform(peaks, lambda k: k["width"]), 0.5))
    return rows.select(*traces.columns, F.coalesce(_clip(F.col("w_") * step, 0.05, 0.35), F.lit(0.18)).alias("width"))


def peak_records(traces: DataFrame, values: str, most: int, factor: float, share: float, with_heights: bool) -> DataFrame:
    """Adds peaks, an array of (height, two_theta, area, fwhm), the highest first: the prominent maxima of corrected traces.

    with_heights adds the 160 highest maxima that stand out of the noise at all.
    """
    y, step, noise = F.col("v_"), F.col("s_"), F.col("e_")
    rows = fixed(traces, v_=F.col(values), s_=A.median_step(F.col("xs")), e_=A.noise(F.col(values)))
    wide = A.points(1.4, step, 5)
    rows = fixed(rows, p_=A.find_peaks(y, F.greatest(factor * noise, share * A.quantile(y, 0.95), F.lit(1.0)), A.points(0.11, step, 3), wide))
    if with_heights:
        rows = fixed(rows, level_=F.greatest(2.2 * noise, A.quantile(y, 0.65)))
        high = A.spaced(y, F.filter(A.maxima(y), lambda i: F.get(y, i) >= F.col("level_")), A.points(0.045, step, 2))
        top = F.slice(F.sort_array(F.transform(high, lambda i: F.struct(F.get(y, i).alias("y"), i.alias("i"))), asc=False), F.lit(1), F.lit(160))
        rows = fixed(rows, at_=F.array_union(F.transform("p_", lambda k: k["i"]), F.transform(top, lambda k: k["i"])))
        rows = fixed(rows, p_2=F.filter(A.measured(y, F.col("at_")), lambda k: (k["prominence"] >= F.greatest(1.15 * noise, F.lit(1.0))) & (k["width"] <= wide))).drop("p_").withColumnRenamed("p_2", "p_")
    record = lambda k: F.struct(
        F.greatest(k["y"], k["prominence"]).alias("height"), F.get("xs", k["i"]).alias("two_theta"), F.greatest(k["prominence"] * F.greatest(k["width"], F.lit(1.0)) * step, k["prominence"]).alias("area"),
        _clip(k["width"] * step, 0.05, 0.9).alias("fwhm"),
    )
    found = F.transform(F.filter("p_", lambda k: k["y"] > 0), record)
    ordered = F.sort_array(F.transform(found, lambda r: F.struct((-r["height"]).alias("k"), r["two_theta"].alias("t"), r.alias("r"))))
    none = F.expr("CAST(array() AS array<struct<height:double,two_theta:double,area:double,fwhm:double>>)")
    peaks = F.when((F.size(y) >= 5) & (F.array_max(y) > 0), F.slice(F.transform(ordered, lambda o: o["r"]), F.lit(1), F.lit(most))).otherwise(none)
    return rows.select(*traces.columns, peaks.alias("peaks"))


def line_records(traces: DataFrame, most: int = 80) -> DataFrame:
    """(pattern_id, peak_id, two_theta, height, area, fwhm) of corrected traces, the highest first: prominent peaks and the highest maxima."""
    got = peak_records(traces, "ys", most, 3.4, 0.020, True).select("pattern_id", F.posexplode("peaks").alias("peak_id", "p"))
    return got.select("pattern_id", (F.col("peak_id") + 1).alias("peak_id"), "p.two_theta", "p.height", "p.area", "p.fwhm")


def significant(trace: DataFrame, reach: float = 0.45, sigmas: float = 5.0) -> DataFrame:
    """(pattern_id, x, y, signal, significant) of the local maxima of a trace: whether they stand five noise levels above what is around.

    signal is the height over the 20th percentile within the reach, the noise that of first differences of the whole
    trace, or the MAD of a straight line's residual nearby, of at most 1.15 of it.
    """
    from peakloom.operators.signal import noise_and_step

    rows = trace.withColumn("mx", F.round(F.col("x") * 1000).cast("long"))
    near = Window.partitionBy("pattern_id").orderBy("mx").rangeBetween(-round(reach * 1000), round(reach * 1000))
    slope, shift = F.regr_slope("y", "x").over(near), F.regr_intercept("y", "x").over(near)
    rows = rows.withColumn("low", F.expr("percentile(y, 0.2)").over(near)).withColumn("lowest", F.min("y").over(near)).withColumn("points", F.count("*").over(near)).withColumn("rest", F.abs(F.col("y") - F.coalesce(slope * F.col("x") + shift, F.col("y"))))
    rows = rows.withColumn("spread", 1.4826 * F.expr("percentile(rest, 0.5)").over(near)).withColumn("p", F.lag("y").over(by_x())).withColumn("q", F.lead("y").over(by_x()))
    noise = noise_and_step(trace).select("pattern_id", "noise")
    tops = rows.where("p < y AND q < y").join(noise, "pattern_id")
    level = sigmas * F.least(F.greatest("noise", F.when(F.col("points") >= 8, F.col("spread")).otherwise(0.0)), 1.15 * F.col("noise"))
    signal = F.col("y") - F.col("low")
    return tops.select("pattern_id", "x", "y", F.round(signal, 6).alias("signal"), ((signal >= level) & (F.col("y") - F.col("lowest") >= level)).alias("significant"))


def peak_mask(trace: DataFrame, peaks: DataFrame, half: float) -> DataFrame:
    """Adds masked: whether a peak (pattern_id, peak) lies within `half` of the point."""
    from peakloom.operators.ranges import range_join

    hit = range_join(trace.select("pattern_id", "x"), peaks.select("pattern_id", "peak"), "x", "peak", half, ["pattern_id"]).select("pattern_id", "x").distinct().withColumn("masked", F.lit(True))
    return trace.join(hit, ["pattern_id", "x"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


# -- composites ----------------------------------------------------------------------------------------------


def prepare_observed(traces: DataFrame, window: int = 5) -> DataFrame:
    """(pattern_id, background, target, width, peaks): smoothed, the envelope taken off and cut at 0, then widths and peaks."""
    rows = fixed(traces.select("pattern_id", "xs", "ys"), smooth=A.quadratic_smooth(F.col("ys"), F.lit(window)))
    rows = envelope(rows, "smooth")
    rows = fixed(rows, target=F.zip_with("smooth", "baseline", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    rows = peak_records(default_width(rows, "target"), "target", 150, 4.4, 0.035, False)
    by_place = F.sort_array(F.transform("peaks", lambda p: F.struct(p["two_theta"].alias("two_theta"), p["height"].alias("height"), p["area"].alias("area"), p["fwhm"].alias("fwhm"))))
    return rows.select("pattern_id", F.col("baseline").alias("background"), "target", "width", by_place.alias("peaks"))


def auto_preprocess(traces: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(pattern_id, method, window, passes, profile, smooth, corrected, background, broad, crystalline, artifacts): features, plan, smoothing, decomposition.

    The plan is a column expression over the features; without weights the profile is the fallback, 1.
    """
    rows = traces.select("pattern_id", "xs", "ys").join(features(traces).select("pattern_id", *smoothing_plan()), "pattern_id")
    one = lambda v: F.when(F.col("method") == "gaussian", A.gaussian_filter(v, F.col("sigma"))).otherwise(A.quadratic_smooth(v, F.col("window")))
    rows = fixed(rows, once=one(F.col("ys")))
    rows = fixed(rows, smooth=F.when(F.col("passes") > 1, one(F.col("once"))).otherwise(F.col("once")))
    smoothed = rows.select("pattern_id", "xs", F.col("smooth").alias("ys"), "method", "window", "passes")
    if weights is None:
        chosen, profiles = smoothed.withColumn("profile", F.lit(1)), PROFILES[1:2]
    else:
        chosen, profiles = smoothed.join(selected_profile(features(smoothed), weights).select("pattern_id", "profile"), "pattern_id"), PROFILES
    parts = None
    for settings in profiles:
        mine = chosen.where(F.col("profile") == PROFILES.index(settings))
        part = decompose(mine, settings).join(mine.select("pattern_id", "method", "window", "passes", "profile", F.col("ys").alias("smooth")), "pattern_id")
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("corrected", F.zip_with("smooth", "background", lambda a, b: a - b))


@F.arrow_udf(ArrayType(BooleanType()))
def near_places(xs: pa.Array, places: pa.Array, half: pa.Array) -> pa.Array:
    """Whether a place lies within `half` of each x, by distances of nine decimals."""

    def near(x: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
        marks = np.zeros(len(x), bool)
        for t in at:
            marks |= np.abs(t - x) < reach + 5e-10
        return marks

    return pa.array([near(x, t, h) for x, t, h in zip(A.lists(xs), A.lists(places), half.to_pylist(), strict=True)], pa.list_(pa.bool_()))


def training_records(trace: DataFrame, low: float = 5.0, high: float = 90.0, points: int = 4096, half: float = 0.18) -> DataFrame:
    """(pattern_id, x, raw, background, corrected, masked) as arrays: traces (pattern_id, x, y) on one grid, the envelope under
    them, marks at their peaks.

    Patterns with fewer than 16 good points, or as few grid points inside, are left out; outside a trace all curves are 0.
    """
    packed = on_grid(as_arrays(well_formed(trace)), low, high, points).select("pattern_id", F.col("gx").alias("x"), F.col("gy").alias("raw"), F.get("xs", 0).alias("x0"), F.element_at("xs", -1).alias("x1"))
    rows = fixed(packed, before=F.size(F.filter("x", lambda v: v < F.col("x0"))), inside=F.size(F.filter("x", lambda v: v.between(F.col("x0"), F.col("x1")))))
    rows = rows.where("inside >= 16")
    rows = envelope(rows.withColumn("xs", F.slice("x", F.col("before") + 1, F.col("inside"))).withColumn("ys", F.slice("raw", F.col("before") + 1, F.col("inside"))))
    nothing = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = fixed(rows.drop("xs", "ys"), background=F.concat(nothing(F.col("before")), F.col("baseline"), nothing(F.size("x") - F.col("before") - F.col("inside"))))
    rows = fixed(rows, corrected=F.zip_with("raw", "background", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    rows = peak_records(rows.withColumnRenamed("x", "xs"), "corrected", 80, 3.4, 0.020, True)
    masked = near_places(F.col("xs"), F.transform("peaks", lambda p: p["two_theta"]), F.lit(half))
    return rows.select("pattern_id", F.col("xs").alias("x"), "raw", "background", "corrected", masked.alias("masked"))


def write_training_records(records: DataFrame, path: str) -> None:
    """Appends records with a column source to Parquet, a folder a source; a source's tasks write its files."""
    records.repartition("source").write.mode("append").partitionBy("source").parquet(path)


def background_on_grid(trace: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds background: the user's nodes (pattern_id, nx, ny) interpolated, flat beyond their ends."""
    return interpolate(trace, nodes, "background")
