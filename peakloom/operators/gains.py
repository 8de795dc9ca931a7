"""What a further phase would explain of patterns whose first phases are chosen: residual lines, gains, their ranking.

Curves are rows (pattern_id, g, target, total, residual) on a grid of degrees: the corrected trace, what the chosen
phases explain of it, and what is left. Records are observed lines (pattern_id, peak_id, two_theta, height, area, fwhm),
sticks the lines of chosen phases (pattern_id, stick), lines those of candidates (pattern_id, entry_id, peak_index,
two_theta, intensity).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from peakloom.functions.arrays import lists
from peakloom.operators.fitting import combined_gain, exhausted, gain_stage, hidden_gain
from peakloom.operators.ranges import range_join
from peakloom.operators.storage import shuffled, written

OWN = ["pattern_id", "entry_id"]
LOW, STEP = 5.0, 0.1
#: Distances are compared rounded to nine digits; the joins before reach so much further, so that a distance of exactly the tolerance is never lost.
SLACK = 1e-6


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _cell(place: Column) -> Column:
    """The grid point nearest to a place."""
    return F.round((place - LOW) / STEP).cast("int")


def _percentile(e: str, p: float) -> Column:
    return F.expr(f"percentile({e}, {p})")


# -- curves --------------------------------------------------------------------------------------------------


def fit_weights(curve: DataFrame, peaks: DataFrame, boost: float = 2.5) -> DataFrame:
    """Adds w to curves: the inverse root of the target between two percentiles, more around peaks (pattern_id, g), 1 in the median."""
    own = Window.partitionBy("pattern_id")
    y = F.greatest("target", F.lit(0.0))
    rows = curve.withColumn("__y", y).withColumn("__q", F.expr("percentile(__y, array(0.55, 0.96))").over(own)).withColumn("__n", F.count("*").over(own))
    floor = F.greatest(F.col("__q")[0], F.lit(1.0))
    base = 1 / F.sqrt(F.least(F.greatest("__y", floor), F.greatest(F.col("__q")[1], floor)))
    half = F.greatest(F.lit(2), F.floor(F.col("__n") / 900)).cast("int")
    sizes = curve.groupBy("pattern_id").agg(F.count("*").alias("__n"))
    near = peaks.join(sizes, "pattern_id").select("pattern_id", F.explode(F.sequence(F.col("g") - half, F.col("g") + half)).alias("g")).distinct().withColumn("__near", F.lit(True))
    rows = rows.withColumn("w", base).join(shuffled(near), ["pattern_id", "g"], "left").withColumn("w", F.col("w") * F.when(F.col("__near"), boost).otherwise(1.0))
    return rows.withColumn("w", F.col("w") / F.greatest(F.expr("percentile(w, 0.5)").over(own), F.lit(1e-9))).drop("__y", "__q", "__n", "__near")


def _trapezoid(value: Column) -> Column:
    """Integral over grid points at distance 1: the sum less half of both ends."""
    return F.sum(value) - (F.min_by(value, "g") + F.max_by(value, "g")) / 2


def misfit(calculated: Column, penalty: float) -> Column:
    """Distance from the target, an excess counted `penalty` times."""
    over = calculated - F.col("target")
    return F.when(over > 0, over * penalty).otherwise(-over)


def fit_summary(curve: DataFrame, penalty: float = 3.0) -> DataFrame:
    """(pattern_id, fit, target_area, residual_area, residual_share, error) of weighted curves."""
    w, r = F.greatest("w", F.lit(0.0)), F.col("target") - F.col("total")
    g = curve.groupBy("pattern_id").agg(
        F.sum(w * r * r).alias("rr"), F.sum(w * F.col("target") * F.col("target")).alias("yy"), _trapezoid(w * F.col("target")).alias("target_area"),
        _trapezoid(w * F.col("residual")).alias("residual_area"), _trapezoid(w * misfit(F.col("total"), penalty)).alias("error"),
    )
    fit = F.least(F.greatest(100 * (1 - F.col("rr") / F.nullif("yy", F.lit(0.0))), F.lit(0.0)), F.lit(100.0))
    return g.select("pattern_id", fit.alias("fit"), "target_area", "residual_area", (F.col("residual_area") / F.greatest("target_area", F.lit(1e-12))).alias("residual_share"), "error")


FACTORS, EXCESS = tuple(round(0.05 + 0.05 * k, 2) for k in range(27)), 5.0


@F.arrow_udf(StructType().add("scale", DoubleType()).add("less", DoubleType()))
def _fit(places: pa.Array, targets: pa.Array, totals: pa.Array, weights: pa.Array, at: pa.Array, heights: pa.Array) -> pa.Array:
    """Of a curve and a profile on its grid: the best scale, and the error of the residual that the profile takes away with it."""
    scales, less, factors = [], [], np.array((0.0, *FACTORS))
    for g, target, total, weight, points, p in zip(*(lists(x) for x in (places, targets, totals, weights, at, heights)), strict=True):
        if not len(g):
            scales.append(0.0), less.append(0.0)
            continue
        order = np.argsort(g, kind="stable")
        k = order[np.minimum(np.searchsorted(g, points, sorter=order), len(g) - 1)]
        met = (g[k] == points) & ~np.isnan(p) & ~np.isnan(weight[k])
        k, p = k[met], p[met]
        target, total, weight = target[k], total[k], weight[k]
        rest, used, scale = np.maximum(target - total, 0.0), weight > 0, 0.0
        pw = (weight * p)[used]
        whole = pw @ p[used]
        initial = pw @ rest[used] / whole if whole else 0.0
        if initial > 1e-12:
            # where the profile is 0 the error is the same for all scales
            off = (total - target)[used] + np.outer(initial * factors, p[used])
            scale = initial * factors[np.argmin(np.round(np.where(off > 0, off * EXCESS, -off) @ weight[used], 9))]
        off = p * scale - rest
        scales.append(scale), less.append(weight @ (rest - np.where(off > 0, off * 3.0, -off)))
    return pa.StructArray.from_arrays([pa.array(scales, pa.float64()), pa.array(less, pa.float64())], ["scale", "less"])


def _fits(curve: DataFrame, profiles: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, scale, less) by _fit(); a profile that its curve doesn't meet has 0 for both.

    A pattern's curve and a candidate's profile are one row: trials are made in it, and no row a grid point or trial is shuffled.
    profiles come as rows (pattern_id, entry_id, g, p) or packed (pattern_id, entry_id, profile).
    """
    if "profile" not in profiles.columns:
        profiles = profiles.groupBy(*OWN).agg(F.collect_list(F.struct("g", "p")).alias("profile"))
    packed = curve.groupBy("pattern_id").agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("target", "total", "w")))).alias("curve"))
    rows = profiles.join(packed, "pattern_id", "left").withColumn("curve", F.coalesce("curve", F.array().cast(packed.schema["curve"].dataType)))
    fit = _fit("curve.g", "curve.target", "curve.total", "curve.w", F.transform("profile", lambda v: v["g"].cast("long")), F.transform("profile", lambda v: F.coalesce(v["p"], F.lit(float("nan")))))
    return rows.select(*OWN, fit.alias("fit")).select(*OWN, "fit.*")


def residual_scales(curve: DataFrame, profiles: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, scale): how much of a candidate's profile (as in _fits()) fits on top of the total.

    The least-squares share of the residual, by the best of 27 factors; an excess over the target counts five times. 0
    where no factor lowers the error.
    """
    return _fits(curve, profiles).select(*OWN, "scale")


def profile_gains(curve: DataFrame, profiles: DataFrame, remaining: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, profile_gain): the share of the residual's error that a candidate's best scaled profile takes away, of what remains.

    Error is the weighted area between curve and target, an excess counted three times; profiles that fit nowhere gain 0.
    """
    # where a profile is 0 the error stays, so the differences at its points suffice
    whole = curve.groupBy("pattern_id").agg(F.sum(F.col("w") * F.greatest(F.col("target") - F.col("total"), F.lit(0.0))).alias("before"))
    share = F.least(F.greatest(F.col("less") / F.greatest("before", F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    rows = _fits(curve, profiles).join(whole, "pattern_id", "left").join(remaining, "pattern_id", "left")
    return rows.select(*OWN, F.when(F.col("scale") > 0, F.coalesce(F.col("remaining") * share, F.lit(0.0))).otherwise(0.0).alias("profile_gain"))


# -- records -------------------------------------------------------------------------------------------------


def _floors(curve: DataFrame) -> DataFrame:
    """(pattern_id, residual_floor, deficit_floor, strength_floor) by percentiles of what is positive."""
    rows = curve.withColumn("r", F.when(F.col("residual") > 0, F.col("residual"))).withColumn("t", F.when(F.col("target") > 0, F.col("target"))).withColumn("c", F.when(F.col("total") > 0, F.col("total")))
    g = rows.groupBy("pattern_id").agg(_percentile("r", 0.72).alias("r72"), _percentile("r", 0.93).alias("r93"), _percentile("r", 0.65).alias("r65"), _percentile("t", 0.80).alias("t80"), _percentile("c", 0.55).alias("c55"))
    most = lambda *c: F.greatest(*(F.coalesce(x, F.lit(1.0)) for x in c), F.lit(1.0))
    return g.select("pattern_id", most(0.28 * F.col("r72"), 0.045 * F.col("r93")).alias("residual_floor"), most(0.20 * F.col("r65"), 0.025 * F.col("t80")).alias("deficit_floor"), most(F.col("c55")).alias("strength_floor"))


def residual_lines(records: DataFrame, sticks: DataFrame, curve: DataFrame, fwhm: float = 0.18) -> DataFrame:
    """Records that the chosen phases don't explain: no stick nearby, and a residual that stands out at their place.

    Where the total is strong itself, the residual must reach 45 % of the target.
    """
    line = F.greatest("fwhm", F.lit(fwhm))
    reach = F.greatest(_clamp(line * 1.45, 0.24, 0.95), F.lit(min(max(3.0 * fwhm, 0.32), 0.72)))
    open_ = records.withColumn("__reach", reach)
    near = range_join(shuffled(sticks.select("pattern_id", "stick")), open_.select("pattern_id", "peak_id", F.col("two_theta").alias("__place"), "__reach"), "stick", "__place", "__reach", ["pattern_id"], width=1.5)
    free = open_.join(shuffled(near.select("pattern_id", "peak_id").distinct()), ["pattern_id", "peak_id"], "left_anti").drop("__reach")
    at = curve.select("pattern_id", F.col("g").alias("__g"), F.col("target").alias("__t"), F.col("total").alias("__c"), F.col("residual").alias("__r"))
    rows = free.withColumn("__g", _cell(F.col("two_theta"))).join(shuffled(at), ["pattern_id", "__g"]).join(_floors(curve), "pattern_id")
    needed = F.when(F.col("__c") >= F.col("strength_floor"), F.greatest(0.45 * F.greatest("__t", F.lit(1.0)), F.col("residual_floor"))).otherwise(F.col("residual_floor"))
    return rows.where(F.col("__r") > needed).select(*records.columns)


def overlap_lines(records: DataFrame, sticks: DataFrame, curve: DataFrame, fwhm: float = 0.18) -> DataFrame:
    """Records at a stick whose height the total misses by 12 % or more: (pattern_id, peak_id, two_theta, fwhm, height, area) of what is missing."""
    reach = _clamp(F.greatest("fwhm", F.lit(max(fwhm, 0.05))) * 1.7, 0.28, 0.85)
    rows = records.withColumn("reach", reach).withColumn("half", F.greatest("reach", F.col("fwhm") * 1.25))
    near = range_join(shuffled(sticks.select("pattern_id", "stick")), rows.select("pattern_id", "peak_id", F.col("two_theta").alias("place"), "reach"), "stick", "place", "reach", ["pattern_id"], width=1.5)
    rows = rows.join(shuffled(near.select("pattern_id", "peak_id").distinct()), ["pattern_id", "peak_id"], "left_semi")
    cells = rows.withColumn("g", F.explode(F.sequence(F.ceil(F.round((F.col("two_theta") - F.col("half") - LOW) / STEP, 6)).cast("int"), F.floor(F.round((F.col("two_theta") + F.col("half") - LOW) / STEP, 6)).cast("int"))))
    top = cells.join(shuffled(curve.select("pattern_id", "g", "target", "total", "residual")), ["pattern_id", "g"]).groupBy("pattern_id", "peak_id").agg(F.max("target").alias("t"), F.max("total").alias("c"), F.max("residual").alias("r"))
    rows = rows.join(shuffled(top), ["pattern_id", "peak_id"]).join(_floors(curve), "pattern_id").withColumn("missing", F.greatest(F.col("t") - F.col("c"), "r", F.lit(0.0)))
    share = F.col("missing") / F.greatest("t", F.lit(1e-12))
    kept = rows.where((F.col("missing") >= F.col("deficit_floor")) & (share >= 0.12))
    return kept.select("pattern_id", "peak_id", "two_theta", "fwhm", F.col("missing").alias("height"), F.greatest(F.col("area") * share, "missing").alias("area"))


def gain_positions(records: DataFrame, stage: Column) -> DataFrame:
    """(pattern_id, peak_id, two_theta, nth): what a further search takes: the largest areas between 5 and 60 degrees, 12 or, hidden, 10."""
    nth = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("area"), "peak_id"))
    return records.where(F.col("two_theta").between(5, 60)).withColumn("nth", nth).where(F.col("nth") <= F.when(stage == "hidden", 10).otherwise(12)).select("pattern_id", "peak_id", "two_theta", "nth")


def signal_factor(records: DataFrame, residual: DataFrame) -> DataFrame:
    """(pattern_id, signal): how far the residual records stand out of all, 0 where they are small."""
    whole = records.groupBy("pattern_id").agg(F.sum("area").alias("all"))
    rest = residual.groupBy("pattern_id").agg(F.max("area").alias("top"), F.sum("area").alias("rest"))
    rows = whole.join(rest, "pattern_id", "left").na.fill(0.0, ["top", "rest"])
    top, share = F.col("top") / F.nullif("all", F.lit(0.0)), F.col("rest") / F.nullif("all", F.lit(0.0))
    small = F.coalesce((top < 0.025) & (share < 0.10), F.lit(True))
    return rows.select("pattern_id", F.when(small, 0.0).otherwise(F.least(F.pow(F.greatest(top / 0.08, share / 0.30), F.lit(0.85)), F.lit(1.0))).alias("signal"))


def noise_floor(curve: DataFrame) -> DataFrame:
    """(pattern_id, floor): below it a corrected trace is noise."""
    rows = curve.withColumn("m", F.expr("percentile(target, 0.5)").over(Window.partitionBy("pattern_id")))
    g = rows.groupBy("pattern_id").agg(F.first("m").alias("m"), _percentile("abs(target - m)", 0.5).alias("mad"), _percentile("target", 0.2).alias("p20"))
    return g.select("pattern_id", F.greatest(F.col("m") + 2.7 * 1.4826 * F.col("mad"), "p20").alias("floor"))


# -- candidates ----------------------------------------------------------------------------------------------


def ranked_lines(lines: DataFrame, most: int, least: float = 3.0) -> DataFrame:
    """The `most` strongest lines of every candidate with rank from 0."""
    rank = F.row_number().over(Window.partitionBy(*OWN).orderBy(F.desc("intensity"), "peak_index")) - 1
    return lines.where((F.col("intensity") >= least) & F.col("two_theta").between(5, 120)).withColumn("rank", rank).where(F.col("rank") < most)


def near_any(lines: DataFrame, places: DataFrame, tolerance: float, name: str) -> DataFrame:
    """Adds a flag to lines: whether a place (pattern_id, place) lies within the tolerance."""
    hit = range_join(shuffled(lines.select(*OWN, "peak_index", "two_theta")), places.select("pattern_id", "place"), "two_theta", "place", tolerance + SLACK, ["pattern_id"])
    hit = hit.where(F.round(F.abs(F.col("place") - F.col("two_theta")), 9) <= tolerance).select(*OWN, "peak_index").distinct().withColumn(name, F.lit(True))
    return lines.join(shuffled(hit), [*OWN, "peak_index"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def novelty(lines: DataFrame, sticks: DataFrame, fwhm: float = 0.18) -> DataFrame:
    """(pattern_id, entry_id, novelty): the share of a candidate's strong lines away from all sticks, as a factor up to 1."""
    strong = near_any(ranked_lines(lines, 32), sticks.select("pattern_id", F.col("stick").alias("place")), min(max(2.2 * fwhm, 0.26), 0.75), "covered")
    w, new = F.pow(F.greatest(F.col("intensity") / 100, F.lit(0.03)), F.lit(0.55)), ~F.col("covered")
    g = strong.groupBy(*OWN).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(F.when(new, w).otherwise(0.0)).alias("nw"), F.sum((new & (F.col("rank") < 12)).cast("int")).alias("fresh"), F.sum((~new & (F.col("rank") < 8)).cast("int")).alias("top"))
    share = F.col("nw") / F.col("w")
    factor = F.least(F.pow(share * F.when(F.col("top") >= 6, 0.35).otherwise(1.0) / 0.55, F.lit(1.35)), F.lit(1.0))
    return g.select(*OWN, F.when((F.col("n") < 3) | (F.col("fresh") < 2) | (share < 0.12), 0.0).otherwise(factor).alias("novelty"))


def line_gate(lines: DataFrame, records: DataFrame, fwhm: float = 0.18) -> DataFrame:
    """(pattern_id, entry_id, gate): agreement of a candidate's lines with the residual records both ways, 0 below either threshold."""
    tol = min(max(2.4 * fwhm, 0.28), 0.75)
    nth = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("area"), "peak_id"))
    first = records.withColumn("nth", nth)
    strong = near_any(ranked_lines(lines, 28), first.where("nth <= 32").select("pattern_id", F.col("two_theta").alias("place")), tol, "matched")
    w = F.pow(F.greatest(F.col("intensity") / 100, F.lit(0.02)), F.lit(0.55)) / F.sqrt(F.col("rank") + 1)
    g = strong.groupBy(*OWN).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(F.when(F.col("matched"), w).otherwise(0.0)).alias("mw"), F.sum((F.col("matched") & (F.col("rank") < 10)).cast("int")).alias("top"))
    major = first.where("nth <= 14").select("pattern_id", "peak_id", F.col("two_theta").alias("place"), "area")
    met = range_join(strong.select(*OWN, "two_theta"), major, "two_theta", "place", tol + SLACK, ["pattern_id"]).where(F.round(F.abs(F.col("place") - F.col("two_theta")), 9) <= tol)
    met = met.groupBy(*OWN, "peak_id").agg(F.first("area").alias("area")).groupBy(*OWN).agg(F.count("*").alias("found"), F.sum("area").alias("found_area"))
    areas = major.groupBy("pattern_id").agg(F.sum("area").alias("area"))
    rows = g.join(areas, "pattern_id").join(met, OWN, "left").na.fill(0, ["found", "found_area"])
    coverage, share = F.col("mw") / F.col("w"), F.col("found_area") / F.greatest("area", F.lit(1e-12))
    shut = (F.col("n") < 3) | (F.col("top") < 2) | (coverage < 0.24) | (F.col("found") < 2) | (share < 0.16)
    return rows.select(*OWN, F.when(shut, 0.0).otherwise(F.least(0.45 * coverage + 0.55 * share, F.lit(1.0))).alias("gate"))


def hidden_presence(lines: DataFrame, observed: DataFrame, residual: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, presence): how much of a candidate's strong lines all records and the residual ones cover, gated by counts."""
    strong = near_any(ranked_lines(lines, 36), observed.select("pattern_id", F.col("two_theta").alias("place")), 0.42, "full")
    strong = near_any(strong, residual.select("pattern_id", F.col("two_theta").alias("place")), 0.48, "rest")
    w, short = F.sqrt("intensity") / F.sqrt(F.col("rank") + 1), F.col("rank") < 24
    part = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    g = strong.groupBy(*OWN).agg(
        F.count("*").alias("n"), (part(F.col("full")) / F.sum(w)).alias("full"), F.sum(F.col("full").cast("int")).alias("n_full"),
        (part(F.col("rest") & short) / part(short)).alias("rest"), F.sum((F.col("rest") & short).cast("int")).alias("n_rest"),
    )
    needed = F.when(F.col("n") >= 12, 5).when(F.col("n") >= 8, 4).otherwise(3)
    shut = (F.col("n") < 3) | (F.col("n_full") < needed) | (F.col("n_rest") < needed) | (F.col("full") < 0.18) | (F.col("rest") < 0.22)
    return g.select(*OWN, F.when(shut, 0.0).otherwise(F.least((0.25 + 0.75 * F.col("full")) * F.pow(F.col("rest") / 0.48, F.lit(1.15)), F.lit(1.0))).alias("presence"))


def coherence(pairs: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, coherence) of matched (area, intensity, w): how well log area over intensity agree, less two outliers at most.

    Candidates with fewer than three pairs are not among the result.
    """
    own = Window.partitionBy(*OWN)
    rows = pairs.where("area > 0 AND intensity > 0").withColumn("ratio", F.log(F.col("area") / F.col("intensity"))).withColumn("n", F.count("*").over(own)).where("n >= 3")
    rows = rows.withColumn("off", F.round(F.abs(F.col("ratio") - F.expr("percentile(ratio, 0.5)").over(own)), 9))
    keep = F.greatest(F.lit(3), F.col("n") - F.least(F.lit(2), F.floor(F.col("n") / 5)))
    rows = rows.withColumn("k", F.row_number().over(own.orderBy("off", "peak_index"))).where(F.col("k") <= keep)
    g = rows.groupBy(*OWN).agg(F.first("n").alias("n"), F.count("*").alias("kept"), (F.sum(F.col("w") * F.col("off")) / F.sum("w")).alias("mean"))
    return g.select(*OWN, F.least(F.greatest(F.exp(-F.col("mean") / 0.95) * F.col("kept") / F.col("n"), F.lit(0.05)), F.lit(1.0)).alias("coherence"))


def line_gains(lines: DataFrame, residual: DataFrame, observed: DataFrame, sticks: DataFrame, curve: DataFrame, remaining: DataFrame, overlapping: bool = False, fwhm: float = 0.18) -> DataFrame:
    """(pattern_id, entry_id, gain): what the residual records give to a candidate's lines, up to what remains (pattern_id, remaining).

    The largest records take the nearest line within a tolerance by their width. Lines without a record speak against
    the candidate: most if nothing is observed there, less if a stick, the total or any peak explains them.
    """
    tol = min(max(2.4 * fwhm, 0.26), 0.72)
    strong = ranked_lines(lines, 42).withColumn("w", F.pow(F.greatest(F.col("intensity") / 100, F.lit(0.025)), F.lit(0.55)) / F.sqrt(F.col("rank") + 1))
    strong = written(strong)
    nth = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("area"), "peak_id"))
    first = residual.withColumn("nth", nth).withColumn("reach", F.greatest(F.lit(tol), F.least(F.lit(0.95), 1.7 * F.col("fwhm"))))
    pairs = range_join(shuffled(strong.select(*OWN, "peak_index", "two_theta", "rank", "intensity", "w")), first.select("pattern_id", "nth", F.col("two_theta").alias("place"), "area", "reach"), "two_theta", "place", "reach", ["pattern_id"], width=1.5)
    delta = F.round(F.abs(F.col("place") - F.col("two_theta")), 9)
    # records in order of area take their nearest line that is free
    fields = "nth:int,delta:double,peak_index:int,rank:int,intensity:double,w:double,area:double,q:double"
    one = F.struct("nth", delta.alias("delta"), "peak_index", "rank", "intensity", "w", "area", (1 - delta / F.col("reach")).alias("q"))
    packed = pairs.groupBy(*OWN).agg(F.array_sort(F.collect_list(one)).alias("p"))
    take = lambda a, v: F.when(F.exists(a, lambda t: (t["nth"] == v["nth"]) | (t["peak_index"] == v["peak_index"])), a).otherwise(F.array_append(a, v))
    met = packed.select(*OWN, F.explode(F.aggregate("p", F.expr(f"CAST(array() AS array<struct<{fields}>>)"), take)).alias("m")).select(*OWN, "m.*")
    met = written(met)
    areas = first.groupBy("pattern_id").agg(F.sum("area").alias("all"), F.sum(F.when(F.col("nth") <= 14, F.col("area"))).alias("major_all"))
    useful = met.groupBy(*OWN).agg(
        F.sum(F.col("area") * (0.35 + 0.65 * F.col("q"))).alias("useful"), F.sum(F.when(F.col("nth") <= 14, F.col("area")).otherwise(0.0)).alias("major"), F.sum("w").alias("m"),
        F.sum(F.when(F.col("rank") < 12, F.col("w")).otherwise(0.0)).alias("m_top"), F.sum((F.col("rank") < 12).cast("int")).alias("n_top"),
    )
    left = strong.join(shuffled(met.select(*OWN, "peak_index")), [*OWN, "peak_index"], "left_anti")
    left = near_any(left, sticks.select("pattern_id", F.col("stick").alias("place")), tol, "repeated")
    left = near_any(left, observed.select("pattern_id", F.col("two_theta").alias("place")), tol, "seen")
    at = curve.select("pattern_id", F.col("g").alias("g"), F.col("target").alias("t"), F.col("total").alias("c")).join(_floors(curve).select("pattern_id", "strength_floor"), "pattern_id")
    left = left.withColumn("g", _cell(F.col("two_theta"))).join(shuffled(at), ["pattern_id", "g"], "left")
    profile = F.coalesce(F.col("c") >= F.greatest("strength_floor", 0.35 * F.col("t")), F.lit(False))
    soft = 0.15 if overlapping else None
    kind = F.when(F.col("repeated"), "stick").when(profile, "profile").when(F.col("seen"), "seen").otherwise("absent")
    left = left.withColumn("kind", kind)
    total = lambda cond, x: F.sum(F.when(cond, F.col("w") * x).otherwise(0.0))
    k = F.col("kind")
    against = left.groupBy(*OWN).agg(
        total(k == "absent", F.when(F.col("rank") < 10, 3.25).otherwise(1.35)).alias("absent"), F.sum(((k == "absent") & (F.col("rank") < 12)).cast("int")).alias("absent_top"),
        (total(k == "stick", F.lit(0.80)) + total(k == "profile", F.lit(0.65)) if soft is None else F.lit(0.0)).alias("repeated"),
        (total(k == "seen", F.lit(0.50)) + (F.lit(0.0) if soft is None else total(k.isin("stick", "profile"), F.lit(soft)))).alias("only"),
    )
    sizes = strong.groupBy(*OWN).agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") < 12, F.col("w")).otherwise(0.0)).alias("top_w"), F.sum((F.col("rank") < 12).cast("int")).alias("checked"))
    rows = sizes.join(useful, OWN).join(against, OWN, "left").join(coherence(met), OWN, "left").join(areas, "pattern_id").join(remaining, "pattern_id")
    rows = rows.na.fill(0.0, ["absent", "repeated", "only"]).na.fill(0, ["absent_top"]).na.fill(0.0, ["coherence"])
    coverage, major = F.col("useful") / F.greatest("all", F.lit(1e-12)), F.col("major") / F.greatest("major_all", F.lit(1e-12))
    support = F.col("m") / (F.col("m") + 3.4 * F.col("absent") + 1.6 * F.col("repeated") + F.col("only"))
    anchor = F.col("m_top") / F.greatest("top_w", F.lit(1e-12))
    none = (
        (F.col("n") < 3) | ((F.col("n_top") < 2) & (anchor < 0.20)) | ((F.col("absent_top") >= F.greatest(F.lit(3), F.ceil(0.34 * F.col("checked")))) & (F.col("absent") > 1.15 * F.col("m")))
        | (major < 0.18) | (coverage < 0.035) | (support < 0.22) | (anchor < 0.16) | (F.col("coherence") < 0.10)
    )
    one = lambda c: F.least(c, F.lit(1.0))
    gain = F.col("remaining") * one(coverage) * one(major / 0.38) * one(support / 0.48) * one(anchor / 0.42) * (0.45 + 0.55 * F.col("coherence"))
    return rows.select(*OWN, F.when(none, 0.0).otherwise(F.least(F.greatest(gain, F.lit(0.0)), "remaining")).alias("gain"))


def pooled(*parts: DataFrame) -> DataFrame:
    """Candidates of several stages in one pool, each once, its scores cleared."""
    whole = parts[0].select(*OWN)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*OWN))
    return whole.distinct().withColumn("gain", F.lit(None).cast("double"))


@dataclass(frozen=True)
class GainContext:
    """What all gains of a pattern's candidates read: curve, records and sticks of the chosen phases, residual and missing lines,
    stage, fit and what remains. Each is written once (gain_context())."""

    curve: DataFrame
    records: DataFrame
    sticks: DataFrame
    direct: DataFrame
    overlap: DataFrame
    stages: DataFrame


def gain_context(records: DataFrame, sticks: DataFrame, curve: DataFrame, phases: int = 2) -> GainContext:
    """The context of weighted curves, and of patterns that are exhausted, by their fit and their residual share, none.

    stages: (pattern_id, stage, remaining): direct with two residual lines, else overlap with two missing heights, else hidden.
    """
    curve, records, sticks = written(curve), written(records), written(sticks)
    direct, overlap = written(residual_lines(records, sticks, curve)), written(overlap_lines(records, sticks, curve))
    count = lambda df, name: df.groupBy("pattern_id").agg(F.count("*").alias(name))
    stages = fit_summary(curve).join(count(direct, "d"), "pattern_id", "left").join(count(overlap, "o"), "pattern_id", "left").na.fill(0, ["d", "o"])
    open_ = ~F.coalesce(exhausted(F.col("fit"), F.lit(phases), 100 - F.col("fit"), F.col("residual_share")), F.lit(False))
    stages = stages.where(open_).select("pattern_id", gain_stage(F.col("d"), F.col("o")).alias("stage"), (100 - F.coalesce("fit", F.lit(0.0))).alias("remaining"))
    return GainContext(curve, records, sticks, direct, overlap, written(stages))


def gain_bounds(lines: DataFrame, context: GainContext, fwhm: float = 0.18) -> DataFrame:
    """(pattern_id, entry_id, bound): no candidate gains more than this: what remains times the share of the residual area that its lines reach.

    One range join and one aggregation, without the ordered fold of line_gains(); candidates that reach no record are not among it.
    """
    tol = min(max(2.4 * fwhm, 0.26), 0.72)
    residual = context.direct.join(context.stages.where("stage = 'direct'"), "pattern_id", "left_semi").unionByName(context.overlap.join(context.stages.where("stage = 'overlap'"), "pattern_id", "left_semi").select(*context.direct.columns))
    areas = residual.groupBy("pattern_id").agg(F.sum("area").alias("all"))
    first = residual.select("pattern_id", "peak_id", F.col("two_theta").alias("place"), "area", F.greatest(F.lit(tol), F.least(F.lit(0.95), 1.7 * F.col("fwhm"))).alias("reach"))
    pairs = range_join(shuffled(ranked_lines(lines, 42).select(*OWN, "two_theta")), first, "two_theta", "place", "reach", ["pattern_id"], width=1.5)
    met = pairs.groupBy(*OWN, "peak_id").agg(F.first("area").alias("area")).groupBy(*OWN).agg(F.sum("area").alias("area"))
    rows = met.join(areas, "pattern_id").join(context.stages, "pattern_id")
    return rows.select(*OWN, (F.col("remaining") * F.least(F.col("area") / F.greatest("all", F.lit(1e-12)), F.lit(1.0))).alias("bound"))


def gain_rank(candidates: DataFrame, peaks: DataFrame, context: GainContext, profiles: DataFrame | None = None, most: int = 20, first: int = 3) -> DataFrame:
    """(pattern_id, entry_id, stage, gain, place): the `most` candidates by what they would add to the chosen phases of their patterns.

    Line gains count in the direct and overlap stages, checked by the profile gain where profiles (pattern_id, entry_id, g, p) are
    given; presence counts in the hidden stage. Candidates whose bound lies under the `most`-th best gain of those with the
    `first` times `most` largest bounds can't be among the best and are left out, so the ordered fold runs for few; none is
    lost, as a bound is never exceeded.
    """
    lines = peaks.join(candidates.select(*OWN), "entry_id")
    hidden = context.stages.where("stage = 'hidden'")
    bounds = written(gain_bounds(lines, context))
    by_bound = Window.partitionBy("pattern_id").orderBy(F.desc("bound"), "entry_id")
    bounds = written(bounds.withColumn("b", F.row_number().over(by_bound)))
    early = written(_line_gains_by_stage(lines, bounds.where(F.col("b") <= first * most), context, profiles))
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("gain")))
    bar = early.withColumn("r", place).where(F.col("r") == most).select("pattern_id", F.col("gain").alias("bar"))
    late = bounds.where(F.col("b") > first * most).join(bar, "pattern_id", "left").where(F.col("bound") >= F.coalesce("bar", F.lit(0.0)))
    gains = early.unionByName(_line_gains_by_stage(lines, late, context, profiles))
    third = hidden_presence(lines.join(hidden.select("pattern_id"), "pattern_id", "left_semi"), context.records, context.records).join(hidden, "pattern_id")
    gains = gains.unionByName(third.select(*OWN, hidden_gain(F.col("remaining"), F.col("presence")).alias("gain")))
    rows = gains.withColumn("gain", F.round("gain", 4)).where("gain > 0").join(context.stages.select("pattern_id", "stage"), "pattern_id")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("gain"), "entry_id")))
    return rows.where(F.col("place") <= most).select(*OWN, "stage", "gain", "place")


def _line_gains_by_stage(lines: DataFrame, chosen: DataFrame, context: GainContext, profiles: DataFrame | None) -> DataFrame:
    """(pattern_id, entry_id, gain) of the chosen candidates of patterns in the direct and the overlap stage."""
    lines = lines.join(chosen.select(*OWN), OWN, "left_semi")
    of = lambda stage: lines.join(context.stages.where(F.col("stage") == stage).select("pattern_id"), "pattern_id", "left_semi")
    remaining = context.stages.select("pattern_id", "remaining")
    gains = line_gains(of("direct"), context.direct, context.records, context.sticks, context.curve, remaining)
    gains = gains.unionByName(line_gains(of("overlap"), context.overlap, context.records, context.sticks, context.curve, remaining, overlapping=True))
    if profiles is None:
        return gains
    checked = profile_gains(context.curve, profiles.join(chosen.select(*OWN), OWN, "left_semi"), remaining)
    return gains.join(checked, OWN, "left").select(*OWN, combined_gain(F.col("gain"), F.col("profile_gain")).alias("gain"))
