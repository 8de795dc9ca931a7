"""Scores of phases against observed peaks: strong lines, nearest peaks, alignment, zero shifts, assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators import pairs as A
from peakloom.operators.ranges import nearest, range_join


@dataclass(frozen=True)
class MatchPolicy:
    """Constants of the scores (fixed values)."""

    intensity_min: float = 5.0
    lines: int = 30
    tolerance: float = 0.25
    good: float = 0.35
    ok: float = 0.18
    min_matched: int = 2
    zero_lines: int = 25
    zero_intensity_min: float = 8.0
    zero_tolerance: float = 0.4
    zero_trim: float = 0.14
    zero_min_fraction: float = 0.18
    zero_max_residual: float = 0.22
    consensus: float = 0.12
    consensus_min_residual: float = 0.16
    consensus_margin: float = 0.08


def strong_lines(peaks: DataFrame, least: float, most: int, low: float | None = 5.0, high: float | None = 120.0) -> DataFrame:
    """The `most` strongest lines of every phase, of at least the intensity; the lower index first among equals."""
    found = peaks.where(F.col("intensity") >= least)
    if low is not None:
        found = found.where(F.col("two_theta").between(low, high))
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("intensity"), "peak_index"))
    return found.withColumn("line_rank", rank).where(F.col("line_rank") <= most)


def near_pairs(lines: DataFrame, observed: DataFrame, tolerance: float, candidates: DataFrame | None = None) -> DataFrame:
    """Pairs of lines and observed positions within the tolerance, with delta = observed - line.

    Without candidates every pattern meets the whole library. candidates (pattern_id, entry_id), such as the phases
    that search_by_peaks() ranks, are the only pairs that are compared.
    """
    lines, keys = lines.select("entry_id", "peak_index", "two_theta", "intensity"), []
    if candidates is not None:
        lines, keys = lines.join(candidates.select("pattern_id", "entry_id"), "entry_id"), ["pattern_id"]
    probes = observed.select("pattern_id", F.col("two_theta").alias("observed"))
    return range_join(lines, probes, "two_theta", "observed", tolerance, keys).withColumn("delta", F.col("observed") - F.col("two_theta"))


def nearest_observed(lines: DataFrame, observed: DataFrame, tolerance: float, higher_wins: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Per pattern and line: the nearest observed position within the tolerance, with delta = observed - line."""
    if candidates is None:
        return A.nearest_scores(lines, observed, tolerance, higher_wins, A.line_rows, "peak_index int, observed double, delta double")
    tie = -F.col("observed") if higher_wins else F.col("observed")
    return nearest(near_pairs(lines, observed, tolerance, candidates), ["pattern_id", "entry_id", "peak_index"], F.round(F.abs("delta"), 9), tie, ["two_theta", "intensity", "observed", "delta"])


MICRO = 1_000_000


def line_hits(lines: DataFrame, observed: DataFrame, tolerance: float, candidates: DataFrame | None = None) -> DataFrame:
    """(pattern_id, entry_id, hits): per line with an observed position within the tolerance the nearest one's delta and the weight.

    hits is an array of struct(d, w): delta in millionths of a degree and the intensity, 1 at least, in thousandths, as
    whole numbers, so that sums don't depend on their order. A phase has a few dozen strong lines, which fit a row:
    one shuffle serves all passes over them.
    """
    one = F.struct("peak_index", F.round(F.abs("delta"), 9).alias("off"), "observed", "delta", "intensity")
    packed = near_pairs(lines, observed, tolerance, candidates).groupBy("pattern_id", "entry_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (x["peak_index"] != F.get("p", i - 1)["peak_index"]))
    whole = lambda x, unit: F.round(x * unit).cast("long")
    return packed.select("pattern_id", "entry_id", F.transform(first, lambda x: F.struct(whole(x["delta"], MICRO).alias("d"), whole(F.greatest(x["intensity"], F.lit(1.0)), 1000).alias("w"))).alias("hits"))


def _total(hits: Column, value) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + value(x))


def _centre(hits: Column) -> Column:
    """Weighted mean of the deltas in whole millionths of a degree."""
    return F.round(_total(hits, lambda x: x["w"] * x["d"]) / F.nullif(_total(hits, lambda x: x["w"]), F.lit(0))).cast("long")


def _whole_spread(hits: Column, centre: Column) -> Column:
    """Weighted mean distance from the centre, rounded to whole millionths of a degree by whole numbers."""
    off, weight = _total(hits, lambda x: x["w"] * F.abs(x["d"] - centre)), _total(hits, lambda x: x["w"])
    return F.floor((2 * off + weight) / F.nullif(2 * weight, F.lit(0)))


def _spread(hits: Column, centre: Column) -> Column:
    """Weighted mean distance from the centre in degrees."""
    return _total(hits, lambda x: x["w"] * F.abs(x["d"] - centre)) / F.nullif(_total(hits, lambda x: x["w"]), F.lit(0)) / MICRO


def status(matched: Column, coverage: Column, policy: MatchPolicy) -> Column:
    return F.when(matched < policy.min_matched, "weak").when(coverage >= policy.good, "good").when(coverage >= policy.ok, "ok").otherwise("weak")


def match_scores(peaks: DataFrame, observed: DataFrame, policy: MatchPolicy = MatchPolicy(), candidates: DataFrame | None = None) -> DataFrame:
    """Per pattern and phase with a match: matched and total strong lines, coverage, mean distance, status."""
    strong = strong_lines(peaks, policy.intensity_min, policy.lines, None)
    if candidates is None:
        found = A.nearest_scores(strong, observed, policy.tolerance, True, A.match_sums, "matched long, total long, mean_delta double").withColumn("mean_delta", F.round("mean_delta", 6))
    else:
        totals = strong.groupBy("entry_id").agg(F.count("*").alias("total"))
        hits = nearest_observed(strong, observed, policy.tolerance, True, candidates)
        found = hits.groupBy("pattern_id", "entry_id").agg(F.count("*").alias("matched"), F.round(F.avg(F.abs("delta")), 6).alias("mean_delta")).join(totals, "entry_id")
    coverage = F.col("matched") / F.col("total")
    return found.select("pattern_id", "entry_id", "matched", "total", F.round(coverage, 6).alias("coverage"), "mean_delta", status(F.col("matched"), coverage, policy).alias("status"))


def alignments(peaks: DataFrame, observed: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Per pattern and phase: zero shift, matched and total lines, weighted mean residual, status, probability."""
    strong = strong_lines(peaks, 5.0, 35)
    own = ["pattern_id", "entry_id"]
    if candidates is None:
        rows = A.nearest_scores(strong, observed, 0.45, False, A.alignment_sums, "matched long, total long, zero long, spread long").withColumn("score", F.col("spread") / MICRO)
    else:
        totals = strong.groupBy("entry_id").agg(F.count("*").alias("total"))
        rows = line_hits(strong, observed, 0.45, candidates).select(*own, "hits", F.size("hits").cast("long").alias("matched"), _centre(F.col("hits")).alias("zero"))
        rows = rows.withColumn("score", _whole_spread(F.col("hits"), F.col("zero")) / MICRO).join(totals, "entry_id")
    fraction, score = F.col("matched") / F.col("total"), F.col("score")
    few, weak = F.col("matched") < 3, (score > 0.18) | (fraction < 0.18)
    kept = F.when(few, 0.0).otherwise(score)
    label = F.when(few | weak, "weak").when((score <= 0.08) & (fraction >= 0.3), "good shift-only").otherwise("ok shift-only")
    penalty = F.when(kept > 0, F.greatest(F.lit(0.15), 1 - F.least(kept / 0.45, F.lit(1.0)))).otherwise(1.0)
    probability = F.least(F.greatest(100 * fraction * penalty * F.least(F.col("matched") / 8.0, F.lit(1.0)), F.lit(0.0)), F.lit(100.0))
    zero = F.when(few | weak, 0.0).otherwise(F.least(F.greatest(F.col("zero") / MICRO, F.lit(-0.5)), F.lit(0.5)))
    return rows.select(*own, "matched", "total", F.round(zero, 6).alias("zero_shift"), kept.alias("score"), label.alias("status"), (F.floor(probability * 1e6 + 0.5) / 1e6).alias("probability"))


def zero_shifts(peaks: DataFrame, observed: DataFrame, policy: MatchPolicy = MatchPolicy(), candidates: DataFrame | None = None) -> DataFrame:
    """Per pattern and phase that passes the gates: zero shift, residual and quality after one trim."""
    strong = strong_lines(peaks, policy.zero_intensity_min, policy.zero_lines, None)
    own, trim = ["pattern_id", "entry_id"], round(policy.zero_trim * MICRO)
    if candidates is None:
        rows = A.nearest_scores(strong, observed, policy.zero_tolerance, False, A.zero_sums(trim), "n long, total long, c long, residual double, mean_w double")
    else:
        totals = strong.groupBy("entry_id").agg(F.count("*").alias("total"))
        rows = line_hits(strong, observed, policy.zero_tolerance, candidates).where(F.size("hits") >= 3)
        # the centre is bound to a variable once: inside the filter it would be computed for every line
        close = lambda c: F.filter("hits", lambda x: F.abs(x["d"] - c) <= trim)
        rows = rows.withColumn("near", F.transform(F.array(_centre(F.col("hits"))), close)[0])
        rows = rows.withColumn("used", F.when(F.size("near") >= 3, F.col("near")).otherwise(F.col("hits"))).withColumn("c", _centre(F.col("used")))
        rows = rows.withColumn("n", F.size("used")).withColumn("residual", _spread(F.col("used"), F.col("c"))).withColumn("mean_w", _total(F.col("used"), lambda x: x["w"]) / F.col("n") / 1000)
        rows = rows.join(totals, "entry_id")
    fraction = F.col("n") / F.col("total")
    good = rows.where((F.col("n") >= 3) & (fraction >= policy.zero_min_fraction) & (F.round("residual", 9) <= policy.zero_max_residual))
    zero = F.least(F.greatest(F.col("c") / MICRO, F.lit(-0.5)), F.lit(0.5))
    return good.select(*own, F.round(zero, 6).alias("zero"), F.round("residual", 6).alias("residual"), F.round(F.col("n") * fraction * F.col("mean_w") / (F.col("residual") + 0.03), 4).alias("quality"))


def consensus_zero(shifts: DataFrame, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Per pattern: the quality-weighted zero of the phases that agree with the best one."""
    best = shifts.groupBy("pattern_id").agg(F.max_by(F.struct("zero", "residual"), F.struct("quality", F.col("entry_id"))).alias("best"))
    near = shifts.join(best, "pattern_id").where(
        (F.round(F.abs(F.col("zero") - F.col("best.zero")), 9) <= policy.consensus) & (F.col("residual") <= F.greatest(F.lit(policy.consensus_min_residual), F.col("best.residual") + policy.consensus_margin))
    )
    return near.groupBy("pattern_id").agg(F.count("*").alias("n_phases"), F.round(F.sum(F.col("zero") * F.col("quality")) / F.sum("quality"), 5).alias("zero"))


def assignments(observed: DataFrame, peaks: DataFrame, selected: DataFrame, base: float = 0.3) -> DataFrame:
    """Per observed peak and selected phase of its pattern: the nearest line within the peak's own tolerance."""
    lines = peaks.where("intensity >= 5").join(selected, "entry_id").select("pattern_id", "entry_id", "peak_index", "two_theta")
    return assigned_lines(observed.withColumn("base", F.lit(base)), lines)


def assigned_lines(observed: DataFrame, lines: DataFrame) -> DataFrame:
    """assignments() of placed lines (pattern_id, entry_id, peak_index, two_theta); observed has a column base, the least tolerance."""
    tol = F.greatest(F.col("base"), F.least(F.lit(0.75), F.greatest(F.lit(0.12), 1.35 * F.col("fwhm"))))
    probes = observed.select("pattern_id", "peak_id", F.col("two_theta").alias("observed"), tol.alias("reach"))
    pairs = range_join(lines, probes, "two_theta", "observed", "reach", ["pattern_id"], width=1.0)
    delta = F.col("observed") - F.col("two_theta")
    return nearest(pairs, ["pattern_id", "peak_id", "entry_id"], F.round(F.abs(delta), 9), F.struct("two_theta", "peak_index"), ["peak_index", "two_theta", "observed"])


def peak_status(observed: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per observed peak: how many phases claim it, and matched, overlapping or unknown."""
    n = assigned.groupBy("pattern_id", "peak_id").agg(F.count("*").alias("n_phases"))
    rows = observed.select("pattern_id", "peak_id").join(n, ["pattern_id", "peak_id"], "left").withColumn("n_phases", F.coalesce("n_phases", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n_phases") == 0, "unknown").when(F.col("n_phases") == 1, "matched").otherwise("overlapping"))


def unclaimed(observed: DataFrame, claimed: DataFrame) -> DataFrame:
    """Observed peaks without a claimed position (pattern_id, claimed, claimed_fwhm) within the wider peak's reach."""
    probes = claimed.withColumn("reach", F.lit(0.75 + 1e-6))  # the rounded distance decides
    width = F.greatest(F.col("fwhm"), F.col("claimed_fwhm"), F.lit(0.05)) * 1.35
    pairs = range_join(observed, probes, "two_theta", "claimed", "reach", ["pattern_id"], width=1.0)
    near = pairs.where(F.round(F.abs(F.col("two_theta") - F.col("claimed")), 9) <= F.greatest(F.lit(0.12), F.least(F.lit(0.75), width)))
    return observed.join(near.select("pattern_id", "peak_id").distinct(), ["pattern_id", "peak_id"], "left_anti")


def mass_fractions(scales: DataFrame) -> DataFrame:
    """Adds fraction = scale * mass over their sum by pattern, negative products as 0; null where nothing is positive."""
    product = F.greatest(F.col("scale") * F.col("mass"), F.lit(0.0))
    total = F.sum(product).over(Window.partitionBy("pattern_id"))
    return scales.withColumn("fraction", product / F.nullif(total, F.lit(0.0)))
