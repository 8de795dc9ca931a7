"""Line gains and the gain rank against plain loops on synthetic patterns whose next phase is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import gains as G

X = G.LOW + G.STEP * np.arange(1151)
WIDTH = 0.3


def bell(centre, height):
    return height * np.exp(-4 * math.log(2) * ((X - centre) / WIDTH) ** 2)


@pytest.fixture(scope="module")
def case(spark):
    """Patterns of two phases of which one is chosen, with 24 candidates: the other phase, parts of it, and random ones."""
    rng = np.random.default_rng(11)
    lines, records, sticks, curve, candidates = [], [], [], [], []
    for k in range(4):
        chosen = np.sort(rng.uniform(10, 110, 8))
        rest = np.sort(rng.uniform(10, 110, 9))
        heights = rng.uniform(20, 100, 9)
        total = sum(bell(p, 80) for p in chosen)
        target = total + sum(bell(p, h) for p, h in zip(rest, heights, strict=True)) + rng.uniform(0, 0.2, len(X))
        for i, (p, h) in enumerate([*((p, 80.0) for p in chosen), *zip(rest, heights, strict=True)]):
            records.append((k, i, round(float(p), 4), float(h), float(h) * WIDTH, WIDTH))
        sticks += [(k, round(float(p), 4)) for p in chosen]
        curve += [(k, g, float(t), float(c), float(max(t - c, 0)), 1.0) for g, (t, c) in enumerate(zip(target, total, strict=True))]
        for c in range(24):
            entry = f"{k}-{c:02d}"
            candidates.append((k, entry))
            n = 9 - c // 2 if c < 10 else 0  # the first ones hold ever fewer lines of the rest
            own = [(p, h) for p, h in zip(rest[:n], heights[:n], strict=True)] + [(float(p), float(h)) for p, h in zip(rng.uniform(10, 110, 6 if c else 0), rng.uniform(5, 60, 6), strict=False)]
            lines += [(entry, i, round(float(p), 4), float(h)) for i, (p, h) in enumerate(own)]
    frame = spark.createDataFrame
    return (
        frame(candidates, "pattern_id long, entry_id string"), frame(lines, "entry_id string, peak_index int, two_theta double, intensity double"),
        frame(records, "pattern_id long, peak_id int, two_theta double, height double, area double, fwhm double"), frame(sticks, "pattern_id long, stick double"),
        frame(curve, "pattern_id long, g int, target double, total double, residual double, w double"),
    )


def loop_gain(lines, residual, observed, sticks, curve, remaining, tol=0.432):
    """One candidate's gain in the direct stage."""
    strong = sorted((x for x in lines if x.intensity >= 3 and 5 <= x.two_theta <= 120), key=lambda x: (-x.intensity, x.peak_index))[:42]
    weight = [max(x.intensity / 100, 0.025) ** 0.55 / math.sqrt(i + 1) for i, x in enumerate(strong)]
    free, met = set(range(len(strong))), []
    first = sorted(residual, key=lambda r: (-r.area, r.peak_id))
    for nth, r in enumerate(first):
        reach = max(tol, min(0.95, 1.7 * r.fwhm))
        near = sorted((round(abs(strong[i].two_theta - r.two_theta), 9), strong[i].peak_index, i) for i in free if abs(strong[i].two_theta - r.two_theta) <= reach)
        if near:
            free.discard(near[0][2])
            met.append((nth, near[0][2], r.area, 1 - near[0][0] / reach))
    if len(strong) < 3 or not met:
        return 0.0
    positive = lambda v: [x for x in v if x > 0]
    floor = max(np.percentile(positive([c.total for c in curve]), 55), 1.0)
    absent = repeated = only = absent_top = 0
    for i in sorted(free):
        x, c = strong[i], curve[int(math.floor((strong[i].two_theta - G.LOW) / G.STEP + 0.5))]
        if any(round(abs(s.stick - x.two_theta), 9) <= tol for s in sticks):
            repeated += 0.80 * weight[i]
        elif c.total >= max(floor, 0.35 * c.target):
            repeated += 0.65 * weight[i]
        elif any(round(abs(o.two_theta - x.two_theta), 9) <= tol for o in observed):
            only += 0.5 * weight[i]
        else:
            absent += weight[i] * (3.25 if i < 10 else 1.35)
            absent_top += i < 12
    whole, major_all = sum(r.area for r in first), sum(r.area for r in first[:14])
    coverage, major = sum(a * (0.35 + 0.65 * q) for _, _, a, q in met) / whole, sum(a for n, _, a, _ in met if n < 14) / major_all
    m, top = sum(weight[i] for _, i, _, _ in met), sum(weight[i] for _, i, _, _ in met if i < 12)
    support, anchor = m / (m + 3.4 * absent + 1.6 * repeated + only), top / sum(weight[:12])
    coherence = 0.0
    if len(met) >= 3:
        ratio = np.array([math.log(a / strong[i].intensity) for _, i, a, _ in met])
        off = np.round(abs(ratio - np.median(ratio)), 9)
        keep = sorted(range(len(met)), key=lambda j: (off[j], strong[met[j][1]].peak_index))[: max(3, len(met) - min(2, len(met) // 5))]
        w = [weight[met[j][1]] for j in keep]
        coherence = min(max(math.exp(-np.average(off[keep], weights=w) / 0.95) * len(keep) / len(met), 0.05), 1)
    n_top, checked = sum(i < 12 for _, i, _, _ in met), min(12, len(strong))
    if (n_top < 2 and anchor < 0.2) or (absent_top >= max(3, math.ceil(0.34 * checked)) and absent > 1.15 * m) or major < 0.18 or coverage < 0.035 or support < 0.22 or anchor < 0.16 or coherence < 0.10:
        return 0.0
    one = lambda v: min(v, 1.0)
    return min(max(remaining * one(coverage) * one(major / 0.38) * one(support / 0.48) * one(anchor / 0.42) * (0.45 + 0.55 * coherence), 0), remaining)


def test_line_gains_equal_a_loop_and_the_rank_loses_none(spark, case):
    candidates, peaks, records, sticks, curve = case
    context = G.gain_context(records, sticks, curve, 1)
    stages = {r.pattern_id: r for r in context.stages.collect()}
    assert {r.stage for r in stages.values()} == {"direct"} and len(stages) == 4
    rows = lambda df: df.collect()
    lib, direct, observed, stick, points = {}, rows(context.direct), rows(records), rows(sticks), rows(curve)
    for r in rows(peaks):
        lib.setdefault(r.entry_id, []).append(r)
    of = lambda v, k: [x for x in v if x.pattern_id == k]
    want = {(k, e): loop_gain(lib[e], of(direct, k), of(observed, k), of(stick, k), of(points, k), stages[k].remaining) for k, e in map(tuple, candidates.collect())}
    remaining = context.stages.select("pattern_id", "remaining")
    lines = peaks.join(candidates, "entry_id")
    got = {(r.pattern_id, r.entry_id): r.gain for r in G.line_gains(lines, context.direct, context.records, context.sticks, context.curve, remaining).collect()}
    assert sum(v > 0 for v in want.values()) >= 12
    assert all(math.isclose(got.get(k, 0.0), v, rel_tol=1e-9, abs_tol=1e-9) for k, v in want.items())
    # bounds are never exceeded, and a rank that prunes after two candidates is that of all
    bounds = {(r.pattern_id, r.entry_id): r.bound for r in G.gain_bounds(lines, context).collect()}
    assert all(v <= bounds.get(k, 0.0) + 1e-9 for k, v in want.items())
    ranked = {(r.pattern_id, r.place): (r.entry_id, r.gain) for r in G.gain_rank(candidates, peaks, context, most=2, first=1).collect()}
    for k in range(4):
        best = sorted(((-round(v, 4), e) for (q, e), v in want.items() if q == k and v > 0))[:2]
        assert [ranked.get((k, n + 1)) for n in range(len(best))] == [(e, -v) for v, e in best]
        assert best[0][1] == f"{k}-00"  # the phase that the pattern was made of


def test_profile_gains_check_line_gains(spark, case):
    candidates, peaks, records, sticks, curve = case
    context = G.gain_context(records, sticks, curve, 1)
    grid = spark.range(1151).select(F.col("id").cast("int").alias("g"))
    two = peaks.where("entry_id IN ('0-00', '0-20')").crossJoin(grid)
    z = (F.lit(G.LOW) + F.col("g") * G.STEP - F.col("two_theta")) / WIDTH
    profiles = two.groupBy("entry_id", "g").agg(F.sum(F.col("intensity") * F.exp(-4 * math.log(2) * z * z)).alias("p")).where("p > 1e-9").select(F.lit(0).cast("long").alias("pattern_id"), "entry_id", "g", "p")
    gains = {r.entry_id: r.profile_gain for r in G.profile_gains(context.curve, profiles, context.stages.select("pattern_id", "remaining")).collect()}
    remaining = context.stages.where("pattern_id = 0").first().remaining
    assert gains["0-00"] > 0.9 * remaining and 0 <= gains["0-20"] < 0.3 * remaining


def test_a_line_at_exactly_the_tolerance_is_near(spark):
    """5.44 - 0.42 is a little more than 5.02 in doubles; rounded to nine digits it is within it."""
    lines = spark.createDataFrame([(1, "e", 0, 5.02), (1, "e", 1, 5.01), (2, "e", 0, 10.0)], "pattern_id long, entry_id string, peak_index int, two_theta double")
    places = spark.createDataFrame([(1, 5.44), (2, 10.42)], "pattern_id long, place double")
    assert 5.44 - 0.42 > 5.02
    rows = G.near_any(lines, places, 0.42, "hit").collect()
    assert {(r.pattern_id, r.peak_index): r.hit for r in rows} == {(1, 0): True, (1, 1): False, (2, 0): True}
