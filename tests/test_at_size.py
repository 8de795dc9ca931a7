"""Steps whose memory, shuffled rows or time grew faster than their input, or with a fixed number of tasks."""

import re

import numpy as np
from peakloom.operators import crystals as X
from peakloom.operators import gains as G
from peakloom.operators import library, pairs
from peakloom.operators import matching as M
from peakloom.operators import phasefit as P
from peakloom.operators.fitting import joint_scales
from peakloom.operators.search import ranked_library
from peakloom.plans import fixtures, result_queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scales_are_tried_in_the_row_of_their_profile(spark):
    """every grid point of every candidate was a row, copied for 28 trials; a curve and a profile are one row now."""
    rng = np.random.default_rng(3)
    points = [(k, g, float(rng.uniform(0, 50)), float(rng.uniform(0, 40)), float(rng.uniform(0, 2))) for k in (1, 2) for g in range(60)]
    curve = spark.createDataFrame(points, "pattern_id long, g int, target double, total double, w double")
    own = [(k, e, g, float(rng.uniform(0, 30))) for k, e in ((1, "a"), (1, "b"), (2, "a"), (3, "a")) for g in range(5, 45)] + [(2, "none", 70, 5.0), (2, "part", 7, 4.0), (2, "part", 8, None)]
    profiles = spark.createDataFrame(own, "pattern_id long, entry_id string, g long, p double")
    scales = G.residual_scales(curve, profiles)
    assert "Generate" not in _plan(scales)
    got = {(r.pattern_id, r.entry_id): r.scale for r in scales.collect()}
    assert set(got) == {(k, e) for k, e, *_ in own} and got[(3, "a")] == got[(2, "none")] == 0.0
    left = {(r.pattern_id, r.entry_id): r.profile_gain for r in G.profile_gains(curve, profiles, curve.selectExpr("pattern_id", "50.0D AS remaining").distinct()).collect()}
    assert set(left) == set(got) and left[(3, "a")] == left[(2, "none")] == 0.0
    at = {(k, g): v for k, g, *v in points}
    for key in ((1, "a"), (1, "b"), (2, "a"), (2, "part")):
        met = [(*at[key[0], g], p) for k, e, g, p in own if (k, e) == key and p is not None]
        target, total, w, p = (np.array(x) for x in zip(*met, strict=True))
        rest = np.maximum(target - total, 0)
        initial = (w * p * rest).sum() / (w * p * p).sum()
        errors = []
        for f in (0.0, *G.FACTORS):
            off = total + p * initial * f - target
            errors.append((round(float((w * np.where(off > 0, 5 * off, -off)).sum()), 9), initial * f))
        scale = min(errors, key=lambda x: x[0])[1]
        assert np.isclose(got[key], scale, rtol=1e-12)
        off = p * scale - rest
        before = sum(v[2] * max(v[0] - v[1], 0.0) for (k, _), v in at.items() if k == key[0])
        share = (w * (rest - np.where(off > 0, 3 * off, -off))).sum() / before
        assert np.isclose(left[key], 50.0 * min(max(share, 0.0), 1.0) if scale > 0 else 0.0, atol=1e-9)


def test_catalogue_describes_a_phase_once(spark, sf):
    """all phases of all results met their descriptions and were sorted with them; now one row a phase does."""
    found = result_queries.phase_catalogue(spark, sf)
    plan = _plan(found)
    assert "Join" in plan and "Aggregate [l_partkey" in plan[plan.index("Join") :] and "Distinct" not in plan
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().count()
    assert found.count() == found.select("phase_id").distinct().count() == rows


def test_library_is_dealt_by_its_size(spark, sf):
    """the lines were sorted in as many tasks as there are shuffle partitions, whatever their number."""
    lines = fixtures.library_lines(spark, sf, task_rows=500)
    rows = lines.count()
    assert lines.rdd.getNumPartitions() == -(-rows // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lines.exceptAll(fixtures.view(spark, sf, "ref_peak")).isEmpty() and rows == fixtures.view(spark, sf, "ref_peak").count()
    ranked = ranked_library(lines)
    assert ranked.rdd.getNumPartitions() == -(-rows // 500)  # no second shuffle by phase


def test_angles_of_cells_are_computed_once_a_row(spark):
    """the angle by a row's cell was spelled out anew in every filter and join condition that read it."""
    cells = spark.createDataFrame([("e", 4.0, 4.0, 4.0, 90.0, 90.0, 90.0)], "entry_id string, a double, b double, c double, alpha double, beta double, gamma double")
    at = [float(2 * np.degrees(np.arcsin(1.5406 / 8 * np.sqrt(n)))) for n in (1, 2, 4)]
    matches = spark.createDataFrame([(1, "e", 1, 0, 0, at[0], 5.0), (1, "e", 1, 1, 0, at[1] + 0.2, 5.0), (1, "e", 2, 0, 0, at[2] + 0.1, 5.0), (1, "e", 9, 9, 9, 50.0, 5.0)], "pattern_id long, entry_id string, h int, k int, l int, angle double, weight double")
    observed = spark.createDataFrame([(1, at[0], 0.1)], "pattern_id long, two_theta double, fwhm double")
    near = X.consistent_matches(matches, cells, observed)
    assert _plan(near).count("ASIN(") == 1
    assert {(r.h, r.k, r.l) for r in near.collect()} == {(1, 0, 0), (2, 0, 0)}


def test_index_holds_every_peak_of_a_phase(spark):
    """of a phase with more than 300 peaks the others were dropped when the index was built."""
    rows = [(e, i, 5.0 + i / 10, float(1 + i % 90), 1, 0, i % 5) for e, n in (("few", 7), ("many", 901)) for i in range(n)]
    peaks = spark.createDataFrame(rows, "entry_id string, peak_index int, two_theta double, intensity double, h int, k int, l int")
    packed = library.peaks_json(peaks)
    assert {tuple(r) for r in library.peak_rows(packed).collect()} == set(rows)
    assert packed.where("entry_id = 'many'").count() == 4 and packed.where("entry_id = 'few'").count() == 1


def test_scores_of_all_pairs_are_made_by_blocks(spark, monkeypatch):
    """Lines and positions were joined, packed and folded pair by pair; blocks of both give what loops give."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(pairs, "PHASES", 5)
    monkeypatch.setattr(pairs, "PATTERNS", 3)
    lines = [(str(e), i, float(x), float(v)) for e in range(23) for i, (x, v) in enumerate(zip(np.round(rng.uniform(10, 16, 9), 2), rng.integers(1, 100, 9), strict=True))]
    seen = [(p, i, float(x)) for p in range(8) for i, x in enumerate(np.round(rng.uniform(10, 16, 12), 2))]
    peaks = spark.createDataFrame(lines, "entry_id string, peak_index int, two_theta double, intensity double")
    observed = spark.createDataFrame(seen, "pattern_id long, peak_id int, two_theta double")
    every = observed.select("pattern_id").distinct().crossJoin(peaks.select("entry_id").distinct())
    for higher in (False, True):
        found = M.nearest_observed(peaks, observed, 0.25, higher)
        plan = found._jdf.queryExecution().toString()
        assert "__bucket" not in plan and "MapInArrow" in plan
        want = {}
        for e, i, x, _ in lines:
            for p in range(8):
                near = [(round(abs(y - x), 9), -y if higher else y, y) for q, _, y in seen if q == p and y - 0.25 <= x <= y + 0.25]
                if near:
                    want[(p, e, i)] = min(near)[2]
        assert {(r.pattern_id, r.entry_id, r.peak_index): r.observed for r in found.collect()} == want
    for score in (M.alignments, M.zero_shifts, M.match_scores):
        rows = lambda df: {(r.pattern_id, r.entry_id): r.asDict() for r in df.collect()}
        got, other = rows(score(peaks, observed)), rows(score(peaks, observed, candidates=every))
        assert got == other and len(got) > 20


def test_grid_points_are_never_broadcast(spark):
    """Points around peaks are few bytes compressed, so adaptive execution broadcast a million of them and the driver ran out of memory."""
    curve = spark.range(4 * 300).selectExpr("id DIV 300 AS pattern_id", "CAST(id % 300 AS INT) AS g", "CAST(id % 37 AS DOUBLE) AS target", "1.0D AS total")
    marks = spark.range(40).selectExpr("id % 4 AS pattern_id", "CAST(id * 7 AS INT) AS g")
    found = G.fit_weights(curve, marks)
    assert len(found.collect()) == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [pattern_id" in plan and not re.search(r"BroadcastHashJoin \[pattern_id#\d+L?, g#", plan)


def test_trials_and_scales_are_made_in_the_row_of_a_pattern(spark):
    """every grid point of every trial was a row, and all pairs of phases met on every grid point."""
    curve = spark.range(2 * 301).selectExpr("id DIV 301 AS pattern_id", "CAST(id % 301 AS INT) AS g", "CAST(id % 41 AS DOUBLE) AS target", "1.0D AS w")
    lines = spark.createDataFrame([(k, ph, 7.0 + k + d, 10.0) for k in (0, 1) for ph, d in (("a", 0.0), ("b", 1.5))], "pattern_id long, phase string, place double, intensity double")
    trials = spark.createDataFrame([(k, f, e) for k in (0, 1) for f in (0.1, 0.3) for e in (0.0, 0.5)], "pattern_id long, fwhm double, eta double")
    errors = P.shape_errors(lines, curve, trials, P.Grid(points=301))
    assert errors.count() == 8 and "explode" not in _plan(errors)
    scales = joint_scales(curve.where("g < 9").selectExpr("pattern_id", "'a' AS phase", "g", "target / 2 AS p"), curve.withColumnRenamed("target", "y"))
    assert _plan(scales).count("Join") == 1 and all(abs(r.scale - 2) < 1e-9 for r in scales.collect())
