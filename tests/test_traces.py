"""Kernels on traces against plain loops, and what the operators on whole traces must keep."""

import numpy as np
import pytest

from peakloom.functions import arrays as A
from peakloom.operators import traces as T
from pyspark.sql import functions as F

from tests import curve_loops as V


def test_filters_against_loops():
    y = np.random.default_rng(1).normal(50, 9, 60)
    at = lambda i: y[min(max(i, 0), len(y) - 1)]
    for size, percent in ((5, 50), (9, 18), (21, 62)):
        want = [sorted(at(i + k) for k in range(-(size // 2), size // 2 + 1))[int(size * percent / 100)] for i in range(len(y))]
        assert np.allclose(V.rank_filter(y, percent, size), want)
    w = [np.exp(-0.5 * (k / 2.5) ** 2) for k in range(-10, 11)]
    assert np.allclose(V.gaussian_filter(y, 2.5), [sum(a * at(i + k) for a, k in zip(w, range(-10, 11), strict=True)) / sum(w) for i in range(len(y))])
    parabola = np.arange(30.0) ** 2 - 4 * np.arange(30)
    assert np.allclose(V.quadratic_smooth(parabola, 7), parabola)  # a quadratic stays what it is, at the ends as well


def test_peaks_against_loops():
    y = np.round(np.random.default_rng(2).uniform(0, 20, 120))
    tops, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            tops.append((i + j) // 2)
        i = j + 1
    assert V.maxima(y).tolist() == tops
    prominence, width = V.prominence_and_width(y, np.array(tops))
    for p, h, w in zip(tops, prominence, width, strict=True):
        lows = []
        for step in (-1, 1):
            k, low = p, y[p]
            while 0 <= k < len(y) and y[k] <= y[p]:
                low, k = min(low, y[k]), k + step
            lows.append(low)
        assert h == y[p] - max(lows) and 0 < w < len(y)
    kept = V.spaced(y, np.array(tops), 6)
    assert all(abs(a - b) >= 6 for a in kept for b in kept if a != b)
    assert all(any(abs(t - k) < 6 and y[k] >= y[t] for k in kept) for t in tops)


@pytest.fixture(scope="module")
def traces(spark):
    x = 5 + np.arange(800) * 0.05
    bell = lambda c, h, w: h * np.exp(-4 * np.log(2) * ((x - c) / w) ** 2)
    noise = np.random.default_rng(3).normal(0, 1, len(x))
    rows = [(1, x.tolist(), (40 + 0.5 * x + bell(15, 300, 0.3) + bell(30, 120, 0.4) + noise).tolist()), (2, x.tolist(), (60 + bell(20, 40, 9.0) + bell(35, 200, 0.3) + noise).tolist()), (3, [5.0, 5.05], [1.0, 2.0])]
    return spark.createDataFrame(rows, "pattern_id long, xs array<double>, ys array<double>")


def test_features_plans_and_profiles(spark, traces):
    found = {r.pattern_id: r for r in T.features(traces).collect()}
    assert found[1].peaks == 2 and 0.2 < found[1].peak_width < 0.5 and found[2].hump > found[1].noise_ratio and found[3].points == 2
    plans = {r.pattern_id: r for r in T.features(traces).select("pattern_id", *T.smoothing_plan()).collect()}
    assert plans[3].window == 5 and all(r.window % 2 == 1 and 5 <= r.window <= 21 for r in plans.values())
    none = spark.createDataFrame([], "feature string, mean double, std double, w array<double>")
    assert {tuple(r)[1:] for r in T.selected_profile(T.features(traces), none).collect()} == {(1, 0.0)}
    sure = spark.createDataFrame([("bias", 0.0, 1.0, [0.0, 0.0, 5.0, 0.0])], none.schema)
    assert {r.profile for r in T.selected_profile(T.features(traces), sure).collect()} == {2}


def test_backgrounds_lie_under_peaks(traces):
    ys = {r.pattern_id: np.array(r.ys) for r in traces.collect()}
    for df, name in ((T.envelope(traces), "baseline"), (T.chebyshev_baseline(traces), "baseline"), (T.peak_suppressed(traces), "base")):
        for r in df.where("pattern_id < 3").collect():
            base, y = np.array(r[name]), ys[r.pattern_id]
            assert base.shape == y.shape and base[np.argmax(y)] < 0.5 * y.max() and np.median(np.abs(base - y)) < 20
    for r in T.decompose(traces).where("pattern_id < 3").collect():
        clean = ~np.array(r.artifacts)
        assert np.allclose((np.array(r.background) + r.broad + np.array(r.crystalline))[clean], ys[r.pattern_id][clean]) and min(r.broad) >= 0
    chosen = {r.pattern_id: r for r in T.choose_background(traces).collect()}
    assert chosen[1].base in T.TRIAL_BASES and chosen[1].score < 1


def test_array_expressions_against_numpy(spark):
    rng, rows = np.random.default_rng(0), []
    for k, n in enumerate((5, 40, 200, 363, 120)):
        x = 5 + np.arange(n) * 0.1
        rows.append((k, x.tolist(), np.round(rng.normal(50, 6, n) + (k % 2) * 200 * np.exp(-(((x - 15) / 0.4) ** 2)), 0 if k % 3 == 0 else 3).tolist()))
    y = F.col("ys")
    d = A.fixed(spark.createDataFrame(rows, "pattern_id long, xs array<double>, ys array<double>"), step=A.median_step(F.col("xs")), noise=A.noise(y))
    d = A.fixed(d, size=A.odd_points(1.4, F.col("step"), 9, F.greatest(F.lit(9), F.floor(F.size("ys") / 3).cast("int"))))
    d = d.withColumns({"ranked": A.rank_filter(y, 22, F.col("size")), "smooth": A.gaussian_filter(y, F.col("size") / 7.0), "slope": A.gradient(y), "fitted": A.quadratic_smooth(y, F.lit(7)), "p99": A.quantile(y, 0.99)})
    for r in d.withColumns({"tops": A.maxima(y), "peaks": A.find_peaks(y, 3 * F.col("noise"), A.points(0.3, F.col("step"), 3), F.lit(50))}).collect():
        x, v = np.array(r.xs), np.array(r.ys)
        assert np.isclose(r.step, V.median_step(x)) and np.isclose(r.noise, V.noise_of(v)) and r.size == V.odd_points(1.4, r.step, 9, max(9, len(v) // 3)) and np.isclose(r.p99, np.percentile(v, 99))
        for got, want in ((r.ranked, V.rank_filter(v, 22, r.size)), (r.smooth, V.gaussian_filter(v, r.size / 7)), (r.slope, np.gradient(v)), (r.fitted, V.quadratic_smooth(v, 7))):
            assert np.allclose(got, want)
        at, prominence, width = V.find_peaks(v, 3 * r.noise, V.at_step(0.3, r.step, 3), 50)
        assert r.tops == V.maxima(v).tolist() and [p.i for p in r.peaks] == at.tolist()
        assert np.allclose([p.prominence for p in r.peaks], prominence) and np.allclose([p.width for p in r.peaks], width)


def test_series_values_and_fit(spark):
    """Clenshaw's recurrence equals numpy's series; a series through nodes of a cubic is the cubic."""
    u = np.linspace(-1, 1, 40)
    c = T.robust_series(u, 3 + u - 2 * u**3, np.ones(40), np.zeros(40, bool), 5)
    assert np.allclose(np.polynomial.chebyshev.chebval(u, c), 3 + u - 2 * u**3)
    xs = np.linspace(10, 70, 31)
    got = spark.createDataFrame([(xs.tolist(), c.tolist())], "xs array<double>, c array<double>").select(T.series_values(F.col("xs"), F.col("c"))).first()[0]
    assert np.allclose(got, np.polynomial.chebyshev.chebval((xs - 40) / 30, c))


def test_prepared_peaks_and_training_records(spark, traces, tmp_path):
    found = {}
    for r in T.prepare_observed(traces).collect():
        found[r.pattern_id] = [round(p.two_theta, 1) for p in sorted(r.peaks, key=lambda p: -p.height)[:2]]
    assert sorted(found[1]) == [15.0, 30.0] and found[2][0] == 35.0 and found[3] == []
    assert {r.profile for r in T.auto_preprocess(traces).collect()} == {1}
    rows = traces.selectExpr("pattern_id", "explode(arrays_zip(xs, ys)) AS v").selectExpr("pattern_id", "v.xs AS x", "v.ys AS y")
    records = T.training_records(rows, 5.0, 45.0, 401, 0.2)
    got = records.collect()
    assert {r.pattern_id for r in got} == {1, 2} and all(len(r.x) == 401 for r in got)
    one = next(r for r in got if r.pattern_id == 1)
    marked = [x for x, m in zip(one.x, one.masked, strict=True) if m]
    assert any(abs(x - 15) < 0.2 for x in marked) and any(abs(x - 30) < 0.2 for x in marked)
    for r in got:
        assert np.allclose(r.corrected, np.maximum(np.array(r.raw) - r.background, 0)) and min(r.corrected) >= 0
    path = str(tmp_path / "records")
    T.write_training_records(records.withColumn("source", F.concat(F.lit("s"), "pattern_id")), path)
    back = spark.read.parquet(path)
    assert sorted(x.name for x in (tmp_path / "records").iterdir() if x.is_dir()) == ["source=s1", "source=s2"]
    assert sorted((r.pattern_id, r.source, tuple(r.raw)) for r in back.collect()) == sorted((r.pattern_id, f"s{r.pattern_id}", tuple(r.raw)) for r in got)
