"""Registered queries of the preparation of whole traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import signal as G
from peakloom.operators import traces as T
from peakloom.plans.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


W = with_views("trace_week")
T0 = "t0 AS (SELECT pattern_id, i, x, CAST(y AS DOUBLE) AS y FROM trace_week)"


def _week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "trace_week").withColumn("y", F.col("y").cast("double"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of one peak family on a slope: the weekly sums, smoothed to a curve."""
    return G.as_arrays(_week(spark, sf_dir).withColumn("y", G.moving_mean(7) + F.col("x")))


@query("p12_well_formed", f"{W}, {T0}, b AS (SELECT pattern_id, i, x, CASE WHEN i % 50 = 3 THEN NULL WHEN i % 50 = 4 THEN 'nan'::DOUBLE ELSE y END AS y FROM t0 WHERE pattern_id % 5 > 0 OR i < 15), f AS (SELECT *, count(*) OVER (PARTITION BY pattern_id) AS n FROM b WHERE y IS NOT NULL AND NOT isnan(y)) SELECT pattern_id, i FROM f WHERE n >= 16")
def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i") % 50
    bad = _week(spark, sf_dir).where("pattern_id % 5 > 0 OR i < 15").withColumn("y", F.when(i == 3, None).when(i == 4, float("nan")).otherwise(F.col("y")))
    return T.well_formed(bad).select("pattern_id", "i")


@query("a32_signature", f"{W}, {T0} SELECT pattern_id, count(*) AS n, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y, round(quantile_cont(y, 0.1), 3) AS p10, round(quantile_cont(y, 0.5), 3) AS p50, round(quantile_cont(y, 0.99), 3) AS p99 FROM t0 GROUP BY pattern_id")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.signature(_week(spark, sf_dir))


@query(
    "w20_background_on_grid",
    f"""{W}, {T0}, n AS (SELECT pattern_id, x AS nx, y AS ny FROM t0 WHERE i % 25 = 7), l AS (SELECT t.*, a.nx AS lx, a.ny AS ly FROM t0 t ASOF LEFT JOIN n a ON t.pattern_id = a.pattern_id AND t.x >= a.nx), r AS (SELECT l.*, b.nx AS rx, b.ny AS ry FROM l ASOF LEFT JOIN n b ON l.pattern_id = b.pattern_id AND l.x <= b.nx)
SELECT pattern_id, i, round(CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL OR rx = lx THEN ly ELSE ly + (ry - ly) * (x - lx) / (rx - lx) END, 6) AS background FROM r""",
)
def background_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _week(spark, sf_dir)
    nodes = t.where("i % 25 = 7").select("pattern_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return T.background_on_grid(t, nodes).select("pattern_id", "i", F.round("background", 6).alias("background"))


@query("w26_peak_mask", f"{W}, {T0}, p AS (SELECT pattern_id, x AS peak FROM t0 WHERE y >= 150) SELECT pattern_id, i, EXISTS (SELECT 1 FROM p WHERE p.pattern_id = t0.pattern_id AND t0.x BETWEEN peak - 0.5::DOUBLE AND peak + 0.5::DOUBLE) AS masked FROM t0")
def peak_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _week(spark, sf_dir)
    return T.peak_mask(t, t.where("y >= 150").select("pattern_id", F.col("x").alias("peak")), 0.5).select("pattern_id", "i", "masked")


def _gauss(sigma: float, name: str = "t0") -> str:
    import math

    r = round(sigma * 4)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    values = ", ".join(f"({i - r}, {w / sum(k)!r}::DOUBLE)" for i, w in enumerate(k))
    return f"kn AS (SELECT * FROM (VALUES {values}) v(o, w)), gs AS (SELECT t.pattern_id, t.i, sum(w * u.y) AS y FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY x) AS n, count(*) OVER (PARTITION BY pattern_id) AS m FROM {name}) t CROSS JOIN kn JOIN (SELECT pattern_id, y, row_number() OVER (PARTITION BY pattern_id ORDER BY x) AS n FROM {name}) u ON u.pattern_id = t.pattern_id AND u.n = greatest(1, least(m, t.n + o)) GROUP BY t.pattern_id, t.i)"


@query("w11_gaussian_filter", f"{W}, {T0}, {_gauss(3.0)} SELECT pattern_id, i, round(y, 6) AS y FROM gs")
def gaussian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week(spark, sf_dir).select("pattern_id", "i", F.round(G.gaussian_smooth(3.0), 6).alias("y"))


@query("w25_significant_peaks")
def significant_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.significant(_week(spark, sf_dir), reach=2.0)


@query("a31_features")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every trace."""
    return T.features(_traces(spark, sf_dir))


@query("w9_smoothing_plans")
def smoothing_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(_traces(spark, sf_dir)).select("pattern_id", *T.smoothing_plan())


@query("x4_selected_profiles")
def selected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by weights that follow from the features' names; without a weights table the fallback is profile 1."""
    rows = [(n, 0.0, 1.0, [float((i + k) % 3 - 1) for k in range(4)]) for i, n in enumerate((*T.SELECTOR_FEATURES, "bias"))]
    weights = spark.createDataFrame(rows, "feature string, mean double, std double, w array<double>")
    return T.selected_profile(T.features(_traces(spark, sf_dir)), weights)


_ARRAYS = """m0 AS (SELECT pattern_id, i, x, CAST(y AS DOUBLE) AS y FROM trace_week),
m1 AS (SELECT pattern_id, x, sum(y) OVER (PARTITION BY pattern_id ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 + x AS y FROM m0),
tr AS (SELECT pattern_id, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys, count(*)::INT AS n FROM m1 GROUP BY pattern_id),
d1 AS (SELECT *, list_transform(range(1, n), lambda i: xs[i + 1] - xs[i]) AS dx, list_transform(range(1, n), lambda i: ys[i + 1] - ys[i]) AS dy FROM tr),
d2 AS (SELECT *, list_aggregate(list_filter(dx, lambda v: v > 0), 'quantile_cont', 0.5) AS step, list_aggregate(dy, 'quantile_cont', 0.5) AS mdy, list_aggregate(ys, 'quantile_cont', 0.5) AS my FROM d1),
d3 AS (SELECT *, list_aggregate(list_transform(dy, lambda v: abs(v - mdy)), 'quantile_cont', 0.5) AS mad, list_aggregate(list_transform(ys, lambda v: abs(v - my)), 'quantile_cont', 0.5) AS mad_y FROM d2),
ds AS (SELECT pattern_id, xs, ys, n, step, CASE WHEN mad > 0 THEN greatest(1.4826::DOUBLE * mad / sqrt(2.0::DOUBLE), 1) ELSE greatest(1.4826::DOUBLE * mad_y, 1) END AS noise FROM d3)"""


def _rank_sql(ys: str, percent: float, size: str) -> str:
    """The value of rank floor(size * percent / 100) among `size` values around every point of a list."""
    return f"list_transform(range(1, n + 1), lambda i: list_sort(list_transform(range(i - {size} // 2, i - {size} // 2 + {size}), lambda j: {ys}[least(n, greatest(1, j))]))[CAST(floor({size} * {percent} / 100) AS INT) + 1])"


def _smooth_sql(ys: str, sigma: str) -> str:
    reach = f"CAST(floor(4 * {sigma} + 0.5) AS INT)"
    weight = f"exp(-0.5::DOUBLE * (k / {sigma}) * (k / {sigma}))"
    return f"list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(-{reach}, {reach} + 1), lambda k: {weight} * {ys}[least(n, greatest(1, i + k))])) / list_sum(list_transform(range(-{reach}, {reach} + 1), lambda k: {weight})))"


def _odd_sql(width: float, least: int, most: str) -> str:
    size = f"least(greatest(CAST(round_even({width} / step, 0) AS INT), {least}), greatest({most}, {least}))"
    return f"({size} + 1 - {size} % 2)"


_ENVELOPE = f"""{_ARRAYS}, e1 AS (SELECT *, {_odd_sql(0.45, 9, "n // 8")} AS small, {_odd_sql(2.8, 31, "n // 2")} AS broad, {_odd_sql(1.2, 9, "n // 5")} AS edge, {_odd_sql(3.0, 21, "n // 3")} / 7.0::DOUBLE AS edge_sigma, {_odd_sql(0.65, 9, "n // 6")} AS last, greatest(greatest(6.0::DOUBLE, least(12.0::DOUBLE, 0.16::DOUBLE * greatest(xs[n] - xs[1], step))), step) AS wide FROM ds),
e2 AS (SELECT *, greatest(broad / 8.0::DOUBLE, 2) AS sigma, least(21, greatest(7, broad // 5)) AS nodes0, {_rank_sql("ys", 18, "small")} AS lo, {_rank_sql("ys", 48, "small")} AS cap, {_rank_sql("ys", 32, "broad")} AS bl, {_rank_sql("ys", 26, "edge")} AS el, {_rank_sql("ys", 62, "last")} AS lc FROM e1),
e3 AS (SELECT *, nodes0 + 1 - nodes0 % 2 AS nodes, {_smooth_sql("bl", "sigma")} AS bs, {_smooth_sql("el", "edge_sigma")} AS es FROM e2),
e4 AS (SELECT *, list_transform(range(1, n + 1), lambda i: greatest(least(bs[i], cap[i] + greatest(1.8::DOUBLE * noise, 1)), lo[i] - greatest(2 * noise, 1))) AS mid0 FROM e3),
e5 AS (SELECT *, {_rank_sql("mid0", 50, "nodes")} AS mid, list_transform(range(1, n + 1), lambda i: least(es[i], ys[i] + greatest(1.5::DOUBLE * noise, 1))) AS side, list_transform(xs, lambda x: least((x - xs[1]) / wide, 1)) AS lt, list_transform(xs, lambda x: least((xs[n] - x) / wide, 1)) AS rt FROM e4),
e6 AS (SELECT *, list_transform(range(1, n + 1), lambda i: mid[i] * lt[i] * lt[i] * (3 - 2 * lt[i]) + side[i] * (1 - lt[i] * lt[i] * (3 - 2 * lt[i]))) AS b1 FROM e5),
e7 AS (SELECT *, list_transform(range(1, n + 1), lambda i: b1[i] * rt[i] * rt[i] * (3 - 2 * rt[i]) + side[i] * (1 - rt[i] * rt[i] * (3 - 2 * rt[i]))) AS b2 FROM e6),
env AS (SELECT pattern_id, unnest(range(n)) AS i, unnest(list_transform(range(1, n + 1), lambda i: greatest(least(b2[i], lc[i] + greatest(2 * noise, 1)), CASE WHEN list_min(ys) >= 0 THEN 0 ELSE list_aggregate(ys, 'quantile_cont', 0.005) END))) AS baseline FROM e7)"""


@query("w12_envelope", f"{W}, {_ENVELOPE} SELECT pattern_id, CAST(i AS INT) AS i, round(baseline, 5) AS baseline FROM env")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.envelope(_traces(spark, sf_dir))
    return rows.select("pattern_id", F.posexplode("baseline").alias("i", "baseline")).withColumn("baseline", F.round("baseline", 5))


@query("w16_chebyshev_baseline")
def chebyshev_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chebyshev_baseline(_traces(spark, sf_dir))


@query("w17_halo")
def halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.halo(_traces(spark, sf_dir))


@query("w18_peak_suppressed")
def peak_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.peak_suppressed(_traces(spark, sf_dir))


_PARTS = f"""{_ARRAYS}, q0 AS (SELECT *, 5 AS five FROM ds), q1 AS (SELECT *, {_rank_sql("ys", 50, "five")} AS med FROM q0), q2 AS (SELECT *, list_transform(range(1, n + 1), lambda i: abs(ys[i] - med[i])) AS off FROM q1),
q3 AS (SELECT *, greatest(10 * noise, list_aggregate(off, 'quantile_cont', 0.998)) AS lim FROM q2), q4 AS (SELECT *, list_filter(range(1, n + 1), lambda i: off[i] <= lim) AS good FROM q3),
q5 AS (SELECT *, list_transform(range(1, n + 1), lambda i: [coalesce(list_max(list_filter(good, lambda g: g < i)), list_min(list_filter(good, lambda g: g > i))), coalesce(list_min(list_filter(good, lambda g: g > i)), list_max(list_filter(good, lambda g: g < i)))]) AS gap FROM q4),
q6 AS (SELECT * EXCLUDE (ys), list_transform(range(1, n + 1), lambda i: CASE WHEN off[i] <= lim THEN ys[i] ELSE ys[gap[i][1]] + (ys[gap[i][2]] - ys[gap[i][1]]) * (i - gap[i][1]) / greatest(gap[i][2] - gap[i][1], 1) END) AS ys FROM q5),
q7 AS (SELECT *, {_odd_sql(12.0, 41, "2 * n // 3")} AS s1, {_odd_sql(1.2, 21, "n // 5")} AS s2, {_odd_sql(5.0, 11, "n // 12")} AS s3, greatest(3.5::DOUBLE / step, 3) AS g1, greatest(3.8::DOUBLE / step, 2) AS g2 FROM q6),
q8 AS (SELECT *, {_rank_sql("ys", 7, "s1")} AS low, {_rank_sql("ys", 18, "s2")} AS fl FROM q7), q9 AS (SELECT *, {_smooth_sql("low", "g1")} AS base FROM q8),
qa AS (SELECT *, list_transform(range(1, n + 1), lambda i: greatest(least(base[i], fl[i] - 0.4::DOUBLE * noise), list_aggregate(ys, 'quantile_cont', 0.002) - 2 * noise)) AS bg FROM q9), qb AS (SELECT *, list_transform(range(1, n + 1), lambda i: ys[i] - bg[i]) AS above FROM qa),
qc AS (SELECT *, {_rank_sql("above", 18, "s3")} AS clip FROM qb), qd AS (SELECT *, {_smooth_sql("clip", "g2")} AS br FROM qc),
dec AS (SELECT pattern_id, unnest(range(n)) AS i, unnest(bg) AS background, unnest(list_transform(br, lambda v: greatest(v, 0))) AS broad, unnest(list_transform(range(1, n + 1), lambda i: above[i] - greatest(br[i], 0))) AS crystalline, unnest(list_transform(off, lambda v: v > lim)) AS artifact FROM qd)"""


@query("w19_decomposition", f"{W}, {_PARTS} SELECT pattern_id, CAST(i AS INT) AS i, round(background, 5) AS background, round(broad, 5) AS broad, round(crystalline, 5) AS crystalline, artifact FROM dec")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("background", "broad", "crystalline", F.col("artifacts").alias("artifact"))).alias("i", "v")
    rows = T.decompose(_traces(spark, sf_dir)).select("pattern_id", zipped).select("pattern_id", "i", "v.*")
    return rows.select("pattern_id", "i", *(F.round(c, 5).alias(c) for c in ("background", "broad", "crystalline")), "artifact")


@query("a36_background_choice")
def background_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.choose_background(_traces(spark, sf_dir)).drop("baseline")


@query("w6_w7_line_records")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_records(_traces(spark, sf_dir))


@query("q4_prepare_observed")
def prepare_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prepare_observed(_traces(spark, sf_dir)).select("pattern_id", "width", F.explode("peaks").alias("p")).select("pattern_id", "width", "p.*")


@query("q5_auto_preprocess")
def auto_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.auto_preprocess(_traces(spark, sf_dir)).select("pattern_id", "method", "window", "passes", "profile", "smooth", "corrected", "background")


@query("q11_training_records")
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace on 4096 points, with background and peak marks, as arrays."""
    return T.training_records(_week(spark, sf_dir)).drop("x")
