"""Registered queries of the operators on traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.operators import signal as G
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


W, VEC = with_views("trace_week"), with_views("trace_vec") + ", tv AS (SELECT vec_id AS pattern_id, i, x, y FROM trace_vec)"
OWN, P = "PARTITION BY pattern_id", "PARTITION BY pattern_id ORDER BY x"


def _week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "trace_week").withColumn("y", F.col("y").cast("double"))


def _vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "trace_vec").withColumnRenamed("vec_id", "pattern_id")


def _around(r: int, weights: list[float] | None = None) -> list[str]:
    before = [f"coalesce(lag(y, {k}) OVER ({P}), first_value(y) OVER ({P}))" for k in range(r, 0, -1)]
    after = [f"coalesce(lead(y, {k}) OVER ({P}), last_value(y) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for k in range(1, r + 1)]
    return [*before, "y", *after]


_NOISE = f"""d AS (SELECT *, y - lag(y) OVER ({P}) AS dy, x - lag(x) OVER ({P}) AS dx FROM t0),
m AS (SELECT *, quantile_cont(dy, 0.5) OVER ({OWN}) AS md, quantile_cont(y, 0.5) OVER ({OWN}) AS my FROM d),
nz AS (SELECT pattern_id, count(*) AS n, CASE WHEN quantile_cont(abs(dy - md), 0.5) > 0 THEN greatest(1.4826::DOUBLE * quantile_cont(abs(dy - md), 0.5) / sqrt(2), 1.0::DOUBLE) ELSE greatest(1.4826::DOUBLE * quantile_cont(abs(y - my), 0.5), 1.0::DOUBLE) END AS noise, quantile_cont(CASE WHEN dx > 0 THEN dx END, 0.5) AS step FROM m GROUP BY pattern_id)"""
T0 = "t0 AS (SELECT pattern_id, i, x, CAST(y AS DOUBLE) AS y FROM trace_week)"


@query("a30_noise_step", f"{W}, {T0}, {_NOISE} SELECT pattern_id, n, round(noise, 6) AS noise, round(step, 6) AS step FROM nz")
def noise_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.noise_and_step(_week(spark, sf_dir)).select("pattern_id", "n", F.round("noise", 6).alias("noise"), F.round("step", 6).alias("step"))


def _gauss_sql(sigma: float) -> str:
    import math

    r = max(1, round(sigma * 4))
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return " + ".join(f"{v} * {w / sum(k)!r}::DOUBLE" for w, v in zip(k, _around(r), strict=True))


@query(
    "w8_smoothing",
    f"""{VEC} SELECT pattern_id, i, round(sum(y) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS moving, round({_gauss_sql(1.0)}, 6) AS gaussian,
round(CASE WHEN i BETWEEN 2 AND 61 THEN (-3 * lag(y, 2) OVER ({P}) + 12 * lag(y) OVER ({P}) + 17 * y + 12 * lead(y) OVER ({P}) - 3 * lead(y, 2) OVER ({P})) / 35
 WHEN i = 0 THEN (31 * y + 9 * lead(y) OVER ({P}) - 3 * lead(y, 2) OVER ({P}) - 5 * lead(y, 3) OVER ({P}) + 3 * lead(y, 4) OVER ({P})) / 35
 WHEN i = 1 THEN (9 * lag(y) OVER ({P}) + 13 * y + 12 * lead(y) OVER ({P}) + 6 * lead(y, 2) OVER ({P}) - 5 * lead(y, 3) OVER ({P})) / 35
 WHEN i = 63 THEN (31 * y + 9 * lag(y) OVER ({P}) - 3 * lag(y, 2) OVER ({P}) - 5 * lag(y, 3) OVER ({P}) + 3 * lag(y, 4) OVER ({P})) / 35
 ELSE (9 * lead(y) OVER ({P}) + 13 * y + 12 * lag(y) OVER ({P}) + 6 * lag(y, 2) OVER ({P}) - 5 * lag(y, 3) OVER ({P})) / 35 END, 6) AS savgol FROM tv""",
)
def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(spark, sf_dir).select("pattern_id", "i", F.round(G.moving_mean(5), 6).alias("moving"), F.round(G.gaussian_smooth(1.0), 6).alias("gaussian"), F.round(G.savgol5(), 6).alias("savgol"))


@query("w10_percentile_filter", f"{VEC} SELECT pattern_id, i, round(list_sort([{', '.join(_around(3))}])[2], 6) AS low FROM tv")
def percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(spark, sf_dir).select("pattern_id", "i", F.round(G.percentile_filter(22, 7), 6).alias("low"))


@query(
    "w13_snip",
    VEC + """, a AS (SELECT pattern_id, list(y ORDER BY x) AS ys FROM tv GROUP BY pattern_id),
s AS (WITH RECURSIVE r(pattern_id, m, ys) AS (SELECT pattern_id, 0, ys FROM a UNION ALL SELECT pattern_id, m + 1, list_transform(range(1, len(ys) + 1), lambda k: CASE WHEN k > m + 1 AND k <= len(ys) - m - 1 THEN least(ys[k], (ys[k - m - 1] + ys[k + m + 1]) / 2) ELSE ys[k] END) FROM r WHERE m < 8)
 SELECT pattern_id, ys FROM r WHERE m = 8), u AS (SELECT pattern_id, unnest(ys) AS b, unnest(range(len(ys))) AS i FROM s) SELECT pattern_id, CAST(i AS INT) AS i, round(b, 6) AS baseline FROM u""",
)
def snip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.as_arrays(_vec(spark, sf_dir)).select("pattern_id", F.posexplode(G.snip_arrays(F.col("ys"), 8)).alias("i", "b"))
    return rows.select("pattern_id", "i", F.round("b", 6).alias("baseline"))


@query(
    "w14_rolling_ball",
    f"""{W}, {T0}, a AS (SELECT *, min(y) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS lo FROM t0), b AS (SELECT *, max(lo) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS hi FROM a)
SELECT pattern_id, i, round(avg(hi) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS baseline FROM b""",
)
def rolling_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rolling_ball(_week(spark, sf_dir), 5).select("pattern_id", "i", F.round("baseline", 6).alias("baseline"))


@query(
    "w15_node_baseline",
    f"""{VEC}, c AS (SELECT *, least(floor((x - min(x) OVER ({OWN})) / (max(x) OVER ({OWN}) - min(x) OVER ({OWN})) * 18), 17) AS bin FROM tv),
n AS (SELECT pattern_id, bin, avg(x) AS nx, quantile_cont(y, 0.1) AS ny FROM c GROUP BY pattern_id, bin),
k AS (SELECT pattern_id, nx, quantile_cont(ny, 0.5) OVER (PARTITION BY pattern_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ny FROM n),
j AS (SELECT t.pattern_id, t.i, t.x, max(k.nx) FILTER (WHERE k.nx <= t.x) AS lx, min(k.nx) FILTER (WHERE k.nx >= t.x) AS rx FROM tv t JOIN k ON t.pattern_id = k.pattern_id GROUP BY t.pattern_id, t.i, t.x)
SELECT j.pattern_id, i, round(CASE WHEN lx IS NULL THEN r.ny WHEN rx IS NULL OR rx = lx THEN l.ny ELSE l.ny + (r.ny - l.ny) * (x - lx) / (rx - lx) END, 6) AS baseline
FROM j LEFT JOIN k l ON j.pattern_id = l.pattern_id AND j.lx = l.nx LEFT JOIN k r ON j.pattern_id = r.pattern_id AND j.rx = r.nx""",
)
def node_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_baseline(_vec(spark, sf_dir), 18).select("pattern_id", "i", F.round("baseline", 6).alias("baseline"))


_MAXIMA = f"""nb AS (SELECT *, row_number() OVER ({P}) - 1 AS k, CASE WHEN y = lag(y) OVER ({P}) THEN 0 ELSE 1 END AS nw FROM t0), ru AS (SELECT *, sum(nw) OVER ({P}) AS run FROM nb),
rs AS (SELECT pattern_id, run, min(k) AS a, max(k) AS b, any_value(y) AS y FROM ru GROUP BY pattern_id, run),
mx AS (SELECT pattern_id, CAST(floor((a + b) / 2) AS INT) AS i, y FROM (SELECT *, lag(y) OVER (PARTITION BY pattern_id ORDER BY run) AS p, lead(y) OVER (PARTITION BY pattern_id ORDER BY run) AS q FROM rs) WHERE p < y AND q < y)"""
_PROM = """hb AS (SELECT m.pattern_id, m.i, m.y, coalesce(max(n.k) FILTER (WHERE n.k < m.i AND n.y > m.y), -1) AS lb, coalesce(min(n.k) FILTER (WHERE n.k > m.i AND n.y > m.y), 1000000) AS rb FROM mx m JOIN nb n ON m.pattern_id = n.pattern_id GROUP BY m.pattern_id, m.i, m.y),
pr AS (SELECT h.pattern_id, h.i, h.y, h.y - greatest(min(n.y) FILTER (WHERE n.k > lb AND n.k <= h.i), min(n.y) FILTER (WHERE n.k >= h.i AND n.k < rb)) AS prominence FROM hb h JOIN nb n ON h.pattern_id = n.pattern_id GROUP BY h.pattern_id, h.i, h.y)"""


@query("w3_local_maxima", f"{W}, {T0}, {_MAXIMA} SELECT pattern_id, i, y FROM mx")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_maxima(_week(spark, sf_dir))


@query("w4_prominence", f"{W}, {T0}, {_MAXIMA}, {_PROM} SELECT pattern_id, i, y, round(prominence, 6) AS prominence FROM pr")
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.prominences(_week(spark, sf_dir)).withColumn("prominence", F.round("prominence", 6))


@query("w5_distance_suppression")
def suppress_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suppress_close(G.local_maxima(_week(spark, sf_dir)), 4)


@query(
    "w21_resample",
    f"""{VEC}, g AS (SELECT DISTINCT pattern_id, k AS g, 5.0::DOUBLE + k * (85.0::DOUBLE / 255) AS x FROM tv, (SELECT unnest(range(256)) AS k)),
j AS (SELECT g.pattern_id, g.g, g.x, max(t.x) FILTER (WHERE t.x <= g.x) AS lx, min(t.x) FILTER (WHERE t.x >= g.x) AS rx FROM g JOIN tv t ON g.pattern_id = t.pattern_id GROUP BY g.pattern_id, g.g, g.x)
SELECT j.pattern_id, CAST(g AS INT) AS g, round(CASE WHEN lx IS NULL OR rx IS NULL THEN 0 WHEN lx = rx THEN l.y ELSE l.y + (r.y - l.y) * (j.x - lx) / (rx - lx) END, 5) AS y
FROM j LEFT JOIN tv l ON j.pattern_id = l.pattern_id AND lx = l.x LEFT JOIN tv r ON j.pattern_id = r.pattern_id AND rx = r.x""",
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resample(_vec(spark, sf_dir), 5.0, 90.0, 256).select("pattern_id", "g", F.round("y", 5).alias("y"))


@query(
    "w22_merge_close_peaks",
    with_views("ref_peak") + """, w AS (SELECT *, CASE WHEN round(two_theta - lag(two_theta) OVER p, 9) <= 0.035 THEN 0 ELSE 1 END AS nw FROM ref_peak WINDOW p AS (PARTITION BY entry_id ORDER BY two_theta, peak_index)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY entry_id ORDER BY two_theta, peak_index) AS session FROM w)
SELECT entry_id, CAST(session AS BIGINT) AS session, count(*) AS n, sum(intensity) AS intensity, round(sum(two_theta * intensity) / sum(intensity), 6) AS two_theta, arg_max(peak_index, intensity * 1000 - peak_index) AS best_index FROM s GROUP BY entry_id, session""",
)
def merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_close(view(spark, sf_dir, "ref_peak")).withColumn("two_theta", F.round("two_theta", 6))


@query(
    "w23_stack_offsets",
    f"""{W}, h AS (SELECT pattern_id, CAST(max(y) AS DOUBLE) AS height FROM trace_week GROUP BY pattern_id)
SELECT pattern_id, height, round(coalesce(sum(height * 0.4::DOUBLE) OVER (PARTITION BY pattern_id % 20 ORDER BY pattern_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS y_offset FROM h""",
)
def stack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of stacked traces: the last at 0, each other above the heights of those behind it, by series (here the patterns of one remainder)."""
    h = _week(spark, sf_dir).groupBy("pattern_id").agg(F.max("y").alias("height"))
    behind = Window.partitionBy(F.col("pattern_id") % 20).orderBy(F.desc("pattern_id")).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("y_offset", F.round(F.coalesce(F.sum(F.col("height") * 0.4).over(behind), F.lit(0.0)), 6))


@query(
    "a31_signal_features",
    f"""{VEC}, t0 AS (SELECT * FROM tv), {_NOISE}, g AS (SELECT *, (lead(y) OVER ({P}) - lag(y) OVER ({P})) / 2 AS g FROM t0), c AS (SELECT *, (lead(g) OVER ({P}) - lag(g) OVER ({P})) / 2 AS c FROM g),
f AS (SELECT pattern_id, count(*) AS points, greatest(quantile_cont(y, 0.99) - quantile_cont(y, 0.01), 1.0::DOUBLE) AS span, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y, quantile_cont(abs(g), 0.95) AS gradient, quantile_cont(abs(c), 0.95) AS curvature FROM c GROUP BY pattern_id)
SELECT f.pattern_id, points, round(span, 5) AS span, round(p10, 5) AS p10, round(p50, 5) AS p50, round(first_y, 5) AS first_y, round(last_y, 5) AS last_y, round(gradient, 5) AS gradient, round(curvature, 5) AS curvature, round(least(noise / span, 1), 5) AS noise_ratio FROM f JOIN nz ON f.pattern_id = nz.pattern_id""",
)
def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.features(_vec(spark, sf_dir))
    return f.select("pattern_id", "points", *(F.round(c, 5).alias(c) for c in ("span", "p10", "p50", "first_y", "last_y", "gradient", "curvature", "noise_ratio")))


@query("f22_normalise", f"{W} SELECT pattern_id, i, round(CAST(y AS DOUBLE) * 100 / nullif(max(CAST(y AS DOUBLE)) OVER ({OWN}), 0), 6) AS y FROM trace_week")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week(spark, sf_dir).select("pattern_id", "i", F.round(F.col("y") * 100 / F.nullif(F.max("y").over(G.own()), F.lit(0.0)), 6).alias("y"))


@query("p8_crop", f"{W} SELECT pattern_id, i FROM trace_week WHERE (x BETWEEN 15 AND 20 OR x BETWEEN 40 AND 60)")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the union of ranges; a range whose end is not above its start is dropped, and no range keeps all."""
    ranges = F.filter(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((15.0, 20.0), (40.0, 60.0), (30.0, 25.0)))), lambda r: r["lo"] < r["hi"])
    return _week(spark, sf_dir).where((F.size(ranges) == 0) | F.exists(ranges, lambda r: F.col("x").between(r["lo"], r["hi"]))).select("pattern_id", "i")


@query(
    "a20_trapezoid_area",
    f"""{W}, {T0}, l AS (SELECT *, lag(x) OVER ({P}) AS x0, lag(y) OVER ({P}) AS y0 FROM t0) SELECT pattern_id, round(sum((x - x0) * (y + y0) / 2), 5) AS area FROM l GROUP BY pattern_id""",
)
def trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _week(spark, sf_dir).withColumn("a", (F.col("x") - F.lag("x").over(G.by_x())) * (F.col("y") + F.lag("y").over(G.by_x())) / 2)
    return t.groupBy("pattern_id").agg(F.round(F.sum("a"), 5).alias("area"))


@query(
    "a19_a22_profile_fit",
    f"""{W}, {T0}, c AS (SELECT *, avg(y) OVER ({P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS calc FROM t0)
SELECT pattern_id, round(least(greatest(100 * (1 - sum(pow(y - calc, 2)) / nullif(sum(y * y), 0)), 0), 100), 5) AS fit,
  round(100 * (sum(least(y, calc)) / nullif(sum(y), 0)) * sum(least(y, calc)) / nullif(sum(least(y, calc)) + 3 * sum(greatest(calc - y, 0)), 0), 5) AS gain FROM c GROUP BY pattern_id""",
)
def profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit quality of a calculated curve, and its gain: what it covers against three times what it exceeds."""
    c = _week(spark, sf_dir).withColumn("calc", F.avg("y").over(G.by_x().rowsBetween(-3, 3)))
    y, k = F.col("y"), F.col("calc")
    covered, over = F.sum(F.least(y, k)), F.sum(F.greatest(k - y, F.lit(0.0)))
    fit = F.least(F.greatest(100 * (1 - F.sum((y - k) * (y - k)) / F.nullif(F.sum(y * y), F.lit(0.0))), F.lit(0.0)), F.lit(100.0))
    gain = 100 * (covered / F.nullif(F.sum("y"), F.lit(0.0))) * covered / F.nullif(covered + 3 * over, F.lit(0.0))
    return c.groupBy("pattern_id").agg(F.round(fit, 5).alias("fit"), F.round(gain, 5).alias("gain"))


_PV = "(0.5 / (1 + 4 * pow((5.0::DOUBLE + g * 0.05::DOUBLE - two_theta) / 0.2, 2)) + 0.5 * exp(-2.772588722239781::DOUBLE * pow((5.0::DOUBLE + g * 0.05::DOUBLE - two_theta) / 0.2, 2)))"


@query(
    "j10_rasterise",
    with_views("ref_peak") + f""", h AS (SELECT *, unnest(range(CAST(greatest(ceil((two_theta - 1.0 - 5.0) / 0.05::DOUBLE), 0) AS BIGINT), CAST(least(floor((two_theta + 1.0 - 5.0) / 0.05::DOUBLE), 1699) AS BIGINT) + 1)) AS g FROM ref_peak WHERE two_theta <= 91),
y AS (SELECT entry_id, g, sum(intensity * {_PV}) AS y FROM h GROUP BY entry_id, g) SELECT entry_id, g, round(y * 100 / max(y) OVER (PARTITION BY entry_id), 4) AS y FROM y""",
)
def rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "ref_peak").select("entry_id", "two_theta", "intensity")
    return G.rasterise(lines, 5.0, 0.05, 1700, 0.2).withColumn("y", F.round("y", 4))
