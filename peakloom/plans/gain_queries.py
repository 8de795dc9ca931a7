"""Registered queries of what a further phase would explain: curves, residual lines, gains and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import gains as G
from peakloom.operators.signal import profiles, rasterise
from peakloom.operators.storage import bounded_broadcast, dealt, shuffled
from peakloom.plans.fixtures import SEARCH_EVERY, ranking, searches, view, with_searches
from peakloom.plans.search_queries import SEARCHED

QUERIES: dict = {}
SQL: dict[str, str] = {}
POINTS, FWHM, SHARE = 1151, 0.4, 0.6


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- the setting: the best two phases of the search are chosen, the next eight are candidates -------------------


def _ranked(spark: SparkSession, sf_dir: str, every: int, condition: str) -> DataFrame:
    """Phases by their rank in the search."""
    return ranking(spark, sf_dir, every).where(condition).select("pattern_id", "entry_id")


def _profile(spark: SparkSession, sf_dir: str, phases: DataFrame) -> DataFrame:
    """Profiles (pattern_id, entry_id, profile) of all lines of the phases, an array of (g, p). Lines go to their patterns, profiles are made there."""
    lines = view(spark, sf_dir, "ref_peak").join(bounded_broadcast(phases), "entry_id").select(*G.OWN, "two_theta", "intensity")
    packed = profiles(dealt(lines, "pattern_id"), G.LOW, G.STEP, POINTS, FWHM, by=G.OWN)
    return packed.select(*G.OWN, F.transform("c", lambda v: F.struct(v["g"].alias("g"), F.round(v["y"], 6).alias("p"))).alias("profile"))


def curves(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """The profile of a pattern's observed lines, 60 % of the best phase's as its total, and what is left."""
    seen = searches(spark, sf_dir, every).select(F.col("pattern_id").cast("string").alias("entry_id"), "two_theta", F.col("height").alias("intensity"))
    target = rasterise(seen, G.LOW, G.STEP, POINTS, FWHM).select(F.col("entry_id").cast("long").alias("pattern_id"), "g", F.round("y", 6).alias("target"))
    total = _profile(spark, sf_dir, _ranked(spark, sf_dir, every, "rank = 1")).select("pattern_id", F.inline("profile")).select("pattern_id", "g", F.round(F.col("p") * SHARE, 6).alias("total"))
    grid = target.select("pattern_id").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1)))).withColumn("g", F.col("g").cast("long"))
    rows = grid.join(shuffled(target), ["pattern_id", "g"], "left").join(shuffled(total), ["pattern_id", "g"], "left").na.fill(0.0, ["target", "total"])
    return rows.select("pattern_id", F.col("g").cast("int").alias("g"), "target", "total", F.greatest(F.round(F.col("target") - F.col("total"), 6), F.lit(0.0)).alias("residual"))


def _sticks(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return view(spark, sf_dir, "ref_peak").where("intensity >= 60").join(_ranked(spark, sf_dir, every, "rank <= 2"), "entry_id").select("pattern_id", F.col("two_theta").alias("stick"))


def _lines(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return view(spark, sf_dir, "ref_peak").join(_ranked(spark, sf_dir, every, "rank BETWEEN 3 AND 10"), "entry_id")


def _raster(source: str, name: str) -> str:
    pv = "(0.5::DOUBLE * (1 / (1 + 4 * ((5.0::DOUBLE + g * 0.1::DOUBLE - two_theta) / 0.4) * ((5.0::DOUBLE + g * 0.1::DOUBLE - two_theta) / 0.4))) + 0.5::DOUBLE * exp(-2.772588722239781::DOUBLE * ((5.0::DOUBLE + g * 0.1::DOUBLE - two_theta) / 0.4) * ((5.0::DOUBLE + g * 0.1::DOUBLE - two_theta) / 0.4)))"
    return f"""{name}h AS (SELECT *, unnest(range(CAST(greatest(ceil((two_theta - 2.0::DOUBLE - 5.0::DOUBLE) / 0.1::DOUBLE), 0) AS BIGINT), CAST(least(floor((two_theta + 2.0::DOUBLE - 5.0::DOUBLE) / 0.1::DOUBLE), 1150) AS BIGINT) + 1)) AS g FROM {source}),
{name} AS (SELECT key, g, round(y * 100 / max(y) OVER (PARTITION BY key), 6) AS y FROM (SELECT key, g, sum(intensity * {pv}) AS y FROM {name}h GROUP BY key, g))"""


_ALL = ("ref_phase", "ref_peak", "obs_peak")
_SET = f"""{SEARCHED}, rk AS (SELECT pattern_id, entry_id, rank FROM t WHERE rank <= 20),
sl AS (SELECT entry_id AS key, two_theta, intensity FROM ref_peak WHERE entry_id IN (SELECT entry_id FROM rk)),
ol AS (SELECT pattern_id AS key, two_theta, height AS intensity FROM obs_peak),
{_raster('sl', 'sp')}, {_raster('ol', 'op')},
cv AS (SELECT pattern_id, g, target, total, greatest(round(target - total, 6), 0) AS residual FROM (SELECT p.pattern_id, i.g, coalesce(op.y, 0) AS target, coalesce(round(sp.y * 0.6::DOUBLE, 6), 0) AS total
  FROM (SELECT DISTINCT pattern_id FROM obs_peak) p CROSS JOIN (SELECT unnest(range(1151)) AS g) i LEFT JOIN op ON op.key = p.pattern_id AND op.g = i.g LEFT JOIN rk ON rk.pattern_id = p.pattern_id AND rank = 1 LEFT JOIN sp ON sp.key = rk.entry_id AND sp.g = i.g)),
st AS (SELECT pattern_id, two_theta AS stick FROM ref_peak JOIN rk USING (entry_id) WHERE intensity >= 60 AND rank <= 2),
ln AS (SELECT pattern_id, r.* FROM ref_peak r JOIN rk USING (entry_id) WHERE rank BETWEEN 3 AND 10)"""
_WEIGHTED = """w0 AS (SELECT *, greatest(quantile_cont(greatest(target, 0), 0.55) OVER (PARTITION BY pattern_id), 1.0::DOUBLE) AS lo, quantile_cont(greatest(target, 0), 0.96) OVER (PARTITION BY pattern_id) AS hi, count(*) OVER (PARTITION BY pattern_id) AS np FROM cv),
w1 AS (SELECT pattern_id, g, target, total, residual, 1 / sqrt(least(greatest(greatest(target, 0), lo), greatest(hi, lo))) * CASE WHEN EXISTS (SELECT 1 FROM obs_peak o WHERE o.pattern_id = w0.pattern_id AND o.height >= 300 AND abs(CAST(round((o.two_theta - 5.0::DOUBLE) / 0.1::DOUBLE) AS INT) - g) <= greatest(2, np // 900)) THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM w0),
wt AS (SELECT * EXCLUDE (w), w / greatest(quantile_cont(w, 0.5) OVER (PARTITION BY pattern_id), 1e-9::DOUBLE) AS w FROM w1)"""


def weighted(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    peaks = searches(spark, sf_dir, every).where("height >= 300").select("pattern_id", G._cell(F.col("two_theta")).alias("g"))
    return G.fit_weights(curves(spark, sf_dir, every), peaks)


@query("a16_fit_weights", with_searches(*_ALL) + f", {_SET}, {_WEIGHTED} SELECT pattern_id, CAST(g AS INT) AS g, round(w, 6) AS w FROM wt")
def fit_weights(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return weighted(spark, sf_dir, every).select("pattern_id", "g", F.round("w", 6).alias("w"))


_SUMMARY = """fs AS (SELECT pattern_id, least(greatest(100 * (1 - sum(w * (target - total) * (target - total)) / nullif(sum(w * target * target), 0)), 0), 100) AS fit,
  sum(w * target) - (arg_min(w * target, g) + arg_max(w * target, g)) / 2 AS target_area, sum(w * residual) - (arg_min(w * residual, g) + arg_max(w * residual, g)) / 2 AS residual_area,
  sum(w * e) - (arg_min(w * e, g) + arg_max(w * e, g)) / 2 AS error FROM (SELECT *, CASE WHEN total > target THEN 3 * (total - target) ELSE target - total END AS e FROM wt) GROUP BY pattern_id)"""


@query("a19_a20_fit_summary", with_searches(*_ALL) + f", {_SET}, {_WEIGHTED}, {_SUMMARY} SELECT pattern_id, round(fit, 5) AS fit, round(target_area, 4) AS target_area, round(residual_area, 4) AS residual_area, round(residual_area / greatest(target_area, 1e-12), 6) AS residual_share, round(error, 4) AS error FROM fs")
def fit_summary(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    s = G.fit_summary(weighted(spark, sf_dir, every))
    return s.select("pattern_id", F.round("fit", 5).alias("fit"), *(F.round(c, 4).alias(c) for c in ("target_area", "residual_area")), F.round("residual_share", 6).alias("residual_share"), F.round("error", 4).alias("error"))


@query(
    "a21_residual_scales",
    with_searches(*_ALL) + f""", {_SET}, {_WEIGHTED}, cp AS (SELECT wt.*, rk.entry_id, sp.y AS p FROM wt JOIN rk ON wt.pattern_id = rk.pattern_id AND rank BETWEEN 3 AND 10 JOIN sp ON sp.key = rk.entry_id AND sp.g = wt.g),
i AS (SELECT pattern_id, entry_id, sum(w * p * greatest(target - total, 0)) / sum(w * p * p) AS initial FROM cp GROUP BY pattern_id, entry_id),
f AS (SELECT round(unnest(range(0, 28)) * 0.05, 2)::DOUBLE AS factor), m AS (SELECT cp.pattern_id, cp.entry_id, factor, any_value(initial) * factor AS scale, round(sum(w * CASE WHEN total + p * initial * factor > target THEN 5 * (total + p * initial * factor - target) ELSE target - total - p * initial * factor END), 6) AS error
  FROM cp JOIN i USING (pattern_id, entry_id) CROSS JOIN f GROUP BY cp.pattern_id, cp.entry_id, factor)
SELECT pattern_id, entry_id, round(scale, 5) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id, entry_id ORDER BY error, factor) AS n FROM m) WHERE n = 1""",
)
def residual_scales(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    candidates = _profile(spark, sf_dir, _ranked(spark, sf_dir, every, "rank BETWEEN 3 AND 10"))
    return G.residual_scales(weighted(spark, sf_dir, every), candidates).withColumn("scale", F.round("scale", 5))


_FLOORS = """fl AS (SELECT pattern_id, greatest(coalesce(0.28::DOUBLE * quantile_cont(residual, 0.72) FILTER (WHERE residual > 0), 1), coalesce(0.045::DOUBLE * quantile_cont(residual, 0.93) FILTER (WHERE residual > 0), 1), 1) AS rf,
  greatest(coalesce(0.20::DOUBLE * quantile_cont(residual, 0.65) FILTER (WHERE residual > 0), 1), coalesce(0.025::DOUBLE * quantile_cont(target, 0.80) FILTER (WHERE target > 0), 1), 1) AS df, greatest(coalesce(quantile_cont(total, 0.55) FILTER (WHERE total > 0), 1), 1) AS sf FROM cv GROUP BY pattern_id)"""
_RESIDUAL = f"""{_FLOORS}, fr AS (SELECT * FROM obs_peak o WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.pattern_id = o.pattern_id AND stick BETWEEN o.two_theta - greatest(greatest(0.24::DOUBLE, least(0.95::DOUBLE, greatest(fwhm, 0.18::DOUBLE) * 1.45::DOUBLE)), 0.54::DOUBLE) AND o.two_theta + greatest(greatest(0.24::DOUBLE, least(0.95::DOUBLE, greatest(fwhm, 0.18::DOUBLE) * 1.45::DOUBLE)), 0.54::DOUBLE))),
rs AS (SELECT fr.* FROM fr JOIN cv ON cv.pattern_id = fr.pattern_id AND cv.g = CAST(round((fr.two_theta - 5.0::DOUBLE) / 0.1::DOUBLE) AS INT) JOIN fl ON fl.pattern_id = fr.pattern_id
  WHERE residual > CASE WHEN total >= sf THEN greatest(0.45::DOUBLE * greatest(target, 1), rf) ELSE rf END)"""


def _residual(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return G.residual_lines(searches(spark, sf_dir, every), _sticks(spark, sf_dir, every), curves(spark, sf_dir, every))


@query("j8_residual_lines", with_searches(*_ALL) + f", {_SET}, {_RESIDUAL} SELECT pattern_id, peak_id, two_theta, height, area FROM rs")
def residual_lines(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return _residual(spark, sf_dir, every).select("pattern_id", "peak_id", "two_theta", "height", "area")


@query(
    "j9_overlap_lines",
    with_searches(*_ALL) + f""", {_SET}, {_FLOORS}, a AS (SELECT *, greatest(0.28::DOUBLE, least(0.85::DOUBLE, greatest(fwhm, 0.18::DOUBLE) * 1.7::DOUBLE)) AS reach FROM obs_peak),
n AS (SELECT *, greatest(reach, fwhm * 1.25::DOUBLE) AS half FROM a WHERE EXISTS (SELECT 1 FROM st WHERE st.pattern_id = a.pattern_id AND stick BETWEEN a.two_theta - reach AND a.two_theta + reach)),
m AS (SELECT n.pattern_id, n.peak_id, any_value(two_theta) AS two_theta, any_value(area) AS area, max(target) AS t, max(total) AS c, max(residual) AS r FROM n JOIN cv ON cv.pattern_id = n.pattern_id AND cv.g BETWEEN ceil(round((n.two_theta - half - 5.0::DOUBLE) / 0.1::DOUBLE, 6)) AND floor(round((n.two_theta + half - 5.0::DOUBLE) / 0.1::DOUBLE, 6)) GROUP BY n.pattern_id, n.peak_id)
SELECT m.pattern_id, peak_id, two_theta, round(greatest(t - c, r, 0), 6) AS height, round(greatest(area * (greatest(t - c, r, 0) / greatest(t, 1e-12)), greatest(t - c, r, 0)), 6) AS area FROM m JOIN fl ON m.pattern_id = fl.pattern_id WHERE greatest(t - c, r, 0) >= df AND greatest(t - c, r, 0) / greatest(t, 1e-12) >= 0.12""",
)
def overlap_lines(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    rows = G.overlap_lines(searches(spark, sf_dir, every), _sticks(spark, sf_dir, every), curves(spark, sf_dir, every))
    return rows.select("pattern_id", "peak_id", "two_theta", F.round("height", 6).alias("height"), F.round("area", 6).alias("area"))


@query("k5_gain_positions", with_searches(*_ALL) + f", {_SET}, {_RESIDUAL} SELECT pattern_id, peak_id, two_theta, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY area DESC, peak_id) AS nth FROM rs WHERE two_theta BETWEEN 5 AND 60) WHERE nth <= CASE WHEN pattern_id % 200 = 0 THEN 10 ELSE 12 END")
def gain_positions(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return G.gain_positions(_residual(spark, sf_dir, every), F.when(F.col("pattern_id") % 200 == 0, "hidden").otherwise("direct"))


@query(
    "a27_gain_context",
    with_searches(*_ALL) + f""", {_SET}, {_RESIDUAL}, c AS (SELECT pattern_id, sum(area) AS whole FROM obs_peak GROUP BY pattern_id), r AS (SELECT pattern_id, max(area) AS top, sum(area) AS rest FROM rs GROUP BY pattern_id),
m AS (SELECT *, quantile_cont(target, 0.5) OVER (PARTITION BY pattern_id) AS m FROM cv), f AS (SELECT pattern_id, greatest(any_value(m) + 2.7::DOUBLE * 1.4826::DOUBLE * quantile_cont(abs(target - m), 0.5), quantile_cont(target, 0.2)) AS floor FROM m GROUP BY pattern_id)
SELECT c.pattern_id, round(floor, 5) AS floor, round(CASE WHEN coalesce(top, 0) / whole < 0.025 AND coalesce(rest, 0) / whole < 0.10 THEN 0 ELSE least(pow(greatest(top / whole / 0.08, rest / whole / 0.30), 0.85), 1.0) END, 5) AS signal FROM c LEFT JOIN r USING (pattern_id) JOIN f USING (pattern_id)""",
)
def gain_context(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Noise floor of the target, and how far the residual lines stand out."""
    signal = G.signal_factor(searches(spark, sf_dir, every), _residual(spark, sf_dir, every))
    return signal.join(G.noise_floor(curves(spark, sf_dir, every)), "pattern_id").select("pattern_id", F.round("floor", 5).alias("floor"), F.round("signal", 5).alias("signal"))


def _strong_sql(most: int) -> str:
    return f"sg AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, entry_id ORDER BY intensity DESC, peak_index) - 1 AS rank FROM ln WHERE intensity >= 3 AND two_theta BETWEEN 5 AND 120), sr AS (SELECT * FROM sg WHERE rank < {most})"


@query(
    "a28_novelty",
    with_searches(*_ALL) + f""", {_SET}, {_strong_sql(32)}, n AS (SELECT *, pow(greatest(intensity / 100, 0.03::DOUBLE), 0.55) AS w, EXISTS (SELECT 1 FROM st WHERE st.pattern_id = sr.pattern_id AND round(abs(stick - two_theta), 9) <= 0.396) AS cov FROM sr),
g AS (SELECT pattern_id, entry_id, count(*) AS n, sum(w) FILTER (WHERE NOT cov) / sum(w) AS share, count(*) FILTER (WHERE NOT cov AND rank < 12) AS fresh, count(*) FILTER (WHERE cov AND rank < 8) AS top FROM n GROUP BY pattern_id, entry_id)
SELECT pattern_id, entry_id, round(CASE WHEN n < 3 OR fresh < 2 OR coalesce(share, 0) < 0.12 THEN 0 ELSE least(pow(share * CASE WHEN top >= 6 THEN 0.35 ELSE 1 END / 0.55, 1.35), 1) END, 5) AS novelty FROM g""",
)
def novelty(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return G.novelty(_lines(spark, sf_dir, every), _sticks(spark, sf_dir, every)).withColumn("novelty", F.round("novelty", 5))


@query(
    "a28_line_gate",
    with_searches(*_ALL) + f""", {_SET}, {_strong_sql(28)}, fo AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY area DESC, peak_id) AS nth FROM obs_peak),
m AS (SELECT *, pow(greatest(intensity / 100, 0.02::DOUBLE), 0.55) / sqrt(rank + 1) AS w, EXISTS (SELECT 1 FROM fo WHERE fo.pattern_id = sr.pattern_id AND nth <= 32 AND round(abs(fo.two_theta - sr.two_theta), 9) <= 0.432) AS hit FROM sr),
g AS (SELECT pattern_id, entry_id, count(*) AS n, coalesce(sum(w) FILTER (WHERE hit), 0) / sum(w) AS cov, count(*) FILTER (WHERE hit AND rank < 10) AS top FROM m GROUP BY pattern_id, entry_id),
mj AS (SELECT g.pattern_id, g.entry_id, sum(area) AS whole, coalesce(sum(area) FILTER (WHERE found), 0) AS part, count(*) FILTER (WHERE found) AS nf FROM (SELECT g.pattern_id, g.entry_id, fo.area, EXISTS (SELECT 1 FROM sr WHERE sr.pattern_id = g.pattern_id AND sr.entry_id = g.entry_id AND round(abs(fo.two_theta - sr.two_theta), 9) <= 0.432) AS found FROM g JOIN fo ON fo.pattern_id = g.pattern_id AND nth <= 14) g GROUP BY ALL)
SELECT g.pattern_id, g.entry_id, round(CASE WHEN n < 3 OR top < 2 OR cov < 0.24 OR nf < 2 OR part / whole < 0.16 THEN 0 ELSE least(0.45::DOUBLE * cov + 0.55::DOUBLE * (part / whole), 1) END, 5) AS gate FROM g JOIN mj USING (pattern_id, entry_id)""",
)
def line_gate(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return G.line_gate(_lines(spark, sf_dir, every), searches(spark, sf_dir, every)).withColumn("gate", F.round("gate", 5))


@query(
    "a25_hidden_presence",
    with_searches(*_ALL) + f""", {_SET}, {_RESIDUAL}, {_strong_sql(36)}, m AS (SELECT *, sqrt(intensity) / sqrt(rank + 1) AS w, EXISTS (SELECT 1 FROM obs_peak o WHERE o.pattern_id = sr.pattern_id AND round(abs(o.two_theta - sr.two_theta), 9) <= 0.42) AS in_all, EXISTS (SELECT 1 FROM rs o WHERE o.pattern_id = sr.pattern_id AND round(abs(o.two_theta - sr.two_theta), 9) <= 0.48) AS in_rest FROM sr),
g AS (SELECT pattern_id, entry_id, count(*) AS n, coalesce(sum(w) FILTER (WHERE in_all), 0) / sum(w) AS fc, count(*) FILTER (WHERE in_all) AS fn, coalesce(sum(w) FILTER (WHERE in_rest AND rank < 24), 0) / sum(w) FILTER (WHERE rank < 24) AS gc, count(*) FILTER (WHERE in_rest AND rank < 24) AS gn FROM m GROUP BY pattern_id, entry_id)
SELECT pattern_id, entry_id, round(CASE WHEN n < 3 OR least(fn, gn) < CASE WHEN n >= 12 THEN 5 WHEN n >= 8 THEN 4 ELSE 3 END OR fc < 0.18 OR gc < 0.22 THEN 0 ELSE least((0.25::DOUBLE + 0.75::DOUBLE * fc) * pow(gc / 0.48, 1.15), 1) END, 5) AS presence FROM g""",
)
def hidden_presence(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return G.hidden_presence(_lines(spark, sf_dir, every), searches(spark, sf_dir, every), _residual(spark, sf_dir, every)).withColumn("presence", F.round("presence", 5))


@query(
    "a24_coherence",
    with_searches(*_ALL) + f""", {_SET}, pr AS (SELECT ln.pattern_id, ln.entry_id, peak_index, ln.intensity, o.area, row_number() OVER (PARTITION BY ln.pattern_id, ln.entry_id, peak_index ORDER BY round(abs(o.two_theta - ln.two_theta), 9), o.two_theta, o.peak_id) AS k FROM ln JOIN obs_peak o ON o.pattern_id = ln.pattern_id AND ln.two_theta BETWEEN o.two_theta - 0.3::DOUBLE AND o.two_theta + 0.3::DOUBLE WHERE ln.intensity >= 3),
q AS (SELECT *, ln(area / intensity) AS ratio, count(*) OVER (PARTITION BY pattern_id, entry_id) AS n FROM pr WHERE k = 1), d AS (SELECT *, round(abs(ratio - quantile_cont(ratio, 0.5) OVER (PARTITION BY pattern_id, entry_id)), 9) AS off FROM q WHERE n >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, entry_id ORDER BY off, peak_index) AS j FROM d), z AS (SELECT pattern_id, entry_id, any_value(n) AS n, count(*) AS kept, sum(sqrt(intensity) * off) / sum(sqrt(intensity)) AS mean FROM r WHERE j <= greatest(3, n - least(2, n // 5)) GROUP BY pattern_id, entry_id)
SELECT pattern_id, entry_id, round(least(greatest(exp(-mean / 0.95::DOUBLE) * kept / n, 0.05), 1), 5) AS coherence FROM z""",
)
def coherence(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Of the candidates' lines and their nearest observed peaks within 0.3 degrees."""
    from peakloom.operators.ranges import nearest, range_join

    lines = _lines(spark, sf_dir, every).where("intensity >= 3").select(*G.OWN, "peak_index", F.col("two_theta").alias("line"), "intensity")
    pairs = range_join(lines, searches(spark, sf_dir, every).select("pattern_id", "peak_id", F.col("two_theta").alias("place"), "area"), "line", "place", 0.3, ["pattern_id"])
    near = nearest(pairs, [*G.OWN, "peak_index"], F.round(F.abs(F.col("place") - F.col("line")), 9), F.struct("place", "peak_id"), ["area", "intensity"])
    return G.coherence(near.withColumn("w", F.sqrt("intensity"))).withColumn("coherence", F.round("coherence", 5))


@query("u6_gain_pool", with_searches(*_ALL) + f", {SEARCHED} SELECT DISTINCT pattern_id, entry_id FROM t WHERE rank BETWEEN 3 AND 15")
def gain_pool(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Candidates of two searches and earlier ones, each once, without scores."""
    parts = (_ranked(spark, sf_dir, every, c) for c in ("rank BETWEEN 3 AND 10", "rank BETWEEN 8 AND 12", "rank BETWEEN 10 AND 15"))
    return G.pooled(*parts).where("gain IS NULL").select(*G.OWN)


def _context(spark: SparkSession, sf_dir: str, every: int) -> G.GainContext:
    return G.gain_context(searches(spark, sf_dir, every), _sticks(spark, sf_dir, every), weighted(spark, sf_dir, every))


@query(
    "a23_line_gains",
    (with_searches(*_ALL) + f""", {_SET}, {_WEIGHTED}, {_SUMMARY}, {_RESIDUAL}, {_strong_sql(42)},
sw AS (SELECT *, pow(greatest(intensity / 100, 0.025::DOUBLE), 0.55) / sqrt(rank + 1) AS w FROM sr),
rf AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY area DESC, peak_id) AS nth, greatest(0.432::DOUBLE, least(0.95::DOUBLE, 1.7::DOUBLE * fwhm)) AS reach FROM rs),
cd AS (SELECT sw.pattern_id, sw.entry_id, nth, peak_index, rank, intensity, w, area, round(abs(rf.two_theta - sw.two_theta), 9) AS delta, reach, row_number() OVER (PARTITION BY sw.pattern_id, sw.entry_id ORDER BY nth, round(abs(rf.two_theta - sw.two_theta), 9), peak_index) AS o
  FROM sw JOIN rf ON rf.pattern_id = sw.pattern_id AND sw.two_theta BETWEEN rf.two_theta - reach AND rf.two_theta + reach),
RECURSE,
mt AS (SELECT cd.*, 1 - delta / reach AS q FROM cd JOIN (SELECT DISTINCT pattern_id, entry_id, unnest(taken) AS o FROM fold f WHERE NOT EXISTS (SELECT 1 FROM fold g WHERE g.pattern_id = f.pattern_id AND g.entry_id = f.entry_id AND g.o > f.o)) t USING (pattern_id, entry_id, o)),
ar AS (SELECT pattern_id, sum(area) AS al, sum(area) FILTER (WHERE nth <= 14) AS ma FROM rf GROUP BY pattern_id),
us AS (SELECT pattern_id, entry_id, sum(area * (0.35::DOUBLE + 0.65::DOUBLE * q)) AS useful, coalesce(sum(area) FILTER (WHERE nth <= 14), 0) AS major, sum(w) AS m, coalesce(sum(w) FILTER (WHERE rank < 12), 0) AS m_top, count(*) FILTER (WHERE rank < 12) AS n_top FROM mt GROUP BY ALL),
lf AS (SELECT sw.*, EXISTS (SELECT 1 FROM st WHERE st.pattern_id = sw.pattern_id AND round(abs(stick - two_theta), 9) <= 0.432) AS rep, EXISTS (SELECT 1 FROM obs_peak o WHERE o.pattern_id = sw.pattern_id AND round(abs(o.two_theta - sw.two_theta), 9) <= 0.432) AS seen
  FROM sw WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.pattern_id = sw.pattern_id AND mt.entry_id = sw.entry_id AND mt.peak_index = sw.peak_index)),
lk AS (SELECT lf.*, CASE WHEN rep THEN 'stick' WHEN coalesce(cv.total >= greatest(sf, 0.35::DOUBLE * cv.target), false) THEN 'profile' WHEN seen THEN 'seen' ELSE 'absent' END AS kind FROM lf LEFT JOIN cv ON cv.pattern_id = lf.pattern_id AND cv.g = CAST(round((lf.two_theta - 5.0::DOUBLE) / 0.1::DOUBLE) AS INT) LEFT JOIN fl ON fl.pattern_id = lf.pattern_id),
ag AS (SELECT pattern_id, entry_id, coalesce(sum(w * CASE WHEN rank < 10 THEN 3.25::DOUBLE ELSE 1.35::DOUBLE END) FILTER (WHERE kind = 'absent'), 0) AS ab, count(*) FILTER (WHERE kind = 'absent' AND rank < 12) AS ab_top, coalesce(sum(w * CASE kind WHEN 'stick' THEN 0.80::DOUBLE ELSE 0.65::DOUBLE END) FILTER (WHERE kind IN ('stick', 'profile')), 0) AS rp, coalesce(sum(w * 0.5::DOUBLE) FILTER (WHERE kind = 'seen'), 0) AS onl FROM lk GROUP BY ALL),
cq AS (SELECT *, ln(area / intensity) AS ratio, count(*) OVER (PARTITION BY pattern_id, entry_id) AS n FROM mt WHERE area > 0 AND intensity > 0), ch AS (SELECT *, round(abs(ratio - quantile_cont(ratio, 0.5) OVER (PARTITION BY pattern_id, entry_id)), 9) AS off FROM cq WHERE n >= 3),
cr AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, entry_id ORDER BY off, peak_index) AS j FROM ch), co AS (SELECT pattern_id, entry_id, least(greatest(exp(-(sum(w * off) / sum(w)) / 0.95::DOUBLE) * count(*) / any_value(n), 0.05), 1) AS coh FROM cr WHERE j <= greatest(3, n - least(2, n // 5)) GROUP BY pattern_id, entry_id),
sz AS (SELECT pattern_id, entry_id, count(*) AS n, sum(w) FILTER (WHERE rank < 12) AS top_w, count(*) FILTER (WHERE rank < 12) AS checked FROM sw GROUP BY ALL),
fin AS (SELECT sz.*, 100 - fit AS remaining, useful / greatest(al, 1e-12) AS cov, major / greatest(ma, 1e-12) AS maj, m / (m + 3.4::DOUBLE * coalesce(ab, 0) + 1.6::DOUBLE * coalesce(rp, 0) + coalesce(onl, 0)) AS sup, m_top / greatest(top_w, 1e-12) AS anc, n_top, coalesce(ab, 0) AS ab, coalesce(ab_top, 0) AS ab_top, m, coalesce(coh, 0) AS coh
  FROM sz JOIN us USING (pattern_id, entry_id) LEFT JOIN ag USING (pattern_id, entry_id) LEFT JOIN co USING (pattern_id, entry_id) JOIN ar USING (pattern_id) JOIN fs USING (pattern_id))
SELECT pattern_id, entry_id, round(CASE WHEN n < 3 OR (n_top < 2 AND anc < 0.20) OR (ab_top >= greatest(3, ceil(0.34::DOUBLE * checked)) AND ab > 1.15 * m) OR maj < 0.18 OR cov < 0.035 OR sup < 0.22 OR anc < 0.16 OR coh < 0.10 THEN 0
  ELSE least(greatest(remaining * least(cov, 1) * least(maj / 0.38, 1) * least(sup / 0.48, 1) * least(anc / 0.42, 1) * (0.45::DOUBLE + 0.55::DOUBLE * coh), 0), remaining) END, 4) AS gain FROM fin""").replace(
        "RECURSE",
        # candidates' pairs in order: each takes its record and its line if both are free
        """fold AS (SELECT pattern_id, entry_id, o, [o] AS taken, [nth] AS ns, [peak_index] AS ps FROM cd WHERE o = 1
UNION ALL SELECT cd.pattern_id, cd.entry_id, cd.o, CASE WHEN list_contains(ns, nth) OR list_contains(ps, peak_index) THEN taken ELSE list_append(taken, cd.o) END, CASE WHEN list_contains(ns, nth) OR list_contains(ps, peak_index) THEN ns ELSE list_append(ns, nth) END,
  CASE WHEN list_contains(ns, nth) OR list_contains(ps, peak_index) THEN ps ELSE list_append(ps, peak_index) END FROM fold JOIN cd ON cd.pattern_id = fold.pattern_id AND cd.entry_id = fold.entry_id AND cd.o = fold.o + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def line_gains(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """What the residual lines give to the candidates' lines, as if all patterns were in the direct stage."""
    c = _context(spark, sf_dir, every)
    remaining = G.fit_summary(c.curve).select("pattern_id", (100 - F.col("fit")).alias("remaining"))
    return G.line_gains(_lines(spark, sf_dir, every), c.direct, c.records, c.sticks, c.curve, remaining).withColumn("gain", F.round("gain", 4))


@query("q8_gain_rank")
def gain_rank(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """The next phase of every pattern: the candidates by line gain, checked by profile gain, or by presence."""
    candidates = _ranked(spark, sf_dir, every, "rank BETWEEN 3 AND 20")
    return G.gain_rank(candidates, view(spark, sf_dir, "ref_peak"), _context(spark, sf_dir, every), _profile(spark, sf_dir, candidates))
