"""Registered queries of the fits; but for the policy columns they fold or solve, so tests hold them against known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import fitting as Q
from peakloom.operators import signal as G
from peakloom.operators.matching import strong_lines
from peakloom.operators.ranges import range_join
from peakloom.plans.fixtures import SEARCH_EVERY, searches, view, with_views
from peakloom.plans.matching_queries import selected

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("j6_one_to_one")
def one_to_one(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """The 42 strongest lines of selected phases against the observed peaks, each peak once."""
    key = F.concat_ws("/", "pattern_id", "entry_id")
    chosen = selected(spark, sf_dir, every)
    lines = strong_lines(view(spark, sf_dir, "ref_peak"), 3, 42, None).join(chosen, "entry_id").select(key.alias("key"), F.col("line_rank").alias("rank"), "two_theta")
    records = searches(spark, sf_dir, every).join(chosen, "pattern_id").select(key.alias("key"), F.col("peak_id").alias("record"), "two_theta", "fwhm")
    return Q.greedy_matches(lines, records)


@query("a11_cell_scales")
def cell_scales(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Cell scales of the phases that the search ranks, of every pattern."""
    return Q.cell_scales(view(spark, sf_dir, "ref_peak"), searches(spark, sf_dir, every), candidates=selected(spark, sf_dir, every))


@query("a15_joint_scales")
def joint_scales(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Scales of the selected phases' profiles against the profile of each pattern's observed peaks."""
    chosen = selected(spark, sf_dir, every)
    lines = view(spark, sf_dir, "ref_peak").join(chosen.select("entry_id").distinct(), "entry_id", "left_semi").select("entry_id", "two_theta", "intensity")
    profiles = G.rasterise(lines, 5.0, 0.1, 1151, 0.4).join(chosen, "entry_id").select("pattern_id", F.col("entry_id").alias("phase"), "g", F.col("y").alias("p"))
    seen = searches(spark, sf_dir, every).select(F.col("pattern_id").cast("string").alias("entry_id"), "two_theta", F.col("height").alias("intensity"))
    target = G.rasterise(seen, 5.0, 0.1, 1151, 0.4).select(F.col("entry_id").cast("long").alias("pattern_id"), "g", "y", F.lit(1.0).alias("w"))
    return Q.joint_scales(profiles, target).withColumn("scale", F.round("scale", 6))


@query("a4_scale_votes")
def scale_votes(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Heaviest clusters of the ratios of observed to library scattering vectors, by pattern and selected phase."""
    q = lambda c: F.sin(F.radians(F.col(c) / 2))
    lines = strong_lines(view(spark, sf_dir, "ref_peak"), 1, 24).join(selected(spark, sf_dir, every), "entry_id").select("pattern_id", "entry_id", "two_theta", "intensity")
    seen = searches(spark, sf_dir, every).select("pattern_id", F.col("two_theta").alias("observed"), "height")
    pairs = range_join(lines, seen, "two_theta", "observed", 0.55, ["pattern_id"])
    votes = pairs.select(F.concat_ws("/", "pattern_id", "entry_id").alias("key"), (q("observed") / q("two_theta")).alias("scale"), (F.col("intensity") * F.col("height") / 1000).alias("weight"))
    return Q.scale_votes(votes.where("scale BETWEEN 0.965 AND 1.035")).select("key", F.round("centre", 6).alias("centre"), F.round("seed_weight", 6).alias("seed_weight"))


@query(
    "a26_gain_policy",
    with_views("obs_peak") + """, r AS (SELECT pattern_id, count(*) FILTER (WHERE height >= 400) AS direct, count(*) FILTER (WHERE height BETWEEN 200 AND 399) AS overlap, max(area) AS line, CASE WHEN pattern_id % 3 > 0 THEN min(area) END AS profile FROM obs_peak GROUP BY pattern_id)
SELECT pattern_id, CASE WHEN direct >= 2 THEN 'direct' WHEN overlap >= 2 THEN 'overlap' ELSE 'hidden' END AS stage, round(CASE WHEN line <= 0 THEN 0 WHEN profile IS NULL THEN line ELSE line * least(greatest(profile / line, 0.35::DOUBLE), 1) END, 6) AS gain,
 round(least(greatest(line * 0.5 * 0.45, 0), line), 6) AS hidden, (line >= 98) OR (direct + overlap >= 5 AND line < 1.5) AS done FROM r""",
)
def gain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("height")
    r = view(spark, sf_dir, "obs_peak").groupBy("pattern_id").agg(F.count_if(h >= 400).alias("direct"), F.count_if(h.between(200, 399)).alias("overlap"), F.max("area").alias("line"), F.min("area").alias("low"))
    profile = F.when(F.col("pattern_id") % 3 > 0, F.col("low"))
    line = F.col("line")
    return r.select(
        "pattern_id", Q.gain_stage(F.col("direct"), F.col("overlap")).alias("stage"), F.round(Q.combined_gain(line, profile), 6).alias("gain"), F.round(Q.hidden_gain(line, F.lit(0.5)), 6).alias("hidden"),
        Q.exhausted(line, F.col("direct") + F.col("overlap"), line, F.lit(1.0)).alias("done"),
    )
