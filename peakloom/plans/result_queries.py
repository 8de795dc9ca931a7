"""Registered queries of results: catalogues, snapshots, hashes and revisions, series; and of readers over texts in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import library as L
from peakloom.plans.fixtures import view, with_views
from peakloom.sources import text as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- results: orders stand for patterns, their parts for phases --------------------------------------------------

_PHASES = "ph AS (SELECT DISTINCT l_orderkey AS pattern_id, 'P' || CAST(l_partkey AS VARCHAR) AS phase_id, CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 40) / 2.0::DOUBLE END AS fraction_percent, l_partkey FROM lineitem)"


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases of all results. Equal ones occur several times; snapshots and the catalogue take them once."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("pattern_id"), _phase_id().alias("phase_id"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 40 / 2).alias("fraction_percent"))


def _phase_id() -> Column:
    return F.concat(F.lit("P"), F.col("l_partkey").cast("string"))


@query("a35_phase_catalogue", with_views("ref_phase") + f", {_PHASES}, u AS (SELECT DISTINCT phase_id, CAST(l_partkey AS VARCHAR) AS e FROM ph) SELECT phase_id, name, formula, source, entry_id AS source_id FROM u LEFT JOIN ref_phase ON entry_id = e")
def phase_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a phase is described by its part alone, so its least pattern is found before it meets its description
    first = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.min("l_orderkey").alias("pattern_id"))
    parts = view(spark, sf_dir, "ref_phase").select(F.col("entry_id").cast("long").alias("l_partkey"), "name", "formula", "source", F.col("entry_id").alias("source_id"))
    return L.phase_catalogue(first.join(parts, "l_partkey", "left").withColumn("phase_id", _phase_id()))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pattern_id"), (F.col("o_custkey") % 1000 / 10).alias("fit_percent"))
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 40")  # noqa: E741
    unknown = l.select(F.col("l_orderkey").alias("pattern_id"), (F.col("l_suppkey") % 90 + 5.5).alias("two_theta"), F.col("l_quantity").cast("double").alias("height"))
    return L.result_snapshots(_phases(spark, sf_dir), fits, unknown)


def _spelled(e: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:.6f}}', {e}), '0+$', ''), '\\.$', '')"


_HASHES = f"""{_PHASES}, pp AS (SELECT pattern_id, string_agg(phase_id || '=' || coalesce({_spelled('fraction_percent')}, 'null'), ',' ORDER BY phase_id) AS t FROM ph GROUP BY pattern_id),
un AS (SELECT l_orderkey AS pattern_id, string_agg({_spelled('CAST(l_quantity AS DOUBLE)')} || '@' || {_spelled('CAST(l_suppkey % 90 + 5.5 AS DOUBLE)')}, ',' ORDER BY l_suppkey % 90, l_quantity) AS t FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey),
hs AS (SELECT o_orderkey AS pattern_id, sha256(CAST(o_orderkey AS VARCHAR) || '|' || coalesce(pp.t, '') || '|' || {_spelled('CAST(o_custkey % 1000 AS DOUBLE) / 10')} || '|' || coalesce(un.t, '')) AS result_sha256 FROM orders LEFT JOIN pp ON pp.pattern_id = o_orderkey LEFT JOIN un ON un.pattern_id = o_orderkey)"""


@query(
    "n5_result_snapshots",
    f"""WITH {_PHASES}, u AS (SELECT l_orderkey AS pattern_id, count(*) AS n, min(l_suppkey % 90 + 5.5)::DOUBLE AS first FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey), p AS (SELECT pattern_id, count(*) AS n, min(phase_id) AS first FROM ph GROUP BY pattern_id)
SELECT o_orderkey AS pattern_id, coalesce(p.n, 0) AS n_phases, p.first AS first_phase, round(CAST(o_custkey % 1000 AS DOUBLE) / 10, 4) AS fit_percent, coalesce(u.n, 0) AS n_unknown, u.first AS first_unknown FROM orders LEFT JOIN p ON p.pattern_id = o_orderkey LEFT JOIN u ON u.pattern_id = o_orderkey""",
)
def result_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested results of all patterns, by what they hold and what comes first."""
    s = _snapshots(spark, sf_dir)
    return s.select("pattern_id", F.size("phases").cast("long").alias("n_phases"), F.get("phases", F.lit(0))["phase_id"].alias("first_phase"), F.round("fit.fit_percent", 4).alias("fit_percent"), F.size("unknown_peaks").cast("long").alias("n_unknown"), F.get("unknown_peaks", F.lit(0))["two_theta"].cast("double").alias("first_unknown"))


@query(
    "q12_result_catalogue",
    f"WITH {_HASHES} SELECT pattern_id, result_sha256, CASE WHEN pattern_id % 3 = 0 THEN 'REV-1' ELSE 'REV-2' END AS revision_id FROM hs",
)
def result_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all results; two thirds differ from those of the revision before and get the new one."""
    now = L.result_hash(_snapshots(spark, sf_dir)).select("pattern_id", "result_sha256")
    before = now.select("pattern_id", F.when(F.col("pattern_id") % 3 == 0, F.col("result_sha256")).otherwise("other").alias("result_sha256"), F.lit("REV-1").alias("revision_id"))
    return L.revised(now, before, "REV-2")


@query("s19_result_json", "SELECT o_orderkey, '{\"pattern_id\":' || CAST(o_orderkey AS VARCHAR) || ',\"status\":\"' || o_orderstatus || '\"}' AS record FROM orders")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON texts, one a row, as the text writer takes them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("pattern_id"), F.col("o_orderstatus").alias("status"))).alias("record"))


@query(
    "q15_series_report",
    with_views("ref_phase") + """, m AS (SELECT entry_id AS pattern_id, source AS series_id, updated_rank AS sample, a FROM ref_phase) SELECT series_id, CAST(row_number() OVER w AS INT) AS place, pattern_id, a, round(a - lag(a) OVER w, 6) AS change FROM m WINDOW w AS (PARTITION BY series_id ORDER BY sample, pattern_id)""",
)
def series_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "ref_phase").withColumnRenamed("entry_id", "pattern_id")
    return L.series_report(p.select("pattern_id", F.col("source").alias("series_id"), F.col("updated_rank").alias("sample")), p.select("pattern_id", "a")).withColumn("change", F.round("change", 6))


# -- readers over texts --------------------------------------------------------------------------------------


@query("s2_s6_reference_files", "SELECT page_id, regexp_matches(lower(name), '\\.(xy|txt|dat|csv)$') AND NOT contains(lower(name), 'readme') AND NOT contains(lower(name), 'license') AS wanted FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/Quartz__R0' || CAST(page_id AS VARCHAR) || '.TXT' WHEN 1 THEN 'README.txt' WHEN 2 THEN 'b/x.pdf' WHEN 3 THEN 'License.dat' ELSE 'c.xy' END AS name FROM pages)")
def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("a/Quartz__R0"), F.col("page_id").cast("string"), F.lit(".TXT"))).when(k == 1, "README.txt").when(k == 2, "b/x.pdf").when(k == 3, "License.dat").otherwise("c.xy")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.is_reference_file(name).alias("wanted"))


@query("s5_reference_headers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name, replace(p_name, ' ', '_') <> '' AS has_mineral, 'R' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-1' AS reference_id FROM part")
def reference_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ids out of the headers and file names of measured references."""
    from peakloom.functions.chemistry import display_reference_id

    p, own = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 2 == 0
    file = F.concat(F.lit("/d/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__R"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("-1__x.txt"))
    text = F.concat(F.lit("##MINERAL?\n# other: x\n"), F.when(own, F.concat(F.lit("##NAME = "), "p_name")).otherwise(F.concat(F.lit("##TITLE: "), "p_brand")), F.lit("\n5.0, 10\n"))
    return p.select("p_partkey", S.header_value(text, ["NAME", "TITLE"]).alias("name"), (S.mineral_name(file) == F.col("p_name")).alias("has_mineral"), display_reference_id(F.replace(file, F.lit("_"), F.lit(" "))).alias("reference_id"))


@query("s8_card_lines", with_views("ref_peak") + ", n AS (SELECT entry_id, peak_index, 1.5406::DOUBLE / (2 * sin(radians(two_theta / 2))) AS d, CAST(least(intensity, 999) AS INT) AS i FROM ref_peak) SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY peak_index) AS INT) AS n, round(d, 5) AS d, least(CAST(i AS DOUBLE), 100.0::DOUBLE) AS intensity FROM n WHERE d < 10 AND i > 0")
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card payloads written from library peaks, and read again."""
    d = 1.5406 / (2 * F.sin(F.radians(F.col("two_theta") / 2)))
    rows = view(spark, sf_dir, "ref_peak").where(d < 10)
    one = F.concat(F.format_string("%.5f", d), F.lit(" "), F.format_string("%3d", F.least(F.col("intensity"), F.lit(999.0)).cast("int")))
    packed = rows.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("peak_index", one.alias("t")))).alias("p"))
    lines = packed.select("entry_id", F.posexplode(S.card_lines(F.array_join(F.transform("p", lambda x: x["t"]), "  "))).alias("n", "l"))
    return lines.select("entry_id", (F.col("n") + 1).alias("n"), F.round("l.d", 5).alias("d"), "l.intensity")
