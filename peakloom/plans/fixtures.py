"""Views over the driver's tables that stand for phases, library peaks, observed peaks, traces and logs.

The text of a view is common to Spark SQL and DuckDB, but for those of SPARK_ONLY, which have one of each. Queries that compare
patterns with the whole library are searches: they take the patterns whose id is divisible by SEARCH_EVERY, with all their
observed peaks, against all phases. a11_cell_scales and q7_fitted_peaks take every pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.search import ranked_library, search_by_peaks
from peakloom.operators.storage import bounded_broadcast, deals, stored, tasks_for

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "ref_phase": """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'USER' WHEN 1 THEN 'COD' WHEN 2 THEN 'MP' WHEN 3 THEN 'CCDC' WHEN 4 THEN 'AFLOW' ELSE 'OQMD' END AS source,
       CAST(p_partkey AS STRING) AS entry_id,
       split_part('Ca,Al,Si,O,Fe,Ti,Mg,Na,K,Ba,C,H', ',', CAST(p_partkey % 12 AS INT) + 1) || CAST(1 + p_size % 4 AS STRING)
         || split_part('O,Si,C,P,S,N', ',', CAST(p_size % 6 AS INT) + 1) || CAST(1 + p_partkey % 3 AS STRING)
         || CASE WHEN p_partkey % 5 = 0 THEN 'H' ELSE '' END AS formula,
       p_name AS name, p_type AS spacegroup,
       3.0E0 + CAST(p_size % 8 AS DOUBLE) / 4 AS a,
       3.0E0 + CAST(p_size % 8 AS DOUBLE) / 4 + CASE WHEN p_partkey % 4 = 3 THEN 0.5E0 ELSE 0.0E0 END AS b,
       3.0E0 + CAST(p_size % 8 AS DOUBLE) / 4 + CASE WHEN p_partkey % 4 >= 2 THEN 1.0E0 ELSE 0.0E0 END AS c,
       90.0E0 AS alpha, 90.0E0 AS beta, CASE WHEN p_partkey % 4 = 2 THEN 120.0E0 ELSE 90.0E0 END AS gamma,
       CAST(p_partkey % 97 AS INT) AS updated_rank
FROM part""",
    "ref_peak": """
SELECT CAST(l_partkey AS STRING) AS entry_id,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) - 1 AS INT) AS peak_index,
       5.0E0 + CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 11500 AS DOUBLE) / 100 AS two_theta,
       CAST(l_quantity AS DOUBLE) * 2 AS intensity,
       CAST(l_linenumber AS INT) AS h, CAST(l_orderkey % 4 AS INT) AS k, CAST(l_suppkey % 5 AS INT) AS l
FROM lineitem""",
    "obs_peak": """
SELECT o_custkey AS pattern_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_partkey) AS INT) AS peak_id,
       5.0E0 + CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 11500 + o_custkey % 7 - 3 AS DOUBLE) / 100 AS two_theta,
       CAST(l_quantity AS DOUBLE) * 10 AS height,
       CAST(l_quantity AS DOUBLE) * (2 + l_linenumber % 3) AS area,
       0.08E0 + CAST(l_linenumber % 5 AS DOUBLE) * 0.04E0 AS fwhm
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "trace_week": """
SELECT g.pattern_id, g.i, 10.0E0 + CAST(g.i AS DOUBLE) / 5 AS x, coalesce(s.y, 0.0E0) AS y FROM
 (SELECT p.pattern_id, w.i FROM (SELECT DISTINCT l_suppkey AS pattern_id FROM lineitem) p CROSS JOIN
   (SELECT DISTINCT CAST(floor((CAST(date_part('year', l_shipdate) AS INT) - 1995) * 53 + CAST(date_part('doy', l_shipdate) AS INT) / 7) AS INT) AS i FROM lineitem) w) g
 LEFT JOIN (SELECT l_suppkey AS pattern_id, CAST(floor((CAST(date_part('year', l_shipdate) AS INT) - 1995) * 53 + CAST(date_part('doy', l_shipdate) AS INT) / 7) AS INT) AS i, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2) s
 ON g.pattern_id = s.pattern_id AND g.i = s.i""",
    "ops": """
SELECT ts, event_type AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value * 10 AS elapsed_ms, CAST(user_id AS STRING) AS correlation FROM events""",
    "xy_text": """
SELECT l_suppkey AS file_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS INT) AS line_no,
       CASE l_partkey % 6 WHEN 0 THEN '# comment' WHEN 1 THEN CAST(l_partkey AS STRING) || '.5, ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.25'
            WHEN 2 THEN CAST(l_partkey AS STRING) || ',5;' || CAST(CAST(l_quantity AS INT) AS STRING)
            WHEN 3 THEN CAST(l_partkey AS STRING) || ',5' || chr(9) || CAST(CAST(l_quantity AS INT) AS STRING)
            WHEN 4 THEN '  ' || CAST(l_partkey AS STRING) || '  ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' note' ELSE '' END AS line
FROM lineitem""",
    "entry_raw": """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'COD' WHEN 1 THEN 'AFLOW' ELSE 'OQMD' END AS source,
       CASE p_partkey % 3 WHEN 0 THEN '{"file":"' || CAST(p_partkey AS STRING) || '","formula_sum":"Ca O","mineral":"' || p_name || '","sg":"P 1"}'
            WHEN 1 THEN '{"auid":"aflow:' || CAST(p_partkey AS STRING) || '","compound":"CaO","spacegroup_relax":"225"}'
            ELSE '{"entry_id":"' || CAST(p_partkey AS STRING) || '","composition":"CaO","delta_e":"-0.5"}' END AS record
FROM part""",
    "card_text": """
SELECT p_partkey AS n, p_name || ' oxide / ' || p_name || '  Ca' || CAST(1 + p_size % 4 AS STRING) || 'O3  ' || CAST(1 + p_size % 60 AS STRING) || '- ' || CAST(1 + p_partkey AS STRING) || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'I' END AS record
FROM part""",
}
SPARK_TRACE_VEC = """
SELECT vec_id, pos AS i, 10.0E0 + pos / 2 AS x, 1000.0E0 * (1.0E0 + CAST(e AS DOUBLE)) AS y
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e"""
DUCKDB_TRACE_VEC = """
SELECT vec_id, i - 1 AS i, 10.0 + CAST(i - 1 AS DOUBLE) / 2 AS x, 1000.0::DOUBLE * (1.0::DOUBLE + CAST(embedding[i] AS DOUBLE)) AS y
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""

#: Lines numbered by entry_id itself, so that what follows by phase needs no second shuffle; the rows of VIEWS["ref_peak"].
SPARK_REF_PEAK = re.sub(r"SELECT CAST\(l_partkey AS STRING\) AS entry_id", "SELECT entry_id", VIEWS["ref_peak"]).replace("PARTITION BY l_partkey", "PARTITION BY entry_id").replace("FROM lineitem", "FROM (SELECT *, CAST(l_partkey AS STRING) AS entry_id FROM lineitem)")

#: Patterns are dealt before they meet their weeks: their ids alone are so few bytes that all traces would be made in one task.
SPARK_TRACE_WEEK = VIEWS["trace_week"].replace("(SELECT DISTINCT l_suppkey AS pattern_id FROM lineitem)", "(SELECT /*+ REPARTITION({deals}, pattern_id) */ * FROM (SELECT DISTINCT l_suppkey AS pattern_id FROM lineitem))")

SPARK_ONLY = {"trace_week": SPARK_TRACE_WEEK, "trace_vec": SPARK_TRACE_VEC, "ref_peak": SPARK_REF_PEAK}
#: The query set of searches.
SEARCH_EVERY = 100
#: Library lines that a task sorts by phase.
LINES_A_TASK = 500_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the Parquet tables of sf_dir."""
    text = (SPARK_ONLY.get(name) or VIEWS[name]).replace("{deals}", str(deals(spark)))
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet` AS \2", text))


def library_lines(spark: SparkSession, sf_dir: str, task_rows: int = LINES_A_TASK) -> DataFrame:
    """The view ref_peak, dealt by phase into as many tasks as its lines need: what follows by phase sorts a share that
    doesn't grow with the library. A library that the shuffle partitions hold is left to adaptive execution."""
    tasks = tasks_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), task_rows)
    if tasks == int(spark.conf.get("spark.sql.shuffle.partitions")):
        return view(spark, sf_dir, "ref_peak")
    text = SPARK_REF_PEAK.replace("(SELECT *, CAST", f"(SELECT /*+ REPARTITION({tasks}, entry_id) */ *, CAST")
    return spark.sql(text.replace("FROM lineitem", f"FROM parquet.`{sf_dir}/lineitem.parquet` AS lineitem"))


def with_views(*names: str) -> str:
    """The WITH clause that defines the named views for DuckDB; further tables may follow after a comma."""
    text = dict(VIEWS, trace_vec=DUCKDB_TRACE_VEC)
    return "WITH " + ", ".join(f"{n} AS ({text[n]})" for n in names)


def searches(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Observed peaks of the patterns that are searched for: those whose id is divisible by `every`."""
    if every == 1:
        return view(spark, sf_dir, "obs_peak")
    # the orders of the query set are few: they go to the line items, which are not shuffled
    orders = bounded_broadcast(spark.read.parquet(f"{sf_dir}/orders.parquet").where(f"o_custkey % {every} = 0").select("o_orderkey", "o_custkey"), 2_000_000)
    text = VIEWS["obs_peak"].replace("FROM lineitem JOIN orders", f"FROM parquet.`{sf_dir}/lineitem.parquet` AS lineitem JOIN {{orders}} AS orders")
    return spark.sql(text, orders=orders)


def with_searches(*names: str) -> str:
    """with_views(), where obs_peak holds the patterns that are searched for."""
    return with_views(*names).replace(VIEWS["obs_peak"], f"SELECT * FROM ({VIEWS['obs_peak']}) WHERE pattern_id % {SEARCH_EVERY} = 0")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked library lines, the index of all searches: built once an application, a phase's lines in one file."""
    build = lambda: ranked_library(library_lines(spark, sf_dir))
    return stored(spark, ("library", sf_dir), build)


def ranking(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY, most: int = 20) -> DataFrame:
    """(pattern_id, entry_id, rank and the search's metrics): the phases that the search ranks; searched once an application."""
    build = lambda: search_by_peaks(searches(spark, sf_dir, every), view(spark, sf_dir, "ref_peak"), view(spark, sf_dir, "ref_phase"), library=library(spark, sf_dir))
    return stored(spark, ("ranking", sf_dir, str(every)), build).where(F.col("rank") <= most)
