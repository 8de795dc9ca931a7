"""Registered queries of the readers, the library's maintenance and the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.chemistry import cell_volume
from peakloom.operators import library as L
from peakloom.operators.search import ranked_library
from peakloom.plans.fixtures import library_lines, view, with_views
from peakloom.sources import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "s1_xy_scan",
    with_views("xy_text") + r""", v AS (SELECT file_id, line_no, CASE WHEN regexp_matches(line, '^[0-9]+\.5, ') THEN [CAST(split_part(line, ', ', 1) AS DOUBLE), CAST(split_part(line, ', ', 2) AS DOUBLE)]
 WHEN line LIKE '%;%' THEN [CAST(replace(split_part(line, ';', 1), ',', '.') AS DOUBLE), CAST(split_part(line, ';', 2) AS DOUBLE)] WHEN line LIKE '%' || chr(9) || '%' THEN [CAST(replace(split_part(line, chr(9), 1), ',', '.') AS DOUBLE), CAST(split_part(line, chr(9), 2) AS DOUBLE)]
 WHEN line LIKE '  %note' THEN [CAST(regexp_extract(line, '([0-9]+)  ([0-9]+)', 1) AS DOUBLE), CAST(regexp_extract(line, '([0-9]+)  ([0-9]+)', 2) AS DOUBLE)] END AS v FROM xy_text)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS INT) AS i, v[1] AS x, v[2] AS y FROM v WHERE v IS NOT NULL""",
)
def xy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.xy_points(view(spark, sf_dir, "xy_text"))


@query(
    "s7_card_summary",
    with_views("card_text") + """ SELECT n, CASE WHEN n % 2 = 0 THEN '01' ELSE '00' END || '-' || lpad(regexp_extract(record, '  ([0-9]+)- [0-9]+ [CI]$', 1), 3, '0') || '-' || lpad(CAST(n + 1 AS VARCHAR), CAST(greatest(4, length(CAST(n + 1 AS VARCHAR))) AS INT), '0') AS entry_id,
 p_name AS name, 'Ca' || CAST(1 + p_size % 4 AS VARCHAR) || 'O3' AS formula, p_name || ' oxide' AS chemical_name, CASE WHEN n % 2 = 0 THEN 'C' ELSE 'I' END AS quality FROM card_text JOIN part ON n = p_partkey""",
)
def card_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "card_text").select("n", T.card_summary(F.col("record")).alias("c")).select("n", "c.*")


@query(
    "s10_entry_records",
    with_views("entry_raw") + """ SELECT source, coalesce(record ->> '$.file', record ->> '$.auid', 'oqmd-' || (record ->> '$.entry_id')) AS entry_id, coalesce(record ->> '$.formula_sum', record ->> '$.compound', record ->> '$.composition') AS formula,
 coalesce(record ->> '$.mineral', record ->> '$.compound', record ->> '$.composition') AS name, coalesce(record ->> '$.sg', record ->> '$.spacegroup_relax', '') AS spacegroup FROM entry_raw""",
)
def entry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entries(view(spark, sf_dir, "entry_raw"))


_NEW = "nw AS (SELECT source, entry_id, formula || 'X' AS formula, CASE WHEN CAST(entry_id AS INT) % 4 = 0 THEN a + 1 END AS a, updated_rank + 100 AS updated_rank FROM ref_phase WHERE CAST(entry_id AS INT) % 2 = 0 UNION ALL SELECT source, 'n' || entry_id, formula, a, updated_rank FROM ref_phase WHERE CAST(entry_id AS INT) % 5 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = view(spark, sf_dir, "ref_phase")
    n = F.col("entry_id").cast("int")
    n = F.col("entry_id").try_cast("int")
    old = p.where(n % 3 == 0).select("source", "entry_id", "formula", "a", "updated_rank")
    changed = p.where(n % 2 == 0).select("source", "entry_id", F.concat("formula", F.lit("X")).alias("formula"), F.when(n % 4 == 0, F.col("a") + 1).alias("a"), (F.col("updated_rank") + 100).alias("updated_rank"))
    added = p.where(n % 5 == 0).select("source", F.concat(F.lit("n"), "entry_id").alias("entry_id"), "formula", "a", "updated_rank")
    return old, changed.unionByName(added)


_OLD = "od AS (SELECT source, entry_id, formula, a, updated_rank FROM ref_phase WHERE CAST(entry_id AS INT) % 3 = 0)"


@query(
    "s13_upsert",
    with_views("ref_phase") + f", {_OLD}, {_NEW} SELECT coalesce(n.source, o.source) AS source, coalesce(n.entry_id, o.entry_id) AS entry_id, coalesce(n.formula, o.formula) AS formula, coalesce(n.a, o.a) AS a, coalesce(n.updated_rank, o.updated_rank) AS updated_rank FROM od o FULL JOIN nw n ON o.source = n.source AND o.entry_id = n.entry_id",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.upsert(*_old_new(spark, sf_dir), keep=["a"], order="updated_rank")


@query("s14_insert_absent", with_views("ref_phase") + f", {_OLD}, {_NEW} SELECT * FROM od UNION ALL SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM od WHERE od.source = nw.source AND od.entry_id = nw.entry_id)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.insert_absent(*_old_new(spark, sf_dir))


@query("s15_replace_index", with_views("ref_phase") + f", {_OLD}, {_NEW} SELECT * FROM nw UNION ALL SELECT * FROM od WHERE NOT EXISTS (SELECT 1 FROM nw WHERE od.source = nw.source AND od.entry_id = nw.entry_id)")
def replace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.replace_rows(*_old_new(spark, sf_dir))


@query("s16_clear_source", with_views("ref_phase") + " SELECT source, count(*) AS n FROM ref_phase WHERE source NOT IN ('MP', 'OQMD') GROUP BY source")
def clear_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ref_phase").where(~F.col("source").isin("MP", "OQMD")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "s17_n2_peak_index_rebuild",
    with_views("ref_peak") + """, r AS (SELECT *, greatest(intensity, 0) / max(intensity) OVER (PARTITION BY entry_id) AS ni, row_number() OVER (PARTITION BY entry_id ORDER BY (CASE WHEN two_theta BETWEEN 5 AND 60 AND intensity > 0 THEN 0 ELSE 1 END), intensity DESC, peak_index DESC) AS rn FROM ref_peak)
SELECT entry_id, peak_index, round(two_theta, 5) AS two_theta, intensity, h, k, l, round(ni, 6) AS norm_intensity, CAST(CASE WHEN rn <= 10 AND two_theta BETWEEN 5 AND 60 AND intensity > 0 THEN rn END AS INT) AS top_rank FROM r""",
)
def peak_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks packed as JSON, parsed again and ranked."""
    rows = ranked_library(L.peak_rows(L.peaks_json(library_lines(spark, sf_dir))))
    return rows.select("entry_id", "peak_index", F.round("two_theta", 5).alias("two_theta"), "intensity", "h", "k", "l", F.round("norm_intensity", 6).alias("norm_intensity"), "top_rank")


@query("s18_status_counts", with_views("ref_phase", "ref_peak") + " SELECT (SELECT count(*) FROM ref_phase) AS phases, (SELECT count(DISTINCT entry_id) FROM ref_peak) AS indexed, (SELECT count(*) FROM ref_peak WHERE intensity >= 50) AS strong_peaks")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = view(spark, sf_dir, "ref_peak").agg(F.count_distinct("entry_id").alias("indexed"), F.count_if(F.col("intensity") >= 50).alias("strong_peaks"))
    return view(spark, sf_dir, "ref_phase").agg(F.count("*").alias("phases")).crossJoin(F.broadcast(peaks))  # one row each


@query(
    "j12_expand_atoms",
    with_views("ref_phase") + """, atm AS (SELECT entry_id, 'Ca' AS element, (p_size % 7) / 8.0::DOUBLE AS x, 0.25::DOUBLE AS y, 0.1::DOUBLE AS z FROM ref_phase JOIN part ON entry_id = CAST(p_partkey AS VARCHAR)),
im AS (SELECT entry_id, element, x, y, z FROM atm UNION ALL SELECT entry_id, element, -x, -y, z + 0.5 FROM atm UNION ALL SELECT entry_id, element, y, x, -z FROM atm UNION ALL SELECT entry_id, element, -y + 0.5, x + 0.5, z FROM atm),
w AS (SELECT entry_id, element, round(x - floor(x), 5) AS x, round(y - floor(y), 5) AS y, round(z - floor(z), 5) AS z FROM im) SELECT DISTINCT * FROM w""",
)
def expand_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    atoms = part.select(F.col("p_partkey").cast("string").alias("entry_id"), F.lit("Ca").alias("element"), (F.col("p_size") % 7 / 8.0).alias("x"), F.lit(0.25).alias("y"), F.lit(0.1).alias("z"))
    ops = atoms.select("entry_id", F.explode(F.array(*(F.lit(o) for o in ("x,y,z", "-x, -y, z+1/2", "y,x,-z", "1/2-y,x+1/2,z")))).alias("op"))
    return L.expand_atoms(atoms, ops)


@query(
    "a33_intensity_ratio",
    with_views("ref_phase", "ref_peak") + """, v AS (SELECT p.entry_id, max(greatest(intensity, 0)) * pow(1.5406 / (any_value(a) * any_value(b) * any_value(c) * sqrt(1 - pow(cos(radians(any_value(gamma))), 2))), 2) AS s FROM ref_phase p JOIN ref_peak r ON p.entry_id = r.entry_id GROUP BY p.entry_id)
SELECT entry_id, round(least(s / (SELECT s FROM v WHERE entry_id = '1'), 99.9), 4) AS ratio FROM v""",
)
def intensity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest peak by (wavelength / volume)^2 over that of a standard phase, at most 99.9."""
    strongest = view(spark, sf_dir, "ref_peak").groupBy("entry_id").agg(F.max(F.greatest("intensity", F.lit(0.0))).alias("top"))
    s = view(spark, sf_dir, "ref_phase").join(strongest, "entry_id").select("entry_id", (F.col("top") * F.pow(1.5406 / cell_volume(), F.lit(2))).alias("s"))
    standard = s.where("entry_id = '1'").select(F.col("s").alias("s0"))  # one row
    return s.crossJoin(F.broadcast(standard)).select("entry_id", F.round(F.least(F.col("s") / F.col("s0"), F.lit(99.9)), 4).alias("ratio"))


@query(
    "s3_series_groups",
    """WITH f AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^/?#]+)/', 1) AS folder FROM pages) SELECT lower(folder) AS series, count(*) AS n_files, min(page_id) AS first_page FROM f GROUP BY lower(folder)""",
)
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (here addresses) grouped by their first folder; those in the root form one group."""
    f = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", "://[^/]+/([^/?#]+)/", 1)).alias("series"))
    return f.groupBy("series").agg(F.count("*").alias("n_files"), F.min("page_id").alias("first_page"))


@query("s4_unique_names", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || ' (' || CAST(n AS VARCHAR) || ')' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_size, lower(p_brand) ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unique_names(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("a38_series_memberships", "SELECT l_partkey AS object_id, min(l_orderkey) AS series_no FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("series_no"), F.col("l_partkey").alias("object_id"))
    existing = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 10").select(F.col("p_partkey").alias("object_id"))
    return L.memberships(claims, existing).select("object_id", "series_no")


@query(
    "j13_link_cascade",
    with_views("ref_phase") + """, ph AS (SELECT CAST(entry_id AS INT) AS phase_id, CASE WHEN CAST(entry_id AS INT) % 3 = 0 THEN entry_id ELSE '' END AS entry_id, CASE WHEN CAST(entry_id AS INT) % 3 = 1 THEN '/p/' || entry_id ELSE '' END AS path, name, formula FROM ref_phase),
ca AS (SELECT CAST(entry_id AS INT) + 1000 AS candidate_id, entry_id, '/p/' || entry_id AS path, name, formula FROM ref_phase WHERE CAST(entry_id AS INT) % 2 = 0)
SELECT phase_id, coalesce((SELECT min(candidate_id) FROM ca WHERE ca.entry_id = ph.entry_id AND ph.entry_id <> ''), (SELECT min(candidate_id) FROM ca WHERE ca.path = ph.path AND ph.path <> ''), (SELECT min(candidate_id) FROM ca WHERE ca.name = ph.name AND ca.formula = ph.formula)) AS candidate_id FROM ph""",
)
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = view(spark, sf_dir, "ref_phase"), F.col("entry_id").cast("int")
    path = F.concat(F.lit("/p/"), "entry_id")
    phases = p.select(n.alias("phase_id"), F.when(n % 3 == 0, F.col("entry_id")).otherwise("").alias("entry_id"), F.when(n % 3 == 1, path).otherwise("").alias("path"), "name", "formula")
    candidates = p.where(n % 2 == 0).select((n + 1000).alias("candidate_id"), "entry_id", path.alias("path"), "name", "formula")
    return L.link_cascade(phases, candidates)


@query(
    "a37_content_hash",
    "SELECT o_orderkey, sha256('{\"p0\":' || CAST(o_orderkey AS VARCHAR) || ',\"p1\":' || CAST(o_custkey AS VARCHAR) || ',\"p2\":\"' || o_orderstatus || '\"}') AS result_sha256 FROM orders",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", L.content_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("result_sha256"))


@query("p13_slow_or_failed", with_views("ops") + " SELECT operation, count(*) AS n, round(avg(elapsed_ms), 4) AS mean_ms FROM ops WHERE elapsed_ms >= 300 OR status = 'failed' GROUP BY operation")
def slow_or_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "ops").where("elapsed_ms >= 300 OR status = 'failed'")
    return o.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.avg("elapsed_ms"), 4).alias("mean_ms"))
