"""Registered queries of candidate rows: shapes, names, filters, unions, links, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import chemistry as C
from peakloom.operators import candidates as K
from peakloom.operators import search as S
from peakloom.plans.fixtures import SEARCH_EVERY, view, with_searches, with_views
from peakloom.plans.search_queries import ELEMENTS, SEARCHED
from peakloom.plans.search_queries import search_by_peaks as ranked_by_peaks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ref_phase")


P = with_views("ref_phase")
N = "CAST(entry_id AS INT)"


@query(
    "f23_normalise_rows",
    P + f""", r AS (SELECT entry_id AS id, {N} % 7 + 4 AS n, ['s' || entry_id, 'e' || entry_id, formula, name, spacegroup, 'x5', 'x6', 'x7', 'x8', 'x9'] AS f FROM ref_phase)
SELECT id, CASE WHEN n = 10 THEN f[2] WHEN n = 5 THEN '' ELSE f[1] END AS source, CASE WHEN n = 10 THEN f[3] WHEN n = 5 THEN '' ELSE f[2] END AS entry_id, CASE WHEN n = 10 THEN f[4] WHEN n = 5 THEN '' ELSE f[3] END AS formula,
  CASE WHEN n IN (10, 5) THEN f[5] ELSE f[4] END AS name, CASE WHEN n IN (7, 8, 9) THEN f[5] ELSE '' END AS spacegroup,
  CASE WHEN n = 10 THEN f[9] WHEN n IN (7, 8, 9) THEN f[6] WHEN n = 6 THEN f[5] ELSE '' END AS note, CASE WHEN n IN (8, 9) THEN f[7] ELSE '' END AS gain,
  CASE WHEN n = 10 THEN f[10] WHEN n IN (8, 9) THEN f[8] WHEN n = 7 THEN f[7] WHEN n = 6 THEN f[6] ELSE '' END AS text FROM r""",
)
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.concat(F.lit("s"), "entry_id"), F.concat(F.lit("e"), "entry_id"), "formula", "name", "spacegroup", *(F.lit(f"x{i}") for i in range(5, 10)))
    row = F.slice(fields, F.lit(1), F.col("entry_id").cast("int") % 7 + 4)
    return _phases(spark, sf_dir).select(F.col("entry_id").alias("id"), K.normalise_row(row).alias("r")).select("id", "r.*")


@query(
    "f24_best_names",
    P + f""", g AS (SELECT *, CASE WHEN {N} % 3 = 0 THEN ' ' || name ELSE ' ' END AS given, CASE WHEN {N} % 3 = 1 THEN formula ELSE spacegroup END AS own, CASE WHEN {N} % 4 = 0 THEN '' ELSE formula END AS known FROM ref_phase)
SELECT entry_id, CASE WHEN trim(known) <> '' THEN trim(known) ELSE 'own ' || formula END AS best_formula, CASE WHEN {N} % 3 = 0 THEN trim(given) WHEN {N} % 3 = 1 THEN formula ELSE spacegroup END AS best_name FROM g""",
)
def best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("entry_id").cast("int")
    given = F.when(n % 3 == 0, F.concat(F.lit(" "), "name")).otherwise(" ")
    own = F.when(n % 3 == 1, F.col("formula")).otherwise(F.col("spacegroup"))
    known = F.when(n % 4 == 0, "").otherwise(F.col("formula"))
    return _phases(spark, sf_dir).select("entry_id", K.best_formula(F.concat(F.lit("own "), "formula"), known).alias("best_formula"), K.best_name(own, given, F.col("formula"), F.col("entry_id")).alias("best_name"))


@query("f21_ratio_text", P + f", r AS (SELECT entry_id, ({N} * 7919 % 99900) / 1000 AS iic, {N} % 5 AS version FROM ref_phase) SELECT entry_id, CASE WHEN version = 4 AND iic > 0 THEN format('{{:.3g}}', iic) ELSE '' END AS shown FROM r")
def ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("entry_id").cast("long")
    return _phases(spark, sf_dir).select("entry_id", C.ratio_text(n * 7919 % 99900 / 1000, n % 5, 4).alias("shown"))


@query(
    "f26_site_text",
    P + f""" SELECT entry_id, regexp_extract(formula, '[A-Z][a-z]?') AS element, round(({N} % 8) / 8.0::DOUBLE, 6) AS x, 0.25::DOUBLE AS y, CASE WHEN {N} % 3 > 0 THEN round(({N} % 3) / 4.0::DOUBLE, 6) END AS z FROM ref_phase""",
)
def site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("entry_id").cast("int")
    text = F.concat(F.regexp_extract("formula", "[A-Z][a-z]?", 0), F.lit(" @ "), (n % 8 / 8).cast("string"), F.lit("  0.25 "), F.when(n % 3 > 0, (n % 3 / 4).cast("string")).otherwise("bad"))
    return _phases(spark, sf_dir).select("entry_id", C.site_tokens(text).alias("s")).select("entry_id", "s.*")


@query("p6_padded_elements", P + f", e AS (SELECT entry_id, array_to_string({ELEMENTS}, ' ') AS els FROM ref_phase) SELECT entry_id, contains(' ' || els || ' ', ' Si ') AS has_si, contains(' ' || els || ' ', ' C ') AS has_c FROM e")
def padded_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.array_join(C.formula_elements(F.col("formula")), " ")
    return _phases(spark, sf_dir).select("entry_id", K.holds_element(e, "Si").alias("has_si"), K.holds_element(e, "C").alias("has_c"))


@query("p7_allowed_rows", P + f", e AS (SELECT *, {ELEMENTS} AS els FROM ref_phase) SELECT source, entry_id, formula FROM e WHERE formula = '' OR (NOT list_has_any(els, ['Ti', 'S']) AND NOT (list_contains(els, 'C') AND list_contains(els, 'H')))")
def allowed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inorganic = S.material_allowed(C.formula_elements(F.col("formula")), organic=False)
    return K.allowed_rows(_phases(spark, sf_dir), ["Ti", "S"], inorganic).select("source", "entry_id", "formula")


@query("p11_complete_searches", P + " SELECT source, formula, count(*) AS n FROM ref_phase GROUP BY source, formula HAVING count(*) < 4")
def complete_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.complete_searches(_phases(spark, sf_dir), ["source", "formula"], 4)


@query("u1_source_union", P + " SELECT source, entry_id, CASE WHEN source IN ('USER', 'CCDC', 'COD') THEN 1 ELSE 2 END AS priority FROM ref_phase UNION ALL SELECT 'CARD', entry_id, 0 FROM ref_phase WHERE source = 'MP'")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phases(spark, sf_dir).select("source", "entry_id")
    return K.by_priority(p.where("source = 'MP'").withColumn("source", F.lit("CARD")), p)


@query("u5_broad_sources", P + " SELECT source, count(*) FILTER (WHERE source IN ('USER', 'CCDC', 'COD')) AS n_broad, count(*) AS n_narrow FROM ref_phase GROUP BY source")
def broad_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return _phases(spark, sf_dir).groupBy("source").agg(F.count_if(K.searched_sources(s, [])).alias("n_broad"), F.count_if(K.searched_sources(s, ["Ca"])).alias("n_narrow"))


@query("j2_phase_peaks", with_views("ref_phase", "ref_peak") + " SELECT p.source, p.entry_id, formula, peak_index, two_theta, intensity FROM ref_phase p JOIN ref_peak r ON p.entry_id = r.entry_id")
def phase_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir).join(view(spark, sf_dir, "ref_peak"), "entry_id").select("source", "entry_id", "formula", "peak_index", "two_theta", "intensity")


@query("j3_element_index", P + f", x AS (SELECT entry_id, unnest({ELEMENTS}) AS element FROM ref_phase) SELECT source, entry_id FROM ref_phase p WHERE EXISTS (SELECT 1 FROM x WHERE x.entry_id = p.entry_id AND element = 'O') AND NOT EXISTS (SELECT 1 FROM x WHERE x.entry_id = p.entry_id AND element IN ('Fe', 'Mg'))")
def element_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases by the inverted index of their elements: a semi join for required, an anti join for excluded ones."""
    p = _phases(spark, sf_dir)
    index = p.select("entry_id", F.explode(C.formula_elements(F.col("formula"))).alias("element"))
    return p.join(index.where("element = 'O'"), "entry_id", "left_semi").join(index.where(F.col("element").isin("Fe", "Mg")), "entry_id", "left_anti").select("source", "entry_id")


@query("s11_entries_with_peaks", with_views("ref_phase", "ref_peak") + " SELECT source, p.entry_id, updated_rank FROM ref_phase p WHERE source IN ('COD', 'USER') AND EXISTS (SELECT 1 FROM ref_peak r WHERE r.entry_id = p.entry_id) ORDER BY updated_rank DESC, p.entry_id LIMIT 200")
def entries_with_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest entries of two sources that have peaks."""
    found = _phases(spark, sf_dir).where(F.col("source").isin("COD", "USER")).join(view(spark, sf_dir, "ref_peak").select("entry_id"), "entry_id", "left_semi")
    return found.orderBy(F.desc("updated_rank"), "entry_id").limit(200).select("source", "entry_id", "updated_rank")


@query("s12_point_lookup", P + f", k AS (SELECT CASE {N} % 3 WHEN 0 THEN source || ':' || entry_id WHEN 1 THEN entry_id ELSE 'MP:' || entry_id END AS cache_id FROM ref_phase) SELECT source, entry_id, formula FROM ref_phase WHERE source || ':' || entry_id IN (SELECT CASE WHEN contains(cache_id, ':') THEN cache_id ELSE 'COD:' || cache_id END FROM k)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = _phases(spark, sf_dir), F.col("entry_id").cast("int") % 3
    keys = p.select(F.when(n == 0, F.concat_ws(":", "source", "entry_id")).when(n == 1, F.col("entry_id")).otherwise(F.concat(F.lit("MP:"), "entry_id")).alias("cache_id"))
    return K.lookup(p, keys).select("source", "entry_id", "formula")


@query(
    "j14_link_phases",
    "SELECT DISTINCT l_suppkey AS pattern_id, l_partkey AS phase_id FROM lineitem WHERE l_linenumber <= 2 UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 45",
)
def link_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of patterns to phases, and further ones, of which some exist."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    pairs = lambda rows: rows.select(F.col("l_suppkey").alias("pattern_id"), F.col("l_partkey").alias("phase_id"))
    return K.add_links(pairs(l.where("l_linenumber <= 2")).distinct(), pairs(l.where("l_quantity > 45")))


@query(
    "j15_structure_override",
    P + f""" SELECT source, entry_id, CASE WHEN {N} % 4 = 0 THEN 'own ' || entry_id WHEN {N} % 4 = 1 THEN 'named ' || entry_id END AS structure FROM ref_phase""",
)
def structure_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = _phases(spark, sf_dir), F.col("entry_id").cast("int") % 4
    own = p.where(n == 0).select(F.col("entry_id").alias("key"), F.concat(F.lit("own "), "entry_id").alias("structure"))
    named = p.where(n <= 1).select(F.concat_ws(":", "source", "entry_id").alias("key"), F.concat(F.lit("named "), "entry_id").alias("structure"))
    return K.with_overrides(p.select("source", "entry_id"), own.unionByName(named)).select("source", "entry_id", "structure")


@query(
    "k3_final_ranking",
    """WITH r AS (SELECT o_custkey % 50 AS pattern_id, o_orderkey, CAST(o_custkey % 11 AS DOUBLE) AS gain, CAST(o_orderkey % 101 AS DOUBLE) AS match, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders)
SELECT pattern_id, o_orderkey, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY CASE WHEN n > 120 THEN 1 ELSE 0 END, CASE WHEN n <= 120 THEN gain END DESC NULLS LAST, CASE WHEN n <= 120 THEN match END DESC NULLS LAST, o_orderkey) AS INT) AS place FROM r""",
)
def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 50).alias("pattern_id"), "o_orderkey", (F.col("o_custkey") % 11).cast("double").alias("gain"), (F.col("o_orderkey") % 101).cast("double").alias("match"), F.col("o_orderkey").alias("input_order"))
    return K.final_ranking(rows).select("pattern_id", "o_orderkey", "place")


@query(
    "u3_peak_hits_first",
    with_searches("ref_phase", "ref_peak", "obs_peak") + f""", {SEARCHED},
c AS (SELECT pattern_id, source, entry_id, 0 AS tier, rank AS n FROM t WHERE rank <= 20 UNION ALL SELECT g.pattern_id, p.source, p.entry_id, 1, 0 FROM ref_phase p CROSS JOIN (SELECT DISTINCT pattern_id FROM obs_peak) g WHERE p.updated_rank >= 96),
d AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, source, entry_id ORDER BY tier, n) AS k FROM c) SELECT pattern_id, source, entry_id, tier FROM d WHERE k = 1""",
)
def peak_hits_first(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Hits of the peak search and, after them, the newest entries: an entry that is in both is a peak hit."""
    hits = ranked_by_peaks(spark, sf_dir, every).select("pattern_id", "source", "entry_id", F.lit(0).alias("tier"))
    newest = _phases(spark, sf_dir).where("updated_rank >= 96").select("source", "entry_id")
    others = hits.select("pattern_id").distinct().crossJoin(newest).select("pattern_id", "source", "entry_id", F.lit(1).alias("tier"))
    return S.dedupe_rows(hits.unionByName(others), [F.col(c) for c in ("pattern_id", "source", "entry_id")], [F.asc("tier")])


def _q3_sql(condition: str) -> str:
    return P + f""", e AS (SELECT *, {ELEMENTS} AS els, CASE WHEN source IN ('USER', 'CCDC', 'COD') THEN 1 ELSE 2 END AS priority FROM ref_phase),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(source)), lower(trim(entry_id)), lower(trim(formula)), lower(trim(name)) ORDER BY priority, updated_rank DESC, entry_id) AS n FROM e WHERE {condition} AND NOT list_has_any(els, ['Fe']))
SELECT source, entry_id, formula, name FROM f WHERE n = 1 ORDER BY priority, updated_rank DESC, entry_id LIMIT 300"""


@query("q3_search_by_elements", _q3_sql("list_has_all(els, ['Ca', 'O'])"))
def search_by_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_candidates(_phases(spark, sf_dir), "Ca O", ["Fe"], 300).select("source", "entry_id", "formula", "name")


@query("q3_search_by_text", _q3_sql("(contains(lower(name), 'green') OR contains(lower(formula), 'green')) AND source IN ('USER', 'CCDC', 'COD')"))
def search_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_candidates(_phases(spark, sf_dir), "Green", ["Fe"], 300).select("source", "entry_id", "formula", "name")
