"""Searches over all patterns of the smallest tables, and whole jobs that loops over their rows confirm."""

import math
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from peakloom.functions import chemistry as C
from peakloom.operators import search as S
from peakloom.plans import fit_queries, matching_queries, phasefit_queries, search_queries, signal_queries
from peakloom.plans.fixtures import view

PATTERNS = [
    (search_queries, "j1_range_join"), (search_queries, "a1_search_metrics"), (search_queries, "q2_search_by_peaks"),
    (matching_queries, "j4_nearest_observed"), (matching_queries, "a2_match_scores"), (matching_queries, "a5_a6_alignment"), (matching_queries, "a8_zero_shifts"),
    (matching_queries, "a9_consensus_zero"),
]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def over_all_patterns(sql):
    """The registered SQL, but with every pattern as a query."""
    assert "WHERE pattern_id % 100 = 0" in sql
    return sql.replace("WHERE pattern_id % 100 = 0", "WHERE pattern_id % 1 = 0")


def same_rows(df, duck, sql):
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    key = lambda r: [(v is None, str(v)) for v in r]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_every_observed_peak_of_every_pattern(spark, duck, sf):
    rows = duck.execute("SELECT count(*), count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()
    seen = view(spark, sf, "obs_peak")
    assert (seen.count(), seen.select("pattern_id").distinct().count()) == rows


@pytest.mark.parametrize(("module", "name"), PATTERNS, ids=[n for _, n in PATTERNS])
def test_query_over_all_patterns(spark, duck, sf, module, name):
    assert same_rows(module.QUERIES[name](spark, sf, every=1), duck, over_all_patterns(module.SQL[name]))


@pytest.mark.parametrize("name", ["j5_assignments", "j7_unclaimed_peaks"])
def test_selected_phases_come_from_the_search(spark, duck, sf, name):
    assert same_rows(matching_queries.QUERIES[name](spark, sf, every=1), duck, over_all_patterns(matching_queries.SQL[name]))


def test_fits_take_the_phases_of_the_search(spark, sf):
    chosen = {tuple(r) for r in matching_queries.selected(spark, sf, 100).collect()}
    scales = fit_queries.QUERIES["a15_joint_scales"](spark, sf).select("pattern_id", "phase").collect()
    assert {tuple(r) for r in scales} == chosen
    for name in ("j6_one_to_one", "a4_scale_votes"):
        pairs = {(int(k.split("/")[0]), k.split("/")[1]) for (k,) in fit_queries.QUERIES[name](spark, sf).select("key").distinct().collect()}
        assert pairs <= chosen and {p for p, _ in pairs} == {p for p, _ in chosen}


def test_few_candidates_rank_as_by_all_metrics(spark):
    """Patterns with fewer strong phases than wanted are searched in full: the order is that of the metrics of all phases."""
    import random

    rng = random.Random(11)
    phases = spark.createDataFrame([("S", str(e), f"A{e}", f"n{e}", "P 1", 1.0 + e, 2.0, 3.0, 90.0, 90.0, 90.0, e % 3) for e in range(30)], "source string, entry_id string, formula string, name string, spacegroup string, a double, b double, c double, alpha double, beta double, gamma double, updated_rank int")
    peaks = spark.createDataFrame([(str(e), i, round(rng.uniform(5, 110), 2), float(rng.randint(1, 100))) for e in range(30) for i in range(14)], "entry_id string, peak_index int, two_theta double, intensity double")
    seen = spark.createDataFrame([(p, i, round(rng.uniform(5, 110), 2)) for p in range(6) for i in range(20)], "pattern_id long, peak_id int, two_theta double")
    got = [(r.pattern_id, r["rank"], r.entry_id) for r in S.search_by_peaks(seen, peaks, phases, 8).collect()]
    metrics = S.search_metrics(S.ranked_library(peaks), S.query_plan(seen)).join(phases, "entry_id").collect()
    key = lambda r: tuple(-r[c] for c in S.ORDER[1]) + (r.best_delta, -r.updated_rank, r.entry_id)
    want = []
    for p in range(6):
        want += [(p, k + 1, r.entry_id) for k, r in enumerate(sorted((r for r in metrics if r.pattern_id == p), key=key)[:8])]
    assert sorted(got) == sorted(want)


def test_profiles_hold_every_line(spark, sf):
    want = defaultdict(lambda: defaultdict(float))
    for entry, position, height in view(spark, sf, "ref_peak").select("entry_id", "two_theta", "intensity").collect():
        for g in range(max(math.ceil(round((position - 6.0) / 0.05, 9)), 0), min(math.floor(round((position - 4.0) / 0.05, 9)), 1699) + 1):
            z = (5.0 + g * 0.05 - position) / 0.2
            want[entry][g] += height * (0.5 / (1 + 4 * z * z) + 0.5 * math.exp(-4 * math.log(2) * z * z))
    got = defaultdict(dict)
    for entry, g, y in signal_queries.QUERIES["j10_rasterise"](spark, sf).select("entry_id", "g", "y").collect():
        got[entry][g] = y
    assert got.keys() == want.keys()
    for entry, profile in want.items():
        top = max(profile.values())
        # a grid point at exactly 5 FWHM may fall to either side by the last bit; its share is 0.5 % of its line
        both = got[entry].keys() & profile.keys()
        assert len(both) >= 0.97 * max(len(profile), len(got[entry]))
        off = [g for g in both if abs(got[entry][g] - 100 * profile[g] / top) > 2e-4]
        assert len(off) <= 0.05 * len(both) and all(abs(got[entry][g] - 100 * profile[g] / top) < 1 for g in off)


def test_element_order_has_the_whole_table(spark, sf):
    symbols = ["H", "Zn", "Ga", "Ba", "La", "Hf", "Og", "Ce", "Lu", "Th", "Lr", "Xx"]
    df = spark.createDataFrame([(x,) for x in symbols], "e string").select("e", C.element_order(F.col("e")).alias("z"))
    assert [r.e for r in df.orderBy("z").collect()] == symbols
    assert df.where("e = 'Lr'").first().z == 118 and df.where("e = 'Xx'").first().z == 119
    rows = search_queries.QUERIES["k6_element_order"](spark, sf).collect()
    seen = {r[0] for r in view(spark, sf, "ref_phase").select(F.explode(C.formula_elements(F.col("formula")))).distinct().collect()}
    assert {r.element for r in rows} == seen and dict(map(tuple, rows))["Ba"] == 56
    assert [r.z for r in rows] == sorted(r.z for r in rows)


def test_strong_hits_are_counted_by_blocks_and_never_shuffled(spark, monkeypatch):
    """Several blocks of phases and patterns give what a loop gives; the plan has no join of lines with positions."""
    import random

    rng = random.Random(4)
    monkeypatch.setattr(S, "PHASES_A_BLOCK", 9)
    monkeypatch.setattr(S, "PATTERNS_A_BLOCK", 3)
    tops = [(str(e), round(rng.uniform(5, 25), 2), k + 1) for e in range(60) for k in range(10)]
    anchors = [(p, round(rng.uniform(5, 25), 2), 1) for p in range(8) for _ in range(1 if p == 7 else 10)]
    library = spark.createDataFrame(tops, "entry_id string, two_theta double, top_rank int")
    able = S.strong_candidates(library, spark.createDataFrame(anchors, "pattern_id long, position double, anchor_weight int"), 5)
    assert "__bucket" not in able._jdf.queryExecution().toString()
    want = set()
    for p in range(8):
        hits = {}
        for e, x, _ in tops:
            hits[e] = hits.get(e, 0) + sum(q == p and a - 0.35 <= x <= a + 0.35 for q, a, _ in anchors)
        some = {e: n for e, n in hits.items() if n}
        want |= {(p, e, len(some) >= 5) for e, n in some.items() if sum(m > n for m in some.values()) < 5}
    assert {tuple(r) for r in able.collect()} == want


def test_all_pairs_are_not_cut_to_the_ranked_phases(spark, sf):
    """A pattern meets more phases than the twenty that a search ranks."""
    rows = search_queries.QUERIES["j1_range_join"](spark, sf, every=100).groupBy("pattern_id").count().collect()
    assert rows and min(r["count"] for r in rows) > 20


def test_cell_scales_and_fitted_peaks_are_of_every_pattern(spark, duck, sf):
    """both read the peaks of each hundredth pattern only."""
    want = duck.execute("SELECT o_custkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1").fetchall()
    peaks = phasefit_queries.QUERIES["q7_fitted_peaks"](spark, sf).groupBy("pattern_id").count().collect()
    assert sorted(map(tuple, peaks)) == sorted(want)
    scales = {tuple(r) for r in fit_queries.QUERIES["a11_cell_scales"](spark, sf).select("pattern_id", "entry_id").collect()}
    chosen = {tuple(r) for r in matching_queries.selected(spark, sf, 1).collect()}
    assert scales <= chosen and len({p for p, _ in scales}) > 0.9 * len(want)
