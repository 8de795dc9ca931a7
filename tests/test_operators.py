"""Small cases with known results, and invariance under partitioning."""

import math
import uuid

from pyspark.sql import functions as F

from peakloom.functions import chemistry as C
from peakloom.operators import library as L
from peakloom.operators import matching as M
from peakloom.operators import signal as G
from peakloom.operators.ranges import range_join
from peakloom.operators.search import search_by_peaks
from peakloom.plans import signal_queries
from peakloom.plans.fixtures import view
from peakloom.sources import text as T
from peakloom.streaming import streams as S


def one(df):
    return df.collect()[0]


def test_formula_functions(spark):
    df = spark.createDataFrame([("Ca1Si2O6.50",), ("quartz low",), (None,)], "f string")
    rows = df.select(C.normalize_formula(F.col("f")), C.formula_key(F.col("f")), C.sorted_formula_key(F.col("f"))).collect()
    assert tuple(rows[0]) == ("Ca1 O6.5 Si2", "ca1si2o6.50", "ca1o6.50si2")
    assert tuple(rows[1]) == ("quartz low", "quartzlow", "quartzlow")
    assert tuple(rows[2]) == ("", "", "")


def test_card_ids(spark):
    df = spark.createDataFrame([("00-012-0345",), ("12-345",), ("x",)], "c string")
    rows = df.select(C.short_card_id(F.col("c")), C.card_code(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("12-0345", "120345"), ("12-345", "120345"), ("x", "")]


def test_phase_uuid_is_version_5(spark):
    df = spark.createDataFrame([("COD:1",), ("ü",)], "i string")
    got = [r[0] for r in df.select(C.phase_uuid(F.col("i"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("COD:1", "ü")]


def test_crystal_systems(spark):
    cells = [(4, 4, 4, 90, 90, 90), (4, 4, 5, 90, 90, 90), (4, 5, 6, 90, 90, 90), (4, 4, 6, 90, 90, 120), (4, 5, 6, 90, 100, 90), (4, 5, 6, 80, 100, 95)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cells] + [(None,) * 6], "a double, b double, c double, alpha double, beta double, gamma double")
    got = [r[0] for r in df.select(C.crystal_system()).collect()]
    assert got == ["cubic", "tetragonal", "orthorhombic", "hexagonal/trigonal", "monoclinic", "triclinic", ""]


def test_d_spacing_of_a_cube(spark):
    df = spark.createDataFrame([(1, 1, 0, 4.0)], "h int, k int, l int, a double").selectExpr("*", "a AS b", "a AS c", "90D AS alpha", "90D AS beta", "90D AS gamma")
    assert math.isclose(one(df.select(C.d_spacing()))[0], 4 / math.sqrt(2), abs_tol=1e-9)


def test_mass_fractions(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 50.0), (1, 2, 1.0, 100.0), (2, 1, -1.0, 100.0), (2, 2, 2.0, 25.0)], "pattern_id int, k int, scale double, mass double")
    assert [r.fraction for r in M.mass_fractions(df).orderBy("pattern_id", "k").collect()] == [0.5, 0.5, 0.0, 1.0]


def test_nearest_ties(spark):
    peaks = spark.createDataFrame([("p", 0, 20.0, 50.0)], "entry_id string, peak_index int, two_theta double, intensity double")
    seen = spark.createDataFrame([(1, 19.875), (1, 20.125)], "pattern_id int, two_theta double")
    assert one(M.nearest_observed(peaks, seen, 0.25)).observed == 19.875
    assert one(M.nearest_observed(peaks, seen, 0.25, higher_wins=True)).observed == 20.125


def test_range_join_kinds(spark):
    lines = spark.createDataFrame([(1, 10.0), (2, 10.6), (3, 50.0)], "id int, x double")
    probes = spark.createDataFrame([("a", 10.3)], "name string, q double")
    assert sorted(r.id for r in range_join(lines, probes, "x", "q", 0.3).collect()) == [1, 2]
    assert sorted(r.id for r in range_join(lines, probes, "x", "q", 0.3, how="left_semi").collect()) == [1, 2]
    assert [r.id for r in range_join(lines, probes, "x", "q", 0.3, how="left_anti").collect()] == [3]


def test_suppression_against_a_loop(spark, sf):
    trace = view(spark, sf, "trace_week").withColumn("y", F.col("y").cast("double"))
    peaks = G.local_maxima(trace).collect()
    want = set()
    for p in {r.pattern_id for r in peaks}:
        kept = []
        for r in sorted((x for x in peaks if x.pattern_id == p), key=lambda x: (-x.y, -x.i)):
            if all(abs(r.i - k) >= 4 for k in kept):
                kept.append(r.i)
        want |= {(p, i) for i in kept}
    got = {(r.pattern_id, r.i) for r in signal_queries.QUERIES["w5_distance_suppression"](spark, sf).collect()}
    assert got == want


def test_symmetry_images(spark):
    atoms = spark.createDataFrame([("a", "Si", 0.25, 0.5, 0.0)], "entry_id string, element string, x double, y double, z double")
    ops = spark.createDataFrame([("a", "x,y,z"), ("a", "-x+1/2, -y, z"), ("a", "'y,-x, -z+0.5'")], "entry_id string, op string")
    got = {(r.x, r.y, r.z) for r in L.expand_atoms(atoms, ops).collect()}
    assert got == {(0.25, 0.5, 0.0), (0.5, 0.75, 0.5)}


def test_numeric_lines(spark):
    lines = ["# c", "10.5, 3.25", "10,5;3", "10,5\t3", "  10  3 note", "", "7", "//x 1 2"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [list(r[0]) for r in df.select(T.numeric_columns(F.col("line"))).collect()] == [[], [10.5, 3.25], [10.5, 3.0], [10.5, 3.0], [10.0, 3.0], [], [7.0], []]


def test_folder_scan_and_headers(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "Quartz_low__R050125-1.txt").write_text("##NAMES=x\n# Ideal Chemistry: SiO2\n# source = mine\n10 1\n11 2\n")
    (tmp_path / "b.xy").write_text("10 1\n")
    (tmp_path / "readme.md").write_text("no")
    rows = T.scan_lines(spark, str(tmp_path))
    assert {(r.entry_id, r.series_name) for r in rows.collect()} == {("s1/Quartz_low__R050125-1.txt", "s1"), ("b.xy", "")}
    text = spark.createDataFrame([((tmp_path / "s1" / "Quartz_low__R050125-1.txt").read_text(),)], "t string")
    assert one(text.select(T.header_value(F.col("t"), ["formula", "ideal chemistry"]), T.header_value(F.col("t"), ["source"])))[:2] == ("SiO2", "mine")
    assert one(text.select(T.mineral_name(F.lit("a/Quartz_low__R050125-1.txt"))))[0] == "Quartz low"


def test_search_is_invariant_under_partitions(spark, sf):
    tables = [view(spark, sf, n) for n in ("obs_peak", "ref_peak", "ref_phase")]
    keys = ["pattern_id", "rank", "entry_id"]
    a = search_by_peaks(*tables).select(*keys).orderBy(*keys).collect()
    b = search_by_peaks(*(t.repartition(7) for t in tables)).select(*keys).orderBy(*keys).collect()
    assert a == b and len(a)


def test_streams_give_the_rows_of_their_batch_twins(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = S.run_to_table(S.monitor(S.operations(stream), "1 hour", lateness="30 days"), "monitor", str(tmp_path / "c1"), "complete")
    want = S.monitor(S.operations(events), "1 hour")
    cols = ["window_start", "operation", "n", "n_failed"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_expiring_marks_drop_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("COD", "fe", "2024-01-01 00:00:00"), ("COD", "fe", "2024-01-02 00:00:00"), ("MP", "fe", "2024-01-02 00:00:00")], "source string, query_key string, t string").selectExpr("source", "query_key", "CAST(t AS timestamp) AS updated_at")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = S.run_to_table(S.expiring_marks(stream), "marks", str(tmp_path / "c2"))
    assert sorted((r.source, r.query_key) for r in got.collect()) == [("COD", "fe"), ("MP", "fe")]


def test_intake_is_idempotent(spark, sf, tmp_path):
    view(spark, sf, "obs_peak").coalesce(1).write.parquet(str(tmp_path / "drop"))
    score = lambda df: df.groupBy("pattern_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        S.intake(spark, str(tmp_path / "drop"), str(tmp_path / "c3"), score, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == view(spark, sf, "obs_peak").count()
