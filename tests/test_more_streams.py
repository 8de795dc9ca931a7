"""T3, T5 and T7 as streams, and the functions S8 and F26 on known texts."""

from pyspark.sql import functions as F

from peakloom.functions import chemistry as C
from peakloom.sources import text as T
from peakloom.streaming import streams as S


def stream_of(spark, df, folder):
    df.coalesce(1).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_queued_keys_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([("COD", "1", 0), ("COD", "1", 5), ("COD", "2", 5), ("MP", "1", 9)], "source string, entry_id string, m int").selectExpr("source", "entry_id", "timestamp_seconds(1700000000 + 60 * m) AS ts")
    got = S.run_to_table(S.distinct_keys(stream_of(spark, rows, tmp_path / "in"), ["source", "entry_id"]), "keys_once", str(tmp_path / "c"))
    assert sorted((r.source, r.entry_id) for r in got.collect()) == [("COD", "1"), ("COD", "2"), ("MP", "1")]


def test_two_tiers_of_results_merge(spark, tmp_path):
    local = spark.createDataFrame([("a", 0, "local a"), ("b", 0, "local b")], "key string, tier int, payload string")
    online = spark.createDataFrame([("a", 1, "again a"), ("c", 1, "online c")], local.schema)
    both = stream_of(spark, local, tmp_path / "local").union(stream_of(spark, online, tmp_path / "online"))
    got = S.run_to_table(S.best_rows(both, ["key"]), "staged", str(tmp_path / "c"), "complete")
    assert sorted(map(tuple, got.collect())) == [("a", 0, "local a"), ("b", 0, "local b"), ("c", 1, "online c")]


def test_sessions_end_with_a_pause(spark, tmp_path):
    # the last row moves the watermark past the sessions before it
    rows = spark.createDataFrame([("u", 0, 1.0), ("u", 20, 2.0), ("u", 60, 4.0), ("v", 10, 8.0), ("w", 600, 16.0)], "correlation string, m int, elapsed_ms double")
    ops = rows.selectExpr("timestamp_seconds(1700000000 + 60 * m) AS ts", "'x' AS operation", "'ok' AS status", "elapsed_ms", "correlation")
    got = S.run_to_table(S.sessions(stream_of(spark, ops, tmp_path / "in")), "sessions", str(tmp_path / "c"))
    assert sorted((r.correlation, r.n, r.total_ms) for r in got.collect()) == [("u", 1, 4.0), ("u", 2, 3.0), ("v", 1, 8.0)]


def test_card_lines_and_sites(spark):
    payload = "3.34250 100 4.25700 22 .000000 50 1.81790 0 1.54180 120"
    df = spark.createDataFrame([(payload, "Fe @ 0.5 0 x")], "p string, s string")
    lines, two, site = df.select(T.card_lines(F.col("p")), T.card_lines(F.col("p"), 2), C.site_tokens(F.col("s"))).first()
    assert [tuple(x) for x in lines] == [(3.3425, 100.0), (4.257, 22.0), (1.5418, 100.0)] and len(two) == 2
    assert tuple(site) == ("Fe", 0.5, 0.0, None)


def test_card_numbers_of_six_digits(spark):
    df = spark.createDataFrame([("tin oxide / tin oxide  Ca2O3  7- 120000 C",), ("tin oxide / tin oxide  Ca2O3  7- 12 I",)], "r string").select(T.card_summary(F.col("r")).alias("c")).select("c.*")
    assert [(r.entry_id, r.formula, r.quality) for r in df.collect()] == [("01-007-120000", "Ca2O3", "C"), ("00-007-0012", "Ca2O3", "I")]
