"""Raw traces, incremental indexes and expiring marks as streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from peakloom.operators.search import ranked_library, search_by_peaks
from peakloom.operators.storage import written
from peakloom.streaming import streams as S


def bell(x, centre, height, width=0.3):
    return height * np.exp(-4 * np.log(2) * ((x - centre) / width) ** 2)


def test_raw_traces_are_scored_once(spark, tmp_path):
    """Two drops, a repeated file name and a restart give each pattern once, with the phase it was made of first."""
    x = 5 + np.arange(1100) * 0.05
    phases = {"1": (12.0, 20.0, 31.0, 44.0), "2": (15.0, 26.0, 37.0, 52.0)}
    peaks = spark.createDataFrame([(e, i, p, 100.0 - 20 * i) for e, places in phases.items() for i, p in enumerate(places)], "entry_id string, peak_index int, two_theta double, intensity double")
    cells = spark.createDataFrame([(e, "COD", "CaO", "n", "P", *(4.0 + int(e),) * 3, 90.0, 90.0, 90.0, 1) for e in phases], "entry_id string, source string, formula string, name string, spacegroup string, a double, b double, c double, alpha double, beta double, gamma double, updated_rank int")
    library = written(ranked_library(peaks))

    def score(found):
        return search_by_peaks(found, peaks, cells, library=library).select("pattern_id", "entry_id", "rank")

    drop, out, checkpoint = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "c")
    drop.mkdir()

    def arrive(name, entry, sep):
        y = 20 + sum(bell(x, p, 400 - 60 * i) for i, p in enumerate(phases[entry]))
        (drop / name).write_text("# trace\n" + "\n".join(f"{a:.2f}{sep}{b:.3f}" for a, b in zip(x, y, strict=True)))

    arrive("a.xy", "1", " ")
    arrive("b.xy", "2", "\t")
    S.intake_traces(spark, str(drop), checkpoint, score, out)
    arrive("c.xy", "2", "; ")
    (drop / "broken.xy").write_text("no numbers here")
    S.intake_traces(spark, str(drop), checkpoint, score, out)
    S.intake_traces(spark, str(drop), checkpoint, score, out)
    rows = spark.read.parquet(out).where("rank = 1").select("pattern_id", "entry_id").collect()
    assert sorted(map(tuple, rows)) == [("a.xy", "1"), ("b.xy", "2"), ("c.xy", "2")]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    library, folder = tmp_path / "library", tmp_path / "incoming"
    folder.mkdir()
    names = ("source", "entry_id", "formula", "peaks_json", "updated_rank")
    peaks = json.dumps([{"peak_index": 0, "two_theta": 12.5, "intensity": 100.0, "h": 1, "k": 0, "l": 0}])
    rows = spark.createDataFrame([("COD", str(i), "CaO", peaks, 1) for i in range(40)], "source string, entry_id string, formula string, peaks_json string, updated_rank int")
    S.write_index(rows, f"{library}/phases", 8)
    S.write_index(rows.select("source", "entry_id", F.explode(F.array(F.lit("Ca"), F.lit("O"))).alias("element")), f"{library}/elements", 8)
    S.write_index(rows.select("source", "entry_id", F.lit(0).alias("peak_index"), F.lit(12.5).alias("two_theta"), F.lit(100.0).alias("intensity")), f"{library}/peaks", 8)
    before = {p: p.stat().st_mtime_ns for p in library.rglob("*.parquet")}
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in (("COD", "3", "MgO", None, 2), ("USER", "x", "Fe2O3", peaks.replace("12.5", "33.0"), 1))))
    for _ in range(2):  # the second run has nothing new
        S.maintain_indexes(spark, str(folder), str(tmp_path / "c"), str(library), ["peaks_json"], 8)
    after = {p: p.stat().st_mtime_ns for p in library.rglob("*.parquet")}
    gone = {p.parent.name for p in before if p not in after}
    assert 1 <= len(gone) <= 2 and all(after[p] == t for p, t in before.items() if p in after)
    got = {(r.source, r.entry_id): r.formula for r in spark.read.parquet(f"{library}/phases").collect()}
    assert len(got) == 41 and got["COD", "3"] == "MgO" and got["COD", "4"] == "CaO"
    elements = {(r.source, r.entry_id, r.element) for r in spark.read.parquet(f"{library}/elements").collect()}
    assert ("COD", "3", "Mg") in elements and ("COD", "3", "Ca") not in elements and ("USER", "x", "Fe") in elements and len(elements) == 82
    lines = {(r.source, r.entry_id): r.two_theta for r in spark.read.parquet(f"{library}/peaks").collect()}
    assert len(lines) == 41 and lines["USER", "x"] == 33.0 and lines["COD", "3"] == 12.5


def test_a_refreshed_mark_lives_on(spark, tmp_path):
    """A mark of day 0, refreshed on day 5, is fresh until day 12; other keys only move the clock."""
    folder, checkpoint = tmp_path / "marks", str(tmp_path / "c")
    schema = "source string, query_key string, updated_at timestamp"
    seen = []

    def batch(name, *marks):
        spark.createDataFrame([(s, k, d) for s, k, d in marks], "source string, query_key string, d int").selectExpr("source", "query_key", "timestamp_seconds(1700000000 + 86400 * d) AS updated_at").coalesce(1).write.mode("append").parquet(str(folder))
        stream = S.mark_states(spark.readStream.schema(schema).parquet(str(folder)))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((name, r.query_key, r.state) for r in df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    batch("day 0", ("COD", "a", 0))
    batch("day 5", ("COD", "a", 5))
    batch("day 9", ("COD", "clock", 9))
    batch("day 11", ("COD", "clock", 11))
    assert not [x for x in seen if x[2] == "expired"]
    batch("day 13", ("COD", "clock", 13))
    batch("day 14", ("COD", "clock", 14), ("COD", "b", 14))
    assert [x[1] for x in seen if x[2] == "expired"] == ["a"]
    assert ("day 5", "a", "fresh") in seen and ("day 14", "b", "fresh") in seen
