"""The library maintenance stream keeps what a record lacks and survives a restart."""

import json

from peakloom.streaming import streams as T


def test_records_are_upserted_by_batches(spark, tmp_path):
    library, folder, checkpoint = (str(tmp_path / n) for n in ("library", "incoming", "checkpoint"))
    rows = [("COD", "1", "CaO", "[1]", 1), ("COD", "2", "MgO", None, 1)]
    spark.createDataFrame(rows, "source string, entry_id string, formula string, peaks_json string, updated_rank int").write.parquet(f"{library}/version=0")
    (tmp_path / "incoming").mkdir()

    def arrive(name, *records):
        (tmp_path / "incoming" / name).write_text("\n".join(json.dumps(dict(zip(("source", "entry_id", "formula", "peaks_json", "updated_rank"), r, strict=True))) for r in records))
        T.maintain(spark, folder, checkpoint, library, ["peaks_json"])

    arrive("a.json", ("COD", "1", "CaO2", None, 2), ("USER", "9", "FeO", "[9]", 1))
    arrive("b.json", ("COD", "2", "MgO", "[2]", 3), ("COD", "2", "Mg2O", None, 2))
    T.maintain(spark, folder, checkpoint, library, ["peaks_json"])  # nothing new
    got = {(r.source, r.entry_id): (r.formula, r.peaks_json) for r in spark.read.parquet(f"{library}/version=2").collect()}
    assert got == {("COD", "1"): ("CaO2", "[1]"), ("COD", "2"): ("MgO", "[2]"), ("USER", "9"): ("FeO", "[9]")}
