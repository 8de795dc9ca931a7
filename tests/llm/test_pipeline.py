import corpus_pipeline as P
from peakloom.llm.common import materialize
from peakloom.llm.decontam import contaminations
from peakloom.llm.minhash import near_duplicates
from pyspark.sql import functions as F


def prose(start, n=80):
    return " ".join(f"word{i}" for i in range(start, start + n))


def test_every_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            assert near_duplicates(docs).where("NOT kept").count() == 0
        if name == "decontaminate":
            assert contaminations(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert kept["near_dedup"] < kept["quality"] and kept["decontaminate"] < kept["near_dedup"] and kept["secrets"] == kept["decontaminate"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    total = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("size(regexp_extract_all(text, '[^ ]+', 0)) > 60").collect()]
    assert all(d in kept["quality"] for d in total if labels.get(d) == 1)
    last = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} <= kept["secrets"] and all(r.taken > 0 for r in last)
    assert abs(sum(r.taken for r in last) - sum({r.source: r.target for r in last}.values())) < 5


def test_run_is_the_stages_in_a_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_equal_rows_and_rows_without_an_id(spark, sf):
    """Equal texts leave one row, whatever their ids; near copies as well; rows without words stay."""
    a, b = prose(0), prose(0, 79) + " other"
    rows = [(7, a)] * 3 + [(5, b), (None, a), (None, prose(500)), (None, prose(500)), (9, prose(900)), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, row string, component int, id int")
    got = P.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text) == sorted([("5", b), ("None", prose(500)), ("9", prose(900))])
    assert got.where("coalesce(text, '') = ''").count() == 3


def test_a_leak_without_an_id_goes(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first().text
    docs = spark.createDataFrame([(None, prose(0) + " " + item, 1), (None, prose(0), 2), (2, item.upper(), 3), (2, prose(9), 4)], "doc_id long, text string, item_id int")
    assert sorted(r.item_id for r in P.decontaminate(spark, docs, sf).collect()) == [2, 4]


def test_stages_of_empty_and_awkward_documents(spark, odd_docs, no_docs, sf):
    n = odd_docs.count()
    for docs, counts in ((no_docs, (0, 0, 0)), (odd_docs, None)):
        got = [stage(spark, docs, sf) for _, stage in P.STAGES[:-1]]
        assert all(g.columns == docs.columns for g in got)
        if counts:
            assert all(g.count() == 0 for g in got) and P.mixing(spark, docs, sf).count() == 0
    quality, dedup, clean, masked = got
    # every odd text is too short, or repeats itself, but two of one word each that are long by characters alone
    assert quality.count() == 0
    assert masked.count() == clean.count() == n
    # the repeated row, and the two spellings of one text
    assert dedup.count() == n - 2
    assert {r.text for r in masked.where(F.col("doc_id") == 8).collect()} == {r.text for r in odd_docs.where(F.col("doc_id") == 8).collect()}
