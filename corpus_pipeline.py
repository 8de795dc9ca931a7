"""A training-data pipeline over documents: quality rules, near-dedup, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. Between the
stages the documents are Parquet in the shared folder, so a lost executor costs one stage's tasks at most.

Stages that join decisions back to documents number the rows first, in a table of their own, so null and repeated
doc_ids, equal rows and clashing columns are rows like all others; see each stage for what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, table
from peakloom.llm.decontam import contaminations
from peakloom.llm.minhash import near_duplicates
from peakloom.llm.mixing import mix, served_order
from peakloom.llm.quality import keep_documents
from peakloom.llm.secrets import redact

#: A hit on a benchmark item of fewer characters, a word or two, doesn't reject a document.
TELLING_ITEM = 24


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): every document as a struct under a number of its own; written, so the numbers stay."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null, empty and short texts fail; rows are judged one by one."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that of the smallest doc_id, nulls last, then of the first row.

    Equal rows, and rows of one doc_id or none, are documents of their own and fall into groups by their texts. Texts
    without words are no duplicates of each other and stay.
    """
    rows = _numbered(docs)
    groups = near_duplicates(_texts(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    # documents alone in their group stay; the others meet by group, in rows of numbers only
    shared = bounded_broadcast(materialize(groups.where("row <> component").select("component").distinct()))
    among = groups.join(shared, "component", "left_semi")
    ids = among.join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    order = F.struct(F.col("id").isNull(), "id", "row")
    best = ids.groupBy("component").agg(F.min(order)["row"].alias("row"))
    gone = materialize(ids.join(best, "row", "left_anti").select("row"))
    return rows.join(bounded_broadcast(gone), "row", "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of TELLING_ITEM characters or more; null texts hold none, every row is judged."""
    rows = _numbered(docs)
    items = table(spark, sf_dir, "benchmark").where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) >= TELLING_ITEM)
    leaks = contaminations(_texts(rows), items).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bounded_broadcast(materialize(leaks)), "row", "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted again; null texts stay null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in serving order, a row a served copy: doc_id, source, copy, size, source_size, target, taken, finish, position.

    Documents without words are never served; null sources are one source.
    """
    return served_order(mix(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]
#: SQL can't express the verified MinHash groups and the edit distances on whole tables; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
