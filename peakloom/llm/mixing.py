"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that serves its documents in a shuffled order, twice at most. A served copy gets a
virtual finish time: the source's cumulative words up to and including it, over the source's target. All
copies of all sources are ranged by finish time and served until the total budget is used up; the copy that
a source is serving at that moment (one a source at most) is taken in part.

Targets add up to the budget, and a source has served v times its target at virtual time v, so the budget is used up
at v = 1: mix() cuts every queue there. served_order() ranges all served copies by finish time and numbers their words;
the last number is the budget.

Prefix sums go by two levels (buckets or ranges, then inside one), and the number of buckets follows the number of
documents, so neither a hot source nor the global order meets in one task. Defined cases: a null or empty text has size
0 and is never taken; a very long text is one document; a null source is a source of its own, after all others;
repeated rows are documents of their own (equal rows share an order key, which any order of them satisfies); documents
without an id are shuffled by a hash of their text; other columns are ignored, whatever their names; an empty table gives
an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.common import materialize, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: A source is dealt into as many buckets as give its documents about so many rows each, and into LEAST_BUCKETS at least.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256

WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words) and the shuffle key to doc_id and source."""
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))))
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), key.alias("key"))


def targets(sources: DataFrame, share: float = BUDGET_SHARE) -> DataFrame:
    """Water-filled targets of (source, source_size): in proportion to weight, none above MAX_EPOCHS sizes.

    The table has a row a source. Ordered by size over weight, the sources that fill up come first. The level
    before a source is what is left of the budget over the weights that are left: it rises over the sources
    that fill up and falls after them, so its maximum is the one that holds for all others.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((n - 1) % len(WEIGHTS) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(MAX_EPOCHS))
        .withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.round(F.least("cap", F.col("level") * F.col("weight")), 6))
        .select("source", "source_size", "target")
    )


def _served(copy: int | F.Column) -> F.Column:
    """Words that the mix takes of a document's copy of the given number."""
    begin = F.col("end") - F.col("size") + F.col("source_size") * copy
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - begin))


def mix(docs: DataFrame, share: float = BUDGET_SHARE, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, finish (of its first copy, null if not taken), end (words of its queue up to it)."""
    buckets = buckets or max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    one = sized(docs).withColumn("b", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).withColumn("b", F.floor("b").cast("int"))
    sums = one.groupBy("source", "b").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share)
    starts = sums.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("b")) - F.col("bucket_size")).select("source", "b", "start")
    meta = starts.join(goal, starts.source.eqNullSafe(goal.source)).select(starts.source.alias("s"), F.col("b").alias("sb"), "start", "source_size", "target")
    # meta has at most `buckets` rows a source; each source of a bucket is one window
    inside = Window.partitionBy("source", "b").orderBy("key", "size")
    queue = one.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    queue = queue.join(meta, queue.source.eqNullSafe(F.col("s")) & (queue.b == F.col("sb"))).withColumn("end", F.col("start") + F.col("within"))
    # Served words of a source at virtual time v are v * target, so the budget (all targets) is used up at v = 1.
    served = sum(_served(e) for e in range(MAX_EPOCHS))
    finish = F.col("end") / F.nullif("target", F.lit(0.0))
    return queue.select("doc_id", "source", "size", "source_size", "target", served.cast("long").alias("taken"), F.when(served > 0, F.round(finish, 9)).alias("finish"), "end")


def served_order(mixed: DataFrame) -> DataFrame:
    """The served copies of mix() rows in serving order: doc_id, source, copy, size, source_size, target, taken, finish, position.

    All copies are sorted by range of virtual finish time; position counts the words served before a copy, by sums of
    the ranges and a running sum inside each.
    """
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))).withColumn("taken", _served(F.col("copy"))).where("taken > 0")
    copies = copies.withColumn("finish", F.round((F.col("end") + F.col("source_size") * F.col("copy")) / F.col("target"), 9))
    order = ["finish", "doc_id", "source", "copy", "end"]
    ranged = materialize(copies.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("taken").alias("words"))  # a row a range
    starts = sums.select("range", (F.sum("words").over(Window.orderBy("range")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("range").orderBy(*order)
    placed = ranged.withColumn("position", F.sum("taken").over(inside) - F.col("taken")).join(F.broadcast(starts), "range")
    placed = placed.withColumn("position", F.col("position") + F.col("before"))
    return placed.select("doc_id", "source", "copy", "size", "source_size", "target", "taken", "finish", "position").orderBy("position")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER p, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0.0::DOUBLE)) AS level
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(least(cap, max(level) OVER () * weight), 6) AS target FROM l),
q AS (SELECT doc_id, size, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CAST(greatest(0, least(size, floor(target)::BIGINT - (fin - size))) + greatest(0, least(size, floor(target)::BIGINT - (fin - size + source_size))) AS BIGINT) AS taken FROM q)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(fin / target, 9) END AS finish FROM r
"""
