"""Streams over operation logs and entry records.

Every function takes and returns a streaming (or, for comparison, a batch) DataFrame; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from peakloom.functions.chemistry import formula_elements
from peakloom.operators.library import peak_rows, upsert
from peakloom.operators.signal import as_arrays
from peakloom.operators.storage import written
from peakloom.operators.traces import prepare_observed, well_formed
from peakloom.sources.text import xy_points

OPERATIONS = "ts timestamp, operation string, status string, elapsed_ms double, correlation string"


def operations(events: DataFrame) -> DataFrame:
    """The operation log of event rows; time stamps without a zone are taken as UTC."""
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    return events.select(ts.alias("ts"), F.col("event_type").alias("operation"), status.alias("status"), (F.col("value") * 10).alias("elapsed_ms"), F.col("user_id").cast("string").alias("correlation"))


def monitor(ops: DataFrame, window: str = "10 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Per window and operation: count, failures, failure rate and an approximate 95th percentile of the time taken."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = ops.withWatermark("ts", lateness).groupBy(w.alias("w"), "operation")
    failed = F.sum((F.col("status") == "failed").cast("int"))
    out = g.agg(F.count("*").alias("n"), failed.alias("n_failed"), F.round(failed / F.count("*"), 6).alias("failure_rate"), F.percentile_approx("elapsed_ms", 0.95, 10_000).alias("p95_ms"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "operation", "n", "n_failed", "failure_rate", "p95_ms")


def sessions(ops: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Operations of one correlation without a pause above `gap`: their number and total time."""
    w = F.session_window("ts", gap)
    g = ops.withWatermark("ts", lateness).groupBy(w.alias("w"), "correlation").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_ms"), 4).alias("total_ms"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "correlation", "n", "total_ms")


def distinct_keys(records: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first record of a key within the watermark."""
    return records.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def best_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the best (least) tier so far, in update or complete mode: staged results replace each other."""
    return records.groupBy(*keys).agg(F.min_by(F.struct("tier", "payload"), F.struct("tier", "payload")).alias("b")).select(*keys, "b.tier", "b.payload")


def fresh(marks: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """Search marks (source, query_key, updated_at) younger than `days` at a given time, which is a parameter."""
    now = F.lit(as_of) if isinstance(as_of, str) else as_of
    return marks.where(F.col("updated_at") > now.cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def expiring_marks(marks: DataFrame, days: int = 7) -> DataFrame:
    """State with expiry: a mark (source, query_key, updated_at) is passed on unless the key was passed on within `days`."""
    return marks.withWatermark("updated_at", f"{days} days").dropDuplicatesWithinWatermark(["source", "query_key"])


MARKS = "source string, query_key string, updated_at timestamp, state string"


def mark_states(marks: DataFrame, days: int = 7) -> DataFrame:
    """Freshness as state with expiry: (source, query_key, updated_at, state) whenever a key is marked ('fresh') or runs out ('expired').

    A later mark refreshes its key, so its time runs anew; an earlier one changes nothing. The watermark is the clock: a key
    expires in the first batch after the watermark has passed its last mark by `days`, and its state is dropped then.
    """
    life = days * 24 * 3600 * 1000

    def advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, word = state.get[0], "expired"
            state.remove()
        else:
            newest = max(int(r["updated_at"].max().value // 1_000_000) for r in rows)
            last, word = max(newest, state.get[0] if state.exists else newest), "fresh"
            state.update((last,))
            # a mark older than the watermark has run out already or runs out at once
            state.setTimeoutTimestamp(max(last + life, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source": [key[0]], "query_key": [key[1]], "updated_at": [pd.Timestamp(last, unit="ms")], "state": [word]})

    keyed = marks.where("updated_at IS NOT NULL").withWatermark("updated_at", "0 seconds").groupBy("source", "query_key")
    return keyed.applyInPandasWithState(advance, MARKS, "last long", "update", "EventTimeTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into an in-memory table, for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed every micro-batch to `work`, once per batch number over restarts with the same checkpoint folder.

    work must be idempotent by batch number, as a batch is repeated if its commit is lost.
    """
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def intake(spark: SparkSession, folder: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Traces that arrive as Parquet files in `folder`, scored by the batch pipeline; results of a batch replace themselves."""
    schema = "pattern_id long, peak_id int, two_theta double, height double, area double, fwhm double"
    stream = spark.readStream.schema(schema).parquet(folder)
    run_batches(stream, lambda df, n: score(df).write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint)


PEAKS = "pattern_id string, peak_id int, two_theta double, height double, area double, fwhm double"


def trace_peaks(lines: DataFrame) -> DataFrame:
    """Observed peaks of trace lines (pattern_id, line_no, line): parsed, prepared and measured; peak_id is the order by height."""
    points = well_formed(xy_points(lines, "pattern_id"))
    found = prepare_observed(as_arrays(points)).select("pattern_id", F.posexplode(F.sort_array(F.transform("peaks", lambda p: F.struct((-p["height"]).alias("k"), p["two_theta"].alias("t"), p.alias("p"))))).alias("n", "v"))
    return found.select("pattern_id", (F.col("n") + 1).alias("peak_id"), "v.p.two_theta", "v.p.height", "v.p.area", "v.p.fwhm")


def intake_traces(spark: SparkSession, folder: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Raw trace files that arrive in `folder`: parsed, their peaks found, scored by `score` against a stored library.

    A file is a pattern, by its name. Batches go to folders of their own, so a repeated one replaces itself; a file name that an
    earlier batch has scored is left out, so each pattern is there once, over restarts as well.
    """
    stream = spark.readStream.option("wholetext", True).text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("pattern_id"), "value")

    def work(batch: DataFrame, n: int) -> None:
        lines = batch.select("pattern_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
        here = spark.read.schema("pattern_id string").option("recursiveFileLookup", True).parquet(*[f"{out}/batch={k}" for k in range(n)]) if n else None
        if here is not None:
            lines = lines.join(here.distinct(), "pattern_id", "left_anti")
        score(trace_peaks(lines)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_batches(stream, work, checkpoint)


#: Key buckets of a stored index: only those that a batch touches are written anew.
INDEX_BUCKETS = 64


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("source", "entry_id"), F.lit(buckets)).cast("int"))


def write_index(rows: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """An index table of rows with source and entry_id, as Parquet in folders by key bucket."""
    _bucketed(rows, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def maintain_indexes(spark: SparkSession, folder: str, checkpoint: str, library: str, keep: list[str], buckets: int = INDEX_BUCKETS) -> None:
    """Entry records that arrive as JSON files in `folder`, upserted into the phases, elements and peaks below `library`.

    Each is a table by key bucket (write_index()). A batch reads and overwrites the buckets of its own keys only; all other
    files stay as they are. A repeated batch gives the same rows, as an upsert does, and the old rows are written aside before
    their bucket is overwritten.
    """
    schema = spark.read.parquet(f"{library}/phases").drop("bucket").schema
    stream = spark.readStream.schema(schema).json(folder)

    def work(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        batch = written(_bucketed(batch, buckets))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        here = F.col("bucket").isin(touched)
        old = session.read.parquet(f"{library}/phases").where(here).select(*schema.names)
        phases = written(upsert(old, batch.select(*schema.names), keep, "updated_rank"))
        keys = phases.select("source", "entry_id")
        elements = phases.select("source", "entry_id", F.explode(formula_elements(F.col("formula"))).alias("element"))
        peaks = peak_rows(phases.select(F.struct("source", "entry_id").alias("entry_id"), "peaks_json")).select("entry_id.*", "peak_index", "two_theta", "intensity")
        for name, rows in (("phases", phases), ("elements", elements.join(keys, ["source", "entry_id"], "left_semi")), ("peaks", peaks)):
            out = _bucketed(written(rows), buckets).repartition("bucket")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{library}/{name}")

    run_batches(stream, work, checkpoint)


def maintain(spark: SparkSession, folder: str, checkpoint: str, library: str, keep: list[str]) -> None:
    """Entry records that arrive as JSON files in `folder`, upserted into the library table by batches.

    Every batch writes the next version of the table in a folder of its own, so one that is repeated replaces itself;
    the newest version below `library` is the table. Rows of a batch keep stored values of `keep` where they have none.
    """
    schema = spark.read.parquet(f"{library}/version=0").schema
    stream = spark.readStream.schema(schema).json(folder)

    def work(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.schema(schema).parquet(f"{library}/version={n}")
        upsert(old, batch, keep, "updated_rank").write.mode("overwrite").parquet(f"{library}/version={n + 1}")

    run_batches(stream, work, checkpoint)
