"""Joins by position within a tolerance, made equi-joins by buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.storage import bounded_broadcast, written

BUCKET = "__bucket"


def range_join(lines: DataFrame, probes: DataFrame, line_pos: str, probe_pos: str, tolerance: float | str, keys: Sequence[str] = (), width: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of lines and probes with line_pos between probe_pos - tolerance and probe_pos + tolerance.

    tolerance is a number, or a column of probes when it differs by row (then give width, about twice a usual
    tolerance). Only the probes are copied, into the two or so buckets that they reach, so no pair occurs
    twice; the bucket is a join key, so a dense region is a skewed partition that the engine can split.
    how: inner, or left_semi / left_anti to keep lines with / without a probe.
    """
    reach = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
    width = width or 2 * float(tolerance)
    low, high = F.floor((F.col(probe_pos) - reach) / width), F.floor((F.col(probe_pos) + reach) / width)
    # the probes' keys get names of their own: both sides may come from one table
    own = {k: f"__probe_{k}" for k in keys}
    dealt = probes.select(*(F.col(c).alias(own.get(c, c)) for c in probes.columns)).withColumn("__dealt", F.explode(F.sequence(low, high)))
    keyed = lines.withColumn(BUCKET, F.floor(F.col(line_pos) / width))
    on: Column = F.col(BUCKET) == F.col("__dealt")
    for k, name in own.items():
        on &= F.col(k) == F.col(name)
    on &= F.col(line_pos).between(F.col(probe_pos) - reach, F.col(probe_pos) + reach)
    return keyed.join(dealt, on, how).drop(BUCKET, "__dealt", *own.values())


def nearest(pairs: DataFrame, by: Sequence[str], distance: Column, tie: Column, take: Sequence[str]) -> DataFrame:
    """Of the pairs of each group, the one of least distance; the lesser tie wins. An aggregation, so no group is held."""
    best = F.min_by(F.struct(*take), F.struct(distance, tie))
    return pairs.groupBy(*by).agg(best.alias("__best")).select(*by, "__best.*")


PAIRS_A_TASK = 4_000_000


def by_phase(lines: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a comparison of all patterns with all phases, made so that its pairs stay in the task of their phase.

    The pairs grow with the product of both sides. lines are dealt by entry_id into so many parts that one has at most some
    PAIRS_A_TASK pairs of a phase and a pattern; probes, few as they are those of the query set, are broadcast below a bound.
    Aggregations by pattern and phase need no shuffle then: disk grows with the lines only.
    """
    probes = written(probes)
    pairs = lines.select("entry_id").distinct().count() * probes.select("pattern_id").distinct().count()
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(least, -(-pairs // PAIRS_A_TASK)), "entry_id"), bounded_broadcast(probes)
