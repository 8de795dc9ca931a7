"""Peak search of a phase library for many patterns at once, and the filters and orders around it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.ranges import range_join
from peakloom.operators.storage import bounded_broadcast, written


@dataclass(frozen=True)
class SearchPolicy:
    """Constants of the peak search (fixed values)."""

    tolerance: float = 0.35
    anchors: int = 10
    most_queries: int = 80
    anchor_low: float = 5.0
    anchor_high: float = 60.0
    top_ranks: int = 10
    overfetch: int = 3


def ranked_library(peaks: DataFrame, policy: SearchPolicy = SearchPolicy()) -> DataFrame:
    """Adds norm_intensity and top_rank (1..10 by intensity within 5-60 degrees, the higher index first among equals)."""
    own = Window.partitionBy("entry_id")
    eligible = F.col("two_theta").between(policy.anchor_low, policy.anchor_high) & (F.col("intensity") > 0)
    rank = F.row_number().over(own.orderBy(eligible.desc(), F.desc("intensity"), F.desc("peak_index")))
    largest = F.max(F.greatest("intensity", F.lit(0.0))).over(own)
    return peaks.withColumn("norm_intensity", F.when(largest > 0, F.greatest("intensity", F.lit(0.0)) / largest).otherwise(0.0)).withColumn("top_rank", F.when(eligible & (rank <= policy.top_ranks), rank))


def query_plan(observed: DataFrame, policy: SearchPolicy = SearchPolicy()) -> DataFrame:
    """(pattern_id, q, position, query_weight, anchor_weight): anchors first, then the others, at most 80 a pattern."""
    own = Window.partitionBy("pattern_id")
    inside = F.col("two_theta").between(policy.anchor_low, policy.anchor_high)
    marked = observed.withColumn("__in", inside.cast("int")).withColumn("__nth", F.sum("__in").over(own.orderBy("peak_id")))
    anchor = (F.col("__in") == 1) & (F.col("__nth") <= policy.anchors)
    marked = marked.withColumn("__anchor", anchor).withColumn("__key", F.round("two_theta", 5))
    taken = F.max(F.col("__anchor").cast("int")).over(Window.partitionBy("pattern_id", "__key"))
    marked = marked.withColumn("__taken", taken).where(F.col("__anchor") | (F.col("__taken") == 0))
    ranked = marked.withColumn("q", F.row_number().over(own.orderBy(F.col("__anchor").desc(), "peak_id")) - 1)
    return ranked.where(F.col("q") < policy.most_queries).select(
        "pattern_id", "q", F.col("two_theta").alias("position"), (1 / F.sqrt(F.col("q") + 1)).alias("query_weight"), F.col("__anchor").cast("int").alias("anchor_weight")
    )


def _marked(library: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with the position of the line before in their phase, query positions with the one before in their pattern."""
    lines = library.select("entry_id", "peak_index", "two_theta", "intensity", "norm_intensity", "top_rank")
    lines = lines.withColumn("line_before", F.lag("two_theta").over(Window.partitionBy("entry_id").orderBy("two_theta", "peak_index")))
    plan = plan.withColumn("position_before", F.lag("position").over(Window.partitionBy("pattern_id").orderBy("position", "q")))
    return lines, plan


def _metrics(pairs: DataFrame, tolerance: float, policy: SearchPolicy) -> DataFrame:
    """One aggregation of pairs, with partial sums before the shuffle.

    The positions near a line are neighbours in their pattern, and so are the lines near a position in their phase. A
    pair counts for its line where the position before is not near it, too, and for its position where the line before is
    not: distinct counts are sums.
    """
    support = F.greatest("norm_intensity", F.lit(0.0))
    strong = ((F.col("anchor_weight") > 0) & F.coalesce(F.col("top_rank").between(1, policy.top_ranks), F.lit(False))).cast("int")
    new_line = F.coalesce(F.col("two_theta") > F.col("position_before") + tolerance, F.lit(True))
    new_position = F.coalesce(F.col("line_before") < F.col("position") - tolerance, F.lit(True))
    total = lambda c: F.round(F.sum(c), 6)
    return pairs.groupBy("pattern_id", "entry_id").agg(
        F.sum(new_position.cast("long")).alias("observed_hits"), F.sum(new_line.cast("long")).alias("peak_hits"),
        F.round(F.min(F.abs(F.col("two_theta") - F.col("position"))), 6).alias("best_delta"), F.sum("anchor_weight").alias("anchor_hits"), F.sum(strong).alias("strong_anchor_hits"),
        total(F.col("anchor_weight") * support).alias("anchor_intensity_support"), total("query_weight").alias("weighted_observed_hits"),
        total(F.col("query_weight") * support).alias("weighted_intensity_support"), total(F.greatest("intensity", F.lit(0.0))).alias("matched_intensity"),
    )


def search_metrics(library: DataFrame, plan: DataFrame, policy: SearchPolicy = SearchPolicy(), candidates: DataFrame | None = None) -> DataFrame:
    """Per pattern and phase: the hit counts and supports of the peaks within the tolerance of a query position.

    candidates (pattern_id, entry_id), if given, are the only pairs that are compared.
    """
    tolerance = max(policy.tolerance, 0.02)
    lines, plan = _marked(library, plan)
    plan = bounded_broadcast(plan)  # lines stay where their phase is: the pairs are not shuffled
    if candidates is None:
        return _metrics(range_join(lines, plan, "two_theta", "position", tolerance), tolerance, policy)
    return _metrics(range_join(lines.join(candidates, "entry_id"), plan, "two_theta", "position", tolerance, ["pattern_id"]), tolerance, policy)


PHASES_A_BLOCK, PATTERNS_A_BLOCK, BLOCKS_A_TASK = 1024, 4096, 16


def _blocked(rows: DataFrame, key: str, size: int, value: Column, name: str) -> DataFrame:
    """One row for about `size` keys: the array of their values. Blocks are dealt to tasks by their number."""
    blocks = max(1, -(-rows.select(key).distinct().count() // size))
    dealt_ = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return dealt_.repartition(max(1, -(-blocks // BLOCKS_A_TASK)), "__block").groupBy("__block").agg(F.collect_list(value).alias(name)).drop("__block")


def _block_hits(row: pa.StructScalar, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, patterns, bars, hits) of one pair of blocks: hits[i, j] counts the pairs of phase i's lines and pattern j's anchors."""
    phases, anchors = row["phases"].values, row["anchors"].values
    places, at = phases.field("places"), anchors.field("position").to_numpy()
    order = np.argsort(at, kind="stable")
    patterns, first, owner = np.unique(anchors.field("pattern_id").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    at, owner = at[order], owner[order]
    lines, ends = places.flatten().to_numpy(), np.cumsum(places.value_lengths().to_numpy())
    low, high = np.searchsorted(at + tolerance, lines, "left"), np.searchsorted(at - tolerance, lines, "right")
    hits = np.empty((len(ends), len(patterns)), np.uint8)
    start = 0
    for i, end in enumerate(ends):
        near = np.concatenate([owner[a:b] for a, b in zip(low[start:end], high[start:end], strict=True)])
        hits[i], start = np.bincount(near, minlength=len(patterns)), end
    return phases.field("entry_id"), patterns, anchors.field("bar").to_numpy()[first], hits


def strong_candidates(library: DataFrame, plan: DataFrame, most: int, policy: SearchPolicy = SearchPolicy()) -> DataFrame:
    """(pattern_id, entry_id, enough) of the phases that can be among the `most` best of a pattern.

    The first key of the order is the number of strong anchor hits, which needs the ten top lines of a phase and the
    ten anchors of a pattern only. A phase with fewer hits than the one of rank `most` is behind it whatever its other
    keys are; phases that tie with it stay. enough is false where the pattern has fewer than `most` such phases, so
    phases without a strong hit count as well.

    Hits of all patterns with all phases are counted by blocks of both, inside tasks, and never written: one pass counts how
    many phases have how many hits, by pattern; then the bar of each pattern is known, and a second pass returns the phases that
    reach it. What is shuffled are the lines and the counts, not the pairs.
    """
    tolerance = max(policy.tolerance, 0.02)
    lines = library.where(F.col("top_rank").isNotNull()).groupBy("entry_id").agg(F.collect_list("two_theta").alias("places"))
    phases = written(_blocked(lines, "entry_id", PHASES_A_BLOCK, F.struct("entry_id", "places"), "phases"))
    anchors = plan.where("anchor_weight > 0").select("pattern_id", "position")
    own = f"pattern_id {plan.schema['pattern_id'].dataType.simpleString()}"

    def pairs(bars: DataFrame) -> DataFrame:
        packed = _blocked(bars, "pattern_id", PATTERNS_A_BLOCK, F.struct("pattern_id", "position", "bar"), "anchors")
        return phases.crossJoin(F.broadcast(packed))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for row in batch.to_struct_array():
                _, patterns, _, hits = _block_hits(row, tolerance)
                levels = np.stack([(hits == h).sum(0) for h in range(1, int(hits.max(initial=0)) + 1)] or [np.zeros(len(patterns), int)], 1)
                known = found.get(key := patterns[0])
                wide = max(levels.shape[1], 0 if known is None else known[1].shape[1])
                total = np.zeros((len(patterns), wide), np.int64)
                total[:, : levels.shape[1]] += levels
                if known is not None:
                    total[:, : known[1].shape[1]] += known[1]
                found[key] = patterns, total
                kind = row["anchors"].values.field("pattern_id").type
        for patterns, total in found.values():
            at, level = np.nonzero(total)
            yield pa.record_batch([pa.array(patterns[at], kind), pa.array(level + 1, pa.int32()), pa.array(total[at, level], pa.int64())], ["pattern_id", "hits", "n"])

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                entries, patterns, bars, hits = _block_hits(row, tolerance)
                i, j = np.nonzero(hits >= bars)
                yield pa.record_batch([pa.array(patterns[j], row["anchors"].values.field("pattern_id").type), entries.take(pa.array(i))], ["pattern_id", "entry_id"])

    sizes = pairs(anchors.withColumn("bar", F.lit(1))).mapInArrow(counted, f"{own}, hits int, n long").groupBy("pattern_id", "hits").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("pattern_id").orderBy(F.desc("hits")))
    bars = sizes.withColumn("above", above).groupBy("pattern_id").agg(F.coalesce(F.max(F.when(F.col("above") >= most, F.col("hits"))), F.lit(1)).alias("bar"), (F.max("above") >= most).alias("enough"))
    bars = written(bars)
    best = pairs(anchors.join(bars, "pattern_id")).mapInArrow(reaching, f"{own}, entry_id string")
    return best.join(bars.select("pattern_id", "enough"), "pattern_id").select("pattern_id", "entry_id", "enough")


ORDER = (
    F.desc, ("strong_anchor_hits", "anchor_intensity_support", "anchor_hits", "weighted_intensity_support", "weighted_observed_hits", "observed_hits", "peak_hits", "matched_intensity"),
)


def candidate_order() -> list[Column]:
    """The ten keys by which candidates are ranked, and the entry last."""
    desc, names = ORDER
    return [*(desc(n) for n in names), F.asc("best_delta"), F.desc("updated_rank"), F.asc("entry_id")]


def crystal_key(cell_names: tuple[str, ...] = ("a", "b", "c", "alpha", "beta", "gamma")) -> Column:
    """Duplicate key of a phase: normalised formula, space group and rounded cell; an entry without a cell is its own."""
    from peakloom.functions.chemistry import cell_volume, normalize_formula, normalize_text

    a, b, c, al, be, ga = cell_names
    numbers = [*(F.round(F.col(x), 2).cast("string") for x in (a, b, c)), *(F.round(F.col(x), 1).cast("string") for x in (al, be, ga)), F.round(cell_volume(), 1).cast("string")]
    whole = F.concat_ws("|", normalize_formula(F.col("formula")), normalize_text(F.col("spacegroup")), *numbers)
    complete = F.lit(True)
    for x in cell_names:
        complete &= F.col(x).isNotNull()
    return F.when(complete, whole).otherwise(F.concat_ws("|", F.lit("unique"), "source", "entry_id"))


def search_by_peaks(observed: DataFrame, peaks: DataFrame, phases: DataFrame, limit: int = 20, policy: SearchPolicy = SearchPolicy(), library: DataFrame | None = None) -> DataFrame:
    """The `limit` best phases of every pattern: preselection, metrics, ten-key order, overfetch, crystallographic dedupe, cut.

    The metrics are computed for the phases that can be among the best; for patterns with few of these, for all. library, if
    given, is ranked_library(peaks) as a stored table. The plan and the preselection are written once, as both branches read them.
    """
    library = ranked_library(peaks, policy) if library is None else library
    plan = written(query_plan(observed, policy))
    able = written(strong_candidates(library, plan, policy.overfetch * limit, policy))
    chosen = able.where("enough").select("pattern_id", "entry_id")
    rest = plan.join(chosen.select("pattern_id").distinct(), "pattern_id", "left_anti")
    metrics = search_metrics(library, plan, policy, chosen)
    if not rest.isEmpty():
        metrics = metrics.unionByName(search_metrics(library, rest, policy))
    rows = metrics.join(phases.select("entry_id", "updated_rank"), "entry_id")
    own = Window.partitionBy("pattern_id").orderBy(*candidate_order())
    first = rows.withColumn("r", F.row_number().over(own)).where(F.col("r") <= policy.overfetch * limit)
    first = first.join(phases.drop("updated_rank"), "entry_id").withColumn("k", crystal_key())
    unique = first.withColumn("d", F.row_number().over(Window.partitionBy("pattern_id", "k").orderBy("r"))).where("d = 1")
    cut = unique.withColumn("rank", F.row_number().over(Window.partitionBy("pattern_id").orderBy("r"))).where(F.col("rank") <= limit)
    return cut.drop("r", "d", "k")


# -- filters -------------------------------------------------------------------------------------------------


def with_all(elements: Column, required: list[str]) -> Column:
    """True where every required element is among elements."""
    return F.size(F.array_except(F.array(*(F.lit(x) for x in required)), elements)) == 0


def with_none(elements: Column, excluded: list[str]) -> Column:
    """True where no excluded element is among elements."""
    return ~F.arrays_overlap(elements, F.array(*(F.lit(x) for x in excluded)))


def exclude_others(elements: Column, required: list[str], optional: list[str]) -> Column:
    """True where nothing but required and optional elements occurs; without required ones nothing is excluded."""
    if not required:
        return F.lit(True)
    return F.size(F.array_except(elements, F.array(*(F.lit(x) for x in [*required, *optional])))) == 0


def text_search(text: str, columns: list[str], formula_key: Column) -> Column:
    """LIKE over the columns in lower case; wildcards of the user stay wildcards, the formula key drops white space."""
    low = text.strip().lower()
    found = formula_key.like(f"%{''.join(low.split())}%")
    for c in columns:
        found |= F.lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{low}%")
    return found


def material_allowed(elements: Column, organic: bool = True, inorganic: bool = True) -> Column:
    """Organic phases hold both C and H."""
    is_organic = F.array_contains(elements, "C") & F.array_contains(elements, "H")
    return F.when(is_organic, F.lit(organic)).otherwise(F.lit(inorganic))


def dedupe_rows(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
