"""Candidate rows: one shape for rows of all sources, names, filters, unions by tier, links and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.chemistry import element_query_tokens, formula_elements, normalize_formula
from peakloom.operators.search import dedupe_rows, material_allowed, with_all, with_none

ROW = ("source", "entry_id", "formula", "name", "spacegroup", "note", "gain", "text")
#: Where each of the eight columns lies in a row of so many fields; None is empty (fixed values). Shorter rows are padded.
SHAPES = {
    10: (1, 2, 3, 4, None, 8, None, 9),
    8: (0, 1, 2, 3, 4, 5, 6, 7),
    7: (0, 1, 2, 3, 4, 5, None, 6),
    6: (0, 1, 2, 3, None, 4, None, 5),
    5: (None, None, None, 4, None, None, None, None),
}


def normalise_row(row: Column) -> Column:
    """struct of the eight columns of a row, an array of 0 to 10 or more fields."""
    n = F.size(row)
    shape = F.when(n >= 10, 10).when(n >= 8, 8).when(n == 7, 7).when(n == 6, 6).when(n == 5, 5).otherwise(8)
    field = lambda i: F.coalesce(F.get(row, F.lit(i)), F.lit(""))
    cols = []
    for k, name in enumerate(ROW):
        at = F.lit("")
        for length, places in SHAPES.items():
            if places[k] is not None:
                at = F.when(shape == length, field(places[k])).otherwise(at)
        cols.append(at.alias(name))
    return F.struct(*cols)


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def best_formula(own: Column, given: Column) -> Column:
    """The formula that came with the record, else that of the structure."""
    return F.coalesce(F.nullif(_clean(given), F.lit("")), _clean(own))


def best_name(own: Column, given: Column, formula: Column, entry_id: Column) -> Column:
    """The name that came with the record, else that of the structure unless it spells the formula, else formula or id."""
    spelled = F.when(normalize_formula(_clean(own)) != normalize_formula(formula), _clean(own))
    return F.coalesce(F.nullif(_clean(given), F.lit("")), F.nullif(spelled, F.lit("")), F.nullif(_clean(formula), F.lit("")), entry_id)


def holds_element(elements: Column, element: str) -> Column:
    """True where the space-joined element list holds the element as a whole token."""
    return F.array_contains(F.split(F.trim(elements), r"\s+"), element)


def allowed_rows(rows: DataFrame, excluded: list[str], allowed: Column | None = None) -> DataFrame:
    """Candidate rows without excluded elements and of allowed material classes; rows without a formula stay.

    allowed is a predicate over the columns of rows, the caller's own; by default every class is allowed.
    """
    known = F.coalesce(F.col("formula"), F.lit("")) != ""
    elements = formula_elements(F.col("formula"))
    fine = (with_none(elements, excluded) if excluded else F.lit(True)) & (F.lit(True) if allowed is None else allowed)
    return rows.where(~known | fine)


def complete_searches(results: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The searches whose results are fewer than the limit, so that nothing was cut off: (keys, n)."""
    return results.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < limit)


#: Cards come first, then the local cache, then other sources (fixed values).
PRIORITY = {"CARD": 0, "USER": 1, "CCDC": 1, "COD": 1}


def by_priority(*parts: DataFrame) -> DataFrame:
    """Candidate rows of several sources in one table, with the priority of their source."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rank = F.lit(2)
    for source, p in PRIORITY.items():
        rank = F.when(F.col("source") == source, p).otherwise(rank)
    return whole.withColumn("priority", rank)


BROAD = ("USER", "CCDC", "COD")


def searched_sources(source: Column, elements: list[str]) -> Column:
    """Without elements a search is broad and keeps to experimental sources; with some, all sources take part."""
    return F.lit(True) if elements else source.isin(*BROAD)


def lookup(phases: DataFrame, keys: DataFrame) -> DataFrame:
    """Phases by cache ids (column cache_id): SOURCE:ID, or a bare id of COD."""
    cut = F.col("cache_id").contains(":")
    wanted = keys.select(F.when(cut, F.substring_index("cache_id", ":", 1)).otherwise("COD").alias("source"), F.when(cut, F.expr("substr(cache_id, instr(cache_id, ':') + 1)")).otherwise(F.col("cache_id")).alias("entry_id"))
    return phases.join(wanted.distinct(), ["source", "entry_id"], "left_semi")


def add_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """links (pattern_id, phase_id) and those of wanted that are not there yet, each once."""
    return links.unionByName(wanted.distinct().join(links, ["pattern_id", "phase_id"], "left_anti"))


def with_overrides(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds structure: that of overrides (key, structure) under the entry id, else under SOURCE:entry_id, else null."""
    own = overrides.select(F.col("key").alias("k1"), F.col("structure").alias("s1"))
    named = overrides.select(F.col("key").alias("k2"), F.col("structure").alias("s2"))
    rows = candidates.join(own, F.col("entry_id") == F.col("k1"), "left")
    rows = rows.join(named, F.concat(F.upper(F.coalesce("source", F.lit(""))), F.lit(":"), "entry_id") == F.col("k2"), "left")
    return rows.withColumn("structure", F.coalesce("s1", "s2")).drop("k1", "k2", "s1", "s2")


def final_ranking(rows: DataFrame, window: int = 120) -> DataFrame:
    """Adds place: by gain, then match, both falling, then input order, within the first `window` rows of a pattern; the rest follows in input order."""
    own = Window.partitionBy("pattern_id")
    tail = (F.row_number().over(own.orderBy("input_order")) > window).cast("int")
    rows = rows.withColumn("__tail", tail)
    inside = F.col("__tail") == 0
    order = [F.col("__tail"), F.when(inside, F.coalesce("gain", F.lit(0.0))).desc(), F.when(inside, F.col("match")).desc(), F.col("input_order")]
    return rows.withColumn("place", F.row_number().over(own.orderBy(*order))).drop("__tail")


def search_candidates(phases: DataFrame, query: str, excluded: list[str], limit: int, allow_organic: bool = True) -> DataFrame:
    """Candidates of a query text: its elements if it is nothing but elements, else a text search; newest first within a priority.

    Rows of a source with excluded elements or of a class that is not allowed go; equal rows (by the first four columns,
    without case and outer space) count once.
    """
    elements = [r for r in phases.sparkSession.range(1).select(element_query_tokens(F.lit(query)).alias("e")).first().e]
    e = formula_elements(F.col("formula"))
    low = query.strip().lower()
    found = with_all(e, elements) if elements else F.lower("name").contains(low) | F.lower("formula").contains(low)
    rows = by_priority(phases.where(found & searched_sources(F.col("source"), elements)))
    rows = allowed_rows(rows, excluded, material_allowed(e, allow_organic, True))
    order = [F.asc("priority"), F.desc("updated_rank"), F.asc("entry_id")]
    unique = dedupe_rows(rows, [F.lower(F.trim(c)) for c in ("source", "entry_id", "formula", "name")], order)
    return unique.orderBy(*order).limit(limit)
