"""Maintenance of the phase library and of results: upserts, index replacement, symmetry, catalogues, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.arrays import fixed
from peakloom.operators.storage import dealt

KEY = ["source", "entry_id"]


def upsert(old: DataFrame, new: DataFrame, keep: list[str], order: str) -> DataFrame:
    """new over old by (source, entry_id); where new has null in a column of keep, the old value stays.

    Of several new rows of a key the last by `order` wins.
    """
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    o, n = old.alias("o"), last.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer")
    fresh = F.col("n.entry_id").isNotNull()
    cols = [F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return joined.select(*cols)


def insert_absent(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those rows of new whose key it lacks, one a key."""
    return old.unionByName(new.join(old, KEY, "left_anti").dropDuplicates(KEY).select(*old.columns))


def replace_rows(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all rows of the keys in fresh replaced by those of fresh."""
    return index.join(fresh.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh)


def peaks_json(peaks: DataFrame, size: int = 300) -> DataFrame:
    """(entry_id, peaks_json) with all peaks by index: a row for each `size` indexes of a phase, so that no text grows with it."""
    one = F.struct("peak_index", F.round("two_theta", 5).alias("two_theta"), F.round("intensity", 4).alias("intensity"), "h", "k", "l")
    packed = peaks.groupBy("entry_id", F.floor(F.col("peak_index") / size).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("p"))
    return packed.select("entry_id", F.to_json("p").alias("peaks_json"))


def peak_rows(phases: DataFrame) -> DataFrame:
    """Index rows of (entry_id, peaks_json): malformed texts and peaks without a finite position are skipped."""
    kind = "array<struct<peak_index:int,two_theta:double,intensity:double,h:int,k:int,l:int>>"
    rows = phases.select("entry_id", F.explode(F.from_json("peaks_json", kind)).alias("p")).select("entry_id", "p.*")
    return rows.where("two_theta IS NOT NULL AND NOT isnan(two_theta)").withColumn("intensity", F.greatest("intensity", F.lit(0.0)))


def parse_symop(op: Column) -> Column:
    """Array of three struct(x, y, z, t): integer coefficients and the shift of each component of 'x,y,z' text."""
    parts = F.split(F.lower(F.regexp_replace(op, r"['\"\s]", "")), ",")

    def one(p: Column) -> Column:
        signed = lambda c: F.coalesce(F.when(F.regexp_extract(p, rf"([+-]?){c}", 0) == "", 0).when(F.regexp_extract(p, rf"([+-]?){c}", 1) == "-", -1).otherwise(1), F.lit(0))
        top, bottom = F.regexp_extract(p, r"([+-]?[0-9]+)/([0-9]+)", 1).try_cast("double"), F.regexp_extract(p, r"([+-]?[0-9]+)/([0-9]+)", 2).try_cast("double")
        plain = F.regexp_extract(p, r"(?:^|[^/0-9.])([+-]?[0-9]*\.[0-9]+)", 1).try_cast("double")
        return F.struct(signed("x").alias("x"), signed("y").alias("y"), signed("z").alias("z"), F.coalesce(top / F.nullif(bottom, F.lit(0.0)), plain, F.lit(0.0)).alias("t"))

    return F.transform(parts, one)


def expand_atoms(atoms: DataFrame, symops: DataFrame) -> DataFrame:
    """Distinct images of atoms (entry_id, element, x, y, z) under symops (entry_id, op), within [0, 1), at five digits."""
    # both are rows of some bytes, but parsing and images are work
    atoms, symops = dealt(atoms, "entry_id"), dealt(symops.select("entry_id", "op"), "entry_id")
    ops = fixed(symops, m=parse_symop(F.col("op"))).where(F.size("m") == 3).select("entry_id", "m")

    def image(i: int) -> Column:
        r = F.col("m")[i]
        v = r["x"] * F.col("x") + r["y"] * F.col("y") + r["z"] * F.col("z") + r["t"]
        w = F.round(v - F.floor(v), 5)
        return F.when(w >= 1, 0.0).otherwise(w)

    rows = atoms.join(ops, "entry_id").select("entry_id", "element", image(0).alias("x"), image(1).alias("y"), image(2).alias("z"))
    return rows.dropDuplicates(["entry_id", "element", "x", "y", "z"])


def unique_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Adds unique_name: the first of equal names (by case) as it is, the others with ' (2)', ' (3)', ..."""
    n = F.row_number().over(Window.partitionBy(group, F.lower(F.trim(name))).orderBy(order))
    base = F.when(F.trim(name) == "", F.lit("Series")).otherwise(F.trim(name))
    return rows.withColumn("unique_name", F.when(n == 1, base).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"))))


def memberships(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """Of claims (series_no, object_id), those on existing objects, the first series of an object alone."""
    live = claims.join(existing, "object_id", "left_semi")
    return live.withColumn("__n", F.row_number().over(Window.partitionBy("object_id").orderBy("series_no"))).where("__n = 1").drop("__n")


def link_cascade(phases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(phase_id, candidate_id): by entry id, else by path, else by name and formula; the least candidate of several."""

    def by(keys: list[str], name: str) -> DataFrame:
        return candidates.where(F.concat(*(F.coalesce(k, F.lit("")) for k in keys)) != "").groupBy(*keys).agg(F.min("candidate_id").alias(name))

    out = phases.join(by(["entry_id"], "c1"), "entry_id", "left").join(by(["path"], "c2"), "path", "left").join(by(["name", "formula"], "c3"), ["name", "formula"], "left")
    return out.select("phase_id", F.coalesce("c1", "c2", "c3").alias("candidate_id"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON, in the order given; parts of integers and text have one spelling only."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


# -- results -------------------------------------------------------------------------------------------------


def phase_catalogue(phases: DataFrame) -> DataFrame:
    """One row a phase_id of result phases (pattern_id, phase_id, name, formula, source, source_id): that of the least pattern."""
    one = F.min_by(F.struct("name", "formula", "source", "source_id"), F.struct("pattern_id", "name"))
    return phases.groupBy("phase_id").agg(one.alias("p")).select("phase_id", "p.*")


def result_snapshots(phases: DataFrame, fits: DataFrame, unknown: DataFrame) -> DataFrame:
    """(pattern_id, phases, fit, unknown_peaks): a nested row a pattern, phases by id and unknown peaks by position."""
    own = phases.groupBy("pattern_id").agg(F.array_sort(F.collect_set(F.struct("phase_id", "fraction_percent"))).alias("phases"))
    rest = unknown.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("two_theta", "height"))).alias("unknown_peaks"))
    rows = fits.join(own, "pattern_id", "left").join(rest, "pattern_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select("pattern_id", empty("phases", kinds["phases"]).alias("phases"), F.struct("fit_percent").alias("fit"), empty("unknown_peaks", kinds["unknown_peaks"]).alias("unknown_peaks"))


def canonical(value: Column) -> Column:
    """A number's one spelling: whole numbers without a point, others with six digits at most and no trailing zeros."""
    text = F.format_string("%.6f", F.round(value.cast("double"), 6))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def result_hash(snapshots: DataFrame) -> DataFrame:
    """Adds result_sha256, of what a result says and nothing else: phases, fractions, fit and unknown peaks in canonical spelling."""
    parts = F.transform("phases", lambda p: F.concat_ws("=", p["phase_id"], F.coalesce(canonical(p["fraction_percent"]), F.lit("null"))))
    peaks = F.transform("unknown_peaks", lambda p: F.concat_ws("@", canonical(p["height"]), canonical(p["two_theta"])))
    text = F.concat_ws("|", F.col("pattern_id").cast("string"), F.array_join(parts, ","), canonical(F.col("fit.fit_percent")), F.array_join(peaks, ","))
    return snapshots.withColumn("result_sha256", F.sha2(text, 256))


def revised(current: DataFrame, previous: DataFrame, revision: str) -> DataFrame:
    """(pattern_id, result_sha256, revision_id): the previous revision where the hash is unchanged, else the new one."""
    old = previous.select("pattern_id", F.col("result_sha256").alias("__h"), F.col("revision_id").alias("__r"))
    kept = F.when(F.col("result_sha256") == F.col("__h"), F.col("__r")).otherwise(F.lit(revision))
    return current.join(old, "pattern_id", "left").select("pattern_id", "result_sha256", kept.alias("revision_id"))


def series_report(members: DataFrame, cells: DataFrame) -> DataFrame:
    """(series_id, place, pattern_id, a, change): fitted cells in the order of a series, and the change from the one before."""
    w = Window.partitionBy("series_id").orderBy("sample", "pattern_id")
    rows = members.join(cells, "pattern_id").withColumn("place", F.row_number().over(w))
    return rows.select("series_id", "place", "pattern_id", "a", (F.col("a") - F.lag("a").over(w)).alias("change"))
