"""Readers of trace files, measured references, card dumps and entry dumps, as column work over lines and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".xy", ".dat", ".csv", ".asc", ".raw", ".mdi")


def scan_lines(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, entry_id, series_name, line_no, line) of all files below folder with one of the suffixes.

    entry_id is the path below folder; series_name its first folder, or empty for files in the root itself.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.lit(False)
    for s in suffixes:
        wanted |= name.endswith(s)
    entry = F.substring_index(F.col("path"), folder.rstrip("/").split("://")[-1] + "/", -1)
    rows = files.where(wanted).select("path", entry.alias("entry_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows.withColumn("series_name", F.when(F.col("entry_id").contains("/"), F.substring_index("entry_id", "/", 1)).otherwise("")).select("path", "entry_id", "series_name", "line_no", "line")


def is_reference_file(name: Column) -> Column:
    """Measured-reference files: data suffixes, neither readme nor license."""
    low = F.lower(name)
    return low.rlike(r"\.(xy|txt|dat|csv)$") & ~low.contains("readme") & ~low.contains("license")


def numeric_columns(line: Column) -> Column:
    """The numbers that a line begins with, by its own delimiter; empty for blank and comment lines."""
    text = F.trim(line)
    mixed = F.split(text, r"[,\s;]+")
    by = lambda sep: F.transform(F.split(text, sep), lambda t: F.replace(F.trim(t), F.lit(","), F.lit(".")))
    spaced = F.split(F.replace(text, F.lit(","), F.lit(".")), r"\s+")
    tokens = F.when(text.contains(",") & text.contains("."), mixed).when(text.contains(";"), by(";")).when(text.contains("\t"), by("\t")).otherwise(spaced)
    numbers = F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")))
    bad = F.array_position(F.transform(numbers, lambda v: v.isNull().cast("int")), 1)
    prefix = F.when(bad > 0, F.slice(numbers, F.lit(1), (bad - 1).cast("int"))).otherwise(numbers)
    return F.when(text.rlike("^(#|!|//)") | (text == ""), F.array().cast("array<double>")).otherwise(prefix)


def xy_points(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, i, x, y) of lines (file, line_no, line) with two numbers or more."""
    found = lines.withColumn("__v", numeric_columns(F.col("line"))).where(F.size("__v") >= 2)
    i = F.row_number().over(Window.partitionBy(file).orderBy("line_no")) - 1
    return found.select(file, i.alias("i"), F.get("__v", F.lit(0)).alias("x"), F.get("__v", F.lit(1)).alias("y"))


def header_value(text: Column, keys: list[str]) -> Column:
    """The value of the first of the keys that a header line gives; empty without one."""
    found = [F.regexp_extract(F.substring(text, 1, 8000), rf"(?im)^\s*[#;!/\s]*{k}\s*[:=][ \t]*(\S.*?)\s*$", 1) for k in keys]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))


def mineral_name(path: Column) -> Column:
    """Mineral name of a file name: what stands before a double underscore, underscores as spaces."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.trim(F.replace(F.regexp_extract(stem, "^(.*?)(__|$)", 1), F.lit("_"), F.lit(" ")))


def card_summary(record: Column) -> Column:
    """struct(entry_id, name, formula, chemical_name, quality) of a card-summary record; null if it has no card number."""
    tail = r"\s+([0-9]{1,2})-\s*([0-9]+)\s*([A-Za-z]*)\s*$"
    part = lambda i: F.regexp_extract(record, tail, i)
    prefix = F.rtrim(F.regexp_replace(record, tail, ""))
    chemical = F.when(prefix.contains("/"), F.trim(F.substring_index(prefix, "/", 1))).otherwise("")
    rest = F.when(prefix.contains("/"), F.trim(F.regexp_replace(prefix, "^[^/]*/", ""))).otherwise(prefix)
    formula = F.regexp_extract(rest, r"\s{2,}([^\s](?:(?!\s{2,}).)*[0-9](?:(?!\s{2,}).)*)$", 1)
    formula = F.when(formula.rlike("[A-Z]"), F.trim(formula)).otherwise("")
    name = F.when(formula != "", F.trim(F.regexp_replace(F.regexp_replace(rest, r"\s{2,}\S(?:(?!\s{2,}).)*$", ""), r"\s{2,}", " "))).otherwise(F.trim(rest))
    number = F.format_string("%s-%03d-%04d", F.when(part(3).contains("C"), "01").otherwise("00"), part(1).try_cast("int"), part(2).try_cast("long"))
    return F.when(part(1) != "", F.struct(number.alias("entry_id"), name.alias("name"), formula.alias("formula"), chemical.alias("chemical_name"), part(3).alias("quality")))


def card_lines(payload: Column, most: int = 250) -> Column:
    """Array of struct(d, intensity) of a tagged payload: positive ones, intensity at most 100, `most` at most."""
    pattern = r"((?:[0-9]+\.[0-9]{5}|\.[0-9]{6}))\s*([0-9]{1,3})"
    pairs = F.arrays_zip(F.regexp_extract_all(payload, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(payload, F.lit(pattern), F.lit(2)).alias("intensity"))
    lines = F.transform(pairs, lambda p: F.struct(p["d"].cast("double").alias("d"), F.least(p["intensity"].cast("double"), F.lit(100.0)).alias("intensity")))
    return F.slice(F.filter(lines, lambda p: (p["d"] > 0) & (p["intensity"] > 0)), 1, most)


#: Fields by source, the first that is present and not empty wins (fixed values).
FIELDS = {
    "COD": {"entry_id": ("file", "cod_id", "id"), "formula": ("formula", "formula_sum"), "name": ("chemical_name_common", "name", "chemical_name_systematic", "mineral", "mineral_name"), "spacegroup": ("sg", "spacegroup", "space_group_name_H-M_alt")},
    "AFLOW": {"entry_id": ("auid", "aurl", "compound"), "formula": ("compound", "formula"), "name": ("compound", "formula"), "spacegroup": ("spacegroup_relax", "spacegroup_orig")},
    "OQMD": {"entry_id": ("entry_id", "id", "name"), "formula": ("composition", "formula", "name"), "name": ("composition", "formula", "name"), "spacegroup": ("spacegroup", "spacegroup_symbol")},
}


def entries(records: DataFrame) -> DataFrame:
    """(source, entry_id, formula, name, spacegroup) of JSON records (source, record); records without an id go."""
    parts = None
    for source, fields in FIELDS.items():
        get = lambda names: F.coalesce(*(F.nullif(F.trim(F.get_json_object("record", f"$['{n}']")), F.lit("")) for n in names), F.lit(""))
        own = records.where(F.col("source") == source).select("source", *(get(names).alias(f) for f, names in fields.items())).where("entry_id <> ''")
        if source == "OQMD":
            own = own.withColumn("entry_id", F.when(F.lower("entry_id").startswith("oqmd"), F.col("entry_id")).otherwise(F.concat(F.lit("oqmd-"), "entry_id")))
        own = own.withColumn("name", F.when(F.col("name") == "", F.when(F.col("formula") != "", F.col("formula")).otherwise(F.col("entry_id"))).otherwise(F.col("name")))
        parts = own if parts is None else parts.unionByName(own)
    return parts
