"""From structure files to diffraction lines: reading, symmetry, reflections, structure factors, cell refinement."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.arrays import fixed
from peakloom.functions.chemistry import cell_volume, d_spacing, lorentz_polarisation, two_theta_of_d
from peakloom.functions.scattering import atomic_weight, debye_waller, scattering_factor
from peakloom.operators.fitting import cell_fit
from peakloom.operators.library import expand_atoms, parse_symop
from peakloom.operators.ranges import nearest, range_join
from peakloom.operators.storage import dealt, written

CELL = ("a", "b", "c", "alpha", "beta", "gamma")

# -- structure files -----------------------------------------------------------------------------------------


def number_text(text: Column) -> Column:
    """A number without its uncertainty in brackets; null for . and ? and anything else."""
    return F.regexp_replace(F.trim(text), r"\([0-9]+\)$", "").try_cast("double")


STATE = "struct<mode:string,tag:string,text:string,header:array<string>,rows:array<string>,tags:array<struct<tag:string,value:string>>,loops:array<struct<header:array<string>,rows:array<string>>>>"


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"(?s)^(['\"])(.*)\1$", "$2")


def read_files(files: DataFrame) -> DataFrame:
    """(entry_id, tags, loops) of structure files (entry_id, text), in one pass over their lines.

    tags is an array of (tag in lower case, value), loops one of (header, rows): rows are the lines of a loop's body. A fold over
    the lines is a machine of five modes: outside; wait, behind a tag whose value is on the next line; text, between lines of
    a semicolon; header and body of a loop. A loop ends at an empty line, a tag behind its body, another loop or a data block.
    """
    line = lambda v: F.trim(v)

    def step(s: Column, raw: Column) -> Column:
        t = line(raw)
        change = lambda **kw: F.struct(*(kw.get(f, s[f]).alias(f) for f in ("mode", "tag", "text", "header", "rows", "tags", "loops")))
        word, nothing = F.lit, F.array().cast("array<string>")
        in_loop = s["mode"].isin("header", "body")
        closed = F.when(in_loop, F.array_append(s["loops"], F.struct(s["header"].alias("header"), s["rows"].alias("rows")))).otherwise(s["loops"])
        pair = lambda tag, value: F.array_append(s["tags"], F.struct(F.lower(tag).alias("tag"), value.alias("value")))
        name, rest = F.regexp_extract(t, r"^\S+", 0), F.trim(F.regexp_extract(t, r"^\S+\s*(.*)$", 1))
        return (
            F.when((s["mode"] == "text") & raw.startswith(";"), change(mode=word(""), tags=pair(s["tag"], F.trim(F.regexp_replace(s["text"], r"\s+", " ")))))
            .when(s["mode"] == "text", change(text=F.concat(s["text"], F.lit(" "), t)))
            .when((s["mode"] == "wait") & raw.startswith(";"), change(mode=word("text"), text=F.substr(raw, F.lit(2))))
            .when(F.lower(t) == "loop_", change(mode=word("header"), header=nothing, rows=nothing, loops=closed))
            .when(t.startswith("_") & (s["mode"] == "header"), change(header=F.array_append(s["header"], F.lower(name))))
            .when(t.startswith("_") & (rest == ""), change(mode=word("wait"), tag=name, loops=closed))
            .when(t.startswith("_"), change(mode=word(""), tags=pair(name, _unquoted(rest)), loops=closed))
            .when((t == "") | F.lower(t).startswith("data_"), F.when(in_loop, change(mode=word(""), loops=closed)).otherwise(s))
            .when(t.startswith("#"), s)
            .when(in_loop, change(mode=word("body"), rows=F.array_append(s["rows"], t)))
            .when(s["mode"] == "wait", change(mode=word(""), tags=pair(s["tag"], _unquoted(t))))
            .otherwise(s)
        )

    def end(s: Column) -> Column:
        last = F.struct(s["header"].alias("header"), s["rows"].alias("rows"))
        return F.struct(s["tags"].alias("tags"), F.when(s["mode"].isin("header", "body"), F.array_append(s["loops"], last)).otherwise(s["loops"]).alias("loops"))

    start = F.expr(f"CAST(named_struct('mode', '', 'tag', '', 'text', '', 'header', array(), 'rows', array(), 'tags', array(), 'loops', array()) AS {STATE})")
    folded = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\r?\n"), start, step, end)
    return fixed(files.select("entry_id", "text"), f=folded).select("entry_id", "f.tags", "f.loops")


def tag_value(tag: str) -> Column:
    """The first value of a tag of a read file; empty without one, and for . and ?."""
    found = F.coalesce(F.get(F.filter("tags", lambda x: x["tag"] == tag.lower()), F.lit(0))["value"], F.lit(""))
    return F.when(found.isin(".", "?"), "").otherwise(found)


def first_value(tags: list[str]) -> Column:
    """The first of several tags that has a value."""
    return F.coalesce(*(F.nullif(tag_value(t), F.lit("")) for t in tags), F.lit(""))


def structures(parsed: DataFrame) -> DataFrame:
    """(entry_id, formula, name, spacegroup, number, a..gamma, volume) of read files."""
    cell = [number_text(tag_value(f"_cell_{kind}_{n}")).alias(n) for n, kind in zip(CELL, ("length",) * 3 + ("angle",) * 3, strict=True)]
    rows = parsed.select(
        "entry_id", F.regexp_replace(first_value(["_chemical_formula_sum", "_chemical_formula_structural"]), r"\s+", "").alias("formula"),
        first_value(["_chemical_name_mineral", "_chemical_name_common", "_chemical_name_systematic"]).alias("name"),
        first_value(["_space_group_name_H-M_alt", "_symmetry_space_group_name_H-M"]).alias("spacegroup"),
        number_text(first_value(["_space_group_IT_number", "_symmetry_Int_Tables_number"])).cast("int").alias("number"), *cell,
        number_text(tag_value("_cell_volume")).alias("__volume"),
    )
    return rows.withColumn("volume", F.coalesce("__volume", cell_volume())).drop("__volume")


def publications(parsed: DataFrame) -> DataFrame:
    """(entry_id, title, journal, year, doi, authors) of read files: authors joined by '; ', in order."""
    authors = F.expr("get(filter(loops, x -> array_contains(x.header, '_publ_author_name')), 0).rows")
    names = F.array_join(F.transform(F.coalesce(authors, F.array().cast("array<string>")), _unquoted), "; ")
    return parsed.select(
        "entry_id", first_value(["_publ_section_title", "_citation_title"]).alias("title"), first_value(["_journal_name_full", "_citation_journal_full"]).alias("journal"),
        number_text(first_value(["_journal_year", "_citation_year"])).cast("int").alias("year"), first_value(["_journal_paper_doi", "_citation_doi"]).alias("doi"), names.alias("authors"),
    )


def _cells(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(r"""'[^']*'|"[^"]*"|\S+"""), F.lit(0)), _unquoted)


def loop_rows(parsed: DataFrame, wanted: str) -> DataFrame:
    """(entry_id, row_no, cells) of the first loop of every read file that has the tag; cells is a map from tag to text."""
    first = parsed.select("entry_id", F.get(F.filter("loops", lambda x: F.array_contains(x["header"], wanted.lower())), F.lit(0)).alias("l")).where("l IS NOT NULL")
    rows = first.select("entry_id", F.col("l.header").alias("tags"), F.posexplode("l.rows").alias("row_no", "line"))
    rows = fixed(rows, v=_cells(F.col("line"))).where(F.size("v") >= F.size("tags"))
    return rows.select("entry_id", "row_no", F.map_from_arrays("tags", F.slice("v", F.lit(1), F.size("tags"))).alias("cells"))


def atom_sites(parsed: DataFrame) -> DataFrame:
    """(entry_id, site_no, label, element, x, y, z, occupancy, biso, uiso) of read files; a missing occupancy is 1."""
    rows = loop_rows(parsed, "_atom_site_label")
    get = lambda t: F.col("cells")[t.lower()]
    label = get("_atom_site_label")
    element = F.regexp_extract(F.coalesce(F.nullif(F.nullif(get("_atom_site_type_symbol"), F.lit("?")), F.lit(".")), label), r"^[A-Za-z]{1,2}", 0)
    number = lambda t: number_text(get(t))
    return rows.select(
        "entry_id", F.col("row_no").alias("site_no"), label.alias("label"), F.initcap(element).alias("element"), number("_atom_site_fract_x").alias("x"), number("_atom_site_fract_y").alias("y"), number("_atom_site_fract_z").alias("z"),
        F.coalesce(number("_atom_site_occupancy"), F.lit(1.0)).alias("occupancy"), number("_atom_site_B_iso_or_equiv").alias("biso"), number("_atom_site_U_iso_or_equiv").alias("uiso"),
    )


SYMOP_TAGS = ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz")


def symmetry_operations(parsed: DataFrame) -> DataFrame:
    """(entry_id, op) of read files: the operations of the first kind of loop that a file has, the identity without one."""

    def listed(tag: str) -> Column:
        """The operations of the rows of a file's first loop with the tag."""
        loop = F.get(F.filter("loops", lambda x: F.array_contains(x["header"], tag)), F.lit(0))
        full = F.filter(F.transform(loop["rows"], _cells), lambda v: F.size(v) >= F.size(loop["header"]))
        ops = F.transform(full, lambda v: F.regexp_replace(F.get(v, F.array_position(loop["header"], tag).cast("int") - 1), r"\s", ""))
        return F.coalesce(ops, F.array().cast("array<string>"))

    # one pass over the files; an entry may have several
    both = parsed.select("entry_id", *(listed(t).alias(n) for t, n in zip(SYMOP_TAGS, ("newer", "older"), strict=True)))
    by_entry = both.groupBy("entry_id").agg(*(F.flatten(F.collect_list(n)).alias(n) for n in ("newer", "older")))
    ops = fixed(by_entry, ops=F.filter(F.when(F.size("newer") > 0, F.col("newer")).otherwise(F.col("older")), lambda o: o != ""))
    return ops.select("entry_id", F.explode(F.when(F.size("ops") > 0, F.col("ops")).otherwise(F.array(F.lit("x,y,z")))).alias("op"))


def atoms_json(sites: DataFrame) -> DataFrame:
    """(entry_id, atoms_json): the sites of an entry in order, fields that are null left out."""
    one = F.struct("site_no", *(c for c in ("label", "element", "x", "y", "z", "occupancy", "biso", "uiso")))
    packed = sites.groupBy("entry_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return packed.select("entry_id", F.to_json(F.transform("p", lambda v: v.dropFields("site_no"))).alias("atoms_json"))


def atom_rows(phases: DataFrame, most: int = 96) -> DataFrame:
    """(entry_id, site_no, label, element, x, y, z, occupancy, b) of (entry_id, atoms_json): what is shown, `most` rows an entry at most."""
    kind = "array<struct<label:string,element:string,x:double,y:double,z:double,occupancy:double,biso:double,uiso:double>>"
    rows = phases.select("entry_id", F.posexplode(F.from_json("atoms_json", kind)).alias("site_no", "v")).where(F.col("site_no") < most)
    shown = lambda c: F.coalesce(F.round(c, 4).cast("string"), F.lit(""))
    label = F.coalesce(F.nullif("v.label", F.lit("")), "v.element", F.lit(""))
    return rows.select("entry_id", "site_no", label.alias("label"), F.coalesce("v.element", F.lit("")).alias("element"), *(shown(F.col(f"v.{c}")).alias(c) for c in ("x", "y", "z", "occupancy")), shown(F.coalesce("v.biso", "v.uiso")).alias("b"))


def diffraction_rows(peaks: DataFrame, wavelength: float = 1.5406, most: int = 60) -> DataFrame:
    """(entry_id, n, d, two_theta, intensity, h, k, l) as shown: fixed decimals, the `most` first peaks of an entry."""
    n = F.row_number().over(Window.partitionBy("entry_id").orderBy("peak_index"))
    d = wavelength / (2 * F.sin(F.radians(F.col("two_theta") / 2)))
    shown = lambda c, k: F.format_string(f"%.{k}f", c)
    rows = peaks.withColumn("n", n).where(F.col("n") <= most)
    return rows.select("entry_id", "n", shown(d, 4).alias("d"), shown(F.col("two_theta"), 3).alias("two_theta"), shown(F.col("intensity"), 1).alias("intensity"), *(F.col(c).cast("string").alias(c) for c in "hkl"))


# -- reflections ---------------------------------------------------------------------------------------------


#: Indices h k l as one whole number h * SPAN^2 + k * SPAN + l: its order is theirs, and its opposite stands for -h -k -l.
SPAN = 1 << 21


def rotation_codes(m: Column) -> Column:
    """Struct(h, k, l) of a parsed operation: what one step of each index adds to the code of the image under its rotation."""
    code = lambda r: sum(r[c].cast("long") * (SPAN**p) for c, p in (("x", 2), ("y", 1), ("z", 0)))
    return F.struct(*(code(m[i]).alias(c) for i, c in enumerate("hkl")))


def _index(code: Column, power: int) -> Column:
    """The index of h k l (power 2, 1 or 0) that a code holds."""
    for _ in range(power):
        code = F.floor((code + SPAN // 2) / F.lit(SPAN)).cast("long")
    return code.cast("int") if power == 2 else (F.pmod(code + SPAN // 2, F.lit(SPAN)) - SPAN // 2).cast("int")


def reflections(cells: DataFrame, symops: DataFrame, low: float = 5.0, high: float = 120.0, wavelength: float = 1.5406, most: int = 12) -> DataFrame:
    """(entry_id, h, k, l, d, two_theta, multiplicity): one of every class of symmetry-equal reflections within the angles.

    Indices are generated a phase at a time, as far as its reciprocal axes need for the smallest distance and `most`
    at most; the least image names a class, and the least member that lies within the angles stands for it. Images and
    members are whole numbers (SPAN), so classes are counted by hash, without a sort.
    """
    dmin, dmax = (wavelength / (2 * math.sin(math.radians(t / 2))) for t in (high, low))
    v = cell_volume()
    edge = lambda x, y, angle: F.col(x) * F.col(y) * F.sin(F.radians(F.col(angle))) / v
    reach = lambda q: F.when(v > 0, F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(1 / dmin / F.greatest(q, F.lit(1e-12))).cast("int") + 1))).otherwise(most)
    # a cell and its operations are rows of some bytes, but have thousands of indices and images
    parsed = fixed(dealt(symops.select("entry_id", "op"), "entry_id"), m=parse_symop(F.col("op"))).where(F.size("m") == 3)
    ops = fixed(parsed, code=rotation_codes(F.col("m"))).groupBy("entry_id").agg(F.collect_set("code").alias("ops"))
    rows = dealt(cells.select("entry_id", *CELL), "entry_id").select("entry_id", *CELL, reach(edge("b", "c", "alpha")).alias("hm"), reach(edge("a", "c", "beta")).alias("km"), reach(edge("a", "b", "gamma")).alias("lm")).join(ops, "entry_id")
    # 1/d^2 is a quadratic form of the indices, computed once a phase; of h k l and its opposite only the lesser is listed
    ca, cb, cg = (F.cos(F.radians(F.col(x))) for x in ("alpha", "beta", "gamma"))
    bottom = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    axis = {"a": (1 - ca * ca) / (F.col("a") * F.col("a")), "b": (1 - cb * cb) / (F.col("b") * F.col("b")), "c": (1 - cg * cg) / (F.col("c") * F.col("c"))}
    mixed = {"ab": 2 * (ca * cb - cg) / (F.col("a") * F.col("b")), "bc": 2 * (cb * cg - ca) / (F.col("b") * F.col("c")), "ac": 2 * (ca * cg - cb) / (F.col("a") * F.col("c"))}
    rows = rows.select("entry_id", "hm", "km", "lm", "ops", *((e / bottom).alias(f"q_{n}") for n, e in (axis | mixed).items()))
    rows = rows.withColumn("h", F.explode(F.sequence(-F.col("hm"), F.lit(0))))
    for name in "kl":
        rows = rows.withColumn(name, F.explode(F.sequence(-F.col(f"{name}m"), F.col(f"{name}m"))))
    rows = rows.where("h < 0 OR (h = 0 AND k < 0) OR (h = 0 AND k = 0 AND l < 0)")
    rows = rows.withColumn("q", F.expr("h*h*q_a + k*k*q_b + l*l*q_c + h*k*q_ab + k*l*q_bc + h*l*q_ac")).where("q > 0").withColumn("d", 1 / F.sqrt("q")).where(F.col("d").between(dmin, dmax))
    images = F.transform("ops", lambda o: -F.abs(F.col("h") * o["h"] + F.col("k") * o["k"] + F.col("l") * o["l"]))
    rows = rows.select("entry_id", "d", F.expr(f"h * {SPAN**2} + k * {SPAN} + l").alias("code"), F.array_min(images).alias("class"))
    best = rows.groupBy("entry_id", "class").agg(F.min("code").alias("code"), F.min_by("d", "code").alias("d"), (2 * F.count("*")).alias("multiplicity"))
    indices = (_index(F.col("code"), 2 - i).alias(c) for i, c in enumerate("hkl"))
    return best.select("entry_id", *indices, "d", two_theta_of_d(F.col("d"), wavelength).alias("two_theta"), "multiplicity").where("two_theta IS NOT NULL")


def expanded_sites(sites: DataFrame, symops: DataFrame) -> DataFrame:
    """Distinct images (entry_id, element, x, y, z, occupancy, biso, uiso) of sites under the operations of their entry."""
    marked = sites.withColumn("element", F.concat_ws("|", "element", F.col("occupancy").cast("string"), F.coalesce(F.col("biso").cast("string"), F.lit("")), F.coalesce(F.col("uiso").cast("string"), F.lit(""))))
    part = F.split("element", r"\|")
    out = expand_atoms(marked, symops)
    return out.select("entry_id", part[0].alias("element"), "x", "y", "z", part[1].try_cast("double").alias("occupancy"), part[2].try_cast("double").alias("biso"), part[3].try_cast("double").alias("uiso"))


def molar_masses(atoms: DataFrame) -> DataFrame:
    """(entry_id, mass) of expanded sites: the mass of all atoms in a cell by occupancy."""
    weight = F.greatest("occupancy", F.lit(0.0)) * atomic_weight(F.col("element"))
    return atoms.groupBy("entry_id").agg(F.greatest(F.sum(weight), F.lit(1e-12)).alias("mass"))


def structure_factors(hkl: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds f2, lp and raw_intensity to reflections: the squared sum of the atoms' waves, by LP and multiplicity.

    Sums run over (entry, reflection) with partial sums before the shuffle; a cell has few atoms beside its reflections.
    """
    s2 = 1 / (4 * F.col("d") * F.col("d"))
    pairs = hkl.join(atoms.withColumnRenamed("x", "ax").withColumnRenamed("y", "ay").withColumnRenamed("z", "az"), "entry_id")
    wave = F.col("occupancy") * scattering_factor(F.col("element"), s2) * debye_waller(F.col("biso"), F.col("uiso"), s2)
    phase = 2 * math.pi * (F.col("h") * F.col("ax") + F.col("k") * F.col("ay") + F.col("l") * F.col("az"))
    keys = ["entry_id", "h", "k", "l", "d", "two_theta", "multiplicity"]
    g = pairs.groupBy(*keys).agg(F.sum(wave * F.cos(phase)).alias("re"), F.sum(wave * F.sin(phase)).alias("im"))
    f2 = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return g.select(*keys, f2.alias("f2"), lorentz_polarisation(F.col("two_theta")).alias("lp")).withColumn("raw_intensity", F.col("f2") * F.col("lp") * F.col("multiplicity"))


def scaled_intensities(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds intensity, the strongest of a phase at 100; lines below `least`, after rounding to four digits, go."""
    top = F.max("raw_intensity").over(Window.partitionBy("entry_id"))
    return lines.where("raw_intensity > 1e-8").withColumn("intensity", 100 * F.col("raw_intensity") / top).where(F.round("intensity", 4) >= least)


def merged_lines(lines: DataFrame, gap: float = 0.035) -> DataFrame:
    """Lines without a gap above `gap` to the next as one: summed, at the intensity-weighted place, with the indices of the strongest."""
    w = Window.partitionBy("entry_id").orderBy("two_theta", "h", "k", "l")
    rows = lines.withColumn("new", F.when(F.round(F.col("two_theta") - F.lag("two_theta").over(w), 9) <= gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    mean = lambda c: F.sum(F.col(c) * F.col("raw_intensity")) / F.nullif(F.sum("raw_intensity"), F.lit(0.0))
    best = F.max_by(F.struct("h", "k", "l"), F.struct("raw_intensity", -F.col("two_theta")))
    g = rows.groupBy("entry_id", "session").agg(best.alias("b"), mean("d").alias("d"), mean("two_theta").alias("two_theta"), F.sum("multiplicity").alias("multiplicity"), F.sum("raw_intensity").alias("raw_intensity"))
    return g.select("entry_id", "b.h", "b.k", "b.l", "d", "two_theta", "multiplicity", "raw_intensity")


def index_library(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phases, peaks) of structure files (entry_id, text): from texts to lines between 5 and 120 degrees of 0.5 % or more.

    A file whose cell is incomplete or that has no atoms is a phase without peaks.
    """
    parsed = written(read_files(files))
    cells, sites, ops = written(structures(parsed)), written(atom_sites(parsed).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")), written(symmetry_operations(parsed))
    whole = cells.where(" AND ".join(f"{c} IS NOT NULL" for c in CELL))
    lines = scaled_intensities(merged_lines(structure_factors(reflections(whole, ops), expanded_sites(sites, ops)).where("raw_intensity > 1e-8")))
    index = F.row_number().over(Window.partitionBy("entry_id").orderBy("two_theta")) - 1
    return cells, lines.select("entry_id", index.alias("peak_index"), "two_theta", "intensity", "h", "k", "l", "multiplicity")


# -- refinement ----------------------------------------------------------------------------------------------


def resolvable(lines: DataFrame) -> DataFrame:
    """(key, system, n_lines, resolved) of (key, system, h, k, l): whether the distinct indices fix all free axes of the system.

    1/d^2 is linear in the squared reciprocal axes with whole coefficients, so their normal matrix has a whole
    determinant, which is 0 if and only if some axis is left open.
    """
    h, k, l = F.col("h").cast("long"), F.col("k").cast("long"), F.col("l").cast("long")  # noqa: E741
    system = F.col("system")
    u1 = F.when(system == "cubic", h * h + k * k + l * l).when(system == "tetragonal", h * h + k * k).when(system == "hexagonal", h * h + h * k + k * k).otherwise(h * h)
    u2 = F.when(system == "cubic", 0).when(system == "orthorhombic", k * k).otherwise(l * l)
    u3 = F.when(system == "orthorhombic", l * l).otherwise(0)
    rows = lines.where("h <> 0 OR k <> 0 OR l <> 0").select("key", "system", "h", "k", "l").distinct().select("key", "system", u1.alias("u1"), u2.alias("u2"), u3.alias("u3"))
    s = lambda e: F.sum(F.expr(e))
    g = rows.groupBy("key", "system").agg(F.count("*").alias("n_lines"), s("u1*u1").alias("a"), s("u1*u2").alias("b"), s("u1*u3").alias("c"), s("u2*u2").alias("d"), s("u2*u3").alias("e"), s("u3*u3").alias("f"))
    det = F.when(system == "cubic", F.col("a")).when(system == "orthorhombic", F.expr("a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c)")).otherwise(F.expr("a*d-b*b"))
    return g.select("key", "system", "n_lines", (det != 0).alias("resolved"))


def isolated_axis(system: Column, h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """The one axis that the position of a reflection depends on; null if there are several."""
    basal, axial = (h != 0) | (k != 0), l != 0
    single = F.when((h != 0) & (k == 0) & ~axial, "a").when((h == 0) & (k != 0) & ~axial, "b").when(~basal & axial, "c")
    return F.when(system == "cubic", F.when(basal | axial, "a")).when(system == "orthorhombic", single).otherwise(F.when(basal & ~axial, "a").when(~basal & axial, "c"))


#: Observed peaks farther off than this don't lend their width to a match.
FAR = 5.0


def _tolerance(fwhm: Column, factor: float, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.greatest(fwhm, F.lit(0.05)) * factor))


def with_angle(rows: DataFrame, name: str, wavelength: float = 1.5406) -> DataFrame:
    """Adds the angle that a line (h, k, l) has by the cell of its row, null without one, computed once a row.

    As a plain column Spark would put it, spelled out several times, into every filter and join condition that reads it.
    """
    spaced = fixed(rows, __d=d_spacing())
    return fixed(spaced, **{name: two_theta_of_d(F.col("__d"), wavelength)}).drop("__d")


def nearest_peak(matches: DataFrame, observed: DataFrame, reach: float) -> DataFrame:
    """Adds peak and peak_fwhm, the nearest observed peak of the same pattern within `reach`, the lower of two; null without one."""
    probes = observed.select("pattern_id", F.col("two_theta").alias("peak"), F.col("fwhm").alias("peak_fwhm"))
    keys = ["pattern_id", "entry_id", "h", "k", "l", "angle"]
    pairs = range_join(matches.select(*keys), probes, "angle", "peak", reach, ["pattern_id"])
    best = nearest(pairs, keys, F.round(F.abs(F.col("peak") - F.col("angle")), 9), F.struct("peak", "peak_fwhm"), ["peak", "peak_fwhm"])
    return matches.join(best, keys, "left")


def compact_matches(matches: DataFrame, observed: DataFrame, most: int = 1, factor: float = 1.0, least: float = 0.06, highest: float = 0.30) -> DataFrame:
    """Of the indexed matches (pattern_id, entry_id, h, k, l, angle, weight) at one observed peak, the `most` of greatest weight.

    A match belongs to its nearest peak if that lies within a tolerance by the peak's width; others stay.
    """
    near = nearest_peak(matches, observed, highest)
    own = F.col("peak").isNotNull() & (F.round(F.abs(F.col("peak") - F.col("angle")), 9) <= _tolerance(F.col("peak_fwhm"), factor, least, highest))
    near = near.withColumn("bucket", F.when(own, F.round("peak", 4)))
    rank = F.row_number().over(Window.partitionBy("pattern_id", "entry_id", "bucket").orderBy(F.desc("weight"), "h", "k", "l", "angle"))
    return near.withColumn("__r", rank).where(F.col("bucket").isNull() | (F.col("__r") <= most)).select(*matches.columns)


def consistent_matches(matches: DataFrame, cells: DataFrame, observed: DataFrame, wavelength: float = 1.5406, factor: float = 1.8, least: float = 0.12, highest: float = 0.45) -> DataFrame:
    """Matches whose angle by the cell (entry_id, a..gamma) lies within a tolerance by the width of the nearest observed peak.

    cells may have a pattern_id as well: then a phase has a cell of its own in every pattern.
    """
    keys = [c for c in ("pattern_id", "entry_id") if c in cells.columns]
    rows = with_angle(nearest_peak(matches.join(cells.select(*keys, *CELL), keys).select(*matches.columns, *CELL), observed, FAR), "__angle", wavelength)
    good = F.round(F.abs(F.col("__angle") - F.col("angle")), 9) <= _tolerance(F.coalesce("peak_fwhm", F.lit(0.05)), factor, least, highest)
    return rows.where(F.col("__angle").isNotNull() & good).select(*matches.columns)


def refined_cells(matches: DataFrame, cells: DataFrame, observed: DataFrame) -> DataFrame:
    """Cells of (pattern_id, entry_id) fitted to indexed matches: compacted by peak, fitted, checked against the fit, fitted again.

    cells: entry_id, system, a..gamma. A phase whose first fit leaves an axis open keeps no matches and has null axes.
    """
    kept = compact_matches(matches, observed)
    key = F.concat_ws("/", "pattern_id", "entry_id")

    def fitted(rows: DataFrame) -> DataFrame:
        lines = rows.join(cells.select("entry_id", "system"), "entry_id").select(key.alias("key"), "system", "h", "k", "l", F.col("angle").alias("two_theta"), "weight")
        return cell_fit(lines)

    kept = written(kept)
    first = written(fitted(kept)).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    moved = first.select(F.substring_index("key", "/", -1).alias("entry_id"), F.substring_index("key", "/", 1).alias("pattern"), "a", "b", "c").join(cells.select("entry_id", "alpha", "beta", "gamma"), "entry_id")
    checked = kept.withColumn("pattern", F.col("pattern_id").cast("string")).join(moved, ["entry_id", "pattern"])
    near = with_angle(checked, "__angle").where(F.abs(F.col("__angle") - F.col("angle")) <= 0.45).select(*kept.columns)
    return fitted(near).select(F.substring_index("key", "/", 1).alias("pattern_id"), F.substring_index("key", "/", -1).alias("entry_id"), "system", "a", "b", "c", "n_lines")


@dataclass(frozen=True)
class EvidencePolicy:
    """Constants of the evidence for a cell (fixed values): weights, lines a peak, tolerances by the peak's width."""

    direct_least: float = 6.0
    direct_most: float = 100.0
    overlap_share: float = 0.18
    overlap_least: float = 1.0
    overlap_most: float = 18.0
    direct_a_peak: int = 2
    overlap_a_peak: int = 1
    direct_tolerance: tuple[float, float, float] = (0.9, 0.06, 0.30)
    overlap_tolerance: tuple[float, float, float] = (1.2, 0.08, 0.36)
    seed_tolerance: tuple[float, float, float] = (2.2, 0.18, 0.60)


def observed_matches(assigned: DataFrame, peaks: DataFrame) -> DataFrame:
    """(pattern_id, entry_id, h, k, l, angle, weight, claims): indexed lines at the observed angle of the peaks that they claim.

    assigned comes from matching.assignments(); claims counts the phases that claim the same peak.
    """
    claims = assigned.groupBy("pattern_id", "peak_id").agg(F.count("*").alias("claims"))
    rows = assigned.select("pattern_id", "peak_id", "entry_id", "peak_index", F.col("observed").alias("angle")).join(claims, ["pattern_id", "peak_id"])
    rows = rows.join(peaks.select("entry_id", "peak_index", "h", "k", "l", "intensity"), ["entry_id", "peak_index"]).where("h <> 0 OR k <> 0 OR l <> 0")
    return rows.groupBy("pattern_id", "entry_id", "h", "k", "l", "angle", "claims").agg(F.max("intensity").alias("weight"))


def cells_from_evidence(matches: DataFrame, cells: DataFrame, observed: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """(pattern_id, entry_id, system, a, b, c, n_lines): the cells (entry_id, system, a..gamma) refined by observed_matches().

    Peaks that one phase alone claims are direct evidence, others overlap. A cell is fitted to the direct evidence; overlapping
    lines that this cell puts at their peaks join. Where the direct evidence fixes no cell, overlapping lines near the phase's
    own cell help, if the cell that they give together keeps all the direct lines. What a last fit doesn't explain goes, unless
    nothing would stay. Phases whose evidence leaves an axis open have null axes.
    """
    p, own = policy, ["pattern_id", "entry_id"]
    plain = ["pattern_id", "entry_id", "h", "k", "l", "angle", "weight"]
    weighted = lambda rows, share, least, most: rows.withColumn("weight", F.least(F.greatest(F.col("weight") * share, F.lit(least)), F.lit(most))).select(*plain)
    matches = written(matches)
    direct = compact_matches(weighted(matches.where("claims = 1"), 1.0, p.direct_least, p.direct_most), observed, p.direct_a_peak, *p.direct_tolerance)
    overlap = compact_matches(weighted(matches.where("claims > 1"), p.overlap_share, p.overlap_least, p.overlap_most), observed, p.overlap_a_peak, *p.overlap_tolerance)
    direct, overlap = written(direct), written(overlap)
    key = F.struct(*own)

    def fit(rows: DataFrame) -> DataFrame:
        """(pattern_id, entry_id, a..gamma, n_lines) of rows that fix all axes."""
        lines = rows.join(cells.select("entry_id", "system"), "entry_id").select(key.alias("key"), "system", "h", "k", "l", F.col("angle").alias("two_theta"), "weight")
        found = cell_fit(lines).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL").select("key.*", "a", "b", "c", "n_lines")
        return written(found.join(cells.select("entry_id", "alpha", "beta", "gamma"), "entry_id").select(*own, *CELL, "n_lines"))

    first = fit(direct)
    settled = overlap.join(first.select(*own), own, "left_semi")
    near = consistent_matches(settled, first, observed)
    # phases that direct evidence leaves open
    open_direct, open_overlap = direct.join(first.select(*own), own, "left_anti"), overlap.join(first.select(*own), own, "left_anti")
    factor, least, most = p.seed_tolerance
    seeds = consistent_matches(open_overlap, cells, observed, factor=factor, least=least, highest=most)
    trial = fit(open_direct.unionByName(seeds))
    held = consistent_matches(open_direct, trial, observed).groupBy(*own).agg(F.count("*").alias("held"))
    all_held = open_direct.groupBy(*own).agg(F.count("*").alias("n")).join(held, own).where("n = held").select(*own)
    alone = trial.join(open_direct.select(*own).distinct(), own, "left_anti").select(*own)
    good = trial.join(all_held.unionByName(alone), own, "left_semi")
    helped = consistent_matches(open_overlap, good, observed)
    whole = written(direct.unionByName(near).unionByName(helped))
    last = fit(whole)
    checked = consistent_matches(whole, last, observed)
    none_left = whole.join(checked.select(*own).distinct(), own, "left_anti")
    final = fit(checked.unionByName(none_left))
    return matches.select(*own).distinct().join(cells.select("entry_id", "system"), "entry_id").join(final.select(*own, "a", "b", "c", "n_lines"), own, "left").select(*own, "system", "a", "b", "c", "n_lines")
