"""Registered queries from structure files to reflections, intensities and refined cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import scattering as A
from peakloom.functions.chemistry import lorentz_polarisation
from peakloom.operators import crystals as X
from peakloom.operators.fitting import cell_fit
from peakloom.operators.matching import assignments, strong_lines
from peakloom.operators.storage import dealt, written
from peakloom.plans.fixtures import SEARCH_EVERY, searches, view, with_searches, with_views
from peakloom.plans.matching_queries import _SELECTED, selected
from peakloom.plans.search_queries import VOLUME

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P, R = with_views("ref_phase"), with_views("ref_phase", "ref_peak")
N = "CAST(entry_id AS INT)"
SYSTEM = "CASE WHEN gamma = 120 THEN 'hexagonal' WHEN a <> b THEN 'orthorhombic' WHEN a <> c THEN 'tetragonal' ELSE 'cubic' END"
OPS = ("x,y,z", "-x,-y,z+1/2", "-x,y,-z", "x,-y,1/2-z")


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ref_phase")


def _system():
    return F.when(F.col("gamma") == 120, "hexagonal").when(F.col("a") != F.col("b"), "orthorhombic").when(F.col("a") != F.col("c"), "tetragonal").otherwise("cubic")


@query(
    "f14_free_cell_names",
    P + f""", n AS (SELECT *, CASE WHEN {N} % 3 = 0 THEN 1 + {N} % 230 END AS number, gamma = 120 AS hex, a = b AND b = c AS cub FROM ref_phase)
SELECT entry_id, CASE WHEN number >= 195 THEN 'a' WHEN number >= 168 THEN 'a c' WHEN number >= 143 AND hex THEN 'a c' WHEN number >= 143 AND cub THEN 'a alpha' WHEN number BETWEEN 75 AND 142 THEN 'a c'
  WHEN number BETWEEN 16 AND 74 THEN 'a b c' WHEN number BETWEEN 3 AND 15 THEN CASE WHEN hex THEN 'a b c gamma' ELSE 'a b c alpha' END WHEN number BETWEEN 1 AND 2 THEN 'a b c alpha beta gamma'
  WHEN NOT hex AND cub THEN 'a' WHEN NOT hex AND a = b THEN 'a c' WHEN NOT hex THEN 'a b c' WHEN a = b THEN 'a c' ELSE 'a b c alpha beta gamma' END AS free FROM n""",
)
def free_cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("entry_id").cast("int")
    return _phases(spark, sf_dir).select("entry_id", F.array_join(A.free_cell_names(F.when(n % 3 == 0, n % 230 + 1), *(F.col(c) for c in X.CELL)), " ").alias("free"))


def _f0_sql(element: str, s2: str) -> str:
    known = " ".join(f"WHEN '{e}' THEN {c}::DOUBLE + " + " + ".join(f"{a}::DOUBLE * exp(-{b}::DOUBLE * {s2})" for a, b in zip(h, w, strict=True)) for e, (h, w, c) in A.GAUSSIANS.items())
    z = f"CASE {element} " + " ".join(f"WHEN '{e}' THEN {n}" for e, n in A.NUMBERS.items()) + " ELSE 10 END"
    return f"CASE {element} {known} ELSE ({z}) * exp(-8.0::DOUBLE * {s2} / greatest(pow({z}, 0.25), 1.0)) END"


LP = "(1 + pow(cos(radians(two_theta)), 2)) / (pow(sin(radians(two_theta / 2)), 2) * cos(radians(two_theta / 2)))"


@query(
    "f18_scattering",
    R + f""", s AS (SELECT r.entry_id, peak_index, two_theta, regexp_extract(formula, '[A-Z][a-z]?') AS element, pow(sin(radians(two_theta / 2)) / 1.5406::DOUBLE, 2) AS s2, peak_index % 3 AS kind FROM ref_peak r JOIN ref_phase p ON r.entry_id = p.entry_id)
SELECT entry_id, peak_index, round({LP}, 6) AS lp, round({_f0_sql('element', 's2')}, 6) AS f0, round(exp(-(CASE kind WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 8 * pi() * pi() * 0.01::DOUBLE ELSE 0.4::DOUBLE END) * s2), 6) AS damping FROM s""",
)
def scattering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ref_peak").join(_phases(spark, sf_dir).select("entry_id", F.regexp_extract("formula", "[A-Z][a-z]?", 0).alias("element")), "entry_id")
    s2, kind = F.pow(F.sin(F.radians(F.col("two_theta") / 2)) / 1.5406, F.lit(2)), F.col("peak_index") % 3
    damping = A.debye_waller(F.when(kind == 0, 0.7), F.when(kind == 1, 0.01), s2)
    return rows.select("entry_id", "peak_index", F.round(lorentz_polarisation(F.col("two_theta")), 6).alias("lp"), F.round(A.scattering_factor(F.col("element"), s2), 6).alias("f0"), F.round(damping, 6).alias("damping"))


@query(
    "f20_radiation_lines",
    P + ", w AS (SELECT entry_id, " + " ".join(f"CASE WHEN {N} % 10 = {i} THEN {x}::DOUBLE ELSE" for i, x in enumerate((1.5406, 1.5418, 0.7107, 2.29, 1.9373, 1.2, 1.79, 0.56, -1.0))) + " 1.5433::DOUBLE" + " END" * 9 + """ AS w FROM ref_phase),
d AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(A.DOUBLETS.values())) + """) t(i, l1, l2)),
m AS (SELECT entry_id, CASE WHEN w > 0 THEN w ELSE 1.54051::DOUBLE END AS w, (SELECT min(i) FROM d WHERE least(abs(g - l1), abs(g - l2), abs(g - (2 * l1 + l2) / 3)) <= 0.006) AS i FROM (SELECT *, CASE WHEN w > 0 THEN w ELSE 1.54051::DOUBLE END AS g FROM w))
SELECT entry_id, coalesce(l1, w) AS wavelength, 1.0::DOUBLE AS weight FROM m LEFT JOIN d ON m.i = d.i UNION ALL SELECT entry_id, l2, 0.5::DOUBLE FROM m JOIN d ON m.i = d.i""",
)
def radiation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("entry_id").cast("int") % 10
    w = F.lit(1.5433)
    for i, x in enumerate((1.5406, 1.5418, 0.7107, 2.29, 1.9373, 1.2, 1.79, 0.56, -1.0)):
        w = F.when(n == i, x).otherwise(w)
    return _phases(spark, sf_dir).select("entry_id", F.explode(A.radiation_lines(w)).alias("l")).select("entry_id", "l.*")


# -- structure files -----------------------------------------------------------------------------------------

#: Structure files of all phases, as texts.
FILES = """concat_ws(chr(10), 'data_' || entry_id, '# phase ' || entry_id, '_chemical_formula_sum ''' || formula || '''', CASE WHEN CAST(entry_id AS INT) % 2 = 0 THEN '_chemical_name_mineral "' || name || '"' ELSE concat('_chemical_name_mineral ?', chr(10), '_chemical_name_common', chr(10), ';', name, chr(10), ';') END,
  '_symmetry_space_group_name_H-M   ''' || spacegroup || '''', '_space_group_IT_number ' || CAST(1 + CAST(entry_id AS INT) % 230 AS STRING), '_cell_length_a ' || CAST(a AS STRING) || '(2)', '_cell_length_b ' || CAST(b AS STRING), '_cell_length_c ' || CAST(c AS STRING) || '(12)', '_cell_angle_alpha 90', '_cell_angle_beta 90.0', '_cell_angle_gamma ' || CAST(gamma AS STRING),
  '_publ_section_title', ';', 'On the structure', '  of ' || name, ';', '_journal_name_full ''Acta of ' || source || '''', '_journal_year ' || CAST(1950 + CAST(entry_id AS INT) % 70 AS STRING), 'loop_', '_publ_author_name', '''Miller, W. H.''', '"Bragg, L."', '',
  'loop_', '_symmetry_equiv_pos_as_xyz', '''x,y,z''', '-x,-y,z+1/2', '''-x, y, -z''', 'x,-y,1/2-z', '', 'loop_', '_atom_site_label', '_atom_site_type_symbol', '_atom_site_fract_x', '_atom_site_fract_y', '_atom_site_fract_z', '_atom_site_occupancy', '_atom_site_B_iso_or_equiv',
  'Ca1 Ca ' || CAST(CAST(CAST(entry_id AS INT) % 7 AS DOUBLE) / 8 AS STRING) || ' 0.25(1) 0.1 1 ?', '# a remark', 'O1 . 0.306 0 0.25 0.9 0.55', 'short row', '_after 1')"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # phases are few bytes, their texts much work: they are dealt before the texts are made
    return dealt(_phases(spark, sf_dir), "entry_id").select("entry_id", F.expr(FILES.replace("chr(10)", "'\\n'")).alias("text"))


@query(
    "s9_structures",
    P + f" SELECT entry_id, formula, name, spacegroup, CAST(1 + {N} % 230 AS INT) AS number, a, b, c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, gamma, round({VOLUME}, 6) AS volume FROM ref_phase",
)
def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.structures(X.read_files(_files(spark, sf_dir))).withColumn("volume", F.round("volume", 6))


@query("s9_atom_sites", P + f" SELECT entry_id, 0 AS site_no, 'Ca1' AS label, 'Ca' AS element, ({N} % 7) / 8.0::DOUBLE AS x, 0.25::DOUBLE AS y, 0.1::DOUBLE AS z, 1.0::DOUBLE AS occupancy, NULL::DOUBLE AS biso, NULL::DOUBLE AS uiso FROM ref_phase UNION ALL SELECT entry_id, 1, 'O1', 'O', 0.306, 0, 0.25, 0.9, 0.55, NULL FROM ref_phase")
def atom_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.atom_sites(X.read_files(_files(spark, sf_dir)))


@query("s9_publications", P + f" SELECT entry_id, 'On the structure of ' || name AS title, 'Acta of ' || source AS journal, CAST(1950 + {N} % 70 AS INT) AS year, '' AS doi, 'Miller, W. H.; Bragg, L.' AS authors FROM ref_phase")
def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.publications(X.read_files(_files(spark, sf_dir)))


@query("s9_symmetry_operations", P + " SELECT entry_id, unnest(['x,y,z', '-x,-y,z+1/2', '-x,y,-z', 'x,-y,1/2-z']) AS op FROM ref_phase")
def symmetry_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.symmetry_operations(X.read_files(_files(spark, sf_dir)))


@query(
    "n3_atom_rows",
    P + f" SELECT entry_id, 0 AS site_no, 'Ca1' AS label, 'Ca' AS element, CAST(round(({N} % 7) / 8.0::DOUBLE, 4) AS VARCHAR) AS x, '0.25' AS y, '0.1' AS z, '1.0' AS occupancy, '' AS b FROM ref_phase UNION ALL SELECT entry_id, 1, 'O1', 'O', '0.306', '0.0', '0.25', '0.9', '0.55' FROM ref_phase",
)
def atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites packed as JSON and shown again."""
    return X.atom_rows(X.atoms_json(X.atom_sites(X.read_files(_files(spark, sf_dir)))))


@query(
    "n4_diffraction_rows",
    with_views("ref_peak") + """, n AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY peak_index) AS n FROM ref_peak)
SELECT entry_id, CAST(n AS INT) AS n, format('{:.4f}', 1.5406::DOUBLE / (2 * sin(radians(two_theta / 2)))) AS d, format('{:.3f}', two_theta) AS two_theta, format('{:.1f}', intensity) AS intensity, CAST(h AS VARCHAR) AS h, CAST(k AS VARCHAR) AS k, CAST(l AS VARCHAR) AS l FROM n WHERE n <= 60""",
)
def diffraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 peaks of every phase as they are shown."""
    return X.diffraction_rows(view(spark, sf_dir, "ref_peak"))


# -- reflections ---------------------------------------------------------------------------------------------

_DMIN, _DMAX = (1.5406 / (2 * math.sin(math.radians(t / 2))) for t in (120.0, 5.0))
_DSQL = """CASE WHEN gamma = 120 THEN 1 / sqrt(4 * (h * h + h * k + k * k) / (3 * a * a) + l * l / (c * c)) ELSE 1 / sqrt(h * h / (a * a) + k * k / (b * b) + l * l / (c * c)) END"""
_REFLECTIONS = f"""v AS (SELECT *, {VOLUME} AS v FROM ref_phase),
m AS (SELECT *, [least(12, CAST(ceil({1 / _DMIN!r}::DOUBLE * v / (b * c)) AS INT) + 1), least(12, CAST(ceil({1 / _DMIN!r}::DOUBLE * v / (a * c)) AS INT) + 1), least(12, CAST(ceil({1 / _DMIN!r}::DOUBLE * v / (a * b * sin(radians(gamma)))) AS INT) + 1)] AS most FROM v),
i AS (SELECT CAST(unnest(range(-12, 13)) AS INT) AS i),
g AS (SELECT m.*, x.i AS h, y.i AS k, z.i AS l FROM m JOIN i x ON abs(x.i) <= most[1] JOIN i y ON abs(y.i) <= most[2] JOIN i z ON abs(z.i) <= most[3] WHERE x.i <> 0 OR y.i <> 0 OR z.i <> 0),
d AS (SELECT *, {_DSQL} AS d FROM g),
cl AS (SELECT entry_id, min({{'h': h, 'k': k, 'l': l, 'd': d}}) AS r, count(*) AS multiplicity FROM d WHERE d BETWEEN {_DMIN!r}::DOUBLE AND {_DMAX!r}::DOUBLE GROUP BY entry_id, abs(h), abs(k), abs(l)),
hkl AS (SELECT entry_id, r.h AS h, r.k AS k, r.l AS l, r.d AS d, 2 * degrees(asin(1.5406::DOUBLE / (2 * r.d))) AS two_theta, multiplicity FROM cl)"""


def _reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phases(spark, sf_dir)
    return X.reflections(p, p.select("entry_id", F.explode(F.array(*(F.lit(o) for o in OPS))).alias("op")))


@query("j11_reflections", P + f", {_REFLECTIONS} SELECT entry_id, h, k, l, round(d, 6) AS d, round(two_theta, 5) AS two_theta, multiplicity FROM hkl")
def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reflections(spark, sf_dir).select("entry_id", "h", "k", "l", F.round("d", 6).alias("d"), F.round("two_theta", 5).alias("two_theta"), "multiplicity")


_ATOMS = f"""sites AS (SELECT entry_id, 'Ca' AS element, ({N} % 7) / 8.0::DOUBLE AS x, 0.25::DOUBLE AS y, 0.1::DOUBLE AS z, 1.0::DOUBLE AS occ, 0.4::DOUBLE AS bi FROM ref_phase UNION ALL SELECT entry_id, 'O', 0.306, 0, 0.25, 0.9, 0.55 FROM ref_phase),
im AS (SELECT entry_id, element, occ, bi, x, y, z FROM sites UNION ALL SELECT entry_id, element, occ, bi, -x, -y, z + 0.5 FROM sites UNION ALL SELECT entry_id, element, occ, bi, -x, y, -z FROM sites UNION ALL SELECT entry_id, element, occ, bi, x, -y, 0.5 - z FROM sites),
atm AS (SELECT DISTINCT entry_id, element, occ, bi, round(x - floor(x), 5) AS x, round(y - floor(y), 5) AS y, round(z - floor(z), 5) AS z FROM im)"""


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phases(spark, sf_dir)
    site = lambda e, x, y, z, o, b: F.struct(F.lit(e).alias("element"), x.alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(o).alias("occupancy"), F.lit(b).cast("double").alias("biso"), F.lit(None).cast("double").alias("uiso"))
    two = F.array(site("Ca", F.col("entry_id").cast("int") % 7 / 8, 0.25, 0.1, 1.0, None), site("O", F.lit(0.306), 0.0, 0.25, 0.9, 0.55))
    sites = p.select("entry_id", F.explode(two).alias("s")).select("entry_id", "s.*")
    return X.expanded_sites(sites, p.select("entry_id", F.explode(F.array(*(F.lit(o) for o in OPS))).alias("op")))


@query("a18_molar_masses", P + f", {_ATOMS} SELECT entry_id, round(sum(occ * CASE element WHEN 'Ca' THEN 40.078 ELSE 15.999 END), 4) AS mass FROM atm GROUP BY entry_id")
def molar_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.molar_masses(_atoms(spark, sf_dir)).select("entry_id", F.round("mass", 4).alias("mass"))


@query(
    "a34_structure_factors",
    P + f""", {_REFLECTIONS}, {_ATOMS}, sf AS (SELECT hkl.entry_id, h, k, l, two_theta, multiplicity, 1 / (4 * d * d) AS s2, element, occ, bi, 2 * pi() * (h * x + k * y + l * z) AS ph FROM hkl JOIN atm ON hkl.entry_id = atm.entry_id),
w AS (SELECT *, occ * ({_f0_sql('element', 's2')}) * exp(-bi * s2) AS w FROM sf),
q AS (SELECT entry_id, h, k, l, two_theta, (pow(sum(w * cos(ph)), 2) + pow(sum(w * sin(ph)), 2)) * ({LP}) * any_value(multiplicity) AS raw FROM w GROUP BY entry_id, h, k, l, two_theta),
n AS (SELECT *, round(100 * raw / max(raw) OVER (PARTITION BY entry_id), 4) AS intensity FROM q WHERE raw > 1e-8) SELECT entry_id, h, k, l, round(two_theta, 5) AS two_theta, intensity FROM n WHERE intensity >= 0.5""",
)
def structure_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.scaled_intensities(X.structure_factors(_reflections(spark, sf_dir), _atoms(spark, sf_dir)))
    return lines.select("entry_id", "h", "k", "l", F.round("two_theta", 5).alias("two_theta"), F.round("intensity", 4).alias("intensity"))


@query("q10_index_library")
def index_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all phases out of their structure files."""
    peaks = X.index_library(_files(spark, sf_dir))[1]
    return peaks.select("entry_id", "peak_index", F.round("two_theta", 4).alias("two_theta"), F.round("intensity", 3).alias("intensity"), "h", "k", "l", "multiplicity")


# -- refinement ----------------------------------------------------------------------------------------------

def _gram(cells: str = "ref_phase", seen: bool = True) -> str:
    """Whether the distinct indices of each phase fix all its axes; seen: only those of lines whose angle exists by the cells."""
    bragg = f"AND 1.5406::DOUBLE / (2 * ({_DSQL})) < 1" if seen else ""
    return f"""s AS (SELECT DISTINCT r.entry_id AS key, {SYSTEM} AS system, CAST(h AS BIGINT) AS h, CAST(k AS BIGINT) AS k, CAST(l AS BIGINT) AS l FROM ref_peak r JOIN {cells} p ON r.entry_id = p.entry_id WHERE (h <> 0 OR k <> 0 OR l <> 0) {bragg}),
g AS (SELECT key, system, count(*) AS n_lines, count(DISTINCT CASE WHEN system = 'cubic' THEN 1 END) AS cubic, [sum(h*h*h*h), sum(h*h*k*k), sum(h*h*l*l), sum(k*k*k*k), sum(k*k*l*l), sum(l*l*l*l)] AS m, [sum(pow(h*h+h*k+k*k, 2)), sum((h*h+h*k+k*k)*l*l), sum(pow(h*h+k*k, 2)), sum((h*h+k*k)*l*l)] AS q FROM s GROUP BY key, system),
res AS (SELECT key, system, n_lines, CASE system WHEN 'cubic' THEN true WHEN 'orthorhombic' THEN m[1]*(m[4]*m[6]-m[5]*m[5]) - m[2]*(m[2]*m[6]-m[5]*m[3]) + m[3]*(m[2]*m[5]-m[4]*m[3]) <> 0 WHEN 'hexagonal' THEN q[1]*m[6]-q[2]*q[2] <> 0 ELSE q[3]*m[6]-q[4]*q[4] <> 0 END AS resolved FROM g)"""


@query("a13_resolvable_cells", R + f", {_gram(seen=False)} SELECT key, system, n_lines, resolved FROM res")
def resolvable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ref_peak").join(_phases(spark, sf_dir), "entry_id")
    return X.resolvable(rows.select(F.col("entry_id").alias("key"), _system().alias("system"), "h", "k", "l"))


@query(
    "a14_isolated_axes",
    R + f""", s AS (SELECT r.entry_id, peak_index, {SYSTEM} AS system, h, k, l FROM ref_peak r JOIN ref_phase p ON r.entry_id = p.entry_id)
SELECT entry_id, peak_index, CASE WHEN h = 0 AND k = 0 AND l = 0 THEN NULL WHEN system = 'cubic' THEN 'a' WHEN h = 0 AND k = 0 THEN 'c' WHEN l <> 0 THEN NULL WHEN system <> 'orthorhombic' OR k = 0 THEN 'a' WHEN h = 0 THEN 'b' END AS axis FROM s""",
)
def isolated_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ref_peak").join(_phases(spark, sf_dir), "entry_id").withColumn("system", _system())
    return rows.select("entry_id", "peak_index", X.isolated_axis(*(F.col(c) for c in ("system", "h", "k", "l"))).alias("axis"))


def _matches(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Lines of the selected phases as indexed matches of their patterns."""
    lines = strong_lines(view(spark, sf_dir, "ref_peak"), 5, 30, None).join(selected(spark, sf_dir, every), "entry_id")
    return lines.groupBy("pattern_id", "entry_id", "h", "k", "l", F.col("two_theta").alias("angle")).agg(F.max("intensity").alias("weight"))


_MATCHES = f"""{_SELECTED}, sl AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY intensity DESC, peak_index) AS rk FROM ref_peak WHERE intensity >= 5),
mt AS (SELECT sel.pattern_id, sl.entry_id, h, k, l, two_theta AS angle, max(intensity) AS weight FROM sl JOIN sel ON sl.entry_id = sel.entry_id WHERE rk <= 30 GROUP BY ALL)"""


def _nearest_sql(reach: float) -> str:
    return f"""np AS (SELECT mt.*, o.two_theta AS peak, o.fwhm AS pf, row_number() OVER (PARTITION BY mt.pattern_id, entry_id, h, k, l, angle ORDER BY round(abs(o.two_theta - angle), 9), o.two_theta, o.fwhm) AS n FROM mt LEFT JOIN obs_peak o ON o.pattern_id = mt.pattern_id AND angle BETWEEN o.two_theta - {reach}::DOUBLE AND o.two_theta + {reach}::DOUBLE)"""


@query(
    "j16_compact_matches",
    with_searches("ref_phase", "ref_peak", "obs_peak") + f""", {_MATCHES}, {_nearest_sql(0.3)},
b AS (SELECT *, CASE WHEN round(abs(peak - angle), 9) <= greatest(0.06::DOUBLE, least(0.3::DOUBLE, greatest(pf, 0.05::DOUBLE) * 0.9::DOUBLE)) THEN round(peak, 4) END AS bucket FROM np WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, entry_id, bucket ORDER BY weight DESC, h, k, l, angle) AS r FROM b) SELECT pattern_id, entry_id, h, k, l, angle, weight FROM r WHERE bucket IS NULL OR r <= 1""",
)
def compact_matches(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return X.compact_matches(_matches(spark, sf_dir, every), searches(spark, sf_dir, every), factor=0.9)


@query(
    "j17_consistent_matches",
    with_searches("ref_phase", "ref_peak", "obs_peak") + f""", {_MATCHES}, {_nearest_sql(5.0)},
c AS (SELECT np.*, {_DSQL} AS d FROM np JOIN (SELECT entry_id AS pe, a, b, c, gamma FROM ref_phase) p ON np.entry_id = p.pe WHERE n = 1 AND (h <> 0 OR k <> 0 OR l <> 0)),
t AS (SELECT *, 2 * degrees(asin(1.5406::DOUBLE / (2 * d))) AS calc FROM c WHERE 1.5406::DOUBLE / (2 * d) < 1)
SELECT pattern_id, entry_id, h, k, l, angle, weight FROM t WHERE round(abs(calc - angle), 9) <= greatest(0.12::DOUBLE, least(0.45::DOUBLE, greatest(coalesce(pf, 0.05::DOUBLE), 0.05::DOUBLE) * 1.8::DOUBLE))""".replace("t AS (SELECT *, 2 * degrees", "tc AS (SELECT *, 2 * degrees").replace("FROM t WHERE round", "FROM tc WHERE round"),
)
def consistent_matches(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    return X.consistent_matches(_matches(spark, sf_dir, every), _phases(spark, sf_dir), searches(spark, sf_dir, every))


@query(
    "q9_refined_cells",
    R + f""", st AS (SELECT entry_id, alpha, beta, gamma, a * 1.002::DOUBLE AS a, CASE WHEN a = b THEN b * 1.002::DOUBLE ELSE b END AS b, CASE WHEN a = b AND b = c AND gamma = 90 THEN c * 1.002::DOUBLE ELSE c END AS c FROM ref_phase), {_gram("st")}, x AS (SELECT p.*, {SYSTEM} AS system, a * 1.002::DOUBLE AS a2, CASE WHEN a = b THEN b * 1.002::DOUBLE ELSE b END AS b2, CASE WHEN a = b AND b = c AND gamma = 90 THEN c * 1.002::DOUBLE ELSE c END AS c2 FROM ref_phase p)
SELECT x.entry_id, x.system, round(a2, 4) AS a, round(b2, 4) AS b, round(c2, 4) AS c FROM x JOIN res ON x.entry_id = res.key WHERE resolved""",
)
def refined_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all phases with a stretched a axis, refined from the angles of the stretched cell; those with an open axis are left out."""
    cells = _phases(spark, sf_dir).withColumn("system", _system())
    same = F.col("a") == F.col("b")
    stretched = cells.select("entry_id", (F.col("a") * 1.002).alias("a"), F.when(same, F.col("b") * 1.002).otherwise(F.col("b")).alias("b"), F.when(F.col("system") == "cubic", F.col("c") * 1.002).otherwise(F.col("c")).alias("c"), "alpha", "beta", "gamma")
    rows = X.with_angle(view(spark, sf_dir, "ref_peak").select("entry_id", "h", "k", "l", "intensity").join(stretched, "entry_id"), "angle").where("angle IS NOT NULL")
    matches = rows.groupBy("entry_id", "h", "k", "l", "angle").agg(F.max("intensity").alias("weight"))
    # read as matches and as observed peaks
    matches = written(matches.withColumn("pattern_id", F.col("entry_id").cast("long")))
    observed = matches.select("pattern_id", F.col("angle").alias("two_theta"), F.lit(0.1).alias("fwhm"))
    fit = X.refined_cells(matches, cells, observed).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    return fit.select("entry_id", "system", *(F.round(c, 4).alias(c) for c in "abc"))


@query("q9_observed_cells")
def observed_cells(spark: SparkSession, sf_dir: str, every: int = SEARCH_EVERY) -> DataFrame:
    """Cells of the phases that the search ranks, refined by the observed peaks that they claim alone or with others."""
    peaks, observed, cells = view(spark, sf_dir, "ref_peak"), searches(spark, sf_dir, every), _phases(spark, sf_dir).withColumn("system", _system())
    found = X.cells_from_evidence(X.observed_matches(assignments(observed, peaks, selected(spark, sf_dir, every)), peaks), cells, observed)
    return found.select("pattern_id", "entry_id", "system", *(F.round(c, 4).alias(c) for c in "abc"), "n_lines")


@query(
    "a12_cell_fit",
    R + f", {_gram()} SELECT x.entry_id AS key, {SYSTEM} AS system, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM ref_phase x JOIN res ON x.entry_id = res.key WHERE resolved",
)
def fitted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all phases from the angles that their cells give: the fit must return them, but where the lines leave an axis open."""
    rows = X.with_angle(view(spark, sf_dir, "ref_peak").join(_phases(spark, sf_dir), "entry_id"), "t").where("t IS NOT NULL")
    lines = rows.select(F.col("entry_id").alias("key"), _system().alias("system"), "h", "k", "l", F.col("t").alias("two_theta"), F.col("intensity").alias("weight"))
    fit = cell_fit(lines).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    return fit.select("key", "system", *(F.round(c, 4).alias(c) for c in "abc"))
