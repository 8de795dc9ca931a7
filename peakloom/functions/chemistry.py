"""Formula, name, identifier and cell functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = "[A-Z][a-z]?"
TOKEN = "([A-Z][a-z]?)([0-9.]+)?"
#: The main table by rows, then lanthanides, then actinides (fixed values).
ELEMENT_ORDER = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og "
    "Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def formula_elements(formula: Column) -> Column:
    """Sorted distinct element symbols."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(formula), F.lit(ELEMENT), F.lit(0))))


def element_order(element: Column) -> Column:
    """Position of a symbol in ELEMENT_ORDER from 1; unknown ones come after all others."""
    at = F.array_position(F.array(*(F.lit(x) for x in ELEMENT_ORDER)), element).cast("int")
    return F.when(at > 0, at).otherwise(len(ELEMENT_ORDER) + 1)


def formula_tokens(formula: Column) -> Column:
    """Array of struct(element, amount), amount as written or empty."""
    pairs = F.arrays_zip(F.regexp_extract_all(_text(formula), F.lit(TOKEN), F.lit(1)).alias("element"), F.regexp_extract_all(_text(formula), F.lit(TOKEN), F.lit(2)).alias("amount"))
    return F.transform(pairs, lambda p: F.struct(p["element"].alias("element"), _text(p["amount"]).alias("amount")))


def _key(formula: Column, tokens: Column) -> Column:
    joined = F.array_join(F.transform(tokens, lambda t: F.concat(F.lower(t["element"]), t["amount"])), "")
    return F.when(F.size(tokens) > 0, joined).otherwise(F.regexp_replace(F.lower(_text(formula)), r"\s+", ""))


def formula_key(formula: Column) -> Column:
    """Elements in lower case with their amounts, in the order written."""
    return _key(formula, formula_tokens(formula))


def sorted_formula_key(formula: Column) -> Column:
    """As formula_key(), by element."""
    return _key(formula, F.array_sort(formula_tokens(formula)))


def normalize_text(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", " "))


def normalize_formula(formula: Column) -> Column:
    """Sorted tokens with trailing zeros and points dropped, a missing amount as 1."""
    tokens = F.array_sort(formula_tokens(formula))
    amount = lambda t: F.when(t["amount"] == "", F.lit("1")).otherwise(F.regexp_replace(F.regexp_replace(t["amount"], "0+$", ""), r"\.+$", ""))
    return F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: F.concat(t["element"], amount(t))), " ")).otherwise(normalize_text(formula))


def display_formula(formula: Column) -> Column:
    parts = F.regexp_extract_all(_text(formula), F.lit("[A-Z][a-z]?[0-9.]*"), F.lit(0))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(formula)


def display_reference_id(text: Column) -> Column:
    found = F.regexp_extract(_text(text), "(?:^|[^A-Za-z0-9])(R[0-9]{5,7}(?:-[0-9]+)?)(?=$|[^A-Za-z0-9])", 1)
    return F.when(found != "", found).otherwise(text)


def display_card_formula(formula: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(_text(formula), F.lit("!"), F.lit("*")), r"\s+", " "))


def display_card_phase(chemical: Column, name: Column, entry_id: Column) -> Column:
    chemical, name = _text(chemical), _text(name)
    return F.when((chemical != "") & (name != ""), F.concat(chemical, F.lit(" ("), name, F.lit(")"))).when(name != "", name).when(chemical != "", chemical).otherwise(_text(entry_id))


def element_query_tokens(query: Column) -> Column:
    """Element symbols of a query that holds nothing else but amounts and separators; else empty."""
    residue = F.regexp_replace(query, r"[A-Z][a-z]?|[0-9.]+|\s|,|;|/|-|_", "")
    return F.when(residue == "", F.regexp_extract_all(query, F.lit(ELEMENT), F.lit(0))).otherwise(F.array().cast("array<string>"))


def formula_query_text(query: Column) -> Column:
    """The formula that a query with a digit spells, or empty."""
    q = F.trim(_text(query))
    tokens = F.regexp_extract_all(q, F.lit("[A-Z][a-z]?[0-9.]*"), F.lit(0))
    residue = F.regexp_replace(q, r"[A-Z][a-z]?[0-9.]*|\s|,|;|/|-|_", "")
    return F.when(q.rlike("[0-9]") & (residue == ""), F.array_join(tokens, "")).otherwise("")


def extract_doi(text: Column) -> Column:
    """The first DOI, which begins a word, without trailing punctuation."""
    return F.regexp_replace(F.regexp_extract(_text(text), r"\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), "[.,;]+$", "")


def search_cache_key(mode: Column, query: Column, excluded: Column) -> Column:
    """mode|query|exclude:..., the query in lower case with single spaces, excluded elements sorted."""
    words = F.array_join(F.array_sort(F.filter(F.transform(excluded, F.trim), lambda x: x != "")), " ")
    return F.concat(mode, F.lit("|"), F.regexp_replace(F.trim(F.lower(_text(query))), r"\s+", " "), F.lit("|exclude:"), words)


_LONG_CARD = r"^[0-9]{2}-([0-9]{3})-([0-9]{4})$"


def short_card_id(entry_id: Column) -> Column:
    """00-012-0345 as 12-0345; other ids as they are."""
    set_no, card_no = (F.regexp_extract(_text(entry_id), _LONG_CARD, i) for i in (1, 2))
    return F.when(set_no != "", F.concat(F.format_string("%02d", set_no.try_cast("int")), F.lit("-"), card_no)).otherwise(entry_id)


def card_code(entry_id: Column) -> Column:
    """00-012-0345 and 12-345 as 120345; else empty."""
    text = F.trim(_text(entry_id))
    long_set, long_no = (F.regexp_extract(text, _LONG_CARD, i) for i in (1, 2))
    short_set, short_no = (F.regexp_extract(text, r"^([0-9]{1,2})-([0-9]{1,5})$", i) for i in (1, 2))
    code = lambda s, n: F.format_string("%02d%04d", s.try_cast("int"), n.try_cast("int"))
    return F.when(long_set != "", code(long_set, long_no)).when(short_set != "", code(short_set, short_no)).otherwise("")


def candidate_key(source: Column, entry_id: Column, formula: Column, path: Column) -> Column:
    source, entry_id, formula = _text(source), _text(entry_id), _text(formula)
    return (
        F.when(entry_id != "", F.concat(F.when(source != "", source).otherwise("UNKNOWN"), F.lit(":"), entry_id))
        .when((source != "") & (formula != ""), F.concat(source, F.lit(":"), formula))
        .otherwise(path)
    )


def phase_uuid(identity: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version-5 UUID of an identity within a namespace (by default that of URLs)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(identity, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def crystal_system(a: str = "a", b: str = "b", c: str = "c", alpha: str = "alpha", beta: str = "beta", gamma: str = "gamma") -> Column:
    """Crystal system of a cell by its metric; empty if the cell is incomplete."""
    lengths, angles = [F.col(x) for x in (a, b, c)], [F.col(x) for x in (alpha, beta, gamma)]
    complete = F.lit(True)
    for x in lengths + angles:
        complete &= x.isNotNull()
    right = [F.abs(x - 90.0) <= 0.2 for x in angles]
    ab, bc = F.abs(lengths[0] - lengths[1]) <= 0.03, F.abs(lengths[1] - lengths[2]) <= 0.03
    n_right = sum((x.cast("int") for x in right), F.lit(0))
    return (
        F.when(~complete, "")
        .when((n_right == 3) & ab & bc, "cubic")
        .when((n_right == 3) & ab, "tetragonal")
        .when(n_right == 3, "orthorhombic")
        .when(right[0] & right[1] & (F.abs(angles[2] - 120.0) <= 0.3) & ab, "hexagonal/trigonal")
        .when(n_right == 2, "monoclinic")
        .otherwise("triclinic")
    )


def cell_volume(a: str = "a", b: str = "b", c: str = "c", alpha: str = "alpha", beta: str = "beta", gamma: str = "gamma") -> Column:
    x, y, z = (F.cos(F.radians(F.col(k))) for k in (alpha, beta, gamma))
    return F.col(a) * F.col(b) * F.col(c) * F.sqrt(F.greatest(1 - x * x - y * y - z * z + 2 * x * y * z, F.lit(0.0)))


def d_spacing(h: str = "h", k: str = "k", l: str = "l") -> Column:  # noqa: E741
    """Interplanar distance in the general (triclinic) cell a, b, c, alpha, beta, gamma; null for (0, 0, 0)."""
    ca, cb, cg = (F.cos(F.radians(F.col(x))) for x in ("alpha", "beta", "gamma"))
    sa, sb, sg = (F.sin(F.radians(F.col(x))) for x in ("alpha", "beta", "gamma"))
    x, y, z = F.col(h) / F.col("a"), F.col(k) / F.col("b"), F.col(l) / F.col("c")
    top = x * x * sa * sa + y * y * sb * sb + z * z * sg * sg + 2 * x * y * (ca * cb - cg) + 2 * y * z * (cb * cg - ca) + 2 * x * z * (ca * cg - cb)
    bottom = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    return F.when(top > 0, F.sqrt(bottom / F.nullif(top, F.lit(0.0))))


def two_theta_of_d(d: Column, wavelength: float = 1.5406) -> Column:
    """Bragg angle in degrees; null outside the domain."""
    s = wavelength / (2 * F.nullif(d, F.lit(0.0)))
    return F.when((s > 0) & (s < 1), 2 * F.degrees(F.asin(F.least(s, F.lit(1.0)))))


def d_of_two_theta(two_theta: Column, wavelength: float = 1.5406) -> Column:
    s = F.sin(F.radians(two_theta / 2))
    return F.when(s > 0, wavelength / (2 * F.nullif(s, F.lit(0.0))))


def scaled_two_theta(two_theta: Column, scale: Column) -> Column:
    """The angle after all d spacings are multiplied by scale; null outside the domain."""
    s = F.sin(F.radians(two_theta / 2)) / F.nullif(scale, F.lit(0.0))
    return F.when((s > 0) & (s < 1), 2 * F.degrees(F.asin(F.least(s, F.lit(1.0)))))


def lorentz_polarisation(two_theta: Column) -> Column:
    t = F.radians(two_theta / 2)
    return (1 + F.cos(2 * t) * F.cos(2 * t)) / F.nullif(F.sin(t) * F.sin(t) * F.cos(t), F.lit(0.0))


def gaussian(x: Column, centre: Column, fwhm: Column) -> Column:
    z = (x - centre) / fwhm
    return F.exp(-2.772588722239781 * z * z)


def lorentzian(x: Column, centre: Column, fwhm: Column) -> Column:
    z = (x - centre) / fwhm
    return 1 / (1 + 4 * z * z)


def pseudo_voigt(x: Column, centre: Column, fwhm: Column, eta: float | Column = 0.5) -> Column:
    return eta * lorentzian(x, centre, fwhm) + (1 - eta) * gaussian(x, centre, fwhm)


def parse_percent(text: Column) -> Column:
    """12,5% as 12.5; null if it is no number."""
    return F.trim(F.replace(F.replace(_text(text), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")


def redact_paths(text: Column) -> Column:
    """Windows and home paths as <path>/name; line ends as spaces and \\n."""
    flat = F.replace(F.replace(_text(text), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("\\n"))
    windows = F.regexp_replace(flat, r"""(?i)(?:[a-z]:\\|\\\\)(?:[^\r\n\t"']*[\\/])?([^\r\n\t"'\\/]+)""", "<path>/$1")
    return F.regexp_replace(windows, r"""/(?:home|Users)/[^/\s]+/(?:[^\r\n\t"']*/)?([^\r\n\t"'/]+)""", "<path>/$1")


def site_tokens(text: Column) -> Column:
    """struct(element, x, y, z) of 'El @ x y z'; coordinates null where they are no numbers."""
    parts = F.split(F.trim(F.regexp_extract(_text(text), "@(.*)$", 1)), r"\s+")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.struct(F.regexp_extract(_text(text), ELEMENT, 0).alias("element"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def ratio_text(ratio: Column, version: Column, current: int) -> Column:
    """An intensity ratio with three significant digits, if it is positive and of the current derived version; else empty."""
    digits = F.greatest(2 - F.floor(F.log10(ratio)).cast("int"), F.lit(0))
    # the rounding may have carried into a further digit, which the plain text shows as well
    places = [F.when(digits == k, F.format_string(f"%.{k}f", ratio)) for k in range(8)]
    text = F.coalesce(*places)
    short = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when((version == current) & (ratio > 0), short).otherwise("")
