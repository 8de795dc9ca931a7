"""Structure files read in one pass, and cells refined by observed evidence."""

import math

import pytest

from peakloom.operators import crystals as X
from peakloom.operators.matching import assignments

TEXT = """data_one
# a remark
_chemical_formula_sum 'Ca O3'
_cell_length_a 4.75(2)
_cell_length_b	5.1
_cell_length_c
 6.25(10)
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_chemical_name_mineral ?
_chemical_name_common
;
 a name
   of two lines
;
_symmetry_space_group_name_H-M "P 1"
loop_
_publ_author_name
'Miller, W. H.'
"O'Hara, S."

_Journal_Year 1984
loop_
_space_group_symop_operation_xyz
x,y,z
'-x, -y, z+1/2'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Ca1 0.5(1) 0 0.25
# inside
short row
O1 ? 0.1 0.2
_after 1
"""


def test_files_are_read_in_one_pass(spark):
    files = spark.createDataFrame([("1", TEXT), ("2", TEXT.replace("\n", "\r\n")), ("3", ""), ("4", None), ("5", "loop_\n_atom_site_label")], "entry_id string, text string")
    parsed = X.read_files(files)
    cells = {r.entry_id: r for r in X.structures(parsed).collect()}
    for e in ("1", "2"):
        r = cells[e]
        assert (r.formula, r.name, r.spacegroup, r.a, r.b, r.c, r.number) == ("CaO3", "a name of two lines", "P 1", 4.75, 5.1, 6.25, None)
    assert len(cells) == 5 and cells["4"].a is None
    sites = sorted((r.entry_id, r.site_no, r.label, r.element, r.x, r.occupancy) for r in X.atom_sites(parsed).collect())
    assert [s for s in sites if s[0] == "1"] == [("1", 0, "Ca1", "Ca", 0.5, 1.0), ("1", 2, "O1", "O", None, 1.0)] and len(sites) == 4
    ops = sorted((r.entry_id, r.op) for r in X.symmetry_operations(parsed).collect())
    assert [o for e, o in ops if e == "1"] == ["-x,-y,z+1/2", "x,y,z"] and ("3", "x,y,z") in ops
    papers = {r.entry_id: r for r in X.publications(parsed).collect()}
    assert (papers["1"].authors, papers["1"].year, papers["1"].title) == ("Miller, W. H.; O'Hara, S.", 1984, "") and papers["5"].authors == ""


HKL = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1), (2, 1, 0), (2, 0, 1), (1, 2, 1), (2, 1, 2), (3, 1, 1)]
SYSTEMS = {
    "cubic": ((5.40, 5.40, 5.40, 90.0), (5.42, 5.42, 5.42, 90.0)), "tetragonal": ((7.70, 7.70, 5.05, 90.0), (7.73, 7.73, 5.07, 90.0)),
    "hexagonal": ((3.50, 3.50, 5.20, 120.0), (3.51, 3.51, 5.19, 120.0)), "orthorhombic": ((5.20, 6.30, 7.40, 90.0), (5.22, 6.28, 7.43, 90.0)),
}


def angle(cell, hkl):
    (a, b, c, gamma), (h, k, l) = cell, hkl  # noqa: E741
    q = 4 / 3 * (h * h + h * k + k * k) / a**2 + l * l / c**2 if gamma == 120 else h * h / a**2 + k * k / b**2 + l * l / c**2
    return 2 * math.degrees(math.asin(1.5406 / 2 * math.sqrt(q)))


@pytest.fixture(scope="module")
def evidence(spark):
    """Pattern 1: one phase each; pattern 2: the same with a second phase at its first six lines, so that these overlap."""
    peaks, cells, chosen, seen = [], [], [], []
    for n, (system, (old, new)) in enumerate(SYSTEMS.items()):
        for i, hkl in enumerate(HKL):
            peaks.append((system, i, round(angle(old, hkl), 5), 100.0 - 5 * i, *hkl))
            for pattern in (10 + n, 20 + n):
                seen.append((pattern, i + 1, round(angle(new, hkl), 5), 0.1))
        peaks += [(f"{system}-twin", i, round(angle(old, hkl), 5), 50.0, *hkl) for i, hkl in enumerate(HKL[:6])]
        for e in (system, f"{system}-twin"):
            cells.append((e, system, *old[:3], 90.0, 90.0, old[3]))
        chosen += [(10 + n, system), (20 + n, system), (20 + n, f"{system}-twin")]
    frame = spark.createDataFrame
    return (
        frame(peaks, "entry_id string, peak_index int, two_theta double, intensity double, h int, k int, l int"),
        frame(cells, "entry_id string, system string, a double, b double, c double, alpha double, beta double, gamma double"),
        frame(chosen, "pattern_id long, entry_id string"), frame(seen, "pattern_id long, peak_id int, two_theta double, fwhm double"),
    )


def test_cells_follow_observed_peaks(evidence):
    peaks, cells, chosen, observed = evidence
    assigned = assignments(observed, peaks, chosen, 0.3)
    matches = X.observed_matches(assigned, peaks)
    claims = {(r.pattern_id, r.entry_id, r.claims) for r in matches.collect()}
    assert all(p < 20 or c >= 1 for p, _, c in claims) and any(c == 2 for p, _, c in claims if p >= 20) and all(c == 1 for p, _, c in claims if p < 20)
    got = {(r.pattern_id, r.entry_id): r for r in X.cells_from_evidence(matches, cells, observed).collect()}
    for n, (system, (_, new)) in enumerate(SYSTEMS.items()):
        for pattern in (10 + n, 20 + n):
            r = got[pattern, system]
            assert r.system == system and all(abs(x - y) < 0.01 for x, y in zip((r.a, r.b, r.c), new[:3], strict=True)), (r, new)
            assert r.n_lines >= 3
