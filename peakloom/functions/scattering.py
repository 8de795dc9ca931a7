"""Scattering of X-rays by atoms, radiation lines, and the free parameters of cells, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ---------------------------------------------------------------------------------------------
#: Four-Gaussian scattering factors by element: heights, widths, constant.
GAUSSIANS = {
    "O": ((3.0485, 2.2868, 1.5463, 0.8670), (13.2771, 5.7011, 0.3239, 32.9089), 0.2508),
    "Al": ((6.4202, 1.9002, 1.5936, 1.9646), (3.0387, 0.7426, 31.5472, 85.0886), 1.1151),
    "Si": ((6.2915, 3.0353, 1.9891, 1.5410), (2.4386, 32.3337, 0.6785, 81.6937), 1.1407),
    "Ca": ((8.6266, 7.3873, 1.5899, 1.0211), (10.4421, 0.6599, 85.7484, 178.437), 1.3751),
    "Mg": ((5.4204, 2.1735, 1.2269, 2.3073), (2.8275, 79.2611, 0.3808, 7.1937), 0.8584),
    "Na": ((4.7626, 3.1736, 1.2674, 1.1128), (3.2850, 8.8422, 0.3136, 129.424), 0.6760),
    "K": ((8.2186, 7.4398, 1.0519, 0.8659), (12.7949, 0.7748, 213.187, 41.6841), 1.4228),
    "Ti": ((9.7595, 7.3558, 1.6991, 1.9021), (7.8508, 0.5000, 35.6338, 116.105), 1.2807),
    "Fe": ((11.7695, 7.3573, 3.5222, 2.3045), (4.7611, 0.3072, 15.3535, 76.8805), 1.0369),
    "Zr": ((17.8765, 10.9480, 5.41732, 3.65721), (1.27618, 11.9160, 0.117622, 87.6627), 2.06929),
    "Mo": ((3.7025, 17.2356, 12.8876, 3.7429), (0.2772, 1.0958, 11.0040, 61.6584), 4.3875),
    "W": ((29.0818, 15.43, 14.4327, 5.11982), (1.72029, 9.2259, 0.321703, 57.056), 9.8875),
}
#: Atomic numbers of the elements that decay by number instead; others count as 10.
NUMBERS = {
    "H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "P": 15, "S": 16, "K": 19, "Ca": 20, "Ti": 22, "Fe": 26,
    "Cu": 29, "Zn": 30, "Sr": 38, "Y": 39, "Zr": 40, "Nb": 41, "Mo": 42, "Ba": 56, "La": 57, "Ce": 58, "Eu": 63, "Gd": 64, "Tb": 65, "W": 74, "Pb": 82,
}
#: Wavelengths of K-alpha 1 and 2 by anode.
DOUBLETS = {
    "Cu": (1.54051, 1.54433), "Ti": (2.74841, 2.75207), "Cr": (2.28962, 2.29351), "Fe": (1.93597, 1.93991), "Co": (1.78892, 1.79278),
    "Ga": (1.34003, 1.34394), "Mo": (0.70926, 0.713543), "Ag": (0.559363, 0.563775), "In": (0.512094, 0.516525),
}
DOUBLET_REACH, SECOND_LINE = 0.006, 0.5
#: Standard atomic weights in g/mol.
WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305,
    "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996,
    "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798,
    "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82,
    "Sn": 118.71, "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Ce": 140.12, "Pr": 140.91, "Nd": 144.24, "Sm": 150.36,
    "Eu": 151.96, "Gd": 157.25, "Tb": 158.93, "Dy": 162.50, "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05, "Lu": 174.97, "Hf": 178.49, "Ta": 180.95, "W": 183.84,
    "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Th": 232.04, "U": 238.03,
}
# -- end of fixed values --------------------------------------------------------------------------------------


def _by_element(element: Column, values: dict, default: float) -> Column:
    """The value of an element out of a small table that becomes part of the plan."""
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(table[element], F.lit(float(default)))


def scattering_factor(element: Column, s2: Column) -> Column:
    """f0 at (sin theta / wavelength) squared: a sum of four Gaussians, or a decay by atomic number where none are known."""
    z = _by_element(element, NUMBERS, 10)
    out = z * F.exp(-8.0 * s2 / F.greatest(F.pow(z, F.lit(0.25)), F.lit(1.0)))
    for e, (heights, widths, constant) in GAUSSIANS.items():
        total = F.lit(constant)
        for a, b in zip(heights, widths, strict=True):
            total = total + a * F.exp(-b * s2)
        out = F.when(element == e, total).otherwise(out)
    return out


def debye_waller(biso: Column, uiso: Column, s2: Column) -> Column:
    """Thermal damping by B, else by 8 pi^2 U, else by B = 0.4."""
    b = F.coalesce(biso, 8 * math.pi**2 * uiso, F.lit(0.4))
    return F.exp(-F.greatest(b, F.lit(0.0)) * s2)


def atomic_weight(element: Column) -> Column:
    """Standard weight; 0 for symbols without one."""
    return _by_element(element, WEIGHTS, 0.0)


def radiation_lines(wavelength: Column) -> Column:
    """Array of struct(wavelength, weight): both lines of the doublet that the wavelength belongs to, else that wavelength alone."""
    given = F.when(wavelength > 0, wavelength).otherwise(DOUBLETS["Cu"][0])
    line = lambda w, k: F.struct(F.lit(w).cast("double").alias("wavelength"), F.lit(k).alias("weight"))
    out = F.array(F.struct(given.alias("wavelength"), F.lit(1.0).alias("weight")))
    for first, second in reversed(DOUBLETS.values()):
        near = F.least(*(F.abs(given - x) for x in (first, second, (2 * first + second) / 3)))
        out = F.when(near <= DOUBLET_REACH, F.array(line(first, 1.0), line(second, SECOND_LINE))).otherwise(out)
    return out


def free_cell_names(number: Column, a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """The cell parameters that symmetry leaves free: by space-group number if it is known, else by the metric; empty for an incomplete cell."""
    names = lambda *x: F.array(*(F.lit(n) for n in x))
    same = lambda x, y: F.abs(x - y) <= 0.004 * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    is_ = lambda x, v: F.abs(x - v) <= 0.35
    off = F.array_max(F.array(*(F.struct(F.abs(x - 90).alias("d"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, x) in enumerate((("alpha", alpha), ("beta", beta), ("gamma", gamma))))))["n"]
    right = is_(alpha, 90) & is_(beta, 90)
    complete = F.lit(True)
    for x in (a, b, c, alpha, beta, gamma):
        complete &= x.isNotNull()
    by_number = (
        F.when(number.between(195, 230), names("a"))
        .when(number.between(168, 194), names("a", "c"))
        .when(number.between(143, 167) & is_(gamma, 120), names("a", "c"))
        .when(number.between(143, 167) & same(a, b) & same(b, c), names("a", "alpha"))
        .when(number.between(75, 142), names("a", "c"))
        .when(number.between(16, 74), names("a", "b", "c"))
        .when(number.between(3, 15), F.array_append(names("a", "b", "c"), off))
        .when(number.between(1, 2), names("a", "b", "c", "alpha", "beta", "gamma"))
    )
    by_metric = (
        F.when(right & is_(gamma, 90) & same(a, b) & same(b, c), names("a"))
        .when(right & is_(gamma, 90) & same(a, b), names("a", "c"))
        .when(right & is_(gamma, 90), names("a", "b", "c"))
        .when(right & is_(gamma, 120) & same(a, b), names("a", "c"))
        .when(is_(alpha, 90) & is_(gamma, 90), names("a", "b", "c", "beta"))
        .otherwise(names("a", "b", "c", "alpha", "beta", "gamma"))
    )
    return F.when(complete, F.coalesce(by_number, by_metric)).otherwise(F.array().cast("array<string>"))
