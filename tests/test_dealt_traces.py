"""Traces are dealt to all tasks, and their steps stay within their row."""

import numpy as np

from peakloom.operators import crystals as X
from peakloom.operators import signal as G
from peakloom.operators import traces as T
from peakloom.plans.crystal_queries import _atoms, _files
from peakloom.plans.trace_queries import _traces
from pyspark.sql import functions as F


def test_traces_are_dealt_to_all_tasks(spark, sf):
    """adaptive execution made all traces in the one task of their few ids."""
    traces = _traces(spark, sf)
    assert traces.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert traces.count() == traces.select("pattern_id").distinct().count()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grids_and_lines_stay_in_the_row_of_their_trace(spark):
    """a row a grid point was shuffled and sorted in windows that held a trace's points twice."""
    rng = np.random.default_rng(5)
    x = np.round(np.cumsum(rng.uniform(0.1, 0.4, 60)) + 10, 3)
    y = np.round(rng.uniform(0, 50, 60), 2)
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "pattern_id long, x double, y double")
    grid = G.resample(rows, 5.0, 30.0, 101)
    assert "Window" not in _plan(grid) and "Window" not in _plan(T.peak_suppressed(G.as_arrays(rows))) and "explode" not in _plan(T.training_records(rows, 5.0, 30.0, 101))
    got = {r.g: r.y for r in grid.collect()}
    at = 5.0 + np.arange(101) * 0.25
    want = np.where((at < x[0]) | (at > x[-1]), 0.0, np.interp(at, x, y))
    assert np.allclose([got[k] for k in range(101)], want)


def test_series_through_nodes_is_the_same_in_a_row(spark):
    """nodes and fit of a series are made from the arrays of a row; a short or flat trace has none."""
    xs = np.linspace(10, 70, 400)
    ys = 5 + 0.1 * xs
    rows = spark.createDataFrame([(1, xs.tolist(), ys.tolist()), (2, [1.0, 2.0], [1.0, 1.0]), (3, [4.0] * 6, [1.0] * 6)], "pattern_id long, xs array<double>, ys array<double>")
    got = {r.pattern_id: r.f for r in rows.select("pattern_id", T.fitted_series(F.col("xs"), F.col("ys"), (2, 3)).alias("f")).collect()}
    assert got[2] is None and got[3] is None and [f.degree for f in got[1]] == [2, 3]
    flat = {r.pattern_id: r.baseline for r in T.chebyshev_baseline(rows).collect()}
    assert np.allclose(flat[1], ys, atol=0.6) and flat[2] == [1.0, 1.0] and len(flat[3]) == 6


def test_profiles_are_filled_beside_their_lines(spark):
    """a row a line and grid point was shuffled; now only lines are, and the sums are those of the formula."""
    lines = spark.createDataFrame([("a", 10.02, 50.0), ("a", 10.31, 20.0), ("a", 10.31, 5.0), ("b", 24.88, 7.0), ("c", 200.0, 1.0), ("d", 12.0, 0.0), ("e", 12.0, None)], "entry_id string, two_theta double, intensity double")
    profile = G.rasterise(lines, 5.0, 0.05, 401, 0.2)
    assert "explode" not in _plan(profile) and "Window" not in _plan(profile)
    got = {}
    for r in profile.collect():
        got.setdefault(r.entry_id, {})[r.g] = r.y
    assert set(got) == {"a", "b", "d", "e"} and {*got["d"].values(), *got["e"].values()} == {None}
    for name, peaks in (("a", ((10.02, 50.0), (10.31, 25.0))), ("b", ((24.88, 7.0),))):
        at = 5.0 + np.array(sorted(got[name])) * 0.05
        shape = lambda o: 0.5 / (1 + 4 * o**2) + 0.5 * np.exp(-4 * np.log(2) * o**2)
        want = sum(h * np.where(np.abs(at - c) <= 1.0 + 1e-9, shape((at - c) / 0.2), 0.0) for c, h in peaks)
        assert np.allclose([got[name][g] for g in sorted(got[name])], want * 100 / want.max())


def test_structure_files_are_read_once_in_all_tasks(spark, sf):
    """the files were read in the one task of their few bytes; operations read them again for each join."""
    files = _files(spark, sf)
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    texts = [("a", "loop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\n-x,-y,z\n"), ("b", "_cell_length_a 3\n"), ("b", "_cell_length_b 3\n"), ("c", "loop_\n_symmetry_equiv_pos_as_xyz\n'x,y,-z'\n\nloop_\n_space_group_symop_operation_xyz\ny,x,z\n")]
    ops = X.symmetry_operations(X.read_files(spark.createDataFrame(texts, "entry_id string, text string")))
    assert sorted(map(tuple, ops.collect())) == [("a", "-x,-y,z"), ("a", "x,y,z"), ("b", "x,y,z"), ("c", "y,x,z")]
    published = X.publications(X.read_files(files))
    assert "Join" not in _plan(ops) and "Join" not in _plan(published)


def test_atoms_are_expanded_in_all_tasks(spark, sf):
    """atoms and operations were parsed and joined in the one task of their few bytes."""
    atoms = _atoms(spark, sf)
    assert atoms.select(F.spark_partition_id().alias("p")).distinct().count() > 1
