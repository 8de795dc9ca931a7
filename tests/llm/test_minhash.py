import random
import re

import numpy as np

from peakloom.llm import minhash as M
from peakloom.llm.components import components
from peakloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Sets, links and components by their definitions."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None and a and b
            if None not in (rows[i][0], rows[j][0]) and a and b and (same_id or 100 * len(a & b) >= 75 * len(a | b)):
                comp[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        mates = [rows[k][0] for k in range(len(rows)) if root(k) == root(i)]
        c = None if doc is None else min(m for m in mates if m is not None)
        out.append((doc, len(sets[i]), c, doc is not None and c == doc))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r)[:4] for r in M.near_duplicates(df).collect()), key=str)


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(30, 80))) for _ in range(6)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)
    monkeypatch.setattr(M, "BLOCK", 7)  # open classes go in many blocks
    assert run(df.repartition(5)) == brute(rows)


def test_awkward_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == brute(rows)
    assert run(no_docs) == []


def test_common_counts_all_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300 if i % 2 else 5000, rng.integers(1, 80))) for i in range(90)]
    got = M._common(sets[:40], sets[40:])
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:40]) for j, b in enumerate(sets[40:]))


def test_shingles_do_not_depend_on_slices():
    import pyarrow as pa

    texts = ["a b c d e f g", None, "", "x y", "a b c d e f g " * 50]
    whole = list(shingle_sets(pa.array(texts)))
    single = [next(iter(shingle_sets(pa.array([t], pa.string())))) for t in texts]
    assert all((a == b).all() for a, b in zip(whole, single, strict=True))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
