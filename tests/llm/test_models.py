"""Language-model scores, spelling variants and vector codes against brute force, and on awkward input."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import scoring, variants, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# -- language-model scores ---------------------------------------------------------------------------------------


def expected_scores(rows):
    """Deleted interpolation over (doc_id, text) rows with plain counters."""
    tokens = [(i, WORD.findall(lowered(t)) + ["</s>"]) for i, t in rows]
    part = [0 if i is None else 2 if zlib.crc32(str(i).encode()) % 5 == 1 else int(zlib.crc32(str(i).encode()) // 5 % 10 == 0) for i, _ in tokens]
    part = [int(zlib.crc32(b"") // 5 % 10 == 0) if i is None else p for (i, _), p in zip(tokens, part, strict=True)]
    one, two = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for (_, t), p in zip(tokens, part, strict=True):
        if p < 2:
            one[p].update(["<s>", *t])
            two[p].update(zip(["<s>", *t], t, strict=False))
    n, n2 = one[0] + one[1], two[0] + two[1]
    total, words = sum(n.values()) - n["<s>"], len(set(n) - {"<s>"})
    kept = sum(one[0].values()) - one[0]["<s>"]
    weights = {0: (0, 0.5, 0.5)} if kept else {k: (0, 0, 1) for k in range(64)}
    seen, last = set(), None
    for _ in range(scoring.ROUNDS if kept else 0):
        mass, fit = collections.defaultdict(lambda: np.zeros(3)), 0
        for (v, w), times in two[1].items():
            at = weights.get(one[0][v].bit_length(), (1 / 3,) * 3)
            p = np.array([at[0] * two[0][v, w] / max(1, one[0][v]), at[1] * one[0][w] / kept, at[2] / (words + 1)])
            if p.sum() > 0:
                mass[one[0][v].bit_length()] += times * p / p.sum()
                fit += times * math.log(p.sum())
        for k, m in mass.items():
            m[2] = max(m[2], scoring.LEAST_EVEN * m.sum())
            weights[k] = m / m.sum()
            seen.add(k)
        if last is not None and abs(fit - last) <= scoring.CLOSE * abs(last):
            break
        last = fit
    for k in range(64):
        weights.setdefault(k, (1 / 3,) * 3)
    for k in range(2, 64):
        if kept and k not in seen and any(j in seen for j in range(1, k)):
            weights[k] = weights[k - 1]
    out = []
    for (i, t), p in zip(tokens, part, strict=True):
        score = 0
        for v, w in zip(["<s>", *t], t, strict=False):
            a = weights[n[v].bit_length()]
            score += math.log10(a[0] * n2[v, w] / max(1, n[v]) + a[1] * n[w] / max(1, total) + a[2] / (words + 1))
        base = sum(math.log10((n[w] + 0.5) / (total + 0.5 * (words + 1))) for w in t)
        out.append((i, p == 2, len(t), sum(n[w] > 0 for w in t), total, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0], *r[1:5], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-6)


def test_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    close(scoring.score_documents(docs).collect(), expected_scores([(r.doc_id, r.text) for r in docs.collect()]))


def test_rare_words_and_hot_pairs_change_nothing(spark, sf, monkeypatch):
    """With a head of a few words nearly all counts come by the join; with a low bound many bigrams are looked up where they stand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: tuple(r) for r in scoring.score_documents(docs).collect()}
    monkeypatch.setattr(scoring, "HOT_LEAST", 5)
    got = {r.doc_id: tuple(r) for r in scoring.score_documents(docs.repartition(3), head_rows=40).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-6) for k in want)


def test_scores_of_awkward_documents(spark, odd_docs, no_docs):
    close(scoring.score_documents(odd_docs).collect(), expected_scores([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert scoring.score_documents(no_docs).count() == 0
    held = spark.createDataFrame([(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1), "only one held out text")], "doc_id long, text string")
    row = scoring.score_documents(held).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score == 0


def test_very_long_text_and_ties(spark):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    docs = spark.createDataFrame([(i, long if i == 3 else f"tie tie w{i}") for i in range(12)] * 2, "doc_id long, text string")
    close(scoring.score_documents(docs).collect(), expected_scores([(r.doc_id, r.text) for r in docs.collect()]))


def test_model_is_a_distribution(spark, sf):
    """The shares of all known words and one unknown one add up to 1 after any context."""
    head = scoring.Head.__new__(scoring.Head)
    counts = np.array([5, 3, 2])
    head.tokens, head.words = 10, 3
    weights = np.full((64, 3), (0.5, 0.3, 0.2))
    seen = np.array([2, 1, 1])  # after a context that occurs four times
    a, q = scoring.mixture(head, weights, np.full(4, 4), np.r_[counts, 0])
    assert math.isclose((a * np.r_[seen, 0] + q).sum(), 1)


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    columns = [rng.integers(-(1 << 62), 1 << 62, 501), np.arange(501), np.zeros(501, np.int64)]
    for a, b in zip(columns, scoring.unpack(scoring.pack(columns), 3), strict=True):
        assert (a == b).all()


# -- spelling variants -------------------------------------------------------------------------------------------


def expected_variants(rows, least=5, often=3):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= often}
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for found in holes.values():
        for w in found:
            near[w] |= found - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found_variants(docs):
    words = vectors.materialize(variants.vocabulary(docs))
    return sorted(map(tuple, variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert found_variants(docs) == want and len({r[2] for r in want}) < len(want)


def test_variants_of_random_words(spark):
    rng = np.random.default_rng(5)
    alphabet = list("aqiéÿz")
    rows = [(int(i), " ".join("".join(rng.choice(alphabet, rng.integers(3, 9))) for _ in range(4000))) for i in range(3)] + [(None, "Straße STRASSE straße " * 4), (None, None), (7, "")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert found_variants(docs) == expected_variants(rows * 2)


def test_variants_of_awkward_documents(spark, odd_docs, no_docs):
    assert found_variants(odd_docs) == expected_variants([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert found_variants(no_docs) == []
    long = "x" * 30_000
    docs = spark.createDataFrame([(1, f"{long} {long} {long} {long}y {long}y {long}y {long}y {long}y {long}y {long}y")], "doc_id long, text string")
    assert [(r[3], r[4]) for r in found_variants(docs)] == [(r[3], r[4]) for r in expected_variants([(1, docs.first().text)])]


def test_every_edit_is_in_a_neighbourhood():
    rng = np.random.default_rng(8)
    for _ in range(300):
        word = rng.integers(97, 123, rng.integers(5, 12))
        at = int(rng.integers(0, len(word)))
        for other in (np.delete(word, at), np.r_[word[:at], rng.integers(97, 123), word[at + 1 :]], np.insert(word, at, rng.integers(97, 123))):
            (own_a, all_a, _), (own_b, all_b, _) = (variants.neighbourhood(variants.symbols(x[None, :])) for x in (word, other))
            assert own_a[0] == own_b[0] or own_b[0] in all_a or own_a[0] in all_b


# -- vector codes ------------------------------------------------------------------------------------------------


def expected_codes(rows, parts=4, entries=256, rounds=4):
    v = np.array([r[1] for r in rows], np.int64)
    step = v.shape[1] // parts
    books = [v[:entries, p * step : (p + 1) * step].copy() for p in range(parts)]
    for last in range(rounds + 1):
        near = [((v[:, None, p * step : (p + 1) * step] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        if last == rounds:
            break
        for p, d in enumerate(near):
            best = d.argmin(1)
            for e in np.unique(best):
                books[p][e] = v[best == e, p * step : (p + 1) * step].sum(0) // (best == e).sum()
    codes = np.stack([d.argmin(1) for d in near], 1)
    return ["".join(f"{x:02x}" for x in c) for c in codes], sum(d.min(1) for d in near), books


@pytest.mark.parametrize(("n", "spread", "entries"), [(700, 3000, 256), (700, 3, 256), (90, 40, 256), (1000, 200, 7)])
def test_codes_equal_brute_force(spark, n, spread, entries):
    """Random, tied (few different values), fewer rows than entries, and a small codebook."""
    rng = np.random.default_rng(n + spread)
    rows = [(i, rng.integers(-spread, spread, 16).tolist()) for i in range(n)]
    frame = spark.createDataFrame([(i, [x / 1024 for x in v], i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    found, books = vectors.encode(frame, entries=entries)
    code, error, want = expected_codes(rows, entries=entries)
    got = {r.vec_id: (r.code, r.error) for r in found.collect()}
    assert got == {i: (code[i], error[i]) for i in range(n)}
    assert all((a == b).all() for a, b in zip(books, want, strict=True))


def test_whole_nodes_are_assigned():
    """Far clusters are assigned by their sums, without a look at their points."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, (8, 4))
    points = centres[rng.integers(0, 8, 3000)] + rng.integers(-5, 5, (3000, 4))
    near, sums, counts, whole = vectors.dual_assign(points, vectors.Tree.grow(points, vectors.LEAF_POINTS), centres, vectors.Tree.grow(centres, 1))
    want = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (near == want).all() and whole > 2000
    assert (counts == np.bincount(want, minlength=8)).all() and all((sums[k] == points[want == k].sum(0)).all() for k in range(8))


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), i / 7, -i / 3, 0.5, 1.0, 2.0, -3.0, i * 1.0], None if i % 4 == 0 else i % 3, "x") for i in range(1, 40)]
    bad = [(40, None, 1, "x"), (41, [], 1, "x"), (42, [1.0] * 7 + [None], 1, "x"), (43, [nan] * 8, 1, "x"), (44, [inf] * 8, 1, "x"), (45, [1.0] * 12, 1, "x"), (46, [1.0] * 7, 1, "x")]
    odd = [(None, [1e30] * 8, 1, "x"), (3, [9.0] * 8, 1, "x"), (3, [9.0] * 8, 1, "x")]
    schema = "vec_id long, embedding array<double>, label int, code string"
    frame = spark.createDataFrame(good + bad + odd, schema)
    found, _ = vectors.encode(frame)
    assert sorted(r.vec_id or -1 for r in found.collect()) == sorted([i for i, *_ in good] + [-1, 3, 3])
    assert vectors.encode(frame.limit(0))[0].count() == 0
    none = frame.where(F.col("vec_id").between(40, 44))
    assert vectors.encode(none)[0].count() == 0
