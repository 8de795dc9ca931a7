import hashlib
import random

import numpy as np

from peakloom.llm import suffixes as S


def brute(rows):
    texts = [(S.LAST_ID if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, b in texts:
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for key, i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (key, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str)


def cases():
    rng = random.Random(3)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    passages = [word(300, "abcdé ") for _ in range(3)]
    rows = [(i, word(rng.randint(0, 250), "abcdefgh ") + rng.choice([*passages, ""])[rng.randint(0, 100) : rng.randint(150, 300)] + word(rng.randint(0, 150), "xyz ")) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "Und " * 400), (102, "ab" * 120), (103, None), (104, ""), (105, rows[3][1]), (105, rows[4][1]), (3, rows[3][1]), (None, rows[7][1]), (None, rows[7][1] + "zz"), (50, "q" * 3000)]
    return rows


def test_against_all_windows(spark):
    rows = cases()
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_names_and_small_chunks(spark, monkeypatch):
    """Few runs make a name hot, and chunks hold little, so that shares, shards and chunk ends all occur.

    The settings reach the workers by the functions' modules only in this process, so the kernels run here.
    """
    monkeypatch.setattr(S, "HOT_RUNS", 2)
    rows = cases()
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_awkward_rows(spark, odd_docs, no_docs):
    assert run(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert run(no_docs) == []


def test_merged_shards_equal_one_sort():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 4000).astype(np.uint8)
    text[1000:1400] = text[100:500]
    text[3000:3300] = text[1050:1350]
    places = np.arange(len(text) - S.LENGTH + 1)
    got = S.repeated(text, np.array_split(places, 5))
    first = {}
    for p in places:
        first.setdefault(text[p : p + S.LENGTH].tobytes(), p)
    assert all(got[p] == first[text[p : p + S.LENGTH].tobytes()] for p in places)
