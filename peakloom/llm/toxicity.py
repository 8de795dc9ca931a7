"""Toxic spans by a linear-chain conditional random field.

The labels mark documents, so token labels are derived first. Over all labelled training rows (texts that are
equal count once), terms - words and their prefixes - are chosen by their odds in toxic documents, if these differ
from 1 by a fixed significance, and greedily by how many toxic documents they explain that no chosen term explains
yet, until no term explains LEAST_DOCS more: terms that merely come along in copies of one text explain none. Tokens
of toxic documents with a chosen term are labelled toxic, all others clean.

The field is fitted to a bounded sample of the training rows: at most SAMPLE_TOXIC and SAMPLE_CLEAN documents, chosen
by a hash of their id whatever their length. Of a text longer than WINDOW characters one window, placed by a hash of the text,
gives the token sequence; the document score is fitted to the whole texts of the sample.

The field has two states; a token's own score is a sum over its terms and over the words to its left and right.
Forward-backward marginals give every token its probability to be toxic. A document's score is a logistic function of
their sum, their share of the tokens and the largest one; runs of tokens above one half are its offending
spans, in code points of the text itself.

Defined cases: a null, empty or letterless text scores 0; very long texts are scored whole; labels of one doc_id that
differ count as toxic if any is; null labels don't count; without toxic training rows every score is 0; rows are scored
one by one, also with repeated or null doc_ids (a null one is not held out); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, table

THRESHOLD = 0.7
SAMPLE_TOXIC, SAMPLE_CLEAN, WINDOW = 800, 2400, 8_000
#: Lengths of the prefixes that are terms.
PREFIXES = (4, 5, 6, 7)
#: Terms with weights of their own, the most frequent of the sample.
VOCABULARY = 200_000
#: A lexicon term: toxic documents, odds ratio and log-likelihood ratio that it needs (20: about once in 100,000 terms by chance),
#: and share of the best support to be chosen with it.
LEAST_DOCS, LEAST_ODDS, LEAST_G2, NEAR_BEST = 5, 4.0, 20.0, 0.6
FOLDS, HELD_OUT = 3, 1

TOKEN = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word and its prefixes, which end in a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str) -> list[str]:
    """The letter runs of a text, each in lower case."""
    if "\u0130" in text:  # the one letter whose lower case is not one letter
        return [w.lower() for w in TOKEN.findall(text)]
    return TOKEN.findall(text.lower())


@dataclass
class Field:
    """Weights of the fitted field and of the document score."""

    weights: dict[str, float]  # by term; "<w" and ">w" are the words w to the left and right
    bias: float
    moves: np.ndarray  # 2 x 2, moves[a, b]: score of state b after state a
    start: float
    doc: np.ndarray  # intercept and weights of document_features()


class Emissions(dict):
    """Row numbers by word in a table of log odds of the toxic state: its own, as left and as right neighbour."""

    def __init__(self, field: Field, most: int = 400_000):
        super().__init__()
        self.field, self.most = field, most
        self.table = np.zeros((1 << 12, 3))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        get = self.field.weights.get
        self.table[k] = self.field.bias + sum(get(t, 0.0) for t in terms(word)), get("<" + word, 0.0), get(">" + word, 0.0)
        return k

    def of(self, texts: list[list[str]], first: np.ndarray) -> np.ndarray:
        """Log odds of all tokens; first is where each text begins."""
        if len(self) > self.most:
            self.clear()
        k = np.fromiter((self[w] for t in texts for w in t), np.int64, int(first[-1]))
        own, left, right = self.table[k].T
        emit = own.copy()
        emit[1:] += left[:-1]
        emit[:-1] += right[1:]
        inner = first[1:-1]
        inner = inner[(inner > 0) & (inner < len(k))]
        inner = np.unique(inner)  # texts don't see each other
        emit[inner] -= left[inner - 1]
        emit[inner - 1] -= right[inner]
        return emit


def forward_backward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of each token's marginal, log odds from the left alone) for all texts at once.

    With two states the messages are log odds, so a step is one vector operation over the texts that are
    still running; texts are taken by falling length.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    starts, length = first[:-1][order], length[order]
    running = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    (oo, ot), (to, tt) = np.exp(moves)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t, k in enumerate(running):
        at = starts[:k] + t
        if t:
            e = np.exp(np.clip(alpha[at - 1], -50, 50))
            alpha[at] = emit[at] + np.log((e * tt + ot) / (e * to + oo))
        else:
            alpha[at] = emit[at] + start
    for t in range(len(running) - 2, -1, -1):
        k = running[t + 1]
        at = starts[:k] + t
        e = np.exp(np.clip(emit[at + 1] + beta[at + 1], -50, 50))
        beta[at] = np.log((tt * e + to) / (ot * e + oo))
    return alpha + beta, alpha


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: 1, log of the sum of its tokens' probabilities, log of their mean, and the largest one."""
    total = np.add.reduceat(np.append(p, 0.0), first[:-1]) if len(first) > 1 else np.zeros(0)
    most = np.maximum.reduceat(np.append(p, 0.0), first[:-1]) if len(first) > 1 else np.zeros(0)
    n = np.diff(first)
    total, most = np.where(n, total, 0.0), np.where(n, most, 0.0)
    return np.stack([np.ones(len(n)), np.log(total + 1e-3), np.log(total / np.maximum(n, 1) + 1e-5), most], axis=1)


def _logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: list[list[str]], labels: list[list[int]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximise the likelihood of the labelled sequences by adaptive gradient steps."""
    words = Counter(w for text in texts for w in text)
    counts = Counter()
    for w, n in words.items():
        for t in (*terms(w), "<" + w, ">" + w):
            counts[t] += n
    names = sorted(t for t, n in counts.most_common(VOCABULARY) if n > 1)
    del counts
    number = {t: i + 1 for i, t in enumerate(names)}  # 0: no weight
    place = {w: i for i, w in enumerate(words)}
    at = np.fromiter((place[w] for text in texts for w in text), np.int32)
    y = np.array([v for t in labels for v in t], float)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    head = np.zeros(len(at), bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    # a column of term numbers by token for the word, each prefix, and the words to the left and right
    own_terms = [terms(w) for w in words]
    columns = [np.array([number.get(t[k], 0) if k < len(t) else 0 for t in own_terms], np.int32)[at] for k in range(len(PREFIXES) + 1)]
    left, right = (np.array([number.get(mark + w, 0) for w in words], np.int32)[at] for mark in "<>")
    left, right = np.append(0, left[:-1]).astype(np.int32), np.append(right[1:], 0).astype(np.int32)
    left[head], right[np.append(head[1:], True)] = 0, 0
    columns += [left, right]
    del own_terms, place, words
    own, bias, moves, start = np.zeros(len(names) + 1), -2.0, np.zeros((2, 2)), 0.0
    here, heads = np.flatnonzero(~head), np.flatnonzero(head)  # tokens with and without a left neighbour
    ya, yb = y[here - 1], y[here]
    true = np.stack([(1 - ya) * (1 - yb), (1 - ya) * yb, ya * (1 - yb), ya * yb]).sum(axis=1)
    seen = [np.full(len(own), 1e-2), np.full(1, 1e-2), np.full(4, 1e-2), np.full(1, 1e-2)]
    for _ in range(rounds):
        emit = bias + sum(own[c] for c in columns)
        odds, alpha = forward_backward(emit, first, moves, start)
        gap = y - _logistic(odds)
        # pair marginals: left message, move, and all that the right token and what follows say
        a, b = np.exp(np.clip(alpha[here - 1], -50, 50)), np.exp(np.clip(odds[here] - alpha[here] + emit[here], -50, 50))
        m = np.exp(moves)
        joint = np.stack([np.full(len(here), m[0, 0]), m[0, 1] * b, m[1, 0] * a, m[1, 1] * a * b])
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        steps = [
            sum(np.bincount(c, gap, len(own)) for c in columns) - ridge * own,
            np.array([gap.sum()]),
            true - joint - ridge * moves.ravel(),
            np.array([gap[heads].sum() - ridge * start]),
        ]
        moved = []
        for g, s in zip(steps, seen, strict=True):
            s += g * g
            moved.append(rate * g / np.sqrt(s))
        moved[0][0] = 0.0
        own += moved[0]
        bias += float(moved[1][0])
        moves = moves + moved[2].reshape(2, 2)
        start += float(moved[3][0])
    return Field({t: float(own[i]) for t, i in number.items() if own[i]}, bias, moves, start, np.zeros(4))


# -- Spark jobs ----------------------------------------------------------------------------------------------


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = bounded_broadcast(materialize(marks.where(~held_out(F.col("doc_id")))))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(marks, "doc_id")
    # equal texts of one label count once
    return rows.groupBy(F.sha1("text").alias("t"), "toxic").agg(F.min_by("doc_id", "doc_id").alias("doc_id"), F.first("text").alias("text")).drop("t")


def _distinct_terms(text: str) -> set[str]:
    return {x for w in set(words_of(text)) for x in terms(w)}


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, n1, n0): documents of each label that hold a term; counted by batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for mark, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([mark] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "mark", "n"])
                c.clear()

        for b in batches:
            for t, mark in zip(b.column("text"), b.column("mark").to_pylist(), strict=True):
                counts[mark].update(_distinct_terms(t.as_py()))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from flush()
        yield from flush()

    parts = rows.select("text", (F.col("toxic") == 1).cast("int").alias("mark")).mapInArrow(run, "term string, mark int, n long")
    by = lambda m: F.sum(F.when(F.col("mark") == m, F.col("n")).otherwise(0))
    return parts.groupBy("term").agg(by(1).alias("n1"), by(0).alias("n0"))


def _term_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, term) of the distinct terms of each text."""
    key = rows.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column("text")):
                own = _distinct_terms(t.as_py())
                at += [i] * len(own)
                found += own
                if len(found) > 200_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["doc_id", "term"])
                    at, found = [], []

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, term string")


def likelihood_ratio(k1: F.Column, k0: F.Column, n1: int, n0: int) -> F.Column:
    """The log-likelihood ratio (G squared) of k1 of n1 against k0 of n0."""
    total = 0.0
    for k, n in ((k1, n1), (k0, n0)):
        expected = (k1 + k0) * n / float(n1 + n0)
        for seen, want in ((k, expected), (n - k, n - expected)):
            total += F.when(seen > 0, 2 * seen * F.log(seen / want)).otherwise(0.0)
    return total


def lexicon(rows: DataFrame) -> DataFrame:
    """(term) of the toxic terms by residual support over all training rows."""
    totals = rows.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()
    n1, n0 = (sum(r.n for r in totals if r.t == t) for t in (True, False))
    odds = (F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1))
    marked = _term_counts(rows).where((F.col("n1") >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (likelihood_ratio(F.col("n1"), F.col("n0"), n1, n0) >= LEAST_G2))
    marked = materialize(marked.select("term"))
    open_ = materialize(_term_sets(rows.where("toxic = 1")).join(bounded_broadcast(marked), "term"))
    chosen = marked.where("false")
    while True:
        # the best support falls by a constant factor with every round, so there are few of them
        support = materialize(open_.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS))
        best = support.agg(F.max("n")).first()[0]
        if best is None:
            return chosen
        new = support.where(F.col("n") >= NEAR_BEST * best).select("term")
        chosen = chosen.union(new)
        explained = open_.join(bounded_broadcast(new), "term").select("doc_id").distinct()
        open_ = materialize(open_.join(explained, "doc_id", "left_anti"))


def sampled(rows: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most SAMPLE_TOXIC and SAMPLE_CLEAN rows, those of the least hashes of their ids.

    Only rows below a threshold of the hash that some more than enough rows meet are sorted.
    """
    totals = {r.t: r.n for r in rows.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for mark, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN)):
        n = totals.get(mark, 0)
        key = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
        below = rows.where(((F.col("toxic") == 1) == mark) & (key <= int(min(1.0, (1.3 * most + 50) / max(n, 1)) * (1 << 30))))
        parts.append(below.orderBy(key, "doc_id").limit(most))
    return parts[0].unionByName(parts[1]).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Lexicon over all training rows, then the field on a bounded sample of them."""
    rows = materialize(training_rows(docs, labels))
    nothing = Field({}, -50.0, np.zeros((2, 2)), 0.0, np.array([-50.0, 0.0, 0.0, 0.0]))
    known = materialize(lexicon(rows).distinct())
    sample = materialize(sampled(rows))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    windows = materialize(sample.select("doc_id", F.substring("text", start, F.lit(WINDOW)).alias("text"), "toxic"))
    # of the lexicon, only what occurs in the windows comes to the driver
    chosen = {r.term for r in _term_sets(windows).select("term").distinct().join(known, "term").collect()}
    seen = windows.select("text", "toxic").collect()
    texts = [words_of(r.text) for r in seen]
    marks = [[int(r.toxic == 1 and not chosen.isdisjoint(terms(w))) for w in t] for r, t in zip(seen, texts, strict=True)]
    if not any(map(any, marks)):
        return nothing
    field = fit(texts, marks)
    facts = score(sample, field, ["toxic"]).select("toxic", "facts").collect()
    field.doc = _logistic_fit(np.array([r.facts for r in facts]), np.array([float(r.toxic == 1) for r in facts]))
    return field


def tag(texts: list[str], field: Field, emissions: Emissions) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(document_features(), offending spans) of each text."""
    tokens = [words_of(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    p = _logistic(forward_backward(emissions.of(tokens, first), first, field.moves, field.start)[0])
    spans = []
    for i, text in enumerate(texts):
        own = p[first[i] : first[i + 1]]
        spans.append([])
        if len(own) and own.max() >= 0.5:
            places = [m.span() for m in TOKEN.finditer(text)]
            hot = own >= 0.5
            for k in np.flatnonzero(hot):
                if spans[-1] and k and hot[k - 1]:
                    spans[-1][-1] = (spans[-1][-1][0], places[k][1])
                else:
                    spans[-1].append(places[k])
    return document_features(p, first), spans


def score(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns of keep, score, facts, spans) of every document; spans is start:end, comma-joined."""
    names = ["doc_id", *(keep or [])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = Emissions(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            facts, spans, k = [], [], 0
            while k < len(texts):  # by a few MB of text
                stop, size = k, 0
                while stop < len(texts) and (stop == k or size + len(texts[stop]) <= 4 << 20):
                    size += len(texts[stop])
                    stop += 1
                found, where = tag(texts[k:stop], model, emissions)
                facts.append(found)
                spans += [",".join(f"{a}:{z}" for a, z in w) for w in where]
                k = stop
            facts = np.concatenate(facts) if facts else np.zeros((0, 4))
            # without a token the largest probability is 0
            scores = np.where(facts[:, 3] > 0, _logistic(facts @ model.doc), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores), pa.array(list(facts), pa.list_(pa.float64())), pa.array(spans, pa.string())], [*names, "score", "facts", "spans"])

    return docs.select(*names, "text").mapInArrow(run, f"{fields}, score double, facts array<double>, spans string")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("score", 9).alias("score"), (F.round("score", 9) >= THRESHOLD).cast("int").alias("predicted"), "spans")
