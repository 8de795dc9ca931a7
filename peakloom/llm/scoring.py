"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor is a mixture of three estimates: the maximum-likelihood estimates of the
bigram and of the unigram, and an even share among all known words and one for unknown ones. The weights depend on the bucket
of the context's frequency (its number of binary digits). A tenth of the training documents is deleted from the counts;
expectation-maximisation on that tenth's bigram counts learns the weights. Scores then use the counts of all training
documents.

How it runs: words are 64-bit hashes. One pass counts them. Documents are written once as codes: the rank of a frequent word
(HEAD_ROWS of them at most, shared with all tasks), or a number among the document's own rare words, whose counts come by a join.
Bigrams then meet in buckets of about BUCKET_EVENTS, as packed columns, sorted and summed up by slice before the shuffle. Bigrams
so frequent that they would fill a bucket (at most HOT_PAIRS) are looked up where the documents are. Only sums of
documents come back, packed by blocks of BLOCK_DOCUMENTS.

Defined cases: a null or empty text has its end as its only token; a null doc_id is training text; repeated rows and ids are
scored row by row; very long texts are read whole; other columns are ignored; an empty table gives no rows; without any
training document all tokens are unknown words. A bucket without deleted tokens takes the weights of the next lower one that has
some; without any, the estimates that exist share evenly. Scores are rounded to nine digits, as sums come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import discard, materialize, mix64, slices, table, text_buffers
from peakloom.llm.shingles import word_hashes
from peakloom.llm.tokens import head_threshold

HEAD_ROWS = 1_000_000
BUCKET_EVENTS = 1_500_000
HOT_PAIRS, HOT_LEAST = 1_000_000, 100_000
#: Bytes of codes of a slice (four a token), and words whose counts a task holds.
SLICE_CODES, COUNTED = 4 << 20, 2_000_000
#: Parts of the documents: counted, deleted from the counts that learn the weights, held out.
COUNTED_PART, DELETED_PART, TEST_PART = 0, 1, 2
DELETED_EVERY = 10
ROUNDS, CLOSE = 30, 1e-5
#: The even share keeps this weight at least, so that no text is impossible.
LEAST_EVEN = 1e-9
#: Documents whose sums travel together (a power of two).
BLOCK_DOCUMENTS = 1024
#: Hashes of the tokens that no text holds, and the key of the first.
START, END = (mix64(np.array([k], np.uint64))[0] for k in (0x5EED51, 0x5EED52))
START_KEY = 1 << 40
#: Frequency buckets: binary digits of a count.
DIGITS = 64


def parted(docs: DataFrame) -> DataFrame:
    """(row, doc_id, part, text)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    deleted = F.floor(h / 5) % DELETED_EVERY == 0
    test = F.col("doc_id").isNotNull() & (h % 5 == 1)
    part = F.when(test, TEST_PART).when(deleted, DELETED_PART).otherwise(COUNTED_PART)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", part.cast("int").alias("part"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n, d): training tokens, the end among them: all, and those of the deleted part."""

    def rows(held: list[np.ndarray], gone: list[np.ndarray]) -> pa.RecordBatch:
        h, inverse, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        d = np.bincount(inverse, np.concatenate(gone), len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(d)], ["hash", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone, size = [], [], 0
        for b in batches:
            body, off = text_buffers(b.column("text"))
            part = b.column("part").to_numpy()
            for i, j in slices(off):
                hashes, first = word_hashes(body[off[i] : off[j]], off[i : j + 1] - off[i])
                held += [hashes, np.full(j - i, END, np.uint64)]
                deleted = part[i:j] == DELETED_PART
                gone += [np.repeat(deleted, np.diff(first)), deleted]
                size += len(hashes) + j - i
                if size >= COUNTED:
                    yield rows(held, gone)
                    held, gone, size = [], [], 0
        if size:
            yield rows(held, gone)

    train = docs.where(F.col("part") != TEST_PART).select("part", "text")
    return train.mapInArrow(run, "hash long, n long, d long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


class Head:
    """The frequent words by rank: hash, n, d; and a search by hash. Also the counts of all words."""

    def __init__(self, found: pa.Table, tokens: int, deleted_tokens: int, words: int, documents: int, deleted_documents: int):
        n, h = found.column("n").to_numpy(), found.column("hash").to_numpy()
        order = np.lexsort((h, -n))
        self.hash, self.n, self.d = h[order].view(np.uint64), n[order], found.column("d").to_numpy()[order]
        self.rank = np.argsort(self.hash, kind="stable").astype(np.int32)
        self.sorted = self.hash[self.rank]
        self.tokens, self.deleted_tokens, self.words = tokens, deleted_tokens, words
        self.documents, self.deleted_documents = documents, deleted_documents
        self.weight = tokens + 0.5 * (words + 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 shares of words by the base score."""
        return np.log10((counts + 0.5) / self.weight)

    def search(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of hashes, -1 where a word isn't frequent."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], np.int32(-1))

    def counts(self, keys: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, d) of keys: of the head by rank, of rare words as given."""
        inside = (keys >= 0) & (keys < len(self.hash))
        at = np.where(inside, keys, 0)
        if len(self.hash):
            n, d = np.where(inside, self.n[at], n), np.where(inside, self.d[at], d)
        begin = keys == START_KEY
        return np.where(begin, self.documents, n), np.where(begin, self.deleted_documents, d)


def coded(docs: DataFrame, head) -> DataFrame:
    """(row, doc_id, part, codes, tails, times, n_tokens, n_head, base_head) of documents.

    codes are int32 ranks, or -1 - k for the k-th of the document's rare words, tails, which occur so many times; n_head tokens
    are frequent, the end among them, and base_head is their part of the base score.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.r_[head.value.base(head.value.n), 0.0]
        end = head.value.base(head.value.documents)
        for b in batches:
            body, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                hashes, first = word_hashes(body[off[i] : off[j]], off[i : j + 1] - off[i])
                code = head.value.search(hashes)
                owner = np.repeat(np.arange(j - i), np.diff(first))
                base = np.bincount(owner, logs[code], j - i) + end
                frequent = np.bincount(owner, code >= 0, j - i).astype(np.int64) + (head.value.documents > 0)
                rare = np.flatnonzero(code < 0)
                doc = np.searchsorted(first, rare, side="right") - 1
                order = np.lexsort((hashes[rare], doc))
                h, k = hashes[rare][order], doc[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])][: len(h)]
                number = np.cumsum(new) - 1
                begins = np.searchsorted(k[new], np.arange(j - i + 1))
                code[rare[order]] = -1 - (number - begins[k])
                codes = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer(code.astype(np.int32).tobytes())])
                tails, times = (pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(x)) for x in (h[new].view(np.int64), np.diff(np.r_[np.flatnonzero(new), len(h)])))
                counts = [pa.array(x) for x in (np.diff(first) + 1, frequent, base)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("row", "doc_id", "part")), codes, tails, times, *counts], ["row", "doc_id", "part", "codes", "tails", "times", "n_tokens", "n_head", "base_head"])

    return docs.mapInArrow(run, f"row long, doc_id {key}, part int, codes binary, tails array<long>, times array<long>, n_tokens long, n_head long, base_head double")


def resolved(codes: DataFrame, words: DataFrame, head: Head) -> DataFrame:
    """coded() rows with the counts of their rare words, tail_n and tail_d, and with n_known and base_score, the add-half unigram score."""
    rare = codes.select("row", F.posexplode(F.arrays_zip(F.col("tails").alias("hash"), F.col("times").alias("times"))).alias("k", "v")).select("row", "k", "v.*")
    n = F.coalesce("n", F.lit(0).cast("long"))
    rare = rare.join(words, "hash", "left").select("row", "k", "times", n.alias("n"), F.coalesce("d", F.lit(0).cast("long")).alias("d"))
    base = F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(head.weight))
    lists = rare.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "n", "d"))).alias("found"), F.sum(base).alias("base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    full = codes.join(lists, "row", "left")
    own = lambda c: F.coalesce(F.col(f"found.{c}"), F.array().cast("array<long>")).alias(f"tail_{c}")
    score = F.round(F.col("base_head") + F.coalesce("base", F.lit(0.0)), 9)
    return full.select("row", "doc_id", "part", "codes", "tails", own("n"), own("d"), "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), score.alias("base_score"))


class Slice:
    """Tokens of some documents in a row, each with its end: doc (number in the slice), key, hash, n, d; before: those of the predecessors."""

    def __init__(self, b: pa.RecordBatch, i: int, j: int, head: Head):
        b = b.slice(i, j - i)
        _, off, body = b.column("codes").buffers()
        off = np.frombuffer(off, np.int32)[b.column("codes").offset : b.column("codes").offset + j - i + 1].astype(np.int64)
        code = np.frombuffer(body, np.int32, (off[-1] - off[0]) // 4, off[0]).astype(np.int64) if off[-1] > off[0] else np.zeros(0, np.int64)
        first = (off - off[0]) // 4
        tails = b.column("tails")
        tail_first = tails.offsets.to_numpy().astype(np.int64)
        tail_first = tail_first - tail_first[0]
        flat = [b.column(c).flatten().to_numpy() for c in ("tails", "tail_n", "tail_d")]
        doc = np.repeat(np.arange(j - i), np.diff(first))
        self.rows, self.parts, self.documents = b.column("row").to_numpy(), b.column("part").to_numpy(), j - i
        size = len(code) + j - i
        at = np.arange(len(code)) + doc
        ends = first[1:] + np.arange(j - i)
        self.doc = np.empty(size, np.int64)
        self.doc[at], self.doc[ends] = doc, np.arange(j - i)
        end = int(head.search(np.array([END]))[0])
        key, n, d = np.full(size, end, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        rare = np.flatnonzero(code < 0)
        where = tail_first[doc[rare]] - 1 - code[rare]
        key[at] = code
        key[at[rare]] = (flat[0][where].view(np.uint64) | np.uint64(1 << 63)).view(np.int64)
        n[at[rare]], d[at[rare]] = flat[1][where], flat[2][where]
        if end < 0:  # only where there is no training document
            key[ends] = np.array([END | np.uint64(1 << 63)]).view(np.int64)
        self.key, self.tail_n, self.tail_d = key, n, d
        self.n, self.d = head.counts(key, n, d)
        self.begins = np.r_[0, ends[:-1] + 1]

    def before(self, x: np.ndarray, start: int) -> np.ndarray:
        out = np.roll(x, 1)
        out[self.begins] = start
        return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(w.view(np.uint64)))


def pack(columns: list[np.ndarray]) -> bytes:
    """Whole-number columns of one length as byte planes, compressed; each column has as many planes as its values need."""
    widths, planes = [], []
    for c in columns:
        c = np.ascontiguousarray(c, np.int64).view(np.uint64)
        width = max(1, -(-int(np.bitwise_or.reduce(c)).bit_length() // 8)) if len(c) else 1
        widths.append(width)
        planes += [(c >> np.uint64(8 * k)).astype(np.uint8) for k in range(width)]
    return bytes(widths) + zstandard.compress(np.concatenate(planes).tobytes(), 1)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob[columns:]), np.uint8).reshape(sum(blob[:columns]), -1)
    out, at = [], 0
    for width in blob[:columns]:
        c = planes[at].astype(np.uint64)
        for k in range(1, width):
            c |= planes[at + k].astype(np.uint64) << np.uint64(8 * k)
        out.append(c.view(np.int64))
        at += width
    return out


def _by_bucket(s: Slice, bucket: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Order of a slice's bigrams (those of the numbers at, or all) by bucket, predecessor and token."""
    words, number = np.unique(s.key, return_inverse=True)
    width = len(words) + 1
    code = s.before(number, width - 1) * width + number
    if at is not None:
        code, bucket = code[at], bucket[at]
    if int(bucket.max(initial=0) + 1) * width * width < 1 << 63:
        return np.argsort(bucket.astype(np.int64) * (width * width) + code)
    return np.lexsort((code, bucket))


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _grouped(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group) of bigrams, in no special order of groups."""
    order = np.argsort(pair_hash(v, w))
    return order, _first(v[order], w[order])


def _blocks(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A packed block a bucket of rows that are sorted by bucket."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    stop = np.r_[first[1:], len(bucket)]
    blobs = [pack([c[i:j] for c in columns]) for i, j in zip(first, stop, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block"])


def _joined(group: pa.Table, width: int) -> list[np.ndarray]:
    """The columns of all blocks of a group."""
    parts = [unpack(x.as_py(), width) for x in group.column("block") if x.is_valid]
    return [np.concatenate([p.pop(0) for p in parts]) if parts else np.zeros(0, np.int64) for _ in range(width)]


def _slices_of(batches: Iterator[pa.RecordBatch], head: Head) -> Iterator[Slice]:
    for b in batches:
        off = np.frombuffer(b.column("codes").buffers()[1], np.int32)[b.column("codes").offset : b.column("codes").offset + b.num_rows + 1]
        for i, j in slices(off, SLICE_CODES):
            yield Slice(b, i, j, head)


def digits(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def pair_counts(docs: DataFrame, head, buckets: int, hot: int) -> DataFrame:
    """(v, w, n, digits, seen, cv, cw, deleted): bigrams of the deleted part, or with n >= hot. docs: resolved() rows.

    n counts all training text; deleted that of the deleted part; seen, cv and cw are the counts of bigram, v and w without it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices_of(batches, head.value):
            v, vn, vd = s.before(s.key, START_KEY), s.before(s.tail_n, 0), s.before(s.tail_d, 0)
            bucket = (pair_hash(v, s.key) >> np.uint64(20)) % np.uint64(buckets)
            order = _by_bucket(s, bucket)
            first = _first(bucket[order], v[order], s.key[order])
            deleted = np.add.reduceat((s.parts[s.doc] == DELETED_PART)[order].astype(np.int64), first)
            one = order[first]
            yield _blocks(bucket[one], [v[one], s.key[one], np.diff(np.r_[first, len(order)]), deleted, vn[one], vd[one], s.tail_n[one], s.tail_d[one]])

    def gather(group: pa.Table) -> pa.Table:
        v, w, n, deleted, vn, vd, wn, wd = _joined(group, 8)
        order, first = _grouped(v, w)
        n, deleted = np.add.reduceat(n[order], first), np.add.reduceat(deleted[order], first)
        one = order[first]
        kept = (deleted > 0) | (n >= hot)
        one, n, deleted = one[kept], n[kept], deleted[kept]
        v, w = v[one], w[one]
        (cv, dv), (cw, dw) = head.value.counts(v, vn[one], vd[one]), head.value.counts(w, wn[one], wd[one])
        return pa.table({"v": v, "w": w, "n": n, "digits": pa.array(digits(cv - dv), pa.int32()), "seen": n - deleted, "cv": cv - dv, "cw": cw - dw, "deleted": deleted})

    train = docs.where(F.col("part") != TEST_PART)
    blocks = train.mapInArrow(spread, "bucket long, block binary")
    return blocks.groupBy("bucket").applyInArrow(gather, "v long, w long, n long, digits int, seen long, cv long, cw long, deleted long")


def learn_weights(pairs: DataFrame, tokens: int, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights [digits, (bigram, unigram, even)] by expectation-maximisation on deleted counts. tokens: those that are not deleted.

    Bigrams that look alike to the estimates are one row; a round is one aggregation of those rows by bucket.
    """
    weights = np.full((DIGITS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if not tokens:
        weights[:] = 0, 0, 1
        return weights
    spark, paths = pairs.sparkSession, []
    alike = pairs.where("deleted > 0").groupBy("digits", "seen", F.when(F.col("seen") > 0, F.col("cv")).otherwise(F.lit(1)).alias("cv"), "cw").agg(F.sum("deleted").alias("times"))
    alike = materialize(alike, paths)
    last, seen = None, np.zeros(DIGITS, bool)
    for _ in range(rounds):
        at = [F.element_at(F.array(*(F.lit(float(x)) for x in weights[:, k])), F.col("digits") + 1) for k in range(3)]
        shares = [at[0] * F.col("seen") / F.col("cv"), at[1] * F.col("cw") / F.lit(float(tokens)), at[2] / F.lit(float(words + 1))]
        rows = alike.select("digits", "times", *(x.alias(f"p{k}") for k, x in enumerate(shares))).withColumn("p", F.col("p0") + F.col("p1") + F.col("p2")).where("p > 0")
        found = rows.groupBy("digits").agg(*(F.sum(F.col("times") * F.col(f"p{k}") / F.col("p")).alias(f"s{k}") for k in range(3)), F.sum(F.col("times") * F.log("p")).alias("fit")).collect()
        fit = sum(r.fit for r in found)
        for r in found:
            mass = np.array([r.s0, r.s1, r.s2])
            mass[2] = max(mass[2], LEAST_EVEN * mass.sum())
            weights[r.digits], seen[r.digits] = mass / mass.sum(), True
        if last is not None and abs(fit - last) <= CLOSE * abs(last):
            break
        last = fit
    for k in range(2, DIGITS):
        if not seen[k] and seen[1:k].any():
            weights[k] = weights[k - 1]
    discard(spark, paths)
    return weights


def mixture(head: Head, weights: np.ndarray, vn: np.ndarray, wn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, q): a token's probability is a * count of its bigram + q, by the counts of its predecessor and of itself."""
    at = weights[digits(vn)]
    return at[:, 0] / np.maximum(vn, 1), at[:, 1] * wn / max(1, head.tokens) + at[:, 2] / (head.words + 1)


def model_scores(docs: DataFrame, head, hot, weights: np.ndarray, buckets: int) -> DataFrame:
    """(row, score): the log10 probability of every document. docs: resolved() rows; hot: broadcast (pair hashes, counts), sorted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = hot.value
        for k, s in enumerate(_slices_of(batches, head.value)):
            v, vn, vt = s.before(s.key, START_KEY), s.before(s.n, head.value.documents), s.before(s.tail_n, 0)
            h = pair_hash(v, s.key)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            known = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            here = known | (vn == 0) | (s.n == 0)
            a, q = mixture(head.value, weights, vn[here], s.n[here])
            n = np.where(known, counts[at], 0)[here] if len(hashes) else 0
            sums = np.bincount(s.doc[here], np.log10(a * n + q), s.documents).astype(np.float64)  # of nothing it counts whole numbers
            there = np.flatnonzero(~here)
            bucket = (h >> np.uint64(20)) % np.uint64(buckets)
            # sorted by v and w, columns pack well
            order = _by_bucket(s, bucket, there)
            at = there[order]
            train = s.parts[s.doc] != TEST_PART
            if len(at):
                b = _blocks(bucket[at], [v[at], s.key[at], s.rows[s.doc[at]], train[at], vt[at], s.tail_n[at]])
                nothing = [pa.array([[]] * b.num_rows, pa.list_(t)) for t in (pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *nothing], ["bucket", "block", "rows", "sums"])
            yield pa.RecordBatch.from_arrays([pa.array([k % buckets], pa.int64()), pa.array([None], pa.binary()), pa.array([s.rows]), pa.array([sums])], ["bucket", "block", "rows", "sums"])

    def gather(group: pa.Table) -> pa.Table:
        rows, sums = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "sums"))
        v, w, row, train, vt, wt = _joined(group, 6)
        order, first = _grouped(v, w)
        if len(v):
            n = np.add.reduceat(train[order], first)
            one = order[first]
            a, q = mixture(head.value, weights, head.value.counts(v[one], vt[one], vt[one])[0], head.value.counts(w[one], wt[one], wt[one])[0])
            rows, sums = np.r_[rows, row[order]], np.r_[sums, np.repeat(np.log10(a * n + q), np.diff(np.r_[first, len(order)]))]
        return _by_document(rows, sums)

    def _by_document(rows: np.ndarray, sums: np.ndarray) -> pa.Table:
        """A row a block of documents: their numbers, and the sums of each."""
        rows, at = np.unique(rows, return_inverse=True)
        sums = np.bincount(at, sums, len(rows)).astype(np.float64)
        place = rows // BLOCK_DOCUMENTS
        first = _first(place)
        cuts = pa.array(np.r_[first, len(rows)], pa.int32())
        return pa.table({"place": place[first], "rows": pa.ListArray.from_arrays(cuts, pa.array(rows)), "sums": pa.ListArray.from_arrays(cuts, pa.array(sums))})

    def total(group: pa.Table) -> pa.Table:
        rows, sums = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "sums"))
        rows, at = np.unique(rows, return_inverse=True)
        return pa.table({"row": rows, "score": np.round(np.bincount(at, sums, len(rows)).astype(np.float64), 9)})

    blocks = docs.mapInArrow(spread, "bucket long, block binary, rows array<long>, sums array<double>")
    parts = blocks.groupBy("bucket").applyInArrow(gather, "place long, rows array<long>, sums array<double>")
    return parts.groupBy("place").applyInArrow(total, "row long, score double")


def score_documents(docs: DataFrame, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, paths = docs.sparkSession, []
    share = spark.sparkContext.broadcast
    docs = parted(docs)
    words = materialize(word_counts(docs))
    total = words.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("d"), F.count("*")))).first()
    ends = words.where(F.col("hash") == int(END.view(np.int64))).first()
    least = head_threshold(words, head_rows)
    head = Head(words.where(F.col("n") >= least).toArrow(), *total, *((ends.n, ends.d) if ends else (0, 0)))
    shared = share(head)
    codes = materialize(coded(docs, shared), paths)
    ready = materialize(resolved(codes, words.where(F.col("n") < least), head))
    discard(spark, paths)
    buckets = max(8, -(-head.tokens * 5 // (4 * BUCKET_EVENTS)))
    hot = max(HOT_LEAST, head.tokens // HOT_PAIRS)
    pairs = materialize(pair_counts(ready, shared, buckets, hot), paths)
    weights = learn_weights(pairs, head.tokens - head.deleted_tokens, head.words)
    frequent = pairs.where(F.col("n") >= hot).select("v", "w", "n").toArrow()  # at most HOT_PAIRS rows
    h = pair_hash(frequent.column("v").to_numpy(), frequent.column("w").to_numpy())
    order = np.argsort(h)
    scores = model_scores(ready, shared, share((h[order], frequent.column("n").to_numpy()[order])), weights, buckets)
    discard(spark, paths)
    return ready.join(scores, "row").select(
        "doc_id", (F.col("part") == TEST_PART).alias("held_out"), "n_tokens", "n_known", F.lit(head.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
