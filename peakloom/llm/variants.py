"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet.

Every letter is hashed to one of SYMBOLS symbols, so a word becomes a reduced word. If two words are one edit apart, their
reduced words are equal or one edit apart. So each reduced word's neighbourhood is generated whole and joined with the
reduced vocabulary; the pairs found are verified on the original strings. Of the two sides of a pair one generates it:
the longer word by a deletion, or that with the smaller symbol by a replacement; equal reduced words meet by themselves.
Reduced words are compared by 64-bit polynomial hashes, which numpy derives for all edits of all words of a batch from
prefix hashes; a chance collision costs a verification and changes nothing.

A word's form is its near word of largest count (ties: the first in code-point order) where that count is at least RATIO times
its own. Forms lead to ever larger counts, so following them ends; roots come by pointer doubling.

Defined cases: null, empty and other texts without letters have no words; a null doc_id counts as an empty string in the hash;
repeated rows count as often as they occur; very long texts are read whole, word by word; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import discard, materialize, mix64, table

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: A word needs so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has at least so many times its word's count.
RATIO = 2
#: Of the hashes of (document, run), those that this divides lose a code point.
DROP_EVERY = 97

#: Code points up to which a word travels with its keys.
LONG = 100
VERIFIED = "levenshtein(a, b, 1) = 1"

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 after lower-casing A-Z.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def dropped(run: bytes, h: int) -> bytes:
    """The run without its code point number h modulo its length."""
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def text_words(text: bytes, doc_id: str, least: int = LEAST_LENGTH) -> Counter:
    """Words of one text with at least `least` code points, with their counts."""
    words: Counter = Counter()
    before = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.lower())).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run, before)
        if h % DROP_EVERY == 0:
            run = dropped(run, h)
        if len(run) >= least and (run.isascii() or len(run.decode()) >= least):
            words[run] += n
    return words


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, most: int = 300_000) -> DataFrame:
    """(word, n) of all words that occur often enough; tasks sum up before the shuffle, `most` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            ids = b.column("id").to_pylist()
            for i, t in zip(ids, b.column("text").cast(pa.binary()), strict=True):
                if t.is_valid:
                    held.update(text_words(t.as_py(), i))
                    if len(held) >= most:
                        yield rows()
                        held = Counter()
        yield rows()

    one = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return one.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol 0 to SYMBOLS - 1 of every code point."""
    return mix64(points.astype(np.uint64) + np.uint64(1)) % np.uint64(SYMBOLS)


def neighbourhood(reduced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own keys, edited keys, numbers of the words they come from) of reduced words of one length, a row each.

    A key is the sum of (symbol + 1) * base^position, and the length, mixed. Edited words: all deletions (one of each run of
    equal symbols) and all replacements by a larger symbol.
    """
    n, length = reduced.shape
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, _BASE, np.uint64)])
    terms = (reduced + np.uint64(1)) * power[:length]
    before = np.hstack([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)])
    whole = before[:, -1:]
    who, keys = [], []
    lone = np.hstack([np.ones((n, 1), bool), reduced[:, 1:] != reduced[:, :-1]])
    shorter = before[:, :-1] + (whole - before[:, 1:]) * _BACK
    row, at = np.nonzero(lone)
    who.append(row)
    keys.append(mix64(shorter[row, at] ^ np.uint64(length - 1)))
    for more in range(1, SYMBOLS):
        row, at = np.nonzero(reduced + np.uint64(more) < SYMBOLS)
        who.append(row)
        keys.append(mix64((whole[row, 0] + power[at] * np.uint64(more)) ^ np.uint64(length)))
    return mix64(whole[:, 0] ^ np.uint64(length)), np.concatenate(keys), np.concatenate(who)


def _keys(words: DataFrame, edited: bool) -> DataFrame:
    """(key, word, n): the reduced word's own key, or those of its neighbourhood; word is the id where words has a column id."""

    name = "id" if "id" in words.columns else "word"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                texts = b.column("word").to_pylist()
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                for length in np.unique(lengths):
                    at = np.flatnonzero(lengths == length)
                    # very long words a few at a time: a neighbourhood has some SYMBOLS * length keys
                    step = max(1, 2_000_000 // (SYMBOLS * int(length)))
                    for k in range(0, len(at), step):
                        mine = at[k : k + step]
                        points = np.frombuffer("".join(texts[i] for i in mine).encode("utf-32-le"), np.uint32).reshape(len(mine), length)
                        own, keys, who = neighbourhood(symbols(points))
                        keys, rows = (keys, mine[who]) if edited else (own, mine)
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(name).take(take), b.column("n").take(take)], ["key", "word", "n"])

    return words.mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of words one edit apart, each once. words: a written table (word, n) of distinct words.

    Words longer than LONG code points are known by hash until a pair is found, as a neighbourhood holds its word once a key.
    """
    size = F.char_length("word")
    pairs = _pairs(words.where(size <= LONG)).where(VERIFIED)
    ids = words.where(size >= LONG).select("word", "n", F.xxhash64("word").cast("string").alias("id"))
    met = _pairs(ids)
    for side in "ab":
        met = met.join(ids.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word")), side)
    met = met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "n_a", "n_b").where(F.greatest(F.char_length("a"), F.char_length("b")) > LONG)
    return pairs.unionByName(met.where(VERIFIED))


def _pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of words, or of their ids where they have some, whose reduced words meet."""
    own = _keys(words, False).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    other = _keys(words, True).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    same = own.select("key", F.col("b").alias("a"), F.col("n_b").alias("n_a"))
    return other.join(own, "key").unionByName(same.join(own, "key").where(F.col("a") < F.col("b"))).select("a", "b", "n_a", "n_b")


def variants(words: DataFrame) -> DataFrame:
    """Per word of a written table (word, n): word, n, n_near, form, form_n, root."""
    pairs = near_pairs(words)
    both = pairs.select(F.expr("inline(array(named_struct('word', a, 'near', b, 'near_n', n_b), named_struct('word', b, 'near', a, 'near_n', n_a)))"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.m") >= RATIO * F.col("n")
    rows = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of links (word, root), by pointer doubling; chains have no loops."""
    spark = links.sparkSession
    kept: list[str] = []
    at = materialize(links, kept)
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(step, "root", "left_semi").take(1):
            return at
        old, kept = kept, []
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), kept)
        discard(spark, old)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(vocabulary(table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
