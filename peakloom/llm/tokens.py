"""Token counts of a public tokenizer without token ids.

A text is cut into pre-tokens: at white space and between letters or digits and ASCII punctuation, none of which
the tokenizer's normalisation or its own pre-tokenisation ever bridges. Every distinct pre-token of the corpus
is counted once by the library; per-document pre-token frequencies are joined to those counts and summed. The
most frequent pre-tokens, a bounded number, are joined where the text is; the others, rare each, in a shuffle.
Special strings inside a text count as one token each, as the library takes them by default, and end a pre-token.

Defined cases: a null text is empty and has 0 tokens; rows are counted one by one, also with repeated or null
doc_ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import materialize, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens that are joined on the map side.
HEAD_ROWS = 300_000
#: Unicode White_Space, which the tokenizer's patterns call \s; its pieces never hold any.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{SPACE}]+")
#: Between a Latin letter or a digit and ASCII punctuation but for the apostrophe, which may begin a contraction.
_SEAM = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9À-ÖØ-öø-ÿ])")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def special_strings(path: str) -> re.Pattern:
    added = tokenizer(path).get_added_tokens_decoder().values()
    return re.compile("|".join(re.escape(x.content) for x in sorted(added, key=lambda x: -len(x.content))) or r"(?!)")


def frequencies(text: str, special: re.Pattern) -> tuple[Counter, int]:
    """(pre-token frequencies, special strings) of a text."""
    found = 0
    if special.search(text):
        text, found = special.subn(" ", text)
    try:
        text.encode("latin-1")
        text = text.lower()  # one character for one, as the tokenizer does it
    except UnicodeEncodeError:
        pass
    return Counter(_WORD.findall(_SEAM.sub(" ", text))), found


def totals(docs: DataFrame, path: str, most: int = 200_000) -> DataFrame:
    """(chunk, n): distinct pre-tokens of the corpus and how often they occur; tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, held = special_strings(path), Counter()

        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["chunk", "n"])

        for b in batches:
            for t in b.column("text"):
                if t.is_valid:
                    held.update(frequencies(t.as_py(), special)[0])
                    if len(held) >= most:
                        yield rows(held)
                        held = Counter()
        yield rows(held)

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def piece_counts(chunks: DataFrame, path: str) -> DataFrame:
    """(chunk, n, pieces) of distinct pre-tokens (chunk, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            words = b.column("chunk").to_pylist()
            pieces = [len(e) for k in range(0, len(words), 4096) for e in t.encode_batch(words[k : k + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("n"), pa.array(pieces, pa.int32())], ["chunk", "n", "pieces"])

    return chunks.mapInArrow(run, "chunk string, n long, pieces int")


def head_counts(docs: DataFrame, path: str, head: dict[str, int]) -> DataFrame:
    """Per document: row, doc_id, n_bytes, tokens (of pre-tokens in head, and special strings), rest (the others with frequencies)."""
    key = docs.select("doc_id").schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(head)
    pair = pa.list_(pa.struct([("chunk", pa.string()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, get = special_strings(path), shared.value.get
        for b in batches:
            size, tokens, rest = [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                freq, total = frequencies(text, special)
                others = []
                for chunk, n in freq.items():
                    pieces = get(chunk)
                    if pieces is None:
                        others.append({"chunk": chunk, "times": n})
                    else:
                        total += n * pieces
                size.append(len(text.encode()))
                tokens.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(rest, pair)], ["row", "doc_id", "n_bytes", "tokens", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {key}, n_bytes long, tokens long, rest array<struct<chunk:string,times:bigint>>")


def head_threshold(vocabulary: DataFrame, most: int) -> int:
    """The least frequency such that at most `most` pre-tokens are as frequent."""
    top = 100_000  # frequencies above count as this one
    total, least = 0, top + 1
    for r in vocabulary.groupBy(F.least("n", F.lit(top)).alias("f")).agg(F.count("*").alias("c")).orderBy(F.desc("f")).toLocalIterator():
        total += r.c
        if total > most:
            break
        least = r.f
    return least


def count_tokens(docs: DataFrame, path: str, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, of the tokenizer file at path."""
    vocabulary = materialize(piece_counts(totals(docs, path), path))
    least = head_threshold(vocabulary, head_rows)
    head = {r.chunk: r.pieces for r in vocabulary.where(F.col("n") >= least).select("chunk", "pieces").toLocalIterator()}
    part = materialize(head_counts(docs, path, head))
    rare = vocabulary.where(F.col("n") < least).select("chunk", "pieces")
    rest = part.select("row", F.inline("rest")).join(rare, "chunk").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return part.join(rest, "row", "left").select("doc_id", "n_bytes", (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
