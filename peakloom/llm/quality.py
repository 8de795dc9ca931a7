"""Quality rules as a bitmask ledger.

measure() evaluates every rule once per document and stores the measurements with one failure bit a rule.
Policies are versioned masks over those bits, so another policy, or the effect of leaving a rule out, needs
no second pass over the texts: verdicts and ablations are bitwise work on the ledger.

Defined cases: a null or empty text has no words and fails RULES[0]; a very long text is measured whole, in memory in
proportion to its words; repeated rows and repeated or null doc_ids are measured row by row; other columns are ignored
by the ledger and kept by keep_documents(), whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Runs of capitals and of letters.
KINDS = (regex.compile(r"\p{Lu}+"), regex.compile(r"\p{L}+"))
ASCII_KINDS = (re.compile(r"[A-Z]+"), re.compile(r"[A-Za-z]+"))

#: Rule name and condition over the ledger's measurements, by bit number.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "100 * n_upper > 60 * n_letters"),
    ("exclamations", "10 * n_exclaims > 3 * n_words"),
    ("word_length", "word_chars > 20 * n_words OR (n_words > 0 AND word_chars < 2 * n_words)"),
]
BASE_MASK = 0b11
#: Masks of failure bits that reject a document, by policy version.
POLICIES: dict[str, int] = {"base": BASE_MASK, "v1": 0b1111111}

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_exclaims long"


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: dict = {}
    for w in windows:
        seen[w] = w in seen
    if not any(seen.values()):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w]:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measures(text: str | None) -> tuple[int, ...]:
    """All measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    earlier: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in earlier
            earlier.add(line)
    kinds = ASCII_KINDS if text.isascii() else KINDS
    upper, letters = (sum(map(len, k.findall(text))) for k in kinds)
    return (
        len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated_words(words),
        lines, upper, letters, text.count("!"),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a document: doc (a struct of the columns in keep), the measurements, failures (bit i set where RULES[i] holds)."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    inside = "text" in keep
    rows = docs.select(F.struct(*keep).alias("doc"), *([] if inside else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("doc").field(keep.index("text")) if inside else b.column("text")
            cols = zip(*(measures(t.as_py()) for t in texts), strict=True) if b.num_rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c, pa.int64()) for c in cols)], ["doc", *names])

    bits = [f"(CASE WHEN {cond} THEN {1 << i}L ELSE 0L END)" for i, (_, cond) in enumerate(RULES)]
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {MEASURES}").withColumn("failures", F.expr(" | ".join(bits)))


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measurements, failures."""
    return measured(docs, ["doc_id"]).select("doc.doc_id", *(x.split()[0] for x in MEASURES.split(", ")), "failures")


def verdict(failures: F.Column, policy: str = "v1") -> F.Column:
    """True where the policy keeps the document."""
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by mask (at most 2^rules rows), so the rules are compared on counts alone.
    """
    mask = POLICIES[policy]
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(n).alias("rule")) for i, (n, _) in enumerate(RULES) if mask >> i & 1))).alias("r")
    one = F.expr("shiftleft(1L, r.bit)")
    return (
        counts.select("m", "n", rule)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == one, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("m").bitwiseAND(F.expr("~shiftleft(1L, r.bit)")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def only_rule(failures: F.Column, policy: str = "v1") -> F.Column:
    """The rule without which a policy would keep the document: the name of a single failure bit, else null."""
    own, at = failures.bitwiseAND(F.lit(POLICIES[policy])), F.lit(None).cast("string")
    for i, (rule, _) in enumerate(RULES):
        at = F.when(own == 1 << i, rule).otherwise(at)
    return at


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with all their columns; measured and filtered in one pass."""
    return measured(docs, docs.columns).where(verdict(F.col("failures"), policy)).select("doc.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failures").bitwiseAND(F.lit(BASE_MASK)) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(F.col("failures"))).alias("kept"), "failures",
        only_rule(F.col("failures")).alias("only_rule"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM g),
r AS (SELECT doc_id, i, twice OR coalesce(lag(twice) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS hit FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
  length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters,
  length(text) - length(replace(text, '!', '')) AS n_exclaims
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN ln ON w.doc_id = ln.doc_id),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 60 * n_letters THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_exclaims > 3 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN word_chars > 20 * n_words OR (n_words > 0 AND word_chars < 2 * n_words) THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures,
  CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'shouting' WHEN 32 THEN 'exclamations' WHEN 64 THEN 'word_length' END AS only_rule FROM f
"""
