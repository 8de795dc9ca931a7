"""Secret scans with DataFrame functions alone.

Base patterns are cut out of a text with split() beside regexp_extract_all(): the pieces between matches give
the start of every match as a running sum of lengths. On top of them, candidate strings go through a sliding
window whose Shannon entropy is kept by incremental counts, per character class; an allow-list suppresses
public identifiers, and spans inside a base span are not repeated. A candidate must hold a digit and a letter to be
measured: runs of digits are numbers, runs of letters are words.

Positions are code points, ends exclusive. Defined cases: a null text is empty and has no spans; a very long text is
searched whole; every row gives a row, also for repeated or null doc_ids; other columns are ignored by the scan and kept
by redact(), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.common import materialize, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What holds wherever a match long enough exists; only such texts are cut up.
HAS_ACCESS, HAS_HEX = r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Window length, and the entropy in bits that a window must reach by character class.
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.85
#: Suppressed candidates: key fingerprints, UUIDs, documentation samples, runs of the alphabet, paths of words.
ALLOWED = r"^[0-9A-F]{40}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|EXAMPLE|(?i)abcdefghij|0123456789|^[A-Za-z]+([/_=-]+[A-Za-z]+)*$"


def window_entropy(s: F.Column, width: int = WINDOW) -> F.Column:
    """The largest entropy (bits) over all windows of `width` ASCII characters of s.

    Entropy of a window is log2(w) - sum(c * log2(c)) / w over its character counts c. A step adds one
    character and drops one, so only two terms of the sum change.
    """
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)))

    def over(chars: F.Column) -> F.Column:
        code = lambda i: F.ascii(F.element_at(chars, i))

        def step(a: F.Column, i: F.Column) -> F.Column:
            new, old, full = code(i), code(F.greatest(i - width, F.lit(1))), i > width
            at = lambda c: F.element_at(a["counts"], c + 1)
            term = lambda n: F.element_at(terms, n + 1)
            counts = F.transform(a["counts"], lambda v, k: v + F.when(k == new, 1).otherwise(0) - F.when(full & (k == old), 1).otherwise(0))
            gain = term(at(new) + 1) - term(at(new))
            total = F.when(full & (new == old), a["total"]).otherwise(a["total"] + gain + F.when(full, term(at(old) - 1) - term(at(old))).otherwise(0.0))
            best = F.when(i >= width, F.greatest(a["best"], F.lit(math.log2(width)) - total / width)).otherwise(a["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda a: a["best"])

    return F.element_at(F.transform(F.array(F.split(s, "")), over), 1)


def _suspicious(m: F.Column) -> F.Column:
    bits = F.when(m.rlike("^[0-9A-Fa-f]+$"), HEX_BITS).otherwise(MIXED_BITS)
    return F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(ALLOWED), window_entropy(m) >= bits).otherwise(False)


def _matches(text: F.Column, kind: int, regex: str, guard: str, ok) -> F.Column:
    """Array of struct(kind, n, gap, len, ok) for all matches of regex; gap is what lies before the match."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.split(text, regex, -1).alias("p"))
    # the last piece has no match; n keeps the order of the matches
    cut = F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), ok(x["m"]).alias("ok")))
    cut = F.filter(cut, lambda x: x["len"].isNotNull())
    return F.when(text.rlike(guard), cut)


def find_spans(docs: DataFrame) -> DataFrame:
    """One row a document: row (a key), doc_id, found (the matches)."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), matches_column().alias("found"))


def place_spans(found: DataFrame) -> DataFrame:
    """Rows (row, doc_id, spans) of find_spans() rows: positions are running sums by row and kind."""
    cut = found.select("row", "doc_id", F.explode_outer("found").alias("f")).select("row", "doc_id", "f.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("n"))
    spans = cut.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    base_end = F.max(F.when(F.col("ok") & (F.col("kind") < 3), F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind"))
    spans = spans.withColumn("ok", F.col("ok") & ((F.col("kind") < 3) | F.coalesce(base_end < F.col("end"), F.lit(True))))
    one = F.when(F.col("ok"), F.struct(F.col("start").cast("int").alias("start"), F.col("kind"), F.col("end").cast("int").alias("end")))
    return spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("spans"))


def spell(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by `mask`; n_chars, if there, follows. All rows and columns stay.

    Matches are found once and written with their documents, so the row number that joins them is fixed. Texts without
    a match, nearly all, keep out of the shuffle; the others are cut up and joined again.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), matches_column().alias("found"), F.monotonically_increasing_id().alias("row"))
    whole = materialize(whole)
    hit = whole.where(F.size("found") > 0)
    cut = hit.select("row", F.explode("found").alias("f")).select("row", "f.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("n"))
    spans = cut.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok")
    # spans of different kinds can overlap: an island is a run of spans without a gap
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    spans = spans.withColumn("before", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(by_start))
    runs = spans.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    prior = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("runs.end"), i))
    kept = F.transform("runs", lambda r, i: F.concat(F.substring(text, prior(i).cast("int") + 1, (r["start"] - prior(i)).cast("int")), F.lit(mask)))
    tail = F.substring(text, F.element_at(F.col("runs.end"), -1).cast("int") + 1, F.lit(2**31 - 1))
    new = F.col("doc").withField("text", F.concat(F.array_join(kept, ""), tail))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
    masked = hit.select("row", "doc").join(runs, "row", "left").select(F.when(F.col("runs").isNotNull(), new).otherwise(F.col("doc")).alias("doc"))
    return whole.where(F.size("found") == 0).select("doc").union(masked).select("doc.*")


def matches_column() -> F.Column:
    """All matches in column text, by kind; of texts without any an empty array."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.expr("CAST(array() AS array<struct<kind:int,n:int,gap:int,len:int,ok:boolean>>)")
    parts = (
        _matches(text, 0, ASSIGN, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _matches(text, 1, ACCESS, HAS_ACCESS, lambda m: F.length(m) >= 16),
        _matches(text, 2, HEX, HAS_HEX, lambda m: F.length(m) >= 32),
        _matches(text, 3, CANDIDATE, CANDIDATE, _suspicious),
    )
    return F.concat(*(F.coalesce(x, empty) for x in parts))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place_spans(find_spans(table(spark, sf_dir, "documents")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return placed.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
