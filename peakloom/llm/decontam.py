"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has a piece that occurs
exactly. All pieces of a block of items go into one automaton, texts are searched for them in one pass, and
each hit is verified with Myers' bit-parallel edit distance on the span it implies. Letters are compared in
lower case, and every run of white space as one space, in items and texts alike.

Items come in blocks of a bounded number of characters, one pass over the texts a block, so neither the driver nor a
task holds more than a block of the benchmark; a task builds a block's automaton once. Items below SHORT characters
have no budget for edits and must occur exactly, between characters that are no letters or digits.

Defined cases: null and empty texts match nothing; null and empty items, and items of white space, match nothing;
equal items match each under its own id; texts of any length are searched whole; rows are searched one by one, also
with repeated or null doc_ids; extra columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import table

#: One edit is allowed for each so many characters; pieces are about as long.
CHARS_PER_EDIT = 24
#: Items of fewer characters are whole words.
SHORT = 24
#: Characters of items in one pass; an automaton takes some 100 bytes a character in every Python worker.
BLOCK_CHARS = 2_000_000


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits allowed for an item of so many characters."""
    return max(0, length // CHARS_PER_EDIT - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern within text, at most `most` edits.

    Bit i of the vectors stands for the row of pattern[i]; Python's integers hold any length. The leftmost
    end wins a tie.
    """
    m = len(pattern)
    if not m:
        return None
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        hp = down | ~(xh | up) & full
        hn = up & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        # a match may start anywhere in the text, so no carry comes into row 0
        hp = hp << 1 & full
        hn = hn << 1 & full
        up = hn | ~(xv | hp) & full
        down = hp & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """The automaton of a block of normalised items."""

    def __init__(self, items: list[str]):
        import ahocorasick

        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            for offset, piece in pieces(item):
                where.setdefault(piece, []).append((k, offset))
        self.items, self.automaton = items, ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def occurrences(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the best occurrence of every item found in a normalised text."""
        starts: dict[int, set[int]] = {}
        if not self.items:
            return []
        for last, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(last + 1 - length - offset)
        found = []
        for k, guesses in starts.items():
            best = _whole_words(self.items[k], text, guesses) if len(self.items[k]) < SHORT else _verified(self.items[k], text, guesses)
            if best:
                found.append((k, *best))
        return sorted(found)


def _whole_words(item: str, text: str, starts: set[int]) -> tuple[int, int, int] | None:
    """The first of the exact occurrences that no letter or digit adjoins."""
    for at in sorted(starts):
        end = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum() or text[end : end + 1].isalnum() and item[-1].isalnum()):
            return at, end, 0
    return None


def _verified(item: str, text: str, guesses: set[int]) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best occurrence within the item's budget near the guessed starts."""
    most, best = budget(len(item)), None
    for lo, hi in _spans(sorted(guesses), len(item), most):
        exact = text.find(item, lo, hi)
        got = (0, exact - lo + len(item)) if exact >= 0 else myers(item, text[lo:hi], most)
        if got and (best is None or got[0] < best[2]):
            end = lo + got[1]
            # the start is where the reversed item ends in the reversed span
            back = myers(item[::-1], text[max(0, end - len(item) - most) : end][::-1], got[0])
            best = (end - back[1], end, got[0])
    return best


def _spans(guesses: list[int], length: int, most: int) -> Iterator[tuple[int, int]]:
    """Spans that hold every occurrence which one of the sorted guessed starts implies; close guesses share one."""
    lo = hi = None
    for g in guesses:
        if lo is not None and g - most <= hi:
            hi = g + length + most
            continue
        if lo is not None:
            yield max(lo, 0), hi
        lo, hi = g - most, g + length + most
    if lo is not None:
        yield max(lo, 0), hi


def _search(docs: DataFrame, items: list[tuple], id_type: str) -> DataFrame:
    key = docs.select("doc_id").schema[0].dataType.simpleString()
    arrow_id = pa.int64() if id_type == "bigint" else pa.string()
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matcher = [i for i, _ in block.value], None
        for b in batches:
            matcher = matcher or Matcher([t for _, t in block.value])
            at, cols = [], ([], [], [], [])
            for i, t in enumerate(b.column("text")):
                for k, start, end, distance in matcher.occurrences(normalize(t.as_py())):
                    at.append(i)
                    for c, x in zip(cols, (ids[k], start, end, distance), strict=True):
                        c.append(x)
            doc = b.column("doc_id").take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(cols[0], arrow_id), *(pa.array(c, pa.int32()) for c in cols[1:])], ["doc_id", "item_id", "start", "end", "distance"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, item_id {id_type}, start int, end int, distance int")


def contaminations(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for every item that a document holds within its edit budget.

    start and end are code points of the normalised text; of several occurrences the best is returned.
    """
    kind = benchmark.select("item_id").schema[0].dataType.simpleString()
    kind, cast = ("bigint", "long") if kind in ("int", "bigint", "smallint", "tinyint") else ("string", "string")
    items = benchmark.select(F.col("item_id").cast(cast).alias("item_id"), "text").where("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_chars
        part = _search(docs, sorted(((r.item_id, t) for r in rows if (t := normalize(r.text))), key=lambda x: (x[1], str(x[0]))), kind)
        found = part if found is None else found.unionByName(part)
    return found


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
