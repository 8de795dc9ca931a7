"""Removal of repeated byte strings: windows are grouped by their least gram hash and sorted by keys of eight symbols.

A byte goes if it lies in a LENGTH-byte string that also starts earlier: in a document of a smaller id, or
earlier in the same one. Strings are judged on the input, overlaps count, matches end with a document.

1. Every LENGTH-byte window names the least hash of the GRAM-byte strings in it. Equal windows name the same
   one, so a window whose hash no other run of windows names can't be repeated. What remains are runs of
   windows of one name, as byte contexts; all windows of a name come to one task, in shards by document.
2. Each shard, a range of the documents in a task's chunk, sorts its windows (the suffixes cut at LENGTH) by their
   first eight symbols, then refines only blocks that hold several windows by the next eight, until the blocks share
   LENGTH symbols. The shards' orders, less windows equal to an earlier one of their shard, are then sorted together
   in the same way. The last blocks are the repeated intervals; all but the earliest window of one are removed.
3. A name that very many runs share is dealt over several tasks; windows that are the first of their task
   are then compared once more by 128-bit fingerprints, in an aggregation.

This is not the merge of shard Burrows-Wheeler transforms: there is no transform and no array of common prefixes, and
blocks are sorted by keys of eight symbols (argsort, lexsort) instead of interleaved by symbol counts. Only blocks of
LENGTH equal symbols are asked for, so no longer prefix is needed, and the grouping by name (1.) puts equal windows
into one task, which shards of all suffixes would have to be merged over all tasks for.

Defined cases: a null text is empty; a very long text is cut into runs of windows, so no task holds it more than a few
times; a null doc_id comes after all others, as if it were LAST_ID; rows of one doc_id are one
document, so equal starts in them are not earlier than each other; equal rows give equal rows; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, mix64, slices, table, text_buffers

LENGTH, GRAM = 100, 32
#: Runs of a name beyond which it is dealt over several tasks, each with about so many.
HOT_RUNS = 2000
#: Windows of a run, runs that are compared before the shuffle, bytes of contexts and shards that a task merges at once.
RUN, FLUSH, CHUNK_BYTES, SHARDS = 1024, 1_000_000, 3 << 20, 4
LAST_ID = (1 << 63) - 1

_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64))
_FACTOR = mix64(np.arange(501, 511, dtype=np.uint64)) | np.uint64(1)
#: Depths of the refinement's rounds; the last one overlaps the one before.
_DEPTHS = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]


# -- names of windows ----------------------------------------------------------------------------------------


def window_names(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the least gram hash of every window of body, whether its first gram has that hash)."""
    h, width = _SYMBOL[body], 1
    for f in _FACTOR[: GRAM.bit_length() - 1]:  # hashes of 2, 4, ... symbols
        h = h[:-width] * f + h[width:]
        width *= 2
    h = own = mix64(h)
    grams, width = LENGTH - GRAM + 1, 1
    while 2 * width <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = grams - width
    h = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
    return h, own[: len(h)] == h


def runs(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, text number, first window, windows, weight) of the maximal runs of windows of one name, RUN windows at most.

    The weight is 2 if the run may hold equal windows itself. Such a run is periodic, so the gram that names it
    occurs in it more than once; a gram that occurs once begins the last window of its run.
    """
    if len(body) < LENGTH:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z, z
    names, begins = window_names(body)
    n = len(names)
    inside = np.zeros(n + 1, np.int32)  # windows that don't cross the end of their text
    ok = bounds[1:] - bounds[:-1] >= LENGTH
    np.add.at(inside, bounds[:-1][ok], 1)
    np.add.at(inside, bounds[1:][ok] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    cut = np.ones(n, bool)
    cut[1:] = names[1:] != names[:-1]
    cut[bounds[:-1][ok]] = True
    cut[np.minimum(bounds[1:][ok] - LENGTH + 1, n - 1)] |= bounds[1:][ok] - LENGTH + 1 < n
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    begins[:-1] &= ~cut[1:]
    begins[-1] = False
    weight = 1 + np.logical_or.reduceat(begins, start)
    if (size > RUN).any():
        parts = -(-size // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - k * RUN, RUN)
        start, weight = np.repeat(start, parts) + k * RUN, np.repeat(weight, parts)
    keep = valid[start]
    start, size, weight = start[keep], size[keep], weight[keep]
    text = np.searchsorted(bounds, start, side="right") - 1
    return names[start], text, start - bounds[text], size, weight


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        name, doc, t, at, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        held, count = [], 0
        order = np.argsort(name, kind="stable")
        name, doc, t, at, weight = name[order], doc[order], t[order], at[order], weight[order]
        first = np.ones(len(name), bool)
        first[1:] = name[1:] != name[:-1]
        heads = np.flatnonzero(first)
        n = np.repeat(np.add.reduceat(weight, heads), np.diff(np.append(heads, len(name))))
        # one run of a name stands for all of these; the others are known to be repeated and need no meeting
        meet = np.where(first, name, mix64(name ^ (doc.view(np.uint64) + at.view(np.uint64)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (meet, first, name.view(np.int64), doc, t, at, n)], ["meet", "first", "name", "doc", "t", "at", "n"])

    for b in batches:
        body, offsets = text_buffers(b.column("text"))
        doc, t = b.column("doc").to_numpy(), b.column("t").to_numpy()
        for lo, hi in slices(offsets):
            name, text, start, size, weight = runs(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            held.append((name, doc[lo + text], t[lo + text], start << 16 | size, weight))
            count += len(name)
            if count >= FLUSH:
                yield flush()
    if held:
        yield flush()


# -- merging -------------------------------------------------------------------------------------------------


def symbols(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def refine(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): windows in the order of their LENGTH symbols, and where a new block begins.

    places holds one or more runs, each in order, one after another. Equal windows keep their order.
    """
    n = len(places)
    places, first = places.copy(), np.zeros(n, bool)
    if not n:
        return places, first
    first[0] = True
    active = np.arange(n)
    for depth in _DEPTHS:
        key, head = words[places[active] + depth], first[active]
        turned = np.zeros(len(key), bool)
        turned[1:] = (key[1:] < key[:-1]) & ~head[1:]
        if turned.any():
            block = np.cumsum(head)
            moved = np.zeros(block[-1] + 1, bool)
            moved[block[turned]] = True
            at = np.flatnonzero(moved[block])
            if depth == 0:
                order = np.argsort(key[at], kind="stable")  # merges the runs
            else:
                order = np.lexsort((key[at], block[at]))
            places[active[at]] = places[active[at[order]]]
            key[at] = key[at[order]]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        first[active] = new
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        if not len(active):
            break
    return places, first


def repeated(text: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
    """For the windows that start at the given places of text, one array a shard: the earliest equal window's place, by place.

    Places rise within and over the shards. The result is indexed like text; other places hold -1.
    """
    words = symbols(text)
    earliest = np.full(len(text), -1, np.int64)
    orders, inner = [], []
    for s in starts:
        order, first = refine(words, s)
        if not len(order):
            continue
        heads = np.flatnonzero(first)
        least = np.minimum.reduceat(order, heads)
        earliest[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
        orders.append(least)  # one window stands for a shard's equal ones
        inner.append(order)
    if len(orders) < 2:
        return earliest
    order, first = refine(words, np.concatenate(orders))
    heads = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    over = np.full(len(text), -1, np.int64)
    over[order] = least
    for o in inner:
        earliest[o] = over[earliest[o]]
    return earliest


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by name and salt to removed windows, and fingerprints of what is first in a salted share."""
    names = ["doc", "t", "lo", "hi", "print"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def merge(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(rows)
        doc, t, lo = (part.column(c).to_numpy() for c in ("doc", "t", "lo"))
        hot = part.column("shares").to_numpy() > 1
        order = np.lexsort((lo, t, doc))
        part = part.take(pa.array(order))
        doc, t, lo, hot = doc[order], t[order], lo[order], hot[order]
        col = part.column("context").combine_chunks().cast(pa.large_binary())
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
        text, off = np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]
        size = np.diff(off) - LENGTH + 1
        run = np.repeat(np.arange(len(size)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        places = off[run] + within
        # shards are ranges of documents
        shard = np.minimum(off[:-1] * SHARDS // max(1, off[-1]), SHARDS - 1)
        earliest = repeated(text, [places[shard[run] == k] for k in range(SHARDS)])[places]
        owner = np.searchsorted(off, earliest, side="right") - 1
        start = lo[run] + within
        gone = (doc[owner] < doc[run]) | (doc[owner] == doc[run]) & (lo[owner] + earliest - off[owner] < start)
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | (run[1:] != run[:-1])
        end = gone.copy()
        end[:-1] &= ~gone[1:] | (run[1:] != run[:-1])
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        cols = [doc[run[b]], t[run[b]], start[b], start[e]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.nulls(len(b), pa.binary())], names)
        left = np.flatnonzero(hot[run] & ~gone)
        for k in range(0, len(left), 50_000):
            w = left[k : k + 50_000]
            prints = [hashlib.blake2b(text[p : p + LENGTH].tobytes(), digest_size=16).digest() for p in places[w]]
            cols = [doc[run[w]], t[run[w]], start[w], start[w]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(prints, pa.binary())], names)

    # equal windows share name and salt, so a chunk may end where these change
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        key = np.stack([b.column("name").to_numpy(), b.column("salt").to_numpy()])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and (key[0][0], key[1][0]) != (held[-1].column("name")[-1].as_py(), held[-1].column("salt")[-1].as_py()):
            change = np.append(0, change)
        if size + b.nbytes > CHUNK_BYTES and len(change):
            cut = int(change[-1])
            if cut:
                held.append(b.slice(0, cut))
            yield from merge(held)
            held, size = ([b.slice(cut)], b.nbytes) if cut < b.num_rows else ([], 0)
        elif b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield from merge(held)
    else:
        yield pa.RecordBatch.from_arrays([pa.array([], x) for x in types], names)


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["name", "salt", "shares", "doc", "t", "lo", "context"]
    for b in batches:
        for i in range(b.num_rows):
            body = b.column("text")[i].as_buffer().to_pybytes()
            doc, t = b.column("doc")[i], b.column("t")[i]
            found = b.column("found")[i].values
            at = found.field("at").to_numpy()
            lo = at >> 16
            texts = [body[s : s + n + LENGTH - 1] for s, n in zip(lo.tolist(), (at & 0xFFFF).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([found.field("name"), found.field("salt"), found.field("shares"), pa.array([doc.as_py()] * len(lo), pa.int64()), pa.array([t.as_py()] * len(lo), pa.int64()), pa.array(lo), pa.array(texts, pa.binary())], names)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, removed, spans, digest = [], [], [], []
        for i in range(b.num_rows):
            body = b.column("text")[i].as_buffer().to_pybytes()
            found = b.column("found")[i].values
            edge = np.zeros(len(body) + 1, np.int32)
            np.add.at(edge, found.field("lo").to_numpy(), 1)
            np.add.at(edge, found.field("hi").to_numpy() + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            size.append(len(body))
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


# -- Spark jobs ----------------------------------------------------------------------------------------------


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc, t, lo, hi): ranges of windows of docs (doc, t, text) that start earlier elsewhere, too."""
    named = docs.select("doc", "t", "text").mapInArrow(_name_runs, "meet long, first boolean, name long, doc long, t long, at long, n long")
    met = named.withColumn("total", F.sum("n").over(Window.partitionBy("meet", "first")))
    found = materialize(met.where("total > 1").select("name", "doc", "t", "at", "total"))
    # names of many runs are dealt over shares; there are at most (all runs / HOT_RUNS) of them
    hot = found.where(F.col("total") > HOT_RUNS).groupBy("name").agg(F.max("total").alias("most"))
    hot = bounded_broadcast(materialize(hot.select("name", F.ceil(F.col("most") / HOT_RUNS).cast("int").alias("shares"))))
    dealt = found.join(hot, "name", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc", "t", "at"), F.col("shares")).cast("int"))
    by_doc = dealt.groupBy("doc", "t").agg(F.collect_list(F.struct("name", "salt", "shares", "at")).alias("found"))
    ids = bounded_broadcast(materialize(found.select("doc", "t").distinct()))
    texts = docs.join(ids, ["doc", "t"], "left_semi")
    contexts = texts.join(by_doc, ["doc", "t"]).mapInArrow(_cut_contexts, "name long, salt int, shares int, doc long, t long, lo long, context binary")
    merged = contexts.repartition("name", "salt").sortWithinPartitions("name", "salt").mapInArrow(_merge, "doc long, t long, lo long, hi long, print binary")
    merged = materialize(merged)
    left = merged.where("print IS NOT NULL")
    least = left.groupBy("print").agg(F.min(F.struct("doc", "lo")).alias("least"))
    again = left.join(least, "print").where(F.struct("doc", "lo") > F.col("least"))
    return merged.where("print IS NULL").select("doc", "t", "lo", "hi").union(again.select("doc", "t", "lo", "hi"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"))
    base = base.withColumn("t", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    # whole copies: every window of a text starts earlier in the first document that has it
    copies = base.where(F.col("n_bytes") >= LENGTH).groupBy(F.sha1("text").alias("sha"), F.col("n_bytes").alias("size"))
    copies = copies.agg(F.min("doc").alias("origin"), F.max("doc").alias("last")).where("origin < last").drop("last")
    copies = bounded_broadcast(materialize(copies))
    placed = base.join(copies, (F.sha1("text") == F.col("sha")) & (F.col("n_bytes") == F.col("size")), "left")
    copy = F.coalesce(F.col("doc") > F.col("origin"), F.lit(False))
    own = placed.where(~copy).select("doc_id", "doc", "t", "text", "n_bytes")
    gone = materialize(removed_windows(own.where(F.col("n_bytes") >= LENGTH)).groupBy("doc", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("found")))
    ids = bounded_broadcast(gone.select("doc", "t"))
    hit = own.join(ids, ["doc", "t"], "left_semi").join(gone, ["doc", "t"]).select("doc_id", "text", "found")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    cut = hit.mapInArrow(_assemble, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    same = own.join(ids, ["doc", "t"], "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    whole = placed.where(copy).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return cut.unionByName(same).unionByName(whole)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
