"""Product codes of vectors by dual-tree Lloyd rounds on whole numbers.

Vectors are cut into equal parts, and every part position has a codebook of its own. encode() writes the vectors once as
blocks, each with a tree over its parts a position: a balanced box tree whose node boxes and node sums are kept with the
block. A round builds the same kind of tree over each codebook's entries and walks both trees level by level. The bounds of
a pair of boxes prune entry nodes that are farther for every point of a point node than another entry node is at most; a
point node that one entry is left for is assigned whole, by its kept sum; leaves that several entries are left for are
decided by squared distances of whole numbers, ties to the lower index. Pairs at equal distance are never pruned, so the
result is that of comparing all parts with all entries.

Spark deals out the blocks; a task sums up all its blocks before it emits its sums, and only codebooks (their size is a
parameter) and their sums meet on the driver.

Defined cases: a vector that is null, empty, or holds null or non-finite components is dropped, and so is one whose length isn't
that of the first kept one or no multiple of the parts; components are held within +-BOUND after scaling, so all sums
fit 64 bits; repeated vec_ids are rows of their own, ordered by their components, and null ones come last; with fewer rows
than entries the codebooks are shorter; null labels are one label; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Greatest magnitude of a scaled component.
BOUND = 1 << 26
#: Vectors of a block, and points of a tree's leaf.
BLOCK_ROWS, LEAF_POINTS = 8192, 32


class Tree:
    """A balanced box tree: node j of a level covers order[cuts[j]:cuts[j + 1]]; its children are 2j and 2j + 1."""

    def __init__(self, order: np.ndarray, lows: list[np.ndarray], highs: list[np.ndarray], sums: np.ndarray):
        self.order, self.lows, self.highs, self.sums = order, lows, highs, sums
        self.depth = len(lows) - 1

    @staticmethod
    def cuts(n: int, level: int) -> np.ndarray:
        """Node borders of a level: halves of halves, so that the borders of a level are among those of the next."""
        edges = np.array([0, n])
        for _ in range(level):
            edges = np.insert(edges, np.arange(1, len(edges)), (edges[:-1] + edges[1:]) // 2)
        return edges

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth = max(0, int(np.floor(np.log2(max(1, n / leaf)))))
        order = np.arange(n)
        for level in range(depth):
            edges, halves = cls.cuts(n, level), cls.cuts(n, level + 1)
            for j in range(len(edges) - 1):
                at = order[edges[j] : edges[j + 1]]
                inside = points[at]
                axis = int(np.argmax(inside.max(0) - inside.min(0)))
                order[edges[j] : edges[j + 1]] = at[np.argpartition(inside[:, axis], halves[2 * j + 1] - edges[j])]
        laid = points[order]
        starts = [cls.cuts(n, level)[:-1] for level in range(depth + 1)]
        sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(laid, 0)])
        return cls(order, [np.minimum.reduceat(laid, s) for s in starts], [np.maximum.reduceat(laid, s) for s in starts], sums)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}_order": self.order.astype(np.int32), f"{name}_low": np.vstack(self.lows), f"{name}_high": np.vstack(self.highs), f"{name}_sums": self.sums}

    @classmethod
    def read(cls, held, name: str) -> Tree:
        low, high = held[f"{name}_low"], held[f"{name}_high"]
        levels = [slice((1 << k) - 1, (2 << k) - 1) for k in range(int(np.log2(len(low) + 1)))]
        return cls(held[f"{name}_order"], [low[s] for s in levels], [high[s] for s in levels], held[f"{name}_sums"])


def dual_assign(points: np.ndarray, tree: Tree, entries: np.ndarray, twin: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry of every point, sums and counts by entry, points assigned by whole nodes).

    tree and twin are trees over points and over entries (its leaves are single entries).
    """
    n, m = len(points), len(entries)
    nearest = np.zeros(n, np.int64)
    sums, counts = np.zeros((m, points.shape[1]), np.int64), np.zeros(m, np.int64)
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level, low_level, whole = 0, 0, 0
    while len(node):
        if low_level < twin.depth:
            node, entry, low_level = np.repeat(node, 2), (2 * entry[:, None] + np.arange(2)).ravel(), low_level + 1
        a, b = tree.lows[level][node], tree.highs[level][node]
        c, d = twin.lows[low_level][entry], twin.highs[low_level][entry]
        least = (np.maximum(0, np.maximum(c - b, a - d)) ** 2).sum(1)
        most = (np.maximum(np.abs(d - a), np.abs(b - c)) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[first, len(node)])
        kept = least <= np.repeat(np.minimum.reduceat(most, first), size)
        node, entry = node[kept], entry[kept]
        if low_level == twin.depth:
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[first, len(node)])
            cuts = Tree.cuts(n, level)
            twin_cuts = Tree.cuts(m, low_level)
            single = twin_cuts[entry[first] + 1] - twin_cuts[entry[first]] == 1
            for at in first[(size == 1) & single]:
                k = twin.order[twin_cuts[entry[at]]]
                lo, hi = cuts[node[at]], cuts[node[at] + 1]
                nearest[tree.order[lo:hi]] = k
                sums[k] += tree.sums[hi] - tree.sums[lo]
                counts[k] += hi - lo
                whole += hi - lo
            left = ~np.repeat((size == 1) & single, size)
            node, entry = node[left], entry[left]
            if level == tree.depth:
                break
        if level < tree.depth and len(node):
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            groups = np.split(entry, first[1:])
            node = np.concatenate([np.repeat([2 * q, 2 * q + 1], len(g)) for q, g in zip(node[first], groups, strict=True)])
            entry = np.concatenate([np.tile(g, 2) for g in groups])
            level += 1
    if len(node):
        cuts, twin_cuts = Tree.cuts(n, level), Tree.cuts(m, low_level)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        for q, g in zip(node[first], np.split(entry, first[1:]), strict=True):
            at = tree.order[cuts[q] : cuts[q + 1]]
            near = np.sort(np.concatenate([twin.order[twin_cuts[e] : twin_cuts[e + 1]] for e in g]))
            best = near[((points[at][:, None, :] - entries[near][None]) ** 2).sum(2).argmin(1)]
            nearest[at] = best
            np.add.at(sums, best, points[at])
            counts += np.bincount(best, minlength=m)
    return nearest, sums, counts, whole


def whole_numbers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v array<int>) of the usable vectors, scaled and floored."""
    usable = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    scaled = f"transform(embedding, x -> CAST(greatest(-{BOUND}D, least({BOUND}D, floor({SCALE}D * CAST(x AS DOUBLE)))) AS INT)) AS v"
    return vectors.where(usable).where(F.size("embedding") % parts == 0).select("vec_id", "label", F.expr(scaled))


def blocks(kept: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """(vec_id array, label array, points, trees): blocks of vectors with a tree a part position, written once."""
    ids, labels = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                points = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, width)
                held = io.BytesIO()
                step = width // parts
                np.savez(held, **{k: x for p in range(parts) for k, x in Tree.grow(points[:, p * step : (p + 1) * step], LEAF_POINTS).arrays(f"t{p}").items()})
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(c)])) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([points.astype(np.int32).tobytes()]), pa.array([held.getvalue()])], ["vec_id", "label", "points", "trees"])

    return materialize(kept.mapInArrow(run, f"vec_id array<{ids}>, label array<{labels}>, points binary, trees binary"))


def _each_part(b: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, tuple]]:
    """(row, part, points, result of dual_assign) of all blocks in a batch."""
    twins = [Tree.grow(e, 1) for e in books]
    width = sum(e.shape[1] for e in books)
    for row in range(b.num_rows):
        points = np.frombuffer(b.column("points")[row].as_buffer(), np.int32).astype(np.int64).reshape(-1, width)
        with np.load(io.BytesIO(b.column("trees")[row].as_py())) as held:
            for p, e in enumerate(books):
                mine = points[:, p * e.shape[1] : (p + 1) * e.shape[1]]
                yield row, p, mine, dual_assign(mine, Tree.read(held, f"t{p}"), e, twins[p])


def lloyd_round(packed: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floored mean of its parts, unused entries as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(e.shape, np.int64) for e in books], [np.zeros(len(e), np.int64) for e in books]
        for b in batches:
            for _, p, _, (_, s, c, _) in _each_part(b, books):
                sums[p] += s
                counts[p] += c
        for p in range(len(books)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts[p]), p)), pa.array(np.arange(len(counts[p]))), pa.array(counts[p]), pa.array(list(sums[p]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = packed.mapInArrow(run, "part long, entry long, n long, sums array<long>").where("n > 0")
    total = found.select("part", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = [e.copy() for e in books]
    for r in total.collect():  # as many rows as the codebooks have numbers
        out[r.part][r.entry, r.i] = r.s // r.n
    return out


def assigned(packed: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of all vectors in the blocks."""
    ids, labels = (packed.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes: dict[int, list[np.ndarray]] = {}
            errors: dict[int, np.ndarray] = {}
            for row, p, points, (nearest, _, _, _) in _each_part(b, books):
                codes.setdefault(row, []).append(nearest.astype(np.uint8))
                errors[row] = errors.get(row, 0) + ((points - books[p][nearest]) ** 2).sum(1)
            for row in codes:
                text = [x.tobytes().hex() for x in np.stack(codes[row], 1)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id")[row].values, b.column("label")[row].values, pa.array(text, pa.string()), pa.array(errors[row])], ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, f"vec_id {ids}, label {labels}, code string, error long")


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) a usable vector, the codebooks). entries is at most 256: an index is a byte."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = whole_numbers(vectors, parts)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).select(F.size("v")).first()
    width = first[0] if first else parts
    kept = kept.where(F.size("v") == width)
    seeds = np.array([r.v for r in kept.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, width)
    step = width // parts
    books = [seeds[:, p * step : (p + 1) * step] for p in range(parts)]
    if not len(seeds):
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, books
    packed = blocks(kept, width, parts)
    for _ in range(rounds):
        books = lloyd_round(packed, books)
    return materialize(assigned(packed, books)), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode(table(spark, sf_dir, "embeddings"))
    sums = bounded_broadcast(materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error"))))
    joined = codes.join(sums, codes.label.eqNullSafe(sums.label))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the entries b{k}, and the entries after it."""
    return f"""
n{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY ALL),
m{k} AS MATERIALIZED (SELECT part, entry, list(s ORDER BY i) AS v FROM (SELECT n.part, n.entry, x.i, CAST(floor(sum(x.x)::DOUBLE / count(*)) AS BIGINT) AS s
  FROM n{k} n JOIN x ON x.vec_id = n.vec_id AND x.part = n.part GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM k, range(4) r(part)),
x AS MATERIALIZED (SELECT vec_id, part, unnest(v) AS x, unnest(range(len(v))) AS i FROM p),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) o USING (vec_id) WHERE entry < 256),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS i FROM b{ROUNDS})),
e AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(entry AS INT))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""
