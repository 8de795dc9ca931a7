"""MinHash near-dedup with tensored banding.

Two collections of HALVES hashes are computed, each from ROWS minhashes. Every pair of a left and a right
hash forms a table key, so HALVES^2 tables cost 2 * HALVES * ROWS minhashes instead of 2 * ROWS * HALVES^2.
At a similarity of 0.75 a pair meets in some table with probability (1 - (1 - 0.75^ROWS)^HALVES)^2, 0.9995
for the defaults; every candidate is confirmed on full shingle sets.

Documents with equal sets form a class first, so copies cost no pairs. In a table, classes are compared with
one centre, not with each other. Classes of a bucket that then still lie in different components are open, and open classes
are compared exactly, family by family, in blocks of bounded size: a task
holds two blocks, counts common shingles by matrix products, and returns one link for two components. Blocks
that lie in one component are not compared.

Defined cases: a very long text is hashed whole, in slices; a null or empty text, or one of white space, has n_shingles 0 and links with nothing; rows
with a null doc_id link with nothing and have a null component; rows of one doc_id are one node; equal rows
give equal rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, mix64, narrowed, table
from peakloom.llm.components import components
from peakloom.llm.shingles import shingle_sets

HALVES, ROWS = 10, 2
SIGNATURE = 2 * HALVES * ROWS
#: Classes of a block, and shingles that so many classes of two blocks share go by matrix products.
BLOCK, DENSE = 1000, 32

_A = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set of hashed shingles: the least high word of each multiply-shift hash."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k : k + 4096, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count, keys, sigs = [], [], []
        for s in shingle_sets(b.column("text")):
            count.append(len(s))
            # sums of two mixes do not depend on order: a 128-bit name of the set
            keys.append(np.array([s.sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes() if len(s) else None)
            sigs.append(minhashes(s).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_key", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = pa.array([s.view(np.int64) for s in shingle_sets(b.column("text"))], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), sets], ["id", "shingles"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id): the HALVES^2 table keys of every class, from its 2 * HALVES half keys."""
    half = lambda side: F.array(*(F.xxhash64(*(F.col("sig")[(side * HALVES + i) * ROWS + r] for r in range(ROWS))) for i in range(HALVES)))
    left = classes.select("id", half(0).alias("left"), half(1).alias("right")).select("id", "right", F.posexplode("left").alias("i", "a"))
    return left.select("id", "i", "a", F.posexplode("right").alias("j", "b")).select(F.xxhash64("i", "j", "a", "b").alias("key"), "id")


def _shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ids (a materialised table with column id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(bounded_broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")
    return materialize(texts.mapInArrow(_sets, "id long, shingles array<bigint>"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= 75 * union."""
    rows = pairs.count()
    left = narrowed(pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u"), rows, 5000)
    both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    fits = 100 * F.least(F.size("a"), F.size("b")) >= 75 * F.greatest(F.size("a"), F.size("b"))
    common = F.size(F.array_intersect("a", "b"))
    return narrowed(both.where(fits).where(100 * common >= 75 * (F.size("a") + F.size("b") - common)).select("u", "v"), rows, 5000)


def _confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = materialize(narrowed(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct(), 2 * pairs.count()))
    return _confirmed(pairs, _shingles_of(docs, ids))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    lens = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in lens]
    names, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cols = column[: lens[0].sum()], column[lens[0].sum() :]
    freq = [np.bincount(c, minlength=len(names)) for c in cols]
    both = (freq[0] > 0) & (freq[1] > 0)
    dense = both & (freq[0] + freq[1] >= DENSE)
    found = np.zeros((len(left), len(right)), np.float32)
    place = np.cumsum(dense) - 1
    for k in range(0, int(dense.sum()), 4096):
        flags = []
        for side, n in ((0, len(left)), (1, len(right))):
            hit = dense[cols[side]]
            at = place[cols[side][hit]] - k
            here = (at >= 0) & (at < 4096)
            m = np.zeros((n, 4096), np.float32)
            m[rows[side][hit][here], at[here]] = 1
            flags.append(m)
        found += flags[0] @ flags[1].T
    # the others have short lists: pair every occurrence on the left with all on the right
    rare = both & ~dense
    hit = rare[cols[1]]
    order = np.argsort(cols[1][hit], kind="stable")
    owners, sorted_cols = rows[1][hit][order], cols[1][hit][order]
    start = np.searchsorted(sorted_cols, np.arange(len(names)))
    hit = rare[cols[0]]
    c, r = cols[0][hit], rows[0][hit]
    for k in range(0, len(c), 200_000):
        n = freq[1][c[k : k + 200_000]]
        at = np.repeat(start[c[k : k + 200_000]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(found, (np.repeat(r[k : k + 200_000], n), owners[at]), 1)
    return found.astype(np.int64)


def _compare_blocks(part: pa.Table) -> pa.Table:
    """One confirmed link (u, v) for every two components that classes of the left and right block connect."""
    side = part.column("side").to_numpy()
    at = [np.flatnonzero(side == k) for k in (0, 1)]
    ids, comp = part.column("id").to_numpy(), part.column("comp").to_numpy()
    sets = [x.values.to_numpy() for x in part.column("shingles")]
    left, right = ([sets[i] for i in a] for a in at)
    if not left or not right:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    common = _common(left, right)
    size = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    alike = 100 * common >= 75 * (size[0][:, None] + size[1][None, :] - common)
    a, b = np.nonzero(alike & (comp[at[0]][:, None] != comp[at[1]][None, :]))
    a, b = at[0][a], at[1][b]
    pair = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])])
    _, one = np.unique(pair, axis=1, return_index=True)
    return pa.table({"u": pa.array(ids[a[one]]), "v": pa.array(ids[b[one]])})


def _block_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within every family of placed (id, comp, family)."""
    sizes = placed.groupBy("family", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < BLOCK).groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("parts"))
    whole = placed.join(sizes, ["family", "comp"]).join(small, "family", "left")
    home = F.when(F.col("n") >= BLOCK, F.col("comp")).otherwise(-1)
    share = F.when(F.col("n") >= BLOCK, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK).cast("long"))).otherwise(F.pmod(F.xxhash64("comp"), "parts"))
    rows = placed.count()
    dealt = materialize(narrowed(whole.select("id", "comp", "family", F.struct(home.alias("home"), share.alias("share")).alias("block")), rows))
    blocks = dealt.select("family", "block").distinct()
    other = blocks.select("family", F.col("block").alias("block_b"))
    pairs = blocks.join(other, "family").where("block <= block_b AND (block.home <> block_b.home OR block.home = -1)")
    # a block is compared with itself, too: its classes are of several components
    sides = pairs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select("family", "block", "block_b", "side", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("block_b")).alias("own"))
    rows = sides.join(dealt.withColumnRenamed("block", "own"), ["family", "own"]).join(sets, "id")
    return rows.select("family", "block", "block_b", "side", "id", "comp", "shingles").groupBy("family", "block", "block_b").applyInArrow(_compare_blocks, "u long, v long")


def _labelled(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds comp to rows with id; a class without links is its own component."""
    known = bounded_broadcast(comps)
    return ids.join(known, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (u, v) between classes (id, sig): enough of them to connect all that are connected."""
    keys = table_keys(classes)
    # a bucket of two is known by its ends; larger ones are few and looked up again
    buckets = materialize(keys.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count("*").alias("n")).where("n > 1"))
    large = bounded_broadcast(buckets.where("n > 2").select("key"))
    members = materialize(keys.join(large, "key"))
    n = members.count()
    centres = buckets.where("n > 2").select("key", "u")
    pairs = buckets.where("n = 2").select("u", "v").union(members.join(bounded_broadcast(centres), "key").where("id <> u").select("u", F.col("id").alias("v"))).distinct()
    pairs = materialize(narrowed(pairs, n + buckets.count()))
    found = materialize(_confirm(docs, pairs))
    comps = materialize(narrowed(components(found), 2 * n))
    placed = materialize(_labelled(members, comps))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("id").alias("u")).where("c1 <> c2").select("key", "u")
    open_ = materialize(narrowed(placed.join(mixed, "key"), n))  # rows (key, id, comp, u) of buckets that hold several components
    if open_.isEmpty():
        return found
    ids = narrowed(open_.select("id", "comp").distinct(), n)
    families = components(open_.select(F.col("u"), F.col("id").alias("v")).distinct())
    placed = materialize(narrowed(ids.join(families, F.col("id") == F.col("node")).select("id", "comp", F.col("component").alias("family")), n))
    return found.union(_block_links(placed, _shingles_of(docs, placed)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, class_id (least doc_id with the same set), component_id, kept."""
    rows = materialize(sketches(docs))
    real = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = real.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    classes = materialize(classes)
    found = links(docs, classes)
    # rows that share a doc_id but not a set are one node: link the classes they lie in
    shared = real.select("doc_id", "set_key").distinct().join(classes.select("set_key", "id"), "set_key")
    shared = shared.where("doc_id <> id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    comps = bounded_broadcast(materialize(components(found.select("u", "v").union(shared))))
    own = F.when(F.col("set_key").isNull(), F.col("doc_id"))
    placed = rows.join(comps, rows.doc_id == comps.node, "left")
    component = F.coalesce(own, "component", F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (WITH RECURSIVE g(node, comp) AS (SELECT doc_id, doc_id FROM s UNION
  SELECT CASE WHEN p.u = g.node THEN p.v ELSE p.u END, g.comp FROM g JOIN p ON p.u = g.node OR p.v = g.node)
  SELECT node, min(comp) AS comp FROM g GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, comp AS component_id, s.doc_id = comp AS kept FROM s JOIN r ON s.doc_id = r.node
"""
