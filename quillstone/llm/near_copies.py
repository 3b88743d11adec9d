"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A document is the set of its 5-word shingles; documents with the same set are one point. Candidates
come from the SimHash operator: fingerprints of those shingles within 3 bits, found by its
vantage-point trees, are a group. At a similarity of 0.8, though, fingerprints differ by 10 of 64
bits on average and by 14 or more in one pair of ten, while those of unrelated documents differ by
32, 4 up or down: no metric tree cuts at such a radius. So points that agree in one of BANDS groups
of ROWS minimum hashes are candidates too, which a pair of similarity 0.8 misses with a chance of 3
in 100,000. All candidates are verified exactly, on their whole sets.

Groups with the same members are verified once. A group of more than MEMBERS points or BYTES of sets
is cut into blocks by hash, so no task holds a group; each block is verified alone, and where a
group's points are not in one component after that (its blocks differ from band to band, so copies
nearly always are), every point outside its largest component is held against all of the group, in
cells of two blocks; groups with the same largest component are one for that, as the bands of one
large group mostly have the same points. No pair of a group stays untested unless it is in one
component already, so nothing is lost. In a block, a point is held against all others unless what is left is one component,
so copies cost a pass and no pairs. Components are closed over all groups by alternating stars.

Edge cases: a null text is empty; texts without words are copies of each other; fewer words than a
shingle give one shingle; rows are told apart by their place in the files, so one row of each
component stays whatever the ids: that of the least id, nulls last; an empty table gives no rows;
texts of any length count whole; other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_vp
from .common import flagged, join_hot, placed, prepare, without_rows, written
from .simhash_vp import Forest, components, majority

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 20, 4
#: Points and bytes of sets that a block of a group holds, on average.
MEMBERS, BYTES = 192, 16 << 20
#: Shingles that are permuted at once.
BLOCK = 8192


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values of all word shingles, repeats included; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    ends = (ends - 1).tolist()
    n, last, h = max(1, len(words) - shingle + 1), min(shingle, len(words)) - 1, xxhash.xxh64_intdigest
    return np.fromiter((h(joined[starts[i] : ends[i + last]], SEED) for i in range(n)), dtype=np.uint64, count=n)


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed hash of each band's number and minimum hashes; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    raw = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(raw, dtype=np.uint64).view(np.int64).tolist()


class Sets:
    """Sets side by side, so that one is held against all in array steps."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.size = similarity, np.array([len(s) for s in sets])
        self.some = np.flatnonzero(self.size)
        tokens, flat = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *sets]), return_inverse=True)
        self.flat, self.mark = flat, np.zeros(len(tokens), dtype=np.int32)
        self.starts = np.cumsum(self.size) - self.size

    def near(self, k: int) -> np.ndarray:
        """Places of the sets that are similar enough to that at k, itself included."""
        if not self.size[k]:
            return np.flatnonzero(self.size == 0)
        mine = self.flat[self.starts[k] : self.starts[k] + self.size[k]]
        self.mark[mine] = 1
        shared = np.zeros(len(self.size), dtype=np.int64)
        shared[self.some] = np.add.reduceat(self.mark[self.flat], self.starts[self.some])
        self.mark[mine] = 0
        return np.flatnonzero(shared >= self.similarity * (self.size + self.size[k] - shared) - 1e-9)


def links_within(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a forest whose components are those of all pairs of sets that are similar enough."""
    n, held, forest = len(sets), Sets(sets, similarity), Forest(len(sets))
    for k in range(n):
        # points never asked are all in the first one's component
        if k and np.ptp(forest.roots(np.array([0, k]))) == 0:
            continue
        near = held.near(k)
        forest.join(np.full(len(near), k), near)
    root = forest.roots(np.arange(n))
    return [(int(r), int(i)) for i, r in enumerate(root) if r != i]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        all_hashes = [shingles(t.as_py()) for t in b.column(3)]
        sets = [np.unique(h) for h in all_hashes]
        fps = np.fromiter((majority(h) for h in all_hashes), dtype=np.uint64, count=len(sets))
        cols = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(fps.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["id", "path", "row", "point", "fp", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t.as_py())).tobytes() for t in b.column(1)], pa.binary())], names=["point", "hashes"])


def _hashes(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(h.as_py(), dtype=np.uint64) for h in t.column("hashes")]


def _linked(points: list, found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([points[i] for i, _ in found], pa.binary()), "b": pa.array([points[j] for _, j in found], pa.binary())})


def _in_block(t: pa.Table) -> pa.Table:
    t = t.sort_by("point")
    return _linked(t.column("point").to_pylist(), links_within(_hashes(t)))


def _in_cell(t: pa.Table) -> pa.Table:
    """Links of a cell: of each asking point to one point of every other component that it is near to."""
    t = t.sort_by("point")
    root = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
    held, asking = Sets(_hashes(t), SIMILARITY), np.flatnonzero(t.column("asks").to_numpy())
    found = []
    for k in asking:
        near = held.near(int(k))
        near = near[root[near] != root[k]]
        found += [(int(k), int(i)) for i in near[np.unique(root[near], return_index=True)[1]]]
    return _linked(t.column("point").to_pylist(), found)


def _blocks(n: Column, size: Column) -> Column:
    """How many blocks so many points with so many shingles take."""
    return F.greatest(F.ceil(n / MEMBERS), F.least(F.ceil(size * 8 / BYTES), F.ceil(n)), F.lit(1)).cast("int")


def _block(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("point", "key", F.lit(salt)), blocks).cast("int")


def candidates(points: DataFrame) -> DataFrame:
    """key, point, n and size (of the key's group) of every group of two or more candidates; of groups
    with the same members one. points: point, fp, size, bands."""
    fps = points.select("fp").distinct()
    roots = simhash_vp.components(simhash_vp.links(fps, fps.count()))
    by_tree = points.join(roots, "fp", "left").select("point", "size", F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("key"))
    postings = written(by_tree.unionByName(points.select("point", "size", F.explode("bands").alias("key"))), "near-postings")
    members = F.bit_xor(F.xxhash64("point")).alias("x"), F.bit_xor(F.xxhash64("point", F.lit(1))).alias("y")
    groups = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *members).where("n > 1")
    keys = written(groups.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.first("total").alias("total")).select("key", "n", "total"), "near-keys")
    return written(join_hot(postings, keys, "key", "n", postings.count()), "near-candidates")


def links(texts: DataFrame, points: DataFrame) -> DataFrame:
    """Links (a, b) between points that make the components of all similar pairs; texts: text, path and
    row; points as _sketch has them, with best."""
    asked = candidates(points)
    where = written(asked.select("point").distinct().join(points, "point").select("point", "best.path", "best.row"), "near-where")
    wanted = flagged(texts, where, ["path", "row"]).where("maybe").join(where, ["path", "row"])
    sets = written(wanted.select("point", "text").mapInArrow(_sets, "point binary, hashes binary"), "near-sets")
    of_block = asked.withColumn("block", _block(_blocks(F.col("n"), F.col("total")), 0)).select("key", "block", "point")
    pair = "a binary, b binary"
    found = written(of_block.join(sets, "point").groupBy("key", "block").applyInArrow(_in_block, pair), "near-links")

    large = asked.where(_blocks(F.col("n"), F.col("total")) > 1)
    if not large.limit(1).count():
        return found
    labels = components(found).select(F.col("fp").alias("point"), "root")
    stars = labels.select(F.col("root").alias("a"), F.col("point").alias("b"))
    large = written(large.join(labels, "point", "left").withColumn("root", F.coalesce("root", "point")), "near-large")
    per_root = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    apart = per_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("giant"), F.max("n").alias("n"), F.max("k").alias("k")).where("n > k")
    apart = written(apart.select("key", "giant", "n"), "near-apart")
    if not apart.limit(1).count():
        return stars
    members = join_hot(large.select("point", "root", "size", "key"), apart, "key", "n", large.count())
    members = written(members.select("point", "root", "size", "giant").distinct(), "near-members")
    outside = F.col("root") != F.col("giant")
    sums = members.groupBy("giant").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.count_if(outside).alias("rest"), F.coalesce(F.sum(F.when(outside, F.col("size"))), F.lit(0)).alias("rest_total"))
    members = join_hot(members, sums, "giant", "n", members.count()).withColumn("key", F.xxhash64("giant"))
    asks = F.col("root") != F.col("giant")
    ra = _blocks(F.col("rest"), F.col("rest_total"))
    ta = _blocks(F.col("n"), F.col("total"))
    own_r, own_t = _block(ra, 1), _block(ta, 2)
    cell = lambda x, y: F.struct(x.alias("r"), y.alias("t"))
    as_asking = F.when(asks, F.transform(F.sequence(F.lit(0), ta - 1), lambda y: cell(own_r, y))).otherwise(F.array().cast("array<struct<r:int,t:int>>"))
    as_target = F.transform(F.sequence(F.lit(0), ra - 1), lambda x: cell(x, own_t))
    cells = members.select("key", "giant", "point", "root", asks.alias("asks"), own_r.alias("own_r"), F.explode(F.array_distinct(F.concat(as_asking, as_target))).alias("c"))
    cells = cells.select("giant", "c.r", "c.t", "point", "root", (F.col("asks") & (F.col("c.r") == F.col("own_r"))).alias("asks"))
    more = cells.join(sets, "point").groupBy("giant", "r", "t").applyInArrow(_in_cell, pair)
    return stars.unionByName(written(more, "near-links"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component of near copies, with its columns."""
    prepare(docs.sparkSession)
    all_rows, names = placed(docs, "near-documents")
    texts = all_rows.select(F.col(f"c{names.index(id_col)}").cast("long").alias("id"), "path", "row", F.col(f"c{names.index(text_col)}").cast("string").alias("text"))

    rows = written(texts.mapInArrow(_sketch, "id long, path string, row long, point binary, fp long, size long, bands array<long>"), "near-rows")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "path", "row")).alias("best")
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "bands")]  # a point's rows have the same
    points = written(rows.groupBy("point").agg(best, *firsts, F.count(F.lit(1)).alias("n")), "near-points")
    roots = components(links(texts, points)).select(F.col("fp").alias("point"), "root")
    grouped = points.join(roots, "point", "left").select("point", "best", "n", F.coalesce("root", "point").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("best").alias("kept"), F.sum("n").alias("members")).where("members > 1")
    of_point = grouped.select("point", "n", "root").join(kept, "root").select("point", "n", "kept")
    other = (F.col("path") != F.col("kept.path")) | (F.col("row") != F.col("kept.row"))
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dropped = join_hot(rows.select("point", "path", "row"), of_point, "point", "n", total).where(other).select("path", "row")
    return without_rows(all_rows, written(dropped, "near-dropped")).drop("path", "row").toDF(*names)
