"""SimHash near-duplicates: vantage-point trees over fingerprints, exact to 3 differing bits.

Fingerprints of equal value are one point. Two points within 3 bits agree to 1 bit on at least
one half of 32 bits, so there is a tree for each half: its nodes split by the Hamming distance
of that half to a vantage point, and a query of radius 1 visits both sides only near the
boundary. Where a half no longer splits (many points share it), nodes split by the distance of
all 64 bits, with radius 3. Both are metrics and the triangle inequality bounds each branch, so
no pair is lost. The top of each tree is fitted to a bounded sample; it deals every point to
the shard that holds it, and copies to the other shards that its ball overlaps. A shard with more
than HOMES points that live there or ASKS that see it (its sample was too coarse, or nothing
splits it) is cut into cells, each of a block of the ones and a block of the others, so no task
gets more than a cell, however many points there are. A cell is searched by the same recursion,
and it returns links of a spanning forest, never all pairs of a group. Groups are closed over
all cells by alternating large-star and small-star rounds.

Edge cases: a null text is empty; texts without words have fingerprint zero and are linked like
any other; fewer words than a shingle give one shingle; a bit that is set in exactly half the hashes is 0; texts
of any length are read whole, their hashes counted in slices; repeated rows are points once and
returned each; a null doc_id is in its fingerprint's component but never names one unless all
its members are null; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, picked, prepare, table, written

SHINGLE, SEED, BITS = 3, 42, 3
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Points that a shard should hold; fingerprints that the trees' tops are fitted to, at most.
SHARD_POINTS, SAMPLE = 10_000, 200_000
#: Points of a cell that live there, and that ask.
HOMES, ASKS = 16_384, 32_768
#: Pairs that are compared at once, and vantage points tried at a node.
PAIRS, TRIED = 1 << 20, 8
#: Sample points of a shard, at least, so a tree has at most SAMPLE / LEAST shards.
LEAST = 32


# --- fingerprints -------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(joined[starts[i] : ends[i + last]], SEED) for i in range(n)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without any."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = picked(docs, {"doc_id": id_col, "text": text_col})
    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


# --- the trees ----------------------------------------------------------------------------


def apart(a: np.ndarray, b, mask) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def choose(points: np.ndarray, half, rng: np.random.Generator) -> tuple | None:
    """(vantage, mask, radius, bound) of the least overlapping split; None if nothing splits well."""
    best, least = None, 0.93
    for mask, radius in ((half, 1), (ALL, BITS)):
        for v in points[rng.integers(len(points), size=TRIED)]:
            d = apart(points, v, mask)
            for bound in np.unique(np.quantile(d, (0.35, 0.5, 0.65)).astype(np.int64)):
                inner = np.count_nonzero(d <= bound) / len(d)
                if inner in (0.0, 1.0):
                    continue
                # work below: points times queries of either side
                work = inner * np.mean(d <= bound + radius) + (1 - inner) * np.mean(d > bound - radius)
                if work < least:
                    best, least = (v, mask, radius, int(bound)), work
        if best:
            return best
    return best


class Top:
    """A tree's top, as nodes (vantage, mask, radius, bound, inner, outer); a negative child is shard -child - 1."""

    def __init__(self, sample: np.ndarray, half, shards: int, seed: int = 7):
        self.nodes: list[tuple] = []
        self.shards = 0
        self.rng = np.random.default_rng(seed)
        self.half, self.least = half, max(LEAST, len(sample) // max(shards, 1))
        self.root = self._grow(np.sort(sample))

    def _grow(self, points: np.ndarray) -> int:
        split = choose(points, self.half, self.rng) if len(points) > 1.5 * self.least else None
        if split is None:
            self.shards += 1
            return -self.shards
        k = len(self.nodes)
        self.nodes.append(())
        v, mask, radius, bound = split
        inside = apart(points, v, mask) <= bound
        self.nodes[k] = (v, mask, radius, bound, self._grow(points[inside]), self._grow(points[~inside]))
        return k

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places of the points that it sees, whether each lives there)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            k, at, lives = todo.pop()
            if not len(at):
                continue
            if k < 0:
                yield -k - 1, at, lives
                continue
            v, mask, radius, bound, inner, outer = self.nodes[k]
            d = apart(points[at], v, mask).astype(np.int64)
            for child, sees, home in ((inner, d <= bound + radius, d <= bound), (outer, d > bound - radius, d > bound)):
                todo.append((child, at[sees], lives[sees] & home[sees]))


class Forest:
    """Union-find over positions, in array steps."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[at] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if len(a):
                np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def search(all_points: np.ndarray, homes: np.ndarray, asking: np.ndarray, half, forest: Forest, seed: int = 11) -> None:
    """Joins all pairs within BITS of a home and an asking point that agree to 1 bit on the half."""
    rng = np.random.default_rng(seed)
    todo = [(np.flatnonzero(homes), np.flatnonzero(asking))]
    while todo:
        at, asks = todo.pop()
        if not len(at) or not len(asks):
            continue
        split = choose(all_points[at if len(at) <= 4096 else rng.choice(at, 4096, replace=False)], half, rng) if len(at) * len(asks) > PAIRS // 4 else None
        if split is not None:
            v, mask, radius, bound = split
            d, q = apart(all_points[at], v, mask).astype(np.int64), apart(all_points[asks], v, mask).astype(np.int64)
            todo += [(at[d <= bound], asks[q <= bound + radius]), (at[d > bound], asks[q > bound - radius])]
            continue
        step = max(1, PAIRS // len(asks))
        for k in range(0, len(at), step):
            block = at[k : k + step]
            i, j = np.nonzero(apart(all_points[block][:, None], all_points[asks][None, :], ALL) <= BITS)
            a, b = block[i], asks[j]
            forest.join(a[a != b], b[a != b])


def links(points: DataFrame, n_points: int) -> DataFrame:
    """Links (a, b), a < b, of a forest whose components are those of all pairs within BITS bits.

    points: distinct fp. Only the sample is collected.
    """
    spark = prepare(points.sparkSession)
    share = min(1.0, SAMPLE / max(n_points, 1))
    picked = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else points
    rows = picked.orderBy(F.xxhash64("fp")).limit(SAMPLE) if share < 1 else picked
    sample = np.sort(np.array([r[0] for r in rows.collect()], dtype=np.int64).view(np.uint64))
    shards = max(1, -(-n_points // SHARD_POINTS))
    tops = [Top(sample, half, shards, 7 + k) for k, half in enumerate(HALVES)] if len(sample) else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            first = 0
            for top in tops:
                for shard, at, lives in top.deal(fps.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + shard, dtype=np.int32)), pa.array(fps[at]), pa.array(lives)], names=["shard", "fp", "home"])
                first += top.shards

    def in_cell(t: pa.Table) -> pa.Table:
        half = HALVES[0] if t.column("shard")[0].as_py() < tops[0].shards else HALVES[1]
        fps = t.column("fp").to_numpy()
        order = np.argsort(fps, kind="stable")
        fps, homes, asking = fps[order], t.column("home").to_numpy()[order], t.column("asks").to_numpy()[order]
        forest = Forest(len(fps))
        search(fps.view(np.uint64), homes, asking, half, forest)
        root = forest.roots(np.arange(len(fps)))
        linked = root != np.arange(len(fps))
        return pa.table({"a": pa.array(fps[root[linked]]), "b": pa.array(fps[linked])})

    dealt = written(points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean"), "dealt")
    # at most 2 * SAMPLE / LEAST shards, whatever the number of points
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count_if("home") / HOMES).cast("int").alias("nh"), F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("na"))
    return in_cells(dealt.join(F.broadcast(sizes), "shard")).groupBy("shard", "i", "j").applyInArrow(in_cell, "a long, b long")


def in_cells(dealt: DataFrame) -> DataFrame:
    """shard, i, j, fp, home, asks: each point in the cells of its block of homes (if it lives in the
    shard) and in those of its block of asking points. dealt: shard, fp, home, nh and na (blocks)."""
    nh, na = F.greatest("nh", F.lit(1)), F.greatest("na", F.lit(1))
    i, j = F.pmod(F.xxhash64("fp", F.lit(1)), nh).cast("int"), F.pmod(F.xxhash64("fp", F.lit(2)), na).cast("int")
    cell = lambda x, y: F.struct(x.cast("int").alias("i"), y.cast("int").alias("j"))
    lives = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), na - 1), lambda y: cell(i, y))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    sees = F.transform(F.sequence(F.lit(0), nh - 1), lambda x: cell(x, j))
    out = dealt.select("shard", "fp", "home", i.alias("own_i"), j.alias("own_j"), F.explode(F.array_distinct(F.concat(lives, sees))).alias("c"))
    return out.select("shard", "c.i", "c.j", "fp", (F.col("home") & (F.col("c.i") == F.col("own_i"))).alias("home"), (F.col("c.j") == F.col("own_j")).alias("asks"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """fp and root (the least fp of its component) of every linked point, by alternating stars.

    A round maps each point's larger neighbours to the least neighbour, then each point and its
    smaller neighbours to the least of them; hot centres are aggregated before the shuffle and
    joins on them are split by adaptive execution. Every round is written to the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    if not edges.limit(1).count():
        return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a < b").distinct(), "links", instead_of=edges)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable) and n_members of every row."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(links(points, points.count()))
    placed = points.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_members"))
    of_point = placed.join(named, "root").select("fp", "n", "component_id", "n_members")
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(rows, of_point, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_members")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}  # XXH64 and components over all pairs: tests/llm compares with brute force
