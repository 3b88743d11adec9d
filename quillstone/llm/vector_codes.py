"""Vector code compression: product codes whose nearest entries come through VA-file filtering.

Vectors become integers, are cut into consecutive parts, and every part position gets a codebook
that starts at the vectors of the smallest ids and is refined for a few rounds by means of the parts
assigned to each entry. Assigning is the cost, and is filtered: every coordinate of the entries is
quantised to a few bits, a cell with the least and largest coordinate in it; for a query, a table
a coordinate gives the least and largest squared distance to every cell, so sums of look-ups bound
the distance to every entry from both sides. Only entries whose lower bound isn't over the least
upper bound are candidates; their distances are computed in integers, ties go to the lower index.

Each round is one pass over the rows without a shuffle of vectors: tasks return sums an entry and
position, and the driver holds the codebooks alone (entries x dimensions). Integers of up to 2^25 are
computed in 64 bits, larger ones as Python's.

Edge cases: rows whose vector is null or has null, NaN or infinite components are dropped; a null id
sorts last, equal ids by their vectors, and repeated rows count each; shorter vectors, and dimensions
that parts don't divide, are filled up with zeros at the end, empty vectors too; integers are held to
+-10^27, errors to the largest long; fewer rows than entries give smaller codebooks; null labels are
one group; an empty table gives no rows; further columns can have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, join_hot, picked, table, written

PARTS, ENTRIES, ROUNDS, CELL_BITS, FACTOR = 4, 256, 4, 4, 1024
#: Integers up to NARROW are computed in 64 bits; LARGEST is where components are held; so many queries are bounded at once.
NARROW, LARGEST, BLOCK = 1 << 25, 10**27, 512
_LONG = (1 << 63) - 1
SUMS = "part int, entry int, position int, n long, total string"


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x), as 64-bit integers where they are narrow, else as Python's."""
    with np.errstate(over="ignore"):
        f = np.clip(np.floor(x.astype(np.float64) * FACTOR), -float(LARGEST), float(LARGEST))
    if not f.size or np.abs(f).max() <= NARROW:
        return f.astype(np.int64)
    return np.array([int(v) for v in f.ravel()], dtype=object).reshape(f.shape)


def narrowed(rows: list[list[int]], width: int) -> np.ndarray:
    wide = any(abs(v) > NARROW for r in rows for v in r)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), width)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors of an Arrow list column without nulls, filled up with zeros to dims."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return whole_numbers(flat.reshape(len(column), dims))
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return whole_numbers(out)


class VAFile:
    """Entries of one codebook, their coordinates quantised to cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, dims = entries.shape
        cells = min(1 << bits, n)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = (rank * cells // n).T  # by dimension, of every entry
        self.low = [np.array([entries[self.cell[j] == c, j].min() for c in range(cells)], dtype=entries.dtype) for j in range(dims)]
        self.high = [np.array([entries[self.cell[j] == c, j].max() for c in range(cells)], dtype=entries.dtype) for j in range(dims)]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of every query to every entry that the cells allow."""
        least = np.zeros((len(x), len(self.entries)), dtype=x.dtype)
        most = np.zeros_like(least)
        for j, cell in enumerate(self.cell):
            below, above = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            gap, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            far = np.maximum(far, gap)
            least += (gap * gap)[:, cell]
            most += (far * far)[:, cell]
        return least, most

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry, its squared distance, and how many distances were computed."""
        index, distance, refined = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK]
            least, most = self.bounds(block)
            query, entry = np.nonzero((least <= most.min(axis=1)[:, None]).astype(bool))
            apart = block[query] - self.entries[entry]
            exact = (apart * apart).sum(axis=1)
            best = np.minimum.reduceat(exact, np.searchsorted(query, np.arange(len(block))))
            hits = np.flatnonzero((exact == best[query]).astype(bool))
            _, first = np.unique(query[hits], return_index=True)
            index[at : at + BLOCK], distance[at : at + BLOCK] = entry[hits[first]], best
            refined += len(query)
        return index, distance, refined


def assigned(x: np.ndarray, books: list[VAFile]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every part position: the parts, their entries and squared distances."""
    out = []
    for part, book in zip(np.split(x, len(books), axis=1), books):
        if book.entries.dtype == object:
            part = part.astype(object)
        elif part.dtype == object:
            book = VAFile(book.entries.astype(object))
        out.append((part, *book.nearest(part)[:2]))
    return out


def _by_entry(part: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries that occur, how often, and the sums of their parts."""
    order = np.argsort(entry, kind="stable")
    own, at, n = np.unique(entry[order], return_index=True, return_counts=True)
    return own, n, np.add.reduceat(part[order], at, axis=0)


class Codebooks:
    """Integer codebooks of consecutive parts; fit() makes them, encode() applies them."""

    def __init__(self, entries: list[list[list[int]]], dims: int):
        self.entries, self.dims = entries, dims

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()

    def files(self) -> list[VAFile]:
        return [VAFile(narrowed(part, self.dims // len(self.entries))) for part in self.entries]

    @classmethod
    def fit(cls, kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
        """kept: vec_id and vector, without nulls in vectors. None if there are no rows."""
        longest = kept.agg(F.max(F.size("vector"))).first()[0]
        if longest is None:
            return None
        dims = max(1, -(-longest // parts)) * parts
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
        rows = whole_numbers(np.array([[*r[0], *[0.0] * (dims - len(r[0]))] for r in first], dtype=np.float64))
        books = cls([[[int(v) for v in r] for r in part] for part in np.split(rows, parts, axis=1)], dims)
        for _ in range(rounds):
            books = books.refined(kept)
        return books

    def refined(self, kept: DataFrame) -> Codebooks:
        """Every entry at the floor of the mean of its parts; entries without parts stay."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, found = self.files(), {}
            for b in batches:
                if not b.num_rows:
                    continue
                for k, (part, entry, _) in enumerate(assigned(matrix(b.column(0), self.dims), files)):
                    for e, n, total in zip(*_by_entry(part, entry)):
                        had = found.get((k, int(e)))
                        found[k, int(e)] = (int(n), total.copy()) if had is None else (had[0] + int(n), had[1] + total)
            for (k, e), (n, total) in found.items():
                size = len(total)
                columns = [pa.array([v] * size, pa.int32()) for v in (k, e)] + [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(v) for v in total.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "n", "total"])

        found = kept.select("vector").mapInArrow(sums, SUMS)
        found = found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        entries = [[list(e) for e in part] for part in self.entries]
        for r in found.collect():  # a number for every coordinate of the codebooks
            entries[r["part"]][r["entry"]][r["position"]] = int(r["total"]) // r["n"]
        return Codebooks(entries, self.dims)

    def encode(self, kept: DataFrame) -> DataFrame:
        """vec_id, label, code, error of kept (vec_id, label, vector)."""
        names = ["vec_id", "label", "code", "error"]

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = self.files()
            for b in batches:
                if not b.num_rows:
                    continue
                found = assigned(matrix(b.column(2), self.dims), files)
                code = [bytes(e).hex() for e in np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8).tolist()]
                error = sum(d.astype(object) for _, _, d in found)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array([min(e, _LONG) for e in error.tolist()], pa.int64())], names=names)

        rows = kept.select("vec_id", "label", "vector")
        return rows.mapInArrow(codes, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def finite_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector of the rows whose vector has finite components alone."""
    out = picked(rows, {"vec_id": id_col, "label": label_col, "vector": vector_col}).withColumns({"vec_id": F.col("vec_id").cast("long"), "vector": F.col("vector").cast("array<double>")})
    return out.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row with a finite vector. entries: at most 256."""
    spark = rows.sparkSession
    kept = finite_vectors(rows, id_col, vector_col, label_col)
    with arrow_batches(spark):
        books = Codebooks.fit(kept, parts, entries, rounds)
        if books is None:
            books = Codebooks([[] for _ in range(parts)], parts)
            kept = kept.limit(0)
        coded = written(books.encode(kept), "vector-codes")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = coded.withColumn("key", key)
    by_label = written(coded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "vector-labels")
    total = by_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    label_error = F.least(F.col("total"), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    return join_hot(coded, by_label, "key", "n", total).select("vec_id", "label", "code", "error", label_error.alias("label_error"), F.lit(books.sha256).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    """Every round a few steps of one statement."""
    steps = [
        f"""kept as (select row_number() over (order by vec_id) - 1 as r, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""x as (select r, (i - 1) // (len(embedding) // {PARTS}) as part, (i - 1) % (len(embedding) // {PARTS}) as pos, floor({FACTOR} * embedding[i]::double)::bigint as v
  from kept, unnest(range(1, len(embedding) + 1)) as u(i))""",
        f"b0 as (select part, r as entry, pos, v from x where r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as (select r, part, arg_min(entry, (d, entry)) as entry, min(d) as d from
  (select r, part, entry, sum((x.v - b.v) * (x.v - b.v))::bigint as d from x join b{k} b using (part, pos) group by all) group by all)""")
        if k < ROUNDS:
            steps.append(f"m{k} as (select part, entry, pos, sum(v)::bigint as s, count(*) as n from x join a{k} using (r, part) group by all)")
            steps.append(f"b{k + 1} as (select part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, v)::bigint as v from b{k} left join m{k} using (part, entry, pos))")
    steps.append(f"c as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by r)")
    steps.append(f"h as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from b{ROUNDS})")
    return f"with {', '.join(steps)}\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join c using (r), h"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {"op12_vector_codes": _sql()}
