"""Token counts of flat token files without an index, by a scan for separators.

A token file is 16-bit little-endian ids, one document after the other, each ended by a separator
id. Spark deals the bytes of a file to tasks in ranges, so one large file is many tasks' work. A
range is cut into blocks, each searched for separators in one array step. A task knows neither how
many bytes lie before its range nor whether it begins in the middle of an id, so a block reports the
separators for both cases, with its first and last byte; an exclusive prefix scan over the blocks of
a file (their lengths, then their separators) gives each block its place, picks the case, finds
separators that lie on a boundary, and stitches documents that cross blocks. Only the blocks' few
totals are scanned by one task a file.

The ranges come from Spark's line reader with the separator's low byte as the end of a line: ranges
end at whole lines, and lines joined by that byte are the bytes of the file again. (A last line that
the file doesn't end gets one byte too many, which can't be the end of a separator: its low byte
would have ended the line.) Every byte is accounted for: a file whose lines don't add up to its
length is an error.

write_tokens makes such files from texts: ids of a public vocabulary plus one, separator 0; numbered
gives the place of each document there. Edge cases: a null or empty text is a document of no tokens;
tokens after the last separator are a last document with ended = false; an odd last byte is ignored;
empty files and empty tables give no documents; repeated rows are documents each; texts of any
length are encoded whole; further columns aren't read, so they can have any names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, prepare, shared_dir, table, written

SEPARATOR, BLOCK_BYTES = 0, 1 << 20
#: Lines of a batch between the JVM and Python; they are short.
LINES = "8192"
_LINES = "spark.sql.execution.arrow.maxRecordsPerBatch"
BLOCK = "id long, block long, n long, head int, tail int, even array<long>, odd array<long>"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
#: Bytes of a mark of byte order, which the line reader skips at the start of a file.
MARK = 3


@lru_cache(maxsize=1)
def encoder():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Flat token files of the texts in a folder that Spark can write to."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            raw = [(e.encode_to_numpy(t.as_py() or "", disallowed_special=()) + 1).astype("<u2").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["ids"])

    ids = picked(docs, {"text": text_col}).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "ids binary")
    # the line separator of the text writer is the separator id: two zero bytes
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\x00\x00").option("compression", "none").text(path)


def straight_from_files(docs: DataFrame) -> bool:
    """Whether docs only reads, filters and projects files, so that its tasks get the same rows each time."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+-]*(Relation|Project|Filter)\b", line) for line in plan.strip().splitlines())


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, file_no and doc_no of the documents that write_tokens writes from docs, which must come straight
    from files: a task's rows become one file, in their order."""
    if not straight_from_files(docs):
        raise ValueError("rows that don't come straight from files have other places each time; write them first")
    n = F.monotonically_increasing_id()
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.shiftright(n, 33).cast("int").alias("file_no"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"))


def joined(lines: pa.BinaryArray, end: int) -> np.ndarray:
    """The bytes of lines, each followed by the byte end."""
    if not len(lines):
        return np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    out, own = np.full(n + len(lines), end, dtype=np.uint8), np.ones(n + len(lines), dtype=bool)
    own[offsets[1:] - offsets[0] + np.arange(len(lines))] = False
    if n:
        out[own] = np.frombuffer(lines.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return out


def separators(content: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Where separators begin if ids begin at even places of content, and if at odd ones."""
    at = np.flatnonzero((content[:-1] == separator & 255) & (content[1:] == separator >> 8))
    return at[at % 2 == 0], at[at % 2 == 1]


class Cutter:
    """Cuts the bytes of one range into blocks."""

    def __init__(self, range_id: int, separator: int, block_bytes: int):
        self.id, self.separator, self.block_bytes, self.block = range_id, separator, block_bytes, 0
        self.held: list[np.ndarray] = []

    def add(self, content: np.ndarray, ends: bool = False) -> Iterator[pa.RecordBatch]:
        self.held.append(content)
        if not ends and sum(map(len, self.held)) < self.block_bytes:
            return
        content = np.concatenate(self.held)
        whole = len(content) if ends else len(content) - len(content) % self.block_bytes
        for at in range(0, whole, self.block_bytes):
            part = content[at : min(at + self.block_bytes, whole)]
            row = [self.id, self.block, len(part), int(part[0]), int(part[-1]), *separators(part, self.separator)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS)], names=[c.split()[0] for c in BLOCK.split(", ")])
            self.block += 1
        self.held = [content[whole:]]


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, doc_no (from 0), start (tokens and separators before it), n_tokens and ended of every document."""
    prepare(spark)
    low = separator & 255
    lines = spark.read.option("lineSep", chr(low)).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*").text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("range")]
    range_id = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None  # a task's rows are one range after the other
        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if cutter is None or cutter.id != int(ids[lo]):
                    if cutter is not None:
                        yield from cutter.add(np.empty(0, dtype=np.uint8), ends=True)
                    cutter = Cutter(int(ids[lo]), separator, block_bytes)
                yield from cutter.add(joined(b.column(1).slice(lo, hi - lo), low))
        if cutter is not None:
            yield from cutter.add(np.empty(0, dtype=np.uint8), ends=True)

    before = spark.conf.get(_LINES)
    spark.conf.set(_LINES, LINES)
    try:
        blocks = written(lines.select(range_id, F.col("value").cast("binary").alias("line")).mapInArrow(run, BLOCK), "blocks")
    finally:
        spark.conf.set(_LINES, before)
    # every line has its range's place: nothing is computed of it before there is one row a range
    ranges = written(lines.select(*place).distinct(), "ranges")
    ranges = ranges.select(F.xxhash64("path", "range").alias("id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "size", "range")
    return documents(blocks, ranges, separator)


def documents(blocks: DataFrame, ranges: DataFrame, separator: int) -> DataFrame:
    """The prefix scan: what count_tokens returns, from blocks and the files, sizes and starts of their ranges."""
    order = Window.partitionBy("file").orderBy("range", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.select("id", "block", "n", "head", "tail", *[f(c).alias(f"{k}_{c}") for c in ("even", "odd") for k, f in (("n", F.size), ("last", lambda c: F.try_element_at(c, F.lit(-1))))]).join(ranges, "id")
    read = totals.groupBy("file").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    lost = F.col("size") - F.col("n")
    marked = read.select("file", lost.isin(MARK, MARK - 1).alias("marked"), lost.isin(0, -1, MARK, MARK - 1).alias("whole"))
    if wrong := marked.where("not whole").first():
        raise RuntimeError(f"the lines of {wrong['file']} don't add up to its length")
    totals = totals.join(marked, "file")
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when(F.col("marked"), MARK).otherwise(0)
    totals = totals.withColumns({"first": first, "left": F.lag("tail").over(order)})
    is_odd = F.col("first") % 2 == 1  # ids begin at odd places of the block
    across = F.coalesce(is_odd & (F.col("left") == (separator & 255)) & (F.col("head") == (separator >> 8)), F.lit(False))
    pick = lambda k: F.when(is_odd, F.col(f"{k}_odd")).otherwise(F.col(f"{k}_even"))
    last_end = F.coalesce(pick("last") + F.col("first"), F.when(across, F.col("first") - 1))
    totals = totals.withColumns({"across": across, "found": pick("n") + across.cast("int"), "after": (last_end / 2 + 1).cast("long")})
    totals = totals.withColumns({"doc_no": F.coalesce(F.sum("found").over(before), F.lit(0)), "began": F.coalesce(F.max("after").over(before), F.lit(0)).cast("long")})

    each = blocks.select("id", "block", "even", "odd").join(totals.select("id", "file", "block", "first", "across", "doc_no", "began"), ["id", "block"])
    ends = F.concat(F.when(F.col("across"), F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")), F.when(is_odd, F.col("odd")).otherwise(F.col("even")))
    each = each.select("file", "first", "doc_no", "began", F.transform(ends, lambda x: ((x + F.col("first")) / 2).cast("long")).alias("ends"))
    each = each.select("file", "doc_no", "began", "ends", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("began")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    ended = each.select("file", (F.col("doc_no") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = totals.groupBy("file").agg(F.floor(F.max("size") / 2).alias("n"), F.sum("found").alias("found"), F.coalesce(F.max("after"), F.lit(0)).alias("began"))
    rest = whole.where("n > began").select("file", F.col("found").alias("doc_no"), F.col("began").alias("start"), (F.col("n") - F.col("began")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the place (file_no, doc_no, start) of every row of docs, counted from flat
    token files alone; the ids come from where write_tokens puts each document. What doesn't come straight
    from files is written first."""
    docs = picked(docs, {"doc_id": id_col, "text": text_col})
    if not straight_from_files(docs):
        docs = written(docs, "token-documents")
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    counted = count_tokens(docs.sparkSession, path).withColumn("file_no", F.regexp_extract("file", r"^part-(\d+)", 1).cast("int"))
    return numbered(docs).join(counted, ["file_no", "doc_no"]).select("doc_id", "n_tokens", "file_no", "doc_no", "start")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat token files and counts each document's tokens from those alone."""
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}  # tokens aren't SQL; tests/llm compares with direct counts
