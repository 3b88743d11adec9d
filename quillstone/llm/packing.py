"""Packing: sum-of-squares online packing of tokenised documents into training windows.

A document is its token ids and an end id. Whole windows are cut off its front; the rest is
placed online into the fill level that minimises the sum of squared counts of partially
filled windows, which a level array tracks. Every task packs its own rows, so nothing is
shuffled and a lost task is packed anew with the same result. When a task ends (or has
max_open windows open) the open windows are consolidated: pieces of the emptiest windows are
cut to top up the fullest, and the one window that remains is cut at powers of two, which
are stored without padding. So that this closes few windows, small partitions are put together
until a task has some ROWS_A_TASK documents. Edge cases: a null or empty text is the end id alone;
texts of any length are packed whole; of equal placements the fullest window is taken; repeated
rows are packed each; a null doc_id is kept; an empty table gives no rows; further columns can have
any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, prepare, table

WINDOW, END_ID, MAX_OPEN = 2048, 1, 1024
#: Of the windows that aren't cut from one document, tasks of 8,000 documents close 83 % online, tasks of 1,000 27 %.
ROWS_A_TASK = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The vocabulary of byte_bpe_50k.json as a rank encoder: the same ids, several times faster.
    The end-of-text string is its special id, as the tokenizers library has it by default."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("window", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    return encoder(ranks_path).encode_to_numpy(text or "", allowed_special="all")


def default_ranks() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class SumOfSquares:
    """Windows of one task. put() takes a document; rows() hands over what is settled."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, max_open: int = MAX_OPEN):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows of each fill
        self.open: list[list[list[_Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.out: list[tuple] = []

    def put(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self._close([_Piece(doc, at, ids[at : at + self.window], total)])
        if whole < total:
            self._place(_Piece(doc, whole, ids[whole:], total))

    def _place(self, piece: _Piece) -> None:
        size = len(piece.ids)
        fills = np.flatnonzero(self.levels[: self.window - size + 1])
        after = fills + size
        change = 1 - 2 * self.levels[fills] + np.where(after < self.window, 2 * self.levels[after] + 1, 0)
        best, fill = 2 * self.levels[size] + 1, 0  # a new window
        if len(fills):
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
            if change[k] <= best:
                fill = int(fills[k])
        pieces = self._take(fill) if fill else []
        pieces.append(piece)
        if fill + size == self.window:
            self._close(pieces)
            return
        self.levels[fill + size] += 1
        self.open[fill + size].append(pieces)
        self.n_open += 1
        if self.n_open > self.max_open:
            self.consolidate()

    def _take(self, fill: int) -> list[_Piece]:
        self.levels[fill] -= 1
        self.n_open -= 1
        return self.open[fill].pop()

    def _close(self, pieces: list[_Piece]) -> None:
        offset = 0
        for p in pieces:
            crc = zlib.crc32(np.ascontiguousarray(p.ids, dtype="<u4").tobytes())
            self.out.append((p.doc, p.start, len(p.ids), crc, p.total, self.next_id, offset))
            offset += len(p.ids)
        self.next_id += 1

    def consolidate(self) -> None:
        """Closes all open windows: the emptiest are cut up to fill the fullest to the brim."""
        windows = [w for level in self.open for w in level]  # by fill
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        spare: list[_Piece] = []
        while windows:
            top = windows.pop()
            room = self.window - sum(len(p.ids) for p in top)
            while room:
                if not spare:
                    if not windows:
                        break
                    spare = windows.pop(0)
                p = spare.pop()
                if len(p.ids) > room:
                    p, rest = p.cut(room)
                    spare.append(rest)
                top.append(p)
                room -= len(p.ids)
            if room:
                self._powers(top)
            else:
                self._close(top)
        if spare:
            self._powers(spare)

    def _powers(self, pieces: list[_Piece]) -> None:
        """Less than a window of tokens as sequences of falling powers of two: no padding."""
        left, queue = sum(len(p.ids) for p in pieces), list(reversed(pieces))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                p = queue.pop()
                if len(p.ids) > room:
                    p, rest = p.cut(room)
                    queue.append(rest)
                now.append(p)
                room -= len(p.ids)
            self._close(now)

    def rows(self, least: int = 0) -> pa.RecordBatch | None:
        if len(self.out) <= least:
            return None
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.out)], schema=_ARROW)
        self.out = []
        return batch


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only id_col and text_col are read. sequence_id is unique over the table: the task's number
    in the upper bits, a counter in the lower 40.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_path or default_ranks()
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.put(doc, np.concatenate([token_ids(text.as_py(), ranks), end]))
            if (rows := packer.rows(2000)) is not None:
                yield rows
        packer.consolidate()
        if (rows := packer.rows()) is not None:
            yield rows

    rows = picked(docs, {"doc_id": id_col, "text": text_col})
    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.coalesce(max(1, -(-docs.count() // ROWS_A_TASK))).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}  # tokenisation isn't SQL; tests/llm compares with a brute-force packer check
