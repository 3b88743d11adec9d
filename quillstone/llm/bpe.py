"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Every vocabulary entry becomes a piece: its bytes mapped to printable characters, scored by
its negative rank, so that sentencepiece's best-score merges are the lowest-rank merges of the
rank encoder. Normalisation is the identity. Texts are pre-split by the vocabulary's pattern
and each pre-token is encoded alone; a pre-token that is an entry as a whole is that entry, as
in the rank encoder. Decoding maps ids back to their bytes. Edge cases: null and empty texts
have no ids; repeated rows are encoded each; very long texts go through in slices; of pairs of equal
rank there are none, as ranks are distinct; an empty table gives no rows; further columns can have any names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, prepare, table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens and their characters whose ids a worker remembers, and pre-tokens of one slice of a text.
REMEMBERED, REMEMBERED_CHARS, SLICE = 300_000, 16 << 20, 100_000


def default_ranks() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken")


def byte_chars() -> list[str]:
    """The character of each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks (0 to len - 1, each once)."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1, each once")
    chars, order = byte_chars(), sorted(ranks, key=ranks.get)
    pieces = [_field(1, _field(1, "".join(chars[b] for b in p).encode()) + _field(2, -float(k))) for k, p in enumerate(order)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)))  # BPE
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join([*pieces, unknown, trainer, normaliser])


class Codec:
    """Encodes texts to decimal ids and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.table = dict(enumerate(byte_chars()))  # for str.translate over Latin-1
        self.bytes_of = {str(k): p for p, k in ranks.items()}
        self.known: dict[str, str] = {}  # a pre-token's ids
        self.text_of: dict[str, bytes] = {}  # the bytes of a pre-token's ids
        self.chars = 0  # of the pre-tokens in known

    def _learn(self, tokens: set[str]) -> None:
        hard = []
        for t in tokens:
            raw = t.encode("utf-8", "surrogatepass")
            if (k := self.ranks.get(raw)) is not None:
                self.known[t] = str(k)
            else:
                hard.append((t, raw.decode("latin-1").translate(self.table)))
        if hard:
            for (t, _), ids in zip(hard, self.model.encode([m for _, m in hard], num_threads=1)):
                self.known[t] = ",".join(map(str, ids))
        for t in tokens:
            ids = self.known[t]
            self.text_of[ids] = self.decode(ids)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The ids of each pre-token of a text, comma-joined, a slice of pre-tokens at a time."""
        if len(text) <= SLICE:
            slices = [self.pattern.findall(text)]
        else:
            found = (m[0] for m in self.pattern.finditer(text))
            slices = iter(lambda: list(islice(found, SLICE)), [])
        known = self.known
        for tokens in slices:
            if new := {t for t in tokens if t not in known}:
                if len(known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                    known.clear()
                    self.text_of.clear()
                    self.chars, new = 0, set(tokens)
                self.chars += sum(map(len, new))
                self._learn(new)
            if tokens:
                yield [known[t] for t in tokens]

    def slices(self, text: str) -> Iterator[str]:
        """Ids of a text, comma-joined, a slice of pre-tokens at a time."""
        return map(",".join, self.parts(text))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(",")))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for parts in self.parts(text or ""):
            ids = ",".join(parts)
            of_ids.update((("," if n else "") + ids).encode())
            of_text.update(b"".join([self.text_of[p] for p in parts]))
            n += ids.count(",") + 1
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    import public_tokenizers as P

    with open(ranks_path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, P.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every row; with digests, what op8_bpe returns instead."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path or default_ranks())
        for b in batches:
            if digests:
                found = [c.digest(t.as_py()) for t in b.column(1)]
                cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = [[int(k) for s in c.slices(t.as_py() or "") for k in s.split(",")] for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = picked(docs, {"doc_id": id_col, "text": text_col})
    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA if digests else "doc_id long, ids array<int>")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of every row; a null list is null, an empty one no bytes."""
    prepare(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path or default_ranks())
        for b in batches:
            raw = [None if x is None else b"".join(c.bytes_of[str(k)] for k in x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "content"])

    return ids.select(ids[id_col].cast("long").alias("doc_id"), ids[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, content binary")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op8_bpe": op8_bpe}
ORACLE: dict[str, str] = {}  # BPE isn't SQL; tests/llm compares with tiktoken and the exact round trip
