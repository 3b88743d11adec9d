"""Language identification by hyperdimensional letter profiles.

Every letter code has a random +1/-1 vector, a fixed function of a seed. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a text's vector
bundles (adds) those of all its n-grams; a language's prototype bundles its texts. A text gets
the language of the nearest prototype by cosine. Bundling counts n-grams first, so a batch
costs one matrix product. Letters are lower-cased; a run of other characters is one blank.
Edge cases: a null text or one without letters is `und` with score 0, and so is every text
if nothing is learned; a null language teaches nothing; ties go to the first language in
order; repeated rows are predicted each; very long texts are taken in slices that don't show in
the result; an empty table gives no rows; further columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, prepare, table

DIMS, SEED, N = 1024, 20240607, 3
#: Codes: 0 blank, 1 to 26 a to z, the rest for other letters by code point; those below U+0FE0 have their own.
CODES = 4096
#: Languages that are learned, the most frequent first: the driver holds a vector of each (8 KB).
MAX_LANGS = 1000
#: Characters that are turned into n-grams, and documents that are bundled, at a time.
BLOCK_CHARS, BLOCK_DOCS = 1 << 20, 256
UNKNOWN = "und"
#: Distinct n-grams of a text up to which its score says nothing, and from which on it says all.
FEW, FULL = 16, 48


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The code of each code point."""
    codes = np.zeros(0x110000, dtype=np.int32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            codes[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % (CODES - 27)
    return codes


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """(place in the n-gram, code) -> vector, rotated by the place."""
    v = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(CODES, DIMS))
    return np.stack([np.roll(v, N - 1 - k, axis=1) for k in range(N)])


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Vectors of n-gram numbers, in float32 for the matrix product."""
    out, v = np.ones((len(grams), DIMS), dtype=np.int8), letter_vectors()
    for k in range(N):
        out *= v[k][grams // CODES ** (N - 1 - k) % CODES]
    return out.astype(np.float32)


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """The n-gram numbers of a text in order, a slice of its characters at a time; none without letters."""
    text, table = text.lower(), letter_codes()  # lower-cased as a whole: a letter's form may depend on its neighbours
    held, some = np.zeros(1, dtype=np.int64), False  # codes before the slice that n-grams still need
    for at in range(0, len(text), BLOCK_CHARS):
        codes = table[np.frombuffer(text[at : at + BLOCK_CHARS].encode("utf-32-le", "replace"), dtype="<u4")].astype(np.int64)
        if at + BLOCK_CHARS >= len(text):
            codes = np.append(codes, 0)
        some = some or bool(codes.any())
        codes = np.concatenate([held, codes])
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]  # a run of others is one blank
        if not some:
            held = codes[-1:]
            continue
        if at + BLOCK_CHARS >= len(text) and len(codes) < N:
            codes = np.pad(codes, (0, N - len(codes)))
        if len(codes) >= N:
            yield sum(codes[k : len(codes) - N + 1 + k] * CODES ** (N - 1 - k) for k in range(N))
        held = codes[-(N - 1) :]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram numbers and their counts; memory is bounded by the slices and the distinct n-grams."""
    keys = counts = np.empty(0, dtype=np.int64)
    for grams in gram_slices(text):
        new, n = np.unique(grams, return_counts=True)
        if not len(keys):
            keys, counts = new, n
            continue
        both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        keys = both
    return keys, counts


def bundle(texts: list[str | None]) -> np.ndarray:
    """The vectors of some texts, zero for those without letters."""
    return bundle_counted(texts)[0]


def bundle_counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of some texts and the numbers of their distinct n-grams."""
    out, distinct = np.zeros((len(texts), DIMS), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    for at in range(0, len(texts), BLOCK_DOCS):
        counted = [gram_counts(t or "") for t in texts[at : at + BLOCK_DOCS]]
        distinct[at : at + len(counted)] = [len(g) for g, _ in counted]
        seen = np.unique(np.concatenate([g for g, _ in counted]))
        for lo in range(0, len(seen), 1 << 14):
            part = seen[lo : lo + (1 << 14)]
            counts = np.zeros((len(counted), len(part)), dtype=np.float32)
            for k, (grams, n) in enumerate(counted):
                a, b = np.searchsorted(grams, [part[0], part[-1] + 1])
                counts[k, np.searchsorted(part, grams[a:b])] = n[a:b]
            out[at : at + len(counted)] += counts @ gram_vectors(part)
    return out, distinct


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[float]]:
    """Prototype of each of the MAX_LANGS most frequent languages, of unit length. Every task bundles
    its rows; the driver gets one vector a language (8 KB each), whatever the number of documents."""
    prepare(labelled.sparkSession)
    by_lang = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull()).groupBy(labelled[lang_col].cast("string").alias("lang")).count()
    taught = {r["lang"] for r in by_lang.orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for lang in taught.intersection(langs):
                texts = b.column(0).filter(pa.array(langs == lang)).to_pylist()
                sums[lang] = sums.get(lang, 0) + bundle(texts).sum(axis=0, dtype=np.float64)
        for lang, v in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], names=["lang", "dim", "v"])

    rows = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull()).select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    sums = rows.mapInArrow(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["v"]
    return {k: (v / np.linalg.norm(v)).tolist() for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) of every row."""
    prepare(docs.sparkSession)
    names, vectors = list(prototypes), np.array(list(prototypes.values()), dtype=np.float32).reshape(-1, DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = bundle(b.column(2).to_pylist())
            size = np.linalg.norm(v, axis=1)
            lang, score = [UNKNOWN] * len(v), np.zeros(len(v))
            if names and len(v):
                cosines = v @ vectors.T / np.maximum(size, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                some = size > 0
                lang = [names[k] if s else UNKNOWN for k, s in zip(best, some)]
                score = np.where(some, cosines[np.arange(len(v)), best].clip(0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = picked(docs, {"id": id_col, "text": text_col})
    source = rows.select(F.col("id").cast("long").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that aren't held out and predicts all."""
    rows = picked(docs, {"id": id_col, "text": text_col, "lang": lang_col})
    return predict(rows, learn(rows.where(~held_out(F.col("id"))), "text", "lang"), "id", "text")


def least_score(distinct: np.ndarray, min_score: float) -> np.ndarray:
    """The score that texts of so many distinct n-grams need: min_score from FULL on, 0 up to FEW, where those of
    clean texts and of noise overlap, and between them in proportion."""
    return min_score * np.clip((distinct - FEW) / (FULL - FEW), 0, 1)


def with_language(docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that have a language: not `und`, and a score that least_score asks for or more.
    The language column becomes the prediction, whatever it was."""
    prepare(docs.sparkSession)
    rows = picked(docs, {"id": id_col, "text": text_col, "lang": lang_col})
    prototypes = learn(rows.where(~held_out(F.col("id"))), "text", "lang")
    vectors = np.array(list(prototypes.values()), dtype=np.float32).reshape(-1, DIMS)
    place, langs, lang_place = docs.columns.index(text_col), np.array(list(prototypes), dtype=object), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, distinct = bundle_counted(b.column(place).to_pylist())
            if not len(vectors) or not len(v):
                yield b.slice(0, 0)
                continue
            size, cosines = np.linalg.norm(v, axis=1), v @ vectors.T
            best = cosines.max(axis=1) / np.maximum(size, 1e-9)
            b = b.set_column(lang_place, b.schema.field(lang_place), pa.array(langs[cosines.argmax(axis=1)], pa.string()).cast(b.schema.field(lang_place).type))
            yield b.filter(pa.array((size > 0) & (best >= least_score(distinct, min_score))))

    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of the input can't be in the way
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_langid": op6_langid}
ORACLE: dict[str, str] = {}  # tests/llm holds it against held-out labels and a brute-force bundle
