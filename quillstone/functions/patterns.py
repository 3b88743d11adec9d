"""Finding many phrases in texts: automata of bounded size, one for each block of the phrases and pass over the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.sources.shared import written

#: Characters of the phrases of one automaton, some 100 bytes each in a worker.
BLOCK_CHARS = 2_000_000
#: The automaton that a worker made last, by the digest of its phrases. The one before goes first.
_LAST: dict = {}


def _automaton(digest: str, phrases: list[str]):
    """Built once for the tasks of a pass that a worker runs."""
    if digest not in _LAST:
        import ahocorasick

        _LAST.clear()
        made = ahocorasick.Automaton()
        for phrase in phrases:
            made.add_word(phrase, phrase)
        made.make_automaton()
        _LAST[digest] = made
    return _LAST[digest]


def _finder(phrases: list[str], whole_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    edge = " " if whole_words else ""
    phrases = [f"{edge}{p}{edge}" for p in phrases]
    digest = hashlib.sha256("\n".join(phrases).encode("utf-8", "surrogatepass")).hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(digest, phrases)
        for b in batches:
            norm = b.schema.get_field_index("norm")
            hits = [sorted({p for _, p in automaton.iter(f"{edge}{t}{edge}")}) if t else [] for t in b.column(norm).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(hits)), [len(own) for own in hits]))
            kept = [k for k in range(b.num_columns) if k != norm]
            found = pa.array([p[len(edge) : len(p) - len(edge)] for own in hits for p in own], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(rows) for k in kept], found], names=[*[b.schema.names[k] for k in kept], "form"])

    return find


def phrases_found(texts: DataFrame, forms: DataFrame, whole_words: bool = True) -> DataFrame:
    """A row for each of the forms that a text holds, as whole words or anywhere: the text's columns but norm, and form.

    texts: norm (normalised) and any columns; forms: form (normalised). Distinct forms are dealt to blocks of some
    BLOCK_CHARS characters. Each block is a pass of its own over the texts, so a worker holds one block's automaton
    whatever the number of forms, and whose forms they are is left to joins. One block at a time is at the driver."""
    each = written(forms.where("form != ''").select("form").distinct(), "forms")
    chars = each.agg(F.sum(F.length("form"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = StructType([*[f for f in texts.schema if f.name != "norm"], StructField("form", StringType())])
    if blocks > 1:  # normalised once, not in each pass
        texts = written(texts, "texts-of-forms")
    passes = []
    for k in range(blocks):
        block = sorted(r["form"] for r in each.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == k).collect())
        if block:
            passes.append(texts.mapInArrow(_finder(block, whole_words), schema))
    return reduce(DataFrame.union, passes) if passes else texts.sparkSession.createDataFrame([], schema)
