"""Extractors: callables from a text to records, run over documents in batches.

An extractor may call an external model; the default one needs none: it proposes the repeated
capitalised phrases of a text as concepts, with a line that holds each as its quote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Extractor = Callable[[str], list[dict]]
CONCEPTS = "doc_id long, seq long, title string, evidence string, times long"
_PHRASE = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][\w-]+(?: [^\W\d_a-zß-öø-ÿ][\w-]+)*")


def proposed(text: str | None, least: int = 2) -> list[dict]:
    """Capitalised phrases that a text repeats, in order of their first place."""
    times = Counter(_PHRASE.findall(text or ""))
    lines = (text or "").split("\n")
    return [{"title": p, "evidence": next((x for x in lines if p in x), ""), "times": n} for p, n in times.items() if n >= least]


def extract(docs: DataFrame, extractor: Extractor = proposed, schema: str = CONCEPTS) -> DataFrame:
    """Records of every document with its doc_id and their order. docs: doc_id, text."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"doc_id": i, "seq": k, **r} for i, t in zip(b["doc_id"], b["text"]) for k, r in enumerate(extractor(t))]
            yield pd.DataFrame(out, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, schema)
