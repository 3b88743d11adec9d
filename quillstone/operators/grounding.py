"""Grounding: which claims the source text supports.

Quotes meet sources through an inverted index with prefix filtering: a quote joins on its rarest keys
only, so the work follows the rare keys that quotes and sources share, not quotes times sources, and
every candidate is verified on its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.grams import KeySet, piece_keys, word_keys
from quillstone.functions.text import source_norm, word_grams
from quillstone.operators.profile import rounded
from quillstone.sources.shared import written

MIN_CHARS, OVERLAP, N = 25, 0.82, 4
#: Words of 64 bits of the table that tells which keys quotes have: 8 MB, whatever the number of quotes.
MOST_WORDS = 1 << 20


def source_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, norm and n_grams (distinct) of every source."""
    norm = docs.select(F.col(id_col).alias("doc_id"), source_norm(text_col).alias("norm"))
    return norm.withColumn("n_grams", F.size(word_grams(F.col("norm"), N)))


def _quote_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows quote_id, norm: every key, whether of a piece or of words, and how many of its kind the quote has."""
    for b in batches:
        keys = [(k, kind, own) for k, t in enumerate(b.column(1).to_pylist()) for kind, own in (("piece", piece_keys(t)), ("words", word_keys(t, N)))]
        rows = np.repeat([k for k, _, _ in keys], [len(own) for _, _, own in keys]) if keys else np.zeros(0, np.int64)
        columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array([kind for _, kind, own in keys for _ in own], pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *[own for _, _, own in keys]])), pa.array([len(own) for _, _, own in keys for _ in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["quote_id", "kind", "key", "total"])


def wanted_keys(keys: DataFrame) -> KeySet:
    """The keys as a bounded table of bits, the only thing that goes through the driver."""
    n, words = keys.count(), 1024
    while words < MOST_WORDS and words < n:
        words *= 2
    word = F.col("key").bitwiseAND(F.lit(words - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("key", 40).bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = KeySet(words)
    out.add_words([r["word"] for r in rows], [r["bits"] for r in rows])
    return out


def inverted(docs: DataFrame, wanted: KeySet) -> DataFrame:
    """doc_id and key of the keys of normalised texts that wanted may have. docs: doc_id, norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.concatenate([piece_keys(t), word_keys(t, N)]) for t in b.column(1).to_pylist()]
            keys = [own[wanted.hits(own)] for own in keys]
            rows = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], names=["doc_id", "key"])

    return docs.select("doc_id", "norm").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key long")


def indexed(quotes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of quotes (quote_id, kind, key, total), and postings (doc_id, key) of those that sources have."""
    keys = written(quotes.mapInArrow(_quote_keys, f"quote_id {dict(quotes.dtypes)['quote_id']}, kind string, key long, total long"), "quote-keys")
    return keys, written(inverted(docs, wanted_keys(keys.select("key").distinct())), "quote-postings")


def candidates(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """quote_id and doc_id of all pairs where a source can support a quote, by an inverted index of the keys of quotes.

    A quote joins on its rarest keys alone: one of its pieces, as a source that holds the quote has all of them, and
    so many of its word n-grams that a source of enough overlap can't lack them all. keys, postings: see indexed."""
    df = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = keys.join(df, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("quote_id", "kind").orderBy("df", "key")))
    least = F.ceil(OVERLAP * F.col("total") - 1e-9)
    joins_on = F.when(F.col("kind") == "piece", 1).otherwise(F.col("total") - least + 1)
    chosen = ranked.where((F.col("rank") <= joins_on) & (F.col("df") > 0)).select("quote_id", "key")
    return chosen.join(postings, "key").select("quote_id", "doc_id").distinct()


def _supported(q: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """quote_id and share of the quotes that a source of pairs supports, verified on whole texts. q: quote_id, norm."""
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").withColumn("source", source_norm("text")).join(q, "quote_id")
    mine = word_grams(F.col("norm"), N)
    share = F.when(F.contains("source", "norm"), 1.0).otherwise(F.size(F.array_intersect(mine, word_grams(F.col("source"), N))) / F.size(mine))
    return both.select("quote_id", share.alias("share")).groupBy("quote_id").agg(F.max("share").alias("share")).where(F.col("share") >= OVERLAP)


def best_source(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, found and similarity of each quote: whether any source holds it, as it is (1) or by enough of its
    word n-grams (their share); similarity is null where none does. Quotes shorter than MIN_CHARS are never found.

    quotes: quote_id, quote; docs: doc_id, text. Candidates are verified on whole texts."""
    q = quotes.select("quote_id", source_norm("quote").alias("norm"))
    pairs = candidates(*indexed(q.where(F.length("norm") >= MIN_CHARS), docs.select("doc_id", source_norm("text").alias("norm"))))
    out = q.select("quote_id").join(_supported(q, docs, pairs), "quote_id", "left")
    return out.select("quote_id", F.col("share").isNotNull().alias("found"), rounded(F.col("share"), 2).alias("similarity"))


def closest_source(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """best_source with the similarity of every quote: where no source supports it, the largest share of its word n-grams
    that one source has, counted by their 64-bit keys over all sources; 0 where none has any or the quote is too short."""
    q = quotes.select("quote_id", source_norm("quote").alias("norm"))
    keys, postings = indexed(q.where(F.length("norm") >= MIN_CHARS), docs.select("doc_id", source_norm("text").alias("norm")))
    words = keys.where("kind = 'words'").select("quote_id", "key", "total")
    shared = words.join(postings.distinct(), "key").groupBy("quote_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    counted = shared.groupBy("quote_id").agg(F.max(F.col("n") / F.col("total")).alias("counted"))
    out = q.select("quote_id").join(_supported(q, docs, candidates(keys, postings)), "quote_id", "left").join(counted, "quote_id", "left")
    share = F.coalesce("share", "counted", F.lit(0.0))
    return out.select("quote_id", (share >= OVERLAP).alias("found"), rounded(share, 2).alias("similarity"))


def in_own_source(claims: DataFrame, docs: DataFrame, quote: str) -> DataFrame:
    """Adds found and similarity of a quote against the claim's own document (equi-join on doc_id)."""
    d = docs.select("doc_id", source_norm("text").alias("source"))
    joined = claims.join(d, "doc_id").withColumn("q", source_norm(quote))
    qg, dg = word_grams(F.col("q"), N), word_grams(F.col("source"), N)
    ratio = F.size(F.array_intersect(qg, dg)) / F.greatest(F.size(qg), F.lit(1))
    similarity = F.when(F.length("q") < MIN_CHARS, 0.0).when(F.contains("source", F.col("q")), 1.0).otherwise(F.round(ratio, 2))
    found = F.when(F.length("q") < MIN_CHARS, False).when(F.contains("source", F.col("q")), True).otherwise(ratio >= OVERLAP)
    return joined.withColumns({"found": found, "similarity": similarity}).drop("source", "q")


def term_state(title: Column, source: Column) -> Column:
    """`presente`, `sigla` (only the acronym occurs) or `ausente` for a title against a normalised source."""
    base = source_norm(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    acronym = F.lower(F.regexp_extract(title, r"\(([A-Z][A-Z0-9\-]{1,9})\)\s*$", 1))
    full = source_norm(title)
    present = ((base != "") & F.contains(source, base)) | ((full != "") & F.contains(source, full))
    return F.when(present, "presente").when((acronym != "") & F.array_contains(F.split(source, " "), acronym), "sigla").otherwise("ausente")


def verified(items: DataFrame) -> DataFrame:
    """level and capped confidence of concepts. items: found, term_present, confidence."""
    level = F.when(F.col("found"), "verificado").when(F.col("term_present"), "parcial").otherwise("sin_anclaje")
    c = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.6))
    capped = F.when(F.col("level") == "parcial", F.least(c, F.lit(0.6))).when(F.col("level") == "sin_anclaje", F.least(c, F.lit(0.35))).otherwise(c)
    return items.withColumn("level", level).withColumn("confidence", capped)


# Why a concept is dropped.
INVENTED = "la sigla aparece en el documento pero su desarrollo no: el extractor lo inventó a partir de lo que suena plausible"
ABSENT = "ni el término ni la cita aparecen en el documento"


def verified_concepts(concepts: DataFrame, docs: DataFrame) -> DataFrame:
    """concepts with level, similarity, diagnosis, capped confidence, and reason and stated (its quote's beginning) where
    neither title nor quote is in its document; such a concept is dropped, which is what a reason says.

    concepts: doc_id, concept_id, title, quote, confidence; docs: doc_id, text."""
    c = concepts.withColumn("quote", F.trim(F.coalesce("quote", F.lit(""))))
    found = in_own_source(c, docs, "quote").join(docs.select("doc_id", source_norm("text").alias("source")), "doc_id")
    found = found.withColumn("diagnosis", term_state(F.coalesce("title", F.lit("")), F.col("source"))).drop("source")
    out = verified(found.withColumn("term_present", F.col("diagnosis") == "presente"))
    dropped = F.col("level") == "sin_anclaje"
    reason = F.when(dropped, F.when(F.col("diagnosis") == "sigla", INVENTED).otherwise(ABSENT))
    return out.withColumns({"reason": reason, "stated": F.when(dropped, F.substring("quote", 1, 160))}).drop("found", "term_present")


def verification_counts(concepts: DataFrame) -> DataFrame:
    """A row a document: concepts verified, without a quote, with a quote that isn't there, with a title that isn't there,
    with an acronym spelled out without support, and dropped. concepts: verified_concepts."""
    level, quote = F.col("level"), F.col("quote")
    absent = level == "sin_anclaje"
    return concepts.groupBy("doc_id").agg(
        F.count_if(level == "verificado").alias("verified"), F.count_if(quote == "").alias("without_quote"), F.count_if((level == "parcial") & (quote != "")).alias("quote_not_found"),
        F.count_if(absent).alias("title_absent"), F.count_if(absent & (F.col("diagnosis") == "sigla")).alias("acronym_invented"), F.count_if(F.col("reason").isNotNull()).alias("dropped"),
    )


def verified_relations(items: DataFrame) -> DataFrame:
    """level of relations: by quote, else by description, else inferred, capped at 0.7 without a quote."""
    level = F.when(F.col("quote_found"), "verificado").when(F.col("description_found"), "parcial").otherwise("inferida")
    return items.withColumn("level", level).withColumns({"confidence": F.when(F.col("level") == "inferida", F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence")), "quote": F.when(F.col("level") == "inferida", F.lit("")).otherwise(F.col("quote"))})


def verification_rate(items: DataFrame) -> DataFrame:
    """One row: verified, partial, unverified and the share that is verified."""
    out = items.agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("verificado", "parcial", "sin_anclaje")])
    total = F.greatest(F.col("verificado") + F.col("parcial") + F.col("sin_anclaje"), F.lit(1))
    return out.withColumn("rate", F.round(F.col("verificado") / total, 2))


def verified_attributes(attributes: DataFrame) -> DataFrame:
    """Attributes of concepts split into kept (named, found, first of its name) and aside.

    attributes: concept_id, seq, name, found.
    """
    named = attributes.withColumn("norm", source_norm("name"))
    good = F.col("found") & (F.col("norm") != "")
    first = named.where(good).groupBy("concept_id", "norm").agg(F.min("seq").alias("first_seq"))
    out = named.join(first, ["concept_id", "norm"], "left")
    return out.withColumn("kept", F.coalesce(good & (F.col("seq") == F.col("first_seq")), F.lit(False))).drop("norm", "first_seq")
