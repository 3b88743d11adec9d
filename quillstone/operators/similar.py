"""Similarity of short texts, near-duplicate theses, safe distractors and adjudicated merges."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import stable_id, title_norm, title_tokens
from quillstone.operators.segment import fold, folded


def similarity(x: str | None, y: str | None) -> float:
    """Ratcliff-Obershelp similarity of two normalised texts: 0 if either is empty, 1 if equal."""
    if not x or not y:
        return 0.0
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def _ratios(a, b):
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def sequence_similarity(a: Column, b: Column, norm) -> Column:
    """Ratcliff-Obershelp similarity of two normalised texts: 0 if either is empty, 1 if equal."""
    return F.pandas_udf(_ratios, "double", F.PandasUDFType.SCALAR)(norm(a), norm(b))


def near_duplicate_texts(rows: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """The absorb map of a greedy pass over each group's texts, from the best score down: id, place (from 1), and kept_id, the
    id of the text that absorbed it or its own.

    A text whose normalised form a kept text has joins it; others of 4 tokens or more join the first kept text of as
    many whose signature has a Jaccard similarity of threshold or more; the signature grows by what it absorbs.
    rows: key, id, seq, score (any type that sorts), text. A group is one document's few theses or frameworks.
    """
    rows = rows.withColumns({"norm": title_norm("text"), "tokens": title_tokens("text")}).withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "seq")))
    kind = dict(rows.dtypes)[key]

    def step(own: list) -> list[tuple]:
        kept: list[tuple[str, set]] = []  # id, signature
        holding: dict[str, list[int]] = {}  # the kept whose signature holds a token
        by_norm: dict[str, int] = {}
        out = []
        for place, (id_, norm, words) in enumerate(own, 1):
            tokens = set(words)
            n = len(tokens)
            into = by_norm.get(norm)
            if into is None and n >= 4:
                # a signature that is alike misses at most n * (1 - threshold) tokens, so it holds one of any so many and one more
                rare = sorted(tokens, key=lambda t: len(holding.get(t, ())))[: int(n * (1 - threshold) + 1e-9) + 1]
                for k in sorted({k for t in rare for k in holding.get(t, ())}):
                    signature = kept[k][1]
                    shared = len(tokens & signature) if len(signature) >= 4 and len(signature) * threshold <= n + 1e-9 else 0
                    if shared and shared / (n + len(signature) - shared) >= threshold:
                        into = k
                        break
            if into is None:
                into = len(kept)
                kept.append((id_, set()))
                if norm:
                    by_norm[norm] = into
            signature = kept[into][1]
            for t in tokens - signature:
                holding.setdefault(t, []).append(into)
            signature |= tokens
            out.append((id_, place, kept[into][0]))
        return out

    return folded(rows.select(key, "id", "seq", "norm", "tokens"), key, step, f"{key} {kind}, id string, place long, kept_id string")


def _united(own: Column, more: Column) -> Column:
    """own and those of more whose normalised form isn't there yet, in order."""
    start = F.struct(own.alias("v"), F.transform(own, title_norm).alias("n"))
    add = lambda acc, x: F.when(F.array_contains(acc["n"], title_norm(x)), acc).otherwise(F.struct(F.concat(acc["v"], F.array(x)).alias("v"), F.concat(acc["n"], F.array(title_norm(x))).alias("n")))
    return F.aggregate(more, start, add, lambda acc: acc["v"])


def united(rows: DataFrame, absorbed: DataFrame, key: str, lists: list[str], max_items: int | None = None) -> DataFrame:
    """The kept rows of a greedy pass, the best first and at most max_items a group, with aliases (the ids they absorbed, in
    order), and with the lists of all they absorbed: a value comes in once by its normalised form. Where a group has absorbed
    any, ids in lists are followed to who absorbed them; a row's own id and repeated ones go.

    rows: key, id and lists (arrays of strings); absorbed: near_duplicate_texts of them, whose ids tell rows of a group apart."""
    none = F.array().cast("array<string>")
    each = rows.select(key, "id", *[F.coalesce(c, none).alias(c) for c in lists]).join(absorbed, [key, "id"])
    member = F.struct("place", "id", *lists)
    groups = each.groupBy(key, "kept_id").agg(F.array_sort(F.collect_list(member)).alias("m")).withColumnRenamed("kept_id", "id")
    later = F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))
    field = lambda a, name: F.transform(a, lambda x: x[name])
    aliases = F.filter(field(later, "id"), lambda x: x != F.col("id"))
    out = groups.select(key, "id", F.col("m")[0]["place"].alias("place"), aliases.alias("aliases"), *[_united(F.col("m")[0][c], F.flatten(field(later, c))).alias(c) for c in lists])
    entries = out.select(key, F.explode("aliases").alias("old"), "id").groupBy(key, "old").agg(F.max("id").alias("id"))
    maps = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("old", "id"))).alias("remap"))
    out = out.join(maps, key, "left")

    def followed(values: Column) -> Column:
        step = lambda acc, v: F.when((v == F.col("id")) | F.array_contains(acc, v), acc).otherwise(F.concat(acc, F.array(v)))
        return F.aggregate(F.transform(values, lambda v: F.coalesce(F.try_element_at("remap", v), v)), none, step)

    out = out.withColumns({c: F.when(F.col("remap").isNull(), F.col(c)).otherwise(followed(F.col(c))) for c in lists}).drop("remap")
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place")).cast("long"))
    return out.where(F.col("place") <= max_items) if max_items is not None else out


def safe_distractors(pool: DataFrame, correct: DataFrame, limit: int = 4, most: float = 0.72) -> DataFrame:
    """The most plausible distractors of each concept that aren't too like the right text.

    pool: concept_id, distractor_id, plausibility, text; correct: concept_id, definition."""
    from quillstone.functions.text import source_norm

    joined = pool.join(correct.select("concept_id", "definition"), "concept_id")
    joined = joined.withColumn("similarity", sequence_similarity(F.col("text"), F.col("definition"), source_norm)).where(F.col("similarity") < most)
    w = Window.partitionBy("concept_id").orderBy(F.desc("plausibility"), "distractor_id")
    return joined.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("definition")


def choice_items(safe: DataFrame, concepts: DataFrame, least: int = 2) -> DataFrame:
    """A1 items of concepts with enough safe distractors: options (id, text, correct)."""
    rows = safe.select("concept_id", F.struct(F.col("distractor_id").alias("id"), "text", F.lit(False).alias("correct")).alias("o"))
    right = concepts.select("concept_id", F.struct(stable_id("a1", F.col("concept_id")).alias("id"), F.col("definition").alias("text"), F.lit(True).alias("correct")).alias("o"))
    out = rows.unionByName(right).groupBy("concept_id").agg(F.array_sort(F.collect_list("o")).alias("options"))
    return out.where(F.size("options") > least).withColumn("item_id", stable_id("a1", F.col("concept_id")))


def statements(safe: DataFrame, concepts: DataFrame) -> DataFrame:
    """B1 items: up to two false statements of a concept and as many true ones, in turn.

    safe: with origin; concepts: concept_id, definition, facets (array)."""
    w = Window.partitionBy("concept_id").orderBy(F.desc("plausibility"), "distractor_id")
    false = safe.where(F.col("origin").isin("distincion", "repertorio")).withColumn("k", F.row_number().over(w)).where("k <= 2").select("concept_id", "k", F.lit(False).alias("polarity"), "text")
    true = concepts.select("concept_id", F.posexplode(F.concat(F.array("definition"), F.slice(F.filter("facets", lambda x: F.length(x) > 30), 1, 2))).alias("k", "text")).select("concept_id", (F.col("k") + 1).alias("k"), F.lit(True).alias("polarity"), "text")
    n = false.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_false"))
    true = true.join(n, "concept_id").where(F.col("k") <= F.greatest(F.lit(1), F.col("n_false"))).drop("n_false")
    return true.unionByName(false).withColumn("place", F.row_number().over(Window.partitionBy("concept_id").orderBy("k", F.desc("polarity"))))


def spread_candidates(cases: DataFrame, candidates: DataFrame, take: int = 3, least: int = 2, key: str = "case_id") -> DataFrame:
    """B2 items: of each case's candidates those used least so far, in order of the cases.

    cases: doc_id, case_id, seq and key; candidates: key, concept_id, rank. key: the column of the cases that tells their
    candidates; a list that cases share meets their document once. One document is one group."""
    rows = cases.select("doc_id", "case_id", "seq", F.col(key).alias("of"))
    lists = candidates.groupBy(F.col(key).alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "concept_id"))).alias("c")).where(F.size("c") >= least)
    near = rows.select("doc_id", "of").distinct().join(lists.select("of", F.transform("c", lambda x: x["concept_id"]).alias("c")), "of").select(F.col("doc_id").alias("doc"), F.col("of").alias("list"), "c")
    kind = dict(rows.dtypes)["doc_id"]

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        place: dict = {}
        own = {of: np.array([place.setdefault(x, len(place)) for x in c]) for of, c in zip(right["list"], right["c"])}
        used, names = np.zeros(len(place), np.int64), np.array(list(place), object)
        left = left[left["of"].isin(own)].sort_values("seq", kind="stable")
        found, times = [], []
        for of in left["of"]:
            at = own[of]
            score = used[at] * len(at) + np.arange(len(at))  # used least first, then by place
            best = at[np.argpartition(score, take - 1)[:take] if len(at) > take else np.argsort(score)]
            np.add.at(used, best, 1)
            found.append(best)
            times.append(len(best))
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        frame = pd.DataFrame({"case_id": np.repeat(left["case_id"].to_numpy(object), times) if found else [], "concept_id": names[every]})
        frame.insert(0, "doc_id", left["doc_id"].iloc[0] if found else None)
        return frame

    return rows.groupBy("doc_id").cogroup(near.groupBy("doc")).applyInPandas(step, f"doc_id {kind}, case_id string, concept_id string")


def adjudicated(decisions: DataFrame, concepts: DataFrame, most: int = 4) -> DataFrame:
    """old and new ids after merge decisions in order: a decision is skipped if its winner is unknown or
    gone, or if fewer than two or more than `most` members are left.

    decisions: doc_id, seq, canonical_id, members (array); concepts: doc_id, concept_id."""
    named = F.posexplode(F.concat(F.array("canonical_id"), F.coalesce("members", F.array().cast("array<string>")))).alias("k", "concept_id")
    each = decisions.select("doc_id", "seq", "canonical_id", named).join(concepts.select("doc_id", "concept_id"), ["doc_id", "concept_id"], "left_semi")
    members = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "concept_id"))), lambda x: x["concept_id"]))
    rows = each.groupBy("doc_id", "seq", "canonical_id").agg(members.alias("members"))
    kind = dict(rows.dtypes)["doc_id"]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for r in pdf.itertuples():
            members = [m for m in r.members if m not in gone]
            if r.canonical_id not in members or not 2 <= len(members) <= most:
                continue
            for m in members:
                if m != r.canonical_id:
                    out.append((m, r.canonical_id))
                gone.add(m)
        frame = pd.DataFrame(out, columns=["old", "new"])
        frame.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return frame

    return fold(rows, "doc_id", step, f"doc_id {kind}, old string, new string")
