"""Validation and repair of nested records: kept rows and reject rows come as a pair of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import domain_norm, word_norm


def checked(rows: DataFrame, rules: dict[str, Column], max_errors: int = 3) -> DataFrame:
    """Adds errors: the names of the first rules that a row breaks. A rule that is null is broken."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), None).otherwise(F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("errors", F.slice(failed, 1, max_errors))


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    out = checked(rows, rules)
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def assembled(root: DataFrame, lists: dict[str, DataFrame], rules: dict[str, dict[str, Column]]) -> DataFrame:
    """doc_id, record and rejects: everything of a document as one typed struct (the root's columns, then every list as an
    array in its order), and beside it the list, place and errors of what breaks a rule. A list's rejects aren't in its
    array; documents whose root breaks a rule have a null record. Documents without rows of a list have it empty.

    root: doc_id (once each) and any columns; lists: each with doc_id, seq and any columns; rules: by list, `root` for the root."""
    ok, bad = split(root, rules.get("root", {}))
    out = root.select("doc_id")
    rejects = [bad.select("doc_id", F.lit("root").alias("list"), F.lit(None).cast("long").alias("seq"), "errors")]
    record = [F.col(f"root.{c}").alias(c) for c in root.columns]
    out = out.join(ok.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in ok.columns]).alias("root")), "doc_id", "left")
    for name, rows in lists.items():
        good, wrong = split(rows, rules.get(name, {}))
        fields = [c for c in rows.columns if c not in ("doc_id", "seq")]
        own = F.struct("seq", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("r"))
        each = good.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(own), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)), lambda x: x["r"]).alias(name))
        out = out.join(each, "doc_id", "left")
        record.append(F.coalesce(F.col(name), F.array().cast(each.schema[name].dataType)).alias(name))
        rejects.append(wrong.select("doc_id", F.lit(name).alias("list"), F.col("seq").cast("long").alias("seq"), "errors"))
    all_rejects = reduce(DataFrame.unionByName, rejects)
    by_doc = all_rejects.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("list", "seq", "errors"))).alias("rejects"))
    out = out.select("doc_id", F.when(F.col("root").isNotNull(), F.struct(*record)).alias("record"))
    none = F.array().cast(by_doc.schema["rejects"].dataType)
    return out.join(by_doc, "doc_id", "left").withColumn("rejects", F.coalesce("rejects", none))


def pruned(rows: DataFrame, id_col: str, refs: str, valid: DataFrame, valid_col: str, drop_empty: bool = True) -> DataFrame:
    """refs (array) cut to known ids, in order; rows left without any go if drop_empty."""
    each = rows.select(id_col, F.posexplode(refs).alias("k", "ref")).join(valid.select(F.col(valid_col).alias("ref")).distinct(), "ref", "left_semi")
    kept = each.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"]).alias("kept"))
    out = rows.join(kept, id_col, "inner" if drop_empty else "left")
    return out.withColumn(refs, F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")


def without_dangling(rows: DataFrame, id_col: str, ref: str, valid: DataFrame, valid_col: str) -> DataFrame:
    """ref is null where it is unknown or the row itself."""
    ids = valid.select(F.col(valid_col).alias("known")).distinct()
    out = rows.join(ids, F.col(ref) == F.col("known"), "left")
    return out.withColumn(ref, F.when(F.col("known") != F.col(id_col), F.col("known"))).drop("known")


def domain_collisions(domains: DataFrame) -> DataFrame:
    """Domains written in more than one way: norm, spellings (sorted), n. domains: raw."""
    found = domains.where("raw is not null").select("raw", domain_norm("raw").alias("norm")).where("norm != ''")
    out = found.groupBy("norm").agg(F.array_sort(F.collect_set("raw")).alias("spellings"), F.count(F.lit(1)).alias("n"))
    return out.where(F.size("spellings") > 1)


def real_distinctions(distinctions: Column, own_id: Column) -> Column:
    """Distinctions (array of struct from_concept, difference) from others that say something."""
    empty = lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))).isin("", "n/a", "na", "-")
    return F.filter(distinctions, lambda d: (d["from_concept"] != own_id) & ~empty(d["difference"]))


def without_fragments(synonyms: Column, title: Column) -> Column:
    """One-word synonyms that share a 5-letter stem with a title of several words go; capitals up to 6 stay."""
    words = F.filter(F.split(word_norm(title), r"\s+"), lambda w: F.length(w) > 3)
    stems = F.transform(words, lambda w: F.substring(w, 1, 5))

    def fragment(s: Column) -> Column:
        short = F.length(s) <= 6
        capital = (s == F.upper(s)) & (s != F.lower(s)) & short
        one = F.size(F.split(F.trim(s), r"\s+")) == 1
        return one & ~capital & F.exists(stems, lambda st: word_norm(s).startswith(st))

    return F.when(F.size(F.split(F.trim(title), r"\s+")) >= 2, F.filter(synonyms, lambda s: ~fragment(s))).otherwise(synonyms)


def without_generic(rows: DataFrame, id_col: str, criterion: str, least: int = 3) -> DataFrame:
    """Rows whose criterion isn't repeated so often over all rows, white space and case aside."""
    norm = F.lower(F.regexp_replace(F.trim(criterion), r"\s+", " "))
    keyed = rows.withColumn("norm", norm)
    often = keyed.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("norm")
    return keyed.join(often, "norm", "left_anti").drop("norm")


def transfer_distance(scenarios: DataFrame, cases: DataFrame) -> DataFrame:
    """Scenarios of known cases with their distance: other domains are far, the same is never far.

    scenarios: parent_case_id, dominio, distancia; cases: case_id, dominio.
    """
    c = cases.select("case_id", domain_norm("dominio").alias("case_domain"))
    out = scenarios.withColumn("own_domain", domain_norm("dominio")).join(c, F.col("parent_case_id") == F.col("case_id"))
    known = (F.col("own_domain") != "") & (F.col("case_domain") != "")
    near = F.when(F.col("distancia").isin("cercana", "media"), F.col("distancia")).otherwise("media")
    declared = F.when(F.col("distancia").isin("cercana", "media", "lejana"), F.col("distancia")).otherwise("media")
    value = F.when(known & (F.col("own_domain") != F.col("case_domain")), "lejana").when(known, near).otherwise(declared)
    return out.withColumn("distancia", value).drop("own_domain", "case_domain", "case_id")


def nested_pruned(lists: Column, valid: Column) -> Column:
    """Each inner list cut to valid ids; repeats stay."""
    return F.transform(lists, lambda inner: F.filter(inner, lambda x: F.array_contains(valid, x)))


def totals(concepts: DataFrame, relations: DataFrame, below: float = 0.5) -> DataFrame:
    """One row: concepts, relations, and how many of both are of low confidence."""
    both = concepts.select(F.lit(1).alias("c"), F.lit(0).alias("r"), "confidence").unionByName(relations.select(F.lit(0).alias("c"), F.lit(1).alias("r"), "confidence"))
    return both.agg(F.sum("c").alias("n_concepts"), F.sum("r").alias("n_relations"), F.count_if(F.col("confidence") < below).alias("low_confidence"))
