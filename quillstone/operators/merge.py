"""Merging the documents of a student: one plan from many materials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from quillstone.functions.text import acronym_split, source_norm, title_norm
from quillstone.operators.resolve import components
from quillstone.operators.similar import similarity
from quillstone.sources.shared import written


def keys(concepts: DataFrame) -> DataFrame:
    """uid and its structural keys: title, base title and @acronym."""
    p = acronym_split(F.col("title"))
    parts = F.array_distinct(F.array_compact(F.array(F.nullif(title_norm("title"), F.lit("")), F.nullif(title_norm(p["base"]), F.lit("")), F.concat(F.lit("@"), F.lower(p["acronym"])))))
    return concepts.select("uid", "definition", F.explode(parts).alias("key"))


def alike_pairs(keyed: DataFrame, least: float) -> DataFrame:
    """(a, b) of concepts that share a key and have alike definitions: each, in order of uid, is compared
    with those of its key that were like no earlier one, and goes to the first that it is like.

    keyed: key, uid, definition. A group is one acronym's concepts; those it keeps apart are few."""
    rows = keyed.select("key", "uid", source_norm("definition").alias("norm"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        for uid, norm in sorted(zip(pdf["uid"], pdf["norm"])):
            to = next((u for u, n in leaders if similarity(n, norm) >= least), None)
            if to is None:
                leaders.append((uid, norm))
            else:
                out.append((to, uid))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("key").applyInPandas(step, "a string, b string")


def matched(concepts: DataFrame, least: float = 0.62) -> DataFrame:
    """uid and canonical uid of concepts of all documents: those that share a title key are one; an
    acronym joins two only if their definitions are alike.

    concepts: uid (sorts by document, then place), title, definition.
    """
    k = keys(concepts)
    is_acronym = F.col("key").startswith("@")
    first = k.where(~is_acronym).groupBy("key").agg(F.min("uid").alias("a"))
    titles = k.where(~is_acronym).join(first, "key").where("a != uid").select("a", F.col("uid").alias("b"))
    found = components(titles.unionByName(alike_pairs(k.where(is_acronym), least)).distinct())
    return concepts.select("uid").join(found.select(F.col("node").alias("uid"), F.col("component").alias("canonical")), "uid", "left").withColumn("canonical", F.coalesce("canonical", "uid"))


def kept_apart(concepts: DataFrame, least: float = 0.62) -> DataFrame:
    """uid of concepts that share an acronym with an earlier one but no title key, and whose definition is like none of that
    acronym's earlier ones."""
    k = keys(concepts)
    acronyms = k.where(F.col("key").startswith("@"))
    joined = alike_pairs(acronyms, least).select(F.col("b").alias("uid"))
    first = acronyms.groupBy("key").agg(F.min("uid").alias("lead"))
    return acronyms.join(first, "key").where("uid != lead").select("uid").distinct().join(joined, "uid", "left_anti")


def best_definitions(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per canonical concept: the fullest definition, its sources, flags and importance.

    concepts: uid, doc_id, title, definition, importance, is_enriched, is_gateway."""
    rows = concepts.join(groups, "uid")
    return rows.groupBy("canonical").agg(
        F.max_by("definition", F.struct("is_enriched", F.length("definition"), "importance", "uid")).alias("definition"),
        F.min_by("title", "uid").alias("title"),
        F.array_sort(F.collect_set("doc_id")).alias("sources"),
        F.max("importance").alias("importance"),
        F.bool_or("is_gateway").alias("is_gateway"),
    )


def suffixed(rows: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """Ids that an earlier document has used get the document's first six characters."""
    w = Window.partitionBy(id_col).orderBy("doc_id")
    again = F.row_number().over(w) > 1
    return rows.withColumn("again", again).withColumn(id_col, F.when(F.col("again"), F.concat(F.col(id_col), F.lit("__"), F.substring(F.col("doc_id").cast("string"), 1, 6))).otherwise(F.col(id_col))).drop("again")


def rewritten(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between canonical concepts, without loops. edges: from_uid, to_uid and more."""
    g = lambda c: groups.select(F.col("uid").alias(c), F.col("canonical").alias(f"{c}_new"))
    out = edges.join(g("from_uid"), "from_uid").join(g("to_uid"), "to_uid").where("from_uid_new != to_uid_new")
    return out.drop("from_uid", "to_uid").withColumnsRenamed({"from_uid_new": "from_uid", "to_uid_new": "to_uid"})


def _followed(value: Column, kind: DataType, path: list[str], new) -> Column:
    """value with new() applied to the ids in it: itself, those of its arrays at any depth, or a field of its structs."""
    if isinstance(kind, ArrayType):
        out = F.transform(value, lambda x: _followed(x, kind.elementType, path, new))
        return F.filter(out, lambda x: x.isNotNull()) if isinstance(kind.elementType, StringType) else out
    if isinstance(kind, StructType):
        return value.withField(path[0], _followed(value[path[0]], kind[path[0]].dataType, path[1:], new))
    return new(value)


def _referred(rows: DataFrame, refs: list[str]) -> Column:
    """The distinct ids, sorted, that columns of a row refer to; a column is a name, with a dot and a field for arrays of structs."""
    found = []
    for ref in refs:
        name, *path = ref.split(".")
        ids, kind = F.col(name), rows.schema[name].dataType
        while isinstance(kind, ArrayType):
            if isinstance(kind.elementType, StructType):
                ids, kind = F.transform(ids, lambda x: x[path[0]]), ArrayType(kind.elementType[path[0]].dataType)
            elif isinstance(kind.elementType, ArrayType):
                ids, kind = F.flatten(F.filter(ids, lambda x: x.isNotNull())), kind.elementType
            else:
                break
        found.append(ids if isinstance(kind, ArrayType) else F.array(ids))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in found]))))


def referenced(rows: DataFrame, refs: list[str]) -> DataFrame:
    """Distinct doc_id and id that columns of rows refer to (see _referred)."""
    return rows.select("doc_id", F.explode(_referred(rows, refs)).alias("id")).distinct()


def id_maps(groups: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """doc_id, id and canonical: a document's map from its concepts' ids to the canonical ones, a row an id. foreign: doc_id
    and id of what its lists refer to; ids that aren't its own but canonical stand for themselves.

    groups: doc_id, id, canonical of every concept."""
    own = groups.groupBy("doc_id", "id").agg(F.min("canonical").alias("canonical"))
    if foreign is not None:
        valid = groups.select(F.col("canonical").alias("id")).distinct()
        others = foreign.select("doc_id", "id").distinct().join(valid, "id", "left_semi").join(own.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
        own = own.unionByName(others.select("doc_id", "id", F.col("id").alias("canonical")))
    return own


def remapped(rows: DataFrame, refs: dict[str, bool], maps: DataFrame) -> DataFrame:
    """rows with the ids in columns refs (see _referred) replaced by their document's canonical ones, whatever the number
    and depth of the columns; order within arrays stays. Unknown ids go (null, or out of their array) where refs says
    True, and stay where it says False. maps: see id_maps.

    Each set of ids that rows of a document refer to meets their canonical ones once, so a row only carries its own."""
    name, asked = "ids", "asked"
    while {name, asked} & set(rows.columns):
        name, asked = name + "_", asked + "_"
    keyed = rows.withColumn(asked, _referred(rows, list(refs)))
    wanted = keyed.select("doc_id", asked).distinct().select("doc_id", asked, F.explode(asked).alias("id"))
    found = wanted.join(maps, ["doc_id", "id"]).groupBy("doc_id", asked).agg(F.map_from_entries(F.collect_list(F.struct("id", "canonical"))).alias(name))
    out = keyed.join(found, ["doc_id", asked], "left").select(*rows.columns, name)
    for ref, must_be_known in refs.items():
        column, *path = ref.split(".")

        def new(x: Column, known: bool = must_be_known) -> Column:
            there = F.try_element_at(F.col(name), x)
            return there if known else F.coalesce(there, x)

        out = out.withColumn(column, _followed(F.col(column), rows.schema[column].dataType, path, new))
    return out.drop(name)


def _of_document(id_: Column) -> Column:
    """An id made unique by the first six characters of its document's; null stays."""
    return F.concat(id_, F.lit("__"), F.substring(F.col("doc_id").cast("string"), 1, 6))


#: Of each list of a document: its references to concepts (whether they must be known), and its own ids.
REFERENCES = {
    "relations": ({"from_concept_id": True, "to_concept_id": True}, ()),
    "repertoires": ({"concept_id": True, "concepto_confundido": False}, ("id",)),
    "cases": ({"concept_ids": True, "primary_concept_id": False}, ("id",)),
    "scenarios": ({"concept_ids": True}, ("id", "parent_case_id")),
    "theses": ({"concept_ids": True}, ("id", "framework_id")),
    "frameworks": ({"concept_ids": False}, ("id", "rivales")),
    "concepts": ({"distinctions.from_concept": False}, ()),
}
#: What rows a list keeps once its ids are canonical.
KEPT = {"relations": "from_concept_id != to_concept_id", "repertoires": "concept_id is not null", "cases": "size(concept_ids) > 0"}


def rewritten_lists(lists: dict[str, DataFrame], groups: DataFrame) -> dict[str, DataFrame]:
    """The lists of all documents, by their name in REFERENCES, with canonical concept ids and with ids of their own that
    no two documents share. Relations need two different known ends, repertoires a known concept, cases one at least.

    lists: each with doc_id and the columns that REFERENCES names; groups: doc_id, id, canonical of every concept."""
    foreign = None
    for name, rows in lists.items():
        found = referenced(rows, list(REFERENCES[name][0]))
        foreign = found if foreign is None else foreign.unionByName(found)
    maps = written(id_maps(groups, foreign), "merge-ids")
    out = {}
    for name, rows in lists.items():
        refs, own = REFERENCES[name]
        rows = remapped(rows, refs, maps)
        for c in own:
            many = isinstance(rows.schema[c].dataType, ArrayType)
            rows = rows.withColumn(c, F.transform(c, _of_document) if many else _of_document(F.col(c)))
        if name == "cases":
            rows = rows.withColumn("primary_concept_id", F.coalesce("primary_concept_id", F.try_element_at("concept_ids", F.lit(1))))
        out[name] = rows.where(KEPT[name]) if name in KEPT else rows
    return out


def fusion_report(lists: dict[str, DataFrame], groups: DataFrame) -> DataFrame:
    """A row a document: how many rows it has of each list, and how many of its concepts are its own, or joined another
    document's. lists and groups as in rewritten_lists; groups may have document-unique uids instead of ids."""
    own = F.col("canonical") == F.col("id")
    out = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_concepts"), F.count_if(own).alias("n_own"), F.count_if(~own).alias("n_joined"))
    for name, rows in lists.items():
        if name != "concepts":
            out = out.join(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "doc_id", "full")
    return out.na.fill(0)


def fusions(concepts: DataFrame, groups: DataFrame, verdicts: DataFrame, joined: int = 50, kept_apart: int = 20) -> DataFrame:
    """The log of a merge: the first concepts that joined an earlier one, and the first that shared an acronym with one but
    have another definition; kind, rank, uid and title.

    concepts: uid, title; groups: uid, canonical; verdicts: uid of concepts that share a key with one they aren't joined to."""
    def first(rows: DataFrame, kind: str, most: int) -> DataFrame:
        top = rows.orderBy("uid").limit(most)
        return top.select(F.lit(kind).alias("kind"), "uid", "title")

    of = concepts.select("uid", "title")
    joins = of.join(groups.where("uid != canonical").select("uid"), "uid", "left_semi")
    apart = of.join(verdicts.select("uid").distinct(), "uid", "left_semi").join(groups.where("uid != canonical").select("uid"), "uid", "left_anti")
    both = first(joins, "fusionada", joined).unionByName(first(apart, "rechazada", kept_apart))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("uid")))


def provenance(best: DataFrame) -> DataFrame:
    """How many concepts come from so many sources."""
    return best.groupBy(F.size("sources").alias("n_sources")).agg(F.count(F.lit(1)).alias("n_concepts"))
