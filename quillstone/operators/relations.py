"""Cleaning and analysis of a typed concept graph.

Edges are tall tables; every step is a join or an aggregate on (document and) pair, so hot
documents are spread over their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.shared import written

# The closed set of relation types, spellings that stand for them, and groups of types.
TYPES = "apoya contradice matiza extiende requiere causa ejemplifica generaliza contrasta".split()
ALIASES = {
    "causa_efecto": "causa", "produce": "causa", "genera": "causa", "ejemplo": "ejemplifica", "ilustra": "ejemplifica",
    "generaliza_a": "generaliza", "abstrae": "generaliza", "contrasta_con": "contrasta", "difiere": "contrasta", "se_opone": "contradice",
    "depende": "requiere", "presupone": "requiere", "amplia": "extiende", "amplía": "extiende", "refina": "matiza", "limita": "matiza",
    "sustenta": "apoya", "respalda": "apoya",
}
SYMMETRIC = ("contrasta", "contradice")
INCOMPATIBLE = (("apoya", "contradice"), ("generaliza", "ejemplifica"), ("causa", "contradice"))


def repaired(edges: DataFrame) -> DataFrame:
    """relation_type in the closed set; unknown types become `apoya` of at most 0.3, the original kept."""
    t = F.replace(F.lower(F.trim(F.coalesce("relation_type", F.lit("")))), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for kv in ({k: k for k in TYPES} | ALIASES).items() for x in kv])
    edges = edges.withColumn("t", t).withColumn("k", F.try_element_at(known, F.col("t")))
    return edges.withColumns({
        "relation_type": F.coalesce("k", F.lit("apoya")),
        "original_type": F.when(F.col("k").isNull(), F.col("t")),
        "confidence": F.when(F.col("k").isNull(), F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")),
    }).drop("t", "k")


def linked(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges between two different known concepts. concepts: concept_id."""
    ids = concepts.select(F.col("concept_id").alias("id"))
    edges = edges.where("from_concept_id is not null and to_concept_id is not null and from_concept_id != to_concept_id")
    return edges.join(ids, F.col("from_concept_id") == F.col("id"), "left_semi").join(ids, F.col("to_concept_id") == F.col("id"), "left_semi")


def keyed(edges: DataFrame) -> DataFrame:
    """Adds a and b: the pair, sorted for symmetric types."""
    both = F.col("relation_type").isin(*SYMMETRIC)
    return edges.withColumns({
        "a": F.when(both, F.least("from_concept_id", "to_concept_id")).otherwise(F.col("from_concept_id")),
        "b": F.when(both, F.greatest("from_concept_id", "to_concept_id")).otherwise(F.col("to_concept_id")),
    })


def counted(edges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for edges that are alike as they come (ends, spelling of the type): their highest confidence, and times. What linked,
    repaired and merged make of these rows is what they make of the edges, as capping keeps the order; edges without confidence,
    which capping gives one, are rows of their own. So types are read and concepts met once for all alike."""
    alike = [*keys, "from_concept_id", "to_concept_id", "relation_type"]
    out = edges.groupBy(*alike, F.col("confidence").isNull().alias("__none")).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("times"))
    return out.drop("__none")


def merged(edges: DataFrame, keys: tuple[str, ...] = ("doc_id",), winner: tuple[str, ...] = ()) -> DataFrame:
    """One edge per pair and type: the most confident (the first by doc_id and seq of equals), raised by 0.1
    for each repetition, times, and the columns in `winner` (description, evidence, place) of that one. edges may be counted."""
    times = F.sum("times") if "times" in edges.columns else F.count(F.lit(1))
    aggs = [F.max("confidence").alias("top"), times.alias("times")]
    if winner:
        place = [F.col(c) for c in ("doc_id", "seq") if c in edges.columns]
        aggs.append(F.min_by(F.struct(*winner), F.struct((-F.col("confidence")).alias("c"), *place)).alias("w"))
    one = keyed(edges).groupBy(*keys, "a", "b", "relation_type").agg(*aggs)
    raised = F.when(F.col("times") > 1, F.least(F.lit(1.0), F.col("top") + 0.1 * (F.col("times") - 1))).otherwise(F.col("top"))
    return one.select(*keys, "a", "b", "relation_type", F.round(raised, 4).alias("confidence"), "times", *[F.col(f"w.{c}").alias(c) for c in winner])


def settled(edges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of incompatible types on a pair, the most confident stays at 0.4 at most; adds conflict.

    edges: as merged() gives them. Of several incompatible pairs of types the first counts.
    """
    pair = Window.partitionBy(*keys, "a", "b")
    edges = edges.withColumn("types", F.array_sort(F.collect_set("relation_type").over(pair)))
    found = None
    for x, y in INCOMPATIBLE:
        both = F.array_contains("types", x) & F.array_contains("types", y)
        value = F.array(F.lit(x), F.lit(y))
        found = F.when(both, value) if found is None else found.when(both, value)
    edges = edges.withColumn("found", found).withColumn("in_it", F.coalesce(F.array_contains("found", F.col("relation_type")), F.lit(False)))
    best = F.row_number().over(Window.partitionBy(*keys, "a", "b", "in_it").orderBy(F.desc("confidence"), "relation_type"))
    edges = edges.withColumn("rank", best).where("not in_it or rank = 1")
    capped = F.when(F.col("in_it"), F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence"))
    return edges.withColumn("confidence", capped).withColumn("conflict", F.col("in_it")).drop("found", "in_it", "rank", "types")


def type_tags(edges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs with more than one type, and their types in order."""
    return edges.groupBy(*keys, "a", "b").agg(F.array_sort(F.collect_set("relation_type")).alias("types")).where(F.size("types") > 1)


def prerequisites(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_id with what it requires and what it unlocks, both sorted, empty without edges."""
    needs = edges.where("relation_type = 'requiere'").select(F.col("from_concept_id").alias("c"), F.col("to_concept_id").alias("p")).distinct()
    pre = needs.groupBy(F.col("c").alias("concept_id")).agg(F.array_sort(F.collect_list("p")).alias("requires"))
    post = needs.groupBy(F.col("p").alias("concept_id")).agg(F.array_sort(F.collect_list("c")).alias("unlocks"))
    none = F.array().cast("array<string>")
    return concepts.select("concept_id").join(pre, "concept_id", "left").join(post, "concept_id", "left").withColumns({k: F.coalesce(k, none) for k in ("requires", "unlocks")})


def sequence_quality(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: prerequisite edges against concepts, and how far an order of study can rest on them."""
    e = edges.where("relation_type = 'requiere'").select("from_concept_id", "to_concept_id").distinct().agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("from_concept_id").alias("with_prerequisite"))
    n = concepts.agg(F.count(F.lit(1)).alias("n_concepts"))
    ratio = F.round(F.col("n_edges") / F.greatest("n_concepts", F.lit(1)), 2)
    level = F.when(F.col("ratio") >= 0.5, "buena").when(F.col("ratio") >= 0.2, "parcial").otherwise("no_confiable")
    return e.join(F.broadcast(n)).withColumn("ratio", ratio).withColumn("level", level)


def histogram(edges: DataFrame) -> DataFrame:
    """One row: edges of high, middle and low confidence."""
    c = F.col("confidence")
    return edges.agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("middle"), F.count_if(c < 0.6).alias("low"))


def orphans(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts without any edge."""
    ends = edges.select(F.col("from_concept_id").alias("concept_id")).unionByName(edges.select(F.col("to_concept_id").alias("concept_id"))).distinct()
    return concepts.select("concept_id").join(ends, "concept_id", "left_anti")


def unordered(pairs: DataFrame, a: str, b: str, concepts: DataFrame) -> DataFrame:
    """Distinct pairs of two different known concepts, the lesser first."""
    ids = concepts.select(F.col("concept_id").alias("id"))
    pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    return pairs.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")


def co_occurrences(mentions: DataFrame, sizes: DataFrame, members: DataFrame, pars: int, max_per_paragraph: int = 8, min_shared: int = 2, top: int = 300) -> DataFrame:
    """Pairs that share paragraphs: a, b, shared, strength; the strongest first.

    mentions: doc_id, seq and group; sizes: group and size; members: concept_id and group; see mentioned_groups. pars: paragraphs in all.
    Those of more than max_per_paragraph concepts give no pairs but count as appearances, so a paragraph gives 28 pairs at most,
    no two paragraphs need to meet, and groups of more concepts are never spelled out.
    """
    some = mentions.where("doc_id is not null and seq is not null").join(sizes, "group").groupBy("doc_id", "seq").agg(F.collect_list("group").alias("groups"), F.sum("size").alias("n_in"))
    some = written(some, "mentions")
    seen = mentions.groupBy("group").agg(F.count(F.lit(1)).alias("seen"))
    small = written(members.join(sizes.where(F.col("size") <= max_per_paragraph), "group").select("concept_id", "group"), "members")
    few = some.where(F.col("n_in").between(2, max_per_paragraph)).select("doc_id", "seq", F.explode("groups").alias("group")).join(small, "group")
    few = few.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_list("concept_id")).alias("concept_ids"))
    after = F.transform("concept_ids", lambda a, k: F.transform(F.filter("concept_ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = few.select(F.explode(F.flatten(after)).alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    seen = small.join(seen, "group").select("concept_id", "seen")
    counts = counts.join(seen.select(F.col("concept_id").alias("a"), F.col("seen").alias("sa")), "a").join(seen.select(F.col("concept_id").alias("b"), F.col("seen").alias("sb")), "b")
    expected = F.greatest(F.col("sa") * F.col("sb") / F.lit(pars), F.lit(0.5))
    counts = counts.select("a", "b", "shared", F.round(F.least(F.lit(1.0), F.col("shared") / expected), 2).alias("strength"))
    return counts.orderBy(F.desc("strength"), F.desc("shared"), "a", "b").limit(top)


def hinted(pairs: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """The pairs most often together that no edge joins. pairs: a, b, shared."""
    known = edges.select(F.least("from_concept_id", "to_concept_id").alias("a"), F.greatest("from_concept_id", "to_concept_id").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti").orderBy(F.desc("shared"), "a", "b").limit(cap)


def axis_positions(positions: DataFrame, concepts: DataFrame, min_share: float = 0.4, floor: int = 4) -> DataFrame:
    """axis_id, n and mean of axes that place enough known concepts; the first position of each counts.

    positions: axis_id, concept_id, seq, position.
    """
    known = positions.where("position is not null").join(concepts.select("concept_id"), "concept_id", "left_semi")
    first = known.groupBy("axis_id", "concept_id").agg(F.min_by("position", "seq").alias("position"))
    n = concepts.agg(F.count(F.lit(1)).alias("n_concepts"))
    out = first.groupBy("axis_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("position") * 1000).cast("long")).alias("s"))
    return out.join(F.broadcast(n)).where(F.col("n") >= F.greatest(F.lit(float(floor)), F.col("n_concepts") * min_share)).select("axis_id", "n", (F.expr("s div n") / 1000).alias("mean_position"))


def degrees(edges: DataFrame) -> DataFrame:
    """concept_id and its number of edge ends."""
    ends = edges.select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("concept_id"))
    return ends.groupBy("concept_id").agg(F.count(F.lit(1)).alias("degree"))


def described(edges: DataFrame, titles: DataFrame, norm) -> DataFrame:
    """Adds mentioned: how many of an edge's ends its description names, whole or by all long words.

    edges: from_concept_id, to_concept_id, description; titles: concept_id, title; norm: a text norm.
    """
    t = titles.select(F.col("concept_id").alias("id"), norm(F.col("title")).alias("tn"))
    out = edges.withColumn("dn", norm(F.col("description")))

    def names(form: Column) -> Column:
        long_words = F.filter(F.split(form, " "), lambda w: F.length(w) > 3)
        whole = F.contains(F.concat(F.lit(" "), F.col("dn"), F.lit(" ")), F.concat(F.lit(" "), form, F.lit(" ")))
        parts = (F.size(long_words) > 0) & (F.size(F.array_except(long_words, F.split("dn", " "))) == 0)
        return F.coalesce((form != "") & (whole | parts), F.lit(False)).cast("int")

    out = out.join(t.select(F.col("id").alias("from_concept_id"), F.col("tn").alias("fa")), "from_concept_id", "left")
    out = out.join(t.select(F.col("id").alias("to_concept_id"), F.col("tn").alias("fb")), "to_concept_id", "left")
    return out.withColumn("mentioned", names(F.col("fa")) + names(F.col("fb"))).drop("dn", "fa", "fb")


def facet_names(facets: DataFrame, cap: int = 60) -> DataFrame:
    """Distinct names in first-seen order, so many at most. facets: name, seq."""
    return facets.groupBy("name").agg(F.min("seq").alias("first_seq")).orderBy("first_seq", "name").limit(cap)
