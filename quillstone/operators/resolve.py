"""Entity resolution: structural keys, components over shared keys, and merging of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import acronym_split, title_norm, title_tokens
from quillstone.sources.shared import written

# Tokens too common in titles to suggest that two are alike.
GENERIC_TOKENS = (
    "like base based using type kind form level part component componente tipo nivel parte proceso process system sistema model modelo "
    "effect efecto study estudio data dato value valor user usuario human humano index indice scale escala metric metrica phase fase"
).split()
MAX_AUTO_GROUP = 3


def extraction_counts(concepts: DataFrame) -> DataFrame:
    """Adds n_extracted: rows of the same normalised title (of the same id if that is empty).

    Titles are counted on the map side first, so that a frequent one isn't gathered in one task."""
    keyed = concepts.withColumn("__title_key", F.coalesce(F.nullif(title_norm("title"), F.lit("")), F.col("concept_id")))
    counts = keyed.groupBy("__title_key").agg(F.count(F.lit(1)).alias("n_extracted"))
    return keyed.join(counts, "__title_key").drop("__title_key")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order: a partial aggregate instead of a sort of all rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def title_parts(concepts: DataFrame) -> DataFrame:
    """concept_id with its normalised title t, title without parenthesis b and acronym a (or null)."""
    return concepts.select("concept_id", "title", acronym_split(F.col("title")).alias("p")).select(
        "concept_id", title_norm("title").alias("t"), title_norm("p.base").alias("b"), F.nullif(title_norm("p.acronym"), F.lit("")).alias("a")
    )


def structural_keys(concepts: DataFrame) -> DataFrame:
    """concept_id and each of its keys: title, title without parenthesis, unambiguous acronym (@).

    A title may itself be the acronym of others, so every title that is one gets that key too. Titles are read once, and what
    they give is written: filters and joins over it would else repeat the reading."""
    parts = written(title_parts(concepts), "title-parts")
    clear = parts.where("a is not null").groupBy("a").agg(F.count_distinct("b").alias("n_bases")).where("n_bases = 1").select("a")
    owners = parts.select("concept_id", "a").where("a is not null")
    bare = parts.select("concept_id", F.col("t").alias("a"))
    named = parts.select("concept_id", F.explode(F.array_distinct(F.array("t", "b"))).alias("key")).where("key != ''")
    by_acronym = owners.unionByName(bare).distinct().join(clear, "a", "left_semi").select("concept_id", F.concat(F.lit("@"), F.col("a")).alias("key"))
    return named.unionByName(by_acronym)


def ambiguous_acronyms(parts: DataFrame) -> DataFrame:
    """Acronyms that more than one base title claims. parts: a, b."""
    return parts.where("a is not null").groupBy("a").agg(F.count_distinct("b").alias("n_bases")).where("n_bases > 1")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node and component (its least member) over edges (a, b), by hooking and shortcutting.

    Every round is written to the shared folder; rounds grow with the logarithm of the longest
    chain. Nodes without edges aren't returned.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "component-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("component")), "component-labels")
    for _ in range(max_rounds):
        offered = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("c"))
        hooked = labels.join(offered.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        after = written(hooked.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")), "component-labels")
        labels = after.select("node", "component")
        if not after.where("old != component").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def key_groups(concepts: DataFrame) -> DataFrame:
    """concept_id and component over shared structural keys; concepts alone are their own."""
    keys = written(structural_keys(concepts), "structural-keys")
    hub = keys.groupBy("key").agg(F.min("concept_id").alias("a"))
    edges = keys.join(hub, "key").select("a", F.col("concept_id").alias("b")).where("a != b").distinct()
    found = components(edges)
    return concepts.select("concept_id").join(found.withColumnRenamed("node", "concept_id"), "concept_id", "left").withColumn("component", F.coalesce("component", "concept_id"))


def sized(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """Concepts with their component and its size; in components over MAX_AUTO_GROUP each is its own (whole: its old one)."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = concepts.join(groups, "concept_id").join(sizes, "component").withColumn("whole", F.col("component"))
    return rows.withColumn("component", F.when(F.col("size") > MAX_AUTO_GROUP, F.col("concept_id")).otherwise(F.col("component")))


def merged(concepts: DataFrame, groups: DataFrame, fill: tuple[str, ...] = ()) -> DataFrame:
    """One row per component of up to MAX_AUTO_GROUP concepts, larger ones concept by concept.

    concepts: concept_id, seq, title, definition, importance, is_enriched, is_gateway, is_threshold; if they are there,
    pages, synonyms and variants (arrays), confidence, and the columns named in fill.
    The best variant gives canonical_id, title and definition, unless a later one's definition is over twice as long;
    titles of others that read differently become synonyms; pages, synonyms and variants are united and sorted;
    importance is the largest (null: 0), flags hold if one does (null: false); a column of fill is the first that isn't
    empty. A component is bounded, so its variants are sorted in one array. Texts and flags may be null.
    """
    counted, have = extraction_counts(concepts), set(concepts.columns)
    arrays = {c: F.coalesce(F.col(c), F.array()) if c in have else F.array() for c in ("synonyms", "variants")}
    arrays = {c: x.cast("array<string>") for c, x in arrays.items()}
    pages = F.coalesce(F.col("pages"), F.array()) if "pages" in have else F.array_compact(F.array("first_page")) if "first_page" in have else F.array()
    zero, no = F.lit(0.0), F.lit(False)
    length = F.length(F.coalesce("definition", F.lit("")))
    importance = F.coalesce(F.col("importance").cast("double"), zero)
    trust = F.coalesce(F.col("confidence"), F.lit(0.6)) if "confidence" in have else F.lit(0.6)
    flag = lambda c: F.coalesce(F.col(c), no)
    rank = [~flag("is_enriched"), -F.col("n_extracted"), F.coalesce(F.array_min(pages.cast("array<int>")), F.lit(999)), acronym_split(F.col("title"))["acronym"].isNull(), -length, -importance, -trust, F.col("seq")]
    row = F.struct(
        *[r.alias(f"r{i}") for i, r in enumerate(rank)], "concept_id", F.coalesce("title", F.lit("")).alias("title"), title_norm("title").alias("norm"), F.coalesce("definition", F.lit("")).alias("definition"),
        importance.alias("importance"), flag("is_gateway").alias("is_gateway"), flag("is_threshold").alias("is_threshold"), pages.cast("array<int>").alias("pages"), *[x.alias(c) for c, x in arrays.items()], *fill,
    )
    found = sized(counted, groups).groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("vs")).withColumn("w", F.get("vs", F.lit(0)))
    later, every = F.slice("vs", 2, MAX_AUTO_GROUP), lambda c: F.flatten(F.transform("vs", lambda x: x[c]))
    united = lambda x: F.array_sort(F.array_distinct(x))
    spelled = F.transform(F.filter(later, lambda x: (F.trim(x["title"]) != "") & (x["norm"] != F.col("w.norm"))), lambda x: F.trim(x["title"]))
    definition = F.aggregate(later, F.col("w.definition"), lambda best, x: F.when(F.length(x["definition"]) > 2 * F.length(best), x["definition"]).otherwise(best))
    kinds = dict(concepts.dtypes)

    def first_filled(c: str) -> Column:
        has = lambda x: (F.size(x[c]) > 0) if kinds[c].startswith("array") else (x[c].cast("string") != "")
        return F.get(F.filter("vs", has), F.lit(0))[c].alias(c)

    filled = [first_filled(c) for c in fill]
    return found.select(
        "component", F.col("w.concept_id").alias("canonical_id"), F.col("w.title").alias("title"), definition.alias("definition"),
        F.array_sort(F.transform("vs", lambda x: x["concept_id"])).alias("members"), united(every("pages")).alias("pages"),
        united(F.concat(every("synonyms"), spelled)).alias("synonyms"), united(every("variants")).alias("variants"),
        F.array_max(F.transform("vs", lambda x: x["importance"])).alias("importance"),
        F.exists("vs", lambda x: x["is_gateway"]).alias("is_gateway"), F.exists("vs", lambda x: x["is_threshold"]).alias("is_threshold"), *filled,
    )


def deterministic_pass(concepts: DataFrame, fill: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What structural keys alone decide: merged concepts, id map (old, new) and the concepts of groups that
    are too large and left to adjudication (component, members)."""
    groups = written(key_groups(concepts), "key-groups")
    out = written(merged(concepts, groups, fill), "merged-concepts")
    id_map = out.select(F.explode("members").alias("old"), F.col("canonical_id").alias("new"))
    large = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_AUTO_GROUP).select("component")
    return out, id_map, groups.join(large, "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("concept_id")).alias("members"))


def pass_report(concepts: DataFrame, out: DataFrame, oversized: DataFrame) -> DataFrame:
    """One row: concepts in and out, fusions, absorbed concepts, ambiguous acronyms and oversized groups."""
    n = lambda df, *aggs: df.agg(*aggs)
    one, size = F.count(F.lit(1)), F.size("members")
    after = n(out, one.alias("n_out"), F.count_if(size > 1).alias("fusions"), F.coalesce(F.sum(size - 1), F.lit(0)).alias("absorbed"))
    row = n(concepts, one.alias("n_in")).join(F.broadcast(after))
    return row.join(F.broadcast(n(ambiguous_acronyms(title_parts(concepts)), one.alias("ambiguous")))).join(F.broadcast(n(oversized, one.alias("oversized"))))


def remapped(rows: DataFrame, col: str, id_map: DataFrame) -> DataFrame:
    """col through id_map (old, new); ids without an entry stay."""
    return rows.join(id_map.select(F.col("old").alias(col), "new"), col, "left").withColumn(col, F.coalesce("new", col)).drop("new")


def acronym_candidates(concepts: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """Groups of concepts that share an acronym: members (sorted array), n. An acronym is in a title's trailing
    parenthesis, is a title of one short word, or is a synonym of 2 to 8 characters in capitals.

    concepts: concept_id, title, and synonyms (array) where there are any."""
    t = F.col("title")
    one_word = title_norm(t)
    keys = F.array(title_norm(acronym_split(t)["acronym"]), F.when(~F.contains(one_word, F.lit(" ")) & (F.length(one_word) <= 8), one_word))
    if "synonyms" in concepts.columns:
        capitals = lambda s: F.length(s).between(2, 8) & (F.upper(s) == s) & (F.lower(s) != s)
        said = F.filter(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), F.trim), capitals)
        keys = F.concat(keys, F.transform(said, title_norm))
    each = concepts.select("concept_id", F.explode(F.array_distinct(keys)).alias("key")).where("key != ''")
    groups = each.groupBy("key").agg(F.array_sort(F.collect_set("concept_id")).alias("members"))
    return groups.where(F.size("members").between(least, most)).select("members").distinct().withColumn("n", F.size("members"))


def token_candidates(concepts: DataFrame, least: int = 2, most: int = 6, cap: int = 25) -> DataFrame:
    """Groups that share a title token that isn't generic, the rarest first."""
    tokens = concepts.select("concept_id", F.explode(title_tokens("title")).alias("token")).where(~F.col("token").isin(GENERIC_TOKENS))
    groups = tokens.groupBy("token").agg(F.array_sort(F.collect_set("concept_id")).alias("members"))
    return groups.withColumn("n", F.size("members")).where(F.col("n").between(least, most)).orderBy("n", "token").limit(cap)


def without_contained(groups: DataFrame) -> DataFrame:
    """Groups that aren't within an earlier one. groups: seq, members. Only groups that share a
    member are compared."""
    each = groups.select("seq", "members", F.explode("members").alias("m"))
    pairs = each.select("seq", "m", F.size("members").alias("n")).join(each.select(F.col("seq").alias("earlier"), "m"), "m").where("earlier < seq")
    inside = pairs.groupBy("seq", "earlier", "n").agg(F.count(F.lit(1)).alias("shared")).where("shared = n").select("seq").distinct()
    return groups.join(inside, "seq", "left_anti")
