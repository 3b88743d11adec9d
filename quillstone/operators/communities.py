"""Communities of a concept graph by label propagation that always settles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.relations import degrees
from quillstone.sources.shared import written


def propagate(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """concept_id and label: each round takes the most frequent label around, of equals the least.

    All concepts move at once, which can swing between two states for ever (two-coloured graphs do). Once a round
    repeats the labels of two rounds before, or after max_rounds, concepts only move to lesser labels, which ends
    on any graph; rounds that don't end within ten times as many raise. A concept counts its own label. Every round is
    written once; hot concepts are pre-aggregated by label.
    """
    both = edges.select(F.col("from_concept_id").alias("a"), F.col("to_concept_id").alias("b")).where("a != b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both.unionByName(both.select("a", F.col("a").alias("b")).distinct()), "community-edges")
    labels = both.select(F.col("a").alias("concept_id")).distinct().select("concept_id", F.lit(None).cast("string").alias("old"), F.col("concept_id").alias("label"))
    labels, falling = written(labels, "community-labels"), False
    for k in range(11 * max_rounds):
        votes = both.join(labels.select(F.col("concept_id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("a").alias("concept_id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("new"))
        new = F.least("label", "new") if falling else F.col("new")
        after = labels.join(best, "concept_id").select("concept_id", F.col("old").alias("older"), F.col("label").alias("old"), new.alias("label"))
        labels = written(after, "community-labels", instead_of=labels)
        moved, new_state = labels.agg(F.expr("count_if(old != label)"), F.expr("count_if(label is distinct from older)")).first()
        if not moved:
            return labels.select("concept_id", "label")
        falling = falling or not new_state or k >= max_rounds
    raise RuntimeError(f"labels still move after {11 * max_rounds} rounds")


def split(labels: DataFrame, edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """Labels of the concepts of one community that is too large, anew: its hubs leave, the rest is propagated, and each hub
    joins the part that it has most edges to. As they were, if the rest is one part.

    labels: concept_id, label of the community's concepts; edges: any. Hubs are concepts of more than two edges and
    of no fewer than the concept at one eighth of the descending degrees has."""
    inside = written(labels.select("concept_id"), "community-inside")
    ends = lambda rows, c, how: rows.join(inside.withColumnRenamed("concept_id", c), c, how)
    sub = ends(ends(edges, "from_concept_id", "left_semi"), "to_concept_id", "left_semi")
    d = written(degrees(sub), "community-degrees")
    n = inside.count()
    cut = d.groupBy("degree").agg(F.count(F.lit(1)).alias("k")).withColumn("above", F.sum("k").over(Window.orderBy(F.desc("degree")))).where(F.col("above") > max(1, n // 8)).agg(F.max("degree")).first()[0] or 0
    hubs = d.where((F.col("degree") >= cut) & (F.col("degree") > 2)).select("concept_id")
    rest = sub.join(hubs.withColumnRenamed("concept_id", "from_concept_id"), "from_concept_id", "left_anti").join(hubs.withColumnRenamed("concept_id", "to_concept_id"), "to_concept_id", "left_anti")
    parts = propagate(rest, max_rounds)
    if parts.select("label").distinct().limit(2).count() < 2:
        return labels
    both = sub.select(F.col("from_concept_id").alias("h"), F.col("to_concept_id").alias("o")).unionByName(sub.select(F.col("to_concept_id").alias("h"), F.col("from_concept_id").alias("o")))
    pulls = both.join(hubs.withColumnRenamed("concept_id", "h"), "h", "left_semi").join(parts.withColumnRenamed("concept_id", "o"), "o").groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    back = pulls.groupBy(F.col("h").alias("concept_id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
    return parts.unionByName(back)


def communities(edges: DataFrame, max_rounds: int = 30, share: float = 0.5, least: int = 6) -> DataFrame:
    """concept_id, community (numbered by size) and community_label of communities of two or more. One that holds over
    `share` of all concepts and over `least` is split."""
    edges = written(edges.select("from_concept_id", "to_concept_id"), "community-graph")
    labels = propagate(edges, max_rounds)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = labels.count()
    big = [r["label"] for r in sizes.where((F.col("n") > share * total) & (F.col("n") > least)).limit(1).collect()]
    if big:
        labels = labels.where(F.col("label") != big[0]).unionByName(split(labels.where(F.col("label") == big[0]), edges, max_rounds))
    return named(labels, edges)


def named(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """concept_id, community and community_label of labels: communities of two or more by size, called as their concept of most edges."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    numbered = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    hub = labels.join(degrees(edges), "concept_id").groupBy("label").agg(F.min_by("concept_id", F.struct((-F.col("degree")).alias("d"), F.length("concept_id"), "concept_id")).alias("community_label"))
    return labels.join(numbered, "label").join(hub, "label").select("concept_id", F.col("community").cast("long").alias("community"), "community_label")
