"""Compilation of ordered study plans and exercise items."""

from __future__ import annotations

from functools import reduce

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import stable_id, title_norm
from quillstone.operators.profile import lookup

# How far an edge of each type moves its ends in the order of study.
SOFT = {"causa": -1.0, "generaliza": -1.0, "ejemplifica": 1.0, "extiende": 1.0, "apoya": 0.2}
DIFFICULTY = {"basico": 1, "intermedio": 2, "avanzado": 3}
LOADS = {"memorizar": "A", "discriminar": "B,C", "integrar": "C,D", "inferir": "E,F"}


def soft_scores(edges: DataFrame) -> DataFrame:
    """concept_id and soft: the sum of its edges' moves (origin down, destination up)."""
    w = lookup(F.col("relation_type"), SOFT, 0.0)
    moves = edges.select(F.explode(F.array(F.struct(F.col("from_concept_id").alias("concept_id"), (-w).alias("m")), F.struct(F.col("to_concept_id").alias("concept_id"), w.alias("m")))).alias("x")).select("x.*")
    return moves.groupBy("concept_id").agg((F.sum(F.round(F.col("m") * 10).cast("long")) / 10).alias("soft"))


def priority(concepts: DataFrame, soft: DataFrame, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Adds rank within keys: gateways, soft score, difficulty, importance, page, input place."""
    c = concepts.join(soft, "concept_id", "left").withColumn("soft", F.coalesce("soft", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("is_gateway"), F.desc("soft"), lookup(F.col("difficulty"), DIFFICULTY, 2), F.desc("importance"), F.coalesce("first_page", F.lit(99)), "seq")
    return c.withColumn("rank", F.row_number().over(w))


def study_order(ranked: DataFrame, needs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Place of every concept: the best ranked whose prerequisites are done comes next; where a
    cycle blocks all, the best ranked of all.

    ranked: key, concept_id, rank; needs: key, concept_id, required. One document is one group.
    """

    def order(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rank = dict(zip(left["concept_id"], left["rank"]))
        waits = {c: set() for c in rank}
        opens: dict = {}
        for c, r in zip(right["concept_id"], right["required"]):
            if c in waits and r in rank and c != r and r not in waits[c]:
                waits[c].add(r)
                opens.setdefault(r, []).append(c)
        ready = [(rank[c], c) for c in rank if not waits[c]]
        every = [(rank[c], c) for c in rank]
        heapq.heapify(ready)
        heapq.heapify(every)
        done: list = []
        seen: set = set()
        while len(done) < len(rank):
            queue = ready or every
            _, c = heapq.heappop(queue)
            if c in seen:
                continue
            seen.add(c)
            done.append(c)
            for o in opens.get(c, ()):
                waits[o].discard(c)
                if not waits[o] and o not in seen:
                    heapq.heappush(ready, (rank[o], o))
        return pd.DataFrame({key: left[key].iloc[0] if len(left) else right[key].iloc[0], "concept_id": done, "place": range(1, len(done) + 1)})

    kind = dict(ranked.dtypes)[key]
    return ranked.select(key, "concept_id", "rank").groupBy(key).cogroup(needs.select(key, "concept_id", "required").groupBy(key)).applyInPandas(order, f"{key} {kind}, concept_id string, place long")


def levels(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    """concept_id and level: the longest chain of prerequisites below it; null in and above cycles.

    A round keeps the edges whose prerequisite still has prerequisites itself and notes what has none left, so it ends
    after as many rounds as the graph is deep, and a round costs as much as is still open."""
    from quillstone.sources.shared import remove, shared_dir, written

    known = nodes.select("concept_id").distinct()
    inside = needs.select("concept_id", "required").where("concept_id != required").join(known, "concept_id", "left_semi").join(known.withColumnRenamed("concept_id", "required"), "required", "left_semi")
    edges = written(inside.select("concept_id", "required").distinct(), "level-edges")
    done, left, k = shared_dir(edges.sparkSession, "levels"), edges.count(), 0
    edges.select("concept_id", F.lit(0).alias("level")).limit(0).write.parquet(done)
    while left:
        open_ = edges.select(F.col("concept_id").alias("required")).distinct()
        rest = written(edges.join(open_, "required", "left_semi").select("concept_id", "required"), "level-edges")
        before, left, k = left, rest.count(), k + 1
        if left == before:  # all that is left waits for itself
            break
        edges.select("concept_id").distinct().join(rest.select("concept_id").distinct(), "concept_id", "left_anti").select("concept_id", F.lit(k).alias("level")).write.mode("append").parquet(done)
        remove(edges.sparkSession, edges.written_to)
        edges = rest
    found = edges.sparkSession.read.schema(f"concept_id {dict(nodes.dtypes)['concept_id']}, level int").parquet(done)
    stuck = edges.select("concept_id", F.lit(None).cast("int").alias("level")).distinct() if left else None
    found = (found if stuck is None else found.unionByName(stuck)).withColumn("open", F.lit(True))
    return nodes.select("concept_id").join(found, "concept_id", "left").select("concept_id", F.when(F.col("open"), F.col("level")).otherwise(0).alias("level"))


def kahn_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """doc_id, concept_id and place (from 1): prerequisites first, of those that are free the least id first;
    concepts in or behind cycles come last, in their input order.

    nodes: doc_id, concept_id, seq; needs: doc_id, concept_id, required (others than nodes don't count).
    What is free depends on what came before, so a document's concepts are ordered in one group."""
    required = needs.groupBy("doc_id", "concept_id").agg(F.collect_set("required").alias("required"))
    rows = nodes.select("doc_id", "concept_id", "seq").join(required, ["doc_id", "concept_id"], "left")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "concept_id"])
        open_ = {c: set() for c in pdf["concept_id"]}
        opens = {c: [] for c in open_}
        for c, wants in zip(pdf["concept_id"], pdf["required"]):
            for r in [] if wants is None else wants:
                if r in open_:
                    open_[c].add(r)
                    opens[r].append(c)
        free = sorted(c for c, r in open_.items() if not r)
        out = []
        while free:
            out.append(heapq.heappop(free))
            for c in opens[out[-1]]:
                open_[c].discard(out[-1])
                if not open_[c]:
                    heapq.heappush(free, c)
        placed = set(out)
        out += [c for c in open_ if c not in placed]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * len(out), "concept_id": out, "place": range(1, len(out) + 1)})

    kind = dict(nodes.dtypes)["doc_id"]
    return rows.groupBy("doc_id").applyInPandas(order, f"doc_id {kind}, concept_id string, place long")


def order_quality(evidence: list[Column]) -> Column:
    """buena, parcial or debil by how many of five signs of an order hold."""
    n = sum((F.coalesce(e, F.lit(False)).cast("int") for e in evidence[1:]), F.coalesce(evidence[0], F.lit(False)).cast("int"))
    return F.when(n >= 4, "buena").when(n >= 2, "parcial").otherwise("debil")


def units(ordered: DataFrame, key: str = "doc_id", size: int = 5, hard: int = 7) -> DataFrame:
    """Unit of every concept: cut at size where the cluster changes, at hard anyway.

    ordered: key, concept_id, place, cluster_id."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        unit, n, last, out = 1, 0, None, []
        for c in pdf["cluster_id"]:
            if n >= hard or n >= size and c != last:
                unit, n = unit + 1, 0
            out.append(unit)
            n, last = n + 1, c
        return pd.DataFrame({key: pdf[key], "concept_id": pdf["concept_id"], "unit": out})

    kind = dict(ordered.dtypes)[key]
    return ordered.groupBy(key).applyInPandas(cut, f"{key} {kind}, concept_id string, unit long")


def curve(unit: Column, total: Column, base: Column) -> Column:
    """struct(difficulty, options, scaffold) of a unit by its place and mean difficulty (0 to 1)."""
    d = F.round(F.least(F.lit(1.0), 0.35 + 0.4 * base + 0.35 * (unit - 1) / total), 3)
    options = F.when(d < 0.5, 3).when(d < 0.75, 4).otherwise(5)
    scaffold = F.when(d < 0.45, "alto").when(d < 0.7, "medio").otherwise("bajo")
    return F.struct(d.alias("difficulty"), options.alias("options"), scaffold.alias("scaffold"))


def concept_difficulty(unit_difficulty: Column, own: Column) -> Column:
    """Mostly the unit's difficulty; ties go up."""
    return F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.6 * unit_difficulty + 0.4 * own)) + 1e-9, 2)


def distinction_pool(distinctions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distractors from distinctions. distinctions: concept_id, other_id, difference."""
    titles = concepts.select(F.col("concept_id").alias("other_id"), F.col("definition").alias("text"))
    out = distinctions.where("concept_id != other_id").dropDuplicates(["concept_id", "other_id"]).join(titles, "other_id")
    return out.select("concept_id", stable_id("d", F.col("concept_id"), F.col("other_id")).alias("distractor_id"), F.lit(0.9).alias("plausibility"), F.lit("distincion").alias("origin"), "text")


def repertoire_pool(repertoires: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distractors from everyday intuitions. repertoires: repertoire_id, concept_id, label."""
    out = repertoires.join(concepts.select("concept_id"), "concept_id", "left_semi")
    return out.select("concept_id", stable_id("r", F.col("repertoire_id")).alias("distractor_id"), F.lit(0.95).alias("plausibility"), F.lit("repertorio").alias("origin"), F.col("label").alias("text"))


def neighbour_pool(edges: DataFrame, pool: DataFrame, concepts: DataFrame, size: int = 6, quota: int = 3) -> DataFrame:
    """Distractors from graph neighbours (their definitions), each neighbour used by the first quota concepts only."""
    seq = concepts.select("concept_id", "seq")
    both = edges.select("from_concept_id", "to_concept_id").unionByName(edges.select(F.col("to_concept_id").alias("from_concept_id"), F.col("from_concept_id").alias("to_concept_id"))).distinct()
    both = both.toDF("concept_id", "other_id").where("concept_id != other_id").join(seq, "concept_id")
    n = pool.groupBy("concept_id").agg(F.count(F.lit(1)).alias("have"))
    used = F.row_number().over(Window.partitionBy("other_id").orderBy("seq"))
    out = both.withColumn("used", used).where(F.col("used") <= quota).join(n, "concept_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    k = F.row_number().over(Window.partitionBy("concept_id").orderBy("other_id"))
    texts = concepts.select(F.col("concept_id").alias("other_id"), F.col("definition").alias("text"))
    out = out.withColumn("k", k).where(F.col("k") + F.col("have") <= size).join(texts, "other_id")
    return out.select("concept_id", stable_id("n", F.col("concept_id"), F.col("other_id")).alias("distractor_id"), F.lit(0.6).alias("plausibility"), F.lit("vecino").alias("origin"), "text")


def effective_options(pool: DataFrame) -> DataFrame:
    """concept_id, n and n_effective: one plus the plausibility of its distractors."""
    return pool.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.round(1 + F.sum(F.round(F.col("plausibility") * 100).cast("long")) / 100, 2).alias("n_effective"))


def accepted_forms(concepts: DataFrame) -> DataFrame:
    """concept_id with accepted and ambiguous forms: a form that several concepts claim is ambiguous.

    concepts: concept_id, forms (array)."""
    each = concepts.select("concept_id", F.explode("forms").alias("form")).withColumn("norm", title_norm("form")).where("norm != ''")
    claims = each.groupBy("norm").agg(F.count_distinct("concept_id").alias("n"))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("norm"))))
    alone = (F.col("n") == 1) & (F.length("norm") >= 4)
    return each.join(claims, "norm").groupBy("concept_id").agg(pick(alone).alias("accepted"), pick(F.col("n") > 1).alias("ambiguous"))


def relation_items(edges: DataFrame, rarity: DataFrame) -> DataFrame:
    """One item per unordered pair: all its types are right, the rarest gives its weight."""
    n_types = edges.select("relation_type").distinct().count()
    e = edges.join(F.broadcast(rarity), "relation_type").select(F.least("from_concept_id", "to_concept_id").alias("a"), F.greatest("from_concept_id", "to_concept_id").alias("b"), "relation_type", "rarity")
    out = e.groupBy("a", "b").agg(F.array_sort(F.collect_set("relation_type")).alias("types"), F.max("rarity").alias("rarity"))
    return out.select(stable_id("c1", F.col("a"), F.col("b")).alias("item_id"), "a", "b", "types", F.round(F.greatest(F.lit(2.0), n_types / F.size("types")), 2).alias("n_effective"), "rarity")


def case_items(cases: DataFrame) -> DataFrame:
    """E1 (where predictions are enabled) and E3 items of cases with an expected resolution."""
    gold = cases.where(F.trim("resolucion_esperada") != "")
    item = lambda m, df: df.select(stable_id(m, F.col("case_id")).alias("item_id"), F.lit(m.upper()).alias("mechanic_id"), "case_id")
    return item("e1", gold.where("prediction_enabled")).unionByName(item("e3", gold))


def error_items(cases: DataFrame, scenarios: DataFrame) -> DataFrame:
    """E2 items of cases and scenarios with an embedded error. Both: source_id, error."""
    rows = cases.unionByName(scenarios).where(F.trim(F.coalesce("error", F.lit(""))) != "")
    return rows.select(stable_id("e2", F.col("source_id")).alias("item_id"), F.lit("E2").alias("mechanic_id"), "source_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, the reverse ones marked, with how the text states it."""
    fwd = edges.select(F.col("from_concept_id").alias("concept_id"), F.col("to_concept_id").alias("other_id"), "relation_type", F.lit(False).alias("reverse"), "confidence")
    back = edges.select(F.col("to_concept_id").alias("concept_id"), F.col("from_concept_id").alias("other_id"), "relation_type", F.lit(True).alias("reverse"), "confidence")
    return fwd.unionByName(back).withColumn("stated", F.when(F.col("confidence") >= 0.6, "afirmada").otherwise("inferida"))


def concept_index(concepts: DataFrame, loads: Column) -> DataFrame:
    """Title with a capital, families that its loads (array) recommend, and place."""
    title = F.concat(F.upper(F.substring("title", 1, 1)), F.expr("substring(title, 2)"))
    table = F.create_map(*[F.lit(x) for kv in LOADS.items() for x in kv])
    families = F.array_sort(F.array_distinct(F.flatten(F.transform(loads, lambda x: F.coalesce(F.split(F.try_element_at(table, x), ","), F.array().cast("array<string>"))))))
    return concepts.select("concept_id", title.alias("title"), F.when(F.size(families) > 0, families).otherwise(F.array(F.lit("A"))).alias("families"))


def provisional_axes(concepts: DataFrame, degrees: DataFrame) -> DataFrame:
    """(axis, concept_id, position) by kind, difficulty and, if any degree is over 2, centrality."""
    kinds = {"teorico": 0.0, "metodologico": 0.33, "empirico": 0.66, "aplicado": 1.0}
    top = degrees.agg(F.max("degree").alias("top"))
    c = concepts.join(degrees, "concept_id", "left").join(F.broadcast(top))
    rows = F.array_compact(F.array(
        F.struct(F.lit("tipo").alias("axis"), lookup(F.col("tipo"), kinds, 0.0).alias("position")),
        F.struct(F.lit("dificultad").alias("axis"), lookup(F.col("difficulty"), {"basico": 0.15, "intermedio": 0.5, "avanzado": 0.9}, 0.5).alias("position")),
        F.when(F.col("top") > 2, F.struct(F.lit("centralidad").alias("axis"), F.round(F.coalesce("degree", F.lit(0)) / F.col("top"), 2).alias("position"))),
    ))
    return c.select("concept_id", F.explode(rows).alias("x")).select("concept_id", "x.axis", "x.position")


def capabilities(concepts: DataFrame, edges: DataFrame, pool: DataFrame, repertoires: DataFrame, scenarios: DataFrame, cases: DataFrame, frameworks: DataFrame) -> DataFrame:
    """One row: what a material can sustain, as counts, and the conditions that those open.

    concepts: concept_id, is_gateway, is_threshold; edges: from_concept_id, to_concept_id, relation_type, confidence (null: 0.6);
    pool: concept_id; scenarios: distancia, cases: prediction_enabled, both error_embebido; frameworks: rival_id.
    Anchors are concepts of three edges or more, top_anchors the first 20. Every part is one row by construction.
    """
    one = F.count(F.lit(1))
    trust = F.coalesce(F.col("confidence"), F.lit(0.6))
    ends = edges.select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("concept_id"))
    anchors = ends.groupBy("concept_id").agg(one.alias("degree")).where("degree >= 3").join(concepts.select("concept_id"), "concept_id", "left_semi")
    top = anchors.orderBy(F.desc("degree"), "concept_id").limit(20).agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "concept_id"))).alias("a"))
    sizes = concepts.select("concept_id").join(pool.groupBy("concept_id").agg(one.alias("n")), "concept_id", "left")
    erroneous = lambda df: df.select(F.trim(F.coalesce("error_embebido", F.lit(""))).alias("e"))
    at = lambda d: F.count_if(F.coalesce(F.col("distancia") == d, F.lit(False)))
    parts = [
        anchors.agg(one.alias("anchors")),
        top.select(F.array_join(F.transform("a", lambda x: x["concept_id"]), ",").alias("top_anchors")),
        concepts.agg(F.count_if("is_gateway").alias("gateways"), F.count_if("is_threshold").alias("thresholds")),
        sizes.agg(F.count_if(F.col("n").isNull()).alias("without_pool"), F.count_if(F.col("n") < 2).alias("least_pools"), F.count_if(F.col("n") >= 3).alias("large_pools")),
        edges.agg(F.count_distinct("relation_type").alias("types"), F.count_if(trust >= 0.8).alias("asserted"), F.count_if((trust >= 0.6) & (trust < 0.8)).alias("implied"), F.count_if(trust < 0.6).alias("inferred")),
        repertoires.agg(one.alias("repertoires")),
        scenarios.agg(one.alias("scenarios"), at("cercana").alias("near"), at("media").alias("middle"), at("lejana").alias("far")),
        cases.agg(F.count_if("prediction_enabled").alias("predicted_cases")),
        erroneous(cases).unionByName(erroneous(scenarios)).agg(F.count_if(F.col("e") != "").alias("with_error")),
        frameworks.agg(F.count_if(F.length("rival_id") > 0).alias("rivals")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    least = {"chain": ("anchors", 2), "monoculture": ("types", 2), "threshold": ("thresholds", 2), "swarm": ("large_pools", 5), "echo": ("repertoires", 1), "portal": ("scenarios", 1), "rival_framework": ("rivals", 2)}
    return out.withColumns({name: F.col(c) >= n for name, (c, n) in least.items()})


def problems(concepts: DataFrame, pool: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """Concepts that lack a pool, edges or items, and what they lack."""
    has = lambda df, name: df.select("concept_id").distinct().withColumn(name, F.lit(True))
    ends = edges.select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("concept_id"))
    c = concepts.select("concept_id").join(has(pool, "p"), "concept_id", "left").join(has(ends, "e"), "concept_id", "left").join(has(items, "i"), "concept_id", "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(v)) for k, v in (("p", "pool"), ("e", "edges"), ("i", "items"))]))
    return c.select("concept_id", lacks.alias("lacks")).where(F.size("lacks") > 0)


# Why an item isn't made; {} stands for a number or names.
REASONS = {
    "alike": "indistinguible de la respuesta correcta (similitud {})",
    "few": "solo quedaron {} distractores utilizables",
    "claimed": "su única forma aceptada la reclama otro concepto ({})",
    "bodiless": "sin una forma aceptada con cuerpo suficiente para pedir evocación",
    "none": "sin distractores utilizables",
    "told": "el caso no admite predicción (prediction_enabled falso)",
}


def _reason(name: str, value: Column | None = None) -> Column:
    text = REASONS[name]
    return F.lit(text) if value is None else F.concat(*[x for k, part in enumerate(text.split("{}")) for x in ([value] if k else []) + [F.lit(part)]])


def _rejected(rows: DataFrame, mechanic: str, source: str, reason: Column, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(mechanic).alias("mechanic_id"), F.col(source).alias("source_id"), (none if detail is None else detail).alias("detail"), reason.alias("reason"))


def choice_rejections(pool: DataFrame, limits: DataFrame, most: float = 0.72, least: int = 2) -> DataFrame:
    """A1: distractors that can't be told from the answer, of those looked at until a concept had enough (the most plausible first),
    and concepts with a pool that were left with fewer than `least`.

    pool: concept_id, distractor_id, plausibility, similarity (to the right answer); limits: concept_id, n_options."""
    w = Window.partitionBy("concept_id").orderBy(F.desc("plausibility"), "distractor_id")
    safe = (F.col("similarity") < most).cast("int")
    seen = pool.join(limits, "concept_id", "left").withColumn("wanted", F.coalesce("n_options", F.lit(4)) - 1)
    seen = seen.withColumn("before", F.coalesce(F.sum(safe).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    alike = seen.where((F.col("before") < F.col("wanted")) & (F.col("similarity") >= most))
    few = seen.groupBy("concept_id").agg(F.least(F.sum(safe), F.first("wanted")).alias("n")).where(F.col("n") < least)
    said = F.format_string("%.2f", "similarity")
    return _rejected(alike, "A1", "concept_id", _reason("alike", said), F.col("distractor_id")).unionByName(_rejected(few, "A1", "concept_id", _reason("few", F.col("n").cast("string"))))


def form_rejections(forms: DataFrame) -> DataFrame:
    """A3: concepts without an accepted form, and whether others claim the ones they have (two are named). forms: accepted_forms."""
    lost = F.size("ambiguous") > 0
    reason = F.when(lost, _reason("claimed", F.array_join(F.slice("ambiguous", 1, 2), ", "))).otherwise(_reason("bodiless"))
    return _rejected(forms.where(F.size("accepted") == 0), "A3", "concept_id", reason)


def case_rejections(cases: DataFrame, spread: DataFrame) -> DataFrame:
    """B2: cases with a known main concept and a resolution but no distractors; E1: cases that already tell what happens.

    cases: case_id, primary_concept_id, resolucion_esperada, prediction_enabled; spread: case_id of those that got distractors."""
    gold = cases.where(F.trim(F.coalesce("resolucion_esperada", F.lit(""))) != "")
    without = cases.where("primary_concept_id is not null").join(spread.select("case_id").distinct(), "case_id", "left_anti")
    told = gold.where(~F.coalesce("prediction_enabled", F.lit(False)))
    return _rejected(without, "B2", "case_id", _reason("none")).unionByName(_rejected(told, "E1", "case_id", _reason("told")))


def several_types(edges: DataFrame) -> DataFrame:
    """One row, n: edges between concepts that edges of several types join."""
    pair = [F.least("from_concept_id", "to_concept_id").alias("a"), F.greatest("from_concept_id", "to_concept_id").alias("b")]
    by = edges.select(*pair, "relation_type").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation_type").alias("types"))
    return by.where("types > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def explanation_sources(pool: DataFrame) -> DataFrame:
    """One row: distractors with an explanation of their own, and with one derived from the graph. pool: explanation, derived."""
    filled = F.length(F.coalesce("explanation", F.lit(""))) > 0
    derived = F.coalesce("derived", F.lit(False))
    return pool.agg(F.count_if(filled & ~derived).alias("own"), F.count_if(derived).alias("derived"))


def bundle_stats(concepts: DataFrame, edges: DataFrame, items: DataFrame, verdicts: DataFrame, pool: DataFrame, rejected: DataFrame, units: DataFrame) -> DataFrame:
    """name, n: the counts of a bundle, items a mechanic among them (items:A1 and so on).

    edges: confidence; items: mechanic_id; verdicts: mechanic_id, available, playable; units: one row a unit."""
    one, trust = F.count(F.lit(1)), F.coalesce(F.col("confidence"), F.lit(0.6))
    wide = [
        concepts.agg(one.alias("concepts")), edges.agg(one.alias("edges"), F.count_if(trust >= 0.6).alias("asserted"), F.count_if(trust < 0.6).alias("inferred")), items.agg(one.alias("items")),
        verdicts.agg(one.alias("mechanics"), F.count_if("available").alias("mechanics_available"), F.count_if("playable").alias("mechanics_playable")),
        pool.agg(one.alias("distractors")), rejected.agg(one.alias("rejected")), units.agg(one.alias("units")),
    ]
    rows = [x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in x.columns])).alias("r")).select("r.*") for x in wide]
    rows.append(items.groupBy(F.concat(F.lit("items:"), "mechanic_id").alias("name")).agg(one.alias("n")))
    return reduce(DataFrame.unionByName, rows)


def no_links(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pairs that a text keeps apart, whose ends are both known. pairs: a, b and more."""
    known = lambda c: concepts.select(F.col("concept_id").alias(c)).distinct()
    return pairs.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi")


def meta_lists(concepts: DataFrame, levels: tuple[str, ...] = ("basico", "intermedio", "avanzado")) -> DataFrame:
    """doc_id, its gateway and threshold concepts in order, and how many concepts each known difficulty has (n_ columns; a null
    difficulty counts as the second level). concepts: doc_id, seq, concept_id, is_gateway, is_threshold, difficulty."""
    in_order = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("seq", "concept_id")))), lambda x: x["concept_id"])
    level = F.coalesce("difficulty", F.lit(levels[1]))
    return concepts.groupBy("doc_id").agg(in_order("is_gateway").alias("gateways"), in_order("is_threshold").alias("thresholds"), *[F.count_if(level == x).alias(f"n_{x}") for x in levels])
