"""Coverage aggregates: what a document's material can teach and measure.

Everything starts from one row of counts a document, so the many indicators cost one scan and
one small shuffle of each entity table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.mechanics import PLAYABLE, emits, requirements
from quillstone.functions.text import capped_ratio


def counts(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row of named counts. tables: name -> (frame, {count name: condition})."""
    rows = [df.agg(*[F.count_if(c).alias(k) for k, c in cols.items()]) for df, cols in tables.values()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)


def tall(row: DataFrame, cols: list[str], key: str, value: str) -> DataFrame:
    """One row per column of a single row."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(f"`{c}`").alias(value)) for c in cols])).alias("x")).select("x.*")


def densities(n: DataFrame) -> DataFrame:
    """Five densities between 0 and 1, as (name, value)."""
    one = F.greatest("concepts", F.lit(1))
    made = {
        "relations": capped_ratio(F.col("relations"), one * 1.5),
        "theses": capped_ratio(F.col("theses"), one * 0.5),
        "cases": capped_ratio(F.col("cases") + F.col("scenarios"), one * 1.0),
        "repertoires": capped_ratio(F.col("repertoires"), one * 0.6),
        "enriched": capped_ratio(F.col("enriched"), one * 1.0),
    }
    return tall(n.select(*[F.round(c, 4).alias(k) for k, c in made.items()]), list(made), "name", "value")


def signal_coverage(n: DataFrame, sequence_level: str = "buena") -> DataFrame:
    """(dimension, coverage, bottleneck) of every dimension of the profile.

    n has concepts, relations, theses, frameworks, cases, scenarios, repertoires, gold_cases,
    contrasted, basic, synonyms, far and axes.
    """
    c = lambda k: F.col(k).cast("double")
    one = F.greatest(c("concepts"), F.lit(1.0))
    made = {
        "recuperacion": capped_ratio(c("concepts"), F.lit(8)),
        "relacion": capped_ratio(c("relations"), one * 1.5),
        "transferencia": 0.6 * capped_ratio(c("gold_cases"), one * 0.6) + 0.4 * capped_ratio(c("scenarios"), one * 0.8),
        "anclaje": capped_ratio(c("contrasted"), one * 0.5),
        "automatizacion": capped_ratio(c("basic"), one * 0.3) * (0.5 + 0.5 * capped_ratio(c("synonyms"), one)),
        **{k: F.lit(1.0) for k in ("calibracion", "srl_accion", "srl_autorreflexion", "persistencia", "engagement")},
        "srl_planeacion": F.lit({"buena": 1.0, "parcial": 0.5, "no_confiable": 0.15}.get(sequence_level, 1.0)),
        "articulacion": F.least(F.lit(1.0), 0.4 + 0.6 * capped_ratio(c("theses") + c("cases"), one * 0.8)),
    }
    rows = [F.struct(F.lit(k).alias("dimension"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2).alias("coverage"), (x < 0.6).alias("bottleneck")) for k, x in made.items()]
    far = capped_ratio(c("far"), F.greatest(F.lit(3.0), c("scenarios") * 0.3))
    rows.append(F.struct(F.lit("transferencia:lejana").alias("dimension"), F.round(far, 2).alias("coverage"), (c("far") < 3).alias("bottleneck")))
    no_axes = F.when(c("axes") == 0, F.struct(F.lit("relacion:espacio_atributos").alias("dimension"), F.lit(0.0).alias("coverage"), F.lit(True).alias("bottleneck")))
    no_frame = F.when(c("frameworks") == 0, F.struct(F.lit("relacion:argumento").alias("dimension"), F.round(F.least(F.lit(0.5), capped_ratio(c("theses"), one * 0.5)), 2).alias("coverage"), F.lit(True).alias("bottleneck")))
    return n.select(F.explode(F.array_compact(F.array(*rows, no_axes, no_frame))).alias("x")).select("x.*")


def family_availability(n: DataFrame) -> DataFrame:
    """(family, available, mechanics): which families of mechanics the counts allow."""
    c = F.col
    axes, frames = c("axes") > 0, c("frameworks") > 0
    ids = lambda s: F.array(*[F.lit(x) for x in s.split()])
    none = F.array().cast("array<string>")
    theses = F.when(frames, ids("F1 F4 F5 F2 F3")).otherwise(ids("F1 F4 F5"))
    rules = [
        ("A", c("concepts") >= 4, ids("A1 A2 A3 A4")),
        ("B", (c("repertoires") >= 2) | (c("distinct") >= 2), ids("B1 B2 B3")),
        ("C", c("relations") >= 5, F.when(axes, ids("C1 C2 C3 C5 C4")).otherwise(ids("C1 C2 C3 C5"))),
        ("D", (c("relations") >= 8) & (c("clusters") >= 1), ids("D1 D2 D3")),
        ("E", c("gold_cases") >= 3, ids("E1 E2 E3 E4 E5")),
        ("F", (c("theses") >= 2) | (c("concepts") >= 4), F.when(c("theses") >= 2, theses).otherwise(ids("F1 F4 F5"))),
        ("G", F.lit(True), ids("G1 G2 G3 G4 G5")),
        ("H", (c("theses") >= 1) | (c("relations") >= 5), ids("H1 H2 H3 H4 H5")),
        ("I", F.lit(True), ids("I1 I2 I3 I4 I5")),
    ]
    rows = [F.struct(F.lit(f).alias("family"), ok.alias("available"), F.when(ok, m).otherwise(none).alias("mechanics")) for f, ok, m in rules]
    return n.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def modalities(n: DataFrame) -> DataFrame:
    """One row: the recommended ways of working. n: threshold, opposed, theses, frameworks."""
    c = F.col
    ways = F.array_compact(F.array(F.lit("individual"), F.when(c("threshold") > 0, "colaborativo"), F.when(c("opposed") > 0, "debate"), F.when((c("theses") >= 2) & (c("frameworks") > 0), "argumentacion")))
    return n.select(ways.alias("modalities"))


def zero_filled(rows: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts of each value of a closed domain, 0 where it doesn't occur; other values don't count."""
    d = rows.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return d.join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def verdicts(inventory: DataFrame, with_items: list[str], judge: bool = True, peer: bool = False) -> DataFrame:
    """State of every mechanic against an inventory (key, n): what it lacks, and whether it can be played.

    A requirement without a row in the inventory counts 0; `ninguno` is always met.
    """
    have = {"juez": judge, "peer": peer, "ninguno": True}
    needs = requirements(inventory.sparkSession).join(F.broadcast(inventory), "key", "left")
    special = None
    for k, ok in have.items():
        special = F.when(F.col("key") == k, F.lit(ok)) if special is None else special.when(F.col("key") == k, F.lit(ok))
    met = special.otherwise(F.coalesce("n", F.lit(0)) >= F.col("least"))
    out = needs.withColumn("met", met).groupBy("mechanic_id").agg(
        F.bool_and("met").alias("available"),
        F.array_sort(F.collect_list(F.when(~F.col("met"), F.col("key")))).alias("missing"),
        F.bool_or(F.col("key") == "juez").alias("needs_judge"),
        F.bool_or(F.col("key") == "peer").alias("needs_peer"),
        F.bool_or(F.col("key") == "ninguno").alias("free"),
    )
    state = F.when(~F.col("available"), F.when(F.col("missing") == F.array(F.lit("peer")), "necesita_peer").otherwise("bloqueada")).when(F.col("needs_judge"), "necesita_juez").when(F.col("needs_peer"), "necesita_peer")
    state = state.when(F.col("free") | F.col("mechanic_id").isin(with_items), "lista").otherwise("sin_items")
    return out.select("mechanic_id", "available", "missing", state.alias("state"))


def readiness(states: DataFrame) -> DataFrame:
    """dimension, whether a playable mechanic measures it, and the mechanics that do or could."""
    e = emits(states.sparkSession).select("mechanic_id", "dimension").distinct().join(states, "mechanic_id")
    playable = (F.col("state") == "lista") & F.col("mechanic_id").isin(*PLAYABLE)
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("mechanic_id"))))
    out = e.groupBy("dimension").agg(pick(playable).alias("now"), pick(~playable & F.col("available")).alias("potential"), pick(~F.col("available")).alias("blocked"))
    return out.withColumn("measurable", F.size("now") > 0)


def layer_report(layers: DataFrame) -> DataFrame:
    """Latest status of each layer of a document. layers: doc_id, layer, seq, status, items."""
    return layers.groupBy("doc_id", "layer").agg(F.max_by(F.struct("status", "items"), "seq").alias("r")).select("doc_id", "layer", "r.status", "r.items")


def layer_progress(report: DataFrame, expected: int = 9) -> DataFrame:
    """Share of expected layers that ended, and the failed ones in order."""
    ended = F.col("status").isin("ok", "empty", "failed", "skipped")
    return report.groupBy("doc_id").agg(F.least(F.lit(1.0), F.round(F.count_if(ended) / expected, 2)).alias("progress"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("layer")))).alias("failed"))
