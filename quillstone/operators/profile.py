"""Evidence weights and profiles derived from cognitive signals.

A profile is a pure aggregation over an append-only signal log: one shuffle on (student,
concept, dimension) with partial sums before it, whatever the number of signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base weight of a modality, and of a way of answering.
MODALITY_WEIGHTS = {"reconocimiento": 0.35, "produccion_guiada": 0.60, "accion_estructural": 0.70, "produccion_libre": 0.85}
VIA_WEIGHTS = {"decision_declarada": 1.0, "mixta": 0.5, "ejecucion_motora": 0.0}
DEFAULT_WEIGHT, CENTRE, GAIN, MIN_LATENCIES = 0.35, 0.5, 2.5, 5


def lookup(key: Column, values: dict, default) -> Column:
    """A value of a small fixed table, in generated code."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, half away from zero on the double itself; F.round goes by its decimal text, where a sum just
    below a half counts as one."""
    return F.round(x * 10**digits) / 10**digits


def evidence_weight(modality: Column, n_effective: Column, hints: Column, scaffolds: Column, via: Column | None = None) -> Column:
    """Base weight lowered by guessing (recognition only), hints, scaffolds and the way of answering."""
    guess = F.when(modality == "reconocimiento", 1 - 1 / F.greatest(n_effective, F.lit(1.01))).otherwise(F.lit(1.0))
    hinted = F.greatest(F.lit(0.40), 1 - F.lit(0.15) * F.greatest(F.lit(0), hints))
    held = F.greatest(F.lit(0.50), 1 - F.lit(0.10) * F.greatest(F.lit(0), scaffolds))
    out = lookup(modality, MODALITY_WEIGHTS, DEFAULT_WEIGHT) * guess * hinted * held
    return F.round(out * lookup(via, VIA_WEIGHTS, 1.0) if via is not None else out, 3)


def weighted_profile(signals: DataFrame) -> DataFrame:
    """Score, evidence and count of every student, concept and dimension from scalar signals.

    signals: student_id, concept_id, dimension, forma, delta, weight. A weight of 0 or null is
    the default weight; a null concept or delta gives no evidence.
    """
    w = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(DEFAULT_WEIGHT))
    scalar = signals.where((F.col("forma") == "escalar") & F.col("concept_id").isNotNull() & F.col("delta").isNotNull()).withColumn("w", w)
    sums = scalar.groupBy("student_id", "concept_id", "dimension").agg(F.sum(F.col("delta") * F.col("w")).alias("dw"), F.sum("w").alias("ws"), F.count(F.lit(1)).alias("n"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), CENTRE + GAIN * F.col("dw") / F.col("ws")))
    return sums.select("student_id", "concept_id", "dimension", rounded(score, 3).alias("score"), rounded(F.col("ws"), 2).alias("evidence"), "n")


def pivoted_profile(profile: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """One row per student and concept with a score column of each named dimension."""
    return profile.groupBy("student_id", "concept_id").pivot("dimension", list(dimensions)).agg(F.max("score"))


def latencies(signals: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean latency of temporal signals with 5 samples or more, for concepts with scalar evidence."""
    timed = signals.where((F.col("forma") == "temporal") & (F.col("latencia_ms") > 0)).groupBy("student_id", "concept_id").agg(F.sum(F.col("latencia_ms").cast("long")).alias("s"), F.count(F.lit(1)).alias("n_latency"))
    means = timed.where(F.col("n_latency") >= MIN_LATENCIES).select("student_id", "concept_id", F.expr("s div n_latency").alias("latency_ms"), "n_latency")
    return means.join(profile.select("student_id", "concept_id").distinct(), ["student_id", "concept_id"], "left_semi")


def active(signals: DataFrame, dimension: str, target: str) -> DataFrame:
    """How often each target of a student's observational signals was active."""
    return signals.where((F.col("dimension") == dimension) & (F.col("forma") == "observacional")).groupBy("student_id", target).agg(F.count(F.lit(1)).alias("n"))


def counters(signals: DataFrame) -> DataFrame:
    """Signals and help requests of each student."""
    return signals.groupBy("student_id").agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("dimension") == "srl_accion").alias("n_help"))


def calibration_error(closed: DataFrame) -> DataFrame:
    """Mean absolute gap of declared and real results of a student's closed bets, null without any.

    closed: student_id, declared, real (null while open). A declared 0 or null counts as 0.5.
    """
    declared = F.coalesce(F.nullif("declared", F.lit(0.0)), F.lit(0.5))
    # in whole thousandths, so that the order of addition doesn't matter
    gap = F.round(F.abs(declared - F.col("real")) * 1000).cast("long")
    sums = closed.groupBy("student_id").agg(F.sum(gap).alias("s"), F.count("real").alias("n_closed"))
    mean = F.when(F.col("n_closed") > 0, F.expr("(2 * s + n_closed) div (2 * n_closed)") / 1000)
    return sums.select("student_id", mean.alias("calibration_error"), "n_closed")


def bets_with_results(events: DataFrame) -> DataFrame:
    """Each bet with the next result of the same student and item: an as-of join by a window.

    events: student_id, item_id, ts, event_id, kind (`bet`, `result`), value.
    """
    later = Window.partitionBy("student_id", "item_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    real = F.first(F.when(F.col("kind") == "result", F.col("value")), ignorenulls=True).over(later)
    return events.withColumn("real", real).where(F.col("kind") == "bet").select("student_id", "item_id", "event_id", F.col("value").alias("declared"), "real")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def progress(profile: DataFrame, plan: DataFrame, dimension: str = "recuperacion") -> DataFrame:
    """Score of every planned concept of a student (plan: student_id, concept_id), 0 without evidence."""
    scores = profile.where(F.col("dimension") == dimension).select("student_id", "concept_id", "score")
    return plan.join(scores, ["student_id", "concept_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
