"""Answered sessions: the signals of every step of a log, those of a step alone and those that depend on steps before.

A log is the events of sessions in order. Exposition gives nothing; a bet is kept until the exercise on its item, which
closes it; planning compares the choice with the concepts of least evidence; reflection compares what was hardest with
the results so far, by the last result of each item; an exercise gives the signals of its grade. A session without an
event for longer than `idle` begins anew: its open bets and results are gone. quillstone.streaming.answered does the
same on a stream.

Edge cases: a bet without a number, or 0, is 0.5; a reflection without an answer is like `_ninguno`; without results, or with
`_ninguno`, a reflection gives one neutral signal; of concepts with equal shares the one that came first is the hardest; a
choice that isn't among the options counts as 1; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.grading import signals

IDLE_S = 30 * 86_400
NONE = "_ninguno"
#: A signal: what it is about, what it says, and of bets the declared, real and missed part.
SIGNAL = "dimension string, forma string, target string, targets array<string>, delta double, latency long, declared double, real double, error double"
_FIELDS = [c.split()[0] for c in SIGNAL.split(", ")]


def signal(**given: Column) -> Column:
    """A signal with nulls for what isn't given."""
    kinds = dict(c.split() for c in SIGNAL.split(", "))
    return F.struct(*[given.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in _FIELDS])


def own_signals(options: Column) -> Column:
    """The signals of a step that need no other step: array of signals. Columns of a log; options: array of struct(id, score)."""
    c = F.col
    graded = F.transform(
        signals(c("mechanic_id"), c("concept_id"), c("pair"), c("correct"), c("partial"), c("repertoire"), c("confused"), c("hints"), c("duration")),
        lambda s: signal(**{f: s[f] for f in _FIELDS[:6]}),
    )
    least = F.coalesce(F.array_min(F.transform(options, lambda o: o["score"])), F.lit(0.0))
    mine = F.coalesce(F.try_element_at(F.filter(options, lambda o: o["id"] == c("said")), F.lit(-1))["score"], F.lit(1.0))
    planned = signal(dimension=F.lit("srl_planeacion"), forma=F.lit("escalar"), target=F.lit("sesion"), targets=F.array(c("said")), delta=F.when(mine <= least + 0.05, 0.15).otherwise(-0.05))
    none = F.array().cast(f"array<struct<{SIGNAL.replace(' ', ':').replace(',:', ',')}>>")
    return F.when(c("kind") == "ejercicio", graded).when(c("kind") == "planeacion", F.array(planned)).otherwise(none)


def declared(bet: Column) -> Column:
    return F.coalesce(F.nullif(bet, F.lit(0.0)), F.lit(0.5))


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def epochs(log: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """log with epoch: how often its session has begun anew before."""
    w = Window.partitionBy("session_id").orderBy("seq")
    paused = _seconds(F.col("ts")) - _seconds(F.lag("ts").over(w)) > idle_s
    return log.withColumn("paused", F.coalesce(paused, F.lit(False)).cast("int")).withColumn("epoch", F.sum("paused").over(w)).drop("paused")


def closed_bets(log: DataFrame) -> DataFrame:
    """session_id, seq and the signal of every exercise whose item was bet on last. log: with epoch."""
    w = Window.partitionBy("session_id", "epoch", "item_id").orderBy("seq")
    rows = log.where(F.col("kind").isin("calibracion", "ejercicio"))
    rows = rows.withColumns({"before": F.lag("kind").over(w), "bet": declared(F.lag("declared").over(w)), "about": F.lag("concept_id").over(w)})
    real = F.coalesce(F.col("correct"), F.lit(False)).cast("double")
    closed = signal(dimension=F.lit("calibracion"), forma=F.lit("calibracion"), target=F.lit("concepto"), targets=F.array("about"), declared=F.col("bet"), real=real, error=F.round(F.abs(F.col("bet") - real), 3))
    return rows.where("kind = 'ejercicio' and before = 'calibracion'").select("session_id", "seq", closed.alias("s"))


def hardest(log: DataFrame) -> DataFrame:
    """session_id, seq and worst (null without results) of every reflection. log: with epoch."""
    asked = log.where("kind = 'reflexion'").select("session_id", "epoch", F.col("seq").alias("asked"))
    done = log.where("kind = 'ejercicio'").select("session_id", "epoch", "seq", "concept_id", "item_id", F.coalesce("correct", F.lit(False)).alias("correct"))
    before = done.join(asked, ["session_id", "epoch"]).where("seq < asked")
    by_item = before.groupBy("session_id", "asked", "item_id").agg(F.max_by("correct", "seq").cast("int").alias("right"))
    each = before.groupBy("session_id", "asked", "item_id", "concept_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("since"))
    shares = each.join(by_item, ["session_id", "asked", "item_id"]).groupBy("session_id", "asked", "concept_id").agg((F.sum(F.col("n") * F.col("right")) / F.sum("n")).alias("share"), F.min("since").alias("since"))
    worst = shares.groupBy("session_id", "asked").agg(F.min_by("concept_id", F.struct("share", "since")).alias("worst"))
    return asked.join(worst, ["session_id", "asked"], "left").select("session_id", F.col("asked").alias("seq"), "worst")


def reflected(said: Column, worst: Column) -> Column:
    """The signals of a reflection: array."""
    one = lambda **k: signal(target=F.lit("sesion"), **{n: F.lit(v) if isinstance(v, str) else v for n, v in k.items()})
    neutral = one(dimension="srl_autorreflexion", forma="escalar", targets=F.array().cast("array<string>"), delta=F.lit(0.0))
    hit = said == worst
    real = hit.cast("double")
    both = F.array(
        one(dimension="srl_autorreflexion", forma="escalar", targets=F.array(said), delta=F.when(hit, 0.15).otherwise(-0.05)),
        one(dimension="calibracion", forma="calibracion", targets=F.array(said), declared=F.lit(1.0), real=real, error=1.0 - real),
    )
    return F.when(said.isNull() | (said == NONE) | worst.isNull(), F.array(neutral)).otherwise(both)


def answered(log: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """session_id, seq and the columns of SIGNAL: all signals of all steps.

    log: session_id, seq, ts, kind (exposicion, calibracion, planeacion, reflexion, ejercicio), concept_id, item_id, mechanic_id, pair,
    correct, partial, repertoire, confused, hints, duration, declared, said, options."""
    own = log.select("session_id", "seq", F.explode(own_signals(F.col("options"))).alias("s"))
    log = epochs(log, idle_s)
    last = hardest(log).join(log.where("kind = 'reflexion'").select("session_id", "seq", "said"), ["session_id", "seq"])
    last = last.select("session_id", "seq", F.explode(reflected(F.col("said"), F.col("worst"))).alias("s"))
    return own.unionByName(closed_bets(log)).unionByName(last).select("session_id", "seq", "s.*")
