"""Structured Streaming over the event log: profiles, windows and bets.

State is keyed, so it spreads over executors; windows and bets expire by watermark or timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.profile import DEFAULT_WEIGHT, rounded
from quillstone.sources.shared import shared_dir


def running_profile(signals: DataFrame) -> DataFrame:
    """Sums that make up the weighted profile, of scalar signals so far; finish() turns them into scores."""
    w = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(DEFAULT_WEIGHT))
    scalar = signals.where((F.col("forma") == "escalar") & F.col("concept_id").isNotNull() & F.col("delta").isNotNull()).withColumn("w", w)
    return scalar.groupBy("student_id", "concept_id", "dimension").agg(F.sum(F.col("delta") * F.col("w")).alias("dw"), F.sum("w").alias("ws"), F.count(F.lit(1)).alias("n"))


def finish(sums: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 2.5 * F.col("dw") / F.col("ws")))
    return sums.select("student_id", "concept_id", "dimension", rounded(score, 3).alias("score"), rounded(F.col("ws"), 2).alias("evidence"), "n")


def daily_counts(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """Signals of each day and dimension; later ones than the watermark are left out."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "dimension").agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").alias("day"), "dimension", "n")


def study_sessions(signals: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each student, ended by a gap without signals."""
    s = F.session_window("ts", gap)
    return signals.withWatermark("ts", late).groupBy("student_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("student_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def bet_gaps(events: DataFrame, timeout_ms: int = 86_400_000) -> DataFrame:
    """The gap of every bet and the next result of the same student and item; state holds open bets.

    events: student_id, item_id, event_id, kind, value. An open bet expires where its student and item have no event for
    longer than the timeout. A call of Python holds a student, not an item: open bets, whose items' last time is beside them,
    are the only state."""

    def match(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, kept = state.getCurrentProcessingTimeMs(), zip(*state.get) if state.exists else ()
        open_bets: dict = {}
        for item, i, bet, at in kept:
            if at + timeout_ms > now:
                open_bets.setdefault(item, []).append((i, bet, at))
        out = []
        if not state.hasTimedOut:
            rows = [r for own in batches for r in zip(*[own[c].tolist() for c in ("event_id", "item_id", "kind", "value")])]
            rows.sort(key=lambda r: r[0])
            for event, item, kind, value in rows:
                if kind == "bet":
                    open_bets.setdefault(item, []).append((event, value, now))
                else:
                    out += [(key[0], item, i, round(abs((d or 0.5) - value), 3)) for i, d, _ in open_bets.pop(item, ())]
            seen = {r[1] for r in rows}
            open_bets = {item: [(i, d, now) for i, d, _ in bets] if item in seen else bets for item, bets in open_bets.items()}
        still = [(item, *bet) for item, bets in open_bets.items() for bet in bets]
        if still:
            state.update(tuple(list(c) for c in zip(*still)))
            state.setTimeoutDuration(max(1, min(at for *_, at in still) + timeout_ms - now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["student_id", "item_id", "event_id", "error"])

    kept = "items array<string>, bets array<long>, said array<double>, at array<long>"
    return events.groupBy("student_id").applyInPandasWithState(match, "student_id long, item_id string, event_id long, error double", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


#: What operators with map state and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained(stream: DataFrame, mode: str, what: str, expires: bool = False, state: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote last (complete) or in all (append).

    expires: the stream has timeouts by processing time. Such a stream asks for batches without
    data for ever, so it is drained without them; otherwise they close windows by the watermark.
    state: `rocksdb` where the stream's state needs that store.
    """
    spark: SparkSession = stream.sparkSession
    home = shared_dir(spark, what)
    wanted = ({NO_DATA: "false"} if expires else {}) | (ROCKSDB if state == "rocksdb" else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, x in wanted.items():
        spark.conf.set(k, x)
    try:
        query = _started(stream, mode, home)  # the query has its own copy of the settings from here on
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def _started(stream: DataFrame, mode: str, home: str) -> StreamingQuery:
    if mode == "append":
        return stream.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    keep = lambda df, k: df.write.mode("overwrite").parquet(f"{home}/out")
    return stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
