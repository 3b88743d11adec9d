"""Signals of answered sessions on a stream: state holds what later steps need, and expires."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.answered import IDLE_S, own_signals, reflected, signal

#: What the state tells of a step: a closed bet, or the hardest concept at a reflection.
FOUND = "session_id long, seq long, kind string, said string, about string, bet double, real double, worst string"
_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
_READ = "session_id seq at kind concept_id item_id correct declared said".split()


#: State of a session in one value: open bets by item, the last result by item, and how often each concept was asked by which item since when.
KEPT = (
    "at double, bet_items array<string>, bets array<double>, abouts array<string>, items array<string>, rights array<boolean>, "
    "asked_concepts array<string>, asked_items array<string>, asked_n array<long>, asked_since array<long>"
)


class SessionState(StatefulProcessor):
    """A group is a bucket of sessions, so that a call of Python serves many; the state of each is read once and written once a
    batch, whatever the number of its steps. A bucket has one timer in event time, for the session that is due first: it drops
    those that have been idle for longer than idle_s; so does a session's next event after such a pause."""

    def __init__(self, idle_s: int):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "session_id long", KEPT)

    def _due(self, last: float) -> int:
        return int((last + self.idle_s) * 1000) + 1

    def _timed(self, due: int) -> None:
        """One timer for the bucket, no later than due."""
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > due:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def _hardest(self, results: dict, asked: dict) -> str | None:
        share: dict[str, list] = {}
        for (concept, item), (n, since) in asked.items():
            s = share.setdefault(concept, [0, 0, since])
            s[0] += n * results[item]
            s[1] += n
            s[2] = min(s[2], since)
        return min(share, key=lambda c: (share[c][0] / share[c][1], share[c][2])) if share else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = [r for own in rows for r in zip(*[own[c].tolist() for c in _READ])]
        steps.sort(key=lambda r: r[:2])
        out, first = [], None
        for session, own in groupby(steps, key=lambda r: r[0]):
            last = self._answered(session, own, out)
            first = last if first is None else min(first, last)
        self._timed(self._due(first))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _answered(self, session: int, steps, out: list) -> float:
        """Takes the steps of one session, adds what they tell to out, and gives the time of the last."""
        before = self.kept.getValue((session,))
        bets, results, asked, last = {}, {}, {}, None
        if before is not None:
            last, bet_items, values, abouts, items, rights, concepts, of, ns, sinces = before
            bets = dict(zip(bet_items, zip(values, abouts)))
            results = dict(zip(items, rights))
            asked = dict(zip(zip(concepts, of), zip(ns, sinces)))
        for _, seq, at, kind, concept, item, correct, declared, said in steps:
            if last is not None and at - last > self.idle_s:
                bets, results, asked = {}, {}, {}
            last = at
            if kind == "calibracion":
                bets[item] = (0.5 if pd.isna(declared) or declared == 0 else float(declared), concept)
            elif kind == "reflexion":
                out.append((session, seq, kind, said, None, None, None, self._hardest(results, asked)))
            elif kind == "ejercicio":
                right = bool(correct) if not pd.isna(correct) else False
                if item in bets:
                    bet, about = bets.pop(item)
                    out.append((session, seq, kind, None, about, bet, float(right), None))
                results[item] = right
                n, since = asked.get((concept, item), (0, seq))
                asked[concept, item] = (n + 1, since)
        self.kept.updateValue((session,), (
            last, list(bets), [b for b, _ in bets.values()], [a for _, a in bets.values()], list(results), list(results.values()),
            [c for c, _ in asked], [i for _, i in asked], [n for n, _ in asked.values()], [s for _, s in asked.values()],
        ))
        return last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        for (session,), value in list(self.kept.iterator()):
            due = self._due(value[0])
            if due <= now:
                self.kept.removeKey((session,))
            else:
                first = due if first is None else min(first, due)
        if first is not None:
            self._timed(first)
        yield pd.DataFrame([], columns=_COLUMNS)


def answered_stream(log: DataFrame, idle_s: int = IDLE_S, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """quillstone.operators.answered.answered on a stream whose events come in order within a session; later ones than the
    watermark are left out. Signals of a step alone need no state and don't wait for it. Sessions are dealt to so many buckets."""
    log = log.withWatermark("ts", late)
    own = log.select("session_id", "seq", F.explode(own_signals(F.col("options"))).alias("s"))
    needed = log.select("session_id", "seq", "ts", F.col("ts").cast("double").alias("at"), "kind", "concept_id", F.col("item_id").cast("string").alias("item_id"), "correct", "declared", "said", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"))
    found = needed.groupBy("bucket").transformWithStateInPandas(SessionState(idle_s), FOUND, "append", "eventTime")
    closed = signal(dimension=F.lit("calibracion"), forma=F.lit("calibracion"), target=F.lit("concepto"), targets=F.array("about"), declared=F.col("bet"), real=F.col("real"), error=F.round(F.abs(F.col("bet") - F.col("real")), 3))
    each = F.when(F.col("kind") == "ejercicio", F.array(closed)).otherwise(reflected(F.col("said"), F.col("worst")))
    return own.unionByName(found.select("session_id", "seq", F.explode(each).alias("s"))).select("session_id", "seq", "s.*")
