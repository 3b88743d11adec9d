"""Signals of answered sessions in batch and on streams, and segments with pages and titles, against goldens worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.operators import answered as N
from quillstone.operators import segment as S

LOG = "session_id long, seq long, ts timestamp, kind string, concept_id string, item_id string, mechanic_id string, pair array<string>, correct boolean, partial double, repertoire string, confused string, hints int, duration int, declared double, said string, options array<struct<id:string,score:double>>"


def step(session, seq, kind, day=0, concept=None, item=None, mechanic=None, correct=None, partial=None, hints=0, duration=0, declared=None, said=None, options=None, repertoire=None):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=seq)
    return (session, seq, at, kind, concept, item, mechanic, [concept or "", "z"], correct, partial, repertoire, None, hints, duration, declared, said, options)


OPTIONS = [("a", 0.5), ("b", 0.2), ("c", 0.24)]
STEPS = [
    step(1, 0, "planeacion", said="c", options=OPTIONS),  # within 0.05 of the least
    step(1, 1, "exposicion", concept="a"),
    step(1, 2, "calibracion", concept="a", item="i", declared=0.9),
    step(1, 3, "calibracion", concept="b", item="j", declared=None),
    step(1, 4, "ejercicio", concept="a", item="i", mechanic="B1", correct=False, partial=0.0),
    step(1, 5, "ejercicio", concept="b", item="j", mechanic="A1", correct=True, partial=1.0, duration=700),
    step(1, 6, "ejercicio", concept="a", item="i", mechanic="A1", correct=True, partial=1.0, hints=1, duration=9),  # no open bet any more
    step(1, 7, "ejercicio", concept="b", item="k", mechanic="B2", correct=False, partial=0.25, repertoire="r"),
    step(1, 8, "reflexion", said="b"),  # a: its item right at last; b: one of two
    step(2, 0, "planeacion", said="q", options=OPTIONS),
    step(2, 1, "reflexion", said="a"),  # nothing answered
    step(3, 0, "calibracion", concept="a", item="i", declared=0.0),
    step(3, 1, "ejercicio", day=2, concept="a", item="i", mechanic="B1", correct=None),  # after the pause: no bet, no grade
    step(3, 2, "ejercicio", day=2, concept="d", item="n", mechanic="B1", correct=False, partial=0.0),
    step(3, 3, "reflexion", day=5, said="d"),  # after a pause
    step(3, 4, "reflexion", day=5, said="_ninguno"),
    step(4, 0, "planeacion", said=None, options=None),
]
#: session, seq, dimension, targets, delta, latency, declared, real, error
WANT = [
    (1, 0, "srl_planeacion", ["c"], 0.15, None, None, None, None),
    (1, 4, "recuperacion", ["a"], -0.2, None, None, None, None), (1, 4, "calibracion", ["a"], None, None, 0.9, 0.0, 0.9),
    (1, 5, "recuperacion", ["b"], 0.2, None, None, None, None), (1, 5, "automatizacion", ["b"], None, 700, None, None, None), (1, 5, "calibracion", ["b"], None, None, 0.5, 1.0, 0.5),
    (1, 6, "recuperacion", ["a"], 0.2, None, None, None, None), (1, 6, "srl_accion", [], None, None, None, None, None),
    (1, 7, "transferencia", ["b"], -0.1, None, None, None, None), (1, 7, "anclaje", ["r"], None, None, None, None, None),
    (1, 8, "srl_autorreflexion", ["b"], 0.15, None, None, None, None), (1, 8, "calibracion", ["b"], None, None, 1.0, 1.0, 0.0),
    (2, 0, "srl_planeacion", ["q"], -0.05, None, None, None, None), (2, 1, "srl_autorreflexion", [], 0.0, None, None, None, None),
    (3, 2, "recuperacion", ["d"], -0.2, None, None, None, None), (3, 3, "srl_autorreflexion", [], 0.0, None, None, None, None), (3, 4, "srl_autorreflexion", [], 0.0, None, None, None, None),
    (4, 0, "srl_planeacion", [None], -0.05, None, None, None, None),
]


def told(df):
    return sorted(((r["session_id"], r["seq"], r["dimension"], r["targets"], r["delta"], r["latency"], r["declared"], r["real"], r["error"]) for r in df.collect()), key=str)


def test_signals_of_a_log(spark):
    log = spark.createDataFrame(STEPS, LOG)
    assert told(N.answered(log, 86_400)) == sorted(WANT, key=str)
    assert N.answered(log.limit(0)).count() == 0


@pytest.mark.parametrize("files", [1, 6])
def test_signals_on_a_stream_of_batches(spark, tmp_path, files):
    from quillstone.streaming.answered import answered_stream
    from quillstone.streaming.profile import drained

    rows = sorted(STEPS, key=lambda r: r[2])
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    assert told(drained(answered_stream(source, 86_400), "append", "answered", state="rocksdb")) == sorted(WANT, key=str)


def test_segments_by_heading_and_size(spark):
    lines = [
        "Title", "one two", "three four five", "Head A", "alpha beta gamma delta", "more  words here", "Head B", "Head C", "end of it", "  ", "x" * 30, "Head D",
    ]
    rows = [(1, k, t, k // 3 + 1) for k, t in enumerate(lines)] + [(2, 0, None, 1), (2, 1, "Head only", 1)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, text string, page long")
    out = S.segmented(df, F.col("text").startswith("Head"), 35, 0).orderBy("doc_id", "seq")
    got = [(r["doc_id"], r["section_title"], r["text"], r["pages"], r["char_count"]) for r in out.collect()]
    assert got == [
        (1, "Introducción", "Title one two three four five", [1], 29),  # 27 characters of lines, ended by a heading
        (1, "Head A", "alpha beta gamma delta more words here", [2], 38),  # ended by its size
        (1, "Head A", "Head B", [2, 3], 6),  # text, as the cut before left none; its page comes along
        (1, "Head C", "end of it " + "x" * 30, [3, 4], 40),
        (1, "Head C", "Head D", [4], 6),
        (2, "Introducción", "Head only", [1], 9),
    ]
    assert S.segmented(df, F.col("text").startswith("Head"), 35, 30).count() == 2 and S.segmented(df.limit(0), F.lit(True)).count() == 0


def test_merged_segments_keep_texts_pages_and_first_title(spark):
    rows = [(1, 0, "a", "T0", "x" * 10, [3, 1], None), (1, 1, "a", "T1", "y" * 5, [2], None), (1, 2, "a", "T2", "z" * 6, None, 6), (1, 3, "b", None, "w", [5], None), (1, 4, None, "T4", None, [6], None), (1, 5, None, "T5", "v", [6], None), (1, 6, "b", "T6", "u" * 99, [9, 7], 99)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, kind string, section_title string, text string, pages array<int>, char_count long")
    out = [tuple(r) for r in S.merged(df, 20).orderBy("seq").collect()]
    assert out == [
        (1, 0, "T0", "a", "x" * 10 + "\n\n" + "y" * 5, [1, 2, 3], 17, 2),
        (1, 2, "T2", "a", "z" * 6, [], 6, 1),
        (1, 3, None, "b", "w", [5], 1, 1),
        (1, 4, "T4", None, "\n\nv", [6], 3, 2),
        (1, 6, "T6", "b", "u" * 99, [9, 7], 99, 1),
    ]
