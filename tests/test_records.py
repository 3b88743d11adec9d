"""Whole records: verification with reasons, typed assembly, deletions, kept results, progress, acronyms among synonyms."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import grounding as G
from quillstone.operators import validate as V
from quillstone.operators.progress import Progress
from quillstone.operators.resolve import acronym_candidates
from quillstone.sources import store
from quillstone.sources.versions import Versions


def test_concepts_without_support_go_with_a_reason(spark):
    docs = spark.createDataFrame([(1, "Working memory holds little. The PCCI was measured in every single group of people.")], "doc_id long, text string")
    rows = [
        (1, "a", "Working memory", "memory holds little. The PCCI", 0.9), (1, "b", "Working memory", "", 0.9), (1, "c", "Working Memory", "a quote that nobody ever wrote down", None),
        (1, "d", "Perceived Index (PCCI)", None, 0.9), (1, "e", "Nothing", "also a quote that nobody ever wrote " + "x" * 200, 0.2), (2, "f", "No document", "", 0.5),
    ]
    c = spark.createDataFrame(rows, "doc_id long, concept_id string, title string, quote string, confidence double")
    found = G.verified_concepts(c, docs)
    out = {r["concept_id"]: (r["level"], r["confidence"], r["diagnosis"], r["reason"], r["stated"]) for r in found.collect()}
    assert out["a"] == ("verificado", 0.9, "presente", None, None) and out["b"] == ("parcial", 0.6, "presente", None, None) and out["c"][:2] == ("parcial", 0.6)
    assert out["d"] == ("sin_anclaje", 0.35, "sigla", G.INVENTED, "") and out["e"] == ("sin_anclaje", 0.2, "ausente", G.ABSENT, rows[4][3][:160])
    counts = {r["doc_id"]: r for r in G.verification_counts(found).collect()}
    assert set(counts) == {1} and tuple(counts[1])[1:] == (1, 2, 1, 2, 1, 2)


def test_a_record_comes_back_from_json(spark):
    root = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "doc_id long, title string")
    lists = {
        "concepts": spark.createDataFrame([(1, 2, "b", ["x"]), (1, 1, "a", None), (2, 1, "", ["y"]), (3, 1, "c", [])], "doc_id long, seq long, id string, tags array<string>"),
        "cases": spark.createDataFrame([(2, 1, {"k": 1})], "doc_id long, seq long, more map<string,int>"),
    }
    out = V.assembled(root, lists, {"root": {"title": F.col("title").isNotNull()}, "concepts": {"id": F.col("id") != ""}})
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["record"].asDict(recursive=True) == {"doc_id": 1, "title": "one", "concepts": [{"id": "a", "tags": None}, {"id": "b", "tags": ["x"]}], "cases": []}
    assert rows[2]["record"]["concepts"] == [] and rows[2]["record"]["cases"][0]["more"] == {"k": 1} and [tuple(x) for x in rows[2]["rejects"]] == [("concepts", 1, ["id"])]
    assert rows[3]["record"] is None and [tuple(x) for x in rows[3]["rejects"]] == [("root", None, ["title"])] and rows[1]["rejects"] == []
    again = out.select("doc_id", F.from_json(F.to_json("record"), out.schema["record"].dataType).alias("record")).where("record is not null")
    assert sorted(again.collect()) == sorted(out.select("doc_id", "record").where("record is not null").collect())
    assert json.loads(out.select(F.to_json("record").alias("j")).where("doc_id = 1").first()["j"])["concepts"][0] == {"id": "a"}


def test_deletion_follows_children_of_children(spark):
    tables = {"a": spark.createDataFrame([(1,), (2,)], "a long"), "b": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "b long, a long"), "c": spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "b long, v string")}
    parents = {"c": ("b", "b", "b"), "b": ("a", "a", "a")}
    left = store.delete_tree(tables, parents, "a", spark.createDataFrame([(1,)], "a long"))
    assert [r["v"] for r in left["c"].orderBy("v").collect()] == ["y", "z"] and left["b"].count() == 2 and left["a"].count() == 1
    with pytest.raises(ValueError):
        store.delete_tree(tables, parents | {"d": ("e", "x", "x")}, "a", spark.createDataFrame([(1,)], "a long"))


def test_results_are_reused_until_their_inputs_change(spark):
    made = []

    def build(rows):
        made.append(sorted({r["owner"] for r in rows.select("owner").collect()}))
        return rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))

    docs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "w")], "owner string, doc_id long, t string").where("owner is not null")
    kept = Versions(spark)
    first = sorted(map(tuple, kept.get(docs, build).collect()))
    assert made == [["a", "b"]] and [r[-1] for r in first] == [True, True]
    assert [r[:-1] for r in sorted(map(tuple, kept.get(docs, build).collect()))] == [r[:-1] for r in first] and len(made) == 1
    less = kept.get(docs.where("doc_id != 2"), build)  # a deletion
    assert made[1:] == [["a"]] and {(r["owner"], r["n"], r["built"]) for r in less.collect()} == {("a", 1, True), ("b", 1, False)}
    kept.get(docs.where("doc_id != 2").withColumn("t", F.upper("t")).where("owner = 'b'"), build)  # as many, other content
    assert made[2:] == [["b"]]
    again = Versions(spark, kept.home)  # another driver
    again.invalidate(spark.createDataFrame([("a",)], "owner string"))
    again.get(docs.where("doc_id = 1"), build)
    assert made[3:] == [["a"]]
    again.get(docs.where("doc_id = 1"), build, force=True)
    assert made[4:] == [["a"]]


def test_progress_counts_what_is_written_and_outlives_failures(spark):
    told = []

    def listener(x):
        told.append((x["last"]["layer"], x["last"]["status"], x["last"]["items"], x["fraction"]))
        raise RuntimeError("a listener that raises")

    run = Progress(["a", "b", "c", "d"], listener)
    out = run.run("a", lambda: spark.range(7))
    assert out.count() == 7 and run.run("b", lambda: out.where("id > 9")).count() == 0
    assert run.run("c", lambda: out.selectExpr("raise_error('x')")) is None
    assert told == [("a", "ok", 7, 0.25), ("b", "empty", 0, 0.5), ("c", "failed", 0, 0.75)] and run.failed == ["c"] and set(run.seconds) == {"a", "b", "c"}


def test_acronyms_among_synonyms(spark):
    rows = [("a", "Epistemic Vigilance Index (EVI)", None), ("b", "Índice de Vigilancia", ["EVI", "vigilancia"]), ("c", "evi", ["X"]), ("d", "Other", ["evi"]), ("e", "Raf", None), ("f", "Resonant Framework", [" RAF "]), ("g", "Two", ["42"]), ("h", "Three", ["42"])]
    c = spark.createDataFrame(rows, "concept_id string, title string, synonyms array<string>")
    assert {tuple(r["members"]) for r in acronym_candidates(c).collect()} == {("a", "b", "c"), ("e", "f")}
    assert {tuple(r["members"]) for r in acronym_candidates(c.drop("synonyms")).collect()} == {("a", "c")}
