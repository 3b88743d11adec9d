"""Merged lists and united near-duplicates against brute force and goldens worked out by hand."""

import random

import pytest

from quillstone.operators import merge as M
from quillstone.operators import similar as Z

GROUPS = [(1, "a", "a"), (1, "b", "b"), (2, "a", "a__2"), (2, "x", "b"), (2, "y", "y")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ids_are_followed_through_arrays_and_structs_in_one_pass(spark):
    rows = frame(spark, [(2, "x", ["y", "q", "a", None], [["x"], [], ["q", "b"], None], [("a", 1), ("q", 2)]), (3, "a", None, None, None)], "doc_id int, one string, many array<string>, nested array<array<string>>, inside array<struct<ref:string,k:int>>")
    groups = frame(spark, GROUPS, "doc_id int, id string, canonical string")
    refs = {"one": True, "many": True, "nested": True, "inside.ref": False}
    foreign = M.referenced(rows, list(refs))
    assert {tuple(r) for r in foreign.collect()} == {(2, "x"), (2, "y"), (2, "q"), (2, "a"), (2, "b"), (3, "a")}
    out = {r["doc_id"]: r.asDict(recursive=True) for r in M.remapped(rows, refs, M.id_maps(groups, foreign)).collect()}
    assert out[2] == {"doc_id": 2, "one": "b", "many": ["y", "a__2"], "nested": [["b"], [], ["b"], None], "inside": [{"ref": "a__2", "k": 1}, {"ref": "q", "k": 2}]}
    assert out[3] == {"doc_id": 3, "one": "a", "many": None, "nested": None, "inside": None}


def test_a_row_carries_the_ids_it_refers_to_and_no_others(spark):
    groups = spark.range(2000).selectExpr("1 as doc_id", "concat('c', id) as id", "concat('m', id) as canonical")
    maps = M.id_maps(groups)
    assert maps.groupBy("doc_id", "id").count().where("count > 1").count() == 0 and maps.count() == 2000
    rows = frame(spark, [(1, ["c7", "c3", "c7"]), (1, ["c3", "c7"]), (1, []), (None, ["c3"])], "doc_id int, ids array<string>")
    out = [r["ids"] for r in M.remapped(rows, {"ids": True}, maps).collect()]
    assert sorted(out) == [[], [], ["m3", "m7"], ["m7", "m3", "m7"]]


def test_all_lists_of_two_documents(spark):
    groups = frame(spark, GROUPS, "doc_id int, id string, canonical string")
    lists = {
        "relations": frame(spark, [(1, "a", "b", 1), (2, "x", "a", 2), (2, "x", "b", 3), (2, "x", "q", 4)], "doc_id int, from_concept_id string, to_concept_id string, seq int"),
        "repertoires": frame(spark, [(2, "r", "x", "q"), (2, "s", "q", "x"), (1, "r", "a", None)], "doc_id int, id string, concept_id string, concepto_confundido string"),
        "cases": frame(spark, [(2, "k", ["q", "y", "x"], None), (2, "l", ["q"], "x"), (1, "k", ["b"], "a")], "doc_id int, id string, concept_ids array<string>, primary_concept_id string"),
        "scenarios": frame(spark, [(2, "s", "k", ["q"])], "doc_id int, id string, parent_case_id string, concept_ids array<string>"),
        "theses": frame(spark, [(2, "t", ["x", "q"], None), (1, "t", ["a"], "f")], "doc_id int, id string, concept_ids array<string>, framework_id string"),
        "frameworks": frame(spark, [(2, "f", ["g", "h"], ["q", "x"])], "doc_id int, id string, rivales array<string>, concept_ids array<string>"),
        "concepts": frame(spark, [(2, "x", [("a", "d")])], "doc_id int, id string, distinctions array<struct<from_concept:string,difference:string>>"),
    }
    out = {k: sorted(tuple(r.asDict(recursive=True).values()) for r in rows.collect()) for k, rows in M.rewritten_lists(lists, groups).items()}
    assert out["relations"] == [(1, "a", "b", 1), (2, "b", "a__2", 2)]
    assert out["repertoires"] == [(1, "r__1", "a", None), (2, "r__2", "b", "q")]
    assert out["cases"] == [(1, "k__1", ["b"], "a"), (2, "k__2", ["y", "b"], "y")]
    assert out["scenarios"] == [(2, "s__2", "k__2", [])]
    assert out["theses"] == [(1, "t__1", ["a"], "f__1"), (2, "t__2", ["b"], None)]
    assert out["frameworks"] == [(2, "f__2", ["g__2", "h__2"], ["q", "b"])]
    assert out["concepts"] == [(2, "x", [{"from_concept": "a__2", "difference": "d"}])]
    report = {r["doc_id"]: r.asDict() for r in M.fusion_report(lists, groups).collect()}
    assert report[2]["n_concepts"] == 3 and report[2]["n_joined"] == 2 and report[2]["n_cases"] == 2 and report[1]["n_scenarios"] == 0


def test_fusions_and_refusals(spark):
    c = frame(spark, [("1:1", "Perceived Index (PCI)", "how people see the index of things"), ("2:1", "Perceived Index", "x"), ("2:2", "Peripheral Component (PCI)", "a slot for cards in a computer case"), ("3:1", "Alone", "y")], "uid string, title string, definition string")
    found = M.matched(c)
    rows = {(r["kind"], r["rank"], r["uid"]) for r in M.fusions(c, found, M.kept_apart(c)).collect()}
    assert rows == {("fusionada", 1, "2:1"), ("rechazada", 1, "2:2")}


def brute_united(rows, threshold, most):
    """rows of one group: id, seq, score, text, lists."""
    from quillstone.functions.text import STOP_WORDS

    def norm(t):
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split() if w not in STOP_WORDS]
        return " ".join(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words)

    kept = []
    for id_, _, _, text, lists in sorted(rows, key=lambda r: (-r[2], r[1])):
        own = norm(text)
        tokens = {w for w in own.split() if len(w) >= 4}
        into = next((k for k in kept if own and k["norm"] == own), None)
        if into is None and len(tokens) >= 4:
            into = next((k for k in kept if len(k["tokens"]) >= 4 and len(tokens & k["tokens"]) / len(tokens | k["tokens"]) >= threshold), None)
        if into is None:
            kept.append({"id": id_, "norm": own, "tokens": tokens, "lists": [list(x) for x in lists], "aliases": []})
            continue
        into["aliases"].append(id_)
        into["tokens"] = into["tokens"] | tokens
        for mine, more in zip(into["lists"], lists):
            seen = {norm(v) for v in mine}
            for v in more:
                if norm(v) not in seen:
                    mine.append(v)
                    seen.add(norm(v))
    to = {a: k["id"] for k in kept for a in k["aliases"]}
    for k in kept if to else ():
        k["lists"] = [[v for v in dict.fromkeys(to.get(v, v) for v in mine) if v != k["id"]] for mine in k["lists"]]
    return [(k["id"], n + 1, k["aliases"], *k["lists"]) for n, k in enumerate(kept[:most])], [(i, k["id"]) for k in kept for i in (k["id"], *k["aliases"])]


@pytest.mark.parametrize("seed", range(3))
def test_united_near_duplicates(spark, seed):
    rng = random.Random(seed)
    words = ["memory", "working", "Loads", "theory", "of", "limits", "span", "the", "attention", "cat", "recall", "stores"]
    data = {}
    for doc in range(8):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(9)]
        ids = [f"t{k}" for k in range(rng.randint(1, 14))]
        data[doc] = [(i, k, rng.randint(0, 2), rng.choice(texts), ([rng.choice(ids + ["z"]) for _ in range(rng.randint(0, 4))], [rng.choice(words) for _ in range(rng.randint(0, 4))])) for k, i in enumerate(ids)]
    rows = spark.createDataFrame([(d, *r[:4], *r[4]) for d, own in data.items() for r in own], "doc_id int, id string, seq int, score int, text string, rivals array<string>, args array<string>")
    absorbed = Z.near_duplicate_texts(rows.select("doc_id", "id", "seq", "score", "text"), "doc_id", 0.6)
    got = sorted((r["doc_id"], r["id"], r["kept_id"]) for r in absorbed.collect())
    want = {d: brute_united(own, 0.6, 5) for d, own in data.items()}
    assert got == sorted((d, *pair) for d, (_, pairs) in want.items() for pair in pairs)
    out = sorted((r["doc_id"], r["place"], r["id"], r["aliases"], r["rivals"], r["args"]) for r in Z.united(rows, absorbed, "doc_id", ["rivals", "args"], 5).collect())
    assert out == sorted((d, k[1], k[0], *k[2:]) for d, (kept, _) in want.items() for k in kept)
    assert sum(len(o[3]) for o in out) > 5


def test_an_absorbed_text_is_no_example_for_equals(spark):
    """Its equal is measured against the grown signature like any other text."""
    data = [("a", 0, 3, "alpha beta gamma delta"), ("b", 1, 2, "alpha beta gamma delta epsilon zeta"), ("c", 2, 1, "alpha beta gamma delta epsilon zeta"), ("d", 3, 0, ""), ("e", 4, 0, "")]
    rows = spark.createDataFrame([(1, *r) for r in data], "doc_id int, id string, seq int, score int, text string")
    assert {r["id"]: r["kept_id"] for r in Z.near_duplicate_texts(rows, "doc_id").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
