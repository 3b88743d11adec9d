"""Items and what is rejected: goldens worked out by hand, and brute force, of operators that SQL can't express."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillstone.operators import compiler as K
from quillstone.operators import similar as Z


def ids(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.collect())


POOL = [
    ("a", "d1", 0.9, "repertorio", "the cat sat on the mats"), ("a", "d2", 0.9, "distincion", "a dog ran"), ("a", "d3", 0.8, "vecino", "birds fly south"), ("a", "d4", 0.7, "vecino", "fish swim in water"),
    ("a", "d5", 0.6, "vecino", "ants"), ("a", "d6", 0.5, "vecino", "bees"), ("b", "d7", 0.9, "repertorio", "exactly this"), ("b", "d8", 0.4, "repertorio", "something else"),
]
CONCEPTS = [("a", "the cat sat on the mat"), ("b", "exactly this"), ("c", "no pool")]


@pytest.fixture(scope="module")
def frames(spark):
    pool = spark.createDataFrame(POOL, "concept_id string, distractor_id string, plausibility double, origin string, text string")
    return pool, spark.createDataFrame(CONCEPTS, "concept_id string, definition string")


def test_safe_distractors_and_choice_items(frames):
    pool, concepts = frames
    safe = Z.safe_distractors(pool, concepts)
    assert ids(safe, "concept_id", "distractor_id", "k") == [("a", "d2", 1), ("a", "d3", 2), ("a", "d4", 3), ("a", "d5", 4), ("b", "d8", 1)]
    items = {r["concept_id"]: r for r in Z.choice_items(safe, concepts).collect()}
    assert set(items) == {"a"} and sorted(o["text"] for o in items["a"]["options"] if o["correct"]) == ["the cat sat on the mat"]
    assert {o["id"] for o in items["a"]["options"] if not o["correct"]} == {"d2", "d3", "d4", "d5"} and items["a"]["item_id"].startswith("a1_")


def test_statements_alternate(frames, spark):
    pool, concepts = frames
    facets = concepts.withColumn("facets", F.array(F.lit("a facet of more than thirty characters, one"), F.lit("short"), F.lit("a facet of more than thirty characters, two")))
    out = Z.statements(Z.safe_distractors(pool, concepts), facets).orderBy("concept_id", "place").collect()
    assert [(r["concept_id"], r["polarity"], r["text"]) for r in out] == [("a", True, "the cat sat on the mat"), ("a", False, "a dog ran"), ("b", True, "exactly this"), ("b", False, "something else")]


def test_similarity_is_that_of_matching_blocks(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))).strip(), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))).strip()) for _ in range(60)] + [(None, "a"), ("", "")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    same = lambda c: F.coalesce(c, F.lit(""))
    got = {r["k"]: r["s"] for r in df.select("k", Z.sequence_similarity(F.col("a"), F.col("b"), same).alias("s")).collect()}
    assert got == {k: pytest.approx(0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()) for k, (a, b) in enumerate(pairs)}


def test_spread_takes_those_used_least(spark):
    cases = spark.createDataFrame([(1, "k1", 1), (1, "k2", 2), (1, "k3", 3), (1, "k4", 4), (2, "k5", 1)], "doc_id int, case_id string, seq int")
    cand = [("k1", c, i) for i, c in enumerate("abcd")] + [("k2", c, i) for i, c in enumerate("abcd")] + [("k3", "a", 0)] + [("k4", c, i) for i, c in enumerate("dcba")] + [("k5", c, i) for i, c in enumerate("ab")]
    out = Z.spread_candidates(cases, spark.createDataFrame(cand, "case_id string, concept_id string, rank int"))
    got = {}
    for r in out.collect():
        got.setdefault(r["case_id"], set()).add(r["concept_id"])
    # k1: a b c; k2: d (unused), then a, b; k3 has one candidate only; k4: d c (used once each), then b before a by place
    assert got == {"k1": set("abc"), "k2": set("dab"), "k4": set("dcb"), "k5": set("ab")}


def test_spread_of_cases_that_share_a_list(spark):
    rng = random.Random(4)
    lists = {k: rng.sample("abcdefgh", rng.randint(1, 7)) for k in range(5)}
    cases = [(d, f"k{d}_{n}", n, rng.randrange(6)) for d in (1, 2) for n in range(40)]
    cand = spark.createDataFrame([(k, c, i) for k, cs in lists.items() for i, c in enumerate(cs)], "of_list int, concept_id string, rank int")
    out = Z.spread_candidates(spark.createDataFrame(cases, "doc_id int, case_id string, seq int, of_list int"), cand, key="of_list")
    want, used = [], {}
    for d, case, _, k in cases:
        cs = lists.get(k, [])
        best = sorted(range(len(cs)), key=lambda i: (used.get((d, cs[i]), 0), i))[:3]
        for i in best if len(best) >= 2 else []:
            used[d, cs[i]] = used.get((d, cs[i]), 0) + 1
            want.append((d, case, cs[i]))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_levels_of_a_chain_deeper_than_100_and_of_a_cycle(spark):
    chain = [(f"c{n}", f"c{n - 1}") for n in range(1, 105)]
    needs = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "x"), ("c1", "gone")], "concept_id string, required string")
    nodes = spark.createDataFrame([(f"c{n}",) for n in range(105)] + [("x",), ("y",), ("z",), ("alone",)], "concept_id string")
    got = {r["concept_id"]: r["level"] for r in K.levels(needs, nodes).collect()}
    assert got == {f"c{n}": n for n in range(105)} | {"x": None, "y": None, "z": None, "alone": 0}


def test_adjudicated_merges_in_order(spark):
    d = [(1, 1, "a", ["a", "b", "zz"]), (1, 2, "b", ["b", "c"]), (1, 3, "c", ["c", "a"]), (1, 4, "d", ["d", "e", "f", "g", "h"]), (1, 5, "q", ["d", "e"]), (1, 6, "e", ["e", "d", "d"]), (2, 1, "a", ["b"])]
    decisions = spark.createDataFrame(d, "doc_id int, seq int, canonical_id string, members array<string>")
    concepts = spark.createDataFrame([(1, x) for x in "abcdefgh"] + [(2, "a")], "doc_id int, concept_id string")
    assert ids(Z.adjudicated(decisions, concepts), "doc_id", "old", "new") == [(1, "b", "a"), (1, "d", "e")]


def test_rejections_say_why(spark):
    pool = spark.createDataFrame([("a", "d1", 0.9, 0.95), ("a", "d2", 0.8, 0.1), ("a", "d3", 0.7, 0.1), ("a", "d4", 0.6, 0.99), ("b", "d5", 0.9, 0.72), ("b", "d6", 0.5, 0.2), ("c", "d7", 0.1, 0.8)], "concept_id string, distractor_id string, plausibility double, similarity double")
    limits = spark.createDataFrame([("a", 3), ("b", 5)], "concept_id string, n_options int")
    got = ids(K.choice_rejections(pool, limits), "mechanic_id", "source_id", "reason")
    few = lambda n: f"solo quedaron {n} distractores utilizables"
    alike = lambda x: f"indistinguible de la respuesta correcta (similitud {x})"
    # a has its two before d4 is looked at
    assert got == sorted([("A1", "a", alike("0.95")), ("A1", "b", alike("0.72")), ("A1", "b", few(1)), ("A1", "c", alike("0.80")), ("A1", "c", few(0))])
    forms = spark.createDataFrame([("a", [], ["x", "y", "z"]), ("b", [], []), ("c", ["good"], ["x"])], "concept_id string, accepted array<string>, ambiguous array<string>")
    assert ids(K.form_rejections(forms), "source_id", "reason") == [("a", "su única forma aceptada la reclama otro concepto (x, y)"), ("b", "sin una forma aceptada con cuerpo suficiente para pedir evocación")]
    cases = spark.createDataFrame([("k1", "a", "gold", True), ("k2", "a", "gold", False), ("k3", None, "gold", None), ("k4", "b", " ", False)], "case_id string, primary_concept_id string, resolucion_esperada string, prediction_enabled boolean")
    out = ids(K.case_rejections(cases, cases.where("case_id = 'k1'")), "mechanic_id", "source_id")
    assert out == [("B2", "k2"), ("B2", "k4"), ("E1", "k2"), ("E1", "k3")]
