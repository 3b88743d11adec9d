"""Communities over relations of all types, and the split of one that holds most concepts, against brute force."""

import itertools
import random
from collections import Counter

import pytest

from quillstone.operators import communities as C


def brute_labels(edges, max_rounds=30):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    labels, old, falling = {a: a for a in near}, {a: None for a in near}, False
    for k in range(11 * max_rounds):
        new = {}
        for a, around in near.items():
            votes = Counter(labels[b] for b in around)
            best = min(votes, key=lambda x: (-votes[x], x))
            new[a] = min(best, labels[a]) if falling else best
        if new == labels:
            return labels
        falling = falling or new == old or k >= max_rounds
        labels, old = new, labels
    raise AssertionError


def brute_split(members, edges):
    sub = [e for e in edges if e[0] in members and e[1] in members]
    degree = Counter(x for e in sub for x in e)
    ranked = sorted(degree.values(), reverse=True)
    over = [d for k, d in enumerate(ranked) if k + 1 > max(1, len(members) // 8)]
    cut = next((d for d in sorted(set(ranked), reverse=True) if sum(x >= d for x in ranked) > max(1, len(members) // 8)), 0) if over else 0
    hubs = {x for x, d in degree.items() if d >= cut and d > 2}
    parts = brute_labels([e for e in sub if not hubs & set(e)])
    if len(set(parts.values())) < 2:
        return {m: "all" for m in members}
    out = dict(parts)
    for h in hubs:
        pulls = Counter(parts[o] for e in sub for x, o in (e, e[::-1]) if x == h and o in parts)
        if pulls:
            out[h] = min(pulls, key=lambda x: (-pulls[x], x))
    return out


def graph(seed):
    rng = random.Random(seed)
    n = rng.randint(4, 40)
    groups = [rng.randint(0, 3) for _ in range(n)]
    return [(f"n{a:02}", f"n{b:02}") for a in range(n) for b in range(n) if a < b and rng.random() < (0.5 if groups[a] == groups[b] else 0.05)]


CASES = {f"random{k}": graph(k) for k in range(3)} | {"two colours": [(f"l{a}", f"r{b}") for a in range(4) for b in range(4)], "loop and pair": [("a", "a"), ("b", "c")]}


@pytest.mark.parametrize("name", CASES)
def test_labels_settle_and_split_like_brute_force(spark, name):
    edges = CASES[name]
    frame = spark.createDataFrame(edges, "from_concept_id string, to_concept_id string")
    want = brute_labels(edges)
    assert {r["concept_id"]: r["label"] for r in C.propagate(frame).collect()} == want
    members = {x for e in edges for x in e}
    one = spark.createDataFrame([(m, "all") for m in members], "concept_id string, label string")
    assert {r["concept_id"]: r["label"] for r in C.split(one, frame).collect()} == brute_split(members, edges)


def test_a_swinging_graph_ends_in_one_community():
    assert set(brute_labels(CASES["two colours"]).values()) == {"l0"}


def test_labels_that_do_not_settle_raise(spark):
    path = [(f"p{k:03}", f"p{k + 1:03}") for k in range(40)]
    with pytest.raises(RuntimeError):
        C.propagate(spark.createDataFrame(path, "from_concept_id string, to_concept_id string"), max_rounds=0)


def test_all_types_count_and_the_largest_is_split(spark, monkeypatch):
    from quillstone.plans import bundles, material

    left, right, hubs = [[f"{x}{k}" for k in range(n)] for x, n in (("m", 7), ("p", 7), ("a", 3))]
    edges = [(a, b, "apoya") for a, b in itertools.combinations(left, 2)] + [(a, b, "requiere") for a, b in itertools.combinations(right, 2)]
    edges += [(h, x, "matiza") for h in hubs for x in left + right]
    frame = spark.createDataFrame(edges, "from_concept_id string, to_concept_id string, relation_type string")
    monkeypatch.setattr(bundles, "edges", lambda v: frame)
    groups = {}
    for r in material.rg7(None).collect():
        groups.setdefault(r["community"], set()).add(r["concept_id"])
    assert groups == {1: {*left, *hubs}, 2: {*right}}
