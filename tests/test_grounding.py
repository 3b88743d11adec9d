"""Quotes in sources and phrases in texts against brute force."""

import random

import numpy as np
import pytest

SOURCE = "The cat sat on the mats while the dogs were barking loudly"
#: quote, whether SOURCE holds it, and how similar it is.
QUOTES = [
    ("at sat on the mats while the dog", True, 1.0),  # cut inside its first and last words
    ("The cat sat on the mats while the dogs were barking loudly", True, 1.0),
    ("cat sat on the mats; while the dógs WERE barking", True, 1.0),
    ("hile the dogs were barking l", True, 1.0),
    ("the cat sat on the mats while the dogs were barking softly", True, 0.89),  # 8 of 9 n-grams
    ("cat sat on the mats and the dogs were barking loudly", False, None),
    ("the dogs were barking", False, None),  # too short
    ("", False, None), (None, False, None),
]


def quotes_in(spark, quotes, sources):
    from quillstone.operators.grounding import best_source

    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    d = spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string")
    return [(r["found"], r["similarity"]) for r in best_source(q, d).orderBy("quote_id").collect()]


def test_quotes_of_one_source(spark):
    assert quotes_in(spark, [q for q, *_ in QUOTES], [SOURCE, None, ""]) == [(found, similarity) for _, found, similarity in QUOTES]


def brute(quote, sources):
    def grams(t):
        w = t.split()
        return {t} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}

    if len(quote) < 25:
        return False, None
    share = max(1.0 if quote in s else len(grams(quote) & grams(s)) / len(grams(quote)) for s in sources)
    return (True, round(share, 2)) if share >= 0.82 else (False, None)


def test_quotes_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice((1, 2, 5, 9, 30)))) for _ in range(25)]
    sources = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(12)]
    sources = [*sources, sources[0], "x" * 24, "y" * 60]
    quotes = ["y" * 25, "y" * 61, "x" * 24]
    for _ in range(120):
        s = rng.choice(sources)
        at = rng.randrange(len(s))
        piece = s[at : at + rng.randint(20, 90)].strip()
        own = piece.split()
        if rng.random() < 0.5 and own:
            own[rng.randrange(len(own))] = rng.choice(words)
        quotes.append(" ".join(own))
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    want = [brute(plain(q), [plain(s) for s in sources]) for q in quotes]
    assert 20 < sum(f for f, _ in want) < 110
    assert quotes_in(spark, quotes, sources) == want


@pytest.mark.parametrize("width, gram", [(25, 13), (7, 3), (5, 5)])
def test_a_text_has_the_piece_keys_of_what_it_holds(width, gram):
    from quillstone.functions.grams import KeySet, piece_keys, word_keys

    rng = random.Random(width)
    for _ in range(100):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 200)))
        at = rng.randrange(len(text))
        piece = text[at : at + rng.randint(1, 60)]
        keys = piece_keys(piece, width, gram)
        assert (len(keys) > 0) == (len(piece) >= width) and set(keys) <= set(piece_keys(text, width, gram))
    some = KeySet(4)
    keys = word_keys("a b c d e f g")
    assert len(keys) == 4 and set(word_keys("a b c d")) < set(keys) and len(word_keys("")) == 0 and set(word_keys("a b")) != set(word_keys("b a"))
    for k in keys.tolist():
        some.bits[k & 3] |= np.uint64(1) << (np.uint64(k & (2**64 - 1)) >> np.uint64(40) & np.uint64(63))
    assert some.hits(keys).all() and int(keys[0]) in some


def test_phrases_in_blocks(spark, monkeypatch):
    from quillstone.functions import patterns
    from quillstone.operators import segment as S

    rng = random.Random(1)
    forms = [(f"c{k % 17}", " ".join(rng.choice(("red", "blue", "re", "d")) for _ in range(rng.randint(1, 3)))) for k in range(40)]
    texts = [(k, " ".join(rng.choice(("red", "blue", "re", "d", "box")) for _ in range(rng.randint(0, 12)))) for k in range(30)] + [(99, None)]
    f, t = spark.createDataFrame([*forms, ("c1", "")], "concept_id string, form string"), spark.createDataFrame(texts, "doc_id long, norm string")
    for chars in (2_000_000, 40):
        monkeypatch.setattr(patterns, "BLOCK_CHARS", chars)
        for whole, edge in ((True, " "), (False, "")):
            want = {k: sorted({i for i, x in forms if f"{edge}{x}{edge}" in f"{edge}{text}{edge}"}) if text else [] for k, text in texts}
            assert {r["doc_id"]: r["concept_ids"] for r in S.mentions(t, f, whole).collect()} == want
    assert all(r["concept_ids"] == [] for r in S.mentions(t, f.limit(0)).collect())


def test_synonyms_and_parentheses_are_forms(spark):
    from quillstone.operators.segment import surface_forms

    c = spark.createDataFrame([("a", "Large (LBB) Blue", ["Big One", None]), ("b", "Box (abcdefghijkl)", None)], "concept_id string, title string, synonyms array<string>")
    assert {tuple(r) for r in surface_forms(c, 3).collect()} == {("a", "large lbb blue"), ("b", "box abcdefghijkl"), ("b", "box")}
    assert {tuple(r) for r in surface_forms(c, 4, synonyms=True).collect()} == {("a", "large lbb blue"), ("a", "big one"), ("b", "box abcdefghijkl"), ("b", "abcdefghijkl")}


def test_every_quote_has_the_share_of_its_closest_source(spark):
    from quillstone.operators.grounding import closest_source

    q = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "none of these words are in sources"), (3, "one two"), (4, "alpha beta gamma delta epsilon")], "quote_id long, quote string")
    d = spark.createDataFrame([(1, "zero one two three four five and six seven eight nine"), (2, "one two three four"), (3, None), (4, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    got = [tuple(r) for r in closest_source(q, d).orderBy("quote_id").collect()]
    assert got == [(1, False, 0.5), (2, False, 0.0), (3, False, 0.0), (4, True, 1.0)]


def test_numbers_are_rounded_on_the_double_itself(spark):
    from quillstone.operators.profile import rounded

    df = spark.createDataFrame([(1.005,), (0.145,), (0.125,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(rounded(df["x"], 2)).collect()] == [1.0, 0.14, 0.13, -0.13, None]


def test_segments_that_mention_a_form_count_once(spark):
    from quillstone.operators.segment import mentioning

    s = spark.createDataFrame([(1, 0, "a form", 6), (1, 0, "a form", 6), (1, 1, "form", 4), (1, 2, "a form", 6)], "doc_id long, seq long, norm string, chars long")
    forms = spark.createDataFrame([("c", "form")], "concept_id string, form string")
    assert sorted(tuple(r) for r in mentioning(s, forms, 10).collect()) == [(1, 0, 6), (1, 1, 4)]


def test_plans_number_the_concepts_of_customers_that_repeat(spark, tmp_path):
    from quillstone.plans import sessions
    from quillstone.plans.book import Views

    spark.createDataFrame([(1,), (1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(4, 1, 1001.23), (5, 1, 2001.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["position"], r["concept_id"]) for r in sessions.plan(Views(spark, str(tmp_path))).collect())
    assert got == [(1, "c4"), (2, "c4"), (3, "c5"), (4, "c5")]
