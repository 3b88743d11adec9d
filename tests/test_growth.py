"""Steps that must not cost more a row as tables grow: their results against brute force or goldens, and the shape of their plans."""

from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_sessions_are_planned_many_to_a_batch(spark):
    from quillstone.operators.session import session_plan

    every = F.array(*[F.lit(m) for m in ("A1", "B1", "E1")])
    c = spark.range(60).select((F.col("id") % 20).alias("student_id"), F.lit(1).alias("course"), F.concat(F.lit("c"), F.col("id") % 7).alias("concept_id"), (F.floor(F.col("id") / 20) + 1).alias("k"), F.lit(0.5).alias("score"), F.lit(True).alias("seen"), F.array(F.lit("A"), F.lit("B")).alias("families"), every.alias("available"))
    i = spark.range(50).select(F.lit(1).alias("course"), F.concat(F.lit("c"), F.col("id") % 6).alias("concept_id"), F.element_at(every, (F.col("id") % 3 + 1).cast("int")).alias("mechanic_id"), F.col("id").alias("item_id"), (-F.col("id")).alias("place"))
    for mode in ("aprendizaje", "evaluacion"):
        out = session_plan(c, i, mode)
        assert "FlatMapGroups" not in plan_of(out)  # one call of Python a student
        whole = sorted(out.collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        try:
            assert sorted(session_plan(c, i, mode).collect()) == whole  # sessions that lie in several batches
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r["student_id"] for r in whole} == set(range(20))
        for student in range(20):
            taken = [r["item_id"] for r in whole if r["student_id"] == student and r["kind"] == "ejercicio"]
            assert taken and len(taken) == len(set(taken))


class FakeState:
    """What a group state holds between calls, and the time it is told."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now, self.get, self.waits = False, False, 0, None, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.waits = ms

    def remove(self):
        self.exists, self.get = False, None


def test_bets_of_a_students_items_expire_each_in_its_time():
    import pandas as pd

    from quillstone.streaming.profile import bet_gaps

    class Events:
        def groupBy(self, *keys):
            assert keys == ("student_id",)  # one call of Python a student, not an item
            return self

        def applyInPandasWithState(self, match, *rest):
            return match

    match, state = bet_gaps(Events(), 100), FakeState()

    def told(now, *rows):
        state.now = now
        frame = pd.DataFrame([(1, *r) for r in rows], columns=["student_id", "item_id", "event_id", "kind", "value"])
        return [tuple(r)[1:] for f in match((1,), iter([frame]), state) for r in f.itertuples(index=False)]

    assert told(0, ("a", 1, "bet", 0.25), ("b", 2, "bet", 0.0)) == [] and state.waits == 100
    assert told(60, ("a", 4, "bet", 0.5)) == [] and state.waits == 40  # b is due first
    assert told(120, ("b", 5, "result", 1.0)) == [] and state.waits == 40  # b's bet has expired, a's not
    assert told(159, ("a", 7, "result", 1.0)) == [("a", 1, 0.75), ("a", 4, 0.5)] and not state.exists
    assert told(160, ("a", 8, "bet", 0.5)) == []
    state.hasTimedOut, state.now = True, 261
    assert list(match((1,), iter([]), state)) == [] and not state.exists


def test_a_session_reads_and_writes_its_state_once_a_batch():
    import pandas as pd

    from quillstone.streaming.answered import SessionState

    calls = []

    class Map(dict):
        def getValue(self, key):
            calls.append("get")
            return self.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(self.items())

    class Handle:
        timers = []

        def getMapState(self, name, key, value):
            return Map()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers = [at]

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    s = SessionState(1000)
    s.init(Handle())
    row = lambda seq, kind, item, **k: {"session_id": 7, "seq": seq, "at": float(seq), "kind": kind, "concept_id": "c", "item_id": item, "correct": None, "declared": None, "said": None} | k
    first = pd.DataFrame([row(1, "calibracion", "i", declared=0.9), row(2, "ejercicio", "j", correct=True), row(3, "calibracion", "j")])
    assert list(s.handleInputRows((5,), iter([first]), None)) == [] and calls == ["get", "update"]
    second = pd.DataFrame([row(4, "ejercicio", "i", correct=False), row(5, "ejercicio", "j", correct=True), row(6, "reflexion", "k", said="c")])
    out = [tuple(r)[:8] for f in s.handleInputRows((5,), iter([second]), None) for r in f.itertuples(index=False)]
    assert [(r[1], r[5], r[6], r[7]) for r in out[:2]] == [(4, 0.9, 0.0, None), (5, 0.5, 1.0, None)] and out[2][7] == "c" and calls == ["get", "update"] * 2
    other = pd.DataFrame([row(9, "calibracion", "i", declared=0.5, session_id=8)])
    assert list(s.handleInputRows((5,), iter([other]), None)) == [] and s.handle.timers == [1_003_001]  # the bucket's first
    s.handle.timers = []
    list(s.handleExpiredTimer((5,), Now(1_006_001), None))
    assert set(s.kept) == {(8,)} and s.handle.timers == [1_009_001]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def query(spark, name):
    import __spark_entry__ as e

    return e.queries()[name](spark, "/root/testdata/sf0.001")


def test_texts_are_normalised_once_a_row_or_pair(spark):
    # of an answer and its forms, each once
    assert optimized(query(spark, "gd5_evoked")).count("translate(") == 2
    plan = optimized(query(spark, "gd4_relation_type"))
    assert "exists(" not in plan and plan.count("translate(") == 2  # types of a pair, answer of an edge


def test_options_are_made_without_windows_and_descriptions_once_a_pair(spark):
    assert "Window" not in optimized(query(spark, "se8_served_options"))
    texts = [line for line in optimized(query(spark, "rg14_described_edges")).split("\n") if "concat_ws( y ," in line]
    assert texts and not any("doc_id" in line for line in texts)


def test_small_groups_share_a_call_of_python(spark):
    for name in ("sg10_budgeted", "ca15_near_duplicate_texts", "ca15_united_lists"):
        assert "FlatMapGroups" not in optimized(query(spark, name)), name


def test_folded_groups_that_lie_in_several_batches(spark):
    from quillstone.operators.segment import folded

    rows = spark.range(60).select((F.col("id") % 7).alias("g"), F.col("id").alias("seq"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = folded(rows, "g", lambda own: [(len(own), [x for (x,) in own])], "g long, n long, xs array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, out)) == [(g, len(range(g, 60, 7)), list(range(g, 60, 7))) for g in range(7)]


def test_batches_of_large_groups_are_numbered_in_ranges(spark):
    from quillstone.operators.segment import batches, batches_across

    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 3)).alias("lang"), ((F.col("id") * 37) % 500).alias("seq"))
    out = batches_across(rows, 3, ("lang",))
    assert sorted(out.collect(), key=str) == sorted(batches(rows, 3, ("lang",)).collect(), key=str)
    windows = [line for line in optimized(out).split("\n") if "Window" in line and "row_number" in line]
    assert windows and all("__part" in line for line in windows)  # no window over a whole group


def test_a_pass_of_python_holds_one_block_of_forms_and_no_ids(spark, monkeypatch):
    from quillstone.functions import patterns

    made = []
    finder = patterns._finder
    monkeypatch.setattr(patterns, "_finder", lambda phrases, whole: made.append(phrases) or finder(phrases, whole))
    monkeypatch.setattr(patterns, "BLOCK_CHARS", 40)
    forms = spark.range(600).select(F.concat(F.lit("concept"), F.col("id")).alias("concept_id"), F.concat(F.lit("form"), F.col("id") % 20).alias("form"))
    texts = spark.createDataFrame([(1, "a form1 and form12"), (2, "none"), (3, "form7"), (4, None)], "doc_id long, norm string")
    found = patterns.phrases_found(texts, forms)
    assert sorted(map(tuple, found.collect())) == [(1, "form1"), (1, "form12"), (3, "form7")]
    assert len(made) > 2 and sorted(x for block in made for x in block) == sorted(f"form{k}" for k in range(20))  # each form once, whatever the concepts
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == len(made)  # passes of their own


def test_concepts_that_share_forms_are_counted_in_groups(spark):
    import itertools
    import random
    from collections import Counter

    from quillstone.operators import relations as R
    from quillstone.operators import segment as S

    rng = random.Random(3)
    words = [f"word{k}" for k in range(12)]
    forms = [(f"c{k:02}", rng.choice(words[:9])) for k in range(14)] + [(f"c{k:02}", rng.choice(words)) for k in range(5)] + [(f"h{k:02}", words[11]) for k in range(9)]
    texts = [(k // 4, k % 4, " ".join(rng.sample([*words, "else"], rng.randint(0, 4)))) for k in range(60)]
    mine = {(d, s): {c for c, f in forms if f in t} for d, s, t in texts}
    seen, shared = Counter(c for m in mine.values() for c in m), Counter(p for m in mine.values() if len(m) <= 8 for p in itertools.combinations(sorted(m), 2))
    want = {(a, b, n, round(min(1, n / max(seen[a] * seen[b] / len(texts), 0.5)) + 1e-9, 2)) for (a, b), n in shared.items() if n >= 2}
    frame = spark.createDataFrame(texts, "doc_id long, seq long, norm string")
    mentions, sizes, members = S.mentioned_groups(frame, spark.createDataFrame(sorted(set(forms)), "concept_id string, form string"), whole_words=False)
    assert sizes.where("size >= 9").count() == 1 and members.count() == len(seen)  # 9 concepts are one row of a paragraph
    got = [tuple(r) for r in R.co_occurrences(mentions, sizes, members, len(texts)).collect()]
    assert len(got) > 10 and set(got) == want and len(got) == len(want)


def test_relations_are_counted_as_they_come_and_read_once(spark):
    from quillstone.operators import relations as R
    from quillstone.plans import graphs

    rows = [(k, k % 3, x, y, t, c) for k, (x, y, t, c) in enumerate([("a", "b", "requiere", 0.5), ("b", "a", "contrasta", 0.4), ("a", "b", "contrasta", 0.6), (None, "a", "contrasta", 0.9), ("a", None, "causa", 0.9), ("a", "a", "causa", 0.9), ("a", "z", "causa", 0.9), ("d", "a", "otro", None), ("d", "a", "otro", 0.1), ("d", "a", "OTRO", 0.2), ("c", "b", "causa", 0.2), ("c", "b", "causa", 0.2), ("d", "c", "apoya", 0.3)] * 3)]
    edges = spark.createDataFrame(rows, "doc_id long, seq long, from_concept_id string, to_concept_id string, relation_type string, confidence double")
    concepts = spark.createDataFrame([(x,) for x in "abcd"], "concept_id string")
    asked = []
    v = lambda name: asked.append(name) or {"v_relations_raw": edges, "v_concepts": concepts}[name]
    plain = R.merged(R.linked(graphs.repaired(v), concepts), ())
    assert sorted(graphs.merged(v).collect()) == sorted(plain.collect()) and plain.count() == 5
    assert R.counted(edges, ()).count() == 12  # of 39 rows
    asked.clear()
    hinted = graphs.rg17(v)
    assert [tuple(r) for r in hinted.collect()] == [("a", "d", 9), ("b", "c", 6), ("c", "d", 3)]
    assert asked.count("v_relations_raw") == 1


def test_a_split_community_reads_its_relations_once(spark, monkeypatch):
    from quillstone.plans import bundles, more

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    sides = [(f"{x}{j}", f"{x}{k}", "apoya") for x in "mp" for k in range(7) for j in range(k)]
    frame = spark.createDataFrame([*sides, *[(f"a{h}", f"{x}{k}", "causa") for h in range(3) for x in "mp" for k in range(7)]], "from_concept_id string, to_concept_id string, relation_type string")
    monkeypatch.setattr(bundles, "edges", lambda v: frame.mapInArrow(seen, frame.schema))
    groups = {}
    for r in more.rg8(None).collect():
        groups.setdefault(r["community"], set()).add(r["concept_id"])
    assert sorted(map(len, groups.values())) == [7, 10] and read.value == frame.count()


def test_titles_are_read_once_for_structural_keys(spark):
    from quillstone.operators import resolve as E

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    titles = ["Large Blue (LBB)", "LBB", "Large Blue", "Box", "box", "Tall Red (TR)", "Tin Rod (TR)", "TR", "", None]
    frame = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(titles)], "concept_id string, title string").mapInArrow(seen, "concept_id string, title string")
    keys = {tuple(r) for r in E.structural_keys(frame).collect()}
    assert keys == {("c0", "large blue lbb"), ("c0", "large blue"), ("c0", "@lbb"), ("c1", "lbb"), ("c1", "@lbb"), ("c2", "large blue"), ("c3", "box"), ("c4", "box"), ("c5", "tall red tr"), ("c5", "tall red"), ("c6", "tin rod tr"), ("c6", "tin rod"), ("c7", "tr")}
    assert read.value == len(titles)
