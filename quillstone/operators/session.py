"""Session planning and replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.profile import lookup
from quillstone.sources.shared import written

# Session modes, playable mechanics and answer formats.
MODES = {
    "aprendizaje": {"ctx_temporal": "libre", "ctx_stakes": "privado", "ctx_social": "independiente", "permite_pistas": True, "feedback_inmediato": True, "muestra_puntaje": False, "ciclo_adquisicion": True, "conceptos_por_sesion": 4, "calibracion_cada": 3, "planeacion_inicial": True, "reflexion_final": True},
    "evaluacion": {"ctx_temporal": "cronometro_suave", "ctx_stakes": "visible_profesor", "ctx_social": "independiente", "permite_pistas": False, "feedback_inmediato": False, "muestra_puntaje": True, "ciclo_adquisicion": False, "conceptos_por_sesion": 8, "calibracion_cada": 1, "planeacion_inicial": False, "reflexion_final": True},
}
PLAYABLE = ("A1", "A3", "B1", "B2", "C1", "E1", "E3")
FORMATS = {"A1": "opcion_multiple", "B1": "si_no", "B2": "opcion_multiple", "C1": "opcion_multiple", "A3": "texto_libre", "E1": "texto_libre", "E3": "texto_libre"}
SQL_TYPES = {str: "string", bool: "boolean", int: "int"}


def modes(spark) -> DataFrame:
    keys = list(MODES["aprendizaje"])
    kinds = ", ".join(f"{k} {SQL_TYPES[type(MODES['aprendizaje'][k])]}" for k in keys)
    return spark.createDataFrame([(m, *[v[k] for k in keys]) for m, v in MODES.items()], f"mode string, {kinds}")


def frontier(plan: DataFrame, limit: int = 4) -> DataFrame:
    """Planned concepts within reach: those known, and the next ones.

    plan: student_id, concept_id, position (from 1), score."""
    w = Window.partitionBy("student_id")
    known = F.count_if(F.col("score") >= 0.6).over(w)
    return plan.withColumn("reach", known + max(limit, 6)).where(F.col("position") <= F.col("reach")).drop("reach")


def learning_choice(plan: DataFrame, limit: int = 4) -> DataFrame:
    """The concepts to study next: unseen first, then the weakest, then by position."""
    w = Window.partitionBy("student_id").orderBy(F.col("score").isNotNull(), F.coalesce("score", F.lit(0.0)), "position")
    return plan.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)


def evaluation_choice(plan: DataFrame, limit: int = 8) -> DataFrame:
    """Concepts taken from the units in turn. plan: student_id, concept_id, unit, position."""
    turn = F.row_number().over(Window.partitionBy("student_id", "unit").orderBy("position"))
    w = Window.partitionBy("student_id").orderBy("turn", "unit")
    return plan.withColumn("turn", turn).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)


def allowed_families(score: Column, recommended: Column, guided: Column) -> Column:
    """Families of mechanics in order of preference: the recommended ones (A if there are none) that the
    mastery allows; a guided step starts with recognition."""
    s, letters = F.coalesce(score, F.lit(0.0)), lambda x: F.array(*[F.lit(f) for f in x])
    wanted = F.when(F.size(recommended) > 0, recommended).otherwise(letters("A"))
    lower = F.filter(wanted, lambda f: f.isin("A", "B", "C"))
    allowed = F.when(s < 0.4, letters("A")).when(s >= 0.65, wanted).when(F.size(lower) > 0, lower).otherwise(letters("AB"))
    return F.when(guided, F.concat(letters("A"), F.filter(allowed, lambda f: f != "A"))).otherwise(allowed)


def preferred_mechanics(families: Column, available: Column) -> Column:
    """Available playable mechanics in the order of families; the first available one if no family has any."""
    ids = F.array_sort(F.array_intersect(available, F.array(*[F.lit(m) for m in PLAYABLE])))
    of_family = F.flatten(F.transform(families, lambda f: F.filter(ids, lambda m: F.startswith(m, f))))
    return F.when(F.size(of_family) > 0, of_family).otherwise(F.slice(ids, 1, 1))


def first_unused(wanted: DataFrame, items: DataFrame, used: DataFrame) -> DataFrame:
    """wanted (student_id, concept_id) with item_id: the concept's first item by place that the student hasn't used.

    items: concept_id, item_id, place; used: student_id, item_id. Rows without such an item go."""
    free = wanted.join(items, "concept_id").join(used, ["student_id", "item_id"], "left_anti")
    return free.groupBy("student_id", "concept_id").agg(F.min_by("item_id", F.struct("place", "item_id")).alias("item_id"))


STEP = (
    "student_id long, step long, kind string, cycle string, concept_id string, mechanic_id string, item_id long, "
    "hints boolean, feedback boolean, fewer_options boolean, fading int, concepts array<string>"
)


def session_plan(choices: DataFrame, items: DataFrame, mode: str = "aprendizaje") -> DataFrame:
    """All steps of each student's session, numbered from 1.

    choices: student_id, course, concept_id, k (from 1), score (null: 0), seen, families, available (mechanics).
    items: course, concept_id (a row for each that an item touches), mechanic_id, item_id, place.

    Learning shows a concept that is new or below 0.35, then asks a guided and, below 0.6, a free exercise;
    evaluation asks one exercise a concept. A mechanic of another answer format than the last is
    preferred. Without an unused item of it on the concept, evaluation takes one on any concept of the session,
    then both try the other available mechanics. Bets come before every n-th exercise, planning opens
    and reflection closes a session that has steps. A concept without items gets no exercise.

    What is chosen depends on the steps before, so a session is planned in order. It uses an item a concept and cycle at most:
    the first cycles * concepts items of each course, concept and mechanic hold all that it can take. Sessions are planned many to an
    Arrow batch, and a task reads the offers of a concept once while it remembers them.
    """
    cfg = MODES[mode]
    most = cfg["conceptos_por_sesion"]
    guided, score = F.lit(cfg["ciclo_adquisicion"]), F.coalesce("score", F.lit(0.0))
    enough = most * (2 if cfg["ciclo_adquisicion"] else 1)
    by_place = Window.partitionBy("course", "concept_id", "mechanic_id").orderBy("place", "item_id")
    near = items.where(F.col("mechanic_id").isin(*PLAYABLE)).withColumn("nth", F.row_number().over(by_place)).where(F.col("nth") <= enough)
    offers = near.groupBy("course", "concept_id").agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "mechanic_id"))).alias("offers"))
    ranked = lambda g: preferred_mechanics(allowed_families(F.col("score"), F.col("families"), g), F.col("available"))
    in_order = Window.partitionBy("student_id").orderBy("k", "concept_id")
    rows = choices.where(F.col("k") <= most).select(
        "student_id", "course", "concept_id", "k", score.alias("score"), (F.coalesce("seen", F.lit(False)) & (score >= 0.35)).alias("known"),
        F.array_sort("available").alias("available"), ranked(guided).alias("first"), ranked(F.lit(False)).alias("second"), F.row_number().over(in_order).alias("own"),
    ).join(written(offers, "offers"), ["course", "concept_id"], "left")
    # a broadcast join keeps the order of the window before it, so that this one sorts nothing again
    rows = rows.withColumn("turn", F.row_number().over(in_order)).drop("own")
    return rows.select(*_CHOICE).mapInArrow(lambda batches: _sessions(batches, cfg), STEP)


_CHOICE = "turn student_id course concept_id score known available first second offers".split()
_STEP_NAMES = [c.split()[0] for c in STEP.split(", ")]
#: Concepts whose offers a task remembers, and steps of an output batch.
_REMEMBERED, _STEPS = 10_000, 20_000


def _sessions(batches: Iterator[pa.RecordBatch], cfg: dict) -> Iterator[pa.RecordBatch]:
    """The steps of sessions whose rows follow each other; turn is 1 where the next one begins."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in STEP.split(", "))])
    offers, open_rows, out = {}, [], []
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        own = batch.column(len(_CHOICE) - 1)
        for i, row in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(_CHOICE) - 1)])):
            if row[0] == 1 and open_rows:
                out += _planned(open_rows, cfg)
                open_rows = []
                if len(out) >= _STEPS:
                    yield made(out)
                    out = []
            key = row[2:4]
            if key not in offers:
                if len(offers) >= _REMEMBERED:
                    offers.clear()
                offers[key] = by_mechanic = {}
                for o in own[i].as_py() or ():
                    by_mechanic.setdefault(o["mechanic_id"], []).append((o["place"], o["item_id"]))
            open_rows.append((*row[1:], offers[key]))
    out += _planned(open_rows, cfg) if open_rows else []
    if out:
        yield made(out)


def _planned(chosen: list[tuple], cfg: dict) -> list[list]:
    """The steps of one student's session; see session_plan. chosen: rows of _CHOICE without turn, offers by mechanic in order."""
    offers = {r[2]: r[8] for r in chosen}
    learning, every = cfg["ciclo_adquisicion"], cfg["calibracion_cada"]
    steps, used, last, exercises = [], set(), None, 0

    def unused(mechanic, among):
        return next((o for o in among.get(mechanic, ()) if o[1] not in used), None)

    def anywhere(mechanic):
        return None if learning else min((o for among in offers.values() if (o := unused(mechanic, among))), default=None)

    def add(kind, **more):
        steps.append({"kind": kind} | more)

    for _, _, concept, score, known, available, first, second, _ in chosen:
        if learning and not known:
            add("exposicion", concept_id=concept)
        cycles = ["evaluacion"] if not learning else ["guiada"] if score >= 0.6 else ["guiada", "autonoma"]
        for cycle in cycles:
            ranked = second if cycle == "autonoma" else first
            if not ranked:
                continue
            mechanic = next((m for m in ranked if FORMATS[m] != last), ranked[0])
            found = unused(mechanic, offers[concept]) or anywhere(mechanic)
            if found is None:
                others = ((m, unused(m, offers[concept])) for m in PLAYABLE if m != mechanic and m in available)
                mechanic, found = next(((m, o) for m, o in others if o), (mechanic, None))
            if found is None:
                continue
            item = found[1]
            if every and exercises % every == 0:
                add("calibracion", concept_id=concept, mechanic_id="G1", item_id=item)
            guided = cycle == "guiada"
            add(
                "ejercicio", cycle=cycle, concept_id=concept, mechanic_id=mechanic, item_id=item, hints=cfg["permite_pistas"] and guided,
                feedback=cfg["feedback_inmediato"], fewer_options=guided and score < 0.4, fading=0 if guided else 1,
            )
            used.add(item)
            last, exercises = FORMATS[mechanic], exercises + 1
    ids = [r[2] for r in chosen]
    if steps and cfg["planeacion_inicial"]:
        steps.insert(0, {"kind": "planeacion", "mechanic_id": "I1", "concepts": ids})
    if steps and cfg["reflexion_final"]:
        add("reflexion", mechanic_id="I4", concepts=ids)
    return [[chosen[0][0], k, *[s.get(c) for c in _STEP_NAMES[2:]]] for k, s in enumerate(steps, 1)]


def served(items: DataFrame, options: int = 2) -> DataFrame:
    """Items as a student sees them: the right option and so many others, shuffled, without secrets.

    items: item_id, options (array of struct id, text, correct)."""
    by_hash = lambda i, o: F.struct(F.sha1(F.concat_ws("|", i, o["id"]).cast("binary")).alias("h"), o.alias("o"))
    right = F.filter("options", lambda o: o["correct"])
    wrong = F.slice(F.transform(F.array_sort(F.transform(F.filter("options", lambda o: ~o["correct"]), lambda o: by_hash(F.col("item_id"), o))), lambda x: x["o"]), 1, options)
    mixed = F.array_sort(F.transform(F.concat(right, wrong), lambda o: by_hash(F.col("item_id"), o)))
    return items.select("item_id", F.transform(mixed, lambda x: F.struct(x["o"]["id"].alias("id"), x["o"]["text"].alias("text"))).alias("options"))


def reordered(steps: DataFrame, choice: DataFrame) -> DataFrame:
    """Steps with the chosen concept's first: fixed ones, the choice, the rest, the end.

    steps: session_id, step, kind, concept_id; choice: session_id, chosen."""
    rank = F.when(F.col("kind") == "planeacion", 0).when(F.col("kind") == "reflexion", 3).when(F.col("concept_id") == F.col("chosen"), 1).otherwise(2)
    w = Window.partitionBy("session_id").orderBy("class", "step")
    return steps.join(choice, "session_id", "left").withColumn("class", rank).withColumn("place", F.row_number().over(w)).drop("class", "chosen")


def planned_well(choices: DataFrame) -> DataFrame:
    """Whether the chosen concept was among the weakest. choices: session_id, score, chosen (boolean)."""
    out = choices.groupBy("session_id").agg(F.min("score").alias("least"), F.max(F.when(F.col("chosen"), F.col("score"))).alias("mine"))
    return out.select("session_id", (F.col("mine") <= F.col("least") + 0.05).alias("well"))


def worst_concept(answers: DataFrame) -> DataFrame:
    """The concept of each session with the lowest share of right answers, of equal ones that asked first.

    answers: session_id, seq, concept_id, correct (null: wrong)."""
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    by = answers.groupBy("session_id", "concept_id").agg((right / F.count(F.lit(1))).alias("share"), F.min("seq").alias("since"))
    return by.groupBy("session_id").agg(F.min_by("concept_id", F.struct("share", "since", "concept_id")).alias("concept_id"))


def summary(answers: DataFrame, planned: DataFrame) -> DataFrame:
    """Attempts, hits and mechanics of every planned concept, 0 without answers."""
    by = answers.groupBy("session_id", "concept_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("correct").alias("hits"), F.count_distinct("mechanic_id").alias("mechanics"))
    return planned.select("session_id", "concept_id").distinct().join(by, ["session_id", "concept_id"], "left").fillna(0, ["attempts", "hits", "mechanics"])


def replay(events: DataFrame) -> DataFrame:
    """State of each session after its log: steps done, exercises, hits, open bets, mean gap of closed bets,
    the concept chosen to start with, the worst one so far and whether the session ended.

    events: session_id, seq, kind (exposicion, calibracion, planeacion, ejercicio, reflexion), concept_id, item_id,
    correct, declared (null or 0: 0.5). Every step advances. A bet belongs to the exercise on its item and closes if that
    comes later; of repeated ones the last counts. All aggregates: a log is never held by one task.
    """
    kind, seq = F.col("kind"), F.col("seq")
    of = lambda k, c: F.when(kind == k, c)
    bet = F.when(F.coalesce(F.col("declared"), F.lit(0.0)) != 0, F.col("declared")).otherwise(0.5)
    items = events.where(kind.isin("calibracion", "ejercicio")).groupBy("session_id", "item_id").agg(
        F.max(of("calibracion", F.struct(seq.alias("at"), bet.alias("bet")))).alias("b"),
        F.max(of("ejercicio", F.struct(seq.alias("at"), F.coalesce("correct", F.lit(False)).alias("right")))).alias("x"),
    )
    closed = F.col("x.at") > F.col("b.at")
    gap = F.when(closed, F.abs(F.col("b.bet") - F.col("x.right").cast("int")))
    bets = items.where("b is not null").groupBy("session_id").agg(F.count_if(F.coalesce(~closed, F.lit(True))).alias("open_bets"), F.avg(gap).alias("gap"))
    state = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("done"), F.count_if(kind == "ejercicio").alias("answers"), F.count_if((kind == "ejercicio") & F.col("correct")).alias("hits"),
        F.max_by("concept_id", of("planeacion", seq)).alias("chosen"), F.bool_or(kind == "reflexion").alias("ended"),
    )
    worst = worst_concept(events.where(kind == "ejercicio")).withColumnRenamed("concept_id", "worst")
    return state.join(bets, "session_id", "left").join(worst, "session_id", "left").fillna(0, ["open_bets"])


def planning_signal(well: Column) -> Column:
    """Signal of a planning step: delta and confidence."""
    return F.struct(F.when(well, 0.15).otherwise(-0.05).alias("delta"), F.lit(0.5).alias("confidence"))


def reflection_signals(said: Column, worst: Column) -> Column:
    """Signals of a reflection: a neutral one without an answer, else two."""
    row = lambda d, x: F.struct(F.lit(d).alias("dimension"), x.alias("delta"))
    right = F.when(said == worst, 0.15).otherwise(-0.05)
    return F.when(said.isNull(), F.array(row("srl_autorreflexion", F.lit(0.0)))).otherwise(F.array(row("srl_autorreflexion", right), row("calibracion", right)))


def mechanic_format(mechanic: Column) -> Column:
    return lookup(mechanic, FORMATS, None)
