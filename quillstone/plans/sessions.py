"""Plans of grading and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import answer_norm
from quillstone.operators import answered as N
from quillstone.operators import grading as G
from quillstone.operators import session as S
from quillstone.operators.profile import rounded
from quillstone.plans.book import Book
from quillstone.plans.texts import ANSWER
from quillstone.sources.fixtures import stream
from quillstone.streaming.answered import answered_stream
from quillstone.streaming.profile import drained

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

TOK = lambda c: f"list_distinct(list_filter(regexp_split_to_array({ANSWER(c)}, '\\s+'), lambda w: length(w) > 2))"
#: Answers of exercises, from the event table.
ANSWERS = """with a as (select event_id, user_id, cast(user_id * 100 + event_id % 5 as bigint) as session_id, 'c'||cast(event_id % 12 as string) as concept_id, ['A1','A3','B1','B2','C1','E1','E3'][(event_id % 7 + 1)::int] as mechanic_id,
 value > 250 as correct, floor(value / 5) / 100 as partial, event_id % 4 as hints, cast(floor(value * 10) as bigint) as duration, case when event_id % 6 = 0 then 'r'||cast(event_id % 9 as string) end as repertoire, case when event_id % 8 = 0 then 'c'||cast(event_id % 5 as string) end as confused from events)"""


def answers(v):
    e, i = v("events"), F.col("event_id")
    c = lambda p, k: F.concat(F.lit(p), (i % k).cast("string"))
    return e.select(
        "event_id", "user_id", "ts", (F.col("user_id") * 100 + i % 5).alias("session_id"), c("c", 12).alias("concept_id"),
        F.element_at(F.array(*[F.lit(m) for m in ("A1", "A3", "B1", "B2", "C1", "E1", "E3")]), (i % 7 + 1).cast("int")).alias("mechanic_id"),
        (F.col("value") > 250).alias("correct"), (F.floor(F.col("value") / 5) / 100).alias("partial"), (i % 4).alias("hints"), F.floor(F.col("value") * 10).cast("long").alias("duration"),
        F.when(i % 6 == 0, c("r", 9)).alias("repertoire"), F.when(i % 8 == 0, c("c", 5)).alias("confused"),
    )


@book.page("gd1_choice", "", "select l_orderkey, l_linenumber, l_returnflag is not distinct from case when l_linestatus = 'F' then 'A' else 'N' end as correct from lineitem")
def gd1(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", G.same(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N")).alias("correct"))


@book.page("gd2_classified", "v_scenarios v_cases", "select scenario_id, concept_id is not distinct from primary_concept_id as correct from v_scenarios left join v_cases on parent_case_id = case_id")
def gd2(v):
    c = v("v_cases").select(F.col("case_id").alias("parent_case_id"), "primary_concept_id")
    return v("v_scenarios").join(c, "parent_case_id", "left").select("scenario_id", G.same(F.col("concept_id"), F.col("primary_concept_id")).alias("correct"))


@book.page("gd3_true_false", "", "select event_id, (event_type in ('click','view')) = (value > 250) as correct, event_type not in ('click','view') as correct_compat from events")
def gd3(v):
    a = F.when(F.col("event_type").isin("click", "view"), "si").otherwise("no")
    return v("events").select("event_id", G.true_false(a, F.col("value") > 250).alias("correct"), G.true_false(a, F.lit(True), compat=True).alias("correct_compat"))


@book.page("gd4_relation_type", "v_relations_raw", "with t as (select from_concept_id, to_concept_id, list(distinct lower(relation_type)) as ts from v_relations_raw group by all) select doc_id, seq, list_contains(ts, lower(case when seq % 2 = 0 then 'Apoya' else relation_type end)) as correct from v_relations_raw join t using (from_concept_id, to_concept_id)")
def gd4(v):
    r = v("v_relations_raw")
    t = r.groupBy("from_concept_id", "to_concept_id").agg(F.collect_set("relation_type").alias("ts")).withColumn("ts", F.transform("ts", answer_norm))
    a = F.when(F.col("seq") % 2 == 0, "Apoya").otherwise(F.col("relation_type"))
    return r.join(t, ["from_concept_id", "to_concept_id"]).select("doc_id", "seq", G.accepted_type(a, F.col("ts")).alias("correct"))


@book.page("gd5_evoked", "v_concepts", f"""with x as (select concept_id, case seq % 4 when 0 then upper(title) when 1 then split_part(title, ' ', 1) when 2 then split_part(title, ' ', 1)||' zzz' else 'qqq www' end as a, [title, title||' extra'] as fs from v_concepts),
 y as (select *, {ANSWER('a')} as n, list_transform(fs, lambda f: lower(f)) as ns, {TOK('a')} as w from x), z as (select *, coalesce(list_max(list_transform(ns, lambda f: len(list_intersect(w, list_distinct(list_filter(string_split(f, ' '), lambda q: length(q) > 2)))) / len(list_distinct(list_filter(string_split(f, ' '), lambda q: length(q) > 2))))), 0) as best from y),
 p as (select concept_id, case when n = '' then 0 when list_contains(ns, n) then 1 when len(list_filter(ns, lambda f: contains(f, n) or contains(n, f))) > 0 then 0.85 when best >= 0.6 then 0.7 when best >= 0.35 then 0.4 else 0 end::double as partial from z)
 select concept_id, partial, partial >= 0.7 as correct, case when partial = 1 then 0.85 else 0.6 end::double as confidence from p""")
def gd5(v):
    t, k, head = F.col("title"), F.col("seq") % 4, F.split_part("title", F.lit(" "), F.lit(1))
    a = F.when(k == 0, F.upper(t)).when(k == 1, head).when(k == 2, F.concat(head, F.lit(" zzz"))).otherwise("qqq www")
    return v("v_concepts").select("concept_id", G.evoked(a, F.array(t, F.concat(t, F.lit(" extra")))).alias("g")).select("concept_id", "g.*")


@book.page("gd6_open_answer", "v_qa", f"with t as (select conv_id, turn, {TOK('answer')} as a, {TOK('gold')} as b from v_qa), s as (select conv_id, turn, case when len(a) < 5 then 0 when len(b) = 0 then 0.5 else round(len(list_intersect(a, b)) / len(b), 2) end::double as score from t) select *, score >= 0.35 as correct, round(least(1, score / 0.6), 4) as partial from s")
def gd6(v):
    return v("v_qa").select("conv_id", "turn", G.open_answer(F.col("answer"), F.col("gold")).alias("g")).select("conv_id", "turn", "g.score", "g.correct", F.round("g.partial", 4).alias("partial"))


@book.page("gd8_signals", "", ANSWERS + """, s as (select event_id, case mechanic_id when 'C1' then 'relacion' when 'A1' then 'recuperacion' when 'A3' then 'recuperacion' when 'B1' then 'recuperacion' else 'transferencia' end as dimension, 'escalar' as forma, case when mechanic_id = 'C1' then 'arista' else 'concepto' end as target,
 case when mechanic_id = 'C1' then concept_id||',x' else concept_id end as targets, round((partial - 0.5) * 0.4, 3) as delta, null::bigint as latency from a union all select event_id, 'anclaje', 'observacional', 'repertorio', repertoire, null, null from a where repertoire is not null
 union all select event_id, 'relacion', 'escalar', 'arista', concept_id||','||confused, -0.1::double, null from a where confused is not null and confused <> concept_id union all select event_id, 'automatizacion', 'temporal', 'concepto', concept_id, null, duration from a where mechanic_id in ('A1','A3','C1') and duration > 0 and hints = 0
 union all select event_id, 'srl_accion', 'observacional', 'sesion', '', null, null from a where hints > 0) select * from s""")
def gd8(v):
    c = F.col
    s = G.signals(c("mechanic_id"), c("concept_id"), F.array(c("concept_id"), F.lit("x")), c("correct"), c("partial"), c("repertoire"), c("confused"), c("hints"), c("duration"))
    out = answers(v).select("event_id", F.explode(s).alias("s")).select("event_id", "s.*")
    return out.withColumn("targets", F.array_join("targets", ","))


_M = G.MESSAGES


@book.page("gd9_feedback", "", ANSWERS + f""", x as (select *, event_id % 5 <> 0 as told, mechanic_id = 'A3' and event_id % 3 = 0 as amb, case when repertoire is not null then 'contraste '||repertoire when event_id % 16 = 0 then 'no es '||confused end as fb,
 case when event_id % 2 = 0 then ['apoya', 'causa'] else ['apoya'] end as answers, case when event_id % 11 = 0 then '—' else concept_id end as expected from a),
 k as (select *, case when not told then null when correct then 'acierto' when repertoire is not null then 'repertorio' when fb is not null then 'distincion' when mechanic_id = 'C1' then 'explicacion' when mechanic_id = 'A3' then case when amb then 'ambigua' when partial >= 0.35 then 'cerca' else 'correccion' end
  when mechanic_id in ('E1', 'E3') then 'modelo' else 'error' end as kind from x)
 select event_id, kind, case kind when 'acierto' then '{_M['acierto']}' when 'repertorio' then fb when 'distincion' then fb when 'explicacion' then 'porque '||concept_id when 'ambigua' then '{_M['ambigua']}'||expected when 'cerca' then '{_M['cerca']}'||expected when 'correccion' then '{_M['correccion']}'||expected when 'modelo' then '{_M['modelo']}' when 'error' then '{_M['error']}' end as message,
 case when kind = 'repertorio' then case when event_id % 4 = 0 then 'en casa' else '' end end as works_where, case when kind = 'explicacion' then array_to_string(answers, ', ') end as answer, case when kind = 'modelo' then 'modelo '||event_id end as model,
 case kind when 'repertorio' then '{_M['nota_repertorio']}' when 'explicacion' then case when len(answers) > 1 then '{_M['nota_vinculos']}'||array_to_string(answers, ', ')||'.' else '' end end as note from k""")
def gd9(v):
    i, c = F.col("event_id"), F.col
    said = F.when(c("repertoire").isNotNull(), F.concat(F.lit("contraste "), c("repertoire"))).when(i % 16 == 0, F.concat(F.lit("no es "), c("confused")))
    result = F.struct(c("correct"), c("partial"), ((c("mechanic_id") == "A3") & (i % 3 == 0)).alias("ambiguous"))
    distractor = F.struct(c("repertoire").alias("repertoire_id"), said.alias("feedback"), F.when(i % 4 == 0, "en casa").alias("works_where"))
    both = F.array(F.lit("apoya"), F.lit("causa"))
    accepted = F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(c("concept_id")))
    item = F.struct(F.concat(F.lit("porque "), c("concept_id")).alias("explanation"), F.when(i % 2 == 0, both).otherwise(F.slice(both, 1, 1)).alias("answers"), accepted.alias("accepted"), F.concat(F.lit("modelo "), i).alias("model"))
    mode = F.when(i % 5 == 0, "evaluacion").otherwise("aprendizaje")
    return answers(v).select("event_id", G.feedback(mode, c("mechanic_id"), result, distractor, item).alias("f")).select("event_id", "f.*")


_CHOICES = ANSWERS + ", c as (select session_id, partial as score, event_id = max(event_id) over (partition by session_id) as chosen from a)"


def choices(v):
    from pyspark.sql import Window

    last = F.max("event_id").over(Window.partitionBy("session_id"))
    return answers(v).select("session_id", F.col("partial").alias("score"), (F.col("event_id") == last).alias("chosen"))


@book.page("gd11_planning_signal", "", _CHOICES + ", w as (select session_id, max(score) filter (where chosen) <= min(score) + 0.05 as well from c group by all) select session_id, case when well then 0.15 else -0.05 end::double as delta, 0.5::double as confidence from w")
def gd11(v):
    return S.planned_well(choices(v)).select("session_id", S.planning_signal(F.col("well")).alias("s")).select("session_id", "s.*")


_WORST = ANSWERS + ", b as (select session_id, concept_id, sum(correct::int) / count(*) as share, min(event_id) as since from a group by all), w as (select session_id, arg_min(concept_id, (share, since)) as concept_id from b group by all)"


@book.page("gd12_reflection_signals", "", _WORST + """, s as (select session_id, case when session_id % 3 = 0 then null when session_id % 3 = 1 then concept_id else 'c0' end as said, concept_id as worst from w) select session_id, 'srl_autorreflexion' as dimension, case when said is null then 0 when said = worst then 0.15 else -0.05 end::double as delta from s
 union all select session_id, 'calibracion', case when said = worst then 0.15 else -0.05 end::double from s where said is not null""")
def gd12(v):
    k = F.col("session_id") % 3
    said = F.when(k == 0, F.lit(None)).when(k == 1, F.col("concept_id")).otherwise("c0")
    return S.worst_concept(answers(v).withColumn("seq", F.col("event_id"))).select("session_id", F.explode(S.reflection_signals(said, F.col("concept_id"))).alias("s")).select("session_id", "s.*")


@book.page("se1_modes", "", "select 'aprendizaje' as mode, 'libre' as ctx_temporal, 'privado' as ctx_stakes, 'independiente' as ctx_social, true as permite_pistas, true as feedback_inmediato, false as muestra_puntaje, true as ciclo_adquisicion, 4 as conceptos_por_sesion, 3 as calibracion_cada, true as planeacion_inicial, true as reflexion_final union all select 'evaluacion', 'cronometro_suave', 'visible_profesor', 'independiente', false, false, true, false, 8, 1, false, true")
def se1(v):
    return S.modes(v.spark)


_PLAN = """with p as (select c_custkey as student_id, 'c'||cast(o_orderkey as string) as concept_id, row_number() over (partition by c_custkey order by o_orderkey) as position, case when o_orderkey % 3 = 0 then null else round((o_totalprice % 1000) / 1000, 3) end as score, (o_orderkey % 4)::bigint as unit from customer join orders on o_custkey = c_custkey)"""


def plan(v):
    from pyspark.sql import Window

    o = v("orders").join(v("customer"), F.col("c_custkey") == F.col("o_custkey"))
    pos = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")).cast("long")
    score = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(rounded((F.col("o_totalprice") % 1000) / 1000, 3))
    return o.select(F.col("c_custkey").alias("student_id"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("concept_id"), pos.alias("position"), score.alias("score"), (F.col("o_orderkey") % 4).alias("unit"))


@book.page("se2_frontier", "", _PLAN + " select student_id, concept_id from (select *, count(*) filter (where score >= 0.6) over (partition by student_id) + 6 as reach from p) where position <= reach")
def se2(v):
    return S.frontier(plan(v)).select("student_id", "concept_id")


@book.page("se3_evaluation_choice", "", _PLAN + ", t as (select *, row_number() over (partition by student_id, unit order by position) as turn from p), k as (select *, row_number() over (partition by student_id order by turn, unit)::int as k from t) select student_id, concept_id, k from k where k <= 8")
def se3(v):
    return S.evaluation_choice(plan(v)).select("student_id", "concept_id", "k")


@book.page("se4_learning_choice", "", _PLAN + ", k as (select *, row_number() over (partition by student_id order by score is not null, coalesce(score, 0), position)::int as k from p) select student_id, concept_id, k from k where k <= 4")
def se4(v):
    return S.learning_choice(plan(v)).select("student_id", "concept_id", "k")


_RECOMMENDED = [["C", "A"], ["B", "E"], ["D"], []]
_OFFERED = ["A1", "A3", "B1", "C1", "E1"]


def recommended():
    """Recommended families by unit."""
    letters = [F.array(*[F.lit(f) for f in x]).cast("array<string>") for x in _RECOMMENDED]
    return F.element_at(F.array(*letters), (F.col("unit") + 1).cast("int"))


@book.page("se5_allowed_families", "", _PLAN + f""", r as (select *, coalesce(score, 0) as s, case unit when 3 then ['A'] else ({_RECOMMENDED})[unit + 1] end as rec from p), l as (select *, list_filter(rec, lambda f: f in ('A', 'B', 'C')) as low from r),
 f as (select *, case when s < 0.4 then ['A'] when s >= 0.65 then rec when len(low) > 0 then low else ['A', 'B'] end as fam from l), g as (select *, case when position % 2 = 0 then list_concat(['A'], list_filter(fam, lambda x: x <> 'A')) else fam end as families from f),
 m as (select *, flatten(list_transform(families, lambda x: list_filter({_OFFERED}, lambda y: starts_with(y, x)))) as ms from g)
 select student_id, concept_id, array_to_string(families, ',') as families, case when len(ms) = 0 then 'A1' else array_to_string(ms, ',') end as mechanics from m""")
def se5(v):
    families = S.allowed_families(F.col("score"), recommended(), F.col("position") % 2 == 0)
    ids = S.preferred_mechanics(F.col("families"), F.array(*[F.lit(m) for m in _OFFERED]))
    return plan(v).withColumn("families", families).select("student_id", "concept_id", F.array_join("families", ",").alias("families"), F.array_join(ids, ",").alias("mechanics"))


_FIRST = _PLAN + ", i as (select o_orderkey as item, 'c'||cast(o_orderkey as string) as concept_id from orders union all select o_orderkey + 1000000000, 'c'||cast(o_orderkey as string) from orders where o_orderkey % 2 = 0)"


@book.page("se6_first_unused_item", "", _FIRST + " select student_id, p.concept_id, min(item)::bigint as item_id from p join i on i.concept_id = p.concept_id where (item + student_id) % 5 <> 0 group by all")
def se6(v):
    o, p = v("orders"), plan(v)
    c = F.concat(F.lit("c"), F.col("o_orderkey")).alias("concept_id")
    keys = o.select(F.col("o_orderkey").alias("item_id"), c).unionByName(o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 1000000000).alias("item_id"), c))
    used = p.join(keys, "concept_id").where("(item_id + student_id) % 5 = 0").select("student_id", "item_id")
    return S.first_unused(p.select("student_id", "concept_id"), keys.withColumn("place", F.col("item_id")), used)


def session_inputs(v, chosen):
    """Choices and items of three courses: concepts of the answers, and those answers as items."""
    kept = chosen.withColumn("concept_id", F.concat(F.lit("c"), F.substring("concept_id", 2, 9).cast("long") % 12)).withColumn("families", recommended())
    first = kept.groupBy("student_id", "concept_id").agg(F.min("k").alias("k"), F.min_by(F.struct("score", "families"), "k").alias("r"))
    choices = first.select("student_id", (F.col("student_id") % 3).alias("course"), "concept_id", "k", "r.*", F.col("r.score").isNotNull().alias("seen"), F.array(*[F.lit(m) for m in _OFFERED]).alias("available"))
    items = answers(v).select((F.col("event_id") % 3).alias("course"), "concept_id", "mechanic_id", F.col("event_id").alias("item_id"), F.col("event_id").alias("place"))
    return choices, items


@book.page("se7_session_steps")
def se7(v):
    return S.session_plan(*session_inputs(v, S.learning_choice(plan(v)))).withColumn("concepts", F.array_join("concepts", ","))


@book.page("se7_evaluation_steps")
def se7_evaluation(v):
    return S.session_plan(*session_inputs(v, S.evaluation_choice(plan(v))), "evaluacion").withColumn("concepts", F.array_join("concepts", ","))


@book.page("se8_served_options", "", """with o as (select l_orderkey as item_id, l_linenumber::varchar as id, l_linenumber = min(l_linenumber) over (partition by l_orderkey) as correct from lineitem), h as (select *, sha1(item_id||chr(124)||id) as h from (select distinct item_id::varchar as item_id, id, correct from o)),
 r as (select *, row_number() over (partition by item_id, correct order by h) as k from h) select item_id, string_agg(id, ',' order by h) as options from r where correct or k <= 2 group by item_id""")
def se8(v):
    o = v("lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ls"))
    option = lambda n: F.struct(n.cast("string").alias("id"), n.cast("string").alias("text"), (n == F.array_min("ls")).alias("correct"))
    items = o.select(F.col("l_orderkey").cast("string").alias("item_id"), F.transform("ls", option).alias("options"))
    return S.served(items).select("item_id", F.array_join(F.transform("options", lambda x: x["id"]), ",").alias("options"))


@book.page("se9_hints", "", ANSWERS + " select event_id, case when mechanic_id in ('A1','B2','C1') then 'descartar' when mechanic_id = 'A3' then 'inicial' when mechanic_id = 'B1' then 'definicion' else 'variables' end as hint from a")
def se9(v):
    m = F.col("mechanic_id")
    return answers(v).select("event_id", F.when(m.isin("A1", "B2", "C1"), "descartar").when(m == "A3", "inicial").when(m == "B1", "definicion").otherwise("variables").alias("hint"))


@book.page("se10_item_by_id", "", "select event_id, o_totalprice from events join orders on o_orderkey = event_id")
def se10(v):
    return v("events").join(v("orders"), F.col("o_orderkey") == F.col("event_id")).select("event_id", "o_totalprice")


_STEPS = ANSWERS + ", s as (select session_id, row_number() over (partition by session_id order by event_id) as step, case when row_number() over (partition by session_id order by event_id) = 1 then 'planeacion' when row_number() over (partition by session_id order by event_id desc) = 1 then 'reflexion' else 'ejercicio' end as kind, concept_id from a), c as (select session_id, max(concept_id) as chosen from a group by all)"


@book.page("se11_reordered", "", _STEPS + " select session_id, step::int as step, row_number() over (partition by session_id order by case when kind = 'planeacion' then 0 when kind = 'reflexion' then 3 when concept_id = chosen then 1 else 2 end, step)::int as place from s join c using (session_id)")
def se11(v):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id")
    a = answers(v).withColumn("step", F.row_number().over(w.orderBy("event_id"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("event_id"))))
    kind = F.when(F.col("step") == 1, "planeacion").when(F.col("back") == 1, "reflexion").otherwise("ejercicio")
    return S.reordered(a.select("session_id", "step", kind.alias("kind"), "concept_id"), a.groupBy("session_id").agg(F.max("concept_id").alias("chosen"))).select("session_id", "step", "place")


@book.page("se12_replayed", "", ANSWERS + """, k as (select session_id, event_id, case mechanic_id when 'B1' then 'calibracion' when 'E3' then 'exposicion' when 'C1' then 'planeacion' else 'ejercicio' end as kind, concept_id, event_id // 7 % 3 as item_id, correct, partial from a),
 x as (select session_id, item_id, max(event_id) filter (where kind = 'calibracion') as b, arg_max(case when partial = 0 then 0.5 else partial end, event_id) filter (where kind = 'calibracion') as bet, max(event_id) filter (where kind = 'ejercicio') as e, arg_max(correct, event_id) filter (where kind = 'ejercicio') as hit from k group by all),
 bets as (select session_id, count(*) filter (where e is null or e < b) as open_bets, avg(abs(bet - hit::int)) filter (where e > b) as gap from x where b is not null group by all), sh as (select session_id, concept_id, avg(correct::int) as share, min(event_id) as since from k where kind = 'ejercicio' group by all),
 w as (select session_id, arg_min(concept_id, (share, since)) as worst from sh group by all)
 select session_id, count(*) as done, count(*) filter (where kind = 'ejercicio') as answers, count(*) filter (where kind = 'ejercicio' and correct) as hits, arg_max(concept_id, event_id) filter (where kind = 'planeacion') as chosen, false as ended, any_value(worst) as worst, coalesce(any_value(open_bets), 0) as open_bets, round(any_value(gap), 6) as gap
 from k left join bets using (session_id) left join w using (session_id) group by session_id""")
def se12(v):
    m = F.col("mechanic_id")
    kind = F.when(m == "B1", "calibracion").when(m == "E3", "exposicion").when(m == "C1", "planeacion").otherwise("ejercicio")
    k = answers(v).select("session_id", F.col("event_id").alias("seq"), kind.alias("kind"), "concept_id", (F.floor(F.col("event_id") / 7) % 3).alias("item_id"), "correct", F.col("partial").alias("declared"))
    return S.replay(k).withColumn("gap", F.round("gap", 6))


#: A log of steps: mechanics stand for kinds; every session has bets, exercises on three items, plans and reflections.
_LOG = ANSWERS + """, g as (select a.*, e.ts, case mechanic_id when 'B1' then 'calibracion' when 'E3' then 'exposicion' when 'C1' then 'planeacion' when 'E1' then 'reflexion' else 'ejercicio' end as kind, (event_id // 5 % 3)::varchar as item_id,
 case when event_id % 5 = 0 then '_ninguno' else 'c'||event_id % 4 end as said, [{'id': 'c0', 'score': partial}, {'id': 'c1', 'score': 0.4}, {'id': 'c2', 'score': partial / 2}] as options from a join events e using (event_id))"""
_SIGNALS = _LOG + f""", p as (select *, sum(paused) over (partition by session_id order by event_id) as epoch from (select *, case when epoch(ts) - epoch(lag(ts) over (partition by session_id order by event_id)) > {7 * 86_400} then 1 else 0 end as paused from g)),
 x as (select * from g where kind = 'ejercicio'),
 own as (select session_id, event_id as seq, case mechanic_id when 'B2' then 'transferencia' else 'recuperacion' end as dimension, 'escalar' as forma, 'concepto' as target, concept_id as targets, round((partial - 0.5) * 0.4, 3) as delta, null::bigint as latency, null::double as declared, null::double as real from x
  union all select session_id, event_id, 'anclaje', 'observacional', 'repertorio', repertoire, null, null, null, null from x where repertoire is not null union all select session_id, event_id, 'relacion', 'escalar', 'arista', concept_id||','||confused, -0.1, null, null, null from x where confused is not null and confused <> concept_id
  union all select session_id, event_id, 'automatizacion', 'temporal', 'concepto', concept_id, null, duration, null, null from x where mechanic_id in ('A1', 'A3') and duration > 0 and hints = 0 union all select session_id, event_id, 'srl_accion', 'observacional', 'sesion', '', null, null, null, null from x where hints > 0
  union all select session_id, event_id, 'srl_planeacion', 'escalar', 'sesion', said, case when coalesce(list_filter(options, lambda o: o.id = said)[-1].score, 1) <= list_min(list_transform(options, lambda o: o.score)) + 0.05 then 0.15 else -0.05 end, null, null, null from g where kind = 'planeacion'),
 bt as (select *, lag(kind) over w as before, lag(partial) over w as bet, lag(concept_id) over w as about from p where kind in ('calibracion', 'ejercicio') window w as (partition by session_id, epoch, item_id order by event_id)),
 cl as (select session_id, event_id as seq, 'calibracion' as dimension, 'calibracion' as forma, 'concepto' as target, about as targets, null::double as delta, null::bigint as latency, coalesce(nullif(bet, 0), 0.5) as declared, correct::int::double as real from bt where kind = 'ejercicio' and before = 'calibracion'),
 r as (select * from p where kind = 'reflexion'), b as (select r.event_id as asked, y.* from r join p y on y.session_id = r.session_id and y.epoch = r.epoch and y.kind = 'ejercicio' and y.event_id < r.event_id),
 it as (select asked, item_id, arg_max(correct, event_id)::int as hit from b group by all), sh as (select asked, concept_id, avg(hit) as share, min(event_id) as since from b join it using (asked, item_id) group by all), ws as (select asked, arg_min(concept_id, (share, since)) as worst from sh group by all),
 rf as (select r.*, worst from r left join ws on asked = event_id), lt as (select session_id, event_id as seq, 'srl_autorreflexion' as dimension, 'escalar' as forma, 'sesion' as target, case when said = '_ninguno' or worst is null then '' else said end as targets, case when said = '_ninguno' or worst is null then 0 when said = worst then 0.15 else -0.05 end as delta, null::bigint as latency, null::double as declared, null::double as real from rf
  union all select session_id, event_id, 'calibracion', 'calibracion', 'sesion', said, null, null, 1, (said = worst)::int from rf where said <> '_ninguno' and worst is not null),
 z as (from own union all by name from cl union all by name from lt) select session_id, seq, dimension, forma, target, targets, delta::double as delta, latency, declared::double as declared, real::double as real, round(abs(declared - real), 3)::double as error from z"""


def step_log(v, events=None):
    from pyspark.sql.types import StringType

    class Given:  # the same columns over a table or a stream of events
        def __call__(self, name):
            return v(name) if events is None else events

    a = answers(Given())
    m, i, text = F.col("mechanic_id"), F.col("event_id"), StringType()
    kind = F.when(m == "B1", "calibracion").when(m == "E3", "exposicion").when(m == "C1", "planeacion").when(m == "E1", "reflexion").otherwise("ejercicio")
    option = lambda k, score: F.struct(F.lit(k).alias("id"), score.cast("double").alias("score"))
    return a.select(
        "session_id", i.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), "concept_id", (F.floor(i / 5) % 3).cast(text).alias("item_id"), "mechanic_id", F.array("concept_id", F.lit("x")).alias("pair"), "correct", "partial", "repertoire", "confused", "hints", "duration",
        F.col("partial").alias("declared"), F.when(i % 5 == 0, "_ninguno").otherwise(F.concat(F.lit("c"), (i % 4).cast(text))).alias("said"), F.array(option("c0", F.col("partial")), option("c1", F.lit(0.4)), option("c2", F.col("partial") / 2)).alias("options"),
    )


@book.page("se12_signals", "", _SIGNALS)
def se12_signals(v):
    return N.answered(step_log(v), 7 * 86_400).withColumn("targets", F.array_join("targets", ","))


@book.page("se12_streamed_signals", "", _SIGNALS)
def se12_streamed(v):
    signals = answered_stream(step_log(v, stream(v.spark, v.sf_dir, "events")), 7 * 86_400)
    return drained(signals.withColumn("targets", F.array_join("targets", ",")), "append", "answered", state="rocksdb")


@book.page("se13_planned_well", "", _CHOICES + " select session_id, max(score) filter (where chosen) <= min(score) + 0.05 as well from c group by all")
def se13(v):
    return S.planned_well(choices(v))


@book.page("se14_worst_concept", "", _WORST + " select * from w")
def se14(v):
    return S.worst_concept(answers(v).withColumn("seq", F.col("event_id")))


@book.page("se15_summary", "", ANSWERS + ", pl as (select distinct session_id, concept_id from a), b as (select * from a where hints = 0) select session_id, concept_id, count(b.event_id) as attempts, count(*) filter (where correct) as hits, count(distinct mechanic_id) as mechanics from pl left join b using (session_id, concept_id) group by all")
def se15(v):
    a = answers(v)
    return S.summary(a.where("hints = 0"), a)


@book.page("se16_hint_counter", "", ANSWERS + " select session_id, concept_id, sum(hints)::bigint as hints from a where hints > 0 group by all")
def se16(v):
    return answers(v).where("hints > 0").groupBy("session_id", "concept_id").agg(F.sum("hints").alias("hints"))
