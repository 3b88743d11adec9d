"""Plans of the profile and store analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import profile as P
from quillstone.plans.book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

#: v_signals with its modality and weight, as both engines have them.
WEIGHTED = """
with s as (select *, case dimension when 'transferencia' then 'produccion_guiada' else 'reconocimiento' end as modalidad from v_signals),
w as (select s.*, round((case modalidad when 'produccion_guiada' then 0.60::double else 0.35::double end)
  * (case modalidad when 'reconocimiento' then 1 - 1/greatest(n_efectivo, 1.01::double) else 1::double end)
  * greatest(0.40::double, 1 - 0.15::double * hints_used) * greatest(0.50::double, 1 - 0.10::double * scaffolds), 3) as weight from s)"""
PROFILE = WEIGHTED + """,
p as (select student_id, concept_id, dimension, round(greatest(0, least(1, 0.5::double + 2.5::double * sum(delta*weight)/sum(weight))), 3) as score,
  round(sum(weight), 2) as evidence, count(*) as n from w where forma = 'escalar' group by all)"""


def weighted(v):
    s = v("v_signals").withColumn("modalidad", F.when(F.col("dimension") == "transferencia", "produccion_guiada").otherwise("reconocimiento"))
    return s.withColumn("weight", P.evidence_weight(F.col("modalidad"), F.col("n_efectivo"), F.col("hints_used"), F.col("scaffolds")))


@book.page("gd7_evidence_weight", "v_signals", WEIGHTED + " select event_id, modalidad, weight from w")
def gd7(v):
    return weighted(v).select("event_id", "modalidad", "weight")


@book.page("pr1_signal_scan", "v_signals", "select event_id, concept_id, dimension, delta from v_signals where student_id = 7")
def pr1(v):
    return v("v_signals").where("student_id = 7").select("event_id", "concept_id", "dimension", "delta")


@book.page("pr2_profile", "v_signals", PROFILE + " select * from p")
def pr2(v):
    return P.weighted_profile(weighted(v))


@book.page("pr2_profile_wide", "v_signals", PROFILE + """ select student_id, concept_id, max(score) filter (where dimension='recuperacion') as recuperacion,
  max(score) filter (where dimension='transferencia') as transferencia from p group by all""")
def pr2_wide(v):
    return P.pivoted_profile(P.weighted_profile(weighted(v)), ("recuperacion", "transferencia"))


@book.page("pr3_latency", "v_signals", PROFILE.replace("(select *, case", "(select * replace ('c'||cast(event_id%5 as string) as concept_id), case", 1) + """, t as (select student_id, concept_id, sum(latencia_ms)::bigint as s, count(*) as n_latency from w
  where forma='temporal' and latencia_ms > 0 group by all having count(*) >= 5)
  select student_id, concept_id, s // n_latency as latency_ms, n_latency from t where exists (select 1 from p where p.student_id=t.student_id and p.concept_id=t.concept_id)""")
def pr3(v):
    s = weighted(v).withColumn("concept_id", F.concat(F.lit("c"), F.col("event_id") % 5))
    return P.latencies(s, P.weighted_profile(s))


@book.page("pr4_active_repertoires", "v_signals", "select student_id, concept_id, count(*) as n from v_signals where dimension='anclaje' and forma='observacional' group by all")
def pr4(v):
    return P.active(v("v_signals"), "anclaje", "concept_id")


_BETS = """
with e as (select user_id as student_id, 'i'||(event_id%10) as item_id, ts, event_id, case when event_id%3=0 then 'bet' else 'result' end as kind,
  case when event_id%3=0 then round(value/500, 2) when value > 250 then 1::double else 0::double end as value from events),
b as (select *, first_value(case when kind='result' then value end ignore nulls) over (partition by student_id, item_id order by ts, event_id
  rows between 1 following and unbounded following) as real from e),
c as (select student_id, item_id, event_id, value as declared, real from b where kind='bet')"""


def bets(v):
    bet = F.col("event_id") % 3 == 0
    value = F.when(bet, F.round(F.col("value") / 500, 2)).when(F.col("value") > 250, 1.0).otherwise(0.0)
    return v("events").select(F.col("user_id").alias("student_id"), F.concat(F.lit("i"), F.col("event_id") % 10).alias("item_id"), "ts", "event_id", F.when(bet, "bet").otherwise("result").alias("kind"), value.alias("value"))


@book.page("gd10_calibration_close", "", _BETS + " select student_id, item_id, event_id, round(abs(coalesce(nullif(declared, 0), 0.5::double) - real), 3) as error from c")
def gd10(v):
    declared = F.coalesce(F.nullif("declared", F.lit(0.0)), F.lit(0.5))
    return P.bets_with_results(bets(v)).select("student_id", "item_id", "event_id", F.round(F.abs(declared - F.col("real")), 3).alias("error"))


@book.page("pr5_calibration", "", _BETS + """, g as (select student_id, sum(cast(round(abs(coalesce(nullif(declared, 0), 0.5::double) - real) * 1000) as bigint))::bigint as s, count(real) as n_closed from c group by student_id)
  select student_id, case when n_closed > 0 then ((2 * s + n_closed) // (2 * n_closed)) / 1000 end as calibration_error, n_closed from g""")
def pr5(v):
    return P.calibration_error(P.bets_with_results(bets(v)))


@book.page("pr6_counters", "v_signals", "select student_id, count(*) as n_signals, count(*) filter (where dimension='srl_accion') as n_help from v_signals group by all")
def pr6(v):
    return P.counters(v("v_signals"))


@book.page("pr7_last_seen", "v_signals", "select student_id, concept_id, epoch_us(max(ts)) as last_seen_us from v_signals group by all")
def pr7(v):
    return v("v_signals").groupBy("student_id", "concept_id").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_seen_us"))


@book.page("pr8_latest_row", "", "select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by all")
def pr8(v):
    return P.latest(v("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@book.page("pr9_lookup_by_code", "", "select c_custkey, upper(substr(replace(lower(c_name), '-', ''), 1, 6)) as code from customer where lower(c_name) = lower('CUSTOMER#000000042') or upper(substr(replace(c_name, '-', ''), 1, 6)) = 'CUSTOM'")
def pr9(v):
    code = F.upper(F.substring(F.replace(F.lower("c_name"), F.lit("-"), F.lit("")), 1, 6))
    named = F.lower("c_name") == "customer#000000042"
    coded = F.upper(F.substring(F.replace("c_name", F.lit("-"), F.lit("")), 1, 6)) == "CUSTOM"
    return v("customer").where(named | coded).select("c_custkey", code.alias("code"))


@book.page("pr10_documents_of_owner", "", """select o.o_custkey as owner, o_orderkey as course, count(*) as n_items from orders o join lineitem on l_orderkey = o_orderkey group by all""")
def pr10(v):
    items = v("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    return v("orders").join(items, "o_orderkey").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("course"), "n_items")


@book.page("pr11_recent_sessions", "", """select user_id, event_id, rn from (select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as rn from events) where rn <= 10""")
def pr11(v):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return v("events").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("user_id", "event_id", "rn")


@book.page("pr12_job_recovery", "", """select event_id, case when event_type in ('click','view') then 'failed' else event_type end as status from
  (select * from events order by ts desc, event_id desc limit 200)""")
def pr12(v):
    last = v("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return last.select("event_id", F.when(F.col("event_type").isin("click", "view"), "failed").otherwise(F.col("event_type")).alias("status"))


@book.page("pr13_plan_progress", "v_signals", PROFILE + """ select s.student_id, s.concept_id, coalesce(p.score, 0) as score from (select distinct student_id, concept_id from v_signals) s
  left join p on p.student_id=s.student_id and p.concept_id=s.concept_id and p.dimension='recuperacion'""")
def pr13(v):
    return P.progress(P.weighted_profile(weighted(v)), v("v_signals").select("student_id", "concept_id").distinct())
