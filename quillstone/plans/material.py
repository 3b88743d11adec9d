"""Plans of stores, merging, payloads, communities, sequential operators, catalogue views and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import payloads as P
from quillstone.operators import communities as C
from quillstone.operators import merge as M
from quillstone.operators import similar as Z
from quillstone.plans import bundles, graphs, profiles
from quillstone.plans.book import Book
from quillstone.sources import store as S
from quillstone.sources.fixtures import VIEWS, stream
from quillstone.streaming import profile as T

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

# --- stores ---


@book.page("io2_upload_gate", "", "select page_id, case when not ends_with(lower(url), '.html') then 'kind' when length(html) > 6000 then 'size' else 'ok' end as gate from pages")
def io2(v):
    return v("pages").select("page_id", S.gate(F.col("url"), F.length("html"), ".html", 6000).alias("gate"))


@book.page("io3_json_props", "", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def io3(v):
    return v("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@book.page("io5_selected", "", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey limit 50")
def io5(v):
    return S.select(v("orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_totalprice")


@book.page("io5_fallback", "", "select s_suppkey as k from supplier where s_nationkey = 3")
def io5_fallback(v):
    c = v("customer").where("c_custkey < 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    s = v("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return S.select_or(c, s, {"n": 3}).select("k")


@book.page("io6_deleted", "", "select o_orderkey from orders where not (o_orderstatus = 'O')")
def io6(v):
    return S.delete(v("orders"), {"o_orderstatus": "O"}).select("o_orderkey")


@book.page("io7_upserted", "", "select l_partkey, arg_max(l_orderkey, (l_shipdate, new, l_orderkey)) as l_orderkey from (select *, 0 as new from lineitem where l_linestatus = 'F' union all select *, 1 from lineitem where l_linestatus <> 'F') group by all")
def io7(v):
    li = v("lineitem").select("l_partkey", "l_orderkey", F.struct("l_shipdate", (F.col("l_linestatus") != "F").cast("int"), "l_orderkey").alias("ver"), "l_linestatus")
    old, new = li.where("l_linestatus = 'F'").drop("l_linestatus"), li.where("l_linestatus <> 'F'").drop("l_linestatus")
    return S.upsert(old, new, ["l_partkey"], "ver").select("l_partkey", "l_orderkey")


@book.page("io8_cascade", "", "select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') group by all")
def io8(v):
    gone = v("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.cascade(v("lineitem"), "l_orderkey", gone).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@book.page("io9_bundle_json", "v_frameworks", """select framework_id, '{"framework_id":"'||framework_id||'","rival_id":"'||rival_id||'"}' as bundle from v_frameworks""")
def io9(v):
    return S.bundle_json(v("v_frameworks"), "framework_id", ("label",))


# --- merging: a concept's first page stands for its document ---


def uids(v):
    return v("v_concepts").select(F.concat_ws(":", F.lpad(F.col("first_page").cast("string"), 3, "0"), F.lpad(F.col("seq").cast("string"), 8, "0")).alias("uid"), F.col("first_page").alias("doc_id"), "concept_id", "title", "definition", "importance", "is_enriched", "is_gateway")


UID = "lpad(first_page::varchar, 3, '0')||':'||lpad(seq::varchar, 8, '0')"
_MERGED = f"""with u as (select {UID} as uid, first_page as doc_id, * from v_concepts), g as (select uid, min(uid) over (partition by title) as canonical from u)"""


@book.page("mg2_matched", "v_concepts", _MERGED + " select * from g")
def mg2(v):
    return M.matched(uids(v))


@book.page("mg3_best_definitions", "v_concepts", _MERGED + """ select canonical, arg_max(definition, (is_enriched, length(definition), importance, uid)) as definition, arg_min(title, uid) as title, array_to_string(list_sort(list(distinct doc_id)), ',') as sources, max(importance) as importance, bool_or(is_gateway) as is_gateway from u join g using (uid) group by canonical""")
def mg3(v):
    u = uids(v)
    return M.best_definitions(u, M.matched(u)).withColumn("sources", F.array_join("sources", ","))


@book.page("mg4_suffixed_ids", "v_theses", "select thesis_id, case when row_number() over (partition by statement order by thesis_id) > 1 then statement||'__'||substr(thesis_id, 1, 6) else statement end as id from v_theses")
def mg4(v):
    return M.suffixed(v("v_theses").select(F.col("thesis_id").alias("doc_id"), F.col("statement").alias("id")), "id").withColumnRenamed("doc_id", "thesis_id")


@book.page("mg5_rewritten_edges", "v_concepts v_relations_raw", _MERGED + ", m as (select concept_id, canonical from u join g using (uid)) select doc_id, seq, x.canonical as from_uid, y.canonical as to_uid from v_relations_raw join m x on x.concept_id = from_concept_id join m y on y.concept_id = to_concept_id where x.canonical <> y.canonical")
def mg5(v):
    u = uids(v)
    g = M.matched(u).join(u.select("uid", "concept_id"), "uid").select(F.col("concept_id").alias("uid"), "canonical")
    e = v("v_relations_raw").select("doc_id", "seq", F.col("from_concept_id").alias("from_uid"), F.col("to_concept_id").alias("to_uid"))
    return M.rewritten(e, g)


@book.page("mg6_provenance", "v_concepts", _MERGED + ", b as (select canonical, count(distinct doc_id)::int as n_sources from u join g using (uid) group by all) select n_sources, count(*) as n_concepts from b group by all")
def mg6(v):
    u = uids(v)
    return M.provenance(M.best_definitions(u, M.matched(u)))


# --- payloads ---


@book.page("ll2_parsed_json", "", "select event_id, case when event_id % 3 = 2 then null else cast(json_extract(props, '$.k') as int) end as k from events")
def ll2(v):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))).otherwise(F.lit("no json"))
    return v("events").select("event_id", F.try_variant_get(P.parsed(raw), "$.k", "int").alias("k"))


@book.page("ll3_salvaged", "", """select event_id, '{"a": ['||props||']}' as salvaged from events""")
def ll3(v):
    cut = F.concat(F.lit('{"a": ['), F.col("props"), F.lit(', {"k": '))
    return v("events").select("event_id", P.salvaged(cut).alias("salvaged"))


@book.page("ll4_item_counts", "", "select event_id, json_array_length('['||props||','||props||']')::int as n from events")
def ll4(v):
    return v("events").select("event_id", F.json_array_length(F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).alias("n"))


_MODELS = """with m as (select s_suppkey as model_id, s_nationkey % 4 as tier, (s_suppkey % 9 + 1) * 4000 as context_limit, (s_suppkey % 7 + 1) * 3000 as tpm, (s_suppkey % 5) * 500 as used_tpm, (s_suppkey % 3)::double as wait_s, (s_suppkey % 2) * 2::double as penalty_s, case when s_suppkey % 11 = 0 then 0 end as left_today from supplier)"""


@book.page("ll6_eligible_models", "", _MODELS + " select model_id, row_number() over (order by wait_s + penalty_s, tpm - used_tpm desc, model_id)::int as rank from m where tier >= 1 and context_limit >= 8000 and tpm >= 8000 and coalesce(left_today, 1) > 0")
def ll6(v):
    k = F.col("s_suppkey")
    m = v("supplier").select(k.alias("model_id"), (F.col("s_nationkey") % 4).alias("tier"), ((k % 9 + 1) * 4000).alias("context_limit"), ((k % 7 + 1) * 3000).alias("tpm"), ((k % 5) * 500).alias("used_tpm"), (k % 3).cast("double").alias("wait_s"), ((k % 2) * 2).cast("double").alias("penalty_s"), F.when(k % 11 == 0, 0).alias("left_today"))
    return P.eligible_models(m, 1, 8000).select("model_id", "rank")


@book.page("ll8_capacity", "", _MODELS + " select tier, count(*) as n, sum(tpm)::bigint as tpm, sum(used_tpm)::bigint as used from m group by all")
def ll8(v):
    k = F.col("s_suppkey")
    return v("supplier").groupBy((F.col("s_nationkey") % 4).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum((k % 7 + 1) * 3000).alias("tpm"), F.sum((k % 5) * 500).alias("used"))


@book.page("ll10_token_bucket")
def ll10(v):
    r = v("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), (F.col("event_id") % 50).cast("double").alias("cost"))
    return P.token_bucket(r, 0.01, 60.0)


@book.page("ll14_rendered_groups", "v_theses", "select framework_id, md5(string_agg(thesis_id||': '||substr(statement, 1, 220), chr(10) order by thesis_id)) as text_md5 from v_theses group by all")
def ll14(v):
    line = F.concat_ws(": ", "thesis_id", F.substring("statement", 1, 220))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("thesis_id", line.alias("t")))), lambda x: x["t"])
    return v("v_theses").groupBy("framework_id").agg(F.md5(F.array_join(lines, "\n").cast("binary")).alias("text_md5"))


# --- communities and sequential operators ---


@book.page("rg7_communities")
def rg7(v):
    return C.communities(bundles.edges(v))


@book.page("fn13_similarity")
def fn13(v):
    from quillstone.functions.text import source_norm

    return v("v_qa").select("conv_id", "turn", F.round(Z.sequence_similarity(F.col("answer"), F.col("gold"), source_norm), 4).alias("similarity"))


@book.page("ca13_adjudicated")
def ca13(v):
    g = v("v_concepts").groupBy("title", "cluster_id").agg(F.min("concept_id").alias("canonical_id"), F.array_sort(F.collect_set("concept_id")).alias("members"), F.min("seq").alias("seq"))
    d = g.select(F.col("cluster_id").alias("doc_id"), "seq", "canonical_id", "members")
    return Z.adjudicated(d, v("v_concepts").select(F.col("cluster_id").alias("doc_id"), "concept_id"))


@book.page("ca15_near_duplicate_texts")
def ca15(v):
    s = v("v_segments").select("doc_id", F.concat_ws("_", "doc_id", "seq").alias("id"), "seq", F.length("text").alias("score"), "text")
    return Z.near_duplicate_texts(s, "doc_id")


def safe(v):
    return Z.safe_distractors(bundles.pools(v)[1], v("v_concepts"))


@book.page("co13_safe_distractors")
def co13(v):
    return safe(v).select("concept_id", "distractor_id", "k")


@book.page("co14_choice_items")
def co14(v):
    return Z.choice_items(safe(v), v("v_concepts")).select("item_id", "concept_id", F.size("options").alias("n_options"))


@book.page("co15_statements")
def co15(v):
    c = v("v_concepts").select("concept_id", "definition", F.array(F.concat("definition", F.lit(" "), "definition")).alias("facets"))
    return Z.statements(safe(v), c).select("concept_id", "place", "polarity")


@book.page("co18_spread_candidates")
def co18(v):
    c = v("v_cases").where(F.trim("resolucion_esperada") != "").select("dominio", "case_id", F.substring("case_id", 2, 9).cast("long").alias("seq"), "primary_concept_id").withColumnRenamed("dominio", "doc_id")
    adj = graphs.ends(graphs.settled(v)).select(F.col("from_concept_id").alias("primary_concept_id"), F.col("to_concept_id").alias("concept_id")).distinct()
    return Z.spread_candidates(c, adj.withColumn("rank", F.col("concept_id")), key="primary_concept_id")


# --- views of the client ---


@book.page("ui1_search", "v_concepts", "select concept_id from v_concepts where contains(lower(title||' '||definition), 'large')")
def ui1(v):
    return v("v_concepts").where(F.contains(F.lower(F.concat_ws(" ", "title", "definition")), F.lit("large"))).select("concept_id")


@book.page("ui2_approval", "v_relations_raw", "select doc_id, seq, case when confidence >= 0.75 then 'aprobado' else 'borrador' end as status, case when confidence >= 0.75 then 'alta' when confidence >= 0.5 then 'media' else 'baja' end as band from v_relations_raw")
def ui2(v):
    c = F.col("confidence")
    return v("v_relations_raw").select("doc_id", "seq", F.when(c >= 0.75, "aprobado").otherwise("borrador").alias("status"), F.when(c >= 0.75, "alta").when(c >= 0.5, "media").otherwise("baja").alias("band"))


@book.page("ui3_scenarios_of_cases", "v_scenarios v_cases", "select parent_case_id, count(*) as n, count(*) filter (where trim(coalesce(resolucion_esperada, '')) = '') as without_gold from v_scenarios left join v_cases on parent_case_id = case_id group by all")
def ui3(v):
    c = v("v_cases").select(F.col("case_id").alias("parent_case_id"), "resolucion_esperada")
    return v("v_scenarios").join(c, "parent_case_id", "left").groupBy("parent_case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("resolucion_esperada", F.lit(""))) == "").alias("without_gold"))


@book.page("ui6_worked_concepts", "v_signals", "select student_id, count(distinct concept_id) as worked from v_signals where forma = 'escalar' group by all")
def ui6(v):
    return v("v_signals").where("forma = 'escalar'").groupBy("student_id").agg(F.count_distinct("concept_id").alias("worked"))


# --- streams ---


def signal_stream(v):
    """v_signals as a stream over the events' files."""
    events = stream(v.spark, v.sf_dir, "events")
    return profiles.weighted(lambda name: v.spark.sql(VIEWS[name].replace("from events", "from {events}"), events=events))


@book.page("st1_streamed_profile", "v_signals", profiles.PROFILE + " select * from p")
def st1(v):
    return T.finish(T.drained(T.running_profile(signal_stream(v)), "complete", "stream-profile"))


@book.page("st2_daily_counts", "v_signals", "select epoch_us(date_trunc('day', ts)) as day_us, dimension, count(*) as n from v_signals group by all")
def st2(v):
    s = signal_stream(v).withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.drained(T.daily_counts(s, "3650 days"), "complete", "stream-days")
    return out.select(F.unix_micros("day").alias("day_us"), "dimension", "n")


@book.page("st3_study_sessions", "v_signals", """with g as (select student_id, ts, case when ts - lag(ts) over (partition by student_id order by ts) < interval 30 minute then 0 else 1 end as cut from v_signals), s as (select *, sum(cut) over (partition by student_id order by ts rows unbounded preceding) as k from g),
 r as (select student_id, k, min(ts) as a, max(ts) as b, count(*) as n from s group by all) select student_id, epoch_us(a) as start_us, epoch_us(b) + 1800000000 as end_us, n from r""")
def st3(v):
    s = signal_stream(v).withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.drained(T.study_sessions(s, late="3650 days"), "complete", "stream-sessions")
    return out.select("student_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@book.page("st4_bet_gaps")
def st4(v):
    events = stream(v.spark, v.sf_dir, "events")
    bet = F.col("event_id") % 3 == 0
    value = F.when(bet, F.round(F.col("value") / 500, 2)).when(F.col("value") > 250, 1.0).otherwise(0.0)
    rows = events.select(F.col("user_id").alias("student_id"), F.concat(F.lit("i"), F.col("event_id") % 10).alias("item_id"), "event_id", F.when(bet, "bet").otherwise("result").alias("kind"), value.alias("value"))
    return T.drained(T.bet_gaps(rows), "append", "stream-bets", expires=True)
