"""Queries over whole records: verification with reasons, typed assembly, deletions, kept results, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import grounding as G
from quillstone.operators import segment as S
from quillstone.operators import validate as V
from quillstone.operators.progress import Progress
from quillstone.plans.book import Book
from quillstone.plans.texts import _CLAIMS, SOURCE, claims
from quillstone.sources import store
from quillstone.sources.versions import Versions

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

# --- concepts that their documents don't support ---

_CONCEPTS = _CLAIMS.replace("f as (", "f as materialized (") + f""", wd as materialized (select doc_id, {SOURCE('text')} as s from documents), ws as (select doc_id, s, string_split(s, ' ') as w from wd),
ti as materialized (select doc_id, case doc_id % 4 when 0 then w[1]||' '||w[2] when 1 then 'zzzz ('||upper(w[1])||')' when 2 then 'qqq www' else 'qqq (ZZQ)' end as title, s from ws),
lv as materialized (select f.doc_id, title, case when f.doc_id % 7 = 0 then '' else trim(quote) end as quote, case when f.doc_id % 7 = 0 then false else found end as found, case when f.doc_id % 7 = 0 then 0 else similarity end as similarity, ((f.doc_id % 10) / 10)::double as c0,
 ti.s, {SOURCE("regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')")} as b, {SOURCE('title')} as t, lower(regexp_extract(title, '\\(([A-Z][A-Z0-9\\-]{{1,9}})\\)\\s*$', 1)) as a from f join ti using (doc_id) join c using (doc_id)),
dg as (select *, case when (b <> '' and contains(s, b)) or (t <> '' and contains(s, t)) then 'presente' when a <> '' and list_contains(string_split(s, ' '), a) then 'sigla' else 'ausente' end as diagnosis from lv),
vc as (select *, case when found then 'verificado' when diagnosis = 'presente' then 'parcial' else 'sin_anclaje' end as level, coalesce(nullif(c0, 0), 0.6) as conf from dg)"""


def concepts_of_documents(v):
    words = F.split(T.source_norm("text"), " ")
    word = lambda k: F.try_element_at(words, F.lit(k))
    k = F.col("doc_id") % 4
    title = F.when(k == 0, F.concat_ws(" ", word(1), word(2))).when(k == 1, F.concat(F.lit("zzzz ("), F.upper(word(1)), F.lit(")"))).when(k == 2, "qqq www").otherwise("qqq (ZZQ)")
    quote = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("quote"))
    return v("documents").select("doc_id", title.alias("title")).join(claims(v).select("doc_id", quote.alias("quote")), "doc_id").select("doc_id", F.concat(F.lit("c"), "doc_id").alias("concept_id"), "title", "quote", (F.col("doc_id") % 10 / 10).alias("confidence"))


@book.page("gr6_dropped_concepts", "", _CONCEPTS + f""" select 'c'||doc_id as concept_id, doc_id, title, quote, level, similarity, diagnosis, case level when 'parcial' then least(conf, 0.6) when 'sin_anclaje' then least(conf, 0.35) else conf end::double as confidence,
 case when level = 'sin_anclaje' then case when diagnosis = 'sigla' then '{G.INVENTED}' else '{G.ABSENT}' end end as reason, case when level = 'sin_anclaje' then substr(quote, 1, 160) end as stated from vc""")
def gr6_dropped(v):
    return G.verified_concepts(concepts_of_documents(v), v("documents"))


@book.page("gr6_counts", "", _CONCEPTS + """ select doc_id % 10 as doc_id, count(*) filter (where level = 'verificado') as verified, count(*) filter (where quote = '') as without_quote, count(*) filter (where level = 'parcial' and quote <> '') as quote_not_found,
 count(*) filter (where level = 'sin_anclaje') as title_absent, count(*) filter (where level = 'sin_anclaje' and diagnosis = 'sigla') as acronym_invented, count(*) filter (where level = 'sin_anclaje') as dropped from vc group by 1""")
def gr6_counts(v):
    found = G.verified_concepts(concepts_of_documents(v), v("documents"))
    return G.verification_counts(found.withColumn("doc_id", F.col("doc_id") % 10))


# --- everything of a document in one record; a concept's first page stands for its document ---


@book.page("va15_records", "v_concepts v_theses", """with r as (select distinct first_page as doc_id, 'doc '||first_page as title from v_concepts), c as (select first_page as doc_id, to_json(list({'concept_id': concept_id, 'title': title, 'importance': round(importance * 100)::bigint} order by seq))::varchar as j, count(*) as n from v_concepts where definition not like '%ECONOMY%' group by all),
t as (select *, substr(concept_id, 2)::int % 40 + 1 as doc_id, substr(thesis_id, 2)::bigint as seq from v_theses), tj as (select doc_id, to_json(list({'thesis_id': thesis_id, 'statement': statement} order by seq))::varchar as j from t where refutation_criterion <> 'generic criterion' group by all),
b as (select doc_id, string_agg(list||':'||seq||':'||err, ',' order by list, seq) as rejects from (select first_page as doc_id, 'concepts' as list, seq, 'economy' as err from v_concepts where definition like '%ECONOMY%' union all select doc_id, 'theses', seq, 'generic' from t where refutation_criterion = 'generic criterion'
 union all select doc_id, 'root', null, 'seventh' from r where doc_id % 7 = 0) group by all)
select doc_id, case when doc_id % 7 > 0 then '{"doc_id":'||doc_id||',"title":"'||title||'","concepts":'||coalesce(c.j, '[]')||',"theses":'||coalesce(tj.j, '[]')||'}' end as record, coalesce(rejects, '') as rejects from r left join c using (doc_id) left join tj using (doc_id) left join b using (doc_id)""".replace("list||':'||seq||':'||err", "list||':'||coalesce(seq::varchar, '')||':'||err"))
def va15(v):
    root = v("v_concepts").select(F.col("first_page").alias("doc_id")).distinct().withColumn("title", F.concat(F.lit("doc "), "doc_id"))
    c = v("v_concepts").select(F.col("first_page").alias("doc_id"), "seq", "concept_id", "title", F.round(F.col("importance") * 100).cast("long").alias("importance"), "definition")
    t = v("v_theses").select((F.substring("concept_id", 2, 9).cast("int") % 40 + 1).alias("doc_id"), F.substring("thesis_id", 2, 9).cast("long").alias("seq"), "thesis_id", "statement", "refutation_criterion")
    rules = {"root": {"seventh": F.col("doc_id") % 7 > 0}, "concepts": {"economy": ~F.contains("definition", F.lit("ECONOMY"))}, "theses": {"generic": F.col("refutation_criterion") != "generic criterion"}}
    out = V.assembled(root, {"concepts": c, "theses": t}, rules)
    shown = lambda x, *names: F.transform(x, lambda r: F.struct(*[r[n] for n in names]))
    record = F.struct(F.col("record.doc_id"), F.col("record.title"), shown(F.col("record.concepts"), "concept_id", "title", "importance").alias("concepts"), shown(F.col("record.theses"), "thesis_id", "statement").alias("theses"))
    told = F.transform("rejects", lambda x: F.concat_ws(":", x["list"], F.coalesce(x["seq"].cast("string"), F.lit("")), F.array_join(x["errors"], "+")))
    return out.select("doc_id", F.when(F.col("record").isNotNull(), F.to_json(record)).alias("record"), F.array_join(told, ",").alias("rejects"))


# --- deletions and results that are kept ---


@book.page("io8_deleted_tree", "", """with c as (select * from customer where c_nationkey <> 3), o as (select * from orders where o_custkey is null or o_custkey not in (select c_custkey from customer where c_nationkey = 3)),
go as (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)), l as (select * from lineitem where l_orderkey not in (select o_orderkey from go))
select 'customer' as name, count(*) as n from c union all select 'lineitem', count(*) from l union all select 'orders', count(*) from o""")
def io8_tree(v):
    tables = {t: v(t) for t in ("customer", "orders", "lineitem")}
    gone = v("customer").where("c_nationkey = 3").select("c_custkey")
    left = store.delete_tree(tables, {"lineitem": ("orders", "l_orderkey", "o_orderkey"), "orders": ("customer", "o_custkey", "c_custkey")}, "customer", gone)
    out = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@book.page("mg8_kept_plans", "v_concepts", """with d as (select (first_page % 10)::varchar as owner, first_page, title from v_concepts where first_page <> 13)
select owner, count(distinct first_page) as n_documents, count(distinct title) as n_titles, owner = '3' as built from d group by owner""")
def mg8(v):
    """Plans of students (ten documents each kind) after a document of the fourth is gone: only that plan is made anew."""
    docs = v("v_concepts").select((F.col("first_page") % 10).alias("owner"), "first_page", "title")
    build = lambda rows: rows.groupBy("owner").agg(F.count_distinct("first_page").alias("n_documents"), F.count_distinct("title").alias("n_titles"))
    kept = Versions(v.spark)
    kept.get(docs, build)
    return kept.get(docs.where("first_page != 13"), build)


@book.page("ll12_layers", "v_segments", """with s as (select count(*) as n, count(*) filter (where length(text) > 100) as m from v_segments) select unnest(['segments', 'long', 'none', 'broken', 'documents']) as layer, unnest(['ok', 'ok', 'empty', 'failed', 'ok']) as status, unnest([n, m, 0, 0, (select count(*) from documents)]) as items, unnest([0.2, 0.4, 0.6, 0.8, 1.0])::double as fraction from s""")
def ll12(v):
    """Layers over documents, one empty and one that fails; counted while they are written."""
    told = []
    run = Progress(["segments", "long", "none", "broken", "documents"], lambda x: told.append((x["last"]["layer"], x["last"]["status"], x["last"]["items"], x["fraction"])))
    lines = run.run("segments", lambda: v("v_segments").withColumn("chars", F.length("text")))
    run.run("long", lambda: lines.where("chars > 100"))
    run.run("none", lambda: lines.where("chars < 0"))
    run.run("broken", lambda: lines.where("no_such_column > 0"))
    run.run("documents", lambda: S.batches_across(v("documents").withColumn("seq", F.col("doc_id")), 3, ("lang",)))
    return v.spark.createDataFrame(told, "layer string, status string, items long, fraction double")
