"""Queries over what a bundle rejects, counts and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import compiler as K
from quillstone.operators import similar as Z
from quillstone.plans import bundles
from quillstone.plans.book import Book
from quillstone.plans.bundles import BASE, POOL, edges, pools
from quillstone.plans.entities import NORM

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def page(name, body, more=""):
    return book.page(name, f"v_relations_raw v_concepts {more}", BASE + body)


_FORMS = f"""with e as (select distinct concept_id, {NORM('form')} as norm from (select concept_id, unnest([title, case when seq % 3 = 0 then substr(cluster_id, 1, 2) else 'alias '||concept_id end]) as form from v_concepts)), n as (select norm, count(distinct concept_id) as n from e where norm <> '' group by all),
a as (select concept_id, list(norm order by norm) filter (where n = 1 and length(norm) >= 4) as accepted, list(norm order by norm) filter (where n > 1) as ambiguous from e join n using (norm) group by concept_id)"""


def forms(v):
    other = F.when(F.col("seq") % 3 == 0, F.substring("cluster_id", 1, 2)).otherwise(F.concat(F.lit("alias "), "concept_id"))
    return K.accepted_forms(v("v_concepts").select("concept_id", F.array("title", other).alias("forms")))


@book.page("co21_form_rejections", "v_concepts", _FORMS + f""" select 'A3' as mechanic_id, concept_id as source_id, null::varchar as detail, case when len(coalesce(ambiguous, [])) > 0 then replace('{K.REASONS['claimed']}', '{{}}', array_to_string(ambiguous[1:2], ', ')) else '{K.REASONS['bodiless']}' end as reason from a where len(coalesce(accepted, [])) = 0""")
def co21_forms(v):
    return K.form_rejections(forms(v))


def spread(v):
    """Cases whose main concept has neighbours."""
    e = edges(v)
    ends = e.select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("primary_concept_id")).distinct()
    return v("v_cases").join(ends, "primary_concept_id", "left_semi").select("case_id")


_CASE_REJECTS = f""", ne as (select f as c from eg union select t from eg), rj as (select 'B2' as mechanic_id, case_id as source_id, null::varchar as detail, '{K.REASONS['none']}' as reason from v_cases where primary_concept_id not in (select c from ne)
 union all select 'E1', case_id, null, '{K.REASONS['told']}' from v_cases where trim(resolucion_esperada) <> '' and not prediction_enabled)"""


@page("co21_case_rejections", _CASE_REJECTS + " select * from rj", "v_cases")
def co21_cases(v):
    return K.case_rejections(v("v_cases"), spread(v))


@book.page("co21_all_rejections")
def co21_all(v):
    pool = pools(v)[1].join(v("v_concepts").select("concept_id", "definition"), "concept_id")
    pool = pool.withColumn("similarity", Z.sequence_similarity(F.col("text"), F.col("definition"), T.source_norm))
    limits = v("v_concepts").select("concept_id", (F.col("seq") % 3 + 3).cast("int").alias("n_options"))
    return reduce(DataFrame.unionByName, (K.choice_rejections(pool, limits), K.form_rejections(forms(v)), K.case_rejections(v("v_cases"), spread(v))))


@page("co28_counts", POOL + " select (select count(*) from eg join (select least(f, t) as a, greatest(f, t) as b from eg group by all having count(distinct relation_type) > 1) p on least(f, t) = a and greatest(f, t) = b) as several_types, (select count(*) from pool where origin <> 'vecino' and length(text) > 0) as own, (select count(*) from pool where origin = 'vecino') as derived", "v_repertoires")
def co28_counts(v):
    pool = pools(v)[1].select(F.col("text").alias("explanation"), (F.col("origin") == "vecino").alias("derived"))
    return K.several_types(edges(v)).withColumnRenamed("n", "several_types").join(F.broadcast(K.explanation_sources(pool)))


@page("co30_all_stats", POOL + _CASE_REJECTS + """, it as (select 'C1' as m from (select distinct least(f, t), greatest(f, t) from eg) union all select 'E1' from v_cases where trim(resolucion_esperada) <> '' and prediction_enabled union all select 'E3' from v_cases where trim(resolucion_esperada) <> ''),
 x as (select unnest([{'name': 'concepts', 'n': (select count(*) from v_concepts)}, {'name': 'edges', 'n': (select count(*) from eg)}, {'name': 'asserted', 'n': (select count(*) from eg where confidence >= 0.6)}, {'name': 'inferred', 'n': (select count(*) from eg where confidence < 0.6)}, {'name': 'items', 'n': (select count(*) from it)},
  {'name': 'mechanics', 'n': 3}, {'name': 'mechanics_available', 'n': 3}, {'name': 'mechanics_playable', 'n': 2}, {'name': 'distractors', 'n': (select count(*) from pool)}, {'name': 'rejected', 'n': (select count(*) from rj)}, {'name': 'units', 'n': (select count(distinct cluster_id) from v_concepts)}], recursive := true))
 select name, n::bigint as n from x union all select 'items:'||m, count(*) from it group by m""", "v_repertoires v_cases")
def co30_all(v):
    items = K.relation_items(edges(v), bundles.rarity(v)).select(F.lit("C1").alias("mechanic_id")).unionByName(K.case_items(v("v_cases")).select("mechanic_id"))
    verdicts = items.distinct().withColumn("available", F.lit(True)).withColumn("playable", F.col("mechanic_id") != "E3")
    return K.bundle_stats(v("v_concepts"), edges(v), items, verdicts, pools(v)[1], K.case_rejections(v("v_cases"), spread(v)), v("v_concepts").select("cluster_id").distinct())


@book.page("co30_no_links", "v_theses v_concepts", "select thesis_id, concept_id as a, 'c'||substr(framework_id, 2)::int * 90 as b from v_theses where concept_id in (select concept_id from v_concepts) and 'c'||substr(framework_id, 2)::int * 90 in (select concept_id from v_concepts)")
def co30_no_links(v):
    pairs = v("v_theses").select("thesis_id", F.col("concept_id").alias("a"), F.concat(F.lit("c"), F.substring("framework_id", 2, 9).cast("int") * 90).alias("b"))
    return K.no_links(pairs, v("v_concepts"))


@book.page("cv5_meta_lists", "v_concepts", """select first_page as doc_id, coalesce(string_agg(concept_id, ',' order by seq) filter (where is_gateway), '') as gateways, coalesce(string_agg(concept_id, ',' order by seq) filter (where is_threshold), '') as thresholds, count(*) filter (where d = 'basico') as n_basico, count(*) filter (where d = 'intermedio') as n_intermedio, count(*) filter (where d = 'avanzado') as n_avanzado
 from (select *, case when seq % 10 = 0 then 'otro' when seq % 10 = 1 then 'intermedio' else difficulty end as d from v_concepts) group by all""")
def cv5_lists(v):
    d = F.when(F.col("seq") % 10 == 0, "otro").when(F.col("seq") % 10 == 1, F.lit(None)).otherwise(F.col("difficulty"))
    out = K.meta_lists(v("v_concepts").withColumn("difficulty", d).withColumnRenamed("first_page", "doc_id"))
    return out.withColumns({k: F.array_join(k, ",") for k in ("gateways", "thresholds")})
