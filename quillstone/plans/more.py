"""Plans of the remaining operators: tokens, keys, catalogue views, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import extract as X
from quillstone.functions import mechanics as M
from quillstone.functions import payloads as P
from quillstone.functions import text as T
from quillstone.operators import communities as C
from quillstone.operators import merge as MG
from quillstone.plans import bundles, coverages, material
from quillstone.plans.book import Book
from quillstone.plans.entities import NORM, PARTS, titled
from quillstone.plans.sessions import TOK
from quillstone.plans.texts import SOURCE
from quillstone.sources import store as S
from quillstone.sources.shared import written

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


@book.page("fn3_graph_norm", "", f"select item_id, {SOURCE('text')} as norm from benchmark")
def fn3(v):
    return v("benchmark").select("item_id", T.source_norm("text").alias("norm"))


@book.page("fn8_answer_tokens", "v_qa", f"select conv_id, turn, array_to_string(list_sort({TOK('answer')}), ' ') as tokens from v_qa")
def fn8(v):
    return v("v_qa").select("conv_id", "turn", F.array_join(F.array_sort(T.answer_tokens("answer")), " ").alias("tokens"))


@book.page("fn11_strict_acronym", "v_concepts", "select concept_id, nullif(regexp_extract(title||' ('||upper(substr(tipo, 1, 4))||')', '\\(([A-Z][A-Z0-9\\-]{1,9})\\)\\s*$', 1), '') as acronym from v_concepts")
def fn11(v):
    t = F.concat(F.col("title"), F.lit(" ("), F.upper(F.substring("tipo", 1, 4)), F.lit(")"))
    return v("v_concepts").select("concept_id", T.strict_acronym(t).alias("acronym"))


@book.page("fn14_containment", "", f"with p as (select item_id, item_id + 1 as other from benchmark), j as (select p.item_id, {TOK('a.text')} as a, {TOK('b.text')} as b from p join benchmark a on a.item_id = p.item_id join benchmark b on b.item_id = other) select item_id, round(case when len(b) = 0 then 0 else len(list_intersect(a, b)) / len(b) end, 4) as share from j")
def fn14(v):
    b = v("benchmark")
    p = b.select("item_id", (F.col("item_id") + 1).alias("other"))
    j = p.join(b.select("item_id", F.col("text").alias("a")), "item_id").join(b.select(F.col("item_id").alias("other"), F.col("text").alias("b")), "other")
    return j.select("item_id", F.round(T.containment(T.answer_tokens("a"), T.answer_tokens("b")), 4).alias("share"))


@book.page("gr4_term_present", "v_concepts", f"select concept_id, contains({SOURCE('text')}, {SOURCE('''split_part(title, ' ', 1)''')}) as present from v_concepts join documents on doc_id = seq")
def gr4(v):
    j = v("v_concepts").join(v("documents"), F.col("doc_id") == F.col("seq"))
    return j.select("concept_id", F.contains(T.source_norm("text"), T.source_norm(F.split_part("title", F.lit(" "), F.lit(1)))).alias("present"))


@book.page("mg1_keys", "v_concepts", f"with {PARTS} select distinct concept_id as uid, unnest(list_filter([nullif(t, ''), nullif(b, ''), '@'||a], lambda x: x is not null)) as key from p")
def mg1(v):
    return MG.keys(titled(v).select(F.col("concept_id").alias("uid"), "title", "definition")).select("uid", "key")


@book.page("mg7_one_document", "v_concepts", "select first_page as doc_id, count(*) as n, count(distinct title) as n_titles from v_concepts group by all")
def mg7(v):
    return v("v_concepts").groupBy(F.col("first_page").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("title").alias("n_titles"))


@book.page("ll7_acquired_model", "", material._MODELS + ", f as (select *, model_id % 4 as failures from m where context_limit >= 8000 and tpm >= 8000) select tier, arg_min(model_id, (failures, wait_s + penalty_s, model_id)) as model_id from f group by all")
def ll7(v):
    k = F.col("s_suppkey")
    m = v("supplier").select(k.alias("model_id"), (F.col("s_nationkey") % 4).alias("tier"), ((k % 9 + 1) * 4000).alias("context_limit"), ((k % 7 + 1) * 3000).alias("tpm"), ((k % 3) + (k % 2) * 2).cast("double").alias("cost"), (k % 4).alias("failures"))
    return m.where("context_limit >= 8000 and tpm >= 8000").groupBy("tier").agg(F.min_by("model_id", F.struct("failures", "cost", "model_id")).alias("model_id"))


@book.page("ui4_mechanics_by_family", "", f"select family, string_agg(mechanic_id, ',' order by mechanic_id) as mechanics from (values {', '.join(str((m, f)) for m, _, f in M.MECHANICS)}) t(mechanic_id, family) group by all")
def ui4(v):
    return M.mechanics(v.spark).groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("mechanic_id")), ",").alias("mechanics"))


@book.page("ui5_failed_layers", "", coverages._LAYERS + " select layer, count(*) as n_documents from r where status = 'failed' group by all")
def ui5(v):
    from quillstone.operators.coverage import layer_report

    return layer_report(coverages.layers(v)).where("status = 'failed'").groupBy("layer").agg(F.count(F.lit(1)).alias("n_documents"))


@book.page("io4_rows_with_ids", "", "select count(*) as n, count(*) as n_ids from events")
def io4(v):
    e = S.with_ids(v("events").withColumn("id", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@book.page("ll1_extracted_concepts")
def ll1(v):
    return X.extract(v("documents"))


@book.page("ll3_salvaged_lengths", "", "select event_id, length('{\"a\": ['||props||']}')::int as n from events")
def ll3_lengths(v):
    cut = F.concat(F.lit('{"a": ['), F.col("props"), F.lit(', {"k": '))
    return v("events").select("event_id", F.length(P.salvaged(cut)).alias("n"))


@book.page("rg8_split_communities")
def rg8(v):
    """All linked concepts as one community that is too large."""
    edges = written(bundles.edges(v).select("from_concept_id", "to_concept_id"), "community-graph")
    one = edges.select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("concept_id")).distinct().withColumn("label", F.lit("all"))
    return C.named(C.split(one, edges), edges)
