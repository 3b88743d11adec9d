"""Queries over merged documents: every list rewritten, reports, united near-duplicates. A concept's first page stands for its document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import merge as M
from quillstone.operators import similar as Z
from quillstone.plans.book import Book
from quillstone.plans.material import UID, uids

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

#: Concepts of the same title are one; its id is that of the first.
_GROUPS = f"""g as (select first_page as doc_id, concept_id as id, first_value(concept_id) over (partition by title order by {UID}) as canonical from v_concepts), valid as (select distinct canonical as v from g)"""


def _steps(name: str, columns: str, rows: str, known: bool, keep: str = "true", last: str = "") -> str:
    """Rewrites the list ids of x (key, doc_id, ids, and columns): each id by itself, then together again in their order."""
    new = "coalesce(canonical, v)" if known else "coalesce(canonical, e.id)"
    return f"""with {_GROUPS}, x as ({rows}), e as (select key, doc_id, generate_subscripts(ids, 1) as k, unnest(ids) as id from x),
r as (select key, string_agg({new}, ',' order by k) as ids, arg_min({new}, k) as first from e left join g on g.doc_id = e.doc_id and g.id = e.id left join valid on v = e.id where {new} is not null group by key),
p as (select x.*, coalesce(canonical, one) as one_new from x left join g on g.doc_id = x.doc_id and g.id = x.one)
select {columns} from p left join r using (key) where {keep}"""


def groups(v):
    u = uids(v)
    of = M.matched(u).join(u.select("uid", F.col("doc_id"), F.col("concept_id").alias("id")), "uid")
    return of.join(u.select(F.col("uid").alias("canonical"), F.col("concept_id").alias("new")), "canonical").select("doc_id", "id", F.col("new").alias("canonical"))


def _n(c):
    return F.substring(c, 2, 9).cast("int")


def _c(n):
    return F.concat(F.lit("c"), n.cast("string"))


def lists(v):
    """The lists of documents: most references are to concepts of the same document, some aren't."""
    rep, case, sc, th, fr = _n("concept_id"), _n("primary_concept_id"), _n("concept_id"), _n("concept_id"), _n("framework_id")
    return {
        "repertoires": v("v_repertoires").select(F.when(rep % 3 == 0, 7).otherwise(rep % 40 + 1).alias("doc_id"), F.col("repertoire_id").alias("id"), "concept_id", "concepto_confundido"),
        "cases": v("v_cases").select((case % 40 + 1).alias("doc_id"), F.col("case_id").alias("id"), F.array("primary_concept_id", _c(case + 40), _c(case * 7 % 220)).alias("concept_ids"), F.when(case % 5 > 0, F.col("primary_concept_id")).alias("primary_concept_id")),
        "scenarios": v("v_scenarios").select(F.when(sc % 3 == 0, 5).otherwise(sc % 40 + 1).alias("doc_id"), F.col("scenario_id").alias("id"), "parent_case_id", F.array("concept_id", _c((sc + 80) % 220)).alias("concept_ids")),
        "theses": v("v_theses").select((th % 40 + 1).alias("doc_id"), F.col("thesis_id").alias("id"), F.when(th % 4 > 0, F.col("framework_id")).alias("framework_id"), F.array("concept_id", _c(th + 1)).alias("concept_ids")),
        "frameworks": v("v_frameworks").select((fr + 1).alias("doc_id"), F.col("framework_id").alias("id"), F.array("rival_id").alias("rivales"), F.array(_c(fr), _c(fr + 39)).alias("concept_ids")),
        "concepts": v("v_concepts").select(F.col("first_page").alias("doc_id"), "concept_id", F.array(*[F.struct(_c(F.col("seq") * k + 40).alias("from_concept"), F.lit(k).alias("k")) for k in (1, 3)]).alias("distinctions")),
    }


def rewritten(v, name):
    """One list; the others only add ids of other documents that theirs refer to."""
    return M.rewritten_lists({name: lists(v)[name]}, groups(v))[name]


@book.page("mg5_repertoires", "v_concepts v_repertoires", f"""with {_GROUPS}, x as (select *, case when substr(concept_id, 2)::int % 3 = 0 then 7 else substr(concept_id, 2)::int % 40 + 1 end as doc_id from v_repertoires)
select x.doc_id, repertoire_id||'__'||x.doc_id as id, coalesce(a.canonical, v) as concept_id, coalesce(b.canonical, concepto_confundido) as concepto_confundido
from x left join g a on a.doc_id = x.doc_id and a.id = x.concept_id left join valid on v = x.concept_id left join g b on b.doc_id = x.doc_id and b.id = concepto_confundido where coalesce(a.canonical, v) is not null""")
def mg5_repertoires(v):
    return rewritten(v, "repertoires")


@book.page("mg5_cases", "v_concepts v_cases", _steps("cases", "doc_id, key||'__'||doc_id as id, ids as concept_ids, coalesce(one_new, first) as primary_concept_id", "select case_id as key, n % 40 + 1 as doc_id, [primary_concept_id, 'c'||(n + 40), 'c'||(n * 7 % 220)] as ids, case when n % 5 > 0 then primary_concept_id end as one from (select *, substr(primary_concept_id, 2)::int as n from v_cases)", True, "r.ids is not null").replace("ids as concept_ids", "r.ids as concept_ids"))
def mg5_cases(v):
    return rewritten(v, "cases").withColumn("concept_ids", F.array_join("concept_ids", ","))


@book.page("mg5_scenarios", "v_concepts v_scenarios", _steps("scenarios", "doc_id, key||'__'||doc_id as id, parent_case_id||'__'||doc_id as parent_case_id, coalesce(r.ids, '') as concept_ids", "select scenario_id as key, parent_case_id, case when n % 3 = 0 then 5 else n % 40 + 1 end as doc_id, [concept_id, 'c'||((n + 80) % 220)] as ids, null::varchar as one from (select *, substr(concept_id, 2)::int as n from v_scenarios)", True))
def mg5_scenarios(v):
    return rewritten(v, "scenarios").withColumn("concept_ids", F.array_join("concept_ids", ","))


@book.page("mg5_theses", "v_concepts v_theses", _steps("theses", "doc_id, key||'__'||doc_id as id, framework_id||'__'||doc_id as framework_id, coalesce(r.ids, '') as concept_ids", "select thesis_id as key, case when n % 4 > 0 then framework_id end as framework_id, n % 40 + 1 as doc_id, [concept_id, 'c'||(n + 1)] as ids, null::varchar as one from (select *, substr(concept_id, 2)::int as n from v_theses)", True))
def mg5_theses(v):
    return rewritten(v, "theses").withColumn("concept_ids", F.array_join("concept_ids", ","))


@book.page("mg5_frameworks", "v_concepts v_frameworks", _steps("frameworks", "doc_id, key||'__'||doc_id as id, rival_id||'__'||doc_id as rivales, r.ids as concept_ids", "select framework_id as key, rival_id, n + 1 as doc_id, ['c'||n, 'c'||(n + 39)] as ids, null::varchar as one from (select *, substr(framework_id, 2)::int as n from v_frameworks)", False))
def mg5_frameworks(v):
    return rewritten(v, "frameworks").withColumns({c: F.array_join(c, ",") for c in ("rivales", "concept_ids")})


@book.page("mg5_distinctions", "v_concepts", _steps("concepts", "doc_id, key as concept_id, r.ids as distinctions", "select concept_id as key, first_page as doc_id, ['c'||(seq + 40), 'c'||(seq * 3 + 40)] as ids, null::varchar as one from v_concepts", False))
def mg5_distinctions(v):
    return rewritten(v, "concepts").withColumn("distinctions", F.array_join(F.transform("distinctions", lambda x: x["from_concept"]), ","))


@book.page("mg6_documents", "v_concepts v_theses v_cases", f"""with {_GROUPS}, c as (select doc_id, count(*) as n_concepts, count(*) filter (where canonical = id) as n_own, count(*) filter (where canonical <> id) as n_joined from g group by all),
t as (select substr(concept_id, 2)::int % 40 + 1 as doc_id, count(*) as n_theses from v_theses group by all), k as (select substr(primary_concept_id, 2)::int % 40 + 1 as doc_id, count(*) as n_cases from v_cases group by all)
select doc_id, coalesce(n_concepts, 0) as n_concepts, coalesce(n_own, 0) as n_own, coalesce(n_joined, 0) as n_joined, coalesce(n_theses, 0) as n_theses, coalesce(n_cases, 0) as n_cases from c full join t using (doc_id) full join k using (doc_id)""")
def mg6_documents(v):
    own = lists(v)
    return M.fusion_report({k: own[k] for k in ("theses", "cases")}, groups(v))


@book.page("mg6_fusions", "v_concepts", f"""with u as (select {UID} as uid, title, concept_id, first_value({UID}) over (partition by title order by {UID}) as canonical from v_concepts)
select 'fusionada' as kind, uid, title, row_number() over (order by uid)::int as rank from u where uid <> canonical order by uid limit 50""")
def mg6_fusions(v):
    u = uids(v)
    return M.fusions(u, M.matched(u), M.kept_apart(u))


@book.page("ca15_united_lists")
def ca15_united(v):
    """Each line of a document as a thesis; its arguments are its neighbours and its long words."""
    s = v("v_segments").withColumn("id", F.concat_ws("_", "doc_id", "seq"))
    near = F.transform(F.array(F.lit(-1), F.lit(1)), lambda k: F.concat_ws("_", F.col("doc_id"), F.col("seq") + k))
    rows = s.select("doc_id", "id", near.alias("rivals"), F.filter(F.split("text", " "), lambda w: F.length(w) > 9).alias("criteria"))
    absorbed = Z.near_duplicate_texts(s.select("doc_id", "id", "seq", F.length("text").alias("score"), "text"), "doc_id")
    return Z.united(rows, absorbed, "doc_id", ["rivals", "criteria"], 12).withColumns({c: F.array_join(c, ",") for c in ("aliases", "rivals", "criteria")})
