"""Plans of validation and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import STOP_WORDS, acronym_split, title_norm
from quillstone.operators import resolve as E
from quillstone.operators import validate as V
from quillstone.plans.book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

DOMAIN = lambda c: f"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g'))"


@book.page("va1_valid_cases", "v_cases", """select case_id, array_to_string(list_filter([case when coalesce(resolucion_esperada <> '', false) then null else 'gold' end, case when coalesce(length(dominio) > 6, false) then null else 'domain' end], lambda x: x is not null), ',') as errors from v_cases""")
def va1(v):
    rules = {"gold": F.col("resolucion_esperada") != "", "domain": F.length("dominio") > 6}
    return V.checked(v("v_cases"), rules).select("case_id", F.array_join("errors", ",").alias("errors"))


@book.page("va3_pruned_references", "v_scenarios v_concepts", """with s as (select parent_case_id, string_agg(concept_id, ',' order by scenario_id) filter (where concept_id in (select concept_id from v_concepts)) as ids from v_scenarios group by all)
select parent_case_id, ids from s where ids is not null""")
def va3(v):
    rows = v("v_scenarios").groupBy("parent_case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("scenario_id", "concept_id"))), lambda x: x["concept_id"]).alias("ids"))
    return V.pruned(rows, "parent_case_id", "ids", v("v_concepts"), "concept_id").select("parent_case_id", F.array_join("ids", ",").alias("ids"))


@book.page("va4_domain_collisions", "v_cases v_scenarios", f"""with u as (select dominio as raw from v_cases union all select dominio from v_scenarios), n as (select raw, {DOMAIN('raw')} as norm from u)
select norm, string_agg(distinct raw, '|' order by raw) as spellings, count(*) as n from n where norm <> '' group by norm having count(distinct raw) > 1""")
def va4(v):
    raw = v("v_cases").select(F.col("dominio").alias("raw")).unionByName(v("v_scenarios").select(F.col("dominio").alias("raw")))
    return V.domain_collisions(raw).select("norm", F.array_join("spellings", "|").alias("spellings"), "n")


@book.page("va5_distinctions", "v_concepts", """select concept_id, (case when 'c'||cast(seq % 50 as string) <> concept_id and seq % 3 <> 0 then 1 else 0 end) as n_kept from v_concepts""")
def va5(v):
    c = v("v_concepts")
    made = F.array(F.struct(F.concat(F.lit("c"), F.col("seq") % 50).alias("from_concept"), F.when(F.col("seq") % 3 == 0, " N/A ").otherwise(F.col("definition")).alias("difference")))
    return c.select("concept_id", F.size(V.real_distinctions(made, F.col("concept_id"))).alias("n_kept"))


@book.page("va6_synonyms", "v_concepts", """select concept_id, array_to_string(list_filter([split_part(title, ' ', 1), upper(substr(title, 1, 4)), tipo], lambda s: not (not (s = upper(s) and s <> lower(s) and length(s) <= 6)
 and len(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3 and starts_with(lower(s), substr(w, 1, 5)))) > 0)), ',') as synonyms from v_concepts""")
def va6(v):
    syn = F.array(F.split_part("title", F.lit(" "), F.lit(1)), F.upper(F.substring("title", 1, 4)), F.col("tipo"))
    return v("v_concepts").select("concept_id", F.array_join(V.without_fragments(syn, F.col("title")), ",").alias("synonyms"))


@book.page("va7_generic_criteria", "v_theses", """select thesis_id from (select thesis_id, count(*) over (partition by lower(regexp_replace(trim(refutation_criterion), '\\s+', ' ', 'g'))) as n from v_theses) where n < 3""")
def va7(v):
    return V.without_generic(v("v_theses"), "thesis_id", "refutation_criterion").select("thesis_id")


@book.page("va8_transfer_distance", "v_scenarios v_cases", f"""with j as (select scenario_id, distancia, {DOMAIN('s.dominio')} as d, {DOMAIN('c.dominio')} as e from v_scenarios s join v_cases c on parent_case_id = case_id)
select scenario_id, case when d <> '' and e <> '' and d <> e then 'lejana' when d <> '' and e <> '' then case when distancia in ('cercana','media') then distancia else 'media' end
 when distancia in ('cercana','media','lejana') then distancia else 'media' end as distancia from j""")
def va8(v):
    return V.transfer_distance(v("v_scenarios"), v("v_cases")).select("scenario_id", "distancia")


@book.page("va9_framework_rivals", "v_frameworks", "select framework_id, case when rival_id <> framework_id and rival_id in (select framework_id from v_frameworks) then rival_id end as rival_id from v_frameworks")
def va9(v):
    f = v("v_frameworks")
    return V.without_dangling(f, "framework_id", "rival_id", f, "framework_id").select("framework_id", "rival_id")


@book.page("va10_thesis_framework", "v_theses v_frameworks", "select thesis_id, f.framework_id from v_theses t left join v_frameworks f on t.framework_id = f.framework_id")
def va10(v):
    return V.without_dangling(v("v_theses"), "thesis_id", "framework_id", v("v_frameworks"), "framework_id").select("thesis_id", "framework_id")


@book.page("va11_nested_references", "v_theses", """with g as (select framework_id, [list(concept_id order by thesis_id), list('c'||substr(framework_id, 2) order by thesis_id)] as ll from v_theses group by all)
select framework_id, array_to_string(list_transform(ll, lambda l: array_to_string(list_filter(l, lambda x: length(x) = 2), ',')), ';') as lists from g""")
def va11(v):
    valid = F.array(*[F.lit(f"c{k}") for k in range(10)])
    names = F.transform(F.array_sort(F.collect_list(F.struct("thesis_id", "concept_id"))), lambda x: x["concept_id"])
    own = F.transform(F.collect_list("framework_id"), lambda x: F.concat(F.lit("c"), F.substring(x, 2, 9)))
    g = v("v_theses").groupBy("framework_id").agg(F.array(names, own).alias("ll"))
    return g.select("framework_id", F.array_join(F.transform(V.nested_pruned(F.col("ll"), valid), lambda x: F.array_join(x, ",")), ";").alias("lists"))


@book.page("va12_scenario_parents", "v_scenarios v_cases", "select scenario_id from v_scenarios where parent_case_id in (select case_id from v_cases)")
def va12(v):
    return v("v_scenarios").join(v("v_cases").select(F.col("case_id").alias("parent_case_id")), "parent_case_id", "left_semi").select("scenario_id")


@book.page("va13_clusters", "v_theses v_concepts", "select framework_id as cluster_id, count(*) as n from v_theses where concept_id in (select concept_id from v_concepts) group by all having count(*) >= 2")
def va13(v):
    known = v("v_theses").join(v("v_concepts").select("concept_id"), "concept_id", "left_semi")
    return known.groupBy(F.col("framework_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@book.page("va14_totals", "v_concepts v_relations_raw", """select (select count(*) from v_concepts) as n_concepts, (select count(*) from v_relations_raw) as n_relations,
 (select count(*) from v_concepts where importance / 10 < 0.5) + (select count(*) from v_relations_raw where confidence < 0.5) as low_confidence""")
def va14(v):
    return V.totals(v("v_concepts").select((F.col("importance") / 10).alias("confidence")), v("v_relations_raw").select("confidence"))


#: Titles with acronyms, so that resolution has something to decide.
TITLES = """c as (select concept_id, seq, case when seq % 6 = 0 then title||' ('||upper(substr(title, 1, 3))||')' when seq % 6 = 1 then upper(substr(title, 1, 3)) else title end as title, definition, importance, is_gateway, is_threshold, is_enriched, first_page from v_concepts)"""
STOP = "', '".join(STOP_WORDS)
NORM = lambda c: f"""array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ('{STOP}')), lambda w: case when length(w) > 3 and w[-1:] = 's' then w[:-2] else w end), ' ')"""
PARTS = f"""{TITLES}, x as (select *, regexp_extract(title, '^(.*?)\\s*\\(([^)]{{2,24}})\\)\\s*$', 2) as i, regexp_extract(title, '^(.*?)\\s*\\(([^)]{{2,24}})\\)\\s*$', 1) as base0 from c),
y as (select *, i <> '' and not regexp_matches(i, '[,/ ]') and length(regexp_replace(i, '\\P{{L}}', '', 'g')) > 0 and length(regexp_replace(i, '\\P{{Lu}}', '', 'g')) >= 0.6 * length(regexp_replace(i, '\\P{{L}}', '', 'g')) as good from x),
p as (select concept_id, title, {NORM('title')} as t, {NORM('case when good then base0 else title end')} as b, nullif(case when good then {NORM('i')} end, '') as a from y),
amb as (select a, count(distinct b) as n_bases from p where a is not null group by a having count(distinct b) > 1),
k as (select concept_id, unnest(list_distinct([t, b])) as key from p union all select concept_id, '@'||a from (select concept_id, a from p union select concept_id, t from p) where a in (select a from p where a is not null) and a not in (select a from amb))"""


def titled(v, acronym=lambda t: F.upper(F.substring(t, 1, 3))):
    t = F.col("title")
    head = acronym(t)
    return v("v_concepts").withColumn("title", F.when(F.col("seq") % 6 == 0, F.concat(t, F.lit(" ("), head, F.lit(")"))).when(F.col("seq") % 6 == 1, head).otherwise(t))


@book.page("ca1_extraction_count", "v_concepts", f"with {TITLES} select concept_id, count(*) over (partition by coalesce(nullif({NORM('title')}, ''), concept_id)) as n_extracted from c")
def ca1(v):
    return E.extraction_counts(titled(v)).select("concept_id", "n_extracted")


@book.page("ca2_first_wins", "v_concepts", "select title, arg_min(concept_id, seq) as concept_id, min(seq) as seq from v_concepts group by title")
def ca2(v):
    return E.first_of(v("v_concepts").select("title", "concept_id", "seq"), ["title"], "seq")


@book.page("ca3_structural_keys", "v_concepts", f"with {PARTS} select * from k where key <> ''")
def ca3(v):
    return E.structural_keys(titled(v))


@book.page("ca4_ambiguous_acronyms", "v_concepts", f"with {PARTS} select * from amb")
def ca4(v):
    return E.ambiguous_acronyms(E.title_parts(titled(v)))


COMPONENTS = f"""with recursive {{views}}{PARTS}, e as (select distinct x.concept_id as a, y.concept_id as b from k x join k y on x.key = y.key and x.key <> ''),
r(node, root) as (select concept_id, concept_id from c union select e.b, r.root from r join e on e.a = r.node), g as (select node as concept_id, min(root) as component from r group by node)"""


#: Titles in blocks: an owner of an acronym, the bare acronym and the base title, which merge, and six equal ones, which are too many.
BLOCKS = "case seq % 6 when 0 then 'Base'||(seq // 6)||' index (BX'||(seq // 6)||')' when 1 then 'BX'||(seq // 6) when 2 then 'Base'||(seq // 6)||' index' else 'Same'||(seq // 12) end as title"

BLOCK_TITLES = f"c as (select concept_id, seq, {BLOCKS}, definition, importance, is_gateway, is_threshold, is_enriched, first_page from v_concepts)"


def blocks(v):
    i = F.col("seq")
    n = lambda k: F.floor(i / k).cast("string")
    base, acronym = F.concat(F.lit("Base"), n(6), F.lit(" index")), F.concat(F.lit("BX"), n(6))
    title = F.when(i % 6 == 0, F.concat(base, F.lit(" ("), acronym, F.lit(")"))).when(i % 6 == 1, acronym).when(i % 6 == 2, base)
    return v("v_concepts").withColumn("title", title.otherwise(F.concat(F.lit("Same"), n(12))))


def component_oracle(body: str, titles: str = TITLES) -> str:
    from quillstone.sources.fixtures import VIEWS

    return COMPONENTS.replace(TITLES, titles).replace("{views}", f"v_concepts as ({VIEWS['v_concepts']}), ") + body


@book.page("ca5_components")
def ca5(v):
    return E.key_groups(titled(v))


ORACLE["ca5_components"] = component_oracle(" select * from g")


@book.page("ca6_oversize_groups")
def ca6(v):
    return E.key_groups(titled(v)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n > {E.MAX_AUTO_GROUP}")


ORACLE["ca6_oversize_groups"] = component_oracle(f" select component, count(*) as n from g group by all having count(*) > {E.MAX_AUTO_GROUP}")


_MERGED = """, x1 as (select c.*, g.component, count(*) over (partition by coalesce(nullif(""" + NORM("title") + """, ''), c.concept_id)) as n_extracted, count(*) over (partition by g.component) as size from c join g using (concept_id)),
x2 as (select * replace (case when size > 3 then concept_id else component end as component), case when seq % 5 = 0 then [title||' syn', 'común'] else [] end as synonyms, case when seq % 4 = 0 then ['v'||seq] else [] end as variants, case when seq % 3 = 0 then 'm'||seq else '' end as measure,
 case when seq % 7 = 0 then definition||repeat('.', 200) else definition end as long_definition from x1),
x3 as (select x2.*, y.t as norm, row_number() over (partition by x2.component order by is_enriched desc, n_extracted desc, coalesce(first_page, 999), (y.a is not null) desc, length(long_definition) desc, importance desc, x2.seq) as rk from x2 join (select concept_id, t, a from p) y using (concept_id)),
x4 as (select component, arg_min(concept_id, rk) as canonical_id, arg_min(title, rk) as title, arg_min(norm, rk) as norm, list_reduce(list(long_definition order by rk), lambda x, y: case when length(y) > 2 * length(x) then y else x end) as definition, list_sort(list(concept_id)) as members, list_sort(list_distinct(list(first_page))) as pages,
 list_distinct(flatten(list(synonyms))) as syn, list_sort(list_distinct(flatten(list(variants)))) as variants, max(importance) as importance, bool_or(is_gateway) as is_gateway, bool_or(is_threshold) as is_threshold, arg_min(measure, rk) filter (where measure <> '') as measure from x3 group by component),
x5 as (select x4.component, list_distinct(list(x3.title)) as spelled from x4 join x3 on x3.component = x4.component and x3.norm <> x4.norm and trim(x3.title) <> '' group by all),
m as (select x4.*, list_sort(list_distinct(list_concat(syn, coalesce(spelled, [])))) as synonyms from x4 left join x5 using (component))"""


def variants(v):
    """Concepts of blocks with synonyms, variants, a field to fill and some long definitions."""
    i, t = F.col("seq"), F.col("title")
    none = F.array().cast("array<string>")
    return blocks(v).select(
        "*", F.when(i % 5 == 0, F.array(F.concat(t, F.lit(" syn")), F.lit("común"))).otherwise(none).alias("synonyms"), F.when(i % 4 == 0, F.array(F.concat(F.lit("v"), i))).otherwise(none).alias("variants"),
        F.when(i % 3 == 0, F.concat(F.lit("m"), i)).otherwise("").alias("measure"),
    ).withColumn("definition", F.when(i % 7 == 0, F.concat("definition", F.repeat(F.lit("."), 200))).otherwise(F.col("definition")))


@book.page("ca7_best_variant")
def ca7(v):
    return E.merged(variants(v), E.key_groups(blocks(v))).select("component", "canonical_id", "title")


ORACLE["ca7_best_variant"] = component_oracle(_MERGED + " select component, canonical_id, title from m", BLOCK_TITLES)


@book.page("ca8_merged_concepts")
def ca8(v):
    m = E.merged(variants(v), E.key_groups(blocks(v)), ("measure",))
    texts = [F.array_join(c, "|").alias(c) for c in ("members", "pages", "synonyms", "variants")]
    return m.select("canonical_id", "definition", "importance", "is_gateway", "is_threshold", "measure", *texts)


ORACLE["ca8_merged_concepts"] = component_oracle(_MERGED + """ select canonical_id, definition, importance, is_gateway, is_threshold, measure, array_to_string(members, '|') as members, array_to_string(pages, '|') as pages, array_to_string(synonyms, '|') as synonyms, array_to_string(variants, '|') as variants from m""", BLOCK_TITLES)


@book.page("ca9_id_map")
def ca9(v):
    return E.deterministic_pass(variants(v), ("measure",))[1]


ORACLE["ca9_id_map"] = component_oracle(_MERGED + " select unnest(members) as old, canonical_id as new from m", BLOCK_TITLES)


@book.page("ca9_report")
def ca9_report(v):
    out, _, oversized = E.deterministic_pass(variants(v))
    return E.pass_report(variants(v), out, oversized)


ORACLE["ca9_report"] = component_oracle(_MERGED + """ select (select count(*) from c) as n_in, (select count(*) from m) as n_out, (select count(*) from m where len(members) > 1) as fusions, (select sum(len(members) - 1)::bigint from m) as absorbed,
 (select count(*) from amb) as ambiguous, (select count(*) from (select component from g group by all having count(*) > 3)) as oversized""", BLOCK_TITLES)


#: Acronyms that few titles share, so that groups stay within 2 to 6 on tables of any size.
RARE = "upper(substr(title, 1, 3))||cast(seq // 6 % 997 as varchar)"


@book.page("ca10_acronym_candidates", "v_concepts", f"""with {PARTS.replace('upper(substr(title, 1, 3))', RARE)}, kk as (select concept_id, a as key from p where a is not null union select concept_id, lower(trim(title)) from p where not contains(trim(title), ' ') and length(trim(title)) <= 8)
select distinct members, n from (select string_agg(distinct concept_id, ',' order by concept_id) as members, count(distinct concept_id)::int as n from kk group by key having count(distinct concept_id) between 2 and 6)""")
def ca10(v):
    rare = lambda t: F.concat(F.upper(F.substring(t, 1, 3)), (F.floor(F.col("seq") / 6) % 997).cast("string"))
    return E.acronym_candidates(titled(v, rare)).select(F.array_join("members", ",").alias("members"), "n")


@book.page("ca11_token_candidates", "v_concepts", f"""with tk as (select distinct concept_id, unnest(string_split({NORM("title||' '||cluster_id||cast(seq % 37 as string)||'x'")}, ' ')) as token from v_concepts)
select token, string_agg(concept_id, ',' order by concept_id) as members, count(*)::int as n from tk where length(token) >= 4 and token not in ('{"', '".join(E.GENERIC_TOKENS)}') group by token having count(*) between 2 and 6 order by n, token limit 25""")
def ca11(v):
    c = v("v_concepts").withColumn("title", F.concat("title", F.lit(" "), "cluster_id", (F.col("seq") % 37).cast("string"), F.lit("x")))
    return E.token_candidates(c).select("token", F.array_join("members", ",").alias("members"), "n")


@book.page("ca12_without_contained", "v_theses", """with g as (select cast(substr(framework_id, 2) as int) as seq, list_sort(list(distinct 'c'||cast(cast(substr(concept_id, 2) as int) % 12 as string))) as members from v_theses group by all)
select seq, array_to_string(members, ',') as members from g where not exists (select 1 from g e where e.seq < g.seq and len(list_filter(g.members, lambda m: not list_contains(e.members, m))) = 0)""")
def ca12(v):
    m = F.concat(F.lit("c"), F.substring("concept_id", 2, 9).cast("int") % 12)
    g = v("v_theses").groupBy(F.substring("framework_id", 2, 9).cast("int").alias("seq")).agg(F.array_sort(F.collect_set(m)).alias("members"))
    return E.without_contained(g).select("seq", F.array_join("members", ",").alias("members"))


@book.page("ca14_remapped", "v_relations_raw v_concepts", """with m as (select concept_id as old, min(concept_id) over (partition by title) as new from v_concepts)
select doc_id, seq, coalesce(new, from_concept_id) as from_concept_id from v_relations_raw left join m on old = from_concept_id""")
def ca14(v):
    c = v("v_concepts")
    lead = c.groupBy("title").agg(F.min("concept_id").alias("new"))
    id_map = c.join(lead, "title").select(F.col("concept_id").alias("old"), "new")
    return E.remapped(v("v_relations_raw").select("doc_id", "seq", "from_concept_id"), "from_concept_id", id_map).select("doc_id", "seq", "from_concept_id")


@book.page("ca16_dangling_concepts", "v_repertoires v_concepts", "select repertoire_id, case when concepto_confundido in (select concept_id from v_concepts) then concepto_confundido end as concepto_confundido from v_repertoires")
def ca16(v):
    return V.without_dangling(v("v_repertoires"), "repertoire_id", "concepto_confundido", v("v_concepts"), "concept_id").select("repertoire_id", "concepto_confundido")
