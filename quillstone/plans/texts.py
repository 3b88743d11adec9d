"""Plans of scalar text functions, segmentation and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import grounding as G
from quillstone.operators import segment as S
from quillstone.plans.book import Book
from quillstone.plans.entities import DOMAIN, NORM

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

PLAIN = lambda c: f"regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
SOURCE = lambda c: f"trim(regexp_replace({PLAIN(c)}, '\\s+', ' ', 'g'))"
ANSWER = lambda c: f"regexp_replace({PLAIN(c)}, '^\\s+|\\s+$', '', 'g')"


@book.page("fn1_title_norm", "v_pages", f"select page_id, {NORM('h1')} as norm from v_pages")
def fn1(v):
    return v("v_pages").select("page_id", T.title_norm("h1").alias("norm"))


@book.page("fn2_source_norm", "v_segments", f"select doc_id, seq, {SOURCE('text')} as norm from v_segments")
def fn2(v):
    return v("v_segments").select("doc_id", "seq", T.source_norm("text").alias("norm"))


@book.page("fn4_answer_norm", "v_qa", f"select conv_id, turn, {ANSWER('answer')} as norm from v_qa")
def fn4(v):
    return v("v_qa").select("conv_id", "turn", T.answer_norm("answer").alias("norm"))


@book.page("fn5_word_norm", "v_pages", "select page_id, strip_accents(lower(h1)) as norm from v_pages")
def fn5(v):
    return v("v_pages").select("page_id", T.word_norm("h1").alias("norm"))


@book.page("fn6_domain_norm", "v_cases", f"select case_id, {DOMAIN('dominio')} as norm from v_cases")
def fn6(v):
    return v("v_cases").select("case_id", T.domain_norm("dominio").alias("norm"))


@book.page("fn7_title_tokens", "v_pages", f"select page_id, len(list_distinct(list_filter(string_split({NORM('h1')}, ' '), lambda w: length(w) >= 4)))::int as n from v_pages")
def fn7(v):
    return v("v_pages").select("page_id", F.size(T.title_tokens("h1")).alias("n"))


@book.page("fn9_word_grams", "v_quotes", f"with n as (select quote_id, {SOURCE('quote')} as t from v_quotes), w as (select *, string_split(t, ' ') as ws from n) select quote_id, (case when len(ws) < 4 then 1 else len(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))) end)::int as n from w")
def fn9(v):
    return v("v_quotes").select("quote_id", F.size(T.word_grams(T.source_norm("quote"))).alias("n"))


@book.page("fn10_acronym_split", "v_concepts", """with t as (select concept_id, case seq % 4 when 0 then title||' (Evi)' when 1 then title||' (EVI)' when 2 then title||' (EVI, PCC)' else title end as title from v_concepts),
 x as (select *, regexp_extract(title, '^(.*?)\\s*\\(([^)]{2,24})\\)\\s*$', 2) as i, regexp_extract(title, '^(.*?)\\s*\\(([^)]{2,24})\\)\\s*$', 1) as b from t),
 g as (select *, i <> '' and not regexp_matches(i, '[,/ ]') and length(regexp_replace(i, '\\P{L}', '', 'g')) > 0 and length(regexp_replace(i, '\\P{Lu}', '', 'g')) >= 0.6 * length(regexp_replace(i, '\\P{L}', '', 'g')) as good from x)
 select concept_id, case when good then b else title end as base, case when good then i end as acronym, nullif(regexp_extract(title, '\\(([A-Z][A-Z0-9\\-]{1,9})\\)\\s*$', 1), '') as strict from g""")
def fn10(v):
    t = F.col("title")
    k = F.col("seq") % 4
    title = F.when(k == 0, F.concat(t, F.lit(" (Evi)"))).when(k == 1, F.concat(t, F.lit(" (EVI)"))).when(k == 2, F.concat(t, F.lit(" (EVI, PCC)"))).otherwise(t)
    c = v("v_concepts").select("concept_id", title.alias("title"))
    return c.select("concept_id", T.acronym_split(F.col("title")).alias("p"), T.strict_acronym(F.col("title")).alias("strict")).select("concept_id", "p.base", "p.acronym", "strict")


@book.page("fn12_jaccard", "v_qa", f"with t as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array({ANSWER('answer')}, '\\s+'), lambda w: length(w) > 2)) as a, list_distinct(list_filter(regexp_split_to_array({ANSWER('gold')}, '\\s+'), lambda w: length(w) > 2)) as b from v_qa) select conv_id, turn, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 4) as jaccard, round(case when len(b) = 0 then 0 else len(list_intersect(a, b)) / len(b) end, 4) as containment from t")
def fn12(v):
    a, b = T.answer_tokens("answer"), T.answer_tokens("gold")
    return v("v_qa").select("conv_id", "turn", F.round(T.jaccard(a, b), 4).alias("jaccard"), F.round(T.containment(a, b), 4).alias("containment"))


@book.page("fn15_capped_ratio", "", "select s_suppkey, round(case when s_acctbal <= 0 then 0 else greatest(0, least(1, s_suppkey / s_acctbal)) end, 6) as ratio from supplier")
def fn15(v):
    return v("supplier").select("s_suppkey", F.round(T.capped_ratio(F.col("s_suppkey"), F.col("s_acctbal")), 6).alias("ratio"))


@book.page("fn16_confidence", "", "select c_custkey, coalesce(try_cast(x as double), case lower(trim(x)) when 'alta' then 0.9 when 'media' then 0.6 when 'baja' then 0.3 end::double, 0.6::double) as confidence from (select c_custkey, case c_custkey % 5 when 0 then 'ALTA' when 1 then ' baja' when 2 then '0.75' when 3 then 'no' end as x from customer)")
def fn16(v):
    k = F.col("c_custkey") % 5
    x = F.when(k == 0, "ALTA").when(k == 1, " baja").when(k == 2, "0.75").when(k == 3, "no")
    return v("customer").select("c_custkey", T.confidence(x).alias("confidence"))


@book.page("fn17_stable_id", "v_concepts", "select concept_id, 'd_'||substr(sha1(concept_id||chr(124)||title), 1, 10) as id from v_concepts")
def fn17(v):
    return v("v_concepts").select("concept_id", T.stable_id("d", F.col("concept_id"), F.col("title")).alias("id"))


@book.page("fn18_short_code", "v_theses", "select thesis_id, upper(substr(replace(thesis_id||'-'||statement, '-', ''), 1, 6)) as code from v_theses")
def fn18(v):
    return v("v_theses").select("thesis_id", T.short_code(F.concat_ws("-", "thesis_id", "statement")).alias("code"))


@book.page("fn19_token_estimate", "", "select doc_id, cast(floor(n_chars / 3.3::double) + 200 as bigint) as tokens from documents")
def fn19(v):
    return v("documents").select("doc_id", T.token_estimate(F.col("n_chars")).alias("tokens"))


@book.page("fn20_stable_shuffle", "v_theses", "select thesis_id, framework_id, row_number() over (partition by framework_id order by sha1(framework_id||chr(124)||thesis_id))::int as place from v_theses")
def fn20(v):
    from pyspark.sql import Window

    w = Window.partitionBy("framework_id").orderBy(F.sha1(F.concat_ws("|", "framework_id", "thesis_id").cast("binary")))
    return v("v_theses").select("thesis_id", "framework_id", F.row_number().over(w).alias("place"))


@book.page("fn21_rarity", "v_relations_raw", "with n as (select relation_type, count(*) as n from v_relations_raw group by all) select relation_type, round(least(3, ((select sum(n) from n)::double / n) / (select count(*) from n)), 2) as rarity from n")
def fn21(v):
    n = v("v_relations_raw").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return n.join(F.broadcast(total)).select("relation_type", F.round(F.least(F.lit(3.0), F.col("total") / F.col("n") / F.col("kinds")), 2).alias("rarity"))


# --- segmentation ---

HEAD = "(trim(text) <> '' and length(trim(text)) <= 60 and not regexp_matches(trim(text), '[,;]$') and seq % 4 = 0)"


def headed(v):
    return (F.trim("text") != "") & (F.length(F.trim("text")) <= 60) & ~F.trim("text").rlike("[,;]$") & (F.col("seq") % 4 == 0)


@book.page("sg1_headings", "", """with p as (select page_id, length(html) as size, regexp_extract(html, '<h1>(.*?)</h1>', 1) as t from pages) select page_id, (trim(t) <> '' and length(trim(t)) <= 120 and not regexp_matches(trim(t), '[.,;]$') and (size % 2 = 0 or size % 17 > 13)) as heading from p""")
def sg1(v):
    p = v("pages").select("page_id", F.length("html").alias("size"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("t"))
    return p.select("page_id", S.is_heading(F.col("t"), F.col("size") % 2 == 0, (F.col("size") % 17).cast("double")).alias("heading"))


@book.page("sg2_islands", "v_segments", f"""with h as (select *, {HEAD} as h, sum(case when {HEAD} then 1 else 0 end) over (partition by doc_id order by seq) as island from v_segments), g as (select doc_id, island, coalesce(max(case when h then text end), 'Introducción') as section_title,
 trim(regexp_replace(coalesce(string_agg(case when not h then text end, ' ' order by seq), ''), '\\s+', ' ', 'g')) as text from h group by all) select doc_id, island::bigint as island, section_title, length(text)::int as char_count from g where text <> ''""")
def sg2(v):
    return S.islands(v("v_segments"), headed(v)).select("doc_id", "island", "section_title", "char_count")


#: Lines of documents in order, ten to a page; each step of the recursion puts the next line of every document into its segment.
_LINES = f"""l as (select doc_id, row_number() over (partition by doc_id order by seq) as k, seq, trim(text) as text, seq // 10 + 1 as page, {HEAD} as h from v_segments where trim(text) <> ''),
st as (select doc_id, 0::bigint as k, 0 as seg, 0::bigint as size, true as fresh, 'Introducción' as title, null::bigint as carry, -1 as own, '' as own_title, null::bigint as own_carry from (select distinct doc_id from l) union all
 select l.doc_id, l.k, seg + (case when h and not fresh or st.size + length(l.text) >= 600 then 1 else 0 end), case when h and not fresh or st.size + length(l.text) >= 600 then 0 else st.size + length(l.text) end, h and not fresh or st.size + length(l.text) >= 600,
  case when h and not fresh then l.text else title end, case when h and not fresh then null when st.size + length(l.text) >= 600 then page else carry end, case when h and not fresh then -1 else seg end, title, carry from st join l on l.doc_id = st.doc_id and l.k = st.k + 1)"""


@book.page("sg2_segments", "v_segments", f"""with recursive {_LINES}, p as (select doc_id, k, text, page, own, own_title, own_carry from st join l using (doc_id, k) where own >= 0),
 g as (select doc_id, own, any_value(own_title) as section_title, trim(regexp_replace(string_agg(text, ' ' order by k), '\\s+', ' ', 'g')) as text, array_to_string(list_sort(list_distinct(list_filter(list(page) || list(own_carry), lambda x: x is not null))), ',') as pages from p group by all)
 select doc_id, section_title, text, pages, length(text)::int as char_count from g where length(text) > 100""")
def sg2_segments(v):
    lines = v("v_segments").withColumn("page", F.floor(F.col("seq") / 10) + 1)
    return S.segmented(lines, headed(v), 600).select("doc_id", "section_title", "text", F.array_join("pages", ",").alias("pages"), "char_count")


@book.page("sg2_cut_by_size", "v_segments", """with recursive l as (select doc_id, row_number() over (partition by doc_id order by seq) as k, seq, length(text) as n from v_segments), st as (select doc_id, 0::bigint as k, 0::bigint as seg, 0::bigint as size, null::bigint as first, 0::bigint as own, null::bigint as own_first from (select distinct doc_id from l)
 union all select l.doc_id, l.k, seg + (size + n >= 1500)::int, case when size + n >= 1500 then 0 else size + n end, case when size + n >= 1500 then null else coalesce(first, l.seq) end, seg, coalesce(first, l.seq) from st join l on l.doc_id = st.doc_id and l.k = st.k + 1)
 select doc_id, own as segment, min(own_first) as first_seq, sum(n)::bigint as char_count from st join l using (doc_id, k) group by all""")
def sg2_cut(v):
    return S.cut_by_size(v("v_segments"), 1500)


@book.page("sg3_collapsed", "v_segments", "select doc_id, seq, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from v_segments")
def sg3(v):
    return v("v_segments").select("doc_id", "seq", S.collapsed(F.col("text")).alias("text"))


@book.page("sg4_long_segments", "v_segments", "select doc_id, seq, length(text)::int as chars from v_segments where length(text) > 100")
def sg4(v):
    return v("v_segments").where(F.length("text") > 100).select("doc_id", "seq", F.length("text").alias("chars"))


_TITLES = ["Referencias", "Abstract", "Conclusiones", "Discussion", "Results", "Método", "Marco teórico", "1. Introduction", "Otros", "Data analysis"]
_PICK = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"
_KIND = "case " + " ".join(f"when regexp_matches(lower(trim(title)), '{p}') then '{k}'" for k, p in S.PATTERNS) + " else 'other' end"
SECTIONS = f"""with t as (select doc_id, seq, {_PICK}[((doc_id * 7 + seq * 3) % 13 + 1)::int] as title, length(text)::bigint as chars from v_segments), k as (select *, {_KIND} as kind0 from (select * replace (coalesce(title, '') as title) from t)),
p as (select doc_id, seq, title, chars, kind0, coalesce(last_value(nullif(kind0, 'other') ignore nulls) over (partition by doc_id order by seq), 'other') as kind from k)"""


def sections(v):
    title = F.try_element_at(F.array(*[F.lit(t) for t in _TITLES]), ((F.col("doc_id") * 7 + F.col("seq") * 3) % 13 + 1).cast("int"))
    s = v("v_segments").select("doc_id", "seq", title.alias("title"), F.length("text").cast("long").alias("chars"))
    return s.withColumn("kind", S.kind_of(F.col("title")))


@book.page("sg5_section_kinds", "v_segments", SECTIONS + " select doc_id, seq, kind0 as kind from p")
def sg5(v):
    return sections(v).select("doc_id", "seq", "kind")


@book.page("sg6_propagated_kinds", "v_segments", SECTIONS + " select doc_id, seq, kind from p")
def sg6(v):
    return S.propagated(sections(v)).select("doc_id", "seq", "kind")


@book.page("sg7_body", "v_segments", SECTIONS + " select doc_id, count(*) as n from p where kind <> 'backmatter' group by all")
def sg7(v):
    return S.propagated(sections(v)).where("kind != 'backmatter'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@book.page("sg8_merged", "v_segments", SECTIONS.replace("with ", "with recursive ", 1) + """, l as (select p.*, v_segments.text, seq // 10 + 1 as page, row_number() over (partition by doc_id order by seq) as k from p join v_segments using (doc_id, seq)),
 st as (select doc_id, 0::bigint as k, 0 as seg, 0::bigint as size, null::varchar as kind from (select distinct doc_id from l) union all
  select l.doc_id, l.k, seg + (case when st.kind = l.kind and size + chars <= 900 then 0 else 1 end), case when st.kind = l.kind and size + chars <= 900 then size + chars else chars end, l.kind from st join l on l.doc_id = st.doc_id and l.k = st.k + 1)
 select doc_id, min(l.seq) as seq, arg_min(l.title, l.k) as section_title, any_value(l.kind) as kind, string_agg(l.text, chr(10)||chr(10) order by l.k) as text, array_to_string(list_sort(list(distinct page)), ',') as pages, length(string_agg(l.text, chr(10)||chr(10) order by l.k))::bigint as char_count, count(*) as merged_count from st join l using (doc_id, k) group by doc_id, seg""")
def sg8(v):
    s = S.propagated(sections(v)).join(v("v_segments"), ["doc_id", "seq"])
    s = s.select("doc_id", "seq", "kind", F.coalesce("title", F.lit("")).alias("section_title"), "text", F.array((F.floor(F.col("seq") / 10) + 1).cast("int")).alias("pages"), F.col("chars").alias("char_count"))
    return S.merged(s, 900).withColumn("pages", F.array_join("pages", ","))


@book.page("sg9_routed", "v_segments", SECTIONS + f""" select doc_id, seq, list_position({S.ROUTES['cases'].split()}, kind)::int as rank from p where kind in ({str(S.ROUTES['cases'].split())[1:-1]})""")
def sg9(v):
    return S.routed(S.propagated(sections(v)), "cases").select("doc_id", "seq", "rank")


#: Greedy choices in SQL: one step of the recursion a candidate.
_CHOSEN = """, c0 as (select *, list_position({kinds}, kind)::int as rank, row_number() over (partition by doc_id order by seq) - 1 as k, count(*) over (partition by doc_id) as n from p),
en as (select doc_id from c0 where rank > 0 group by all having sum(chars) >= 1500), lh as (select *, floor(n * 0.3::double) as lo, greatest(floor(n * 0.9::double), 1) as hi from c0),
cd as (select doc_id, seq, chars, rank from c0 where rank > 0 and doc_id in (select doc_id from en) union all select doc_id, seq, chars, 0 from lh where doc_id not in (select doc_id from en) and (k >= lo and k < hi or lo >= hi)),
od as (select *, row_number() over (partition by doc_id order by rank, seq) as o from cd),
g(doc_id, o, seq, used, fits) as (select doc_id, o, seq, chars, true from od where o = 1 union all select od.doc_id, od.o, od.seq, case when used + chars <= 2000 then used + chars else used end, used + chars <= 2000 from g join od on od.doc_id = g.doc_id and od.o = g.o + 1)
select doc_id, seq, truncated from (select *, bool_or(not fits) over (partition by doc_id) as truncated from g) where fits"""


@book.page("sg10_budgeted")
def sg10(v):
    return S.selected(S.propagated(sections(v)), "cases", 2000)


def _chosen_oracle() -> str:
    from quillstone.sources.fixtures import oracle

    return oracle("v_segments", SECTIONS + _CHOSEN.replace("{kinds}", str(S.ROUTES["cases"].split()))).replace("with ", "with recursive ", 1)


ORACLE["sg10_budgeted"] = _chosen_oracle()


@book.page("sg11_positional", "v_segments", """with k as (select doc_id, seq, row_number() over (partition by doc_id order by seq) - 1 as k, count(*) over (partition by doc_id) as n from v_segments)
 select doc_id, seq from k where k < greatest(1, floor(n * 0.35::double)) or (n > 3 and k >= n - greatest(1, n // 4))""")
def sg11(v):
    return S.positional(v("v_segments"), "repertoires").select("doc_id", "seq")


@book.page("sg12_rendered", "v_segments", SECTIONS + " select doc_id, md5(string_agg('## '||title||chr(10)||chars::varchar, chr(10) order by seq)) as text_md5 from (select * replace (coalesce(title, '') as title) from p) group by all")
def sg12(v):
    part = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("chars").cast("string"))
    out = sections(v).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("t")))).alias("a"))
    return out.select("doc_id", F.md5(F.array_join(F.transform("a", lambda x: x["t"]), "\n").cast("binary")).alias("text_md5"))


@book.page("sg13_section_report", "v_segments", SECTIONS + " select kind, count(*) as n, sum(chars)::bigint as chars from p group by all")
def sg13(v):
    return S.section_report(S.propagated(sections(v)))


#: Concepts that documents mention: two phrases of each quote, the first with another as synonym, the second with a word of it
#: as acronym; and those of v_concepts.
_PHRASES = f"""qw as (select quote_id, string_split({SOURCE('quote')}, ' ') as w from v_quotes),
qc as (select 'a'||quote_id::varchar as concept_id, w[1]||' '||w[2] as title, w[7]||' '||w[8] as synonym from qw union all select 'b'||quote_id::varchar, w[3]||' '||w[4]||' '||w[5]||' ('||upper(w[6])||')', null from qw
 union all select concept_id, title, null from v_concepts)"""
_FORMS = "fm as (select distinct concept_id, form from (select concept_id, unnest([{forms}]) as form from qc) where length(form) >= {least})"
_BASE = SOURCE("regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')")
TITLES = _PHRASES + ", " + _FORMS.format(forms=", ".join((SOURCE("title"), _BASE, SOURCE("regexp_extract(title, '\\(([^)]{2,10})\\)\\s*$', 1)"))), least=3)
ALL_NAMES = _PHRASES + ", " + _FORMS.format(forms=", ".join((SOURCE("title"), _BASE, SOURCE("regexp_extract(title, '\\(([^)]{2,12})\\)', 1)"), SOURCE("synonym"))), least=4)


def phrase_concepts(v):
    w = F.split(T.source_norm("quote"), " ")
    phrase = lambda *ks: F.concat(*[x for k in ks for x in (F.lit(" "), F.try_element_at(w, F.lit(k)))][1:])
    q = v("v_quotes")
    first = q.select(F.concat(F.lit("a"), "quote_id").alias("concept_id"), phrase(1, 2).alias("title"), F.array(phrase(7, 8)).alias("synonyms"))
    none = F.lit(None).cast("array<string>").alias("synonyms")
    second = q.select(F.concat(F.lit("b"), "quote_id").alias("concept_id"), F.concat(phrase(3, 4, 5), F.lit(" ("), F.upper(phrase(6)), F.lit(")")).alias("title"), none)
    return first.unionByName(second).unionByName(v("v_concepts").select("concept_id", "title", none))


@book.page("sg14_mentioning", "v_segments v_quotes v_concepts", f"""with {TITLES}, s as (select doc_id, seq, {SOURCE('text')} as norm, length(text)::bigint as chars from v_segments),
 h as (select distinct s.doc_id, s.seq, chars from s, (select distinct form from fm) f where contains(' '||norm||' ', ' '||form||' ')), b as (select *, sum(chars) over (partition by doc_id order by seq) as used, row_number() over (partition by doc_id order by seq) as k from h)
 select doc_id, seq, chars from b where k = 1 or used <= 3000""")
def sg14(v):
    s = v("v_segments").select("doc_id", "seq", T.source_norm("text").alias("norm"), F.length("text").cast("long").alias("chars"))
    return S.mentioning(s, S.surface_forms(phrase_concepts(v)), 3000)


@book.page("sg15_batches", "v_segments", "select doc_id, seq, ((row_number() over (partition by doc_id order by seq) - 1) // 3)::bigint as batch from v_segments")
def sg15(v):
    return S.batches(v("v_segments"), 3).select("doc_id", "seq", "batch")


# --- grounding ---


@book.page("gr1_source_index", "", f"with n as (select doc_id, {SOURCE('text')} as norm from documents), w as (select *, string_split(norm, ' ') as ws from n) select doc_id, md5(norm) as norm_md5, (case when len(ws) < 4 then 1 else len(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))) end)::int as n_grams from w")
def gr1(v):
    return G.source_index(v("documents")).select("doc_id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "n_grams")


_GRAMS = f"""with q as (select quote_id, {SOURCE('quote')} as t from v_quotes), d as (select doc_id, {SOURCE('text')} as t from documents),
qg as (select distinct quote_id, unnest(case when len(ws) < 4 then [t] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as g from (select *, string_split(t, ' ') as ws from q where length(t) >= 25)),
dg as (select distinct doc_id, unnest(case when len(ws) < 4 then [t] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as g from (select *, string_split(t, ' ') as ws from d)),
sh as (select quote_id, doc_id, count(*) as n from qg join dg using (g) group by all), bst as (select quote_id, max(n) as n from sh group by all), tot as (select quote_id, count(*) as t from qg group by all),
ins as (select distinct quote_id from q join d on length(q.t) >= 25 and contains(d.t, q.t)),
fnd as (select q.quote_id, case when ins.quote_id is not null then 1 else coalesce(n / tot.t, 0) end::double as r from q left join bst using (quote_id) left join tot using (quote_id) left join ins using (quote_id))"""


@book.page("gr2_quotes_in_sources", "v_quotes", _GRAMS + " select quote_id, r >= 0.82 as found, round(r, 2) as similarity from fnd")
def gr2(v):
    return G.closest_source(v("v_quotes"), v("documents"))


#: Claims of documents: a piece of their own text, or of another's.
_CLAIMS = f"""with c as (select doc_id, case when doc_id % 3 = 0 then substr(text, 5, 60) when doc_id % 3 = 1 then reverse(substr(text, 1, 60)) else substr(text, 1, 12) end as quote from documents),
s as (select c.doc_id, {SOURCE('quote')} as q, {SOURCE('text')} as t from c join documents using (doc_id)),
g as (select *, case when len(string_split(q, ' ')) < 4 then [q] else list_distinct(list_transform(range(1, len(string_split(q, ' ')) - 2), lambda i: array_to_string(string_split(q, ' ')[i:i+3], ' '))) end as qg,
 case when len(string_split(t, ' ')) < 4 then [t] else list_distinct(list_transform(range(1, len(string_split(t, ' ')) - 2), lambda i: array_to_string(string_split(t, ' ')[i:i+3], ' '))) end as tg from s),
o as (select doc_id, length(q) as l, contains(t, q) as inside, len(list_intersect(qg, tg)) / len(qg) as r from g),
f as (select doc_id, case when l < 25 then false when inside then true else r >= 0.82 end as found, case when l < 25 then 0 when inside then 1 else round(r, 2) end::double as similarity from o)"""


def claims(v):
    k = F.col("doc_id") % 3
    quote = F.when(k == 0, F.substring("text", 5, 60)).when(k == 1, F.reverse(F.substring("text", 1, 60))).otherwise(F.substring("text", 1, 12))
    return v("documents").select("doc_id", quote.alias("quote"))


@book.page("gr2_claims_in_own_source", "", _CLAIMS + " select * from f")
def gr2_own(v):
    return G.in_own_source(claims(v), v("documents"), "quote").select("doc_id", "found", "similarity")


_TERM = f"""with t as (select concept_id, case seq % 3 when 0 then split_part(title, ' ', 1)||' (THE)' when 1 then 'zzzz (THE)' else title end as title from v_concepts), d as (select doc_id, {SOURCE('text')} as s from documents),
x as (select concept_id, doc_id, {SOURCE("regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')")} as b, {SOURCE('title')} as f, lower(regexp_extract(title, '\\(([A-Z][A-Z0-9\\-]{{1,9}})\\)\\s*$', 1)) as a, s from t, d where d.doc_id = cast(substr(concept_id, 2) as int))"""


@book.page("gr5_terms", "v_concepts", _TERM + " select concept_id, case when (b <> '' and contains(s, b)) or (f <> '' and contains(s, f)) then 'presente' when a <> '' and list_contains(string_split(s, ' '), a) then 'sigla' else 'ausente' end as state from x")
def gr5(v):
    t, k = F.col("title"), F.col("seq") % 3
    title = F.when(k == 0, F.concat(F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" (THE)"))).when(k == 1, "zzzz (THE)").otherwise(t)
    c = v("v_concepts").select("concept_id", title.alias("title"), F.substring("concept_id", 2, 9).cast("long").alias("doc_id"))
    d = v("documents").select("doc_id", T.source_norm("text").alias("source"))
    return c.join(d, "doc_id").select("concept_id", G.term_state(F.col("title"), F.col("source")).alias("state"))


_LEVELS = _CLAIMS + """, i as (select doc_id, found, doc_id % 4 = 0 as term, ((doc_id % 10) / 10)::double as c0 from f), l as (select doc_id, case when found then 'verificado' when term then 'parcial' else 'sin_anclaje' end as level, coalesce(nullif(c0, 0), 0.6::double) as c from i),
 m as (select doc_id, level, case level when 'parcial' then least(c, 0.6::double) when 'sin_anclaje' then least(c, 0.35::double) else c end as confidence from l)"""


def levels(v):
    found = G.in_own_source(claims(v), v("documents"), "quote")
    return G.verified(found.withColumns({"term_present": F.col("doc_id") % 4 == 0, "confidence": (F.col("doc_id") % 10) / 10}))


@book.page("gr6_verified_concepts", "", _LEVELS + " select * from m")
def gr6(v):
    return levels(v).select("doc_id", "level", "confidence")


@book.page("gr7_verified_items", "", _CLAIMS + " select doc_id, found, case when found then 0.8::double else 0.5::double end as confidence from f")
def gr7(v):
    found = G.in_own_source(claims(v), v("documents"), "quote")
    return found.select("doc_id", "found", F.when(F.col("found"), 0.8).otherwise(0.5).alias("confidence"))


@book.page("gr8_verified_relations", "", _CLAIMS + " select doc_id, case when found then 'verificado' when doc_id % 2 = 0 then 'parcial' else 'inferida' end as level, case when found or doc_id % 2 = 0 then 0.9::double else 0.7::double end as confidence from f")
def gr8(v):
    found = G.in_own_source(claims(v), v("documents"), "quote").withColumnsRenamed({"found": "quote_found"})
    return G.verified_relations(found.withColumns({"description_found": F.col("doc_id") % 2 == 0, "confidence": F.lit(0.9)})).select("doc_id", "level", "confidence")


@book.page("gr9_verified_attributes", "v_segments", f"""with a as (select doc_id as concept_id, seq, split_part(text, ' ', 1) as name, seq % 3 <> 0 as found from v_segments), n as (select *, {SOURCE('name')} as norm from a),
 r as (select *, row_number() over (partition by concept_id, norm, found and norm <> '' order by seq) as rk from n) select concept_id, seq, name, found and norm <> '' and rk = 1 as kept from r""")
def gr9(v):
    a = v("v_segments").select(F.col("doc_id").alias("concept_id"), "seq", F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), (F.col("seq") % 3 != 0).alias("found"))
    return G.verified_attributes(a).select("concept_id", "seq", "name", "kept")


@book.page("gr10_verification_rate", "", _LEVELS + ", k as (select count(*) filter (where level = 'verificado') as verificado, count(*) filter (where level = 'parcial') as parcial, count(*) filter (where level = 'sin_anclaje') as sin_anclaje from m) select *, round(verificado / greatest(verificado + parcial + sin_anclaje, 1), 2) as rate from k")
def gr10(v):
    return G.verification_rate(levels(v))
