"""Plans of the bundle compiler."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import compiler as K
from quillstone.operators import relations as R
from quillstone.plans import graphs
from quillstone.plans.book import Book
from quillstone.plans.entities import NORM

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

BASE = graphs.CLEAN + """, eg as (select a as f, b as t, relation_type, confidence from stl)"""
SID = lambda p, *c: f"'{p}_'||substr(sha1({'||chr(124)||'.join(c)}), 1, 10)"


def edges(v):
    return graphs.ends(graphs.settled(v))


def page(name, body, more=""):
    return book.page(name, f"v_relations_raw v_concepts {more}", BASE + body)


SOFT = """, mv as (select concept_id, sum(cast(round(m*10) as bigint))::bigint / 10 as soft from (select f as concept_id, -w as m from w union all select t, w from w) group by all)"""
_W = ", w as (select f, t, case relation_type " + " ".join(f"when '{k}' then {x}::double" for k, x in K.SOFT.items()) + " else 0::double end as w from eg)"
RANK = _W + SOFT + """, rk as (select c.*, coalesce(soft, 0) as soft, row_number() over (partition by cluster_id order by is_gateway desc, coalesce(soft, 0) desc, case difficulty when 'basico' then 1 when 'intermedio' then 2 when 'avanzado' then 3 else 2 end, importance desc, coalesce(first_page, 99), seq)::int as rank from v_concepts c left join mv using (concept_id))"""


@page("co1_valid_edges", " select (select count(*) from eg) as n_edges, count(*) as n_clusters, max(n) <= 0.6 * sum(n) as keep_clusters from (select cluster_id, count(*) as n from v_concepts group by all)")
def co1(v):
    k = v("v_concepts").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_clusters"), (F.max("n") <= 0.6 * F.sum("n")).alias("keep_clusters"))
    return edges(v).agg(F.count(F.lit(1)).alias("n_edges")).join(F.broadcast(k))


@page("co2_soft_scores", _W + SOFT + " select * from mv")
def co2(v):
    return K.soft_scores(edges(v))


@page("co3_priority", RANK + " select concept_id, cluster_id, rank from rk")
def co3(v):
    return K.priority(v("v_concepts"), K.soft_scores(edges(v))).select("concept_id", "cluster_id", "rank")


def ordered(v):
    ranked = K.priority(v("v_concepts"), K.soft_scores(edges(v))).select("cluster_id", "concept_id", "rank")
    of = v("v_concepts").select("cluster_id", F.col("concept_id"))
    needs = edges(v).where("relation_type = 'requiere'").select(F.col("from_concept_id").alias("concept_id"), F.col("to_concept_id").alias("required")).join(of, "concept_id")
    return K.study_order(ranked, needs, "cluster_id")


@book.page("co4_study_order")
def co4(v):
    return ordered(v)


@page("co5_order_quality", """, e as (select count(*) filter (where relation_type = 'requiere') >= 5 as a, count(*) filter (where relation_type in ('causa','generaliza','ejemplifica','extiende')) >= 5 as b from eg), c as (select bool_or(is_gateway) as c, count(distinct difficulty) >= 2 as d, count(distinct first_page) >= 3 as p from v_concepts)
 select case when a::int + b::int + c::int + d::int + p::int >= 4 then 'buena' when a::int + b::int + c::int + d::int + p::int >= 2 then 'parcial' else 'debil' end as quality from e cross join c""")
def co5(v):
    t = F.col("relation_type")
    e = edges(v).agg((F.count_if(t == "requiere") >= 5).alias("a"), (F.count_if(t.isin("causa", "generaliza", "ejemplifica", "extiende")) >= 5).alias("b"))
    c = v("v_concepts").agg(F.bool_or("is_gateway").alias("c"), (F.count_distinct("difficulty") >= 2).alias("d"), (F.count_distinct("first_page") >= 3).alias("p"))
    return e.join(F.broadcast(c)).select(K.order_quality([F.col(x) for x in "abcdp"]).alias("quality"))


@book.page("co6_units")
def co6(v):
    return K.units(ordered(v).join(v("v_concepts").select("concept_id", F.col("tipo").alias("t")), "concept_id").withColumnRenamed("cluster_id", "doc").withColumnRenamed("t", "cluster_id"), "doc")


_UNIT = """, un as (select cluster_id, (rank - 1) // 5 + 1 as unit, avg(case difficulty when 'basico' then 1 when 'intermedio' then 2 else 3 end) as m, count(*) as n from rk group by all), tt as (select *, count(*) over (partition by cluster_id) as total, round((m - 1) / 2, 3) as base from un),
cv as (select *, round(least(1, 0.35::double + 0.4::double * base + 0.35::double * (unit - 1) / total), 3) as d from tt)"""


def curved(v):
    from pyspark.sql import Window
    from quillstone.operators.profile import lookup

    r = K.priority(v("v_concepts"), K.soft_scores(edges(v))).withColumn("unit", F.expr("(rank - 1) div 5 + 1")).withColumn("own", lookup(F.col("difficulty"), K.DIFFICULTY, 2))
    u = r.groupBy("cluster_id", "unit").agg(F.avg("own").alias("m"), F.count(F.lit(1)).alias("n"))
    u = u.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))).withColumn("base", F.round((F.col("m") - 1) / 2, 3))
    return r, u.withColumn("c", K.curve(F.col("unit"), F.col("total"), F.col("base")))


@page("co7_difficulty_curve", RANK + _UNIT + " select cluster_id, unit::bigint as unit, n, d as difficulty, (case when d < 0.5 then 3 when d < 0.75 then 4 else 5 end)::int as options, case when d < 0.45 then 'alto' when d < 0.7 then 'medio' else 'bajo' end as scaffold from cv")
def co7(v):
    return curved(v)[1].select("cluster_id", "unit", "n", "c.difficulty", "c.options", "c.scaffold")


@page("co8_concept_difficulty", RANK + _UNIT + " select concept_id, round(greatest(0.2::double, least(1, 0.6::double * d + 0.4::double * (case difficulty when 'basico' then 0.15::double when 'intermedio' then 0.5::double else 0.9::double end))) + 1e-9::double, 2) as difficulty from rk join cv on rk.cluster_id = cv.cluster_id and (rank - 1) // 5 + 1 = unit")
def co8(v):
    from quillstone.operators.profile import lookup

    r, u = curved(v)
    own = lookup(F.col("difficulty"), {"basico": 0.15, "intermedio": 0.5}, 0.9)
    return r.withColumn("mine", own).join(u.select("cluster_id", "unit", F.col("c.difficulty").alias("d")), ["cluster_id", "unit"]).select("concept_id", K.concept_difficulty(F.col("d"), F.col("mine")).alias("difficulty"))


POOL = f""", ds as (select distinct x.concept_id, 'c'||cast(x.seq % 50 as string) as other_id from v_concepts x where x.seq % 4 = 0), pd as (select ds.concept_id, {SID('d', 'ds.concept_id', 'other_id')} as distractor_id, 0.9::double as plausibility, 'distincion' as origin, o.definition as text from ds join v_concepts o on o.concept_id = other_id where ds.concept_id <> other_id),
pr as (select concept_id, {SID('r', 'repertoire_id')} as distractor_id, 0.95::double as plausibility, 'repertorio' as origin, label as text from v_repertoires where concept_id in (select concept_id from v_concepts)), p0 as (select * from pd union all select * from pr),
nb as (select distinct * from (select f as concept_id, t as other_id from eg union all select t, f from eg)), us as (select nb.*, row_number() over (partition by other_id order by seq) as used from nb join v_concepts using (concept_id)),
nk as (select us.*, coalesce(h.n, 0) as have, row_number() over (partition by us.concept_id order by other_id) as k from us left join (select concept_id, count(*) as n from p0 group by all) h using (concept_id) where used <= 3),
pn as (select nk.concept_id, {SID('n', 'nk.concept_id', 'other_id')} as distractor_id, 0.6::double as plausibility, 'vecino' as origin, o.definition as text from nk join v_concepts o on o.concept_id = other_id where k + have <= 6), pool as (select * from p0 union all select * from pn)"""


def pools(v):
    c = v("v_concepts")
    d = K.distinction_pool(c.where("seq % 4 = 0").select("concept_id", F.concat(F.lit("c"), F.col("seq") % 50).alias("other_id")), c)
    first = d.unionByName(K.repertoire_pool(v("v_repertoires"), c))
    return first, first.unionByName(K.neighbour_pool(edges(v), first, c))


@page("co9_distinction_pool", POOL + " select * from pd", "v_repertoires")
def co9(v):
    return pools(v)[0].where("origin = 'distincion'")


@page("co10_repertoire_pool", POOL + " select * from pr", "v_repertoires")
def co10(v):
    return pools(v)[0].where("origin = 'repertorio'")


@page("co11_neighbour_pool", POOL + " select * from pn", "v_repertoires")
def co11(v):
    return pools(v)[1].where("origin = 'vecino'")


@page("co12_effective_options", POOL + " select concept_id, count(*) as n, round(1 + sum(cast(round(plausibility*100) as bigint))::bigint / 100, 2) as n_effective from pool group by all", "v_repertoires")
def co12(v):
    return K.effective_options(pools(v)[1])


@book.page("co16_accepted_forms", "v_concepts", f"""with e as (select distinct concept_id, {NORM('form')} as norm from (select concept_id, unnest([title, split_part(title, ' ', 2)||' '||cluster_id, 'alias '||concept_id]) as form from v_concepts)), n as (select norm, count(distinct concept_id) as n from e where norm <> '' group by all)
select concept_id, coalesce(string_agg(norm, '|' order by norm) filter (where n = 1 and length(norm) >= 4), '') as accepted, coalesce(string_agg(norm, '|' order by norm) filter (where n > 1), '') as ambiguous from e join n using (norm) group by concept_id""")
def co16(v):
    forms = F.array(F.col("title"), F.concat(F.split_part("title", F.lit(" "), F.lit(2)), F.lit(" "), F.col("cluster_id")), F.concat(F.lit("alias "), F.col("concept_id")))
    return K.accepted_forms(v("v_concepts").select("concept_id", forms.alias("forms"))).withColumns({k: F.array_join(k, "|") for k in ("accepted", "ambiguous")})


RARITY = ", rn as (select relation_type, count(*) as n from eg group by all), ra as (select relation_type, round(least(3, ((select sum(n) from rn)::double / n) / (select count(*) from rn)), 2) as rarity from rn)"


def rarity(v):
    n = edges(v).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return n.join(F.broadcast(total)).select("relation_type", F.round(F.least(F.lit(3.0), F.col("total") / F.col("n") / F.col("kinds")), 2).alias("rarity"))


@page("co17_relation_items", RARITY + f""", g as (select least(f, t) as a, greatest(f, t) as b, list_sort(list_distinct(list(relation_type))) as types, max(rarity) as rarity from eg join ra using (relation_type) group by all)
select {SID('c1', 'a', 'b')} as item_id, a, b, array_to_string(types, ',') as types, round(greatest(2, (select count(*) from rn) / len(types)), 2) as n_effective, rarity from g""")
def co17(v):
    return K.relation_items(edges(v), rarity(v)).withColumn("types", F.array_join("types", ","))


@book.page("co19_case_items", "v_cases", f"select {SID('e1', 'case_id')} as item_id, 'E1' as mechanic_id, case_id from v_cases where trim(resolucion_esperada) <> '' and prediction_enabled union all select {SID('e3', 'case_id')}, 'E3', case_id from v_cases where trim(resolucion_esperada) <> ''")
def co19(v):
    return K.case_items(v("v_cases"))


@book.page("co20_error_items", "v_cases v_scenarios", f"select {SID('e2', 'source_id')} as item_id, 'E2' as mechanic_id, source_id from (select case_id as source_id, error_embebido as error from v_cases union all select scenario_id, case when distancia = 'INVALID' then 'bad distance' end from v_scenarios) where trim(coalesce(error, '')) <> ''")
def co20(v):
    c = v("v_cases").select(F.col("case_id").alias("source_id"), F.col("error_embebido").alias("error"))
    s = v("v_scenarios").select(F.col("scenario_id").alias("source_id"), F.when(F.col("distancia") == "INVALID", "bad distance").alias("error"))
    return K.error_items(c, s)


@book.page("co21_rejections", "v_cases", "select 'E1' as mechanic_id, case when trim(resolucion_esperada) = '' then 'sin_gold' else 'sin_prediccion' end as reason, count(*) as n from v_cases where trim(resolucion_esperada) = '' or not prediction_enabled group by all")
def co21(v):
    reason = F.when(F.trim("resolucion_esperada") == "", "sin_gold").when(~F.col("prediction_enabled"), "sin_prediccion")
    return v("v_cases").withColumn("reason", reason).where("reason is not null").groupBy(F.lit("E1").alias("mechanic_id"), "reason").agg(F.count(F.lit(1)).alias("n"))


@page("co22_adjacency", ", ad as (select f as concept_id, t as other_id, relation_type, false as reverse, confidence from eg union all select t, f, relation_type, true, confidence from eg) select *, case when confidence >= 0.6 then 'afirmada' else 'inferida' end as stated from ad")
def co22(v):
    return K.adjacency(edges(v))


@book.page("co23_concept_index", "v_concepts", """select concept_id, upper(substr(title, 1, 1))||substr(title, 2) as title, case tipo when 'teorico' then 'A' when 'empirico' then 'B,C' when 'metodologico' then 'C,D,E,F' else 'A' end as families from v_concepts""")
def co23(v):
    t = F.col("tipo")
    s = lambda *x: F.array(*[F.lit(k) for k in x])
    loads = F.when(t == "teorico", s("memorizar")).when(t == "empirico", s("discriminar")).when(t == "metodologico", s("integrar", "inferir")).otherwise(s("otra"))
    return K.concept_index(v("v_concepts"), loads).withColumn("families", F.array_join("families", ","))


@page("co24_provisional_axes", """, dg as (select c as concept_id, count(*) as degree from (select f as c from eg union all select t from eg) group by all) select concept_id, 'tipo' as axis, case tipo when 'teorico' then 0 when 'metodologico' then 0.33 when 'empirico' then 0.66 else 1 end::double as position from v_concepts
 union all select concept_id, 'dificultad', case difficulty when 'basico' then 0.15 when 'intermedio' then 0.5 else 0.9 end::double from v_concepts union all select c.concept_id, 'centralidad', round(coalesce(degree, 0) / (select max(degree) from dg), 2) from v_concepts c left join dg using (concept_id)""")
def co24(v):
    return K.provisional_axes(v("v_concepts"), R.degrees(edges(v)))


@page("co28_capabilities", POOL + """, dg as (select c, count(*) as degree from (select f as c from eg union all select t from eg) where c in (select concept_id from v_concepts) group by all having count(*) >= 3), sz as (select c.concept_id, n from v_concepts c left join (select concept_id, count(*) as n from pool group by all) p using (concept_id)),
 er as (select error_embebido as e from v_cases union all select case when distancia = 'INVALID' then 'x' end from v_scenarios),
 z as (select (select count(*) from dg) as anchors, (select string_agg(c, ',' order by degree desc, c) from (select * from dg order by degree desc, c limit 20)) as top_anchors, (select count(*) from v_concepts where is_gateway) as gateways, (select count(*) from v_concepts where is_threshold) as thresholds,
 (select count(*) from sz where n is null) as without_pool, (select count(*) from sz where n < 2) as least_pools, (select count(*) from sz where n >= 3) as large_pools, (select count(distinct relation_type) from eg) as types, (select count(*) from eg where confidence >= 0.8) as asserted, (select count(*) from eg where confidence >= 0.6 and confidence < 0.8) as implied,
 (select count(*) from eg where confidence < 0.6) as inferred, (select count(*) from v_repertoires) as repertoires, (select count(*) from v_scenarios) as scenarios, (select count(*) from v_scenarios where distancia = 'cercana') as near, (select count(*) from v_scenarios where distancia = 'media') as middle, (select count(*) from v_scenarios where distancia = 'lejana') as far,
 (select count(*) from v_cases where prediction_enabled) as predicted_cases, (select count(*) from er where trim(e) <> '') as with_error, (select count(*) from v_frameworks where rival_id <> '') as rivals)
 select *, anchors >= 2 as chain, types >= 2 as monoculture, thresholds >= 2 as threshold, large_pools >= 5 as swarm, repertoires >= 1 as echo, scenarios >= 1 as portal, rivals >= 2 as rival_framework from z""", "v_repertoires v_scenarios v_cases v_frameworks")
def co28(v):
    scenarios = v("v_scenarios").withColumn("error_embebido", F.when(F.col("distancia") == "INVALID", "x"))
    return K.capabilities(v("v_concepts"), edges(v), pools(v)[1], v("v_repertoires"), scenarios, v("v_cases"), v("v_frameworks"))


@page("co29_problem_concepts", POOL + """, it as (select distinct primary_concept_id as concept_id from v_cases where trim(resolucion_esperada) <> ''), x as (select concept_id, concept_id not in (select concept_id from p0) as p, concept_id not in (select f from eg union select t from eg) as e, concept_id not in (select concept_id from it) as i from v_concepts)
 select concept_id, array_to_string(list_filter([case when p then 'pool' end, case when e then 'edges' end, case when i then 'items' end], lambda z: z is not null), ',') as lacks from x where p or e or i""", "v_repertoires v_cases")
def co29(v):
    items = v("v_cases").where(F.trim("resolucion_esperada") != "").select(F.col("primary_concept_id").alias("concept_id"))
    return K.problems(v("v_concepts"), pools(v)[0], edges(v), items).withColumn("lacks", F.array_join("lacks", ","))


@page("co30_bundle_stats", POOL + " select (select count(*) from v_concepts) as concepts, (select count(*) from eg) as edges, (select count(*) from pool) as distractors", "v_repertoires")
def co30(v):
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias(k))
    return n(v("v_concepts"), "concepts").join(F.broadcast(n(edges(v), "edges"))).join(F.broadcast(n(pools(v)[1], "distractors")))


@page("rg12_levels", "")
def rg12(v):
    needs = edges(v).where("relation_type = 'requiere' and from_concept_id < to_concept_id").select(F.col("from_concept_id").alias("concept_id"), F.col("to_concept_id").alias("required"))
    return K.levels(needs, v("v_concepts"))


@book.page("rg12_order")
def rg12_order(v):
    of = v("v_concepts").select(F.col("cluster_id").alias("doc_id"), "concept_id", "seq")
    needs = edges(v).where("relation_type = 'requiere'").select(F.col("from_concept_id").alias("concept_id"), F.col("to_concept_id").alias("required"))
    return K.kahn_order(of, needs.join(of, "concept_id").select("doc_id", "concept_id", "required"))


def _levels_oracle() -> str:
    from quillstone.sources.fixtures import oracle

    text = oracle("v_relations_raw v_concepts", BASE + ", nd as (select distinct f, t from eg where relation_type = 'requiere' and f < t), lv(c, l) as (select concept_id, 0 from v_concepts union select nd.f, l + 1 from nd join lv on nd.t = lv.c) select c as concept_id, max(l)::int as level from lv group by c")
    return text.replace("with ", "with recursive ", 1)


ORACLE["rg12_levels"] = _levels_oracle()
