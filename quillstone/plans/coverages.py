"""Plans of coverage, the mechanics catalogue and the material's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import mechanics as M
from quillstone.operators import coverage as C
from quillstone.plans import graphs
from quillstone.plans.book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

ALL = "v_concepts v_relations_raw v_repertoires v_frameworks v_theses v_cases v_scenarios"
N = graphs.CLEAN + """, n as (select (select count(*) from v_concepts) as concepts, (select count(*) from v_concepts where is_enriched) as enriched, (select count(*) from v_concepts where difficulty = 'basico') as basic,
 (select count(*) from v_concepts where tipo <> 'aplicado') as synonyms, (select count(*) from v_concepts where is_threshold) as threshold, (select count(*) from v_concepts where is_enriched and seq % 3 = 0) as "distinct",
 (select count(distinct cluster_id) from v_concepts) as clusters, (select count(*) from stl) as relations, (select count(*) from stl where relation_type in ('contradice','contrasta')) as opposed,
 (select count(*) from stl where relation_type = 'causa') as arista_tipo_causa, (select count(*) from stl where relation_type = 'contrasta') as arista_tipo_contrasta,
 (select count(*) from v_repertoires) as repertoires, (select count(*) from v_repertoires where trim(contraste_cientifico) <> '') as contrasted,
 (select count(*) from v_frameworks) as frameworks, (select count(*) from v_frameworks where rival_id in (select framework_id from v_frameworks)) as rivals, (select count(*) from v_theses) as theses,
 (select count(*) from v_cases) as cases, (select count(*) from v_cases where trim(resolucion_esperada) <> '') as gold_cases, (select count(*) from v_cases where error_embebido <> '') as error_cases,
 (select count(*) from v_scenarios) as scenarios, (select count(*) from v_scenarios where distancia = 'lejana') as far, 0::bigint as axes)"""
ratio = lambda n, t: f"(case when {t} <= 0 then 0 else greatest(0, least(1, {n} / ({t}))) end)"


def counts(v):
    yes = F.lit(True)
    c, f = v("v_concepts"), v("v_frameworks")
    rivals = f.join(f.select(F.col("framework_id").alias("rival_id")), "rival_id", "left_semi")
    t = F.col("relation_type")
    row = C.counts({
        "c": (c, {"concepts": yes, "enriched": F.col("is_enriched"), "basic": F.col("difficulty") == "basico", "synonyms": F.col("tipo") != "aplicado", "threshold": F.col("is_threshold"), "distinct": F.col("is_enriched") & (F.col("seq") % 3 == 0)}),
        "k": (c.select("cluster_id").distinct(), {"clusters": yes}),
        "r": (graphs.settled(v), {"relations": yes, "opposed": t.isin("contradice", "contrasta"), "arista_tipo_causa": t == "causa", "arista_tipo_contrasta": t == "contrasta"}),
        "p": (v("v_repertoires"), {"repertoires": yes, "contrasted": F.trim("contraste_cientifico") != ""}),
        "f": (f, {"frameworks": yes}),
        "f2": (rivals, {"rivals": yes}),
        "t": (v("v_theses"), {"theses": yes}),
        "k2": (v("v_cases"), {"cases": yes, "gold_cases": F.trim("resolucion_esperada") != "", "error_cases": F.col("error_embebido") != ""}),
        "s": (v("v_scenarios"), {"scenarios": yes, "far": F.col("distancia") == "lejana"}),
    })
    return row.withColumn("axes", F.lit(0).cast("long"))


@book.page("cv1_densities", ALL, N + f""" select name, round(value, 4) as value from (select unnest([{{'name': 'relations', 'value': {ratio('relations', 'concepts*1.5::double')}::double}}, {{'name': 'theses', 'value': {ratio('theses', 'concepts*0.5::double')}::double}},
 {{'name': 'cases', 'value': {ratio('(cases+scenarios)', 'concepts')}::double}}, {{'name': 'repertoires', 'value': {ratio('repertoires', 'concepts*0.6::double')}::double}}, {{'name': 'enriched', 'value': {ratio('enriched', 'concepts')}::double}}], recursive := true) from n)""")
def cv1(v):
    return C.densities(counts(v))


def _cover_rows() -> str:
    parts = [
        ("recuperacion", ratio("concepts", "8")), ("relacion", ratio("relations", "concepts*1.5::double")),
        ("transferencia", f"0.6::double*{ratio('gold_cases', 'concepts*0.6::double')}+0.4::double*{ratio('scenarios', 'concepts*0.8::double')}"),
        ("anclaje", ratio("contrasted", "concepts*0.5::double")),
        ("automatizacion", f"{ratio('basic', 'concepts*0.3::double')}*(0.5::double+0.5::double*{ratio('synonyms', 'concepts')})"),
        *[(k, "1") for k in ("calibracion", "srl_accion", "srl_autorreflexion", "persistencia", "engagement", "srl_planeacion")],
        ("articulacion", f"least(1, 0.4::double+0.6::double*{ratio('(theses+cases)', 'concepts*0.8::double')})"),
    ]
    rows = [f"select '{k}' as dimension, round(({x})::double, 2) as coverage, ({x})::double < 0.6 as bottleneck from n" for k, x in parts]
    rows.append(f"select 'transferencia:lejana', round(({ratio('far', 'greatest(3, scenarios*0.3::double)')})::double, 2), far < 3 from n")
    rows.append("select 'relacion:espacio_atributos', 0::double, true from n where axes = 0")
    return " union all ".join(rows)


@book.page("cv2_signal_coverage", ALL, N + " " + _cover_rows())
def cv2(v):
    return C.signal_coverage(counts(v))


@book.page("cv3_family_availability", ALL, N + """ select 'A' as family, concepts >= 4 as available, case when concepts >= 4 then 'A1,A2,A3,A4' else '' end as mechanics from n union all
 select 'B', repertoires >= 2 or "distinct" >= 2, case when repertoires >= 2 or "distinct" >= 2 then 'B1,B2,B3' else '' end from n union all select 'C', relations >= 5, case when relations >= 5 then 'C1,C2,C3,C5' else '' end from n union all
 select 'D', relations >= 8 and clusters >= 1, case when relations >= 8 and clusters >= 1 then 'D1,D2,D3' else '' end from n union all select 'E', gold_cases >= 3, case when gold_cases >= 3 then 'E1,E2,E3,E4,E5' else '' end from n union all
 select 'F', theses >= 2 or concepts >= 4, case when theses >= 2 then 'F1,F4,F5,F2,F3' when concepts >= 4 then 'F1,F4,F5' else '' end from n union all select 'G', true, 'G1,G2,G3,G4,G5' from n union all
 select 'H', theses >= 1 or relations >= 5, case when theses >= 1 or relations >= 5 then 'H1,H2,H3,H4,H5' else '' end from n union all select 'I', true, 'I1,I2,I3,I4,I5' from n""")
def cv3(v):
    return C.family_availability(counts(v)).withColumn("mechanics", F.array_join("mechanics", ","))


@book.page("cv4_modalities", ALL, N + " select 'individual' || case when threshold > 0 then ',colaborativo' else '' end || case when opposed > 0 then ',debate' else '' end || case when theses >= 2 and frameworks > 0 then ',argumentacion' else '' end as modalities from n")
def cv4(v):
    return C.modalities(counts(v)).select(F.array_join("modalities", ",").alias("modalities"))


@book.page("cv5_difficulty_histogram", "v_concepts", "select d.difficulty, count(c.concept_id) as n from (values ('basico'), ('intermedio'), ('avanzado')) d(difficulty) left join v_concepts c on c.difficulty = d.difficulty group by all")
def cv5(v):
    return C.zero_filled(v("v_concepts"), "difficulty", ["basico", "intermedio", "avanzado"])


_LAYERS = """with l as (select user_id as doc_id, 'layer'||cast(event_id % 11 as string) as layer, event_id as seq, case event_type when 'click' then 'ok' when 'view' then 'empty' when 'error' then 'failed' when 'signup' then 'skipped' else 'running' end as status, cast(event_id % 50 as bigint) as items from events),
r as (select doc_id, layer, arg_max(status, seq) as status, arg_max(items, seq) as items from l group by all)"""


def layers(v):
    from quillstone.operators.profile import lookup

    status = lookup(F.col("event_type"), {"click": "ok", "view": "empty", "error": "failed", "signup": "skipped"}, "running")
    return v("events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("layer"), F.col("event_id") % 11).alias("layer"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 50).alias("items"))


@book.page("cv6_layer_status", "", _LAYERS + " select * from r")
def cv6(v):
    return C.layer_report(layers(v))


@book.page("cv6_layer_progress", "", _LAYERS + " select doc_id, least(1, round(count(*) filter (where status <> 'running') / 9, 2)) as progress, coalesce(string_agg(layer, ',' order by layer) filter (where status = 'failed'), '') as failed from r group by all")
def cv6_progress(v):
    return C.layer_progress(C.layer_report(layers(v))).withColumn("failed", F.array_join("failed", ","))


INVENTORY = N + """, inv as (select unnest([{'key': 'concepto', 'n': concepts}, {'key': 'sinonimos', 'n': synonyms}, {'key': 'distractores', 'n': repertoires}, {'key': 'arista', 'n': relations}, {'key': 'arista_tipo:causa', 'n': arista_tipo_causa},
 {'key': 'arista_tipo:contrasta', 'n': arista_tipo_contrasta}, {'key': 'cluster', 'n': clusters}, {'key': 'eje', 'n': axes}, {'key': 'caso_gold', 'n': gold_cases}, {'key': 'caso_error', 'n': error_cases}, {'key': 'tesis', 'n': theses}, {'key': 'marco_rival', 'n': rivals}], recursive := true) from n)"""
KEYS = {"concepto": "concepts", "sinonimos": "synonyms", "distractores": "repertoires", "arista": "relations", "arista_tipo:causa": "arista_tipo_causa", "arista_tipo:contrasta": "arista_tipo_contrasta", "cluster": "clusters", "eje": "axes", "caso_gold": "gold_cases", "caso_error": "error_cases", "tesis": "theses", "marco_rival": "rivals"}
_REQ = ", ".join(f"('{m}', '{k}', {n})" for m, k, n in M.REQUIREMENTS)
_EMIT = ", ".join(f"('{m}', '{d}')" for m, d, *_ in M.EMITS)
VERDICTS = INVENTORY + f""", req(mechanic_id, key, least) as (values {_REQ}), met as (select req.*, case key when 'juez' then true when 'peer' then false when 'ninguno' then true else coalesce(n, 0) >= least end as met from req left join inv using (key)),
agg as (select mechanic_id, bool_and(met) as available, coalesce(list_sort(list(key) filter (where not met)), []) as missing, bool_or(key = 'juez') as j, bool_or(key = 'peer') as p, bool_or(key = 'ninguno') as free from met group by all),
ver as (select mechanic_id, available, missing, case when not available then case when missing = ['peer'] then 'necesita_peer' else 'bloqueada' end when j then 'necesita_juez' when p then 'necesita_peer'
 when free or mechanic_id in ('{"', '".join(M.PLAYABLE)}') then 'lista' else 'sin_items' end as state from agg)"""


def inventory(v):
    row = counts(v).select(*[F.col(c).alias(k) for k, c in KEYS.items()])
    return C.tall(row, list(KEYS), "key", "n")


def verdicts(v):
    return C.verdicts(inventory(v), list(M.PLAYABLE))


@book.page("co25_inventory", ALL, INVENTORY + " select * from inv")
def co25(v):
    return inventory(v)


@book.page("co26_verdicts", ALL, VERDICTS + " select mechanic_id, available, array_to_string(missing, ',') as missing, state from ver")
def co26(v):
    return verdicts(v).withColumn("missing", F.array_join("missing", ","))


@book.page("co27_readiness", ALL, VERDICTS + f""", em(mechanic_id, dimension) as (select distinct * from (values {_EMIT}) t), x as (select dimension, ver.*, state = 'lista' and mechanic_id in ('{"', '".join(M.PLAYABLE)}') as pl from em join ver using (mechanic_id))
 select dimension, coalesce(string_agg(mechanic_id, ',' order by mechanic_id) filter (where pl), '') as now, coalesce(string_agg(mechanic_id, ',' order by mechanic_id) filter (where not pl and available), '') as potential,
 coalesce(string_agg(mechanic_id, ',' order by mechanic_id) filter (where not available), '') as blocked, count(*) filter (where pl) > 0 as measurable from x group by dimension""")
def co27(v):
    return C.readiness(verdicts(v)).withColumns({k: F.array_join(k, ",") for k in ("now", "potential", "blocked")})


@book.page("mechanics_catalogue", "", f"""with req(mechanic_id, key, least) as (values {_REQ}), em(mechanic_id, dimension) as (values {_EMIT}), m(mechanic_id, name, family) as (values {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in M.MECHANICS)})
select mechanic_id, name, family, (select count(*) from req r where r.mechanic_id = m.mechanic_id) as n_requirements, (select count(*) from em e where e.mechanic_id = m.mechanic_id) as n_signals from m""")
def catalogue(v):
    r = M.requirements(v.spark).groupBy("mechanic_id").agg(F.count(F.lit(1)).alias("n_requirements"))
    e = M.emits(v.spark).groupBy("mechanic_id").agg(F.count(F.lit(1)).alias("n_signals"))
    return M.mechanics(v.spark).join(r, "mechanic_id").join(e, "mechanic_id")
