"""Derived views that give the driver tables the shape of the engine's entities.

The same SQL text runs in Spark and, as common table expressions, in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LINE_ORDER = "order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate"

VIEWS = {
    "v_concepts": """
select 'c'||cast(p_partkey as string) as concept_id, p_partkey as seq, p_name as title,
       p_name||' '||p_type||' '||p_brand as definition,
       case when p_type in ('STANDARD','LARGE') then 'teorico' when p_type in ('ECONOMY','SMALL') then 'empirico'
            when p_type='MEDIUM' then 'metodologico' else 'aplicado' end as tipo,
       case when p_size<=16 then 'basico' when p_size<=33 then 'intermedio' else 'avanzado' end as difficulty,
       (p_retailprice-cast(900 as double))/cast(100 as double) as importance,
       p_size%10=0 as is_gateway, p_size%10=5 as is_threshold, p_size%4=0 as is_enriched,
       cast(p_partkey%40+1 as int) as first_page, p_brand as cluster_id
from part""",
    "v_relations_raw": f"""
select doc_id, cast(ln as bigint) as seq,
       'c'||cast(f%220 as string) as from_concept_id, 'c'||cast(t%220 as string) as to_concept_id,
       case cast(q as int)%11 when 0 then 'apoya' when 1 then 'contradice' when 2 then 'matiza' when 3 then 'extiende'
            when 4 then 'requiere' when 5 then 'causa' when 6 then 'ejemplifica' when 7 then 'generaliza'
            when 8 then 'contrasta' when 9 then 'Sustenta' else 'otro' end as relation_type,
       round(cast(0.3 as double)+d*cast(7 as double),2) as confidence
from (select l_orderkey as doc_id, row_number() over w as ln, l_partkey as f, lead(l_partkey) over w as t,
             l_quantity as q, l_discount as d
      from lineitem window w as (partition by l_orderkey {_LINE_ORDER})) x
where t is not null""",
    "v_signals": """
select event_id, user_id as student_id, ts, 'c'||cast(event_id%100 as string) as concept_id,
       case event_type when 'click' then 'recuperacion' when 'purchase' then 'transferencia' when 'view' then 'automatizacion'
            when 'error' then 'anclaje' else 'srl_accion' end as dimension,
       case when event_type in ('click','purchase') then 'escalar' when event_type='view' then 'temporal'
            else 'observacional' end as forma,
       (value/cast(500 as double)-cast(0.5 as double))*cast(0.4 as double) as delta,
       cast(round(value*100) as int) as latencia_ms,
       cast(event_id%4 as int) as hints_used, cast(event_id%3 as int) as scaffolds,
       cast(2+event_id%3 as double) as n_efectivo
from events""",
    "v_repertoires": """
select 'r'||cast(s_suppkey as string) as repertoire_id, 'c'||cast(s_suppkey%220 as string) as concept_id, s_name as label,
       case when s_acctbal>3000 then 'contrast '||s_name else '' end as contraste_cientifico,
       case when s_suppkey%3=0 then 'c'||cast((s_suppkey+7)%220 as string) end as concepto_confundido
from supplier""",
    "v_frameworks": """
select 'f'||cast(n_nationkey as string) as framework_id, n_name as label,
       'f'||cast((n_nationkey*3+1)%30 as string) as rival_id
from nation""",
    "v_theses": """
select 't'||cast(c_custkey as string) as thesis_id, c_mktsegment||' '||cast(c_nationkey as string) as statement,
       'c'||cast(c_custkey%220 as string) as concept_id, 'f'||cast(c_nationkey+c_custkey%3*10 as string) as framework_id,
       case when c_custkey%5=0 then 'generic criterion' else 'criterion '||c_name end as refutation_criterion
from customer""",
    "v_cases": """
select 'k'||cast(o_orderkey as string) as case_id, 'c'||cast(o_custkey%220 as string) as primary_concept_id,
       case when o_orderkey%2=0 then lower(o_orderpriority)||'.' else ' '||o_orderpriority end as dominio,
       case when o_orderstatus='F' then '' else 'gold '||o_orderstatus end as resolucion_esperada,
       o_orderkey%3=0 as prediction_enabled,
       case when o_orderkey%7=0 then 'error '||o_orderstatus end as error_embebido
from orders""",
    "v_scenarios": f"""
select 's'||cast(l_orderkey as string)||'_'||cast(rn as string) as scenario_id,
       'k'||cast(l_orderkey+(rn%5)*20 as string) as parent_case_id, 'c'||cast(l_partkey%220 as string) as concept_id,
       case l_suppkey%5 when 0 then '1-URGENT' when 1 then '2-high' when 2 then '3-MEDIUM' when 3 then '' else '5-LOW' end as dominio,
       case l_returnflag when 'A' then 'cercana' when 'N' then 'lejana' else 'INVALID' end as distancia
from (select *, row_number() over (partition by l_orderkey {_LINE_ORDER}) as rn from lineitem) x""",
    "v_qa": """
select conv_id, turn, answer, gold from
  (select conv_id, turn, role, text as answer, lead(text) over (partition by conv_id order by turn) as gold,
          lead(role) over (partition by conv_id order by turn) as next_role from conversations) x
where role='user' and next_role='assistant'""",
    "v_quotes": "select item_id as quote_id, text as quote from benchmark",
    "v_pages": "select page_id, url, regexp_extract(html,'<h1>(.*?)</h1>',1) as h1 from pages",
}
#: Lines of documents as paragraphs; the engines write this one differently.
SEGMENTS_SPARK = "select doc_id, cast(pos as bigint) as seq, line as text from {documents} lateral view posexplode(split(text, '\\n')) t as pos, line"
SEGMENTS_DUCKDB = "select doc_id, generate_subscripts(ls, 1) - 1 as seq, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream: its folder, or the one file of a folder. Any store that Spark reads."""
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table by its name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = SEGMENTS_SPARK if name == "v_segments" else re.sub(r"\bfrom (\w+)\b(?=\s|$|\))", lambda m: f"from {{{m[1]}}}" if m[1] in TABLES else m[0], VIEWS[name])
    used = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **used)


def oracle(views: str, body: str) -> str:
    """DuckDB text of body over the named views (space separated)."""
    ctes = [f"{v} as ({SEGMENTS_DUCKDB if v == 'v_segments' else VIEWS[v]})" for v in views.split()]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes + [body[15:]])}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes + [body[5:]])}" if ctes else body
    return f"with {', '.join(ctes)} {body}" if ctes else body
