"""Site-relative line frequency: drops lines that too many pages of one host repeat.

For every host, the pages that contain a line are divided by the host's pages; a line above
max_ratio that is on at least min_pages pages is boilerplate of that host and goes from all
its pages. A page counts a line once. Lines stand as SHA-256 digests while they are counted, which
are pre-aggregated before the shuffle, so a host with a third of all pages is no hot task. One plan
serves all sizes: texts of hosts with more than a thousandth of all pages, which are fewer than a
thousand, and of hosts without boilerplate stay where they are; those of other hosts are shuffled
by host, which is never a hot key. A host has at most 20 times as many boilerplate lines as a page
of it has lines on average, as each is on a twentieth of its pages or more.

Edge cases: a null text stays null with no lines; a null host is a host of its own; lines of
white space alone are never dropped; a line at the very ratio stays; repeated rows are pages each;
a text all of whose lines go becomes empty; texts of any length are taken whole; an empty table
gives no rows; further columns of the input are kept by drop_site_lines, whatever their names: its
own two get underscores until they are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, flagged, let, table, written

MAX_RATIO, MIN_PAGES = 0.05, 5
#: Lines of hot hosts that are broadcast at most (32 bytes each); more are joined by a shuffle whose skewed partitions Spark splits.
HOT_LINES = 1 << 20
WORD = r"[^\x20\x09-\x0D]"


def _key(host: Column) -> Column:
    """A host as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def _digest(line: Column) -> Column:
    return F.unhex(F.sha2(line.cast("binary"), 256))


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host key, pages and bad (sorted digests of its boilerplate lines) of hosts that have any."""
    pages = docs.select(_key(host).alias("host"), text.cast("string").alias("t"))
    n_pages = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    seen = pages.select("host", F.explode(lines).alias("line")).groupBy("host", _digest(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= min_pages).join(n_pages, "host").where(F.col("n") > max_ratio * F.col("pages"))
    return often.groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("line")).alias("bad"))


def drop_site_lines(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text_col freed of boilerplate, and __n_lines and __n_dropped (long) as last columns."""
    # the input is one column meanwhile, under names that can't clash with any of ours
    own = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select("*", host.alias("host")).toDF(*own, "host")
    text = F.col(own[docs.columns.index(text_col)])
    bad = written(boilerplate(rows, F.col("host"), text, max_ratio, min_pages), "site-lines")
    most = docs.count() // HOT_SHARE
    whole = rows.select(F.struct(*own).alias("whole"), text.cast("string").alias("t"), _key(F.col("host")).alias("host"))
    hot = bad.where(F.col("pages") > most).select("host", "bad")
    if (hot.agg(F.sum(F.size("bad"))).first()[0] or 0) <= HOT_LINES:
        hot = F.broadcast(hot)
    cool = bad.where(F.col("pages") <= most).select("host", "bad")
    of_hot = whole.join(hot, "host", "left").select("whole", "t", "host", "bad")
    rest = flagged(of_hot.where("bad is null"), cool, ["host"])
    held = ("whole", "t", "bad")
    joined = of_hot.where("bad is not null").select(*held).unionByName(rest.where(~F.col("maybe")).select(*held))
    joined = joined.unionByName(rest.where("maybe").drop("bad").join(cool, "host", "left").select(*held))
    clean = let(F.col("bad"), lambda bad: F.filter(F.split("t", "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(bad, _digest(x)))))
    out = joined.select("whole", "t", F.when(F.col("bad").isNull(), F.split("t", "\n")).otherwise(clean).alias("stays"))
    n = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(F.split("t", "\n"))).cast("long")
    dropped = F.when(F.col("t").isNull(), F.lit(0)).otherwise(n - F.size("stays")).cast("long")
    text = F.when(F.col("t").isNotNull(), F.array_join("stays", "\n")).alias(text_col)
    more = []
    for name, value in (("__n_lines", n), ("__n_dropped", dropped)):
        while name in docs.columns:
            name += "_"
        more.append(value.alias(name))
    return out.select(*[text if c == text_col else F.col(f"whole.{k}").alias(c) for c, k in zip(docs.columns, own)], *more)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_site_lines(docs, F.col("source"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE = {
    "op5_line_dedup": f"""
with d as (select row_number() over () as rid, doc_id, coalesce('h' || source, '') as host, text from documents),
n as (select host, count(*) as pages from d group by host),
l as (select rid, doc_id, host, generate_subscripts(ls, 1) as k, unnest(ls) as line from (select *, string_split(text, chr(10)) as ls from d)),
f as (select host, line, count(distinct rid) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by host, line),
bad as (select f.host, line from f join n using (host) where f.n >= {MIN_PAGES} and f.n > {MAX_RATIO} * pages),
m as (select l.*, bad.line is not null as gone from l left join bad using (host, line)),
a as (select rid, count(*) as n_lines, count(*) filter (where gone) as n_dropped, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as t from m group by rid)
select doc_id::bigint as doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(t, '')) as text_sha256
from d left join a using (rid)"""
}
