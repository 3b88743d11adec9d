"""Source divergence audit: how far the sources of a language differ, and by which terms, from sorted runs.

Tasks count the terms of their documents and emit partial counts (language, term, source, first
document); these are dealt by language, term and source, sorted within partitions by all four, and a
run-length scan adds them up. A second scan over runs of one language and term yields its document
frequency and counts, a third, with smoothed shares, emits partial sums for every pair of sources
that a run has. No run is longer than the number of sources, or of tasks in the first scan.

A term's share in a source that lacks it is the same for all such terms, so what a pair of sources
gets from terms that one or both lack is added up from each source's histogram of shares, and the
work grows with the counts there are instead of with terms times pairs. Shares are integers of
billionths, sums are exact.

    share(term) = 1 + floor(10^9 * (count + 1) / (all counts + terms))
    f(p, q) = floor((p - q)^2 / q)

Edge cases: null text, lang and source are empty strings; a document is a row, so repeated rows count
each; a language without kept terms has no term rows and pairs of value 0; a source alone in its
language has no pairs; ties rank by the bytes of the item; texts of any length are counted whole, in
slices; an empty table gives no rows; further columns can have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, picked, table, whole_runs, written

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: A task holds at most so many counts, slices of so many bytes of a text, and so many entries of pairs.
ENTRIES, SLICE, PAIRS = 1 << 19, 1 << 20, 1 << 20
_OTHER = bytes(b for b in range(128) if not chr(b).isalpha())
#: Bytes of a text: A-Z lower-cased, other ASCII characters than letters are spaces.
TERM_BYTES = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))
PARTIAL = "lang string, term string, source string, document long, docs long, n long"
COUNTED = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, lang_n long, first boolean"
SUMS = "lang string, source string, item string, value long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def slices_of_terms(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, those of about size bytes at a time."""
    at = 0
    while at < len(text):
        part = text[at : at + size].translate(TERM_BYTES)
        at += len(part)
        if at < len(text) and part[-1:] != b" ":  # up to the end of the term
            rest = bytearray()
            while at < len(text) and not rest.endswith(b" "):
                more = text[at : at + 64].translate(TERM_BYTES)
                end = more.find(b" ") + 1 or len(more)
                rest += more[:end]
                at += end
            part += rest
        yield part.split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's documents (lang, source, text)."""
    schema = _arrow(PARTIAL)
    document, entries, tally = TaskContext.get().partitionId() << 40, 0, {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (first, docs, ns) in tally.items():
            terms = list(ns)
            for k in range(0, len(terms), 1 << 15):
                own = terms[k : k + (1 << 15)]
                size = len(own)
                columns = [[lang] * size, pa.array(own, pa.binary()).cast(pa.string()), [source] * size, [first] * size, [docs[t] for t in own], [ns[t] for t in own]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(j).type) for j, c in enumerate(columns)], schema=schema)

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            document += 1
            _, docs, ns = tally.setdefault((lang, source), (document, Counter(), Counter()))
            before, seen = len(ns), set()
            for terms in slices_of_terms(text.as_py()):
                ns.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(ns) - before
            if entries > ENTRIES:
                yield from rows()
                entries, tally = 0, {}
    yield from rows()


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts sorted by lang, term, source, document: one row for each run of the first three."""
    for b, at in whole_runs(batches, [0, 1, 2]):
        keys = [b.column(k).take(pa.array(at)) for k in range(3)]
        sums = [pa.array(np.add.reduceat(b.column(k).to_numpy(), at)) for k in (4, 5)]
        yield pa.RecordBatch.from_arrays(keys + sums, schema=_arrow(COUNTED))


def kept_runs(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of the runs (lang, term) that min_docs documents have, with the language's count; first marks a run's first row."""
    for b, at in whole_runs(batches, [0, 1]):
        sizes = np.diff(at, append=b.num_rows)
        ns = b.column(4).to_numpy()
        stay = np.repeat(np.add.reduceat(b.column(3).to_numpy(), at) >= min_docs, sizes)
        first = np.zeros(b.num_rows, dtype=bool)
        first[at] = True
        columns = [b.column(0), b.column(1), b.column(2), b.column(4), pa.array(np.repeat(np.add.reduceat(ns, at), sizes)), pa.array(first)]
        yield pa.RecordBatch.from_arrays(columns, schema=_arrow(KEPT)).filter(pa.array(stay))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PairSums:
    """Sums by pair of sources, at most some PAIRS of them held."""

    def __init__(self):
        self.codes, self.names, self.held, self.size = {}, [], [], 0

    def code(self, lang: str, source: str) -> int:
        k = self.codes.setdefault((lang, source), len(self.names))
        if k == len(self.names):
            self.names.append((lang, source))
        return k

    def add(self, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(((g << 32 | h).ravel(), value.ravel()))
        self.size += value.size
        if self.size > 4 * PAIRS:
            self.combine()
            if self.size > PAIRS:
                yield from self.rows()

    def combine(self) -> None:
        if not self.held:
            return
        codes, back = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
        sums = np.zeros(len(codes), dtype=np.int64)
        np.add.at(sums, back, np.concatenate([v for _, v in self.held]))
        self.held, self.size = [(codes, sums)], len(codes)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.combine()
        for codes, sums in self.held:
            for k in range(0, len(codes), 1 << 15):
                own = codes[k : k + (1 << 15)]
                g, h = [[self.names[c] for c in x.tolist()] for x in (own >> 32, own & 0xFFFFFFFF)]
                columns = [[x[0] for x in g], [x[1] for x in g], [x[1] for x in h], sums[k : k + (1 << 15)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _arrow(SUMS))], schema=_arrow(SUMS))
        self.held, self.size, self.codes, self.names = [], 0, {}, []


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows lang, term, source, p, z (z: share of a term that the source lacks), sorted by the first three: partial
    sums for pairs of sources that share a term, of what their shares add over one or both lacking it."""
    sums = PairSums()
    for b, at in whole_runs(batches, [0, 1]):
        lang, source = b.column(0).to_pylist(), b.column(2).to_pylist()
        own = np.array([sums.code(*x) for x in zip(lang, source)], dtype=np.int64)
        p, z = b.column(3).to_numpy(), b.column(4).to_numpy()
        sizes = np.diff(at, append=b.num_rows)
        for k in np.unique(sizes[sizes > 1]).tolist():  # runs of as many sources at a time
            starts = at[sizes == k]
            many = max(1, PAIRS // (k * k))
            for j in range(0, len(starts), many):
                place = starts[j : j + many, None] + np.arange(k)
                for lo in range(0, k, max(1, PAIRS // k)):  # and of a long run some rows at a time
                    g = place[:, lo : lo + max(1, PAIRS // k)]
                    pg, zg, gg = p[g][:, :, None], z[g][:, :, None], own[g][:, :, None]
                    ph, zh, gh = p[place][:, None], z[place][:, None], own[place][:, None]
                    value = _f(pg, ph) - _f(pg, zh) - _f(zg, ph) + _f(zg, zh)
                    yield from sums.add(*np.broadcast_arrays(gg, gh), value)
                    if not sums.names:  # handed over
                        own = np.array([sums.code(*x) for x in zip(lang, source)], dtype=np.int64)
    yield from sums.rows()


def _share(n: Column, total: Column, terms: Column) -> Column:
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(20,0)") * (n + 1).cast("decimal(18,0)"), F.greatest(total + terms, F.lit(1)).cast("decimal(38,0)"))
    return whole.cast("long") + 1


def _floor_ratio(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of every source the other sources of its language by divergence (part
    pair, all of them), and the top terms that it has more of than its language (part term)."""
    spark = docs.sparkSession
    texts = picked(docs, {"lang": lang_col, "source": source_col, "text": text_col})
    texts = texts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts.columns])
    with arrow_batches(spark):
        partial = texts.mapInArrow(counted, PARTIAL)
        runs = partial.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(added, COUNTED)
        runs = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(lambda batches: kept_runs(batches, min_docs), KEPT)
        kept = written(runs, "divergence-kept")

        of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("first"), 1)).alias("firsts"))
        groups = texts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).join(of_group, ["lang", "source"], "left")
        groups = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "firsts")]), "divergence-groups")
        langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
        zero = _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
        stats = written(groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "terms", zero.alias("z")), "divergence-stats")

        shares = kept.join(stats, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
        shared = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(pair_sums, SUMS)
        both = written(shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "divergence-pairs")

    other = stats.select("lang", F.col("source").alias("item"), F.col("z").alias("zi"))
    apart = F.col("source") != F.col("item")
    neither = stats.join(other, "lang").where(apart).select("lang", "source", "item", (F.col("terms") * _floor_ratio(F.col("z"), F.col("zi"))).alias("value"))
    histogram = shares.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("of")).join(other, "lang").where(apart)
    ahead = F.col("of") * (_floor_ratio(F.col("p"), F.col("zi")) - _floor_ratio(F.col("z"), F.col("zi")))
    behind = F.col("of") * (_floor_ratio(F.col("zi"), F.col("p")) - _floor_ratio(F.col("zi"), F.col("z")))
    one = histogram.groupBy("lang", "source", "item").agg(F.sum(ahead).alias("ahead"), F.sum(behind).alias("behind"))
    pairs = neither.unionByName(both.where(apart))
    pairs = pairs.unionByName(one.select("lang", "source", "item", F.col("ahead").alias("value")))
    pairs = pairs.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("behind").alias("value")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _floor_ratio(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return ranked.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


_SQL_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_F = "(({p} - {q})::hugeint * ({p} - {q}) // {q})"
QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE = {
    "op11_source_divergence": f"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(text, '{_SQL_TERM}')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by lang, term having count(distinct rid) >= {MIN_DOCS}),
langs as (select lang, coalesce(v, 0) as v, coalesce(n, 0) as n from (select distinct lang from d) left join (select lang, count(*) as v, sum(lang_n) as n from kept group by lang) using (lang)),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
g as (select lang, source, coalesce(n, 0) as total from (select distinct lang, source from d) left join (select lang, source, sum(n) as n from c group by all) using (lang, source)),
p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as own,
  (1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 1) // (g.total + langs.v))::bigint as p, (1 + {SCALE}::hugeint * (kept.lang_n + 1) // (langs.n + langs.v))::bigint as q
  from g join langs using (lang) join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
pairs as (select a.lang, a.source, b.source as item, sum({_SQL_F.format(p="a.p", q="b.p")}) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, {_SQL_F.format(p="p", q="q")}::bigint as value from p where own > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from all_pairs union all by name from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}"""
}
