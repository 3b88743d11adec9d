"""Quality rules: base counts and distribution divergence, all in DataFrame functions.

A document's histogram of character classes and of common words is compared with references
by Jensen-Shannon distance (base 2, 0 to 1). A reference is the mean of the shares of all
documents of one language, each of equal weight, so that a few long ones don't make it; documents
without a language have the reference of all documents, and every document may instead match
that one, so that a wrong label alone drops nothing.
Guards: a histogram of too few characters or words isn't judged. The same 64-bit hash stands
for the same 8-word window. Edge cases: a null text is empty and fails the base rule; a null
language uses the reference of all documents; repeated rows are judged each, equally; ties stay
(a distance must be above its bound); texts of any length are counted whole; an empty table gives
no rows; only the id, text and language columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, placed, table, without_rows, written

# Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in is that for it with as on be by this are "
    "der die und den von zu das mit sich des auf nicht ein ist im dem "
    "le la de et les des un une du que qui pour dans par sur est "
    "el en los del se las por con una no su al y a lo como"
)
WORDS = tuple(dict.fromkeys(COMMON_WORDS.split()))
SPACE = r"[\x20\x09-\x0D]"
#: Classes of characters; what is left over is a class of its own.
CLASSES = {"upper": r"\p{Lu}", "symbol": "#*$%&|<>", "stop": r".,;:!?'\"()-"}
MIN_WORDS, MAX_REPEAT = 20, 30
#: The character distance, or the sum of both distances, above these drops a document that has
#: at least so many characters or words. Fitted to labelled documents: few clean ones go.
MAX_CHAR_DISTANCE, MAX_BOTH_DISTANCES = 0.22, 0.44
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 400, 80
#: A document's shares are summed in whole parts of this, so that the order of addition doesn't matter.
PARTS = 1_000_000
#: References of so many languages are broadcast (under 1 KB each); more are joined by shuffle.
BROADCAST_LANGS = 10_000


def _count(c: Column, of: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{of}]+", "")).cast("long")


def one_of(words) -> str:
    """A pattern of exactly these words that shares their beginnings."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            by.setdefault(w[0], []).append(w[1:])
    body = "|".join(c + (one_of(tails) if tails != [""] else "") for c, tails in by.items())
    return f"(?:{body})" + ("?" if "" in words else "")


def _repeated(words: Column) -> Column:
    """Words in 8-word windows found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            marked = F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), (same(e, k - 1) & (k > 0) | same(e, k + 1)).alias("r")))
            return F.sort_array(F.transform(F.filter(marked, lambda x: x["r"]), lambda x: x["i"]))

        steps = let(let(pairs, starts), lambda p: F.transform(p, lambda x, k: F.when(k == 0, 8).otherwise(F.least(F.lit(8), x - F.get(p, F.greatest(k - 1, F.lit(0)))))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(w: Column) -> Column:
        of_words = F.transform(w, lambda x: F.xxhash64(x))
        hashes = let(of_words, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 7), lambda i: F.xxhash64(F.slice(x, i, 8))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) > 8, of(words)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", place: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base counts, and the histograms chars and words (array<long>), after the
    columns in place."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(*place, docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), text.alias("t"))
    t = F.col("t")
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.regexp_extract_all(F.lower(t), F.lit(rf"(?<![^\x20\x09-\x0D])({one_of(WORDS)})(?![^\x20\x09-\x0D])"), F.lit(1))
    out = base.select(
        *place,
        "doc_id",
        "lang",
        F.length(t).cast("long").alias("n_chars"),
        *[_count(t, v).alias(k) for k, v in CLASSES.items()],
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeated(w).alias("r"))).alias("w"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(common, lambda m: F.array(*[(F.size(m) - F.size(F.array_remove(m, w))).cast("long") for w in WORDS])).alias("found"),
    )
    named = [F.col(k) for k in CLASSES]
    rest = F.col("w.c") - sum(named[1:], named[0])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        *place,
        "doc_id",
        "lang",
        F.col("w.n").alias("n_words"),
        F.col("w.c").alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"),
        F.array(*named, F.col("n_chars") - F.col("w.c"), rest).alias("chars"),
        F.concat("found", F.array(F.col("w.n") - total(F.col("found")))).alias("words"),
    )


def references(counted: DataFrame) -> DataFrame:
    """lang (null: of all documents), chars and words as shares, from all documents."""
    millionths = lambda c: let(F.col(c), lambda a: F.transform(a, lambda x: F.round(x * PARTS / F.greatest(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(1))).cast("long")))
    parts = counted.select("lang", millionths("chars").alias("chars"), millionths("words").alias("words"))
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)]
    sums += [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    by_lang = written(parts.groupBy("lang").agg(*sums), "quality-references")
    names = by_lang.columns[1:]
    pooled = by_lang.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(F.lit(None).cast("string").alias("lang"), *names)
    share = lambda p: let(F.array(*[F.col(n) for n in names if n[0] == p]), lambda a: F.transform(a, lambda x: x / F.greatest(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(1))))
    return by_lang.where("lang is not null").unionByName(pooled).select("lang", share("c").alias("chars"), share("w").alias("words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", place: tuple[str, ...] = ()) -> DataFrame:
    """The base counts with char_distance, word_distance, base_failed and kept of every row."""
    counted = written(counts(docs, id_col, text_col, lang_col, place), "quality-counts")
    refs = references(counted).select("lang", F.struct("chars", "words").alias("r"))
    refs = written(refs, "quality-shares")
    pooled = refs.where("lang is null").select("r").first()
    own = refs.where("lang is not null")
    if own.count() <= BROADCAST_LANGS:
        own = F.broadcast(own)
    shares = lambda c: let(F.col(c), lambda a: F.transform(a, lambda x: x / F.greatest(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(1))))
    doubles = lambda a: F.array(*[F.lit(float(x)) for x in a])
    both = lambda p, k: F.least(distance(p, F.col(f"r.{k}")), distance(p, doubles(pooled["r"][k])))  # noqa: E731  a null distance is passed over
    out = counted.join(own, "lang", "left").withColumn("char_distance", let(shares("chars"), lambda p: both(p, "chars"))).withColumn("word_distance", let(shares("words"), lambda p: both(p, "words")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    far = (F.col("word_chars") >= MIN_CHARS_JUDGED) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far |= (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.col("char_distance") + F.col("word_distance") > MAX_BOTH_DISTANCES)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    rows, names = placed(docs, "quality-documents")
    own = [f"c{names.index(c)}" for c in (id_col, text_col, lang_col)]
    dropped = judged(rows, *own, place=("path", "row")).where("not kept").select("path", "row")
    return without_rows(rows, written(dropped, "quality-dropped")).drop("path", "row").toDF(*names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*cols)


QUERIES = {"op4_quality": op4_quality}


def _oracle() -> str:
    space, n_char, n_word = SPACE, len(CLASSES) + 2, len(WORDS) + 1
    classes = ", ".join("length(regexp_replace(t, '[^" + v.replace("'", "''").replace('\\"', '"').replace("\\''", "''") + "]+', '', 'g')) as " + k for k, v in CLASSES.items())
    found = ", ".join(f"len(list_filter(m, lambda x: x = '{w}'))" for w in WORDS)
    sums = ", ".join([f"sum(chars[{i}]) as c{i}" for i in range(1, n_char + 1)] + [f"sum(words[{i}]) as w{i}" for i in range(1, n_word + 1)])
    arrays = f"[{', '.join(f'c{i}' for i in range(1, n_char + 1))}]::double[] as c, [{', '.join(f'w{i}' for i in range(1, n_word + 1))}]::double[] as w"
    share = lambda a: f"list_transform({a}, lambda x: x / greatest(list_sum({a}), 1))"
    millionths = lambda a: f"list_transform({a}, lambda x: round(x * {PARTS} / greatest(list_sum({a}), 1)))"
    part = lambda x, y: f"case when {x} > 0 then {x} * log2({x} / (({x} + {y}) / 2)) else 0 end"
    dist = lambda p, q, n: f"sqrt(greatest(list_sum(list_transform(range(1, {n} + 1), lambda i: ({part(f'{p}[i]', f'{q}[i]')} + {part(f'{q}[i]', f'{p}[i]')}) / 2)), 0))"
    return f"""
with d as materialized (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
s as materialized (select *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') as ws,
  list_filter(regexp_split_to_array(lower(t), '{space}+'), lambda x: x in ('{"', '".join(WORDS)}')) as m,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls,
  length(regexp_replace(t, '{space}+', '', 'g')) as word_chars, {classes} from d),
win as (select rid, i, array_to_string(ws[i:i+7], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from s where len(ws) > 8)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from win) where n > 1),
rep as (select rid, sum(k) as r from (select rid, coalesce(least(8, i - lag(i) over (partition by rid order by i)), 8) as k from hit) group by rid),
c as materialized (select s.rid, doc_id, lang, len(ws) as n_words, word_chars, symbol as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(r, 0) as n_repeat_words, [{', '.join(CLASSES)}, length(t) - word_chars, word_chars - {' - '.join(CLASSES)}]::double[] as chars,
  [{found}, len(ws) - len(m)]::double[] as words from s left join rep using (rid)),
sums as (select lang, {sums} from (select lang, {millionths('chars')} as chars, {millionths('words')} as words from c) group by lang),
refs as (select lang, {share('c')} as rc, {share('w')} as rw from (select lang, {arrays} from sums where lang is not null)),
pool as (select {share('c')} as pc, {share('w')} as pw from (select {arrays} from (select {', '.join([f'sum(c{i}) as c{i}' for i in range(1, n_char + 1)] + [f'sum(w{i}) as w{i}' for i in range(1, n_word + 1)])} from sums))),
p as (select c.*, {share('chars')} as cs, {share('words')} as wsh from c),
j as (select p.*, least({dist('cs', 'rc', n_char)}, {dist('cs', 'pc', n_char)}) as cd, least({dist('wsh', 'rw', n_word)}, {dist('wsh', 'pw', n_word)}) as wd
  from p left join refs on p.lang = refs.lang cross join pool),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from j)
select doc_id::bigint as doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not (word_chars >= {MIN_CHARS_JUDGED} and cd > {MAX_CHAR_DISTANCE})
  and not (n_words >= {MIN_WORDS_JUDGED} and cd + wd > {MAX_BOTH_DISTANCES}) as kept from f"""


ORACLE = {"op4_quality": _oracle()}
