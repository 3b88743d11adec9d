"""Segmentation of documents, section routing and character budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.functions.patterns import phrases_found
from quillstone.functions.text import source_norm
from quillstone.sources.shared import written

# Section patterns in order of precedence, and the sections of each layer in order of preference.
PATTERNS = (
    ("backmatter", r"referenc|bibliograf|apéndic|apendic|appendix|acknowledg|agradecim|anexo|funding|conflict of interest|declaration"),
    ("abstract", r"^\s*(abstract|resumen|summary)\b"),
    ("conclusion", r"conclusi|closing remarks|final remarks|consideraciones finales"),
    ("discussion", r"discusi|discussion|general discussion|implicacion|implications|limitacion|limitations"),
    ("results", r"resultad|results|findings|hallazgos|análisis de datos|analisis de datos|data analysis|experiment \d|estudio \d|study \d"),
    ("method", r"m[ée]todo|method|materials|participant|procedimiento|procedure|muestra|sample|dise[ñn]o|design|instrument|medida|measures"),
    ("theory", r"marco te[óo]rico|theoretical|background|literature|estado del arte|related work|antecedent|revisi[óo]n|framework|fundament"),
    ("intro", r"^\s*(1\.?\s*)?(introducci[óo]n|introduction)\b|planteamiento|the present study|el presente estudio"),
)
ROUTES = {
    "concepts": "abstract intro theory method results discussion conclusion other",
    "relations": "theory discussion intro conclusion other results method",
    "enrichment": "intro theory results discussion conclusion other",
    "repertoires": "intro discussion theory conclusion",
    "arguments": "discussion conclusion theory intro",
    "cases": "results method discussion theory",
}
SPANS = {"concepts": (0.0, 1.0), "relations": (0.0, 1.0), "enrichment": (0.0, 1.0), "repertoires": (0.0, 0.35), "arguments": (0.55, 1.0), "cases": (0.30, 0.90)}


def is_heading(text: Column, bold: Column, mean_size: Column) -> Column:
    """A short line that doesn't end like a sentence and is bold or large."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.,;]$") & (F.coalesce(bold, F.lit(False)) | (F.coalesce(mean_size, F.lit(0.0)) > 13))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def islands(lines: DataFrame, heading: Column, keys: tuple[str, ...] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Segments between headings: the heading is the title, the lines below it are the text."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("h", heading).withColumn("island", F.sum(F.col("h").cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct(order, "text")))), lambda x: x["text"]), " ")
    title = F.max(F.when(F.col("h"), F.col("text")))
    out = marked.groupBy(*keys, "island").agg(F.coalesce(title, F.lit("Introducción")).alias("section_title"), collapsed(text).alias("text"))
    return out.where("text != ''").withColumn("char_count", F.length("text"))


def fold(rows: DataFrame, key: str, step, schema: str) -> DataFrame:
    """step(group sorted by seq) of every group; for steps that depend on what they did before.

    A group is one document or one student, which bounds it."""
    return rows.groupBy(key).applyInPandas(lambda pdf: step(pdf.sort_values("seq", kind="stable")), schema)


def folded(rows: DataFrame, key: str, step, schema: str) -> DataFrame:
    """fold for steps that take a group as a list of tuples in order (the columns of rows without key and seq) and give tuples
    without key, which is the first column of schema: many groups share an Arrow batch, so small ones cost no call of Python each."""
    fields = [c for c in rows.columns if c not in (key, "seq")]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kinds)
        own, now, out = [], None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if own and k != now:
                    out += [(now, *o) for o in step(own)]
                    own = []
                    if len(out) >= 20_000:
                        yield made()
                        out = []
                now = k
                own.append(row)
        out += [(now, *o) for o in step(own)] if own else []
        if out:
            yield made()

    return rows.repartition(key).sortWithinPartitions(key, "seq").select(key, *fields).mapInArrow(run, schema)


def _in_order(rows: DataFrame, key: str, order: str, fields: dict[str, Column]) -> DataFrame:
    """key and rows: a document's rows as one array of structs, in order. A document is a group, whatever its size."""
    each = F.struct(F.col(order).alias("o"), *[c.alias(f) for f, c in fields.items()])
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("rows"))


def _slice(first: Column, last: Column) -> Column:
    return F.slice("rows", first, last - first + 1)


def segmented(lines: DataFrame, heading: Column, max_chars: int = 4000, least: int = 100, title: str = "Introducción") -> DataFrame:
    """Segments of documents, cut at headings and at size: doc_id, seq, section_title, text, pages, char_count.

    A heading below text ends a segment and is the next one's title; with no text before it, it is text itself. A segment
    that reaches max_chars ends there; the next one keeps its title and begins on the same page. White space in a text
    is collapsed, and segments of at most `least` characters go. lines: doc_id, seq, text, page; blank ones don't count.

    One fold over a document's lines in the JVM: its state is the cuts so far, so a line copies nothing."""
    text = F.trim("text")
    rows = lines.where(text != "").withColumn("h", F.coalesce(heading, F.lit(False)))
    rows = _in_order(rows, "doc_id", "seq", {"text": text, "page": F.col("page").cast("int"), "h": F.col("h"), "size": F.length(text)})
    cut = "struct<first:int,last:int,title:int,carry:int>"
    zero, no_page = F.lit(0), F.lit(None).cast("int")
    state = lambda cuts, k, first, size, title, carry: F.struct(cuts.alias("cuts"), k.cast("int").alias("k"), first.cast("int").alias("first"), size.cast("int").alias("size"), title.cast("int").alias("title"), carry.alias("carry"))
    ended = lambda acc, first, last: F.concat(acc["cuts"], F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), acc["title"].alias("title"), acc["carry"].alias("carry"))))

    def step(acc: Column, x: Column) -> Column:
        k, first, size = acc["k"] + 1, F.when(acc["first"] > 0, acc["first"]).otherwise(acc["k"] + 1), acc["size"] + x["size"]
        return (
            F.when(x["h"] & (acc["first"] > 0), state(ended(acc, acc["first"], acc["k"]), k, zero, zero, k, no_page))
            .when(size >= max_chars, state(ended(acc, first, k), k, zero, zero, acc["title"], x["page"]))
            .otherwise(state(acc["cuts"], k, first, size, acc["title"], acc["carry"]))
        )

    start = state(F.array().cast(f"array<{cut}>"), zero, zero, zero, zero, no_page)
    finish = lambda acc: F.when(acc["first"] > 0, ended(acc, acc["first"], acc["k"])).otherwise(acc["cuts"])
    cuts = rows.withColumn("cuts", F.aggregate("rows", start, step, finish))

    def made(c: Column) -> Column:
        own = _slice(c["first"], c["last"])
        pages = F.transform(own, lambda x: x["page"])
        return F.struct(
            F.coalesce(F.try_element_at("rows", F.nullif(c["title"], zero))["text"], F.lit(title)).alias("section_title"),
            collapsed(F.array_join(F.transform(own, lambda x: x["text"]), " ")).alias("text"),
            F.array_distinct(F.when(c["carry"].isNull(), pages).otherwise(F.concat(F.array(c["carry"]), pages))).alias("pages"),
        )

    out = cuts.select("doc_id", F.posexplode(F.transform("cuts", made)).alias("seq", "s")).select("doc_id", F.col("seq").cast("long").alias("seq"), "s.*")
    return out.withColumn("char_count", F.length("text")).where(F.col("char_count") > least)


def cut_by_size(lines: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Cuts each document's lines when the text since the last cut reaches max_chars.

    lines: doc_id, seq, text. Returns doc_id, segment, first_seq, char_count."""
    rows = _in_order(lines, "doc_id", "seq", {"size": F.length(F.coalesce("text", F.lit("")))})
    one = lambda first, size: F.array(F.struct(first.alias("first"), size.alias("size")))
    state = lambda cuts, first, size: F.struct(cuts.alias("cuts"), first.alias("first"), size.cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        first, size = F.coalesce(acc["first"], x["o"]), acc["size"] + x["size"]
        return F.when(size >= max_chars, state(F.concat(acc["cuts"], one(first, size)), F.lit(None).cast("long"), F.lit(0))).otherwise(state(acc["cuts"], first, size))

    start = state(F.array().cast("array<struct<first:long,size:long>>"), F.lit(None).cast("long"), F.lit(0))
    finish = lambda acc: F.when(acc["first"].isNotNull(), F.concat(acc["cuts"], one(acc["first"], acc["size"]))).otherwise(acc["cuts"])
    cuts = rows.select("doc_id", F.posexplode(F.aggregate("rows", start, step, finish)).alias("segment", "c"))
    return cuts.select("doc_id", F.col("segment").cast("long").alias("segment"), F.col("c.first").alias("first_seq"), F.col("c.size").alias("char_count"))


def kind_of(title: Column) -> Column:
    """The section that a title names, `other` if none."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    out = None
    for kind, pattern in PATTERNS:
        out = F.when(t.rlike(pattern), kind) if out is None else out.when(t.rlike(pattern), kind)
    return out.otherwise("other")


def propagated(segments: DataFrame) -> DataFrame:
    """kind `other` takes the last known kind of its document. segments: doc_id, seq, kind."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("kind", F.coalesce(F.last(F.nullif("kind", F.lit("other")), ignorenulls=True).over(w), F.lit("other")))


def merged(segments: DataFrame, target: int = 6000) -> DataFrame:
    """Joins neighbours of one kind while their characters stay within target: doc_id, seq and section_title of the first, kind,
    text (joined by a blank line), pages (sorted), char_count, merged_count. A segment over target stays alone.

    segments: doc_id, seq, kind, section_title, text, pages, and char_count (of the text where null)."""
    text = F.coalesce("text", F.lit(""))
    pages = F.coalesce("pages", F.array().cast("array<int>"))
    rows = _in_order(segments, "doc_id", "seq", {"kind": F.col("kind"), "title": F.col("section_title"), "text": text, "pages": pages, "size": F.coalesce("char_count", F.length(text)).cast("long")})
    state = lambda cuts, k, first, size: F.struct(cuts.alias("cuts"), k.cast("int").alias("k"), first.cast("int").alias("first"), size.cast("long").alias("size"))
    ended = lambda acc: F.concat(acc["cuts"], F.array(F.struct(acc["first"].alias("first"), acc["k"].alias("last"))))

    def step(acc: Column, x: Column) -> Column:
        k = acc["k"] + 1
        same = x["kind"].eqNullSafe(F.try_element_at("rows", F.nullif(acc["first"], F.lit(0)))["kind"])
        goes_on = same & (acc["size"] + x["size"] <= target)
        return F.when(acc["first"] == 0, state(acc["cuts"], k, k, x["size"])).when(goes_on, state(acc["cuts"], k, acc["first"], acc["size"] + x["size"])).otherwise(state(ended(acc), k, k, x["size"]))

    start = state(F.array().cast("array<struct<first:int,last:int>>"), F.lit(0), F.lit(0), F.lit(0))
    cuts = rows.withColumn("cuts", F.aggregate("rows", start, step, ended))

    def made(c: Column) -> Column:
        own, first = _slice(c["first"], c["last"]), F.element_at("rows", c["first"])
        joined = F.array_join(F.transform(own, lambda x: x["text"]), "\n\n")
        n = c["last"] - c["first"] + 1
        all_pages = F.when(n == 1, first["pages"]).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda x: x["pages"])))))
        return F.struct(first["o"].alias("seq"), first["title"].alias("section_title"), first["kind"].alias("kind"), joined.alias("text"), all_pages.alias("pages"), F.when(n == 1, first["size"]).otherwise(F.length(joined)).alias("char_count"), n.cast("long").alias("merged_count"))

    return cuts.select("doc_id", F.explode(F.transform("cuts", made)).alias("s")).select("doc_id", "s.*")


def routed(segments: DataFrame, layer: str) -> DataFrame:
    """Segments of a layer's sections with their rank of preference."""
    kinds = ROUTES[layer].split()
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    return segments.withColumn("rank", rank).where("rank > 0")


def budgeted(segments: DataFrame, budget: int) -> DataFrame:
    """Greedy choice in order of (rank, seq) within a budget of characters: what doesn't fit is passed over.

    segments: doc_id, seq, rank, chars. Returns doc_id, seq, truncated (whether the document lost any)."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "seq"))
    rows = segments.select("doc_id", F.col("seq").alias("own"), "chars", order.cast("long").alias("seq"))

    def step(own: list) -> list[tuple]:
        left, taken = budget, []
        for seq, chars in own:
            if chars <= left or not taken:
                left -= chars
                taken.append(seq)
        return [(seq, len(taken) < len(own)) for seq in taken]

    return folded(rows, "doc_id", step, "doc_id long, seq long, truncated boolean")


def positional(segments: DataFrame, layer: str) -> DataFrame:
    """A layer's share of each document by place, all of it if the share is empty; repertoires also take
    the last quarter of documents of more than three segments."""
    lo, hi = SPANS[layer]
    w = Window.partitionBy("doc_id")
    n = F.count(F.lit(1)).over(w)
    k = F.row_number().over(w.orderBy("seq")) - 1
    first, end = F.floor(n * lo), F.greatest(F.floor(n * hi), F.lit(1))
    inside = (k >= first) & (k < end) | (first >= end)
    if layer == "repertoires":
        inside |= (n > 3) & (k >= n - F.greatest(F.floor(n / 4), F.lit(1)))
    return segments.withColumn("inside", inside).where("inside").drop("inside")


def selected(segments: DataFrame, layer: str, budget: int, least: int = 1500) -> DataFrame:
    """The segments that a layer reads: those of its sections by preference, or its share by place of
    documents where they have fewer than `least` characters, within the budget.

    segments: doc_id, seq, kind, chars."""
    by_section = routed(segments, layer)
    enough = by_section.groupBy("doc_id").agg(F.sum("chars").alias("total")).where(F.col("total") >= least).select("doc_id")
    by_place = positional(segments, layer).join(enough, "doc_id", "left_anti").withColumn("rank", F.lit(0))
    cols = ["doc_id", "seq", "rank", "chars"]
    return budgeted(by_section.join(enough, "doc_id", "left_semi").select(*cols).unionByName(by_place.select(*cols)), budget)


def section_report(segments: DataFrame) -> DataFrame:
    return segments.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def surface_forms(concepts: DataFrame, least: int = 3, synonyms: bool = False) -> DataFrame:
    """concept_id and its normalised forms: title, title without a trailing parenthesis, what is in it; with
    synonyms a parenthesis anywhere, up to two letters longer, and the concept's synonyms too.

    concepts: concept_id, title, and synonyms (array, may be null) where they count."""
    base = F.regexp_replace("title", r"\s*\([^)]*\)\s*$", "")
    inner = F.regexp_extract("title", r"\(([^)]{2,12})\)" if synonyms else r"\(([^)]{2,10})\)\s*$", 1)
    each = F.array("title", base, inner)
    if synonyms:
        each = F.concat(each, F.coalesce("synonyms", F.array().cast("array<string>")))
    forms = concepts.select("concept_id", F.explode(each).alias("form"))
    return forms.select("concept_id", source_norm("form").alias("form")).where(F.length("form") >= least).distinct()


def mentions(texts: DataFrame, forms: DataFrame, whole_words: bool = True) -> DataFrame:
    """texts (norm and any columns) with concept_ids: the sorted concepts of which a text holds a form. forms: concept_id, form.

    A text carries all ids that it mentions; mentioned_groups doesn't, where many concepts share their forms."""
    each = written(texts.withColumn("__text", F.monotonically_increasing_id()), "texts")
    found = phrases_found(each.select("__text", "norm"), forms, whole_words)
    ids = found.join(forms, "form").groupBy("__text").agg(F.sort_array(F.collect_set("concept_id")).alias("concept_ids"))
    return each.join(ids, "__text", "left").select(*texts.columns, F.coalesce("concept_ids", F.array().cast("array<string>")).alias("concept_ids"))


def mentioned_groups(texts: DataFrame, forms: DataFrame, whole_words: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What texts mention, by groups of concepts of which texts hold the same forms, so that a text mentions all or none of a group:
    the columns of texts but norm with group (distinct), the size of each group, and the group of each concept_id.

    texts: norm and any columns; forms: concept_id, form. Concepts that no text mentions are in no group."""
    forms = written(forms, "forms-of-concepts")
    found = written(phrases_found(texts, forms, whole_words), "forms-found")
    own = forms.join(found.select("form").distinct(), "form").groupBy("concept_id").agg(F.sort_array(F.collect_set("form")).alias("own"))
    own = written(own, "concepts-found")
    sizes = written(own.groupBy("own").agg(F.count(F.lit(1)).alias("size")).withColumn("group", F.monotonically_increasing_id()), "groups-found")
    of_forms = sizes.select("group", F.explode("own").alias("form"))
    return found.join(of_forms, "form").drop("form").distinct(), sizes.select("group", "size"), own.join(sizes, "own").select("concept_id", "group")


def mentioning(segments: DataFrame, forms: DataFrame, budget: int) -> DataFrame:
    """Segments that hold one of the forms as whole words, up to a budget of characters a document: the
    first that doesn't fit ends the document's choice, but one is always taken.

    segments: doc_id, seq, norm, chars; forms: concept_id, form (normalised)."""
    found = phrases_found(segments.select("doc_id", "seq", "chars", "norm"), forms).select("doc_id", "seq", "chars").distinct()
    w = Window.partitionBy("doc_id").orderBy("seq")
    kept = found.withColumn("used", F.sum("chars").over(w)).withColumn("k", F.row_number().over(w))
    return kept.where((F.col("k") == 1) | (F.col("used") <= budget)).select("doc_id", "seq", "chars")


def batches_across(rows: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """batches of groups that are too large for one task: rows are dealt by ranges of keys and seq, counted there, and numbered from the
    counts of the ranges before."""
    dealt = written(rows.repartitionByRange(*keys, "seq").withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    k = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("seq")) - 1
    numbered = dealt.withColumn("__k", k).join(F.broadcast(before), same)
    return numbered.withColumn("batch", F.floor((F.col("__before") + F.col("__k")) / size).cast("long")).select(*rows.columns, "batch")


def batches(rows: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of the batch of so many rows that a row is in."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1
    return rows.withColumn("batch", F.floor(k / size).cast("long"))
