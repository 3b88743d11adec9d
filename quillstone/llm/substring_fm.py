"""Substring deduplication: repeated word windows found by FM-indexes of shards.

A window is `window` consecutive words. It belongs to its leftmost minimal k-gram of words (by hash),
so equal windows belong to equal k-grams, and consecutive windows of one occurrence of a k-gram form a
segment of at most 2 * window words. A k-gram that the corpus has once can't have a repeated window;
segments of the others go, with their words, to the shard of their k-gram, equal ones of a task as one
(all but the first place are repeats whatever else there is). A shard's different segments become an FM-index: suffixes sorted by their first `window` words, the
Burrows-Wheeler transform in a wavelet tree stored level by level as bits with counts, counts of
smaller words, and where suffixes begin to differ. The shard's segments are then streamed through it:
backward search adds a word to the left, and beyond the threshold the interval widens to that of the
first `window` words; an interval of several rows is a repeated window, and all but its first place
in the corpus is reported. So every document is searched only where its repeats can be, work grows
with the text, and no shard grows with the corpus: a k-gram with more than HOT segments sends single
windows instead, dealt by the hash of their words.

Keys are hashes but decide nothing: segments are compared by their words, and indexes hold whole words.

Edge cases: null and empty texts have no words; texts shorter than a window lose none; a null doc_id
sorts first; rows of the same doc_id are documents of their own, the one that is first by place comes
first; overlapping repeats in one text (runs of one word) are found as any others; texts of any length
are read in slices; an empty table gives no rows; further columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, changes, flagged, join_hot, placed, remove, table, whole_runs, written

WINDOW, GRAM = 20, 6
#: A k-gram of more segments sends windows; words of a shard; bytes of a text and words read at a time.
HOT, SHARD_WORDS, SLICE, CHUNK = 1 << 15, 400_000, 1 << 20, 1 << 20
#: Segments that a task holds to find equal ones.
HELD = 1 << 17
SEGMENT = "key long, file long, `row` long, at int, n int"
CUT = "shard int, doc_id long, file long, `row` long, at int, n int, words binary"
SPAN = "file long, `row` long, start int, stop int"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[_SPACE] = 0
_POWER = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


# --- words and segments ---------------------------------------------------------------------


def pieces(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in pieces of about size bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_starts(text: bytes) -> np.ndarray:
    """The bytes where the words of a text begin."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(space) else np.zeros(0, np.int64)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and the bytes where they begin."""
    data, starts = np.frombuffer(text, np.uint8), word_starts(text)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    return mixed(np.add.reduceat(_VALUE[data[starts[0] :]] * _POWER[place & 4095], starts - starts[0])), starts


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(words: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of at most CHUNK hashed words, doc telling whose they are: first word, windows, key."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * _ODD + words[j : j + len(grams)]
    grams = mixed(grams)
    low = np.uint64(CHUNK - 1)
    place = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & low).astype(np.int64)
    own = doc[: len(place)] == doc[window - 1 :]
    begins = own.copy()
    begins[1:] &= ~own[:-1] | (place[1:] != place[:-1])
    at = np.flatnonzero(begins)
    if not len(at):
        return none, none, none
    return at, np.add.reduceat(own.astype(np.int64), at), grams[place[at]].view(np.int64)


def scanned(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Segments of documents (file, row, text)."""
    names = ["key", "file", "row", "at", "n"]

    def rows(words, doc, files, lines, offsets):
        at, n, key = segments(words, doc, window, gram)
        if len(at):
            own = doc[at]
            columns = [key, files[own], lines[own], (at - offsets[own]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for b in batches:
        files, lines = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = [t.as_py() or b"" for t in b.column(2).cast(pa.binary())]
        k = 0
        while k < len(texts):
            if len(texts[k]) > SLICE:
                words = np.concatenate([word_hashes(p)[0] for p in pieces(texts[k])])
                for at in range(0, max(1, len(words) - window + 1), CHUNK - window):
                    part = words[at : at + CHUNK - 1]
                    yield from rows(part, np.zeros(len(part), np.int64), files[k : k + 1], lines[k : k + 1], np.array([-at]))
                k += 1
                continue
            many, size = k, 0
            while many < len(texts) and len(texts[many]) <= SLICE and (many == k or size + len(texts[many]) < 2 * CHUNK):
                size += len(texts[many]) + 1
                many += 1
            words, starts = word_hashes(b" ".join(texts[k:many]))
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[k : many - 1]])
            doc = np.searchsorted(begins, starts, "right") - 1
            yield from rows(words, doc, files[k:many], lines[k:many], np.searchsorted(starts, begins))
            k = many


class Firsts:
    """Of equal segments the first one by place; what is known not to be first is handed over as a span, with no words."""

    def __init__(self, shards: int):
        self.shards, self.own, self.spans = shards, {}, []

    def add(self, key: int, place: tuple, n: int, words: bytes) -> None:
        had = self.own.get(words)
        if had is None:
            self.own[words] = (key, place, n)
            return
        first, later = (had[1], place) if _order(had[1]) <= _order(place) else (place, had[1])
        self.own[words] = (key, first, n)
        self.spans.append((later, n))

    def rows(self) -> pa.RecordBatch:
        keys = [key for key, _, _ in self.own.values()] + [place[1] ^ place[2] for place, _ in self.spans]
        shard = (mixed(np.array(keys, np.int64).view(np.uint64)) % np.uint64(self.shards)).astype(np.int32)
        places = [(*place, n) for _, place, n in self.own.values()] + [(*place, n) for place, n in self.spans]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        words = pa.array([*self.own, *[None] * len(self.spans)], pa.binary())
        columns = [pa.array(shard), *[pa.array(c, t) for c, t in zip(zip(*places), kinds)], words]
        self.own, self.spans = {}, []
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0].strip("`") for c in CUT.split(", ")])


def _order(place: tuple) -> tuple:
    return place[0] is not None, place[0] or 0, *place[1:]


def cut(batches: Iterator[pa.RecordBatch], window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The words of segments and their shards, equal ones of a task as one. Rows: doc_id, file, row, text, list of (at, n, key, hot)."""
    firsts = Firsts(shards)
    for b in batches:
        wanted = b.column(4)
        bounds = wanted.offsets.to_numpy()
        ats, ns, keys, hots = (wanted.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n", "key", "hot"))
        for k, (doc_id, file, row) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
            text = b.column(3)[k].as_py().encode()
            starts = np.append(np.concatenate([word_starts(p) + at for p, at in _with_offsets(text)]), len(text))
            own = slice(bounds[k], bounds[k + 1])
            at, n = ats[own].astype(np.int64), ns[own].astype(np.int64)
            for first, many, key, hot, lo, hi in zip(at.tolist(), n.tolist(), keys[own].tolist(), hots[own].tolist(), starts[at].tolist(), starts[at + n + window - 1].tolist()):
                if not hot:
                    firsts.add(key, (doc_id, file, row, first), many, b" ".join(text[lo:hi].split()))
                    continue
                for j in range(first, first + many):  # single windows, by their words
                    words = b" ".join(text[starts[j] : starts[j + window]].split())
                    own_key = mixed(word_hashes(words)[0] * _ODD ** np.arange(window, dtype=np.uint64)).sum()
                    firsts.add(int(own_key.view(np.int64)), (doc_id, file, row, j), 1, words)
            if len(firsts.own) + len(firsts.spans) > HELD:
                yield firsts.rows()
    if firsts.own:
        yield firsts.rows()


def _with_offsets(text: bytes) -> Iterator[tuple[bytes, int]]:
    at = 0
    for p in pieces(text):
        yield p, at
        at += len(p)


# --- the index ------------------------------------------------------------------------------


class WaveletTree:
    """Ranks in a sequence of small integers: a level for each bit, packed, with counts of ones before every 64."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (x >> bit & 1).astype(bool)
            packed = np.zeros(len(x) // 64 * 8 + 8, np.uint8)
            bits = np.packbits(ones, bitorder="little")
            packed[: len(bits)] = bits
            packed = packed.view("<u8")
            before = np.zeros(len(packed), np.uint32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:], dtype=np.uint32)
            self.levels.append((bit, packed, before, int(len(x) - ones.sum())))
            x = np.concatenate([x[~ones], x[ones]])
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = i >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i are symbol."""
        return self._descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Backward search over texts of word numbers from 1; a 0 ends each text. Suffixes are sorted by
    their first `depth` words, so intervals are right for patterns of up to that many."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, size = depth, len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:  # ranks of the first width words, doubled
            step = min(width, depth - width)
            after = np.zeros(size, np.int64)
            after[: size - step] = rank[step:]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            width += step
        order = np.argsort(rank, kind="stable")
        self.group = rank[order]  # of every row
        self.start = np.concatenate([np.flatnonzero(np.diff(self.group, prepend=-1)), [size]])  # rows of a group
        self.group = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        self.earliest = np.minimum.reduceat(order, self.start[:-1])  # place in the text of a group
        top = int(text.max())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(text[order - 1], top)
        self.size = size

    def matches(self, words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams texts words[first:stop] from the right, all at a time. Yields where matches of depth words
        begin, the rows of the index that have them, and the earliest place there. Words that the
        index lacks are 0 or over its largest."""
        at, began, n = stop - 1, first, np.zeros(len(first), np.int64)  # the word to add, n words right of it match
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.size)
        while len(at):
            on = at >= began
            at, began, n, lo, hi = at[on], began[on], n[on], lo[on], hi[on]
            if not len(at):
                return
            c = words[at]
            known = (c > 0) & (c < len(self.smaller) - 1)
            c = np.where(known, c, 0)
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.smaller[c], 2)
            lo, hi = both[: len(c)], both[len(c) :]
            found = known & (lo < hi)
            n = np.where(found, n + 1, n)
            full = found & (n >= self.depth)
            if full.any():  # the interval of the first depth words
                group = self.group[lo[full]]
                lo[full], hi[full], n[full] = self.start[group], self.start[group + 1], self.depth
                yield at[full], lo[full], hi[full], self.earliest[group]
            # a word that doesn't fit: whatever ends right of the match's last word can't match
            at = np.where(found, at - 1, np.where(n > 0, at + n - 1, at - 1))
            lo, hi, n = np.where(found, lo, 0), np.where(found, hi, self.size), np.where(found, n, 0)


def numbered_words(texts: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers from 1 of texts, a 0 after each, and where the texts begin. Numbers follow the first occurrences."""
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for t in texts for w in t.split()), np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(len(flat) + len(sizes), np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    return text, first


def _spans(file, row, start, stop) -> pa.RecordBatch:
    columns = [file, row, start.astype(np.int32), stop.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "row", "start", "stop"])


def searched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that begin earlier in their shard too, and of segments that occur earlier as they are. Rows of CUT,
    by shard, words and place; those without words are such spans already."""
    for b, bounds in whole_runs(batches, [0]):
        for lo, hi in zip(bounds, [*bounds[1:], b.num_rows]):
            own = b.slice(lo, hi - lo)
            known = own.column(6).is_valid().to_numpy(zero_copy_only=False)
            first = known & changes(own, [6], None)
            file, row, at, n = (own.column(k).to_numpy() for k in range(2, 6))
            later = ~first
            if later.any():
                yield _spans(file[later], row[later], at[later], at[later] + n[later] + window - 1)
            if not first.any():
                continue
            own = _by_place(own.filter(pa.array(first)))
            file, row, at, n = (own.column(k).to_numpy() for k in range(2, 6))
            sizes = n.astype(np.int64) + window - 1
            text, begins = numbered_words(own.column(6).to_pylist(), sizes)
            found = [place[place != earliest] for place, _, _, earliest in FMIndex(text, window).matches(text, begins, begins + sizes)]
            place = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if not len(place):
                continue
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)  # windows of two segments are never neighbours
            last = place[np.append(run[1:], len(place)) - 1]
            seg = np.searchsorted(begins, place[run], "right") - 1
            yield _spans(file[seg], row[seg], at[seg] + place[run] - begins[seg], at[seg] + last - begins[seg] + window)


def _by_place(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.take(pc.sort_indices(b, [("doc_id", "ascending"), ("file", "ascending"), ("row", "ascending"), ("at", "ascending")], null_placement="at_start"))


# --- documents ------------------------------------------------------------------------------


def _file_numbers(rows: DataFrame) -> Column:
    """A long for every path; another seed in the unlikely case that two share one."""
    paths = rows.select("path").distinct()
    for seed in range(8):
        number = F.xxhash64("path", F.lit(seed))
        n, k = paths.agg(F.count("path"), F.count_distinct(number)).first()
        if n == k:
            return number
    raise ValueError("paths of the documents can't be told apart")


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """file, row, start, stop: spans of words to remove from texts (doc_id, file, row, text), which may overlap."""
    spark = texts.sparkSession
    with arrow_batches(spark):
        found = written(texts.select("file", "row", "text").mapInArrow(lambda b: scanned(b, window, gram), SEGMENT), "substring-segments")
        repeated = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where("of > 1"), "substring-keys")
        doubtful = join_hot(found, repeated, "key", "of", found.count())
        segments_of = F.collect_list(F.struct("at", "n", "key", (F.col("of") > HOT).alias("hot"))).alias("segments")
        wanted = written(doubtful.groupBy("file", "row").agg(segments_of, F.sum(F.col("n") + window - 1).alias("words")), "substring-wanted")
        for done in (found, repeated):
            remove(spark, done.written_to)
        shards = max(1, -(-(wanted.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS))
        segs = texts.join(wanted.drop("words"), ["file", "row"]).select("doc_id", "file", "row", "text", "segments").mapInArrow(lambda b: cut(b, window, shards), CUT)
        segs = segs.repartition("shard").sortWithinPartitions("shard", "words", "doc_id", "file", "row", "at")
        spans = written(segs.mapInArrow(lambda b: searched(b, window), SPAN), "substring-spans")
        remove(spark, wanted.written_to)
        return spans


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: number, text, list of (start, stop). Returns number, n_words, n_removed and the words that stay, joined by a space."""
    names = ["number", "n_words", "n_removed", "kept"]
    for b in batches:
        found = []
        for text, spans in zip(b.column(1).cast(pa.binary()), b.column(2)):
            spans, text = spans.as_py(), text.as_py() or b""
            stays, n, removed, out = None, 0, 0, []
            if spans:
                stays = np.ones(max(s["stop"] for s in spans), bool)
                for s in spans:
                    stays[s["start"] : s["stop"]] = False
                removed = int(len(stays) - stays.sum())
            for p in pieces(text):
                own = p.split()
                if stays is not None and n < len(stays):
                    mask = stays[n : n + len(own)].tolist()
                    mask += [True] * (len(own) - len(mask))
                    n += len(own)
                    own = list(compress(own, mask))
                else:
                    n += len(own)
                if own:
                    out.append(b" ".join(own))
            found.append((n, removed, b" ".join(out)))
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns[:2], columns[2].cast(pa.string())], names=names)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row of docs: the words that no window covers which begins earlier too."""
    spark = docs.sparkSession
    rows, names = placed(docs, "substring-documents")
    of = {k: F.col(f"c{names.index(c)}") for k, c in (("doc_id", id_col), ("text", text_col))}
    number = _file_numbers(rows)
    texts = rows.select(of["doc_id"].cast("long").alias("doc_id"), number.alias("file"), "row", F.coalesce(of["text"].cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(texts, window, gram)
    a_row = written(spans.groupBy("file", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "substring-rows")
    marked = flagged(texts, a_row.select("file", "row"), ["file", "row"])
    none = F.lit(None).cast(a_row.schema["spans"].dataType).alias("spans")
    untouched = marked.where(~F.col("maybe")).select("doc_id", "text", none)
    touched = marked.where("maybe").join(a_row, ["file", "row"], "left").select("doc_id", "text", "spans")
    with arrow_batches(spark):
        out = untouched.unionByName(touched).mapInArrow(kept_words, "number long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("number", "doc_id")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_sha256 = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", kept_sha256)


_SQL_WORD = r"[^\x20\x09-\x0D]+"
QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLE = {
    "op13_substring_dedup": f"""
with d as (select row_number() over (order by doc_id) as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') as words from documents),
w as (select rid, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from d where len(words) >= {WINDOW}),
h as (select rid, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') as win from w),
f as (select rid, i, row_number() over (partition by win order by rid, i) as k from h),
gone as (select distinct rid, i + j as i from f, unnest(range({WINDOW})) as u(j) where k > 1),
one as (select rid, unnest(words) as word, generate_subscripts(words, 1) as i from d),
left_over as (select rid, string_agg(word, ' ' order by i) as kept from one anti join gone using (rid, i) group by rid),
n as (select rid, count(*) as n_removed from gone group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (rid) left join n using (rid)"""
}
