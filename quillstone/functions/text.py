"""Scalar text functions. The normalisers differ on purpose; results depend on which is used."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in titles.
STOP_WORDS = (
    "el la los las un una unos unas de del al y e o u en con por para a "
    "the an of and or in on with for to"
).split()
DASHES = "‐‑‒–—−"
WORD_GAP = r"(?U)[^\w\s]"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks (up to U+024F and U+1E00 to U+1EFF) and their base letters, by decomposition."""
    out = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            out[chr(cp)] = base
    return "".join(out), "".join(out.values())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c) -> Column:
    """Latin letters without their marks; combining marks go. Stays in the JVM."""
    return F.regexp_replace(F.translate(_col(c), *_accents()), r"\p{Mn}", "")


def plain(c) -> Column:
    """Null is empty; no accents, lower case, punctuation as blanks."""
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(_col(c).cast("string"), F.lit("")))), WORD_GAP, " ")


def source_norm(c) -> Column:
    """For quotes and sources: plain with runs of white space as one blank. What is no word character separates words, so
    one pass does for both; ASCII texts need no accents folded and no Unicode classes."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    words = F.regexp_replace(F.lower(fold_accents(t)), r"(?U)\W+", " ")
    return F.trim(F.when(F.octet_length(t) == F.length(t), F.regexp_replace(F.lower(t), "[^a-z0-9_]+", " ")).otherwise(words))


def answer_norm(c) -> Column:
    """For answers: plain and stripped; inner runs of blanks stay."""
    return F.regexp_replace(plain(c), r"(?U)^\s+|\s+$", "")


def title_norm(c) -> Column:
    """For titles: plain words without stop words and without a final s of words over 3 letters."""
    words = F.filter(F.split(source_norm(c), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def word_norm(c) -> Column:
    """Lower case without marks; punctuation stays."""
    return fold_accents(F.lower(F.coalesce(_col(c), F.lit(""))))


def domain_norm(c) -> Column:
    """Domain spellings: dashes alike, one blank, stripped of blanks and ` .,;:`, lower case; accents stay."""
    t = F.translate(F.coalesce(_col(c), F.lit("")), DASHES + " ", "-" * len(DASHES) + " ")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.lower(F.regexp_replace(t, r"^[ .,;:]+|[ .,;:]+$", ""))


def title_tokens(c) -> Column:
    """Distinct title words of 4 letters or more."""
    return F.array_distinct(F.filter(F.split(title_norm(c), " "), lambda w: F.length(w) >= 4))


def once(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm_tokens(norm: Column) -> Column:
    """Distinct words of more than 2 letters of what answer_norm gives."""
    return F.array_distinct(F.filter(F.split(norm, r"(?U)\s+"), lambda w: F.length(w) > 2))


def answer_tokens(c) -> Column:
    """Distinct answer words of more than 2 letters."""
    return norm_tokens(answer_norm(c))


def word_grams(text: Column, n: int = 4) -> Column:
    """Distinct n-grams of a normalised text's words; the text itself if it has fewer."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    grams = F.transform(F.array(words), lambda w: F.when(F.size(w) < n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))))
    return F.element_at(grams, 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all tokens of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(words: Column, gold: Column) -> Column:
    """Share of gold tokens among words; 0 without gold."""
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.size(F.array_intersect(words, gold)) / F.size(gold))


def capped_ratio(n: Column, target: Column) -> Column:
    """n of target between 0 and 1; 0 if the target isn't positive."""
    return F.when(target <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / target)))


def confidence(c: Column) -> Column:
    """Numbers as they are, `alta`, `media`, `baja` as 0.9, 0.6, 0.3, all else 0.6."""
    word = F.lower(F.trim(c))
    return F.coalesce(c.try_cast("double"), F.when(word == "alta", 0.9).when(word == "media", 0.6).when(word == "baja", 0.3), F.lit(0.6))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 10 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10))


def short_code(c: Column) -> Column:
    """Six upper-case letters of an id without dashes."""
    return F.upper(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 6))


def token_estimate(chars: Column) -> Column:
    """Tokens that so many characters need, with a margin."""
    return (F.floor(chars / 3.3) + 200).cast("long")


def acronym_split(title: Column) -> Column:
    """struct(base, acronym): a trailing parenthesis that is an acronym, else the title and null; a title that
    is nothing but a parenthesis has none."""
    pattern = r"^\s*(\S.*?)\s*\(([^)]{2,24})\)\s*$"
    inner = F.trim(F.regexp_extract(title, pattern, 2))
    letters = F.length(F.regexp_replace(inner, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(inner, r"\P{Lu}", ""))
    good = (inner != "") & ~inner.rlike(r"[,/ ]") & (letters > 0) & (upper >= 0.6 * letters)
    return F.struct(F.when(good, F.regexp_extract(title, pattern, 1)).otherwise(F.trim(title)).alias("base"), F.when(good, inner).alias("acronym"))


def strict_acronym(title: Column) -> Column:
    """A trailing parenthesis of capitals, digits and dashes; null without one."""
    return F.nullif(F.regexp_extract(title, r"\(([A-Z][A-Z0-9\-]{1,9})\)\s*$", 1), F.lit(""))
