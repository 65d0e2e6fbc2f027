"""Column builders over text; all run inside the JVM.

White space is what Unicode calls so (``WS``), not only ASCII's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\s\\u000b\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
BENGALI = "[\\u0980-\\u09FF]"
MARKS = "[^\\p{L}\\p{N}_\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def split_words(c: Column) -> Column:
    """The words between white space, case kept; [] for null and blank."""
    return F.filter(F.split(or_empty(c), f"{WS}+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case words; punctuation stays on them."""
    return split_words(F.lower(c))


def token_count(c: Column) -> Column:
    return F.size(split_words(c)).cast("long")


def shingles(c: Column, k: int) -> Column:
    """Distinct word k-grams of the lower-case text without punctuation; a shorter text is one shingle, an empty one none."""
    def grams(w: Column) -> Column:
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(every))

    return let(split_words(F.regexp_replace(F.lower(or_empty(c)), MARKS, "")), grams)


def shingle_hashes(c: Column, k: int) -> Column:
    """64-bit hashes of the ``shingles``, distinct and sorted, without building the phrases."""
    def grams(w: Column) -> Column:
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(every)))

    return let(split_words(F.regexp_replace(F.lower(or_empty(c)), MARKS, "")), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays of distinct values, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def trigrams(word: Column) -> Column:
    """Character trigrams of the lower-case word; a word under three characters is its own."""
    w = F.lower(word)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))
    return F.when(F.length(w) < 3, F.array(w)).otherwise(grams)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (la + lb), unrounded: 100 for equal strings, 0 if one is empty.  Exact and built in; for bulk use its Arrow twin."""
    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    row = lambda p, x: F.aggregate(
        F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)),
        lambda q, j: F.concat(q, F.array(F.when(x == F.substring(b, j, F.lit(1)), F.get(p, j - 1) + 1).otherwise(F.greatest(F.get(p, j), F.get(q, j - 1))))),
    )
    letters = F.filter(F.split(a, ""), lambda x: x != "")
    lcs = F.element_at(F.aggregate(letters, zeros, row), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.lit(200.0) * lcs / (F.length(a) + F.length(b)))


def script_lang(c: Column, chars: int = 200) -> Column:
    """'bn' if a Bengali letter is among the first characters, else 'en'."""
    return F.when(F.substring(or_empty(c), 1, chars).rlike(BENGALI), "bn").otherwise("en")


def bengali_share(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(or_empty(c), F.lit(BENGALI)).cast("double"), F.length(or_empty(c)).cast("double")), F.lit(0.0))


def detect_lang(c: Column, share: float = 0.3) -> Column:
    """'unknown' for blank text, 'bn' if over ``share`` of it is Bengali, else 'en'."""
    return F.when(strip(or_empty(c)) == "", "unknown").when(bengali_share(c) > share, "bn").otherwise("en")


def is_mixed(c: Column, share: float = 0.1) -> Column:
    latin = F.coalesce(F.try_divide(F.regexp_count(or_empty(c), F.lit("[A-Za-z]")).cast("double"), F.length(or_empty(c)).cast("double")), F.lit(0.0))
    return (bengali_share(c) > share) & (latin > share)
