"""Text normalization, shingles and similarity as column expressions.

Each function takes and returns columns, and gives null for null unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def audit_norm(c: Column) -> Column:
    """Lower case, without LaTeX commands, brackets and punctuation, words apart by one space.
    Letters and digits of all scripts are kept."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), r"\\[a-z]+\b", " "), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def _runs(norm: Column, k: int, made: Callable[[Column], Column]) -> Column:
    """Distinct `made` of the runs of k words. The words are bound once, so the text is not split again for each run."""
    def runs(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: made(F.slice(w, i, k))))

    return F.when(norm.isNotNull(), F.get(F.transform(F.array(F.split(norm, " ")), runs), F.lit(0)))


def shingle_set(norm: Column, k: int = 5) -> Column:
    """Distinct runs of k words of a normalized text; a shorter text is one shingle, even an empty one."""
    return _runs(norm, k, lambda run: F.array_join(run, " "))


def shingle_hashes(norm: Column, k: int = 5) -> Column:
    """64-bit hashes of the runs in shingle_set."""
    return _runs(norm, k, lambda run: F.xxhash64(run))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def answer_norm(c: Column, commas: bool = True) -> Column:
    """Answer without \\text{}, white space, dollar signs and thin spaces, in lower case; `commas`
    False drops commas too and gives '' for null."""
    t = F.regexp_replace(F.regexp_replace(c, r"\\text\{([^}]*)\}", "$1"), r"\s+", "")
    for mark in ("$", "\\,", "\\!", "\\;"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    t = F.lower(t)
    return t if commas else F.coalesce(F.replace(t, F.lit(","), F.lit("")), F.lit(""))


def preview(c: Column, n: int = 120) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int = 300) -> Column:
    return F.right(c, F.lit(n))


def falsy(c: Column, other: Column) -> Column:
    """`other` where a string is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)
