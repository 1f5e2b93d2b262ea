"""Matching of candidate answers with reference answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_norm


def strict_match(preds: Column, gold: Column) -> Column:
    """Whether a candidate equals the gold after normalization, or holds it (so 15 matches gold 5)."""
    g = answer_norm(gold)
    return F.coalesce(F.exists(preds, lambda p: (answer_norm(p) == g) | ((g != "") & answer_norm(p).contains(g))), F.lit(False))


def strict_match_any(preds: Column, gold: Column) -> Column:
    """As strict_match without regard to commas; an empty gold never matches."""
    g = answer_norm(gold, commas=False)
    return (g != "") & F.coalesce(F.exists(preds, lambda p: answer_norm(p, commas=False).contains(g)), F.lit(False))


def all_golds_matched(golds: Column, preds: Column) -> Column:
    """Whether every gold has a matching candidate; no gold is not matched."""
    return (F.size(F.coalesce(golds, F.array().cast("array<string>"))) > 0) & F.coalesce(F.forall(golds, lambda g: strict_match_any(preds, g)), F.lit(False))


def not_blank(preds: Column) -> Column:
    return F.filter(preds, lambda p: F.coalesce(F.regexp_replace(p, r"\s+", "") != "", F.lit(False)))


def choice_correct(letter: Column, gold: Column, trim_gold: bool = True) -> Column:
    return F.coalesce(letter == (F.trim(gold) if trim_gold else gold), F.lit(False))
