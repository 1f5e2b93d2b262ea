"""Removal of listed rows, and resuming: anti-joins and last-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy


def purge_key(source: Column, uid: Column) -> Column:
    """Key of a row: its source, or its uid where the source is null or empty."""
    return falsy(source, uid)


def listed_ids(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame | None = None) -> DataFrame:
    """Ids of all members of the a side's classes that stand in a pair, whole and untruncated; with
    `members_b` also those of the b side."""
    a = members_a.join(pairs.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("id")
    if members_b is None:
        return a
    return a.unionByName(members_b.join(pairs.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi").select("id"))


def purge(df: DataFrame, key: str, listed: DataFrame, listed_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows of `df`; rows with a null key are kept."""
    ids = listed.select(F.col(listed_key).alias("_id")).distinct()
    cond = F.col(key) == F.col("_id")
    return df.join(ids, cond, "left_anti"), df.join(ids, cond, "left_semi")


def by_family(df: DataFrame, family: Column) -> DataFrame:
    """Rows per family, most first; a missing family counts as `?`."""
    return df.groupBy(F.coalesce(family, F.lit("?")).alias("family")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "family")


def todo(df: DataFrame, done: DataFrame, keys: list[str], defaults: list[str] | None = None) -> DataFrame:
    """Rows of `df` whose key is not among the done ones. Keys are compared as strings; a null is
    replaced by its default, and without defaults a row with a null key is always to do."""
    fill = lambda c, i: F.coalesce(F.col(c).cast("string"), F.lit(defaults[i])) if defaults else F.col(c).cast("string")
    d = done.select(*[fill(k, i).alias(f"_d{i}") for i, k in enumerate(keys)]).distinct()
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & (fill(k, i) == F.col(f"_d{i}"))
    return df.join(d, cond, "left_anti")


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a key: the one of greatest `pos`, with the key's least `pos` as first_pos. Equal
    positions are told apart by the whole row."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(pos), *[c for c in cols if c != pos])).alias("_r"), F.min(pos).alias("first_pos"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols], "first_pos")
