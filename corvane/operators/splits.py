"""Keep-first distinct, seeded samples and disjoint splits.

All orders are total: a seeded md5 key, then the uid. The same rows come out for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Most rows of each source in the capped split.
SOURCE_CAPS = {"physreason": 250, "ugphysics": 200, "openstax": 75, "physics_se": 100, "rl_sft": 50}


def seeded(uid: Column, seed: int = 42, salt: str = "") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), uid.cast("string")))


def head_limit(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n rows in the given order; all rows for n = 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in the given order, which should be total; null is a key of its own.
    max_by keeps one row a key in the partial aggregate, so a key with a third of all rows is no hot task."""
    cols = df.columns
    best = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def _ranked(df: DataFrame, strata: list[str], uid: str, seed: int, salt: str, most: Column) -> DataFrame:
    """Rows whose seeded rank in their stratum is at most `most`. Spark cuts each task's rows to the limit
    before the exchange (WindowGroupLimit), if the limit is a constant."""
    w = W.partitionBy(*strata).orderBy("_h", uid)
    return df.withColumn("_h", seeded(F.col(uid), seed, salt)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)


def stratified(df: DataFrame, n: int, strata: list[str], uid: str, seed: int = 42) -> DataFrame:
    """n rows, as many as fit equally from each stratum; what is missing comes from the leftovers of all.

    Fewer rows than n are all taken; with fewer rows asked than strata, all come from the leftovers."""
    count = df.select(*strata).distinct().agg(F.count("*").alias("c")).scalar()
    per = F.floor(F.lit(n) / F.greatest(count, F.lit(1)))
    # no stratum gives more than n rows, so tasks cut theirs to n before the exchange; the leftovers
    # are then ordered without strata, and only n rows of each task leave it
    first = _ranked(df, strata, uid, seed, "a", F.lit(n)).where(F.col("_rn") <= per).drop("_rn").persist()
    rest = df.join(first.select(F.col(uid).alias("_u")), F.col(uid) == F.col("_u"), "left_anti").withColumn("_h", seeded(F.col(uid), seed, "a"))
    both = first.withColumn("_o", F.lit("")).unionByName(rest.withColumn("_o", seeded(F.col(uid), seed, "b")))
    return both.orderBy("_o", "_h", uid).limit(n).drop("_h", "_o")


def quotas(df: DataFrame, n: int, strata: list[str]) -> DataFrame:
    """Rows for each stratum by largest remainder; equal remainders go by descending key, nulls last."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    whole = W.partitionBy()
    raw = F.lit(n) * F.col("_c") / F.sum("_c").over(whole)
    q = sizes.withColumn("_raw", raw).withColumn("_q", F.floor("_raw")).withColumn("_short", F.lit(n) - F.sum("_q").over(whole))
    r = F.row_number().over(W.partitionBy().orderBy((F.col("_raw") - F.col("_q")).desc(), *[F.col(s).desc() for s in strata]))
    return q.withColumn("_quota", F.col("_q") + F.when(r <= F.col("_short"), 1).otherwise(0)).select(*strata, "_quota")


def proportional(df: DataFrame, n: int, strata: list[str], uid: str, seed: int = 42) -> DataFrame:
    """n rows with the strata's own shares; all rows if there are fewer than n; none of an empty table."""
    q = quotas(df, n, strata).select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], "_quota")
    cond = F.lit(True)
    for i, s in enumerate(strata):
        cond = cond & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    ranked = _ranked(df, strata, uid, seed, "p", F.lit(n))
    return ranked.join(q, cond).where(F.col("_rn") <= F.col("_quota")).drop("_h", "_rn", "_quota", *[f"_s{i}" for i in range(len(strata))])


def capped_top(df: DataFrame, n: int, hardness: str, source: str, uid: str, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """The n hardest rows with at most caps[source] of each source (0 for others); if too few are left,
    filled up with the hardest of the rest."""
    cap = F.lit(0)
    for s, c in caps.items():
        cap = F.when(F.col(source) == s, c).otherwise(cap)
    order = [F.col(hardness).desc(), F.col("_h"), F.col(uid)]
    w = W.partitionBy(source).orderBy(*order)
    rows = df.withColumn("_h", seeded(F.col(uid), seed, "t")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return rows.withColumn("_over", F.col("_rn") > cap).orderBy("_over", *order).limit(n).drop("_h", "_rn", "_over")


def four_way(df: DataFrame, uid: str, hardness: str, source: str, concept: str, level: str, hardest: int, mini: int, full: int, seed: int = 42, caps: dict | None = None) -> DataFrame:
    """(uid, split): the hardest rows first, then a stratified and a proportional sample of what is
    left, and the rest for training. Splits are disjoint by anti-join; uids must be unique."""
    base = df.select(uid, hardness, source, concept, level)
    top = capped_top(base, hardest, hardness, source, uid, caps or SOURCE_CAPS, seed).select(uid).persist()
    left = base.join(top, uid, "left_anti")
    small = stratified(left, mini, [concept, level], uid, seed).select(uid).persist()
    left = left.join(small, uid, "left_anti")
    wide = proportional(left, full, [source], uid, seed).select(uid).persist()
    named = top.select(uid, F.lit("eval_hard").alias("split")).unionByName(small.select(uid, F.lit("eval_mini").alias("split"))).unionByName(wide.select(uid, F.lit("eval_full").alias("split")))
    return base.select(uid).join(named, uid, "left").select(uid, F.coalesce("split", F.lit("train_pool")).alias("split"))


def split_check(splits: DataFrame, uid: str) -> DataFrame:
    """One row: rows, distinct uids, and uids that stand in more than one split (0 if they are disjoint)."""
    per = splits.groupBy(uid).agg(F.count("*").alias("c"), F.count_distinct("split").alias("s"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("uids"), F.count_if(F.col("s") > 1).alias("shared"))
