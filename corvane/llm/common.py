"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir). Where the session names none,
    a temporary folder is set if the master is local, and an error tells so if it is not: executors of
    several machines would each write to a folder of their own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-ckpt-"))
    return df.checkpoint(eager=True)


MOST_BITS = 27  # of a bitset: 16 MB at any size of the input


def md5_of(text: Column) -> Column:
    """16-byte digest of a text, for joins that need not exchange the text."""
    return F.unhex(F.md5(text.cast("binary")))


def hash_bitset(df: DataFrame, column: str, most_bits: int = MOST_BITS) -> tuple[int, object]:
    """(bits, numpy uint8 array): the bitset over the first `bits` bits of the 64-bit hashes in `column`, bit i
    at place i % 8 of byte i // 8.

    About 64 bits a distinct hash, 2**most_bits at most; a fuller bitset only lets more through. Bitmaps of
    32,768 bits are made in the tasks and merged by partial aggregation, and only they come to the driver."""
    import numpy as np

    n = max(1, df.agg(F.approx_count_distinct(column)).first()[0])
    bits = min(most_bits, max(16, (64 * n - 1).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    made = df.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    found = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in made.collect():
        at = (r["b"] - 1) * 4096
        found[at : at + 4096] = np.frombuffer(r["m"], np.uint8)
    return bits, found


def label_key(c: Column) -> Column:
    """Label without regard to case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def bucket_of(c: Column, buckets: int) -> Column:
    """Bucket of a 64-bit order key; `buckets` is a power of two, and buckets are ordered ranges of the key."""
    return F.shiftright(c, 64 - (buckets.bit_length() - 1))


def running_totals(df: DataFrame, group: list[str], order_hash: str, tie: list[str], measure: Column, buckets: int = 1024) -> DataFrame:
    """Adds `before` (the exclusive running sum of `measure` within `group`, ordered by
    `order_hash`, then `tie`) and `group_total`.

    A group may hold a third of all rows, so no window sees a whole group: rows are cut into
    `buckets` ordered ranges of the hash, the sums of the ranges are accumulated over at most
    `buckets` rows a group, and each range gets its own window. Rows with equal hash and tie are
    told apart by an arbitrary but complete order."""
    from pyspark.sql import Window as W

    b = df.withColumn("_m", measure).withColumn("_b", bucket_of(F.col(order_hash), buckets))
    sums = b.groupBy(*group, "_b").agg(F.sum("_m").alias("_bs"))
    over = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    sums = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_b2"),
        F.coalesce(F.sum("_bs").over(over), F.lit(0)).alias("_base"), F.sum("_bs").over(whole).alias("group_total"),
    )
    cond = (F.col("_b") == F.col("_b2"))
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = W.partitionBy(*group, "_b").orderBy(order_hash, *tie).rowsBetween(W.unboundedPreceding, -1)
    out = b.withColumn("_in", F.coalesce(F.sum("_m").over(inner), F.lit(0))).join(sums, cond)
    drop = ["_m", "_b", "_b2", "_bs", "_base", "_in", *[f"_g{i}" for i in range(len(group))]]
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop(*drop)
