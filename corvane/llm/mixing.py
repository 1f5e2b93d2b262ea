"""Mixing sources to target weights along a curriculum (problem 7).

Method: every source has a weight schedule over the training position t in [0, 1]; its integral is
the cumulative token demand of the source. Inverting that demand at the cumulative tokens of a
document gives the document's position, and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals

TILT = 0.5
BUCKETS = 1024


def mix_plan(sizes: DataFrame, weights: DataFrame, tilt: float = TILT) -> DataFrame:
    """One row a (mix, source): demand in tokens, tokens available, tokens to place, full passes
    and the slope of the weight schedule.

    Weight of a source at t: share * (1 + slope * (2t - 1)). Slopes are larger for sources that may
    be repeated more (they come later) and are centred, so that the weights of a mix add up to the
    same sum at any t. Sources without documents, or without size, have nothing available."""
    have = sizes.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens")).scalar()
    w = weights.select("mix_name", "source", "target_share", "max_repeats", "size_rate").join(have, F.col("source") == F.col("_s"), "left").drop("_s").withColumn("corpus_tokens", total)
    rough = F.lit(tilt) * (F.col("max_repeats") - 1) / (F.col("max_repeats") + 1)
    mean = w.groupBy(F.col("mix_name").alias("_mix")).agg((F.sum(F.col("target_share") * rough) / F.sum("target_share")).alias("_mean"))
    demand = F.col("target_share") * F.col("size_rate") * F.col("corpus_tokens")
    avail = F.coalesce("available", F.lit(0))
    return (
        w.join(mean, F.col("mix_name").eqNullSafe(F.col("_mix")))
        .withColumn("slope", rough - F.col("_mean"))
        .withColumn("demand", demand)
        .withColumn("available", avail)
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
        .withColumn("place", F.least(demand, (avail * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).cast("double")))
        .withColumn("passes", F.when(avail > 0, F.ceil(F.col("place") / avail)).otherwise(0).cast("int"))
        .drop("_mix", "_mean")
    )


def choose_documents(sizes: DataFrame, weights: DataFrame, seed: int = 42, tilt: float = TILT) -> DataFrame:
    """Chosen documents: mix_name, source, doc_id, pass (1..max_repeats), n_tokens, position.

    `sizes`: doc_id, source, n_tokens. In each pass a source's documents stand in one seeded order;
    a copy is taken while at least half of it fits into what is to be placed. No copy has a number above max_repeats.
    Null sources, sources in no mix and documents of no tokens are not used."""
    plan = mix_plan(sizes, weights, tilt)
    docs = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).join(weights.select(F.col("source").alias("_u")).distinct(), F.col("source") == F.col("_u"), "left_semi")
    keyed = docs.select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("_h"))
    ordered = running_totals(keyed, ["source"], "_h", ["doc_id"], F.col("n_tokens"), BUCKETS)
    p = plan.where(F.col("passes") > 0).select("mix_name", F.col("source").alias("_src"), "demand", "place", "available", "passes", "slope")
    each = ordered.join(p, F.col("source") == F.col("_src")).drop("_src").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    at = F.col("before") + (F.col("pass") - 1) * F.col("available") + F.col("n_tokens") / 2
    # cumulative demand: D(t) = demand * ((1 - s) t + s t^2); inverted in closed form
    y = F.col("_at") / F.greatest(F.col("place"), F.lit(1e-9))
    s = F.col("slope")
    t = F.when(F.abs(s) < 1e-9, y).otherwise((s - 1 + F.sqrt(F.greatest((1 - s) * (1 - s) + 4 * s * y, F.lit(0.0)))) / (2 * s))
    return (
        each.withColumn("_at", at).where(F.col("_at") <= F.col("place"))
        .select("mix_name", "source", "doc_id", F.col("pass").cast("int").alias("pass"), "n_tokens", t.alias("position"))
    )


def training_order(chosen: DataFrame) -> DataFrame:
    """Range sort by position, within each mix."""
    return chosen.repartitionByRange("mix_name", "position", "doc_id").sortWithinPartitions("mix_name", "position", "doc_id", "pass")


SHARE_TOLERANCE = 0.005  # of the target share


def mix_report(sizes: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reached against target, one row a (mix, source) of `weights`, also for sources without any document.

    actual_share: of the tokens that the mix really has. `met`: it is the target share, up to SHARE_TOLERANCE of it or half a mean
    document of the source. `reason` of one that is not: the source has no document, it is exhausted, or it has its tokens and
    another source of the mix lacks its own, so that its share is larger."""
    plan = mix_plan(sizes, weights)
    got = chosen.groupBy(F.col("mix_name").alias("_m"), F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), F.max("pass").alias("most_repeats"))
    full = chosen.groupBy(F.col("mix_name").alias("_f")).agg(F.sum("n_tokens").alias("mix_tokens"))
    out = plan.join(got, F.col("mix_name").eqNullSafe(F.col("_m")) & (F.col("source") == F.col("_s")), "left").join(full, F.col("mix_name").eqNullSafe(F.col("_f")), "left")
    tokens = F.coalesce("tokens", F.lit(0))
    doc = F.when(F.col("docs") > 0, F.col("available") / F.col("docs")).otherwise(0.0)
    share = F.coalesce(F.try_divide(tokens, F.col("mix_tokens")), F.lit(0.0))
    met = F.abs(share - F.col("target_share")) <= F.greatest(F.col("target_share") * SHARE_TOLERANCE, F.coalesce(F.try_divide(doc / 2 + 1, F.col("mix_tokens")), F.lit(0.0)))
    lacks = tokens < F.col("demand") - F.greatest(F.col("demand") * SHARE_TOLERANCE, doc / 2 + 1)
    reason = F.when(met, None).when(F.col("available") == 0, "no document").when(lacks, "source exhausted").otherwise("another source lacks tokens")
    return out.select(
        "mix_name", "source", "target_share", F.col("demand").alias("target_tokens"), tokens.alias("tokens"),
        share.alias("actual_share"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats", met.alias("met"), reason.alias("reason"),
    )
