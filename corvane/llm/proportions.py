"""Sample matching target category proportions (problem 3).

Method: systematic unequal-probability sampling. Each category has an inclusion probability; one that would have to be
above 1 cannot be met and is drawn whole, and what it lacks goes to the other categories in the ratio of their
targets, less what floors take. Rows stand in random order within the sorted categories of a plan; probabilities are
accumulated over all partitions and the rows at which the sum passes an integer, counted from one random start, are
drawn. Floors are repaired after.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import label_key, running_totals

LABELS = ("concept", "difficulty", "source_bucket")


def _key(columns: dict, used: tuple) -> F.Column:
    """Join key of a category: which labels it names, and their values; null if one is missing."""
    return F.concat(F.lit("|".join(used)), *[F.concat(F.lit("\u0001"), columns[c]) for c in used])


def usable_rows(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (plan_name, target_id, uid) where the row's labels name the target's category.

    `pool`: uid and the labels; `targets`: target_id, plan_name and the labels, of which null ones are
    not part of the category. Rows without uid and labels outside all categories are not usable; a uid
    is used once however often its rows repeat."""
    norm = {c: label_key(F.col(c)) for c in LABELS}
    subsets = [s for n in range(len(LABELS) + 1) for s in combinations(LABELS, n)]
    rows = pool.where(F.col("uid").isNotNull()).select("uid", *[norm[c].alias(c) for c in LABELS]).distinct()
    rows = rows.select("uid", F.explode(F.array(*[_key({c: F.col(c) for c in LABELS}, s) for s in subsets])).alias("_k"))
    sig = F.coalesce(*[F.when(F.lit(True) if not s else _all(s), _key(norm, s)) for s in reversed(subsets)])
    cats = targets.select("target_id", "plan_name", sig.alias("_c"))
    return rows.join(cats, F.col("_k") == F.col("_c")).select("plan_name", "target_id", "uid").distinct()


def _all(names: tuple) -> F.Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def target_report(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: usable rows, usable rows of the plan, rows needed, the inclusion probability that would take them
    (`pressure`), and whether it is met, which is whether that is a probability at all.

    needed = greater of min_rows and target_share * sample_rate * (usable rows of the plan), unrounded;
    null parameters count as 0. Plans without a usable row are reported with 0."""
    return _report(targets, usable_rows(pool, targets))


def _report(targets: DataFrame, use: DataFrame) -> DataFrame:
    targets = targets.select("target_id", "plan_name", *LABELS, "target_share", "min_rows", "sample_rate")
    per = use.groupBy(F.col("target_id").alias("_t"), F.col("plan_name").alias("_q")).agg(F.count("*").alias("usable"))
    whole = use.select("plan_name", "uid").distinct().groupBy(F.col("plan_name").alias("_p")).agg(F.count("*").alias("plan_usable"))
    out = targets.join(per, F.col("target_id").eqNullSafe(F.col("_t")) & F.col("plan_name").eqNullSafe(F.col("_q")), "left").join(whole, F.col("plan_name").eqNullSafe(F.col("_p")), "left")
    n, all_n = F.coalesce("usable", F.lit(0)), F.coalesce("plan_usable", F.lit(0))
    share = F.coalesce(F.col("target_share") * F.col("sample_rate"), F.lit(0.0)) * all_n
    needed = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), share)
    pressure = F.when(needed <= 0, 0.0).when(n == 0, F.lit(float("inf"))).otherwise(needed / n)
    return out.select(
        "target_id", "plan_name", n.alias("usable"), all_n.alias("plan_usable"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), share.alias("quota"), needed.alias("needed"),
        pressure.alias("pressure"), (n >= needed).alias("met"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"),
    )


def allocate(sizes: DataFrame) -> DataFrame:
    """Adds `rows`, the expected rows of each category, to (plan_name, target_id, count, quota, min_rows).

    rows = rate * quota, but never less than min_rows nor more than there are, with one rate a plan, so that the sum is
    the sum of the quotas (or all there is, or the floors if they are more). The rate is found on the sorted points at which a
    category leaves its floor or is used up, between which the sum is a straight line: no loop, and a few rows a target."""
    lo, hi = F.least("min_rows", "count").cast("double"), F.col("count").cast("double")
    c = sizes.withColumn("_lo", lo).withColumn("_hi", hi)
    event = lambda at, slope: F.struct((at / F.col("quota")).alias("at"), slope.alias("slope"))
    events = c.where("quota > 0").select("plan_name", F.explode(F.array(event(F.col("_lo"), F.col("quota")), event(F.col("_hi"), -F.col("quota")))).alias("e"))
    points = events.groupBy("plan_name", "e.at").agg(F.sum("e.slope").alias("slope"))
    by = W.partitionBy("plan_name").orderBy("at")
    after = points.withColumn("slope", F.sum("slope").over(by))
    gained = F.coalesce(F.lag("slope").over(by) * (F.col("at") - F.lag("at").over(by)), F.lit(0.0))
    walked = after.withColumn("_g", gained).withColumn("gained", F.sum("_g").over(by))
    total = c.groupBy(F.col("plan_name").alias("_p")).agg(F.sum("quota").alias("_n"), F.sum("_lo").alias("_floors"))
    room = F.col("_n") - F.col("_floors") - F.col("gained")
    reached = walked.join(total, F.col("plan_name").eqNullSafe(F.col("_p"))).where(room >= -1e-9)
    rate = reached.groupBy(F.col("plan_name").alias("_p")).agg(F.max_by(F.struct("at", "slope", room.alias("room")), "at").alias("r"))
    rate = rate.select("_p", (F.col("r.at") + F.when(F.col("r.slope") > 1e-12, F.col("r.room") / F.col("r.slope")).otherwise(0.0)).alias("rate"))
    out = c.join(rate, F.col("plan_name").eqNullSafe(F.col("_p")), "left")
    wanted = F.coalesce("rate", F.lit(0.0)) * F.col("quota")
    return out.withColumn("rows", F.greatest(F.col("_lo"), F.least(F.col("_hi"), wanted))).drop("_lo", "_hi", "_p", "rate")


def random_start(plan: Column, seed: int) -> Column:
    """One start in [0, 1) a plan, from an md5, so that other engines give the same."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("start"), plan)), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def draw(pool: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Drawn rows: plan_name, target_id, uid, inclusion (probability), how ("systematic" or "floor").

    A uid that names several categories of a plan stands in the one of least target_id. A category
    with fewer rows than its quota is drawn whole, and the others make good for it in the ratio of their targets."""
    use = usable_rows(pool, targets)
    report = _report(targets, use).select(F.col("target_id").alias("_t"), F.col("plan_name").alias("_q"), "quota", "min_rows")
    use = use.groupBy("plan_name", "uid").agg(F.min("target_id").alias("target_id"))
    keyed = use.withColumn("_h", F.xxhash64(F.lit(seed), "plan_name", "uid"))
    ranked = running_totals(keyed, ["plan_name", "target_id"], "_h", ["uid"], F.lit(1)).withColumnRenamed("before", "_rank").withColumnRenamed("group_total", "_n")
    sizes = use.groupBy("plan_name", "target_id").count().join(report, F.col("target_id").eqNullSafe(F.col("_t")) & F.col("plan_name").eqNullSafe(F.col("_q")), "right")
    sizes = allocate(sizes.select(F.col("_q").alias("plan_name"), F.col("_t").alias("target_id"), F.coalesce("count", F.lit(0)).alias("count"), "quota", "min_rows")).where("count > 0")
    sizes = sizes.withColumn("inclusion", F.col("rows") / F.col("count"))
    base = F.sum("rows").over(W.partitionBy("plan_name").orderBy("target_id").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("plan_name").alias("_p"), F.col("target_id").alias("_i"), "inclusion", "min_rows", (F.coalesce(base, F.lit(0.0)) + random_start(F.col("plan_name"), seed)).alias("_base"))
    at = F.col("_base") + F.col("_rank") * F.col("inclusion")
    # 1e-9 keeps whole-number sums of doubles on their own side of the crossing
    hit = F.floor(at + F.col("inclusion") + 1e-9) > F.floor(at + 1e-9)
    each = ranked.join(sizes, F.col("plan_name").eqNullSafe(F.col("_p")) & F.col("target_id").eqNullSafe(F.col("_i"))).withColumn("_hit", hit)
    drawn = each.where("_hit").groupBy(F.col("plan_name").alias("_p2"), F.col("target_id").alias("_i2")).agg(F.count("*").alias("_got"))
    each = each.join(drawn, F.col("plan_name").eqNullSafe(F.col("_p2")) & F.col("target_id").eqNullSafe(F.col("_i2")), "left")
    short = F.col("min_rows") - F.coalesce("_got", F.lit(0))
    # the missed rows among the first min_rows + drawn ones are enough to fill any floor
    near = each.where(~F.col("_hit") & (short > 0) & (F.col("_rank") < F.col("min_rows") + F.coalesce("_got", F.lit(0))))
    fill = near.withColumn("_r", F.row_number().over(W.partitionBy("plan_name", "target_id").orderBy("_rank"))).where(F.col("_r") <= short)
    cols = ["plan_name", "target_id", "uid", "inclusion"]
    return each.where("_hit").select(*cols, F.lit("systematic").alias("how")).unionByName(fill.select(*cols, F.lit("floor").alias("how")))


def sample_report(pool: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """target_report with the rows drawn, the share they have of the plan's sample, and why a target is not met."""
    got = draw(pool, targets, seed).groupBy(F.col("plan_name").alias("_p"), F.col("target_id").alias("_i")).agg(F.count("*").alias("_n"))
    out = target_report(pool, targets).join(got, F.col("plan_name").eqNullSafe(F.col("_p")) & F.col("target_id").eqNullSafe(F.col("_i")), "left").withColumn("drawn", F.coalesce("_n", F.lit(0)))
    whole = out.groupBy(F.col("plan_name").alias("_q")).agg(F.sum("drawn").alias("plan_drawn"))
    reason = F.when(F.col("met"), None).when(F.col("usable") == 0, "no usable row").when(F.col("usable") < F.col("min_rows"), "fewer usable rows than min_rows").otherwise("fewer usable rows than its share asks for")
    out = out.join(whole, F.col("plan_name").eqNullSafe(F.col("_q")))
    return out.select("target_id", "plan_name", "usable", "plan_usable", "target_share", "needed", "pressure", "met", "drawn", "plan_drawn", F.coalesce(F.try_divide("drawn", "plan_drawn"), F.lit(0.0)).alias("reached_share"), reason.alias("reason"))
