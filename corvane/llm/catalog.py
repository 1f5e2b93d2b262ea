"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, mixing, overlap, pairs, proportions, residue, tokenize, truncation
from .common import cut_lineage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "oe_items").groupBy("id").agg(F.min("question").alias("question"))
    g = table(spark, d, "generations").select("gen_id", "id", "response", "gold", "raw_len")
    rows = g.join(items, "id", "left").select("gen_id", "question", "response", "gold", "raw_len")
    return pairs.find_defects(rows, "gen_id").select("gen_id", "defect")


def p3_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_mini").select(F.col("_uid").alias("uid"), F.col("_concept").alias("concept"), F.col("_difficulty").alias("difficulty"), F.col("_source_bucket").alias("source_bucket"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that would need an inclusion probability above 1."""
    return proportions.target_report(p3_pool(spark, d), table(spark, d, "mini_targets")).where("pressure > 1").select("target_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    r = proportions.sample_report(p3_pool(spark, d), table(spark, d, "mini_targets"))
    return r.select("target_id", "plan_name", "usable", "plan_usable", "met", "drawn", F.round("reached_share", 6).alias("reached_share"), "reason")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.draw(p3_pool(spark, d), table(spark, d, "mini_targets"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = tokenize.encode_corpus(docs.select("doc_id", "text"), counts_only=True)
    return docs.select("doc_id", "source").join(n, "doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut_lineage(_sizes(spark, d))
    return mixing.training_order(mixing.choose_documents(sizes, table(spark, d, "mix_weights")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sizes, w = cut_lineage(_sizes(spark, d)), table(spark, d, "mix_weights")
    return mixing.mix_report(sizes, w, mixing.choose_documents(sizes, w))


def _contents(c: str = "messages") -> F.Column:
    return F.array_join(F.transform(c, lambda m: m["content"]), "\n")


def stem(c: F.Column) -> F.Column:
    """Question without its lettered options."""
    cut = F.regexp_extract(c, r"(?s)^(.+?)\s*\n\s*\(?[Aa]\s*[).:]\s.*$", 1)
    return F.coalesce(F.nullif(cut, F.lit("")), c)


def _leak_sides(spark: SparkSession, d: str):
    corpus = table(spark, d, "master_corpus").select("rec_id", _contents().alias("text"))
    items = table(spark, d, "phyx_mc").select("index", stem(F.col("question")).alias("stem"))
    return corpus, items


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    corpus, items = _leak_sides(spark, d)
    return leakage.leaked_items(corpus, items, "rec_id", "text", "index", "stem").select("rec_id", "index")


def p2_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    corpus, items = _leak_sides(spark, d)
    return leakage.reparameterised(corpus, items, "rec_id", "text", "index", "stem")


def _split_sides(spark: SparkSession, d: str):
    first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"].alias("text")
    subset = F.col("metadata.corpus_subset")

    def side(name, split):
        return table(spark, d, name).select("rec_id", first, split.alias("split"), F.col("source"))

    master = table(spark, d, "master_corpus").select("rec_id", first, subset.alias("split"), "source")
    evals = side("eval_olympiad_v2", F.lit("eval_olympiad_v2")).unionByName(side("eval_mini", F.lit("eval_mini"))).unionByName(master.where(F.col("split").startswith("eval")))
    train = side("train_pool", F.lit("train_pool")).unionByName(master.where(F.col("split") == "train"))
    return evals, train


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    evals, train = _split_sides(spark, d)
    found = overlap.record_pairs(*overlap.cross_split_overlaps(evals, train))
    return found.select(F.least("eval_rec_id", "train_rec_id").alias("rec_id_a"), F.greatest("eval_rec_id", "train_rec_id").alias("rec_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    evals, train = _split_sides(spark, d)
    return overlap.overlap_counts(*overlap.cross_split_overlaps(evals, train, carry=["split", "source"]), ["split", "source"])


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations").select("gen_id", "response", "raw_len")
    return truncation.find_truncated(g, "gen_id", "response", "raw_len", table(spark, d, "oe_items").select("question"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("cut").select("gen_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "generations"), _truncated(spark, d), "gen_id", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.split_residue(table(spark, d, "documents"))[1]


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_reparameterised": p2_reparameterised, "p3_found": p3_found, "p3_report": p3_report, "p3_sample": p3_sample, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_rates": p5_rates, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_clean": p8_clean}

_P3 = """
with pool as (
  select distinct _uid as uid, lower(regexp_replace(_concept, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as c,
    lower(regexp_replace(_difficulty, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as d,
    lower(regexp_replace(_source_bucket, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as s
  from eval_mini where _uid is not null
), hits as (
  select distinct t.plan_name, t.target_id, p.uid from mini_targets t join pool p
  on (t.concept is null or lower(trim(t.concept)) = p.c) and (t.difficulty is null or lower(trim(t.difficulty)) = p.d)
  and (t.source_bucket is null or lower(trim(t.source_bucket)) = p.s)
), per as (select target_id, count(*) as usable from hits group by 1),
whole as (select plan_name, count(distinct uid) as plan_usable from hits group by 1),
report as (
  select t.target_id, t.plan_name, coalesce(usable, 0) as usable, coalesce(plan_usable, 0) as plan_usable,
    coalesce(usable, 0) >= greatest(cast(t.min_rows as double), t.target_share * t.sample_rate * coalesce(plan_usable, 0)) as met
  from mini_targets t left join per using (target_id) left join whole on whole.plan_name = t.plan_name
)
"""

# rows of a target in the sample: the allocation on sorted break points, then whole numbers passed from one start
_P3_DRAWN = _P3 + """,
mine as (select plan_name, uid, min(target_id) as target_id from hits group by 1, 2),
sizes as (select t.plan_name, t.target_id, coalesce(c.n, 0) as n, coalesce(t.target_share * t.sample_rate, 0) * coalesce(w.plan_usable, 0) as quota, coalesce(t.min_rows, 0) as floor_rows
  from mini_targets t left join (select target_id, count(*) as n from mine group by 1) c using (target_id) left join whole w on w.plan_name = t.plan_name),
bounds as (select *, cast(least(floor_rows, n) as double) as lo, cast(n as double) as hi from sizes),
points as (select plan_name, pt, sum(slope) as slope from (select plan_name, lo / quota as pt, quota as slope from bounds where quota > 0 union all select plan_name, hi / quota, -quota from bounds where quota > 0) group by 1, 2),
slopes as (select plan_name, pt, sum(slope) over (partition by plan_name order by pt) as slope from points),
gains as (select *, coalesce(lag(slope) over w * (pt - lag(pt) over w), 0) as g from slopes window w as (partition by plan_name order by pt)),
walked as (select *, sum(g) over (partition by plan_name order by pt) as gained from gains),
total as (select plan_name, sum(quota) as n, sum(lo) as floors from bounds group by 1),
rates as (select plan_name, max_by(pt + case when slope > 1e-12 then (n - floors - gained) / slope else 0 end, pt) as rate from walked join total using (plan_name) where n - floors - gained >= -1e-9 group by 1),
alloc as (select plan_name, target_id, greatest(lo, least(hi, coalesce(rate, 0) * quota)) as rows from bounds left join rates using (plan_name)),
sums as (select *, coalesce(sum(rows) over (partition by plan_name order by target_id rows between unbounded preceding and 1 preceding), 0) + cast(('0x' || substr(md5('42:start:' || plan_name), 1, 8)) as bigint) / 4294967296 as base from alloc),
drawn as (select plan_name, target_id, cast(floor(base + rows + 1e-9) - floor(base + 1e-9) as bigint) as drawn from sums)
"""

ORACLE = {
    "p3_found": _P3 + "select target_id from report where not met",
    "p3_report": _P3_DRAWN + """select r.target_id, r.plan_name, usable, plan_usable, met, drawn, round(coalesce(drawn / nullif(sum(drawn) over (partition by r.plan_name), 0), 0), 6) as reached_share,
  case when met then null when usable = 0 then 'no usable row' when usable < min_rows then 'fewer usable rows than min_rows' else 'fewer usable rows than its share asks for' end as reason
  from report r join drawn d using (target_id) join mini_targets t using (target_id)""",
}
