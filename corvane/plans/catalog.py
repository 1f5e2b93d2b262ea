"""Registered queries of the core, each over its whole tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, match, prompts, reward, tags, text
from ..operators import judging, purge, similarity, splits, stats
from ..streaming import resume
from .cases import REWARD_CASES
from ..sources import readers, writers
from ..sources.writers import strip_internal

COMPARISONS = [
    ("train_vs_olympiad_v2", "train", "olympiad_v2"), ("train_vs_mini", "train", "mini"), ("train_vs_full", "train", "full"),
    ("train_vs_olympiad", "train", "olympiad"), ("novel_vs_choice", "novel", "choice"),
]
CAPS = {"en": 120, "de": 40, "fr": 30}
SPLIT_CAPS = {"physreason": 25, "ugphysics": 20, "openstax": 7, "physics_se": 10, "rl_sft": 5}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- text and similarity


def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.audit_norm(F.col("text")).alias("norm"))


def shingle_count(spark, d):
    return _t(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(text.shingle_set(text.audit_norm(F.col("text")))).alias("n"))


def near_dup_pairs(spark, d):
    m = _t(spark, d, "master_corpus").select("rec_id", tags.question_of(F.col("messages")).alias("text"))
    return similarity.near_duplicates(m, "rec_id", "text")[0].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dup_members(spark, d):
    pairs, members = similarity.near_duplicates(_t(spark, d, "documents"), "doc_id", "text")
    return similarity.linked_members(pairs, members)


def _split_texts(spark, d):
    first = F.coalesce(tags.question_of(F.col("messages")), F.lit(""))
    rec = F.col("rec_id").cast("string").alias("id")
    part = lambda name, split: _t(spark, d, name).select(F.lit(split).alias("split"), rec, first.alias("text"))
    subset = F.col("metadata.corpus_subset")
    named = F.when(subset == "eval_full", "full").when(subset == "eval_olympiad", "olympiad").when(subset == "novel_pool", "novel")
    master = _t(spark, d, "master_corpus").select(named.alias("split"), rec, first.alias("text")).where(F.col("split").isNotNull())
    choice = _t(spark, d, "phyx_mc").select(F.lit("choice").alias("split"), F.concat(F.lit("mc_"), F.col("index")).alias("id"), F.coalesce("question", F.lit("")).alias("text"))
    return part("train_pool", "train").unionByName(part("eval_olympiad_v2", "olympiad_v2")).unionByName(part("eval_mini", "mini")).unionByName(master).unionByName(choice)


def overlap_pairs(spark, d):
    return similarity.compare_splits(_split_texts(spark, d), COMPARISONS)[0].withColumn("jaccard", F.round("jaccard", 6))


def overlap_counts(spark, d):
    return similarity.counts(similarity.compare_splits(_split_texts(spark, d), COMPARISONS)[0])


def overlap_top(spark, d):
    return similarity.top_pairs(similarity.compare_splits(_split_texts(spark, d), COMPARISONS)[0]).select("comparison", "a", "b", "rank")


def overlap_previews(spark, d):
    texts = _split_texts(spark, d)
    return similarity.with_previews(similarity.compare_splits(texts, COMPARISONS)[0].select("comparison", "a", "b"), texts)


def _train_listed(spark, d):
    pairs, members = similarity.compare_splits(_split_texts(spark, d), COMPARISONS)
    return purge.listed_ids(pairs.where(F.col("comparison").startswith("train")), members.where(F.col("split") == "train"))


def purge_train(spark, d):
    return purge.purge(_t(spark, d, "train_pool").withColumn("key", F.col("rec_id").cast("string")), "key", _train_listed(spark, d))[0].select("rec_id")


def purge_by_family(spark, d):
    dropped = purge.purge(_t(spark, d, "train_pool").withColumn("key", F.col("rec_id").cast("string")), "key", _train_listed(spark, d))[1]
    return purge.by_family(dropped, F.col("metadata._split_tags.source_bucket"))


def purge_keys(spark, d):
    return _t(spark, d, "train_pool").select("rec_id", purge.purge_key(F.col("source"), F.col("metadata._split_tags.uid")).alias("key"))


# ---- distinct, resume, samples, splits


def dedup_keep_first(spark, d):
    return splits.keep_first(_t(spark, d, "documents").select("doc_id", "text", "crawled_at", "source"), "text", [F.col("crawled_at"), F.col("doc_id")]).select("doc_id", "source")


def dedup_keep_last(spark, d):
    return purge.last_wins(_t(spark, d, "generations").select("id", "gen_id", "source"), "id", "gen_id").select("id", "gen_id", "source", "first_pos")


def resume_todo(spark, d):
    return purge.todo(_t(spark, d, "oe_items").select("id", "question"), _t(spark, d, "generations").where(F.col("response").isNotNull()), ["id"])


def resume_composite(spark, d):
    g = _t(spark, d, "generations").select("gen_id", "source", "topic", "benchmark")
    return purge.todo(g, g.where(F.col("benchmark") == "physreason"), ["source", "topic"], ["None", ""]).select("gen_id")


def stratified_sample(spark, d):
    return splits.stratified(_t(spark, d, "documents").select("doc_id", "lang", "source"), 200, ["lang", "source"], "doc_id")


def proportional_sample(spark, d):
    return splits.proportional(_t(spark, d, "documents").select("doc_id", "lang"), 300, ["lang"], "doc_id")


def capped_topk(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("hard"))
    return splits.capped_top(docs, 250, "hard", "lang", "doc_id", CAPS)


def _tagged(spark, d):
    m = _t(spark, d, "master_corpus")
    q = tags.question_of(F.col("messages"))
    bucket = tags.bucket_of_source(F.coalesce("source", F.lit("")))
    md = F.col("metadata")
    t = m.select("rec_id", "source", "images", "messages", "metadata", bucket.alias("_source_bucket"), F.col("rec_id").alias("_row_idx"))
    level = tags.difficulty(md["difficulty"], md["score"], F.col("_source_bucket"))
    t = t.withColumns({"_concept": tags.topic(md, q), "_difficulty": level, "_multimodal": tags.multimodal(F.col("images"), q), "_uid": tags.uid(F.col("_source_bucket"), F.col("source"), F.col("_row_idx"))})
    return t.withColumn("_hardness", tags.hardness(F.col("_difficulty"), F.col("_source_bucket"), md))


def record_tags(spark, d):
    t = _tagged(spark, d)
    return t.select("rec_id", F.col("_source_bucket").alias("bucket"), F.col("_concept").alias("concept"), F.col("_difficulty").alias("difficulty"), F.col("_multimodal").alias("multimodal"), F.col("_uid").alias("uid"), F.round("_hardness", 6).alias("hardness"))


def split_tags_block(spark, d):
    t = strip_internal(_tagged(spark, d), {"source_bucket": "_source_bucket", "concept": "_concept", "difficulty": "_difficulty", "multimodal": "_multimodal", "uid": "_uid"})
    return t.select("rec_id", F.col("metadata._split_tags.uid").alias("uid"), F.col("metadata.topic").alias("topic"))


def _four_way(spark, d):
    return splits.four_way(_tagged(spark, d), "rec_id", "_hardness", "_source_bucket", "_concept", "_difficulty", 40, 120, 200, caps=SPLIT_CAPS)


def four_way_split(spark, d):
    return _four_way(spark, d)


def split_disjoint(spark, d):
    return splits.split_check(_four_way(spark, d), "rec_id")


def union_sources(spark, d):
    a, b = (_t(spark, d, n).select("rec_id", "source", F.lit(n).alias("origin")) for n in ("train_pool", "master_corpus"))
    c = _t(spark, d, "eval_mini").select("rec_id", "source", F.lit("eval_mini").alias("origin"), "_uid")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


# ---- counts


def split_stats(spark, d):
    return stats.split_summary(_tagged(spark, d), ["_source_bucket", "_concept", "_difficulty"], "_multimodal")


def crosstab(spark, d):
    return stats.crosstab(_tagged(spark, d), "_source_bucket", "_difficulty", tags.SOURCES, ["low", "mid", "high"])


# ---- answers


def _answers(spark, d):
    g = _t(spark, d, "generations").select("gen_id", "source", "topic", "subtopic", "response", "gold")
    return g.withColumn("boxes", extract.boxed_all("response"))


def boxed_all(spark, d):
    return _answers(spark, d).select("gen_id", F.array_join("boxes", "|").alias("boxes"))


def boxed_last(spark, d):
    return _answers(spark, d).select("gen_id", extract.boxed_last(F.col("boxes")).alias("boxed"))


def strict_matches(spark, d):
    boxes, golds = F.coalesce("boxes", F.array().cast("array<string>")), F.coalesce("gold", F.array().cast("array<string>"))
    return _answers(spark, d).select(
        "gen_id", F.coalesce(F.exists(golds, lambda g: match.strict_match(boxes, g)), F.lit(False)).alias("strict"),
        F.coalesce(F.exists(golds, lambda g: match.strict_match_any(boxes, g)), F.lit(False)).alias("strict_any"), match.all_golds_matched(F.col("gold"), F.col("boxes")).alias("every"),
    )


def tail_fallback(spark, d):
    return _t(spark, d, "generations").select("gen_id", F.array_join(extract.tail_candidates(text.tail(F.col("response"), 600)), "|").alias("candidates"))


def response_tails(spark, d):
    r = F.col("response")
    return _t(spark, d, "generations").select("gen_id", F.length(r).alias("n"), text.tail(r).alias("tail"), text.preview(r).alias("head"))


def yes_no(spark, d):
    return _t(spark, d, "generations").select("gen_id", extract.yes_no(F.concat(F.col("response"), F.when(F.col("gen_id") % 3 == 0, " Yes.").when(F.col("gen_id") % 3 == 1, " no").otherwise(""))).alias("verdict"))


def _golds(spark, d):
    g = _t(spark, d, "generations").select("gen_id", "response", F.posexplode("gold").alias("n", "gold"))
    return g.where(F.col("gold").isNotNull())


def gold_subparts(spark, d):
    broken = F.replace(F.replace(F.concat(F.lit("Answer:"), F.col("gold")), F.lit("(a)"), F.lit("\n(a)")), F.lit(" (b)"), F.lit("\n (b):"))
    return _golds(spark, d).select("gen_id", "n", F.array_join(extract.gold_parts(broken), "|").alias("parts"))


def gold_lists(spark, d):
    first = F.get("gold", F.lit(0))
    listed = F.when(F.col("gen_id") % 2 == 0, F.to_json("gold")).otherwise(first)
    found = _t(spark, d, "generations").where(F.size("gold") > 0)
    return found.select("gen_id", F.array_join(F.transform(extract.gold_list(listed), lambda x: F.coalesce(x, F.lit("-"))), "|").alias("golds"))


def answer_forms(spark, d):
    return _golds(spark, d).select("gen_id", "n", text.answer_norm(F.col("gold")).alias("plain"), text.answer_norm(F.col("gold"), commas=False).alias("no_commas"))


def mcq_letter(spark, d):
    return _t(spark, d, "generations").select("gen_id", extract.choice_letter(F.col("response")).alias("letter"))


def _graded(spark, d):
    gold = F.substring(F.lit("ABCD"), (F.col("gen_id") % 4 + 1).cast("int"), F.lit(1))
    g = _t(spark, d, "generations")
    return g.withColumn("correct", match.choice_correct(extract.choice_letter(F.col("response")), F.concat(gold, F.lit(" "))))


def mcq_accuracy(spark, d):
    return stats.accuracy(_graded(spark, d), F.col("correct"))


def mcq_by_category(spark, d):
    g = _graded(spark, d).withColumn("category", stats.category(F.col("subtopic"), F.col("topic")))
    return stats.accuracy(g, F.col("correct"), ["category"])


def choice_prompts(spark, d):
    p = _t(spark, d, "phyx_mc")
    m = prompts.user_message(prompts.choice_prompt(F.col("question")), F.array("image"))
    return p.select("index", prompts.choice_prompt(F.col("question")).alias("prompt"), prompts.choice_prompt(F.col("question"), prompts.CHOOSE_LETTER).alias("letter_prompt"), F.size(m).alias("parts"), F.length(F.unbase64("image")).alias("image_bytes"))


def open_prompts(spark, d):
    return _t(spark, d, "oe_items").select("id", prompts.fill(prompts.SOLVE, F.col("question")).alias("prompt"), prompts.fill(prompts.SOLVE_BELOW, F.col("question")).alias("below"))


# ---- reward and judge


def numeric_match(spark, d):
    near = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.009, 1.011, 0.9)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    pred = F.concat(F.lit("so \\boxed{"), (F.col("l_quantity") * near).cast("string"), F.lit("}"))
    facts = reward.answer_facts(pred, F.col("l_quantity").cast("string"))
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", facts.alias("f"))
    return li.select("l_orderkey", "l_linenumber", (F.col("f.answer") == 1).alias("matched"))


def numeric_forms(spark, d):
    """Numbers written as fractions, powers of ten, sums and with units, against plain ones on both sides of 1 %."""
    q, near = F.col("l_quantity").cast("int"), F.element_at(F.array(*[F.lit(x) for x in (1000, 1009, 1011)]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    part = F.col("l_suppkey") % 5
    shown = (
        F.when(part == 0, F.format_string("\\frac{%d}{1000}", q * near)).when(part == 1, F.format_string("%d \\times 10^{-3}", q * near)).when(part == 2, F.format_string("%d/10^3", q * near))
        .when(part == 3, F.format_string("%d/1000 + 0*7", q * near)).otherwise(F.concat((q * near / 1000).cast("string"), F.lit(" \\mathrm{kg}")))
    )
    facts = reward.answer_facts(F.concat(F.lit("so $x$ is \\boxed{"), shown, F.lit("}")), q.cast("string"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", facts.alias("f")).select("l_orderkey", "l_linenumber", (F.col("f.answer") == 1).alias("matched"))


def _rewarded(spark, d):
    return _golds(spark, d).withColumn("facts", reward.answer_facts("response", "gold"))


def reward_components(spark, d):
    g = _rewarded(spark, d)
    return g.select("gen_id", "n", *[c.alias(n) for n, c in reward.components(F.col("facts"), F.col("response")).items()])


def reward_total(spark, d):
    parts = reward.components(F.col("facts"), F.col("response"))
    dirty = (F.col("gen_id") % 3) / 2
    total = reward.total(parts, dense=True, audit_lambda=1.0, contamination=dirty)
    return _rewarded(spark, d).select("gen_id", "n", reward.total(parts).alias("binary"), F.round(total, 6).alias("dense"))


def reward_cases(spark, d):
    df = spark.createDataFrame([(i, g, s) for i, (g, s, _, _) in enumerate(REWARD_CASES)], "case int, gold string, solution string")
    f = reward.answer_facts("solution", "gold")
    return df.select("case", f.alias("f")).select("case", F.col("f.answer").alias("answer"), F.col("f.number").alias("number"))


def reward_format(spark, d):
    return _rewarded(spark, d).select("gen_id", "n", reward.components(F.col("facts"), F.col("response"))["format"].alias("format"))


def reward_conservation(spark, d):
    q = F.col("l_quantity")
    cons = F.struct(F.array(q, F.lit(10.0)).alias("in"), F.array(F.lit(4.0), q).alias("out"), F.lit(1).alias("answer_index"), F.lit(0.05).alias("tol"))
    value = q + F.col("l_linenumber")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reward.conservation_broken(value, cons).alias("broken"))


def _stub_judge():
    return lambda prompt: "YES" if len(prompt.split("GOLD: ")[1].split("\nCANDIDATES")[0]) % 2 == 0 else "No, it is not."


def judge_liberal(spark, d):
    a = _answers(spark, d).withColumn("golds", F.coalesce(F.filter("gold", lambda g: g.isNotNull()), F.array().cast("array<string>")))
    a = a.withColumn("preds", judging.candidates(F.col("boxes"), text.tail(F.col("response"))))
    return judging.judge_golds(a, "gen_id", "golds", "preds", _stub_judge).select("gen_id", "strict", "liberal", "judged")


def judge_counts(spark, d):
    """Rows, strict and liberal ones, rows that needed the judge, and rows whose candidates come from the tail."""
    a = _answers(spark, d)
    boxed = F.coalesce(match.not_blank(F.col("boxes")), F.array().cast("array<string>"))
    used = a.select("gen_id", ((F.size(boxed) == 0) & (F.size(judging.candidates(F.col("boxes"), text.tail(F.col("response")))) > 0)).alias("fallback"))
    j = judge_liberal(spark, d).join(used, "gen_id")
    return j.agg(F.count("*").alias("total"), F.count_if("strict").alias("strict"), F.count_if("liberal").alias("liberal"), F.count_if(F.col("judged") > 0).alias("asked"), F.count_if("fallback").alias("fallback"))


def judge_parts(spark, d):
    """The form in which the judge sees every part of the gold: golds of one benchmark are lists, those of others are split at their marks."""
    marked = F.replace(F.get("gold", F.lit(0)), F.lit("(b)"), F.lit("\n(b)"))
    g = _t(spark, d, "generations").select("gen_id", "benchmark", "gold", marked.alias("whole"), extract.boxed_all("response").alias("boxes"))
    golds = F.when(F.col("benchmark") == "physreason", F.col("gold")).otherwise(extract.gold_parts(F.col("whole")))
    none = F.array().cast("array<string>")
    ready = g.select("gen_id", F.coalesce(F.filter(golds, lambda x: x.isNotNull()), none).alias("golds"), F.coalesce(match.not_blank(F.col("boxes")), none).alias("preds"))
    return judging.judge_golds(ready, "gen_id", "golds", "preds", _stub_judge, strict_first=False, tol="1%").select("gen_id", "liberal", "judged")


def _stub_whole():
    return lambda prompt: "yes" if len(prompt.split("REFERENCE SOLUTION: ")[1].split("\nCANDIDATES")[0]) % 2 == 0 and len(prompt.split("END OF THE RESPONSE:\n")[1]) % 2 == 0 else "NO"


def judge_whole(spark, d):
    a = _answers(spark, d).withColumn("whole", F.array_join("gold", "; "))
    return judging.judge_whole(a, "gen_id", "whole", "boxes", "response", _stub_whole).select("gen_id", "strict", "liberal")


def gold_lookup(spark, d):
    """Golds by item id, of the items with an answer; generations of other items have none."""
    golds = _t(spark, d, "oe_items").where("answer is not null").groupBy("id").agg(F.sort_array(F.collect_set("answer")).alias("golds"))
    return judging.with_golds(_t(spark, d, "generations").select("gen_id", "id"), golds, "id").select("gen_id", F.array_join("golds", "|").alias("golds"), "err")


def _flaky():
    seen = set()

    def call(prompt):
        first = prompt not in seen
        seen.add(prompt)
        if len(prompt) % 3 == 0:
            raise RuntimeError("down")
        return "" if first and len(prompt) % 2 else "YES"

    return call


def model_retries(spark, d):
    q = _t(spark, d, "oe_items").where("question is not null").select("id", "question").distinct()
    r = judging.call_model(q, ["id"], "question", _flaky, attempts=2, wait=lambda n: 0.0)
    return r.select("id", "reply", F.col("err").isNotNull().alias("failed"))


def model_batches(spark, d):
    q = _t(spark, d, "oe_items").where("question is not null").select("id", "question")
    return judging.call_batches(q, ["id"], "question", lambda: lambda prompts: [str(len(p)) for p in prompts], size=50)


def first_rows(spark, d):
    return splits.head_limit(_t(spark, d, "phyx_mc").select("index", "answer").distinct(), 25, [F.col("index"), F.col("answer")])


# ---- files: derived files are written by tasks, read back and compared with the tables


def json_malformed(spark, d):
    """Every third line of events is broken and every fifth blank; the others come back with their places."""
    ev = _t(spark, d, "events").select("event_id", "props")
    line = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("props").alias("response"))))
    path = writers.scratch(spark)
    ev.orderBy("event_id").coalesce(1).select(line.alias("value")).write.text(path)
    return readers.jsonl_tolerant(spark, path, "id string, response string").select(F.col("_row_idx").cast("long").alias("row_idx"), "id", "response", F.col("_bad").isNotNull().alias("bad"))


def json_dropped(spark, d):
    ev = _t(spark, d, "events").select("event_id", "props")
    path = writers.scratch(spark)
    ev.select(F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("id")))).alias("value")).write.text(path)
    return readers.jsonl_dropping(spark, path, "id string").select("id")


def _corpus_file(spark, d, name):
    path = writers.scratch(spark)
    writers.jsonl(_t(spark, d, name).select("source", "images", "messages", "metadata"), path)
    return path


def corpus_subsets(spark, d):
    return readers.corpus_by_split(readers.jsonl_strict(spark, _corpus_file(spark, d, "master_corpus"), readers.CORPUS))


def held_out(spark, d):
    return readers.held_out(readers.jsonl_strict(spark, _corpus_file(spark, d, "eval_olympiad_v2"), readers.CORPUS))


def optional_items(spark, d):
    """Numbered items of a file, and none of a file that is not there."""
    path = writers.scratch(spark)
    _t(spark, d, "phyx_mc").orderBy("index", "question", "answer").coalesce(1).select("index", "question").write.json(path)
    schema = "index string, question string"
    found = readers.numbered_items(readers.optional(spark, path, schema, readers.jsonl_tolerant))
    return found.unionByName(readers.optional(spark, path + "-none", "id string, text string"))


def tsv_items(spark, d):
    path = writers.scratch(spark)
    writers.tsv(_t(spark, d, "phyx_mc"), path)
    return readers.tsv(spark, path).select("index", "question", F.length("image").alias("image_chars"), "answer", "category", F.coalesce("subfield", F.lit("")).alias("subfield"))


def json_array(spark, d):
    path = writers.scratch(spark)
    items = _t(spark, d, "oe_items").select("id", "question", "answer", "subtopic").distinct()
    # one array a block of ids, so that no file holds the whole table
    blocks = items.groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("_b")).agg(F.to_json(F.collect_list(F.struct("id", "question", "answer", "subtopic"))).alias("text"))
    writers.files(blocks.select(F.format_string("%d.json", "_b").alias("name"), "text"), path, "name", "text")
    return readers.json_whole(spark, path, "id string, question string, answer string, subtopic string")


def json_object(spark, d):
    path = writers.scratch(spark)
    golds = _t(spark, d, "oe_items").where("id is not null and answer is not null").groupBy("id").agg(F.sort_array(F.collect_set("answer")).alias("g"))
    blocks = golds.groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("_b")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "g")))).alias("text"))
    writers.files(blocks.select(F.format_string("%d.json", "_b").alias("name"), "text"), path, "name", "text")
    return readers.json_map(spark, path).select("id", F.array_join("value", "|").alias("golds"))


def problem_folders(spark, d):
    """A folder an item; the sub-questions stand in the file against the order of their keys."""
    path = writers.scratch(spark)
    one = _t(spark, d, "oe_items").where("id is not null").groupBy("id").agg(F.min("question").alias("question"), F.min("subtopic").alias("subtopic"), F.min("answer").alias("answer"))
    parts = F.struct(F.coalesce("question", F.lit("")).alias("b"), F.coalesce("subtopic", F.lit("")).alias("a"))
    body = F.to_json(F.struct(parts.alias("question_structure"), F.to_json(F.array(F.coalesce("answer", F.lit("")))).alias("answer"), F.lit("hard").alias("difficulty")))
    writers.files(one.select(F.concat("id", F.lit("/problem.json")).alias("name"), body.alias("text")), path, "name", "text")
    return readers.problem_folders(spark, path).select("id", "problem_text", F.array_join("gold", "|").alias("gold"), "difficulty", F.size("images").alias("images"))


def appended_rows(spark, d):
    """Two appends of disjoint halves, the second through the resuming anti-join."""
    path = writers.scratch(spark)
    g = _t(spark, d, "generations").select("gen_id", "source")
    writers.append_rows(g.where("gen_id % 2 = 0"), path)
    resume.process_rest(g, path, ["gen_id"], lambda rest: rest)
    return spark.read.parquet(path)


def result_document(spark, d):
    g = _graded(spark, d).withColumn("category", stats.category(F.col("subtopic"), F.col("topic")))
    each = stats.accuracy(g, F.col("correct"), ["category"]).drop("accuracy")
    doc = writers.result_document(stats.accuracy(g, F.col("correct")).drop("accuracy"), each)
    kind = "struct<total:long,correct:long,categories:array<struct<category:string,total:long,correct:long>>>"
    back = doc.select(F.from_json("value", kind).alias("r"))
    return back.select("r.total", "r.correct", F.posexplode("r.categories").alias("place", "c")).select("total", "correct", "place", "c.category", F.col("c.total").alias("rows"), F.col("c.correct").alias("hits"))


def split_report(spark, d):
    return stats.split_report(_tagged(spark, d), "_source_bucket", "_concept", "_difficulty", "_multimodal", tags.SOURCES, [t for t, _ in tags.TOPICS], ["low", "mid", "high"])


_NAMES = """normalize_text shingle_count near_dup_pairs near_dup_members overlap_pairs overlap_counts overlap_top overlap_previews purge_train
purge_by_family purge_keys dedup_keep_first dedup_keep_last resume_todo resume_composite stratified_sample proportional_sample capped_topk record_tags
split_tags_block four_way_split split_disjoint union_sources split_stats crosstab boxed_all boxed_last strict_matches tail_fallback response_tails
yes_no gold_subparts gold_lists answer_forms mcq_letter mcq_accuracy mcq_by_category choice_prompts open_prompts numeric_match numeric_forms
reward_components reward_total reward_cases reward_format reward_conservation judge_liberal judge_counts judge_parts judge_whole gold_lookup model_retries
model_batches first_rows json_malformed json_dropped corpus_subsets held_out optional_items tsv_items json_array json_object problem_folders appended_rows
result_document split_report""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from .oracle import ORACLE  # noqa: E402, F401
