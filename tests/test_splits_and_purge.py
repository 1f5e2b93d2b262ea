import hashlib

from pyspark.sql import functions as F

from corvane.operators import purge, splits, stats

from .conftest import rows


def test_keep_first_is_ordered_and_null_safe(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("b", 3, None)], "k string, o int, v string")
    assert rows(splits.keep_first(df, "k", [F.col("o")])) == [("a", 1, "y"), ("b", 3, None), (None, 4, "m")]


def test_last_wins_keeps_first_place(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")], "id string, pos int, v string")
    assert rows(purge.last_wins(df, "id", "pos")) == [("a", 2, "z", 0), ("b", 1, "y", 1)]


def test_stratified_shortfall_and_bounds(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else f"s{i}") for i in range(55)], "uid int, g string")
    got = splits.stratified(df, 20, ["g"], "uid").collect()
    assert len(got) == 20 and {f"s{i}" for i in range(50, 55)} <= {r.g for r in got}
    assert splits.stratified(df, 100, ["g"], "uid").count() == 55
    assert splits.stratified(df, 3, ["g"], "uid").count() == 3
    assert splits.stratified(df.limit(0), 3, ["g"], "uid").count() == 0
    again = splits.stratified(df.repartition(7), 20, ["g"], "uid").collect()
    assert sorted(r.uid for r in again) == sorted(r.uid for r in got)


def test_proportional_quotas(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("a" * 5 + "b" * 5 + "c" * 5)], "uid int, g string")
    q = {r.g: r._quota for r in splits.quotas(df, 10, ["g"]).collect()}
    assert q == {"a": 3, "b": 3, "c": 4}  # equal remainders go by descending key
    assert splits.proportional(df, 10, ["g"], "uid").count() == 10
    assert splits.proportional(df, 99, ["g"], "uid").count() == 15
    assert splits.proportional(df.limit(0), 10, ["g"], "uid").count() == 0


def test_capped_top_equals_greedy_scan(spark):
    data = [(i, float(i % 7), "xyz"[i % 3]) for i in range(60)]
    caps = {"x": 4, "y": 2}
    got = {r.uid for r in splits.capped_top(spark.createDataFrame(data, "uid int, h double, s string"), 12, "h", "s", "uid", caps).collect()}
    order = sorted(data, key=lambda r: (-r[1], hashlib.md5(f"42:t:{r[0]}".encode()).hexdigest(), r[0]))
    used, picked = {}, []
    for r in order:
        if len(picked) < 12 and used.get(r[2], 0) < caps.get(r[2], 0):
            picked.append(r[0])
            used[r[2]] = used.get(r[2], 0) + 1
    picked += [r[0] for r in order if r[0] not in picked][: 12 - len(picked)]
    assert got == set(picked)


def test_four_way_is_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, float(i % 5), ["ugphysics", "openstax", "other"][i % 3], "c%d" % (i % 4), ["low", "mid", "high"][i % 3]) for i in range(300)], "uid int, h double, s string, c string, d string")
    got = splits.four_way(df, "uid", "h", "s", "c", "d", 20, 40, 60)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"eval_hard": 20, "eval_mini": 40, "eval_full": 60, "train_pool": 180}
    assert splits.split_check(got, "uid").first()[:] == (300, 300, 0)


def test_purge_and_todo(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3"), ("b", "4")], "key string, v string")
    kept, dropped = purge.purge(df, "key", spark.createDataFrame([("b",), ("b",), (None,)], "id string"))
    assert rows(kept.select("v")) == [("1",), ("3",)] and rows(dropped.select("v")) == [("2",), ("4",)]
    done = spark.createDataFrame([("a", None)], "key string, t string")
    todo = purge.todo(df.withColumn("t", F.lit(None).cast("string")), done, ["key", "t"], ["None", ""])
    assert rows(todo.select("v")) == [("2",), ("3",), ("4",)]
    assert purge.by_family(dropped, F.lit(None).cast("string")).first()[:] == ("?", 2)


def test_statistics(spark):
    df = spark.createDataFrame([("a", "low", True), ("a", "mid", False), ("b", None, None)], "s string, d string, m boolean")
    assert rows(stats.split_summary(df, ["s", "d"], "m")) == sorted([("s", "a", 2, 1), ("s", "b", 1, 0), ("d", "low", 1, 1), ("d", "mid", 1, 0), ("d", None, 1, 0), ("TOTAL", None, 3, 1)], key=repr)
    assert rows(stats.crosstab(df, "s", "d", ["a", "z"], ["low", "mid"])) == [("a", 1, 1), ("z", 0, 0)]
    assert stats.accuracy(df, F.col("m")).first()[:2] == (3, 1)
    assert stats.accuracy(df.limit(0), F.col("m")).first().accuracy is None
    assert "| TOTAL | 3    |" in stats.summary_markdown(stats.split_summary(df, ["s"], "m"), "t")


def test_head_limit_and_report(spark):
    df = spark.createDataFrame([(3, "a", "low", True), (1, "a", "mid", None), (2, "z", None, False)], "i int, s string, d string, m boolean")
    assert [r.i for r in splits.head_limit(df, 2, [F.col("i")]).collect()] == [1, 2] and splits.head_limit(df, 0, [F.col("i")]).count() == 3
    report = stats.split_report(df, "s", "s", "d", "m", ["a", "b"], ["a"], ["low", "mid"])
    got = {tuple(r)[:3]: r["count"] for r in report.collect()}
    assert got["source", "a", "count"] == 2 and got["source", "b", "count"] == 0 and got["source", "TOTAL", "count"] == 3 and got["modality", "text-only", "count"] == 2
    assert got["source x difficulty", "a", "mid"] == 1 and got["source x difficulty", "b", "low"] == 0 and ("source", "z", "count") not in got
    shown = stats.report_markdown(report, "train", ["a", "b"], ["a"], ["low", "mid"])
    assert "## train  (n=3)" in shown and "| b      | 0   | 0   |" in shown
    assert {r["count"] for r in stats.split_report(df.limit(0), "s", "s", "d", "m", ["a"], ["a"], ["low"]).collect()} == {0}
