import random

from pyspark.sql import functions as F

from corvane.llm import proportions
from corvane.llm.common import running_totals

POOL = "uid string, concept string, difficulty string, source_bucket string, usable int"
TARGETS = "target_id int, plan_name string, concept string, difficulty string, source_bucket string, target_share double, min_rows int, sample_rate double, usable int"


def test_report_on_uneven_labels(spark):
    pool = spark.createDataFrame([("1", " EM\t", "low", "x", 0), ("1", "EM", "low", "x", 0), ("2", "em", None, "x", 0), ("3", "QM", "low", None, 0), (None, "EM", "low", "x", 0), ("4", "?", "low", "x", 0), ("5", None, None, None, 0)], POOL)
    targets = spark.createDataFrame([(1, "c", "EM", None, None, 0.5, 2, 1.0, 0), (2, "c", "QM", None, None, 0.5, 2, 1.0, 0), (3, "c", "Optics", None, None, None, None, None, 0), (4, "d", "em ", "LOW", None, 1.0, 0, 1.0, 0), (5, "all", None, None, None, 1.0, 0, 1.0, 0)], TARGETS)
    got = {r.target_id: (r.usable, r.plan_usable, r.met) for r in proportions.target_report(pool, targets).collect()}
    assert got == {1: (2, 3, True), 2: (1, 3, False), 3: (0, 3, True), 4: (1, 1, True), 5: (5, 5, True)}


def test_draw_meets_quotas_floors_and_shares(spark):
    pool = spark.createDataFrame([(str(i), "A" if i % 10 else "B", None, None, 0) for i in range(2000)] + [("7", "A", None, None, 0)], POOL)
    targets = spark.createDataFrame([(1, "p", "a", None, None, 0.6, 1, 0.2, 0), (2, "p", "b", None, None, 0.4, 1, 0.2, 0), (3, "q", "a", None, None, 0.001, 30, 0.2, 0), (4, "q", "b", None, None, 0.4, 5, 0.2, 0), (5, "r", "a", None, None, 0.5, 0, 0.2, 0), (6, "r", "none", None, None, 0.5, 5, 0.2, 0)], TARGETS)
    got = proportions.draw(pool, targets).collect()
    n = {t: sum(r.target_id == t for r in got) for t in range(1, 7)}
    assert abs(n[1] - 240) <= 1 and abs(n[2] - 160) <= 1
    assert n[3] == 30 and abs(n[4] - 130.4) <= 1  # what a floor takes comes from the others
    assert abs(n[5] - 360) <= 1 and n[6] == 0  # what a category lacks goes to the others
    assert len({(r.plan_name, r.uid) for r in got}) == len(got)
    again = proportions.draw(pool.repartition(5), targets).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_small_categories_are_drawn_whole_and_empty_tables_work(spark):
    pool = spark.createDataFrame([("1", "a", None, None, 0), ("2", "a", None, None, 0), ("3", "b", None, None, 0)], POOL)
    targets = spark.createDataFrame([(1, "p", "a", None, None, 0.9, 5, 1.0, 0), (2, "p", "b", None, None, 0.1, 0, 1.0, 0)], TARGETS)
    got = proportions.draw(pool, targets).collect()
    assert sum(r.target_id == 1 for r in got) == 2 and sum(r.target_id == 2 for r in got) <= 1
    assert proportions.draw(pool.limit(0), targets).count() == 0 and proportions.draw(pool, targets.limit(0)).count() == 0
    assert {r.target_id: r.usable for r in proportions.target_report(pool.limit(0), targets).collect()} == {1: 0, 2: 0}


def brute_allocation(cats):
    """Rows of each (count, quota, floor) by bisection of the rate."""
    lo, hi = 0.0, 1e9
    rows = lambda rate: [max(min(f, c), min(c, rate * q)) for c, q, f in cats]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(rows(mid)) < sum(q for _, q, _ in cats) else (lo, mid)
    return rows(lo)


def test_allocation_equals_bisection(spark):
    rng = random.Random(3)
    plans = [[(rng.choice([0, 1, 5, 40, 300]), rng.choice([0.0, 0.5, 7.0, 33.3, 90.0]), rng.choice([0, 1, 4, 50])) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    df = spark.createDataFrame([(f"p{i}", j, *c) for i, p in enumerate(plans) for j, c in enumerate(p)], "plan_name string, target_id int, count long, quota double, min_rows int")
    got = {(r.plan_name, r.target_id): r.rows for r in proportions.allocate(df).collect()}
    for i, p in enumerate(plans):
        for j, want in enumerate(brute_allocation(p)):
            assert abs(got[f"p{i}", j] - want) < 1e-6, (p, j)


def test_sample_report_tells_shares_and_reasons(spark):
    pool = spark.createDataFrame([(str(i), "a" if i else "b", None, None, 0) for i in range(50)], POOL)
    targets = spark.createDataFrame([(1, "p", "a", None, None, 0.5, 0, 0.4, 0), (2, "p", "b", None, None, 0.4, 0, 0.4, 0), (3, "p", "c", None, None, 0.1, 1, 0.4, 0)], TARGETS)
    got = {r.target_id: r for r in proportions.sample_report(pool, targets).collect()}
    assert [got[i].drawn for i in (1, 2, 3)] == [19, 1, 0] and got[1].reached_share == 0.95
    assert [got[i].reason for i in (1, 2, 3)] == [None, "fewer usable rows than its share asks for", "no usable row"] and got[3].pressure == float("inf")


def test_running_totals_equal_a_plain_scan(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 2}", i % 5) for i in range(300)], "i int, g string, m int").withColumn("h", F.xxhash64("i"))
    got = running_totals(df, ["g"], "h", ["i"], F.col("m"), 8).collect()
    for g in (None, "g0", "g1"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.i)):
            assert r.before == total
            total += r.m
        assert all(r.group_total == total for r in got if r.g == g)
