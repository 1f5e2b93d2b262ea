import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import similarity

from .conftest import rows


def norm(t):
    t = re.sub(r"\\[a-zA-Z]+\b", " ", t.lower())
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def shingles(n, k=5):
    w = n.split(" ")
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_norm_and_shingles(spark):
    texts = ["A \\frac{1}{2} café, x_1!", "", "one two three four five six", "a b", None, "[x](y) $z$"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.audit_norm(F.col("t")).alias("n"), text.shingle_set(text.audit_norm(F.col("t"))).alias("s")).collect()
    for r in got:
        t = texts[r.i]
        if t is None:
            assert r.n is None and r.s is None
        else:
            assert r.n == norm(t) and set(r.s) == shingles(norm(t))


def test_jaccard_of_empty_sets(spark):
    df = spark.range(1).select(F.array().cast("array<string>").alias("e"), F.array(F.lit("a")).alias("a"))
    assert df.select(text.jaccard(F.col("e"), F.col("a")), text.jaccard(F.col("a"), F.col("a"))).first()[:] == (0.0, 1.0)


@pytest.mark.parametrize("t", [0.1, 0.4, 0.8])
def test_self_join_equals_nested_loop(spark, t):
    rng = random.Random(3)
    base = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    data = [(i, x) for i, x in enumerate(base + base[:7] + ["", "", "a b c d e"])]
    pairs, members = similarity.near_duplicates(spark.createDataFrame(data, "id int, t string"), "id", "t", t)
    reps = {}
    for i, x in data:
        reps.setdefault(norm(x), i)
    want = set()
    for a, ra in reps.items():
        for b, rb in reps.items():
            sa, sb = shingles(a), shingles(b)
            if ra < rb and len(sa & sb) / len(sa | sb) >= t:
                want.add((ra, rb))
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {(r.id, r.rep) for r in members.collect()} == {(i, reps[norm(x)]) for i, x in data}


def test_texts_that_share_a_few_rare_shingles_are_no_candidates(spark):
    # each text shares 4 of its 12 shingles with 5 others of its row and 4 with 5 others of its column
    texts = [" ".join([f"r{r}w{j}" for j in range(8)] + [f"c{c}w{j}" for j in range(8)]) for r in range(6) for c in range(6)]
    texts += [t + " more" for t in texts[:2]]
    normed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, norm string")
    p = similarity._prefixes(similarity._classes(normed, [], 5), [], 0.4)
    left, right = (p.select("s", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for x in "ab")
    assert {tuple(r) for r in similarity._candidates(left, right, ["s"], 0.4, True).collect()} == {(0, 36), (1, 37)}
    pairs, members = similarity.near_duplicates(normed, "id", "norm", 0.4)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 36), (1, 37)}
    assert {r.id for r in similarity.linked_members(pairs, members).where("links > 0").collect()} == {0, 1, 36, 37}


def test_pairs_that_share_few_shingles_are_not_compared_in_any_order_of_ids(spark):
    texts = [" ".join([f"r{r}w{j}" for j in range(8)] + [f"c{c}w{j}" for j in range(8)]) for r in range(5) for c in range(5)]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate([*texts, texts[7] + " more", texts[9]])], "rec_id long, text string")
    c = similarity._classes(df.select(F.col("rec_id").alias("id"), F.col("text").alias("norm")), [], 5)
    left, right = (similarity._prefixes(c, [], 0.4).select("s", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for x in "ab")
    assert similarity._candidates(left, right, ["s"], 0.4, True).count() == 1
    assert [(r.a, r.b) for r in similarity.near_duplicates(df, "rec_id", "text")[0].collect()] == [(75, 93)]


@pytest.mark.parametrize("t", [0.2, 0.4, 0.7])
def test_self_join_holds_no_row_a_shingle_and_loses_none_at_the_cuts(spark, monkeypatch, t):
    from corvane.operators import posting

    monkeypatch.setattr(posting, "FLUSH", 300)
    monkeypatch.setattr(posting, "STEP", 7)
    rng = random.Random(4)
    stock = [" ".join(f"s{i}w{j}" for j in range(9)) for i in range(4)]
    texts = {" ".join(rng.sample(stock, rng.randint(0, 3)) + [rng.choice("abc") for _ in range(rng.randint(1, 14))]) for _ in range(150)}
    data = list(enumerate(sorted(texts)))
    pairs, _ = similarity.near_duplicates(spark.createDataFrame(data, "id int, t string").repartition(3), "id", "t", t)
    assert "explode" not in pairs._jdf.queryExecution().toString()
    sets = [shingles(x) for _, x in data]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, _ in data for b in range(a + 1, len(data))}
    assert {(r.a, r.b): r.jaccard for r in pairs.collect()} == {p: j for p, j in want.items() if j >= t}


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        similarity.near_duplicates(spark.createDataFrame([], "id int, t string"), "id", "t", 0)


def test_compare_splits_top_and_counts(spark):
    data = [("train", "1", "a b c d e f"), ("train", "2", "a b c d e f"), ("train", "3", "z"), ("eval", "9", "a b c d e f g"), ("eval", "8", None)]
    pairs, members = similarity.compare_splits(spark.createDataFrame(data, "split string, id string, text string"), [("t_e", "train", "eval"), ("t_x", "train", "none")])
    assert [(r.comparison, r.a, r.b) for r in pairs.collect()] == [("t_e", "1", "9")]
    assert rows(similarity.counts(pairs)) == [("t_e", 1), (None, 1)]
    assert [r.rank for r in similarity.top_pairs(pairs).collect()] == [1]
    assert {(r.id, r.rep) for r in members.collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("9", "9")}


def test_empty_table(spark):
    pairs, members = similarity.near_duplicates(spark.createDataFrame([], "id int, t string"), "id", "t")
    assert pairs.count() == 0 and members.count() == 0
