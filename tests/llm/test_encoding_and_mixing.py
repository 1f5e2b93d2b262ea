import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corvane.llm import mixing, tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary")
ODD = ["", None, " ", "  a\n\n b ", "<|endoftext|>", "日本語 text 🧲👩‍🔬", "x" * 50_000, "don't   stop\t\r\n", " ​", "٣٫٥ m", "a" * 3 + "\u0000", "same", "same"]


def reference(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library_and_decode_back(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)], "doc_id long, text string, ids string, block string").repartition(3)
    out = tokenize.encode_corpus(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert [got[i] for i in range(len(ODD))] == reference(ODD)
    assert got[0] == [] and got[1] == []
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(out).collect()}
    assert [back[i] for i in range(len(ODD))] == [t or "" for t in ODD]
    counts = {r.doc_id: r.n_tokens for r in tokenize.encode_corpus(df, counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_any_text_round_trips(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    out = tokenize.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert [r.ids for r in out.orderBy("doc_id").collect()] == reference(texts)


def test_null_and_repeated_ids_keep_their_rows(spark):
    out = tokenize.encode_corpus(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id int, text string")).collect()
    assert sorted((r.doc_id is None, tuple(r.ids)) for r in out) == [(False, (65,)), (False, (65,)), (True, (64,))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenize.encode_corpus(df).count() == 0 and tokenize.encode_corpus(df, counts_only=True).count() == 0
    assert tokenize.decode_corpus(spark.createDataFrame([(1, [999999]), (2, None)], "doc_id int, ids array<int>")).orderBy("doc_id").collect()[0].text == "�"


def sizes(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, n_tokens long, slope string")


WEIGHTS = "mix_name string, source string, target_share double, max_repeats int, size_rate double, available int"


def test_mix_reaches_shares_within_a_document(spark):
    docs = [(i, "abc"[i % 3], 10 + i % 7, None) for i in range(3000)] + [(9000 + i, "tiny", 10, None) for i in range(5)] + [(9999, None, 50, None), (9998, "a", 0, None)]
    s = sizes(spark, docs)
    w = spark.createDataFrame([("m", "a", 0.5, 1, 0.3, 0), ("m", "b", 0.3, 2, 0.3, 0), ("m", "tiny", 0.1, 3, 0.3, 0), ("m", "gone", 0.1, 3, 0.3, 0), ("n", "c", 1.0, 4, 1.0, 0)], WEIGHTS)
    chosen = mixing.choose_documents(s, w).cache()
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(s, w, chosen).collect()}
    total = sum(d[2] for d in docs)
    for key in (("m", "a"), ("m", "b"), ("n", "c")):
        assert abs(report[key].tokens - report[key].target_tokens) <= 20
    # shares are of what the mix really has
    of_m = sum(r.tokens for k, r in report.items() if k[0] == "m")
    assert all(abs(r.actual_share - r.tokens / of_m) < 1e-12 for k, r in report.items() if k[0] == "m")
    assert report["n", "c"].met and report["n", "c"].reason is None
    assert [(report["m", x].met, report["m", x].reason) for x in ("a", "tiny", "gone")] == [(False, "another source lacks tokens"), (False, "source exhausted"), (False, "no document")]
    assert report["m", "tiny"].tokens == 150 and not report["m", "tiny"].met and report["m", "tiny"].most_repeats == 3
    assert report["m", "gone"].tokens == 0 and not report["m", "gone"].met
    assert abs(report["n", "c"].target_tokens - total) < 1e-6 and report["n", "c"].most_repeats <= 4
    assert chosen.groupBy("mix_name", "doc_id", "pass").count().where("count > 1").count() == 0
    assert chosen.where("position < 0 or position > 1").count() == 0


def test_weights_follow_the_schedule(spark):
    s = sizes(spark, [(i, "ab"[i % 2], 1, None) for i in range(4000)])
    w = spark.createDataFrame([("m", "a", 0.5, 1, 1.0, 0), ("m", "b", 0.5, 9, 1.0, 0)], WEIGHTS)
    c = mixing.choose_documents(s, w)
    early = {r.source: r["count"] for r in c.where("position < 0.1").groupBy("source").count().collect()}
    plan = {r.source: r for r in mixing.mix_plan(s, w).collect()}
    for k in "ab":
        p = plan[k]
        assert abs(early[k] - p.place * ((1 - p.slope) * 0.1 + p.slope * 0.01)) < 2
    assert early["a"] > early["b"]


def test_order_is_the_same_for_any_partitions_and_empty_inputs(spark):
    s = sizes(spark, [(i, "a", 5, None) for i in range(200)])
    w = spark.createDataFrame([("m", "a", 1.0, 1, 0.5, 0)], WEIGHTS)
    one = [(r.doc_id, r.position) for r in mixing.training_order(mixing.choose_documents(s, w)).collect()]
    two = [(r.doc_id, r.position) for r in mixing.training_order(mixing.choose_documents(s.repartition(7), w)).collect()]
    assert one == two and len(one) == 100
    assert mixing.choose_documents(s.limit(0), w).count() == 0
    assert mixing.mix_report(s.limit(0), w, mixing.choose_documents(s.limit(0), w)).first().tokens == 0
    assert mixing.choose_documents(s, w.limit(0)).count() == 0
