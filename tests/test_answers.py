import pytest
from pyspark.sql import functions as F

from corvane.functions import extract, match, prompts, reward, tags, text
from corvane.operators import judging


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def one(df, c):
    return [r.y for r in df.select("i", c.alias("y")).orderBy("i").collect()]


def test_boxes(spark):
    df = col(spark, ["\\boxed{ a{b{c}} } and \\boxed{2}", "\\boxed{open \\boxed{3}", None, "none", "\\boxed{1} \\boxed{2"])
    assert [list(x) for x in one(df, extract.boxed_all("x"))] == [["a{b{c}}", "2"], [], [], [], ["1"]]
    assert one(df, extract.boxed_last(extract.boxed_all("x"))) == ["2", None, None, None, "1"]


def test_choice_letters(spark):
    given = ["A</think> so \\boxed{B}", "Answer: (C)", "**D**", "it is B.", "x (A) y", "A dog", "", None, "nothing"]
    assert one(col(spark, given), extract.choice_letter(F.col("x"))) == ["B", "C", "D", "B", "A", "A", "X", "X", "X"]


def test_tail_yes_no_and_parts(spark):
    got = one(col(spark, ["Answer: 5 V. Thus 5 V", None]), extract.tail_candidates(F.col("x")))
    assert got[0][0] == "5 V" and len(got[0]) == len(set(got[0])) and got[1] is None
    assert one(col(spark, ["well no", "YES or no", "yesterday", None]), extract.yes_no(F.col("x"))) == [False, True, None, None]
    assert one(col(spark, ["\n(a) 5\n(b) 6", "(a) 5\n(b) 6", "7"]), extract.gold_parts(F.col("x"))) == [["5", "6"], ["6"], ["7"]]
    assert one(col(spark, ['["a","b"]', "[broken", "c"]), extract.gold_list(F.col("x"))) == [["a", "b"], ["[broken"], ["c"]]


def test_strict_matches(spark):
    df = spark.createDataFrame([(["15"], "5"), (["4"], "5"), ([], ""), (["1,000 V"], "1000"), (["x"], None), ([""], "")], "p array<string>, g string")
    assert [r[0] for r in df.select(match.strict_match(F.col("p"), F.col("g"))).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in df.select(match.strict_match_any(F.col("p"), F.col("g"))).collect()] == [True, False, False, True, False, False]


@pytest.mark.parametrize("s,v", [("1/2", 0.5), ("3\\times10^8 m/s", 3.0), ("2x", 2.0), ("9**9**9", None), ("2^{3}", 8.0), ("-4.5e2", -450.0), ("", None), (None, None), ("abc", None), ("\\frac{1}{4}", 0.25), ("(1+1", None)])
def test_numbers(s, v):
    assert reward.number(s) == v


@pytest.mark.parametrize(
    "s,g,v",
    [("\\boxed{0.5}", "1/2", 1), ("\\boxed{100.9}", "100", 1), ("\\boxed{101.1}", "100", 0), ("\\boxed{0}", "0", 1), ("\\boxed{1e-7}", "0", 1), ("\\boxed{(b) 1 (a) 2}", "(a) 1 (b) 2", 0),
     ("\\boxed{(a) 1 (b) 2}", "(a) 1 (b) 2", 1), ("\\boxed{1; 2}", "1; 2", 1), ("Answer: (B)", "b", 1), (None, "1", 0), ("\\boxed{1}", None, 0), ("\\boxed{}", "1", 0), ("\\boxed{\\text{x}}", "\\text{x} tail", 1)],
)
def test_answer_score(s, g, v):
    boxes = extract.balanced_boxes(s)
    assert reward.answer_score(s, g, boxes[-1] if boxes else None) == v


def test_reward_components_and_total(spark):
    data = [("5 N so \\frac{a}{b} \\boxed{5}", "5"), ("5 MeV \\boxed{7}", "5"), (None, "5"), ("nothing", "5")]
    df = spark.createDataFrame(data, "s string, g string").select("s", reward.answer_facts("s", "g").alias("f"))
    parts = reward.components(F.col("f"), F.col("s"))
    got = df.select(*[c.alias(n) for n, c in parts.items()], reward.total(parts, dense=True).alias("t"), reward.total(parts, audit_lambda=1.0, contamination=F.lit(0.5)).alias("half")).collect()
    assert [tuple(r)[:4] for r in got] == [(1.0, 0.1, 0.15, 0.2), (0.0, 0.1, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    assert [r.t for r in got] == [1.0, 0.1, 0.0, 0.0] and got[0].half == 0.5
    cons = F.struct(F.array(F.lit(10.0)).alias("in"), F.array(F.lit(4.0), F.lit(0.0)).alias("out"), F.lit(1).alias("answer_index"), F.lit(None).cast("double").alias("tol"))
    assert [spark.range(1).select(reward.conservation_broken(F.lit(v), cons)).first()[0] for v in (6.2, 7.0, None)] == [False, True, False]


def test_tags(spark):
    meta = "struct<tags:array<string>,topic:string,book:string,theorem:string,subject:string,category:string,chapter:string,difficulty:string,score:double>"
    none = (None,) * 9
    data = [(0, none, "a lens"), (1, None, "spindle"), (2, (["spin"],) + (None,) * 8, "lens"), (3, (None,) * 7 + ("Difficult", 1.0), None), (4, (None,) * 8 + (25.0,), None), (5, (None,) * 8 + (9.9,), None)]
    df = spark.createDataFrame(data, f"i int, m {meta}, q string")
    assert [r[0] for r in df.orderBy("i").select(tags.topic(F.col("m"), F.col("q"))).collect()] == ["Optics", "Mechanics", "QM", "Mechanics", "Mechanics", "Mechanics"]
    assert [r[0] for r in df.orderBy("i").select(tags.difficulty(F.col("m.difficulty"), F.col("m.score"), F.lit("ugphysics"))).collect()] == ["high", "high", "high", "high", "high", "low"]
    book = df.limit(1).select(*[tags.hardness(F.lit("mid"), F.lit("openstax"), F.struct(F.lit(b).alias("book"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("double").alias("score"))) for b in ("Vol 3", "vol2", "vol 2", "vol3")])
    assert book.first()[:] == (1.5, 1.0, 1.5, 1.5)
    assert spark.range(1).select(tags.uid(F.lit("b"), F.lit(""), F.lit(7))).first()[0] == "b::b_7"


def test_prompts(spark):
    df = col(spark, ["<image> q", None])
    assert one(df, prompts.fill("P {problem_text}", F.col("x"))) == ["P q", "P "]
    m = df.select(prompts.user_message(F.col("x"), F.array(F.lit("aa"), F.lit(None)))).first()[0]
    assert [p["type"] for p in m] == ["image_url", "text"] and m[0]["value"] == "data:image/jpeg;base64,aa"


def test_judge_asks_only_for_the_rest_and_keeps_errors(spark):
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def call(prompt):
            seen.add(1)
            if "GOLD: bad" in prompt:
                raise RuntimeError("down")
            return "yes" if "GOLD: two" in prompt else "NO"

        return call

    df = spark.createDataFrame([(1, ["5"], ["5"]), (2, ["5", "two"], ["5"]), (3, ["three"], ["5"]), (4, [], ["5"]), (5, ["x"], []), (6, ["bad"], ["5"]), (7, None, None)], "id int, g array<string>, p array<string>")
    got = {r.id: (r.strict, r.liberal, r.judged, r.errors) for r in judging.judge_golds(df, "id", "g", "p", factory).collect()}
    assert got == {1: (True, True, 0, 0), 2: (False, True, 1, 0), 3: (False, False, 1, 0), 4: (False, False, 0, 0), 5: (False, False, 0, 0), 6: (False, False, 1, 1), 7: (False, False, 0, 0)}
    assert seen.value == 3
    everything = judging.judge_golds(df, "id", "g", "p", factory, strict_first=False)
    assert {r.id: r.judged for r in everything.collect()}[2] == 2
    assert sorted(r.id for r in judging.done_rows(judging.judge_golds(df, "id", "g", "p", factory)).collect()) == [1, 2, 3, 4, 5, 7]


def test_call_model_retries(spark):
    def factory():
        tries = []

        def call(p):
            tries.append(p)
            return "" if len(tries) < 3 else "done"

        return call

    df = spark.createDataFrame([(1, "p")], "id int, prompt string").coalesce(1)
    assert judging.call_model(df, ["id"], "prompt", factory, attempts=4, wait=lambda n: 0).first().reply == "done"
    assert judging.call_model(df, ["id"], "prompt", factory, attempts=2, wait=lambda n: 0).first().reply == ""


def test_answer_norm(spark):
    assert spark.range(1).select(text.answer_norm(F.lit("\\text{A B} $1,0\\,0$")), text.answer_norm(F.lit(None).cast("string"), commas=False)).first()[:] == ("ab1,00", "")


@pytest.mark.parametrize("s,v", [("\\frac{\\frac{1}{2}}{\\dfrac{3}{4}}", 2 / 3), ("2^3^2", 512.0), ("-2^2", -4.0), ("10^3}", 10.0), ("6//4", 1.0), ("2**-1", 0.5), ("010*2", 10.0), ("--3", 3.0), ("(2)(3)", None), ("\\left(1+2\\right)*3", 9.0), ("(-8)**0.5", None), ("1/0", 1.0), ("(" * 5000 + "1+1", None)])
def test_arithmetic_binds_as_usual_and_falls_back_to_the_leading_number(s, v):
    assert reward.number(s) == v


def test_lines_of_latex():
    line = reward.linear
    assert line("\\frac{1}{\\frac{a}{b}} \\pi") == "(1)/((a)/(b))pi" and line("\\text{5 \\%} kg") == "5kg"
    assert line("\\frac {1}{2}") == line("\\frac{1} {2}") == "\\frac{1}{2}" and line("\\frac{x^{2}}{3}") == "\\frac{x^{2}}{3}"
    deep = "\\frac{" * 4 + "1" + "}{2}" * 4
    assert line(deep) == "\\frac{(((1)/(2))/(2))/(2)}{2}" and line("\\frac{}{2}") == "\\frac{}{2}"


def test_plain_answers_give_the_same_facts_in_either_engine(spark):
    from corvane.plans.cases import REWARD_CASES

    data = [(g, s) for g, s, _, _ in REWARD_CASES] + [("5", f"\\boxed{{{x}}}") for x in ("5", " 5.04 ", "-5", "+5.06", "1e1")] + [("0", "\\boxed{0.0000001}"), ("5", "\\boxed{5} \\frac{1}{2}")]
    rows = spark.createDataFrame(data, "g string, s string").select("g", "s", reward.answer_facts("s", "g").alias("f")).collect()
    for r in rows:
        boxes = extract.balanced_boxes(r.s)
        b = boxes[-1] if boxes else None
        assert (r.f.boxed, r.f.answer, r.f.number) == (b, reward.answer_score(r.s, r.g, b), reward.number(b)), r


def test_late_calls_time_out_and_batches_keep_their_rows(spark):
    import time

    df = spark.createDataFrame([(i, "slow" if i == 3 else f"p{i}") for i in range(10)], "id int, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.err) for r in judging.call_model(df, ["id"], "prompt", lambda: lambda p: time.sleep(5) if p == "slow" else "ok", limit=0.5).collect()}
    assert got[3] == ("", "attempt 1: timeout after 0.5 s") and all(got[i] == ("ok", None) for i in got if i != 3)
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def call(prompts):
            sizes.add(1)
            assert len(prompts) <= 4
            return [p.upper() for p in prompts]

        return call

    back = judging.call_batches(df.withColumnRenamed("prompt", "reply"), ["id"], "reply", factory, size=4)
    assert {r.id: r.reply for r in back.collect()} == {i: "SLOW" if i == 3 else f"P{i}" for i in range(10)} and sizes.value == 3
    assert judging.call_batches(df.limit(0), ["id"], "prompt", factory).count() == 0


def test_gold_lookup_and_whole_solutions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "id int, err0 string")
    golds = spark.createDataFrame([("1", ["x"]), ("2", [])], "id string, golds array<string>")
    assert {r.id: (r.golds, r.err) for r in judging.with_golds(df, golds, "id").collect()} == {1: (["x"], None), 2: ([], "no gold"), None: ([], "no gold"), 4: ([], "no gold")}
    seen = spark.createDataFrame([(1, "5" * 4000, ["15"], "r" * 700), (2, "", ["5"], "r"), (3, "7", None, None), (4, None, [], "r")], "id int, g string, b array<string>, r string")

    def factory():
        return lambda p: "YES" if p.count("5") == 3001 and p.count("r" * 600) == 1 and "r" * 601 not in p or "[no box]" in p else "NO"

    assert {r.id: (r.strict, r.liberal) for r in judging.judge_whole(seen, "id", "g", "b", "r", factory).collect()} == {1: (False, True), 2: (False, False), 3: (False, True), 4: (False, False)}
