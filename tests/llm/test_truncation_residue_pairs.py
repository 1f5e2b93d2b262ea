import hashlib
import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from corvane.llm import pairs, residue, truncation

PARTS = ["The {a} {n} weighs {x} kg and rests on a {m} table.", "We first need the {q}, which the {r} law gives.", "Because of the {m}, {x} s must be added.", "Hence the {q} grows in step with the {r} term."]

# complete endings without a full stop: values, units, boxes, options, and formulas in three notations
ENDS = ["Answer: {} m/s", "So we get {} N", "The result is \\boxed{{{}}}", "Final answer: ({2})", "Hence ${2} = {0} {1}^{{2}}$", "Hence \\({1}({2}) = e^{{-{0} t}}\\)", "Hence {1} = {0} {2} / {1}", "So \\[{2} \\approx {0}\\]"]


def text(rng, n=None):
    pick = lambda s: rng.choice(s.split())
    body = [rng.choice(PARTS).format(a=pick("red old tall wet"), n=pick("wheel rope block lamp"), m=pick("steel wood glass clay"), q=pick("speed force load charge"), r=pick("second lens loop torque"), x=f"{rng.randint(1, 99)}.{rng.randint(1, 9)}") for _ in range(n or rng.randint(2, 6))]
    return " ".join(body + [rng.choice(ENDS).format(rng.randint(1, 99), rng.choice("abpqt"), rng.choice("FGMV"))])


def test_held_out_cuts_are_found(spark):
    rng = random.Random(1)
    rows, cut = [], set()
    for i in range(1500):
        t = text(rng)
        if i % 10 == 0:
            at = rng.randrange(15, len(t) - 12)
            while t[at - 1] in " .\\":
                at += 1
            t, _ = t[:at] + rng.choice(["", "", "...", " [stream closed]", "�"]), cut.add(i)
        rows.append((i, t, len(t), None, None))
    rows += [(9000, "42", 50, None, None), (9001, "", 0, None, None), (9002, None, 5, None, None), (9003, "x = 3.1 m", 9, None, None), (9004, "...", 3, None, None), (9005, rows[1][1], 10**6, None, None)]
    df = spark.createDataFrame(rows, "gen_id long, response string, raw_len int, cut string, word string")
    found = {r.gen_id for r in truncation.find_truncated(df, "gen_id", "response", "raw_len").where("cut").collect()}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 3 and not found & {9000, 9001, 9002, 9003, 9004, 9005}
    rate = {r.s: (r.total, r.cut) for r in truncation.truncation_rates(df.withColumn("s", F.lit(None).cast("string")), truncation.find_truncated(df, "gen_id", "response", "raw_len"), "gen_id", "s").collect()}
    assert rate == {None: (len(rows), len(found))}


def test_complete_formulas_without_a_full_stop_are_whole(spark):
    rng = random.Random(7)
    lead = lambda: text(rng).rsplit(". ", 1)[0] + ". "
    formulas = lambda: ["$V_{%d} = \\frac{a}{%d}$" % (rng.randint(1, 9), rng.randint(1, 9)), "\\(\\omega(k) = V e^{-U t}\\)", "$$k = \\sqrt{p^2 + t_{4}^2}$$", "omega = %d.77e2 rho / t" % rng.randint(1, 9)]
    rows = [(i, lead() + "Hence " + rng.choice(formulas()) + rng.choice(["", ".", ""])) for i in range(200)]
    rows += [(1000 + i, lead() + "Hence $V_{2} = \\fra") for i in range(5)] + [(2000 + i, lead() + "Because of the") for i in range(5)]
    got = {r.i for r in truncation.find_truncated(spark.createDataFrame(rows, "i int, t string"), "i", "t").where("cut").collect()}
    assert got == {i for i, _ in rows if i >= 1000}


def test_strict_prefixes_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["h" * 48 + text(rng) for _ in range(30)]
    data = base + [b[: rng.randint(50, len(b))] for b in base] + [b + " and more" for b in base[:9]] + base[:3] + ["short", "sh", "s", None, "", "\U0001f9ea", "\U0001f9ea\uffff", "\uffff"]
    want = {t for t in data if t and any(o and o != t and o.startswith(t) for o in data)}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame([(t,) for t in data], "t string")
        got = {bytes(r.digest) for r in truncation.strict_prefixes(df, "t").collect()}
        assert got == {hashlib.md5(t.encode()).digest() for t in want} and len(want) > 40
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_own_counts_equal_the_joined_evidence(spark):
    rng = random.Random(8)
    whole = [text(rng) for _ in range(12)]
    cut = [(i, t[: rng.randrange(12, len(t) - 6)]) for i, t in enumerate(whole)]
    ends = truncation.tails(spark.createDataFrame(cut, "i long, t string"), "i", "t")
    for i, t in cut:
        e = truncation.ending(t)
        longer = truncation.continuations(spark.createDataFrame([(whole[i],)], "t string"), "t", ends)
        r = truncation.ending_evidence(ends.where(F.col("id") == i), longer).first()
        assert truncation.own_counts(whole[i], e[2]) == [(r[f"on{n}"], r[f"stop{n}"]) for n in truncation.LEVELS], t


def test_a_prefix_of_a_longer_copy_is_cut_whatever_its_ending(spark):
    lead = "The tall red wheel weighs much more than the old wet block and rests near the wall with"
    rows = [(1, lead + " no loss"), (2, lead + " no loss of energy in the steel rope."), (3, "Here the load is held with no loss"), (4, "There a rope runs with no loss"), (5, lead.replace("tall", "long") + " no loss.")]
    rows.append((6, rows[4][1] + " So it stays."))
    got = {r.i: r.cut for r in truncation.find_truncated(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_open_formulas():
    assert truncation.unbalanced("so $x = 1") and truncation.unbalanced("so \\frac{1") and truncation.unbalanced("it is \\[a + b")
    assert not truncation.unbalanced("so $x$ and \\(y\\) and {z}") and not truncation.unbalanced("a bill of \\$5")


def test_truncation_of_an_empty_table(spark):
    assert truncation.find_truncated(spark.createDataFrame([], "i int, t string, n int"), "i", "t", "n").count() == 0


def test_residue_cases_and_look_alikes(spark):
    bad = ["{{title}}", "Figure: [INSERT TOPIC HERE]", "Dear <%= user.name %>, welcome", "the %(term)s of it", "x __PAGE_TITLE__ y", "See ${section}.", "by {author} on", "[[due_date]]", "TBD: topic goes here", "{% block a_b %}{% endblock %}", "{{id}}", "Hi {{ user1 | upper }}!", "{{item-name}}", "see ${price1} now", "\n[[q1]]\n", "<TITLE_HERE> by us", "%(x1)s of it", "__PAGE_2__ follows", "{% " + "x" * 90 + " %}", "q = ${solution} \\cdot V",
           "Body. Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "404 Not Found\nThe requested URL was not found on this server.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "Seite nicht gefunden.", "La página: Lo sentimos, la página que busca no existe.",
           "text " * 40_000 + "Error establishing a database connection", "HTTP 503 - Service Unavailable", "Please  check back in 12​ minutes."]
    good = ["The peak at 404 keV was not found in the cork sample.", "Write ${{T}}^{{2}}$ with \\mathrm{min} and \\frac{abc}{def}", 'printf("%d %s\\n", n, name);', "Placeholders such as <mass> or [time] are common.", "The Latin word dolor means pain.", "In Python, f\"{x!r}\" inserts x",
            "The service of the pump was unavailable for 4 min.", "An applet written in JavaScript shows the sled.", "Access to the drum was forbidden after 890 min.", "x_{max} and ${\\tau}_{B}$ and __init__", "$a^{{ab}} = {h}_{{xy}}$", "so ${x1} = 3$ and ${r}_{f} = {R}^{{k}} r$", "a <b> c <TAG> d", "m[[0]] and [[1, 2]]", "", None, " \n", "Fill in the gap _____ yourself", '{"status": 200}', "error 5 percent or less"]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(bad + good)] + [(0, bad[0], "l"), (None, "plain", "l")], "doc_id int, text string, label string")
    found = residue.find_residue(df)
    assert sorted({r.doc_id for r in found.collect()}) == list(range(len(bad)))
    assert found.where("doc_id = 0").count() == 2  # copies count each
    hit, clean = residue.split_residue(df)
    assert clean.count() == len(good) + 1 and hit.count() == len(bad)
    assert residue.find_residue(df.limit(0)).count() == 0


def sample(rng, n):
    rows = []
    for i in range(n):
        q = " ".join(["How heavy is the thing, if"] + [text(rng, 2).rsplit(".", 1)[0] for _ in range(2)]) + "?"
        rows.append([i, q, text(rng), [str(rng.randint(1, 99))], None, "x"])
    return rows


GERMAN = "Zunächst betrachten wir das Fass, denn die Energie ist noch unbekannt. Nach 3 h hat sich die Platte um 4 km verschoben. Daraus ergibt sich das Ergebnis nicht ohne Verluste."


def test_defects_on_held_out_pairs(spark):
    rng = random.Random(4)
    rows = sample(rng, 900)
    truth = set()
    for i in range(0, 900, 6):
        kind = pairs.LABELS[(i // 6) % 5]
        r = rows[i]
        if kind == "empty":
            r[2:4] = rng.choice([["", r[3]], [None, r[3]], ["<think>so</think> ", r[3]], ["N/A", r[3]], [r[2], None], [r[2], []], [r[2], [" ", None]], ["\\boxed{}", r[3]]])
        elif kind == "refusal":
            r[2] = rng.choice(["", "We begin. "]) + rng.choice(["Unfortunately, I can't help with this task.", "I must decline this request. Please consult a teacher.", "My guidelines keep me from working through exam material."])
        elif kind == "copied":
            r[2:4] = rng.choice([[r[1], r[3]], [r[1].upper(), r[3]], [r[2], [r[1]]]])
        elif kind == "other_language":
            r[2] = GERMAN
        else:
            at = rng.randrange(30, len(r[2]) - 15)
            while r[2][at - 1] in " .\\":
                at += 1
            r[2] = r[2][:at]
        truth.add((i, kind))
    rows.append([9001, rows[1][1], 'The label says "Das ist nicht die Energie, denn sie ist noch unbekannt". ' + rows[1][2], ["5"], None, "x"])
    rows.append([9002, None, rows[1][2], ["5"], None, "x"])
    rows.append([9003, rows[1][1], "42", ["5"], 2, "x"])
    rows.append([9004, rows[1][1], "Unfortunately, the force does not vanish. I cannot neglect friction here, so it stays. Answer: 4 m/s", ["5"], None, "x"])
    rows.append([9005, rows[1][1], "I must decline this request. " + rows[1][2], ["5"], None, "x"])  # whatever follows
    df = spark.createDataFrame(rows, "gen_id long, question string, response string, gold array<string>, raw_len int, cut string")
    got = {(r.gen_id, r.defect) for r in pairs.find_defects(df, "gen_id").collect()}
    hit = len(got & truth)
    assert hit >= 0.95 * len(truth) and hit >= 0.95 * len(got), (truth - got, got - truth)
    assert (9005, "refusal") in got
    got = {g for g in got if g[0] != 9005}
    assert not {g for g in got if g[0] > 9000}


def test_pairs_of_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "q", "", [], 0)], "gen_id long, question string, response string, gold array<string>, raw_len int")
    assert pairs.find_defects(df.limit(0), "gen_id").count() == 0
    pairs.find_defects(df, "gen_id").collect()


def test_language_and_core():
    assert pairs.language(GERMAN) == "de" and pairs.language("The force is in the box and it is red.") == "en" and pairs.language("温度约为，速度等于，能量减少") == "zh"
    assert pairs.language("$x$ 42") is None and pairs.language(None) is None
    assert pairs.core("<think>a</think>") == pairs.core("Answer:") == pairs.core("$$ $$") == pairs.core("null") == pairs.core("​") == pairs.core("\\boxed{}") == pairs.core(None) == ""
    assert pairs.core("\\boxed{B}") == "B" and pairs.core("42") == "42" and pairs.copied_share("a b c d e f", "a b c d e f") == 1.0


def test_short_questions_can_be_copied():
    assert pairs.copied_share("what is the mass", "What is the **mass**?") == 1.0 and pairs.copied_share("Why", "Why?") == 1.0
    assert pairs.copied_share("the mass", "What is the mass?") == pairs.copied_share("", "") == pairs.copied_share(None, None) == 0.0


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from corvane.llm import pairs
df = s.createDataFrame([(i, "What is it?", "The red mass is %d kg." % i if i else "", ["5"], None) for i in range(20)], "gen_id long, question string, response string, gold array<string>, raw_len int")
print("FOUND", sorted((r.gen_id, r.defect) for r in pairs.find_defects(df, "gen_id").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "FOUND [(0, 'empty')]" in out.stdout, out.stderr[-2000:]
