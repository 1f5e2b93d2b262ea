import random

from pyspark.sql import functions as F

from corvane.llm import leakage, overlap
from corvane.llm.canonical import template_word, words

VOCAB = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) if rng.random() < 0.8 else f"{rng.randint(1, 999)}.{rng.randint(1, 9)} kg" for _ in range(n))


def test_words_set_typesetting_aside():
    plain = words("The mass is 5.5e2 cm at 38.4 h near the magnetic wall")
    for t in ("The mass is $5.5 \\times 10^{2}$ cm at $38.4\\,\\mathrm{h}$ near the magnetic wall", "THE MASS IS 5.5 x 10^2~cm <b>at</b> 38.4&nbsp;h near the magne-\n> tic wall", "<p>The mass is ５.５e2 cm at 38.4\\ h near\nthe mag​netic **wall**</p>"):
        assert words(t) == plain
    assert words(None) == words("") == words(" \n") == words("***") == []
    assert [template_word(w) for w in ("5", "kg", "x", "alpha", "mass")] == ["<num>", "<unit>", "<name>", "<name>", "mass"]


def brute_pairs(evals, train):
    def bag(t):
        count, out = {}, set()
        for w in words(t):
            count[w] = count.get(w, 0) + 1
            out.add((w, count[w]))
        return out

    found = set()
    for i, a in evals:
        for j, b in train:
            if words(a) and words(b):
                if len(bag(a) & bag(b)) >= 0.75 * max(len(bag(a)), len(bag(b))):
                    found.add((i, j))
    return found


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(3, 60)) for _ in range(60)]

    def edited(t):
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 8))):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[rng.choice(VOCAB)], [], [w[i], rng.choice(VOCAB)]])
        return " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)

    evals = [(i, t) for i, t in enumerate(base)] + [(100, None), (101, ""), (102, " "), (103, base[0])]
    train = [(1000 + i, edited(t)) for i, t in enumerate(base)] + [(2000 + i, sentence(rng, 40)) for i in range(40)] + [(3000, None), (3001, ""), (3002, base[0]), (3003, base[0])]
    cols = "rec_id long, text string, n string, shared string"
    e, t = (spark.createDataFrame([(i, x, None, None) for i, x in d], cols) for d in (evals, train))
    got = overlap.cross_split_overlaps(e, t)
    pairs = {(r.eval_rec_id, r.train_rec_id) for r in overlap.record_pairs(*got).collect()}
    assert pairs == brute_pairs(evals, train) and len(pairs) > 30
    count = overlap.overlap_counts(*overlap.cross_split_overlaps(e.withColumn("split", F.lit("s")), t.withColumn("split", F.lit("t")), carry=["split"]), ["split"]).first()
    assert count.pairs == len(pairs) and count.eval_records == len({a for a, _ in pairs})


def test_scattered_changes_keep_a_pair(spark):
    rng = random.Random(6)
    texts = [[rng.choice(VOCAB) for _ in range(n)] for n in (64, 40, 8, 5, 4, 4)]
    gaps = (8, 4, 8, 5, 4, 2)  # of the last text half the words are replaced
    other = [[f"new{chr(97 + i)}" if i % g == g - 1 else w for i, w in enumerate(x)] for x, g in zip(texts, gaps)]
    shuffled = [rng.sample(x, len(x)) for x in other]
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "rec_id long, text string")
    t = spark.createDataFrame([(10 * (1 + k) + i, " ".join(x)) for k, side in enumerate((other, shuffled)) for i, x in enumerate(side)], "rec_id long, text string")
    got = {(r.eval_rec_id, r.train_rec_id) for r in overlap.record_pairs(*overlap.cross_split_overlaps(e, t)).collect()}
    assert got == {(i, 10 * k + i) for i in range(5) for k in (1, 2)}
    blocks = overlap.class_pairs(*(overlap._classes(overlap.text_bags(x, "rec_id", "text", [])) for x in (e, t)), block=2)
    assert blocks.count() == len(got)


def test_no_side_is_exchanged_again_for_the_blocks_of_the_other(spark):
    rng = random.Random(7)
    texts = [[rng.choice(VOCAB) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "rec_id long, text string")
    t = spark.createDataFrame([(100 + i, " ".join(x[1:])) for i, x in enumerate(texts * 5)], "rec_id long, text string").repartition(4)
    kept = [overlap._met_once(overlap.text_bags(x, "rec_id", "text", [])) for x in (e, t)]
    assert [x.count() for x in kept] == [12, 60] and [x.where("bag is not null").count() for x in kept] == [12, 12]
    classes = [x.where("bag is not null").select("text_class", "bag") for x in kept]
    small, whole = (overlap.class_pairs(*classes, block=n) for n in (2, 1000))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect())) and small.count() == 12
    plan = small._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "bag" not in plan


def test_overlaps_of_empty_sides(spark):
    empty = spark.createDataFrame([], "rec_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "rec_id long, text string")
    for e, t in ((empty, some), (some, empty), (empty, empty)):
        assert overlap.record_pairs(*overlap.cross_split_overlaps(e, t)).count() == 0
    assert overlap.record_pairs(*overlap.cross_split_overlaps(some, some)).count() == 1


def test_bitsets_hold_every_hash_and_few_others(spark):
    import numpy as np

    from corvane.llm.common import hash_bitset

    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    for most, others in ((27, 0.03), (12, 1.0)):
        bits, found = hash_bitset(spark.createDataFrame([(int(x),) for x in h] + [(None,), (-1,), (0,)], "h long").repartition(3), "h", most)
        has = lambda x: (found[x >> 3] >> (x & 7).astype(np.uint8)) & 1  # noqa: E731, B023
        place = lambda x: (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)  # noqa: E731, B023
        assert has(place(h)).all() and has(place(np.array([-1, 0]))).all() and has(place(rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64))).mean() <= others
    bits, found = hash_bitset(spark.createDataFrame([], "h long"), "h")
    assert not found.any()
    df = spark.createDataFrame([(i, f"a b c d e f g h a {i}") for i in range(50)], "rec_id long, text string")
    assert int(np.unpackbits(overlap.words_bitset(overlap.text_bags(df, "rec_id", "text", []))[1]).sum()) in (58, 59)
    x = rng.integers(0, 1 << 48, 7).astype(np.uint64)
    assert (overlap.unpacked(overlap.packed(x)) == x).all() and len(overlap.unpacked(b"")) == 0


def test_leaks_whole_partly_and_mistyped(spark):
    rng = random.Random(9)
    items = [(str(i), "<image>\n" + sentence(rng, 50)) for i in range(40)] + [("39", None), (None, sentence(rng, 50)), ("short", "only seven words stand in this item 7.31")]
    items += items[:3]
    quote = lambda k, a, b: " ".join(items[k][1].replace("<image>", "").split()[a:b])
    typo = quote(4, 0, 50).split()
    for i in range(6, len(typo), 11):
        typo[i] = "oops" + typo[i][:2]
    other = " ".join(str(float(w) + 1) if w[0].isdigit() else w for w in quote(6, 0, 50).split())
    corpus = [(1, "x " + quote(0, 0, 60) + " y"), (2, quote(1, 5, 34)), (3, quote(2, 10, 22)), (4, " ".join(typo)), (5, sentence(rng, 80)), (6, other), (7, None), (8, ""), (9, quote(5, 3, 30).upper().replace(" ", "\n")), (9, quote(5, 3, 30)), (10, "so only seven words stand in this item 7.31 yes"), (11, "word " * 30_000 + quote(7, 0, 40))]
    c = spark.createDataFrame([(i, t, None) for i, t in corpus], "rec_id long, text string, index string")
    i = spark.createDataFrame([(k, t, None) for k, t in items], "index string, stem string, text string")
    got = sorted((r.rec_id, r["index"]) for r in leakage.leaked_items(c, i, "rec_id", "text", "index", "stem").collect())
    assert [g for g in got if g[0] != 9] == [(1, "0"), (2, "1"), (4, "4"), (10, "short"), (11, "7")]
    assert (9, "5") in got
    marked = {(r.rec_id, r["index"]) for r in leakage.reparameterised(c, i, "rec_id", "text", "index", "stem").collect()}
    assert (6, "6") in marked and (1, "0") not in marked


def test_quotations_without_numbers_bridge_a_replaced_word():
    chain = lambda runs, numbers=(), stock=(): leakage._chain([(j, 100 + j + shift, 31, j not in stock) for a, b, shift in runs for j in range(a, b - 4)], 60, 60, list(numbers), 5, 20)
    assert chain([(0, 10, 0), (11, 21, 0)]) == 21  # one word replaced
    assert chain([(0, 9, 0), (10, 31, 0)]) == 31
    assert chain([(0, 5, 0), (12, 33, 0)], stock=range(5)) >= 21  # a stock window at a fitting offset
    assert chain([(0, 5, 0), (9, 14, 0), (18, 38, 0)], numbers=[6, 7, 15, 16]) == 20  # another number before a verbatim quotation
    assert chain([(0, 8, 0), (10, 20, 0)]) < 20  # two words side by side: another question of the same build
    assert chain([(0, 19, 0)]) < 20 and chain([(0, 6, 0), (12, 18, 0), (24, 30, 0)]) < 20 and chain([(0, 25, 0)], stock=range(25)) < 20


def test_slots_are_compared_one_by_one(spark):
    rng = random.Random(11)
    items = [(str(i), " ".join(rng.choice(VOCAB) if n % 6 else str(rng.randint(10, 999)) for n in range(1, 61))) for i in range(30)]

    def other(k, every):
        seen = 0
        out = []
        for w in items[k][1].split():
            if w.isdigit():
                seen += 1
                w = str(int(w) + 1000) if seen % every == 0 else w
            out.append(w)
        return " ".join(out)

    c = spark.createDataFrame([(1, other(1, 1)), (2, other(2, 3)), (3, other(3, 99)), (4, "w" + "q " * 30)], "rec_id long, text string")
    i = spark.createDataFrame(items, "index string, stem string")
    got = {(r.rec_id, r["index"]) for r in leakage.leaked_items(c, i, "rec_id", "text", "index", "stem").collect()}
    assert got == {(2, "2"), (3, "3")}  # all numbers others; every third; none
    text, item = "a mass of 7 kg".split(), "a mass of 5 kg".split()
    kinds = [[template_word(w) for w in x] for x in (item, text)]
    assert leakage._aligned(item, text, leakage._at(kinds[0], 5), kinds[1], [True], 5) == [(0, 0, 0b10111, False)]


def test_short_items_are_held_word_for_word(spark):
    i = spark.createDataFrame([("a", "mass 5"), ("b", "the speed of light"), ("c", ""), ("d", "***")], "index string, stem string")
    c = spark.createDataFrame([(1, "the mass 5 kg"), (2, "mass 6"), (3, "find the speed of light now"), (4, "the speed light")], "rec_id long, text string")
    got = {(r.rec_id, r["index"]) for r in leakage.leaked_items(c, i, "rec_id", "text", "index", "stem").collect()}
    assert got == {(1, "a"), (3, "b")}


def test_leaks_with_several_replaced_words(spark):
    rng = random.Random(10)
    items = [(str(i), " ".join(rng.choice(VOCAB) for _ in range(50))) for i in range(20)]
    quote = items[3][1].split()[10:30]
    quote[6], quote[13] = "oops", "alas"
    c = spark.createDataFrame([(1, " ".join(quote)), (2, " ".join(items[4][1].split()[10:26]))], "rec_id long, text string")
    i = spark.createDataFrame(items, "index string, stem string")
    got = [tuple(r) for r in leakage.leaked_items(c, i, "rec_id", "text", "index", "stem").collect()]
    assert got == [(1, "3", 20)]


def test_leaks_with_empty_tables(spark):
    c = spark.createDataFrame([(1, "a b c d e f")], "rec_id long, text string")
    i = spark.createDataFrame([("1", "a b c d e f")], "index string, stem string")
    run = lambda x, y: leakage.leaked_items(x, y, "rec_id", "text", "index", "stem").count()
    assert run(c.limit(0), i) == 0 and run(c, i.limit(0)) == 0


def test_leaks_of_items_of_stock_templates(spark):
    rng = random.Random(12)
    mould = [rng.choice(VOCAB) if n % 5 else None for n in range(1, 41)]
    made = [(str(i), " ".join(w or str(rng.randint(1000, 9999)) for w in mould)) for i in range(12)]
    c = spark.createDataFrame([(1, "so " + made[3][1]), (2, " ".join(w or "7" for w in mould))], "rec_id long, text string")
    i = spark.createDataFrame(made, "index string, stem string")
    got = {(r.rec_id, r["index"]) for r in leakage.leaked_items(c, i, "rec_id", "text", "index", "stem").collect()}
    assert got == {(1, "3")}
