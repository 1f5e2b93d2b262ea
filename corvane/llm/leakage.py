"""Evaluation texts leaking into training text (problem 2).

Method: template canonicalisation. Numbers, units and symbol names become typed placeholders; windows of five
template words are hash-joined with those of the held-out items, without stock templates, which many items hold.
Pairs with enough distinctive template words in one chain are then compared whole: windows of the two templates
are chained, stock templates too, and the slots, the words behind the placeholders, are compared one by one. A slot
that disagrees is one missing word, like a mistyped one; a chain is a quotation if nearly all of its words agree and
most of the item's own numbers do. Long template windows whose slots disagree mark re-parameterised questions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .canonical import Hasher, stable_hash, template_word, window_hashes, words
from .common import cut_lineage, hash_bitset

K = 5  # words of a window
LONG_K = 16  # words of a window that marks a re-parameterised question
MIN_WORDS = 20  # consecutive words of the item, split at white space
BRIDGE = 12  # most words between the starts of two linked windows
DRIFT = 3  # most words added or lost between two linked windows
COVER = 0.8  # least share of a chain's words that agree
DISTINCT = 0.5  # least share of the asked words that stand in template windows that are no stock
SLOTS = 0.6  # least share of a chain's own numbers that agree in windows that are no stock phrases
PLAIN = 0.9  # least share of windows that are no stock phrases in a chain without numbers
LITERAL = 0x5BD1E995D6E8FEB8  # tells keys of literal windows from those of templates
STOCK = 0.01  # a window of more than this share of the items, and of more than two, is a stock phrase


class _Template(Hasher):
    def __call__(self, ws):
        seen, out = self.seen, []
        if len(seen) > self.most:
            seen.clear()
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = stable_hash(template_word(w))
            out.append(h)
        return out


def _windows(df: DataFrame, id_col: str, text_col: str, sizes: list[int], known: tuple | None = None, slots: bool = False, both: bool = False) -> DataFrame:
    """(id, place, template, and slots if asked for) of each window of the given sizes; only those whose template may
    be in `known`, a bitset, if given. slots: hash of the literal words, and whether one is a number. both: the hash of the literal words, by LITERAL,
    stands in a row of its own as a template too."""
    import numpy as np

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits, sent = (known[0], df.sparkSession.sparkContext.broadcast(known[1])) if known is not None else (0, None)
    kind = src.schema["id"].dataType.simpleString()
    number = np.uint64(stable_hash(template_word("0")))

    def run(batches):
        lexical, template = Hasher(), _Template()
        for batch in batches:
            lists = [words(t) for t in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in lists], np.int64)
            ends = np.cumsum(size)
            flat = [w for x in lists for w in x]
            kinds = np.array(template(flat), np.uint64)
            exact = np.array(lexical(flat), np.uint64) if slots or both else kinds
            of = np.repeat(np.arange(len(lists)), size)
            for k in sizes:
                own = window_hashes(exact, k) if slots or both else None
                for made in [window_hashes(kinds, k) ^ np.uint64(k), *([own ^ np.uint64(LITERAL)] if both else [])]:
                    if not len(made):
                        continue
                    owner, at = of[: len(made)], np.arange(len(made))
                    ok = at + k <= ends[owner]
                    if sent is not None:
                        pos = (made >> np.uint64(64 - bits)).astype(np.int64)
                        ok &= ((sent.value[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(bool)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    who = owner[at]
                    out = {"id": batch.column(0).take(pa.array(who)), "place": pa.array((at - (ends - size)[who]).astype(np.int32)), "template": pa.array(made[at].view(np.int64))}
                    if slots:
                        held = np.concatenate([[0], np.cumsum(kinds == number)])
                        out["slots"] = pa.array(own[at].view(np.int64))
                        out["number"] = pa.array(held[at + k] > held[at])
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return src.mapInArrow(run, f"id {kind}, place int, template long{', slots long, number boolean' if slots else ''}")


def _distinctive(js: list, places: list, k: int, reach: int, need: float) -> bool:
    """Whether template windows at `js` of the item and `places` of the text, sorted, cover `need` words of the item in
    a stretch of `reach` words, all within BRIDGE words of one offset."""
    n, own = len(js), (1 << k) - 1
    for a in range(n):
        covered, end, shift = 0, js[a] + reach - k, places[a] - js[a]
        for b in range(a, n):
            if js[b] > end:
                break
            if -BRIDGE <= places[b] - js[b] - shift <= BRIDGE:
                covered |= own << js[b]
        if covered.bit_count() >= need:
            return True
    return False


def _at(kinds: list, k: int) -> dict:
    """Places of each template window of an item."""
    at: dict[tuple, list] = {}
    for j in range(len(kinds) - k + 1):
        at.setdefault(tuple(kinds[j : j + k]), []).append(j)
    return at


def _aligned(item: list, text: list, at: dict, text_kinds: list, rare: list, k: int) -> list[tuple]:
    """(j, place, agreeing words of the window as bits, whether it agrees whole and is no stock phrase) of the template
    windows that both hold, in order."""
    out, whole, get = [], (1 << k) - 1, at.get
    for i, window in enumerate(zip(*[text_kinds[n:] for n in range(k)])):
        for j in get(window, ()):
            bits = sum(1 << n for n in range(k) if item[j + n] == text[i + n])
            out.append((j, i, bits, bits == whole and rare[j]))
    return sorted(out)


def _chain(places: list, size: int, spaced: int, numbers: list, k: int, least: int) -> int:
    """Words (as split at white space) of the item that the longest accepted chain holds.

    A chain is accepted if enough of its words stand in agreeing windows, and enough of the item's
    own numbers in it in agreeing windows that are no stock phrases. Of the windows of a chain without
    such a number only single words may be missing, and nearly all must be no stock phrases, or it must be half as long again, as instructions
    recur in many items. A window extends the best chain of each start in reach; where it does not
    follow on directly, or follows on a stock phrase without being one, it also starts a chain of its own."""
    scale = spaced / max(size, 1)
    own = (1 << k) - 1
    rares = {(j, i): rare for j, i, _, rare in places}
    chains: list[tuple] = []  # last j, last i, start, covered places and those covered by no stock phrase (bits), windows that are none, windows
    best = 0
    for j, i, bits, rare in places:
        links: dict[tuple, tuple] = {}
        for c in reversed(chains):
            dj = j - c[0]
            if dj > BRIDGE:
                break
            if dj > 0 and abs((i - c[1]) - dj) <= DRIFT and (c[2] not in links or c[3].bit_count() > links[c[2]][3].bit_count()):
                links[c[2]] = c
        mine = own << j if rare else 0
        found = [(j, i, c[2], c[3] | bits << j, c[4] | mine, c[5] + rare, c[6] + 1) for c in links.values()]
        before = rares.get((j - 1, i - 1))
        if before is None or rare and not before:
            found.append((j, i, (j, i), bits << j, mine, int(rare), 1))
        chains += found
        for c in found:
            first = c[2][0]
            span = j + k - first
            words_held = round(span * scale)
            if words_held <= best or c[3].bit_count() < COVER * span:
                continue
            inside = [x for x in numbers if first <= x < j + k]
            if inside:
                good = sum(c[4] >> x & 1 for x in inside) >= SLOTS * len(inside)
            else:
                long = 2 * words_held >= 3 * min(least, spaced) and 2 * c[4].bit_count() >= span
                gaps = ~c[3] & ((1 << span) - 1) << first
                good = not gaps & gaps >> 1 and (long or c[5] >= PLAIN * c[6])
            if good:
                best = words_held
    return best


def _item_facts(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """(item, item_text, size in canonical words, spaced words, numbers, rare): places of the item's own numbers, those
    that do not stand in more than STOCK of the items, as constants do; and for each place whether the literal
    window there is no stock phrase."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        lexical = Hasher()
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [words(t) for t in texts]
            marks = [[{"at": n, "h": h, "number": True} for n, (w, h) in enumerate(zip(x, lexical(x))) if w[0].isdigit()] + [{"at": n, "h": stable_hash(" ".join(x[n : n + k])), "number": False} for n in range(len(x) - k + 1)] for x in lists]
            for m in marks:
                for x in m:
                    x["h"] -= 1 << 63
            kinds = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), ("number", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in lists], pa.int32()), pa.array([len((t or "").split()) for t in texts], pa.int32()), pa.array(marks, kinds)],
                names=["item", "item_text", "size", "spaced", "marks"],
            )

    each = items.select(item_col, text_col).mapInArrow(run, f"item {kind}, item_text string, size int, spaced int, marks array<struct<at:int,h:long,number:boolean>>")
    flat = each.select("item", "item_text", "size", "spaced", F.explode_outer("marks").alias("n")).select("item", "item_text", "size", "spaced", "n.*")
    used = flat.groupBy("h", "number").agg(F.count_distinct("item").alias("_in"))
    few = F.col("_in") <= _few(items)
    joined = flat.join(used, ["h", "number"], "left")
    return joined.groupBy("item", "item_text", "size", "spaced").agg(
        F.collect_list(F.when(few & F.col("number"), F.col("at"))).alias("numbers"), F.collect_list(F.when(few & ~F.col("number"), F.col("at"))).alias("rare")
    )


def _few(items: DataFrame):
    return F.greatest(F.lit(2), STOCK * items.agg(F.count("*")).scalar())


def _template_sides(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, k: int) -> tuple[DataFrame, list[int]]:
    """(id, item, j, place, sure) of the windows that a text shares with an item, and the
    word counts below k that items have: such an item is one window of its own size.

    Windows are shared by their template if few items hold it, else by their literal words if few hold those. A window that
    is no stock phrase, holds a number and stands near windows of stock templates is shared by its literal words in any case, and sure."""

    def counts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in b.column(0).to_pylist()], pa.int32())], names=["n"])

    short = sorted(r["n"] for r in items.select(item_text).mapInArrow(counts, "n int").where((F.col("n") > 0) & (F.col("n") < k)).distinct().collect())
    cols = [F.col("id").alias("item"), F.col("place").alias("j"), "template", "slots", "number"]
    win = _windows(items, item_col, item_text, [k], slots=True).select(*cols)
    for n in short:
        # only a window that is the whole of its item
        one = _windows(items, item_col, item_text, [n], slots=True).select(*cols)
        of = one.groupBy("item").agg(F.count("*").alias("_n"))
        win = win.unionByName(one.join(of.where("_n = 1"), "item").drop("_n"))
    few = lambda c, name: win.groupBy(c).agg((F.count_distinct("item") <= _few(items)).alias(name))
    marked = win.join(few("template", "_open"), "template").join(few("slots", "_rare"), "slots")
    # a chain of 20 words or more with fewer such windows near has DISTINCT of its words in the others, as COVER of them agree
    near = W.partitionBy("item").orderBy("j").rangeBetween(-24, 24)
    stock = F.count_if(~F.col("_open")).over(near) >= F.greatest(F.lit(1), F.least(F.lit(6), F.floor(0.3 * F.count("*").over(W.partitionBy("item")))))
    marked = marked.withColumn("number", F.col("number") & stock)
    literal = F.col("_rare") & (F.col("number") | ~F.col("_open"))
    keys = F.array_compact(F.array(F.when(F.col("_open"), F.struct("template", F.lit(False).alias("sure"))), F.when(literal, F.struct(F.col("slots").bitwiseXOR(F.lit(LITERAL)).alias("template"), F.col("number").alias("sure")))))
    win = cut_lineage(marked.select("item", "j", F.explode(keys).alias("key")).select("item", "j", "key.*"))
    return _windows(corpus, id_col, text_col, [k, *short], hash_bitset(win, "template"), both=True).join(win, "template").select("id", "item", "j", "place", "sure"), short


def leaked_items(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(id, item, words): corpus texts that hold an item, or at least `min_words` consecutive words of it.

    An item shorter than `min_words` must be held whole; one of fewer than `k` words, word for word. A quotation with no number of the item's
    own in a literal window that few items hold must have DISTINCT of the words asked for in templates or literal windows that few items hold. Null and empty texts match nothing; items
    without a name are not reported; repeated rows of the corpus count each, repeated items once; repeated names with other
    texts are one item each. Item windows and their bitset are made when this is called."""
    named = items.where(F.col(item_col).isNotNull()).select(item_col, item_text).distinct()
    hits, short = _template_sides(corpus, named, id_col, text_col, item_col, item_text, k)
    facts = _item_facts(named, item_col, item_text, k)
    id_kind, item_kind = corpus.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    # only places meet here, no texts
    per = hits.groupBy("id", "item").agg(F.sort_array(F.collect_set(F.struct("j", "place"))).alias("places"), F.bool_or("sure").alias("sure"))
    least = min_words

    # a quotation has an own number in a literal window that few items hold, or DISTINCT of its words in shared windows, so some stretch of twice the asked length has as many
    asked = F.least(F.lit(least - 0.5), F.col("spaced")) * F.col("size") / F.greatest(F.col("spaced"), F.lit(1))

    def screen(batches):
        for b in batches:
            col = b.column(2)
            ends = col.offsets.to_pylist()
            js, places = (col.values.field(n).to_pylist() for n in (0, 1))
            keep = [
                n for n, (x, y, size, words_, sure) in enumerate(zip(ends, ends[1:], *[b.column(c).to_pylist() for c in (3, 4, 5)]))
                if sure or _distinctive(js[x:y], places[x:y], min(k, size), int(2 * words_) + 2, DISTINCT * words_ - 1e-9)
            ]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["id", "item"])

    sizes = facts.groupBy("item").agg(F.min(F.struct(asked.alias("asked"), "size")).alias("s")).select("item", "s.size", "s.asked")
    sized = per.join(sizes, "item").where(F.col("sure") | (F.size("places") * k >= DISTINCT * F.col("asked") - 1e-9)).select("id", "item", "places", "size", "asked", "sure")
    likely = cut_lineage(sized.mapInArrow(screen, f"id {id_kind}, item {item_kind}"))
    texts = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    both = texts.join(likely, "id").join(facts, "item").select("id", "item", "text", "item_text", "spaced", "numbers", "rare")

    def judge(batches):
        lexical, template, seen = Hasher(), _Template(), {}
        for b in batches:
            out = []
            for text, item, spaced, numbers, rare in zip(*[b.column(n).to_pylist() for n in range(2, 7)]):
                if item not in seen:
                    if len(seen) > 2000:
                        seen.clear()
                    ws = words(item)
                    seen[item] = (ws, lexical(ws), _at(template(ws), k))
                ws, lex, at = seen[item]
                got = words(text)
                size = len(ws)
                if size < k:
                    out.append(spaced if any(got[i : i + size] == ws for i in range(len(got) - size + 1)) else 0)
                    continue
                few = set(rare)
                places = _aligned(lex, lexical(got), at, template(got), [j in few for j in range(size)], k)
                out.append(_chain(places, size, spaced, numbers, k, least))
            keep = [n for n, (w, spaced) in enumerate(zip(out, b.column(4).to_pylist())) if w >= min(least, spaced) and w > 0]
            if keep:
                ix = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array([out[n] for n in keep], pa.int32())], names=[id_col, item_col, "words"])

    return both.mapInArrow(judge, f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, words int")


def reparameterised(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, k: int = LONG_K) -> DataFrame:
    """(id, item, windows, agreeing): texts that share long template windows with an item of which
    most slots disagree, so the wording was taken over with other numbers, units or names."""
    named = items.where(F.col(item_col).isNotNull()).select(item_col, item_text).distinct()
    win = cut_lineage(_windows(named, item_col, item_text, [k], slots=True).select(F.col("id").alias("item"), "template", "slots"))
    hits = _windows(corpus, id_col, text_col, [k], hash_bitset(win, "template"), slots=True).withColumnRenamed("slots", "own").join(win, "template")
    agree = F.count_if(F.col("own") == F.col("slots"))
    return (
        hits.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.count("*").alias("windows"), agree.alias("agreeing"))
        .where(F.col("agreeing") * 2 < F.col("windows"))
    )
