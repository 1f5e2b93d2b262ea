"""Text cut off by field limits (problem 5).

Method: self-join by hashed prefix, at three levels. (1) Whole values: distinct values are range-sorted, and
one that the next begins with is a strict prefix of a longer copy elsewhere. (2) Last sentences: whole copies
of a cut text are rare, but its last, broken sentence often is a strict prefix of a longer sentence elsewhere.
All its words but the last are hashed, and joined with the same prefix of every sentence of all texts; the last
word, perhaps broken itself, must be a prefix of the word that follows there. (3) Where no other text has that
sentence, the same join runs on the last two words or the last word before it, prefixes of fixed length of the
windows that begin at every word. What has longer copies and next to none that stop there is cut. Numbers and
whole formulas are typed, so that texts that differ in figures are copies.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .canonical import Hasher, mixed
from .common import cut_lineage, hash_bitset, md5_of

STOP_SHARE = 0.08  # an ending that stops elsewhere in a greater share of its uses is complete
LEVELS = ("s", 2, 1)  # words before the last one that are hashed, tried in turn: the whole sentence's, two, one
SEEN = 3  # uses elsewhere from which a sentence's prefix decides

# Marks that exporters put at a cut.
MARKS = re.compile(r"(?:\s*(?:\.{3,}|…|�+|\[[^\[\]]{0,40}(?:clos|trunc|cut|omit|limit|continu|abort|more)[^\[\]]{0,40}\]|<[^<>]{0,20}(?:trunc|cut|more)[^<>]{0,20}>|\((?:truncated|cut off|continued)\)))+\s*$", re.I)
_UNIT = re.compile(r"(?<=[.!?。！？])[\"'”’)\]*]*\s+(?=[^\sa-z,;:)\]])|[\r\n]+|(?<=[。！？])")
_NUMBER = re.compile(r"\$?\d[\d.]*\s*(?:\\times|[x×*])\s*10\^\{?-?\d+\}?\$?|\d+(?:[.,]\d+)*(?:e[+-]?\d+)?")
_FORMULA = re.compile(r"\$\$[^$]+\$\$|\$[^$\n]+\$|\\\((?:(?!\\\().)+?\\\)|\\\[(?:(?!\\\[).)+?\\\]", re.S)
# a formula in plain letters: a short name, a relation, and short names, numbers and signs
_NAME = r"(?:[A-Za-z]|alpha|beta|gamma|delta|epsilon|eta|theta|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|phi|chi|psi|omega)(?:_\w+)?(?:\([a-z]+\))?"
_PLAIN = re.compile(rf"(?<![\w\\]){_NAME}(?: [=≈~] (?:(?:{_NAME}|0)(?:\^0)?(?:(?: [-+*/] | )(?:{_NAME}|0)(?:\^0)?)*))+(?![\w(^])")
_VALUE = re.compile(r"(?:\S{1,8} [=≈:] )?[(+-]?0(?: \S+){0,2}$|§$")
_THINK = re.compile(r"</?think>", re.I)
_CLOSERS = re.compile(r"[.!?,;:。！？，；：][\"'”’)\]*»_`]*$")
_STOPPED = r"[.!?。！？][\"'”’)\]*»_`]*$"
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("i.e.", "e.g.", "cf.", "approx.", "ca.")


def units(text: str) -> list[list[str]]:
    """Sentences and lines of a text, as words with typed numbers and formulas."""
    flat = _NUMBER.sub("0", _THINK.sub("\n", text))
    if "$" in flat or "\\" in flat:
        flat = _FORMULA.sub("§", flat)
    if " = " in flat or " ≈ " in flat or " ~ " in flat:
        flat = _PLAIN.sub("§", flat)
    return [u for u in (x.split() for x in _UNIT.split(flat)) if u]


def bare(word: str) -> str:
    """Word without the punctuation that closes it; a word of nothing else stays."""
    return _CLOSERS.sub("", word) or word


def unbalanced(text: str) -> bool:
    """Whether the last formula or group of a text is still open."""
    last = re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n\n", text)[-1]
    bare_ = last.replace("\\$", "").replace("\\{", "").replace("\\}", "")
    if bare_.replace("$$", "").count("$") % 2 or bare_.count("$$") % 2:
        return True
    if bare_.count("\\(") > bare_.count("\\)") or bare_.count("\\[") > bare_.count("\\]"):
        return True
    return bare_.count("{") > bare_.count("}") or bool(re.search(r"\\[a-zA-Z]*$", bare_) and not re.search(r"\\[a-zA-Z]{2,}$", bare_))


def ending(text: str | None) -> tuple | None:
    """(marked, open formula, last sentence) of a text; None for blank ones and for a lone word or value, which
    is short but whole."""
    if not text or not text.strip():
        return None
    rest = MARKS.sub("", text)
    marked = rest != text
    if not rest.strip():
        return None
    got = units(rest)
    if not got:
        return None
    if len(got) == 1 and not marked and (len(got[0]) == 1 or _VALUE.match(" ".join(got[0]))):
        return None
    return marked, unbalanced(rest), got[-1]


class Prefixes:
    """Hashes of what stands before each word of sentences: of all of the sentence, of two words, of one."""

    # an odd multiplier and its inverse modulo 2**64, so that hashes of runs come from running sums
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.hasher = Hasher()

    def __call__(self, sentences: list[list[str]]):
        """(flat words, sentence of each, whether it ends its sentence, {level: hashes}) as lists and numpy arrays."""
        import numpy as np

        size = np.array([len(u) for u in sentences], np.int64)
        words = [w for u in sentences for w in u]
        if not words:
            return words, np.empty(0, np.int64), np.empty(0, bool), {}
        h = np.array(self.hasher(words), np.uint64)
        n = len(h)
        owner = np.repeat(np.arange(len(sentences)), size)
        starts = (np.cumsum(size) - size)[owner]
        at = np.arange(n)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(n, self.BASE, np.uint64))
            inverse = np.multiply.accumulate(np.full(n, self.INVERSE, np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power, dtype=np.uint64)])
            place = (at - starts).astype(np.uint64)
            whole = mixed((sums[:-1] - sums[starts]) * inverse[starts] + place * np.uint64(0x100000001B3) + np.uint64(11))
            before = np.where(at > starts, np.concatenate([[np.uint64(0)], h[:-1]]), np.uint64(1))
            first = np.where(at > starts + 1, np.concatenate([np.zeros(min(2, n), np.uint64), h[:-2]])[:n], np.uint64(1))
            one = mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
            two = mixed(first * np.uint64(0x165667B19E3779F9) + before * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(3))
        last = np.zeros(n, bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        return words, owner, last, {"s": whole, 2: two, 1: one}


def tails(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, marked, open, stopped, ps, p2, p1, word) of each text's ending: the hashed prefixes and the last
    word. Blank texts have no row."""
    kind = texts.schema[id_col].dataType.simpleString()
    stopped, levels = re.compile(_STOPPED), LEVELS

    def take(batches):
        import numpy as np

        prefixes = Prefixes()
        for b in batches:
            got = [ending(t) for t in b.column(1).to_pylist()]
            keep = [i for i, g in enumerate(got) if g]
            if keep:
                g = [got[i] for i in keep]
                words, _, last, by = prefixes([x[2] for x in g])
                at = np.flatnonzero(last)
                ends = [words[i] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array([x[0] for x in g]), pa.array([x[1] for x in g]), pa.array([bool(stopped.search(w)) and w not in ABBREVIATIONS for w in ends]),
                     *[pa.array(by[n][at].view(np.int64)) for n in levels], pa.array([bare(w) for w in ends])],
                    names=["id", "marked", "open", "stopped", *[f"p{n}" for n in levels], "word"],
                )

    return texts.select(id_col, text_col).mapInArrow(take, f"id {kind}, marked boolean, open boolean, stopped boolean, ps long, p2 long, p1 long, word string")


def continuations(texts: DataFrame, text_col: str, endings: DataFrame) -> DataFrame:
    """(level, prefix, word, goes_on, stops) over distinct texts, for the hashed prefixes that some ending has:
    how often a word after its prefix is followed by another of the sentence, or ends it.

    A bitset of fixed size tells which prefixes endings have (it takes a job when this is called); its false
    hits only let windows through. Counts are added up in each task before the exchange."""
    import numpy as np

    keys = endings.select(F.explode(F.array(*[F.col(f"p{n}") for n in LEVELS])).alias("k"))
    bits, found = hash_bitset(keys, "k")
    sent = texts.sparkSession.sparkContext.broadcast(found)
    distinct = texts.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    levels = LEVELS

    def count(batches):
        prefixes, on, stop = Prefixes(), Counter(), Counter()

        def send():
            keys = list(on.keys() | stop.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys]), pa.array([on[k] for k in keys], pa.int64()), pa.array([stop[k] for k in keys], pa.int64())],
                names=["level", "prefix", "word", "goes_on", "stops"],
            )

        for b in batches:
            words, _, last, by = prefixes([u for t in b.column(0).to_pylist() for u in units(t)])
            for n, level in enumerate(levels):
                if not len(last):
                    continue
                pos = (by[level] >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero((sent.value[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1)
                for i, p, end in zip(hit.tolist(), by[level][hit].view(np.int64).tolist(), last[hit].tolist()):
                    (stop if end else on)[(n, p, bare(words[i]))] += 1
            if len(on) + len(stop) > 300_000:
                yield send()
                on.clear(), stop.clear()
        if on or stop:
            yield send()

    each = distinct.mapInArrow(count, "level int, prefix long, word string, goes_on long, stops long")
    return each.groupBy("level", "prefix", "word").agg(F.sum("goes_on").alias("goes_on"), F.sum("stops").alias("stops"))


def ending_evidence(endings: DataFrame, longer: DataFrame) -> DataFrame:
    """`endings` with, for each level, how often the ending goes on elsewhere (ons, on2, on1: in longer words
    too) and stops there (stops, stop2, stop1). Distinct endings are joined once; a prefix that very many
    words follow meets each ending with the words of its own first character only."""
    per = [F.struct(F.lit(i).alias("level"), F.col(f"p{n}").alias("prefix")) for i, n in enumerate(LEVELS)]
    asked = endings.select("word", F.explode(F.array(*per)).alias("l")).select("word", "l.level", "l.prefix").distinct()
    a = asked.select(F.col("level").alias("_l"), F.col("prefix").alias("_p"), F.col("word").alias("_w"), F.substring("word", 1, 1).alias("_h"))
    b = longer.withColumn("_c", F.substring("word", 1, 1))
    j = a.join(b, (F.col("_l") == F.col("level")) & (F.col("_p") == F.col("prefix")) & (F.col("_h") == F.col("_c")) & F.col("word").startswith(F.col("_w")))
    more = F.col("word") != F.col("_w")
    s = j.groupBy("_l", "_p", "_w").agg(F.sum(F.when(more, F.col("goes_on") + F.col("stops")).otherwise(F.col("goes_on"))).alias("on"), F.sum(F.when(more, 0).otherwise(F.col("stops"))).alias("stop"))
    out, zero = endings, F.lit(0)
    for i, n in enumerate(LEVELS):
        own = s.where(F.col("_l") == i).select(F.col("_p").alias("_q"), F.col("_w").alias("_v"), F.col("on").alias("_on"), F.col("stop").alias("_stop"))
        out = out.join(own, (F.col(f"p{n}") == F.col("_q")) & (F.col("word") == F.col("_v")), "left").withColumns({f"on{n}": F.coalesce("_on", zero), f"stop{n}": F.coalesce("_stop", zero)}).drop("_q", "_v", "_on", "_stop")
    return out


def strict_prefixes(texts: DataFrame, text_col: str) -> DataFrame:
    """(digest): md5 of each value that is a strict prefix of a longer value elsewhere.

    Distinct values are range-sorted over all tasks. In sorted order the value after a strict prefix of any
    other begins with it, so each task compares neighbours and sends its first and last value; those of
    neighbouring tasks are compared afterwards. No group of values meets in one task, however long their
    common beginning. The empty text is no value."""
    values = texts.select(F.col(text_col).alias("t")).where(F.length(text_col) > 0).distinct()

    def neighbours(batches):
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), None, None
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                if held is not None and t.startswith(held):
                    found.append(held)
                first, held = t if first is None else first, t
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array(found), pa.nulls(len(found), pa.string())], names=["part", "t", "head"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held]), pa.array([first])], names=["part", "t", "head"])

    ordered = values.repartitionByRange(F.col("t")).sortWithinPartitions("t").mapInArrow(neighbours, "part int, t string, head string")
    # kept, as a second run might cut the ranges elsewhere; it holds the hits and two values a task
    ordered = cut_lineage(ordered)
    edges = ordered.where(F.col("head").isNotNull()).withColumn("next", F.lead("head").over(W.partitionBy(F.lit(0)).orderBy("part")))
    hits = ordered.where(F.col("head").isNull()).select("t").unionByName(edges.where(F.col("next").startswith(F.col("t"))).select("t"))
    return hits.select(md5_of(F.col("t")).alias("digest"))


def own_counts(text: str, sentence: list[str]) -> list[tuple[int, int]]:
    """What `text` itself adds to the evidence of an ending, per level: (goes on, stops)."""
    word, out = bare(sentence[-1]), [[0, 0] for _ in LEVELS]
    for u in units(text):
        for i, w in enumerate(u):
            if w.startswith(word):
                stops = bare(w) == word and i == len(u) - 1
                for k, n in enumerate(LEVELS):
                    # at the beginning of a sentence the fewer words before it are the whole prefix
                    if (u[:i] == sentence[:-1]) if n == "s" or i < n or len(sentence) <= n else (u[i - n : i] == sentence[-1 - n : -1]):
                        out[k][stops] += 1
    return [tuple(x) for x in out]


def is_cut(prefix: Column, raw_longer: Column) -> Column:
    """Verdict over the columns of ending_evidence. A strict prefix of a longer text that doesn't stop is
    cut, whatever its ending does elsewhere. A sentence seen SEEN times elsewhere is judged by itself, else by
    its last words, and what is new throughout by a raw length above the text's."""
    own = F.lit(1)  # the text itself stops there
    verdict = F.lit(None).cast("boolean")
    for n in reversed(LEVELS):
        on, stop = F.col(f"on{n}"), F.greatest(F.col(f"stop{n}") - own, F.lit(0))
        verdict = F.when(on + stop >= (SEEN if n == "s" else 1), stop < STOP_SHARE * (on + stop)).otherwise(verdict)
    goes_on = prefix | F.coalesce(verdict, raw_longer) | F.col("marked")
    return F.coalesce(F.col("open") | (goes_on & ~F.col("stopped")), F.lit(False))


def cut_of(e: dict) -> bool:
    """is_cut for one row of evidence on the driver."""
    verdict = bool(e["raw_longer"])
    for n in reversed(LEVELS):
        on, stop = e[f"on{n}"], max(0, e[f"stop{n}"] - 1)
        if on + stop >= (SEEN if n == "s" else 1):
            verdict = stop < STOP_SHARE * (on + stop)
    return bool(e["open"] or (e["prefix_of_longer"] or verdict or e["marked"]) and not e["stopped"])


def find_truncated(texts: DataFrame, id_col: str, text_col: str, raw_len_col: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """(id, cut, marked, open, stopped, prefix_of_longer, raw_longer, and the evidence) for each text with an ending.

    `more` (one text column) only adds texts to compare with. Null, empty and blank texts, lone words or values,
    and texts of nothing but a mark, have no row; a raw length is a witness only where an ending is new. Ids must
    be unique and not null. Endings, their bitset, their continuations and value prefixes are made when this is called."""
    endings = cut_lineage(tails(texts, id_col, text_col))
    all_texts = texts.select(text_col) if more is None else texts.select(text_col).unionByName(more.toDF(text_col))
    longer = cut_lineage(continuations(all_texts, text_col, endings))
    return judge(ending_evidence(endings, longer), texts, id_col, text_col, raw_len_col, strict_prefixes(all_texts, text_col))


def judge(evidence: DataFrame, texts: DataFrame, id_col: str, text_col: str, raw_len_col: str | None, prefixes: DataFrame) -> DataFrame:
    """Adds prefix_of_longer, raw_longer and cut to the evidence of `texts`."""
    raw = F.coalesce(F.col(raw_len_col) > F.length(text_col), F.lit(False)) if raw_len_col else F.lit(False)
    own = texts.select(F.col(id_col).alias("_id"), raw.alias("raw_longer"), md5_of(F.col(text_col)).alias("_d"))
    pre = prefixes.withColumn("_pre", F.lit(True))
    out = evidence.join(own, F.col("id") == F.col("_id")).join(pre, F.col("_d") == F.col("digest"), "left").withColumn("prefix_of_longer", F.coalesce("_pre", F.lit(False)))
    names = ["marked", "open", "stopped", "prefix_of_longer", "raw_longer", "word", *[f"{k}{n}" for n in LEVELS for k in ("on", "stop")]]
    return out.select(F.col("id").alias(id_col), is_cut(F.col("prefix_of_longer"), F.col("raw_longer")).alias("cut"), *names)


def truncation_rates(rows: DataFrame, found: DataFrame, id_col: str, by: str) -> DataFrame:
    """Rows, cut rows and their rate per value of `by` (null is a value)."""
    hit = found.where("cut").select(F.col(id_col).alias("_i")).distinct()
    j = rows.select(id_col, by).join(hit, F.col(id_col) == F.col("_i"), "left")
    return j.groupBy(by).agg(F.count("*").alias("total"), F.count("_i").alias("cut")).withColumn("rate", F.col("cut") / F.col("total"))
