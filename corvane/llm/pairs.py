"""Broken prompt and response pairs (problem 1).

Method: a multi-label linear classifier over hashed n-grams of the response's sentences and over features of
the pair. It is trained on pairs of the table itself, and on synthetically emptied, refused, copied,
swapped and truncated ones, with a threshold for each label calibrated on held-out pairs of both kinds.
The training sample is bounded (SAMPLE pairs); every row is scored, over its whole texts.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import Hasher, window_hashes, words
from .common import cut_lineage
from .truncation import LEVELS, STOP_SHARE, continuations, cut_of, ending, ending_evidence, judge, own_counts, strict_prefixes, tails

LABELS = ("empty", "refusal", "copied", "other_language", "truncated")
SAMPLE = 4000  # pairs of the table that training may use
HASHED = 1 << 13
ROUNDS = 120  # of training
DOUBT = 0.1  # weight of the table's pairs in the first fit

# Words that mark a language (function words and verb forms of plain prose).
LANGUAGE_WORDS = {
    "en": "the a an and of is it that with for at by from as on this be are which to in we so has then its not into when will i you he she they what can could would have had was were but if or my your me do does there than more most must should please".split(),
    "de": "der die das und ist von mit für bei aus als auf nicht sich wir wird wenn dass im den dem ein eine einer zu nach um hat bis noch denn also daraus dabei".split(),
    "fr": "l d qu été pendant le la les a à et est de du des une un que qui dans pour sur avec au aux par nous on ne pas ce cette plus donc puis jusqu tant".split(),
    "es": "el la los las a y es de del una un que en por con para se al no lo su como más sin cuando hasta entonces luego donde".split(),
    "it": "l dell all stata stato il lo la gli le a e è di del della una un che in per con si al non come più quando fino dal nel dei delle alla poi finché".split(),
    "pt": "o a os as e é de do da dos uma um que em por com para se ao não no na como mais quando até então depois enquanto pelo".split(),
    "nl": "de het een en is van met voor bij uit als op niet we wordt wanneer dat te naar om heeft tot nog want dus er zijn".split(),
}
# Ways to decline, by kind: beginnings, which take an action and its object, and whole sentences.
REFUSALS = {
    "unable": (
        ["I can't", "I cannot", "I am not able to", "I'm unable to", "I'm afraid I can't", "it isn't possible for me to", "I do not feel able to", "I am in no position to"],
        ["I can't help with this task.", "I cannot assist with that request.", "I'm unable to answer this question.", "it isn't possible for me to work on this question.", "I am not able to solve problems of this kind.", "I cannot view images, so I will not attempt an answer.", "This falls under material I am unable to discuss.", "This is beyond what I am able to do."],
    ),
    "unwilling": (
        ["I won't", "I will not", "I am not going to", "I must decline to", "I have to decline to", "I refuse to", "I choose not to"],
        ["I won't be answering this one.", "I have to decline to give an answer.", "I must decline this request.", "I will refrain from solving it.", "I decline."],
    ),
    "not allowed": (
        ["I am not allowed to", "I'm not permitted to", "my guidelines don't let me", "the rules I follow keep me from trying to"],
        ["I am not allowed to provide a solution here.", "Answering this is not something I'm permitted to do.", "My guidelines keep me from working through exam material.", "It would be against my rules to reply."],
    ),
    "impersonal": (
        ["nobody here can", "this assistant does not"],
        ["this request is outside what I can do.", "no solution can be provided by me.", "I must leave this question unanswered.", "No answer from me on this one, sorry.", "The request was declined.", "There will be no answer to this."],
    ),
    "preference": (
        ["I'd rather not", "I would prefer not to", "I prefer not to", "I do not wish to", "I'm not comfortable trying to"],
        ["Not comfortable answering that.", "I prefer not to give a reply.", "I don't have enough confidence to reply and would rather pass.", "I'd rather not answer this.", "I will pass on this one."],
    ),
}
ACTIONS = ["help with", "assist with", "answer", "solve", "work on", "respond to", "reply to", "give an answer to", "provide a solution to", "work through", "discuss", "attempt"]
OBJECTS = ["this", "that", "it", "this question", "this request", "this task", "this problem", "that request", "problems of this kind", "this one", "exam material"]
OPENINGS = ["", "", "", "As a language model,", "I must be honest:", "Unfortunately,", "Apologies,", "Regrettably", "Thanks for sharing this, but", "I appreciate the question, however", "I'm sorry, but", "Sorry,"]
CLOSINGS = ["", "", "", "Please consult a teacher.", "Let me know if you have another topic.", "Feel free to ask me about something different.", "Perhaps a textbook would serve you better.", "Is there anything else you would like to talk about?", "Please rephrase the request."]
# Stand-ins for a missing answer.
STAND_INS = frozenset("n/a na none null nil nan - -- ? ... … tbd todo unknown undefined missing empty answer answer: the result is".split()) | {""}

_WORD = re.compile(r"[^\W\d_]+")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\[a-zA-Z]+", re.S)
_THOUGHT = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
_QUOTED = re.compile(r"\"[^\"\n]{0,300}\"|“[^”\n]{0,300}”|«[^»\n]{0,300}»")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SCRIPTS = re.compile("[^\x00-\u02ff]")
_WEIGHT: dict[str, list] = {}


def language(text: str | None) -> str | None:
    """Main language of the prose of a text; None where too little prose tells."""
    if not text:
        return None
    prose = _QUOTED.sub(" ", _MATH.sub(" ", text))
    letters = Counter()
    for c in () if prose.isascii() else _SCRIPTS.findall(prose):
        if c.isalpha():
            letters["zh" if "\u4e00" <= c <= "\u9fff" else "ja" if "\u3040" <= c <= "\u30ff" else "ko" if "\uac00" <= c <= "\ud7af" else "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "arabic" if "\u0600" <= c <= "\u06ff" else "other"] += 1
    if letters:
        latin = sum(map(len, _WORD.findall(prose))) - sum(letters.values())
        script, n = letters.most_common(1)[0]
        if n * (3 if script in ("zh", "ja", "ko") else 1) > latin and n >= 4:
            return script
    if not _WEIGHT:
        owners = Counter(w for ws in LANGUAGE_WORDS.values() for w in set(ws))
        for lang, ws in LANGUAGE_WORDS.items():
            for w in set(ws):
                _WEIGHT.setdefault(w, []).append((lang, 1 / owners[w]))
    score = Counter()
    for w in _WORD.findall(prose.lower()):
        for lang, x in _WEIGHT.get(w, ()):
            score[lang] += x
    top = score.most_common(2)
    if not top or top[0][1] < 1.5 or len(top) > 1 and top[0][1] < 1.3 * top[1][1]:
        return None
    return top[0][0]


def core(text: str | None) -> str:
    """What a response or gold says: without thoughts, hidden characters, and the wrapping of an answer."""
    if not text:
        return ""
    t = _HIDDEN.sub("", _THOUGHT.sub(" ", text))
    t = re.sub(r"\\boxed\s*\{([^{}]*)\}", r" \1 ", t)
    t = re.sub(r"\\(?:text|mathrm)\s*\{([^{}]*)\}", r" \1 ", t)
    t = re.sub(r"^\W*(?:final\s+)?answer\s*:?\W*$", " ", t.strip(), flags=re.I)
    t = re.sub(r"[$*`{}\[\]\"']+|\\[,;!()\[\]]", " ", t).strip()
    return "" if t.lower() in STAND_INS or not re.search(r"\w", t) else t


def copied_share(text: str | None, question: str | None, k: int = 3) -> float:
    """Share of the words of `text` that stand in k-word runs of `question`; for fewer than 2k words, 1 if
    they are the whole question and 0 otherwise."""
    b = words(question)
    return _share(words(text), b, set(zip(*[b[i:] for i in range(k)])), k)


def _share(a: list[str], b: list[str], runs: set, k: int = 3) -> float:
    if a and a == b:
        return 1.0
    if len(a) < 2 * k or len(b) < k:
        return 0.0
    hit = bytearray(len(a))
    for i, g in enumerate(zip(*[a[i:] for i in range(k)])):
        if g in runs:
            hit[i : i + k] = b"\x01" * k
    return sum(hit) / len(a)


def _mostly(share: float) -> float:
    """0 up to three quarters, 1 from 95 %."""
    return min(1.0, max(0.0, share - 0.75) * 5)


DENSE = (
    "bias", "empty_response", "empty_gold", "copied_response", "copied_gold", "language_differs", "short",
    "cut", "open", "marked", "stopped", *[f"{k}{n}" for n in LEVELS for k in ("goes", "stops")],
)
# the features that a label may weigh: planted defects exclude each other and real ones do not, so a label must not
# learn from the traces of another
OWN = {"empty": ("empty_response", "empty_gold"), "refusal": ("short",), "copied": ("copied_response", "copied_gold"), "other_language": ("language_differs",), "truncated": DENSE[7:]}
WORDED = ("refusal",)  # labels that show in the wording alone; n-grams would tell the sample's topics for the others
NO_ENDING = (False, False, False, True, *[0.0, 0.0] * len(LEVELS))


def ending_features(e) -> tuple:
    """Features of a row of find_truncated, a mapping; the text's own stop is taken off."""
    if e is None or e["cut"] is None:
        return NO_ENDING
    out = [e["cut"], e["open"], e["marked"] and not e["stopped"], e["stopped"]]
    for n in LEVELS:
        on, stop = e[f"on{n}"], max(0, e[f"stop{n}"] - 1)
        goes = on + stop > 0 and stop < STOP_SHARE * (on + stop) and not e["stopped"]
        out += [float(goes), float(on + stop > 0 and not goes)]
    return tuple(out)


class Questions:
    """Language and word runs of questions, remembered up to a bound."""

    def __init__(self, k: int = 3, most: int = 10_000):
        self.k, self.most, self.seen = k, most, {}

    def __call__(self, question):
        got = self.seen.get(question)
        if got is None:
            if len(self.seen) > self.most:
                self.seen.clear()
            ws = words(question)
            got = self.seen[question] = (language(question), ws, set(zip(*[ws[i:] for i in range(self.k)])))
        return got


def dense_features(question, response, gold, ending: tuple, known: Questions) -> list[float]:
    golds = [x for x in (gold or []) if x is not None]
    r = core(response)
    rest = _THOUGHT.sub(" ", response or "")
    q_lang, q_words, q_runs = known(question)
    r_lang = language(rest)
    answered = bool(r)
    return [
        1.0, float(not answered), float(not any(core(x) for x in golds)),
        _mostly(_share(words(rest), q_words, q_runs)), _mostly(_share(words(" ".join(golds)), q_words, q_runs)),
        float(answered and q_lang is not None and r_lang is not None and q_lang != r_lang), float(len(r) < 40), *map(float, ending),
    ]


_GRAM_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d[\d.]*")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")


def sentences(response) -> list[list[str]]:
    """All sentences of a response as words with typed numbers, without its thoughts."""
    text = _THOUGHT.sub(" ", response or "").lower().replace("’", "'")
    got = ([("#" if w[0].isdigit() else w) for w in _GRAM_WORD.findall(x)] for x in _SENTENCE.split(text))
    return [x for x in got if x]


class Grams:
    """Hashed 1- to 3-grams of many sentences: `index` of each gram, `starts` of each sentence's, `pair` of each sentence."""

    def __init__(self, per_pair: list[list[list[str]]], hasher: Hasher):
        import numpy as np

        flat = [x for pair in per_pair for x in pair]
        self.pair = np.repeat(np.arange(len(per_pair)), [len(p) for p in per_pair]).astype(np.int64)
        size = np.array([len(x) for x in flat], np.int64)
        h = np.array(hasher([w for x in flat for w in x]), np.uint64)
        owner = np.repeat(np.arange(len(flat)), size)
        ends = np.cumsum(size)[owner] if len(flat) else size
        at, parts, owners = np.arange(len(h)), [], []
        for n in (1, 2, 3):
            ok = at + n <= ends
            parts.append((window_hashes(h, n)[ok[: max(0, len(h) - n + 1)]] % np.uint64(HASHED)).astype(np.int64))
            owners.append(owner[ok])
        index, by = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(by, kind="stable")
        self.index, by = index[order], by[order]
        self.starts = np.flatnonzero(np.diff(by, prepend=-1))
        self.sentence = by
        self.scale = 1 / np.sqrt(np.maximum(np.diff(np.append(self.starts, len(by))), 1))


def decline(rng: random.Random, kinds: tuple = tuple(REFUSALS)) -> str:
    """One refusal of one of the kinds: composed, or a whole sentence."""
    starts, whole = REFUSALS[rng.choice(kinds)]
    if rng.random() < 0.5:
        return rng.choice(whole)
    return f"{rng.choice(starts)} {rng.choice(ACTIONS)} {rng.choice(OBJECTS)}."


def broken_copies(rows: list[dict], seed: int) -> list[tuple]:
    """Synthetic defective pairs made of sample rows: (label, question, response, gold, response it was made of)."""
    rng = random.Random(seed)
    whole = [r for r in rows if core(r["response"]) and r["question"]]
    by_lang: dict = {}
    for r in whole:
        if len(r["response"]) > 80:
            by_lang.setdefault(language(r["response"]), []).append(r)
    langs = [x for x in by_lang if x]
    out = []
    for r in whole:
        q, t, g = r["question"], r["response"], r["gold"]
        kind = rng.random()
        if kind < 0.12:
            hollow = rng.choice(["", "  ", "\n", "N/A", "null", "-", "...", "Answer:", "\\boxed{}", "$$ $$", "\u200b", "<think>" + t + "</think>", "<think>" + t])
            out.append(("empty", q, hollow, g, t) if rng.random() < 0.6 else ("empty", q, t, rng.choice([[], None, [""], ["  "], ["N/A"], [None], ["", ""]]), None))
        elif kind < 0.4:
            start = re.split(r"(?<=[.!?])\s+", t)[: rng.choice([0, 0, 1, 2])]
            say = decline(rng)
            lead = rng.choice(OPENINGS)
            parts = [*start, (lead + " " + say).strip(), rng.choice(CLOSINGS)]
            out.append(("refusal", q, " ".join(p for p in parts if p), g, t))
        elif kind < 0.55:
            twin = q.lower() if rng.random() < 0.3 else q
            twin = twin[: max(60, int(len(twin) * rng.uniform(0.7, 1)))] if rng.random() < 0.3 else twin
            out.append(("copied", q, twin, g, None) if rng.random() < 0.7 else ("copied", q, t, [twin], None))
        elif kind < 0.7 and len(langs) > 1:
            own = language(q)
            other = [x for x in langs if x != own]
            if own and other:
                out.append(("other_language", q, rng.choice(by_lang[rng.choice(other)])["response"], g, None))
        elif len(t) > 60:
            at = rng.randrange(20, len(t) - 8)
            while t[at - 1] in " .!?\n" and at > 10:
                at -= 1
            out.append(("truncated", q, t[:at] + rng.choice(["", "", "", "...", " [truncated]", "\ufffd"]), g, t))
    return out


class LinearModel:
    """Logistic regression over dense and hashed features, one column a label. A pair has the n-gram score of
    that of its sentences which scores highest, so a sentence that declines counts wherever it stands."""

    def __init__(self, dense=None, hashed=None, threshold=None):
        self.dense, self.hashed, self.threshold = dense, hashed, threshold

    def _best(self, grams: Grams, n: int):
        """(score of each sentence and label, highest of each pair and label)."""
        import numpy as np

        best = np.zeros((n, self.hashed.shape[1]))
        if not len(grams.starts):
            return np.zeros((0, self.hashed.shape[1])), best
        z = np.add.reduceat(self.hashed[grams.index], grams.starts, axis=0) * grams.scale[:, None]
        first = np.flatnonzero(np.diff(grams.pair, prepend=-1))
        best[grams.pair[first]] = np.maximum.reduceat(z, first, axis=0)
        return z, best

    def scores(self, dense, grams: Grams):
        import numpy as np

        x = np.asarray(dense, np.float64)
        return 1 / (1 + np.exp(-np.clip(x @ self.dense + self._best(grams, len(x))[1], -30, 30)))

    def fit(self, dense, grams: Grams, y, weight, rounds: int = ROUNDS, rate: float = 0.3):
        """Adam on the weighted log loss. Each label has the features of OWN, and those of WORDED the n-grams too."""
        import numpy as np

        x = np.asarray(dense, np.float64)
        k = y.shape[1]
        mask = np.array([[float(name == "bias" or name in OWN[label]) for label in LABELS] for name in DENSE])
        params = [np.zeros((x.shape[1], k)), np.zeros((HASHED, k))]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        for t in range(1, rounds + 1):
            self.dense, self.hashed = params
            z, best = self._best(grams, len(x))
            err = (1 / (1 + np.exp(-np.clip(x @ self.dense + best, -30, 30))) - y) * weight / weight.sum(axis=0)
            each = np.where(z >= best[grams.pair], err[grams.pair], 0.0) * grams.scale[:, None] if len(z) else z
            g = [np.bincount(grams.index, weights=each[grams.sentence, j], minlength=HASHED) if len(z) and label in WORDED else np.zeros(HASHED) for j, label in enumerate(LABELS)]
            grads = [(x.T @ err + 1e-5 * params[0]) * mask, np.stack(g, 1) + 3e-5 * params[1]]
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        self.dense, self.hashed = params
        return self

    def calibrate(self, s, y, weight):
        """From the scores `s` of held-out pairs, per label the threshold of best F1; in the middle of the range of equally good ones. Also
        keeps held-out (precision, recall) per label in `held_out`."""
        import numpy as np

        self.threshold, self.held_out = [], {}
        grid = np.linspace(0.05, 0.95, 91)
        for j, label in enumerate(LABELS):
            w, yes = weight[:, j], y[:, j] > 0
            f = []
            for t in grid:
                p = s[:, j] >= t
                f.append(2 * (w * (p & yes)).sum() / max(1e-9, (w * p).sum() + (w * yes).sum()))
            best = np.flatnonzero(np.array(f) >= max(f) - 1e-9)
            self.threshold.append(float(grid[best].mean()))
            p = s[:, j] >= self.threshold[-1]
            tp = (w * (p & yes)).sum()
            self.held_out[label] = (float(tp / max(1e-9, (w * p).sum())), float(tp / max(1e-9, (w * yes).sum())))
        return self


def train(rows: list[dict], broken: list[tuple], endings: list, seed: int = 42) -> LinearModel:
    """Fits on sample rows (question, response, gold) and their broken copies. `endings`: what find_truncated says of
    each of both, or None.

    All pairs count, in training and in calibration: those of the table as free of the defects that were not
    planted in them, though some have one. Only for refusals, which show in their wording alone, pairs of the table that a
    first fit takes for one are left out."""
    import numpy as np

    made = [("", r["question"], r["response"], r["gold"], None) for r in rows] + broken
    k = len(LABELS)
    if not made:
        return LinearModel(np.zeros((len(DENSE), k)), np.zeros((HASHED, k)), [2.0] * k)
    ends = [ending_features(e) for e in endings]
    known, rng, y = Questions(), random.Random(seed), np.zeros((len(made), k))
    dense, texts = [], []
    for i, (label, q, t, g, _) in enumerate(made):
        dense.append(dense_features(q, t, g, ends[i], known))
        got = sentences(t)
        # of long texts the ends and some others; of refusals all, as any may be the one that declines
        texts.append(got if len(got) <= 4 or label == "refusal" else [got[0], *rng.sample(got[1:-1], 2), got[-1]])
        if label:
            y[i, LABELS.index(label)] = 1
    dense, hasher = np.array(dense), Hasher()
    real = np.arange(len(made)) < len(rows)
    fold = np.arange(len(made)) % 4 == 3
    block = lambda where: Grams([texts[i] for i in np.flatnonzero(where)], hasher)
    weight, refusal = np.ones(y.shape), LABELS.index("refusal")
    trained = block(~fold)
    # a response of the table may decline: those that repeat weigh as one, all little in the first fit, and what that fit
    # takes for a refusal is left out, also as part of a pair that is broken otherwise
    plain = y[:, refusal] == 0
    copies = Counter(m[2] for m, p in zip(made, plain) if p and core(m[2]))
    weight[:, refusal] = [1 / copies.get(m[2], 1) if p else 1.0 for m, p in zip(made, plain)]
    first = LinearModel().fit(dense[~fold], trained, y[~fold], (weight * np.where(real[:, None], DOUBT, 1.0))[~fold], rounds=ROUNDS // 2)
    declines = _all_scores(first, dense[real], [m[2] for m in made[: len(rows)]], hasher)[:, refusal] >= 0.3
    taken = {m[2] for m, d in zip(made, declines) if d}
    weight[[bool(p and (m[2] in taken or m[4] in taken)) for m, p in zip(made, plain)], refusal] = 1e-9
    model = LinearModel().fit(dense[~fold], trained, y[~fold], weight[~fold])
    scores = _all_scores(model, dense[fold], [made[i][2] for i in np.flatnonzero(fold)], hasher)
    return model.calibrate(scores, y[fold], weight[fold])


def _all_scores(model: LinearModel, dense, texts: list, hasher: Hasher, step: int = 500):
    """Scores over all sentences of the texts, a few hundred texts at a time."""
    import numpy as np

    got = [model.scores(dense[i : i + step], Grams([sentences(t) for t in texts[i : i + step]], hasher)) for i in range(0, len(texts), step)]
    return np.concatenate(got) if got else np.zeros((0, len(LABELS)))


EVIDENCE = ("cut", "open", "marked", "stopped", "prefix_of_longer", "raw_longer", *[f"{k}{n}" for n in LEVELS for k in ("on", "stop")])


def find_defects(pairs: DataFrame, id_col: str = "id", sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(id, defect, score): one row a defect. `pairs`: id, question, response, gold (array), and raw_len.

    A null question (an item that is not known) tells neither copies nor languages. Null, empty and blank
    responses and golds are empty; a null in a gold list is no answer. Repeated rows count each; ids must be
    unique, and a row with a null id is not told to be truncated. An empty table has no defects; other columns are ignored.
    The classifier is fitted when this is called, on at most `sample` pairs in hash order; every row is scored."""
    return defect_scores(pairs, id_col, sample, seed)[1]


def defect_scores(pairs: DataFrame, id_col: str = "id", sample: int = SAMPLE, seed: int = 42) -> tuple[LinearModel, DataFrame]:
    """(fitted model, rows of find_defects)."""
    spark = pairs.sparkSession
    pairs = pairs.select(id_col, "question", "response", "gold", "raw_len")
    kind = pairs.schema[id_col].dataType.simpleString()
    questions = pairs.select(F.col("question").alias("t")).where(F.col("t").isNotNull()).distinct()
    texts = pairs.select(F.col("response").alias("t")).unionByName(questions)
    drawn = pairs.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample)
    rows = [r.asDict() for r in drawn.collect()]
    broken = broken_copies(rows, seed) + broken_copies(rows, seed + 1)
    planted = cut_lineage(tails(spark.createDataFrame([(i, m[2]) for i, m in enumerate(broken)], "i long, t string"), "i", "t"))
    endings = cut_lineage(tails(pairs, id_col, "response"))
    both = endings.drop("id").unionByName(planted.drop("id"))
    longer = cut_lineage(continuations(texts, "t", both))
    verdicts = cut_lineage(judge(ending_evidence(endings, longer), pairs, id_col, "response", "raw_len", strict_prefixes(texts, "t")).select(F.col(id_col).alias("_i"), *EVIDENCE))
    mine = verdicts.join(F.broadcast(drawn.select(F.col(id_col).alias("_j"))), F.col("_i") == F.col("_j")).collect()
    by_id = {r["_i"]: r.asDict() for r in mine}
    seen = {r["id"]: r.asDict() for r in ending_evidence(planted, longer).collect()}
    for i, e in seen.items():
        text, origin = broken[i][2], broken[i][4]
        if origin:
            # what the original adds is taken off, so that a copy is not told by the text it was cut from; and a stop
            # more, as each text of the table has its own
            for n, (on, stop) in zip(LEVELS, own_counts(origin, ending(text)[2])):
                e |= {f"on{n}": max(0, e[f"on{n}"] - on), f"stop{n}": max(0, e[f"stop{n}"] - stop) + 1}
        e |= {"prefix_of_longer": False, "raw_longer": False}
        e["cut"] = cut_of(e)
    model = train(rows, broken, [by_id.get(r[id_col]) for r in rows] + [seen.get(i) for i in range(len(broken))], seed)
    # plain arrays, which any worker can load
    sent = spark.sparkContext.broadcast((model.dense, model.hashed, model.threshold))
    src = pairs.join(verdicts, F.col(id_col) == F.col("_i"), "left").select(id_col, "question", "response", "gold", F.struct(*EVIDENCE).alias("e"))

    def score(batches):
        import numpy as np

        scorer, known, hasher = LinearModel(*sent.value), Questions(), Hasher()
        for b in batches:
            rows = list(zip(*[b.column(i).to_pylist() for i in range(1, 5)]))
            if not rows:
                continue
            s = scorer.scores([dense_features(q, t, g, ending_features(e), known) for q, t, g, e in rows], Grams([sentences(r[1]) for r in rows], hasher))
            i, j = np.nonzero(s >= np.array(scorer.threshold))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array([LABELS[x] for x in j], pa.string()), pa.array(s[i, j])], names=[id_col, "defect", "score"])

    return model, src.mapInArrow(score, f"`{id_col}` {kind}, defect string, score double")
