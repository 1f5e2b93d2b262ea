"""Canonical words of a text: typesetting, mark-up, letter case and white space are set aside.

Runs inside Arrow batches on the executors; everything here works on whole texts.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

# Mark-up that stands inside words, macros that only set type, unit and letter names.
INLINE_TAGS = "b|i|em|strong|span|sub|sup|u|tt|code|mark|small"
TYPE_MACROS = "mathrm|mathit|mathbf|mathsf|mathcal|text|textrm|textbf|textit|emph|operatorname|boldsymbol|underline"
UNITS = frozenset(
    "m cm mm km um nm pm s ms us ns min h d kg g mg ug t n kn mn j kj mj mev kev ev gev w kw mw v kv mv a ma k hz khz mhz rpm rad deg degrees c f uf nf pf ohm kohm pa kpa bar l t mt percent".split()
)
GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split())

_INLINE = re.compile(rf"</?(?:{INLINE_TAGS})(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|<!--.*?-->", re.I | re.S)
_MACRO = re.compile(rf"\\+(?:{TYPE_MACROS})\s*\{{([^{{}}]*)\}}")
_POWER = re.compile(r"\s*(?:\\times|\\cdot|×|\*|(?<=\d)\s+x(?=\s+10))\s*10\s*(?:\^|\*\*)\s*\{?\s*([+-]?\d+)\s*\}?")
_SPACE = re.compile(r"\\(?:quad|qquad|thinspace|left|right|displaystyle)\b|\\+[,;:! ]|~|&nbsp;")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[>\s]*(?=[^\W\d_])")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])
_ASCII_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*(?:e[+-]?\d+(?![a-z]))?")
_EXPONENT = re.compile(r"\de[+-]?\d")
_WORD = re.compile(r"\d+(?:\.\d+)*(?:e[+-]?\d+(?![a-z]))?|[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Words of a text. Null and empty texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_HIDDEN))
    if "&" in text:
        text = html.unescape(text).replace("\xa0", " ")
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = text.lower()
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    if "\\" in text or "~" in text:
        if "\\" in text:
            text = _MACRO.sub(r" \1 ", text)
        text = _SPACE.sub(" ", text)
    if "10" in text:
        text = _POWER.sub(r"e\1 ", text)
    out = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
    if _EXPONENT.search(text):
        out = [f"{float(w):g}" if "e" in w and w[0].isdigit() else w for w in out]
    return out


def stable_hash(word: str) -> int:
    """Unsigned 64-bit hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self.seen, self.most = {}, most

    def __call__(self, ws: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = stable_hash(w)
            out.append(h)
        return out


def template_word(w: str) -> str:
    """Typed placeholder of a number, a unit or a symbol's name; other words stand for themselves."""
    if w[0].isdigit():
        return "<num>"
    if w in UNITS:
        return "<unit>"
    if len(w) == 1 or w in GREEK:
        return "<name>"
    return w


def mixed(x):
    """Finalizer for combined hashes (numpy uint64)."""
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(flat, k: int):
    """Hashes of the k-word windows that start at each place of a flat array of word hashes (the
    last k-1 places have none)."""
    import numpy as np

    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + flat[j : j + n]
        return mixed(h)
