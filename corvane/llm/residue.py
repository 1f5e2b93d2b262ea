"""Template residue and error-page text (problem 8).

Method: labelled residue exemplars are retrieved through an inverted index of their rarest terms;
the TF-IDF containment of an exemplar in the passage window around the hit decides. Terms are pairs of
adjacent words; unfilled template fields become one typed word, which is an exemplar by itself. One pass over the texts
keeps the places of exemplar terms; frequencies over all documents, retrieval and containment work on these. The index
is as large as the exemplar list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

# Exemplars by label.
EXEMPLARS = {
    "filler": """
lorem ipsum dolor sit amet
consectetur adipiscing elit
sed do eiusmod tempor
ut labore et dolore magna
ut enim ad minim veniam
quis nostrud exercitation
duis aute irure
excepteur sint occaecat
praesent commodo cursus
nulla facilisi
integer posuere erat
mauris non tempor quam
vestibulum ante ipsum primis
etiam porta sem malesuada
content coming soon
sample text
dummy text
this is dummy copy used to show the layout
this page intentionally filled with placeholder words
this page intentionally left blank
your text goes here
type something here to begin
insert text here
add your text here
replace this paragraph with your own words
description to be added later
blah blah blah
more blah to come
asdf asdf asdf qwer qwer
hier steht ein beispieltext bitte ersetzen
texte d'exemple a remplacer par le contenu definitif
texto de relleno aqui ira el contenido
texto de ejemplo
""",
    "error page": """
404 not found
the requested url was not found on this server
that page can't be found
it looks like nothing was found at this location
the page you requested could not be found
sorry the page you are looking for does not exist
403 forbidden
you don't have permission to access this resource
401 unauthorized
access denied
this content is not available in your region
http 503 service unavailable
http 500 internal server error
http 502 bad gateway
http 502 service unavailable
http 503 bad gateway
http 500 service unavailable
http 500 bad gateway
http 502 internal server error
http 503 internal server error
500 internal server error
502 bad gateway
503 service unavailable
504 gateway timeout
gateway time out the upstream did not answer in time
the site is down for maintenance
please check back in 5 minutes
something went wrong try again later
we couldn't load this page right now
an unexpected error has occurred please try again
error establishing a database connection
too many requests
you have exceeded the rate limit
your session has expired
log in again to continue
verifying that you are human
checking your browser before accessing
traceback most recent call last
keyerror body
warning undefined variable page in
fatal error uncaught exception
status 503 error document unavailable request
error document unavailable request
seite nicht gefunden
der angeforderte inhalt ist nicht mehr verfugbar
erreur 404 la page demandee est introuvable
la page demandee est introuvable
lo sentimos la pagina que busca no existe
pagina no encontrada
""",
    "script notice": """
please enable javascript to view this page
you need to enable javascript to run this app
javascript seems to be disabled in your browser
this site requires javascript
turn it on in your browser settings and reload
enable scripts and cookies to continue reading
please enable cookies to continue
your browser does not support scripting or it has been switched off
content cannot be shown
scripts are blocked
the comments and formulas on this page will not load without them
to see the formulas allow scripts from this site
loading if nothing appears check that js is on
bitte aktivieren sie javascript um diese seite anzuzeigen
veuillez activer javascript pour afficher le contenu
active javascript en su navegador para ver este contenido
""",
    "template field": """
templatefield
""",
}
COVERAGE = 0.85  # least share of an exemplar's TF-IDF weight in the window
ANCHORS = 2  # rarest terms of an exemplar that retrieve it
SLACK = 1  # words a window may be longer than its exemplar
FIELD = "templatefield"

# names of fields: of two characters at least, as formulas put single letters in braces
_NAME = r"[A-Za-z_][\w.\-]+(?:\s*\|\s*\w+)*"
_LETTERS = r"[A-Za-z][A-Za-z_.]{2,}\d*"  # for single braces, which formulas and code use too
_FIELDS = re.compile(
    "|".join(
        [
            rf"(?<![\w\\^_}}$])\{{\{{\s*{_NAME}\s*\}}\}}(?![_^])",
            r"\{%[^{}%]+%\}",
            rf"<%=?\s*{_NAME}\s*%>",
            rf"[$#]\{{\s*{_LETTERS}\s*\}}",
            r"[$#]\{\s*[A-Za-z]\w*\d\s*\}(?!\s*[_^=+*/$\\-])",
            rf"%\({_NAME}\)[sdfSDF]",
            r"(?<![\w%])%[A-Z][A-Z0-9_.]+%(?!\w)",
            r"(?<!\w)__[A-Z][A-Z0-9_.]+__(?!\w)",
            rf"@@\s*{_NAME}\s*@@",
            rf"\[\[\s*{_NAME}\s*\]\]",
            rf"<<\s*{_NAME}\s*>>",
            r"<[A-Z]{2,}(?:_[A-Z0-9]+)+>",
            rf"\[\s*insert\s+{_NAME}(?:\s+[a-z_.]+)*\s*\]|\[\s*INSERT\s+[^\[\]]+\]",
            rf"\[\s*(?:[Yy]our|YOUR)\s+{_NAME}\s*\]",
            rf"\b(?:TBD|TBC|TODO)\s*:\s*{_NAME}\s+(?:goes|GOES)\s+(?:here|HERE)",
            rf"(?<![\w\\^_}}{{$#%\"'])\{{{_LETTERS}\}}(?![\w{{^_}}])",
        ]
    )
)
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?|\d+(?:[.,]\d+)*|[^\W\d_]+")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def residue_words(text: str) -> list[str]:
    """Words with fields typed, letters without case and accents, and numbers other than status codes typed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_HIDDEN))
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'")
    if "{" in text or "%" in text or "[" in text or "_" in text or "@@" in text or "<" in text or "TB" in text or "TODO" in text:
        text = _FIELDS.sub(f" {FIELD} ", text)
    return [w if not w[0].isdigit() or len(w) == 3 and w[0] in "45" and w.isdigit() else "#" for w in _WORD.findall(text.lower())]


def _terms(ws: list[str]) -> list:
    return list(zip(ws, ws[1:])) if len(ws) > 1 else [(w,) for w in ws]


def exemplar_list() -> list[tuple[str, list[str]]]:
    return [(label, residue_words(line)) for label, lines in EXEMPLARS.items() for line in lines.strip().splitlines()]


def known_terms() -> dict[tuple, int]:
    """Number of each term of the exemplars."""
    return {t: n for n, t in enumerate(sorted({t for _, ws in exemplar_list() for t in _terms(ws)}))}


def term_places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, places, terms): where which exemplar terms stand in each text that holds one. All that
    matching needs, made in the only pass over the texts."""
    src = df.select(id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    number = known_terms()
    heads = {t[0] for t in number}
    field = number[(FIELD,)]

    def find(batches):
        get = number.get
        for b in batches:
            rows, places, terms = [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                ws = residue_words(t)
                if heads.isdisjoint(ws):
                    continue
                at = [(i, x) for i, pair in enumerate(zip(ws, ws[1:])) if (x := get(pair)) is not None]
                if FIELD in ws:
                    at = sorted(at + [(i, field) for i, w in enumerate(ws) if w == FIELD])
                if at:
                    rows.append(n), places.append([i for i, _ in at]), terms.append([x for _, x in at])
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(places, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.int32()))], names=[id_col, "places", "terms"])

    return src.mapInArrow(find, f"`{id_col}` {kind}, places array<int>, terms array<int>")


def term_frequencies(places: DataFrame) -> dict[tuple, int]:
    """Documents that hold each exemplar term, over all rows; as few as there are terms."""
    names = {n: t for t, n in known_terms().items()}
    got = places.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    return {names[r["t"]]: r["n"] for r in got}


def build_index(docs: int, freq: dict) -> tuple[list, dict]:
    """Exemplars (label, words, term weights, total weight), and anchor term -> [(exemplar, place)]."""
    idf = lambda t: math.log((docs + 1) / (freq.get(t, 0) + 1)) + 1
    made, index = [], {}
    for k, (label, ws) in enumerate(exemplar_list()):
        weight = {t: n * idf(t) for t, n in Counter(_terms(ws)).items()}
        made.append((label, len(ws), weight, sum(weight.values())))
        terms = _terms(ws)
        for t in sorted(set(terms), key=lambda t: (-idf(t), terms.index(t)))[:ANCHORS]:
            index.setdefault(t, []).append((k, terms.index(t)))
    return made, index


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, label, hits): documents that hold residue, by label; hits counts the matched windows.

    Null, empty and blank texts match nothing; repeated rows count each. Whole texts are read, with no
    bound on length. The terms' places and frequencies are found when this is called."""
    kind = df.schema[id_col].dataType.simpleString()
    places = cut_lineage(term_places(df, id_col, text_col))
    made, index = build_index(df.count(), term_frequencies(places))
    number = known_terms()
    weights = [{number[t]: w for t, w in weight.items()} for _, _, weight, _ in made]
    anchors = {number[t]: at for t, at in index.items()}

    def match(batches):
        for b in batches:
            at, labels, hits = [], [], []
            for n, (where, terms) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = Counter()
                for i, term in zip(where, terms):
                    for k, place in anchors.get(term, ()):
                        label, size, _, total = made[k]
                        # terms whose words all stand in the window, which is a little longer than the exemplar
                        first, end = i - place - SLACK, i - place + size + SLACK - (size > 1)
                        have = set(terms[bisect_left(where, first) : bisect_left(where, end)])
                        if sum(w for x, w in weights[k].items() if x in have) >= coverage * total:
                            found[label] += 1
                for label, c in found.items():
                    at.append(n), labels.append(label), hits.append(c)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(labels), pa.array(hits, pa.int32())], names=[id_col, "label", "hits"])

    return places.mapInArrow(match, f"`{id_col}` {kind}, label string, hits int")


def split_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(residue documents, the clean rest). Ids must be unique; rows with a null id stay in the rest."""
    bad = find_residue(df, id_col, text_col).select(id_col).distinct()
    return bad, df.join(bad, id_col, "left_anti")
