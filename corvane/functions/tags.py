"""Topic, difficulty, modality and hardness tags of corpus records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics in the order in which they are tried, with their patterns.
TOPICS = [
    ("Optics", r"optic|lens|mirror|refract|diffract|interferenc|polariz|thin.?film|telescope|microscope"),
    ("Waves", r"wave|sound|acoustic|doppler|standing.?wave|string.?vibr|harmonic.?motion|oscillat|pendulum"),
    ("QM", r"quantum|wavefunction|schrodinger|schr.?dinger|spin(?!dle)|qubit|hilbert|operator|commutat|uncertainty|eigenstat|bra.?ket|entangle"),
    ("Modern", r"relativ|lorentz|general.?relat|special.?relat|cosmolog|black.?hole|nuclear|particle.?phys|standard.?model|qft|quantum.?field|field.?theory|gauge|string.?theory"),
    ("Thermo", r"thermo|entropy|heat|temperature|ideal.?gas|carnot|kinetic.?theory|statistic.?mech|boltzmann|partition.?function|phase.?transition|fluid.?stat|viscos"),
    ("EM", r"electr|magnet|capacitor|inductor|resistor|current|voltage|maxwell|coulomb|gauss|faraday|ampere|circuit|emf|electrostat|electrodynam|induction"),
    ("Mechanics", r"mechanic|newton|force|momentum|kinetic|potential.?energy|kinematic|dynamic|lagrang|hamilton|rotation|torque|rigid.?body|projectile|gravit|collision|friction|fluid.?dynam"),
]
DEFAULT_TOPIC = "Mechanics"
# Levels of named difficulties, of scores and of sources.
LEVELS = {"easy": "low", "knowledge": "low", "medium": "mid", "difficult": "high", "hard": "high", "intro": "low", "undergrad": "mid", "graduate": "high"}
SCORE_LEVELS = [(25, "high"), (10, "mid")]
SOURCE_LEVELS = {"physreason": "mid", "ugphysics": "high", "rl_sft": "mid", "openstax": "low"}
SOURCES = ["rl_sft", "physics_se", "openstax", "ugphysics", "physreason"]
TOPIC_FIELDS = ["topic", "book", "theorem", "subject", "category", "chapter"]


def _first_match(c: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TOPICS):
        found = F.when(c.rlike("(?i)" + pattern), F.lit(name)).otherwise(found)
    return found


def topic(metadata: Column, question: Column) -> Column:
    """First topic whose pattern the metadata matches, else the first 400 characters of the question, else the default."""
    parts = F.concat(F.coalesce(metadata["tags"], F.array().cast("array<string>")), F.filter(F.array(*[metadata[f] for f in TOPIC_FIELDS]), lambda x: x.isNotNull()))
    return F.coalesce(_first_match(F.array_join(parts, " ")), _first_match(F.substring(question, 1, 400)), F.lit(DEFAULT_TOPIC))


def difficulty(named: Column, score: Column, source: Column) -> Column:
    """Level by the named difficulty, else by the score, else by the source; `mid` for others."""
    table = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    by_score = F.when(score.isNotNull(), F.when(score >= SCORE_LEVELS[0][0], SCORE_LEVELS[0][1]).when(score >= SCORE_LEVELS[1][0], SCORE_LEVELS[1][1]).otherwise("low"))
    by_source = F.create_map(*[F.lit(x) for kv in SOURCE_LEVELS.items() for x in kv])
    return F.coalesce(table[F.lower(named)], by_score, by_source[source], F.lit("mid"))


def hardness(level: Column, source: Column, metadata: Column) -> Column:
    """Level plus a source bonus: named `difficult`, a score in fifties up to 2, or an advanced volume."""
    base = F.when(level == "low", 0.0).when(level == "high", 2.0).otherwise(1.0)
    book = F.lower(F.coalesce(metadata["book"], F.lit("")))
    bonus = (
        F.when(source == "physreason", F.when(metadata["difficulty"] == "difficult", 4.0).otherwise(2.0))
        .when(source == "ugphysics", 1.5)
        .when(source == "physics_se", F.least(F.lit(2.0), F.coalesce(metadata["score"], F.lit(0.0)) / 50))
        .when(source == "openstax", F.when(book.contains("vol 3") | book.contains("vol3") | book.contains("vol 2"), 0.5).otherwise(0.0))
        .otherwise(0.0)
    )
    return base + bonus


def multimodal(images: Column, question: Column) -> Column:
    return F.coalesce(F.size(images) > 0, F.lit(False)) | F.coalesce(question.contains("<image>"), F.lit(False))


def uid(bucket: Column, source: Column, row: Column) -> Column:
    """bucket::source, where an empty source is replaced by bucket_row."""
    return F.concat(bucket, F.lit("::"), F.coalesce(F.nullif(source, F.lit("")), F.concat_ws("_", bucket, row.cast("string"))))


def bucket_of_source(source: Column) -> Column:
    """Source bucket named by the source's prefix; `other` if none is."""
    found = F.lit("other")
    for s in SOURCES:
        found = F.when(source.startswith(s), s).otherwise(found)
    return found


def question_of(messages: Column) -> Column:
    """First user message; a record may open with a system message, which is no question."""
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
