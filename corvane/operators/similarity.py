"""Set-similarity join of texts by word shingles, exact for any threshold above 0.

Texts with equal normal form are one class, so copies are never paired with each other; pairs are
between classes, and membership tells which rows stand in one. The join itself is an equi-join on the
shingles of each class's prefix: a pair of Jaccard similarity t shares at least DEPTH of the
n - ceil(t n) + DEPTH rarest shingles of either side, or all it must share if that is less. Shingles are exchanged as 64-bit hashes; what is left is
verified on the words themselves. The join of a table with itself makes its candidates in posting.py, from packed posting lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import audit_norm, jaccard, preview, shingle_hashes, shingle_set
from .posting import self_pairs

DEPTH = 6  # rare shingles that a pair must share before its words are compared; any value gives the same pairs


def _classes(normed: DataFrame, split: list[str], k: int) -> DataFrame:
    """(split columns, rep, norm, hashes, n): rep is the least id of the class. Copies are combined before the exchange, so
    a large class costs a row a task."""
    reps = normed.groupBy(*split, "norm").agg(F.min("id").alias("rep"))
    made = reps.select(*split, "rep", "norm", shingle_hashes(F.col("norm"), k).alias("hashes"))
    return made.withColumn("n", F.size("hashes"))


def _prefixes(c: DataFrame, split: list[str], t: float) -> DataFrame:
    """(split columns, rep, n, s, pos): the indexed part of each class's prefix, in one order of all shingles by
    rarity. Shingles of a single class are the rarest of all: they take their places in the prefix, but are not exchanged again or joined."""
    each = c.select(*split, "rep", "n", F.explode("hashes").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    own = W.partitionBy(*split, "rep")
    pos = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "s"))
    ranked = each.join(shared, "s").withColumn("pos", pos)
    return ranked.where(F.col("pos") <= F.col("n") - F.ceil(t * F.col("n") - 1e-9) + DEPTH).select(*split, "rep", "n", "s", "pos")


def _candidates(left: DataFrame, right: DataFrame, on: list[str], t: float, ordered: bool) -> DataFrame:
    """(on columns but s, a, b) of classes that share enough indexed shingles and may be similar enough by length and position."""
    cand = left.join(right, on)
    if ordered:
        cand = cand.where(F.col("a") < F.col("b"))
    need = F.lit(t / (1 + t)) * (F.col("na") + F.col("nb"))
    depth = F.least(F.lit(DEPTH), F.ceil(need - 1e-9))
    # of the rarest `depth` common shingles, each leaves room for all that must still be common behind it, so pairs of single rare shingles go before they are counted
    reach = depth + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    close = cand.where((F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9) & (reach >= need - 1e-9))
    keys = [*[c for c in on if c != "s"], "a", "b"]
    return close.groupBy(*keys).agg(F.count("*").alias("met"), F.first(depth).alias("depth")).where(F.col("met") >= F.col("depth")).select(*keys)


def _check(t: float) -> None:
    if t <= 0:
        raise ValueError("the threshold must be above 0")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, t: float = 0.4, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives: a, b, jaccard, with a < b), (members: id, rep) of one table. Null texts are in no class.
    The candidates are made when this is called."""
    _check(t)
    normed = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), audit_norm(F.col(text_col)).alias("norm"))
    c = normed.groupBy("norm").agg(F.min("id").alias("rep"))
    return self_pairs(c, t, k, DEPTH), normed.join(c, "norm").select("id", "rep")


def linked_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row a text: id, class_id, copies in the class, and links to other classes."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return members.join(copies, "rep").join(links, "rep", "left").select(F.col("id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _in_comparisons(comparisons: list[tuple[str, str, str]], side: int) -> Column:
    """Names of the comparisons in which a split is the given side, as an array."""
    of: dict[str, list] = {}
    for c in comparisons:
        of.setdefault(c[side], []).append(c[0])
    out = F.array().cast("array<string>")
    for split, names in of.items():
        out = F.when(F.col("split") == split, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def compare_splits(texts: DataFrame, comparisons: list[tuple[str, str, str]], t: float = 0.4, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Similarity joins between splits of one long table (split, id, text), in one join.

    `comparisons`: (name, split of a, split of b). Returns (pairs: comparison, a, b, jaccard) between
    classes of a split, and (members: split, id, rep). Splits without rows give no pairs."""
    _check(t)
    normed = texts.where(F.col("text").isNotNull()).select("split", "id", audit_norm(F.col("text")).alias("norm"))
    c = _classes(normed.where(F.col("split").isin(*{x for _, a, b in comparisons for x in (a, b)})), ["split"], k)
    p = _prefixes(c, ["split"], t)
    left, right = (p.select(F.explode(_in_comparisons(comparisons, 1 + i)).alias("comparison"), "s", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for i, x in enumerate("ab"))
    cand = _candidates(left, right, ["comparison", "s"], t, False)
    for i, x in enumerate("ab"):
        own = c.select(F.explode(_in_comparisons(comparisons, 1 + i)).alias("comparison"), F.col("rep").alias(x), F.col("norm").alias(f"_{x}"))
        cand = cand.join(own, ["comparison", x])
    pairs = cand.select("comparison", "a", "b", jaccard(shingle_set(F.col("_a"), k), shingle_set(F.col("_b"), k)).alias("jaccard")).where(F.col("jaccard") >= t)
    reps = normed.groupBy("split", "norm").agg(F.min("id").alias("rep"))
    return pairs, normed.join(reps, ["split", "norm"]).select("split", "id", "rep")


def with_previews(pairs: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Adds a_text and b_text, the first 120 characters of both."""
    a = texts.select(F.col(id_col).alias("a"), preview(F.col(text_col)).alias("a_text"))
    b = texts.select(F.col(id_col).alias("b"), preview(F.col(text_col)).alias("b_text"))
    return pairs.join(a, "a").join(b, "b")


def top_pairs(pairs: DataFrame, n: int = 50) -> DataFrame:
    """The n most similar pairs of each comparison, ties by ids. For reading only: nothing that removes rows takes this."""
    w = W.partitionBy("comparison").orderBy(F.col("jaccard").desc(), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def counts(pairs: DataFrame) -> DataFrame:
    """Pairs per comparison, and in all (comparison null)."""
    return pairs.rollup("comparison").agg(F.count("*").alias("pairs"))
