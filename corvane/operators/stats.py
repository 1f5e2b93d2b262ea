"""Counts, cross-tables and accuracies, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_summary(df: DataFrame, by: list[str], multimodal: str) -> DataFrame:
    """(kind, value, rows, multimodal) for each value of each column, in one pass, with the total (kind
    `TOTAL`). A null value stays null."""
    bits = {c: len(by) - 1 - i for i, c in enumerate(by)}
    every = df.groupingSets([[c] for c in by] + [[]], *by).agg(F.count("*").alias("rows"), F.count_if(F.col(multimodal)).alias("multimodal"), F.grouping_id().alias("_g"))
    kind, value = F.lit("TOTAL"), F.lit(None).cast("string")
    for c in by:
        own = F.col("_g") == ((1 << len(by)) - 1) ^ (1 << bits[c])
        kind, value = F.when(own, F.lit(c)).otherwise(kind), F.when(own, F.col(c).cast("string")).otherwise(value)
    return every.select(kind.alias("kind"), value.alias("value"), "rows", "multimodal")


def crosstab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts by row value and column value, 0 where there are none, for the given values only."""
    fixed = df.sparkSession.createDataFrame([(r,) for r in rows], f"`{row}` string")
    counted = df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in columns])
    return fixed.join(counted, row, "left").na.fill(0, columns)


def accuracy(df: DataFrame, correct: Column, by: list[str] | None = None) -> DataFrame:
    """Rows, correct ones and their share (null of no rows), in all or per group; a null verdict is wrong."""
    hit = F.count_if(F.coalesce(correct, F.lit(False)))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), hit.alias("correct"), F.try_divide(hit, F.count("*")).alias("accuracy"))


def category(subfield: Column, main: Column) -> Column:
    """Subfield, else category, else `unknown`; empty strings are values."""
    return F.coalesce(subfield, main, F.lit("unknown"))


def markdown(headers: list[str], rows: list) -> str:
    """Markdown table of a few rows."""
    body = [[str(x) for x in r] for r in rows]
    width = [max(len(h), *(len(r[i]) for r in body)) if body else len(h) for i, h in enumerate(headers)]
    show = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([show(headers), show(["-" * w for w in width]), *map(show, body)])


def split_report(df: DataFrame, source: str, concept: str, level: str, multimodal: str, sources: list[str], concepts: list[str], levels: list[str]) -> DataFrame:
    """(part, row, column, count) of one split in long form: counts by source, concept and level with their totals, by
    modality, and sources by levels. The given values all have their rows, 0 where there is nothing; other values count in the
    totals only. One pass over the data, in one grouping of few groups."""
    spark = df.sparkSession
    tall = df.groupBy(source, concept, level, F.coalesce(F.col(multimodal), F.lit(False)).alias("_m")).agg(F.count("*").alias("_n"))

    def cell(part: str, row: Column, column: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), row.cast("string").alias("row"), column.cast("string").alias("column"))

    count, parts = F.lit("count"), (("source", source), ("concept", concept), ("difficulty", level))
    cells = [cell(p, F.col(c), count) for p, c in parts] + [cell(p, F.lit("TOTAL"), count) for p, _ in parts]
    cells.append(cell("modality", F.when(F.col("_m"), "multimodal").otherwise("text-only"), count))
    each = F.array(*cells, cell("source x difficulty", F.col(source), F.col(level)))
    counted = tall.select(F.explode(each).alias("e"), "_n").groupBy("e").agg(F.sum("_n").alias("_n")).select("e.*", "_n")
    wanted = [(part, r, "count") for part, rows in (("source", sources), ("concept", concepts), ("difficulty", levels)) for r in [*rows, "TOTAL"]]
    wanted += [("modality", r, "count") for r in ("text-only", "multimodal")] + [("source x difficulty", r, c) for r in sources for c in levels]
    fixed = spark.createDataFrame(wanted, "part string, row string, column string")
    return fixed.join(counted, ["part", "row", "column"], "left").select("part", "row", "column", F.coalesce("_n", F.lit(0)).alias("count"))


def report_markdown(report: DataFrame, title: str, sources: list[str], concepts: list[str], levels: list[str]) -> str:
    """The rows of split_report, as few as the categories, as Markdown tables in the given order."""
    got = {(r["part"], r["row"], r["column"]): r["count"] for r in report.collect()}
    out = [f"## {title}  (n={got['source', 'TOTAL', 'count']})"]
    for part, rows in (("source", [*sources, "TOTAL"]), ("concept", [*concepts, "TOTAL"]), ("difficulty", [*levels, "TOTAL"]), ("modality", ["text-only", "multimodal"])):
        out += ["", f"### By {part}" if part != "modality" else "### Modality", markdown([part, "count"], [(r, got[part, r, "count"]) for r in rows])]
    out += ["", "### Source x difficulty", markdown(["source", *levels], [(s, *[got["source x difficulty", s, c] for c in levels]) for s in sources])]
    return "\n".join(out)


def summary_markdown(summary: DataFrame, title: str) -> str:
    """The rows of split_summary, which are as few as the categories, as Markdown."""
    got = summary.orderBy("kind", "value").collect()
    out = [f"# {title}"]
    for kind in dict.fromkeys(r["kind"] for r in got):
        out += ["", f"## {kind}", markdown(["value", "rows"], [(r["value"] if kind != "TOTAL" else "TOTAL", r["rows"]) for r in got if r["kind"] == kind])]
    return "\n".join(out)
