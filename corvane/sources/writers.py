"""Writers of corpora, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strip_internal(df: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """Without the columns whose name begins with `_`; `tags` (field: column) become metadata._split_tags,
    also where metadata is null."""
    if tags:
        block = F.struct(*[F.col(c).alias(f) for f, c in tags.items()])
        fields = df.schema["metadata"].dataType.fields
        df = df.withColumn("metadata", F.struct(*[F.col("metadata")[f.name].alias(f.name) for f in fields if f.name != "_split_tags"], block.alias("_split_tags")))
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8 without null fields."""
    df.write.mode(mode).json(path)


def tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated text with a header, quoted where needed; white space at the ends of fields is kept."""
    df.write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def files(df: DataFrame, root: str, name: str, content: str) -> int:
    """One small text file a row, named by the column `name` below `root`, written by the tasks; returns their number. For folders that
    all executors see as a local path. A row written twice by a repeated task gives the same file."""
    import os

    if "://" in root and not root.startswith("file://"):
        raise ValueError("files are written to mounted folders only")
    base = root.removeprefix("file://")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(base, n)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def scratch(spark) -> str:
    """A new folder for files of this session, below spark.checkpoint.dir, which all executors share; a temporary one where the
    session names none and the master is local."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='corvane-files-')}/files-{uuid.uuid4().hex}"


def append_rows(df: DataFrame, path: str) -> None:
    """Appends as Parquet; each commit is whole or absent."""
    df.write.mode("append").parquet(path)


def result_document(overall: DataFrame, per_category: DataFrame) -> DataFrame:
    """One JSON text (column value) of an accuracy and its categories, which are few."""
    listed = per_category.select(F.struct(*per_category.columns).alias("c")).agg(F.sort_array(F.collect_list("c")).alias("categories"))
    return overall.select(F.to_json(F.struct(*overall.columns, listed.scalar().alias("categories"))).alias("value"))


def report_long(pairs: DataFrame, most: int | None = 50) -> DataFrame:
    """Overlap report in long form: all pairs, or with `most` the head of each comparison."""
    from ..operators.similarity import top_pairs

    return pairs if most is None else top_pairs(pairs, most)
