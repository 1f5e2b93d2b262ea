"""Readers of the file formats of question-answer corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
METADATA = "struct<tags:array<string>,topic:string,book:string,theorem:string,subject:string,category:string,chapter:string,difficulty:string,score:double,corpus_subset:string>"
CORPUS = f"source string, images array<string>, messages {MESSAGES}, metadata {METADATA}"
GENERATION = "id string, benchmark string, source string, topic string, gold array<string>, subtopic string, difficulty string, response string, raw_len int"
CHOICES = "index string, question string, image string, answer string, category string, subfield string, reasoning_type string"
OPEN_ITEM = "id string, question string, image string, answer string, subtopic string, difficulty string"


def _present(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl_tolerant(spark: SparkSession, path: str, schema: str, bad_column: str = "_bad") -> DataFrame:
    """JSON lines with the row's place: blank lines are skipped, broken ones have no columns but the text in
    `bad_column`. _row_idx is the 0-based number of the line in its file, counting all lines; lines of one file
    are numbered over its splits by their byte offsets, without a global sort."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    # places in a split are contiguous; each split's first number is the count of the splits before it
    from pyspark.sql import Window as W

    splits = lines.groupBy("_file", "_at").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select(F.col("_file").alias("_f2"), F.col("_at").alias("_a2"), "_first", before.alias("_before"))
    rows = lines.join(starts, (F.col("_file") == F.col("_f2")) & (F.col("_at") == F.col("_a2"))).where(F.trim("value") != "")
    parsed = rows.withColumn("_j", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return parsed.select(*[F.col(f"_j.{n}").alias(n) for n in names], (F.col("_m") - F.col("_first") + F.col("_before")).alias("_row_idx"), F.when(bad, F.col("value")).alias(bad_column))


def jsonl_dropping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the broken ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str = "array<string>") -> DataFrame:
    """(id, value) of a file of one JSON object that maps ids to values."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "value"))


def optional(spark: SparkSession, path: str, schema: str, read=jsonl_dropping) -> DataFrame:
    """As `read`, or an empty table of the schema where nothing is at the path."""
    return read(spark, path, schema) if _present(spark, path) else spark.createDataFrame([], schema)


def tsv(spark: SparkSession, path: str, schema: str = CHOICES) -> DataFrame:
    """Tab-separated text with a header, quoted fields over several lines, and fields of any length."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1)


def corpus_by_split(corpus: DataFrame) -> DataFrame:
    """(split, id, text) of corpus records; a record without subset is in `?`, one without messages has text ''."""
    text = F.coalesce(F.get("messages", F.lit(0))["content"], F.lit(""))
    return corpus.select(F.coalesce("metadata.corpus_subset", F.lit("?")).alias("split"), F.col("source").alias("id"), text.alias("text"))


def held_out(df: DataFrame) -> DataFrame:
    """(id, text, norm) of held-out records: source, first message, and its normal form."""
    from ..functions.text import audit_norm

    text = F.get("messages", F.lit(0))["content"]
    return df.select(F.col("source").alias("id"), text.alias("text"), audit_norm(text).alias("norm"))


def numbered_items(lines: DataFrame, prefix: str = "phyx_") -> DataFrame:
    """(id, text) of the rows of jsonl_tolerant: the id is the prefix and the row's place in its file, the text the
    question, else the first message, else ''."""
    text = F.coalesce(F.nullif("question", F.lit("")), F.get("messages", F.lit(0))["content"] if "messages" in lines.columns else F.lit(None), F.lit(""))
    return lines.where(F.col("_bad").isNull()).select(F.concat(F.lit(prefix), F.col("_row_idx").cast("string")).alias("id"), text.alias("text"))


def choice_items(df: DataFrame, prefix: str = "mc_") -> DataFrame:
    """(id, text) of choice items: the question, else the first message, else ''."""
    text = F.coalesce(F.nullif("question", F.lit("")), F.get("messages", F.lit(0))["content"] if "messages" in df.columns else F.lit(None), F.lit(""))
    return df.select(F.concat(F.lit(prefix), F.col("index")).alias("id"), text.alias("text"))


def problem_folders(spark: SparkSession, root: str) -> DataFrame:
    """id, problem_text, gold, difficulty and images of folders `<id>/problem.json` with `images/*`.

    Sub-questions stand in the order of their keys. Images are sorted by name, hidden files and
    other types left out; only paths are read, not the images."""
    from ..functions.extract import gold_list

    schema = "question_structure string, answer string, difficulty string"
    p = json_whole(spark, f"{root}/*/problem.json", schema).select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/problem\.json$", 1).alias("id"))
    parts = F.array_sort(F.map_entries(F.from_json("question_structure", "map<string,string>")))
    text = F.coalesce(F.array_join(F.transform(parts, lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), F.coalesce(e["value"], F.lit("None")))), "\n\n"), F.col("question_structure"), F.lit(""))
    got = p.select("id", text.alias("problem_text"), gold_list(F.coalesce("answer", F.lit(""))).alias("gold"), F.coalesce("difficulty", F.lit("")).alias("difficulty"))
    none = F.array().cast("array<string>")
    if not _present(spark, f"{root}/*/images/*"):
        return got.withColumn("images", none)
    files = spark.read.format("binaryFile").load(f"{root}/*/images/*").select("path").where(F.lower("path").rlike(r"/[^./][^/]*\.(png|jpg|jpeg)$"))
    images = files.groupBy(F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1).alias("_p")).agg(F.sort_array(F.collect_list("path")).alias("images"))
    return got.join(images, F.col("id") == F.col("_p"), "left").drop("_p").withColumn("images", F.coalesce("images", none))
