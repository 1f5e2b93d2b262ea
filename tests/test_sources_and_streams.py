import base64
import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import readers, writers
from corvane.streaming import resume

from .conftest import rows


def test_tolerant_jsonl_counts_all_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source":"x"}\n\n{broken\n{"source":"y","messages":[{"role":"user","content":"ü"}]}\n')
    got = readers.jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), readers.CORPUS).orderBy("_row_idx").collect()
    assert [(r._row_idx, r.source, r._bad) for r in got] == [(0, "x", None), (2, None, "{broken"), (3, "y", None)]
    assert got[2].messages[0].content == "ü"


def test_dropping_and_strict_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1"}\n{broken\n')
    assert readers.jsonl_dropping(spark, str(p), "id string").count() == 1
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(p), "id string").collect()


def test_optional_maps_arrays_and_tsv(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), readers.OPEN_ITEM).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"a": ["1"], "b": []}))
    assert rows(readers.json_map(spark, str(tmp_path / "m.json"))) == [("a", ["1"]), ("b", [])]
    (tmp_path / "l.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}], indent=1))
    assert readers.json_whole(spark, str(tmp_path / "l.json"), "id string").count() == 2
    big = "x" * 200_000
    (tmp_path / "t.tsv").write_text(f'index\tquestion\timage\tanswer\tcategory\tsubfield\treasoning_type\n1\t"a ""q""\nb"\t{big}\tA \tc\t\t\n')
    r = readers.tsv(spark, str(tmp_path / "t.tsv")).first()
    assert (r.question, len(r.image), r.answer) == ('a "q"\nb', 200_000, "A ")


def test_problem_folders(spark, tmp_path):
    for pid, body in {"p1": {"question_structure": {"b": "second", "a": "first"}, "answer": '["1","2"]', "difficulty": "hard"}, "p2": {"question_structure": "plain", "answer": "[oops"}}.items():
        (tmp_path / pid / "images").mkdir(parents=True)
        (tmp_path / pid / "problem.json").write_text(json.dumps(body))
    for name in ("2.png", "1.JPG", ".hidden.png", "n.txt"):
        (tmp_path / "p1" / "images" / name).write_bytes(b"x")
    got = {r.id: r for r in readers.problem_folders(spark, str(tmp_path)).collect()}
    assert got["p1"].problem_text == "(a) first\n\n(b) second" and got["p1"].gold == ["1", "2"]
    assert [p.rsplit("/", 1)[1] for p in got["p1"].images] == ["1.JPG", "2.png"]
    assert got["p2"].problem_text == "plain" and got["p2"].gold == ["[oops"] and got["p2"].images == []


def test_corpus_views(spark):
    df = spark.createDataFrame([("s", None, None, None), ("t", None, [("user", "hi")], None)], readers.CORPUS)
    assert rows(readers.corpus_by_split(df)) == [("?", "s", ""), ("?", "t", "hi")]
    items = spark.createDataFrame([("1", "", None, None, None, None, None)], readers.CHOICES)
    assert rows(readers.choice_items(items)) == [("mc_1", "")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", None, "u")], "source string, metadata struct<topic:string>, _uid string")
    out = writers.strip_internal(df, {"uid": "_uid"})
    assert out.columns == ["source", "metadata"] and out.first().metadata._split_tags.uid == "u"
    writers.jsonl(out.withColumn("t", F.lit("é")), str(tmp_path / "o"))
    assert "é" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("*.json"))
    doc = writers.result_document(spark.createDataFrame([(2, 1)], "total int, correct int"), spark.createDataFrame([("a", 2)], "category string, total int")).first().value
    assert json.loads(doc) == {"total": 2, "correct": 1, "categories": [{"category": "a", "total": 2}]}
    pairs = spark.createDataFrame([("c", i, i, 0.5) for i in range(60)], "comparison string, a int, b int, jaccard double")
    assert writers.report_long(pairs).count() == 50 and writers.report_long(pairs, None).count() == 60


def test_resume_in_batch_and_stream(spark, tmp_path):
    out, calls = str(tmp_path / "out"), []

    def work(df):
        calls.append(df.count())
        return df.withColumn("v", F.lit(1))

    df = spark.createDataFrame([(1,), (2,)], "id int")
    resume.process_rest(df, out, ["id"], work)
    resume.process_rest(df.union(spark.createDataFrame([(3,)], "id int")), out, ["id"], work)
    assert calls == [2, 1] and spark.read.parquet(out).count() == 3
    src = tmp_path / "src"
    spark.createDataFrame([(3,), (4,), (4,)], "id int").write.parquet(str(src))
    q = resume.process_stream(spark.readStream.schema("id int").parquet(str(src)), out, str(tmp_path / "ck"), ["id"], work)
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_image_round_trip(spark):
    raw = base64.b64encode(b"abc").decode()
    assert spark.range(1).select(F.unbase64(F.lit(raw))).first()[0] == bytearray(b"abc")


def test_files_tsv_and_numbered_items(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a\t"q"\n b ', None), ("2", "", "x ")], "index string, question string, image string")
    writers.tsv(df, str(tmp_path / "t"))
    assert rows(readers.tsv(spark, str(tmp_path / "t"), "index string, question string, image string").select("index", F.coalesce("question", F.lit("")), "image")) == [("1", 'a\t"q"\n b ', None), ("2", "", "x ")]
    assert writers.files(df.select(F.concat("index", F.lit("/q.txt")).alias("n"), "question"), str(tmp_path / "f"), "n", "question") == 2
    assert (tmp_path / "f" / "1" / "q.txt").read_text() == 'a\t"q"\n b ' and writers.files(df.limit(0), str(tmp_path / "g"), "index", "question") == 0
    with pytest.raises(ValueError):
        writers.files(df, "s3://x", "index", "question")
    (tmp_path / "i.jsonl").write_text('{"question":"q"}\n\n{broken\n{"messages":[{"role":"user","content":"m"}]}\n{}\n')
    lines = readers.jsonl_tolerant(spark, str(tmp_path / "i.jsonl"), f"question string, messages {readers.MESSAGES}")
    assert rows(readers.numbered_items(lines)) == [("phyx_0", "q"), ("phyx_3", "m"), ("phyx_4", "")]
    assert readers.held_out(spark.createDataFrame([("s", None, [("user", "A b!")], None)], readers.CORPUS)).first()[:] == ("s", "A b!", "a b")
