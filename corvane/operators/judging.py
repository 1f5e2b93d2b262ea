"""Judging of responses: strict matches first, an injected judge for the rest, and model calls.

A judge or model is a callable from prompt to text; nothing here opens a connection by itself.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import tail_candidates, yes_no
from ..functions.match import not_blank, strict_match, strict_match_any
from ..functions.text import tail

GRADE = "GOLD: {gold}\nCANDIDATES:\n{preds}\nIs one of the candidates equivalent to the gold, within {tol} relative tolerance? Answer YES or NO."
GRADE_WHOLE = GRADE.replace("GOLD:", "REFERENCE SOLUTION:") + "\nEND OF THE RESPONSE:\n{tail}"
MOST_PREDS = 6
TIME_LIMIT = 90.0  # seconds of one call
GOLD_CHARACTERS, TAIL_CHARACTERS = 3000, 600  # of a reference solution and a response that a judge is shown


def candidates(boxes: Column, raw_tail: Column) -> Column:
    """Non-blank boxed answers, or those found in the tail where there are none."""
    boxed = F.coalesce(not_blank(boxes), F.array().cast("array<string>"))
    return F.when(F.size(boxed) > 0, boxed).otherwise(F.coalesce(tail_candidates(raw_tail), F.array().cast("array<string>")))


def within(call: Callable, argument, seconds: float | None):
    """call(argument), or TimeoutError after `seconds`; the late call goes on in a thread of its own and is not waited for."""
    if seconds is None:
        return call(argument)
    done: queue.Queue = queue.Queue()

    def run():
        try:
            done.put((call(argument), None))
        except BaseException as e:  # noqa: BLE001
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        out, err = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"timeout after {seconds:g} s") from None
    if err is not None:
        raise err
    return out


def call_model(df: DataFrame, id_cols: list[str], prompt: str, factory: Callable[[], Callable[[str], str]], attempts: int = 1, wait: Callable[[int], float] = lambda n: 2.0**n + 1, limit: float | None = TIME_LIMIT) -> DataFrame:
    """id columns, reply, err and seconds for each row. The factory runs once a task, so a local model is loaded
    once; a call that fails, gives nothing or takes longer than `limit` seconds is tried up to `attempts` times and then keeps its
    error. Partitions set the concurrency. Write the result to a table before using it twice, as each action calls again."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]):
        call = factory()
        for b in batches:
            reply, errors, took = [], [], []
            for p in b.column(len(id_cols)).to_pylist():
                began, out, err = time.time(), "", None
                for n in range(attempts):
                    try:
                        out, err = within(call, p, limit) or "", None
                    except Exception as e:  # noqa: BLE001
                        out, err = "", f"attempt {n + 1}: {str(e)[:200]}"
                    if out or n == attempts - 1:
                        break
                    time.sleep(wait(n))
                reply.append(out), errors.append(err), took.append(time.time() - began)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(id_cols))], pa.array(reply), pa.array(errors, pa.string()), pa.array(took, pa.float64())], names=[*id_cols, "reply", "err", "seconds"])

    return df.select(*id_cols, prompt).mapInArrow(run, f"{kinds}, reply string, err string, seconds double")


def call_batches(df: DataFrame, id_cols: list[str], prompt: str, factory: Callable[[], Callable[[list[str]], list[str]]], size: int = 1000) -> DataFrame:
    """id columns and reply: a model that takes many prompts at once, loaded once a task, gets them `size` at a time. Replies keep to their
    rows; a model that returns another number of replies fails the task."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]):
        call, held, rows = factory(), [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            replies = call(t.column(len(id_cols)).to_pylist())
            if len(replies) != t.num_rows:
                raise ValueError(f"{len(replies)} replies to {t.num_rows} prompts")
            made = pa.Table.from_arrays([*[t.column(i) for i in range(len(id_cols))], pa.array(replies, pa.string())], names=[*id_cols, "reply"])
            return made.to_batches()

        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, size - rows)
                held.append(piece)
                at, rows = at + piece.num_rows, rows + piece.num_rows
                if rows == size:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    return df.select(*id_cols, prompt).mapInArrow(run, f"{kinds}, reply string")


def with_golds(df: DataFrame, golds: DataFrame, key: str, golds_col: str = "golds") -> DataFrame:
    """`df` with the golds of its key, an empty array where there is none, and err `no gold` there. Keys are compared as
    strings; the gold table must have one row a key."""
    g = golds.select(F.col(key).cast("string").alias("_k"), F.col(golds_col).alias("_g"))
    out = df.join(g, F.col(key).cast("string") == F.col("_k"), "left").withColumn(golds_col, F.coalesce("_g", F.array().cast("array<string>")))
    return out.withColumn("err", F.when(F.size(golds_col) == 0, "no gold")).drop("_k", "_g")


def judge_golds(df: DataFrame, id_col: str, golds: str, preds: str, factory: Callable[[], Callable[[str], str]], strict_first: bool = True, tol: str = "2%") -> DataFrame:
    """(id, strict, liberal, judged, errors): per row whether every gold matches strictly, and whether it does
    strictly or by the judge. The judge sees only golds that do not match strictly (all with
    strict_first False). Rows without gold or candidate are wrong without a call. Ids must be unique."""
    each = df.where((F.size(golds) > 0) & (F.size(preds) > 0)).select(id_col, preds, F.posexplode(golds).alias("_n", "gold"))
    each = each.withColumn("_strict", strict_match_any(F.col(preds), F.col("gold")))
    ask = each.where(~F.col("_strict")) if strict_first else each
    prompt = F.replace(F.replace(F.replace(F.lit(GRADE), F.lit("{gold}"), F.coalesce("gold", F.lit(""))), F.lit("{preds}"), F.array_join(F.slice(F.col(preds), 1, MOST_PREDS), "\n===\n")), F.lit("{tol}"), F.lit(tol))
    said = call_model(ask.withColumn("_prompt", prompt), [id_col, "_n"], "_prompt", factory).select(id_col, "_n", F.coalesce(yes_no(F.col("reply")), F.lit(False)).alias("_yes"), "err")
    verdict = each.join(said, [id_col, "_n"], "left").groupBy(id_col).agg(
        F.every("_strict").alias("strict"),
        F.every(F.coalesce("_yes", F.lit(False)) | (F.col("_strict") if strict_first else F.lit(False))).alias("liberal"),
        F.count("_yes").alias("judged"), F.count("err").alias("errors"),
    )
    no = F.lit(False)
    return df.select(id_col).join(verdict, id_col, "left").select(id_col, F.coalesce("strict", no).alias("strict"), F.coalesce("liberal", no).alias("liberal"), F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("errors", F.lit(0)).alias("errors"))


def judge_whole(df: DataFrame, id_col: str, gold: str, boxes: str, response: str, factory: Callable[[], Callable[[str], str]], tol: str = "2%") -> DataFrame:
    """(id, strict, liberal, errors) against one whole reference solution a row: the judge sees its first GOLD_CHARACTERS, all
    boxes and the last TAIL_CHARACTERS of the response, and is asked whether or not a box matches strictly. Rows without
    gold are wrong without a call."""
    none = F.array().cast("array<string>")
    shown = F.when(F.size(F.coalesce(boxes, none)) > 0, F.array_join(boxes, "\n===\n")).otherwise("[no box]")
    prompt = F.lit(GRADE_WHOLE)
    for field, value in {"{gold}": F.left(F.col(gold), F.lit(GOLD_CHARACTERS)), "{preds}": shown, "{tol}": F.lit(tol), "{tail}": tail(F.coalesce(response, F.lit("")), TAIL_CHARACTERS)}.items():
        prompt = F.replace(prompt, F.lit(field), value)
    has = F.coalesce(F.length(gold) > 0, F.lit(False))
    said = call_model(df.where(has).withColumn("_prompt", prompt), [id_col], "_prompt", factory).select(id_col, F.coalesce(yes_no(F.col("reply")), F.lit(False)).alias("_yes"), "err")
    strict = has & strict_match(F.coalesce(boxes, none), F.col(gold))
    return df.select(id_col, strict.alias("strict")).join(said, id_col, "left").select(id_col, "strict", F.coalesce("_yes", F.lit(False)).alias("liberal"), F.when(F.col("err").isNotNull(), 1).otherwise(0).alias("errors"))


def done_rows(judged: DataFrame, with_errors: bool = False) -> DataFrame:
    """Rows that need no new call: those without an error, unless `with_errors`."""
    return judged if with_errors else judged.where(F.col("errors") == 0)
