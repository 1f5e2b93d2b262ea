"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Method: global distinct-word shuffle. Texts are split into pre-tokens; each block of documents
keeps its documents as indexes into the block's own word list, and only the word lists are
exchanged. Rows of one word meet in one partition, which encodes the word once; the ids go back to
the blocks, where documents are reassembled by position. A word that stands in every document is
one row a block, so there is no hot key to salt.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_DOCS, BLOCK_CHARS = 1000, 4_000_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: block, id, index list into the block's words; and the words themselves
    on the block's first row. Blocks are bounded by documents and characters; one text is never cut."""
    kind = df.schema[id_col].dataType.simpleString()
    pattern, most_docs, most_chars = PATTERN, BLOCK_DOCS, BLOCK_CHARS
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def split(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                words, rows, chars, start = {}, [], 0, at
                while at < len(texts) and at - start < most_docs and (chars < most_chars or at == start):
                    t = texts[at] or ""
                    rows.append([words.setdefault(w, len(words)) for w in find(t)])
                    chars += len(t)
                    at += 1
                block = (part << 32) + n
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows), pa.int64()), ids.slice(start, len(rows)), pa.array(rows, pa.list_(pa.int32())), pa.array([list(words)] + [None] * (len(rows) - 1), pa.list_(pa.string()))],
                    names=["block", "id", "idx", "words"],
                )

    return src.mapInArrow(split, f"block long, id {kind}, idx array<int>, words array<string>")


def _encoded_words(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """(block, i, ids) of every word of every block's list; each distinct word is encoded once."""
    pattern = PATTERN
    words = blocks.where(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("i", "word"))

    def encode(batches):
        import tiktoken

        ranks = load_ranks(vocabulary)
        enc = tiktoken.Encoding("corvane", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        last, ids = None, []
        for batch in batches:
            out = []
            for w in batch.column(2).to_pylist():
                if w != last:
                    last, ids = w, enc.encode_ordinary(w)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["block", "i", "ids"])

    # sorted, so that a task remembers one word and not its whole share of the vocabulary
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block long, i int, ids array<int>")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(id, ids) or, with counts_only, (id, n_tokens) for every row of `df`.

    Empty and null texts give an empty list (0 tokens); blank texts are encoded like any other.
    Strings that look like special tokens are ordinary text. Repeated and null ids keep a row each;
    other columns are ignored. An empty table gives an empty table."""
    kind = df.schema[id_col].dataType.simpleString()
    # kept, so that texts are split once and both uses see the same blocks; a lost part is made again
    blocks = _blocks(df, id_col, text_col).persist(StorageLevel.DISK_ONLY)
    ids = _encoded_words(blocks, vocabulary)
    result = "n_tokens long" if counts_only else "ids array<int>"

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        order = np.argsort(words.column("i").to_numpy()) if words.num_rows else np.empty(0, np.int64)
        lists = words.column("ids").take(pa.array(order)).combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        idx = docs.column("idx").combine_chunks()
        if isinstance(idx, pa.ChunkedArray):
            idx = pa.concat_arrays(idx.chunks)
        starts = idx.offsets.to_numpy()
        picked = lists.take(idx.flatten())
        if counts_only:
            size = np.diff(picked.offsets.to_numpy()).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            made = pa.array(total[starts[1:] - starts[0]] - total[starts[:-1] - starts[0]])
        else:
            ends = picked.offsets.to_numpy()
            made = pa.ListArray.from_arrays(pa.array((ends[starts - starts[0]] - ends[0]).astype(np.int32)), picked.flatten())
        return pa.table({id_col: docs.column("id"), result.split()[0]: made})

    pairs = blocks.select("block", "id", "idx").groupBy("block").cogroup(ids.groupBy("block"))
    return pairs.applyInArrow(assemble, f"`{id_col}` {kind}, {result}")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) from token ids by a join with the table of token bytes, whose size is that of the
    vocabulary. Ids outside the vocabulary and bytes that are no UTF-8 become U+FFFD; an empty or
    null list gives an empty text. Ids must be unique."""
    spark = df.sparkSession
    ranks = load_ranks(vocabulary)
    tokens = spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "tok int, bytes binary")
    each = df.select(F.col(id_col).alias("_id"), F.posexplode_outer(ids_col).alias("_pos", "tok"))
    lists = each.join(tokens, "tok", "left").groupBy("_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.hex(F.coalesce("bytes", F.lit("�").cast("binary"))).alias("h"))))).alias("l")
    )
    raw = F.unhex(F.array_join(F.transform("l", lambda x: x["h"]), ""))
    return lists.select(F.col("_id").alias(id_col), F.make_valid_utf8(raw.cast("string")).alias("text"))
