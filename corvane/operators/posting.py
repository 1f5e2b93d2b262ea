"""Candidates of the similarity self-join as packed posting lists, for tables whose shingles are too many for a row each.

A pair of Jaccard similarity t shares `need` = ceil(t / (1 + t) * (na + nb)) shingles or more, so its `depth` rarest common ones
stand among the first n - need + depth shingles of either side, in one order of all shingles. That bound depends on the partner's
size, and is tightest where the partner is at least as large: only such entries are compared with the entries of the texts from their
own size on. The order is that of a table of counts over hashed shingles, of fixed size: two shingles that share a place
only seem more frequent, which changes the order and no result. Texts, counts, entries and pairs go from task to task as compressed blocks.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26  # places of the table of counts: 64 MB at any size of the input
COUNT_RANGES = 64  # parts of that table
FLUSH = 4_000_000  # shingles, entries or pairs that a task holds before it sends them on
STEP = 2_000_000  # pairs that a task looks at together
KNOWN = 500_000  # words of which a task remembers the hash
CODEC = "zstd"
HASH_BITS = 40  # of a shingle in an entry; two that are equal there only make a pair to compare


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir, or in a temporary folder if none is named and the master is local."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-ckpt-"))
    return df.checkpoint(eager=True)


def deflated(*arrays) -> bytes:
    """Integer arrays of one length and of any widths as one block: bytes of equal weight stand together."""
    import numpy as np

    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec=CODEC, asbytes=True)


def inflated(block: bytes, *kinds: str) -> list:
    """The arrays of a block, given their dtypes."""
    import numpy as np

    raw = np.frombuffer(pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec=CODEC, asbytes=True), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["r", "block"])


def _cut(places, many: int):
    """Bounds of the ranges 0 .. many - 1 in a sorted array of range numbers."""
    import numpy as np

    return np.searchsorted(places, np.arange(many + 1)).tolist()


def packed_texts(classes: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(checkpoint of packs: reps, texts, deflated, words; its partitions, classes in the largest of them, words in all). `classes`: rep, norm."""

    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.binary())
            size = pc.binary_length(text).to_numpy().astype("<u4")
            words = pc.sum(pc.count_substring(b.column(1), " ")).as_py() + b.num_rows
            body = b"".join(text.to_pylist())
            block = deflated(size), len(body).to_bytes(8, "little") + pa.compress(body, codec=CODEC, asbytes=True)
            reps = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([reps, pa.array([block[0]], pa.binary()), pa.array([block[1]], pa.binary()), pa.array([words], pa.int64())], names=["reps", "sizes", "body", "words"])

    kind = classes.schema["rep"].dataType.simpleString()
    packs = checkpoint(classes.select("rep", "norm").mapInArrow(run, f"reps array<{kind}>, sizes binary, body binary, words long"))
    gc.collect()  # the texts' own exchange, which is half the input, would stay on disk until the driver happens to collect its garbage
    packs.sparkSession.sparkContext._jvm.System.gc()
    counts = packs.groupBy(F.spark_partition_id()).agg(F.sum(F.size("reps")).alias("n"), F.sum("words").alias("w")).collect()
    return packs, max(1, packs.rdd.getNumPartitions()), max([r["n"] for r in counts], default=0), sum(r["w"] for r in counts)


def _texts(batches, many: int):
    """(class numbers, reps, norms) of each pack in a partition. Numbers are dense if the partitions are even: row i of partition p is i * many + p."""
    import numpy as np

    p, i = TaskContext.get().partitionId(), 0
    for b in batches:
        for k in range(b.num_rows):
            (size,) = inflated(b.column(1)[k].as_py(), "<u4")
            block = b.column(2)[k].as_py()
            body = pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec=CODEC)
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            norm = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(body))
            yield (i + np.arange(len(size), dtype=np.int64)) * many + p, b.column(0)[k].values, norm
            i += len(size)


class _Shingler:
    """Hashes of the runs of k words of normalized texts; a shorter text is one run. An object remembers the hashes of words."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, norm) -> tuple:
        """(text's place, hash) of each run, repeated ones too."""
        import numpy as np

        lists = pc.split_pattern(norm, " ")
        words = lists.flatten().dictionary_encode()
        if len(self.known) > KNOWN:
            self.known.clear()
        known, table = self.known, []
        for w in words.dictionary.to_pylist():
            if (h := known.get(w)) is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            table.append(h)
        flat = np.array(table, np.uint64)[words.indices.to_numpy()]
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        starts = np.cumsum(size) - size
        runs = np.maximum(size - (self.k - 1), 1)
        owner = np.repeat(np.arange(len(size)), runs)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + starts[owner]
        h = np.zeros(len(owner), np.uint64)
        short = size[owner] < self.k if (size < self.k).any() else None
        padded = np.concatenate([flat, np.zeros(self.k, np.uint64)])
        for j in range(self.k):
            w = padded[first + j]
            if short is not None:
                w = np.where(short & (j >= size[owner]), np.uint64(0), w)
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return owner, h


def shingle_counts(packs: DataFrame, many: int, words: int, k: int, most_bits: int = MOST_BITS):
    """numpy uint8 array of 2**bits levels of frequency by the leading bits of a shingle's hash. Levels grow with the count; 0 and 1 are exact."""
    import numpy as np

    bits = min(most_bits, max(12, (2 * words).bit_length()))
    parts = min(COUNT_RANGES, 1 << max(0, bits - 20))
    width = bits - (parts.bit_length() - 1)  # bits of a place within its range

    def counted(batches):
        made, held, size = _Shingler(k), [], 0

        def sent():
            place, n = np.unique(np.concatenate(held), return_counts=True)
            at = _cut(place >> width, parts)
            return _blocks([(r, deflated(np.diff(place[a:b], prepend=r << width).astype("<u4"), n[a:b].astype("<u4"))) for r, (a, b) in enumerate(zip(at, at[1:])) if a < b])

        for _, _, norm in _texts(batches, many):
            held.append((made(norm)[1] >> np.uint64(64 - bits)).astype(np.int64))
            size += len(held[-1])
            if size > FLUSH:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def summed(batches):
        sums = {}
        for b in batches:
            for r, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                step, n = inflated(block, "<u4", "<u4")
                if r not in sums:
                    sums[r] = np.zeros(1 << width, np.int64)
                sums[r][np.cumsum(step, dtype=np.int64)] += n
        for r, n in sums.items():
            level = np.where(n < 32, n, np.minimum(32 + 8 * (np.log2(np.maximum(n, 32)) - 5), 255)).astype(np.uint8)
            yield _blocks([(r, deflated(level))])

    made = packs.mapInArrow(counted, "r int, block binary").repartitionById(parts, "r").mapInArrow(summed, "r int, block binary")
    levels = np.zeros(1 << bits, np.uint8)
    for r in made.toLocalIterator():
        levels[r["r"] << width : (r["r"] + 1) << width] = inflated(bytes(r["block"]), "u1")[0]
    return levels


def _need(t: float, na, nb):
    import numpy as np

    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def _pairs_of(s, c, n, pos, t: float, depth: int):
    """Arrays (pair key, weight) of the entries of one range: class numbers, smaller text first, as one uint64. Weights of a pair that shares `depth`
    of its rarest shingles, or all it must share if that is less, add up to `depth` at least."""
    import numpy as np

    order = np.lexsort((c, n, s))
    s, c, n, pos = s[order], c[order], n[order], pos[order]
    # the group's place and the size in one sorted number
    group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    scale = int(n.max()) + 2
    where = group * scale + n
    # partner sizes from the own one to that which the entry's place still allows
    most = np.minimum(np.floor((n + depth - pos) * ((1 + t) / t) + 1e-6) - n, np.floor(n / t + 1e-6)).astype(np.int64)
    ends = np.searchsorted(where, group * scale + np.clip(most, 0, scale - 1), "right")
    begins = np.arange(1, len(s) + 1)
    many = np.where(most >= n, np.maximum(ends - begins, 0), 0)
    rows = np.flatnonzero(many)
    total = np.concatenate([[0], np.cumsum(many[rows])])
    done = 0
    while done < total[-1]:  # an entry with many partners is cut too
        upto = min(done + STEP, int(total[-1]))
        x = np.searchsorted(total, done, "right") - 1
        y = np.searchsorted(total, upto, "left")
        own = rows[x:y]
        take = np.minimum(total[x + 1 : y + 1], upto) - np.maximum(total[x:y], done)
        a = np.repeat(own, take)
        skipped = np.maximum(done - total[x:y], 0)
        b = np.arange(len(a)) - np.repeat(np.cumsum(take) - take, take) + np.repeat(begins[own] + skipped, take)
        done = upto
        need = _need(t, n[a], n[b])
        least = np.minimum(need, depth)
        fits = (pos[a] <= n[a] - need + least) & (pos[b] <= n[b] - need + least) & (n[a] >= t * n[b] - 1e-9)
        if fits.any():
            a, b, least = a[fits], b[fits], np.maximum(least[fits], 1)
            lo, hi = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
            yield (lo.astype(np.uint64) << np.uint64(32)) | hi.astype(np.uint64), (-(-depth // least)).astype(np.int64)


def _summed(keys: list, weights: list) -> tuple:
    """Distinct keys, sorted, and the sums of their weights."""
    import numpy as np

    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight, first)


def candidates(packs: DataFrame, many: int, words: int, t: float, k: int, depth: int) -> DataFrame:
    """Checkpoint of (a long, b long): numbers of classes that share enough rare shingles, a < b."""
    import numpy as np

    levels = shingle_counts(packs, many, words, k)
    bits = len(levels).bit_length() - 1
    sent = packs.sparkSession.sparkContext.broadcast(levels)
    ranges = max(1, words // 2_000_000)

    def entries(batches):
        made, held, size = _Shingler(k), [], 0

        def out():
            s, c, n, pos = (np.concatenate(x) for x in zip(*held))
            r = ((s >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # in the order of s
            s = s >> np.uint64(64 - HASH_BITS)
            order = np.argsort(s, kind="stable")
            s, c, n, pos = s[order], c[order], n[order], pos[order]
            at = _cut(r[order], ranges)
            return _blocks([(i, deflated(np.diff(s[a:b], prepend=s[a : a + 1] * np.uint64(0)).astype("<u8"), c[a:b].astype("<u4"), n[a:b].astype("<u4"), pos[a:b].astype("<u4"))) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b])

        for number, _, norm in _texts(batches, many):
            owner, h = made(norm)
            level = sent.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.argsort(h, kind="stable")
            order = order[np.argsort((owner.astype(np.uint32)[order] << np.uint32(8)) | level[order], kind="stable")] if len(norm) < 1 << 24 else np.lexsort((h, level, owner))
            owner, h, level = owner[order], h[order], level[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
            owner, h, level = owner[new], h[new], level[new]
            n = np.bincount(owner, minlength=len(norm))
            pos = np.arange(1, len(h) + 1) - (np.cumsum(n) - n)[owner]
            n = n[owner]
            # shingles counted once are in no other text: they take their places, but no entry
            kept = (level > 1) & (pos <= n - np.ceil(t * n - 1e-9) + depth)
            held.append((h[kept], number[owner[kept]], n[kept], pos[kept]))
            size += int(kept.sum())
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def paired(batches):
        got: dict[int, list] = {}
        for b in batches:
            for r, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.setdefault(r, []).append(inflated(block, "<u8", "<u4", "<u4", "<u4"))

        def out(keys, weights):
            key, weight = _summed(keys, weights)
            r = ((key >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(r, kind="stable")
            key, weight = key[order], np.minimum(weight[order], 255)
            at = _cut(r[order], ranges)
            return _blocks([(i, deflated(np.diff(key[a:b], prepend=key[a : a + 1] * np.uint64(0)).astype("<u8"), weight[a:b].astype("u1"))) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b])

        for r in list(got):
            step, c, n, pos = zip(*got.pop(r))
            s = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in step])
            keys, weights, size = [], [], 0
            for key, weight in _pairs_of(s, *(np.concatenate(x).astype(np.int64) for x in (c, n, pos)), t, depth):
                keys.append(key)
                weights.append(weight)
                size += len(key)
                if size > FLUSH:
                    yield out(keys, weights)
                    keys, weights, size = [], [], 0
            if size:
                yield out(keys, weights)

    def met(batches):
        keys, weights, size = [], [], 0
        for b in batches:
            for block in b.column(1).to_pylist():
                step, weight = inflated(block, "<u8", "u1")
                keys.append(np.cumsum(step, dtype=np.uint64))
                weights.append(weight.astype(np.int64))
                size += len(weight)
                if size > 2 * FLUSH:
                    key, weight = _summed(keys, weights)
                    keys, weights, size = [key], [weight], len(key) // 2
        if keys:
            key, weight = _summed(keys, weights)
            key = key[weight >= depth]
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int64)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64))], names=["a", "b"])

    rows = packs.mapInArrow(entries, "r int, block binary").repartitionById(ranges, "r").mapInArrow(paired, "r int, block binary")
    found = checkpoint(rows.repartitionById(ranges, "r").mapInArrow(met, "a long, b long"))
    sent.unpersist()
    return found


def self_pairs(classes: DataFrame, t: float, k: int, depth: int) -> DataFrame:
    """(a, b, jaccard) of the classes (rep, norm) that are t similar or more, a < b, compared by their words. The candidates are made when this is called."""
    import numpy as np

    packs, many, most, words = packed_texts(classes)
    if many * most >= 1 << 32:
        raise ValueError("more than 2**32 classes")
    cand = candidates(packs, many, words, t, k, depth)
    wanted = np.zeros(many * most + 7 >> 3, np.uint8)

    def bits_of(batches):
        own = np.zeros(len(wanted), np.uint8)
        for b in batches:
            for x in (0, 1):
                c = b.column(x).to_numpy()
                np.bitwise_or.at(own, c >> 3, np.uint8(1) << (c & 7).astype(np.uint8))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([deflated(own)], pa.binary())], names=["m"])

    for r in cand.mapInArrow(bits_of, "m binary").toLocalIterator():
        wanted |= inflated(bytes(r["m"]), "u1")[0]
    sent = packs.sparkSession.sparkContext.broadcast(wanted)

    def needed(batches):
        for c, reps, norm in _texts(batches, many):
            keep = pa.array(np.flatnonzero((sent.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(c).take(keep), reps.take(keep), norm.take(keep).cast(pa.string())], names=["c", "rep", "norm"])

    kind = classes.schema["rep"].dataType.simpleString()
    texts = packs.mapInArrow(needed, f"c long, rep {kind}, norm string")
    both = cand
    for x in "ab":
        both = both.join(texts.select(F.col("c").alias(x), F.col("rep").alias(f"_{x}"), F.col("norm").alias(f"n{x}")), x)

    def compared(batches):
        def shingles(norm):
            w = norm.split(" ")
            return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

        for b in batches:
            known: dict[str, set] = {}
            share = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if x not in known:
                    known[x] = shingles(x)
                common = len(known[x] & (other := shingles(y)))
                share[i] = common / (len(known[x]) + len(other) - common)
            keep = pa.array(np.flatnonzero(share >= t))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(share).take(keep)], names=["a", "b", "jaccard"])

    rows = both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "na", "nb")
    return rows.mapInArrow(compared, f"a {kind}, b {kind}, jaccard double")
