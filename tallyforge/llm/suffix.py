"""Removal of long repeated byte strings: blockwise suffix sorting with a difference-cover sample.

Whether a suffix is removed depends only on its class at depth ``length``: does another suffix of
any text agree with it that far? Suffixes are therefore named instead of ranked, with 64 bits to a
name; equal names are adjacent after a sort, as equal prefixes are in a suffix array. Never are
all suffixes held or sent at once:

1. Texts are laid out in blocks of a bounded size, each distinct text once.
2. A difference cover D modulo v picks the sample: positions whose remainder is in D. Two suffixes
   that agree for ``length`` bytes have, within v bytes, a place where both are in the sample and
   agree for length - v + 1 bytes more. The sample's names at that depth are sorted bucket by
   bucket; which of them repeat goes back to the blocks.
3. Only suffixes with a repeated sample name within v bytes can repeat. Their names at the full
   depth are sorted bucket by bucket, and what repeats goes back to the blocks, which cut.

A bucket is a range of names and is sorted by one task, with names that a block holds several times
sent once, so that a frequent string adds one name for each block to its bucket.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ensure_checkpoint_dir, ship_package

LENGTH = 200
#: Bytes of text in a block, and about the bytes of text whose names share a bucket.
BLOCK, PER_BUCKET = 4 << 20, 8 << 20
SPAN = "array<struct<start:bigint,stop:bigint>>"


@lru_cache
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D) for a prime q: q + 1 residues modulo v = q*q + q + 1 whose differences are all residues.

    The zeros of a linear recurrence of order three over the field of q elements, for the first
    coefficients that give such a set (Singer's construction).
    """
    v = q * q + q + 1
    for c in itertools.product(range(q), repeat=3):
        a = [0, 0, 1]
        while len(a) < v:
            a.append((c[0] * a[-1] + c[1] * a[-2] + c[2] * a[-3]) % q)
        d = [i for i, x in enumerate(a) if x == 0]
        if len(d) == q + 1 and len({(x - y) % v for x in d for y in d}) == v:
            return v, np.array(d)
    raise ValueError(f"no cover for {q}")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover that leaves a third of ``length`` at least to the sample's names; (1, [0]) for short ones."""
    fits = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23) if length - (q * q + q) >= length / 3]
    return difference_cover(fits[-1]) if fits else (1, np.array([0]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = 0x9E3779B97F4A7C15 * 2 + 3 & (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, BLOCK + (1 << 16))
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held)
    return held[:n]


class Names:
    """64-bit names of the strings in a block, from prefix sums of two polynomials modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = []
        table = _mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)
        for t in table:
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(t[data] * _power(_MULT, len(data)), out=s[1:])
            self.sums.append(s)

    def at(self, where: np.ndarray, length: int) -> np.ndarray:
        back = _power(pow(_MULT, -1, 1 << 64), len(self.data) + 1)[where]
        a, b = (_mix((s[where + length] - s[where]) * back) for s in self.sums)
        return a ^ _mix(b + np.uint64(length))


class Block:
    """One block: its texts' bytes, sizes, and what each step derives from them, the same every time."""

    def __init__(self, data: bytes, sizes: np.ndarray, length: int):
        self.length, self.sizes = length, np.asarray(sizes, np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names = Names(self.data)
        self.v, cover = cover_for(length)
        self.depth = length - self.v + 1
        self.in_cover = np.zeros(self.v, bool)
        self.in_cover[cover] = True
        at = np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)
        self.room = np.repeat(self.sizes, self.sizes) - at
        self.sample = np.flatnonzero(self.in_cover[at % self.v] & (self.room >= self.depth) & (np.repeat(self.sizes, self.sizes) >= length))

    def sample_names(self):
        return np.unique(self.names.at(self.sample, self.depth), return_inverse=True, return_counts=True)

    def candidates(self, sample_repeats: np.ndarray) -> np.ndarray:
        """Suffixes with a repeated sample name within v bytes, and length bytes left in their text."""
        names, inverse, counts = self.sample_names()
        hits = self.sample[(sample_repeats | (counts > 1))[inverse]]
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, np.maximum(hits - self.v + 1, 0), 1)
        np.add.at(edge, hits + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.room >= self.length))

    def suffix_names(self, where: np.ndarray):
        return np.unique(self.names.at(where, self.length), return_inverse=True, return_counts=True)

    def spans(self, repeated: np.ndarray) -> list[list[tuple[int, int]]]:
        """Maximal covered runs of each text, from the suffixes that repeat."""
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + self.length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        turn = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        for a, b in turn.reshape(-1, 2).tolist():
            k = int(np.searchsorted(self.starts, a, "right")) - 1
            while a < b:  # a run that goes on into the next text is a run of each
                stop = min(b, int(self.starts[k] + self.sizes[k]))
                if stop > a:
                    out[k].append((a - int(self.starts[k]), stop - int(self.starts[k])))
                a, k = max(a, stop), k + 1
        return out


def _lay_out(texts: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of (key, text, n) as blocks of about ``block_bytes``; a longer text is a block of its own."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys, sizes, copies, data = [], [], [], []
        total = 0

        def block():
            nonlocal seq, keys, sizes, copies, data, total
            row = {"block": (part << 32) + seq, "keys": keys, "sizes": sizes, "copies": copies, "data": b"".join(data)}
            seq, keys, sizes, copies, data, total = seq + 1, [], [], [], [], 0
            kind = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("data", pa.binary())])
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in batches:
            for key, text, n in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "n")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if total and total + len(raw) > block_bytes:
                    yield block()
                keys.append(key), sizes.append(len(raw)), copies.append(n), data.append(raw)
                total += len(raw)
        if keys:
            yield block()

    return texts.select("key", "text", "n").mapInArrow(run, "block long, keys array<string>, sizes array<long>, copies array<long>, data binary")


def _send(block_id: int, names: np.ndarray, bits: int, width: int):
    """Rows (bucket, block, names): the sorted names cut into buckets by their leading bits, ``width`` bytes of the rest each."""
    cuts = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    rest = (names << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :width] if len(names) else np.zeros((0, width), np.uint8)
    ends = [*cuts[1:].tolist(), len(names)]
    rows = [(b, rest[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(cuts.tolist(), ends, strict=True)) if hi > lo]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([block_id] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
            ["bucket", "block", "names"],
        )


def _repeats(sent: DataFrame, width: int) -> DataFrame:
    """(block, flags): for each block its buckets' bits, in bucket order, set where another block sent the same name."""

    def run(table):
        blobs = table.column("names").to_pylist()
        sizes = [len(x) // width for x in blobs]
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        names = wide.view(">u8").ravel().astype(np.uint64)
        order = np.argsort(names, kind="stable")
        s = names[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        flags = np.zeros(len(s), bool)
        flags[order] = same[1:] | same[:-1]
        at = np.cumsum([0, *sizes])
        return pa.table(
            {
                "block": table.column("block").combine_chunks(),
                "bucket": table.column("bucket").combine_chunks(),
                "n": pa.array(sizes, pa.int64()),
                "flags": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            }
        )

    found = sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, n long, flags binary")
    return found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "flags"))).alias("flags"))


def _bits(flags: list[dict] | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=x["n"]) for x in flags or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _each_block(batches, length: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, Block(row.column("data")[0].as_buffer(), row.column("sizes").flatten().to_numpy(), length)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256) of every distinct text; key is its SHA-256 in hex.

    spans are the maximal runs of bytes covered by strings of ``length`` bytes that also start
    elsewhere in any text, the same one included, judged on the input. A text that occurs in several
    rows is covered whole if it has ``length`` bytes. Null texts count as empty. The blocks and both
    sorted sets of repeats are written below the checkpoint folder, so a lost task redoes its block.
    """
    spark = docs.sparkSession
    ship_package(spark)
    top = f"{ensure_checkpoint_dir(spark)}/repeats-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.sha2(text.cast("binary"), 256).alias("key"), text.alias("text"))
    texts = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    name = f"repeats_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = _lay_out(texts, block_bytes).write.bucketBy(buckets, "block").format("parquet")
    laid.option("path", f"{top}/blocks").option("compression", "zstd").saveAsTable(name)
    try:
        # A table bucketed by block: what comes back for a block is joined without moving the text.
        blocks = spark.table(name)
        total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
        bits = max(3, math.ceil(math.log2(max(1, total / PER_BUCKET))))

        def send_sample(batches):
            for row, block in _each_block(batches, length):
                yield from _send(row.column("block")[0].as_py(), block.sample_names()[0], bits, 4)

        def send_suffixes(batches):
            for row, block in _each_block(batches, length):
                where = block.candidates(_bits(row.column("sample")[0].as_py()))
                yield from _send(row.column("block")[0].as_py(), block.suffix_names(where)[0], bits, 8 - bits // 8)

        def cut(batches):
            for row, block in _each_block(batches, length):
                where = block.candidates(_bits(row.column("sample")[0].as_py()))
                _, inverse, counts = block.suffix_names(where)
                flags = _bits(row.column("suffixes")[0].as_py())
                spans = block.spans(where[(flags | (counts > 1))[inverse]])
                out = []
                data = block.data.tobytes()
                for k, (n, start, copies, key) in enumerate(
                    zip(block.sizes.tolist(), block.starts.tolist(), row.column("copies")[0].as_py(), row.column("keys")[0].as_py(), strict=True)
                ):
                    held = [(0, n)] if copies > 1 and n >= length else spans[k]
                    ends = [0, *(start_stop for s in held for start_stop in s), n]
                    kept = hashlib.sha256(b"".join(data[start + a : start + b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                    out.append({"key": key, "n_bytes": n, "spans": [{"start": a, "stop": b} for a, b in held], "kept_sha256": kept.hexdigest()})
                kind = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])
                yield pa.RecordBatch.from_pylist(out, schema=kind)

        def back(rows: DataFrame, found: DataFrame, col: str) -> DataFrame:
            found = found.withColumnRenamed("flags", col).repartition(buckets, "block")
            return rows.join(found.hint("shuffle_hash"), "block", "left")

        sent = "bucket int, block long, names binary"
        sample = _repeats(blocks.select("block", "sizes", "data").mapInArrow(send_sample, sent), 4).checkpoint()
        asked = back(blocks.select("block", "sizes", "data"), sample, "sample")
        suffixes = _repeats(asked.mapInArrow(send_suffixes, sent), 8 - bits // 8).checkpoint()
        last = back(back(blocks, sample, "sample"), suffixes, "suffixes")
        done = last.mapInArrow(cut, f"key string, n_bytes long, spans {SPAN}, kept_sha256 string")
        return done.checkpoint()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``; see repeated_spans."""
    spans = repeated_spans(docs, text_col, length)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return docs.select(F.col(id_col), key.alias("key")).join(spans, "key").select(
        id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; bytes of a character cut in two become replacement marks."""
    spans = repeated_spans(docs, text_col, length).select("key", "spans").withColumnsRenamed({"key": "__key", "spans": "__spans"})
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).join(spans, "__key")
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            cut = []
            for t, held in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if t is not None and held:
                    raw = t.encode("utf-8", "surrogatepass")
                    ends = [0, *(x for s in held for x in (s["start"], s["stop"])), len(raw)]
                    t = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode("utf-8", "replace")
                cut.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(cut, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in names], names)

    return keyed.select(*names, "__spans").mapInArrow(run, schema)
