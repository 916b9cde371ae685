"""Importance resampling towards a target distribution of hashed word features.

Texts beyond CHUNK bytes are cut at word starts into chunks that carry the next n - 1 words. A chunk
owns the features that start at its own words, so each feature of a text is counted once, and a
huge text is counted by as many tasks as it has chunks. What chunks count is summed by document.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.batches import byte_set, raw_bytes, slices, word_spans
from tallyforge.session import ship_package

#: Bytes of text that a chunk owns.
CHUNK = 1 << 16
#: Words are ASCII letters and digits and all characters beyond ASCII.
IN_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words with more bytes are hashed one by one.
STEPS = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The CRC-32 states after each has read its word; longest words first, so that each step has a prefix of them."""
    size = stops - starts
    out = state.copy()
    for k in np.flatnonzero(size > STEPS).tolist():
        out[k] = zlib.crc32(data[starts[k] : stops[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(np.where(size > STEPS, 0, -size).astype(np.int8), kind="stable")
    left = np.bincount(np.where(size > STEPS, 0, size), minlength=STEPS + 1)[::-1].cumsum()[::-1]
    at, held = starts[order], state[order]
    for k in range(STEPS):
        m = int(left[k + 1])
        if not m:
            break
        held[:m] = _TABLE[(held[:m] ^ data[at[:m] + k]) & 0xFF] ^ (held[:m] >> 8)
    fed = order[: int(left[1])]
    out[fed] = held[: len(fed)]
    return out


def bucket_runs(data: np.ndarray, cuts: np.ndarray, n: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(found, at, first): buckets of the runs of 1, 2, .. n words and the word each starts at; row k has words first[k] to first[k + 1]."""
    low = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)
    starts, stops, first = word_spans(low, cuts, IN_WORD)
    row_end = np.repeat(first[1:], np.diff(first))
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(starts))
    found, where = [], []
    for k in range(n):
        if k:
            keep = at + k < row_end[at]
            at, state = at[keep], state[keep]
            state = _TABLE[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8)
        state = _feed(state, low, starts[at + k], stops[at + k])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
        where.append(at)
    return found, where, first


def _chunks(texts: DataFrame, n: int, chunk: int) -> DataFrame:
    """(id, key, head, carry, text) of texts beyond ``chunk`` bytes: their chunks, dealt out over all tasks.

    key is the text's SHA-256; head marks a text's first chunk; the last ``carry`` words belong to the next chunk.
    """

    def run(batches):
        for some in slices(batches):
            for k in range(some.num_rows):
                data, cuts = raw_bytes(some.column(1).slice(k, 1))
                starts, stops, _ = word_spans(data, cuts, IN_WORD)
                key = hashlib.sha256(data).digest()
                cut = np.unique(np.searchsorted(starts, np.arange(0, len(data), chunk))) if len(starts) else np.zeros(0, np.int64)
                cut = [*cut[cut < len(starts)].tolist(), len(starts)] if len(starts) else [0, 0]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    last = min(len(starts), b + n - 1)
                    piece = data[starts[a] : stops[last - 1]].tobytes() if b > a else b""
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).slice(k, 1), pa.array([key]), pa.array([a == 0]), pa.array([last - b], pa.int32()), pa.array([piece], pa.binary())],
                        ["id", "key", "head", "carry", "text"],
                    )

    kind = texts.schema["id"].dataType.simpleString()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = texts.mapInArrow(run, f"id {kind}, key binary, head boolean, carry int, text binary")
    return cut.repartition(parts, F.xxhash64("text"))


def _parts(rows: DataFrame, id_col: str, text_col: str, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts of up to ``chunk`` bytes, each one chunk that stays where it is, and the chunks of the others."""
    ship_package(rows.sparkSession)
    texts = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = texts.where(F.octet_length("text") <= chunk)
    whole = short.select("id", F.lit(None).cast("binary").alias("key"), F.lit(True).alias("head"), F.lit(0).alias("carry"), F.col("text").cast("binary").alias("text"))
    return whole, _chunks(texts.where(F.octet_length("text") > chunk), n, chunk)


def bucket_counts(rows: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000, chunk: int = CHUNK) -> np.ndarray:
    """How many features of all whole texts each bucket holds; ``buckets`` numbers, however large the input is."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for some in slices(batches):
            found, at, first = bucket_runs(*raw_bytes(some.column(1)), n, buckets)
            owned = np.repeat(first[1:] - some.column(0).to_numpy(), np.diff(first))
            for b, w in zip(found, at, strict=True):
                total += np.bincount(b[w < owned[w]], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    whole, cut = _parts(rows.withColumn("__id", F.lit(0)), "__id", text_col, n, chunk)
    both = [p.select("carry", "text").mapInArrow(run, "bucket long, n long") for p in (whole, cut)]
    for r in both[0].unionByName(both[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source, floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(id, n_features, weight) of every row; weight is the floored mean gain of its features, 0 without any."""

    def run(batches):
        for some in slices(batches):
            found, at, first = bucket_runs(*raw_bytes(some.column(4)), n, len(gain))
            last = first[1:] - some.column(3).to_numpy()
            own = np.repeat(last, np.diff(first))
            n_all, g_all = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1, np.int64)
            for b, w in zip(found, at, strict=True):
                mine = w < own[w]
                n_all[1:][w[mine]] += 1
                g_all[1:][w[mine]] += gain[b[mine]]
            for x in (n_all, g_all):
                np.cumsum(x, out=x)
            sums = [pa.array(x[first[1:]] - x[first[:-1]]) for x in (n_all, g_all)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *sums], ["id", "key", "head", "n", "gain"])

    whole, cut = _parts(rows, id_col, text_col, n, chunk)
    kind = whole.schema["id"].dataType.simpleString()
    counted, parts = (p.mapInArrow(run, f"id {kind}, key binary, head boolean, n long, gain long") for p in (whole, cut))
    # Equal rows share a group: their sums are divided by their number, and the group is that many rows again.
    parts = parts.groupBy("id", "key").agg(F.sum(F.col("head").cast("long")).alias("copies"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    parts = parts.select("id", F.expr("n div copies").alias("n"), F.expr("gain div copies").alias("gain"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return counted.select("id", "n", "gain").unionByName(parts.select("id", "n", "gain")).select(
        F.col("id").alias(id_col), F.col("n").alias("n_features"), F.expr("CASE WHEN n = 0 THEN 0L ELSE (gain - pmod(gain, n)) div n END").alias("weight")
    )


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 2, buckets: int = 10_000,
    share: int = 25, min_words: int = 20, seed: int = 7, chunk: int = CHUNK,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    score is the weight plus Gumbel noise drawn from the id, so that the highest scores are a sample
    without replacement by weight. The floor(share * N / 100) highest scores of the N rows with
    ``min_words`` words get a rank from 1 on, ties to the smaller id (null last), then to fewer
    features and the smaller weight; other rows get null. A null or empty text has no features and
    weight 0. Rows with the same id and text are a row each. Empty tables give no rows, an empty
    target only its smoothing. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, n, buckets, chunk), bucket_counts(target, target_text, n, buckets, chunk))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights(docs, gain, id_col, text_col, n, chunk).withColumn("score", F.col("weight") + noise).checkpoint()
    # n_features of a text with w >= n words is n * w less what its end lacks.
    enough = n * min_words - n * (n - 1) // 2 if min_words >= n else min_words * (min_words + 1) // 2
    eligible = scored.where(F.col("n_features") >= enough)
    # Scores are thousandths of logarithms, so their distinct values stay some ten thousand at any size.
    held = sorted(((r["score"], r["n"]) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, before, offsets = share * sum(c for _, c in held) // 100, 0, []
    for score, c in held:
        if before >= draw:
            break
        offsets.append((score, before))
        before += c
    least = offsets[-1][0] if offsets else None
    inside = (F.col("n_features") >= enough) & (F.col("score") >= F.lit(least).cast("long"))
    names = [id_col, "n_features", "weight", "score"]
    ahead = docs.sparkSession.createDataFrame(offsets, "score long, ahead long")
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    drawn = scored.where(inside).groupBy(*names).agg(F.count("*").alias("n")).join(F.broadcast(ahead), "score")
    drawn = drawn.withColumn("last", F.col("ahead") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = drawn.select(*names, F.explode(F.expr("sequence(last - n + 1, last)")).alias("rank"))
    drawn = drawn.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~F.coalesce(inside, F.lit(False))).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn; see resample. A null id is never drawn."""
    ids = resample(docs, target, id_col, **options).where("rank is not null").select(id_col).distinct()
    return docs.join(ids, id_col, "left_semi").select(*docs.columns)
