"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.llm.batches import slices
from tallyforge.session import ship_package

SHINGLE, THRESHOLD = 5, 0.8
#: Characters of benchmark items that one scan of the documents searches for; more items take more scans.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes one worker keeps; beyond it the table starts anew.
MEMO = 100_000
_words: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, so that case, punctuation and spacing don't matter."""
    return WORD.findall((text or "").lower())


def word_codes(words: list[str]) -> np.ndarray:
    import xxhash

    if len(_words) > MEMO:
        _words.clear()
    out = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit codes of all runs of n words, from the codes of the words."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = (out * _MULT) ^ (codes[k : k + len(out)] >> np.uint64(1))
    out ^= out >> np.uint64(29)
    return out * _MULT


class ContainmentIndex:
    """MinHash sketches of items, in partitions by their number of shingles, each with a table of its own.

    An item of n distinct shingles lies in a document at a threshold t if ceil(t n) of them do, so at
    most n - ceil(t n) miss. Its sketch holds its smallest shingle hashes, one more than may miss for
    the largest item of its partition (sizes from 2^k up to below 2^(k+1)): every document that
    contains it has one of them at least, however long it is, and none is overlooked. A document
    with fewer shingles than a partition's smallest item needs passes that partition by. Items of
    under ``shingle`` words are one shingle of all their words, in partitions by their length.
    """

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items: list[tuple[object, int, frozenset]] = []
        parts: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(shingle, len(words))
            codes = shingle_codes(word_codes(words), n)
            grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
            size = len(grams).bit_length() - 1
            for c in np.unique(codes)[: self.sketch_size(size)].tolist():
                parts[n, size][c].append(len(self.items))
            self.items.append((item_id, n, frozenset(grams)))
        self.partitions = []
        for (n, size), held in sorted(parts.items()):
            codes = np.array(sorted(held), dtype=np.uint64)
            bits = max(12, int(codes.size * 16).bit_length())
            bitmap = np.zeros(1 << bits, bool)
            bitmap[codes >> np.uint64(64 - bits)] = True
            least = math.ceil(threshold * (1 << size) - 1e-9)
            self.partitions.append((n, least, codes, [held[c] for c in codes.tolist()], bitmap, np.uint64(64 - bits)))

    def sketch_size(self, size: int) -> int:
        """Hashes kept of an item in the partition of 2^size up to below 2^(size + 1) shingles."""
        most = (2 << size) - 1
        return most - math.ceil(self.threshold * most - 1e-9) + 1

    def search(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, item's shingles, those in the text) of each item contained in the whole text."""
        words = words_of(text)
        if not words:
            return []
        codes = word_codes(words)
        found: set[int] = set()
        all_of: dict[int, np.ndarray] = {}
        for n, least, sketch, items, bitmap, shift in self.partitions:
            if n not in all_of:
                all_of[n] = shingle_codes(codes, n)
            mine = all_of[n]
            if len(mine) < least:
                continue
            mine = mine[bitmap[mine >> shift]]
            if len(mine):
                at = np.searchsorted(sketch, mine)
                at[at == len(sketch)] = 0
                for k in np.unique(at[sketch[at] == mine]).tolist():
                    found.update(items[k])
        out = []
        grams: dict[int, set[str]] = {}
        for i in sorted(found):
            item_id, n, want = self.items[i]
            if n not in grams:
                grams[n] = {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            shared = len(want & grams[n])
            if shared >= self.threshold * len(want) - 1e-9:
                out.append((item_id, len(want), shared))
        return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int):
    """The benchmark in blocks of bounded size, in id order, each small enough for the driver and every task."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def contained_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item_id, n_shingles, n_shared, containment): documents holding the share ``threshold`` of an item's shingles.

    Shingles are sets of runs of five words. All items are searched for in all whole texts. Null and
    word-less texts and items match nothing; a null id is kept; a repeated document or item row gives
    a row each. A scan of the documents searches for one block of items; documents are never shuffled.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType
    item_kind, item_type = item_kind.simpleString(), to_arrow_type(item_kind)
    found = None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        index = ContainmentIndex(block, shingle, threshold)

        def run(batches, index=index):
            for batch in slices(batches):
                hits = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.search(t)]
                cols = list(zip(*hits, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], item_type), *(pa.array(c, pa.int64()) for c in cols[2:])], ["id", "item_id", "n_shingles", "n_shared"]
                )

        part = kept.mapInArrow(run, f"id {kind}, item_id {item_kind}, n_shingles long, n_shared long")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_col), "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text contains no benchmark item; columns stay as they are."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text", block_chars):
        index = ContainmentIndex(block, shingle, threshold)

        def run(batches, index=index):
            for batch in slices(batches):
                yield batch.filter(pa.array([not index.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: All pairs by exact containment, for DuckDB.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
b AS (SELECT item_id, least(5, len(w)) AS n, w FROM bw WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
bn AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM h JOIN bn USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_shingles - 1e-9
"""
