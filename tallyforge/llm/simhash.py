"""SimHash near-duplicate detection by a binary-trie self-join of the fingerprints."""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.batches import slices
from tallyforge.operators.components import connected_components
from tallyforge.session import ensure_checkpoint_dir, ship_package

BITS = 64
SEED = 42
#: Fingerprints per trie node at the depth where the trie is dealt out to tasks, on average.
NODE_SIZE = 1 << 14
#: A node pair with at most this many leaf pairs is compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs that one step of the traversal widens at a time; bounds a task's memory.
FRONTIER = 1 << 17


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a text, as a signed integer; zero if the text has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), "<u8")
    # One byte lane per bit; 255 rows at most are added before a lane could overflow.
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    partial_sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    ones = partial_sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a long.

    Words are runs other than ASCII white space, A-Z lower-cased; shingles count as often as they
    occur. A null or empty text has fingerprint zero. Rows with a null id and repeated rows keep
    their own row. Extra columns are ignored.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def _labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest index of each component, given labels so far and further links."""
    while len(u):
        low = np.minimum(labels[u], labels[v])
        new = labels.copy()
        np.minimum.at(new, labels[u], low)
        np.minimum.at(new, labels[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, labels):
            break
        labels = new
        differ = labels[u] != labels[v]
        u, v = u[differ], v[differ]
    return labels


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, apart: int, budget: int, labels: np.ndarray):
    """Traverse two trie nodes together and yield the index pairs of leaves within ``budget`` bits.

    ``left`` and ``right`` are the sorted fingerprints below the nodes, ``right`` None for a node
    with itself; all below a node share its first ``depth`` bits, and the nodes differ in ``apart`` of
    them. A node pair widens into the pairs of its children with the differing bits added up; it
    goes once they exceed the budget, or once all leaves below it have one label already, so that
    a dense ball of near copies costs no pair for each pair of its members. ``labels`` covers left,
    then right.
    """
    own = right is None
    b = left if own else right
    shift = 0 if own else len(left)
    changes_a = np.concatenate(([0], np.cumsum(labels[1 : len(left)] != labels[: len(left) - 1])))
    lab_b = labels[shift : shift + len(b)]
    changes_b = np.concatenate(([0], np.cumsum(lab_b[1:] != lab_b[:-1])))
    start = np.array([[0, len(left), 0, len(b), apart]], dtype=np.int64)
    stack = [(depth, start)]
    while stack:
        at, front = stack.pop()
        if len(front) > FRONTIER:
            stack.append((at, front[FRONTIER:]))
            front = front[:FRONTIER]
        a0, a1, b0, b1, d = front.T
        one = (changes_a[a1 - 1] == changes_a[a0]) & (changes_b[b1 - 1] == changes_b[b0]) & (labels[a0] == lab_b[b0])
        if one.any():
            front = front[~one]
            a0, a1, b0, b1, d = front.T
        area = (a1 - a0) * (b1 - b0)
        leaf = area <= LEAF_PAIRS if at < BITS else np.ones(len(front), bool)
        if leaf.any():
            n = area[leaf]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((b1 - b0)[leaf], n)
            i, j = np.repeat(a0[leaf], n) + k // wide, np.repeat(b0[leaf], n) + k % wide
            near = np.bitwise_count(left[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near] + shift
            front = front[~leaf]
            a0, a1, b0, b1, d = front.T
        if not len(front):
            continue
        bit, high = np.uint64(1 << (BITS - 1 - at)), np.uint64((~((1 << (BITS - at)) - 1)) & ((1 << BITS) - 1))
        ma = np.clip(np.searchsorted(left, (left[a0] & high) | bit), a0, a1)
        mb = np.clip(np.searchsorted(b, (b[b0] & high) | bit), b0, b1)
        same = own & (a0 == b0)
        parts = [
            np.stack([a0, ma, b0, mb, d], 1),
            np.stack([ma, a1, mb, b1, d], 1),
            np.stack([a0, ma, mb, b1, d + 1], 1),
            np.stack([ma, a1, b0, mb, d + 1], 1)[~same],
        ]
        front = np.concatenate(parts)
        front = front[(front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2]) & (front[:, 4] <= budget)]
        if len(front):
            stack.append((at + 1, front))


def join_nodes(lo: int, hi: int, depth: int, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint it reaches here) for one pair of trie nodes."""
    fps = np.unique(fps.view(np.uint64))
    node = (fps >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(fps), np.int64)
    left = fps[node == lo]
    right = None if lo == hi else fps[node == hi]
    every = left if right is None else np.concatenate([left, right])
    labels = np.arange(len(every))
    if len(left) and (right is None or len(right)):
        for budget in range(1, max_bits + 1):  # small distances first: what they join need not be compared again
            for i, j in trie_links(left, right, depth, (lo ^ hi).bit_count(), budget, labels):
                labels = _labels(len(every), i, j, labels)
    moved = labels != np.arange(len(every))
    return every[moved].view(np.int64), every[labels[moved]].view(np.int64)


def fingerprint_components(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root) for every fingerprint that links to another one, by a binary-trie self-join.

    The trie is cut at a depth where a node holds NODE_SIZE fingerprints on average. Every node
    meets the nodes whose prefix differs from its own in at most ``max_bits`` bits, as one group
    each; within it the two subtrees are traversed together. A group returns a star for each local
    component, never its pairs, and the stars of all groups are joined by connected_components.
    Null fingerprints are ignored.
    """
    ship_package(fps.sparkSession)
    ensure_checkpoint_dir(fps.sparkSession)
    distinct = fps.select("fp").where("fp is not null").distinct()
    n = distinct.count()
    depth = min(14, max(3, math.ceil(math.log2(max(n, 1) / NODE_SIZE)) if n else 3))
    masks = [sum(1 << b for b in c) for k in range(max_bits + 1) for c in combinations(range(depth), k)]
    node = F.shiftrightunsigned("fp", BITS - depth).cast("int")
    dealt = (
        distinct.select("fp", node.alias("node"))
        .select("fp", "node", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
        .select("fp", F.col("node").alias("x"), F.col("node").bitwiseXOR(F.col("mask")).alias("y"))
        .select("fp", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    )

    def run(key, group):
        u, v = join_nodes(key[0].as_py(), key[1].as_py(), depth, group.column("fp").to_numpy(), max_bits)
        return pa.table({"a": u, "b": v})

    stars = dealt.groupBy("lo", "hi").applyInArrow(run, "a long, b long")
    return connected_components(stars).select(F.col("vertex").alias("fp"), F.col("component").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id): the near-duplicate class of every document.

    component_id is the smallest id reachable by links of at most ``max_bits`` differing bits. Texts
    without a word share fingerprint zero. A null id is kept and takes no part in the minimum (the
    class of null ids alone is null); repeated ids share what their rows link to only through their
    fingerprints. An empty input gives an empty result. Extra columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    roots = fingerprint_components(fps, max_bits)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(component, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """The documents of which each near-duplicate class keeps its smallest id, all columns unchanged.

    Repeated rows of one id count as one document and leave one row. Rows with a null id stay, as
    nothing can name them.
    """
    heads = near_duplicates(docs, id_col, text_col, max_bits).where(F.col(id_col) == F.col("component_id"))
    named = docs.join(heads.select(id_col).distinct(), id_col, "left_semi").dropDuplicates([id_col])
    return named.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
