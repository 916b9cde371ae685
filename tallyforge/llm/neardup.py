"""Near-duplicate texts: SimHash classes verified on the texts, and a prefix-filter self-join of shingles for what they miss."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import simhash
from tallyforge.llm.batches import slices
from tallyforge.llm.decontam import shingle_codes
from tallyforge.operators.components import connected_components
from tallyforge.session import scratch, ship_package, written

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles are ordered by how often they occur in one of SAMPLE texts, as far as they are among the
#: COMMON most frequent; the order decides on the cost only, never on what is found.
SAMPLE, COMMON = 32, 100_000
#: Bits of a set's parity map.
BITS = 1024
#: Rounds in which members of a shingle's list meet one of them only, before all that are still apart meet.
STARS = 2


def _words(text: str | None) -> list[bytes]:
    """Runs other than ASCII white space, A-Z lower-cased, as for the fingerprints."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """The set of runs of ``size`` words; a shorter text is one shingle of all its words."""
    words = _words(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def similar(a: set, b: set, threshold: float = THRESHOLD) -> bool:
    """Whether the Jaccard similarity reaches the threshold; two empty sets are equal."""
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def _codes(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit codes of the shingles, each once."""
    import xxhash

    words = _words(text)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(shingle_codes(codes, max(1, min(size, len(words)))))


def _parity(codes: np.ndarray) -> np.ndarray:
    """BITS bits as longs, each of them the parity of the number of codes that fall on it.

    A code that only one of two sets has changes one bit, so two maps differ in no more bits than the
    sets have codes that the other lacks.
    """
    at = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def _common(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of frequent shingles and their counts, from one of SAMPLE texts."""

    def run(batches):
        for batch in slices(batches):
            found = [_codes(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["token"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    codes, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(id, text, node, n, bits, prefix): a hash of the shingle set, its size, its parity map, and its rarest shingles.

    Of sets a and b with similarity t or more, at most |a| - ceil(t |a|) shingles of a are not in b. So
    the first |a| - ceil(t |a|) + 1 of a and the like of b, in one order of all shingles, have one in common.
    Of rows with one shingle set, a task gives the first its prefix only.
    """
    common, counts = _common(docs, text_col, size)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import xxhash

        seen = set()
        for batch in slices(batches):
            nodes, sizes, bits, prefixes = [], [], [], []
            for t in batch.column(1).to_pylist():
                codes = _codes(t, size)
                often = np.zeros(len(codes), np.int64)
                if len(common):
                    at = np.searchsorted(common, codes)
                    at[at == len(common)] = 0
                    often = np.where(common[at] == codes, counts[at], 0)
                n = len(codes)
                nodes.append(xxhash.xxh64_intdigest(codes.tobytes()))
                sizes.append(n)
                bits.append(_parity(codes))
                first = 0 if nodes[-1] in seen else n - math.ceil(threshold * n - 1e-9) + 1
                seen.add(nodes[-1])
                prefixes.append(codes[np.argsort(often, kind="stable")][:first].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = lambda ends, parts: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                    lists(np.arange(len(bits) + 1) * (BITS // 64), bits), lists(ends, prefixes),
                ],
                ["id", "text", "node", "n", "bits", "prefix"],
            )

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string, node long, n int, bits array<long>, prefix array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar, by their shingles themselves."""
    # Written, so that the planner knows their number: the other texts are shuffled only where it is large.
    asked = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    texts = sets.select("node", "text").join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    rows = pairs.join(one, "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        last, held = None, set()
        for batch in slices(batches):
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, held = b, shingles(y, size)
                keep.append(similar(shingles(x, size), held, threshold))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _possible(threshold: float) -> str:
    """SQL: sets of sizes na and nb, of whose prefixes ``shared`` shingles are common, may reach the similarity.

    A shingle that both sets have is in both prefixes, unless it comes after the end of the one that ends
    first. So no more than ``shared`` and what that set has beyond its prefix are common.
    """
    beyond = lambda n: f"ceil({threshold} * {n} - 1e-9) - 1"
    return f"shared + greatest({beyond('na')}, {beyond('nb')}) >= {threshold} / (1 + {threshold}) * (na + nb) - 1e-6"


def _worth_a_look(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b, na, nb, shared) whose parity maps don't rule the similarity out.

    Sets that reach it have at most (1 - t) / (1 + t) of their sizes' sum in only one of them.
    """
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("xs")), "a").join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("ys")), "b")
    apart = " + ".join(f"bit_count(xs[{i}] ^ ys[{i}])" for i in range(BITS // 64))
    return both.where(f"{apart} <= {1 - threshold} / {1 + threshold} * (na + nb) + 1e-6").select("a", "b", "shared")


def _folds() -> tuple[str, str]:
    """SQL of a parity map of 128 bits, folded from that of BITS: two longs f0 and f1."""
    return tuple(" ^ ".join(f"bits[{i}]" for i in range(k, BITS // 64, 2)) for k in (0, 1))


def _near(threshold: float) -> str:
    """SQL: the folded maps of two nodes (f0, f1 and g0, g1) don't rule the similarity out, by the same count as in _worth_a_look."""
    return f"bit_count(f0 ^ g0) + bit_count(f1 ^ g1) <= {1 - threshold} / {1 + threshold} * (na + nb) + 1e-6"


def _lists(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, weight, node, n, f0, f1): the members of prefix shingles that several nodes have, with their folded parity maps.

    Shingles with the same members are one list, named by the smallest of them, and their number is its
    weight. Members are compared by their number and 128 bits of hashes.
    """
    listed = sets.select("node", F.explode("prefix").alias("token")).repartition("token").distinct()
    code = lambda i: F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"code{i}")
    several = listed.groupBy("token").agg(F.count("*").alias("members"), code(1), code(2)).where("members > 1")
    kept = several.groupBy("members", "code1", "code2").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
    f0, f1 = _folds()
    return listed.join(kept.select("token", "weight"), "token").join(nodes.selectExpr("node", "n", f"{f0} AS f0", f"{f1} AS f1"), "node").select("token", "weight", "node", "n", "f0", "f1")


def _fingerprint_links(sets: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b): nodes that SimHash fingerprints put into one class, each with the class's least node, as far as their texts are similar."""
    fps = written(simhash.fingerprints(sets, "node", "text").distinct(), "fingerprints")
    classed = fps.join(simhash.fingerprint_components(fps), "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("id").alias("b"))
    pairs = classed.join(least, "root").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return written(_verified(written(pairs, "pairs"), sets, size, threshold), "links")


def links(sets: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): verified links whose components are those of all pairs of similar nodes.

    Classes of SimHash fingerprints come first, as by op1, and their similar texts are components before any shingle is
    compared. For what the fingerprints miss, members of a shingle's list meet the list's leader, so that a dense group is one component
    before its pairs are asked for; which of them are worth a look is judged by the lists they lead. Then
    all pairs with a common prefix shingle meet whose nodes are in different components, without those
    whose sizes, common prefix shingles or parity maps cannot reach the threshold.
    """
    nodes = written(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "shingle-nodes")
    lists = written(_lists(sets, nodes), "shingle-lists")
    sized = f"least(na, nb) >= {threshold} * greatest(na, nb) - 1e-9"
    labels = lambda found: written(connected_components(found), "labels").select(F.col("vertex").alias("node"), F.col("component").alias("label"))
    found = _fingerprint_links(sets, size, threshold)
    roots = labels(found)
    for r in range(STARS + 1):
        open_lists = lists.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = open_lists.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        open_lists = open_lists.join(apart.select("token"), "token")
        if r < STARS:
            order = F.xxhash64(F.lit(r), "node")
            leaders = open_lists.groupBy("token").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("f0").alias("g0"), F.col("f1").alias("g1")), order).alias("x"))
            met = open_lists.join(leaders.select("token", "x.*"), "token").where("label <> lb").withColumnsRenamed({"node": "a", "n": "na"}).where(sized).where(_near(threshold))
            met = met.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(_possible(threshold))
            met = _worth_a_look(written(met, "met"), nodes, threshold)
            met = met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        else:
            open_lists = written(open_lists, "open-lists")
            x = open_lists.select("token", "weight", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), "f0", "f1")
            y = open_lists.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
            met = x.join(y, "token").where("a < b and la <> lb").where(sized).where(_near(threshold))
            met = met.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(_possible(threshold))
            met = _worth_a_look(written(met, "met"), nodes, threshold)
        more = written(_verified(written(met.select("a", "b"), "pairs"), sets, size, threshold), "links")
        found = found.union(more)
        if r < STARS:
            roots = labels(found)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which each near-duplicate class keeps its smallest id, all columns unchanged.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least
    ``threshold``; classes are what links connect, and no link is missed. Texts without a word are equal. Sets
    are told apart by 64-bit hashes: of two different ones, equal hashes have a chance of 2^-64.
    Repeated rows of one id count as one document and leave one row. Rows with a null id stay, as
    nothing can name them, and take no part in the smallest id.
    """
    ship_package(docs.sparkSession)
    with scratch(docs.sparkSession):
        sets = written(_sets(docs, id_col, text_col, size, threshold), "shingle-sets")
        roots = connected_components(links(sets, size, threshold)).select(F.col("vertex").alias("node"), F.col("component").alias("label"))
        nodes = sets.groupBy("node").agg(F.min("id").alias("least"))
        heads = nodes.join(roots, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
        heads = heads.checkpoint()
    # An id goes by the class of its rows; one that heads a class stays.
    named = docs.join(heads.select(F.col("least").alias(id_col)).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi")
    return named.dropDuplicates([id_col]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
