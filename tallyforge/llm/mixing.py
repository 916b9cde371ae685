"""Mixing sources to target weights: DataFrame functions only.

Every source is cut into blocks of documents. A source's target becomes whole passes over its blocks
and a rest of permuted blocks; a splitting tree of multivariate hypergeometric draws deals the exact
block quotas out to the output shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ensure_checkpoint_dir, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Blocks of a source, and output shards (a power of two).
BLOCKS, SHARDS = 4096, 64


def word_count(text: Column) -> Column:
    """Runs other than ASCII white space in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _code(*parts: Column | str) -> Column:
    """32 hash bits of some columns, null told from empty."""
    md5 = F.md5(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("~")) for p in parts)))
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``most`` times its source's size, and what is left over is shared anew.
    The level at which the sharing ends is found from running sums over the sources ordered by where
    they stop. Windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = per.withColumn("rank", F.expr("row_number() over (order by source asc nulls last)"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    level = (
        ordered.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.expr(f"sum(source_size) over () * {float(share)}D"))
        .withColumn("stops", F.expr("cap / w"))
        .withColumn("low", F.expr("sum(cap) over (order by stops)"))
        .withColumn("high", F.expr("sum(w) over () - sum(w) over (order by stops)"))
        .withColumn("full", F.expr("low + stops * high <= total"))
        .withColumn("left", F.expr("total - sum(if(full, cap, 0D)) over ()"))
        .withColumn("open", F.expr("sum(if(full, 0D, w)) over ()"))
    )
    return level.select("source", "source_size", "n", "rank", F.expr("if(full, cap, least(cap, left * w / open))").alias("target"))


def _log_gamma(x: str) -> str:
    """Stirling's series, shifted so that it holds from 1 on."""
    y = f"({x} + 7D)"
    rest = " * ".join(f"({x} + {i}D)" for i in range(7))
    return f"(({y} - 0.5D) * ln{y} - {y} + 1D / (12D * {y}) - 1D / (360D * {y} * {y} * {y}) - ln({rest}))"


def _hypergeometric(n: str, good: str, drawn: str, u: str) -> str:
    """SQL for one hypergeometric variate by inversion: ``drawn`` of ``n`` items of which ``good`` count.

    The terms within 12 standard deviations of the mean are summed up; the rest weigh under 1e-30.
    """
    def weight(k: str) -> str:
        return " ".join(
            f"- {_log_gamma(f'(cast({v} as double) + 1D)')}"
            for v in (k, f"(x.g - {k})", f"(x.d - {k})", f"(x.n - x.g - x.d + {k})")
        )

    ends = (
        f"transform(array(named_struct('n', {n}, 'g', {good}, 'd', {drawn}, 'u', {u})), x -> struct(x.n, x.g, x.d, x.u, "
        "if(x.n = 0, 0D, x.d * 1D * x.g / greatest(x.n, 1)) as m, "
        "12D * sqrt(if(x.n < 2, 0D, x.d * 1D * x.g / greatest(x.n, 1) * (x.n - x.g) / greatest(x.n, 1) * (x.n - x.d) / greatest(x.n - 1, 1))) + 10D as s))"
    )
    span = (
        f"transform({ends}, x -> struct(x.n, x.g, x.d, x.u, cast(floor(x.m) as bigint) as mode, "
        "greatest(0L, x.d - x.n + x.g, cast(floor(x.m - x.s) as bigint)) as lo, least(x.g, x.d, cast(ceil(x.m + x.s) as bigint)) as hi))"
    )
    span = f"transform({span}, x -> struct(x.n, x.g, x.d, x.u, x.lo, x.hi, greatest(x.lo, least(x.hi, x.mode)) as mode))"
    at_mode = f"transform({span}, x -> struct(x.n, x.g, x.d, x.u, x.lo, x.hi, (0D {weight('x.mode')}) as peak))"
    terms = f"transform({at_mode}, x -> struct(x.u, x.lo, x.hi, transform(sequence(x.lo, x.hi), k -> exp(0D {weight('k')} - x.peak)) as p))"
    goal = f"transform({terms}, x -> struct(x.lo, x.hi, x.p, x.u * aggregate(x.p, 0D, (a, b) -> a + b) as goal))"
    return (
        f"element_at(transform({goal}, x -> least(x.hi, x.lo + aggregate(x.p, struct(0D as c, 0L as k), "
        "(a, b) -> struct(a.c + b as c, a.k + if(a.c + b < x.goal, 1L, 0L) as k), a -> a.k))), 1)"
    )


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(shard, rank, quota): exact quotas of every source for every shard, from rows (rank, quota).

    A node holds the quotas of its shards as one array over the sources (their number, not the
    documents', bounds the row). Its left child takes half the items; how many of each source is a
    multivariate hypergeometric draw, made as one hypergeometric draw after another. The right child
    takes what is left, so quotas add up exactly at every level. Draws are functions of the seed,
    the node and the source.
    """
    node = quotas.groupBy().agg(
        F.expr("transform(array_sort(collect_list(struct(rank, quota))), x -> x.quota)").alias("q")
    ).select(F.lit(1).cast("long").alias("node"), F.coalesce("q", F.array().cast("array<bigint>")).alias("q"))
    uniform = f"(pmod(xxhash64({int(seed)}L, node, i), 1073741789L) + 0.5D) / 1073741789D"
    draw = _hypergeometric("acc.rest", "element_at(q, i)", "acc.need", uniform)
    for _ in range(int(math.log2(shards))):
        left = (
            "aggregate(sequence(1, size(q)), "
            "named_struct('rest', aggregate(q, 0L, (a, b) -> a + b), 'need', cast(ceil(aggregate(q, 0L, (a, b) -> a + b) / 2D) as bigint), 'got', cast(array() as array<bigint>)), "
            f"(acc, i) -> element_at(transform(array({draw}), d -> named_struct('rest', acc.rest - element_at(q, i), 'need', acc.need - d, 'got', concat(acc.got, array(d)))), 1), "
            "acc -> acc.got)"
        )
        left = f"if(size(q) = 0, q, {left})"
        both = f"element_at(transform(array({left}), l -> array(struct(2 * node as node, l as q), struct(2 * node + 1 as node, zip_with(q, l, (a, b) -> a - b) as q))), 1)"
        node = node.select(F.explode(F.expr(both)).alias("x")).select("x.node", "x.q")
    return node.select((F.col("node") - shards).alias("shard"), F.posexplode("q").alias("i", "quota")).select(
        "shard", (F.col("i") + 1).alias("rank"), "quota"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    """Adds the columns that decide: __source, __size, __block, __key."""
    return (
        docs.withColumn("__source", F.col(source_col))
        .withColumn("__size", word_count(F.col(text_col)))
        .withColumn("__block", F.pmod(_code(F.lit(seed), F.lit("block"), id_col), F.lit(blocks)))
        .withColumn("__key", _code(F.lit(seed), F.lit("key"), id_col))
    )


def block_plan(sized: DataFrame, weights=WEIGHTS, share=1.5, most=2.0, blocks=BLOCKS, shards=SHARDS, seed=0) -> DataFrame:
    """One row for each block: (source, block, source_size, target, passes, whole, cut_block, cut_key, shards).

    ``sized`` has (source, size, block, key) of every document. A source takes ``passes`` whole passes,
    then its blocks in permuted order while they fit into the rest; in the block where the rest ends,
    the documents in permuted order up to ``cut_key``, to the nearest document. Only the blocks of a
    source and the documents of one block of each source are ever ordered.
    """
    ensure_checkpoint_dir(sized.sparkSession)
    per_block = sized.groupBy("source", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    targets = source_targets(sized.select("source", "size"), weights, share, most).checkpoint()
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    ordered = per_block.withColumn("perm", _code(F.lit(seed), F.lit("perm"), "source", "block"))
    ordered = (
        ordered.join(targets, same(ordered, targets))
        .select(ordered["*"], "source_size", "target", "rank")
        .withColumn("passes", F.expr("if(source_size > 0, cast(floor(target / source_size) as int), 0)"))
        .withColumn("rest", F.expr("target - passes * source_size"))
        .withColumn("cum", F.expr("sum(size) over (partition by source order by perm, block rows unbounded preceding)"))
        .withColumn("seq", F.expr("row_number() over (partition by source order by perm, block) - 1"))
        .withColumn("n_blocks", F.expr("count(*) over (partition by source)"))
        .withColumn("whole", F.expr("cum <= rest"))
        .withColumn("cut", F.expr("not whole and cum - size < rest"))
        .checkpoint()
    )
    cuts = ordered.where("cut").select("source", "block", F.expr("rest - (cum - size)").alias("room"))
    inside = sized.join(cuts, same(sized, cuts) & (sized["block"] == cuts["block"])).select(sized["source"], "key", "size", "room")
    by_key = inside.groupBy("source", "key", "room").agg(F.sum("size").alias("size"))
    upto = by_key.withColumn("cum", F.expr("sum(size) over (partition by source order by key)"))
    cut_keys = upto.where("cum - size / 2D <= room").groupBy("source").agg(F.max("key").alias("cut_key"))
    drawn = ordered.withColumn("draws", F.expr("passes + if(whole or cut, 1, 0)"))
    quotas = drawn.groupBy("rank").agg(F.sum("draws").alias("quota"))
    dealt = splitting_tree(quotas, shards, seed).withColumn(
        "end", F.expr("sum(quota) over (partition by rank order by shard rows unbounded preceding)")
    )
    slots = dealt.where("quota > 0").select("rank", "shard", F.explode(F.expr("sequence(end - quota, end - 1)")).alias("slot"))
    copies = drawn.where("draws > 0").select(
        "source", "block", "rank", F.posexplode(F.expr("transform(sequence(0, draws - 1), c -> c * n_blocks + (seq + c * 7919) % n_blocks)")).alias("copy", "slot"), "draws", "passes", "n_blocks", "seq"
    )
    # The draw of the rest keeps its place in the permuted order, so that its slots have no gaps.
    copies = copies.withColumn("slot", F.expr("if(copy < passes, slot, passes * n_blocks + seq)"))
    where = copies.join(slots, ["rank", "slot"]).groupBy("source", "block").agg(
        F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> cast(x.shard as int))").alias("shards")
    )
    plan = ordered.join(where, same(ordered, where) & (ordered["block"] == where["block"]), "left").select(ordered["*"], "shards")
    return plan.join(cut_keys, same(plan, cut_keys), "left").select(
        plan["source"], "block", "source_size", "target", "passes", "whole", "cut", "cut_key", "shards"
    )


def with_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.5, most=2.0,
                blocks=BLOCKS, shards=SHARDS, seed=0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` with __size, __source_size, __target, __copies and __shards (of each copy).

    Sizes are word counts, null texts 0. All rows of one id fall into one block and share their fate.
    Null sources form a source of their own, weighed last; null ids are one id. A document of size 0
    may be drawn and takes no word. An empty input gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    cols = docs.columns if keep is None else list(keep)
    keyed = _keyed(docs, id_col, text_col, source_col, blocks, seed)
    sized = keyed.select(*cols, *(c for c in ("__source", "__size", "__block", "__key")))
    if keep is not None:
        sized = sized.checkpoint()
        facts = sized
    else:
        facts = keyed.select("__source", "__size", "__block", "__key").checkpoint()
    facts = facts.select(*(F.col(f"__{c}").alias(c) for c in ("source", "size", "block", "key")))
    plan = block_plan(facts, weights, share, most, blocks, shards, seed).select(
        F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), *(F.col(c).alias(f"__{c}") for c in ("passes", "whole", "cut", "cut_key")), F.col("shards").alias("__all"),
    )
    # Written, so that the planner knows its size: the documents are shuffled only where it is too large to be broadcast.
    plan = written(plan, "mixing-plan")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("~"))  # noqa: E731  an equi-key in which null equals null
    joined = sized.withColumn("__n", name(F.col("__source"))).join(
        plan.withColumn("__m", name(F.col("__s"))), (F.col("__n") == F.col("__m")) & (F.col("__block") == F.col("__b"))
    )
    copies = F.expr("__passes + if(__whole or (__cut and __key <= __cut_key), 1, 0)")
    joined = joined.withColumn("__copies", F.coalesce(copies, F.col("__passes")))
    return joined.select(
        *cols, "__source", "__size", "__source_size", "__target", "__copies", F.expr("slice(coalesce(__all, array()), 1, __copies)").alias("__shards")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every drawn copy of a document as a row, with its shard and its place there.

    Adds ``shard`` and ``shard_key``; rows ordered by shard_key within a shard are shuffled. Columns of
    these names in ``docs`` give way to them.
    """
    docs = docs.drop("shard", "shard_key")
    seed, id_col = how.get("seed", 0), how.get("id_col", "doc_id")
    rows = with_copies(docs, **how).select(*docs.columns, F.posexplode("__shards").alias("__copy", "shard"))
    return rows.withColumn("shard_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("__copy"))).drop("__copy")


def mixed_words(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, size, source_size, target, taken) of every document: taken counts the words of the
    copies that the splitting tree dealt to the shards."""
    return with_copies(docs, id_col=id_col, keep=(id_col,), **how).select(
        id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.size("__shards")).alias("taken"),
    )


#: The digest of ``mixed_words(documents)`` for DuckDB; the shards, which it has not, come from the draws.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0|block|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT % 4096 AS block,
    ('0x' || substr(md5('0|key|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS stops, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM w),
m AS (SELECT *, sum(cap) OVER (ORDER BY stops) + stops * (sum(w) OVER () - sum(w) OVER (ORDER BY stops)) <= total AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap,
    (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target FROM m),
b AS (
  SELECT d.source, block, sum(size)::BIGINT AS size,
    ('0x' || substr(md5('0|perm|' || coalesce(d.source, '~') || '|' || block::VARCHAR), 1, 8))::BIGINT AS perm
  FROM d GROUP BY d.source, block),
o AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS passes,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY perm, block ROWS UNBOUNDED PRECEDING) AS cum
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, target - passes * source_size AS rest FROM o),
p AS (SELECT *, cum <= rest AS whole, cum > rest AND cum - size < rest AS cut FROM r),
k AS (
  SELECT source, max(key) AS cut_key FROM (
    SELECT source, key, size, room, sum(size) OVER (PARTITION BY source ORDER BY key) AS cum FROM (
      SELECT d.source, d.key, p.rest - (p.cum - p.size) AS room, sum(d.size) AS size
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.block = p.block WHERE p.cut GROUP BY ALL))
  WHERE cum - size / 2.0::DOUBLE <= room GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
  d.size * (p.passes + CASE WHEN p.whole OR (p.cut AND coalesce(d.key <= k.cut_key, false)) THEN 1 ELSE 0 END) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.block = p.block
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
