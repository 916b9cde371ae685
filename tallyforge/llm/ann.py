"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ensure_checkpoint_dir, ship_package

#: Neighbours of a node, neighbours-of-neighbours rounds, and random partitions that start the graph.
NEIGHBOURS, ROUNDS, PARTITIONS = 20, 6, 2
#: Nodes of a start cell, about; best nodes a search holds; nodes it widens at a time; entry nodes
#: besides the query's own; bytes of query vectors that one search takes along to every task.
CELL, BEAM, WIDTH, ENTRIES, QUERY_BYTES = 256, 512, 64, 32, 32 << 20


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): ids with a vector that is not null, not all zero, and has finite components only.

    Vectors of another length than that of the smallest id's are left out.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    first = rows.agg(F.min_by(F.size("v"), "id")).first()[0] or 0
    return rows.where(F.size("v") == first)


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """(id, q, s): vectors as bytes of 32-bit floats in units of their largest component, and that; for navigation only."""

    def run(batches):
        for batch in batches:
            x = _floats(batch.column(1), width)
            s = np.abs(x).max(1) if len(x) else np.zeros(0)
            q = (x / s[:, None]).astype(np.float32) if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s)], ["id", "q", "s"])

    return rows.select("id", "v").mapInArrow(run, "id long, q binary, s double")


def _unpack(q: pa.Array, s: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(q.to_pylist()), np.float32).reshape(-1, width)
    return raw * s.to_numpy(zero_copy_only=False)[:, None]


def _best(u: np.ndarray, w: np.ndarray, d: np.ndarray, k: int):
    """The k nearest different w of each u."""
    order = np.lexsort((d, w, u))
    u, w, d = u[order], w[order], d[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, d = u[first], w[first], d[first]
    order = np.lexsort((w, d, u))
    u, w, d = u[order], w[order], d[order]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
    keep = rank < k
    return u[keep], w[keep], d[keep]


def _distances(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(0)  # about their middle, so that small differences of long vectors are not rounded away
    n = (x * x).sum(1)
    return np.maximum(n[:, None] + n[None] - 2 * x @ x.T, 0)


def _edges(u, w, d):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(d.astype(np.float32))], ["u", "w", "d"])


def _start(nodes: DataFrame, width: int, k: int, partitions: int, cell: int, n: int) -> DataFrame:
    """(u, w, d): neighbours within the cells that bisectors of a few sampled pairs of nodes cut out.

    A cell with many nodes is cut further at random, so that no cell grows with the input.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n / cell)))))
    pairs = nodes.orderBy(F.xxhash64(F.lit("pairs"), "id")).limit(2 * bits * partitions).toArrow()
    x = _unpack(pairs["q"].combine_chunks(), pairs["s"].combine_chunks(), width)
    x = x[: len(x) // 2 * 2]
    normal, middle = x[::2] - x[1::2], ((x[::2] ** 2).sum(1) - (x[1::2] ** 2).sum(1)) / 2

    def code(batches):
        for batch in batches:
            side = (_unpack(batch.column("q"), batch.column("s"), width) @ normal.T > middle).astype(np.int64)
            for p in range(partitions):
                mine = side[:, p * bits : (p + 1) * bits]
                cells = mine @ (1 << np.arange(mine.shape[1])) if mine.shape[1] else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p] * batch.num_rows, pa.int32()), pa.array(cells, pa.int64()), *batch.columns], ["p", "cell", "id", "q", "s"])

    coded = nodes.mapInArrow(code, "p int, cell long, id long, q binary, s double")
    sizes = coded.groupBy("p", "cell").agg(F.count("*").alias("n"))
    dealt = coded.join(sizes, ["p", "cell"]).withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.ceil(F.col("n") / cell)))

    def inside(table):
        x, ids = _unpack(table["q"].combine_chunks(), table["s"].combine_chunks(), width), table["id"].to_numpy()
        d = _distances(x)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        if m < 1:
            return pa.Table.from_batches([_edges(ids[:0], ids[:0], d.ravel()[:0])])
        near = np.argpartition(d, m - 1, 1)[:, :m]
        return pa.Table.from_batches([_edges(np.repeat(ids, m), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel())])

    return dealt.select("p", "cell", "salt", "id", "q", "s").groupBy("p", "cell", "salt").applyInArrow(inside, "u long, w long, d float")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """(u, w, d, new): the k nearest of each u; new unless the edge was there before."""
    merged = edges.repartition("u").groupBy("u", "w").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    ranked = merged.withColumn("r", F.expr("row_number() over (partition by u order by d, w)"))
    return ranked.where(F.col("r") <= k).drop("r")


def build_graph(nodes: DataFrame, width: int, k: int = NEIGHBOURS, rounds: int = ROUNDS, partitions: int = PARTITIONS, cell: int = CELL) -> DataFrame:
    """(u, w, d): each node's k nearest found, by NN-descent; d is the squared distance of packed vectors.

    In each round every node is the meeting place of its neighbours and of k of those whose
    neighbour it is: two that meet, one of them new there, are neighbours of neighbours and become
    candidates for each other. The lists and the vectors that meet are joined by Spark; a round's
    graph is checkpointed. Rounds end early once no edge is new.
    """
    n = nodes.count()
    graph = _nearest(_start(nodes, width, k, partitions, cell, n).withColumn("new", F.lit(True)), k).checkpoint()
    for r in range(rounds):
        kth = graph.groupBy("u").agg(F.count("*").alias("n"), F.max("d").alias("d")).select(
            F.col("u").alias("id"), F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")).cast("float")).alias("kth")
        )
        known = nodes.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")).cast("float")))
        back = graph.select(F.col("w").alias("pivot"), F.col("u").alias("id"), "new")
        back = back.withColumn("r", F.expr(f"row_number() over (partition by pivot order by xxhash64({r}, pivot, id))"))
        meets = graph.select(F.col("u").alias("pivot"), F.col("w").alias("id"), "new").union(back.where(F.col("r") <= k).drop("r"))
        members = meets.join(known, "id").select("pivot", "id", "new", "q", "s", "kth")
        members = members.repartition("pivot").sortWithinPartitions("pivot")

        def local_join(batches):
            held: list = []
            count = 0
            rest = None
            for batch in [*_chain(batches), None]:
                if batch is None:
                    table, rest = rest, None
                else:
                    table = batch if rest is None else pa.Table.from_batches([*rest.to_batches(), *batch.to_batches()]).combine_chunks()
                    last = table["pivot"].to_numpy()
                    cut = int(np.searchsorted(last, last[-1]))
                    table, rest = table.slice(0, cut), table.slice(cut)
                if table is None or not table.num_rows:
                    continue
                table = table.combine_chunks()
                pivot, ids = table["pivot"].to_numpy(), table["id"].to_numpy()
                new, far = table["new"].to_numpy(), table["kth"].to_numpy()
                x = _unpack(table["q"].combine_chunks(), table["s"].combine_chunks(), width)
                edges = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    d = _distances(x[a:b])
                    i, j = np.nonzero((new[a:b, None] | new[None, a:b]) & (ids[a:b, None] != ids[None, a:b]) & (d < far[a:b, None]))
                    if len(i):
                        held.append((ids[a + i], ids[a + j], d[i, j]))
                        count += len(i)
                    if count > 1_000_000:
                        yield _edges(*_best(*map(np.concatenate, zip(*held, strict=True)), k))
                        held, count = [], 0
            if held:
                yield _edges(*_best(*map(np.concatenate, zip(*held, strict=True)), k))

        found = members.mapInArrow(local_join, "u long, w long, d float")
        # An edge that was there keeps its distance, and min(new) makes it old.
        graph = _nearest(graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))), k).checkpoint()
        if not graph.where("new").limit(1).count():
            break
    return graph.select("u", "w", "d")


def _chain(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def search_graph(graph: DataFrame, nodes: DataFrame, queries: DataFrame, width: int, beam: int = BEAM, step: int = WIDTH, entries: int = ENTRIES) -> DataFrame:
    """(query, node, d): the ``beam`` nearest nodes that greedy search finds for each query.

    ``queries`` has (query, v, node): a vector and the node to start from, or null; a few nodes drawn
    in a fixed order are starts for all. In each round every search takes the nearest nodes that it
    holds and has not widened, and joins the graph in both directions for their neighbours.
    Searches run side by side in blocks of queries whose vectors fit QUERY_BYTES; all nodes are
    within reach of every block.
    """
    n = queries.count()
    blocks = max(1, -(-n * width * 8 // QUERY_BYTES))
    links = graph.select("u", "w").union(graph.select("w", "u")).distinct().repartition("u").checkpoint()
    starts = nodes.select("id").orderBy(F.xxhash64(F.lit("start"), "id")).limit(entries)
    found = None
    for k in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        table = some.select("query", "v").orderBy("query").toArrow()
        ids = table["query"].to_numpy()
        matrix = _floats(table["v"].combine_chunks(), width)

        def measure(batches, ids=ids, matrix=matrix):
            for batch in batches:
                x = _unpack(batch.column("q"), batch.column("s"), width)
                d = ((x - matrix[np.searchsorted(ids, batch.column("query").to_numpy())]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(d.astype(np.float32))], ["query", "node", "d"])

        def measured(pairs, measure=measure):
            rows = pairs.join(nodes.withColumnRenamed("id", "node"), "node").select("query", "node", "q", "s")
            return rows.mapInArrow(measure, "query long, node long, d float")

        every = some.select("query").crossJoin(F.broadcast(starts.withColumnRenamed("id", "node")))  # a constant number of rows a query
        first = some.where("node is not null").select("query", "node").union(every).distinct()
        pool = _pool(measured(first).withColumn("open", F.lit(True)), beam, step).checkpoint()
        while pool.where("next").limit(1).count():
            front = pool.where("next").select("query", F.col("node").alias("u"))
            reached = front.join(links, "u").select("query", F.col("w").alias("node")).distinct()
            reached = reached.join(pool.select("query", "node"), ["query", "node"], "left_anti")
            held = pool.select("query", "node", "d", (F.col("open") & ~F.col("next")).alias("open"))
            pool = _pool(held.union(measured(reached).withColumn("open", F.lit(True))), beam, step).checkpoint()
        part = pool.select("query", "node", "d")
        found = part if found is None else found.union(part)
    return found


def _pool(rows: DataFrame, beam: int, step: int) -> DataFrame:
    ranked = rows.withColumn("r", F.expr("row_number() over (partition by query order by d, node)")).where(F.col("r") <= beam)
    turn = F.expr(f"open and sum(cast(open as int)) over (partition by query order by d, node rows unbounded preceding) <= {step}")
    return ranked.withColumn("next", turn).drop("r")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM,
    neighbours: int = NEIGHBOURS, rounds: int = ROUNDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all other rows.

    ``queries`` holds rows of ``vectors``. score is the Euclidean distance of the original vectors in
    double precision; ties go to the smaller id. Equal vectors are one node of the graph, so that
    copies, however many, don't crowd a list; a node stands for its k + 1 smallest ids, which are all that
    a result can name. Rows with an unusable vector (see usable) take no part, as query or candidate;
    repeated ids take part once each. Fewer than k others give fewer rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    top = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    rows = usable(vectors, id_col, vec_col)
    copies = rows.withColumn("r", F.expr("row_number() over (partition by v order by id)")).where(F.col("r") <= k + 1)
    copies.withColumn("node", F.expr("min(id) over (partition by v)")).write.parquet(f"{top}/members")
    members = spark.read.parquet(f"{top}/members")
    heads = members.where("r = 1")
    width = len((heads.select("v").first() or [[]])[0])
    out = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], out)
    _packed(heads, width).write.parquet(f"{top}/nodes")
    nodes = spark.read.parquet(f"{top}/nodes")
    asked = usable(queries, id_col, vec_col).join(heads.select("v", "node"), "v").select(F.col("id").alias("query"), "v", "node").checkpoint()
    graph = build_graph(nodes, width, neighbours, rounds)
    pool = search_graph(graph, nodes, asked, width, beam)
    # The whole pool is measured on the originals.
    pairs = pool.select("query", "node").join(asked.select("query", F.col("v").alias("a")), "query")
    pairs = pairs.join(members.select("node", "id", F.col("v").alias("b")), "node").where("query <> id")

    def exact(batches):
        for batch in batches:
            d = np.sqrt(((_floats(batch.column("a"), width) - _floats(batch.column("b"), width)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(d)], ["query", "id", "score"])

    scored = pairs.select("query", "id", "a", "b").mapInArrow(exact, "query long, id long, score double")
    ranked = scored.withColumn("rank", F.expr("row_number() over (partition by query order by score, id)")).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
