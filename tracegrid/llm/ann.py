"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Equal vectors become one node that carries the smallest vec_ids of its rows, as many as a result can use,
so a vector that fills much of the table costs one node. Nodes are dealt by hash into shards of about
``SHARD_NODES``. A shard's graph starts at random; batches of nodes then search it greedily from the node
nearest to the mean, and what a search meets is proposed as neighbours. Relaxed distance pruning keeps the
nearest proposal and drops those that it covers, being ``ALPHA`` times nearer to it than to the node, and so
on, which leaves at most ``DEGREE`` diverse edges; reverse edges are added and pruned likewise. All rows are
indexed; nothing is sampled. Queries run a beam search of width ``BEAM`` in every shard, in blocks of
``QUERY_BLOCK``; the distances returned are recomputed on the original vectors in double precision.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, as
queries or as candidates; vectors are compared only with those of their own length; rows that repeat vec_id
and vector count once; a null vec_id takes no part; ties go to the smaller vec_id; fewer candidates than asked
for give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.llm.runtime import materialised

NEAREST = 10
SHARD_NODES = 4096
DEGREE = 32
WIDTH = 48
BEAM = 96
BUILD_BEAM = 64
ALPHA = 1.2
EXPAND = 4
BATCH = 256
QUERY_BLOCK = 1024
GROUP_BLOCKS = 16
INDEX = "shard long, dim int, n int, start int, vectors binary, graph binary, ids array<array<long>>"


# ---------------------------------------------------------------- graph


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest nodes met, nearest first, and their squared distances; -1 pads."""
    n, b = len(x), len(q)
    norm = np.einsum("nd,nd->n", x, x)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    own = np.einsum("bd,bd->b", q, q)
    ids[:, 0], open_[:, 0], seen[:, start] = start, True, True
    dist[:, 0] = norm[start] - 2 * (q @ x[start]) + own
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return ids, dist
        wait = np.where(open_[rows], dist[rows], np.inf)
        k = min(EXPAND, width)
        at = np.argpartition(wait, k - 1, axis=1)[:, :k]
        valid = np.isfinite(np.take_along_axis(wait, at, 1))
        nodes = np.where(valid, ids[rows[:, None], at], -1)
        open_[rows[:, None], at] = False
        next_ = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(rows), -1)
        safe = np.maximum(next_, 0)
        fresh = (next_ >= 0) & ~seen[rows[:, None], safe]
        # one of equal proposals is enough
        order = np.argsort(next_, axis=1, kind="stable")
        ordered = np.take_along_axis(next_, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        node = next_[r, c]
        seen[rows[r], node] = True
        d = np.full(next_.shape, np.inf, np.float32)
        d[r, c] = norm[node] - 2 * np.einsum("kd,kd->k", x[node], q[rows[r]]) + own[rows[r]]
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], np.where(fresh, next_, -1)], axis=1)
        all_o = np.concatenate([open_[rows], fresh], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.take_along_axis(all_i, best, 1)
        open_[rows] = np.take_along_axis(all_o, best, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of its row of proposals; -1 pads."""
    out = np.full((len(nodes), degree), -1, np.int64)
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    proposed[proposed == nodes[:, None]] = -1
    v = x[np.maximum(proposed, 0)]
    norm = np.einsum("bcd,bcd->bc", v, v)
    to_node = norm - 2 * np.einsum("bcd,bd->bc", v, x[nodes]) + np.einsum("bd,bd->b", x[nodes], x[nodes])[:, None]
    between = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = proposed >= 0
    rows = np.arange(len(nodes))
    for k in range(degree):
        d = np.where(alive, to_node, np.inf)
        at = d.argmin(axis=1)
        some = np.isfinite(d[rows, at])
        if not some.any():
            break
        out[some, k] = proposed[rows[some], at[some]]
        alive &= ~((alpha * alpha * between[rows, at] <= to_node) & some[:, None])
        alive[rows, at] = False
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The graph (a row of neighbours for each node, -1 pads) and the node where searches start."""
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, WIDTH), -1, np.int64)
    rng = np.random.default_rng(n)
    if n > 1:
        graph[:, : DEGREE // 2] = (np.arange(n)[:, None] + rng.integers(1, n, (n, DEGREE // 2))) % n
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        nodes = order[at : at + BATCH]
        met, _ = beam_search(x, graph, start, x[nodes], BUILD_BEAM)
        kept = robust_prune(x, nodes, np.concatenate([met, graph[nodes]], axis=1))
        graph[nodes] = -1
        graph[nodes, :DEGREE] = kept
        src = np.repeat(nodes, kept.shape[1])[kept.ravel() >= 0]
        dst = kept.ravel()[kept.ravel() >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        have = (graph[targets] >= 0).sum(axis=1)
        room = have + count <= WIDTH
        nth = np.arange(len(dst)) - np.repeat(first, count)
        free = np.repeat(room, count)
        graph[dst[free], (np.repeat(have, count) + nth)[free]] = src[free]
        full = np.flatnonzero(~room)
        for k in range(0, len(full), BATCH):
            part = full[k : k + BATCH]
            extra = np.full((len(part), int(count[part].max())), -1, np.int64)
            for i, t in enumerate(part):
                extra[i, : count[t]] = src[first[t] : first[t] + count[t]]
            graph[targets[part]] = np.pad(robust_prune(x, targets[part], np.concatenate([graph[targets[part]], extra], axis=1)), ((0, 0), (0, WIDTH - DEGREE)), constant_values=-1)
    return graph, start


# ---------------------------------------------------------------- over tables


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, repeated rows once."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = F.exists(v, lambda c: c != 0)
    ok = embeddings.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.size(v) > 0).filter(finite).filter(some)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def build_index(embeddings: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """One row for each shard: its vectors, its graph and the vec_ids of each node."""
    rows = usable(embeddings).distinct()
    least = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= nearest + 1)
    nodes = materialised(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // SHARD_NODES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        v = whole["vector"].combine_chunks()
        x = v.flatten().to_numpy().reshape(len(v), -1)
        graph, start = build_graph(x.astype(np.float32))
        ids = whole["ids"].combine_chunks()
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        cols = [pa.array([whole["shard"][0].as_py()], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([start], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([graph.astype(np.int32).tobytes()], pa.binary()), one]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "dim", "n", "start", "vectors", "graph", "ids"])

    dealt = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    return materialised(dealt.groupBy("shard", "dim").applyInArrow(build, INDEX), "ann-index")


def _blocks_of(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries packed into blocks (block, dim, their ids, their vectors one after the other), and how many blocks there are."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    rows = F.array_sort(F.collect_list(F.struct("query_id", "vector")))
    return packed.groupBy("block", "dim").agg(rows.alias("q")).select("block", "dim", F.col("q.query_id").alias("query_ids"), F.flatten(F.col("q.vector")).alias("query_vectors")), blocks


def search(index: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries(query_id, vector)`` the nearest found in any shard.

    Every block of queries visits every shard, so the work is shards times blocks and grows with the product of
    both tables. Each pair of a shard and a group of ``GROUP_BLOCKS`` blocks is a key of its own: no task holds more
    than one shard and one group, and pairs spread over all tasks whatever the dimensions.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for row in left.to_pylist():
            x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
            graph = np.frombuffer(row["graph"], np.int32).reshape(row["n"], WIDTH)
            small = x.astype(np.float32)
            for block in right.to_batches(max_chunksize=1):
                ids = block.column("query_ids")[0].values.to_numpy()
                q = block.column("query_vectors")[0].values.to_numpy().reshape(-1, row["dim"])
                for at in range(0, len(q), BATCH):
                    part = q[at : at + BATCH]
                    met, _ = beam_search(small, graph, row["start"], part.astype(np.float32), BEAM)
                    for i, found in enumerate(met):
                        own = int(ids[at + i])
                        found = found[found >= 0]
                        exact = np.sqrt(((x[found] - part[i]) ** 2).sum(axis=1))
                        best = sorted((d, v) for d, k in sorted(zip(exact.tolist(), found.tolist()))[: nearest + 1] for v in row["ids"][k] if v != own)
                        for d, v in best[:nearest]:
                            out[0].append(own), out[1].append(v), out[2].append(d)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    packed, blocks = _blocks_of(queries)
    shards = index.agg(F.max("shard")).first()[0]
    groups = -(-blocks // GROUP_BLOCKS)
    key = ["shard", "dim", "part"]
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy(*key)
    right = packed.withColumn("part", F.floor(F.col("block") / F.lit(GROUP_BLOCKS)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards or 0)))).groupBy(*key)
    found = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_search(embeddings: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """The brute-force result that recall is measured against; for small tables."""
    rows = usable(embeddings).distinct()
    both = F.broadcast(queries).join(rows, (F.size("vector") == F.size("query_vector")) & (F.col("vec_id") != F.col("query_id")))
    apart = F.sqrt(F.aggregate(F.zip_with("vector", "query_vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return both.select("query_id", "vec_id", apart.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)


def nearest_neighbours(embeddings: DataFrame, every: int = 100, nearest: int = NEAREST) -> DataFrame:
    """Index all of ``embeddings`` and search it for its rows whose vec_id is divisible by ``every``."""
    queries = usable(embeddings).filter(F.pmod("vec_id", F.lit(every)) == 0).distinct().withColumnRenamed("vec_id", "query_id")
    return search(build_index(embeddings, nearest), queries, nearest)
