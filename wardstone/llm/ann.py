"""Approximate nearest neighbours: a robust-pruned directed graph per shard.

Distinct vectors are dealt to shards of about ``shard_rows``. In each shard, greedy searches from a middle vector
propose neighbours for every vector, and relaxed pruning keeps a proposal only if no kept neighbour is closer to it
by the factor ``alpha``, so edges stay few and point in diverse directions. Queries go through every shard in blocks;
a beam search answers each, and the best of all shards are merged. Beams of many queries advance together in numpy.

Nearness is the inner product: inside a shard, vectors get one more component that makes all norms equal, which
turns the largest product into the least distance. Scores are recomputed in double precision on the originals.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; equal vectors are one node that carries its ``k + 1`` least ids, so ties go to the least ids and big
groups of copies cost one node; repeated ids are rows of their own; vectors only meet vectors of their length; an
empty table gives an empty result; further columns are not looked at.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import settled
from wardstone.operators.skew import topk_per_key


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a last component that gives all of them the greatest norm."""
    square = (vectors**2).sum(1)
    return np.hstack([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)


def beam_search(nodes: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int):
    """Per query the best ``beam`` nodes met (ids with -1 for none, best first) and the trail of expanded nodes."""
    m, n = len(queries), len(nodes)
    ids, sims, live = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
    ids[:, 0], sims[:, 0], live[:, 0] = entry, queries @ nodes[entry], True
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    trail = []
    active = np.arange(m)
    while len(active):
        pick = np.where(live[active], sims[active], -np.inf).argmax(1)
        now = ids[active, pick]
        live[active, pick] = False
        trail.append((active, now))
        around = graph[now]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        r, c = np.nonzero(fresh)
        seen[active[r], around[r, c]] = True
        found = np.full(around.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", nodes[around[r, c]], queries[active[r]])
        every = np.concatenate([sims[active], found], 1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], around], 1), top, 1)
        live[active] = np.take_along_axis(np.concatenate([live[active], fresh], 1), top, 1)
        sims[active] = np.take_along_axis(every, top, 1)
        active = active[live[active].any(1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), trail


def robust_prune(node: int, proposed: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse near neighbours: a proposal goes if a kept one is ``alpha`` times closer to it than the node is."""
    proposed = proposed[proposed != node]
    if len(proposed) <= 1:
        return proposed
    level = float(nodes[node] @ nodes[node])
    away = 2 * (level - nodes[proposed] @ nodes[node])
    order = np.argsort(away, kind="stable")
    proposed, away = proposed[order], away[order]
    between = 2 * (level - nodes[proposed] @ nodes[proposed].T) * (alpha * alpha)
    alive, kept = np.ones(len(proposed), bool), []
    for i in range(len(proposed)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= between[i] > away
    return proposed[kept]


def build_graph(nodes: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 3) -> tuple[np.ndarray, int]:
    """Neighbours of every node (-1 for none) and the entry node. Starts from random edges; nodes are inserted in batches."""
    n, room = len(nodes), degree + degree // 2
    rng = np.random.default_rng(seed)
    graph = np.full((n, room), -1, np.int32)
    entry = int((nodes @ nodes.mean(0)).argmax())
    if n <= degree + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph, entry
    for i in range(n):
        some = np.unique(rng.integers(0, n, degree // 2))
        graph[i, : len(some)] = some
    order = rng.permutation(n)
    for a in range(0, n, 256):
        batch = order[a : a + 256]
        _, trail = beam_search(nodes, graph, entry, nodes[batch], beam)
        met = [[] for _ in batch]
        for rows, at in trail:
            for r, node in zip(rows.tolist(), at.tolist(), strict=True):
                met[r].append(node)
        for r, node in enumerate(batch.tolist()):
            own = graph[node]
            kept = robust_prune(node, np.unique(np.concatenate([met[r], own[own >= 0]])).astype(np.int64), nodes, degree, alpha)
            graph[node] = -1
            graph[node, : len(kept)] = kept
            for other in kept.tolist():
                theirs = graph[other]
                if node in theirs:
                    continue
                used = int((theirs >= 0).sum())
                if used < room:
                    graph[other, used] = node
                    continue
                less = robust_prune(other, np.append(theirs, node).astype(np.int64), nodes, degree, alpha)
                graph[other] = -1
                graph[other, : len(less)] = less
    return graph, entry


GRAPH = "dim int, shard long, vectors binary, graph binary, entry int, ids array<array<long>>"
HITS = "qid long, vec_id long, score double"


def _built(table: pa.Table, degree: int, beam: int, alpha: float) -> pa.Table:
    """One row with the shard's vectors, graph and ids."""
    vectors = np.array(table.column("embedding").to_pylist(), np.float64)
    graph, entry = build_graph(levelled(vectors), degree, beam, alpha)
    return pa.table({
        "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": table.column("shard").slice(0, 1).cast(pa.int64()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "graph": pa.array([graph.tobytes()], pa.binary()), "entry": pa.array([entry], pa.int32()), "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
    })


def _answered(batches, k: int, beam: int):
    """For each (shard, block of queries) row: every query's best ``k`` rows of the shard."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            dim = get("dim")
            vectors = np.frombuffer(get("vectors"), np.float64).reshape(-1, dim)
            graph = np.frombuffer(get("graph"), np.int32).reshape(len(vectors), -1)
            ids, asked = get("ids"), get("asked")
            queries = np.array([q["embedding"] for q in asked], np.float64).reshape(-1, dim)
            flat = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
            best, _ = beam_search(levelled(vectors), graph, get("entry"), flat, min(beam, max(k, len(vectors))))
            out = []
            for q, nodes in zip(range(len(queries)), best, strict=True):
                nodes = nodes[nodes >= 0][:k]
                scores = (vectors[nodes] * queries[q]).sum(1)
                rows = sorted((-s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for v in ids[node])[:k]
                out += [(asked[q]["qid"], v, -s) for s, v in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["qid", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    wide = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0.0)
    return vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding")).filter(fine)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 4096, block_rows: int = 1024, degree: int = 24, build_beam: int = 48, beam: int = 64, alpha: float = 1.2
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the ``k`` nearest found among all rows but its own id.

    Both tables hold ``vec_id, embedding``. Work is queries times shards, a beam each; it is dealt out as one task
    per shard and block of queries, so neither side has to fit in one place.
    """
    rows = usable(vectors)
    ids = topk_per_key(rows, ["embedding"], [F.col("vec_id")], k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = settled(ids.withColumn("dim", F.size("embedding")))
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")))

    def build(table: pa.Table) -> pa.Table:
        return _built(table, degree, build_beam, alpha)

    graphs = settled(placed.select("dim", "shard", "embedding", "ids").groupBy("dim", "shard").applyInArrow(build, GRAPH))

    asking = usable(queries).withColumnRenamed("vec_id", "query_id")
    distinct = settled(asking.groupBy("embedding").agg(F.min("query_id").alias("qid")).withColumn("dim", F.size("embedding")))
    blocks = distinct.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    dealt = distinct.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "embedding"), F.col("blocks")))
    asked = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("qid", "embedding")).alias("asked"))
    work = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    hits = work.join(graphs, ["dim", "shard"]).repartition("shard", "block").mapInArrow(partial(_answered, k=k + 1, beam=beam), HITS)
    best = settled(topk_per_key(hits, ["qid"], [F.col("score").desc(), F.col("vec_id")], k + 1, rank_col="_r"))
    back = asking.join(distinct.select("embedding", "qid"), "embedding").select("query_id", "qid")
    found = back.join(best, "qid").filter("vec_id != query_id")
    return topk_per_key(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
