"""Near-duplicate embeddings by range search in a robust-pruned flat graph.

1.  Vectors are normalised; equal ones are collapsed.  Cluster centres come from Lloyd steps over all vectors, and every
    vector goes to its `overlap` nearest clusters, so clusters overlap.  A cluster beyond `shard_rows` is cut into hashed
    blocks and each pair of blocks is a shard: tight groups larger than a shard lose no pair.
2.  In each shard every node gets its nearest candidates and some far ones, thinned by robust pruning (a candidate goes
    if a kept one is nearer to it by the factor ALPHA than the node is); edges are made symmetric, hubs pruned again.
3.  The adjacency lists of a node from all its shards are united.  A shard is searched on the united lists of its members
    with the vectors of their neighbours in other shards: from the shard's medoid a beam search descends to the query,
    then the search expands every node within range until no new one appears.  Every vector is a query in its nearest cluster.
4.  Every found pair is verified in double precision.  An audit compares the pairs of `audit` vectors (smallest hash of the
    id; their number is a parameter, and grows up to AUDIT_MOST until TRUE_PAIRS pairs are seen) with brute force over all
    vectors.  Below the target recall, clusters are made to overlap more and the search is repeated; a single shard is
    compared exhaustively instead, and where no overlap reaches the target, an error is raised - a result below the
    target is never returned.  Without true pairs the audit says nothing and its recall is null.

What is broadcast: the audit vectors (a parameter) and centres, one per shard_rows vectors up to CENTRE_BYTES; a larger
table has larger clusters, and so more blocks per cluster.

near_duplicate_classes() gives one row per vector: its class (connected by pairs), the number of vectors it pairs with, and
its highest similarity.  near_duplicates() gives the pairs, copies expanded.

Defined cases: null, empty and all-zero vectors, those with null, NaN or infinite elements, and those whose dimension
isn't the most frequent one (the smaller one if equal) have no partners; a null id is ignored; of several vectors with
one id the first in byte order counts, so repeated rows count once; equal vectors have similarity 1; an empty table gives
an empty result; other columns are ignored.  In near_duplicate_classes() every id has one row; without partners it is a class
of its own with 0 links and a null similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.classes import key_classes
from factloom.llm.common import partitions_for, small_side
from factloom.storage import shared_table

THRESHOLD = 0.95
SHARD_ROWS = 4096
OVERLAP = 2
NEAR, FAR, HUB = 24, 8, 64
CANDIDATES = 64
ALPHA = 1.2
BEAM = 32
AUDIT, AUDIT_MOST, TRUE_PAIRS = 256, 4096, 64
CENTRE_BYTES = 64 << 20
MOST_OVERLAP = 16
RECALL = 0.98
LLOYD_STEPS = 3
PAIRS = "a bigint, b bigint, similarity double"
SHARD = ["shard", "i", "j"]


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """((id, vec) with one normalised float32 vector per id, dimension)."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.filter("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 0

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0).astype(np.float32)  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])

    return rows.filter(F.size("v") == dim).mapInArrow(unit, "id bigint, vec binary").groupBy("id").agg(F.min("vec").alias("vec")), dim


def matrix(column: pa.Array | pa.ChunkedArray | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def find_centres(reps: DataFrame, k: int, dim: int, steps: int) -> np.ndarray:
    """k cluster centres: Lloyd steps over all vectors, from the vectors with the smallest hashes."""
    first = reps.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(k).toPandas()
    centres = matrix(first["vec"], dim)
    for _ in range(steps):
        shared = reps.sparkSession.sparkContext.broadcast(centres)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0), dim)
                cell = np.concatenate([np.argmax(x[a : a + 1024] @ shared.value.T, axis=1) for a in range(0, len(x), 1024)] or [np.zeros(0, int)])
                by = np.argsort(cell, kind="stable")
                cells, at = np.unique(cell[by], return_index=True)
                sums = np.add.reduceat(x[by].astype(np.float64), at, axis=0) if len(at) else np.zeros((0, dim))
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())], names=["cell", "sum"])

        def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            s = np.frombuffer(b"".join(sorted(frame["sum"])), np.float64).reshape(-1, dim).sum(axis=0)
            return pd.DataFrame({"cell": [key[0]], "vec": [(s / max(np.linalg.norm(s), 1e-12)).astype(np.float32).tobytes()]})

        moved = reps.select("vec").mapInArrow(part, "cell int, sum binary").groupBy("cell").applyInPandas(total, "cell int, vec binary").toPandas()
        centres = centres.copy()
        centres[moved["cell"].to_numpy()] = matrix(moved["vec"], dim)
    return centres


def to_shards(reps: DataFrame, centres: np.ndarray | None, dim: int, overlap: int, shard_rows: int) -> DataFrame:
    """(shard, i, j, home, id, vec): every vector in its nearest clusters (home: the nearest), large clusters as pairs of blocks."""
    if centres is None:
        placed = reps.select(F.lit(0).alias("shard"), F.lit(True).alias("home"), "id", "vec")
    else:
        shared = reps.sparkSession.sparkContext.broadcast(centres)
        keep = min(overlap, len(centres))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dim)
                near = []
                for a in range(0, len(x), 1024):
                    far = -(x[a : a + 1024] @ shared.value.T)
                    cell = np.argpartition(far, keep - 1, axis=1)[:, :keep]
                    near.append(np.take_along_axis(cell, np.argsort(np.take_along_axis(far, cell, 1), axis=1, kind="stable"), 1))
                cells = np.concatenate(near).astype(np.int32) if near else np.zeros((0, keep), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int32()))], names=["id", "vec", "cells"])

        placed = reps.select("id", "vec").mapInArrow(place, "id bigint, vec binary, cells array<int>").select(F.posexplode("cells").alias("place", "shard"), "id", "vec").select("shard", (F.col("place") == 0).alias("home"), "id", "vec")
    placed = shared_table(placed, "neardup-placed")
    blocks = placed.groupBy("shard").count().select("shard", F.when(F.col("count") <= 4 * shard_rows, 1).otherwise(F.ceil(F.col("count") / shard_rows)).cast("int").alias("blocks"))
    placed = placed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "home", "id", "vec")


def robust_prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, keep: int, alpha: float = ALPHA) -> np.ndarray:
    """For each node up to `keep` of its candidates (columns in any order; -1: none), padded with -1."""
    sims = np.where(candidates >= 0, np.einsum("nd,ncd->nc", x[node], x[candidates]), -2.0)
    by = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, by, 1), np.take_along_axis(sims, by, 1)
    v = x[candidates]
    among = 1 - v @ v.transpose(0, 2, 1)  # half the squared distances
    own = 1 - sims
    alive, out = candidates >= 0, np.full((len(node), keep), -1, np.int64)
    rows = np.arange(len(node))
    for k in range(keep):
        pick = np.argmax(alive, axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        alive[rows, pick] = False
        alive &= ~((alpha * alpha * among[rows, pick] <= own) & some[:, None])
    return out


def shard_graph(x: np.ndarray) -> list[np.ndarray]:
    """Symmetric adjacency lists of a shard."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    near, far = [], []
    spread = np.unique(np.linspace(0, n - 1, min(n, 4 * FAR)).astype(np.int64))
    for a in range(0, n, 256):
        node = np.arange(a, min(n, a + 256))
        s = x[node] @ x.T
        s[node - a, node] = -2
        c = min(CANDIDATES, n - 1)
        near.append(robust_prune(x, node, np.argpartition(-s, c - 1, axis=1)[:, :c], NEAR))
        other = (spread[None, :] + node[:, None] * 7) % n
        far.append(robust_prune(x, node, np.where(other == node[:, None], -1, other), FAR))
    both = np.concatenate((np.concatenate(near), np.concatenate(far)), axis=1)
    a, b = np.repeat(np.arange(n), both.shape[1]), both.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    edge = np.unique(np.concatenate((a * n + b, b * n + a)))
    lists = np.split(edge % n, np.searchsorted(edge // n, np.arange(1, n)))
    for i in [i for i, e in enumerate(lists) if len(e) > 2 * HUB]:  # hubs keep their nearest, diverse neighbours
        lists[i] = np.sort(robust_prune(x, np.array([i]), lists[i][None, :], HUB)[0])
        lists[i] = lists[i][lists[i] >= 0]
    return lists


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def range_search(x: np.ndarray, lists: list[np.ndarray], entries: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs within range. Nodes beyond len(lists) are seen, but have no lists."""
    n, degree = len(lists), np.array([len(e) for e in lists], dtype=np.int64)
    at, flat = np.concatenate(([0], np.cumsum(degree))), np.concatenate(lists) if lists else np.zeros(0, np.int64)
    degree, at = np.append(degree, np.zeros(len(x) - n, np.int64)), np.append(at[:-1], np.zeros(len(x) - n, np.int64))

    def step(q: np.ndarray, node: np.ndarray, block: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (query, neighbour, similarity) from expanding nodes."""
        m = degree[node]
        q, node = np.repeat(q, m), flat[np.repeat(at[node] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        new = ~seen[q, node]
        code = np.unique(q[new] * len(x) + node[new])
        q, node = code // len(x), code % len(x)
        seen[q, node] = True
        sims = np.concatenate([np.einsum("kd,kd->k", x[block[q[a : a + 65536]]], x[node[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0, np.float32)])
        return q, node, sims

    for s in range(0, len(queries), 128):
        block = queries[s : s + 128]
        rows = np.arange(len(block))
        seen = np.zeros((len(block), len(x)), bool)
        ids = np.full((len(block), beam), -1, np.int64)
        sims = np.full((len(block), beam), -2.0, np.float32)
        done = np.ones((len(block), beam), bool)
        k = min(beam, len(entries))
        ids[:, :k], sims[:, :k], done[:, :k] = entries[:k], x[block] @ x[entries[:k]].T, False
        seen[:, entries[:k]] = True
        hit_q, hit_node = [np.repeat(rows, k)], [np.tile(entries[:k], len(rows))]
        keep = sims[:, :k].reshape(-1) >= threshold
        hit_q[0], hit_node[0] = hit_q[0][keep], hit_node[0][keep]
        expanded = []
        while True:  # descend: expand the best four of each beam
            order = np.argsort(np.where(done, 3.0, -sims), axis=1, kind="stable")[:, :4]
            q, col = np.repeat(rows, order.shape[1]), order.reshape(-1)
            live = ~done[q, col]
            if not live.any():
                break
            q, col = q[live], col[live]
            done[q, col] = True
            expanded.append(q * len(x) + ids[q, col])
            q, node, got = step(q, ids[q, col], block, seen)
            near = got >= threshold
            hit_q.append(q[near])
            hit_node.append(node[near])
            by = np.lexsort((-got, q))
            q, node, got = q[by], node[by], got[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < beam
            q, node, got, place = q[top], node[top], got[top], place[top]
            more_ids, more_sims, more_done = np.full_like(ids, -1), np.full_like(sims, -2.0), np.ones_like(done)
            more_ids[q, place], more_sims[q, place], more_done[q, place] = node, got, False
            ids, sims, done = np.concatenate((ids, more_ids), 1), np.concatenate((sims, more_sims), 1), np.concatenate((done, more_done), 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(z, best, 1) for z in (ids, sims, done))
        # expand the range: from all nodes within it, and the query's own node
        own = ~seen[rows, block]
        hit_q.append(rows[own])
        hit_node.append(block[own])
        seen[rows, block] = True
        q, node = np.concatenate(hit_q), np.concatenate(hit_node)
        fresh = ~np.isin(q * len(x) + node, np.concatenate(expanded) if expanded else [])
        front_q, front_node = q[fresh], node[fresh]
        while len(front_q):
            next_q, next_node = [], []
            for a in range(0, len(front_q), 4096):
                fq, fn, got = step(front_q[a : a + 4096], front_node[a : a + 4096], block, seen)
                near = got >= threshold
                next_q.append(fq[near])
                next_node.append(fn[near])
            front_q, front_node = np.concatenate(next_q), np.concatenate(next_node)
            q, node = np.concatenate((q, front_q)), np.concatenate((node, front_node))
        other = block[q] != node
        yield block[q[other]], node[other]


def search_graph(shards: DataFrame, reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Verified pairs (a < b, similarity) of the range searches in all shards."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        ids, x = frame["id"].to_numpy(), matrix(frame["vec"], dim)
        lists = shard_graph(x)
        return pd.DataFrame({"shard": key[0], "i": key[1], "j": key[2], "id": ids, "near": [ids[e].tobytes() for e in lists]})

    lists = shared_table(shards.groupBy(*SHARD).applyInPandas(build, "shard int, i int, j int, id bigint, near binary"), "neardup-lists")
    united = lists.groupBy("id").agg(F.collect_list("near").alias("near"))
    members = shards.join(united, "id").select(*SHARD, "home", "id", "vec", "near")
    # Neighbours in other shards: their ids per shard, packed, then their vectors.
    outside = lists.alias("l").join(lists.select("id", *[F.col(c).alias(f"o{c}") for c in SHARD], F.col("near").alias("out")).alias("o"), "id")
    outside = outside.filter("shard <> oshard OR i <> oi OR j <> oj").select(*SHARD, "id", "out")

    def beyond(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.unique(np.concatenate([np.frombuffer(o, np.int64) for o in frame["out"]]))
        return pd.DataFrame({"shard": key[0], "i": key[1], "j": key[2], "id": np.setdiff1d(seen, frame["id"].to_numpy())})

    halo = outside.groupBy(*SHARD).applyInPandas(beyond, "shard int, i int, j int, id bigint")
    halo = halo.join(reps.select("id", "vec"), "id").join(shards.select(*SHARD, "id"), [*SHARD, "id"], "left_anti")
    both = members.unionByName(halo.select(*SHARD, F.lit(False).alias("home"), "id", "vec", F.lit(None).cast("array<binary>").alias("near")))

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(outer=frame["near"].isna()).sort_values(["outer", "id"], kind="stable")
        ids, x, m = frame["id"].to_numpy(), matrix(frame["vec"], dim), int((~frame["outer"]).sum())
        by = np.argsort(ids, kind="stable")
        nodes = []
        for near in frame["near"].iloc[:m]:
            e = np.unique(np.concatenate([np.frombuffer(o, np.int64) for o in near]))
            at = np.minimum(np.searchsorted(ids[by], e), len(ids) - 1)
            nodes.append(by[at][ids[by[at]] == e])
        out = [np.zeros((0, 2), np.int64)]
        if m:
            for q, node in range_search(x, nodes, np.array([medoid(x[:m])]), np.flatnonzero(frame["home"].to_numpy()), threshold - 1e-4):
                out.append(np.stack((np.minimum(ids[q], ids[node]), np.maximum(ids[q], ids[node])), 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        a, b = by[np.searchsorted(ids[by], pairs[:, 0])], by[np.searchsorted(ids[by], pairs[:, 1])]
        sims = np.concatenate([np.einsum("kd,kd->k", x[a[s : s + 65536]].astype(np.float64), x[b[s : s + 65536]].astype(np.float64)) for s in range(0, len(a), 65536)] or [np.zeros(0)])
        hit = sims >= threshold
        return pd.DataFrame({"a": pairs[hit, 0], "b": pairs[hit, 1], "similarity": np.minimum(1.0, np.round(sims[hit], 6))})

    return both.groupBy(*SHARD).applyInPandas(search, PAIRS).repartition("a").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def audited_recall(reps: DataFrame, pairs: DataFrame, dim: int, threshold: float, audit: int = AUDIT) -> float | None:
    """Share of the pairs of `audit` vectors that were found, by brute force over all vectors; None where there are none."""
    while True:
        chosen = reps.select("id", "vec", F.xxhash64("id", F.lit(1)).alias("h")).orderBy("h", "id").limit(audit).select("id", "vec").toPandas()
        if not len(chosen):
            return None
        shared = reps.sparkSession.sparkContext.broadcast((chosen["id"].to_numpy(), matrix(chosen["vec"], dim).astype(np.float64)))

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, v = shared.value
            for batch in batches:
                own, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim).astype(np.float64)
                for a in range(0, len(x), 512):
                    i, j = np.nonzero(x[a : a + 512] @ v.T >= threshold)
                    p, q = own[a + i], ids[j]
                    keep = p != q
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)[keep]), pa.array(np.maximum(p, q)[keep])], names=["a", "b"])

        true = reps.select("id", "vec").mapInArrow(brute, "a bigint, b bigint").distinct()
        n, found = true.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*"), F.count("hit")).first()
        if n >= TRUE_PAIRS or audit >= AUDIT_MOST or len(chosen) < audit:
            return found / n if n else None
        audit = min(AUDIT_MOST, audit * 4)


def _exhaustive(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """All pairs of one shard."""

    def every(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        ids, x = frame["id"].to_numpy(), matrix(frame["vec"], dim).astype(np.float64)
        out = []
        for a in range(0, len(x), 512):
            s = x[a : a + 512] @ x.T
            i, j = np.nonzero(s >= threshold)
            keep = a + i < j
            out.append(pd.DataFrame({"a": ids[a + i[keep]], "b": ids[j[keep]], "similarity": np.minimum(1.0, np.round(s[i[keep], j[keep]], 6))}))
        return pd.concat(out)

    return reps.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda frame: every(frame), PAIRS)


def _found(vectors: DataFrame, threshold: float, shard_rows: int, overlap: int, recall: float, audit: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, float | None]:
    """((id, rep) of all vectors, verified pairs of different vectors, audited recall)."""
    cleaned, dim = clean_vectors(vectors, id_col, vec_col)
    cleaned = shared_table(cleaned, "neardup-vectors")
    reps = shared_table(cleaned.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "neardup-reps")
    k = min(partitions_for(reps.count(), shard_rows), max(2, CENTRE_BYTES // (4 * max(1, dim))))
    centres = find_centres(reps, k, dim, LLOYD_STEPS) if k > 1 else None
    while True:
        shards = shared_table(to_shards(reps, centres, dim, overlap, shard_rows), "neardup-shards")
        pairs = shared_table(search_graph(shards, reps, dim, threshold), "neardup-pairs")
        reached = audited_recall(reps, pairs, dim, threshold, audit)
        if reached is None or reached >= recall:
            break
        if centres is None:
            pairs, reached = shared_table(_exhaustive(reps, dim, threshold), "neardup-pairs"), 1.0
            break
        if overlap >= min(len(centres), MOST_OVERLAP):
            raise RuntimeError(f"recall {reached:.4f} of the target {recall} with clusters that overlap {overlap} times; larger shards or a higher threshold are needed")
        overlap = min(2 * overlap, len(centres), MOST_OVERLAP)
    members = cleaned.join(reps.select(F.col("id").alias("rep"), "vec"), "vec").select("id", "rep")
    return shared_table(members, "neardup-members"), pairs, reached


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, recall: float = RECALL, audit: int = AUDIT, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """All found pairs vec_a < vec_b with cosine similarity >= threshold: (vec_a, vec_b, similarity, audited_recall)."""
    members, pairs, reached = _found(vectors, threshold, shard_rows, overlap, recall, audit, id_col, vec_col)
    one, two = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    copies = one.join(two, F.expr("a = b AND x < y")).select("x", "y", F.lit(1.0).alias("similarity"))
    near = pairs.join(one, "a").join(two, "b").select("x", "y", "similarity")
    return copies.unionByName(near).select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "similarity", F.lit(reached).cast("double").alias("audited_recall"))


def near_duplicate_classes(
    vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, recall: float = RECALL, audit: int = AUDIT, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(vec_id, class_id, n_links, best_similarity) of every id; class_id is the smallest id of its class."""
    members, pairs, _ = _found(vectors, threshold, shard_rows, overlap, recall, audit, id_col, vec_col)
    n = small_side(shared_table(members.groupBy("rep").agg(F.count("*").alias("n")), "neardup-copies"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("key"), "similarity").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("key"), "similarity"))
    sums = both.join(n, "rep").groupBy("key").agg(F.sum("n").alias("links"), F.max("similarity").alias("best"))
    per = key_classes(members.select("id", F.col("rep").alias("key")), sums, pairs.select("a", "b"))
    per = small_side(shared_table(per.select(F.col("key").alias("rep"), "links", F.round("best", 4).alias("best"), "class_id"), "neardup-classes"))
    found = members.join(per, "rep").select(F.col("id").alias("vec_id"), "class_id", "links", "best")
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id")).filter("vec_id IS NOT NULL").distinct()
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("best").alias("best_similarity"))


CLASSES_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  alike AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
  near(a, b) AS (SELECT id, id FROM v UNION SELECT near.a, alike.b FROM near JOIN alike ON near.b = alike.a),
  tops AS (SELECT a AS vec_id, min(b) AS class_id FROM near GROUP BY a),
  counts AS (SELECT a AS vec_id, count(*) AS n_links, max(s) AS best FROM alike GROUP BY a)
SELECT vec_id, class_id, coalesce(n_links, 0) AS n_links, round(best, 4) AS best_similarity FROM tops LEFT JOIN counts USING (vec_id)"""
