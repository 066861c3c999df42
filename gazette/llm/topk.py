"""Exact inner-product search, a block of vectors at a time.

Vectors are ordered by id and cut into blocks. A block keeps its vectors side by side (the forward index) and, per
component, its largest and smallest value. For a query these give an upper bound of every score in the block: the sum
over components of query times maximum, or times minimum where the query is negative. Each query takes its blocks from
the highest bound down and stops where no bound reaches the score it already has in the k-th place.

Shards of blocks meet packs of queries as keys of a join, so no side is whole in any task or in the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored

_NOBODY = np.iinfo(np.int64).max
PACKED = "ids binary, width int, vectors binary"


def quantised(vectors: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(key, vector of floor(scale * x)); rows with a null key, a null vector, or null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), whole.alias("vector"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` neighbouring ids as one row each: ids, and the vectors as one matrix (short ones padded by 0).

    Of rows with the same id the one with the largest vector counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            width = max(map(len, held))
            matrix = np.zeros((len(held), width), dtype="<i8")
            for i, v in enumerate(held):
                matrix[i, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "width", "vectors"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ids and ids[-1] == key:
                    continue
                if len(ids) == size:
                    yield row()
                    ids, held = [], []
                ids.append(key)
                held.append(vector.values.to_numpy(zero_copy_only=False))
        if ids:
            yield row()

    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.desc("vector"))
    return ordered.mapInArrow(run, PACKED)


def _matrix(row: dict, width: int) -> np.ndarray:
    matrix = np.frombuffer(row["vectors"], "<i8").reshape(-1, max(1, row["width"])) if row["width"] else np.zeros((len(row["ids"]) // 8, 0), np.int64)
    out = np.zeros((len(row["ids"]) // 8, width), np.int64)
    out[:, : matrix.shape[1]] = matrix
    return out


def _largest(numbers: np.ndarray) -> int:
    """Largest absolute value, also where it has no counterpart of the other sign."""
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


def _best_of_wide(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """:func:`best_of` for products beyond 64 bits, a query at a time; scores that don't fit are given as the nearest that does."""
    found, score = np.full((len(queries), k), _NOBODY), np.zeros((len(queries), k), np.int64)
    for row, (query_id, query) in enumerate(zip(query_ids.tolist(), queries)):
        best: list[tuple[int, int]] = []
        for ids, vectors in blocks:
            scores = vectors.astype(object) @ query.astype(object)
            best = heapq.nsmallest(k, best + [(-s, i) for s, i in zip(scores, ids.tolist()) if i != query_id])
        for place, (less, i) in enumerate(best):
            found[row, place], score[row, place] = i, max(-(2**63), min(2**63 - 1, -less))
    return found, score, len(queries) * len(blocks)


def best_of(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of each query's k best rows (score -inf: none), and the number of blocks scored, counted per query.

    ``blocks`` are (ids in ascending order, vectors). Numbers are whole, so doubles are exact up to 2**53; beyond it
    products of 64 bits are taken, and Python's integers where a sum might not fit into these.
    """
    bound = _largest(queries) * max([_largest(m) for _, m in blocks], default=0) * max(1, queries.shape[1])
    if bound >= 2**62:
        return _best_of_wide(query_ids, queries, blocks, k)
    exact = bound < 2**53
    kind = np.float64 if exact else np.int64
    none = -np.inf if exact else -(2**62)
    queries, mats = queries.astype(kind), [m.astype(kind) for _, m in blocks]
    high = np.array([m.max(axis=0) for m in mats]).reshape(len(mats), -1)
    low = np.array([m.min(axis=0) for m in mats]).reshape(len(mats), -1)
    first = np.array([ids[0] for ids, _ in blocks])
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = np.full((len(queries), k), _NOBODY)
    score = np.full((len(queries), k), none, dtype=kind)
    everyone, scored = np.arange(len(queries)), 0
    for rank in range(len(blocks)):
        block = order[:, rank]
        bound = bounds[everyone, block]
        if (bound < score[:, -1]).all():
            break
        live = (bound > score[:, -1]) | ((bound == score[:, -1]) & (first[block] < found[:, -1]))
        for b in np.unique(block[live]):
            rows = np.flatnonzero(live & (block == b))
            scored += len(rows)
            ids = blocks[b][0]
            got = queries[rows] @ mats[b].T
            got[ids[None, :] == query_ids[rows, None]] = none
            best = np.argsort(-got, axis=1, kind="stable")[:, :k]  # ids ascend, so ties keep the smaller id
            here = np.take_along_axis(got, best, 1)
            both = np.concatenate([score[rows], here], 1)
            names = np.concatenate([found[rows], np.where(here == none, _NOBODY, ids[best])], 1)
            keep = np.lexsort((names, -both), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
    return found, score, scored


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 1024, shard: int = 64, pack: int = 8192
) -> DataFrame:
    """For each query row its k rows of ``vectors`` with the highest integer inner product, ties to the smaller id.

    Returns query_id, rank (from 1), vec_id, score. A query's own id is no candidate; with fewer candidates all are
    returned, with none the query has no row. Components of any size count in full; those beyond 64 bits, and scores beyond
    them, are the nearest number of 64 bits, and such scores tie. Null ids and null, non-finite or partly null vectors take no part on
    either side; a repeated id counts once; of vectors of unequal length the missing components count 0; an empty
    table gives no rows. Other columns are not read. ``block`` vectors make a block, ``shard`` blocks and ``pack``
    queries are at most in one task (fewer where the table is small, to keep executors busy).
    """
    blocks = stored(packed(quantised(vectors, key, vector), block), "blocks")
    packs = stored(packed(quantised(queries, key, vector), pack), "queries")
    n_blocks, n_packs = blocks.count(), packs.count()
    shards = max(1, -(-n_blocks // max(4, min(shard, n_blocks // 16))))
    parts = max(1, n_packs)
    number = F.hash(F.monotonically_increasing_id())
    left = packs.select(F.pmod(number, F.lit(parts)).alias("pack"), "*").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = blocks.select(F.pmod(number, F.lit(shards)).alias("shard"), "*").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        blocks_here = held.to_pylist()
        for one in asked.to_pylist() if blocks_here else []:
            width = max([one["width"], *(b["width"] for b in blocks_here)])
            ids = np.frombuffer(one["ids"], "<i8")
            found, scores, _ = best_of(ids, _matrix(one, width), [(np.frombuffer(b["ids"], "<i8"), _matrix(b, width)) for b in blocks_here], k)
            real = found != _NOBODY
            out["query_id"].append(np.repeat(ids, real.sum(1)))
            out["vec_id"].append(found[real])
            out["score"].append(scores[real].astype(np.int64))
        return pa.table({name: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()) for name, parts in out.items()})

    hits = left.groupBy("shard", "pack").cogroup(right.groupBy("shard", "pack")).applyInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
