"""Exact top-k search through vector-approximation files (operator 1).

Each vector becomes a row of small cell numbers on a grid. A search first scans
only the cells, which bound every score from both sides, and then reads exact
vectors in the order of their bounds until no unread vector can change the k
best. The scan of a block of cells is one matrix product.

A stored block holds up to ``block_rows`` vectors: ids, grid (origin and cell
width per dimension), cells (one byte per component) and exact components.
Queries are handled in chunks of about ``query_chunk`` rows; each chunk, whose
size that parameter bounds, is broadcast and meets every block once, so vectors
are never shuffled. Each task keeps k rows per query; these meet in one window.

Edge cases: a vector that is null, empty, or holds null or non-finite components
takes no part. Vectors of different lengths never meet. Repeated candidate rows
are candidates each; a repeated query id asks once, with its greatest vector. A
candidate with the query's own id is left out. Ties go to the smaller id. Null
ids take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import finite_vector, materialize, scratch_path, slices, table, vector_groups

BLOCK_SCHEMA = "dim int, ids binary, origin binary, width binary, cells binary, exact binary"
#: Up to here float64 products and their sums are exact integers.
EXACT_LIMIT = float(2**52)


def scaled_floor(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def _block(ids: np.ndarray, vectors: np.ndarray, bits: int) -> dict:
    cells = 2**bits
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    width = np.maximum(1.0, np.ceil((high - low + 1.0) / cells))
    codes = np.minimum(np.floor((vectors - low) / width), cells - 1).astype(np.uint8)
    return {"dim": vectors.shape[1], "ids": ids.tobytes(), "origin": low.tobytes(), "width": width.tobytes(), "cells": codes.tobytes(), "exact": vectors.tobytes()}


def build_va_file(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, scale: float = 256.0, bits: int = 6, block_rows: int = 8192) -> DataFrame:
    """The approximation file of ``vectors``: integer components floor(scale * x), in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_rows):
            rows = [_block(ids, scaled_floor(m, scale), bits) for ids, m in vector_groups(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)

    good = vectors.filter(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)))
    return good.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(pack, BLOCK_SCHEMA)


_BLOCK_ARROW = pa.schema([("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "origin", "width", "cells", "exact"))])


class _Best:
    """The k best (score, id) of each query so far, as sorted arrays."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> float:
        """Merge rows into query q's list; returns the kth best score."""
        s = np.concatenate([self.scores[q], scores])
        i = np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        return self.scores[q, -1]


def _exact_rows(exact: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    return exact[at] @ query


def _search_block(block: dict, qids: np.ndarray, queries: np.ndarray, best: _Best, step: int) -> None:
    dim = block["dim"]
    ids = np.frombuffer(block["ids"], np.int64)
    low, width = (np.frombuffer(block[c], np.float64) for c in ("origin", "width"))
    cells = np.frombuffer(block["cells"], np.uint8).reshape(-1, dim)
    exact = np.frombuffer(block["exact"], np.float64).reshape(-1, dim)
    if np.abs(low).max() + width.max() * 256 > EXACT_LIMIT / max(1.0, dim * np.abs(queries).max()):
        for q, query in enumerate(queries):  # too large for float64: plain integers, which have no bound
            whole = [int(x) for x in query]
            rows = np.flatnonzero(ids != qids[q])
            big = np.array([sum(a * int(b) for a, b in zip(whole, exact[r])) for r in rows], dtype=object)
            order = sorted(range(len(rows)), key=lambda j: (-big[j], ids[rows[j]]))[: best.k]
            best.offer(q, big[order].astype(np.float64), ids[rows[order]])
        return
    grid = cells.astype(np.float64)
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        base = (part @ low)[:, None] + (part * width) @ grid.T
        upper = base + (np.maximum(part, 0) @ (width - 1))[:, None]
        slack = (np.abs(part) @ (width - 1))[:, None]  # upper - lower
        own = ids[None, :] == qids[start : start + step, None]
        upper[own] = -np.inf
        k = min(best.k, len(ids))
        sure = np.partition(upper, len(ids) - k, axis=1)[:, len(ids) - k] - slack[:, 0] if len(ids) > best.k else np.full(len(part), -np.inf)
        for j in range(len(part)):
            q = start + j
            reached = max(best.scores[q, -1], sure[j])
            found = np.flatnonzero((upper[j] >= reached) & ~own[j])
            if not len(found):
                continue
            found = found[np.argsort(-upper[j, found], kind="stable")]
            for at in range(0, len(found), 64):
                some = found[at : at + 64]
                if upper[j, some[0]] < best.scores[q, -1]:
                    break
                best.offer(q, _exact_rows(exact, some, queries[q]), ids[some])


def search_va_file(va_file: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, query_chunk: int = 20_000) -> DataFrame:
    """The k largest integer inner products of each query with the vectors of ``va_file``.

    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    spark = va_file.sparkSession
    good = queries.filter(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)))
    asked = good.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(vec_col).cast("array<double>")).alias("vec"))
    chunks = max(1, math.ceil(asked.count() / query_chunk))
    parts = [_chunk_top(spark, va_file, asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c), k, scale) for c in range(chunks)] if chunks == 1 else None
    if parts is None:
        path = scratch_path(spark, "va-chunks")
        for c in range(chunks):
            _chunk_top(spark, va_file, asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c), k, scale).write.mode("append").parquet(path)
        parts = [spark.read.parquet(path)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts[0].withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunk_top(spark: SparkSession, va_file: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    got = asked.toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast([(i, scaled_floor(m, scale)) for b in got.to_batches() for i, m in vector_groups(b.column(0), b.column(1))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(ids, m, _Best(len(ids), k)) for ids, m in sent.value]
        for batch in slices(batches, 1):
            for block in batch.to_pylist():
                for ids, m, best in groups:
                    if m.shape[1] == block["dim"]:
                        _search_block(block, ids, m, best, 256)
        for ids, _, best in groups:
            q, at = np.nonzero(np.isfinite(best.scores))
            limit = float(2**63 - 1024)
            score = np.clip(best.scores[q, at], -limit, limit).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.ids[q, at]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return va_file.mapInArrow(search, "query_id long, vec_id long, score long")


def op1_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    blocks = materialize(build_va_file(vectors), "va-file")
    return search_va_file(blocks, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
