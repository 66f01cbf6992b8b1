"""Approximate nearest neighbours by cross-polytope hashing (operator 8).

A hash function turns a unit vector by three rounds of random signs and a fast
Hadamard transform, and takes the nearest signed axis. A table's bucket is the
tuple of ``hashes`` such axes; a query also looks into the buckets of its next
nearest axes (multiprobe). Candidates are ranked by exact Euclidean distance on
the original vectors, in double precision.

Every row is indexed. Identical vectors form one class (of which the k + 1
smallest ids suffice for any answer), so a vector that many rows share meets a
query once. The index holds packed blocks per table and bucket; queries join them
on table and bucket, and each task keeps the best classes of every query it saw.

How many axes and buckets that takes is measured for each length of vectors: the
nearest classes of up to ``SAMPLE`` queries are found by brute force, and the number
of buckets a table is what brings ``RECALL`` of them into the candidates (``probes``
axes of each hash at least). Of one hash to as many as leave ``bucket_rows`` rows in
a bucket, the cheapest is taken, where opening a bucket costs as much as ranking
``bucket_rows`` rows. Where hashing can't save any ranking, one table is read whole.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part. Vectors of different lengths never meet. A repeated id
counts once per distinct vector. A candidate with the query's own id is left out.
Fewer candidates than k give fewer rows. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import finite_vector, materialize, slices, table, vector_groups

SAMPLE = 128
RECALL = 0.95
#: Beyond so many buckets of several hashes, or lengths of vectors, nothing is measured: fewer hashes, or all buckets, are used.
MOST_PROBES = 4096
MOST_LENGTHS = 16

BLOCK_SCHEMA = "slot long, dim int, ids binary, vecs binary"
_BLOCK_ARROW = pa.schema([("slot", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row; the length is a power of two."""
    n, d = rows.shape
    h = 1
    while h < d:
        pair = rows.reshape(n, d // (2 * h), 2, h)
        rows = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return rows / math.sqrt(d)


def rotate(unit: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and Hadamard transform."""
    d = 1 << max(0, (unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), d))
    out[:, : unit.shape[1]] = unit
    signs = np.random.default_rng(seed)
    for _ in range(3):
        out = hadamard(out * signs.choice([-1.0, 1.0], d))
    return out


def axis_ranks(turned: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of each row, nearest first."""
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :n]


def _span(dim: int) -> int:
    """The number of signed axes."""
    return 2 << max(0, (dim - 1).bit_length())


def _unit(m: np.ndarray) -> np.ndarray:
    unit = m / np.abs(m).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _pairs(a: int, b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in two descending lists of a and b values whose sums can be among the n largest."""
    count = np.minimum(b, n // np.arange(1, a + 1))
    return np.repeat(np.arange(a), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def buckets(unit: np.ndarray, t: int, hashes: int, n: int) -> np.ndarray:
    """The n nearest buckets of each row in table t, by the sum of its components along their axes, nearest first."""
    span = _span(unit.shape[1])
    for h in range(hashes):
        turned = rotate(unit, t * 64 + h)
        axes = axis_ranks(turned, n)
        along = np.take_along_axis(np.concatenate([turned, -turned], axis=1), axes, 1)
        if h == 0:
            slot, score = axes + t * span, along
            continue
        i, j = _pairs(slot.shape[1], axes.shape[1], n)
        score = score[:, i] + along[:, j]
        best = np.argsort(-score, axis=1, kind="stable")[:, :n]
        slot, score = np.take_along_axis(slot[:, i] * span + axes[:, j], best, 1), np.take_along_axis(score, best, 1)
    return slot


def _slots(unit: np.ndarray, tables: int, hashes: int, probes: int) -> Iterator[np.ndarray]:
    """For each table and probe, the bucket of every row."""
    for t in range(tables):
        yield from buckets(unit, t, hashes, probes).T


def _whole(dim: int) -> tuple[int, int, int]:
    """The plan (tables, hashes, probes) that reads every bucket of one table."""
    return 1, 1, _span(dim)


def _nearest_of(sample: np.ndarray, k: int):
    """The k vectors nearest to each of a sample, its equals left out, among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty((0, sample.shape[1])))] * len(sample)
        for batch in slices(batches, 2048):
            for _, m in vector_groups(batch.column(0), batch.column(1)):
                for i, query in enumerate(sample):
                    gap = m - query
                    gap = np.einsum("ij,ij->i", gap, gap)
                    near = np.flatnonzero((gap > 0) & (gap < best[i][0][-1] if len(best[i][0]) >= k else gap > 0))
                    if len(near):
                        gap, vecs = np.append(best[i][0], gap[near]), np.concatenate([best[i][1], m[near]])
                        order = np.argsort(gap, kind="stable")[:k]
                        best[i] = gap[order], vecs[order]
        at = np.repeat(np.arange(len(sample)), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([b[0] for b in best])), pa.array([v.tobytes() for b in best for v in b[1]], pa.binary())], names=["at", "gap", "vec"])

    return run


def probes_needed(queries: np.ndarray, at: np.ndarray, near: np.ndarray, tables: int, hashes: int, most: int) -> int | None:
    """How many buckets a table bring ``RECALL`` of the vectors ``near`` into the candidates of their queries (number ``at``); None if over ``most``."""
    if not len(near):
        return 1
    least = np.full(len(near), most + 1)
    for t in range(tables):
        probed, own = buckets(queries, t, hashes, most), buckets(near, t, hashes, 1)
        for i, row in enumerate(probed):
            here = np.flatnonzero(at == i)
            hit = row == own[here]
            least[here] = np.minimum(least[here], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1))
    n = int(np.sort(least)[math.ceil(RECALL * len(least)) - 1])
    return n if n <= most else None


def _plans(own: DataFrame, asked: DataFrame, k: int, tables: int, probes: int, bucket_rows: int, hashes: int | None) -> dict[int, tuple[int, int, int]]:
    """(tables, hashes, probes) for the commonest lengths of vectors."""
    plans = {}
    lengths = own.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS)
    for dim, n in lengths.collect():
        span = _span(dim)
        of_length = F.size("vec") == dim
        some = min(SAMPLE, max(16, (1 << 24) // (8 * dim * k)))  # some 16 MB of neighbours
        queries = np.array([r["vec"] for r in asked.filter(of_length).orderBy(F.xxhash64("id"), "vec").limit(some).collect()]).reshape(-1, dim)
        found = own.filter(of_length).select("id", "vec").mapInArrow(_nearest_of(queries, k), "at long, gap double, vec binary") if len(queries) else None
        order = Window.partitionBy("at").orderBy("gap", "vec")
        pairs = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("at", "vec").collect() if found is not None else []
        at = np.array([r["at"] for r in pairs], np.int64)
        near = np.frombuffer(b"".join(r["vec"] for r in pairs), np.float64).reshape(-1, dim)
        most_hashes = max(1, math.ceil(math.log(max(1, n / bucket_rows)) / math.log(span)))
        choices = []
        for h in range(1, most_hashes + 1) if hashes is None else [hashes]:
            most = span if h == 1 else min(span**h, MOST_PROBES)
            need = probes_needed(_unit(queries), at, _unit(near), tables, h, most) if len(near) else 1
            if need is not None:
                need = max(need, min(probes, span) ** h)
                choices.append((tables * need * (n / span**h + bucket_rows), (tables, h, need)))
        if hashes is None or not choices:
            choices.append((n + span * bucket_rows, _whole(dim)))
        plans[dim] = min(choices)[1]
    return plans


def _blocks(df: DataFrame, plans: dict[int, tuple[int, int, int]], probing: bool, block_rows: int = 2048) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_rows * 4):
            for all_ids, all_rows in vector_groups(batch.column(0), batch.column(1)):
                dim = all_rows.shape[1]
                tables, hashes, probes = plans.get(dim) or _whole(dim)
                probes = probes if probing else 1
                step = max(64, (1 << 20) // probes)
                for start in range(0, len(all_ids), step):
                    ids, m = all_ids[start : start + step], all_rows[start : start + step]
                    for slot in _slots(_unit(m), tables, hashes, probes):
                        order = np.argsort(slot, kind="stable")
                        cuts = np.flatnonzero(np.diff(slot[order])) + 1
                        rows = [at[i : i + block_rows] for at in np.split(order, cuts) for i in range(0, len(at), block_rows)]
                        yield pa.RecordBatch.from_pylist([{"slot": slot[at[0]], "dim": dim, "ids": ids[at].tobytes(), "vecs": m[at].tobytes()} for at in rows], schema=_BLOCK_ARROW)

    return df.mapInArrow(pack, BLOCK_SCHEMA)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 16, probes: int = 6, bucket_rows: int = 1000, hashes: int | None = None) -> DataFrame:
    """The k nearest candidates found for each query: query_id, rank, vec_id, score (distance)."""

    def clean(df: DataFrame) -> DataFrame:
        good = df.filter(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0))
        return good.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("vec"))

    def classes(df: DataFrame, most: int) -> DataFrame:
        first = df.withColumn("n", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= most)
        return first.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids")

    own = materialize(classes(clean(vectors), k + 1), "ann-classes")
    wanted = clean(queries).distinct()
    asked = materialize(classes(wanted, 1).drop("ids"), "ann-asked")
    plans = _plans(own, asked, k, tables, probes, bucket_rows, hashes)
    index = _blocks(own.select("id", "vec"), plans, False)
    probing = _blocks(asked, plans, True).toDF("slot", "dim", "qids", "qvecs")
    found = index.join(probing, ["slot", "dim"]).select("dim", "ids", "vecs", "qids", "qvecs").mapInArrow(_ranker(k + 1), "qid long, id long, score double")
    order = Window.partitionBy("qid").orderBy("score", "id")
    best = found.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("qid", "id", "score")
    members = best.join(own.select("id", "ids"), "id").select("qid", "score", F.explode("ids").alias("vec_id"))
    ranked = members.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1)
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    keyed = wanted.join(asked.select(F.col("id").alias("qid"), "vec"), "vec").select(F.col("id").alias("query_id"), "qid")
    out = keyed.join(lists, "qid").select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    return out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _ranker(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v[0]) for v in best.values()])
            ids, scores = (np.concatenate([v[i] for v in best.values()]) if best else np.empty(0, t) for i, t in ((1, np.int64), (0, np.float64)))
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], names=["qid", "id", "score"])

        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
                vecs, qvecs = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]) for c in ("vecs", "qvecs"))
                for q, query in zip(qids.tolist(), qvecs):
                    gap = vecs - query
                    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    have = best.get(q)
                    if have is not None:
                        if len(have[0]) >= k:
                            near = score <= have[0][-1]
                            if not near.any():
                                continue
                            score, some = score[near], ids[near]
                        else:
                            some = ids
                        score, some = np.concatenate([have[0], score]), np.concatenate([have[1], some])
                        some, first = np.unique(some, return_index=True)
                        score = score[first]
                    else:
                        some = ids
                    order = np.lexsort((some, score))[:k]
                    best[q] = score[order], some[order]
            if len(best) > 100_000:
                yield out()
        yield out()

    return rank


def op8_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
