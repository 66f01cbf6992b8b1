"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 5).

A text becomes counts of hashed byte trigrams over its whole length, and one more
term, the (smoothed) percentage of its words that repeat the word before. From a sample of
labelled texts a latent-semantic space is made: damped counts, weighted by how few
sample texts hold a term, and their leading singular directions. The sample's
vectors with their labels are broadcast; every document is compared with all of them
by exact cosines, block against block, and its nearest ones vote with their cosine
as weight.

The sample holds at most ``SAMPLE`` labelled documents, the first by a hash of their
ids; it bounds what reaches the driver and what is broadcast (``SAMPLE`` and
``TERMS`` times ``RANK`` numbers). Every document is scored on its whole text.

Edge cases: a text without trigrams (null, empty, under three bytes), or without a
neighbour of positive cosine, gets the sample's mean label; with no labels at all
every score is 1. Several labels of one document are averaged; a label whose
document is missing, or null, is not used. A labelled id that several texts share
stands for the smallest of them. Repeated rows are scored each.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import release_memory, short_batches, slices, table

BUCKETS = 4096
RANK = 96
SAMPLE = 6000
NEIGHBOURS = 15
#: A cosine votes with this power, so that close neighbours outweigh far ones.
SHARPNESS = 4
#: The term of repeated words stands against some thousand trigrams.
REPEAT_WEIGHT = 8
TERMS = BUCKETS + 1
#: Words added to a text's length, so that one repetition says little about a short text.
SMOOTHING = 40
BLOCK_BYTES = 1 << 20


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte trigrams and the percentage of repeated words: one row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if len(words) > 1:
            out[i, BUCKETS] = 100 * sum(map(operator.eq, words, words[1:])) / (len(words) + SMOOTHING)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_BYTES) and end - begin < 256:
            size += len(texts[end])
            end += 1
        length = np.array([len(t) for t in texts[begin:end]])
        data = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
        if len(data) >= 3:
            wide = data.astype(np.uint32)
            h = ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(20)
            owner = np.repeat(np.arange(end - begin), length)
            whole = owner[:-2] == owner[2:]
            key = owner[:-2][whole] * BUCKETS + h[whole]
            out[begin:end, :BUCKETS] = np.bincount(key, minlength=(end - begin) * BUCKETS).reshape(-1, BUCKETS)
        begin = end
    return out


class LatentSpace:
    """Trigram weights and singular directions of a sample, with its vectors and labels.

    The sample comes as (terms, counts) of each text; its matrix is only ever made
    some rows at a time.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 1.0
        self.labels = labels.astype(np.float32)
        held = np.zeros(TERMS)
        for at, _ in rows:
            held[at] += 1
        self.weight = np.where(held > 0, np.log((1 + len(rows)) / (1 + held)) + 0.1, 0).astype(np.float32)
        self.weight[BUCKETS] *= REPEAT_WEIGHT
        rank = min(RANK, len(rows), TERMS)
        # Leading directions by subspace iteration from a fixed start.
        basis = np.random.default_rng(11).standard_normal((TERMS, min(rank + 16, TERMS))).astype(np.float32)
        for _ in range(5):
            turned = np.zeros_like(basis)
            for block in self._blocks(rows):
                turned += block.T @ (block @ basis)
            basis, _ = np.linalg.qr(turned)
        seen = np.concatenate([np.zeros((0, basis.shape[1]), np.float32), *(block @ basis for block in self._blocks(rows))])
        _, _, turn = np.linalg.svd(seen, full_matrices=False) if len(rows) else (0, 0, np.eye(basis.shape[1], dtype=np.float32))
        self.directions = np.ascontiguousarray((basis @ turn.T)[:, :rank])
        self.vectors = self.unit(np.concatenate([np.zeros((0, rank), np.float32), *(block @ self.directions for block in self._blocks(rows))]))

    def _blocks(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        for start in range(0, len(rows), 256):
            counts = np.zeros((len(rows[start : start + 256]), TERMS), np.float32)
            for row, (at, n) in zip(counts, rows[start : start + 256]):
                row[at] = n
            yield self.damp(counts, own=True)

    def damp(self, counts: np.ndarray, own: bool = False) -> np.ndarray:
        """Damped, weighted rows of length 1; with ``own``, in the place of the counts."""
        out = np.log1p(counts, out=counts if own else None)
        out *= self.weight
        out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
        return out

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), 256):
            cosine = self.unit(self.damp(counts[at : at + 256]) @ self.directions) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
            total = vote.sum(axis=1)
            out[at : at + 256] = np.where(total > 1e-9, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LatentSpace:
    """A latent space from at most ``sample`` labelled documents that are not held out."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The sample's size is a parameter; one text per id.
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            counts = term_counts([t.encode() for t in batch.column(2).to_pylist()])
            rows = []
            for row in counts:
                at = np.flatnonzero(row)
                rows.append((at.astype(np.uint16).tobytes(), row[at].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "label", "at", "count"])

    got = joined.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(featurize, "id long, label double, at binary, count binary").toArrow().sort_by("id")
    rows = [(np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(n.as_buffer(), np.float32)) for at, n in zip(got.column("at"), got.column("count"))]
    space = LatentSpace(rows, np.array(got.column("label").to_pylist(), np.float64))
    del rows, got
    release_memory()
    return space


def score_documents(docs: DataFrame, space: LatentSpace, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default the id) of every document, and its score."""
    short_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(space)
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    source = docs.select(*keep, *([] if text_col in keep else [F.col(text_col)]))
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            scores = sent.value.score(term_counts([(t or "").encode() for t in batch.column(text_at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "score"])

    return source.mapInArrow(run, schema)


def op5_nearest_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
