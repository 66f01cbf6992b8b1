"""Operator 5 by held-out accuracy, and the pipeline against its parts."""

import numpy as np
import zlib

from conftest import EDGE_TEXTS, frame
from pyspark.sql import functions as F

from seagrid.llm.knnquality import NEIGHBOURS, SHARPNESS, SMOOTHING, fit, op5_nearest_neighbour_quality, score_documents, term_counts


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_nearest_neighbour_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) >= 0.97 * len(judged)
    assert sum(p for p, y in judged if y) >= 0.98 * sum(y for _, y in judged)
    assert sum(1 - p for p, y in judged if not y) >= 0.9 * sum(1 - y for _, y in judged)


def test_held_out_labels_are_not_used(spark, documents):
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    space = fit(documents, spark.createDataFrame([(i, 0) for i in out], "doc_id long, quality int"))
    assert len(space.labels) == 0 and space.prior == 1.0


def test_quality_edge_cases(spark, documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    docs = frame(spark, EDGE_TEXTS)
    rows = score_documents(docs, fit(docs, labels)).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    none = score_documents(docs, fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {1.0}
    assert score_documents(frame(spark, []), fit(docs, labels)).collect() == []
    assert [r.text for r in score_documents(docs, fit(docs, labels), keep=["text"]).filter("text IS NULL").collect()] == [None]


def test_votes_against_brute_force(spark, documents):
    """One text at a time: trigrams counted in a dictionary, all cosines in double precision, the nearest by sorting."""
    docs = documents.union(documents.sparkSession.createDataFrame([(-1, None), (-2, "ab"), (-3, "one one one two")], "doc_id long, text string").select(*(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in documents.dtypes)))
    space = fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    vectors, directions, weight = (x.astype(np.float64) for x in (space.vectors, space.directions, space.weight))
    k, clear = min(NEIGHBOURS, len(space.labels)), 0
    assert k > 1
    rows = score_documents(docs, space, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for row in rows:
        raw = (row.text or "").encode()
        counts = np.zeros(len(weight))
        for i in range(len(raw) - 2):
            counts[(int.from_bytes(raw[i : i + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        words = raw.split()
        if len(words) > 1:
            counts[-1] = 100 * sum(a == b for a, b in zip(words, words[1:])) / (len(words) + SMOOTHING)
        at = (np.log1p(counts) * weight) @ directions
        cosines = vectors @ at / max(np.linalg.norm(at), 1e-12)
        order = np.argsort(-cosines)
        if not raw or len(raw) < 3:
            assert abs(row.score - space.prior) < 1e-6
            continue
        if k < len(order) and cosines[order[k - 1]] - cosines[order[k]] < 1e-5:
            continue  # which of two equally near ones votes is open
        votes = np.maximum(cosines[order[:k]], 0) ** SHARPNESS
        assert abs(row.score - (votes * space.labels[order[:k]]).sum() / votes.sum()) < 1e-3
        clear += 1
    assert clear >= len(rows) // 2


def test_pipeline(spark, documents):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == documents.dtypes, name
        docs = corpus_pipeline.materialize(out, "test")
        sizes.append(docs.count())
    assert documents.count() > sizes[0] == sizes[1] >= sizes[2] == sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(map(tuple, last), key=str)[:1] and {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(tuple(r[c] for c in key) for r in last)
    kept = {r.doc_id: r for r in docs.collect()}
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", None, 7, 1) for i, t in EDGE_TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").repartition(2)
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame_ in (docs, docs.limit(0)):
        now = frame_
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), "test")
            assert now.count() >= 0, name


def test_votes_against_brute_force(spark, documents):
    """The same space, all cosines at once, neighbours by a full sort."""
    space = fit(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = documents.select("doc_id", "text").collect()
    counts = np.log1p(term_counts([(r.text or "").encode() for r in rows]).astype(np.float64)) * space.weight
    vectors = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12) @ space.directions
    cosine = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) @ space.vectors.T
    got = {x.doc_id: x.score for x in score_documents(documents, space).collect()}
    for r, c in zip(rows, cosine):
        near = np.argsort(-c)[:NEIGHBOURS]
        vote = np.maximum(c[near], 0) ** SHARPNESS
        want = (vote * space.labels[near]).sum() / vote.sum() if vote.sum() > 1e-9 else space.prior
        assert abs(got[r.doc_id] - want) < 2e-3
