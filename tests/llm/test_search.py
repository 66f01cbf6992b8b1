"""Operators 1 and 8 against brute force."""

import math

import duckdb
import numpy as np
import pytest

from seagrid.llm.crosspolytope import buckets, hadamard, nearest_neighbours, op8_cross_polytope_ann, rotate
from seagrid.llm.vafile import OP1_SQL, build_va_file, op1_vector_approximation_topk, search_va_file

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, queries, k, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_va_file_is_exact(spark, bits):
    g = np.random.default_rng(bits)
    m = g.normal(0, 0.2, (400, 12)).round(2)
    m[100:200] = m[0]  # a hot vector, and ties
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(900, None), (901, []), (902, [None] * 12), (903, [math.nan] * 12), (904, [math.inf] * 12), (905, [1.0, 2.0]), (910, [3.0, 4.0]), (None, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    blocks = build_va_file(df, bits=bits, block_rows=64)
    for chunk in (7, 1000):
        got = search_va_file(blocks, df.filter("vec_id % 25 = 0 OR vec_id >= 900"), k=5, query_chunk=chunk)
        assert sorted(map(tuple, got.collect())) == brute_topk(rows, {*range(0, 400, 25), 905, 910, 900}, 5)


def test_va_file_large_components(spark):
    rows = [(1, [1e12, 2.0]), (2, [3.0, 1e12]), (3, [-1e12, 5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = search_va_file(build_va_file(df), df, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


def test_va_file_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert search_va_file(build_va_file(df), df).collect() == []


def test_op1_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(OP1_SQL).fetchall())
    got = op1_vector_approximation_topk(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_hadamard_is_orthonormal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.linalg.norm(rotate(np.ones((1, 10)) / math.sqrt(10), 3)), 1)


def nearest(rows, k, of):
    out = {}
    for q, v in rows:
        if of(q):
            d = sorted((math.dist(v, w), i) for i, w in rows if i != q)
            out[q] = d[:k]
    return out


def recall(found, rows, of):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(rows, 10, of)
    return sum(len(got.get(q, set()) & {i for _, i in x}) for q, x in want.items()) / (10 * len(want))


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = nearest(rows, 10, lambda q: q % 100 == 0)
    got = {}
    for r in op8_cross_polytope_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want)
    hit, vectors = 0, dict(rows)
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(abs(s - math.dist(vectors[q], vectors[i])) < 1e-12 and i != q for _, s, i in found)
        hit += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("more", [{"hashes": 2}, {"bucket_rows": 10}])
def test_recall_beyond_one_hash(spark, more):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    assert recall(nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"), k=10, **more), rows, lambda i: i % 100 == 0) >= 0.9


def test_recall_of_long_vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(0, 1, (600, 300)).astype(np.float32))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert recall(nearest_neighbours(df, df.filter("vec_id < 20")), rows, lambda i: i < 20) >= 0.9


def test_buckets_by_joint_score():
    unit = rotate(np.random.default_rng(5).normal(0, 1, (4, 8)), 99)
    sums = sum(np.concatenate([x, -x], axis=1)[:, axis] for x, axis in zip((rotate(unit, 3 * 64), rotate(unit, 3 * 64 + 1)), np.divmod(np.arange(256), 16)))
    for n in (1, 7, 100, 256):
        got = buckets(unit, 3, 2, n) - 3 * 256
        assert all(len(set(row)) == n for row in got.tolist())
        assert np.allclose(np.take_along_axis(sums, got, 1), -np.sort(-sums, axis=1)[:, :n])


def test_ann_edge_cases(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [1.0, 0.1, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [None, 1.0, 1.0]), (104, [math.nan, 1.0, 1.0]), (105, []), (106, [5.0, 6.0]), (0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in nearest_neighbours(df, df.filter("vec_id IN (0, 5, 100, 101, 102, 106)"), k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4)] and sorted(got[5]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(got[100]) == [(1, 0), (2, 1), (3, 2), (4, 3)] and set(got) == {0, 5, 100}
    assert nearest_neighbours(df.limit(0), df.limit(0)).collect() == []
