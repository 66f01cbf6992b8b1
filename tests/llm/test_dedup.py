"""Operators 4, 9 and 10 against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import EDGE_TEXTS, frame
from seagrid.llm import jaccardjoin, linededup, suffixdedup
from seagrid.llm.components import components
from seagrid.llm.jaccardjoin import allocate, jaccard_components, most_apart, op10_ngram_jaccard_join, size_bands
from seagrid.llm.linededup import op4_line_similarity_dedup, remove_repeated_lines
from seagrid.llm.suffixdedup import op9_suffix_array_dedup, remove_repeats, whole_characters
from seagrid.llm.suffixkernel import permuted_common_prefixes, suffix_array


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# Operator 10


def brute_components(rows, k, num, den):
    sets, parent = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d in sorted(sets):
        common = collections.Counter(e for s in sets[d] for e in holders.get(s, ()))
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
        for e, i in common.items():
            if den * i >= num * (len(sets[d]) + len(sets[e]) - i):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        base = r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 9, 12, 20, 40, 100, 300]))
        for _ in range(r.choice([1, 2, 3, 8, 60])):
            p = r.choice([0, 0.005, 0.01, 0.02, 0.05])
            rows.append((len(rows) * 3 + 1, " ".join(r.choice(vocabulary) if r.random() < p else x for x in base)))
    return rows + [(100001, None), (100002, ""), (100003, "  \n"), (100004, "one"), (100005, "ONE"), (100006, "one two")]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, near_copies, k, num):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(frame(spark, near_copies), words=k, num=num, den=100).collect()}
    assert got == brute_components(near_copies, k, num, 100)


def test_jaccard_components_in_small_blocks(spark, near_copies, monkeypatch):
    for name, value in {"PART_CLASSES": 4, "BLOCK_SHINGLES": 4096, "BROADCAST_ROWS": 2, "FILTER_BITS": 1 << 15}.items():
        monkeypatch.setattr(jaccardjoin, name, value)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(frame(spark, near_copies), words=5, num=80, den=100).collect()}
    assert got == brute_components(near_copies, 5, 80, 100)


def test_maps_never_part_similar_sets():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 63, 64, 65, 130, 1000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.unique(np.append(a[r.random(n) > 0.1], r.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)))
        x, y = jaccardjoin.set_map(a), jaccardjoin.set_map(b)
        size = min(len(x), len(y))
        differ = np.bitwise_count(jaccardjoin.folded(x, size) ^ jaccardjoin.folded(y, size)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_op10(spark, documents):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op10_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_components([tuple(x) for x in documents.select("doc_id", "text").collect()], 3, 90, 100)


def test_op10_edge_cases(spark):
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id) for x in jaccard_components(frame(spark, EDGE_TEXTS)).collect())
    assert len(got) == len(EDGE_TEXTS)
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5][1] == by[6][1] == 5 and by[10][1] == by[11][1] == 10 and by[9] == (1, 9)
    assert jaccard_components(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "a b c d", 5, "x")], "doc_id long, text string, signature long, `key` string")
    assert jaccard_components(odd).collect()[0].component_id == 1


def test_bands_and_levels():
    for num in (90, 80):
        low, high = size_bands(num, 100, 5000)
        assert (low[1:] == high[:-1] + 1).all()
        band = {n: i for i, (a, b) in enumerate(zip(low, high)) for n in range(a, b + 1)}
        for n in range(1, 4000, 7):
            least = -(-n * num // 100)
            assert band[least] >= band[n] - 1
    for size in (1, 5, 10, 30, 200, 3000):
        for population in (1, 1000, 10**9):
            for num in (90, 80):
                segments, twice, spare = allocate(size, size, num, 100, population)
                assert segments - spare + twice == most_apart(2 * size, num, 100) + 1 and 0 <= twice <= segments and not (twice and spare)


# Operator 9


@pytest.mark.parametrize(("n", "symbols"), [(2000, 3), (3000, 1), (3000, 2), (2000, 90), (1, 1), (2, 1)])
def test_suffix_array(n, symbols):
    t = np.append(np.random.default_rng(n + symbols).integers(1, symbols + 1, n), 0).astype(np.uint16)
    raw = t.astype(">u2").tobytes()
    sa = suffix_array(t, n + 1)
    assert sa.tolist() == sorted(range(n + 1), key=lambda i: raw[2 * i :])
    plcp = permuted_common_prefixes(t, sa, 20)
    for a, b in zip(sa[:-1], sa[1:]):
        common = next((k for k in range(20) if t[a + k] != t[b + k]), 20)
        assert (plcp[b] == 20) == (common == 20) and 0 <= common - plcp[b] < 8


def brute_repeats(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), kept)
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(1)
    words = ["the", "of", "and", "é", "ü", "x" * 30] + [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choices(words, k=n))
    shared = [text(r.choice([15, 20, 25, 40, 80])) for _ in range(12)]
    rows = []
    for i in range(200):
        p = r.random()
        if p < 0.1:
            t = r.choice([None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 700, "a" * 1000, " " * 300])
        elif p < 0.2 and rows:
            t = r.choice(rows)[1]
        else:
            t = " ".join(r.choice([text(r.randint(1, 60)), r.choice(shared)]) for _ in range(r.randint(1, 5)))
        rows.append((i * 7 % 307, t if t is not None else ""))
    return rows


def repeats(df, **more):
    return {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in remove_repeats(df, **more).collect()}


@pytest.mark.parametrize("change", [{}, {"HOT_SNIPPETS": 20}, {"_PART": 1 << 10, "BUFFER_BYTES": 1 << 9}, {"SHARD_BYTES": 2000, "MOST_SEEN": 3}, {"FILTER_BITS": 1 << 15}, {"BROADCAST_DOCS": 3, "BROADCAST_ROWS": 2}])
def test_repeats(spark, passages, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(suffixdedup, name, value)
    assert repeats(frame(spark, passages, parts=5)) == brute_repeats(passages)


def test_repeat_in_two_parts_of_one_text(spark):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = letters[np.random.default_rng(11).integers(0, 26, suffixdedup._PART + 100_000)].tobytes().decode()
    far = text + "[" + text[:300] + "]"
    (got,) = remove_repeats(frame(spark, [(1, far)], parts=1)).collect()
    assert [(x.start, x.stop) for x in got.spans] == [(len(far) - 301, len(far) - 1)] and bytes(got.kept).decode() == text + "[]"


def test_op9(spark, documents):
    want = brute_repeats([tuple(x) for x in documents.select("doc_id", "text").collect()])
    for x in op9_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect():
        n, gone, spans, kept = want[x.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_op9_edge_cases(spark):
    got = collections.defaultdict(list)
    for x in remove_repeats(frame(spark, EDGE_TEXTS), keep=["text"]).withColumn("whole", whole_characters(F.col("kept"))).collect():
        got[x.doc_id].append((x.n_bytes, x.n_removed))
        assert x.whole.encode() == bytes(x.kept)
    assert sum(map(len, got.values())) == len(EDGE_TEXTS)
    assert got[1] == got[2] == [(0, 0)] and got[8] == [(50_000, 49_999)] and got[11] == [(31, 0)] * 2
    assert remove_repeats(frame(spark, [])).collect() == []
    cut = spark.createDataFrame([(bytearray("é".encode()[:1] + b"a"),), (None,)], "b binary").select(whole_characters(F.col("b"))).collect()
    assert [r[0] for r in cut] == ["a", None]


# Operator 4


def brute_lines(rows, num=80, den=100):
    lines = [(d, j, frozenset(line.encode().split())) for d, t in sorted(rows, key=lambda x: x[0]) for j, line in enumerate((t or "").split("\n")) if line.encode().split()]
    holders, gone = collections.defaultdict(list), collections.defaultdict(set)
    for i, (d, j, s) in enumerate(lines):
        common = collections.Counter(k for w in s for k in holders[w])
        for w in s:
            holders[w].append(i)
        if any(den * o >= num * (len(s) + len(lines[k][2]) - o) for k, o in common.items()):
            gone[d].add(j)
    return {d: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) for d, t in rows}


@pytest.fixture(scope="module")
def line_rows():
    r = random.Random(2)
    rare, common = [f"w{i}" for i in range(3000)], ["the", "of", "and", "to", "in"]
    line = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n)]
    bases = [line(r.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 40, 90, 120, 135, 200])) for _ in range(50)]
    near = lambda x: [r.choice(rare) if r.random() < r.choice([0, 0.03, 0.08]) else w for w in x]
    rows = []
    for i in range(200):
        text = "\n".join(" ".join(near(r.choice(bases)) if r.random() < 0.5 else line(r.randint(0, 30))) for _ in range(r.randint(1, 8)))
        rows.append((i * 7 % 307, r.choice([None, "", "\n\n"]) if r.random() < 0.04 else text))
    return rows


@pytest.mark.parametrize("change", [{}, {"HOT_LEVEL": 3, "BLOCK_ROWS": 8}, {"MOST_SEEN": 2, "CHUNK_LINES": 5}, {"BROADCAST_ROWS": 2, "PAIRS": 7, "TASK_ENTRIES": 50, "NEIGHBOURS": 1}, {"FOLDED_LINE": 4, "SHORT_LINE": 20, "LEAST_PARTS": 1}])
def test_lines(spark, line_rows, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(linededup, name, value)
    got = {x.doc_id: x.text for x in remove_repeated_lines(frame(spark, line_rows, parts=5)).collect()}
    assert got == brute_lines(line_rows)


def test_op4(spark, documents):
    want = brute_lines([tuple(x) for x in documents.select("doc_id", "text").collect()])
    for x in op4_line_similarity_dedup(spark, "/root/testdata/sf0.001").collect():
        assert (x.n_chars, x.text_sha256) == (len(want[x.doc_id]), hashlib.sha256(want[x.doc_id].encode()).hexdigest())


def test_op4_edge_cases(spark):
    got = collections.defaultdict(list)
    for x in remove_repeated_lines(frame(spark, EDGE_TEXTS)).collect():
        got[x.doc_id].append(x.text)
    assert sum(map(len, got.values())) == len(EDGE_TEXTS)
    assert got[1] == [None] and got[2] == [""] and got[3] == [" \n\t "] and got[10] == ["same text of seven words in all"] and got[11] == [""] * 2
    assert remove_repeated_lines(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "a b\na b", 3, 4)], "doc_id long, text string, line long, ord long")
    assert remove_repeated_lines(odd, keep=["doc_id", "line", "ord"]).collect()[0][:] == (1, 3, 4, "a b", 1)
