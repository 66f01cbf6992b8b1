"""Operators 2, 6 and 7 against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from conftest import EDGE_TEXTS, frame
from seagrid.llm import mergereplay
from seagrid.llm.fst import CountingTransducer, count_tokens, op6_finite_state_token_counts
from seagrid.llm.mergereplay import RankFile, encode_decode, op7_merge_replay_bpe
from seagrid.llm.packing import WordTokenizer, op2_best_fit_packing, pack_pieces, plan_bins, tokenize_pieces

PIECES = ["'s", "'re", "'ll", "'", "''", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "a", "ab", "the", "The", "é", "中", "文", "١", "²", "½", "😀", "!!", "-", "_", "\xa0", "　", "\x1c", "\x85", "​", "0", "12", "Ünï", "İ", "ǅ", "́", "Σ", "ς"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = ["".join(r.choices(PIECES, k=r.randint(0, 12))) for _ in range(3000)]
    out += ["".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0x80, 0x800), r.randrange(0x800, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(r.randint(0, 20))) for _ in range(1500)]
    return out + ["a" * 30_000, " " * 4000 + "x", "aab" * 9000, "\n" * 3000, "", "ab" * 3000 + "a" * 999]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_transducer_counts_as_the_library(texts):
    machine, want = CountingTransducer(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    n_bytes, n_tokens = machine.count(texts)
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert n_tokens.tolist() == [len(e.ids) for e in want.encode_batch(texts, add_special_tokens=False)]


def test_transducer_after_resets(texts, monkeypatch):
    import seagrid.llm.fst as fst

    monkeypatch.setattr(fst, "MAX_STATES", 50)
    monkeypatch.setattr(fst, "CHUNKS", 7)
    machine, want = CountingTransducer(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    some = texts[:60] + texts[-6:]
    assert [int(machine.count([t])[1][0]) for t in some] == [len(want.encode(t, add_special_tokens=False).ids) for t in some]


def test_stays_apart_is_the_encoding_of_both():
    m = CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    want = library("byte_bpe_50k.json")
    vocabulary = {i: t for t, i in want.get_vocab().items()}
    r = random.Random(9)
    for _ in range(4000):
        a, b = r.choice(list(m.rank)), r.choice(list(m.rank))
        joined = want.model.tokenize(vocabulary[a] + vocabulary[b])
        assert m.stays_apart(a, b) == ([t.id for t in joined] == [a, b])


def test_op6(spark, documents):
    want = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in op6_finite_state_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in documents.collect():
        n = len(want.encode(d.text, add_special_tokens=False).ids)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(d.text.encode()), n, n > 512)


def test_op6_edge_cases(spark):
    got = count_tokens(frame(spark, EDGE_TEXTS), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = library("byte_bpe_50k.json")
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in got) == sorted(((i or -1), len((t or "").encode()), len(want.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE_TEXTS)
    assert count_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_encodes_as_the_library(texts, tik):
    encoder = mergereplay.CorpusEncoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for block in (texts[:2000], texts[2000:], texts[:50]):
        for text, ids in zip(block, encoder.encode(block)):
            assert ids.tolist() == tik.encode_ordinary(text)
            assert encoder.file.decode(ids) == text.encode()


def test_replay_where_merges_make_lower_pairs(tmp_path):
    """Ranks without the usual order: each word must still merge its lowest pair first."""
    r = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = {bytes(r.choices(b"abc", k=r.randint(2, 6))) for _ in range(60)}
    for t in r.sample(sorted(tokens), len(tokens)):
        ranks[t] = len(ranks)
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
    import tiktoken

    want = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    f = RankFile(str(path))
    words = sorted({bytes(r.choices(b"abc", k=r.randint(1, 30))) for _ in range(3000)})
    ids, counts = f.replay(words)
    for w, part in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == f.encode_word(w) == want.encode_ordinary(w.decode())


def test_op7(spark, documents, tik):
    rows = {r.doc_id: r for r in op7_merge_replay_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in documents.collect():
        ids = tik.encode_ordinary(d.text)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_op7_edge_cases(spark, tik):
    got = encode_decode(frame(spark, EDGE_TEXTS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted(((r.doc_id or -1), bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(((i or -1), (t or "").encode(), tik.encode_ordinary(t or "")) for i, t in EDGE_TEXTS)


def test_word_tokenizer(texts):
    own, want = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), most=500), library("word_bpe_49k.json")
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_every_item(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 4096])
    counts = {r.randint(1, capacity): r.choice([1, 2, 3, 20]) for _ in range(r.choice([1, 5, 60]))}
    placed: dict[int, int] = {}
    bins = 0
    for pattern, n in plan_bins(counts, capacity):
        assert sum(length * k for length, k in pattern) <= capacity and n > 0
        assert sum(k for length, k in pattern if 3 * length > capacity) <= 2 or all(3 * length == capacity for length, _ in pattern)
        bins += n
        for length, k in pattern:
            placed[length] = placed.get(length, 0) + k * n
    assert placed == counts
    rooms: list[int] = []  # first fit, longest first
    for length in sorted((length for length, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(capacity)
            at = -1
        rooms[at] -= length
    assert -(-sum(length * n for length, n in counts.items()) // capacity) <= bins <= len(rooms) * 1.03 + 1


def check_packing(rows, texts, capacity):
    want = library("word_bpe_49k.json")
    seen: dict[int, list] = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    got = sorted(((r.doc_id or -1), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for i, t in texts:
        ids = [*want.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append(((i or -1), p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert got == sorted(expected)
    return len(seen), sum(x[3] for x in expected)


def test_op2(spark, documents):
    rows = op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n, total = check_packing(rows, [(d.doc_id, d.text) for d in documents.collect()], 4096)
    assert n == -(-total // 4096)


def test_op2_edge_cases(spark):
    from pyspark.sql import functions as F

    pieces = tokenize_pieces(frame(spark, EDGE_TEXTS), public_tokenizers.path("word_bpe_49k.json"), capacity=128)
    rows = pack_pieces(pieces, capacity=128, payload=[F.crc32("ids").alias("ids_crc32")], rows_per_part=3).collect()
    check_packing(rows, EDGE_TEXTS, 128)
    assert pack_pieces(tokenize_pieces(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"))).collect() == []
