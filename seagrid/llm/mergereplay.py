"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 7).

The texts of a block (one Arrow batch, some ten thousand documents) are split into
pre-tokens, of which each distinct one is encoded once. All new words stand in one
symbol array; an inverted index leads from the rank of a token pair to the places
in it where that pair begins. Merges are applied in rank order, each to all its
places at once, and only the touched neighbours are looked up and indexed anew.
Words do not influence each other, so blocks need no exchange between tasks; each
worker remembers the words of earlier blocks, up to ``MOST_WORDS``.

A rank file may let a merge create a pair of lower rank. A word in which that
happens is encoded again by itself, always merging its lowest pair first.

Edge cases: a null or empty text has no ids and decodes to no bytes. Special tokens
are ordinary text. A word that is itself in the rank file is one token. Repeated
rows are encoded each. Any id outside the rank file makes decoding fail.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import slices, table
from seagrid.llm.fst import LETTER, NUMBER, OTHER, SPACE, CharacterClasses, pretoken_starts

MOST_WORDS = 500_000
NONE = np.int32(2**31 - 1)


def tiktoken_probe(char: str) -> int:
    """The class of a character in tiktoken's regular expressions."""
    for kind, encoding in _class_encodings().items():
        if encoding.encode_ordinary(char):
            return kind
    return OTHER


@functools.lru_cache(maxsize=1)
def _class_encodings() -> dict:
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    return {kind: tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}) for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))}


class Splitter:
    """Pre-tokens by the split pattern of byte-level rank files, as tiktoken finds them."""

    PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")

    def __init__(self):
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.classes = CharacterClasses(tiktoken_probe)

    def __call__(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        first = np.zeros(len(text), bool)
        first[0] = True
        cuts = np.flatnonzero(pretoken_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), first, self.classes)).tolist()
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class RankFile:
    """A vocabulary of byte strings by rank; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        order = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = order, np.array([pairs[k] for k in order.tolist()], np.int32)
        self.pairs = pairs
        most = max(self.bytes_of, default=-1) + 1
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(most)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(most)), np.uint8)
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_word(self, word: bytes) -> list[int]:
        """One word by itself: always the lowest pair, the leftmost of equal ones."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        parts = self.single[np.frombuffer(word, np.uint8)].tolist()
        while len(parts) > 1:
            rank, at = min((self.pairs.get(a << 32 | b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[at : at + 2] = [rank]
        return parts

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        follow = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        full = lengths > 0
        follow[begin[full] + lengths[full] - 1] = -1
        before[begin[full]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(follow >= 0)
        # Words that are tokens themselves need no merges.
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        word_of = np.repeat(np.arange(len(words)), lengths)
        inner = inner[whole[word_of[inner]] < 0]
        pair[inner] = self.pair_rank(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(places: np.ndarray) -> None:
            """Enter the places under the ranks of the pairs that begin there."""
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                rank = int(ranks[a])
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(queue, rank)

        odd: set[int] = set()
        if len(some := inner[pair[inner] != NONE]):
            file(some)
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[pair[at] == rank]
            if not len(at):
                continue
            gone = follow[at]
            linked = gone[:-1] == at[1:]
            if linked.any():  # overlapping places: every other one of a run, from its left
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(True, ~linked), place, 0))
                at = at[(place - run) % 2 == 0]
                gone = follow[at]
            beyond = follow[gone]
            symbol[at] = rank
            alive[gone] = False
            pair[gone] = NONE
            follow[at] = beyond
            pair[at] = NONE
            right = at[beyond >= 0]
            before[follow[right]] = right
            touched = np.unique(np.concatenate([right, (left := before[at])[left >= 0]]))
            if len(touched):
                pair[touched] = new = self.pair_rank(symbol[touched], symbol[follow[touched]])
                if (low := touched[new < rank]).size:
                    odd.update(word_of[low].tolist())
                if len(touched := touched[new != NONE]):
                    file(touched)
        counts = np.bincount(word_of[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
        ids = symbol[alive]
        special = sorted({*np.flatnonzero(whole >= 0).tolist(), *odd})
        if special:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w in special:
                parts[w] = np.array([whole[w]] if whole[w] >= 0 else self.encode_word(words[w]), np.int32)
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.max() >= len(self.token_length) or (self.token_length[ids] == 0).any()):
            raise ValueError("an id that the rank file doesn't have")
        return spans(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def spans(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length] over all rows."""
    shift = start - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(int(length.sum()))]


class CorpusEncoder:
    """Encodes block after block, remembering the words it has met."""

    def __init__(self, path: str):
        self.file, self.split = RankFile(path), Splitter()
        self.clear()

    def clear(self) -> None:
        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                self[word] = number = len(self)
                return number

        self.number = Numbers()
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MOST_WORDS:
            self.clear()
        known = len(self.length)
        number = self.number.__getitem__
        rows = [np.array(list(map(number, self.split(t))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        if len(self.number) > known:
            new = [w.encode() for w in list(self.number)[known:]]
            ids, counts = self.file.replay(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.ids = np.concatenate([self.ids, ids])
        return [spans(self.ids, self.start[r], self.length[r]) for r in rows]


@functools.lru_cache(maxsize=2)
def corpus_encoder(path: str) -> CorpusEncoder:
    return CorpusEncoder(path)


def _emit(doc_ids: list, columns: dict[str, list[bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes."""
    start = held = 0
    for i in range(len(doc_ids) + 1):
        if i == len(doc_ids) or held > most:
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[start:i], pa.int64()), *(pa.array(c[start:i], pa.binary()) for c in columns.values())], names=["doc_id", *columns])
            start, held = i, 0
        if i < len(doc_ids):
            held += sum(len(c[i]) for c in columns.values())


def encode_decode(docs: DataFrame, rank_file: str, *, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and, if asked for, the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = corpus_encoder(rank_file)
        for batch in slices(batches, 5000):
            rows = encoder.encode(batch.column(1).to_pylist())
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, len(rows), 500):
                columns = {"ids": [r.astype("<u4").tobytes() for r in rows[at : at + 500]]}
                if decode:
                    columns["decoded"] = [encoder.file.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in columns["ids"]]
                yield from _emit(doc_ids[at : at + 500], columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decode)


def op7_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
