"""Best-fit packing of tokenized documents into fixed-length sequences (operator 2).

Whole texts are tokenized, an end id is added, and documents longer than the
capacity are cut into full pieces and a rest. Packing looks at lengths only, of
which there are at most ``capacity``: their histogram, whose size the capacity
bounds, goes to the driver. Items above one third of the capacity are matched
greedily, at most two to a bin, the largest with the largest that fits beside it;
smaller items then go, longest first, into the smallest gap that takes them.
Equal bins are kept as one pattern with a count, so the plan is as small for 100 TB
as for a test. Pieces find their place by their rank within their length, counted
in hashed parts so that a frequent length is never gathered in one task.

Edge cases: a null or empty text is one piece that holds the end id only. Repeated
rows are packed each. Very long texts are cut; nothing is dropped.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import materialize, short_batches, slices, table
from seagrid.llm.fst import byte_alphabet

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


class WordTokenizer:
    """A tokenizer file whose pre-tokens are encoded one by one, with a memory of them.

    Texts of plain Latin letters, digits and marks take the quick path: there the
    normalizer only lowers letters, and the words of the text can be looked up.
    All other texts, and those with special strings, go through the library whole.
    """

    PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ɏ]*")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokenize = self.tokenizer.model.tokenize
        stand_in = {b: c for c, b in byte_alphabet().items()}

        class Memory(dict):
            """A word is a pre-token, so that the model alone can encode it; it takes bytes as printable stand-ins."""

            def __missing__(self, word: str) -> bytes:
                if len(self) >= most:
                    self.clear()
                piece = word if word.isascii() else "".join([stand_in[b] for b in word.encode()])
                self[word] = ids = np.array([t.id for t in tokenize(piece)], "<u4").tobytes()
                return ids

        self.memory = Memory()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            memory = self.memory
            return b"".join([memory[w] for w in self.WORDS.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document with their ids (little-endian unsigned 32-bit)."""
    short_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        encode = words.encode
        for batch in slices(batches, 500):
            doc_ids, pieces, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = encode(text or "") + end
                for piece, at in enumerate(range(0, len(whole), step)):
                    doc_ids.append(doc_id)
                    pieces.append(piece)
                    ids.append(whole[at : at + step])
            piece = np.array(pieces, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(np.array([len(x) // 4 for x in ids], np.int64)), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        words.memory.clear()  # the worker may go on with other operators

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies), ...], number of bins) that hold ``counts`` items of each length."""
    left = dict(counts)
    done: list[tuple[list[tuple[int, int]], int]] = []
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    sizes: list[int] = []

    def keep(pattern: list[tuple[int, int]], bins: int, gap: int) -> None:
        if bins <= 0:
            return
        if gap == 0:
            done.append((pattern, bins))
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((pattern, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        b = large[bisect.bisect_right(large, capacity - a) - 1] if large[0] <= capacity - a else None
        if b is None:
            pairs, pattern, gap = left[a], [(a, 1)], capacity - a
            left[a] = 0
        elif b == a:
            pairs, pattern, gap = left[a] // 2, [(a, 2)], capacity - 2 * a
            left[a] -= 2 * pairs
            if left[a] and not pairs:  # one is left; the next smaller one may go beside it
                rest = large[:-1]
                c = rest[-1] if rest else None
                pairs, left[a] = 1, 0
                pattern, gap = ([(a, 1), (c, 1)], capacity - a - c) if c else ([(a, 1)], capacity - a)
                if c:
                    left[c] -= 1
        else:
            pairs = min(left[a], left[b])
            pattern, gap = [(a, 1), (b, 1)], capacity - a - b
            left[a] -= pairs
            left[b] -= pairs
        keep(pattern, pairs, gap)
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                pattern, bins, gap = [], todo, capacity
            else:
                gap = sizes[at]
                pattern, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            copies = gap // n
            full = min(bins, todo // copies)
            keep([*pattern, (n, copies)], full, gap - copies * n)
            todo -= full * copies
            bins -= full
            if bins and todo and todo < copies:
                keep([*pattern, (n, todo)], 1, gap - todo * n)
                todo, bins = 0, bins - 1
            if pattern:
                keep(pattern, bins, gap)
    return done + [x for group in gaps.values() for x in group]


def slot_table(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Where the r-th item of a length goes: rows sorted by length and first rank."""
    rows, sequence, used = [], 0, {}
    for pattern, bins in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * bins
            offset += length * copies
        sequence += bins
    rows.sort()
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("length", "first", "sequence", "copies", "offset"))}


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096, payload: list[Column] | None = None, rows_per_part: int = 200_000) -> DataFrame:
    """A place for every piece: doc_id, piece, start, length, payload, sequence_id, offset.

    ``payload`` are expressions over a piece (by default its ids) to be carried along.
    """
    payload = [F.col("ids")] if payload is None else payload
    own = materialize(pieces.select("doc_id", "piece", "start", "length", *payload), "pieces")
    counts = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = own.sparkSession.sparkContext.broadcast(slot_table(plan_bins(counts, capacity)))
    parts = max(1, -(-sum(counts.values()) // rows_per_part))
    extra = [c for c in own.columns if c not in ("doc_id", "piece", "start", "length")]
    tied = F.xxhash64("doc_id", "piece", *extra)
    dealt = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = dealt.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", tied)) - 1)
    ranked = ranked.join(before.select("length", "part", "before"), ["length", "part"]).withColumn("r", F.col("r") + F.coalesce("before", F.lit(0)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = slots.value
        n, r = length.to_numpy(), rank.to_numpy()
        lo, hi = np.searchsorted(t["length"], n, "left"), np.searchsorted(t["length"], n, "right")
        while (hi - lo > 1).any():  # the last row of this length whose first rank isn't above r
            mid = (lo + hi) // 2
            up = (t["first"][np.minimum(mid, len(t["first"]) - 1)] <= r) & (hi - lo > 1)
            lo, hi = np.where(up, mid, lo), np.where(up | (hi - lo <= 1), hi, mid)
        within = r - t["first"][lo]
        return pd.DataFrame({"sequence_id": t["sequence"][lo] + within // t["copies"][lo], "offset": t["offset"][lo] + within % t["copies"][lo] * n})

    return ranked.withColumn("at", place("length", "r")).select("doc_id", "piece", "start", "length", *extra, "at.sequence_id", "at.offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    packed = pack_pieces(pieces, payload=[F.crc32("ids").alias("ids_crc32")])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
