"""Line deduplication by an exact set-similarity join (operator 4).

A line is the set of its words. A line goes if an earlier one (smaller document id,
or the same document further up) has a Jaccard similarity of ``num`` / ``den`` or
more with it; lines are judged on the input, removed ones too. Lines without words
stay.

1. Words are counted over all lines in ``BUCKETS`` hashed sums, which order them by
   rarity: words of one occurrence first, then by the logarithm of their sum. The
   table has a fixed size; any order keeps the join exact.
2. Lines with equal sets form one class, which is known by its earliest line. A task
   that saw a set earlier in the corpus doesn't send it again.
3. Similar sets share a word among their rarest ones (prefix filter). Entries (word,
   line) go to their word's part packed in arrays. Under a word, lines are sorted by
   size; a line meets the larger ones up to the size that its place in the order of
   words still allows (length and positional filter), and a pair passes if maps of
   both sets don't differ in more places than similar sets can. Each line takes its
   earliest passing neighbours; the pairs are verified on whole sets of 64-bit word
   hashes. Lines that are still in place and have more neighbours then take all.
4. Prefix words above ``HOT_COUNT`` occurrences are not gathered by word: their
   lines stand in blocks, and blocks are compared with blocks.

Edge cases: a null text stays null, an empty one empty. Rows that repeat id and text
are one document, and each gets its result; different texts of one id (or of the null
id) are told apart and ordered by 34 bits of a hash. Null ids come last. Ties can't
occur, as lines are ordered by document and place. Texts of any length are taken whole,
with up to 2**29 lines. An empty table gives an empty result. Lines end with a line
feed only; what stays is joined by line feeds. Words are parted by ASCII white space.
Columns of any name may stand beside id and text; ``keep`` may hold any of them but
text and n_removed, the names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import bitmap_of, materialize, release_memory, scratch_scope, short_batches, slices, table
from seagrid.llm.wordkernel import distinct, find_words, hash_words, mix

HASH_BITS = 42
BUCKET_BITS = 26
#: Buckets are counted and sent in chunks.
CHUNK_BITS = 16
HOT_COUNT = 1 << 14
#: Levels are logarithms of sums, in four bits; 0 is a word of one occurrence.
HOT_LEVEL = int(np.log2(HOT_COUNT))
FILTER_BITS = 1 << 27
CHUNK_LINES = 1 << 15
MOST_SEEN = 120_000
#: A prefix entry is one integer: word, and place in the order of the line's words (capped).
PLACE_BITS = 11
#: Lines of up to so many words are compared by maps of 64 bits, up to ``SHORT_LINE`` by 128, longer ones by wide maps.
FOLDED_LINE = 64
SHORT_LINE = 180
NEIGHBOURS = 2
WIDE_BITS = 256
#: Parts of entries at least: then hardly two entries of a line meet in a part, at any size.
LEAST_PARTS = 64
BLOCK_ROWS = 512
TASK_ENTRIES = 250_000
#: Pairs looked at together.
PAIRS = 1 << 19
BROADCAST_ROWS = 300_000
_LAST = (1 << 63) - 1
#: Bits of a line's number; those above tell texts of one id apart.
LINE_BITS = 29


def _narrow(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - HASH_BITS)


def joined_texts(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2000, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts with a line feed after each, first byte of each text) in buffers of some megabytes."""
    for batch in slices(batches, rows):
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, to - at)
            fed = pc.binary_join_element_wise(pc.fill_null(part.column(column), "").cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
            offsets = np.frombuffer(fed.buffers()[1], np.int64)[fed.offset : fed.offset + len(fed) + 1]
            yield part, np.frombuffer(fed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
            at = to


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the stretches of an array between neighbouring cuts."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of buckets with those that have words, and how many (up to 65,535)."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
        held.clear()
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        h, n = h[at], np.diff(np.append(at, len(h)))
        chunk = h >> np.uint32(CHUNK_BITS)
        new = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])[: len(h)])
        cuts = np.append(new, len(h))
        places = _binary((h & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint16), cuts)
        return pa.RecordBatch.from_arrays([pa.array(chunk[new].astype(np.int32)), places, _binary(np.minimum(n, 65535).astype(np.uint16), cuts)], names=["chunk", "places", "counts"])

    for _, data, _ in joined_texts(batches, 0):
        held.append((hash_words(data, *find_words(data)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
        if sum(map(len, held)) > 4_000_000:
            yield out()
    yield out()


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of each chunk, two in a byte; rows come sorted by chunk, so that one chunk is held at a time."""
    now, sums = None, np.zeros(1 << CHUNK_BITS, np.int64)

    def out() -> pa.RecordBatch:
        level = np.minimum(np.log2(np.maximum(sums, 1)), 15).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], names=["chunk", "levels"])

    for batch in batches:
        for chunk, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if chunk != now:
                if now is not None:
                    yield out()
                now = chunk
                sums[:] = 0
            sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint16)
    if now is not None:
        yield out()


class Rarity:
    """The order of words: 0 for words of one occurrence, else the level of their bucket."""

    def __init__(self, levels: bytes):
        self.levels = np.frombuffer(levels, np.uint8)

    def __call__(self, word: np.ndarray) -> np.ndarray:
        bucket = word >> np.uint64(HASH_BITS - BUCKET_BITS)
        return self.levels[bucket >> np.uint64(1)] >> ((bucket & np.uint64(1)) * np.uint64(4)).astype(np.uint8) & 15


def least_overlap(total, num: int, den: int):
    """The smallest common part of two similar sets with ``total`` words together."""
    return -(-(num * total) // (num + den))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values in order of their owners as one list for each of n owners."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sign_lines(num: int, den: int, levels):
    """One row per line with words: where it is, its set (two sums of word mixes), size, map and prefix entries.

    Size, map and entries are left out where the task has sent the set for an earlier line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(levels.value)
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for rows, data, begin in joined_texts(batches, 2):
            ords, bases = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            first, last = find_words(data)
            if not len(first):
                continue
            h = _narrow(hash_words(data, first, last))
            level = rarity(h).astype(np.uint64)
            feeds = np.flatnonzero(data == 10)
            line_of = np.searchsorted(feeds, first)  # lines of the buffer, blank ones counted
            starts = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))
            owner = np.searchsorted(begin, first[starts], "right") - 1
            number = line_of[starts] - np.searchsorted(feeds, begin)[owner] + bases[owner]
            edge = np.append(starts, len(first))
            for a in range(0, len(starts), CHUNK_LINES):
                b = min(len(starts), a + CHUNK_LINES)
                part = slice(edge[a], edge[b])
                line = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(edge[a : b + 1]))
                packed = np.sort(line << np.uint64(HASH_BITS + 4) | level[part] << np.uint64(HASH_BITS) | h[part])
                packed = packed[np.append(True, packed[1:] != packed[:-1])]
                of = (packed >> np.uint64(HASH_BITS + 4)).astype(np.int64)
                word = packed & np.uint64((1 << HASH_BITS) - 1)
                lev = (packed >> np.uint64(HASH_BITS) & np.uint64(15)).astype(np.int64)
                size = np.bincount(of, minlength=b - a)
                start = np.cumsum(size) - size
                mixed = mix(word + np.uint64(1))
                bit = np.uint64(1) << (mixed & np.uint64(63))
                upper = (mixed & np.uint64(64)) > 0
                with np.errstate(over="ignore"):
                    k1, k2 = (np.add.reduceat(v, start).view(np.int64) for v in (mixed, mix(mixed + np.uint64(7))))
                zero = np.uint64(0)
                b1, b2 = (np.bitwise_or.reduceat(np.where(side, bit, zero), start).view(np.int64) for side in (upper, ~upper))
                place = np.arange(len(of)) - start[of]
                where = ords[owner[a:b]]
                fresh = np.ones(b - a, bool)
                for i, (set_, at) in enumerate(zip(zip(k1.tolist(), k2.tolist()), zip(where.tolist(), number[a:b].tolist()))):
                    known = seen.get(set_)
                    if known is not None and known < at:
                        fresh[i] = False
                    else:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen[set_] = at
                send = fresh[of] & (place < (size - -(-num * size // den) + 1)[of]) & (lev > 0)  # a word of one occurrence has no partner
                entry = (word[send].astype(np.int64) << PLACE_BITS) | np.minimum(place[send], (1 << PLACE_BITS) - 1)
                frequent = lev[send] >= HOT_LEVEL
                entries = [_lists(entry[side], of[send][side], b - a) for side in (~frequent, frequent)]
                stale = ~fresh
                # Long lines, and those short ones that may be similar to them, have a wide map too.
                wide_line = fresh & (size * den >= (SHORT_LINE + 1) * num)
                wide_row = np.cumsum(wide_line) - 1
                wide_word = wide_line[of]
                bits = np.zeros((int(wide_line.sum()), WIDE_BITS), np.uint8)
                bits[wide_row[of[wide_word]], (mixed[wide_word] >> np.uint64(7) & np.uint64(WIDE_BITS - 1)).astype(np.int64)] = 1
                packed_maps = np.packbits(bits, axis=1).tobytes()
                step = WIDE_BITS // 8
                wide = [packed_maps[r * step : (r + 1) * step] if w else None for r, w in zip(wide_row.tolist(), wide_line.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(number[a:b].astype(np.int64)), pa.array(k1), pa.array(k2), *(pa.array(x, mask=stale) for x in (size.astype(np.int64), b1, b2)), pa.array(wide, pa.binary()), *entries],
                    names=["ord", "line", "k1", "k2", "size", "b1", "b2", "wide", "entries", "frequent"],
                )

    return run


_LINES = "ord long, line long, k1 long, k2 long, size long, b1 long, b2 long, wide binary, entries array<long>, frequent array<long>"


def _passes(x: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length, positional and bit map filter for the rows i and j of the columns x."""
    n, m = x["size"][i], x["size"][j]
    need = least_overlap(n + m, num, den)
    good = np.minimum(n, m) * den >= np.maximum(n, m) * num
    good &= np.minimum(n - x["place"][i], m - x["place"][j]) >= need
    at = np.flatnonzero(good)
    i, j, most = i[at], j[at], (n + m - 2 * need)[at]
    a1, a2, z1, z2 = (x[b][k].view(np.uint64) for k in (i, j) for b in ("b1", "b2"))
    folded = np.minimum(x["size"][i], x["size"][j]) <= FOLDED_LINE
    one = np.where(folded, (a1 | a2) ^ (z1 | z2), a1 ^ z1)
    differ = np.bitwise_count(one).astype(np.int64) + np.where(folded, 0, np.bitwise_count(a2 ^ z2))
    long = np.flatnonzero((differ <= most) & (np.maximum(x["size"][i], x["size"][j]) > SHORT_LINE))
    if len(long):
        differ[long] = np.bitwise_count(x["maps"][x["wide"][i[long]]] ^ x["maps"][x["wide"][j[long]]]).sum(axis=1, dtype=np.int64)
    good[at] = differ <= most
    return good


_MEMBER = ("word", "ord", "line", "set", "size", "place", "b1", "b2", "wide")
_PAIR = "a_ord long, a_line long, b_ord long, b_line long"


def _wide_maps(column: pa.Array) -> dict:
    """The wide maps as a matrix, and the row of each line in it (-1 for lines without)."""
    have = column.is_valid().to_numpy(zero_copy_only=False)
    maps = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)
    return {"maps": maps, "wide": np.where(have, np.cumsum(have) - 1, -1)}


_PACKED = ("entry", "ord", "line", "size", "set", "b1", "b2")


def _pack(column: np.ndarray) -> bytes:
    """Integers as their least one and what is above it, in as few bytes each as that takes."""
    least, most = int(column.min()), int(column.max())
    if most - least > np.iinfo(np.uint32).max:  # nulls beside ids, maps
        return b"\0" * 8 + b"\x08" + column.tobytes()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if most - least <= np.iinfo(k).max)
    return least.to_bytes(8, "little", signed=True) + bytes([kind(0).itemsize]) + (column - least).astype(kind).tobytes()


def _deal(parts: int, words, asking: bool):
    """Prefix entries of lines as packed arrays for the parts of their words.

    ``words`` (a sorted array, broadcast) leaves out all other words. With ``asking``,
    a ninth column lists the words for which a line asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            x = {n: np.concatenate([h[0][n] for h in held]) for n in held[0][0]}
            maps, has = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            row = np.cumsum(has) - 1
            held.clear()
            part = ((x["entry"] >> PLACE_BITS) % parts).astype(np.int32)
            short = x["size"] <= FOLDED_LINE
            x["b1"] = np.where(short, x["b1"] | x["b2"], x["b1"])
            x["b2"] = np.where(short, 0, x["b2"])
            order = np.lexsort((short, part))  # stable
            part = part[order]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            blobs: list[list] = [[] for _ in range(len(_PACKED) + 3)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = order[a:b]
                for column, name in zip(blobs, _PACKED):
                    values = x[name][at]
                    column.append(_pack(np.diff(values, prepend=0) if name == "ord" else values))  # ids mostly grow by little
                blobs[-3].append(np.packbits(has[at]).tobytes())
                blobs[-2].append(maps[row[at[has[at]]]].tobytes())
                blobs[-1].append(np.packbits(x["asks"][at]).tobytes() if asking else None)
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.diff(cuts)), *(pa.array(c, pa.binary()) for c in blobs)], names=["part", "n", *_PACKED, "has", "maps", "asks"])

        size = 0
        for batch in batches:
            lists = batch.column(7)
            entry = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            if words is not None:
                word = entry >> PLACE_BITS
                at = np.minimum(np.searchsorted(words.value, word), len(words.value) - 1)
                hit = words.value[at] == word
                entry, owner = entry[hit], owner[hit]
            if not len(entry):
                continue
            x = {"entry": entry} | {n: pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False)[owner] for i, n in enumerate(("ord", "line", "set", "size", "b1", "b2"))}
            if asking:
                asked = batch.column(8)
                of = np.repeat(np.arange(batch.num_rows), pc.fill_null(asked.value_lengths(), 0).to_numpy(zero_copy_only=False))
                x["asks"] = np.isin((owner << HASH_BITS) | (entry >> PLACE_BITS), (of << HASH_BITS) | asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            wide = _wide_maps(batch.column(6))
            row = wide["wide"][owner]
            held.append((x, wide["maps"][row[row >= 0]], row >= 0))
            size += len(entry)
            if size >= TASK_ENTRIES:
                yield out()
                size = 0
        if held:
            yield out()

    return run


_DEALT = "part int, n long, " + ", ".join(f"{n} binary" for n in (*_PACKED, "has", "maps", "asks"))


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[8]
    column = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width], offset=9)
    return column if width == 8 else column + np.int64(int.from_bytes(raw[:8], "little", signed=True))


def _part_columns(blobs: list[dict]) -> dict[str, np.ndarray]:
    """The entries of one part under words that several lines have, sorted by word and size."""
    x = {n: np.concatenate([np.cumsum(_unpack(b[n])) if n == "ord" else _unpack(b[n]) for b in blobs]) for n in _PACKED}
    has, asks = (np.concatenate([np.unpackbits(np.frombuffer(b[n], np.uint8), count=b["n"]) if b[n] is not None else np.zeros(b["n"], np.uint8) for b in blobs]).astype(bool) for n in ("has", "asks"))
    x |= {"asks": asks, "wide": np.where(has, np.cumsum(has) - 1, -1), "word": x["entry"] >> PLACE_BITS, "place": x.pop("entry") & ((1 << PLACE_BITS) - 1)}
    order = np.argsort(x["word"])
    word = x["word"][order]
    same = word[1:] == word[:-1]
    order = order[np.append(False, same) | np.append(same, False)]  # alone, a line has no neighbour
    order = order[np.lexsort((x["size"][order], x["word"][order]))]
    return {n: v[order] for n, v in x.items()} | {"maps": np.frombuffer(b"".join(b["maps"] for b in blobs), np.uint64).reshape(-1, WIDE_BITS // 64)}


def _candidates(x: dict, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passing pairs of rows (earlier line, later line), some at a time."""
    n = len(x["word"])
    size = x["size"]
    # The largest size that a line with as many words, at this place, can be similar to.
    most = np.minimum(size * den // num, (size - x["place"]) * (num + den) // num - size)
    key = np.cumsum(np.append(0, x["word"][1:] != x["word"][:-1])) << 32
    count = np.maximum(np.searchsorted(key | np.minimum(size, (1 << 31) - 1), key | np.clip(most, 0, (1 << 31) - 1), "right") - 1 - np.arange(n), 0)
    rows = np.flatnonzero(count)
    total = np.cumsum(count[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        these, many = rows[at:to], count[rows[at:to]]
        i = np.repeat(these, many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        good = x["set"][i] != x["set"][j]  # other tasks may have sent a set too
        good[good] = _passes(x, i[good], j[good], num, den)
        i, j = i[good], j[good]
        later = (x["ord"][i] > x["ord"][j]) | ((x["ord"][i] == x["ord"][j]) & (x["line"][i] > x["line"][j]))
        yield np.where(later, j, i), np.where(later, i, j)
        at = to


def _pairs(x: dict, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(x[c][i]) for i in (a, b) for c in ("ord", "line")]


def _earliest(x: dict, num: int, den: int) -> pa.RecordBatch:
    """Each row's earliest passing neighbours, and the word if that has more of them.

    Only these are held while pairs are looked at, however many lines are similar.
    """
    n = len(x["word"])
    by_place = np.lexsort((x["line"], x["ord"]))
    rank = np.empty(n, np.int64)
    rank[by_place] = np.arange(n)
    best = np.full((NEIGHBOURS, n), n)
    met = np.zeros(n, np.int64)
    for a, b in _candidates(x, num, den):
        met += np.bincount(b, minlength=n)
        order = np.lexsort((rank[a], b))
        a, b = rank[a][order], b[order]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
        inside = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        for k in range(NEIGHBOURS):  # the k-th new one goes between those held
            new, row = a[inside == k], b[inside == k]
            for level in best:
                low = np.minimum(level[row], new)
                new = np.maximum(level[row], new)
                level[row] = low
    pairs = [(by_place[level[row]], row, met[row] > NEIGHBOURS) for level in best for row in [np.flatnonzero(level < n)]]
    a, b, more = (np.concatenate(c) for c in zip(*pairs))
    return pa.RecordBatch.from_arrays([*_pairs(x, a, b), pa.array(x["word"][b], mask=~more)], names=["a_ord", "a_line", "b_ord", "b_line", "more"])


def _neighbours(num: int, den: int, every: bool):
    """Passing pairs of lines (a earlier, b) that share a prefix word, part by part.

    With ``every``, all pairs of the rows that ask; else the earliest of each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of what this worker did before
        held: list[dict] = []

        def out() -> Iterator[pa.RecordBatch]:
            x = _part_columns(held)
            held.clear()
            if not every:
                yield _earliest(x, num, den)
                return
            for a, b in _candidates(x, num, den):
                a, b = a[x["asks"][b]], b[x["asks"][b]]
                yield pa.RecordBatch.from_arrays([*_pairs(x, a, b), pa.nulls(len(a), pa.int64())], names=["a_ord", "a_line", "b_ord", "b_line", "more"])

        for batch in batches:
            for row in slices([batch], 64):
                for blob in row.to_pylist():
                    if held and held[-1]["part"] != blob["part"]:
                        yield from out()
                    held.append(blob)
        if held:
            yield from out()
        release_memory()

    return run


def _met_blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            both = [*row["left"], *row["right"]]
            x = {n: np.array([m[n] for m in both], np.int64) for n in _MEMBER[1:-1]} | _wide_maps(pa.array([m["wide"] for m in both], pa.binary()))
            i, j = (v.ravel() for v in np.meshgrid(np.arange(len(row["left"])), np.arange(len(row["left"]), len(both)), indexing="ij"))
            keep = (x["set"][i] != x["set"][j]) & _passes(x, i, j, num, den)
            i, j = i[keep], j[keep]
            later = (x["ord"][i] > x["ord"][j]) | ((x["ord"][i] == x["ord"][j]) & (x["line"][i] > x["line"][j]))
            yield pa.RecordBatch.from_arrays(_pairs(x, np.where(later, j, i), np.where(later, i, j)), names=["a_ord", "a_line", "b_ord", "b_line"])

    return run


def _blocked(members: DataFrame, num: int, den: int) -> DataFrame:
    """Passing pairs of the lines of frequent words, block against block."""
    counts = members.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = members.join(_small(counts), "word").withColumn("part", F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / (16 * BLOCK_ROWS))))
    dealt = dealt.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("word", "part").orderBy("size", "set")) - 1) / BLOCK_ROWS))
    blocks = dealt.groupBy("word", "part", "block").agg(F.collect_list(F.struct(*_MEMBER[1:])).alias("rows"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    blocks = materialize(blocks.withColumn("at", F.col("part") * (1 << 32) + F.col("block")), "line-blocks")
    other = blocks.select("word", F.col("at").alias("at2"), F.col("rows").alias("right"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = blocks.join(other, "word").filter((F.col("at") <= F.col("at2")) & (F.col("hi") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo") * num))
    return met.select(F.col("rows").alias("left"), "right").mapInArrow(_met_blocks(num, den), _PAIR)


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast, if it has been counted to be small enough for that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _place_of(ord_, line):
    """The place of a line in a bit map; columns and arrays are taken alike."""
    inside = (lambda x, n: F.pmod(x, F.lit(n))) if isinstance(ord_, Column) else np.mod
    return inside(inside(ord_, FILTER_BITS) * 31337 + inside(line, 1 << 20) * 101, FILTER_BITS)


def _line_sets(asked):
    """The word sets of the lines in a bit map (and of some more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(asked.value, np.uint8)
        for rows, data, begin in joined_texts(batches, 2):
            feeds = np.flatnonzero(data == 10)
            owner = np.searchsorted(begin, feeds, "right") - 1
            number = np.arange(len(feeds)) - np.searchsorted(feeds, begin)[owner] + rows.column(1).to_numpy()[owner]
            ords = rows.column(0).to_numpy()[owner]
            place = _place_of(ords, number)
            hit = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            if not len(hit):
                continue
            whole = data.tobytes()
            opens = np.append(0, feeds[:-1] + 1)
            text = b"\n".join([whole[a:b] for a, b in zip(opens[hit].tolist(), feeds[hit].tolist())])
            some = np.frombuffer(text, np.uint8)
            first, last = find_words(some)
            h = hash_words(some, first, last)
            cuts = np.searchsorted(first, np.cumsum(feeds[hit] - opens[hit] + 1)).tolist()
            sets = [distinct(h[a:b]).tobytes() for a, b in zip([0, *cuts], cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(ords[hit]), pa.array(number[hit]), pa.array(sets, pa.binary())], names=["ord", "line", "set"])

    return run


def _checked(num: int, den: int):
    """The later lines of the pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = np.frombuffer(s + t, np.uint64)
                ordered = np.sort(both, kind="stable")
                common = int((ordered[1:] == ordered[:-1]).sum())
                keep.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["ord", "line"]).filter(pa.array(keep, pa.bool_()))

    return run


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        texts, removed = [], []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out = set(gone or ()) if text is not None else set()
            removed.append(len(out))
            texts.append("\n".join([line for i, line in enumerate(text.split("\n")) if i not in out]) if out else text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64()), *batch.columns[2:]], names=["text", "n_removed", *batch.schema.names[2:]])


def _placed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __ord, the id (nulls last), and __base, which tells texts of one id apart."""
    rows = docs.withColumn("__ord", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    shared = materialize(rows.groupBy("__ord").count().filter("count > 1").select("__ord"), "line-ids", keep=True)
    if not shared.limit(1).count():
        return rows.withColumn("__base", F.lit(0).cast("long"))
    mark = F.shiftleft(F.xxhash64(F.col(text_col).cast("string")).bitwiseAND(F.lit((1 << 34) - 1)), LINE_BITS)
    marked = rows.join(_small(shared.withColumn("__shared", F.lit(True))), "__ord", "left")
    return marked.withColumn("__base", F.when(F.col("__shared"), mark).otherwise(F.lit(0).cast("long"))).drop("__shared")


def _repeated_lines(placed: DataFrame, text_col: str, num: int, den: int) -> DataFrame:
    """ord, base and the numbers from 0 of the lines to remove; documents without any are left out."""
    spark = placed.sparkSession
    texts = placed.select(F.col("__ord").alias("ord"), F.col("__base").alias("base"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = texts.select("text").mapInArrow(_count_words, "chunk int, places binary, counts binary").repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(_sum_words, "chunk int, levels binary")
    levels = bytearray((1 << BUCKET_BITS) // 2)
    step = (1 << CHUNK_BITS) // 2
    rows = sums.toArrow()  # of fixed size, whatever the corpus
    for chunk, part in zip(rows.column("chunk").to_pylist(), rows.column("levels")):
        levels[chunk * step : (chunk + 1) * step] = part.as_buffer()
    del rows
    sent = spark.sparkContext.broadcast(bytes(levels))
    del levels
    lines = materialize(texts.mapInArrow(_sign_lines(num, den, sent), _LINES), "lines")
    sent.destroy()
    del sent
    columns = [*(F.col(c) for c in ("ord", "line")), F.col("k1").alias("set"), *(F.col(c) for c in ("size", "b1", "b2", "wide"))]

    # A part holds its words whole; none of them is frequent, so enough parts make each one small.
    total = lines.agg(F.sum(F.size("entries"))).first()[0] or 0
    parts = max(LEAST_PARTS, tasks, -(-total // TASK_ENTRIES))

    def neighbours(rows: DataFrame, words, every: bool) -> DataFrame:
        dealt = rows.mapInArrow(_deal(parts, words, every), _DEALT).repartition(parts, "part").sortWithinPartitions("part")
        return dealt.mapInArrow(_neighbours(num, den, every), f"{_PAIR}, more long")

    sendable = lines.filter(F.size("entries") > 0)
    near = materialize(neighbours(sendable.select(*columns, "entries"), None, False), "line-near")
    hot = lines.filter(F.size("frequent") > 0).select(*columns, F.explode("frequent").alias("e"))
    hot = hot.withColumns({"word": F.shiftright("e", PLACE_BITS), "place": F.col("e").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).select(*_MEMBER)
    blocked = materialize(_blocked(materialize(hot, "line-frequent"), num, den), "line-hot")
    ends = ["a_ord", "a_line", "b_ord", "b_line"]
    pairs = materialize(near.select(ends).union(blocked).distinct(), "line-pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        """ord and line of the later lines of the similar ones among the pairs."""
        places = pairs.select(F.explode(F.array(_place_of(F.col("a_ord"), F.col("a_line")), _place_of(F.col("b_ord"), F.col("b_line")))).alias("place"))
        asked = spark.sparkContext.broadcast(bitmap_of(places, "place", FILTER_BITS))
        sets = texts.mapInArrow(_line_sets(asked), "ord long, line long, set binary").groupBy("ord", "line").agg(F.any_value("set").alias("set"))
        sets = materialize(sets, "line-sets")
        side = lambda name: sets.select(*(F.col(c).alias(f"{name}_{c}") for c in ("ord", "line", "set")))
        joined = pairs.join(side("a"), ["a_ord", "a_line"]).join(side("b"), ["b_ord", "b_line"]).select("b_ord", "b_line", "a_set", "b_set")
        return joined.mapInArrow(_checked(num, den), "ord long, line long").distinct()

    gone = materialize(verified(pairs), "line-gone")
    open_ = near.filter("more IS NOT NULL").select(F.col("b_ord").alias("ord"), F.col("b_line").alias("line"), F.col("more").alias("word"))
    open_ = materialize(open_.distinct().join(gone, ["ord", "line"], "left_anti"), "line-open")
    if open_.limit(1).count():
        asks = _small(materialize(open_.groupBy("ord", "line").agg(F.collect_set("word").alias("asked")), "line-asks"))
        theirs = open_.select("word").distinct()
        few = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else all entries are dealt once more
        wanted = spark.sparkContext.broadcast(np.sort(theirs.toArrow().column("word").to_numpy())) if few else None
        again = neighbours(sendable.select(*columns, "entries").join(asks, ["ord", "line"], "left").select("ord", "line", "set", "size", "b1", "b2", "wide", "entries", "asked"), wanted, True)
        rest = materialize(again.select(ends).distinct().join(pairs, ends, "left_anti"), "line-rest")
        gone = materialize(gone.union(verified(rest)).distinct(), "line-gone")
    # Besides, of each class only the first line stays; it was always sent and judged.
    placed_lines = lines.select("ord", "line", "k1", "k2")
    many = placed_lines.groupBy("k1", "k2").agg(F.min("ord").alias("o"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "o")
    marked = placed_lines.join(_small(materialize(many, "line-classes")), ["k1", "k2"])
    head = materialize(marked.filter(F.col("ord") == F.col("o")).groupBy("k1", "k2").agg(F.min("line").alias("l")), "line-heads")
    again = marked.join(_small(head), ["k1", "k2"]).filter((F.col("ord") != F.col("o")) | (F.col("line") != F.col("l")))
    drop = gone.union(again.select("ord", "line"))
    mask = (1 << LINE_BITS) - 1
    return drop.groupBy("ord", (F.col("line") - F.col("line").bitwiseAND(F.lit(mask))).alias("base")).agg(F.collect_set(F.col("line").bitwiseAND(F.lit(mask))).alias("lines"))


def remove_repeated_lines(docs: DataFrame, *, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default the id), text without repeated lines and n_removed of every document."""
    short_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *own)
    with scratch_scope(docs.sparkSession):
        placed = _placed_texts(rows, "__id", "__text")
        drop = materialize(_repeated_lines(placed, "__text", num, den).select(F.col("ord").alias("__ord"), F.col("base").alias("__base"), F.col("lines").alias("__lines")), "line-drop", keep=True)
    size = drop.agg(F.count("*").alias("docs"), F.sum(F.size("__lines")).alias("lines")).first()
    few = size["docs"] <= BROADCAST_ROWS and (size["lines"] or 0) <= 10 * BROADCAST_ROWS  # some 40 MB
    joined = placed.join(F.broadcast(drop) if few else drop, ["__ord", "__base"], "left")
    source = joined.select("__text", "__lines", *(f"__{i}" for i in range(len(keep))))
    types = dict(source.dtypes)
    schema = "text string, n_removed long" + "".join(f", __{i} {types[f'__{i}']}" for i in range(len(keep)))
    out = source.mapInArrow(_drop_lines, schema)
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "text", "n_removed")


def op4_line_similarity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
