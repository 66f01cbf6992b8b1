"""Removal of repeated byte strings by suffix arrays (operator 9).

A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a
document with a smaller id, or in the same one further left. Strings are judged on
the input, and never cross documents.

1. Equal texts form a class; all but the first lose every byte (if long enough).
2. Every window picks an anchor, the smallest of its gram hashes. Equal windows pick
   equal anchors, so only windows whose anchor occurs twice can repeat. Anchors are
   counted by an aggregation that combines before its shuffle; the repeated ones go
   into a bit map of fixed size (``FILTER_BITS``), whose false hits cost time only.
3. Runs of windows with a repeated anchor become snippets, dealt to shards by anchor,
   so equal windows meet. A task that saw a snippet's bytes earlier reports the later
   one as covered instead of sending it.
4. Each shard of about ``SHARD_BYTES`` builds its suffix array by induced sorting and
   the permuted common prefixes; neighbours that agree in ``window`` bytes are one
   string, of which all but the earliest occurrence are covered.
5. Anchors with more than ``HOT_SNIPPETS`` snippets take an exact way without a
   shard: their windows are hashed (128 bits) and the earliest of each is a minimum.

Edge cases: a null text is empty; an empty or short text keeps its bytes. Rows that
repeat id and text are one document, each row with its result; rows that repeat an
id with other texts are ordered by the texts' digests. Null ids come last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import bitmap_of, materialize, scratch_scope, short_batches, slices, table
from seagrid.llm.suffixkernel import anchors, permuted_common_prefixes, suffix_array

FILTER_BITS = 1 << 27
SHARD_BYTES = 3 << 20
HOT_SNIPPETS = 40_000
BUFFER_BYTES = 2 << 20
BROADCAST_ROWS = 100_000
BROADCAST_DOCS = 300_000
MOST_SEEN = 120_000
_LAST = (1 << 63) - 1


def _buffers(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, begins, lengths) of texts in buffers of some megabytes."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        if held and size + len(raw) > BUFFER_BYTES:
            yield first, *_joined(held)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, *_joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in held], np.int64)
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum(length) - length, length


#: One text may fill a buffer by itself; places in it must fit their packed bits.
_PART = 1 << 23


def _anchors(data: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``anchors`` of a buffer of any size; a very long text is taken in parts that share window - 1 bytes."""
    if len(data) <= _PART:
        yield anchors(data, begin, length, window)
        return
    for b, n in zip(begin.tolist(), length.tolist()):
        for at in range(0, max(1, n - window + 1), _PART):
            part = data[b + at : b + min(n, at + _PART + window - 1)]
            h, first, last = anchors(part, np.zeros(1, np.int64), np.array([len(part)]), window)
            yield h, first + b + at, last + b + at


def _count_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            docs = batch.column(0).to_numpy()
            for base, data, begin, length in _buffers(batch.column(1)):
                # Parts of one text are counted together, as an anchor may occur once in each of them.
                h, first, _ = (np.concatenate(x) for x in zip(*_anchors(data, begin, length, window)))
                if not len(h):
                    continue
                owner = docs[base + np.searchsorted(begin, first, "right") - 1]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
                at = np.flatnonzero(new)
                again = np.diff(np.append(at, len(h))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(owner[at]), pa.array(again)], names=["anchor", "doc", "again"])

    return run


_SNIPPET = "ord long, key binary, start long, stop long, anchor long, bytes binary"
_SNIPPET_ARROW = pa.schema([("ord", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("anchor", pa.int64()), ("bytes", pa.binary())])


def _cut_snippets(window: int, bits) -> object:
    """Snippets with repeated anchors, and (without anchor and bytes) covered stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        seen: dict[bytes, tuple[int, bytes, int]] = {}
        for batch in slices(batches, 1000):
            ords, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for base, data, begin, length in _buffers(batch.column(2)):
                whole = data.tobytes()
                rows = []
                for h, first, last in _anchors(data, begin, length, window):
                    place = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    keep = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    owner = np.searchsorted(begin, first[keep], "right") - 1
                    covered = None
                    for a, x, y, w in zip(h[keep].view(np.int64).tolist(), first[keep].tolist(), last[keep].tolist(), owner.tolist()):
                        piece = whole[x : y + window]
                        digest = xxhash.xxh3_128_digest(piece)
                        at = x - int(begin[w])
                        here = ords[base + w], keys[base + w], at
                        known = seen.get(digest)
                        if known is not None and known < here:
                            if covered is not None and covered[:2] == here[:2] and at <= covered[3] + window:
                                covered[3] = y - int(begin[w])
                            else:
                                covered = [*here, y - int(begin[w]), None, None]
                                rows.append(covered)
                        else:
                            if len(seen) >= MOST_SEEN:
                                seen.clear()
                            seen[digest] = here
                            rows.append([*here, y - int(begin[w]), a, piece])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SNIPPET_ARROW)], schema=_SNIPPET_ARROW)

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_STRETCH = "ord long, key binary, start long, stop long"
_STRETCH_ARROW = pa.schema(list(_SNIPPET_ARROW)[:4])


def covered_windows(ord_: list[int], key: list[bytes], start: np.ndarray, pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) of the windows that another row, or the same one, has earlier."""
    rank_of = {d: i for i, d in enumerate(sorted(set(zip(ord_, key))))}
    rank = np.array([rank_of[d] for d in zip(ord_, key)], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    length = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(length + 1) - (length + 1)
    symbols = text.astype(np.uint16) + 2
    symbols[begin + length] = 1  # ends a snippet
    present = np.flatnonzero(np.bincount(symbols))
    dense = np.zeros(258, np.uint16)
    dense[present] = np.arange(1, len(present) + 1)
    t = np.append(dense[symbols], np.uint16(0))
    sa = suffix_array(t, window // 2 + 2)
    plcp = permuted_common_prefixes(t, sa, window)
    owner = np.repeat(np.arange(len(pieces)), length + 1)
    inside = np.arange(len(text)) - begin[owner]
    is_window = np.append(inside + window <= length[owner], False)
    when = np.append((rank[owner] << 40) | (start[owner] + inside), 0)
    places = sa[is_window[sa]]
    new = plcp[places] < window
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    new[0] = True
    heads = np.flatnonzero(new)
    earliest = np.minimum.reduceat(when[places], heads)
    later = np.zeros(len(t), bool)
    later[places] = when[places] > earliest[np.cumsum(new) - 1]
    a, b = _runs(later)
    return owner[a], start[owner[a]] + inside[a], start[owner[a]] + inside[b]


def _shard(window: int):
    """Covered stretches of a shard's snippets.

    Of equal snippets all but the earliest are covered whole. Windows of one snippet
    differ, as they stand differently to their anchor, so an anchor that is left with
    one snippet has no more to find; the others meet in a suffix array.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("ord", "key", "start", "anchor", "bytes"))))
        first: dict[bytes, int] = {}
        covered = []
        for i, row in enumerate(rows):
            j = first.setdefault(row[4], i)
            if row[:3] < rows[j][:3]:
                first[row[4]], i, j = i, j, i
            if rows[i][:3] > rows[j][:3]:
                covered.append((*rows[i][:3], rows[i][2] + len(row[4]) - window))
        kinds = Counter(rows[i][3] for i in first.values())
        left = [rows[i] for i in first.values() if kinds[rows[i][3]] > 1]
        if left:
            ord_, key, start, _, pieces = zip(*left)
            for r, a, b in zip(*(x.tolist() for x in covered_windows(ord_, key, np.array(start, np.int64), pieces, window))):
                covered.append((ord_[r], key[r], a, b))
        columns = zip(*covered) if covered else ([], [], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STRETCH_ARROW)], schema=_STRETCH_ARROW)

    return run


def _split_windows(window: int):
    """Every window of a snippet with a 128-bit hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = []
            for o, k, s, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for at in range(len(piece) - window + 1):
                    rows.append((xxhash.xxh3_128_digest(piece[at : at + window]), o, k, s + at))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary(), pa.int64()))] if rows else [pa.array([], kind) for kind in (pa.binary(), pa.int64(), pa.binary(), pa.int64())], names=["digest", "ord", "key", "start"])

    return run


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast, if it has been counted to be small enough for that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _merge_stretches(window: int):
    """Each document's stretches of windows as spans of bytes that neither overlap nor touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.lexsort((start, doc))
            doc, start, stop = doc[order], start[order], stop[order] + window
            # The furthest end so far within each document, by places that grow from document to document.
            step = int(stop.max(initial=0)) + 1
            reach = np.maximum.accumulate(stop + doc * step)
            fresh = np.append(True, start[1:] + doc[1:] * step > reach[:-1])[: len(doc)] | np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            at = np.flatnonzero(fresh)
            ends = reach[np.append(at[1:], len(doc)) - 1] - doc[at] * step if len(at) else at
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=batch.num_rows))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start[at]), pa.array(ends)], names=["start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], names=["ord", "key", "stretches"])

    return run


def _in_bitmap(column: int, bits, hits: bool):
    """The rows whose 64-bit hash is in the bit map, or those whose isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            place = batch.column(column).to_numpy() & (FILTER_BITS - 1)
            found = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1) == int(hits)
            yield batch.filter(pa.array(found))

    return run


def _with_stretches(marked: DataFrame, found: DataFrame) -> DataFrame:
    """``marked`` with the spans of its documents, null for those without any.

    Few spans are broadcast. Else only documents that have spans are shuffled: a bit
    map of their hashes parts them from the rest (a false hit is shuffled in vain).
    """
    size = found.agg(F.count("*").alias("docs"), F.sum(F.size("stretches")).alias("all")).first()
    if size["docs"] <= BROADCAST_DOCS and (size["all"] or 0) <= 5 * BROADCAST_DOCS:  # some 60 MB
        return marked.join(F.broadcast(found), ["ord", "key"], "left")
    bits = marked.sparkSession.sparkContext.broadcast(bitmap_of(found.select(F.xxhash64("ord", "key").alias("h")), "h", FILTER_BITS))
    keyed = marked.select(F.xxhash64("ord", "key").alias("__h"), *marked.columns)
    there, rest = (keyed.mapInArrow(_in_bitmap(0, bits, hits), keyed.schema).drop("__h") for hits in (True, False))
    return there.join(found, ["ord", "key"], "left").select(*marked.columns, "stretches").union(rest.withColumn("stretches", F.lit(None).cast(found.schema["stretches"].dataType)))


def _keep(window: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, copy, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = (text or "").encode()
                spans = [[0, len(raw)]] if copy and len(raw) >= window else [[x["start"], x["stop"]] for x in stretches or ()]
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for column, value in zip(out, (doc_id, len(raw), sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], b"".join(kept))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(out, kinds)), *batch.columns[4:]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *extra])

    return run


def remove_repeats(docs: DataFrame, *, window: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, from start to before stop) and kept bytes of every document.

    The further columns ``keep`` are carried along.
    """
    spark = docs.sparkSession
    short_batches(spark)
    carried = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep or ())]
    names = [f"__{i}" for i in range(len(carried))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried)
    rows = rows.withColumns({"ord": F.coalesce("doc_id", F.lit(_LAST)), "key": F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))})
    copied = materialize(rows.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "copied")
    marked = rows.join(_small(copied), "key", "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
    with scratch_scope(spark):
        found = _stretches(marked.filter(~F.col("copy")), window).groupBy("ord", "key").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
        found = materialize(found.mapInArrow(_merge_stretches(window), found.schema), "stretches", keep=True)
    full = _with_stretches(marked, found).select("doc_id", "text", "copy", "stretches", *names)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    schema += "".join(f", {n} {dict(full.dtypes)[n]}" for n in names)
    out = full.mapInArrow(_keep(window, names), schema)
    return out.select("doc_id", "n_bytes", "n_removed", "spans", "kept", *(F.col(n).alias(c) for n, c in zip(names, keep or ())))


def _stretches(source: DataFrame, window: int) -> DataFrame:
    """ord, key, start and stop: runs of windows that have an earlier equal one."""
    spark = source.sparkSession

    counted = source.select(F.xxhash64("ord", "key").alias("doc"), "text").mapInArrow(_count_anchors(window), "anchor long, doc long, again boolean")
    repeated = counted.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("again").alias("again")).filter("lo <> hi OR again")
    bits = spark.sparkContext.broadcast(bitmap_of(repeated, "anchor", FILTER_BITS))

    pieces = materialize(source.select("ord", "key", "text").mapInArrow(_cut_snippets(window, bits), _SNIPPET), "snippets")
    bits.destroy()
    snippets = pieces.filter(F.col("anchor").isNotNull())
    total = snippets.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = materialize(snippets.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SNIPPETS).select("anchor"), "hot")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    plain = snippets.join(_small(hot), "anchor", "left_anti").select(shard, "ord", "key", "start", "anchor", "bytes")
    found = [pieces.filter(F.col("anchor").isNull()).select("ord", "key", "start", "stop"), plain.groupBy("shard").applyInArrow(_shard(window), _STRETCH)]
    if hot.limit(1).count():
        windows = snippets.join(_small(hot), "anchor", "left_semi").select("ord", "key", "start", "bytes").mapInArrow(_split_windows(window), "digest binary, ord long, key binary, start long")
        windows = materialize(windows, "windows")
        earliest = windows.groupBy("digest").agg(F.min(F.struct("ord", "key", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        found.append(windows.join(earliest, "digest").filter(F.struct("ord", "key", "start") > F.col("first")).select("ord", "key", "start", F.col("start").alias("stop")))
    stretches = found[0]
    for more in found[1:]:
        stretches = stretches.union(more)
    return stretches


def whole_characters(kept: Column) -> Column:
    """Kept bytes as text; characters of which only some bytes are left go too."""

    @F.pandas_udf("string")
    def decode(raw):
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return decode(kept)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=100)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
