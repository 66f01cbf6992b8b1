"""N-gram Jaccard join by partitioning the universe (operator 10).

A document is the set of its word shingles. Two sets of a and b shingles whose
Jaccard similarity is at least num / den differ in at most
H = floor((a + b)(den - num) / (den + num)) shingles. In each band of sizes a hash
deals the universe of shingles into segments, and pigeonholes say that of segments
whose levels x_i add up to H + 1 at least one differs in fewer than x_i shingles:
level 1 asks for equal subsets, level 2 for subsets that are equal or differ by one
deletion. ``allocate`` picks the levels of a band, and spare segments that let sets
leave out their empty ones, by the cost of signatures and of chance pairs. A set signs
in its own band and in the next larger one.

Sets that share a signature are candidates, and nothing else is compared:

1. Equal texts are signed once. Signatures are counted by an aggregation that
   combines before its shuffle; those that occur twice go into a bit map of fixed
   size (``FILTER_BITS``, whose false hits cost time only), and a second pass over the
   texts keeps them. Equal sets form one class.
2. Of the classes of a signature, the one that shares most with others is compared
   with the rest. This star finds nearly every component.
3. In signatures that still hold several components, every pair between different
   components is compared: in blocks of bounded size, so that no group is
   gathered whole, and in rows that hold both blocks.

Every class has a map of ``MAP_BITS`` bits a shingle. Two maps can't differ in more
places than their sets do, so pairs whose maps differ too much are left out; what
passes is verified on 64-bit hashes of whole shingles. Links inside a component
that is already connected are not needed and not listed.

Edge cases: a null text, or one without words, has the empty set and is linked with
nothing. A text with fewer words than a shingle is one shingle. Equal texts and
repeated rows are in one component. Texts that share a document id are in one
component too; of these the one with the least key stands for the id in
comparisons. A row with a null id gets the component of its equal texts, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import bitmap_of, materialize, scratch_scope, short_batches, slices, table
from seagrid.llm.components import components
from seagrid.llm.wordkernel import distinct, find_words, hash_words, mix

#: A block holds up to so many shingles, a class counting as 1,024 at least: at most 256 classes and 1 MB.
BLOCK_SHINGLES = 256 * 1024
FILTER_BITS = 1 << 27
#: Tables of up to so many rows of at most 64 bytes are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000
MAP_BITS = 16
#: Classes of a signature are parted into about so many before they are put into blocks.
PART_CLASSES = 1024
#: A band and its neighbour are taken to hold this share of all sets.
BAND_SHARE = 0.1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)



class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words = words

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        first, last = find_words(data)
        h = hash_words(data, first, last, fold=True)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cuts = np.searchsorted(first, ends).tolist()
        k = self.words
        with np.errstate(over="ignore"):
            rolled = np.full(max(0, len(h) - k + 1), np.uint64(k))
            for i in range(k):
                rolled = mix(rolled * _GOLDEN + h[i : len(h) - k + 1 + i])
        out, a = [], 0
        for b in cuts:
            out.append(distinct(rolled[a : b - k + 1]) if b - a >= k else self._short(h[a:b]))
            a = b
        return out

    @staticmethod
    def _short(h: np.ndarray) -> np.ndarray:
        """The one shingle of a text with fewer words than a shingle has."""
        out = np.full(min(1, len(h)), np.uint64(len(h)))
        with np.errstate(over="ignore"):
            for x in h:
                out = mix(out * _GOLDEN + x)
        return out


def most_apart(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of two similar sets with ``total`` shingles together."""
    return total * (den - num) // (den + num)


def size_bands(num: int, den: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band; similar sets are in the same band or in neighbouring ones."""
    low, high, at = [], [], 1
    while at <= most:
        low.append(at)
        high.append(max(at, at * den // num))
        at = high[-1] + 1
    return np.array(low), np.array(high)


def allocate(low: int, high: int, num: int, den: int, population: int) -> tuple[int, int, int]:
    """(segments, how many of them at level 2, spare ones) of the least cost for a band.

    The cost of a set is its signatures; that of chance pairs is the chance that two
    unlike sets agree on a segment, which takes both to have (almost) nothing in it.
    With spare segments beyond the levels needed, a set leaves out its empty segments,
    as long as these are no more than the spare ones: similar sets agree on more
    segments than that, so on one that isn't empty.
    """
    need = most_apart(2 * high, num, den) + 1
    size = (low + high) / 2
    least = max(1.0, low * num / den)
    spare = 0
    for _ in range(8):  # as many as nearly all sets have empty segments, the smallest sets too
        empty = (need + spare) * math.exp(-least / (need + spare))
        spare = math.ceil(empty + 3 * math.sqrt(empty) + 1)
    pairs = (BAND_SHARE * population) ** 2 / 2
    best = None
    for twice, more in [(0, 0), (0, spare), *((t, 0) for t in (need // 4, need // 2, (need + 1) // 2) if t)]:
        segments = need - twice + more
        if segments < max(1, twice):
            continue
        filled = size / segments
        signatures = BAND_SHARE * population * (segments + twice * filled)
        chance = 0.0 if more or segments == 1 else pairs * math.exp(-2 * filled) * (segments - twice + twice * (1 + filled) ** 2)
        cost = signatures + chance
        if best is None or cost < best[0]:
            best = cost, segments, twice, more
    return best[1:]


class Signer:
    """The signatures of a set."""

    def __init__(self, num: int, den: int, population: int):
        self.num, self.den, self.population = num, den, population
        self.low, self.high = size_bands(num, den)
        self.plans: dict[int, tuple[int, int, int]] = {}

    def plan(self, band: int) -> tuple[int, int, int]:
        if band not in self.plans:
            self.plans[band] = allocate(int(self.low[band]), int(self.high[band]), self.num, self.den, self.population)
        return self.plans[band]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(0, np.int64)
        own = int(np.searchsorted(self.low, len(shingles), "right")) - 1
        out = []
        for band in (own, own + 1):
            if band > own and len(shingles) * self.den < self.low[band] * self.num:
                continue
            segments, twice, spare = self.plan(band)
            with np.errstate(over="ignore"):
                weight = mix(shingles + np.uint64(band))
                segment = ((shingles >> np.uint64(11)) % np.uint64(segments)).astype(np.int64)
                order = np.argsort(segment, kind="stable")
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[order])])
                ends = np.searchsorted(segment[order], np.arange(segments + 1))
                sums = running[ends[1:]] - running[ends[:-1]]
                salt = mix((np.uint64(band) << np.uint64(32)) + np.arange(segments, dtype=np.uint64) * _GOLDEN)
                empty = ends[1:] == ends[:-1]
                leave_out = empty if 0 < empty.sum() <= spare else np.zeros(segments, bool)
                out.append(mix(sums + salt)[~leave_out])
                if twice:
                    some = segment < twice
                    out.append(mix(sums[segment[some]] - weight[some] + salt[segment[some]]))
        return distinct(np.concatenate(out)).view(np.int64)


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def set_map(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's place among ``MAP_BITS`` places a shingle, or the next power of two.

    With few bits a shingle many differences would fall together, and sets well below
    the threshold would pass: as many as the square of a group's size.
    """
    size = max(64, 1 << max(0, MAP_BITS * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[((shingles >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The map of the same set in ``size`` bytes, as 64-bit words."""
    out = np.frombuffer(raw, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _lists(arrays: list[np.ndarray], dtype) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(dtype) if arrays else np.zeros(0, dtype)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _text_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of some rows and megabytes."""
    for batch in slices(batches, rows):
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
            yield batch.slice(at, to - at)
            at = to


def _signatures(words: int, num: int, den: int, population: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(words), Signer(num, den, population)
        for batch in _text_batches(batches, 0):
            found = [sign(s) for s in shingle.many(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["signature"])

    return run


def _signed(words: int, num: int, den: int, population: int, bits):
    """Size, key of the whole set (null if empty) and the signatures in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(words), Signer(num, den, population)
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in _text_batches(batches, 2):
            sets = shingle.many(batch.column(2).to_pylist())
            signatures = []
            for s in sets:
                x = sign(s)
                place = x & (FILTER_BITS - 1)
                signatures.append(x[bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1])
            keys = [_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([set_map(s) for s in sets], pa.binary()), _lists(signatures, np.int64)], names=["doc_id", "text_key", "n_shingles", "key", "map", "signatures"])

    return run


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key and 64-bit hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in _text_batches(batches, 1, 500):
            sets = shingle.many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "key", "full"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, key binary, full binary").filter("key IS NOT NULL")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct ones."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _near_maps(num: int, den: int):
    """Keeps the pairs (a, b) whose sets may be similar, by their sizes and maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keep = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if min(n, m) * den < max(n, m) * num:
                    keep.append(False)
                    continue
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
                keep.append(differ <= most_apart(n + m, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(num: int, den: int):
    """Keeps the pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                i = _common(s, t)
                keep.append(den * i >= num * (len(s) + len(t) - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast, if it has been counted to be small enough for that."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) with the further columns of ``held`` (by id) for either end."""
    side = lambda name: held.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in held.columns if c != "id"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{n}" for n in "ab" for c in held.columns if c != "id"))


def near_pairs(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may be similar by the maps (id, n, map)."""
    return _both(pairs, maps).mapInArrow(_near_maps(num, den), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The similar ones among the pairs (a, b); only their texts are shingled once more."""
    pairs = materialize(pairs, "near")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("__id")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    sets = _sets(texts.join(_small(wanted), "__id", "left_semi"), words, "__id", "__text").groupBy("id").agg(F.min(F.struct("key", "full")).alias("s")).select("id", "s.full")
    return materialize(_both(pairs, materialize(sets, "sets")).mapInArrow(_similar(num, den), "a long, b long"), "links")


def _cross_pairs(num: int, den: int):
    """Pairs of different components that may be similar, from rows that hold two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            least = min(len(m["map"]) for side in ("left", "right") for m in row[side])
            left, right = ({n: np.array([m[n] for m in row[side]], np.int64) for n in ("id", "component", "n")} | {"map": np.stack([folded(m["map"], least) for m in row[side]])} for side in ("left", "right"))
            found = []
            for i in range(len(left["id"])):
                n = left["n"][i]
                near = np.minimum(right["n"], n) * den >= np.maximum(right["n"], n) * num
                near &= (right["component"] != left["component"][i]) & (right["id"] != left["id"][i])
                at = np.flatnonzero(near)
                differ = np.bitwise_count(right["map"][at] ^ left["map"][i]).sum(axis=1, dtype=np.int64)
                at = at[differ <= (right["n"][at] + n) * (den - num) // (den + num)]
                found.append(np.stack([np.full(len(at), left["id"][i]), right["id"][at]]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _jaccard_components(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col).withColumn("text_key", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = materialize(texts.filter("n > 1 AND text_key IS NOT NULL").select("text_key", "first"), "copied")
    marked = rows.join(_small(copied), "text_key", "left")
    source = marked.filter(F.col("first").isNull() | (F.col("doc_id") == F.col("first")))
    population = max(1, docs.count())
    counted = source.select("text").mapInArrow(_signatures(words, num, den, population), "signature long").groupBy("signature").count().filter("count > 1")
    bits = spark.sparkContext.broadcast(bitmap_of(counted, "signature", FILTER_BITS))
    signed = source.select("doc_id", "text_key", "text").mapInArrow(_signed(words, num, den, population, bits), "doc_id long, text_key binary, n_shingles long, key binary, map binary, signatures array<long>")
    signed = materialize(signed, "signed")
    bits.destroy()
    classes = materialize(signed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("id")), "classes")
    pairs_of = signed.select("key", F.explode("signatures").alias("signature")).join(_small(classes), "key").select("signature", "id").distinct()
    found = materialize(pairs_of, "found")
    shared = found.groupBy("signature").count().filter("count > 1").select("signature")
    members = materialize(found.join(_small(shared), "signature"), "members")

    # The most connected class of each signature meets the others.
    counts = members.groupBy("signature").agg(F.count("*").alias("n"))
    weights = members.join(_small(counts), "signature").groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = members.join(_small(weights), "id")
    hubs = weighed.groupBy("signature").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("signature", (-F.col("top.minus")).alias("hub"))
    star = members.join(_small(hubs), "signature").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    involved = members.select("id").distinct()
    held = signed.filter(F.col("key").isNotNull()).select(F.col("doc_id").alias("id"), F.struct("key", F.col("n_shingles").alias("n"), "map").alias("s"))
    maps = materialize(held.join(_small(involved), "id", "left_semi").groupBy("id").agg(F.min("s").alias("s")).select("id", "s.n", "s.map"), "maps")
    verified = lambda pairs: _verified(pairs, docs, words, num, den, id_col, text_col)
    links = verified(near_pairs(star, maps, num, den))

    # What is left: signatures with several components, in blocks.
    first = components(links)
    placed = members.join(_small(first.withColumnRenamed("node", "id")), "id", "left").select("signature", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2").select("signature", "n")
    left = materialize(placed.join(_small(mixed), "signature"), "mixed")
    few = left.filter(F.col("n") <= 16)
    pairs = few.select("signature", "id", "component").join(few.select("signature", F.col("id").alias("b"), F.col("component").alias("other")), "signature").filter("id < b AND component <> other").select(F.col("id").alias("a"), "b").distinct()
    many = left.filter(F.col("n") > 16)
    near = near_pairs(pairs.join(star, ["a", "b"], "left_anti"), maps, num, den)
    rest = verified(near.union(_blocked(many, maps, num, den)).distinct())
    linked = components(links.union(rest))

    owner = classes.join(linked, classes["id"] == linked["node"], "left").select("key", F.coalesce("component", "id").alias("component"))
    by_text = signed.dropDuplicates(["text_key"]).select("text_key", "n_shingles", "key").join(owner, "key", "left").drop("key")
    # A null text has no key and no shingles.
    joined = rows.select("doc_id", "text_key").join(by_text, "text_key", "left")
    return joined.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, *, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document."""
    short_batches(docs.sparkSession)
    with scratch_scope(docs.sparkSession):
        return materialize(_jaccard_components(docs, words, num, den, id_col, text_col), "jaccard", keep=True)


def _blocked(members: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components within a signature, found block against block."""
    # Blocks are dealt by component, so that those of one component need no comparison; a large one has several parts.
    order = Window.partitionBy("signature", "part").orderBy("component", "id")
    shares = members.groupBy("signature", "component").agg(F.count("*").alias("share"))
    dealt = members.join(shares, ["signature", "component"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("share") / PART_CLASSES)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("component", "salt"), F.ceil(F.col("n") / PART_CLASSES)))
    dealt = dealt.select("signature", "id", "component", "part").join(maps, "id")
    held = F.sum(F.greatest("n", F.lit(1024))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = dealt.withColumn("block", F.floor((held - 1) / BLOCK_SHINGLES))
    blocks = dealt.groupBy("signature", "part", "block").agg(F.collect_list(F.struct("id", "component", "n", "map")).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = materialize(blocks.withColumn("place", F.col("part") * (1 << 32) + F.col("block")), "blocks")
    other = blocks.select("signature", F.col("place").alias("place2"), F.col("rows").alias("right"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = blocks.join(other, "signature").filter("place <= place2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select(F.col("rows").alias("left"), "right")
    return met.mapInArrow(_cross_pairs(num, den), "a long, b long")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
