"""Shared helpers: durable intermediate tables, and vectorised word hashing over Arrow buffers.

Python stages see text as Arrow string arrays. ``Words`` finds the words of a whole batch on the
UTF-8 buffer itself and gives each a 64-bit hash, so no Python string is made per word.
Work is cut into slices of about ``SLICE_BYTES`` so that temporaries stay small whatever
the batch holds; a single longer text forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import materialise, release, shared_dir, tidy  # noqa: F401 - for the operators

SLICE_BYTES = 1 << 18


def give_back() -> None:
    """Return memory that this process holds but doesn't use: workers live on, idle, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed_row(df: DataFrame) -> DataFrame:
    """df as one struct column ``row``, so that helper columns beside it can clash with none of its names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def numbered(df: DataFrame, times: Column, name: str, block: int = 4096) -> DataFrame:
    """Each row of df ``times`` times, with name from 0 to times - 1; no array is longer than block, however large times is."""
    last = F.greatest(times.cast("long"), F.lit(0).cast("long")) - 1
    out = df.select("*", last.alias("_last")).where("_last >= 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {block}"))))
    within = F.sequence(F.col("_block") * block, F.least(F.col("_last"), F.col("_block") * block + (block - 1)))
    return out.withColumn(name, F.explode(within)).drop("_last", "_block")


SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, most_bits: int = SIEVE_BITS) -> Callable[[Column], Column]:
    """A test that is true of every key (a long column ``key``) of keys, and of few other longs: a Bloom filter.

    It spares rows that surely have no partner a shuffle. Its size follows the number of keys up to most_bits (4 MB), which
    bounds what the driver and each task hold; with more keys than the filter could tell apart every row passes.
    """
    n = keys.count()
    if 2 * n > most_bits:
        return lambda key: F.lit(True)
    bits = min(most_bits, max(1 << 10, 1 << (16 * n).bit_length()))
    places = F.array(*[F.shiftrightunsigned(F.xxhash64("key", F.lit(k)), 64 - (bits.bit_length() - 1)) for k in range(2)])
    word = F.shiftright("at", 6).cast("int")
    mask = keys.select(F.explode(places).alias("at")).groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[np.asarray(mask.column("word"))] = np.asarray(mask.column("mask"), np.int64).view(np.uint64)

    @F.arrow_udf("boolean")
    def passes(first: pa.Array, second: pa.Array) -> pa.Array:
        out = np.ones(len(first), bool)
        for column in (first, second):
            at = np.asarray(pc.fill_null(column, 0), np.int64)
            out &= (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(out)

    return lambda key: passes(*[F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 64 - (bits.bit_length() - 1)) for k in range(2)])


def valid_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, rid and text (and columns) of the rows that have both an id and a text.

    rid tells apart rows that share a doc_id but differ in text; rows equal in both are one document.
    """
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").alias("text"), *columns
    )


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows in them; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    return _powers(max(1 << 16, 1 << int(n).bit_length()), base)[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words (runs of bytes other than ASCII white space) of many texts.

    start, end: byte offsets; first: per text, the index of its first word (one more entry than texts);
    hash: 64-bit content hash of each word.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACE):
        raw, offsets = buffers(texts)
        n = len(raw)
        word = np.frombuffer(raw.tobytes().translate((~separators).tobytes()), bool)  # an index of bytes would be widened first
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = ~word[:-1]
            after[:-1] = ~word[1:]
            before |= edge[:n]
            after |= edge[1:]
        self.raw = raw
        self.offsets = offsets
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(n + 1, np.uint64)
            own = self._sums[1:]
            _TABLE.take(raw, out=own, mode="clip")
            own *= powers(n, _MUL)[:n]
            np.cumsum(own, out=own)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Content hash of byte ranges."""
        with np.errstate(over="ignore"):
            h = (self._sums[end] - self._sums[start]) * powers(len(self.raw), _INV)[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, for all but the last n - 1 words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(0x5851F42D4C957F2D) + hashes[j : j + m]
        return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same of the next, in one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(start - (np.cumsum(count) - count), count)
    return at + np.arange(total)


def groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 1 << 16, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut batches that are sorted by an integer key so that no group of equal keys is split.

    Yields batches of whole groups, of about ``rows`` rows or ``size`` bytes, or of one group that is larger.
    """
    held: list[pa.RecordBatch] = []
    n = bytes_ = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        bytes_ += batch.nbytes
        if n < rows and bytes_ < size:
            continue
        keys = np.asarray(batch.column(key))
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            give_back()
            held = [batch.slice(cut)]
            n, bytes_ = held[0].num_rows, held[0].nbytes
        elif len(held) > 1 and held[-2].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held[:-1]).combine_chunks().to_batches()[0]
            held = [batch]
            n, bytes_ = batch.num_rows, batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        give_back()


def group_cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if not len(keys):
        return []
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:]))


class Sets:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round is a
    written table, so no lineage grows and no lost executor costs more than its tasks.
    """

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every node links its greater neighbours to the least of itself and all neighbours;
        # small: every node links itself and its smaller neighbours to the least of them
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = mark(e)
    while now[0]:
        step = materialise(star(star(e, True), False))
        release(e)
        e, before = step, now
        now = mark(e)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
