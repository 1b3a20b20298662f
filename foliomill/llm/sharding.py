"""Sharding: best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups of equal size are interchangeable, so best-fit decreasing runs over sizes, not groups: the tightest
shard that can take a group of size s stays the tightest while it still has room, and so takes a run of
min(groups left, room // s) of them at once. What the driver holds is the histogram of sizes (as many as there are
different sizes), the open shards in a balanced tree (a treap keyed by room) and the runs; the groups themselves stay distributed: a group's
number within its size decides the run, and so the shard, that it belongs to.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ranges

CAPACITY = 16 << 20
PART = 100_000


class Treap:
    """Balanced search tree from room to the open shards with just that room (taken lowest number first)."""

    __slots__ = ("root", "_state")

    def __init__(self):
        self.root = None
        self._state = 0x2545F491

    def _random(self) -> int:
        x = self._state
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self._state = x
        return x

    # node: [key, priority, left, right, heap of shards]
    def _split(self, node, key):
        """Nodes with keys < key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        node = self.root
        while node is not None:
            if node[0] == room:
                heapq.heappush(node[4], shard)
                return
            node = node[2] if room < node[0] else node[3]
        a, b = self._split(self.root, room)
        self.root = self._merge(self._merge(a, [room, self._random(), None, None, [shard]]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, shard) of the least room that is at least size."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= size:
                found, node = node, node[2]
            else:
                node = node[3]
        if found is None:
            return None
        shard = heapq.heappop(found[4])
        if not found[4]:
            a, rest = self._split(self.root, found[0])
            _, b = self._split(rest, found[0] + 1)
            self.root = self._merge(a, b)
        return found[0], shard


def best_fit_runs(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over (size, groups) pairs: runs (size, first number, number past the last, shard).

    A group larger than the capacity has a shard of its own. Groups of size 0 all join the tightest shard.
    """
    tree, runs, shards = Treap(), [], 0
    for size, groups in sorted(histogram, reverse=True):
        done = 0
        while done < groups:
            if size > capacity:
                runs.append((size, done, done + 1, shards))
                shards += 1
                done += 1
                continue
            room, shard = tree.take_tightest(size) or (capacity, None)
            if shard is None:
                shard, shards = shards, shards + 1
            n = min(groups - done, room // size) if size else groups - done
            runs.append((size, done, done + n, shard))
            done += n
            tree.add(room - n * size, shard)
    return runs


def _cut_runs(runs: list[tuple[int, int, int, int]], width: int) -> pa.Table:
    """The runs (size, lo, hi, shard) as rows (group_size, part, number, shard_id) that begin a run; runs are cut at multiples of width, where a part begins."""
    size, lo, hi, shard = np.array(runs, np.int64).reshape(-1, 4).T
    pieces = (hi - 1) // width - lo // width + 1
    at = np.repeat(np.arange(len(size)), pieces)
    part = ranges(lo // width, pieces)
    number = np.maximum(lo[at], part * width)
    return pa.table({"group_size": size[at], "part": part, "number": number, "shard_id": shard[at]})


def pack_shards(groups: DataFrame, capacity: int = CAPACITY, width: int = PART) -> DataFrame:
    """group_key, group_size and shard_id of groups (group_key, group_size); keys must be distinct.

    Within one size, groups are numbered by a hash of their key. Null sizes count as 0; negative sizes are an error.
    An empty input gives an empty result. A size that many groups have is numbered slice by slice, and meets its runs in
    parts of ``width`` groups, so that no task holds a whole size.
    """
    spark = groups.sparkSession
    key = F.md5(F.col("group_key").cast("string"))
    sized = materialise(groups.select("group_key", F.coalesce(F.col("group_size"), F.lit(0)).cast("long").alias("group_size"), key.alias("key"), F.substring(key, 1, 2).alias("slice")))
    counts = materialise(sized.groupBy("group_size", "slice").agg(F.count("*").alias("n")))
    histogram = [(r.group_size, r.n) for r in counts.groupBy("group_size").agg(F.sum("n").alias("n")).toLocalIterator()]
    if any(size < 0 for size, _ in histogram):
        raise ValueError("negative group size")
    starts = materialise(spark.createDataFrame(_cut_runs(best_fit_runs(histogram, capacity), width), "group_size long, part long, number long, shard_id long"))
    earlier = F.sum("n").over(Window.partitionBy("group_size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("group_size", "slice", F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("group_size", "slice").orderBy("key", "group_key")) - 1
    placed = sized.withColumn("within", within).join(offsets, ["group_size", "slice"]).withColumn("number", F.col("before") + F.col("within"))
    placed = placed.select("group_size", F.expr(f"number div {width}").alias("part"), "number", F.lit(None).cast("long").alias("shard_id"), "group_key")
    # a group belongs to the last run that begins at or before its number
    both = placed.unionByName(starts.withColumn("group_key", F.lit(None).cast(sized.schema["group_key"].dataType)).withColumn("begins", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy("group_size", "part").orderBy("number", F.col("begins").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shard = F.last("shard_id", ignorenulls=True).over(upto)
    return both.withColumn("shard_id", shard).where("begins IS NULL").select("group_key", "group_size", "shard_id")


def shard_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, group_key, group_size, shard_id: one row per row of docs.

    A group is all documents with the same text, so copies never sit in two shards (and never on both sides of
    a split made by shard); its size is the sum of their UTF-8 bytes. The key is the SHA-256 of the text. Null
    and empty texts form one group of size 0. A null doc_id stays null; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("group_key"), F.octet_length(text).alias("size"))
    narrow = materialise(narrow)
    groups = narrow.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    return narrow.join(pack_shards(groups, capacity), "group_key").select("doc_id", "group_key", "group_size", "shard_id")
