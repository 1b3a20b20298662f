"""Best-fit packing of documents into training sequences, improved by swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens (whole documents; only longer ones are cut).
Pieces fall by hash into buckets of about ``bucket_pieces``; the number of buckets follows the data, so every
bucket costs the same at any size and loses at most part of a bin. In a bucket, best-fit decreasing comes first. Then
underfull bins exchange documents: a move, one for one, two for one or one for two, always raising the
sum of squared fills, which fills some bins and drains others until they are empty and vanish. It ends where no
exchange raises the sum.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered
from .mixing import tokens

CAPACITY = 2048
BUCKET_PIECES = 4096
MOST_TASKS = 10_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices of sizes."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    open_: dict[int, list[int]] = defaultdict(list)
    bins: list[list[int]] = []
    for i in order:
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
        bins[b].append(i)
        room -= sizes[i]
        if room > 0:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append(b)
    return bins


class _Bin:
    """A bin's documents as sorted singles and pairs, for quick search."""

    __slots__ = ("items", "fill", "single", "single_of", "pair", "pair_of")

    def __init__(self, items: list[int], sizes: list[int]):
        self.items = items
        self.fill = sum(sizes[i] for i in items)
        size = np.array([sizes[i] for i in items], np.int64)
        self.single, at = np.unique(size, return_index=True)
        self.single_of = [(items[k],) for k in at]
        a, b = np.triu_indices(len(items), 1)
        self.pair, at = np.unique(size[a] + size[b], return_index=True)
        self.pair_of = [(items[a[k]], items[b[k]]) for k in at]


def _best_exchange(donor: _Bin, others: list[_Bin], capacity: int) -> tuple[int, _Bin, tuple, tuple] | None:
    """The exchange that raises the squared fill most: gain, receiver, what donor gives, what it gets back.

    A receiver A gains d = given - returned at the cost of donor B; the sum of squares rises by
    2 d (A - B + d). That grows with d where it is positive, so for each thing returned
    the largest gift that fits is best.
    """
    returned, owner, kind, place = [], [], [], []
    for k, a in enumerate(others):
        n, m = len(a.single), len(a.pair)
        returned += [np.zeros(1, np.int64), a.single, a.pair]
        owner.append(np.full(1 + n + m, k))
        kind.append(np.repeat([0, 1, 2], [1, n, m]))
        place += [np.zeros(1, np.int64), np.arange(n), np.arange(m)]
    returned, owner, kind, place = (np.concatenate(x) for x in (returned, owner, kind, place))
    fills = np.array([a.fill for a in others])[owner]
    best = None
    for gifts, names, allowed in ((donor.single, donor.single_of, kind <= 2), (donor.pair, donor.pair_of, kind == 1)):
        if not len(gifts):
            continue
        r, o, f = returned[allowed], owner[allowed], fills[allowed]
        at = np.searchsorted(gifts, capacity - f + r, side="right") - 1
        d = np.where(at >= 0, gifts[np.maximum(at, 0)] - r, 0)
        gain = np.where(d > 0, 2 * d * (f - donor.fill + d), 0)
        j = int(np.argmax(gain)) if len(gain) else -1
        if j >= 0 and gain[j] > 0 and (best is None or gain[j] > best[0]):
            a = others[int(o[j])]
            k, p = int(kind[allowed][j]), int(place[allowed][j])
            back = () if k == 0 else a.single_of[p] if k == 1 else a.pair_of[p]
            best = (int(gain[j]), a, names[int(at[j])], back)
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins until no exchange raises the sum of squared fills."""
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    under = [_Bin(b, sizes) for b in bins if sum(sizes[i] for i in b) < capacity]
    improved = True
    while improved and len(under) > 1:
        improved = False
        for donor in sorted(under, key=lambda b: b.fill):
            if all(donor is not b for b in under):
                continue
            while True:
                others = [b for b in under if b is not donor]
                found = _best_exchange(donor, others, capacity) if others else None
                if found is None:
                    break
                improved = True
                _, a, given, back = found
                to_a = _Bin([i for i in a.items if i not in back] + list(given), sizes)
                to_b = _Bin([i for i in donor.items if i not in given] + list(back), sizes)
                under = [b for b in under if b is not a and b is not donor]
                for changed in (to_a, to_b):
                    if changed.fill == capacity:
                        full.append(changed.items)
                    elif changed.items:
                        under.append(changed)
                if not to_b.items or to_b.fill == capacity:
                    break
                donor = to_b
    return full + [b.items for b in under]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; sizes lie between 1 and capacity."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """doc_id, piece, piece_start, piece_tokens, bin_id, bin_offset: where each piece of each document goes.

    Pieces of a document are numbered from 0; piece_start is the token at which one begins. bin_id is one number over all
    buckets. Repeated rows are packed as documents of their own; a null doc_id stays null. Documents without tokens
    (null, empty or blank text) have no piece; a text of any length is cut into as many pieces as it needs. Other columns are
    ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens().alias("n"), F.xxhash64("doc_id", "text").alias("h")).where("n > 0")
    # equal rows are told apart by a number, so that they spread over all buckets
    copies = numbered(narrow.groupBy("doc_id", "n", "h").agg(F.count("*").alias("copies")), F.col("copies"), "copy")
    pieces = materialise(numbered(copies, F.expr(f"(n - 1) div {capacity} + 1"), "piece").select("doc_id", "n", "h", "copy", "piece"))
    buckets = max(1, -(-pieces.count() // bucket_pieces))
    sized = pieces.select(
        "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("piece_start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("piece_tokens"),
        F.pmod(F.xxhash64("h", "piece", "copy"), F.lit(buckets)).alias("bucket"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["piece_tokens"].tolist()
        which, where = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, items in enumerate(pack(sizes, capacity)):
            at = 0
            for i in items:
                which[i], where[i] = k, at
                at += sizes[i]
        pdf["bin_id"] = which + (int(pdf["bucket"].iloc[0]) << 32)
        pdf["bin_offset"] = where
        return pdf.drop(columns=["bucket", "copy"])

    out = "doc_id long, piece long, piece_start long, piece_tokens long, bin_id long, bin_offset long"
    # few bytes, much search: as many tasks as buckets, not as bytes
    return sized.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInPandas(run, out)
