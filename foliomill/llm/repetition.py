"""Quality rule: repetition inside a document, by suffix array.

Words are the alphabet. Prefix doubling sorts the suffixes of a slice of documents at once (a suffix
only shares ranks within its own document); each round resorts only suffixes whose rank is still
shared. The longest common prefix of neighbours follows from the ranks of all rounds. An interval of
common prefixes of at least ``min_words`` is a maximal repeat; a suffix's longest repeat is the larger of
the two common prefixes beside it, and the spans of all repeats have the same union as these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices

MIN_WORDS = 6
MAX_FRACTION = 0.25
MAX_LONGEST = 64


def suffix_array(symbols: np.ndarray, doc: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many documents laid end to end, and the ranks by 1, 2, 4, ... symbols.

    A rank is the number of suffixes that sort before the suffix's first symbols; documents sort by
    their place, so suffixes of different documents share no rank. doc_end: for each symbol.
    """
    n = len(symbols)
    _, code = np.unique(symbols, return_inverse=True)
    key = doc.astype(np.int64) * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks = [rank]
    width = 1
    # suffixes whose rank is shared, with equal ranks side by side
    alone = fresh & np.append(fresh[1:], True)
    shared = order[~alone]
    while len(shared):
        rank = rank.copy()
        nxt = shared + width
        inside = nxt < doc_end[shared]
        tail = np.where(inside, ranks[-1][np.minimum(nxt, n - 1)] + 1, 0)
        group = ranks[-1][shared]
        order = np.argsort(group * (n + 2) + tail, kind="stable")
        shared, group, tail = shared[order], group[order], tail[order]
        at = np.arange(len(shared))
        new_group = np.ones(len(shared), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_run = new_group.copy()
        new_run[1:] |= tail[1:] != tail[:-1]
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_run = np.maximum.accumulate(np.where(new_run, at, 0))
        rank[shared] = group + first_of_run - first_of_group
        ranks.append(rank)
        width *= 2
        alone = new_run & np.append(new_run[1:], True)
        shared = shared[~alone]
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, ranks


def common_prefixes(sa: np.ndarray, ranks: list[np.ndarray], doc_end: np.ndarray) -> np.ndarray:
    """For each place of the suffix array but the first, the common prefix with the suffix before it."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    pairs = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1 if n > 1 else np.zeros(0, np.int64)
    a, b = sa[pairs - 1].copy(), sa[pairs].copy()
    end_a, end_b = doc_end[a], doc_end[b]
    total = np.zeros(len(pairs), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        ok = (a < end_a) & (b < end_b)
        same = ok & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        step = np.where(same, 1 << level, 0)
        total += step
        a += step
        b += step
    lcp[pairs] = total
    return lcp


def measure(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, words inside repeats of at least min_words, words of the longest such repeat."""
    w = Words(texts)
    docs = len(w.first) - 1
    count = np.diff(w.first)
    covered, longest = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    n = len(w.hash)
    if n:
        doc = w.doc()
        doc_end = w.first[1:][doc]
        sa, ranks = suffix_array(w.hash, doc, doc_end)
        lcp = common_prefixes(sa, ranks, doc_end)
        best = np.zeros(n, np.int64)
        best[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
        best[best < min_words] = 0
        np.maximum.at(longest, doc[best > 0], best[best > 0])
        starts = np.flatnonzero(best)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + best[starts], -1)
        inside = np.cumsum(edges)[:n] > 0
        covered = np.bincount(doc[inside], minlength=docs)
    return count, covered, longest


def repetition_rule(
    docs: DataFrame, min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """doc_id, n_words, covered_words, covered_fraction, longest_repeat, keep: one row per row of docs.

    keep is false where repeats of at least min_words words cover more than max_fraction of the words, or
    one is longer than max_longest words. Null and empty texts have no words, fraction 0, and are kept;
    a null doc_id stays null; repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                count, covered, longest = measure(part.column(1), min_words)
                fraction = covered / np.maximum(count, 1)
                keep = (fraction <= max_fraction) & (longest <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count), pa.array(covered), pa.array(fraction), pa.array(longest), pa.array(keep)],
                    ["doc_id", "n_words", "covered_words", "covered_fraction", "longest_repeat", "keep"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, covered_words long, covered_fraction double, longest_repeat long, keep boolean")
