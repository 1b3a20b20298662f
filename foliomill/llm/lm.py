"""Language-model scoring with a gated recurrent network trained here, in numpy.

Tokens are words and an end mark. The most frequent words of the corpus, more of them the larger it is, are tokens by
themselves. Any other word is a token of its length to the network, and its bytes are scored by a model of
spelling counted over all such words, so that its probability is that of the very word. The output
softmax is factored: a class of tokens first, then the token within its class. Tokens are ordered by frequency and cut into classes of
equal shares of the sum of square roots of frequencies, which makes the softmax cheapest: classes of frequent tokens are small. Training is truncated
backpropagation: documents run through lanes in windows, each lane's state carried from window to window and
reset where a document begins. Every document is trained on once: documents fall by hash into rounds and shards (the
number of either follows the corpus); the shards of a round train apart from the same weights, and the weights
are averaged by tokens before the next round. Scoring carries the state through each whole document,
so its log-likelihood is of the complete text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, materialise, ranges, release, signed, slices, tidy

VOCABULARY = 2048  # tokens of a small corpus
GROWTH = 2  # tokens of a larger one: so many times the square root of its words
SLOWER = 1 << 18  # tokens from which their number grows more slowly
LENGTHS = 32  # tokens for other words, by length in bytes; the last one is for all longer words too
ORDER = 3  # bytes before that a byte's spelling depends on
EMBEDDING, HIDDEN = 16, 24
LANES, WINDOW = 512, 20
LONGEST_WINDOW = 1024  # steps of a window when few lanes are left
ROUNDS = 2  # of a small corpus
SHARD_TOKENS = 2_000_000
RATE = 0.01
MOST = 3.0  # bound of an output weight, which keeps exponentials finite
BLOCK = 4096
PIECE = 1 << 15  # weights that are moved at once, to fit the cache
CELLS = 1 << 16  # probabilities that are held at once, to fit the cache
SCORED = 1 << 23  # tokens that a task scores at once: the more, the fewer steps have lanes that wait for the longest text
DENSE = 1 << 24  # most cells of the table of spellings
HELD = 2_000_000  # words or bytes whose counts a task sends on at once


# --- tokens


def _sums(docs: DataFrame, keys: Callable[[pa.Array], np.ndarray], name: str) -> DataFrame:
    """(name, n): how often each of the keys of the texts occurs; a task sends counts on piece by piece and drops none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([signed(found), pa.array(n.astype(np.int64))], [name, "n"])

        for batch in batches:
            for part in slices(batch):
                held.append(keys(part.column(0)))
                size += len(held[-1])
                if size > HELD:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of word hashes over all texts."""
    return _sums(docs, lambda texts: Words(texts).hash, "word")


def vocabulary_size(words: int) -> int:
    """Number of tokens, lengths and end mark among them, for a corpus of so many words.

    The growth slows from SLOWER tokens on (an eighth root), as every task holds the weights: 10 ** 14 words have some 770,000 tokens, 180 MB.
    """
    tokens = math.ceil(GROWTH * math.sqrt(words))
    return max(VOCABULARY, tokens if tokens <= SLOWER else math.ceil(SLOWER * (tokens / SLOWER) ** 0.25))


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the most frequent words, most frequent first, and the number of all words."""
    counts = materialise(word_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary_size(total) - LENGTHS - 1).select("word").toArrow()
    release(counts)
    return np.asarray(top.column(0), np.int64).view(np.uint64), total


END = 0
FIRST_WORD = 1 + LENGTHS


def token_type(tokens: int) -> np.dtype:
    return np.dtype("<u2" if tokens <= 1 << 16 else "<i4")


class Known:
    """Token ids of words by their hashes; a table says where the words with the same top bits begin among the sorted ones."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        top = np.uint64(2**64 - 1)
        self.words, self.token = np.append(words[order], top), np.append(FIRST_WORD + order, 0)
        bits = min(24, max(8, len(words).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(words[order], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.tokens = FIRST_WORD + len(words)

    def ids(self, w: Words) -> np.ndarray:
        """Token id of each word, the length for words that are none of the vocabulary's."""
        at = self.first[w.hash >> self.shift]
        before = np.flatnonzero(self.words[at] < w.hash)
        while len(before):
            at[before] += 1
            before = before[self.words[at[before]] < w.hash[before]]
        return np.where((self.words[at] == w.hash) & (at < len(self.words) - 1), self.token[at], np.minimum(w.end - w.start, LENGTHS))


def encode(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts, each with the end mark, and the number of tokens of each."""
    w = Words(texts)
    return _laid(w, Known(words).ids(w), token_type(FIRST_WORD + len(words)))


def _laid(w: Words, ids: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(w.first) + 1
    out = np.full(int(count.sum()), END, kind)
    out[np.arange(len(ids)) + w.doc()] = ids
    return out, count


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each byte of the words, the byte and the ORDER before it in its word (0 before the first), as one number."""
    at, mask = _preceded(start, end - start)
    # the four bytes up to each byte of raw as one number, made for the whole buffer without an index
    wide = raw.astype(np.uint32)
    strings = wide.copy()
    for k in range(1, ORDER + 1):
        strings[k:] |= wide[:-k] << np.uint32(8 * k)
    return (strings.take(at) & mask).astype(np.int64)


_MASKS = np.array([(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)], np.uint32)


def _preceded(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' bytes, and for each a mask of the four bytes up to it that leaves those of its word."""
    at, first = ranges(start, length), np.cumsum(length) - length
    mask = np.full(len(at), _MASKS[ORDER], np.uint32)
    for k in range(ORDER - 1, -1, -1):
        mask[(first + k)[length > k]] = _MASKS[k]
    return at, mask


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


LONG, EXCESS = -1, -2  # keys of spelling counts: words of LENGTHS bytes or more, and their bytes beyond LENGTHS


class Spelling:
    """Probability of a word's bytes, given its length token: each byte after the ORDER before it.

    Orders are interpolated (Witten-Bell) down to even odds for all bytes, so no word has probability 0. The bytes of a word
    longer than LENGTHS are as many as a geometric distribution says.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        extra = {int(k): int(c) for k, c in zip(keys[keys < 0], n[keys < 0])}
        long, excess = extra.get(LONG, 0), extra.get(EXCESS, 0)
        self.more = math.log((excess + 1) / (excess + long + 2))
        self.last = math.log((long + 1) / (excess + long + 2))
        keys, n = keys[keys >= 0], n[keys >= 0].astype(np.float64)
        self.tables: list[tuple[np.ndarray, ...]] = []  # by order: strings, their log probabilities, contexts, log weights of the order below
        before = None
        for k in range(ORDER + 1):
            strings, code = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.bincount(code, weights=n, minlength=len(strings))
            contexts, of = np.unique(strings >> 8, return_inverse=True)
            kinds = np.bincount(of, minlength=len(contexts))
            total = np.bincount(of, weights=seen, minlength=len(contexts)) + kinds
            below = np.full(len(strings), 1 / 256) if before is None else before[1][_find(before[0], strings & ((1 << 8 * k) - 1))[0]]
            p = (seen + kinds[of] * below) / total[of]
            self.tables.append((strings, np.log(p), contexts, np.log(kinds / total)))
            before = strings, p
        self._lay_out()

    def _lay_out(self) -> None:
        """Where it is small enough, one table of log probabilities: a row for each context of any order, a column for each byte.

        place says the row of three bytes before: that of the longest of their ends that was seen. It only makes look-ups fast.
        """
        self.place: np.ndarray | None = None
        seen = np.zeros(256, bool)
        for k in range(ORDER + 1):
            seen[(self.tables[-1][0] >> (8 * k)) & 255] = True
        seen[0] = True  # stands before a word too
        code = np.full(256, int(seen.sum()), np.int64)  # the last one is for all bytes that never occur
        code[seen] = np.arange(seen.sum())
        width = int(seen.sum()) + 1
        rows = sum(len(t[2]) for t in self.tables)
        if width**ORDER + max(rows, 1) * width > DENSE:
            return
        table = np.full((max(rows, 1), width), -math.log(256), np.float32)
        place, base, below = np.zeros((width,) * ORDER, np.int32), 0, np.zeros(0, np.int64)
        for k, (strings, p, contexts, weight) in enumerate(self.tables):
            if not len(contexts):
                break
            own = base + np.arange(len(contexts))
            if k:
                table[own] = table[below[np.searchsorted(self.tables[k - 1][2], contexts & ((1 << 8 * (k - 1)) - 1))]]
            table[own] += weight[:, None]
            table[base + np.searchsorted(contexts, strings >> 8), code[strings & 255]] = p
            before = tuple(code[(contexts >> (8 * j)) & 255] for j in range(k))
            place[before] = own.reshape((-1, *[1] * (ORDER - k))) if k else own[0]
            base, below = base + len(contexts), own
        self.place, self.table, self.code = place, table, code

    def log_probabilities(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each word (byte ranges of raw)."""
        length = end - start
        if self.place is not None:
            strings = _strings(raw, start, end)
            place, width = np.zeros(len(strings), np.int64), self.place.shape[0]
            for k in range(1, ORDER + 1):
                place = place * width + self.code.take((strings >> (8 * k)) & 255)
            row = self.place.reshape(-1).take(place).astype(np.int64)
            out = self.table.reshape(-1).take(row * self.table.shape[1] + self.code.take(strings & 255)).astype(np.float64)
        else:
            out = self._searched(_strings(raw, start, end))
        total = np.bincount(np.repeat(np.arange(len(start)), length), weights=out, minlength=len(start))
        return total + np.where(length >= LENGTHS, self.last + np.maximum(length - LENGTHS, 0) * self.more, 0.0)

    def _searched(self, strings: np.ndarray) -> np.ndarray:
        out = np.zeros(len(strings))
        left = np.arange(len(strings))
        for k in range(ORDER, -1, -1):
            known, p, contexts, weight = self.tables[k]
            now = strings[left] & ((1 << 8 * (k + 1)) - 1)
            at, hit = _find(known, now)
            out[left[hit]] += p[at[hit]]
            left, now = left[~hit], now[~hit]
            at, hit = _find(contexts, now >> 8)
            out[left[hit]] += weight[at[hit]]
        out[left] -= math.log(256)
        return out


def spelling_model(docs: DataFrame, words: np.ndarray) -> Spelling:
    """Counted over every word of docs that isn't in the vocabulary."""
    known = Known(words)

    def keys(texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        other = np.flatnonzero(known.ids(w) < FIRST_WORD)
        start, end = w.start[other], w.end[other]
        beyond = (end - start - LENGTHS)[end - start >= LENGTHS]
        return np.concatenate([_strings(w.raw, start, end), np.full(len(beyond), LONG), np.full(int(beyond.sum()), EXCESS)])

    found = _sums(docs, keys, "string").toArrow()
    return Spelling(np.asarray(found.column(0), np.int64), np.asarray(found.column(1), np.int64))


def encoded(docs: DataFrame, words: np.ndarray, spelling: Spelling) -> DataFrame:
    """(doc_id, h, n, spelled, ids): the tokens of each row (see token_type), and the log probability of the spelling of its other words."""
    kind, vocabulary_ = token_type(FIRST_WORD + len(words)), Known(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(2))
                known = vocabulary_.ids(w)
                ids, count = _laid(w, known, kind)
                other = np.flatnonzero(known < FIRST_WORD)
                spelled = np.bincount(w.doc()[other], weights=spelling.log_probabilities(w.raw, w.start[other], w.end[other]), minlength=len(count)).astype(np.float64)  # of no words it would be whole numbers
                offsets = np.zeros(len(count) + 1, np.int32)
                np.cumsum(count * kind.itemsize, out=offsets[1:])
                binary = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), pa.array(spelled), binary], ["doc_id", "h", "n", "spelled", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, h long, n long, spelled double, ids binary")


# --- the network

OUTPUT = ("wc", "ww")  # weights of classes, and of tokens within their class
TRAINED = ("b", "emb", "u", "w", *OUTPUT)


def class_edges(counts: np.ndarray) -> np.ndarray:
    """First token of each class, and the number of tokens: classes of equal shares of the sum of square roots of frequencies."""
    root = np.sqrt((counts + 1.0) / (counts.sum() + len(counts)))
    share = np.cumsum(root) - root / 2
    classes = max(1, round(root.sum()))
    first = np.searchsorted(share, np.arange(classes) * root.sum() / classes)
    return np.unique(np.append(first, len(counts))).astype(np.int64)


def fresh(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training; output biases (the last column of OUTPUT) are the log frequencies of counts."""
    rng = np.random.Generator(np.random.PCG64(5))
    edges = class_edges(counts)
    p = (counts + 1.0) / (counts.sum() + len(counts))
    by_class = np.add.reduceat(p, edges[:-1])

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def output(bias: np.ndarray) -> np.ndarray:
        return np.hstack([normal(len(bias), HIDDEN, scale=0.05), np.log(bias).astype(np.float32)[:, None]])

    return {
        "emb": normal(len(counts), EMBEDDING, scale=0.3), "w": normal(EMBEDDING, 3 * HIDDEN, scale=EMBEDDING**-0.5), "u": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "b": np.zeros(3 * HIDDEN, np.float32), "wc": output(by_class), "ww": output(p / np.repeat(by_class, np.diff(edges))), "edges": edges,
    }


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in TRAINED])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {"edges": like["edges"]}, 0
    for k in TRAINED:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w, u and b as rows for states in columns; those of the two gates are halved, as sigmoid(v) = (tanh(v / 2) + 1) / 2."""
    half = np.ones((3 * HIDDEN, 1), p["w"].dtype)
    half[: 2 * HIDDEN] = 0.5
    return p["w"].T * half, p["u"].T * half, p["b"][:, None] * half


def _spans(edges: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[tuple[str, np.ndarray, list[tuple[int, int, int, int]]]]]:
    """Order of the targets by class, and for each of OUTPUT its name, what is chosen for each target in that order, and the runs (first choice, end choice, start, end in that order).

    A run has about CELLS probabilities at most. A class of one token is no choice and has none.
    """
    cls = np.searchsorted(edges, target, side="right") - 1
    order = np.argsort(cls.astype(np.int16 if len(edges) < 1 << 15 else np.int32), kind="stable")
    cls = cls[order]
    ends = np.searchsorted(cls, np.arange(len(edges)))
    at = np.flatnonzero((np.diff(ends) > 0) & (np.diff(edges) > 1))

    def cut(lo: int, hi: int, a: int, b: int) -> list[tuple[int, int, int, int]]:
        rows = max(128, CELLS // (hi - lo))
        return [(lo, hi, i, min(b, i + rows)) for i in range(a, b, rows)]

    within = [run for own in zip(edges[at].tolist(), edges[at + 1].tolist(), ends[at].tolist(), ends[at + 1].tolist()) for run in cut(*own)]
    return order, [("wc", cls, cut(0, len(edges) - 1, 0, len(target))), ("ww", target[order], within)]


def _cells(chosen: np.ndarray, lo: int, hi: int, a: int, b: int) -> np.ndarray:
    """Places of the choices of a run among all its probabilities, row by row."""
    own = np.arange(0, (b - a) * (hi - lo), hi - lo)
    own += chosen[a:b]
    own -= lo
    return own


def log_probabilities(p: dict, h1: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target token after a state; h1 has the states and a last column of ones, which meets the biases."""
    order, levels = _spans(p["edges"], target)
    h1 = h1.take(order, axis=0)
    odds = np.ones((len(levels), len(h1)), h1.dtype)
    for k, (name, chosen, runs) in enumerate(levels):
        for lo, hi, a, b in runs:
            e = h1[a:b] @ p[name][lo:hi].T
            np.exp(e, out=e)
            odds[k, a:b] = e.reshape(-1).take(_cells(chosen, lo, hi, a, b)) / (e @ np.ones(hi - lo, e.dtype))
    out = np.empty(len(h1), h1.dtype)
    out[order] = np.log(np.maximum(odds, 1e-30)).sum(axis=0)
    return out


def forward(p: dict, x: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States of a window (steps x lanes x H + 1, the last column 1), and the state (H x lanes) after it.

    Steps go in blocks of about LANES states, which fit the cache: what needs no earlier state is done for a block at once. keep gets of each
    block what gradients() needs of it.
    """
    (steps, lanes), k, kind = x.shape, HIDDEN, h.dtype
    w, u, bias = _gates(p)
    rows = np.ones((steps, lanes, k + 1), kind)
    begins, block = starts.any(axis=1).tolist(), max(1, LANES // lanes)
    for a in range(0, steps, block):
        b = min(a + block, steps)
        fed = p["emb"].take(x[a:b].reshape(-1), axis=0)
        if any(begins[a:b]):
            fed[starts[a:b].reshape(-1)] = 0
        inputs = w @ fed.T
        inputs += bias
        inputs = inputs.reshape(3 * k, b - a, lanes)
        before, zr, n, an = np.empty((b - a, k, lanes), kind), np.empty((b - a, 2 * k, lanes), kind), np.empty((b - a, k, lanes), kind), np.empty((b - a, k, lanes), kind)
        for t in range(b - a):
            own, gates, new = before[t], zr[t], n[t]
            if begins[a + t]:
                np.multiply(h, ~starts[a + t], out=own)
            else:
                own[:] = h
            fits = u @ own
            np.add(inputs[: 2 * k, t], fits[: 2 * k], out=gates)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            an[t] = fits[2 * k :]
            np.multiply(gates[k:], fits[2 * k :], out=new)
            new += inputs[2 * k :, t]
            np.tanh(new, out=new)
            h = own - new
            h *= gates[:k]
            h += new
            rows[a + t, :, :k] = h.T
        if keep is not None:
            keep.append((a, b, fed, before, zr, n, an))
    return rows, h


def gradients(p: dict, x: np.ndarray, y: np.ndarray, starts: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss over one window, the state (H x lanes) after it, and the summed loss.

    x, y: input and target tokens (window x lanes); starts: where a document begins (no input, state 0); real: what is no padding.
    The gradient of emb is a pair: the tokens that occur, and a row for each. What a block of forward() needs is small enough for the cache,
    so nothing but the softmax works on the whole window.
    """
    (steps, lanes), k, kind = x.shape, HIDDEN, h.dtype
    saved: list[tuple] = []
    rows, after = forward(p, x, starts, h, saved)
    at = np.flatnonzero(real.reshape(-1))
    total = max(len(at), 1)
    target = y.reshape(-1)[at]
    order, levels = _spans(p["edges"], target)
    place = at[order]
    h1 = rows.reshape(-1, k + 1).take(place, axis=0)
    g = {name: np.zeros_like(p[name]) for name in OUTPUT}
    odds, dh = np.ones((len(levels), len(at)), kind), np.zeros((len(at), k), kind)
    for part, (name, chosen, runs) in enumerate(levels):
        for lo, hi, a, b in runs:
            # a row's scale meets its state, not its many exponentials
            weights, own = p[name][lo:hi], _cells(chosen, lo, hi, a, b)
            e = h1[a:b] @ weights.T
            np.exp(e, out=e)
            sums = e @ np.ones(hi - lo, kind)
            flat = e.reshape(-1)
            taken = flat.take(own)
            odds[part, a:b] = taken / sums
            flat[own] = taken - sums
            scale = (1 / (sums * total))[:, None]
            g[name][lo:hi] += e.T @ (h1[a:b] * scale)
            back = e @ weights[:, :k]
            back *= scale
            dh[a:b] += back
    loss = -float(np.log(np.maximum(odds, 1e-30)).sum())
    dstates = np.zeros((steps * lanes, k), kind)
    dstates[place] = dh
    dstates = dstates.reshape(steps, lanes, k)
    # one buffer: gradients at n, z, r, and at what r multiplies; inputs see the first three, the state the last three
    carry, begins = np.zeros((k, lanes), kind), starts.any(axis=1).tolist()
    w_rows, u_rows = np.roll(p["w"].T, k, axis=0), p["u"]
    dw, du, db, fed_back = np.zeros((3 * k, EMBEDDING), kind), np.zeros((3 * k, k), kind), np.zeros(3 * k, kind), np.empty((steps * lanes, EMBEDDING), kind)
    for a, b, fed, before, zr, n, an in reversed(saved):
        z, r, buffer = zr[:, :k], zr[:, k:], np.empty((b - a, 4 * k, lanes), kind)
        to_z = np.subtract(1, z)
        to_n = n * n
        np.subtract(1, to_n, out=to_n)
        to_n *= to_z
        to_z *= z
        to_z *= before - n
        an *= 1 - r
        for t in range(b - a - 1, -1, -1):
            d, (dn, dz, dr, dnr) = carry, buffer[t].reshape(4, k, lanes)
            d += dstates[a + t].T
            np.multiply(d, to_n[t], out=dn)
            np.multiply(d, to_z[t], out=dz)
            np.multiply(dn, r[t], out=dnr)
            np.multiply(dnr, an[t], out=dr)
            d *= z[t]
            carry = u_rows @ buffer[t, k:]
            carry += d
            if begins[a + t]:
                carry *= ~starts[a + t]
        flat, own = (v.swapaxes(0, 1).reshape(v.shape[1], -1) for v in (buffer, before))
        inner = flat[: 3 * k]
        dw += inner @ fed
        db += inner @ np.ones(len(fed), kind)
        du += flat[k:] @ own.T
        np.matmul(inner.T, w_rows, out=fed_back[a * lanes : b * lanes])
    g["w"], g["b"], g["u"] = np.roll(dw, -k, axis=0).T, np.roll(db, -k), du.T
    fed = np.flatnonzero(~starts.reshape(-1))
    tokens = x.reshape(-1)[fed]
    order = np.argsort(tokens.astype(token_type(len(p["emb"]))), kind="stable")  # by digits, if there are two bytes
    tokens = tokens[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    sums = np.add.reduceat(fed_back.take(fed[order], axis=0), first, axis=0) if len(tokens) else np.zeros((0, EMBEDDING), kind)
    g["emb"] = (tokens[first].astype(np.int64), sums)
    return g, after, loss


class Lanes:
    """Documents one after another in lanes, longest lane first, without padding: a long document costs no other lane anything."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, width: int):
        ends = np.cumsum(count)
        width = max(1, min(width, len(count)))
        fill = [(0, k) for k in range(width)]
        place: list[list[int]] = [[] for _ in range(width)]
        for i in np.argsort(-count, kind="stable").tolist():
            n, k = fill[0]
            place[k].append(i)
            heapq.heapreplace(fill, (n + int(count[i]), k))
        size = np.array([n for n, _ in sorted(fill, key=lambda x: x[1])], np.int64)
        by_size = np.argsort(-size, kind="stable")
        order = np.array([i for k in by_size for i in place[k]], np.int64)
        self.size = size[by_size]
        self.base = np.cumsum(self.size) - self.size
        self.ids = ids[ranges((ends - count)[order], count[order])]
        self.begins = np.zeros(len(self.ids), bool)
        self.begins[np.cumsum(count[order]) - count[order]] = True
        self.doc = np.repeat(order, count[order])

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """x, y, starts and real (see gradients()), and each place's token, of window after window.

        Lanes that end drop out, and the fewer are left, the longer the window.
        """
        t = 0
        while t < (self.size[0] if len(self.size) else 0):
            live = int(np.searchsorted(-self.size, -t, side="left"))
            steps = min(max(window, min(LONGEST_WINDOW, window * len(self.size) // live)), int(self.size[0]) - t)
            real = (t + np.arange(steps))[:, None] < self.size[:live]
            at = np.where(real, self.base[:live] + (t + np.arange(steps))[:, None], self.base[:live])
            starts = self.begins[at] | ~real
            yield np.where(starts, 0, self.ids[at - 1]).astype(np.int32), np.where(real, self.ids[at], 0).astype(np.int32), starts, real, at
            t += steps


class Adam:
    """Adam in place, piece by piece; of emb, only the rows that occur move. Output weights, but not biases, are bounded.

    first is ten times the mean of gradients, second a hundred times that of their squares, which saves scaling either.
    """

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.first = {k: np.zeros_like(p[k]) for k in TRAINED}
        self.second = {k: np.zeros_like(p[k]) for k in TRAINED}
        self.most = np.resize(np.append(np.full(HIDDEN, MOST), np.inf), PIECE + HIDDEN + 1).astype(np.float32)
        self.least = -self.most

    def _move(self, p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float, bounded: bool) -> None:
        for a in range(0, p.size, PIECE):
            pp, mm, vv, gg = (x[a : a + PIECE] for x in (p, m, v, g))
            mm *= 0.9
            mm += gg
            gg *= gg
            vv *= 0.99
            vv += gg
            np.sqrt(vv, out=gg)
            gg += 1e-7
            np.divide(mm, gg, out=gg)
            gg *= rate
            pp -= gg
            if bounded:
                at = a % (HIDDEN + 1)
                np.minimum(pp, self.most[at : at + len(pp)], out=pp)
                np.maximum(pp, self.least[at : at + len(pp)], out=pp)

    def move(self, g: dict) -> None:
        self.step += 1
        rate = self.rate * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k in TRAINED:
            p, m, v = self.p[k], self.first[k], self.second[k]
            if k == "emb":
                rows, grad = g[k]
                own = [x[rows] for x in (p, m, v)]
                self._move(*[x.reshape(-1) for x in own], grad.reshape(-1), rate, False)
                p[rows], m[rows], v[rows] = own
            else:
                self._move(p.reshape(-1), m.reshape(-1), v.reshape(-1), np.ascontiguousarray(g[k]).reshape(-1), rate, k in OUTPUT)


def train(p: dict, ids: np.ndarray, count: np.ndarray, rate: float = RATE, width: int = LANES, window: int = WINDOW) -> float:
    """One pass over documents, changing p; returns the mean loss per token."""
    # a shard with little text trains in fewer lanes, so that it still makes steps
    width = max(8, min(width, int(count.sum()) // (window * 40) + 1))
    laid = Lanes(ids, count, width)
    h = np.zeros((HIDDEN, len(laid.size)), np.float32)
    adam, loss = Adam(p, rate), 0.0
    for x, y, starts, real, _ in laid.windows(window):
        g, h, more = gradients(p, x, y, starts, real, h[:, : x.shape[1]])
        loss += more
        adam.move(g)
    return loss / max(int(count.sum()), 1)


def log_likelihoods(p: dict, ids: np.ndarray, count: np.ndarray, width: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Log-likelihood of each document, its state carried from its first token to its last."""
    out = np.zeros(len(count))
    laid = Lanes(ids, count, width)
    h = np.zeros((HIDDEN, len(laid.size)), np.float32)
    for x, y, starts, real, at in laid.windows(window):
        rows, h = forward(p, x, starts, h[:, : x.shape[1]])
        place = np.flatnonzero(real.reshape(-1))
        found = log_probabilities(p, rows.reshape(-1, HIDDEN + 1)[place], y.reshape(-1)[place])
        out += np.bincount(laid.doc[at.reshape(-1)[place]], weights=found, minlength=len(out))
    return out


# --- over tables


def _ids(column: pa.Array, kind: np.dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, count=(o[-1] - o[0]) // kind.itemsize, offset=int(o[0])) if len(column) else np.zeros(0, kind)


def token_counts(table: DataFrame, tokens: int) -> np.ndarray:
    """How often each token occurs in an encoded table."""
    kind = token_type(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tokens, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0), kind), minlength=tokens)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tokens)), pa.array(total)], ["token", "n"])

    out = np.zeros(tokens)
    found = table.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return out


def schedule(words: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> tuple[int, int]:
    """Rounds, and shards of a round, for a corpus of so many words: a larger one trains longer, and in more shards at once.

    A shard holds more tokens where the vocabulary is larger, so that the weights that shards send keep their proportion to the corpus.
    """
    shard_tokens = max(shard_tokens, 100 * vocabulary_size(words))
    shards = max(1, round(words / shard_tokens))
    rounds = max(rounds, round(shards ** (1 / 3)))
    return rounds, max(1, round(words / rounds / shard_tokens))


def by_shard(table: DataFrame, shards: int) -> DataFrame:
    """Rows by the hash of h, a partition for each shard: by a hash of their numbers, some tasks would get several shards one after another."""
    return table.repartitionById(shards, F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))


def fit(table: DataFrame, tokens: int, rounds: int, shards: int, rate: float = RATE) -> dict[str, np.ndarray]:
    """Train on every document of an encoded table once; see schedule()."""
    counts, kind = token_counts(table, tokens), token_type(tokens)
    params = fresh(counts)
    rows = "block int, tokens long, weights array<float>"
    for k in range(rounds):
        start, pace = flatten(params), rate * (1 - 0.5 * k / rounds)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            p, part = unflatten(start, params), pa.Table.from_batches(held)
            order = np.argsort(np.asarray(part.column("h").combine_chunks()), kind="stable")
            part = part.take(pa.array(order))
            count = np.asarray(part.column("n").combine_chunks())
            train(p, _ids(part.column("ids"), kind), count, pace)
            flat = flatten(p)
            blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([int(count.sum())] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))], ["block", "tokens", "weights"])
            give_back()

        def mean(part: pa.Table) -> pa.Table:
            weight = np.asarray(part.column("tokens").combine_chunks(), np.float64)
            lists = part.column("weights").combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            values = np.asarray(lists.flatten(), np.float64).reshape(len(weight), -1)
            merged = (weight @ values / weight.sum()).astype(np.float32)
            return pa.table({"block": part.column("block").slice(0, 1), "tokens": pa.array([int(weight.sum())]), "weights": pa.array([merged], pa.list_(pa.float32()))})

        mine = table.where(F.col("round") == k).select("h", "n", "ids")
        trained = by_shard(mine, shards).mapInArrow(one, rows)
        with tidy(table.sparkSession):
            merged = trained.groupBy("block").applyInArrow(mean, rows).toArrow().sort_by("block")
        if len(merged):
            params = unflatten(np.concatenate([np.asarray(c.flatten(), np.float32) for c in merged.column("weights").chunks]), params)
    return params


def score(table: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and perplexity of the rows of an encoded table."""
    kind = token_type(len(params["emb"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def scored() -> pa.RecordBatch:
            ids = np.concatenate([_ids(batch.column(3), kind) for batch in held])
            doc, count, spelled = (pa.concat_arrays([batch.column(k) for batch in held]) for k in range(3))
            found = log_likelihoods(params, ids, np.asarray(count)) + np.asarray(spelled)
            return pa.RecordBatch.from_arrays([doc, count, pa.array(found), pa.array(np.exp(-found / np.asarray(count)))], ["doc_id", "n_tokens", "log_likelihood", "perplexity"])

        for batch in batches:
            held.append(batch)
            size += batch.column(3).nbytes
            if size > SCORED * kind.itemsize:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()
        give_back()

    return table.select("doc_id", "n", "spelled", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, perplexity double")


def score_documents(docs: DataFrame, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, perplexity: one row per row of docs, by a model of docs themselves.

    n_tokens counts the end mark. Null, empty and blank texts hold the end mark alone; a text of any length is trained on and scored whole.
    A null doc_id stays null; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    words, total = vocabulary(docs)
    rounds, shards = schedule(total, rounds, shard_tokens)
    # rows of a round lie together in each file, so that a round reads little else
    laid = encoded(docs, words, spelling_model(docs, words)).withColumn("round", F.pmod("h", F.lit(rounds)).cast("int"))
    table = materialise(laid.sortWithinPartitions("round"))
    return score(table, fit(table, FIRST_WORD + len(words), rounds, shards))
