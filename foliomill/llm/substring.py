"""Substring deduplication with prefix-partitioned suffix trees over words.

A repeat is a run of at least ``min_words`` words that stands in two places. The suffixes of all texts are
partitioned by a prefix, so that a group's subtree can be built by itself in memory:

1. Every window of min_words words is owned by one of its suffixes, the one whose first ``PREFIX`` words hash
   lowest (its minimiser; a window equal to it is owned at the same place). Only these suffixes, about one in
   seventeen words, are partitioned by their prefix, as rows of a few integers with a hash of the words that
   their windows span (the context). A prefix that occurs once has a leaf for a subtree, and is dropped before any text moves.
2. Suffixes with equal contexts have equal subtrees: the first of them stands for all, and the others
   are repeats throughout. Only prefixes with several contexts get the words of one suffix per context, in the task of the prefix.
   A prefix with more than ``group_rows`` contexts would outgrow a task's memory: the suffixes at each of its windows are partitioned by
   their first min_words words instead, the longest variable-length prefix that is ever needed (lengthening it by steps would move the same
   rows several times, as a group of this size is one passage that many texts hold). A node of that depth is a group by itself, so it is counted, not built.
3. A task builds its subtrees top-down, breadth first: windows that agree so far form a node; each level extends the edge
   by ``EDGE`` words and drops nodes with one leaf. What is left at depth min_words are the deep internal nodes:
   the windows under one node are equal, and maximal repeats are the unions of overlapping such windows.

Words are compared by 64-bit hashes. Of equal windows the first by (doc_id, rid, place) is kept, the others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, groups, materialise, mix, packed_row, powers, ranges, release, sieve, signed, slices, valid_docs

MIN_WORDS = 40
PREFIX = 8
EDGE = 8
GROUP_ROWS = 5_000

_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def owners(w: Words, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each owning suffix: hash of its prefix, its text, and the first and last window start that it owns."""
    window = min_words - prefix + 1
    key = grams(w.hash, prefix)
    count = np.maximum(np.diff(w.first) - min_words + 1, 0)
    starts = ranges(w.first[:-1], count)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    # sliding minimum of (hash, place) by running minima from both ends of blocks of the window's width
    n = len(key)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (key & ~np.uint64(0xFFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF))
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[starts], ahead[starts + window - 1])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    place += (starts - place + 0xFFFFFF) >> 24 << 24
    doc = np.repeat(np.arange(len(count)), count)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(starts)) - 1
    doc = doc[begin]
    base = w.first[doc]
    return key[place[begin]], doc, starts[begin] - base, starts[end] - base


def contexts(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words from first to before last (word indices)."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * powers(len(w.hash), _STEP)[:-1], out=sums[1:])
        return mix((sums[last] - sums[first]) * powers(len(w.hash), _BACK)[first] + (last - first).astype(np.uint64))


def _suffixes(min_words: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(2))
                key, doc, lo, hi = owners(w, min_words, prefix)
                at = pa.array(doc)
                context = contexts(w, w.first[doc] + lo, w.first[doc] + hi + min_words)
                yield pa.RecordBatch.from_arrays(
                    [signed(key), signed(context), part.column(0).take(at), part.column(1).take(at), pa.array(lo.astype(np.int32)), pa.array((hi - lo + 1).astype(np.int16))],
                    ["prefix", "context", "doc_id", "rid", "lo", "windows"],
                )

    return run


def _cut(min_words: int):
    """(doc_id, rid, text, suffixes) to one row per suffix with the words that its windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(2))
                lists = part.column(3)
                where = np.asarray(lists.value_lengths())
                doc = np.repeat(np.arange(len(where)), where)
                flat = lists.flatten()
                prefix, lo, windows, hot = (flat.field(k) for k in range(4))
                first = w.first[doc] + np.asarray(lo)
                last = first + np.asarray(windows).astype(np.int64) + min_words - 2
                a, b = w.start[first], w.end[last]
                # cut the bytes out of the buffer all at once
                size = b - a
                data = w.raw[ranges(a, size)]
                offsets = np.zeros(len(a) + 1, np.int64)
                np.cumsum(size, out=offsets[1:])
                words = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([prefix, part.column(0).take(at), part.column(1).take(at), lo, words, hot], ["prefix", "doc_id", "rid", "lo", "words", "hot"])

    return run


def deep_nodes(w: Words, min_words: int, edge: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """Window starts under deep internal nodes (word indices in w), and the node of each.

    w holds the texts of suffixes; every start with min_words words in its text is a leaf of the tree.
    """
    count = np.maximum(np.diff(w.first) - min_words + 1, 0)
    at = ranges(w.first[:-1], count)
    node = np.zeros(len(at), np.int64)
    labels = {n: grams(w.hash, n) for n in {edge, min_words % edge or edge}}
    for depth in range(0, min_words, edge):
        if not len(at):
            break
        label = labels[min(edge, min_words - depth)][at + depth]
        # children: leaves that share the node and the edge's label
        order = np.lexsort((label, node)) if depth else np.argsort(label, kind="stable")
        n, x = node[order], label[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (n[1:] != n[:-1]) | (x[1:] != x[:-1])
        child = np.cumsum(fresh) - 1
        inner = np.bincount(child)[child] > 1
        at, node = at[order[inner]], child[inner]
    return at, node


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per doc; doc and start must be sorted."""
    if not len(doc):
        return doc, start, end
    reach = end + doc * (1 << 40)  # rising over docs, so one running maximum serves all
    top = np.maximum.accumulate(reach)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = start[1:] + doc[1:] * (1 << 40) > top[:-1]
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], top[stop] - doc[begin] * (1 << 40)


def _trees(min_words: int):
    """Suffix rows sorted by prefix to spans (doc_id, rid, start, end, dropped) of repeated and of dropped windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, rows=GROUP_ROWS, size=2 << 20):
            w = Words(batch.column(4))
            at, node = deep_nodes(w, min_words)
            owner = np.searchsorted(w.first, at, side="right") - 1
            ids, rids = np.asarray(batch.column(1))[owner], np.asarray(batch.column(2))[owner]
            start = np.asarray(batch.column(3)).astype(np.int64)[owner] + at - w.first[owner]
            order = np.lexsort((start, rids, ids, node))
            node, ids, rids, start = node[order], ids[order], rids[order], start[order]
            same_place = np.zeros(len(node), bool)
            same_place[1:] = (node[1:] == node[:-1]) & (ids[1:] == ids[:-1]) & (rids[1:] == rids[:-1]) & (start[1:] == start[:-1])
            node, ids, rids, start = (x[~same_place] for x in (node, ids, rids, start))  # a document given twice is one
            first = np.ones(len(node), bool)
            first[1:] = node[1:] != node[:-1]
            alone = first & np.append(first[1:], True)
            parts = []
            for dropped, keep in ((False, ~alone), (True, ~first)):
                order = np.lexsort((start[keep], rids[keep], ids[keep]))
                i, r, s = ids[keep][order], rids[keep][order], start[keep][order]
                fresh = np.ones(len(i), bool)
                fresh[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1])
                doc = np.cumsum(fresh) - 1
                d, a, b = merge(doc, s, s + min_words)
                own = np.flatnonzero(fresh)[d] if len(d) else d
                parts.append((i[own], r[own], a, b, np.full(len(a), dropped)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)], ["doc_id", "rid", "start", "end", "dropped"])

    return run


def _windows(min_words: int):
    """Suffix rows to one row (window, doc_id, rid, start) per window, keyed by a hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words"):
                w = Words(part.column(4))
                key = grams(w.hash, min_words)
                count = np.maximum(np.diff(w.first) - min_words + 1, 0)
                at = ranges(w.first[:-1], count)
                doc = np.repeat(np.arange(len(count)), count)
                own = pa.array(doc)
                start = np.asarray(part.column(3)).astype(np.int64)[doc] + at - w.first[doc]
                yield pa.RecordBatch.from_arrays([signed(key[at]), part.column(1).take(own), part.column(2).take(own), pa.array(start)], ["window", "doc_id", "rid", "start"])

    return run


_SPANS = "doc_id long, rid int, start long, end long, dropped boolean"
_LIST = "array<struct<start:long,end:long,dropped_words:long>>"


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rid, spans (start, end, dropped)) to (doc_id, rid, repeats, drops): unions in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("dropped_words", pa.int64())]))
    for batch in batches:
        lists = batch.column(2)
        count = np.asarray(lists.value_lengths()).astype(np.int64)
        doc = np.repeat(np.arange(len(count)), count)
        flat = lists.flatten()
        start, end = (np.asarray(flat.field(k)) for k in range(2))
        dropped = np.asarray(flat.field(2).to_numpy(zero_copy_only=False), bool)
        order = np.lexsort((start, doc))
        doc, start, end, dropped = doc[order], start[order], end[order], dropped[order]
        d, a, b = merge(doc[dropped], start[dropped], end[dropped])
        drops = _lists(d, a, b, b - a, len(count), kind)
        d2, a2, b2 = merge(doc, start, end)
        # a dropped span lies within one repeated span: the last that begins before it
        inside = np.searchsorted(d2 * (1 << 40) + a2, d * (1 << 40) + a, side="right") - 1
        words = np.bincount(inside, weights=b - a, minlength=len(d2)).astype(np.int64) if len(d) else np.zeros(len(d2), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(d2, a2, b2, words, len(count), kind), drops], ["doc_id", "rid", "repeats", "drops"])


def _lists(doc: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, end, words)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), items, type=kind)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, rid, repeats, drops of each document that has repeated windows.

    repeats and drops are sorted arrays of disjoint spans (start, end, dropped_words): the union of all repeated windows, and
    of those that are dropped. Words are runs of characters other than ASCII white space, counted from 0; end is exclusive.
    rid is a hash of the text. Rows that agree in doc_id and text are one document; null ids, null texts and texts of fewer
    than min_words words have no spans. Windows may repeat within one document. Other columns are ignored.
    """
    if min_words < prefix:
        raise ValueError("min_words must be at least prefix")
    valid = valid_docs(docs).withColumn("rid", F.hash("text"))
    rows = "prefix long, context long, doc_id long, rid int, lo int, windows short"
    suffixes = materialise(valid.select("doc_id", "rid", "text").mapInArrow(_suffixes(min_words, prefix), rows))
    repeated = suffixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix")
    again = suffixes.join(repeated, "prefix", "left_semi")
    twice = valid.select("doc_id", "rid").groupBy("doc_id", "rid").count().where("count > 1")
    doubled = not twice.isEmpty()
    again = materialise(again.distinct() if doubled else again)
    release(suffixes)
    place = F.struct("doc_id", "rid", "lo")
    by_context = materialise(again.groupBy("prefix", "context").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max("windows").alias("windows")))
    # prefixes with several contexts: one suffix of each context goes to the tree
    several = by_context.groupBy("prefix").agg(F.count("*").alias("contexts")).where("contexts > 1").select("prefix", (F.col("contexts") > group_rows).alias("hot"))
    leaves = by_context.join(several, "prefix").select("prefix", "hot", "first.*", "windows")
    leaves = materialise(leaves.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("prefix", "lo", "windows", "hot")).alias("suffixes")))
    hot = not leaves.where(F.exists("suffixes", lambda x: x["hot"])).isEmpty()
    wanted = sieve(leaves.select(F.xxhash64("doc_id", "rid").alias("key")))
    texts = valid.select("doc_id", "rid", "text").where(wanted(F.xxhash64("doc_id", "rid")))
    cuts = texts.join(leaves.hint("shuffle_hash"), ["doc_id", "rid"])
    cuts = cuts.dropDuplicates(["doc_id", "rid"]) if doubled else cuts
    cuts = materialise(cuts.select("doc_id", "rid", "text", "suffixes").mapInArrow(_cut(min_words), "prefix long, doc_id long, rid int, lo int, words string, hot boolean"))
    release(leaves)
    found = cuts.where("NOT hot").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(min_words), _SPANS)
    if hot:
        windows = materialise(cuts.where("hot").mapInArrow(_windows(min_words), "window long, doc_id long, rid int, start long"))
        at = F.struct("doc_id", "rid", "start")
        firsts = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(at).alias("f")).where("n > 1")
        places = windows.join(firsts, "window")
        found = found.union(places.select("doc_id", "rid", "start", (F.col("start") + min_words).alias("end"), (at != F.col("f")).alias("dropped")))
    found = materialise(found)
    release(cuts)
    if hot:
        release(windows)
    # copies of a context: repeats throughout, and dropped but for the first
    stop = F.col("lo") + F.col("w") + (min_words - 1)
    copied = by_context.where("n > 1").select("prefix", "context", "first", F.col("windows").cast("long").alias("w"))
    copies = again.join(copied, ["prefix", "context"])
    found = copies.select("doc_id", "rid", F.col("lo").cast("long").alias("start"), stop.alias("end"), (place != F.col("first")).alias("dropped")).union(found)
    lists = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "end", "dropped")).alias("spans"))
    return lists.mapInArrow(_merge_lists, f"doc_id long, rid int, repeats {_LIST}, drops {_LIST}")


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start_word, end_word, dropped_words: one row per maximal repeated span of a document.

    dropped_words counts the words of the span that lie in windows of which an earlier copy is kept. See repeated_spans().
    """
    spans = repeated_spans(docs, **options).select("doc_id", F.explode("repeats").alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.dropped_words").alias("dropped_words"))


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans (start, end; sorted, disjoint) and the white space after each; no change where spans are null."""
    w = Words(texts)
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    count = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    flat = spans.flatten()
    first, last = w.first[doc] + np.asarray(flat.field(0), np.int64), w.first[doc] + np.asarray(flat.field(1), np.int64)
    stop = np.append(w.start, 0)[last]
    stop = np.where(last < w.first[doc + 1], stop, w.offsets[doc + 1])
    change = np.zeros(len(w.raw) + 1, np.int32)
    np.add.at(change, w.start[first], 1)
    np.add.at(change, stop, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = w.raw[keep]
    out = pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(kept[w.offsets].astype(np.int64)), pa.py_buffer(data)])
    return out.cast(pa.string())


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without the dropped passages; n_chars, if there, is counted anew for texts that change.

    A row whose text loses all its words goes. Rows with a null id or text stay as they are, and so do empty texts and those of fewer
    than min_words words. Repeated rows (same id and text) all change alike. Columns of any other name are kept; an empty table
    gives an empty result. See repeated_spans().
    """
    spans = repeated_spans(docs, **options).where(F.size("drops") > 0)
    spans = materialise(spans.select(F.xxhash64("doc_id", "rid").alias("key"), "doc_id", "rid", F.col("drops").alias("spans")))
    rows = packed_row(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("rid", F.hash("row.text"))
    touched = sieve(spans.select("key"))(F.xxhash64("doc_id", "rid"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, where: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, where], ["text", "spans"])
        return pa.concat_arrays([without_spans(part.column(0), part.column(1)) for part in slices(batch)] or [pa.array([], pa.string())])

    joined = rows.where(touched).join(spans.select("doc_id", "rid", "spans"), ["doc_id", "rid"], "left")
    changed = F.col("spans").isNotNull()
    joined = joined.withColumn("new", cut(F.when(changed, F.col("row.text").cast("string")), "spans")).where(~changed | F.col("new").rlike("[^ \\t\\n\\r\\f\\x0B]"))
    anew = {"text": F.col("new"), "n_chars": F.length("new")}
    columns = [F.when(changed, anew[c].cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c in anew else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.where(~touched).select("row.*").union(joined.select(*columns))


def repeated_passages_sql(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for repeated_passages() over a table documents with distinct ids."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(0, len(ws) - {min_words - 1})) AS pos, unnest(list_transform(range(1, len(ws) - {min_words - 2}), lambda i: md5(array_to_string(ws[i:i + {min_words - 1}], ' ')))) AS win
      FROM w WHERE len(ws) >= {min_words}),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM x),
a AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM
      (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {min_words} THEN 0 ELSE 1 END AS fresh FROM r WHERE n > 1)),
s AS (SELECT doc_id, isle, min(pos) AS start_word, max(pos) + {min_words} AS end_word FROM a GROUP BY doc_id, isle),
c AS (SELECT doc_id, pos, least({min_words}, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, {min_words})) AS words FROM r WHERE k > 1)
SELECT s.doc_id, s.start_word::BIGINT AS start_word, s.end_word::BIGINT AS end_word, coalesce(sum(c.words), 0)::BIGINT AS dropped_words
FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.pos >= s.start_word AND c.pos < s.end_word GROUP BY ALL
"""
