"""Near-duplicate documents by chosen-path set similarity join over MinHash signatures.

Every distinct text has a signature of ``SIZE`` minwise tokens of its word shingles. A tree starts with all
texts in its root; a node picks ``ceil(1 / threshold)`` coordinates of the signature at random (fixed by the
node's name) and sends each text to the children named by its minwise tokens there. Nodes with a single text
end (from the second level on); nodes of at most ``leaf`` texts are compared exhaustively; larger nodes branch again. A node that is as
large after ``depth`` levels holds texts that are alike nearly everywhere and is compared exhaustively too. A pair at the
threshold survives a level with probability 1 - (1 - threshold) ** branches; ``trees`` independent trees bring the
recall to its target. Comparisons in nodes use sketches of the signatures with a margin below the threshold;
clusters that they connect are then verified on exact Jaccard similarities of the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sets, Words, connected_components, grams, group_cuts, groups, materialise, packed_row, ranges, release, sieve, signed, slices, valid_docs

THRESHOLD = 0.5
SHINGLE = 3
SIZE = 128
TREES = 8
LEAF = 1024
DEPTH = 5
MARGIN = 0.12


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of the texts in lower case, and how many each text has.

    A text of fewer than n words has one shingle, of all its words; a text without words has none.
    """
    w = Words(pc.utf8_lower(texts))
    words = np.diff(w.first)
    count = np.maximum(words - n + 1, np.minimum(words, 1))
    all_grams = grams(w.hash, n)
    at = ranges(w.first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    inside = at < len(all_grams)
    out[inside] = all_grams[at[inside]]
    for d in np.flatnonzero((words > 0) & (words < n)):
        out[count[:d].sum()] = grams(w.hash[w.first[d] : w.first[d + 1]], int(words[d]))[0]
    return out, count


def signatures(hashes: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Signature rows (uint32) of the texts that have shingles, in their order."""
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, size, dtype=np.uint64)
    full = count > 0
    starts = (np.cumsum(count) - count)[full]
    out = np.empty((size, len(starts)), np.uint64)
    if len(starts):
        # the least number has the least upper half, so the lower halves needn't be cut off before; one buffer serves all coordinates
        room = np.empty_like(hashes)
        with np.errstate(over="ignore"):
            for k in range(size):
                np.multiply(hashes, mul[k], out=room)
                room += add[k]
                np.minimum.reduceat(room, starts, out=out[k])
    return np.ascontiguousarray((out >> np.uint64(32)).astype(np.uint32).T)


def sketches(rows: np.ndarray) -> np.ndarray:
    """The two lowest bits of every coordinate, packed in 64-bit words."""
    bits = np.stack([rows & 1, (rows >> 1) & 1], axis=2).astype(np.uint8).reshape(len(rows), 2 * rows.shape[1])
    return np.packbits(bits, axis=1).view(np.uint64)


def _words(size: int) -> list[str]:
    return [f"s{k}" for k in range(size // 32)]


def _sign(n: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, count = shingles(part.column(1), n)
                rows = signatures(hashes, count, size)
                rid = pc.filter(part.column(0), pa.array(count > 0))
                values = pa.array(rows.view(np.int32).reshape(-1))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
                packed = sketches(rows)
                yield pa.RecordBatch.from_arrays([rid, pa.ListArray.from_arrays(offsets, values), *[signed(packed[:, k]) for k in range(size // 32)]], ["rid", "sig", *_words(size)])

    return run


_EVEN = np.uint64(0x5555555555555555)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates two words of sketches differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _EVEN)


FEW = 64  # rows up to which every pair of sketches is looked at


def alike(packed: np.ndarray, most: float) -> np.ndarray:
    """Root of each row's set, where rows that differ in at most that many coordinates are joined.

    A row that was reached is not compared again, so a set of rows that are all alike costs little more than its size.
    """
    same, inverse = np.unique(packed, axis=0, return_inverse=True)
    n = len(same)
    if n <= FEW:
        sets, apart = Sets(n), np.zeros((n, n), np.uint16)
        for k in range(same.shape[1]):
            apart += differing(same[:, None, k], same[None, :, k])
        for i, j in zip(*np.nonzero(apart <= most)):
            if j > i:
                sets.join(int(i), int(j))
        return sets.roots()[inverse.reshape(-1)]
    roots, left, words = np.arange(n), np.arange(n), np.ascontiguousarray(same.T)
    reached: list[int] = []
    while len(left):
        if not reached:
            reached, root = [int(left[0])], int(left[0])
            left, words = left[1:], words[:, 1:]
        v = same[reached.pop()]
        apart = np.zeros(len(left), np.uint16)
        for k in range(len(v)):
            apart += differing(v[k], words[k])
        near = apart <= most
        if near.any():
            roots[left[near]] = root
            reached += left[near].tolist()
            left, words = left[~near], words[:, ~near]
    return roots[inverse.reshape(-1)]


def _nodes(size: int, least: float, leaf: float):
    """(node, rid, words of the sketch) sorted by node to edges (a, b) between alike texts, and (rid, null, node) of larger nodes."""
    most = size * (1 - least) * 0.75  # two bits agree by chance in a quarter of the coordinates that differ
    pairs_of = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, rows=1 << 15, size=2 << 20):
            node, rid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            packed = np.stack([np.asarray(batch.column(2 + k)).view(np.uint64) for k in range(size // 32)], axis=1)
            left, right, onward = [], [], []
            for d in range(1, min(pairs_of, len(node))):
                at = np.flatnonzero(node[d:] == node[:-d])
                if not len(at):
                    break
                apart = np.zeros(len(at), np.uint16)
                for k in range(packed.shape[1]):
                    apart += differing(packed[at, k], packed[at + d, k])
                near = at[(apart <= most) & (rid[at] != rid[at + d])]
                left.append(rid[near])
                right.append(rid[near + d])
            # nodes beyond what the shifts above reach
            far = np.flatnonzero(node[pairs_of:] == node[:-pairs_of]) if len(node) > pairs_of else np.zeros(0, np.int64)
            for name in np.unique(node[far]):
                a, b = np.searchsorted(node, name, "left"), np.searchsorted(node, name, "right")
                if b - a > leaf:
                    onward.append((a, b))
                    continue
                roots = alike(packed[a:b], most)
                own = rid[a:b]
                _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
                left.append(own[first[inverse]])
                right.append(own)
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
            low, high = np.minimum(a, b), np.maximum(a, b)
            edges = np.unique(np.stack([low, high], axis=1)[low != high], axis=0)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(x, y) for x, y in onward]])
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64())], ["a", "b", "node"])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), none, pa.array(node[at])], ["a", "b", "node"])

    return run


def jaccard_sets(hashes: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """Root of each text's set, where texts with an exact Jaccard similarity of at least the threshold are joined."""
    m = len(count)
    doc = np.repeat(np.arange(m), count)
    _, code = np.unique(hashes, return_inverse=True)
    pairs = np.unique(doc * (int(code.max(initial=0)) + 1) + code)
    doc, code = np.divmod(pairs, int(code.max(initial=0)) + 1)
    size = np.bincount(doc, minlength=m)
    used = np.bincount(code) >= 2
    keep = used[code]
    doc, code = doc[keep], (np.cumsum(used) - 1)[code[keep]]
    # shingles by rarity: the rarest that two near texts share is among the rarest of either, as many as it may lack and one more
    # (prefix filter), and leaves room for as many in common as they need after it (position filter)
    often = np.bincount(code, minlength=int(used.sum()))
    rank = np.empty_like(often)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]
    order = np.lexsort((code, doc))
    row, own = code[order], np.bincount(doc, minlength=m)
    row_at = np.cumsum(own) - own
    prefix = np.minimum(own, np.maximum(0, size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1 - (size - own)))
    of = np.repeat(np.arange(m), prefix)
    rare_at = ranges(row_at, prefix)
    rare_code, room = row[rare_at], own[of] - (rare_at - row_at[of])

    def by_shingle(live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts not reached yet that have each shingle among their rarest, and how many of their shingles it leaves; where those of a shingle begin and how many they are."""
        kept = np.flatnonzero(live[of])
        n = np.bincount(rare_code[kept], minlength=len(often))
        kept = kept[np.argsort(rare_code[kept], kind="stable")]
        return of[kept], room[kept], np.cumsum(n) - n, n

    # each text is asked once for those near it that no other has reached; sets are found from their least text on
    roots, live, mark = np.arange(m), np.ones(m, bool), np.zeros(len(often), bool)
    (posted, left, at, n), listed, open_ = by_shingle(live), m, m
    for seed in range(m):
        if not live[seed]:
            continue
        live[seed], reached, open_ = False, [seed], open_ - 1
        while reached:
            v = reached.pop()
            mine = row[row_at[v] : row_at[v] + own[v]]
            rare = mine[: prefix[v]]
            if not len(rare):
                continue
            place = ranges(at[rare], n[rare])
            found = posted[place]
            shared = np.minimum(left[place], np.repeat(own[v] - np.arange(len(rare)), n[rare]))
            found = np.unique(found[live[found] & (shared * (1 + threshold) >= threshold * (size[v] + size[found]) - 1e-6)])
            found = found[(size[found] >= threshold * size[v] - 1e-6) & (size[v] >= threshold * size[found] - 1e-6)]
            if not len(found):
                continue
            mark[mine] = True
            ends = np.cumsum(own[found])
            both = np.add.reduceat(mark[row[ranges(row_at[found], own[found])]].astype(np.int64), ends - own[found])
            mark[mine] = False
            near = found[both >= threshold * (size[v] + size[found] - both) - 1e-6]
            live[near], roots[near], open_ = False, seed, open_ - len(near)
            reached += near.tolist()
            if 2 * open_ < listed:
                (posted, left, at, n), listed = by_shingle(live), open_
    return roots


def _verify(n: int, threshold: float):
    """(component, rid, text) sorted by component to (rid, set): set is the least rid of those that belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, size=2 << 20):
            rid = np.asarray(batch.column(1))
            cut = [shingles(part.column(0), n) for part in slices(pa.RecordBatch.from_arrays([batch.column(2)], ["text"]))]
            hashes, count = np.concatenate([x for x, _ in cut]), np.concatenate([x for _, x in cut])
            ends = np.cumsum(count)
            out = rid.copy()
            for a, b in group_cuts(np.asarray(batch.column(0))):
                order = np.argsort(rid[a:b], kind="stable")
                span = ranges((ends - count)[a:b][order], count[a:b][order])
                roots = jaccard_sets(hashes[span], count[a:b][order], threshold)
                own = rid[a:b][order]
                out[a + order] = own[roots]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(out)], ["rid", "set"])

    return run


def candidate_edges(sigs: DataFrame, threshold: float, size: int, trees: int, leaf: int, depth: int, margin: float) -> DataFrame:
    """Edges (a, b) between texts of sigs (rid, sig, words of the sketch) that some leaf of some tree found alike.

    A text goes to a node with its sketch (two bits a coordinate), so a node is compared where it is gathered, and only
    what lies in nodes of more than ``leaf`` texts moves again. The first two levels are taken in one step.
    """
    branches = math.ceil(1 / threshold)
    rng = np.random.Generator(np.random.PCG64(11))
    roots = [(t, int(i)) for t in range(trees) for i in rng.choice(size, branches, replace=False)]
    child = lambda *of: F.xxhash64(*of)
    pick = lambda node, k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(size)).cast("int")
    below = lambda node: [child(node, pick(node, k), F.col("sig")[pick(node, k)]) for k in range(branches)]
    words = _words(size)
    tops = sigs.select("rid", "sig", *words, F.array(*[child(F.lit(t), F.lit(i), F.col("sig")[i]) for t, i in roots]).alias("tops"))
    paths = F.flatten(F.transform("tops", lambda node: F.array(*below(node))))
    members = tops.select("rid", *words, F.explode(F.array_distinct(paths)).alias("node"))
    found = []
    for level in range(2, depth + 1):
        gathered = members.select("node", "rid", *words).repartition("node").sortWithinPartitions("node")
        compared = materialise(gathered.mapInArrow(_nodes(size, threshold - margin, leaf if level < depth else math.inf), "a long, b long, node long"))
        found.append(compared.where("node IS NULL").select("a", "b"))
        large = compared.where("node IS NOT NULL").select(F.col("a").alias("rid"), F.col("node").alias("parent"))
        if level == depth or large.isEmpty():
            break
        # texts that meet in many nodes go on under each of them, once
        grown = large.join(sigs, "rid").select("rid", *words, F.explode(F.array_distinct(F.array(*below(F.col("parent"))))).alias("node"))
        members = grown
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, size: int = SIZE, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, margin: float = MARGIN
) -> DataFrame:
    """doc_id, rid, group_id, keep of every document that has a duplicate or near duplicate.

    Documents belong together if a chain of pairs with Jaccard similarity of at least threshold connects them;
    group_id is the least doc_id of the group, and the document that stays. rid is the hash of the text. Rows
    that agree in doc_id and text are one document. Null ids, null texts and texts without words are in no group.
    Other columns are ignored; an empty table gives an empty result.
    """
    valid = valid_docs(docs)
    sigs = materialise(valid.select("rid", "text").mapInArrow(_sign(shingle, size), "rid long, sig array<int>, " + ", ".join(f"{w} long" for w in _words(size))).dropDuplicates(["rid"]))
    parts = connected_components(candidate_edges(sigs, threshold, size, trees, leaf, depth, margin))
    parts = materialise(parts.select(F.col("node").alias("rid"), "component"))
    release(sigs)
    wanted = sieve(parts.select(F.col("rid").alias("key")))
    texts = valid.select("rid", "text").where(wanted(F.col("rid"))).join(parts.hint("shuffle_hash"), "rid").dropDuplicates(["rid"])
    whole = texts.select("component", "rid", "text").repartition("component").sortWithinPartitions("component")
    sets = materialise(whole.mapInArrow(_verify(shingle, threshold), "rid long, set long"))
    owned = docs.where("doc_id IS NOT NULL AND text RLIKE '[^ \\\\t\\\\n\\\\r\\\\f\\\\x0B]'")
    owned = owned.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid")).distinct()
    named = materialise(owned.join(sets, "rid", "left").select("doc_id", "rid", F.coalesce("set", "rid").alias("set")))
    firsts = named.groupBy("set").agg(F.min("doc_id").alias("group_id"), F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    return named.join(firsts, "set").select("doc_id", "rid", "group_id", kept.alias("keep"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but for all documents of a group other than the one that stays.

    Of rows that agree in doc_id and text one stays. Rows with a null id or text stay, and so do texts without words.
    Columns of any other name are kept; an empty table gives an empty result.
    """
    found = near_duplicates(docs, **options)
    gone = materialise(found.where("NOT keep").select(F.xxhash64("doc_id", "rid").alias("key"), "doc_id", "rid"))
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"))
    repeated = materialise(ids.groupBy("doc_id", "rid").count().where("count > 1").select(F.xxhash64("doc_id", "rid").alias("key"), "doc_id", "rid"))
    rows = packed_row(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("rid", F.when(F.col("row.text").isNotNull(), F.xxhash64("row.text")))
    # most rows are neither gone nor repeated, and pass without a shuffle
    key = F.xxhash64("doc_id", "rid")
    touched = F.coalesce(sieve(gone.select("key").union(repeated.select("key")))(key), F.lit(False)) & F.col("doc_id").isNotNull() & F.col("rid").isNotNull()
    left = rows.where(touched).join(gone.select("doc_id", "rid"), ["doc_id", "rid"], "left_anti")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["doc_id", "rid"])
    return rows.where(~touched).select("row.*").union(left.select("row.*"))


def near_duplicates_sql(threshold: float = THRESHOLD, shingle: int = SHINGLE) -> str:
    """DuckDB SQL for doc_id, group_id, keep over a table documents with distinct ids: every pair is compared."""
    words = " || ' ' || ".join(f"ws[i + {j}]" for j in range(shingle))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {shingle} THEN list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {words}) ELSE [array_to_string(ws, ' ')] END) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {threshold} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT DISTINCT a, a FROM ways UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.other),
g AS (SELECT doc_id, min(other) AS group_id FROM r GROUP BY doc_id)
SELECT doc_id, group_id, doc_id = group_id AS keep FROM g
"""
