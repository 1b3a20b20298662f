"""Nearest neighbours by block matrix join.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own. The table is cut into row blocks and column
stripes by hash; a task holds one row block and one stripe, and multiplies int8 tiles of them. With
residuals e_a, e_b (what quantisation took away), a product is off by at most e_a + (1 + e_a) e_b, so
a pair whose bound cannot reach the row's k-th best so far is dropped; the others are recomputed in float64 and
pushed on the row's heap. The heaps of a row over all stripes are merged at the end. No pair is lost to the bounds: the
result is exact.

The products of int8 codes are taken by a float32 matrix product, which is exact for them up to a dimension of
1040 (127 * 127 * 1040 < 2 ** 24); wider vectors use float64.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

K = 10
BLOCK_ROWS = 4096
STRIPE_BYTES = 64 << 20  # of a stripe's vectors in float64; a task holds about five times as much
DECIMALS = 6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the lengths of what the codes leave out."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def nearest(rows: np.ndarray, row_ids: np.ndarray, columns: np.ndarray, column_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row id, neighbour id, cosine distance) of the k nearest columns of each row; equal ids are no pair.

    Distances are rounded to 6 decimals; ties go to the lower neighbour id.
    """
    exact = np.float32 if rows.shape[1] <= 1040 else np.float64
    rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    columns = columns / np.linalg.norm(columns, axis=1)[:, None]
    row_codes, row_scale, row_rest = quantise(rows)
    column_codes, column_scale, column_rest = quantise(columns)
    column_codes, column_scale = column_codes.astype(exact), column_scale.astype(exact)
    slack = 2 * 10.0**-DECIMALS
    out_row, out_column, out_distance = [], [], []
    for a in range(0, len(rows), 512):
        mine, ids = rows[a : a + 512], row_ids[a : a + 512]
        codes = row_codes[a : a + 512].astype(exact)
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(mine))]
        worst = np.full(len(mine), np.inf)  # distance of the k-th best so far
        for b in range(0, len(columns), 4096):
            product = codes @ column_codes[b : b + 4096].T  # int8 tile
            product *= column_scale[b : b + 4096]
            most = column_rest[b : b + 4096].max()
            if not np.isfinite(worst).all() and product.shape[1] > k + 1:
                # a first bound: the k + 1 largest products of the tile, exactly (one may be the row itself)
                top = np.argpartition(product, -(k + 1), axis=1)[:, -(k + 1) :]
                sims = np.einsum("rkd,rd->rk", columns[b + top], mine)
                sims[column_ids[b + top] == ids[:, None]] = -np.inf
                worst = np.minimum(worst, 1 - np.sort(sims, axis=1)[:, 1])
            rest, scale = row_rest[a : a + 512], row_scale[a : a + 512]
            least = ((1 - worst - slack - rest - (1 + rest) * most) / scale).astype(exact)
            r, c = np.nonzero(product >= least[:, None] * (1 - np.sign(least[:, None]) * exact(1e-6)))
            c += b
            differ = column_ids[c] != ids[r]
            r, c = r[differ], c[differ]
            for at in range(0, len(r), 1 << 16):
                rr, cc = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                distance = np.round(1 - np.einsum("ij,ij->i", mine[rr], columns[cc]), DECIMALS) + 0.0
                for x, d, i in zip(rr.tolist(), distance.tolist(), column_ids[cc].tolist()):
                    heap = heaps[x]
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -i))
                    elif (-d, -i) > heap[0]:
                        heapq.heapreplace(heap, (-d, -i))
            for x, heap in enumerate(heaps):
                if len(heap) == k:
                    worst[x] = min(worst[x], -heap[0][0])
        for x, heap in enumerate(heaps):
            for d, i in heap:
                out_row.append(int(ids[x]))
                out_column.append(-i)
                out_distance.append(-d + 0.0)
    return np.array(out_row, np.int64), np.array(out_column, np.int64), np.array(out_distance, np.float64)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def knn_join(
    vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, stripe_rows: int | None = None
) -> DataFrame:
    """id, rank, neighbor_id, distance: the k nearest others of every vector by cosine distance, rank from 1.

    distance is rounded to 6 decimals; ties rank by lower neighbor_id. Rows with a null id, and vectors that are null, empty, zero,
    or hold a null, NaN or infinity, or of another length than most (of lengths as frequent, the longest), take no
    part. Of rows with one id the least vector counts. Vectors with fewer than k others get all of them. Other
    columns are ignored; an empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sane).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    clean = materialise(clean.groupBy("id").agg(F.min("v").alias("v")))
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim, n = (lengths[0]["d"], lengths[0]["count"]) if lengths else (1, 0)
    clean = clean.where(F.size("v") == dim)
    stripe_rows = stripe_rows or max(block_rows, STRIPE_BYTES // (8 * dim))
    blocks, stripes = max(1, -(-n // block_rows)), max(1, -(-n // stripe_rows))
    row_block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    stripe = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(stripes)).cast("int")
    as_row = clean.select("id", "v", F.lit(True).alias("is_row"), row_block.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("j"))
    as_column = clean.select("id", "v", F.lit(False).alias("is_row"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), stripe.alias("j"))

    def tile(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id").combine_chunks())
        is_row = np.asarray(table.column("is_row").combine_chunks().to_numpy(zero_copy_only=False), bool)
        x = _matrix(table.column("v"))
        found = nearest(x[is_row], ids[is_row], x[~is_row], ids[~is_row], k)
        return pa.table(dict(zip(("id", "neighbor_id", "distance"), map(pa.array, found))))

    tiles = as_row.union(as_column).groupBy("i", "j").applyInArrow(tile, "id long, neighbor_id long, distance double")
    best = tiles.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k).alias("best"))
    ranked = best.select("id", F.posexplode("best").alias("at", "b"))
    return ranked.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("rank"), "b.neighbor_id", "b.distance")


def knn_sql(k: int = K) -> str:
    """DuckDB SQL for knn_join() over a table embeddings with distinct ids and vectors of one length."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(1 - list_cosine_similarity(a.e, b.e), {DECIMALS}) + 0.0::DOUBLE AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, distance FROM r WHERE rank <= {k}
"""
