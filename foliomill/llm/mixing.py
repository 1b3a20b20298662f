"""Mixing sources to target weights along a time-varying curriculum.

Training time t runs from 0 to 1. Source s has a piecewise linear weight w_s(t); the weights of all sources
add up to 1 at every knot. With T training tokens in all, s is to have supplied D_s(t) = T * integral of
w_s from 0 to t. A document whose source has supplied c tokens before it (in an order fixed by a hash of
its id) is trained at the t with D_s(t) = c: on each linear piece that is the root of a quadratic, so the
inverse is a closed-form column expression. T is the least total at which no source has a token left over, so
every document is used; a source that supplies less than its share is run through again, as often as its demand asks.
Sorting by t gives the training order.

The cumulative sums never pass through one task per source: documents fall into 4096 buckets per source by
hash; bucket totals are summed over a small table, and only the order inside a bucket needs a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, numbered

#: (time, exponent): at that time a source's weight is its token share to this power, normalised.
SCHEDULE: tuple[tuple[float, float], ...] = ((0.0, 1.0), (0.5, 0.9), (1.0, 0.7))


def tokens(text: str = "text"):
    """Tokens of a text: its space characters and line ends, plus one; 0 for null and blank texts (nothing but ASCII white space)."""
    t = F.col(text)
    n = F.octet_length(t) - F.octet_length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return F.when(t.rlike("[^ \\t\\n\\r\\f\\x0B]"), n).otherwise(F.lit(0)).cast("long")


def weight_schedule(supply: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """Pieces of each source's weight: source, supply, t0, t1, w0, w1, from supply (source, supply)."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(schedule, schedule[1:])):
        raise ValueError("the schedule's times must rise from 0 to 1")
    total = F.sum("supply").over(Window.partitionBy())
    shares = supply.where("supply > 0").withColumn("share", F.col("supply") / total)
    powers = [F.pow("share", F.lit(float(a))) for _, a in schedule]
    weighted = shares.select("source", "supply", *[(p / F.sum(p).over(Window.partitionBy())).alias(f"k{i}") for i, p in enumerate(powers)])
    pieces = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(a[0])).alias("t0"), F.lit(float(b[0])).alias("t1"), F.col(f"k{i}").alias("w0"), F.col(f"k{i + 1}").alias("w1"))
                for i, (a, b) in enumerate(zip(schedule, schedule[1:]))
            ]
        )
    )
    return weighted.select("source", "supply", pieces.alias("p")).select("source", "supply", "p.*")


def demand(supply: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """Pieces with cumulative demand: source, supply, need, t0, t1, w0, w1, d0, d1, total (all tokens of training)."""
    pieces = weight_schedule(supply, schedule)
    area = (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2
    by_source = Window.partitionBy("source")
    pieces = pieces.select("*", area.alias("area"), F.sum(area).over(by_source).alias("mean_weight"))
    pieces = pieces.withColumn("total", F.max(F.col("supply") / F.col("mean_weight")).over(Window.partitionBy()))
    upto = F.sum("area").over(by_source.orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.select(
        "source", "supply", "t0", "t1", "w0", "w1", "total",
        ((upto - F.col("area")) * F.col("total")).alias("d0"), (upto * F.col("total")).alias("d1"), (F.col("mean_weight") * F.col("total")).alias("need"),
    )


def _positions(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows (source, n_tokens, before, ...) with epoch and position; each row once per epoch that it is used in."""
    need = pieces.select("source", "supply", "need").distinct()
    used = rows.join(need, "source", "left")
    times = F.greatest(F.lit(1), F.coalesce(F.ceil((F.col("need") - F.col("before")) / F.col("supply") - 1e-9), F.lit(1)))
    used = numbered(used, times, "_use").withColumn("epoch", (F.col("_use") + 1).cast("int"))
    used = used.withColumn("c", F.col("before") + (F.col("epoch") - 1) * F.col("supply"))
    segments = pieces.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("t0", "t1", "w0", "w1", "d0", "d1", "total"))).alias("segments")
    )
    used = used.join(segments, "source", "left")
    # the last piece that begins at or before c (the first begins at 0)
    piece = F.element_at(F.filter("segments", lambda s: s["d0"] <= F.col("c")), -1)
    used = used.withColumn("s", piece)
    slope = (F.col("s.w1") - F.col("s.w0")) / (F.col("s.t1") - F.col("s.t0"))
    left = (F.col("c") - F.col("s.d0")) / F.col("s.total")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("s.w0") * F.col("s.w0") + 2 * slope * left))
    # the stable form of the root: no difference of near-equal numbers when the slope is small
    position = F.least(F.col("s.t1"), F.col("s.t0") + 2 * left / (F.col("s.w0") + root))
    return used.withColumn("position", F.coalesce(F.round(position, 9), F.lit(0.0)))


def curriculum(
    docs: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE, carry: tuple[str, ...] = (), order: bool = True
) -> DataFrame:
    """doc_id, source, n_tokens, epoch, position (and carry) of each use of a document, range-sorted by position.

    Every row of docs is used at least once, and as often as its source's demand asks, without a limit. A null source is a source of its own. Documents without tokens
    (null, empty or blank text) take part with 0 tokens, and a source without any token has position 0. Null doc_ids
    count as the lowest id. Rows that agree in id, tokens and text follow each other. Ties in position sort by
    doc_id, then epoch.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"),
        tokens().alias("n_tokens"), key.alias("_key"), F.md5(text).alias("_text_key"), *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry],
    )
    rows = rows.withColumn("_bucket", F.substring("_key", 1, 3))
    buckets = materialise(rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("tokens")))
    supply = buckets.groupBy("source").agg(F.sum("tokens").alias("supply"))
    pieces = materialise(demand(supply, schedule))
    earlier = F.sum("tokens").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select("source", "_bucket", F.coalesce(earlier, F.lit(0)).alias("bucket_start"))
    within = F.sum("n_tokens").over(
        Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "n_tokens", "_text_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, ["source", "_bucket"])
    rows = rows.withColumn("before", F.col("bucket_start") + F.col("_within"))
    placed = _positions(rows, pieces)
    placed = placed.select(
        "doc_id", F.when(F.col("source") != "\0", F.col("source")).alias("source"), "n_tokens", "epoch", "position", *[F.col(f"`_carry_{c}`") for c in carry]
    )
    return placed.orderBy("position", F.col("doc_id").asc_nulls_first(), "epoch") if order else placed


def mixed_documents(docs: DataFrame, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """The rows of docs, repeated as the schedule asks and in training order, with the columns of docs.

    Rows with a null or blank text or a null source are kept, repeated rows too, as curriculum() says; columns of any other name are
    carried along; an empty table gives an empty result.
    """
    placed = curriculum(docs, schedule, carry=tuple(docs.columns))
    return placed.select(*[F.col(f"`_carry_{c}`").alias(c) for c in docs.columns])


def curriculum_sql(schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> str:
    """DuckDB SQL for curriculum() over a table documents."""
    knots = ", ".join(f"pow(share, {float(a)!r}) / sum(pow(share, {float(a)!r})) OVER () AS k{i}" for i, (_, a) in enumerate(schedule))
    pieces = " UNION ALL ".join(
        f"SELECT source, supply, {float(a[0])!r}::DOUBLE AS t0, {float(b[0])!r}::DOUBLE AS t1, k{i} AS w0, k{i + 1} AS w1 FROM k" for i, (a, b) in enumerate(zip(schedule, schedule[1:]))
    )
    return f"""
WITH r AS (SELECT doc_id, coalesce(source, chr(1)) AS source, CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN length(text) - length(translate(text, ' ' || chr(10), '')) + 1 ELSE 0 END AS n_tokens,
           md5(coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS text_key FROM documents),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, n_tokens, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM r),
sup AS (SELECT source, sum(n_tokens)::DOUBLE AS supply FROM r GROUP BY source HAVING sum(n_tokens) > 0),
sh AS (SELECT *, supply / sum(supply) OVER () AS share FROM sup),
k AS (SELECT source, supply, {knots} FROM sh),
p AS ({pieces}),
q AS (SELECT *, (t1 - t0) * (w0 + w1) / 2 AS area, sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source) AS mean_weight FROM p),
z AS (SELECT *, max(supply / mean_weight) OVER () AS total, sum(area) OVER (PARTITION BY source ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
d AS (SELECT source, supply, t0, t1, w0, w1, total, (upto - area) * total AS d0, mean_weight * total AS need FROM z),
e AS (SELECT b.*, n.supply, unnest(range(1, coalesce(greatest(1, ceil((n.need - b.before) / n.supply - 1e-9)), 1)::BIGINT + 1)) AS epoch
      FROM b LEFT JOIN (SELECT DISTINCT source, supply, need FROM d) n USING (source)),
c AS (SELECT e.*, before + (epoch - 1) * e.supply AS c FROM e),
m AS (SELECT c.*, d.t0, d.t1, d.w0, d.w1, d.d0, d.total, (d.w1 - d.w0) / (d.t1 - d.t0) AS slope, row_number() OVER (PARTITION BY c.source, key, c.doc_id, c.n_tokens, text_key, epoch, before ORDER BY d.t0 DESC) AS rn
      FROM c LEFT JOIN d ON d.source = c.source AND d.d0 <= c.c)
SELECT doc_id, CASE WHEN source <> chr(1) THEN source END AS source, n_tokens::BIGINT AS n_tokens, epoch::INTEGER AS epoch,
  coalesce(round(least(t1, t0 + 2 * ((c - d0) / total) / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * ((c - d0) / total))))), 9), 0.0) AS position
FROM m WHERE rn = 1
"""
