"""Recurring graphics: where drawn objects stand, which are decoration, and how many images a page has besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def transform_point(m: Column, x: Column, y: Column) -> Column:
    """Point (x, y) under the matrix m (a, b, c, d, e, f)."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """Matrix that applies m, then n."""
    cell = lambda p, q, r, s: m[p] * n[q] + m[r] * n[s]
    return F.struct(
        cell("a", "a", "b", "c").alias("a"), cell("a", "b", "b", "d").alias("b"), cell("c", "a", "d", "c").alias("c"), cell("c", "b", "d", "d").alias("d"),
        (cell("e", "a", "f", "c") + n["e"]).alias("e"), (cell("e", "b", "f", "d") + n["f"]).alias("f"),
    )


def unit_box(m: Column, width: Column, height: Column) -> Column:
    """Box of the unit square under m as shares of the page, clipped to it; null if nothing is left."""
    corners = [transform_point(m, F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    xs, ys = [p["x"] / width for p in corners], [p["y"] / height for p in corners]
    box = F.struct(clip(F.least(*xs)).alias("x0"), clip(F.least(*ys)).alias("y0"), clip(F.greatest(*xs)).alias("x1"), clip(F.greatest(*ys)).alias("y1"))
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def position(x0: Column, y0: Column, x1: Column, y1: Column, band: float = 0.12) -> Column:
    return F.when(y1 <= band, "bottom").when(y0 >= 1.0 - band, "top").when(x1 <= band, "left").when(x0 >= 1.0 - band, "right").otherwise("interior")


def with_geometry(graphics: DataFrame, band: float = 0.12) -> DataFrame:
    """graphics (x0, y0, x1, y1) with position and area_ratio."""
    c = F.col
    return graphics.withColumns({"position": position(c("x0"), c("y0"), c("x1"), c("y1"), band), "area_ratio": (c("x1") - c("x0")) * (c("y1") - c("y0"))})


_SIDES = ("x0", "y0", "x1", "y1")


def distinct_occurrences(graphics: DataFrame) -> DataFrame:
    """Of occurrences on a page that agree in fingerprint and box to 6 decimals, the last. All that follows is grouped within (doc_id, fingerprint)."""
    same = Window.partitionBy("doc_id", "fingerprint", "page_number", *[F.round(k, 6) for k in _SIDES]).orderBy(F.desc("ordinal"))
    return graphics.repartition("doc_id", "fingerprint").withColumn("_last", F.row_number().over(same)).where("_last = 1").drop("_last")


def _near(tolerance: float) -> Column:
    near = F.lit(True)
    for k in _SIDES:
        near = near & (F.abs(F.col(k) - F.col(f"m_{k}")) <= tolerance)
    return near


def with_rules(graphics: DataFrame, least_share: float = 0.70, most_area: float = 0.05, tolerance: float = 0.025, least_pages: int = 5) -> DataFrame:
    """graphics with decorative (whether its document's rules make the graphic decoration), edge, median box m_*, and counts.

    graphics has doc_id, page_number, page_count, fingerprint, ordinal, the box, position and area_ratio. A graphic is decoration if it stands on
    enough inner pages, nearly always at one edge, small, and close to its median box. Windows within (doc_id, fingerprint) alone: one shuffle.
    """
    c = F.col
    by, placed = Window.partitionBy("doc_id", "fingerprint"), Window.partitionBy("doc_id", "fingerprint", "position")
    page = Window.partitionBy("doc_id", "fingerprint", "page_number").orderBy("ordinal")
    d = graphics.withColumns({"_core": (c("page_number") > 1) & (c("page_number") < c("page_count")), "_new": F.row_number().over(page) == 1})
    d = d.withColumns({"_n": F.count_if("_core").over(placed), "_first": F.min(F.when(c("_core"), F.struct("page_number", "ordinal"))).over(placed)})
    d = d.withColumns({
        "_main": F.min(F.when(c("_core"), F.struct((-c("_n")).alias("n"), c("_first").alias("f"), c("position").alias("p")))).over(by), "core": F.count_if("_core").over(by), "occurrences": F.count("*").over(by),
        "pages_with_it": F.count_if("_new").over(by), "core_pages": F.count_if(c("_new") & c("_core")).over(by),
    })
    edge = F.when((c("_main.p") != "interior") & (-c("_main.n") / c("core") >= 0.95), c("_main.p"))
    d = d.withColumn("edge", edge)
    d = d.withColumn("_ok", F.coalesce(c("_core") & (c("position") == c("edge")) & (c("area_ratio") <= most_area), F.lit(False)))
    d = d.withColumns({f"m_{k}": F.median(F.when(c("_ok"), c(k))).over(by) for k in _SIDES} | {"_oks": F.count_if("_ok").over(by)})
    d = d.withColumn("_stable", F.count_if(c("_ok") & _near(tolerance)).over(by))
    needed = F.greatest(F.lit(least_pages), F.ceil(F.greatest(c("page_count") - 2, F.lit(1)) * F.lit(least_share)))
    found = c("edge").isNotNull() & (c("core_pages") >= needed) & (c("_oks") / c("core") >= 0.95) & (c("_stable") / c("core") >= 0.95)
    d = d.withColumns({"decorative": F.coalesce(found, F.lit(False))} | {f"m_{k}": F.round(f"m_{k}", 6) for k in _SIDES})
    return d.drop("_core", "_new", "_n", "_first", "_main", "_ok", "_oks", "_stable", "core")


def repeated_graphics(graphics: DataFrame, **options) -> DataFrame:
    """Decorative graphics per document, one row each. See with_rules()."""
    c = F.col
    first = F.row_number().over(Window.partitionBy("doc_id", "fingerprint").orderBy("page_number", "ordinal"))
    d = with_rules(graphics, **options).where("decorative").withColumn("_k", first).where("_k = 1")
    return d.select(
        "doc_id", "fingerprint", F.concat(F.lit("graphic-"), F.left("fingerprint", F.lit(12))).alias("graphic_id"), "occurrences", "pages_with_it",
        F.round(c("pages_with_it") / F.greatest("page_count", F.lit(1)), 6).alias("page_ratio"), c("edge").alias("position"), *[f"m_{k}" for k in _SIDES],
    )


def page_graphics(graphics: DataFrame, most_area: float = 0.05, tolerance: float = 0.025, refined: bool = False, band: float = 0.15, **options) -> DataFrame:
    """Images per page: all, decorative by the rules, and content. Graphics of one fingerprint count by the largest weight.

    refined: a graphic that is decoration anywhere counts as such wherever it is small and near an edge; counts only grow.
    """
    c = F.col
    d = with_rules(graphics, most_area=most_area, tolerance=tolerance, **options)
    match = c("decorative") & (c("area_ratio") <= most_area) & F.coalesce((c("position") == c("edge")) & _near(tolerance), F.lit(False))
    wide = c("decorative") & (c("area_ratio") <= most_area) & (position(c("x0"), c("y0"), c("x1"), c("y1"), band) != "interior")
    per = d.groupBy("doc_id", "fingerprint", "page_number").agg(F.max("image_weight").alias("w"), F.bool_or(match).alias("d"), F.bool_or(wide).alias("e"))
    sums = per.groupBy("doc_id", "page_number").agg(F.sum("w").alias("raw_images"), *[F.coalesce(F.sum(F.when(c(k), c("w"))), F.lit(0)).alias(k) for k in ("d", "e")])
    decorative = F.least(F.greatest("d", "e"), "raw_images") if refined else c("d")
    return sums.select("doc_id", "page_number", "raw_images", decorative.alias("decorative_images")).withColumn("content_images", F.greatest(c("raw_images") - c("decorative_images"), F.lit(0)))
