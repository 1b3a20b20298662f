"""Tokens of recognised text to lines, columns and blocks. All windows and groups share the page as their first key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import metrics, text as T

PAGE = ("doc_id", "page_number")


def line_type(text: Column) -> Column:
    folded = T.fold_upper(T.strip(text))
    kind = F
    for name, pattern in L.LINE_TYPES:
        kind = kind.when(folded.rlike(pattern), name)
    return kind.otherwise("texto")


def join_tokens(tokens: Column) -> Column:
    """Text of ordered tokens: no space before closing marks, after opening marks, or after a slash; dashes stand alone."""
    words = F.filter(F.transform(tokens, T.strip), lambda t: t != "")

    def add(done: Column, token: Column) -> Column:
        last = F.right(done, F.lit(1))
        dash = token.isin("-", "–", "—")
        close = F.contains(F.lit(L.NO_SPACE_BEFORE), F.left(token, F.lit(1))) | F.contains(F.lit(L.NO_SPACE_AFTER + "/"), last)
        return F.when(done == "", token).when(~dash & close, F.concat(done, token)).otherwise(F.concat(done, F.lit(" "), token))

    return F.aggregate(words, F.lit(""), add)


def read_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens without blank ones; a confidence that is no number or negative becomes null."""
    number = F.expr("try_cast(confidence AS DOUBLE)")
    return tokens.where(T.strip(F.col("text")) != "").withColumn("confidence", F.when(number >= 0, number))


def _mean_confidence() -> Column:
    return metrics.mean_to_thousandths(F.sum(metrics.millionths(F.col("confidence"))), F.count("confidence"))


def token_lines(tokens: DataFrame) -> DataFrame:
    """One row per line: ordered text, type, mean confidence, count and extent."""
    c = F.col
    item = F.struct("left", "word_number", "text")
    lines = tokens.groupBy(*PAGE, "block_number", "paragraph_number", "line_number").agg(
        F.array_sort(F.collect_list(item)).alias("items"), _mean_confidence().alias("confidence"), F.count("*").cast("int").alias("tokens"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(c("left") + c("width")).alias("right"), F.max(c("top") + c("height")).alias("bottom"),
    )
    lines = lines.withColumn("text", join_tokens(F.transform("items", lambda x: x["text"]))).drop("items")
    return lines.withColumn("line_type", line_type(c("text")))


def assign_columns(lines: DataFrame) -> DataFrame:
    """lines with column_number (0 across, 1 left or only, 2 right) and line_order, by the widest gap of line centres."""
    c = F.col
    page = Window.partitionBy(*PAGE)
    width = F.max("right").over(page) - F.min("left").over(page)
    d = lines.withColumns({"_w": width, "_n": F.count("*").over(page), "_centre": (c("left") + c("right")) / 2})
    d = d.withColumn("_narrow", c("right") - c("left") <= c("_w") * F.lit(0.72))
    by = Window.partitionBy(*PAGE, "_narrow").orderBy("_centre", "top", "left", "block_number", "paragraph_number", "line_number")
    whole = Window.partitionBy(*PAGE, "_narrow")
    d = d.withColumns({"_i": F.row_number().over(by) - 1, "_m": F.count("*").over(whole), "_back": F.lag("_centre").over(by)})
    inner = c("_narrow") & (c("_i") >= 2) & (c("_i") < c("_m") - 2)
    best = F.max(F.when(inner, F.struct((c("_centre") - c("_back")).alias("gap"), (-c("_i")).alias("i"), ((c("_centre") + c("_back")) / 2).alias("cut")))).over(whole)
    d = d.withColumn("_best", best)
    left, right = c("_i") < -c("_best.i"), c("_i") >= -c("_best.i")
    extent = {f"_{n}{k}": f(F.when(g, c(col))).over(whole) for n, g in (("l", left), ("r", right)) for k, f, col in (("t", F.min, "top"), ("b", F.max, "bottom"))}
    d = d.withColumns(extent)
    shared = F.least("_lb", "_rb") - F.greatest("_lt", "_rt")
    lower = F.least(c("_lb") - c("_lt"), c("_rb") - c("_rt"))
    split = (c("_n") >= 6) & (c("_w") > 0) & (c("_m") >= 6) & (c("_best.gap") >= c("_w") * F.lit(0.18)) & (-c("_best.i") >= 3) & (c("_m") + c("_best.i") >= 3) & (shared > 0) & (lower > 0) & (shared / lower >= 0.35)
    # what holds of the narrow lines decides for the page
    cut = F.max(F.when(c("_narrow") & split, c("_best.cut"))).over(page)
    d = d.withColumn("_cut", cut)
    column = F.when(c("_cut").isNull(), 1).when(~c("_narrow"), 0).when(c("_centre") <= c("_cut"), 1).otherwise(2)
    order = Window.partitionBy(*PAGE).orderBy("top", "column_number", "left", "block_number", "paragraph_number", "line_number")
    return d.withColumn("column_number", column).withColumn("line_order", F.row_number().over(order)).select(*lines.columns, "column_number", "line_order")


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines (with column_number): texts in order, the first type other than plain text, extents, and an ordinal."""
    c = F.col
    item = F.struct("top", "left", "line_order", "text", "line_type", "confidence")
    d = lines.groupBy(*PAGE, "column_number", "block_number", "paragraph_number").agg(
        F.array_sort(F.collect_list(item)).alias("lines"), _mean_confidence().alias("confidence"), F.count("*").cast("int").alias("line_count"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
    )
    kinds = F.filter(F.transform("lines", lambda x: x["line_type"]), lambda k: k != "texto")
    order = Window.partitionBy(*PAGE).orderBy("top", "column_number", "left", "block_number", "paragraph_number")
    return d.withColumns({"text": F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "block_type": F.coalesce(F.get(kinds, F.lit(0)), F.lit("texto")), "block_order": F.row_number().over(order)})
