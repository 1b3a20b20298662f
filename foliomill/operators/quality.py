"""Quality of recognised text, and arbitration between two extractions of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, text as T
from ..lexicon import REASONS


def _said(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    cases = [F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in pairs]
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


said = _said


def _counts(t: Column) -> dict[str, Column]:
    """Of stripped text: characters, words, what is no white space, letters and digits."""
    return {"n": F.length(t), "w": F.regexp_count(t, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")), "s": F.length(F.regexp_replace(t, r"(?U)\s+", "")), "a": T.alphanumeric_count(t)}


def _mean(confidences: Column | None) -> tuple[Column, Column]:
    """Mean of the confidences that are not negative, as it is and rounded; the order of the array doesn't matter."""
    if confidences is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    good = F.filter(confidences, lambda c: c >= 0)
    total = F.aggregate(F.transform(good, metrics.millionths), F.lit(0).cast("long"), lambda a, c: a + c)
    n = F.greatest(F.size(good), F.lit(0)).cast("long")
    return F.when(n > 0, total / (n * 1_000_000)), metrics.mean_to_thousandths(total, n)


def _judged(n: Column, w: Column, s: Column, a: Column, mean: Column, rounded: Column, min_characters: int, min_words: int, low: float, medium: float) -> Column:
    ratio = F.when(s > 0, a / s).otherwise(F.lit(0.0))
    doubts = _said((n < min_characters, REASONS["short"]), (w < min_words, REASONS["few_words"]), (ratio < 0.6, REASONS["noise"]), (mean < low, REASONS["low_conf"]))
    severe = (n < min_characters) | (w < min_words) | (ratio < 0.6) | F.coalesce(mean < low, F.lit(False))
    middling = F.coalesce(mean < medium, F.lit(False))
    return F.struct(
        n.alias("character_count"), w.alias("word_count"), F.round(ratio, 6).alias("alphanumeric_ratio"), rounded.alias("mean_confidence"),
        F.when(severe, "low").when(middling, "medium").otherwise("high").alias("quality"), (severe | middling).alias("requires_review"),
        F.when(~severe & middling, F.array(F.lit(REASONS["mid_conf"]))).otherwise(doubts).alias("reasons"),
    )


def ocr_quality(
    text: Column, confidences: Column | None = None, min_characters: int = 80, min_words: int = 15, low_confidence: float = 55.0, medium_confidence: float = 75.0
) -> Column:
    """Struct of counts, alphanumeric ratio, mean confidence, quality, requires_review and reasons. For a whole table, see with_ocr_quality()."""
    return _judged(*_counts(T.strip(F.coalesce(text, F.lit("")))).values(), *_mean(confidences), min_characters, min_words, low_confidence, medium_confidence)


def with_ocr_quality(
    df: DataFrame, name: str = "quality", text: str = "text", confidences: str | None = None, min_characters: int = 80, min_words: int = 15, low_confidence: float = 55.0, medium_confidence: float = 75.0
) -> DataFrame:
    """df with a struct column as of ocr_quality(). Each text is stripped once and counted once: steps stand in projections of their own."""
    stripped = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), T.strip(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_t"), *([F.col(confidences).alias("_c")] if confidences else []))
    counted = stripped.select("_row", *[v.alias(f"_{k}") for k, v in _counts(F.col("_t")).items()], *[m.alias(k) for k, m in zip(("_mean", "_rounded"), _mean(F.col("_c") if confidences else None))])
    judged = _judged(*[F.col(f"_{k}") for k in ("n", "w", "s", "a", "mean", "rounded")], min_characters, min_words, low_confidence, medium_confidence)
    return counted.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != name], judged.alias(name))


def native_mode(pages: DataFrame) -> DataFrame:
    """pages (layout_text, simple_text, messages) with the extraction chosen for each page.

    Adds text, raw_text, selected_mode, layout_character_count, simple_character_count, rotated_text and warnings. The simple
    extraction counts only where it is asked for: rotated text, a thin layout text, or one spaced out too far.
    """
    base = pages.withColumns({"_l": T.nfc(F.coalesce("layout_text", F.lit(""))), "_s": T.nfc(F.coalesce("simple_text", F.lit(""))), "_messages": F.coalesce("messages", F.array().cast("array<string>"))})
    # each step is a column of its own, so that no later one repeats it
    base = base.withColumns({"_layout": T.trimmed(T.clean_invisible(F.col("_l"), composed=True)), "_rotated": F.exists("_messages", lambda m: F.lower(m).contains("rotated text"))}).drop("_l")
    base = base.withColumn("_wide", T.spacing_of_clean(F.col("_layout")))
    tried = F.col("_rotated") | (F.length("_layout") < 40) | F.col("_wide")
    base = base.withColumn("_simple", F.when(tried, T.trimmed(T.clean_invisible(F.col("_s"), composed=True))).otherwise(F.lit(""))).drop("_s")
    # scores decide only where there are two texts
    two = F.col("_simple") != ""
    base = base.withColumns({"_a": F.when(two, T.score_of_clean(F.col("_layout"))), "_b": F.when(two, T.score_of_clean(F.col("_simple")))})
    a, b = F.col("_a"), F.col("_b")
    better = (F.col("_layout") == "") | (b > a * 1.05) | (F.col("_rotated") & (b >= a * 0.95)) | (F.col("_wide") & (b >= a * 0.85))
    mode = F.when((F.col("_simple") != "") & better, "simple").when(F.col("_wide"), "layout_normalized").otherwise("layout")
    base = base.withColumn("selected_mode", mode)
    base = base.withColumn("_chosen", F.when(F.col("selected_mode") == "simple", F.col("_simple")).otherwise(F.col("_layout")))
    noted = F.when(F.col("_wide"), F.array_append("_messages", F.lit("layout_spacing_excessive: compared_with_simple_extraction"))).otherwise(F.col("_messages"))
    return base.withColumns(
        {
            "text": T.prose_of_clean(F.col("_chosen")), "raw_text": F.when(F.col("_layout") != "", F.col("_layout")).otherwise(F.col("_chosen")),
            "layout_character_count": F.length("_layout"), "simple_character_count": F.length("_simple"), "rotated_text": F.col("_rotated"),
            "warnings": F.array_distinct(F.filter(F.transform(noted, T.strip), lambda m: m != "")),
        }
    ).drop("_layout", "_rotated", "_wide", "_simple", "_messages", "_a", "_b", "_chosen")
