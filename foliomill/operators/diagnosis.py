"""Diagnosis of parsed pages: which extraction counts, what a page shows, and the route it takes. One row per page, then one per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graphics, pages as P, quality

KEYS = ("doc_id", "page_number")


def grid_of(rectangles: Column) -> Column:
    """Grid evidence of a page from its array of rectangles (width, height); as pages.vector_grids(), without a shuffle."""
    sized = F.transform(F.coalesce(rectangles, F.array().cast("array<struct<width:double,height:double>>")), lambda r: F.struct(F.abs(r["width"]).alias("w"), F.abs(r["height"]).alias("h")))
    n = F.size(sized)
    across = F.size(F.filter(sized, lambda r: (r["h"] <= 2.5) & (r["w"] >= 20)))
    down = F.size(F.filter(sized, lambda r: (r["w"] <= 2.5) & (r["h"] >= 8)))
    return P.grid_evidence(n, across, down)


def image_counts(parsed: DataFrame) -> DataFrame:
    """doc_id, page_number, raw_images, decorative_images, content_images of the pages that draw something."""
    drawn = parsed.select(*KEYS, "page_count", F.inline("graphics"))
    return graphics.page_graphics(graphics.distinct_occurrences(graphics.with_geometry(drawn)), refined=True)


def repeated_of(parsed: DataFrame) -> DataFrame:
    """doc_id, repeated_graphics: the decorative graphics of each document that has any."""
    drawn = parsed.select(*KEYS, "page_count", F.inline("graphics"))
    found = graphics.repeated_graphics(graphics.distinct_occurrences(graphics.with_geometry(drawn)))
    record = F.struct("graphic_id", F.col("fingerprint").alias("sha256"), "occurrences", F.col("pages_with_it").alias("page_count"), "page_ratio", "position", F.array(*[f"m_{k}" for k in ("x0", "y0", "x1", "y1")]).alias("median_bbox"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(record)).alias("repeated_graphics"))


def diagnose(parsed: DataFrame, least: int = 40) -> DataFrame:
    """Pages as of pdf.pdf_pages() with the extraction chosen, image counts, assessments, route, page_type and warnings.

    A page without text, images or drawings is left to OCR. Where graphics are null, because nothing could scan them, the images among a
    page's resources count as content. Assessments that found nothing are null. Rows without a page number, of files that couldn't be
    opened, are left out. An empty table gives an empty result.
    """
    c = F.col
    own = parsed.where("page_number IS NOT NULL")
    counts = image_counts(own.where("graphics IS NOT NULL"))
    d = quality.native_mode(own).join(counts, list(KEYS), "left")
    scanned = c("graphics").isNotNull()
    for name in ("raw_images", "content_images"):
        d = d.withColumn(name, F.coalesce(c(name), F.when(scanned, F.lit(0)).otherwise(c("image_count")), F.lit(0)).cast("int"))
    d = d.withColumn("_upper", T.fold_upper(F.coalesce("raw_text", F.lit(""))))
    d = d.withColumns({"decorative_images": F.coalesce("decorative_images", F.lit(0)).cast("int"), "characters": F.length(T.trimmed(c("text"))), "grid": grid_of(c("rectangles")), "coordinates": P.coordinates(c("raw_text"), c("_upper"))}).drop("_upper")
    d = P.assess_tables(d, "raw_text")
    d = d.withColumn("table", P.merge_grid(c("table"), c("grid"), c("raw_text")))
    d = d.withColumn("coordinate_register", P.is_coordinate_register(c("coordinates"), c("table"), c("grid.strong")))
    register = c("coordinate_register")
    cleared = F.when(register, c("table").withField("classification", F.lit("not_table")).withField("suspected", F.lit(False)).withField("content_profile", F.lit("coordinates"))).otherwise(c("table"))
    d = d.withColumns({"table": cleared, "map_class": P.map_class(c("text"), c("content_images"), F.lit(False))})
    routed = d.withColumns({
        "table_class": c("table.classification"), "coordinates_detected": c("coordinates.detected"), "grid_detected": c("grid.detected"), "rotated": c("rotated_text"), "mode": c("selected_mode"),
        "messages": c("warnings"), "is_last": c("page_number") == c("page_count"),
    }).withColumnRenamed("warnings", "extraction_warnings")
    routed = P.route_pages(routed, least)
    return routed.withColumns({
        "has_native_text": c("characters") >= least, "suspected_table": c("table_class") == "confirmed", "suspected_map": P.is_map(c("map_class")),
        "table_assessment": F.when(c("table_class") != "not_table", c("table")), "coordinate_assessment": F.when(c("coordinates.detected"), c("coordinates")),
    })


PAGE_FIELDS = (
    "page_number has_native_text character_count image_count raw_image_count decorative_image_count content_image_count suspected_table suspected_map page_type route warnings table_assessment coordinate_assessment "
    "native_extraction_mode layout_character_count simple_character_count rotated_text_detected extraction_warnings"
).split()


def records(diagnosed: DataFrame) -> DataFrame:
    """doc_id, page_count, pages: one row per document, its page records in order."""
    named = {
        "character_count": "characters", "image_count": "content_images", "raw_image_count": "raw_images", "decorative_image_count": "decorative_images", "content_image_count": "content_images",
        "native_extraction_mode": "selected_mode", "rotated_text_detected": "rotated_text",
    }
    record = F.struct(*[F.col(named.get(name, name)).alias(name) for name in PAGE_FIELDS])
    return diagnosed.groupBy("doc_id").agg(F.max("page_count").alias("page_count"), F.array_sort(F.collect_list(record), lambda a, b: a["page_number"] - b["page_number"]).alias("pages"))


def document_records(parsed: DataFrame, documents: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, source_path, sha256, page_count, pages, repeated_graphics of documents (doc_id, content)."""
    hashes = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("content", 256).alias("sha256"))
    found = records(diagnose(parsed, least)).join(hashes, "doc_id").join(repeated_of(parsed.where("page_number IS NOT NULL")), "doc_id", "left")
    none = F.array().cast("array<struct<graphic_id:string,sha256:string,occurrences:bigint,page_count:bigint,page_ratio:double,position:string,median_bbox:array<double>>>")
    return found.select("doc_id", F.col("doc_id").alias("source_path"), "sha256", "page_count", "pages", F.coalesce("repeated_graphics", none).alias("repeated_graphics"))
