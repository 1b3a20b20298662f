"""Conversion of diagnosed pages: what each page becomes, its Markdown, and the manifest of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import diagnosis, pages as P, products, quality

#: Product of a page to the image that is kept with it; products that aren't here keep none.
SUFFIXES = {
    "map": "mapa", "map_cover": "capa_mapa", "coordinates": "coordenadas", "table_candidate": "tabela", "table": "tabela", "diagram": "diagrama", "raster_table": "tabela_raster",
    "ocr_review": "ocr_revisao", "rotated": "texto_rotacionado",
}
DPI = {"coordinates": 200, "table": 200, "table_candidate": 200, "raster_table": 200, "diagram": 250}
NOTICES = {
    "map_cover": "Capa ou índice cartográfico preservado sem ser contado como mapa efetivo.", "map_confirmed": "Conteúdo cartográfico confirmado por evidência textual e visual.",
    "map_candidate": "Possível conteúdo cartográfico preservado para revisão.", "diagram": "Estrutura visual preservada como possível fluxograma, esquema ou desenho técnico.",
    "rotated": "Texto rotacionado detectado; imagem preservada para conferência.",
}
LISTS = (
    "used_ocr_pages map_pages table_pages table_candidate_pages decorative_pages review_pages rotated_text_pages visual_text_preserved_pages raster_table_pages diagram_pages coordinate_register_pages "
    "map_candidate_pages map_cover_pages ocr_review_image_pages"
).split()


def with_evidence(diagnosed: DataFrame, recognised: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """diagnosed with ocr_text, ocr (quality), raster, ocr_register and visual (map metrics) of the pages that have them.

    recognised: doc_id, page_number, text, confidences of OCR; measured: doc_id, page_number, m (raster.metrics). Pages join
    theirs by number; a page without any keeps nulls.
    """
    c = F.col
    keys = list(diagnosis.KEYS)
    empty = diagnosed.sparkSession.createDataFrame([], "doc_id string, page_number int, text string, confidences array<double>")
    recognised = empty if recognised is None else recognised
    judged = quality.with_ocr_quality(recognised.select(*keys, T.nfc(c("text")).alias("text"), "confidences"), "ocr", "text", "confidences").select(*keys, c("text").alias("ocr_text"), "ocr")
    judged = P.assess_tables(judged, "ocr_text").withColumnsRenamed({"table": "ocr_table"})
    d = diagnosed.join(judged, keys, "left")
    if measured is None:
        d = d.withColumn("m", F.lit(None).cast("struct<horizontal_lines:int,vertical_lines:int,intersections:int,closed_regions:int,boxes:int,area:double,ink:double,edges:double,components:int>"))
    else:
        d = d.join(measured.select(*keys, "m"), keys, "left")
    native = d.withColumns({"_text": c("text"), "text": c("ocr_text")})
    d = P.ocr_evidence(native).withColumn("text", c("_text")).drop("_text")
    found = P.coordinates(c("ocr_text"))
    d = d.withColumns({"ocr_coordinates": F.when(c("ocr_text").isNotNull(), found), "visual": F.when(c("m").isNotNull(), P.map_visual(c("m.ink"), c("m.edges"), c("m.components")))})
    return d.withColumn("ocr_register", F.coalesce(P.is_coordinate_register(c("ocr_coordinates"), c("ocr_table"), c("raster.strong")), F.lit(False)))


def _visual(name: str) -> Column:
    return F.coalesce(F.col("visual")[name], F.lit(False))


def convert(evidence: DataFrame, stem: Column | None = None) -> DataFrame:
    """evidence (of with_evidence) with product, final page_type and route, image (name or null), title, notice and chunk, the page's Markdown.

    The first rule that fits decides. A page for OCR without recognised text is a fault of the set-up, not of the page: see missing_ocr().
    """
    c = F.col
    seen = F.struct(_visual("visual_complexity").alias("visual_complexity"), _visual("cover_like").alias("cover_like"))
    evidence = evidence.withColumn("_seen", seen)
    evidence = evidence.withColumns({"_ocr_kind": P.confirmed_map(c("ocr_text"), c("content_images"), c("_seen")), "_native_kind": P.confirmed_map(c("text"), c("content_images"), c("_seen")), "_false": P.legal_false_positive(c("raw_text"), c("table"))})
    ocr_kind, native_kind, false = c("_ocr_kind"), c("_native_kind"), c("_false")
    ocr = c("route") == "ocr"
    review = F.coalesce(c("ocr.requires_review"), F.lit(True))
    product = (
        F.when(c("route") == "map", F.when(native_kind == "map_cover", "map_cover").otherwise("map")).when(c("route") == "decorative", "decorative").when(c("page_type") == "coordinate_register", "coordinates")
        .when((c("page_type") == "table_candidate") & ~false, "table_candidate").when(c("route") == "structured", "table")
        .when(ocr & (c("raster.classification") == "diagram_candidate"), "diagram").when(ocr & (c("raster.classification") == "raster_table_candidate"), "raster_table").when(ocr & c("ocr_register"), "coordinates")
        .when(ocr & (ocr_kind == "map_cover"), "map_cover").when(ocr & (ocr_kind != "none"), "map").when(ocr & review, "ocr_review").when(ocr, "ocr").when(c("rotated_text"), "rotated").otherwise("native")
    )
    d = evidence.withColumns({"product": product, "_map": F.when(ocr, ocr_kind).otherwise(native_kind)})
    mapped = c("product").isin("map", "map_cover")
    kind = (
        F.when(mapped, c("_map")).when(c("product") == "diagram", "diagram_candidate").when(c("product") == "raster_table", "raster_table_candidate").when(c("product") == "coordinates", "coordinate_register")
        .when(c("product") == "ocr_review", "ocr_review").when(c("product") == "rotated", "rotated_text_review").otherwise(c("page_type"))
    )
    name = F.coalesce(*[F.when(c("product") == k, products.image_name(c("page_number"), v)) for k, v in SUFFIXES.items()])
    folder = F.concat(stem if stem is not None else document_stem(c("doc_id")), F.lit("_assets/"))
    shown = F.when(ocr, c("ocr_text")).when(c("product").isin("coordinates", "table", "table_candidate"), c("raw_text")).otherwise(c("text"))
    page = c("page_number").cast("string")
    title = (
        F.when(mapped, P.map_title(shown, c("page_number"))).when(c("product").isin("table", "table_candidate"), P.table_title(c("raw_text"), c("page_number")))
        .when(c("product") == "diagram", F.concat(F.lit("Diagrama da página "), page)).when(c("product") == "raster_table", F.concat(F.lit("Tabela raster da página "), page))
        .when(c("product") == "rotated", F.concat(F.lit("Texto rotacionado da página "), page))
    )
    notice = F.coalesce(*[F.when(F.coalesce(F.when(mapped, c("_map")), c("product")) == k, F.lit(v)) for k, v in NOTICES.items()])
    d = d.withColumns({"_kind": kind, "image_name": name, "_image": F.concat(folder, name), "_shown": shown, "_title": title, "_notice": notice, "used_ocr": ocr})
    d = d.withColumns({"route": F.when(ocr & mapped, "map").otherwise(c("route")), "page_type": c("_kind")})
    drawn = d.select("*", F.when(c("product").isin("map", "map_cover", "diagram", "rotated"), "visual").otherwise(c("product")).alias("_as"))
    how = F.when(~c("used_ocr"), c("selected_mode")).when(c("product") == "diagram", "ocr+raster").otherwise("ocr")
    view = drawn.select("doc_id", F.col("page_number"), c("_as").alias("product"), "page_type", c("_shown").alias("text"), c("_title").alias("title"), c("_image").alias("image"), how.alias("mode"), c("ocr.quality").alias("quality"), c("_notice").alias("notice"), F.struct(*[x for x in drawn.columns if x[0] != "_"]).alias("_row"), "_title", "_image", "_notice")
    made = products.render(view)
    kept = [x for x in drawn.columns if x[0] != "_" and x not in ("title", "image", "notice", "chunk")]
    return made.select(*[F.col("_row")[x].alias(x) for x in kept], c("_title").alias("title"), c("_image").alias("image"), c("_notice").alias("notice"), "chunk")


def document_stem(doc: Column) -> Column:
    """Name of a document's file without its folders and ending."""
    return F.regexp_replace(F.element_at(F.split(doc, "[/!]"), -1), r"(?<=.)\.[^.]*$", "")


def missing_ocr(evidence: DataFrame) -> DataFrame:
    """doc_id, pages of documents that need OCR which nobody did."""
    return evidence.where("route = 'ocr' AND ocr_text IS NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))


def manifests(converted: DataFrame, dpi: int = 300, version: str = "1") -> DataFrame:
    """One row per document: Markdown with its hash and size, page lists (sorted and distinct), and asset names in page order."""
    c = F.col
    is_ = lambda *names: c("product").isin(*names)
    lists = {
        "used_ocr_pages": c("used_ocr"), "map_pages": c("page_type") == "map_confirmed", "table_pages": is_("table"), "table_candidate_pages": is_("table_candidate", "raster_table"), "decorative_pages": is_("decorative"),
        "review_pages": ~is_("decorative", "ocr", "native"), "rotated_text_pages": is_("rotated"), "visual_text_preserved_pages": is_("map", "map_cover") & ~c("used_ocr") & (T.strip(c("text")) != ""),
        "raster_table_pages": is_("raster_table"), "diagram_pages": is_("diagram"), "coordinate_register_pages": is_("coordinates"), "map_candidate_pages": c("page_type") == "map_candidate",
        "map_cover_pages": c("page_type") == "map_cover", "ocr_review_image_pages": is_("ocr_review"),
    }
    assets = F.transform(F.array_sort(F.collect_list(F.when(c("image").isNotNull(), F.struct("page_number", "image")))), lambda x: x["image"])
    # by document, as both aggregations need it; beyond the exchange a page's product is a value, not an expression repeated in every list
    converted = converted.repartition("doc_id")
    pages = converted.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(F.when(k, c("page_number")))).alias(name) for name, k in lists.items()], assets.alias("asset_paths"))
    return products.assemble(converted.select("doc_id", "page_number", "chunk")).join(pages, "doc_id").withColumns({"dpi": F.lit(dpi), "converter_version": F.lit(version)})


def published(manifest: DataFrame) -> DataFrame:
    """manifest with where its files go: analise/ for text, ativos/ for images, and links and asset paths rewritten to match."""
    c = F.col
    stem = document_stem(c("doc_id"))
    assets = F.concat(F.lit("ativos/"), stem)
    d = manifest.withColumns({
        "markdown": F.replace(c("markdown"), F.concat(stem, F.lit("_assets/")), F.concat(F.lit("../ativos/"), stem, F.lit("/"))), "stem": stem, "markdown_path": F.concat(F.lit("analise/"), stem, F.lit(".md")),
        "manifest_path": F.concat(F.lit("analise/"), stem, F.lit(".manifest.json")), "ocr_tokens_path": F.concat(F.lit("analise/"), stem, F.lit(".ocr_tokens.jsonl")), "ocr_structure_path": F.concat(F.lit("analise/"), stem, F.lit(".estrutura_ocr.jsonl")),
        "asset_paths": F.transform("asset_paths", lambda x: F.concat(assets, F.lit("/"), F.element_at(F.split(x, "/"), -1))), "compatibility_manifest": F.concat(stem, F.lit(".manifest.json")),
    })
    layout = F.struct(F.lit("analise").alias("analysis_directory"), assets.alias("assets_directory"), F.array(*[F.lit(x) for x in (".md", ".csv", ".json", ".jsonl")]).alias("lightweight_extensions"))
    structure = F.struct(F.lit("1.0").alias("schema_version"), F.lit("ocr_tokens").alias("source"), F.lit(True).alias("conservative"), F.lit(False).alias("replaces_markdown"))
    return d.withColumns({"output_layout": layout, "ocr_structure": structure, "markdown_sha256": F.sha2("markdown", 256), "markdown_size_bytes": F.octet_length("markdown").cast("long")})
