"""Markdown of pages and documents, and the page lists of a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NOTICES: dict[str, str] = {
    "visual": "Texto associado à página visual, preservado para pesquisa e rastreabilidade. A interpretação espacial deve consultar a imagem.",
    "coordinates": "Sequência espacial preservada em classe própria. A imagem deve ser consultada para conferir pares, vértices, ordem e continuidade geométrica.",
    "ocr": "**Revisão necessária:** o resultado do OCR apresentou qualidade baixa ou moderada. A imagem integral foi preservada e deve prevalecer em caso de dúvida.",
    "decorative": "Página sem conteúdo textual normativo detectável. Os elementos gráficos foram classificados como decorativos recorrentes; o PDF original permanece como fonte visual de referência.",
}


def _join(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def head(page: Column, fields: list[tuple[str, Column | str]]) -> Column:
    parts: list[Column | str] = ["<!-- pagina_original: ", page.cast("string")]
    for name, value in fields:
        parts += [f"; {name}: ", value]
    return _join(*parts, " -->\n\n## Página ", page.cast("string"))


def fenced(text: Column) -> Column:
    return _join("```text\n", text, "\n```\n")


def visual_page(page: Column, title: Column, text: Column, image: Column, mode: Column, kind: Column, notice: Column) -> Column:
    prose = T.prose(F.coalesce(text, F.lit("")), composed=True)
    shown = F.when(prose != "", _join("\n\n> ", NOTICES["visual"], "\n\n", fenced(prose))).otherwise("")
    top = head(page, [("tipo", kind), ("rota", _join("imagem+texto:", mode)), ("revisao", "sim")])
    return _join(top, " — ", title, "\n\n> ", notice, "\n\n", T.markdown_image(title, image), shown)


def table_page(page: Column, title: Column, text: Column, image: Column, candidate: Column, raster: Column) -> Column:
    sort, source = F.when(candidate, "candidata").otherwise("confirmada"), F.when(raster, "raster").otherwise("nativa/vetorial")
    top = head(page, [("tipo", _join("tabela_", sort)), ("origem", source), ("rota", "structured:preservacao"), ("revisao", "sim")])
    note = _join("**Revisão estrutural necessária:** estrutura tabular ", sort, " identificada em fonte ", source, ". O texto linear e a imagem foram preservados; ", "as relações entre linhas e colunas devem ser conferidas.")
    return _join(top, " — ", title, "\n\n> ", note, "\n\n", T.markdown_image(_join("Página tabular ", page.cast("string")), image), "\n\n", fenced(T.strip(T.clean_invisible(text, composed=True))))


def coordinate_page(page: Column, text: Column, image: Column) -> Column:
    top = head(page, [("tipo", "coordinate_register"), ("rota", "structured:preservacao"), ("revisao", "sim")])
    picture = T.markdown_image(_join("Registro de coordenadas da página ", page.cast("string")), image)
    return _join(top, " — Registro de coordenadas\n\n> ", NOTICES["coordinates"], "\n\n", picture, "\n\n", fenced(T.strip(T.clean_invisible(text, composed=True))))


def ocr_review_page(page: Column, text: Column, image: Column, quality: Column) -> Column:
    top = head(page, [("tipo", "ocr_review"), ("qualidade", quality), ("rota", "ocr:tesseract+pdfium"), ("revisao", "sim")])
    picture = T.markdown_image(_join("Página ", page.cast("string"), " para revisão de OCR"), image)
    return _join(top, " — OCR com revisão necessária\n\n> ", NOTICES["ocr"], "\n\n", picture, "\n\n", fenced(T.prose(text, composed=True)))


def decorative_page(page: Column, kind: Column) -> Column:
    label = F.when(kind == "back_cover", "Contracapa").otherwise("Página decorativa")
    return _join(head(page, [("tipo", kind), ("rota", "decorative"), ("revisao", "nao")]), " — ", label, "\n\n> ", NOTICES["decorative"], "\n")


def ocr_page(page: Column, text: Column) -> Column:
    return _join(head(page, [("rota", "ocr:tesseract+pdfium"), ("revisao", "nao")]), "\n\n", T.prose(text, composed=True), "\n")


def native_page(page: Column, text: Column, mode: Column) -> Column:
    return _join(head(page, [("rota", "native:pypdf"), ("modo", mode)]), "\n\n", text, "\n")


def image_name(page: Column, suffix: str) -> Column:
    return F.format_string(f"pagina_%04d_{suffix}.png", page.cast("int"))


def product_kind(pages: DataFrame) -> DataFrame:
    """pages (route, page_type, false_positive, raster_class, coordinate_register, ocr_map, quality, rotated) with product: the first rule that fits."""
    c = F.col
    ocr = c("route") == "ocr"
    kind = (
        F.when(c("route") == "map", "visual").when(c("route") == "decorative", "decorative").when(c("page_type") == "coordinate_register", "coordinates")
        .when((c("page_type") == "table_candidate") & ~c("false_positive"), "table_candidate").when(c("route") == "structured", "table")
        .when(ocr & (c("raster_class") == "diagram_candidate"), "visual").when(ocr & (c("raster_class") == "raster_table_candidate"), "raster_table").when(ocr & c("coordinate_register"), "coordinates")
        .when(ocr & c("ocr_map"), "visual").when(ocr & (c("quality") != "high"), "ocr_review").when(ocr, "ocr").when(c("rotated"), "visual").otherwise("native")
    )
    return pages.withColumn("product", kind)


def render(pages: DataFrame) -> DataFrame:
    """pages (page_number, product, page_type, text in NFC, title, image, mode, quality, notice) with chunk, the page's Markdown."""
    c = F.col
    page, text, image = c("page_number"), F.coalesce("text", F.lit("")), c("image")
    chunk = (
        F.when(c("product") == "visual", visual_page(page, c("title"), text, image, c("mode"), c("page_type"), c("notice")))
        .when(c("product").isin("table", "table_candidate", "raster_table"), table_page(page, c("title"), text, image, c("product") == "table_candidate", c("product") == "raster_table"))
        .when(c("product") == "coordinates", coordinate_page(page, text, image)).when(c("product") == "ocr_review", ocr_review_page(page, text, image, c("quality")))
        .when(c("product") == "decorative", decorative_page(page, c("page_type"))).when(c("product") == "ocr", ocr_page(page, text)).otherwise(native_page(page, text, c("mode")))
    )
    return pages.withColumn("chunk", chunk)


def assemble(chunks: DataFrame) -> DataFrame:
    """markdown and its hash and size per document: chunks in page order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "chunk")))
    d = chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "\n\n").alias("markdown"), F.count("*").alias("page_count"))
    return d.withColumns({"markdown_sha256": F.sha2("markdown", 256), "markdown_size_bytes": F.octet_length("markdown").cast("long")})


def manifest_lists(pages: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """Sorted distinct page numbers per document, one array for each condition; one aggregation for all of them."""
    return pages.groupBy("doc_id").agg(F.max("page_number").alias("page_count"), *[F.array_sort(F.collect_set(F.when(k, F.col("page_number")))).alias(name) for name, k in lists.items()])
