"""Sources: archives, token lines, cases and earlier manifests; adapters for PDF and OCR libraries that may be absent."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = "doc_id BIGINT, text STRING, confidence DOUBLE, page_number INT, block_number INT, paragraph_number INT, line_number INT, word_number INT, left INT, top INT, width INT, height INT"
MEMBERS = "archive string, member string, ordinal int, size bigint, attributes bigint, content binary"
#: Functions of libraries that may be absent, by name: pdf (bytes -> pages, as pdf.parse_pages), render (bytes, page, dpi -> (height, width, RGB
#: bytes)), ocr (an OcrEngine), docling (bytes -> Markdown). They are pickled to the executors.
ADAPTERS: dict[str, Callable] = {}


class OcrEngine(Protocol):
    """Recognises one page: columns of equal length, named as in COLUMNS, one entry per word. recognise(content, page_number, dpi)."""

    def __call__(self, content: bytes, page_number: int, dpi: int) -> dict[str, list]: ...


COLUMNS = ("text", "conf", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")
RAW = "doc_id string, page_number int, text array<string>, conf array<string>, " + ", ".join(f"{n} array<int>" for n in COLUMNS[2:])


def adapter(name: str) -> Callable:
    """A registered adapter (pdf, render, ocr, docling, ...); a clear error where there is none."""
    if name not in ADAPTERS:
        raise RuntimeError(f"no adapter named {name!r} is registered: install its library and register a function in ADAPTERS")
    return ADAPTERS[name]


def recognise(pages: DataFrame, engine: OcrEngine, dpi: int = 300) -> DataFrame:
    """Columns of words (RAW) of pages (doc_id, page_number, content), recognised on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.string()), ("page_number", pa.int32()), ("text", pa.list_(pa.string())), ("conf", pa.list_(pa.string())), *[(n, pa.list_(pa.int32())) for n in COLUMNS[2:]]]
        for batch in batches:
            for name, page, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = engine(raw.as_py(), page, dpi)
                row = {"doc_id": name, "page_number": page, "text": [str(x) for x in found.get("text", [])], "conf": [str(x) for x in found.get("conf", [])]}
                yield pa.RecordBatch.from_pylist([row | {n: [int(x or 0) for x in found.get(n, [])] for n in COLUMNS[2:]}], pa.schema(kinds))

    return pages.selectExpr("CAST(doc_id AS STRING) AS doc_id", "page_number", "content").mapInArrow(run, RAW)


def ocr_tokens(raw: DataFrame) -> DataFrame:
    """Tokens, one row each, of columns of words (RAW): blank words go, a confidence that is negative or no number is null, a missing place is 0."""
    c = F.col
    words = F.transform("text", lambda x, i: F.struct(F.regexp_replace(x, r"(?U)^\s+|\s+$", "").alias("text"), i.alias("i")))
    d = raw.select("doc_id", "page_number", F.explode(F.filter(words, lambda w: w["text"] != "")).alias("w"), *COLUMNS[1:])
    number = F.expr("try_cast(get(conf, w.i) AS DOUBLE)")
    names = {"block_num": "block_number", "par_num": "paragraph_number", "line_num": "line_number", "word_num": "word_number"}
    return d.select("doc_id", c("w.text").alias("text"), F.when(number >= 0, number).alias("confidence"), "page_number", *[F.coalesce(F.get(n, c("w.i")), F.lit(0)).alias(names.get(n, n)) for n in COLUMNS[2:]])


def recognised_pages(tokens: DataFrame) -> DataFrame:
    """doc_id, page_number, text, confidences of tokens: words in reading order with a space between them."""
    order = F.array_sort(F.collect_list(F.struct("block_number", "paragraph_number", "line_number", "word_number", "left", "text", "confidence")))
    d = tokens.groupBy("doc_id", "page_number").agg(order.alias("words"))
    sure = F.filter(F.transform("words", lambda w: w["confidence"]), lambda x: x.isNotNull())
    return d.select("doc_id", "page_number", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), sure.alias("confidences"))


def page_images(pages: DataFrame, render: Callable[[bytes, int, int], tuple[int, int, bytes]], dpi: int = 150) -> DataFrame:
    """doc_id, page_number, height, width, data (RGB) of pages (doc_id, page_number, page_count, content), drawn on executors."""
    if dpi <= 0:
        raise ValueError("dpi must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("page_number", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for name, page, count, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3)):
                if page < 1:
                    raise ValueError("page_number must be 1 or more")
                if page > count:
                    raise IndexError(f"page {page} of {count}")
                height, width, data = render(raw.as_py(), page, dpi)
                yield pa.RecordBatch.from_pylist([{"doc_id": name, "page_number": page, "height": height, "width": width, "data": data}], schema)

    return pages.selectExpr("CAST(doc_id AS STRING) AS doc_id", "page_number", "page_count", "content").mapInArrow(run, "doc_id string, page_number int, height int, width int, data binary")


def archive_members(archives: DataFrame, ending: str | None = None) -> DataFrame:
    """One row per member of archives (path, content), folders left out. Members are unpacked one by one, so one of them is in memory, not all.

    ending: contents of members with another one stay null. A file that is no archive gives a row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("ordinal", pa.int32()), ("size", pa.int64()), ("attributes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    opened = zipfile.ZipFile(pa.BufferReader(raw.as_buffer()))
                except zipfile.BadZipFile as failure:
                    yield pa.RecordBatch.from_pylist([{"archive": name, "error": str(failure)}], schema)
                    continue
                with opened as z:
                    for k, m in enumerate(i for i in z.infolist() if not i.is_dir()):
                        row = {"archive": name, "member": m.filename, "ordinal": k, "size": m.file_size, "attributes": m.external_attr}
                        try:
                            row["content"] = z.read(m) if ending is None or m.filename.lower().endswith(ending) else None
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as failure:
                            row["error"] = str(failure)
                        yield pa.RecordBatch.from_pylist([row], schema)

    return archives.select("path", "content").mapInArrow(run, MEMBERS + ", error string")


def read_archives(spark: SparkSession, path: str, ending: str | None = None) -> DataFrame:
    """Members of the ZIP files under path; see archive_members()."""
    return archive_members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path), ending)


def source_reference(archive: Column, member: Column) -> Column:
    return F.concat_ws("!/", archive, member)


ENTRY = "member string, status string, source_sha256 string, dpi int, converter_version string, markdown_path string, manifest_path string, duplicate_of string, output_relative_path string"


def parse_manifests(texts: DataFrame) -> DataFrame:
    """archive, member, status, sha256, dpi, version, markdown_path, manifest_path of batch manifests (archive, value: JSON).

    Tolerant: text that isn't such a manifest gives no rows, nor do entries without a member. Of entries of one member the last counts.
    """
    entry = F.posexplode(F.from_json("value", f"source_zip string, entries array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ENTRY.split(','))}>>")["entries"])
    each = texts.select("archive", entry.alias("k", "e")).where("e.member IS NOT NULL AND e.member <> ''")
    last = each.groupBy("archive", F.col("e.member").alias("member")).agg(F.max_by("e", "k").alias("e"))
    return last.select("archive", "member", "e.status", F.col("e.source_sha256").alias("sha256"), "e.dpi", F.col("e.converter_version").alias("version"), "e.markdown_path", "e.manifest_path")


def read_manifests(spark: SparkSession, path: str, archive: Column | None = None) -> DataFrame:
    """parse_manifests() of the files under path; a path that doesn't exist gives an empty table."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        texts = spark.createDataFrame([], "value string")
    return parse_manifests(texts.select((F.input_file_name() if archive is None else archive).alias("archive"), "value"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path: files under a folder; their contents aren't read. A folder that doesn't exist has none."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def is_pdf(content: Column) -> Column:
    return F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))


def read_tokens_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a line that doesn't fit the schema is an error. Blank lines are skipped."""
    return spark.read.schema(TOKENS).option("mode", "FAILFAST").json(path)


def _field(case: Column, first: str, second: str, kind: str) -> Column:
    has = F.array_contains(F.json_object_keys(F.to_json(case)), first)
    return F.when(has, F.try_variant_get(case, f"$.{first}", kind)).otherwise(F.try_variant_get(case, f"$.{second}", kind))


def _texts(case: Column, first: str, second: str, *keys: str) -> Column:
    items = F.coalesce(_field(case, first, second, "array<variant>"), F.array().cast("array<variant>"))
    plain = lambda x: F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in keys], F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")), F.lit(""))
    return F.transform(items, plain)


def parse_cases(documents: DataFrame, column: str = "value") -> DataFrame:
    """Cases of JSON documents: a list, or an object with casos or cases. Keys may be Portuguese or English."""
    root = documents.select(F.parse_json(column).alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.casos", "array<variant>"), F.try_variant_get("v", "$.cases", "array<variant>"))
    each = root.select(F.explode(listed).alias("case"))
    c = F.col("case")
    meta = F.coalesce(F.try_variant_get(c, "$.metadados.artigos_alterados", "array<string>"), F.try_variant_get(c, "$.metadata.altered_articles", "array<string>"))
    ids = ("identificador", "valor", "numero")
    return each.select(
        F.coalesce(_field(c, "identificador_caso", "case_id", "string"), F.lit("desconhecido")).alias("case_id"), _texts(c, "dispositivos_esperados", "headings", *ids).alias("expected"),
        _texts(c, "termos_criticos", "critical_terms", "valor", "termo", "texto").alias("terms"), _texts(c, "remissoes_esperadas", "expected_references", *ids).alias("references"),
        meta.alias("altered"), F.coalesce(_field(c, "texto_observado", "observed_text", "string"), F.lit("")).alias("observed"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_cases(spark.read.text(path, wholetext=True))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments go, tags become spaces, common entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
