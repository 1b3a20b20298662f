"""Sinks: published files (Markdown, manifests, images), token and block lines, case reports, and the analysis package.

Tables are written by Spark's committers. Single files (one per document) are written by executors under a temporary name and renamed, so that a
reader never sees half a file and a task that runs again replaces its own work; their folder must be one that all executors share.
"""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import conversion, structure
from ..operators.batch import is_packed
from .readers import listing


def _local(path: str) -> str:
    """A folder as the operating system names it."""
    return path.removeprefix("file://").removeprefix("file:")


def utc_now() -> Column:
    """The time as ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def manifest_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def stamped(manifests: DataFrame) -> DataFrame:
    """manifests with generated_at, kept where a row has one, and updated_at."""
    kept = F.coalesce("generated_at", utc_now()) if "generated_at" in manifests.columns else utc_now()
    return manifests.withColumns({"generated_at": kept, "updated_at": utc_now()})


def write_files(files: DataFrame, root: str) -> None:
    """Write files (path, relative to root; value: string or binary) one by one, each whole or not at all."""
    base = _local(root)

    def write(rows: Iterable) -> None:
        for r in rows:
            target = Path(base, r["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            temporary = target.with_name(f"{target.name}.{os.getpid()}.tmp")
            temporary.write_bytes(bytes(r["value"]) if isinstance(r["value"], (bytes, bytearray)) else r["value"].encode())
            os.replace(temporary, target)

    files.select("path", "value").foreachPartition(write)


def indented(value: Column) -> Column:
    """JSON text laid out with two spaces."""

    @F.udf("string", useArrow=True)
    def lay_out(text: str) -> str:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2) if text is not None else None

    return lay_out(value)


def manifest_files(manifests: DataFrame, path: Column) -> DataFrame:
    """path, value of one JSON file per row, with null fields, two spaces of indent and both times."""
    whole = stamped(manifests.withColumn("_path", path))
    fields = [c for c in whole.columns if c != "_path"]
    return whole.select(F.col("_path").alias("path"), indented(manifest_json(*fields)).alias("value"))


def publish(manifests: DataFrame, root: str, images: DataFrame | None = None) -> None:
    """Write what conversion.published() says: Markdown and manifest under analise/, the manifest again at the root, images under ativos/.

    images: path (relative to root), value. Earlier files of the same names are replaced.
    """
    c = F.col
    own = manifests.drop("markdown", "stem", "compatibility_manifest")
    write_files(manifests.select(c("markdown_path").alias("path"), c("markdown").alias("value")), root)
    write_files(manifest_files(own, c("manifest_path")), root)
    at_root = manifests.select("doc_id", "compatibility_manifest").join(own, "doc_id")
    write_files(manifest_files(at_root.drop("compatibility_manifest"), F.concat(conversion.document_stem(c("doc_id")), F.lit(".manifest.json"))), root)
    if images is not None:
        write_files(images, root)


def token_lines(tokens: DataFrame) -> DataFrame:
    """doc_id, value: the OCR tokens of each document as lines of JSON, distinct, in page and reading order."""
    fields = ["page_number", "block_number", "paragraph_number", "line_number", "word_number", "left", "top", "width", "height", "text", "confidence"]
    lines = tokens.select("doc_id", *fields).distinct().withColumn("value", manifest_json(*fields))
    ordered = F.array_sort(F.collect_list(F.struct(*fields[:6], "value")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))


PORTUGUESE = {
    "page_number": "pagina", "block_order": "ordem", "column_number": "coluna", "block_number": "bloco_origem", "paragraph_number": "paragrafo_origem", "block_type": "tipo_predominante", "text": "texto",
    "confidence": "confianca_media", "line_count": "quantidade_linhas", "left": "esquerda", "top": "topo", "right": "direita", "bottom": "base",
}


def block_records(blocks: DataFrame) -> DataFrame:
    """blocks with the names of the structure file: one block per record, its lines nested as linhas, tipo_registro always bloco_ocr."""
    named = [F.col(a).alias(b) for a, b in PORTUGUESE.items()]
    lines = F.transform("lines", lambda x: F.struct(x["line_order"].alias("ordem"), x["text"].alias("texto"), x["line_type"].alias("tipo"), x["confidence"].alias("confianca_media"), x["left"].alias("esquerda"), x["top"].alias("topo")))
    return blocks.select("doc_id", *named, lines.alias("linhas"), F.lit("bloco_ocr").alias("tipo_registro"))


def write_tokens_jsonl(tokens: DataFrame, path: str) -> None:
    """Tokens as JSON lines, a document's in one partition and in order; no global sort."""
    order = ["doc_id", "page_number", "block_number", "paragraph_number", "line_number", "word_number"]
    tokens.distinct().repartition("doc_id").sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_blocks_jsonl(blocks: DataFrame, path: str) -> None:
    block_records(blocks).repartition("doc_id").sortWithinPartitions("doc_id", "pagina", "ordem").write.mode("overwrite").json(path)


def structure_of(tokens: DataFrame) -> DataFrame:
    return structure.blocks(structure.assign_columns(structure.token_lines(structure.read_tokens(tokens))))


REPORT = ("resultados_canario", "canary_results")


def report(results: DataFrame) -> DataFrame:
    """One row: the JSON report of a suite with its schema version, totals and results in order of their case."""
    c = F.col
    each = F.array_sort(F.collect_list(F.struct(*results.columns)))
    d = results.agg(F.count("*").alias("total_casos"), F.count_if("passed").alias("casos_aprovados"), F.count_if(~c("passed")).alias("casos_reprovados"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("aprovado"), each.alias("resultados"))
    return d.select(manifest_json(*["versao_esquema", *d.columns]).alias("value")) if "versao_esquema" in d.columns else d.withColumn("versao_esquema", F.lit("2.0")).select(manifest_json("versao_esquema", *d.columns).alias("value"))


def write_report(results: DataFrame, path: str) -> None:
    """JSON report and CSV table of case results, under their names and the names of earlier versions; arrays are joined by '|' in the CSV."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    whole = report(results)
    for name in REPORT:
        write_files(whole.select(F.lit(f"{name}.json").alias("path"), indented(F.col("value")).alias("value")), path)
        results.select(*flat).orderBy("case_id").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}_csv")


def package_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """relative: files (path) that go in the analysis package, in order. root: the folder that paths are taken relative to."""
    base = _local(root).rstrip("/") + "/" if root else ""
    clean = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(F.startswith(clean, F.lit(base)), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean) if base else F.col("path")
    return files.select(relative.alias("relative")).where(is_packed(F.col("relative"))).orderBy("relative")


def write_package(spark, root: str, target: str) -> str:
    """A ZIP of the text results under root, without images and working folders, and without itself.

    A ZIP is one file, so one process writes it: names come as an iterator, and files are copied piece by piece.
    """
    base, out = Path(_local(root)).resolve(), Path(_local(target)).resolve()
    out.parent.mkdir(parents=True, exist_ok=True)
    temporary = out.with_name(out.name + ".tmp")
    names: Iterator[str] = (r["relative"] for r in package_files(listing(spark, str(base)), str(base)).toLocalIterator())
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            if base / name not in (out, temporary):
                z.write(base / name, name)
    os.replace(temporary, out)
    return str(out)


def write_by_language(texts: DataFrame, path: str) -> None:
    """texts (doc_id, language, markdown) under a folder per language: pt, en, outros. Originals are never moved."""
    from ..functions.language import bucket

    texts.withColumn("bucket", bucket(F.col("language"))).write.mode("overwrite").partitionBy("bucket").json(path)
