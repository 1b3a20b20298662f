"""Command line: diagnose and convert documents, plan and convert batches, gate regression cases, rebuild structure, package results."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import language
from .functions import text as T
from .operators import batch, canary, conversion, diagnosis, raster
from .sources import office, pdf, readers, writers


def _dpi(text: str) -> int:
    value = int(text)
    if not 150 <= value <= 600:
        raise argparse.ArgumentTypeError("the resolution must lie between 150 and 600")
    return value


def _count(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliomill", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, help_: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        p.add_argument("--entrada", required=True)
        p.add_argument("--saida", required=True)
        p.set_defaults(run=run)
        return p

    command("diagnosticar", diagnose, "diagnosis of PDF files as JSON")
    command("converter", convert, "PDF files to Markdown and manifests").add_argument("--dpi", type=_dpi, default=300)
    p = command("converter-lote", convert_batch, "PDF files of ZIP archives to Markdown and manifests")
    p.add_argument("--dpi", type=_dpi, default=300)
    p.add_argument("-n", "--documentos", type=_count, default=0, help="most PDF files to take; 0 takes all")
    p.add_argument("--retomar", action=argparse.BooleanOptionalAction, default=False, help="leave alone what an earlier run finished")
    p.add_argument("--remover-raiz-comum", action=argparse.BooleanOptionalAction, default=True, dest="raiz", help="drop a folder that all files share")
    p.add_argument("--manter-raiz-comum", action="store_false", dest="raiz", help="keep it")
    p.add_argument("--nao-retomar", action="store_false", dest="retomar", help="do everything again")
    command("validar-canario", gate, "regression cases; fails with exit code 1")
    command("reconstruir-estrutura", rebuild, "blocks from OCR tokens")
    command("empacotar-analise", package, "ZIP of the text results")
    p = command("converter-pasta", convert_folder, "PDF, DOCX and EPUB files to Markdown by language")
    p.add_argument("--idiomas", nargs="*", help="languages to keep, as pt en fr")
    p.add_argument("--limite", type=_count, default=0)
    p.add_argument("--reprocessar", action="store_true", help="also what was converted before")
    p.add_argument("--dry-run", action="store_true", dest="dry", help="say what would be done")
    p.add_argument("--forcar-ocr", action="store_true", dest="forcar", help="recognise every PDF page")
    return out


def _documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def _parse() -> Callable:
    return readers.ADAPTERS.get("pdf", pdf.parse_pages)


def diagnose(spark: SparkSession, a: argparse.Namespace) -> int:
    documents = _documents(spark, a.entrada)
    found = diagnosis.document_records(pdf.pdf_pages(documents, _parse()), documents)
    name = F.concat(conversion.document_stem(F.col("doc_id")), F.lit(".diagnostico.json"))
    writers.write_files(writers.manifest_files(found, name), a.saida)
    return 0


def staged(df: DataFrame, target: str, name: str) -> DataFrame:
    """df written beside the target and read back: what follows neither plans nor runs it again."""
    path = f"{target.rstrip('/')}{batch.STAGING}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}{batch.STAGING}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def evidence(spark: SparkSession, documents: DataFrame, parsed: DataFrame, dpi: int, target: str, every_page: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Pages with OCR and raster evidence where adapters are there, and the OCR tokens."""
    diagnosed = staged(diagnosis.diagnose(parsed), target, "diagnosis")
    wanted = diagnosed.where(F.lit(every_page) | F.col("route").isin("ocr", "map")).select("doc_id", "page_number", "page_count", "route").join(documents, "doc_id")
    tokens = measured = recognised = None
    if "ocr" in readers.ADAPTERS:
        tokens = staged(readers.ocr_tokens(readers.recognise(wanted.where(F.lit(every_page) | (F.col("route") == "ocr")), readers.ADAPTERS["ocr"], dpi)), target, "tokens")
        seen = readers.recognised_pages(tokens)
        # a page on which nothing was recognised has been recognised all the same
        recognised = wanted.where("route = 'ocr'").select("doc_id", "page_number").join(seen, ["doc_id", "page_number"], "left").withColumns({"text": F.coalesce("text", F.lit("")), "confidences": F.coalesce("confidences", F.array().cast("array<double>"))})
    if "render" in readers.ADAPTERS:
        images = readers.page_images(wanted, readers.ADAPTERS["render"], min(150, dpi))
        measured = images.select("doc_id", "page_number", raster.metrics(F.col("height"), F.col("width"), F.col("data")).alias("m"))
    return staged(conversion.with_evidence(diagnosed, recognised, measured), target, "evidence"), tokens


def convert_documents(spark: SparkSession, documents: DataFrame, target: str, dpi: int) -> DataFrame:
    """Convert documents (doc_id, content) and publish them under target; doc_id, status (success or failed), error of each.

    A document that can't be opened, or that needs OCR where no engine is registered, fails; the others are published all the same.
    """
    parsed = staged(pdf.pdf_pages(documents, _parse()), target, "pages")
    found, tokens = evidence(spark, documents, parsed, dpi, target)
    broken = parsed.where("page_number IS NULL").select("doc_id", "error")
    unread = conversion.missing_ocr(found).select("doc_id", F.concat(F.lit("no OCR engine is registered for pages "), F.array_join(F.col("pages").cast("array<string>"), ", ")).alias("error"))
    failed = broken.union(unread)
    good = found.join(failed.select("doc_id"), "doc_id", "left_anti")
    pages = staged(conversion.convert(good), target, "converted")
    made = staged(conversion.published(conversion.manifests(pages, dpi, __version__)), target, "manifests")
    hashes = documents.select("doc_id", F.sha2("content", 256).alias("source_sha256"))
    writers.publish(made.join(hashes, "doc_id").withColumn("source_path", F.col("doc_id")), target)
    if tokens is not None:
        lines = writers.token_lines(tokens).select(F.concat(F.lit("analise/"), conversion.document_stem(F.col("doc_id")), F.lit(".ocr_tokens.jsonl")).alias("path"), "value")
        writers.write_files(lines, target)
        blocks = writers.block_records(writers.structure_of(tokens))
        order = F.array_sort(F.collect_list(F.struct("pagina", "ordem", writers.manifest_json(*[c for c in blocks.columns if c != "doc_id"]).alias("value"))))
        files = blocks.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["value"]), "\n").alias("value"))
        writers.write_files(files.select(F.concat(F.lit("analise/"), conversion.document_stem(F.col("doc_id")), F.lit(".estrutura_ocr.jsonl")).alias("path"), "value"), target)
    outcome = documents.select("doc_id").join(failed.groupBy("doc_id").agg(F.first("error").alias("error")), "doc_id", "left").withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
    known = [(r["doc_id"], r["error"], r["status"]) for r in outcome.toLocalIterator()]  # a line per file
    unstage(spark, target)
    return spark.createDataFrame(known, "doc_id string, error string, status string")


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    done = convert_documents(spark, _documents(spark, a.entrada), a.saida, a.dpi).where("status = 'failed'").collect()
    for r in done:
        print(f"{r['doc_id']}: {r['error']}")
    return int(bool(done))


def batch_manifest(plan: DataFrame, outcomes: DataFrame, dpi: int, limit: int, resume: bool, root: bool) -> DataFrame:
    """One row per archive: counts, status, entries and ignored entries, as of the plan and the outcomes (archive, member, status, error, sha256) of what was converted."""
    c = F.col
    d = plan.join(outcomes.select("archive", "member", c("status").alias("_now"), c("error").alias("_error"), "sha256"), ["archive", "member"], "left")
    d = d.withColumn("status", F.when(c("status") == "to_convert", F.coalesce("_now", F.lit("failed"))).otherwise(c("status")))
    stem = F.regexp_replace("output_path", r"\.[^./]*$", "")
    folder = F.regexp_replace(stem, "[^/]*$", "")
    done = c("status").isin("success", "resumed")
    entry = F.struct(
        F.when(c("position").isNull(), c("member")).otherwise(batch.clean_path(c("member"))).alias("member"), c("output_path").alias("output_relative_path"), F.when(c("status") == "resumed", "success").otherwise(c("status")).alias("status"), c("sha256").alias("source_sha256"), F.lit(dpi).alias("dpi"),
        F.lit(__version__).alias("converter_version"), "duplicate_of", F.when(done, F.concat(folder, F.lit("analise/"), F.regexp_extract(stem, "[^/]*$", 0), F.lit(".md"))).alias("markdown_path"),
        F.when(done, F.concat(stem, F.lit(".manifest.json"))).alias("manifest_path"), c("_error").alias("error"), F.when(c("status") == "resumed", F.lit(True)).alias("resumed_without_processing"),
    )
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.coalesce("position", F.lit(0)).alias("k"), entry.alias("e"))))), lambda x: x["e"])
    listed = d.groupBy("archive").agg(ordered(~c("status").isin("ignored", "pending")).alias("entries"), ordered(c("status") == "ignored").alias("ignored_entries"))
    whole = batch.batch_counts(d).join(listed, "archive").withColumnsRenamed({"final_status": "status", "skipped_count": "skipped_non_pdf_count"})
    return whole.withColumns({
        "source_zip": c("archive"), "dpi": F.lit(dpi), "converter_version": F.lit(__version__), "document_limit": F.lit(limit), "resume_enabled": F.lit(resume), "common_root_removed": F.lit(root), "directory_policy": F.lit("mirror_zip_structure"),
        "processed_count": c("success_count") + c("duplicate_count") + c("failure_count"),
    }).drop("archive", "to_convert_count")


def manifest_name(archive):
    return F.concat(conversion.document_stem(archive), F.lit(".lote.manifest.json"))


def convert_batch(spark: SparkSession, a: argparse.Namespace) -> int:
    members = readers.read_archives(spark, a.entrada, ".pdf").withColumns({"sha256": F.sha2("content", 256), "signed": readers.is_pdf(F.col("content"))})
    broken = members.where("member IS NULL").select("archive", "error").collect()
    for r in broken:
        print(f"{r['archive']}: {r['error']}")
    members = members.where("member IS NOT NULL")
    previous = None
    if a.retomar:
        archives = members.select("archive").distinct().withColumn("name", manifest_name(F.col("archive")))
        name = F.regexp_extract(F.input_file_name(), "[^/]+$", 0)
        old = readers.read_manifests(spark, f"{a.saida}/*.lote.manifest.json", name).withColumnRenamed("archive", "name")
        base = writers._local(os.path.abspath(a.saida) if "://" not in a.saida and not a.saida.startswith("file:") else a.saida).rstrip("/")
        there = readers.listing(spark, a.saida).select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "").alias("path"))
        previous = batch.whole_entries(old.join(archives, "name"), there).select("archive", "member", "status", "sha256", "dpi", "version")
    plan = batch.plan_batch(members.drop("content", "size", "error"), previous, a.documentos, a.dpi, __version__, a.raiz)
    chosen = plan.where("status = 'to_convert'").join(members.select("archive", "member", "content", "sha256"), ["archive", "member"])
    chosen = chosen.withColumn("doc_id", readers.source_reference(F.col("archive"), F.col("member")))
    outcomes = None
    folders = [r["folder"] for r in chosen.select(F.regexp_replace("output_path", "[^/]*$", "").alias("folder")).distinct().toLocalIterator()]
    for folder in folders:
        own = chosen.where(F.regexp_replace("output_path", "[^/]*$", "") == folder)
        done = convert_documents(spark, own.select("doc_id", "content"), f"{a.saida}/{folder}".rstrip("/"), a.dpi).join(own.select("doc_id", "archive", "member", "sha256"), "doc_id")
        outcomes = done if outcomes is None else outcomes.union(done)
    if outcomes is None:
        outcomes = spark.createDataFrame([], "doc_id string, error string, status string, archive string, member string, sha256 string")
    whole = batch_manifest(plan, outcomes, a.dpi, a.documentos, a.retomar, a.raiz)
    writers.write_files(writers.manifest_files(whole, manifest_name(F.col("source_zip"))), a.saida)
    for r in whole.select("source_zip", "pdf_count", "success_count", "duplicate_count", "failure_count", "skipped_non_pdf_count", "pending_count", "status").toLocalIterator():
        print("; ".join(f"{k} {v}" for k, v in r.asDict().items()))
    return int(bool(broken) or not whole.where("failure_count > 0").isEmpty())


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    results = canary.evaluate(readers.read_cases(spark, a.entrada))
    writers.write_report(results, f"{a.saida}/analise")
    return int(not canary.summary(results).first()["suite_passed"])


def rebuild(spark: SparkSession, a: argparse.Namespace) -> int:
    writers.write_blocks_jsonl(writers.structure_of(readers.read_tokens_jsonl(spark, a.entrada)), a.saida)
    return 0


def package(spark: SparkSession, a: argparse.Namespace) -> int:
    writers.write_package(spark, a.entrada, a.saida)
    return 0


def convert_folder(spark: SparkSession, a: argparse.Namespace) -> int:
    files = _documents(spark, a.entrada, "*.{pdf,docx,epub,PDF,DOCX,EPUB}")
    if not a.reprocessar:
        try:
            files = files.join(spark.read.json(f"{a.saida}/bucket=*").select("doc_id"), "doc_id", "left_anti")
        except Exception as missing:  # noqa: BLE001 - the first run has no results yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if a.limite:
        files = files.orderBy("doc_id").limit(a.limite)
    is_pdf_name = F.lower("doc_id").endswith(".pdf")
    native, _ = evidence(spark, files.where(is_pdf_name), pdf.pdf_pages(files.where(is_pdf_name), _parse()), 300, a.saida, a.forcar)
    shown = F.coalesce(F.when(F.lit(a.forcar), F.col("ocr_text")), F.when(F.col("text") != "", F.col("text")), F.col("ocr_text"), F.lit(""))
    each = native.select("doc_id", "page_number", F.concat(F.lit("### Página "), F.col("page_number").cast("string"), F.lit("\n\n"), T.strip(shown)).alias("chunk"))
    from_pdf = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("text"))
    texts = from_pdf.union(office.office_text(files.where(~is_pdf_name)).where("error IS NULL").select("doc_id", "text")).withColumn("l", language.language(F.col("text")))
    if a.idiomas:
        texts = texts.where(F.col("l.language").isin(*a.idiomas))
    if a.dry:
        texts.select("doc_id", "l.language", "l.probability").show(1000, False)
        return 0
    name = F.element_at(F.split("doc_id", "/"), -1)
    head = F.concat(F.lit("<!-- arquivo_original: "), name, F.lit(" -->\n<!-- idioma_detectado: "), F.col("l.language"), F.lit(" ("), F.format_string("%.2f", "l.probability"), F.lit(") -->\n\n"))
    unstaged = texts.select("doc_id", F.col("l.language").alias("language"), F.concat(head, T.strip(F.col("text"))).alias("markdown"))
    writers.write_by_language(staged(unstaged, a.saida, "texts"), a.saida)
    unstage(spark, a.saida)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
