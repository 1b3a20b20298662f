"""Plan of a batch of archive members: what is rejected, ignored, pending, a copy, done already, or to be converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_path(member: Column) -> Column:
    """Path with forward slashes, without empty and '.' parts."""
    parts = F.filter(F.split(F.replace(member, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def is_unsafe(member: Column) -> Column:
    """Absolute, empty, climbing, or with a drive letter."""
    p = F.replace(member, F.lit("\\"), F.lit("/"))
    return p.startswith("/") | (clean_path(member) == "") | F.array_contains(F.split(p, "/"), "..") | p.rlike("^[A-Za-z]:")


def is_link(attributes: Column) -> Column:
    return F.shiftright(attributes, 16).bitwiseAND(F.lit(0o170000)) == F.lit(0o120000)


STAGING = ".staging"


def is_packed(path: Column) -> Column:
    """Whether a file (path relative to the tree's root) belongs in the analysis package: text results, outside of image and working folders.

    Endings count in any case, folder names as they are.
    """
    extension = F.lower(F.regexp_extract(path, r"[^./](\.[^./]+)$", 1))
    folders = F.array(*[F.lit(x) for x in ("ativos", STAGING, "__pycache__")])
    return extension.isin(".md", ".json", ".jsonl", ".csv", ".txt", ".yaml", ".yml") & ~F.arrays_overlap(F.split(path, "/"), folders)


def is_finished(dpi: int, version: str | None = None, status: str = "status", made_with: str = "dpi", made_by: str = "version") -> Column:
    """Whether an entry of an earlier manifest ended well, at this resolution and with this version."""
    c = F.col
    same = c(status).isin("success", "duplicate") & (c(made_with) == dpi)
    return F.coalesce(same if version is None else same & (c(made_by) == version), F.lit(False))


def whole_entries(previous: DataFrame, files: DataFrame) -> DataFrame:
    """previous (of readers.parse_manifests) without entries of status success whose Markdown or manifest isn't among files (path)."""
    there = files.select("path").distinct()
    for name in ("markdown_path", "manifest_path"):
        own = there.select(F.col("path").alias(name), F.lit(True).alias(f"_{name}"))
        previous = previous.join(own, name, "left")
    kept = (F.col("status") != "success") | (F.col("_markdown_path") & F.col("_manifest_path"))
    return previous.where(F.coalesce(kept, F.lit(False))).drop("_markdown_path", "_manifest_path")


def plan_batch(members: DataFrame, previous: DataFrame | None = None, limit: int = 0, dpi: int = 300, version: str = "1", strip_root: bool = True) -> DataFrame:
    """member, output_path, status, duplicate_of, position of every member of one archive per archive column.

    members: archive, member, ordinal, attributes, sha256, and signed (whether the content begins as a PDF; taken as true where the column is
    absent). previous: archive, member, status, sha256, dpi, version. Status is rejected, ignored, pending, failed (path taken by an
    earlier member, or no PDF after all), resumed, duplicate or to_convert. Members equal in content are copies of the first that is to be converted.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    c = F.col
    d = members.withColumns({"path": clean_path(c("member")), "_unsafe": is_unsafe(c("member")), "_signed": F.coalesce(c("signed"), F.lit(False)) if "signed" in members.columns else F.lit(True)})
    d = d.withColumn("_pdf", ~c("_unsafe") & F.lower("path").endswith(".pdf"))
    order = Window.partitionBy("archive", "_pdf").orderBy(F.lower("path"), "ordinal")
    whole = Window.partitionBy("archive", "_pdf")
    folders = F.split("path", "/")
    root = F.lower(F.get(folders, F.lit(0)))
    one_root = F.lit(strip_root) & (F.min(root).over(whole) == F.max(root).over(whole)) & (F.min(F.size(folders)).over(whole) > 1)
    d = d.withColumns({"position": F.row_number().over(order), "_count": F.count("*").over(whole), "_root": one_root})
    output = F.when(c("_root"), F.array_join(F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(1))), "/")).otherwise(c("path"))
    d = d.withColumns({"output_path": F.when(c("_pdf"), output), "_late": F.lit(limit > 0) & (c("position") > limit)})
    d = d.withColumn("_taken", F.row_number().over(Window.partitionBy("archive", "_pdf", F.lower("output_path")).orderBy("position")) > 1)
    done = F.lit(False)
    if previous is not None:
        old = previous.select("archive", c("member").alias("path"), c("status").alias("_status"), c("sha256").alias("_sha"), c("dpi").alias("_dpi"), c("version").alias("_version"))
        d = d.join(old, ["archive", "path"], "left")
        done = is_finished(dpi, version, "_status", "_dpi", "_version") & F.coalesce(c("_sha") == c("sha256"), F.lit(False))
    early = (
        F.when(c("_unsafe"), "rejected").when(~c("_pdf"), "ignored").when(c("_late"), "pending").when(c("_taken"), "failed").when(is_link(c("attributes")), "rejected").when(~c("_signed"), "failed").when(done, "resumed")
    )
    d = d.withColumn("_early", early)
    d = d.withColumn("_open", c("_early").isNull())
    first = F.first("path").over(Window.partitionBy("archive", "_open", "sha256").orderBy("position"))
    d = d.withColumn("_first", first)
    copied = c("_open") & (c("_first") != c("path"))
    return d.select(
        "archive", "member", "output_path", F.coalesce("_early", F.when(copied, "duplicate").otherwise("to_convert")).alias("status"), F.when(copied, c("_first")).alias("duplicate_of"), F.when(c("_pdf"), c("position")).alias("position"),
        F.when(c("_pdf"), F.least(c("_count"), F.lit(limit if limit else 2**62)).cast("int")).alias("selected"),
    )


def batch_counts(plan: DataFrame) -> DataFrame:
    """Counters of each archive and its final status. What is still to be converted counts apart from what is done."""
    pdf = F.col("position").isNotNull()
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    d = plan.groupBy("archive").agg(
        F.count_if(pdf).alias("pdf_count"), n("success", "resumed").alias("success_count"), n("to_convert").alias("to_convert_count"), n("rejected", "failed").alias("failure_count"), n("ignored").alias("skipped_count"),
        n("duplicate").alias("duplicate_count"), n("pending").alias("pending_count"),
    )
    return d.withColumn("final_status", F.when(F.col("failure_count") > 0, "completed_with_failures").when(F.col("pending_count") > 0, "completed_with_limit").when(F.col("to_convert_count") > 0, "running").otherwise("completed"))
