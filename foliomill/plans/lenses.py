"""Lenses: projections that give the driver's tables the shape of pages, tokens, graphics and archive members.

Each is one SQL text that Spark and DuckDB both read, so that a query and its check see the same rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf


def div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


TOKENS = f"""SELECT {div("l_orderkey", 256)} AS doc_id, CAST({div("l_orderkey", 16)} % 16 + 1 AS INT) AS page_number, 1 + l_linenumber % 2 AS block_number, 1 AS paragraph_number,
  CAST(l_orderkey % 16 AS INT) AS line_number, l_linenumber AS word_number, CAST(40 + (l_linenumber % 2) * 400 + l_partkey % 30 AS INT) AS lft, CAST((l_orderkey % 16) * 40 + l_suppkey % 5 AS INT) AS tp,
  CAST(40 + l_partkey % 60 AS INT) AS wd, 12 AS ht, CASE WHEN l_linenumber % 7 = 0 THEN '-1' ELSE CAST(CAST(round(l_discount * 1000) AS INT) AS VARCHAR(9)) END AS confidence,
  CASE l_partkey % 11 WHEN 0 THEN 'Art.' WHEN 1 THEN '1' WHEN 2 THEN 'º' WHEN 3 THEN '-' WHEN 4 THEN '(' WHEN 5 THEN 'caput' WHEN 6 THEN ';' WHEN 7 THEN 'II -' WHEN 8 THEN 'lei' WHEN 9 THEN '  ' ELSE 'a)' END AS txt
FROM lineitem"""

GRAPHICS = """WITH p AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS page_number, CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS page_count,
  event_id, event_type, value FROM events)
SELECT doc_id, page_number, page_count, event_id * 2 AS ordinal, event_type AS fingerprint, (event_id % 80) / 100e0 AS x0, (event_id % 70) / 100e0 AS y0, (event_id % 80) / 100e0 + 0.05e0 + (event_id % 11) / 100e0 AS x1,
  (event_id % 70) / 100e0 + 0.1e0 AS y1, CAST(1 + event_id % 2 AS INT) AS image_weight FROM p
UNION ALL SELECT doc_id, page_number, page_count, event_id * 2 + 1, 'footer', CASE WHEN event_id % 97 = 0 THEN 0.5e0 ELSE 0.02e0 END, CASE WHEN event_id % 97 = 0 THEN 0.4e0 ELSE 0.02e0 + (event_id % 3) / 1000e0 END,
  CASE WHEN event_id % 97 = 0 THEN 0.6e0 ELSE 0.12e0 END, CASE WHEN event_id % 97 = 0 THEN 0.5e0 ELSE 0.06e0 END, 1 FROM p"""

VECTORS = f"""SELECT {div("l_orderkey", 16)} AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 ELSE l_discount * 30 END AS width, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 30 ELSE l_quantity * 10 END AS height FROM lineitem"""

MEMBERS = """SELECT CASE WHEN lang = 'en' THEN 'en.zip' ELSE 'more.zip' END AS archive, doc_id AS ordinal, CASE WHEN doc_id % 211 = 0 THEN CAST(2717843456 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS attributes, text,
  CASE WHEN doc_id % 53 = 0 THEN '../up/doc.pdf' WHEN doc_id % 59 = 0 THEN 'C:/doc.pdf' WHEN doc_id % 61 = 0 THEN '/abs/doc.pdf' WHEN doc_id % 67 = 0 THEN concat('Root/', source, '/SAME.pdf')
    ELSE concat('root/', source, '/doc_', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END) END AS member FROM documents"""

#: Files of a result tree: every ending and folder that the package's rule knows, and near misses.
FILES = """SELECT doc_id AS ordinal, concat(CASE doc_id % 7 WHEN 0 THEN 'analise/' WHEN 1 THEN 'ativos/' WHEN 2 THEN 'a/.staging/' WHEN 3 THEN 'Ativos/' WHEN 4 THEN 'b/__pycache__/' WHEN 5 THEN 'x/ativos/y/' ELSE '' END, source, '_', CAST(doc_id AS VARCHAR(20)),
  CASE doc_id % 13 WHEN 0 THEN '.md' WHEN 1 THEN '.CSV' WHEN 2 THEN '.json' WHEN 3 THEN '.jsonl' WHEN 4 THEN '.txt' WHEN 5 THEN '.yaml' WHEN 6 THEN '.yml' WHEN 7 THEN '.log' WHEN 8 THEN '.png' WHEN 9 THEN '.md.tmp' WHEN 10 THEN '' WHEN 11 THEN '.tar.YML' ELSE '.pdf' END) AS path FROM documents"""

#: Lines of made-up law pages: a matrix, its continuation, legal prose, coordinates, plain words, a map title.
LAW = f"""WITH b AS (SELECT {div("p_partkey", 14)} AS doc_id, CAST(p_partkey % 14 AS INT) AS ln, CAST({div("p_partkey", 14)} % 6 AS INT) AS kind, CAST(p_size AS VARCHAR(9)) AS s, CAST(p_partkey AS VARCHAR(20)) AS k, p_partkey, p_name, p_type FROM part)
SELECT doc_id, ln, kind, CASE
  WHEN kind = 0 AND ln = 0 THEN 'QUADRO 1 - PARAMETROS POR ZONA'
  WHEN kind = 0 AND ln = 1 THEN concat(rpad('ZONA', 14, ' '), rpad('USO', 20, ' '), rpad('COEFICIENTE', 16, ' '), rpad('TESTADA', 12, ' '), 'GABARITO')
  WHEN kind = 0 THEN concat(rpad(concat('ZRU', CAST(p_partkey % 7 AS VARCHAR(9))), 14, ' '), rpad('Habitacional', 20, ' '), rpad(concat(s, ',0'), 16, ' '), rpad(s, 12, ' '), '2')
  WHEN kind = 1 AND ln > 10 THEN 'Os recuos, testada, gabarito e lote permanecem.'
  WHEN kind = 1 THEN concat(rpad(concat('ZRU', CAST(p_partkey % 7 AS VARCHAR(9))), 12, ' '), rpad('Misto', 14, ' '), rpad(s, 10, ' '), '10,00')
  WHEN kind = 2 THEN concat('Art. ', s, ' A lei e o decreto da camara municipal revogados no inciso ', k, ';')
  WHEN kind = 3 THEN concat('Vertice ', k, ' X = 25', CAST(1000 + p_partkey % 1000 AS VARCHAR(9)), ',55 Y = 91', CAST(10000 + p_partkey % 1000 AS VARCHAR(9)), ',25 UTM')
  WHEN kind = 4 THEN concat(p_name, ' ', lower(p_type), '.')
  WHEN ln = 0 THEN concat('MAPA ', k, ' - ZONEAMENTO') WHEN ln = 1 AND doc_id % 4 = 1 THEN 'ANEXO DE MAPAS' WHEN ln = 1 THEN 'ESCALA 1:5000' ELSE s END AS line FROM b"""

PAGES = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_number, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS page_count, o_orderkey AS k, o_orderpriority AS priority,
  o_orderstatus AS status, CAST(o_orderkey % 12 AS INT) AS h, CAST(o_orderkey % 9 AS INT) AS v, CAST(o_orderkey % 31 AS INT) AS crossings, CAST(o_orderkey % 5 AS INT) AS regions, CAST(o_custkey % 6 AS INT) AS boxes, (o_orderkey % 70) / 100e0 AS area,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 90 END AS INT) AS characters, CAST(o_orderkey % 3 AS INT) AS raw_images, CAST(CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 3 ELSE 0 END AS INT) AS decorative_images,
  CAST(CASE WHEN o_orderkey % 5 < 2 THEN 0 ELSE o_orderkey % 3 END AS INT) AS content_images,
  CASE o_orderkey % 13 WHEN 0 THEN 'map_confirmed' WHEN 1 THEN 'map_candidate' WHEN 2 THEN 'map_cover' ELSE 'none' END AS map_class,
  CASE o_orderkey % 11 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'candidate' WHEN 2 THEN 'mixed_candidate' WHEN 3 THEN 'visual_candidate' ELSE 'not_table' END AS table_class,
  o_orderkey % 17 = 0 AS coordinate_register, o_orderkey % 17 < 2 AS coordinates_detected, o_orderkey % 19 = 0 AS grid_detected, o_orderkey % 23 = 0 AS rotated FROM orders"""


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the cluster has cores, where its files make fewer; larger tables are left alone and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table, or some columns of it that heavy functions are to run on, spread over all cores."""
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found.select(*columns)) if columns else found


def lens(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=view(spark, sf_dir, table))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"lft": "left", "tp": "top", "wd": "width", "ht": "height", "txt": "text"}
    return lens(spark, sf_dir, TOKENS, "lineitem").withColumnsRenamed(names)


def law_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lens(spark, sf_dir, LAW, "part")
    ordered = F.array_sort(F.collect_list(F.struct("ln", "line")))
    # few bytes, much work per page: a fixed number of partitions, which aren't merged by their size
    lines = lines.repartition(spark.sparkContext.defaultParallelism, "doc_id", "kind")
    return lines.groupBy("doc_id", "kind").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


LAW_PAGES = f"SELECT doc_id, kind, string_agg(line, chr(10) ORDER BY ln) AS text FROM ({LAW}) GROUP BY doc_id, kind"


# --- generated binaries: whole texts of documents as PDF, ZIP, DOCX and EPUB files

PAGE_LINES = 40
#: What a PDF page can hold of a text: tabs, line ends and printable Latin-1.
_NOT_PLAIN = r"[^\x09\x0A\x20-\x7E\xA1-\xFF]"
PLAIN = f"regexp_replace(text, '{_NOT_PLAIN}', '?', 'g')"
#: What XML can't hold.
_CONTROL = r"[\x00-\x08\x0B-\x1F]"
CLEAN = f"regexp_replace(text, '{_CONTROL}', '?', 'g')"


def binary(make: Callable[[int, str], bytes], key: str, text: str) -> Column:
    @F.arrow_udf("binary")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([make(k, t or "") for k, t in zip(keys.to_pylist(), texts.to_pylist())], pa.binary())

    return run(F.col(key), F.col(text))


def _pdf(key: int, text: str) -> bytes:
    lines = text.split("\n")
    pages = []
    for n, at in enumerate(range(0, len(lines), PAGE_LINES), 1):
        page: dict = {"lines": [(50, 780 - 12 * i, x) for i, x in enumerate(lines[at : at + PAGE_LINES])]}
        page["rectangles"] = [(10, 10 + 5 * i, 100, 1) if i % 2 else (10 + 5 * i, 10, 1, 60) for i in range(key % 23)]
        page["images"] = [(10, 10, 20, 20, "logo")] * (key % 2 == 0) + [(200, 300, 200, 200, f"own {key} {n}")] * ((key + n) % 5 == 0)
        pages.append(page)
    return pdf.build(pages)


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/", b"")
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _archive(key: int, text: str) -> bytes:
    raw = text.encode()
    return _zip({"x/notes.txt": raw, "x/law.pdf": b"%PDF-1.4\n" + raw, "x/fake.PDF": raw})


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _docx(key: int, text: str) -> bytes:
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escaped(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{name}"><w:body>{body}</w:body></w:document>'.encode()})


def _epub(key: int, text: str) -> bytes:
    half = text.split("\n")
    parts = [half[: len(half) // 2], half[len(half) // 2 :]]
    chapters = {f"O/c{k}.xhtml": ("<html><head><style>p {}</style></head><body>" + "".join(f"<p>{_escaped(x)}</p>" for x in part) + "</body></html>").encode() for k, part in enumerate(parts)}
    items = "".join(f'<item id="i{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(2))
    package = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine><itemref idref="i1"/><itemref idref="i0"/></spine></package>'
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    return _zip({"META-INF/container.xml": box.encode(), "O/p.opf": package.encode(), **chapters})


def files(spark: SparkSession, sf_dir: str, kind: str, ending: str = "") -> DataFrame:
    """doc_id (the document's number and the ending) and content: each document as a file of that kind."""
    make = {"pdf": _pdf, "zip": _archive, "docx": _docx, "epub": _epub}[kind]
    d = view(spark, sf_dir, "documents", "doc_id", "text").withColumn("plain", F.regexp_replace("text", _NOT_PLAIN if kind == "pdf" else _CONTROL, "?"))
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(ending)).alias("doc_id"), binary(make, "doc_id", "plain").alias("content"))
