"""Text of DOCX and EPUB files, which are archives of XML: the standard library is enough."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs that hold more than white space, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    body = root.find(f"{_WORD}body")
    paragraphs = []
    for p in body.findall(f"{_WORD}p") if body is not None else []:
        paragraphs.append("".join(x.text or "" if x.tag == f"{_WORD}t" else marks.get(x.tag, "") for x in p.iter()))
    return "\n\n".join(x for x in paragraphs if x.strip())


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_text(raw: bytes) -> str:
    """Text of the chapters in the order of the package's spine, pieces on lines of their own, a blank line between chapters."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.attrib["full-path"] for x in box.iter() if _local(x.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(package))
        items = {x.attrib["id"]: x.attrib for x in root.iter() if _local(x.tag) == "item"}
        spine = [items[x.attrib["idref"]] for x in root.iter() if _local(x.tag) == "itemref" and x.attrib.get("idref") in items]
        chapters = [x for x in spine or items.values() if x.get("media-type") in ("application/xhtml+xml", "text/html")]
        out = []
        for item in chapters:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(item["href"])))
            if name in names:
                seen = _Visible()
                seen.feed(z.read(name).decode("utf-8", "replace"))
                out.append("\n".join(seen.parts))
    return "\n\n".join(out)


READERS = {".docx": docx_text, ".epub": epub_text}


def office_text(documents: DataFrame) -> DataFrame:
    """doc_id, text, error of documents (doc_id, content) whose name ends in .docx or .epub; another ending, or a damaged file, gives its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("error", pa.string())])
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                read = READERS.get(posixpath.splitext(name or "")[1].lower())
                try:
                    row = {"text": read(raw.as_py() or b"")} if read else {"error": "unsupported format"}
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as failure:
                    row = {"error": f"{type(failure).__name__}: {failure}"}
                yield pa.RecordBatch.from_pylist([{"doc_id": name} | row], schema)

    return documents.selectExpr("CAST(doc_id AS STRING) AS doc_id", "content").mapInArrow(run, "doc_id string, text string, error string")
