"""From files to published results: PDF pages, diagnosis, conversion, batches, sinks and the command line."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliomill import cli
from foliomill.functions import language, metrics
from foliomill.functions import text as T
from foliomill.operators import batch, conversion, diagnosis, graphics, pages, raster, structure
from foliomill.sources import office, pdf, readers, writers
from foliomill.streaming import ingest

c = F.col


def files(spark, *raw):
    return spark.createDataFrame([(f"d{i}.pdf", x) for i, x in enumerate(raw)], "doc_id string, content binary")


def page(*lines, **more):
    return {"lines": [(72, 720 - 14 * i, x) for i, x in enumerate(lines)]} | more


LAW = "Artigo 1 Teste normativo municipal com texto suficiente para a rota nativa"


def test_a_line_of_any_length_is_diagnosed(spark):
    """a repeated group in the pattern of cells took a frame of the stack for each word."""
    line = "palavra " * 30000 + "  fim"
    (found,) = spark.createDataFrame([(line,)], "t string").select(pages.cell_starts(c("t")).alias("s")).collect()
    assert found["s"] == [0, len(line) - 3]
    (found,) = diagnosis.diagnose(pdf.pdf_pages(files(spark, pdf.build([page(line)])))).select("route", "page_type", "characters").collect()
    assert tuple(found) == ("native", "text", len(line) - 2)


def test_images_of_different_keys_differ(spark):
    """written with one byte of their key's hash, the images "logo" and "own 444 1" were the same."""
    keys = ["logo", "own 444 1", *(f"own {i} {j}" for i in range(60) for j in range(10))]
    (found,) = pdf.parse_pages(pdf.build([page(images=[(i % 20 * 20, i // 20 * 20, 10, 10, k) for i, k in enumerate(keys)])]))
    assert len({g["fingerprint"] for g in found["graphics"]}) == len(keys) == found["image_count"]
    d = diagnosis.image_counts(pdf.pdf_pages(files(spark, pdf.build([page(images=[(10, 10, 20, 20, "logo"), (200, 300, 200, 200, "own 444 1")])]))))
    assert [(r["raw_images"], r["content_images"]) for r in d.collect()] == [(2, 2)]


def test_a_line_of_any_length_is_converted(spark, tmp_path):
    """conversion failed with the diagnosis. The step between them is a written table, as on the command line."""
    line = "palavra " * 30000 + "  fim"
    diagnosis.diagnose(pdf.pdf_pages(files(spark, pdf.build([page(line)])))).write.parquet(f"{tmp_path}/diagnosed")
    conversion.with_evidence(spark.read.parquet(f"{tmp_path}/diagnosed")).write.parquet(f"{tmp_path}/evidence")
    (made,) = conversion.manifests(conversion.convert(spark.read.parquet(f"{tmp_path}/evidence"))).collect()
    assert made["review_pages"] == [] and made["markdown"].count("palavra") == 30000 and made["markdown_size_bytes"] == len(made["markdown"].encode())


def test_reader_takes_what_writers_make(spark):
    packed = zlib.compress(b"BT /F1 12 Tf 1 0 0 1 72 720 Tm [(Ol) -20 (\xe1) -400 (mundo)] TJ T* (fim\\051 \\(x\\)) ' ET q 20 0 0 20 5 5 cm /Im1 Do Q BI /W 1 ID xx EI 1 2 30 4 re")
    raw = (
        b"junk\n%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents [4 0 R] /Resources << /Font << /F1 << /Subtype /Type1 /Encoding /WinAnsiEncoding >> >> /XObject << /Im1 5 0 R >> >> >> endobj\n"
        b"4 0 obj << /Filter /FlateDecode /Length 6 0 R >> stream\n" + packed + b"\nendstream endobj\n"
        b"5 0 obj << /Subtype /Form /BBox [0 0 1 1] /Resources << /XObject << /A 7 0 R /B 5 0 R >> >> /Length 0 >> stream\n\nendstream endobj\n"
        b"6 0 obj " + str(len(packed)).encode() + b" endobj 7 0 obj << /Subtype /Image /Width 1 /Height 1 /Length 1 >> stream\nx\nendstream endobj"
    )
    (found,) = pdf.parse_pages(raw)
    assert found["simple_text"] == "Olá mundo\nfim) (x)" or found["simple_text"].replace("\n", " ") == "Olá mundo fim) (x)"
    assert found["image_count"] == 1 and found["rectangles"] == [{"width": 30.0, "height": 4.0}] and found["graphics"][0]["image_weight"] == 1
    seen = []
    reader = pdf.Pdf(raw)
    pdf.draw(reader, reader.pages()[0], lambda op, operands, matrix: seen.append(op))
    assert {"BT", "TJ", "Do", "re"} <= set(seen)
    turned = pdf.parse_pages(pdf.build([page("normal")]).replace(b"", b""))[0]
    assert turned["messages"] == []


def test_rotated_text_is_told(spark):
    raw = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << /Length 60 >> stream\nBT /F1 12 Tf 0 1 -1 0 100 100 Tm (texto virado na pagina) Tj ET      \nendstream endobj"
    (found,) = pdf.parse_pages(raw)
    assert found["layout_text"] == "" and found["simple_text"] == "texto virado na pagina" and found["messages"] == [pdf.ROTATED]


def test_damaged_and_odd_files_give_rows(spark):
    found = pdf.pdf_pages(files(spark, b"no pdf", None, b"%PDF-1.4\n", pdf.build([{}]))).collect()
    by = {r["doc_id"]: r for r in found}
    assert by["d0.pdf"]["error"] and by["d1.pdf"]["error"] and "d2.pdf" not in by and by["d3.pdf"]["page_count"] == 1
    assert pdf.pdf_pages(files(spark).limit(0)).count() == 0


def test_diagnosis(spark):
    grid = [(0, 10 * i, 200, 1) for i in range(12)] + [(10 * i, 0, 1, 100) for i in range(9)]
    logo = {"images": [(10, 10, 20, 20, "logo")]}
    raw = [
        pdf.build([page(LAW)]), pdf.build([{"width": 200, "height": 200}]), pdf.build([page(LAW, rectangles=grid)]),
        pdf.build([page(LAW + f" pagina {k}", **logo) for k in range(7)] + [logo]), pdf.build([page("Mapa 01 de zoneamento. Legenda. Escala", images=[(50, 50, 400, 400, "m")])]),
        pdf.build([page(*[f"V{i}  X = 2500{i},10 Y = 9100{i},20 UTM vertice" for i in range(6)])]),
    ]
    d = {(r["doc_id"], r["page_number"]): r for r in diagnosis.diagnose(pdf.pdf_pages(files(spark, *raw))).collect()}
    assert d["d0.pdf", 1]["route"] == "native" and d["d0.pdf", 1]["page_type"] == "text" and d["d0.pdf", 1]["table_assessment"] is None
    assert d["d1.pdf", 1]["route"] == "ocr" and "pagina sem texto ou imagem detectavel" in d["d1.pdf", 1]["warnings"]
    assert d["d2.pdf", 1]["page_type"] == "table_candidate" and d["d2.pdf", 1]["table_assessment"]["classification"] == "visual_candidate"
    assert d["d3.pdf", 8]["page_type"] == "back_cover" and d["d3.pdf", 3]["content_images"] == 0 and d["d3.pdf", 3]["decorative_images"] == 1
    assert d["d4.pdf", 1]["route"] == "map" and d["d4.pdf", 1]["page_type"] == "map_confirmed"
    assert d["d5.pdf", 1]["page_type"] == "coordinate_register" and d["d5.pdf", 1]["coordinate_assessment"]["detected"] and d["d5.pdf", 1]["table_assessment"] is None
    whole = {r["doc_id"]: r for r in diagnosis.document_records(pdf.pdf_pages(files(spark, *raw)), files(spark, *raw)).collect()}
    assert len(whole["d3.pdf"]["pages"]) == 8 and whole["d3.pdf"]["repeated_graphics"][0]["position"] == "bottom" and whole["d0.pdf"]["repeated_graphics"] == []


def test_conversion_lists_and_links(spark, tmp_path):
    raw = pdf.build([page(LAW), {}, page("Mapa 01 de zoneamento. Legenda. Escala", images=[(50, 50, 400, 400, "m")]), {}, {}])
    found = diagnosis.diagnose(pdf.pdf_pages(files(spark, raw)))
    seen = spark.createDataFrame([("d0.pdf", 2, LAW + " repetido para dar palavras que bastem a uma pagina inteira de texto legal", [91.0]), ("d0.pdf", 4, "@@", [20.0]), ("d0.pdf", 5, "FLUXOGRAMA do processo", [80.0])], "doc_id string, page_number int, text string, confidences array<double>")
    boxes = spark.createDataFrame([("d0.pdf", 5, (3, 2, 2, 1, 3, 0.1, 0.1, 0.1, 5))], "doc_id string, page_number int, m struct<horizontal_lines:int,vertical_lines:int,intersections:int,closed_regions:int,boxes:int,area:double,ink:double,edges:double,components:int>")
    made = cli.staged(conversion.convert(cli.staged(conversion.with_evidence(cli.staged(found, str(tmp_path), "a"), seen, boxes), str(tmp_path), "b")), str(tmp_path), "c")
    assert [r["product"] for r in made.orderBy("page_number").collect()] == ["native", "ocr", "map", "ocr_review", "diagram"]
    m = conversion.published(conversion.manifests(made)).first()
    assert m["used_ocr_pages"] == [2, 4, 5] and m["ocr_review_image_pages"] == [4] and m["diagram_pages"] == [5] and m["review_pages"] == [3, 4, 5] and m["visual_text_preserved_pages"] == [3]
    assert "(<../ativos/d0/pagina_0004_ocr_revisao.png>)" in m["markdown"] and "d0_assets" not in m["markdown"]
    assert m["asset_paths"][-1] == "ativos/d0/pagina_0005_diagrama.png" and set(conversion.LISTS) <= set(m.asDict())
    assert [r["pages"] for r in conversion.missing_ocr(conversion.with_evidence(cli.staged(found, str(tmp_path), "d"))).collect()] == [[2, 4, 5]]


def test_latent_grid_beside_a_table_is_promoted(spark):
    weak, strong = (3, 3, 4, 2, 1, 0.03, 0.1, 0.1, 5), (9, 9, 60, 30, 30, 0.5, 0.1, 0.1, 5)
    schema = "doc_id string, page_number int, text string, route string, page_type string, m struct<horizontal_lines:int,vertical_lines:int,intersections:int,closed_regions:int,boxes:int,area:double,ink:double,edges:double,components:int>"
    rows = [("a", 1, "", "ocr", "unknown", weak), ("a", 2, "", "ocr", "unknown", strong), ("a", 3, "", "ocr", "unknown", weak), ("b", 1, None, "ocr", "unknown", weak), ("b", 2, LAW, "native", "text", None), ("c", 1, LAW, "structured", "table", None), ("c", 2, "", "ocr", "unknown", weak)]
    got = {(r["doc_id"], r["page_number"]): r["raster"] for r in pages.ocr_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k]["classification"] == "raster_table_candidate" for k in (("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 2))] == [True, True, True, False, True]
    assert got["b", 1]["reasons"] and got["a", 3]["contextual_continuation"] and got["b", 2] is None


def test_diagrams_are_detected_and_map_reasons_exclude_each_other(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    n = lambda *v: [F.lit(x) for x in v]
    d = one(pages.raster_decision(*n(3, 2, 2, 1, 3, 0.1, False, True, False)))
    assert d["classification"] == "diagram_candidate" and d["detected"] and not d["strong"] and d["score"] == 10 and len(d["reasons"]) == 2
    assert one(pages.map_visual(*n(0.1, 0.03, 40)))["reasons"] == [pages.L.REASONS["dense"]]
    assert one(pages.confirmed_map(F.lit("Mapa 01"), F.lit(0), pages.map_visual(*n(0.01, 0.001, 2)))) == "map_cover"


def test_rules_that_tell_near_misses_apart(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert one(structure.line_type(F.lit("Capítulo II"))) == "capitulo"
    assert one(T.prose(F.lit("Capítulo  I"))) == "Capítulo I" and one(T.fold_upper(F.lit("ação m² Nº"))) == "ACAO M2 NO" and one(T.fold_exact(F.lit("ação ﬁm"))) == "ACAO FIM"
    assert one(T.legal_text(F.lit("Ａrt. 1º"))).startswith("art.1")
    far = one(pages.coordinates(F.lit("X = 25000,1\nY = 91000,2 " * 4)))
    near = one(pages.coordinates(F.lit("X = 25000,1 ; Y = 91000,2 " * 4)))
    assert far["pair_count"] == 0 and near["pair_count"] == 4
    table = "named_struct('classification', 'candidate', 'header_hits', array(), 'urban_parameter_hits', array(), 'content_profile', 'generic_table', 'visual_grid_detected', false)"
    d = spark.range(1).select(F.expr(table).alias("t"))
    false = lambda text: d.select(pages.legal_false_positive(F.lit(text), c("t")).alias("x")).first()["x"]
    assert false("EMENDA SANCIONA VIGOR") and not false("INCISO PARÁGRAFO RESOLUÇÃO")
    packed = lambda p: one(batch.is_packed(F.lit(p)))
    assert packed("a/x.yml") and packed("Ativos/a.MD") and not packed("a.log") and not packed("run/ativos/a.md") and not packed("a/.md")


def test_means_are_rounded_once_and_in_any_order(spark):
    for values, want in (([12.0625], 12.062), ([12.0635, 12.0635], 12.064), ([0.1, 0.2, 0.3], 0.2), ([], None)):
        rows = spark.createDataFrame([(v,) for v in values] or [(None,)], "v double").repartition(3)
        got = rows.select(metrics.mean_to_thousandths(F.sum(metrics.millionths(c("v"))), F.count("v")).alias("m")).first()["m"]
        assert got == want


def test_edits_against_the_usual_table():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert metrics.edits(a, b) == row[-1]
    assert metrics.edits("x" * 50_000, "x" * 30_000 + "y" * 20_000) == 20_000


def test_office_files(spark, tmp_path):
    d = spark.createDataFrame([("a.docx", b"no archive"), ("b.odt", b""), ("c.epub", None)], "doc_id string, content binary")
    assert all(r["error"] and r["text"] is None for r in office.office_text(d).collect())
    assert [r["x"]["language"] for r in spark.createDataFrame([("the law of the land is for all",), ("não são mais dos outros",), (None,), ("",)], "t string").select(language.language(c("t")).alias("x")).collect()] == ["en", "pt", "und", "und"]


def test_manifests_that_are_missing_or_broken_count_as_none(spark, tmp_path):
    assert readers.read_manifests(spark, f"{tmp_path}/none/*.json").count() == 0
    (tmp_path / "a.json").write_text("{ broken")
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"member": "x.pdf", "status": "success", "dpi": 300, "markdown_path": "x.md", "manifest_path": "x.json"}, {"status": "success"}, {"member": "y.pdf", "status": "duplicate"}]}))
    old = readers.read_manifests(spark, f"{tmp_path}/*.json")
    assert {r["member"] for r in old.collect()} == {"x.pdf", "y.pdf"}
    there = spark.createDataFrame([("x.md",)], "path string")
    assert [r["member"] for r in batch.whole_entries(old, there).collect()] == ["y.pdf"]


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_batch_from_archive_to_manifest_and_again(spark, tmp_path):
    law = pdf.build([page(LAW)])
    archive(tmp_path / "in.zip", {"raiz/a/lei.pdf": law, "raiz/a/copia.pdf": law, "raiz/b/outra.pdf": pdf.build([page(LAW + " outra")]), "raiz/b/falsa.pdf": b"texto", "raiz/notas.txt": b"x", "../fora.pdf": law})
    out = tmp_path / "out"
    assert cli.main(["converter-lote", "--entrada", str(tmp_path), "--saida", str(out)]) == 1
    (name,) = [p for p in out.iterdir() if p.name.endswith(".lote.manifest.json")]
    m = json.loads(name.read_text())
    status = {e["member"]: e["status"] for e in m["entries"]}
    assert status == {"raiz/a/copia.pdf": "success", "raiz/a/lei.pdf": "duplicate", "raiz/b/outra.pdf": "success", "raiz/b/falsa.pdf": "failed", "../fora.pdf": "rejected"}
    assert m["status"] == "completed_with_failures" and m["pdf_count"] == 4 and m["ignored_entries"][0]["member"].endswith("notas.txt") and m["generated_at"] == m["updated_at"]
    assert LAW in (out / "a/analise/copia.md").read_text() and (out / "a/copia.manifest.json").exists() and not list(out.rglob("*.tmp"))
    assert all("raiz" not in (e["output_relative_path"] or "") for e in m["entries"])
    before = (out / "a/analise/copia.md").stat().st_mtime_ns
    (out / "b/analise/outra.md").unlink()
    assert cli.main(["converter-lote", "--entrada", str(tmp_path), "--saida", str(out), "--retomar"]) == 1
    again = {e["member"]: e for e in json.loads(name.read_text())["entries"]}
    assert again["raiz/a/copia.pdf"]["resumed_without_processing"] and (out / "a/analise/copia.md").stat().st_mtime_ns == before
    assert not again["raiz/b/outra.pdf"].get("resumed_without_processing") and (out / "b/analise/outra.md").exists()
    assert cli.main(["converter-lote", "--entrada", str(tmp_path), "--saida", str(tmp_path / "few"), "-n", "1", "--manter-raiz-comum"]) in (0, 1)
    few = json.loads(next((tmp_path / "few").glob("*.lote.manifest.json")).read_text())
    assert few["pending_count"] == 3 and few["document_limit"] == 1 and (tmp_path / "few/raiz/a/analise/copia.md").exists()


def test_single_documents_on_the_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/lei.pdf").write_bytes(pdf.build([page(LAW)]))
    assert cli.main(["diagnosticar", "--entrada", str(tmp_path / "in"), "--saida", str(tmp_path / "d")]) == 0
    found = json.loads((tmp_path / "d/lei.diagnostico.json").read_text())
    assert found["page_count"] == 1 and found["pages"][0]["route"] == "native" and found["generated_at"] and "table_assessment" in found["pages"][0]
    assert cli.main(["converter", "--entrada", str(tmp_path / "in"), "--saida", str(tmp_path / "c"), "--dpi", "200"]) == 0
    assert LAW in (tmp_path / "c/analise/lei.md").read_text() and json.loads((tmp_path / "c/lei.manifest.json").read_text())["dpi"] == 200
    (tmp_path / "in/branca.pdf").write_bytes(pdf.build([{}]))
    assert cli.main(["converter", "--entrada", str(tmp_path / "in"), "--saida", str(tmp_path / "e")]) == 1 and (tmp_path / "e/analise/lei.md").exists()
    with pytest.raises(SystemExit):
        cli.main(["converter", "--entrada", "x", "--saida", "y", "--dpi", "100"])
    assert cli.main(["empacotar-analise", "--entrada", str(tmp_path / "c"), "--saida", str(tmp_path / "c/pacote.zip")]) == 0
    assert zipfile.ZipFile(tmp_path / "c/pacote.zip").namelist() == ["analise/lei.manifest.json", "analise/lei.md", "lei.manifest.json"]


def test_registered_engines_do_the_pages_that_need_them(spark, tmp_path, monkeypatch):
    def engine(content, page_number, dpi):
        words = (LAW + " palavra" * 20).split()
        return {"text": [*words, " "], "conf": ["92"] * len(words) + ["-1"], **{k: [1] * (len(words) + 1) for k in ("block_num", "par_num", "line_num", "top", "height", "width")}, "word_num": list(range(len(words) + 1)), "left": [10 * k for k in range(len(words) + 1)]}

    monkeypatch.setitem(readers.ADAPTERS, "ocr", engine)
    (tmp_path / "branca.pdf").write_bytes(pdf.build([{}]))
    assert cli.main(["converter", "--entrada", str(tmp_path), "--saida", str(tmp_path / "o")]) == 0
    assert "rota: ocr" in (tmp_path / "o/analise/branca.md").read_text()
    block = json.loads((tmp_path / "o/analise/branca.estrutura_ocr.jsonl").read_text().splitlines()[0])
    assert block["tipo_registro"] == "bloco_ocr" and block["linhas"][0]["texto"].startswith("Artigo 1")
    assert len((tmp_path / "o/analise/branca.ocr_tokens.jsonl").read_text().splitlines()) == len(LAW.split()) + 20
    monkeypatch.delitem(readers.ADAPTERS, "ocr")
    with pytest.raises(RuntimeError, match="ocr"):
        readers.adapter("ocr")


def test_structure_cases_and_folders_on_the_command_line(spark, tmp_path):
    tokens = [{"doc_id": 1, "text": t, "confidence": 90.0, "page_number": 1, "block_number": 1, "paragraph_number": 1, "line_number": 1, "word_number": k, "left": 10 * k, "top": 5, "width": 8, "height": 9} for k, t in enumerate(["Art.", "1", "º"])]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, tokens)))
    assert cli.main(["reconstruir-estrutura", "--entrada", str(tmp_path / "t.jsonl"), "--saida", str(tmp_path / "s")]) == 0
    assert "Art. 1º" in "".join(p.read_text() for p in (tmp_path / "s").glob("*.json"))
    (tmp_path / "c.json").write_text(json.dumps({"casos": [{"identificador_caso": "a", "dispositivos_esperados": ["9"], "texto_observado": "Art. 1º x"}]}))
    assert cli.main(["validar-canario", "--entrada", str(tmp_path / "c.json"), "--saida", str(tmp_path / "v")]) == 1
    report = json.loads((tmp_path / "v/analise/resultados_canario.json").read_text())
    assert report["versao_esquema"] == "2.0" and report["casos_reprovados"] == 1 and (tmp_path / "v/analise/canary_results.json").exists()
    (tmp_path / "p").mkdir()
    (tmp_path / "p/lei.pdf").write_bytes(pdf.build([page("não são mais dos outros, uma lei das terras pelo povo e pela cidade")]))
    archive(tmp_path / "p/doc.docx", {"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>the law of the land is for all</w:t></w:r></w:p></w:body></w:document>'})
    run = lambda *more: cli.main(["converter-pasta", "--entrada", str(tmp_path / "p"), "--saida", str(tmp_path / "l"), *more])
    assert run("--idiomas", "pt", "en") == 0
    made = spark.read.json(f"{tmp_path}/l")
    assert {(r["bucket"], "arquivo_original" in r["markdown"]) for r in made.collect()} == {("pt", True), ("en", True)}


def test_stream_resumes_and_tells(spark, tmp_path):
    told = []
    listener = ingest.Progress(told.append)
    spark.streams.addListener(listener)
    schema = "doc_id string, sha256 string"
    convert = lambda d: d.select("doc_id", F.when(c("doc_id") == "bad", "failed").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"))
    for rows in ([("a", "1"), ("bad", "2")], [("a", "1"), ("bad", "2"), ("b", "3")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest.convert_stream(ingest.read_documents(spark, f"{tmp_path}/in", schema), f"{tmp_path}/status", f"{tmp_path}/cp", convert)
        q.awaitTermination(60)
    found = ingest.entries(spark, f"{tmp_path}/status")
    assert sorted((r["doc_id"], r["status"]) for r in found.collect()) == [("a", "success"), ("b", "success"), ("bad", "failed"), ("bad", "failed")]
    assert ingest.status(found).first()["status"] == "completed_with_failures" and ingest.status(found, active=True).first()["status"] == "running"
    assert ingest.status(found, interrupted=True).first()["status"] == "interrupted" and ingest.status(found.where("status = 'success'"), pending=2).first()["status"] == "completed_with_limit"
    assert ingest.entries(spark, f"{tmp_path}/nothing").count() == 0
    spark.streams.removeListener(listener)


def test_first_copies_and_windows_of_a_stream(spark, tmp_path):
    rows = [(1, "x", "2024-01-01 00:00:00"), (2, "x", "2024-01-01 01:00:00"), (3, "y", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "doc_id int, text string, at string").selectExpr("doc_id", "text", "CAST(at AS TIMESTAMP) AS at").write.parquet(f"{tmp_path}/in")
    stream = ingest.read_documents(spark, f"{tmp_path}/in", "doc_id int, text string, at timestamp")
    q = ingest.first_copies(stream, "at").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_plans_scan_once_and_strip_once(spark):
    import oracle
    from foliomill.plans import catalog

    plan = lambda name: catalog.queries()[name](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("document_quality_gate").count("\\A\\s++") == 1
    assert plan("graphics_refined").count("Relation [") + plan("graphics_refined").count("Relation[") <= 2 and "Join" not in plan("graphics_refined")


def test_geometry(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    m = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("abcdef", v)])
    assert one(graphics.unit_box(m(20, 0, 0, 20, 10, 10), F.lit(600.0), F.lit(800.0))).asDict() == {"x0": 10 / 600, "y0": 10 / 800, "x1": 30 / 600, "y1": 30 / 800}
    assert one(graphics.unit_box(m(20, 0, 0, 20, 900, 10), F.lit(600.0), F.lit(800.0))) is None
    assert tuple(one(graphics.multiply(m(2, 0, 0, 2, 0, 0), m(1, 0, 0, 1, 5, 6)))) == (2.0, 0.0, 0.0, 2.0, 5.0, 6.0)


def test_empty_images_have_no_metrics(spark):
    d = spark.createDataFrame([(0, 0, b""), (2, 2, b"x"), (None, None, None)], "h int, w int, data binary")
    assert [r["m"] for r in d.select(raster.metrics(c("h"), c("w"), c("data")).alias("m")).collect()] == [None, None, None]


def test_writers_stamp_and_order(spark, tmp_path):
    d = spark.createDataFrame([("a", "2020-01-01T00:00:00+00:00")], "doc_id string, generated_at string")
    r = writers.stamped(d).first()
    assert r["generated_at"].startswith("2020") and r["updated_at"].endswith("+00:00")
    writers.write_files(writers.manifest_files(d, F.lit("x/m.json")), str(tmp_path))
    assert '\n  "doc_id": "a"' in (tmp_path / "x/m.json").read_text()


def test_a_step_is_a_table_and_nothing_runs_twice(spark):
    """each use of the parsed pages parsed every file again."""
    from foliomill.plans import catalog

    import oracle

    for name in ("pdf_diagnosis", "pdf_conversion", "pdf_graphics", "pdf_pages", "epub_text"):
        assert "MapInArrow" not in catalog.queries()[name](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
