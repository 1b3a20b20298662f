import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliomill.functions import metrics, text as T
from foliomill.operators import batch, canary, pages, quality, raster, structure
from foliomill.plans import catalog

import oracle

c = F.col


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(c("v")).alias("r")).first()["r"]


def table(spark, text):
    return pages.assess_tables(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["table"]


def test_tables(spark):
    matrix = "\n".join(["QUADRO II", "ZONA            USO            COEFICIENTE     TESTADA"] + [f"ZR{i}           Misto          {i},5             {i}0,00" for i in range(1, 7)])
    found = table(spark, matrix)
    assert found["classification"] == "confirmed" and found["suspected"] and found["header_line_index"] == 2
    assert 2 <= found["stable_columns"] <= 14 and "territorial" in found["header_hits"]
    more = "\n".join([f"NUR{i}        Misto          200        10,00" for i in range(4)] + ["Lote, testada e recuo permanecem."])
    assert table(spark, more)["classification"] == "continuation_candidate"
    assert table(spark, "\n".join(f"Art. {i} O texto da lei;" for i in range(9)))["content_profile"] == "legal_list"
    assert table(spark, "\n".join(f"V{i}   X = 2500{i},10   Y = 9100{i},20" for i in range(8)))["content_profile"] == "coordinates"
    for nothing in (None, "", "uma linha"):
        assert table(spark, nothing)["classification"] == "not_table"


def test_coordinates_and_maps(spark):
    found = one(spark, "UTM SIRGAS " + " ".join(f"X: 2500{i},10; Y: 9100{i},20" for i in range(4)), pages.coordinates)
    assert found["detected"] and found["pair_count"] == 4
    assert not one(spark, "Lei 1234 de 2001, art. 15", pages.coordinates)["detected"]
    kind = lambda t, n=1: one(spark, t, lambda x: pages.map_class(x, F.lit(n), F.lit(False)))
    assert kind("Mapa 01 - Bairros") == "map_candidate"
    assert kind("Mapa de zoneamento. Legenda. Escala 1:5000") == "map_confirmed"
    assert kind("CADERNO DE MAPAS") == "map_cover"
    assert kind("Mapa 01", 0) == kind("nada aqui") == kind("mapa " * 200) == kind(None) == "none"


def test_line_types_and_glue(spark):
    kinds = {"TÍTULO I": "titulo", "Capítulo II": "capitulo", "Seção 1": "secao", "§ 2º Texto": "paragrafo", "IV - texto": "inciso", "a) texto": "alinea", "I) texto": "alinea", "3. texto": "item", "Art. 1º - A": "artigo", "texto": "texto"}
    for text, kind in kinds.items():
        assert one(spark, text, structure.line_type) == kind, text
    join = lambda *t: one(spark, list(t), structure.join_tokens, "array<string>")
    assert join("Art.", "1", "º", "-", "Esta") == "Art. 1º - Esta"
    assert join("(", "a", ")", ",", "km", "/", "h") == "(a), km/h" or join("(", "a", ")", ",") == "(a),"


def test_ocr_quality(spark):
    q = lambda t, conf: spark.createDataFrame([(t, conf)], "t string, c array<double>").select(quality.ocr_quality(c("t"), c("c")).alias("q")).first()["q"]
    long = "palavra legal de teste " * 10
    assert q("@@ ##", [20.0])["quality"] == "low" and q(None, None)["quality"] == "low"
    assert q(long, [91.0])["quality"] == "high" and q(long, [68.0])["quality"] == "medium"


def test_error_rates(spark):
    rate = lambda f, a, b: spark.createDataFrame([(a, b)], "a string, b string").select(f(c("a"), c("b")).alias("r")).first()["r"]
    assert rate(metrics.char_error_rate, "abc", "abd") == 1 / 3 and rate(metrics.char_error_rate, "", "x") == 1.0
    assert rate(metrics.word_error_rate, "a b c", "a c") == 1 / 3 and rate(metrics.word_error_rate, "", " ") == 0.0


def test_prose_is_idempotent(spark):
    for text in ("a ​b   c\r\n\r\n\r\n\r\n d  ", "", "\t x \n", "﻿ABC"):
        once = one(spark, text, T.prose)
        assert one(spark, once, T.prose) == once


def test_promotion_equals_sequential_rule(spark):
    rows, want = [], {}
    for doc, kinds in enumerate(itertools.chain.from_iterable(itertools.product("lso", repeat=n) for n in range(1, 6))):
        state = [k == "s" for k in kinds]
        for i, k in enumerate(kinds):
            if k == "l":
                state[i] = (i > 0 and state[i - 1]) or (i + 1 < len(kinds) and kinds[i + 1] == "s")
                want[doc, i] = state[i]
            rows.append((doc, i, k == "l", k == "s"))
    got = pages.promote_by_context(spark.createDataFrame(rows, "doc_id int, page_number int, latent boolean, seed boolean")).where("latent").collect()
    assert {(r["doc_id"], r["page_number"]): r["promoted"] for r in got} == want


def test_canary(spark):
    schema = "case_id string, expected array<string>, terms array<string>, references array<string>, altered array<string>, observed string"
    rows = [
        ("ok", ["Art. 103-A"], ["10%", "m²"], None, None, "Art. 103-A Fica 10 % e 5 m2 conforme art. 12."),
        ("bad", ["126"], [], [], [], "Art. l26 texto"),
        ("extra", ["1"], ["Art. 2º"], [], [], "Art. 1º a. Art. 2º b. Art. 3º c."),
        ("empty", None, None, None, None, None),
    ]
    got = {r["case_id"]: r for r in canary.evaluate(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"]["passed"] and got["ok"]["references_found"] == ["12"]
    assert not got["bad"]["passed"] and got["bad"]["missing_articles"] == ["126"]
    assert got["extra"]["unexpected_articles"] == ["3"] and got["empty"]["passed"]


def test_batch_plan(spark):
    rows = [("a", m, i, 0, h) for i, (m, h) in enumerate([("r/b.pdf", "x"), ("r/a.PDF", "x"), ("r/A.pdf", "y"), ("../c.pdf", "z"), ("r/n.txt", "t"), ("r/d.pdf", "w")])]
    members = spark.createDataFrame(rows, "archive string, member string, ordinal int, attributes long, sha256 string")
    got = {r["member"]: r["status"] for r in batch.plan_batch(members, limit=3).collect()}
    assert got == {"r/a.PDF": "to_convert", "r/A.pdf": "failed", "r/b.pdf": "duplicate", "r/d.pdf": "pending", "../c.pdf": "rejected", "r/n.txt": "ignored"}
    assert batch.plan_batch(members.limit(0)).count() == 0


def test_raster_grid():
    import numpy as np

    page = np.full((600, 500, 3), 255, np.uint8)
    for i in range(7):
        page[80 + 60 * i : 82 + 60 * i, 60:422] = 0
        page[80:442, 60 + 60 * i : 62 + 60 * i] = 0
    m = raster.measure(page)
    assert (m["horizontal_lines"], m["vertical_lines"], m["intersections"], m["closed_regions"], m["boxes"]) == (7, 7, 49, 37, 37)
    assert raster.measure(np.full((300, 300, 3), 255, np.uint8))["horizontal_lines"] == 0
    mask = np.array(random.Random(1).choices([0, 1], k=400), bool).reshape(20, 20)
    labels, stats = raster.components(mask)
    assert stats[:, 0].sum() == mask.sum() == (labels > 0).sum()


def test_members_of_one_path_are_resumed_by_the_first(spark, tmp_path):
    """which of several members of one path counted as done before was left open."""
    rows = [(67 * k, f"text {20 if k == 3 else k}", "en", "web", 7) for k in (20, 15, 10, 5, 13, 8, 3)] + [(68, "text 13", "en", "web", 7)]  # the later ones are met first
    for own in (rows, [r for r in rows if r[0] != 67 * 3]):
        path = tmp_path / f"n{len(own)}"
        path.mkdir()
        pq.write_table(pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in own]), path / "documents.parquet")
        for name in ("batch_plan", "batch_counts"):
            assert oracle.difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], str(path)) == ""


def test_edits_that_are_known_without_a_table(monkeypatch):
    """every pair took a whole table, and time with the square of the text's length."""
    text = "zee mêle " * 4000
    read = text.translate({ord("e"): "☃", ord("z"): None})
    full = metrics._whole
    monkeypatch.setattr(metrics, "_whole", lambda a, b: 1 / 0)
    assert metrics.edits(text, read) == metrics.edits("\0" + text, "\0" + read) == 4 * 4000
    assert metrics.edits(text.split(), ["☃" if len(x) == 3 else x for x in text.split()]) == 4000
    monkeypatch.setattr(metrics, "_whole", full)
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abc ez\0") for _ in range(rng.randrange(60, 150)))
        b = "".join(rng.choice(("☃", "", x)) if x in "ez" or rng.random() < 0.02 else x for x in a)
        assert metrics.edits(a, b) == metrics.edits(list(a), list(b)) == (full(a, b) if b else len(a))
