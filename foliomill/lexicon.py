"""Vocabulary as data: word lists from which the patterns of the classifiers are built."""

from __future__ import annotations


def any_of(words: str, gap: str = r"\s+") -> str:
    """A pattern for any of the words, longest first; underscores stand for the gap between words."""
    parts = sorted(words.split(), key=lambda w: (-len(w), w))
    return r"\b(?:" + "|".join(p.replace("_", gap) for p in parts) + r")\b"


def phrases(words: str) -> str:
    """any_of() with exactly one space in a term: in a layout, a wider gap separates cells."""
    return any_of(words, " ")


#: Header vocabulary by group, in the order in which hits are listed. Matched on folded upper-case text.
HEADERS: dict[str, str] = {
    "territorial": phrases("AREA MACROZONA SETOR ZEIS ZONA ZONAS"),
    "identificador": phrases("CODIGO DECRETO LEI NUMERO NO Nº N°"),
    "denominacao": phrases("COMUNIDADE DENOMINACAO DESCRICAO LOCALIDADE NOME"),
    "parametro": phrases("APROVEITAMENTO AREA_MINIMA CA COEFICIENTE GABARITO GM LM LOTE_MINIMO RECUO SOLO_NATURAL TAXA TESTADA TM TO TSN"),
    "instrumento": phrases("INSTRUMENTO INSTRUMENTOS OUTORGA POLITICA_URBANA TRANSFERENCIA"),
    "observacao": phrases("OBSERVACOE OBSERVACOES REQUISITO_ESPECIAIS REQUISITOS_ESPECIAIS"),
    "uso": phrases("HABITACIONAL MISTO NAO_HABITACIONAL RESIDENCIAL USO USOS"),
    "dimensao": phrases("M2 METRO METROS PAVIMENTO PAVIMENTOS PAVTO PAVTOS"),
}

URBAN: dict[str, str] = {
    "lote": phrases("AREA_MINIMA LM LOTE"),
    "testada": phrases("TESTADA TM"),
    "recuo": phrases("FRONT FUND FUNDO FUNDOS LAT LATERAL RECUO"),
    "ocupacao": phrases("TAXA_DE_OCUPACAO TO"),
    "solo_natural": phrases("SOLO_NATURAL TSN"),
    "gabarito": phrases("GABARITO GM PAVIMENTO PAVIMENTOS PAVTO PAVTOS"),
    "aproveitamento": phrases("CA COEFICIENTE_DE_APROVEITAMENTO"),
    "uso": phrases("HABITACIONAL INDUSTRIAL MISTO RESIDENCIAL USO"),
}

ZONE_CODE = r"\b(?:CCSB|MZ[0-9]+|NUAR|NUR[0-9]*|SEI|SOU|ZRU[0-9]*|Z[A-Z]{1,4}[0-9]*)\b"
NUMBER = r"[0-9]+(?:[.,/][0-9]+)?"
LEGAL_PREFIX = r"^(?:§|ART\.?\s*[0-9]+|PARAGRAFO\b|[A-Z]\s*[.)]|[CDILMVX]+\s*[).-])"
COORDINATE_LINE = r"(?i)\b[XY]\s*=\s*[0-9]"
TITLE_TABLE = r"^(?:QUADRO|TABELA)\b"
TITLE_ANNEX = r"^ANEXO\b.{0,180}" + any_of("INSTRUMENTO INSTRUMENTOS LISTAGEM PARAMETRO PARAMETROS QUADRO TABELA USO USOS ZEIS ZONA ZONAS")
TITLE_NOMINAL = r"^(?:INDICE|INDICES|INSTRUMENTO|INSTRUMENTOS|LISTAGEM|PARAMETRO|PARAMETROS|REQUISITO|REQUISITOS)\b.{0,180}" + any_of(
    "EDILICIO EDILICIOS URBANISTICO URBANISTICOS USO USOS ZEIS ZONA ZONAS"
)

#: Between X and Y stands a comma, a semicolon or a space, not a line end or tab alone.
XY_PAIR = r"\bX\s*[=:]\s*-?[0-9]{3,}(?:[,.][0-9]+)?\s*[ ,;]+\s*Y\s*[=:]\s*-?[0-9]{3,}(?:[,.][0-9]+)?"
LAT_LONG_PAIR = r"\b(?:NORTE|LAT|LATITUDE)\s*[=:]?\s*-?[0-9]{1,3}(?:[,.][0-9]+)?.{0,40}?\b(?:LESTE|LONG|LONGITUDE)\s*[=:]?\s*-?[0-9]{1,3}(?:[,.][0-9]+)?"
COORDINATE_NUMBER = r"(?<![0-9])-?[0-9]{4,7}(?:[,.][0-9]{2,})?(?![0-9])"
COORDINATE_WORDS: dict[str, str] = {
    "coordenada": r"\bCOORDENAD", "vertice": r"\bVERTICE", "utm": r"\bUTM\b", "sirgas": r"\bSIRGAS\b",
    "azimute": r"\bAZIMUTE\b", "norte_leste": any_of("LESTE NORTE"), "poligono": r"\bPOLIGONO\b", "distancia": r"\bDISTANCIA\b",
}

#: Map patterns run on raw text, with or without accents and in any case.
MAP_WORD = any_of("CARTA CARTAS CROQUI MAPA MAPAS PLANTA PLANTAS")
SPATIAL = any_of("[AÁ]REA_DE_RISCO [AÁ]REAS_DE_RISCO MACROZONEAMENTO PER[IÍ]METRO_URBANO SISTEMA_VI[AÁ]RIO USO_E_OCUPA[CÇ][AÃ]O ZONEAMENTO")
CARTOGRAPHIC = any_of("COORDENADA COORDENADAS DATUM ESCALA FONTE_CARTOGR[AÁ]FICA FUSO LEGENDA MERIDIANO NORTE PROJE[CÇ][AÃ]O SIRGAS UTM")
COVER = any_of(
    "ANEXO_CARTOGR[AÁ]FICO ANEXO_DE_MAPA ANEXO_DE_MAPAS CADERNO_DE_MAPA CADERNO_DE_MAPAS [IÍ]NDICE_MAPA [IÍ]NDICE_MAPAS [IÍ]NDICE_DE_MAPA [IÍ]NDICE_DE_MAPAS "
    "LISTA_DE_MAPA LISTA_DE_MAPAS MAPA_ANEXO MAPA_ANEXOS MAPAS_ANEXO MAPAS_ANEXOS RELA[CÇ][AÃ]O_DE_MAPA RELA[CÇ][AÃ]O_DE_MAPAS ANEXOS?\\s+[-–—:]?\\s*MAPAS?"
)
COVER_LAYOUT = r"^(?:AP[EÊ]NDICE|ANEXO|CADERNO)\b.{0,180}$"
MAP_TITLE = r"\b(?:CARTA|CROQUI|MAPA|PLANTA)\b(?:\s+(?:N[°º.]?\s*)?[0-9A-Z.-]+)?(?:\s*[:—–-]\s*[^\n]{1,150})?"

DIAGRAM_WORDS = any_of("CORTE DETALHE DIAGRAMA ELEVACAO ESQUEMA FLUXOGRAMA GRAFICO ORGANOGRAMA PLANTA_BAIXA REPRESENTACAO_GRAFICA")
TABLE_WORDS = any_of("COLUNA CONTINUACAO INDICE INDICES LINHA PARAMETRO PARAMETROS QUADRO SUBTOTAL TABELA TOTAL")

LEGAL_PRESENCE: tuple[str, ...] = (
    r"\bLEI\s+(?:NO|NUMERO|N)\b", r"\bART\.?\s*[0-9]+", r"\bPREFEIT[AO]\b", r"\bCAMARA\s+MUNICIPAL\b",
    r"\bSANCIONA\b", r"\bENTRARA?\s+EM\s+VIGOR\b", r"\bREVOGAD[OA]S?\b", r"\bPROVIDENCIAS\b",
)
#: Occurrences on raw text for scoring an extraction, and on folded text for spotting legal prose among table candidates. The lists differ.
LEGAL_OCCURRENCE = any_of("ART ARTIGO DECRETO INCISO LEI PAR[AÁ]GRAFO RESOLU[CÇ][AÃ]O")

LEGAL_MARKER = any_of(r"ART\.? ARTIGO ASSINATURA CAMARA_MUNICIPAL DECRETO EMENDA LEI PREFEIT[AO] REVOGAD[AO]S? SANCIONA VIGOR")

#: Line types in order of priority, on folded upper-case text.
LINE_TYPES: tuple[tuple[str, str], ...] = (
    *((kind, rf"^{word}\s+(?:[0-9]+|[CDILMVX]+)(?:\b|\s)") for kind, word in (("titulo", "TITULO"), ("capitulo", "CAPITULO"), ("subsecao", "SUBSECAO"), ("secao", "SECAO"))),
    ("artigo", r"^ART(?:IGO)?\.?\s*[0-9]+[°ºO]?(?:\s*-\s*[A-Z])?(?:[.–—-]|\b)"),
    ("paragrafo", r"^(?:PARAGRAFO\s+(?:[0-9]+[°ºO]?|UNICO)|§\s*[0-9]+[°ºO]?)(?:[.–—-]|\b)"),
    ("inciso", r"^[CDILMVX]+\s*[.–—-]"),
    ("alinea", r"^[A-Z]\s*\)"),
    ("item", r"^[0-9]+\s*[).–—-]"),
)

NO_SPACE_BEFORE = ".,;:!?%)]}º°"
NO_SPACE_AFTER = "([{§"

#: Reasons and warnings, by key. They are part of results and so fixed.
REASONS: dict[str, str] = {
    "short": "texto OCR muito curto", "few_words": "poucas palavras reconhecidas", "noise": "alta proporcao de simbolos ou ruido",
    "low_conf": "confianca media OCR baixa", "mid_conf": "confianca media OCR moderada",
    "continuation": "possivel continuacao de matriz urbanistica sem cabecalho local",
    "title": "titulo tabular explicito associado ao cabecalho", "headers": "grupos semanticos de cabecalho em bloco local",
    "special": "cabecalho urbanistico especializado", "rows": "quatro ou mais linhas alinhadas",
    "columns": "colunas recorrentes em quantidade plausivel", "numeric": "linhas com valores ou codigos numericos",
    "compact": "linhas compactas tipicas de matriz de parametros", "matrix": "vocabulario convergente de matriz urbanistica",
    "zones": "codigos de zonas recorrentes", "legal": "penalizacao por estrutura juridica enumerativa", "prose": "penalizacao por paragrafos extensos",
    "numbers": "sequencia extensa de numeros com formato de coordenada", "geodetic": "vocabulario geodesico ou de memorial descritivo",
    "grid": "grade vetorial com linhas horizontais e verticais", "strong_grid": "grade vetorial forte e repetitiva",
    "amendment": "reclassificada como prosa juridica: sem grade vetorial e com marcadores legais",
    "diagram_words": "vocabulário explícito de diagrama ou representação gráfica",
    "boxes": "caixas e conectores sem regularidade suficiente de grade tabular",
    "raster_strong": "grade raster forte com linhas e cruzamentos regulares",
    "raster_context": "grade raster parcial promovida por continuidade contextual",
    "raster_cells": "grade raster candidata com estrutura celular",
    "raster_latent": "grade raster parcial mantida como evidência latente sem contexto adjacente",
    "dense": "rede gráfica densa e conectada compatível com mapa",
    "diverse": "ocupação gráfica e diversidade de componentes compatíveis com mapa",
    "cover": "baixa ocupação gráfica compatível com capa ou folha de abertura",
}

WARNINGS: dict[str, str] = {
    "map_confirmed": "conteudo cartografico confirmado: preservar imagem e texto",
    "map_candidate": "possivel conteudo cartografico: preservar para revisao",
    "map_cover": "capa ou indice cartografico: preservar sem contar como mapa",
    "decorative": "pagina exclusivamente decorativa: OCR dispensado",
    "coordinates": "registro de coordenadas: preservar imagem e texto em classe propria",
    "table": "estrutura tabular confirmada: preservar imagem e exigir revisao estrutural",
    "candidate": ": preservar texto bruto e imagem para revisao estrutural",
    "thin": "camada textual insuficiente", "vector": "grade vetorial detectada: bordas tabulares preservadas como evidencia",
    "subordinate": "evidencia de coordenadas subordinada a estrutura tabular mais forte",
    "hybrid": "pagina hibrida: texto e imagem relevante", "blank": "pagina sem texto ou imagem detectavel",
    "rotated": "texto rotacionado detectado; extracao selecionada: ", "messages": "avisos da extracao nativa registrados",
}
