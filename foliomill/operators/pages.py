"""Page classifiers: tables, coordinate registers, maps, vector grids, raster decisions, routing. One row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as T
from .quality import said

_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _title(folded: Column) -> Column:
    short = (F.length(folded) <= 220) & ~folded.rlike(L.LEGAL_PREFIX)
    return short & (folded.rlike(L.TITLE_TABLE) | folded.rlike(L.TITLE_ANNEX) | folded.rlike(L.TITLE_NOMINAL))


def cell_starts(line: Column) -> Column:
    """Places at which the cells of a line begin: its first mark, and the end of every inner run of two spaces or more."""
    parts = F.regexp_extract_all(line, F.lit(" +|[^ ]++(?: [^ ]++)*+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(seen: Column, part: Column) -> Column:
        starts = F.when(part.startswith(" "), seen["starts"]).otherwise(F.array_append(seen["starts"], seen["at"]))
        return F.struct((seen["at"] + F.length(part)).alias("at"), starts.alias("starts"))

    return F.aggregate(parts, start, step, lambda s: s["starts"])


def _line(line: Column) -> Column:
    return _measured(F.struct(line.alias("text"), T.fold_upper(line).alias("folded")))


def _measured(x: Column) -> Column:
    """What a line (text, folded) shows. Folding comes in a step of its own, as a lambda's parts are evaluated wherever they stand."""
    line, folded = x["text"], x["folded"]
    trimmed = T.trimmed(folded)
    prefixed = trimmed.rlike(L.LEGAL_PREFIX)
    return F.struct(
        line.alias("text"), folded.alias("folded"), cell_starts(line).alias("starts"), T.word_count(line).alias("words"), F.regexp_count(line, F.lit(L.NUMBER)).alias("numbers"), _title(T.squeeze(folded)).alias("title"),
        prefixed.alias("prefixed"), (prefixed | trimmed.endswith(";")).alias("legal"), line.rlike(L.COORDINATE_LINE).alias("coordinate"), folded.rlike(L.ZONE_CODE).alias("zone"), F.size(T.hits(folded, L.HEADERS)).alias("headers"),
    )


def _count(lines: Column, keep) -> Column:
    return F.size(F.filter(lines, keep))


def _compact(x: Column) -> Column:
    return (F.size(x["starts"]) >= 3) & (x["words"] <= 24) & ((x["numbers"] >= 2) | x["zone"])


def _window(lines: Column, start: Column, width: int) -> Column:
    """A run of lines that may be a header: its text and place, or null where there is too little structure."""
    part = F.slice(lines, start + 1, width)
    gaps = F.aggregate(part, F.lit(0), lambda a, x: a + F.greatest(F.size(x["starts"]) - 1, F.lit(0)))
    fits = (start + width <= F.size(lines)) & (gaps >= 2) & ~F.exists(part, lambda x: x["prefixed"])
    return F.when(fits, F.struct(F.concat_ws(" ", F.transform(part, lambda x: x["folded"])).alias("text"), gaps.alias("gaps"), (-start).alias("before"), F.lit(-width).alias("narrow")))


def _best_header(lines: Column, starts: Column) -> Column:
    """The window of the most hits; then of more gaps, earlier, narrower. Each window's words are looked up once."""
    windows = F.filter(F.flatten(F.transform(starts, lambda s: F.array(*[_window(lines, s, w) for w in (1, 2, 3)]))), lambda w: w.isNotNull())
    looked = F.transform(windows, lambda w: F.struct(T.hits(w["text"], L.HEADERS).alias("headers"), T.hits(w["text"], L.URBAN).alias("urban"), w["gaps"].alias("gaps"), w["before"].alias("before"), w["narrow"].alias("narrow")))
    ranked = F.transform(F.filter(looked, lambda w: F.size(w["headers"]) >= 2), lambda w: F.struct((F.size(w["headers"]) + F.size(w["urban"])).alias("hits"), w["gaps"].alias("gaps"), w["before"].alias("before"), w["narrow"].alias("narrow"), w["headers"].alias("headers"), w["urban"].alias("urban")))
    return F.array_max(ranked)


def assess_tables(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with a struct column table: classification, scores and counts of what the layout text shows.

    Null and empty texts are prose; no text is cut short.
    """
    lines = F.filter(F.transform(T.split_lines(F.coalesce(F.col(text), F.lit(""))), T.rstrip), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(x.alias("text"), T.fold_upper(x).alias("folded")))
    d = pages.withColumn("_l", F.transform(pairs, _measured))
    one, n = F.col("_l"), F.size("_l")
    page = F.concat_ws("\n", F.transform(one, lambda x: x["folded"]))
    d = d.withColumns(
        {
            "_n": n, "_coords": _count(one, lambda x: x["coordinate"]), "_legal": _count(one, lambda x: x["legal"]), "_multi": _count(one, lambda x: F.size(x["starts"]) >= 3),
            "_compact": _count(one, _compact), "_numeric": _count(one, lambda x: (F.size(x["starts"]) >= 3) & (x["numbers"] >= 2)), "_zones": F.regexp_count(page, F.lit(L.ZONE_CODE)),
            "_urban": T.hits(page, L.URBAN), "_titled": F.exists(F.slice(one, 1, 8), lambda x: x["title"]), "_opens": page.rlike(L.TITLE_TABLE) | page.rlike(L.TITLE_ANNEX),
            "_signed": F.exists(one, lambda x: (F.size(x["starts"]) >= 3) & (x["headers"] >= 2)),
        }
    )
    starts = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_best", _best_header(F.col("_l"), starts))
    head = -F.col("_best.before")
    stop = head - F.col("_best.narrow")
    d = d.withColumns({"_head": head, "_stop": stop, "_data": F.slice("_l", F.coalesce(stop, F.lit(0)) + 1, 45)})
    rows = F.filter("_data", lambda x: ~x["legal"] & (F.size(x["starts"]) >= 3))
    d = d.withColumn("_rows", rows)
    buckets = F.flatten(F.transform("_rows", lambda x: F.array_distinct(F.transform(x["starts"], lambda p: F.bround(p / 4).cast("int")))))
    before = F.slice("_l", F.greatest(F.col("_head") - 5, F.lit(0)) + 1, F.least(F.col("_head"), F.lit(5)))
    d = d.withColumns(
        {
            "_buckets": buckets, "_title": F.col("_titled") | F.coalesce(F.exists(before, lambda x: x["title"]) | F.exists(F.slice("_l", F.col("_head") + 1, F.col("_stop") - F.col("_head")), lambda x: x["title"]), F.lit(False)),
            "_hits": F.col("_best.headers"), "_page_urban": F.array_sort(F.array_union("_urban", F.col("_best.urban"))), "_m": F.greatest(F.size("_data"), F.lit(1)),
            "_legal_rows": _count(F.col("_data"), lambda x: x["legal"]), "_prose": _count(F.col("_data"), lambda x: ~x["legal"] & (F.size(x["starts"]) < 3) & (x["words"] >= 14)),
            "_r": F.size("_rows"), "_num": _count(F.col("_rows"), lambda x: x["numbers"] >= 1), "_cmp": _count(F.col("_rows"), _compact),
        }
    )
    least = F.greatest(F.lit(3), F.ceil(F.col("_r") * F.lit(0.35)))
    stable = _count(F.array_distinct("_buckets"), lambda b: _count(F.col("_buckets"), lambda x: x == b) >= least)
    c = F.col
    d = d.withColumns({"_stable": stable, "_lr": c("_legal_rows") / c("_m"), "_pr": c("_prose") / c("_m")})
    vocabulary = (F.size("_page_urban") >= 4) | (F.array_contains("_hits", "territorial") & F.array_contains("_hits", "uso") & (F.size("_page_urban") >= 2))
    d = d.withColumn("_vocabulary", vocabulary)
    columns = c("_stable").between(2, 14)
    strong = c("_vocabulary") & (c("_r") >= 3) & (c("_cmp") >= 2) & ((c("_zones") >= 1) | (c("_num") >= 3)) & (c("_lr") <= 0.30)
    listing = c("_title") & (F.size("_hits") >= 3) & (c("_r") >= 4) & (c("_num") >= 3) & (c("_lr") <= 0.20) & (c("_pr") <= 0.25)
    d = d.withColumns({"_strong": strong, "_listing": listing, "_columns": columns})
    aligned = c("_columns") | c("_strong") | c("_listing") | ((c("_multi") >= 5) & (c("_zones") >= 2))
    candidate = (c("_r") >= 3) & aligned & (c("_lr") <= 0.35) & (c("_pr") <= 0.35) & (c("_title") | (c("_num") >= 2) | c("_strong"))
    d = d.withColumn("_candidate", candidate)
    dense = (c("_r") >= 4) & (c("_cmp") >= 3) & (c("_lr") <= 0.20) & (c("_pr") <= 0.25) & (c("_title") | (F.size("_hits") >= 3) | c("_strong"))
    mixed = c("_candidate") & ((c("_head") >= 10) | (c("_pr") > 0.20))
    d = d.withColumns({"_confirmed": c("_candidate") & (c("_listing") | dense), "_mixed": mixed})
    points = [
        (c("_title"), 3, "title"), (F.size("_hits") >= 3, 3, "headers"), ((F.size("_hits") == 2) & c("_vocabulary"), 2, "special"), (c("_r") >= 4, 2, "rows"), (c("_columns"), 2, "columns"),
        (c("_num") >= 2, 1, "numeric"), (c("_cmp") >= 3, 2, "compact"), (c("_vocabulary"), 3, "matrix"), (c("_zones") >= 2, 2, "zones"), (c("_lr") >= 0.30, -4, "legal"), (c("_pr") >= 0.30, -2, "prose"),
    ]
    score = sum((F.when(k, F.lit(v)).otherwise(F.lit(0)) for k, v, _ in points), F.lit(0))
    found = F.when(c("_confirmed") & ~c("_mixed"), "confirmed").when(c("_mixed"), "mixed_candidate").when(c("_candidate"), "candidate").otherwise("not_table")
    ratio = c("_legal") / F.greatest(c("_n"), F.lit(1))
    coordinates = (c("_coords") >= F.greatest(F.lit(4), F.floor(c("_n") / 3))) & ~c("_opens")
    continued = (c("_compact") >= 3) & (c("_zones") >= 2) & ((F.size("_urban") >= 2) | (c("_compact") >= 4)) & (ratio <= 0.25) & ~c("_titled") & ~c("_signed")

    def result(cls, points_, rows_, columns_, hits, why, index, legal, prose, numeric, compact, multi, urban, zones, profile) -> Column:
        whole = {
            "classification": cls, "suspected": cls == "confirmed", "score": points_, "row_count": rows_, "stable_columns": columns_, "header_hits": hits, "reasons": why, "header_line_index": index,
            "legal_list_ratio": legal, "prose_ratio": prose, "numeric_rows": numeric, "compact_value_rows": compact, "multi_column_lines": multi, "urban_parameter_hits": urban,
            "zone_code_count": zones, "content_profile": profile,
        }
        kinds = {"classification": "string", "suspected": "boolean", "header_hits": _EMPTY, "reasons": _EMPTY, "urban_parameter_hits": _EMPTY, "content_profile": "string", "legal_list_ratio": "double", "prose_ratio": "double"}
        return F.struct(*[v.cast(kinds.get(k, "int")).alias(k) for k, v in whole.items()])

    zero, null = F.lit(0), F.lit(None)

    def empty(profile: Column, multi: Column = zero) -> Column:
        return result(F.lit("not_table"), zero, zero, zero, _none(), _none(), null, F.lit(0.0), F.lit(0.0), zero, zero, multi, _none(), zero, profile)

    more = result(F.lit("continuation_candidate"), F.lit(7), c("_multi"), zero, _none(), F.array(F.lit(L.REASONS["continuation"])), null, F.bround(ratio, 4), F.lit(0.0), c("_numeric"), c("_compact"), c("_multi"), c("_urban"), c("_zones"), F.lit("urban_matrix_continuation"))
    profile = F.when(c("_mixed"), "mixed_urban_matrix").when(c("_vocabulary"), "urban_matrix").otherwise("generic_table")
    full = result(found, score, c("_r"), c("_stable"), c("_hits"), said(*[(k, L.REASONS[r]) for k, _, r in points]), c("_head") + 1, F.bround("_lr", 4), F.bround("_pr", 4), c("_num"), c("_cmp"), c("_multi"), c("_page_urban"), c("_zones"), profile)
    table = (
        F.when(c("_n") < 3, empty(F.lit("prose"))).when(coordinates, empty(F.lit("coordinates"), c("_multi"))).when(continued, more)
        .when(c("_best").isNull(), empty(F.when(c("_legal") >= c("_n") * 0.3, "legal_list").otherwise("prose"))).otherwise(full)
    )
    d = d.withColumn("table", table)
    return d.select(*pages.columns, "table")


def coordinates(text: Column, folded: Column | None = None) -> Column:
    """Struct of what speaks for a register of coordinates. folded: T.fold_upper() of text, where it is a column, so that no pattern folds it again."""
    t = T.fold_upper(F.coalesce(text, F.lit(""))) if folded is None else folded
    pairs = F.regexp_count(t, F.lit(L.XY_PAIR)) + F.regexp_count(t, F.lit("(?d)" + L.LAT_LONG_PAIR))
    numbers, words = F.regexp_count(t, F.lit(L.COORDINATE_NUMBER)), T.hits(t, L.COORDINATE_WORDS)
    n = F.size(words)
    score = F.least(pairs, F.lit(10)) * 2 + F.when(numbers >= 8, F.least(F.floor(numbers / 4), F.lit(8))).otherwise(0) + F.least(n, F.lit(5))
    found = (pairs >= 4) | ((numbers >= 12) & (n >= 2)) | ((pairs >= 2) & (numbers >= 8) & (n >= 1))
    reasons = said((pairs > 0, F.concat(pairs.cast("string"), F.lit(" pares explicitos de coordenadas"))), (numbers >= 8, L.REASONS["numbers"]), (n > 0, L.REASONS["geodetic"]))
    return F.struct(found.alias("detected"), score.cast("int").alias("score"), pairs.alias("pair_count"), numbers.alias("numeric_coordinate_count"), words.alias("keyword_hits"), reasons.alias("reasons"))


def is_coordinate_register(found: Column, table: Column, strong_grid: Column) -> Column:
    """Whether coordinates come before the table assessment of the page."""
    clear = (table["classification"] == "confirmed") & (table["stable_columns"] >= 3) & ((F.size(table["header_hits"]) >= 2) | (F.size(table["urban_parameter_hits"]) >= 2) | (table["row_count"] >= 4))
    return found["detected"] & ~F.coalesce(strong_grid, F.lit(False)) & ~F.coalesce(clear, F.lit(False))


def map_class(text: Column, images: Column, complex_: Column, most: int = 700) -> Column:
    """none, map_cover, map_candidate or map_confirmed."""
    t = T.squeeze(F.coalesce(text, F.lit("")))
    word, spatial, drawn = (t.rlike("(?iu)" + p) for p in (L.MAP_WORD, L.SPATIAL, L.CARTOGRAPHIC))
    cover = t.rlike("(?iu)" + L.COVER) | ((F.length(t) <= 180) & t.rlike("(?iu)" + L.COVER_LAYOUT) & ~drawn)
    evidence = word.cast("int") + spatial.cast("int") + drawn.cast("int") + complex_.cast("int")
    outside = (F.coalesce(images, F.lit(0)) < 1) | (F.length(t) > most) | ~(word | spatial)
    return F.when(outside, "none").when(cover & ~complex_, "map_cover").when((evidence >= 2) & (drawn | complex_), "map_confirmed").otherwise("map_candidate")


def is_map(kind: Column) -> Column:
    return kind.isin("map_candidate", "map_confirmed")


def _clean_lines(text: Column) -> Column:
    return F.filter(F.transform(T.split_lines(F.coalesce(text, F.lit(""))), T.squeeze), lambda x: x != "")


def map_title(text: Column, page: Column) -> Column:
    lines = _clean_lines(text)
    named = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "(?iu)" + L.MAP_TITLE, 0)), lambda x: x != ""), F.lit(0))
    placed = F.left(F.get(F.filter(lines, lambda x: x.rlike("(?iu)" + L.SPATIAL)), F.lit(0)), F.lit(160))
    return F.coalesce(T.trim_marks(named), T.trim_marks(placed), F.concat(F.lit("Mapa da página "), page.cast("string")))


def table_title(text: Column, page: Column) -> Column:
    first = F.get(F.filter(_clean_lines(text), lambda x: _title(T.fold_upper(x))), F.lit(0))
    return F.coalesce(T.trim_marks(F.left(first, F.lit(180))), F.concat(F.lit("Tabela ou quadro da página "), page.cast("string")))


def vector_grids(operations: DataFrame, *keys: str) -> DataFrame:
    """Grid evidence per page from drawn rectangles (keys, width, height); one shuffle, on the page."""
    w, h = F.abs(F.col("width")), F.abs(F.col("height"))
    counts = operations.groupBy(*keys).agg(
        F.count("*").cast("int").alias("rectangle_count"), F.count_if((h <= 2.5) & (w >= 20)).cast("int").alias("horizontal_lines"), F.count_if((w <= 2.5) & (h >= 8)).cast("int").alias("vertical_lines")
    )
    return counts.select(*keys, grid_evidence(F.col("rectangle_count"), F.col("horizontal_lines"), F.col("vertical_lines")).alias("g")).select(*keys, "g.*")


def grid_evidence(n: Column, a: Column, b: Column) -> Column:
    """Struct of what a number of rectangles, of thin horizontal and of thin vertical ones say of a grid."""
    found, strong = (n >= 10) & (a >= 4) & (b >= 3), (n >= 16) & (a >= 8) & (b >= 6)
    score = F.when(found, 3).otherwise(0) + F.when(strong, 3).otherwise(0) + F.floor(F.least(a, F.lit(20)) / 4) + F.floor(F.least(b, F.lit(20)) / 3)
    return F.struct(
        found.alias("detected"), strong.alias("strong"), score.cast("int").alias("score"), n.alias("rectangle_count"), a.alias("horizontal_lines"), b.alias("vertical_lines"),
        said((found, L.REASONS["grid"]), (strong, L.REASONS["strong_grid"])).alias("reasons"),
    )


def legal_markers(text: Column) -> Column:
    t = T.fold_upper(text)
    return sum((t.rlike(p).cast("int") for p in L.LEGAL_PRESENCE), F.lit(0))


def merge_grid(table: Column, grid: Column, text: Column) -> Column:
    """The table assessment with the evidence of the page's vector grid; never more than a candidate."""
    found = F.coalesce(grid["detected"], F.lit(False))
    visual = found & (table["classification"] == "not_table")
    titled = F.array_contains(table["reasons"], L.REASONS["title"])
    prose = ~found & (table["classification"] == "candidate") & (table["content_profile"] == "generic_table") & (table["legal_list_ratio"] >= 0.20) & (F.size(table["header_hits"]) <= 2) & ~titled & (legal_markers(text) >= 3)
    reasons = F.array_union(table["reasons"], F.coalesce(grid["reasons"], _none()))
    count = lambda name: F.coalesce(grid[name], F.lit(0))
    kept = ["row_count", "stable_columns", "header_hits", "header_line_index", "legal_list_ratio", "prose_ratio", "numeric_rows", "compact_value_rows", "multi_column_lines", "urban_parameter_hits", "zone_code_count"]
    return F.struct(
        F.when(visual, "visual_candidate").when(prose, "not_table").otherwise(table["classification"]).alias("classification"),
        F.when(visual | prose, F.lit(False)).otherwise(table["suspected"]).alias("suspected"), (table["score"] + F.when(visual, count("score")).otherwise(0)).alias("score"),
        F.when(visual, "visual_grid").when(prose, "legal_amendment").otherwise(table["content_profile"]).alias("content_profile"),
        F.when(prose, F.array_append(reasons, F.lit(L.REASONS["amendment"]))).otherwise(reasons).alias("reasons"), *[table[k].alias(k) for k in kept],
        found.alias("visual_grid_detected"), F.coalesce(grid["strong"], F.lit(False)).alias("visual_grid_strong"), count("score").alias("visual_grid_score"), count("rectangle_count").alias("vector_rectangle_count"),
        count("horizontal_lines").alias("vector_horizontal_lines"), count("vertical_lines").alias("vector_vertical_lines"),
    )


def legal_false_positive(text: Column, table: Column) -> Column:
    """Whether a table candidate is legal prose after all."""
    marks = F.regexp_count(text, F.lit("(?iu)" + L.LEGAL_MARKER))
    weak = table["classification"].isin("candidate", "mixed_candidate", "continuation_candidate") & (F.size(table["header_hits"]) <= 2) & (F.size(table["urban_parameter_hits"]) <= 1)
    return F.coalesce(~table["visual_grid_detected"] & (marks >= 3) & weak & ~table["content_profile"].isin("urban_matrix", "mixed_urban_matrix"), F.lit(False))


def diagram_words(text: Column) -> Column:
    return T.fold_upper(F.coalesce(text, F.lit(""))).rlike(L.DIAGRAM_WORDS)


def table_words(text: Column) -> Column:
    return T.fold_upper(F.coalesce(text, F.lit(""))).rlike(L.TABLE_WORDS)


def raster_decision(h: Column, v: Column, crossings: Column, regions: Column, boxes: Column, area: Column, table_text: Column, diagram_text: Column, context: Column) -> Column:
    """Class of a page image from the counts of its lines, crossings, regions and boxes, with its score and reasons.

    A diagram counts as detected too. A partial grid is a table only in context, and else stays latent evidence.
    """
    R = L.REASONS
    regular = (crossings / F.greatest(h + v, F.lit(1)) >= 1.15) & (crossings >= 8)
    whole = (h >= 4) & (v >= 3) & (crossings >= 6) & (area >= 0.04) & (regular | table_text)
    partial = (h >= 3) & (v >= 2) & (crossings >= 4) & (regions >= 2) & (area >= 0.02) & ~diagram_text
    strong = (h >= 8) & (v >= 6) & (crossings >= 20) & (area >= 0.08) & regular
    drawn = diagram_text | (~partial & (~regular | (crossings < F.greatest(F.lit(12), 4 * boxes))))
    diagram = (boxes >= 2) & (h + v >= 4) & area.between(0.008, 0.60) & drawn & ~strong
    promoted = partial & context
    table = whole | promoted
    is_diagram = diagram & (diagram_text | ~table)
    is_table = table & ~is_diagram
    kind = F.when(is_diagram, "diagram_candidate").when(is_table, "raster_table_candidate").otherwise("none")
    step = lambda x, most, width: F.floor(F.least(x, F.lit(most)) / width)
    table_score = F.lit(4) + step(h, 20, 4) + step(v, 20, 3) + step(crossings, 40, 8) + F.when(table_text, 2).otherwise(0) + F.when(strong, 4).otherwise(0)
    score = F.when(is_diagram, F.lit(4) + F.least(boxes, F.lit(10)) + F.when(diagram_text, 3).otherwise(0)).when(is_table, table_score).otherwise(0)
    why = F.when(strong, R["raster_strong"]).when(~whole, R["raster_context"]).otherwise(R["raster_cells"])
    reasons = said((is_diagram & diagram_text, R["diagram_words"]), (is_diagram, R["boxes"]), (is_table, why), (~is_diagram & ~is_table & partial, R["raster_latent"]))
    return F.struct(
        kind.alias("classification"), (is_diagram | is_table).alias("detected"), (strong & is_table).alias("strong"), score.cast("int").alias("score"), partial.alias("partial_grid_detected"), promoted.alias("contextual_continuation"),
        regular.alias("regular"), table_text.alias("table_text_evidence"), diagram_text.alias("diagram_text_evidence"), reasons.alias("reasons"),
    )


def map_visual(ink: Column, edges: Column, parts: Column) -> Column:
    """Whether a page image is dense or varied enough for a map, or sparse enough for a cover; the reason is one of three."""
    dense, varied, full = (ink >= 0.045) & (edges >= 0.025), (ink >= 0.055) & (edges >= 0.012) & (parts >= 18), (ink >= 0.09) & (parts >= 12)
    complex_ = dense | varied | full
    cover = ~complex_ & ((ink <= 0.035) | ((parts <= 8) & (edges <= 0.012)) | ((ink <= 0.05) & (edges <= 0.010)))
    reasons = said((dense, L.REASONS["dense"]), (~dense & complex_, L.REASONS["diverse"]), (cover, L.REASONS["cover"]))
    return F.struct(
        complex_.alias("visual_complexity"), cover.alias("cover_like"), F.round(ink, 6).alias("ink_ratio"), F.round(edges, 6).alias("edge_ratio"), parts.alias("component_count"), reasons.alias("reasons")
    )


def confirmed_map(text: Column, images: Column, visual: Column) -> Column:
    """map_class() of a page with the evidence of its image (map_visual): a sparse page that isn't confirmed is a cover."""
    kind = map_class(text, F.greatest(F.coalesce(images, F.lit(0)), F.lit(1)), visual["visual_complexity"])
    return F.when(visual["cover_like"] & (kind != "map_confirmed"), "map_cover").otherwise(kind)


def ocr_evidence(pages: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Pages with the raster decision after the second pass over their neighbours: a latent grid beside a table is a table.

    pages: doc, page, text, and raster counts as of raster.metrics in a struct column ``m``; page_type and route of the diagnosis. Only pages of
    route ocr have raster evidence. Adds raster (struct) and promoted. One window per document.
    """
    c = F.col
    own = (c("route") == "ocr") & c("m").isNotNull()
    m = c("m")

    # what the decision looks at again and again are columns of their own
    counts = {f"_{k}": F.coalesce(m[k], F.lit(0)) for k in ("horizontal_lines", "vertical_lines", "intersections", "closed_regions", "boxes", "area")}
    helpers = [*counts, "_table_words", "_diagram_words"]

    def decided(context: Column) -> Column:
        return raster_decision(*[c(k) for k in helpers], context)

    pages = pages.withColumns(counts | {"_table_words": table_words(c("text")), "_diagram_words": diagram_words(c("text"))})
    d = pages.withColumn("_first", F.when(own, decided(F.lit(False))))
    seed = c("page_type").isin("table", "table_candidate") | F.coalesce(c("_first.classification") == "raster_table_candidate", F.lit(False))
    latent = F.coalesce(c("_first.partial_grid_detected") & ~c("_first.detected"), F.lit(False))
    d = promote_by_context(d.withColumns({"_latent": latent, "_seed": seed}), doc, page, "_latent", "_seed")
    return d.withColumn("raster", F.when(own, decided(c("promoted")))).drop("_first", "_latent", "_seed", *helpers)


def promote_by_context(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", latent: str = "latent", seed: str = "seed") -> DataFrame:
    """pages with promoted: a latent page next to a table page is one too.

    A run of latent pages after a seed is promoted whole; before a seed, only its last page is. One window per document.
    """
    by = Window.partitionBy(doc).orderBy(page)
    island = F.sum(F.when(F.col(latent), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    d = pages.withColumns({"_isle": island, "_next": F.coalesce(F.lead(seed).over(by), F.lit(False)), "_last": ~F.coalesce(F.lead(latent).over(by), F.lit(False))})
    # the page before a run is the one that is not latent and opens its island
    before = F.coalesce(F.max(F.when(~F.col(latent), F.col(seed))).over(Window.partitionBy(doc, "_isle")), F.lit(False))
    d = d.withColumn("promoted", F.col(latent) & (before | (F.col("_last") & F.col("_next"))))
    return d.drop("_isle", "_next", "_last")


def route_pages(pages: DataFrame, least: int = 40) -> DataFrame:
    """pages (characters, raw_images, decorative_images, content_images, map_class, coordinate_register, coordinates_detected,
    table_class, grid_detected, rotated, mode, messages, is_last) with route, page_type and warnings."""
    c, W = F.col, L.WARNINGS
    native = c("characters") >= least
    confirmed = ~c("coordinate_register") & (c("table_class") == "confirmed")
    candidate = ~c("coordinate_register") & c("table_class").isin("candidate", "mixed_candidate", "continuation_candidate", "visual_candidate")
    mapped = c("map_class") != "none"
    ornament = (c("characters") == 0) & (c("raw_images") > 0) & (c("content_images") == 0) & (c("raw_images") == c("decorative_images"))
    route = F.when(mapped, "map").when(ornament, "decorative").when(c("coordinate_register") & native, "native").when(confirmed, "structured").when(native, "native").otherwise("ocr")
    kind = (
        F.when(mapped, c("map_class")).when(ornament, F.when(c("is_last"), "back_cover").otherwise("decorative_only")).when(c("coordinate_register") & native, "coordinate_register")
        .when(confirmed, "table").when(native, F.when(candidate, "table_candidate").otherwise("text")).otherwise("unknown")
    )
    first = F.coalesce(
        F.when(c("map_class") == "map_confirmed", W["map_confirmed"]).when(c("map_class") == "map_candidate", W["map_candidate"]).when(c("map_class") == "map_cover", W["map_cover"])
        .when(ornament, W["decorative"]).when(c("coordinate_register"), W["coordinates"]).when(confirmed, W["table"])
        .when(candidate, F.concat(F.replace(c("table_class"), F.lit("_"), F.lit(" ")), F.lit(W["candidate"]))).when((c("characters") > 0) & ~native, W["thin"])
    )
    more = [
        (first.isNotNull(), first), (c("grid_detected"), W["vector"]), (c("coordinates_detected") & ~c("coordinate_register"), W["subordinate"]),
        ((c("content_images") > 0) & native & ~mapped, W["hybrid"]), ((c("characters") == 0) & (c("raw_images") == 0), W["blank"]),
        (c("rotated"), F.concat(F.lit(W["rotated"]), c("mode"))), (F.size("messages") > 0, W["messages"]),
    ]
    return pages.withColumns({"route": route, "page_type": kind, "warnings": said(*more)})
