"""The catalogue of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import language, metrics, text as T
from ..operators import batch, canary, conversion, diagnosis, graphics, pages, products, quality, raster, structure
from ..sources import office, pdf, readers
from ..sources.steps import step
from . import lenses as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_q(pattern)}))"


def _all(*cases: tuple[str, str]) -> str:
    """List of the texts whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {k} THEN {_q(v)} END" for k, v in cases) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


def _squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\s\u00a0]+', ' ', 'g'))"


# --- text

_CLEAN = "replace(translate(text, '\u00a0\u200b\u200c\u200d\u2060\ufeff', ' '), chr(13), '')"
_STRIPPED = "regexp_replace(regexp_replace({0}, '^[\\s\u00a0\u0085\u2000-\u200a\u2028\u2029]+', ''), '[\\s\u00a0\u0085\u2000-\u200a\u2028\u2029]+$', '')"


@query(f"""
WITH d AS (SELECT lang, {_STRIPPED.format("text")} AS t FROM documents),
m AS (SELECT lang, length(t) AS n, {_n("t", "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")} AS w, length(regexp_replace(t, '[\\s\u00a0]', '', 'g')) AS s, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS a FROM d),
q AS (SELECT lang, (n < 80 OR w < 15 OR CASE WHEN s > 0 THEN a / s ELSE 0 END < 0.6) AS low FROM m)
SELECT lang, CASE WHEN low THEN 'low' ELSE 'high' END AS quality, low AS requires_review, count(*) AS documents FROM q GROUP BY ALL
""")
def document_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.with_ocr_quality(V.view(spark, sf_dir, "documents", "lang", "text"), "q")
    return d.groupBy("lang", c("q.quality").alias("quality"), c("q.requires_review").alias("requires_review")).agg(F.count("*").alias("documents"))


@query(f"""
WITH d AS (SELECT doc_id, replace(text, '. ', '.   ') || chr(10) || chr(10) || chr(10) || '  x' AS text FROM documents),
l AS (SELECT doc_id, list_transform(string_split({_CLEAN}, chr(10)), lambda x: regexp_replace({_STRIPPED.format("x")}, '[ \\t]{{2,}}', ' ', 'g')) AS ls FROM d)
SELECT doc_id, md5(regexp_replace({_STRIPPED.format("array_to_string(ls, chr(10))")}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS prose_md5 FROM l
""")
def prose_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.view(spark, sf_dir, "documents", "doc_id", "text")
    wide = F.concat(F.replace("text", F.lit(". "), F.lit(".   ")), F.lit("\n\n\n  x"))
    return d.select("doc_id", F.md5(T.prose(wide)).alias("prose_md5"))


@query(f"""
WITH p AS ({V.LAW_PAGES}), g AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS s, length(text) - length(regexp_replace(text, ' {{8,}}', '', 'g')) AS long, {_n("text", " {8,}")} AS gaps FROM p)
SELECT doc_id, n >= 120 AND gaps >= 3 AND (s / greatest(n, 1) >= 0.22 OR long / greatest(n, 1) >= 0.08) AS excessive FROM g
""")
def layout_spacing_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.law_pages(spark, sf_dir).select("doc_id", T.excessive_spacing(c("text")).alias("excessive"))


@query()
def native_mode_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.law_pages(spark, sf_dir)
    said = F.when(c("doc_id") % 5 == 0, F.array(F.lit("Rotated text discovered"))).otherwise(F.array().cast("array<string>"))
    d = quality.native_mode(p.select("doc_id", c("text").alias("layout_text"), T.squeeze(c("text")).alias("simple_text"), said.alias("messages")))
    return d.select("doc_id", "selected_mode", "layout_character_count", "simple_character_count", "rotated_text", "warnings", F.md5("text").alias("text_md5"))


# Every mark put in costs an edit, and so does every character left out: the distance is known without a table.
@query("SELECT doc_id, round((length(text) - length(translate(text, 'ez', '')))::DOUBLE / length(text), 9) AS cer FROM documents WHERE text <> ''")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against themselves with one letter misread throughout and another lost."""
    d = V.view(spark, sf_dir, "documents", "doc_id", "text").where("text <> ''")
    return d.select("doc_id", F.round(metrics.char_error_rate(c("text"), F.translate("text", "ez", "☃")), 9).alias("cer"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, round(len(list_filter(ws, lambda x: length(x) IN (3, 5)))::DOUBLE / len(ws), 9) AS wer FROM w WHERE len(ws) > 0""")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against themselves with words of 3 letters misread and those of 5 lost."""
    d = V.view(spark, sf_dir, "documents", "doc_id", "text").withColumn("ws", metrics.words(c("text"))).where(F.size("ws") > 0)
    read = F.transform(F.filter("ws", lambda x: F.length(x) != 5), lambda x: F.when(F.length(x) == 3, F.lit("☃")).otherwise(x))
    return d.select("doc_id", F.round(metrics.word_error_rate(c("text"), F.array_join(read, " ")), 9).alias("wer"))


# --- archives

_ORDER = "ORDER BY lower(path), ordinal"
_PLAN = f"""
WITH m AS ({V.MEMBERS}),
a AS (SELECT *, (member LIKE '../%' OR member LIKE 'C:%' OR member LIKE '/%') AS unsafe, regexp_replace(member, '^/', '') AS path, sha256(text) AS sha FROM m),
f AS (SELECT *, NOT unsafe AND lower(path) LIKE '%.pdf' AS pdf FROM a),
r AS (SELECT archive, count(DISTINCT lower(split_part(path, '/', 1))) = 1 AND bool_and(contains(path, '/')) AS one FROM f WHERE pdf GROUP BY archive),
o AS (SELECT f.*, CASE WHEN pdf THEN CASE WHEN one THEN substr(path, strpos(path, '/') + 1) ELSE path END END AS output_path, CASE WHEN pdf THEN row_number() OVER (PARTITION BY f.archive, pdf {_ORDER}) END AS position FROM f LEFT JOIN r USING (archive)),
t AS (SELECT *, row_number() OVER (PARTITION BY archive, pdf, lower(output_path) ORDER BY position) > 1 AS taken FROM o),
e AS (SELECT *, CASE WHEN unsafe THEN 'rejected' WHEN NOT pdf THEN 'ignored' WHEN taken THEN 'failed' WHEN attributes <> 0 THEN 'rejected' WHEN ordinal % 5 = 0 THEN 'resumed' END AS early FROM t),
h AS (SELECT *, first_value(path) OVER (PARTITION BY archive, early IS NULL, sha ORDER BY position) AS owner FROM e),
plan AS (SELECT archive, member, output_path, coalesce(early, CASE WHEN owner <> path THEN 'duplicate' ELSE 'to_convert' END) AS status, CASE WHEN early IS NULL AND owner <> path THEN owner END AS duplicate_of, position::INTEGER AS position, CASE WHEN pdf THEN count(*) OVER (PARTITION BY archive, pdf)::INTEGER END AS selected FROM h)
"""


@query(_PLAN + "SELECT * FROM plan")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.lens(spark, sf_dir, V.MEMBERS, "documents").withColumn("sha256", F.sha2("text", 256)).drop("text")
    # of members of one path the earlier run, like this one, took the first; whichever a plan met first isn't it
    first = m.groupBy("archive", batch.clean_path(c("member")).alias("member")).agg(F.min(F.struct("ordinal", "sha256")).alias("m"))
    old = first.where("m.ordinal % 5 = 0").select("archive", "member", F.lit("success").alias("status"), "m.sha256", F.lit(300).alias("dpi"), F.lit("1").alias("version"))
    return batch.plan_batch(m, old)


@query(_PLAN + """SELECT archive, count(position) AS pdf_count, count_if(status IN ('success', 'resumed')) AS success_count, count_if(status = 'to_convert') AS to_convert_count, count_if(status IN ('rejected', 'failed')) AS failure_count, count_if(status = 'ignored') AS skipped_count,
count_if(status = 'duplicate') AS duplicate_count, count_if(status = 'pending') AS pending_count, CASE WHEN count_if(status IN ('rejected', 'failed')) > 0 THEN 'completed_with_failures' WHEN count_if(status = 'to_convert') > 0 THEN 'running' ELSE 'completed' END AS final_status FROM plan GROUP BY archive""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_counts(batch_plan(spark, sf_dir))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.view(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"SELECT ordinal, (member LIKE '../%' OR member LIKE 'C:%' OR member LIKE '/%') AS unsafe FROM ({V.MEMBERS})")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lens(spark, sf_dir, V.MEMBERS, "documents").select("ordinal", batch.is_unsafe(c("member")).alias("unsafe"))


@query(f"""WITH f AS ({V.FILES}), x AS (SELECT *, string_split(path, '/') AS parts, regexp_extract(string_split(path, '/')[-1], '.(\\.[^.]*)$', 1) AS ending FROM f)
SELECT ordinal, path FROM x WHERE lower(ending) IN ('.md', '.csv', '.json', '.jsonl', '.txt', '.yaml', '.yml') AND NOT list_has_any(parts, ['ativos', '{batch.STAGING}', '__pycache__'])""")
def analysis_package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lens(spark, sf_dir, V.FILES, "documents").where(batch.is_packed(c("path"))).select("ordinal", "path")


@query(f"""WITH m AS ({V.MEMBERS}), old AS (SELECT archive, ordinal, sha256(text) AS sha, CASE ordinal % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'failed' ELSE 'success' END AS status, CASE WHEN ordinal % 3 = 0 THEN 200 ELSE 300 END AS dpi FROM m WHERE ordinal % 5 <> 0)
SELECT m.archive, m.ordinal FROM m LEFT JOIN old o ON o.archive = m.archive AND o.ordinal = m.ordinal AND o.sha = sha256(m.text) AND o.status IN ('success', 'duplicate') AND o.dpi = 300 WHERE o.ordinal IS NULL""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that an earlier run didn't finish with the same content and resolution."""
    m = V.lens(spark, sf_dir, V.MEMBERS, "documents").select("archive", "ordinal", F.sha2("text", 256).alias("sha256"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("success", "duplicate", "failed", "success")]), (c("ordinal") % 4 + 1).cast("int"))
    old = m.where("ordinal % 5 <> 0").select("archive", "ordinal", "sha256", status.alias("status"), F.when(c("ordinal") % 3 == 0, 200).otherwise(300).alias("dpi"))
    return m.join(old.where(batch.is_finished(300)), ["archive", "ordinal", "sha256"], "left_anti").select("archive", "ordinal")


# --- tokens

_TYPE = "CASE " + " ".join(f"WHEN {_has('u', p)} THEN '{k}'" for k, p in L.LINE_TYPES) + " ELSE 'texto' END"
_TOKENS = f"tk AS (SELECT *, CASE WHEN confidence::DOUBLE >= 0 THEN confidence::DOUBLE END AS conf FROM ({V.TOKENS}) WHERE trim(txt) <> '')"
_LINES = f"""{_TOKENS},
g AS (SELECT doc_id, page_number, block_number, paragraph_number, line_number, list_transform(list_sort(list({{'a': lft, 'b': word_number, 'c': txt}})), lambda x: x.c) AS items, {metrics.mean_sql('sum(round(conf * 1000000)::BIGINT)', 'count(conf)')} AS confidence, count(*)::INTEGER AS tokens,
  min(lft) AS x_left, min(tp) AS y_top, max(lft + wd) AS x_right, max(tp + ht) AS y_bottom FROM tk GROUP BY ALL),
j AS (SELECT * EXCLUDE (items), list_reduce(list_prepend('', items), lambda a, t: CASE WHEN a = '' THEN t WHEN t <> '-' AND (contains('{L.NO_SPACE_BEFORE}', left(t, 1)) OR contains('{L.NO_SPACE_AFTER}/', right(a, 1))) THEN a || t ELSE a || ' ' || t END) AS text FROM g),
lines AS (SELECT * EXCLUDE (u), {_TYPE} AS line_type FROM (SELECT *, upper(translate(trim(text), 'º', 'o')) AS u FROM j))"""
_BOX = {"left": "x_left", "top": "y_top", "right": "x_right", "bottom": "y_bottom"}


@query(f"WITH {_LINES} SELECT * FROM lines")
def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.token_lines(structure.read_tokens(V.tokens(spark, sf_dir))).withColumnsRenamed(_BOX)


_COLUMNS = f"""{_LINES},
w AS (SELECT *, max(x_right) OVER p - min(x_left) OVER p AS w, count(*) OVER p AS n, (x_left + x_right) / 2 AS centre FROM lines WINDOW p AS (PARTITION BY doc_id, page_number)),
nw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY centre, y_top, x_left, block_number, paragraph_number, line_number) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page_number) AS m,
  centre - lag(centre) OVER (PARTITION BY doc_id, page_number ORDER BY centre, y_top, x_left, block_number, paragraph_number, line_number) AS gap FROM w WHERE x_right - x_left <= w * 0.72::DOUBLE),
b AS (SELECT doc_id, page_number, i, gap, centre - gap / 2 AS cut FROM nw WHERE i >= 2 AND i < m - 2 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY gap DESC, i) = 1),
s AS (SELECT nw.doc_id, nw.page_number, any_value(b.cut) AS cut, any_value(nw.n) AS n, any_value(nw.w) AS w, any_value(m) AS m, any_value(b.i) AS i, any_value(b.gap) AS gap, min(y_top) FILTER (nw.i < b.i) AS lt, max(y_bottom) FILTER (nw.i < b.i) AS lb,
  min(y_top) FILTER (nw.i >= b.i) AS rt, max(y_bottom) FILTER (nw.i >= b.i) AS rb FROM nw JOIN b USING (doc_id, page_number) GROUP BY nw.doc_id, nw.page_number),
k AS (SELECT doc_id, page_number, cut FROM s WHERE n >= 6 AND w > 0 AND m >= 6 AND gap >= w * 0.18::DOUBLE AND i >= 3 AND m - i >= 3 AND least(lb, rb) > greatest(lt, rt) AND (least(lb, rb) - greatest(lt, rt)) / least(lb - lt, rb - rt) >= 0.35),
cols AS (SELECT w.* EXCLUDE (w, n, centre), CASE WHEN k.cut IS NULL THEN 1 WHEN x_right - x_left > w.w * 0.72::DOUBLE THEN 0 WHEN centre <= k.cut THEN 1 ELSE 2 END AS column_number FROM w LEFT JOIN k USING (doc_id, page_number)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y_top, column_number, x_left, block_number, paragraph_number, line_number)::INTEGER AS line_order FROM cols)"""


@query(f"WITH {_COLUMNS} SELECT doc_id, page_number, block_number, line_number, column_number, line_order FROM placed")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.token_lines(structure.read_tokens(V.tokens(spark, sf_dir)))
    return structure.assign_columns(lines).select("doc_id", "page_number", "block_number", "line_number", "column_number", "line_order")


@query(f"""WITH {_COLUMNS},
bl AS (SELECT doc_id, page_number, column_number, block_number, paragraph_number, string_agg(text, chr(10) ORDER BY y_top, x_left, line_order) AS text, coalesce(first(line_type ORDER BY y_top, x_left, line_order) FILTER (line_type <> 'texto'), 'texto') AS block_type,
  {metrics.mean_sql('sum(round(confidence * 1000000)::BIGINT)', 'count(confidence)')} AS confidence, count(*)::INTEGER AS line_count, min(x_left) AS x_left, min(y_top) AS y_top, max(x_right) AS x_right, max(y_bottom) AS y_bottom FROM placed GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y_top, column_number, x_left, block_number, paragraph_number)::INTEGER AS block_order FROM bl""")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.assign_columns(structure.token_lines(structure.read_tokens(V.tokens(spark, sf_dir))))
    return structure.blocks(lines).drop("lines").withColumnsRenamed(_BOX)


@query(f"WITH {_TOKENS} SELECT doc_id, page_number, count(*) AS tokens, count(conf) AS confident FROM tk GROUP BY ALL")
def ocr_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.read_tokens(V.tokens(spark, sf_dir)).groupBy("doc_id", "page_number").agg(F.count("*").alias("tokens"), F.count("confidence").alias("confident"))


@query(f"""WITH {_LINES}, pg AS (SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY line_number, block_number) AS t, sum(round(confidence * 1000000)::BIGINT) AS total, count(confidence) AS cn FROM lines GROUP BY ALL),
q AS (SELECT doc_id, page_number, length(t) AS n, {_n("t", "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")} AS w, length(replace(t, ' ', '')) AS s, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS a, {metrics.mean_sql('total', 'cn')} AS mc, total / (cn * 1000000) AS exact FROM pg),
z AS (SELECT *, n < 80 OR w < 15 OR (CASE WHEN s > 0 THEN a / s ELSE 0 END) < 0.6 OR coalesce(exact < 55, false) AS low FROM q)
SELECT doc_id, page_number, w::INTEGER AS word_count, mc AS mean_confidence, CASE WHEN low THEN 'low' WHEN exact < 75 THEN 'medium' ELSE 'high' END AS quality FROM z""")
def ocr_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.token_lines(structure.read_tokens(V.tokens(spark, sf_dir)))
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "block_number", "text")))
    p = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.collect_list("confidence").alias("confidences"))
    return quality.with_ocr_quality(p, "q", "text", "confidences").select("doc_id", "page_number", "q.word_count", "q.mean_confidence", "q.quality")


_MARKS = ["TITULO I ", "Capítulo 2 ", "SUBSEÇÃO IV ", "Seção 1 ", "Art. 5º ", "§ 1º ", "IV - ", "b) ", "3. ", ""]


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT ([{", ".join(_q(m) for m in _MARKS)}])[pos % 10 + 1] || line AS line FROM l), f AS (SELECT upper(translate(strip_accents(trim(line)), 'ºª', 'oa')) AS u FROM m)
SELECT {_TYPE} AS line_type, count(*) AS lines FROM f GROUP BY ALL""")
def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.view(spark, sf_dir, "documents", "text").select(F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = F.concat(F.get(F.array(*[F.lit(m) for m in _MARKS]), c("pos") % 10), c("line"))
    return l.select(structure.line_type(marked).alias("line_type")).groupBy("line_type").agg(F.count("*").alias("lines"))


# --- graphics

_POS = "CASE WHEN y1 <= {0} THEN 'bottom' WHEN y0 >= 1.0::DOUBLE - {0} THEN 'top' WHEN x1 <= {0} THEN 'left' WHEN x0 >= 1.0::DOUBLE - {0} THEN 'right' ELSE 'interior' END"
_GRAPHICS = f"gr AS (SELECT *, {_POS.format('0.12::DOUBLE')} AS position, {_POS.format('0.15::DOUBLE')} AS wide, (x1 - x0) * (y1 - y0) AS area_ratio FROM ({V.GRAPHICS}))"
_RULES = f"""{_GRAPHICS},
core AS (SELECT * FROM gr WHERE page_number > 1 AND page_number < page_count),
pc AS (SELECT doc_id, fingerprint, position, count(*) AS n, min(page_number::BIGINT * 100000000000 + ordinal) AS f FROM core GROUP BY ALL),
mp AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, fingerprint) AS core FROM pc QUALIFY row_number() OVER (PARTITION BY doc_id, fingerprint ORDER BY n DESC, f) = 1),
el AS (SELECT c.*, mp.core FROM core c JOIN mp USING (doc_id, fingerprint, position) WHERE position <> 'interior' AND mp.n / mp.core >= 0.95 AND area_ratio <= 0.05),
md AS (SELECT doc_id, fingerprint, position, count(*) AS ok, any_value(core) AS core, median(x0) AS a, median(y0) AS b, median(x1) AS c, median(y1) AS d FROM el GROUP BY ALL),
st AS (SELECT el.doc_id, el.fingerprint, count(*) AS stable FROM el JOIN md USING (doc_id, fingerprint) WHERE abs(x0 - a) <= 0.025 AND abs(y0 - b) <= 0.025 AND abs(x1 - c) <= 0.025 AND abs(y1 - d) <= 0.025 GROUP BY ALL),
al AS (SELECT doc_id, fingerprint, count(*) AS occurrences, count(DISTINCT page_number) AS pages, any_value(page_count) AS page_count FROM gr GROUP BY ALL),
cp AS (SELECT doc_id, fingerprint, count(DISTINCT page_number) AS core_pages FROM core GROUP BY ALL),
rules AS (SELECT md.doc_id, md.fingerprint, 'graphic-' || left(md.fingerprint, 12) AS graphic_id, occurrences, pages AS pages_with_it, round(pages / greatest(page_count, 1), 6) AS page_ratio, position, round(a, 6) AS m_x0, round(b, 6) AS m_y0, round(c, 6) AS m_x1, round(d, 6) AS m_y1
  FROM md JOIN st USING (doc_id, fingerprint) JOIN al USING (doc_id, fingerprint) JOIN cp USING (doc_id, fingerprint) WHERE core_pages >= greatest(5, ceil(0.7 * greatest(page_count - 2, 1))) AND ok / core >= 0.95 AND stable / core >= 0.95)"""
_PAGE_GRAPHICS = f"""{_RULES},
pf AS (SELECT doc_id, page_number, fingerprint, max(image_weight) AS w, bool_or(coalesce(gr.position = r.position AND area_ratio <= 0.05 AND abs(x0 - m_x0) <= 0.025 AND abs(y0 - m_y0) <= 0.025 AND abs(x1 - m_x1) <= 0.025 AND abs(y1 - m_y1) <= 0.025, false)) AS d,
  bool_or(r.fingerprint IS NOT NULL AND wide <> 'interior' AND area_ratio <= 0.05) AS e FROM gr LEFT JOIN rules r USING (doc_id, fingerprint) GROUP BY ALL),
pg AS (SELECT doc_id, page_number, sum(w)::BIGINT AS raw_images, coalesce(sum(w) FILTER (d), 0)::BIGINT AS decorative_images, coalesce(sum(w) FILTER (e), 0)::BIGINT AS more FROM pf GROUP BY ALL)"""


def _graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.distinct_occurrences(graphics.with_geometry(V.lens(spark, sf_dir, V.GRAPHICS, "events")))


@query(f"WITH {_GRAPHICS} SELECT position, count(*) AS n FROM gr GROUP BY ALL")
def graphic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.with_geometry(V.lens(spark, sf_dir, V.GRAPHICS, "events")).groupBy("position").agg(F.count("*").alias("n"))


@query(f"WITH {_RULES} SELECT * FROM rules")
def repeated_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.repeated_graphics(_graphics(spark, sf_dir))


@query(f"WITH {_PAGE_GRAPHICS} SELECT doc_id, page_number, raw_images, decorative_images, greatest(raw_images - decorative_images, 0) AS content_images FROM pg")
def page_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.page_graphics(_graphics(spark, sf_dir))


@query(f"WITH {_PAGE_GRAPHICS} SELECT doc_id, page_number, raw_images, least(greatest(decorative_images, more), raw_images) AS decorative_images, greatest(raw_images - greatest(decorative_images, more), 0) AS content_images FROM pg")
def graphics_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.page_graphics(_graphics(spark, sf_dir), refined=True)


# --- classifiers

_GRID = f"""vg AS (SELECT doc_id, count(*)::INTEGER AS rectangle_count, count_if(abs(height) <= 2.5 AND abs(width) >= 20)::INTEGER AS horizontal_lines, count_if(abs(width) <= 2.5 AND abs(height) >= 8)::INTEGER AS vertical_lines FROM ({V.VECTORS}) GROUP BY ALL),
grid AS (SELECT *, rectangle_count >= 10 AND horizontal_lines >= 4 AND vertical_lines >= 3 AS detected, rectangle_count >= 16 AND horizontal_lines >= 8 AND vertical_lines >= 6 AS strong FROM vg)"""


@query(f"WITH {_GRID} SELECT *, (detected::INT * 3 + strong::INT * 3 + least(horizontal_lines, 20) // 4 + least(vertical_lines, 20) // 3)::INTEGER AS score, {_all(('detected', L.REASONS['grid']), ('strong', L.REASONS['strong_grid']))} AS reasons FROM grid")
def vector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.vector_grids(V.lens(spark, sf_dir, V.VECTORS, "lineitem"), "doc_id")


@query(f"""WITH l AS (SELECT doc_id, rtrim(line) AS line, upper(line) AS u, {_n("trim(line)", " {2,}")} + 1 AS cells, {_n("line", L.NUMBER)} AS numbers FROM ({V.LAW}) WHERE trim(line) <> '')
SELECT doc_id, count(*) AS lines, count_if(cells >= 3) AS multi_column, count_if(cells >= 3 AND numbers >= 2) AS numeric_aligned, count_if({_has("u", L.ZONE_CODE)}) AS zone_lines, count_if({_has("line", L.COORDINATE_LINE)}) AS coordinate_lines,
count_if({_has("trim(u)", L.LEGAL_PREFIX)} OR trim(u) LIKE '%;') AS legal_lines FROM l GROUP BY doc_id""")
def table_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.lens(spark, sf_dir, V.LAW, "part").where(F.trim("line") != "").select("doc_id", pages._line(T.rstrip(c("line"))).alias("x"))
    many = F.size("x.starts") >= 3
    return l.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(many).alias("multi_column"), F.count_if(many & (c("x.numbers") >= 2)).alias("numeric_aligned"), F.count_if("x.zone").alias("zone_lines"),
        F.count_if("x.coordinate").alias("coordinate_lines"), F.count_if("x.legal").alias("legal_lines"),
    )


def _hits(column: str, patterns: dict[str, str]) -> str:
    return _all(*[(_has(column, p), k) for k, p in patterns.items()])


_WHY = L.REASONS
_TITLE_SQL = "length({0}) <= 220 AND NOT " + _has("{0}", "@P") + " AND (" + " OR ".join(_has("{0}", f"@{k}") for k in range(3)) + ")"
for _k, _p in (("@P", L.LEGAL_PREFIX), ("@0", L.TITLE_TABLE), ("@1", L.TITLE_ANNEX), ("@2", L.TITLE_NOMINAL)):
    _TITLE_SQL = _TITLE_SQL.replace(_k, _p.replace("'", "''").replace("{", "{{").replace("}", "}}"))
_MANY, _FEW = "len(starts) >= 3", "len(starts) < 3"
_COMPACT = "len(starts) >= 3 AND words <= 24 AND (numbers >= 2 OR zone)"
_NONE = "[]::VARCHAR[]"
_POINTS = [
    ("title", 3, "title"), ("nh >= 3", 3, "headers"), ("nh = 2 AND vocabulary", 2, "special"), ("r >= 4", 2, "rows"), ("columns_", 2, "columns"), ("num >= 2", 1, "numeric"), ("cmp >= 3", 2, "compact"), ("vocabulary", 3, "matrix"),
    ("zones >= 2", 2, "zones"), ("lr >= 0.30", -4, "legal"), ("pr >= 0.30", -2, "prose"),
]
_TABLES = f"""tl0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({V.LAW_PAGES})),
tl1 AS (SELECT doc_id, rtrim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM tl0 WHERE rtrim(line) <> ''),
tl2 AS (SELECT *, upper(line) AS u, trim(upper(line)) AS t, trim(regexp_replace(upper(line), '\\s+', ' ', 'g')) AS sq, regexp_extract_all(line, ' +|[^ ]+(?: [^ ]+)*') AS parts FROM tl1),
tl AS (SELECT doc_id, k, line, u, list_filter(list_transform(range(1, len(parts) + 1), lambda j: CASE WHEN NOT starts_with(parts[j], ' ') THEN length(array_to_string(parts[1:j - 1], '')) END), lambda x: x IS NOT NULL) AS starts,
  {_n("line", "[^ ]+")} AS words, {_n("line", L.NUMBER)} AS numbers, {_TITLE_SQL.format("sq")} AS title, {_has("t", L.LEGAL_PREFIX)} AS prefixed, {_has("t", L.LEGAL_PREFIX)} OR ends_with(t, ';') AS legal,
  {_has("line", L.COORDINATE_LINE)} AS coordinate, {_has("u", L.ZONE_CODE)} AS zone, len({_hits("u", L.HEADERS)}) AS headers FROM tl2),
tp0 AS (SELECT doc_id, count(*) AS n, count_if(coordinate) AS coords, count_if(legal) AS legals, count_if({_MANY}) AS multi, count_if({_COMPACT}) AS compacts, count_if({_MANY} AND numbers >= 2) AS numerics, bool_or(title AND k < 8) AS titled,
  bool_or({_MANY} AND headers >= 2) AS signed, string_agg(u, chr(10) ORDER BY k) AS page FROM tl GROUP BY doc_id),
tp AS (SELECT *, {_n("page", L.ZONE_CODE)} AS zones, {_hits("page", L.URBAN)} AS urban, {_has("page", L.TITLE_TABLE)} OR {_has("page", L.TITLE_ANNEX)} AS opens FROM tp0),
tw AS (SELECT a.doc_id, a.k AS s, w, string_agg(b.u, ' ' ORDER BY b.k) AS t, sum(greatest(len(b.starts) - 1, 0)) AS gaps FROM tl a CROSS JOIN (VALUES (1), (2), (3)) v(w) JOIN tl b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.k < a.k + w
  GROUP BY a.doc_id, a.k, w HAVING count(*) = w AND NOT bool_or(b.prefixed)),
th AS (SELECT *, {_hits("t", L.HEADERS)} AS hh, {_hits("t", L.URBAN)} AS hu FROM tw WHERE gaps >= 2),
tb AS (SELECT *, s + w AS stop FROM th WHERE len(hh) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(hh) + len(hu) DESC, gaps DESC, s, w) = 1),
td AS (SELECT tl.*, NOT legal AND {_MANY} AS is_row FROM tl JOIN tb USING (doc_id) WHERE k >= stop AND k < stop + 45),
ta AS (SELECT doc_id, count(*) AS m, count_if(legal) AS legal_rows, count_if(NOT legal AND {_FEW} AND words >= 14) AS proses, count_if(is_row) AS r, count_if(is_row AND numbers >= 1) AS num, count_if(is_row AND {_COMPACT}) AS cmp FROM td GROUP BY doc_id),
tk AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_transform(starts, lambda p: round_even(p / 4, 0)))) AS bucket FROM td WHERE is_row) GROUP BY ALL),
ts AS (SELECT doc_id, count_if(tk.n >= greatest(3, ceil(ta.r * 0.35::DOUBLE))) AS stable FROM tk JOIN ta USING (doc_id) GROUP BY doc_id),
tt AS (SELECT tb.doc_id, bool_or(title) AS near FROM tb JOIN tl ON tl.doc_id = tb.doc_id AND k >= s - 5 AND k < stop GROUP BY tb.doc_id),
t1 AS (SELECT tp.*, tb.s AS head, tb.stop, hh, len(hh) AS nh, titled OR coalesce(near, false) AS title, list_sort(list_distinct(list_concat(urban, coalesce(hu, {_NONE})))) AS page_urban, coalesce(legal_rows, 0) / greatest(coalesce(m, 0), 1) AS lr,
  coalesce(proses, 0) / greatest(coalesce(m, 0), 1) AS pr, coalesce(r, 0) AS r, coalesce(num, 0) AS num, coalesce(cmp, 0) AS cmp, coalesce(stable, 0) AS stable, legals / greatest(n, 1) AS ratio
  FROM tp LEFT JOIN tb USING (doc_id) LEFT JOIN ta USING (doc_id) LEFT JOIN ts USING (doc_id) LEFT JOIN tt USING (doc_id)),
t2 AS (SELECT *, stable BETWEEN 2 AND 14 AS columns_, len(page_urban) >= 4 OR (list_contains(hh, 'territorial') AND list_contains(hh, 'uso') AND len(page_urban) >= 2) AS vocabulary FROM t1),
t3 AS (SELECT *, vocabulary AND r >= 3 AND cmp >= 2 AND (zones >= 1 OR num >= 3) AND lr <= 0.30 AS strong, title AND nh >= 3 AND r >= 4 AND num >= 3 AND lr <= 0.20 AND pr <= 0.25 AS listing FROM t2),
t4 AS (SELECT *, r >= 3 AND (columns_ OR strong OR listing OR (multi >= 5 AND zones >= 2)) AND lr <= 0.35 AND pr <= 0.35 AND (title OR num >= 2 OR strong) AS cand FROM t3),
t5 AS (SELECT *, cand AND (head >= 10 OR pr > 0.20) AS mixed, cand AND (listing OR (r >= 4 AND cmp >= 3 AND lr <= 0.20 AND pr <= 0.25 AND (title OR nh >= 3 OR strong))) AS conf FROM t4),
t6 AS (SELECT *, CASE WHEN n < 3 THEN 'short' WHEN coords >= greatest(4, floor(n / 3)) AND NOT opens THEN 'coordinates' WHEN compacts >= 3 AND zones >= 2 AND (len(urban) >= 2 OR compacts >= 4) AND ratio <= 0.25 AND NOT titled AND NOT signed THEN 'more'
  WHEN head IS NULL THEN 'empty' ELSE 'full' END AS kind FROM t5),
tables AS (SELECT doc_id, CASE kind WHEN 'more' THEN 'continuation_candidate' WHEN 'full' THEN CASE WHEN conf AND NOT mixed THEN 'confirmed' WHEN mixed THEN 'mixed_candidate' WHEN cand THEN 'candidate' ELSE 'not_table' END ELSE 'not_table' END AS classification,
  kind = 'full' AND conf AND NOT mixed AS suspected, (CASE kind WHEN 'more' THEN 7 WHEN 'full' THEN {" + ".join(f"CASE WHEN {k} THEN {v} ELSE 0 END" for k, v, _ in _POINTS)} ELSE 0 END)::INTEGER AS score,
  (CASE kind WHEN 'more' THEN multi WHEN 'full' THEN r ELSE 0 END)::INTEGER AS row_count, (CASE kind WHEN 'full' THEN stable ELSE 0 END)::INTEGER AS stable_columns, CASE kind WHEN 'full' THEN hh ELSE {_NONE} END AS header_hits,
  CASE kind WHEN 'more' THEN [{_q(_WHY["continuation"])}] WHEN 'full' THEN {_all(*[(k, _WHY[w]) for k, _, w in _POINTS])} ELSE {_NONE} END AS reasons, CASE kind WHEN 'full' THEN (head + 1)::INTEGER END AS header_line_index,
  CASE kind WHEN 'more' THEN round_even(ratio, 4) WHEN 'full' THEN round_even(lr, 4) ELSE 0::DOUBLE END AS legal_list_ratio, CASE kind WHEN 'full' THEN round_even(pr, 4) ELSE 0::DOUBLE END AS prose_ratio,
  (CASE kind WHEN 'more' THEN numerics WHEN 'full' THEN num ELSE 0 END)::INTEGER AS numeric_rows, (CASE kind WHEN 'more' THEN compacts WHEN 'full' THEN cmp ELSE 0 END)::INTEGER AS compact_value_rows,
  (CASE WHEN kind IN ('more', 'full', 'coordinates') THEN multi ELSE 0 END)::INTEGER AS multi_column_lines, CASE kind WHEN 'more' THEN urban WHEN 'full' THEN page_urban ELSE {_NONE} END AS urban_parameter_hits,
  (CASE WHEN kind IN ('more', 'full') THEN zones ELSE 0 END)::INTEGER AS zone_code_count,
  CASE kind WHEN 'short' THEN 'prose' WHEN 'coordinates' THEN 'coordinates' WHEN 'more' THEN 'urban_matrix_continuation' WHEN 'empty' THEN CASE WHEN legals >= n * 0.3 THEN 'legal_list' ELSE 'prose' END
  ELSE CASE WHEN mixed THEN 'mixed_urban_matrix' WHEN vocabulary THEN 'urban_matrix' ELSE 'generic_table' END END AS content_profile FROM t6)"""


@query(f"WITH {_TABLES} SELECT * FROM tables")
def table_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assess_tables(V.law_pages(spark, sf_dir)).select("doc_id", "table.*")


_PRESENT = " + ".join(f"{_has('u', p)}::INT" for p in L.LEGAL_PRESENCE)


@query(f"""WITH {_TABLES}, {_GRID}, px AS (SELECT doc_id, text, upper(text) AS u FROM ({V.LAW_PAGES})),
mg AS (SELECT t.*, coalesce(g.detected, false) AS found, coalesce((g.detected::INT * 3 + g.strong::INT * 3 + least(g.horizontal_lines, 20) // 4 + least(g.vertical_lines, 20) // 3), 0) AS gscore, g.detected AS gd, g.strong AS gs, px.text AS text, {_PRESENT} AS present FROM tables t JOIN px USING (doc_id) LEFT JOIN grid g USING (doc_id)),
mh AS (SELECT *, found AND classification = 'not_table' AS visual, NOT found AND classification = 'candidate' AND content_profile = 'generic_table' AND legal_list_ratio >= 0.20 AND len(header_hits) <= 2 AND NOT list_contains(reasons, {_q(_WHY["title"])}) AND present >= 3 AS prose FROM mg),
mi AS (SELECT doc_id, CASE WHEN visual THEN 'visual_candidate' WHEN prose THEN 'not_table' ELSE classification END AS classification, (score + CASE WHEN visual THEN gscore ELSE 0 END)::INTEGER AS score,
  CASE WHEN visual THEN 'visual_grid' WHEN prose THEN 'legal_amendment' ELSE content_profile END AS content_profile, list_concat(reasons, list_concat({_all(("coalesce(gd, false)", _WHY["grid"]), ("coalesce(gs, false)", _WHY["strong_grid"]))}, CASE WHEN prose THEN [{_q(_WHY["amendment"])}] ELSE {_NONE} END)) AS reasons,
  header_hits, urban_parameter_hits, found, text FROM mh)
SELECT doc_id, classification, score, content_profile, reasons, NOT found AND {_n("text", "(?i)" + L.LEGAL_MARKER)} >= 3 AND classification IN ('candidate', 'mixed_candidate', 'continuation_candidate') AND len(header_hits) <= 2 AND len(urban_parameter_hits) <= 1
AND content_profile NOT IN ('urban_matrix', 'mixed_urban_matrix') AS false_positive FROM mi""")
def table_vector_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = pages.vector_grids(V.lens(spark, sf_dir, V.VECTORS, "lineitem"), "doc_id")
    p = pages.assess_tables(V.law_pages(spark, sf_dir)).join(grids.select("doc_id", F.struct("detected", "strong", "score", "rectangle_count", "horizontal_lines", "vertical_lines", "reasons").alias("grid")), "doc_id", "left")
    merged = p.withColumn("merged", pages.merge_grid(c("table"), c("grid"), c("text")))
    return merged.select("doc_id", "merged.classification", "merged.score", "merged.content_profile", "merged.reasons", pages.legal_false_positive(c("text"), c("merged")).alias("false_positive"))


_COORD = f"""lp AS (SELECT doc_id, upper(text) AS u FROM ({V.LAW_PAGES})),
co AS (SELECT doc_id, {_n("u", L.XY_PAIR)} + {_n("u", L.LAT_LONG_PAIR)} AS pairs, len(list_filter(regexp_extract_all(u, '-?[0-9]+(?:[,.][0-9]+)?'), lambda x: regexp_full_match(x, '-?[0-9]{{4,7}}(?:[,.][0-9]{{2,}})?'))) AS nums,
  {_all(*[(_has("u", p), k) for k, p in L.COORDINATE_WORDS.items()])} AS keyword_hits FROM lp),
cd AS (SELECT *, pairs >= 4 OR (nums >= 12 AND len(keyword_hits) >= 2) OR (pairs >= 2 AND nums >= 8 AND len(keyword_hits) >= 1) AS detected FROM co)"""


@query(f"""WITH {_COORD} SELECT doc_id, detected, (least(pairs, 10) * 2 + CASE WHEN nums >= 8 THEN least(nums // 4, 8) ELSE 0 END + least(len(keyword_hits), 5))::INTEGER AS score, pairs::INTEGER AS pair_count, nums::INTEGER AS numeric_coordinate_count, keyword_hits FROM cd""")
def coordinate_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.law_pages(spark, sf_dir).select("doc_id", pages.coordinates(c("text")).alias("x")).select("doc_id", "x.detected", "x.score", "x.pair_count", "x.numeric_coordinate_count", "x.keyword_hits")


@query(f"""WITH {_TABLES}, {_COORD} SELECT t.doc_id, detected, detected AND doc_id % 9 <> 0 AND NOT (classification = 'confirmed' AND stable_columns >= 3 AND (len(header_hits) >= 2 OR len(urban_parameter_hits) >= 2 OR row_count >= 4)) AS coordinate_register
FROM tables t JOIN cd USING (doc_id)""")
def coordinate_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages.assess_tables(V.law_pages(spark, sf_dir)).withColumn("x", pages.coordinates(c("text")))
    return p.select("doc_id", "x.detected", pages.is_coordinate_register(c("x"), c("table"), c("doc_id") % 9 == 0).alias("coordinate_register"))


_MAP = f"""mt AS (SELECT doc_id, {_squeeze("text")} AS t, doc_id % 3 AS images, doc_id % 5 = 0 AS complex FROM ({V.LAW_PAGES})),
me AS (SELECT *, {_has("t", "(?i)" + L.MAP_WORD)} AS w, {_has("t", "(?i)" + L.SPATIAL)} AS s, {_has("t", "(?i)" + L.CARTOGRAPHIC)} AS g, {_has("t", "(?i)" + L.COVER)} AS cv, {_has("t", "(?i)" + L.COVER_LAYOUT)} AS cl FROM mt)"""


@query(f"""WITH {_MAP} SELECT doc_id, CASE WHEN images < 1 OR length(t) > 700 OR NOT (w OR s) THEN 'none' WHEN (cv OR (length(t) <= 180 AND cl AND NOT g)) AND NOT complex THEN 'map_cover'
WHEN w::INT + s::INT + g::INT + complex::INT >= 2 AND (g OR complex) THEN 'map_confirmed' ELSE 'map_candidate' END AS map_class FROM me""")
def map_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.law_pages(spark, sf_dir).select("doc_id", pages.map_class(c("text"), c("doc_id") % 3, c("doc_id") % 5 == 0).alias("map_class"))


_TRIM_MARKS = "regexp_replace(regexp_replace({0}, '^[ .;:-]+', ''), '[ .;:-]+$', '')"


@query(f"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_squeeze("l")}), lambda l: l <> '') AS ls FROM ({V.LAW_PAGES})),
y AS (SELECT doc_id, list_filter(list_transform(ls, lambda l: regexp_extract(l, {_q("(?i)" + L.MAP_TITLE)})), lambda l: l <> '')[1] AS named, left(list_filter(ls, lambda l: {_has("l", "(?i)" + L.SPATIAL)})[1], 160) AS placed, left(list_filter(ls, lambda l: {_TITLE_SQL.format("upper(l)")})[1], 180) AS tabled FROM x)
SELECT doc_id, coalesce({_TRIM_MARKS.format("named")}, {_TRIM_MARKS.format("placed")}, 'Mapa da página ' || doc_id) AS map_title, coalesce({_TRIM_MARKS.format("tabled")}, 'Tabela ou quadro da página ' || doc_id) AS table_title FROM y""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.law_pages(spark, sf_dir).select("doc_id", pages.map_title(c("text"), c("doc_id")).alias("map_title"), pages.table_title(c("text"), c("doc_id")).alias("table_title"))


_RASTER = f"""rp AS (SELECT *, (crossings / greatest(h + v, 1) >= 1.15 AND crossings >= 8) AS regular, priority LIKE '1%' AS tt, priority LIKE '2%' AS dt, priority LIKE '3%' AS cx FROM ({V.PAGES})),
rd AS (SELECT *, h >= 4 AND v >= 3 AND crossings >= 6 AND area >= 0.04 AND (regular OR tt) AS whole, h >= 3 AND v >= 2 AND crossings >= 4 AND regions >= 2 AND area >= 0.02 AND NOT dt AS partial, h >= 8 AND v >= 6 AND crossings >= 20 AND area >= 0.08 AND regular AS strong FROM rp),
rt AS (SELECT *, whole OR (partial AND cx) AS tbl, boxes >= 2 AND h + v >= 4 AND area >= 0.008 AND area <= 0.6 AND (dt OR (NOT partial AND (NOT regular OR crossings < greatest(12, 4 * boxes)))) AND NOT strong AS dia FROM rd),
ru AS (SELECT *, dia AND (dt OR NOT tbl) AS isd, tbl AND NOT (dia AND (dt OR NOT tbl)) AS ist FROM rt),
raster AS (SELECT doc_id, page_number, CASE WHEN isd THEN 'diagram_candidate' WHEN ist THEN 'raster_table_candidate' ELSE 'none' END AS classification, isd OR ist AS detected, strong AND ist AS strong,
  (CASE WHEN isd THEN 4 + least(boxes, 10) + dt::INT * 3 WHEN ist THEN 4 + least(h, 20) // 4 + least(v, 20) // 3 + least(crossings, 40) // 8 + tt::INT * 2 + strong::INT * 4 ELSE 0 END)::INTEGER AS score, partial AS partial_grid_detected, partial AND cx AS contextual_continuation,
  regular, tt AS table_text_evidence, dt AS diagram_text_evidence,
  list_filter([CASE WHEN isd AND dt THEN {_q(L.REASONS["diagram_words"])} END, CASE WHEN isd THEN {_q(L.REASONS["boxes"])} END, CASE WHEN ist THEN CASE WHEN strong THEN {_q(L.REASONS["raster_strong"])} WHEN NOT whole THEN {_q(L.REASONS["raster_context"])} ELSE {_q(L.REASONS["raster_cells"])} END END,
  CASE WHEN NOT isd AND NOT ist AND partial THEN {_q(L.REASONS["raster_latent"])} END], lambda x: x IS NOT NULL) AS reasons FROM ru)"""


def _raster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lens(spark, sf_dir, V.PAGES, "orders")
    flag = lambda d: c("priority").startswith(d)
    return p.withColumn("r", pages.raster_decision(c("h"), c("v"), c("crossings"), c("regions"), c("boxes"), c("area"), flag("1"), flag("2"), flag("3")))


@query(f"WITH {_RASTER} SELECT * FROM raster")
def raster_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster_pages(spark, sf_dir).select("doc_id", "page_number", "r.*")


_MV = f"""mv AS (SELECT doc_id, page_number, h / 100e0 AS ink, v / 300e0 AS edges, crossings AS parts FROM ({V.PAGES})),
mw AS (SELECT *, ink >= 0.045 AND edges >= 0.025 AS dense, (ink >= 0.055 AND edges >= 0.012 AND parts >= 18) OR (ink >= 0.09 AND parts >= 12) AS varied FROM mv)"""


@query(f"WITH {_MV} SELECT doc_id, page_number, dense OR varied AS visual_complexity, NOT (dense OR varied) AND (ink <= 0.035 OR (parts <= 8 AND edges <= 0.012) OR (ink <= 0.05 AND edges <= 0.01)) AS cover_like, {_all(("dense", L.REASONS["dense"]), ("varied AND NOT dense", L.REASONS["diverse"]), ("NOT (dense OR varied) AND (ink <= 0.035 OR (parts <= 8 AND edges <= 0.012) OR (ink <= 0.05 AND edges <= 0.01))", L.REASONS["cover"]))} AS reasons FROM mw")
def map_visual_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lens(spark, sf_dir, V.PAGES, "orders")
    m = pages.map_visual(c("h") / F.lit(100.0), c("v") / F.lit(300.0), c("crossings"))
    return p.select("doc_id", "page_number", m.alias("m")).select("doc_id", "page_number", "m.visual_complexity", "m.cover_like", "m.reasons")


@query()
def raster_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled pages, drawn from nation rows: as many lines as the key says."""
    @F.arrow_udf("binary")
    def draw(keys: pa.Array) -> pa.Array:
        out = []
        for k in keys.to_pylist():
            page = np.full((300, 240, 3), 255, np.uint8)
            for i in range(3 + k % 6):
                page[40 + 30 * i : 42 + 30 * i, 20:220] = 0
                page[40 : 42 + 30 * (2 + k % 6), 20 + 24 * i : 22 + 24 * i] = 0
            out.append(page.tobytes())
        return pa.array(out, pa.binary())

    n = V.view(spark, sf_dir, "nation")
    return n.select("n_nationkey", raster.metrics(F.lit(300), F.lit(240), draw("n_nationkey")).alias("m")).select("n_nationkey", "m.*")


@query(f"""WITH RECURSIVE pg AS (SELECT doc_id, page_number, priority LIKE '1%' OR priority LIKE '2%' AS latent, priority LIKE '5%' AS seed FROM ({V.PAGES})),
nx AS (SELECT *, coalesce(lead(seed) OVER (PARTITION BY doc_id ORDER BY page_number), false) AS ahead FROM pg),
run(doc_id, page_number, latent, promoted, state) AS (SELECT doc_id, page_number, latent, latent AND ahead, seed OR (latent AND ahead) FROM nx WHERE page_number = 1
  UNION ALL SELECT n.doc_id, n.page_number, n.latent, n.latent AND (r.state OR n.ahead), n.seed OR (n.latent AND (r.state OR n.ahead)) FROM run r JOIN nx n ON n.doc_id = r.doc_id AND n.page_number = r.page_number + 1)
SELECT doc_id, page_number, latent, promoted FROM run""")
def context_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lens(spark, sf_dir, V.PAGES, "orders")
    p = p.select("doc_id", "page_number", (c("priority").startswith("1") | c("priority").startswith("2")).alias("latent"), c("priority").startswith("5").alias("seed"))
    return pages.promote_by_context(p).drop("seed")


_W = L.WARNINGS
_ROUTED = f"""ro AS (SELECT *, characters >= 40 AS native, NOT coordinate_register AND table_class = 'confirmed' AS conf, NOT coordinate_register AND table_class IN ('candidate', 'mixed_candidate', 'visual_candidate') AS cand,
  map_class <> 'none' AS mapped, characters = 0 AND raw_images > 0 AND content_images = 0 AND raw_images = decorative_images AS orn FROM ({V.PAGES})),
routed AS (SELECT *, CASE WHEN mapped THEN 'map' WHEN orn THEN 'decorative' WHEN coordinate_register AND native THEN 'native' WHEN conf THEN 'structured' WHEN native THEN 'native' ELSE 'ocr' END AS route,
  CASE WHEN mapped THEN map_class WHEN orn THEN CASE WHEN page_number = page_count THEN 'back_cover' ELSE 'decorative_only' END WHEN coordinate_register AND native THEN 'coordinate_register' WHEN conf THEN 'table' WHEN native THEN CASE WHEN cand THEN 'table_candidate' ELSE 'text' END ELSE 'unknown' END AS page_type FROM ro)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lens(spark, sf_dir, V.PAGES, "orders")
    extra = {"mode": F.lit("layout"), "messages": F.array().cast("array<string>"), "is_last": c("page_number") == c("page_count")}
    return pages.route_pages(p.withColumns(extra))


@query(f"WITH {_ROUTED} SELECT doc_id, page_number, route, page_type FROM routed")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("doc_id", "page_number", "route", "page_type")


_FIRST = f"""CASE WHEN map_class = 'map_confirmed' THEN {_q(_W["map_confirmed"])} WHEN map_class = 'map_candidate' THEN {_q(_W["map_candidate"])} WHEN map_class = 'map_cover' THEN {_q(_W["map_cover"])} WHEN orn THEN {_q(_W["decorative"])}
WHEN coordinate_register THEN {_q(_W["coordinates"])} WHEN conf THEN {_q(_W["table"])} WHEN cand THEN replace(table_class, '_', ' ') || {_q(_W["candidate"])} WHEN characters > 0 AND NOT native THEN {_q(_W["thin"])} END"""


@query(f"""WITH {_ROUTED} SELECT doc_id, page_number, list_filter([{_FIRST}, CASE WHEN grid_detected THEN {_q(_W["vector"])} END, CASE WHEN coordinates_detected AND NOT coordinate_register THEN {_q(_W["subordinate"])} END,
CASE WHEN content_images > 0 AND native AND NOT mapped THEN {_q(_W["hybrid"])} END, CASE WHEN characters = 0 AND raw_images = 0 THEN {_q(_W["blank"])} END, CASE WHEN rotated THEN {_q(_W["rotated"] + "layout")} END], lambda x: x IS NOT NULL) AS warnings FROM routed""")
def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("doc_id", "page_number", "warnings")


@query(f"WITH {_ROUTED} SELECT page_type, route, count(*) AS pages FROM routed GROUP BY ROLLUP (page_type, route)")
def page_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).rollup("page_type", "route").agg(F.count("*").alias("pages"))


@query(f"""WITH {_ROUTED} SELECT doc_id, max(page_number) AS page_count, list_sort(coalesce(list(DISTINCT page_number) FILTER (page_type = 'map_confirmed'), [])) AS map_pages, list_sort(coalesce(list(DISTINCT page_number) FILTER (route = 'ocr'), [])) AS used_ocr_pages,
list_sort(coalesce(list(DISTINCT page_number) FILTER (page_type = 'table'), [])) AS table_pages, list_sort(coalesce(list(DISTINCT page_number) FILTER (page_type = 'table_candidate'), [])) AS table_candidate_pages, list_sort(coalesce(list(DISTINCT page_number) FILTER (route = 'decorative'), [])) AS decorative_pages,
list_sort(coalesce(list(DISTINCT page_number) FILTER (page_type = 'coordinate_register'), [])) AS coordinate_register_pages, list_sort(coalesce(list(DISTINCT page_number) FILTER (rotated), [])) AS rotated_text_pages FROM routed GROUP BY doc_id""")
def manifest_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda x: c("page_type") == x
    lists = {
        "map_pages": kind("map_confirmed"), "used_ocr_pages": c("route") == "ocr", "table_pages": kind("table"), "table_candidate_pages": kind("table_candidate"),
        "decorative_pages": c("route") == "decorative", "coordinate_register_pages": kind("coordinate_register"), "rotated_text_pages": c("rotated"),
    }
    return products.manifest_lists(_routed(spark, sf_dir), lists)


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _routed(spark, sf_dir).withColumns({
        "false_positive": c("k") % 29 == 0, "raster_class": F.when(c("k") % 7 == 0, "diagram_candidate").when(c("k") % 7 == 1, "raster_table_candidate").otherwise("none"), "ocr_map": c("k") % 31 == 0,
        "quality": F.when(c("k") % 2 == 0, "high").otherwise("low"), "text": F.concat(F.lit("Texto  da  pagina "), c("priority")), "title": F.concat(F.lit("Mapa ["), c("k").cast("string"), F.lit("]")),
        "image": products.image_name(c("page_number"), "pagina"), "notice": F.lit("Conteudo visual."),
    })
    return products.render(products.product_kind(p))


_PRODUCT = f"""{_ROUTED},
pk AS (SELECT *, CASE WHEN route = 'map' THEN 'visual' WHEN route = 'decorative' THEN 'decorative' WHEN page_type = 'coordinate_register' THEN 'coordinates' WHEN page_type = 'table_candidate' AND k % 29 <> 0 THEN 'table_candidate' WHEN route = 'structured' THEN 'table'
WHEN route = 'ocr' AND k % 7 = 0 THEN 'visual' WHEN route = 'ocr' AND k % 7 = 1 THEN 'raster_table' WHEN route = 'ocr' AND coordinate_register THEN 'coordinates' WHEN route = 'ocr' AND k % 31 = 0 THEN 'visual' WHEN route = 'ocr' AND k % 2 = 1 THEN 'ocr_review' WHEN route = 'ocr' THEN 'ocr' WHEN rotated THEN 'visual' ELSE 'native' END AS product FROM routed)"""


@query(f"WITH {_PRODUCT} SELECT doc_id, page_number, product FROM pk")
def page_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select("doc_id", "page_number", "product")


_N2, _P = "chr(10) || chr(10)", "page_number::VARCHAR"


def _head(*fields: tuple[str, str]) -> str:
    return f"'<!-- pagina_original: ' || {_P}" + "".join(f" || '; {k}: ' || {v}" for k, v in fields) + f" || ' -->' || {_N2} || '## Página ' || {_P}"


_FENCE = "'```text' || chr(10) || {0} || chr(10) || '```' || chr(10)"
_REVIEW = ("revisao", "'sim'")
_IMG = "'](<' || img || '>)'"
_LAID, _PROSE = "'Texto  da  pagina ' || priority", "'Texto da pagina ' || priority"
_NOTE = {k: _q(v) for k, v in products.NOTICES.items()}


def _table_sql(sort: str, source: str) -> str:
    note = f"'> **Revisão estrutural necessária:** estrutura tabular {sort} identificada em fonte {source}. O texto linear e a imagem foram preservados; as relações entre linhas e colunas devem ser conferidas.'"
    top = _head(("tipo", f"'tabela_{sort}'"), ("origem", f"'{source}'"), ("rota", "'structured:preservacao'"), _REVIEW)
    return f"{top} || ' — Mapa [' || k || ']' || {_N2} || {note} || {_N2} || '![Página tabular ' || {_P} || {_IMG} || {_N2} || {_FENCE.format(_LAID)}"


@query(f"""WITH {_PRODUCT}, ck AS (SELECT *, printf('pagina_%04d_pagina.png', page_number) AS img FROM pk),
ch AS (SELECT doc_id, page_number, CASE product
WHEN 'visual' THEN {_head(("tipo", "page_type"), ("rota", "'imagem+texto:layout'"), _REVIEW)} || ' — Mapa [' || k || ']' || {_N2} || '> Conteudo visual.' || {_N2} || '![Mapa (' || k || ')' || {_IMG} || {_N2} || '> ' || {_NOTE["visual"]} || {_N2} || {_FENCE.format(_PROSE)}
WHEN 'table' THEN {_table_sql("confirmada", "nativa/vetorial")} WHEN 'table_candidate' THEN {_table_sql("candidata", "nativa/vetorial")} WHEN 'raster_table' THEN {_table_sql("confirmada", "raster")}
WHEN 'coordinates' THEN {_head(("tipo", "'coordinate_register'"), ("rota", "'structured:preservacao'"), _REVIEW)} || ' — Registro de coordenadas' || {_N2} || '> ' || {_NOTE["coordinates"]} || {_N2} || '![Registro de coordenadas da página ' || {_P} || {_IMG} || {_N2} || {_FENCE.format(_LAID)}
WHEN 'ocr_review' THEN {_head(("tipo", "'ocr_review'"), ("qualidade", "'low'"), ("rota", "'ocr:tesseract+pdfium'"), _REVIEW)} || ' — OCR com revisão necessária' || {_N2} || '> ' || {_NOTE["ocr"]} || {_N2} || '![Página ' || {_P} || ' para revisão de OCR' || {_IMG} || {_N2} || {_FENCE.format(_PROSE)}
WHEN 'decorative' THEN {_head(("tipo", "page_type"), ("rota", "'decorative'"), ("revisao", "'nao'"))} || ' — ' || CASE page_type WHEN 'back_cover' THEN 'Contracapa' ELSE 'Página decorativa' END || {_N2} || '> ' || {_NOTE["decorative"]} || chr(10)
WHEN 'ocr' THEN {_head(("rota", "'ocr:tesseract+pdfium'"), ("revisao", "'nao'"))} || {_N2} || {_PROSE} || chr(10) ELSE {_head(("rota", "'native:pypdf'"), ("modo", "'layout'"))} || {_N2} || {_LAID} || chr(10) END AS chunk FROM ck),
md AS (SELECT doc_id, string_agg(chunk, {_N2} ORDER BY page_number) AS markdown, count(*) AS page_count FROM ch GROUP BY doc_id)
SELECT doc_id, page_count, sha256(markdown) AS markdown_sha256, strlen(markdown)::BIGINT AS markdown_size_bytes FROM md""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.assemble(_products(spark, sf_dir)).select("doc_id", "page_count", "markdown_sha256", "markdown_size_bytes")


# --- legal text


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.view(spark, sf_dir, "conversations")
    n = (c("turn") + 1).cast("string")
    piece = F.concat(F.lit("Art. "), n, F.lit("º "), c("text"), F.lit(" nos termos do art. "), (c("turn") + 40).cast("string"), F.lit(", 10 % ao ano.\n"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p"), n.alias("n"), c("text").alias("t")))).alias("all"))
    return g.select(
        c("conv_id").cast("string").alias("case_id"), F.concat(F.transform("all", lambda x: F.concat(F.lit("Artigo "), x["n"])), F.when(c("conv_id") % 10 == 0, F.array(F.lit("999"))).otherwise(F.array().cast("array<string>"))).alias("expected"),
        F.array(F.lit("10%"), F.lit("Art. 1º"), c("all")[0]["t"]).alias("terms"), F.array(F.lit("40")).alias("references"), F.array().cast("array<string>").alias("altered"), F.array_join(F.transform("all", lambda x: x["p"]), "").alias("observed"),
    )


@query()
def article_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("case_id", F.explode(canary.occurrences(c("observed"))).alias("o")).select("case_id", "o.*")


@query()
def canary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.evaluate(_cases(spark, sf_dir))


@query()
def canary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.summary(canary_cases(spark, sf_dir))


@query("SELECT conv_id, turn, (turn + 1) || CASE WHEN turn % 3 = 0 THEN '-B' ELSE '' END AS article FROM conversations")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" Art. "), (c("turn") + 1).cast("string"), F.when(c("turn") % 2 == 0, "º").otherwise(""), F.when(c("turn") % 3 == 0, "-b").otherwise(""))
    return V.view(spark, sf_dir, "conversations").select("conv_id", "turn", T.article_id(raw).alias("article"))


@query("SELECT conv_id, turn, 'conforme art.' || (turn + 1) || ' da lei nº ' || conv_id || '/2020, 10% de 250m2' AS legal FROM conversations")
def legal_text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Conforme  ARTIGO "), (c("turn") + 1).cast("string"), F.lit("º da Lei n° "), c("conv_id").cast("string"), F.lit(" / 2020, 10 % de 250 m²"))
    return V.view(spark, sf_dir, "conversations").select("conv_id", "turn", T.legal_text(raw).alias("legal"))


@query("SELECT conv_id::VARCHAR AS case_id, list(text ORDER BY turn) AS terms, count(*)::INTEGER AS turns FROM conversations GROUP BY conv_id")
def variant_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    body = F.to_json(F.struct(F.array(F.struct(c("conv_id").cast("string").alias("case_id"), F.transform("a", lambda x: F.struct(x["text"].alias("valor"))).alias("termos_criticos"))).alias("cases")))
    return readers.parse_cases(t.select(body.alias("value"))).select("case_id", "terms", F.size("terms").alias("turns"))


# --- other sources


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM a""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.view(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(readers.html_text(c("html"))).alias("text_md5"))


@query("SELECT event_type, count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS k_total FROM events GROUP BY ALL")
def events_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.view(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k_total"))


_PDF_LINES = f"""ln AS (SELECT doc_id, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) - 1 AS i FROM (SELECT doc_id, {V.PLAIN} AS p FROM documents)),
pl AS (SELECT doc_id, i // {V.PAGE_LINES} + 1 AS page_number, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS t FROM ln GROUP BY ALL)"""


@query(f"""WITH {_PDF_LINES} SELECT doc_id::VARCHAR AS doc_id, page_number::INTEGER AS page_number, count(*) OVER (PARTITION BY doc_id)::INTEGER AS page_count, md5({_STRIPPED.format("t")}) AS text_md5, (doc_id % 23)::INTEGER AS rectangles,
(doc_id % 23 // 2)::INTEGER AS across, ((doc_id % 2 = 0)::INT + ((doc_id + page_number) % 5 = 0)::INT)::INTEGER AS image_count FROM pl""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a PDF file and read back: text, rectangles and images of each page."""
    p = pdf.pdf_pages(V.files(spark, sf_dir, "pdf"))
    across = F.size(F.filter("rectangles", lambda r: r["width"] > r["height"]))
    return step(p.select("doc_id", "page_number", "page_count", F.md5("simple_text").alias("text_md5"), F.size("rectangles").alias("rectangles"), across.alias("across"), "image_count"))


@query(f"""WITH {_PDF_LINES}, pg AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pl),
g AS (SELECT doc_id, page_number, n, (doc_id % 2 = 0) AS logo, (doc_id + page_number) % 5 = 0 AS own FROM pg)
SELECT doc_id::VARCHAR AS doc_id, page_number::INTEGER AS page_number, (logo::INT + own::INT)::BIGINT AS raw_images, (logo AND n - 2 >= greatest(5, ceil(greatest(n - 2, 1) * 0.7)))::BIGINT AS decorative_images,
(logo::INT + own::INT - (logo AND n - 2 >= greatest(5, ceil(greatest(n - 2, 1) * 0.7)))::INT)::BIGINT AS content_images FROM g WHERE logo OR own""")
def pdf_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn on the pages of every document's PDF file; a logo that recurs in a long one is decoration."""
    return diagnosis.image_counts(step(pdf.pdf_pages(V.files(spark, sf_dir, "pdf")).select("doc_id", "page_number", "page_count", "graphics")))


@query()
def pdf_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnosis.diagnose(step(pdf.pdf_pages(V.files(spark, sf_dir, "pdf"))))
    return d.select("doc_id", "page_number", "route", "page_type", "selected_mode", "characters", "content_images", "warnings", F.col("table_assessment").isNull().alias("no_table"), F.col("coordinate_assessment").isNull().alias("no_coordinates"))


@query()
def pdf_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of every document's PDF file; pages without text are left for review, as no OCR is at hand. Its steps are tables, as on the command line."""
    diagnosed = step(diagnosis.diagnose(step(pdf.pdf_pages(V.files(spark, sf_dir, "pdf")))))
    converted = step(conversion.convert(step(conversion.with_evidence(diagnosed))))
    return conversion.published(conversion.manifests(converted)).drop("markdown")


@query(f"""WITH m AS (SELECT doc_id, {V.CLEAN} AS t FROM documents),
x AS (SELECT doc_id, unnest(['x/notes.txt', 'x/law.pdf', 'x/fake.PDF']) AS member, unnest([0, 1, 2]) AS ordinal, unnest([t, '%PDF-1.4' || chr(10) || t, t]) AS body FROM m)
SELECT doc_id::VARCHAR AS archive, member, ordinal::INTEGER AS ordinal, strlen(body)::BIGINT AS size, sha256(body) AS sha256, contains(left(body, 1024), '%PDF-') AS signed FROM x""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = readers.archive_members(V.files(spark, sf_dir, "zip").withColumnRenamed("doc_id", "path"))
    return step(a.select("archive", "member", "ordinal", "size", F.sha2("content", 256).alias("sha256"), readers.is_pdf(c("content")).alias("signed")))


@query(f"""WITH d AS (SELECT doc_id, string_split({V.CLEAN}, chr(10)) AS ls FROM documents)
SELECT doc_id || '.docx' AS doc_id, md5(array_to_string(list_filter(ls, lambda x: {_STRIPPED.format("x")} <> ''), chr(10) || chr(10))) AS text_md5 FROM d""")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step(office.office_text(V.files(spark, sf_dir, "docx", ".docx")).select("doc_id", F.md5("text").alias("text_md5")))


_EPUB_PART = "coalesce(array_to_string(list_filter(list_transform({0}, lambda x: " + _STRIPPED.format("x") + "), lambda x: x <> ''), chr(10)), '')"


@query(f"""WITH d AS (SELECT doc_id, string_split({V.CLEAN}, chr(10)) AS ls FROM documents)
SELECT doc_id || '.epub' AS doc_id, md5({_EPUB_PART.format("ls[len(ls) // 2 + 1:]")} || chr(10) || chr(10) || {_EPUB_PART.format("ls[:len(ls) // 2]")}) AS text_md5 FROM d""")
def epub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in the order of the spine, which here isn't that of the files."""
    return step(office.office_text(V.files(spark, sf_dir, "epub", ".epub")).select("doc_id", F.md5("text").alias("text_md5")))


_VOTES = ", ".join(f"{{'hits': len(list_filter(ws, lambda w: w IN ({', '.join(map(_q, own))}))), 'language': '{name}'}}" for name, own in language.WORDS.items())


@query(f"""WITH d AS (SELECT doc_id, regexp_split_to_array(lower(translate(left(text, {language.LOOK}), chr(10) || chr(13) || chr(9) || '.,;:!?()[]"' || chr(39), repeat(' ', 15))), ' +') AS ws FROM documents),
v AS (SELECT doc_id, unnest([{_VOTES}]) AS v FROM d), b AS (SELECT doc_id, v.language AS language, v.hits AS hits, sum(v.hits) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY v.hits DESC, v.language) AS k FROM v)
SELECT doc_id, CASE WHEN total > 0 THEN language ELSE 'und' END AS language, CASE WHEN total > 0 AND language IN ('pt', 'en') THEN language ELSE 'outros' END AS bucket, round(CASE WHEN total > 0 THEN hits / total ELSE 0 END, 9) AS probability FROM b WHERE k = 1""")
def language_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.view(spark, sf_dir, "documents", "doc_id", "text").withColumn("l", language.language(c("text")))
    return d.select("doc_id", "l.language", language.bucket(c("l.language")).alias("bucket"), F.round("l.probability", 9).alias("probability"))


@query(f"""WITH m AS ({V.MEMBERS}), e AS (SELECT archive, 'm' || (ordinal // 2) AS member, ordinal, CASE ordinal % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'failed' ELSE 'success' END AS status, sha256(text) AS sha256, CASE WHEN ordinal % 3 = 0 THEN 200 ELSE 300 END::INTEGER AS dpi, 'o/' || ordinal || '.md' AS markdown_path FROM m)
SELECT archive, member, status, sha256, dpi, '1' AS version, markdown_path FROM e QUALIFY row_number() OVER (PARTITION BY archive, member ORDER BY ordinal DESC) = 1""")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier manifests, one per archive, written as JSON and read back; damaged ones beside them give nothing."""
    m = V.lens(spark, sf_dir, V.MEMBERS, "documents")
    status = F.element_at(F.array(*[F.lit(x) for x in ("success", "duplicate", "failed", "success")]), (c("ordinal") % 4 + 1).cast("int"))
    entry = F.struct(
        F.concat(F.lit("m"), F.floor(c("ordinal") / 2).cast("string")).alias("member"), status.alias("status"), F.sha2("text", 256).alias("source_sha256"), F.when(c("ordinal") % 3 == 0, 200).otherwise(300).alias("dpi"), F.lit("1").alias("converter_version"),
        F.concat(F.lit("o/"), c("ordinal").cast("string"), F.lit(".md")).alias("markdown_path"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))), lambda x: x["e"])
    whole = m.groupBy("archive").agg(F.to_json(F.struct(listed.alias("entries"))).alias("value"))
    damaged = whole.select("archive", F.left("value", F.lit(50)).alias("value")).union(whole.select("archive", F.lit("[]")))
    return readers.parse_manifests(whole.union(damaged)).drop("manifest_path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
