"""Regression cases on legal text: expected and observed articles, references and critical terms."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ARTICLE = r"\bart(?:igo)?\.?\s*([0-9]+)[º°o]?(-[a-z])?(?=[\s.,;:—–-]|$)"
_LEADS = "conforme segundo observad[oa]s? revoga(?:-se)? acrescenta(?:-se)? substitui(?:-se)? nos_termos(?:_d[oa])? de_acordo_com de_que_trata na_forma_d[oa] altera(?:-se)?(?:_a)?_redacao_d[oa]"
_FOUND = "disposto disposta previsto prevista referido referida mencionado mencionada estabelecido estabelecida"
_BEFORE = re.compile("(?:" + "|".join([w.replace("_", r"\s+") for w in _LEADS.split()] + [w + r"\s+n[oa]" for w in _FOUND.split()]) + ")\\s*[\"'“”]*$", re.I)
_AFTER = re.compile(r"^\s*(?:,\s*)?(?:(?:ao|e)\s+(?:o\s+)?art(?:igo)?\.?|daquel[ae]s?|dest[ae]s?|d[ao]s?)\b", re.I)
_ONE = re.compile(ARTICLE.replace("[º°o]?", "(?:[º°o])?"), re.I)
OCCURRENCES = "array<struct<article:string,found:string,kind:string,start:int,stop:int>>"


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def occurrences(text: Column) -> Column:
    """Articles named in a text, each as its own provision or as a reference, by the words before and after it. Offsets count characters."""

    @F.arrow_udf(OCCURRENCES)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            found = []
            for m in _ONE.finditer(t or ""):
                before, after = _fold(t[max(0, m.start() - 100) : m.start()]), _fold(t[m.end() : m.end() + 80])
                kind = "remissao" if _BEFORE.search(before) or _AFTER.search(after) else "dispositivo_principal"
                found.append({"article": m.group(1) + (m.group(2) or "").upper(), "found": m.group(0), "kind": kind, "start": m.start(), "stop": m.end()})
            out.append(found)
        kind = pa.list_(pa.struct([("article", pa.string()), ("found", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array(out, kind)

    return run(text)


def articles(found: Column, kind: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda o: o["kind"] == kind), lambda o: o["article"])))


def evaluate(cases: DataFrame) -> DataFrame:
    """cases (case_id, expected, terms, references, altered: arrays of strings; observed) with what is missing, unexpected and found.

    A case passes if no expected article and no critical term is missing and no article is unexpected. Null arrays count as empty.
    """
    c = F.col
    blank = F.array().cast("array<string>")
    own = lambda name: F.filter(F.coalesce(c(name), blank), lambda x: T.strip(x) != "")
    plain = {f"_{name}": T.nfkc_all(own(name)) for name in ("expected", "references", "altered")}
    d = cases.withColumns({"_text": F.coalesce("observed", F.lit("")), "_terms": own("terms")} | plain)
    d = d.withColumns({"_found": occurrences(c("_text")), "_normal": T.legal_text(c("_text")), "_pairs": F.arrays_zip("_terms", T.nfkc_all(c("_terms")).alias("plain"))})
    ids = lambda a: F.array_distinct(F.transform(a, lambda x: T.article_id(x, composed=True)))
    term, form = (lambda p: p["_terms"]), (lambda p: p["plain"])
    named = F.transform(F.filter("_pairs", lambda p: T.strip(term(p)).rlike(r"(?iu)^art(?:igo)?\.?\s*[0-9]+[º°o]?(?:-[a-z])?$")), form)
    d = d.withColumn("_expected", ids(c("_expected")))
    allowed = F.array_union(F.array_union(ids(c("_altered")), ids(c("_references"))), F.array_except(ids(named), "_expected"))
    d = d.withColumns({"_main": articles(c("_found"), "dispositivo_principal"), "_allowed": allowed})
    there = lambda p: F.contains(F.lower("_text"), F.lower(term(p)))
    d = d.withColumns({"exact_terms": F.transform(F.filter("_pairs", there), term), "_rest": F.filter("_pairs", lambda p: ~there(p))})
    meant = lambda p: T.contains_term(c("_normal"), T.legal_text(form(p), composed=True))
    d = d.withColumns({
        "missing_articles": F.array_sort(F.array_except("_expected", "_main")), "unexpected_articles": F.array_sort(F.array_except(F.array_except("_main", "_expected"), "_allowed")),
        "references_found": articles(c("_found"), "remissao"), "normalised_terms": F.transform(F.filter("_rest", meant), term), "missing_terms": F.transform(F.filter("_rest", lambda p: ~meant(p)), term),
    })
    passed = (F.size("missing_articles") == 0) & (F.size("unexpected_articles") == 0) & (F.size("missing_terms") == 0)
    return d.select("case_id", "missing_articles", "unexpected_articles", "references_found", "exact_terms", "normalised_terms", "missing_terms", passed.alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """Totals of a suite; an empty suite passes."""
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"), F.count_if(~F.col("passed")).alias("failed_cases"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("suite_passed"))


normalize_article, extract_article_headings, evaluate_case, run_canary_suite = T.article_id, occurrences, evaluate, summary
