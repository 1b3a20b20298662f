"""Text functions on columns. Everything runs in the JVM but for the exact Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

_LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def _base(mark: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", mark) if not unicodedata.combining(x))


#: Marks of the Latin, Greek, Cyrillic, super- and subscript, letterlike, number and full-width blocks that stand for one other mark.
_BLOCKS = [*range(0xA0, 0x530), *range(0x1D00, 0x2190), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F)]
_ONE = {m: _base(m) for m in map(chr, _BLOCKS) if len(_base(m)) == 1 and _base(m) != m}
_FROM, _TO = "".join(_ONE), "".join(_ONE.values())
_ODD = "[^\\x00-\\x7F]"


def fold(text: Column) -> Column:
    """Without accents, whether composed or not, and marks of _BLOCKS as plain ones (NFKD); ligatures stay. See fold_exact() for any script."""
    return F.when(odd(text), F.regexp_replace(F.translate(text, _FROM, _TO), "\\p{M}+", "")).otherwise(text)


def fold_upper(text: Column) -> Column:
    """Upper case without accents, whether composed or not; ordinals and superscripts become plain."""
    return F.upper(fold(text))


def odd(text: Column) -> Column:
    """Whether text has a mark that isn't ASCII: a count of bytes, far cheaper than a pattern over every mark."""
    return F.octet_length(text) > F.length(text)


def _normal_form(form: str):
    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in text.to_pylist()], pa.string())

    return run


#: Marks that a text in NFC holds only where they can't be composed, or never: combining ones, Jamo, and singletons.
_NOT_COMPOSED = "[\\p{M}\\u1100-\\u11FF\\u2000\\u2001\\u2126\\u212A\\u212B\\u2329\\u232A\\u0340\\u0341\\u0343\\u0374\\u037E\\u0387\\u1F71-\\u1FFD\\uF900-\\uFAFF\\uFB1D-\\uFB4E]|[\\x{2F800}-\\x{2FA1D}]"


def nfc(text: Column) -> Column:
    """Unicode normal form C. Only texts that may not be in it go through Python."""
    return F.coalesce(_normal_form("NFC")(F.when(odd(text) & text.rlike(_NOT_COMPOSED), text)), text)


def nfkc_all(texts: Column) -> Column:
    """Each text of an array in normal form KC; for use before a lambda, which can't call Python. Arrays of ASCII don't go through Python."""

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in v] for v in values.to_pylist()], pa.list_(pa.string()))

    return F.coalesce(run(F.when(F.array_join(texts, " ").rlike(_ODD), texts)), texts)


def nfkc(text: Column) -> Column:
    """Unicode normal form KC. ASCII texts don't go through Python."""
    return F.coalesce(_normal_form("NFKC")(F.when(text.rlike(_ODD), text)), text)


def fold_exact(text: Column) -> Column:
    """Upper case without combining marks, for any script. ASCII texts don't go through Python."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _base(t).upper() for t in values.to_pylist()], pa.string())

    return F.coalesce(run(F.when(text.rlike(_ODD), text)), F.upper(text))


#: What (?U)\s matches.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends. The look behind keeps long inner runs from being tried at each of their places."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def trimmed(text: Column) -> Column:
    """strip() for long texts: nothing between the ends is looked at."""
    return F.trim(text, F.lit(_SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


_INVISIBLE = "\u00a0\u200b\u200c\u200d\u2060\ufeff"


def clean_invisible(text: Column, composed: bool = False) -> Column:
    """NFC; zero-width characters go, no-break spaces become spaces, line ends become LF. composed: the text is in NFC already."""
    t = text if composed else nfc(text)
    plain = F.when(odd(t) & t.rlike(f"[{_INVISIBLE}]"), F.translate(t, _INVISIBLE, " ")).otherwise(t)
    return F.replace(F.replace(plain, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Lines at any Unicode line boundary; a boundary at the end starts no further line."""
    lines = F.split(text, _LINE_BREAK)
    ends_open = F.element_at(lines, -1) == ""
    return F.when(ends_open, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def prose(text: Column, composed: bool = False) -> Column:
    """Searchable prose: cleaned, each line trimmed with single spaces, at most one blank line in a row."""
    return prose_of_clean(clean_invisible(text, composed))


def prose_of_clean(clean: Column) -> Column:
    """prose() of text that clean_invisible() made. Every step is one pass over the whole text; no line is a value of its own."""
    t = F.regexp_replace(clean, "[\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]", "\n")
    t = F.regexp_replace(t, r"(?U)(?<![^\S\n])[^\S\n]++(?=\n)|(?<=\n)[^\S\n]++", "")
    t = F.regexp_replace(trimmed(t), "[ \\t]{2,}", " ")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def excessive_spacing(text: Column) -> Column:
    """Whether spaces were used for placement: 120 characters, three gaps of 8 spaces, and many spaces in all."""
    return spacing_of_clean(clean_invisible(text))


def spacing_of_clean(t: Column) -> Column:
    n = F.length(t)
    spaces = n - F.length(F.replace(t, F.lit(" "), F.lit("")))
    in_gaps = n - F.length(F.regexp_replace(t, " {8,}", ""))
    gaps = F.regexp_count(t, F.lit(" {8,}"))
    return (n >= 120) & (gaps >= 3) & ((spaces / F.greatest(n, F.lit(1)) >= 0.22) | (in_gaps / F.greatest(n, F.lit(1)) >= 0.08))


def alphanumeric_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def text_score(text: Column) -> Column:
    """How readable an extraction is: letters and digits, words and legal terms, less replacement marks and lost spacing."""
    return score_of_clean(strip(clean_invisible(text)))


def score_of_clean(t: Column) -> Column:
    """text_score() of clean and stripped text; a column of its own, as it is looked at several times."""
    terms = F.regexp_count(t, F.lit("(?iu)" + lexicon.LEGAL_OCCURRENCE))
    broken = F.length(t) - F.length(F.replace(t, F.lit("\ufffd"), F.lit("")))
    lost = F.greatest(F.length(t) - F.length(prose_of_clean(t)), F.lit(0))
    score = alphanumeric_count(t) + word_count(t) * 0.5 + terms * 12.0 - broken * 8.0 - lost * 0.35
    return F.when(t == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score))


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur in folded text, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def trim_marks(text: Column) -> Column:
    """Without spaces, dots, semicolons, colons and hyphens at both ends."""
    return F.regexp_replace(text, "^[ .;:-]+|[ .;:-]+$", "")


def markdown_image(alt: Column, target: Column) -> Column:
    return F.concat(F.lit("!["), F.translate(alt, "[]", "()"), F.lit("](<"), target, F.lit(">)"))


# --- legal text


def article_id(value: Column, composed: bool = False) -> Column:
    """Identifier of an article: NFKC, no label, no ordinal mark, a hyphen before a final letter. composed: value is in NFKC but for ordinals."""
    t = F.regexp_replace(F.upper(F.translate(value if composed else nfkc(value), "ºª", "oa")), r"(?U)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, "^ARTIGO", ""), r"^ART\.?", "")
    t = F.regexp_replace(t, "(?<=[0-9])[O°](?=-|$)", "")
    return F.regexp_replace(t, "(?<=[0-9])-?([A-Z])$", "-$1")


def legal_text(value: Column, composed: bool = False) -> Column:
    """Legal text for comparison: NFKC, lower case, one kind of dash, compact article, law, percent and area forms."""
    t = F.replace(F.lower(F.translate(value if composed else nfkc(value), "ºª²³\u00a0", "oa23 ")), F.lit("ß"), F.lit("ss"))
    t = F.regexp_replace(t, "[‐‑‒–—]", "-")
    t = F.regexp_replace(t, r"\bart(?:igo)?\.?\s*([0-9]+)\s*[o°]?\s*-\s*([a-z])", "art.$1-$2")
    t = F.regexp_replace(t, r"\bart(?:igo)?\.?\s*([0-9]+)(?![0-9]|-[a-z])\s*[o°]?", "art.$1")
    t = F.regexp_replace(t, r"\blei\s*n\s*[o°]\s*", "lei nº ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*/\s*", "/"), r"(?<=[0-9])\s*%", "%")
    t = F.regexp_replace(t, r"(?<=[0-9])\s*m\s*2\b", "m2")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a normalised term occurs; a term of digits must stand by itself."""
    alone = F.concat(F.lit("(?<![0-9])"), term, F.lit("(?![0-9])"))
    return F.when(term.rlike("^[0-9]+$"), F.regexp_like(text, alone)).otherwise(F.contains(text, term))
