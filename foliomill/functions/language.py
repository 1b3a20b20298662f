"""Language of a text by its function words: a built-in guess where no language identifier is registered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent short words that the languages don't share.
WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "and", "of", "to", "is", "that", "with", "for", "was", "are", "this", "from"),
    "pt": ("não", "uma", "dos", "das", "pelo", "pela", "são", "ao", "também", "mais", "seu", "sua"),
    "es": ("el", "los", "las", "una", "del", "por", "con", "su", "más", "también", "pero", "y"),
    "fr": ("le", "les", "des", "une", "et", "est", "dans", "pour", "qui", "sur", "pas", "avec"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "den", "von", "zu"),
}
LOOK = 1000


def votes(text: Column, look: int = LOOK) -> Column:
    """Array of (hits, language), one per language, over the first ``look`` characters: the guess is defined by them."""
    words = F.split(F.lower(F.translate(F.left(F.coalesce(text, F.lit("")), F.lit(look)), "\n\r\t.,;:!?()[]\"'", " " * 15)), " +")


    def hits(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    return F.array(*[F.struct(hits(own).alias("hits"), F.lit(name).alias("language")) for name, own in WORDS.items()])


def language(text: Column, look: int = LOOK) -> Column:
    """Struct of language ('und' without any hit; of equals the first by name) and share of the hits that are its own."""
    v = votes(text, look)
    total = F.aggregate(v, F.lit(0), lambda a, x: a + x["hits"])
    best = F.array_min(F.transform(v, lambda x: F.struct((-x["hits"]).alias("minus"), x["language"].alias("language"))))
    return F.struct(F.when(total > 0, best["language"]).otherwise("und").alias("language"), F.when(total > 0, -best["minus"] / total).otherwise(0.0).alias("probability"))


def bucket(code: Column) -> Column:
    """Folder of a language: pt, en, or outros."""
    return F.when(code.isin("pt", "en"), code).otherwise("outros")
