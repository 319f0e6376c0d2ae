"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own (end punctuation, navigation, boilerplate); failing lines go, and a
document that loses too much of its text goes whole. Word statistics are of the whole original text.

Defined cases: a null or empty text has no words, no lines and fails the base rules; repeated rows and
repeated ids are judged row by row; an empty table gives an empty result; other columns (whatever their
names) are untouched, since statistics live in one struct until the caller names them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACES = "[\\x20\\x09-\\x0D]+"
#: Terminal marks that make a line a piece of prose.
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*($|[\\x20\\x09-\\x0D])"
SEPARATOR = "[|»›•·]|(^|\\s)[/>](\\s|$)"

# Lines that are nothing but one of these lead elsewhere.
NAVIGATION_WORDS = {
    "en": ("home", "menu", "next", "previous", "prev", "back", "top", "search", "login", "log in", "sign in", "sign up", "register", "contact", "contact us", "about", "about us", "sitemap", "share", "read more", "more", "help", "faq", "skip to content"),
    "de": ("startseite", "menü", "weiter", "zurück", "suche", "anmelden", "registrieren", "kontakt", "über uns", "teilen", "weiterlesen", "mehr lesen", "mehr", "hilfe", "zum inhalt"),
    "es": ("inicio", "menú", "siguiente", "anterior", "volver", "buscar", "iniciar sesión", "registrarse", "contacto", "acerca de", "sobre nosotros", "compartir", "leer más", "más", "ayuda", "ir al contenido"),
    "fr": ("accueil", "suivant", "précédent", "retour", "rechercher", "connexion", "inscription", "se connecter", "à propos", "partager", "lire la suite", "plus", "aide", "aller au contenu"),
}
# Lines that hold one of these are not the document's own.
BOILERPLATE_PHRASES = {
    "en": ("all rights reserved", "licensed under", "released under the", "©", "&copy;", "cookie policy", "cookie settings", "cookie notice", "uses cookies", "privacy policy", "terms of use", "terms of service",
           "enable javascript", "click here", "subscribe to", "newsletter", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation"),
}


def navigation(words: dict[str, tuple[str, ...]] = NAVIGATION_WORDS) -> str:
    """Pattern of a line that is one of the words."""
    return "(?i)^\\W*(" + "|".join(dict.fromkeys(w for some in words.values() for w in some)) + ")\\W*$"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_line_words_for_punctuation: int = 4  # shorter lines (headings, names) need no end mark
    nav_separators_per_word: float = 1 / 3
    max_lost_share: float = 0.5  # of the characters of non-blank lines
    sentence_end: str = SENTENCE_END
    separator: str = SEPARATOR
    navigation: str = navigation()
    boilerplate: tuple[str, ...] = tuple(p for some in BOILERPLATE_PHRASES.values() for p in some)  # in lower case


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more; windows meet by 64-bit hash within one text."""

    def covered(dup: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(dup, lambda d: F.array(d["p"], d["p"] + 1, d["p"] + 2)))))

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return let(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), covered)

    hashed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
        )
    )
    return F.when(F.size(words) >= 4, let(hashed, twice)).otherwise(0)


def word_stats(text: Column) -> Column:
    """struct(n_words, word_chars, n_repeat_words)"""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def line_fails(line: Column, p: QualityParams) -> Column:
    """A non-blank line that breaks a rule; blank lines never fail."""
    n_words = F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))
    holds = lambda low: reduce(lambda a, b: a | b, [low.contains(x) for x in p.boilerplate], F.lit(False))
    return (n_words > 0) & (
        ((n_words >= p.min_line_words_for_punctuation) & ~line.rlike(p.sentence_end))
        | line.rlike(p.navigation)
        | (F.regexp_count(line, F.lit(p.separator)) >= F.greatest(F.lit(2.0), n_words * p.nav_separators_per_word))
        | let(F.lower(line), holds)
    )


def line_stats(text: Column, p: QualityParams) -> Column:
    """struct(n_dup_lines, n_lines_removed, lost_chars, line_chars, clean_text)"""
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    def of_lines(lines: Column) -> Column:
        return let(
            F.struct(F.filter(lines, has_word).alias("full"), F.filter(lines, lambda x: ~line_fails(x, p)).alias("good")),
            lambda s: F.struct(
                (F.size(s["full"]) - F.size(F.array_distinct(s["full"]))).cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(s["good"])).cast("long").alias("n_lines_removed"),
                (chars(lines) - chars(s["good"])).alias("lost_chars"),
                chars(s["full"]).alias("line_chars"),
                F.array_join(s["good"], "\n").alias("clean_text"),
            ),
        )

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of_lines)


def judge(docs: DataFrame, text: str = "text", params: QualityParams = QualityParams(), out: str = "quality") -> DataFrame:
    """docs with one struct column `out`: the statistics, base_failed, kept and clean_text."""
    col = F.col(text)
    # a generator of one row: filters on the result stay above it, so that a text is walked once
    stats = F.struct(word_stats(col).alias("w"), line_stats(col, params).alias("l"))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], F.explode(F.array(stats)).alias(out))
    w, l = F.col(out)["w"], F.col(out)["l"]
    failed = (w["n_words"] < params.min_words) | (100 * w["n_repeat_words"] > params.max_repeat_percent * w["n_words"])
    symbols = F.regexp_count(F.coalesce(col, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")
    kept = ~failed & (l["lost_chars"] <= params.max_lost_share * l["line_chars"])
    return base.withColumn(
        out,
        F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), l["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"), l["n_lines_removed"].alias("n_lines_removed"), l["lost_chars"].alias("lost_chars"),
            failed.alias("base_failed"), kept.alias("kept"), l["clean_text"].alias("clean_text"),
        ),
    )


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", params: QualityParams = QualityParams()) -> DataFrame:
    """Kept documents with their failing lines removed; the columns of docs."""
    out = "__quality"
    kept = judge(docs, text, params, out).where(F.col(out)["kept"])
    new = {text: F.col(out)["clean_text"]}
    if n_chars and n_chars in docs.columns:
        new[n_chars] = F.length(F.col(out)["clean_text"]).cast(docs.schema[n_chars].dataType)
    return kept.withColumns(new).select(*docs.columns)
