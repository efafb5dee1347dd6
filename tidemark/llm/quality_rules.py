"""Line-first cleaning by rules, in DataFrame functions only.

Each line with a word is judged alone. It fails as
- punctuation: it doesn't end as a sentence and has either three words or fewer, or ten or more of which fewer than half differ; it has
  more symbols than a third of its words, or more than half as many exclamation and question marks as words;
- navigation: three or more separators, which are a seventh of its words or more;
- boilerplate: at most 40 words, among them a phrase of BOILERPLATE.
Failed lines are removed. A document is rejected if the base rules fail (under 20 words, or over 30 % of its words in
8-word windows that the document repeats) or if more than half of its words were in removed lines.

Defined results: a null text has no words and is rejected; lines without a word are neither judged nor removed;
rows with equal ids are judged apart; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

#: A mark, closing quotes or brackets, and blanks at the end of a line.
SENTENCE_END = r"""[.!?…。！？؟।]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|»›•·]|(?:^|\s)[>/](?=\s|$)"
#: Each begins with a letter of a to z and stands at the begin of a word.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "lorem ipsum", "sign in to", "subscribe to our", "click here to", "powered by", "skip to content",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "nous utilisons des cookies", "aller au contenu", "abonnez-vous à",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utilizamos cookies", "saltar al contenido", "haz clic aquí",
)
BOILERPLATE_PATTERN = "(?:^|[^a-z])(?:" + "|".join(BOILERPLATE) + ")"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of `window` words (a power of two) that occur twice or more.

    Windows are compared by a 64-bit hash, made by doubling: two of one width give one of twice the width.
    """

    def covered(at: Column) -> Column:
        following = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.element_at(at, -1) + window))
        return F.aggregate(F.zip_with(at, following, lambda a, b: F.least(F.lit(window), b - a)), F.lit(0), lambda total, x: total + x)

    def places(pairs: Column) -> Column:
        twice = lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(bind(pairs, places), covered))

    def widened(width: int):
        def step(hashes: Column) -> Column:
            if width == window:
                return counted(hashes)
            n = F.size(hashes) - width
            return bind(F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b)), widened(2 * width))

        return step

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), widened(1)))


def judged_lines(text: Column) -> Column:
    """array<struct<line, words, failed>>"""

    def count(line: Column, pattern: str) -> Column:
        return F.regexp_count(line, F.lit(pattern))

    def failed(x: Column) -> Column:
        line, n = x["line"], x["words"]
        ends = line.rlike(SENTENCE_END)
        few = (n >= 10) & (2 * F.size(F.array_distinct(words_of(line))) < n)
        punctuation = (~ends & ((n <= 3) | few)) | (3 * count(line, SYMBOL) > n) | (2 * count(line, "[!?]") > n)
        separators = count(line, SEPARATOR)
        navigation = (separators >= 3) & (7 * separators >= n)
        boilerplate = (n <= 40) & F.lower(line).rlike(BOILERPLATE_PATTERN)
        return (n > 0) & (punctuation | navigation | boilerplate)

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), count(x, WORD).alias("words")))
    return F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), failed(x).alias("failed")))


def statistics(text: Column, max_lost: float = 0.5) -> Column:
    """struct of the base counts, the verdicts and the cleaned text."""

    def of_words(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        texts = F.transform(F.filter(lines, lambda x: x["words"] > 0), lambda x: x["line"])
        dups = bind(texts, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        lost = F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + F.when(x["failed"], x["words"]).otherwise(F.lit(0)))
        left = F.array_join(F.transform(F.filter(lines, lambda x: ~x["failed"]), lambda x: x["line"]), "\n")
        return F.struct(dups.cast("long").alias("n_dup_lines"), lost.alias("n_lost_words"), left.alias("clean_text"))

    def all_of(w: Column, x: Column, symbols: Column) -> Column:
        base = (w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])
        kept = ~base & (x["n_lost_words"] <= F.lit(max_lost) * w["n_words"])
        return F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), x["n_lost_words"].alias("n_lost_words"), base.alias("base_failed"), kept.alias("kept"), x["clean_text"].alias("clean_text"))

    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return bind(bind(words_of(text), of_words), lambda w: bind(bind(judged_lines(text), of_lines), lambda x: all_of(w, x, symbols)))


def judge(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """docs as one struct column `doc`, with the struct `quality` of statistics().

    It comes out of a generator of one row, through which no filter on it is pushed: a verdict is then not computed twice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("doc"), F.explode(F.array(statistics(text, max_lost))).alias("quality"))
