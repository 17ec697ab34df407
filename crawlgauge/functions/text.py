"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' \s has it.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: The same characters, one by one.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Openers of a question. Those that end in an ASCII letter need a non-word character next, the others an ASCII word character.
ASCII_OPENERS = "what|how|why|when|where|which|who|can|should|do|does|is|are|will|que|cómo|como|porque|cuándo|cuando|dónde|donde|cuál|cual|quién|quien|puedo|puede|debo|es|son"
OTHER_OPENERS = "¿|qué|por qué"
QUESTION = rf"(?iu)^{SPACE}*(?:(?:{ASCII_OPENERS})(?![A-Za-z0-9_])|(?:{OTHER_OPENERS})(?=[A-Za-z0-9_]))|\?{SPACE}*$"


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def trimmed(s: Column | str) -> Column:
    """Without white space at the ends, whatever kind it is."""
    return F.btrim(F.col(s) if isinstance(s, str) else s, F.lit(WHITE))


def collapse(s: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def to_tenth(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(x))).cast("int")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def words(collapsed: Column) -> Column:
    """Tokens between spaces that hold a letter or digit."""
    return F.filter(F.split(collapsed, " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def sentence_count(collapsed: Column) -> Column:
    pieces = F.filter(F.split(collapsed, r"[.!?¿¡]+(?:\s|$)", -1), lambda s: F.length(F.trim(s)) > 0)
    return F.greatest(F.lit(1), F.size(pieces))


_VOWELS = "aeiouyáéíóúü"
#: A word of two or more vowel groups whose last letter is an e that is not heard.
_SILENT = rf"(?<![^ ])[^ {_VOWELS}]*+(?:[{_VOWELS}]++[^ {_VOWELS}]++)++(?:[{_VOWELS}]*[áéíóúü])?e(?![^ ])"


def syllables(words: Column) -> Column:
    """Syllables of all words: their vowel groups, at least one each, less silent ends. A few passes over the joined words."""
    letters = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-záéíóúüñ ]", "")
    voiceless = rf"(?<![^ ])[^ {_VOWELS}]+(?![^ ])"
    return F.regexp_count(letters, F.lit(f"[{_VOWELS}]+")) + F.regexp_count(letters, F.lit(voiceless)) - F.regexp_count(letters, F.lit(_SILENT))


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    ease = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return to_tenth(F.when(n_words == 0, F.lit(0.0)).otherwise(ease))


def reading_level(ease: Column) -> Column:
    """A code for the band of reading ease."""
    out = F.lit("graduate")
    for least, name in ((30, "university"), (50, "fairly_difficult"), (60, "plain"), (70, "fairly_easy"), (80, "easy"), (90, "very_easy")):
        out = F.when(ease >= least, F.lit(name)).otherwise(out)
    return out


def term(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}-]", "")


def is_question(heading: Column) -> Column:
    return heading.rlike(QUESTION)
