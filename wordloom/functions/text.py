"""Text hygiene, casing and letters, as Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The alphabets and the characters that are folded.
LETTERS = "абвгґдеёжзійклмнопрстуўфхцчшыьэюя"
#: The same letters as ranges, which patterns test faster than one by one.
RANGES = "а-зй-шы-яёіўґ"
VOWELS = "аеёіоуыэюя"
SOFT_VOWELS = "еёіюя"
SOFTENERS = SOFT_VOWELS + "ь"
APOSTROPHE = "’"
APOSTROPHES = "’'ʼ`‘"
ZERO_WIDTH = "​‌‍⁠﻿­"
#: Letters of this alphabet with a combining mark, and in one character.
MARKED = (("й", "й"), ("ў", "ў"), ("ё", "ё"), ("ї", "ї"), ("Й", "Й"), ("Ў", "Ў"), ("Ё", "Ё"), ("Ї", "Ї"))
LATIN_ALIKE = "aeopcyxiAEOPCYXITHKMB"
CYRILLIC_ALIKE = "аеорсухіАЕОРСУХІТНКМВ"

KINDS = {"cyrillic": "\\p{IsCyrillic}", "latin": "\\p{IsLatin}"}


@F.udf(returnType=StringType(), useArrow=True)
def _nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_nfc(text: Column) -> Column:
    """Normal form C. There is no such function in the JVM's SQL; see sanitize for the rows that need it."""
    return _nfc(text)


def strip_zero_width(text: Column) -> Column:
    # A few searches for bytes, where translate() would look up each character.
    for c in ZERO_WIDTH:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def normalize_apostrophes(text: Column) -> Column:
    for c in APOSTROPHES:
        if c != APOSTROPHE:
            text = F.replace(text, F.lit(c), F.lit(APOSTROPHE))
    return text


def fold_homoglyphs(text: Column, script: str = "cyrillic") -> Column:
    """In runs of letters with one of the script, look-alikes of the other become its own."""
    away, to = (LATIN_ALIKE, CYRILLIC_ALIKE) if script == "cyrillic" else (CYRILLIC_ALIKE, LATIN_ALIKE)
    # Runs that hold both are few: they are folded together, and all else stays where it is.
    mixed = f"(?<!\\p{{L}})(?=\\p{{L}}*?[{away}])(?=\\p{{L}}*?[{KINDS[script]}&&\\p{{L}}])\\p{{L}}+"
    folded = F.split(F.translate(F.array_join(F.regexp_extract_all(text, F.lit(mixed), F.lit(0)), " "), away, to), " ")
    pieces = F.zip_with(F.split(text, mixed, -1), folded, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(f"[{away}]") & text.rlike(KINDS[script]), F.array_join(pieces, "")).otherwise(text)


def compose_marks(text: Column) -> Column:
    """Letters of this alphabet that are written with a combining mark, in one character: й ў ё ї and capitals."""
    for a, b in MARKED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sanitize(text: Column, script: str = "cyrillic", full_nfc: bool = False) -> Column:
    """Normal form C, zero-width characters, look-alikes, apostrophes, in this order.

    full_nfc: by the Unicode tables, which live in Python; otherwise the marks of
    this alphabet are composed in the JVM, which is the same for its texts.
    """
    text = to_nfc(text) if full_nfc else F.when(text.rlike("\\p{M}"), compose_marks(text)).otherwise(text)
    return normalize_apostrophes(fold_homoglyphs(strip_zero_width(text), script))


def case_of(word: Column) -> Column:
    """lower, title, upper or mixed, by the letters; one capital alone is title."""

    def form(s: Column) -> Column:
        small, tall = s == F.lower(s), s == F.upper(s)
        title = F.substring(s, 1, 1) != F.lower(F.substring(s, 1, 1))
        return F.when(small, "lower").when(title & (F.expr("1") == F.length(s)), "title").when(title & (F.substring(s, 2, 1 << 30) == F.lower(F.substring(s, 2, 1 << 30))), "title").when(tall, "upper").otherwise("mixed")

    return let(F.regexp_replace(word, "[^\\p{L}]", ""), form)


def apply_case(word: Column, form: Column) -> Column:
    first = F.regexp_instr(word, F.lit("\\p{L}"))
    title = F.when(first > 0, F.concat(F.substring(word, F.lit(1), first - 1), F.upper(F.substring(word, first, F.lit(1))), F.substring(word, first + 1, F.length(word)))).otherwise(word)
    return F.when(form == "upper", F.upper(word)).when(form == "title", title).otherwise(word)


def recase(source: Column, target: Column) -> Column:
    return apply_case(target, case_of(source))


def recase_like(source: Column, target: Column) -> Column:
    """target with the capitals of source, part by part if both have as many hyphens; source if it only differs in them."""
    a, b = F.split(source, "-"), F.split(target, "-")
    parts = F.array_join(F.zip_with(a, b, lambda x, y: recase(x, y)), "-")
    return F.when(target == F.lower(source), source).when(source.contains("-") & (F.size(a) == F.size(b)), parts).otherwise(recase(source, target))


def is_word(word: Column) -> Column:
    """Whether only letters of the alphabet, apostrophes and hyphens occur."""
    return word.rlike(f"\\A[{RANGES}{RANGES.upper()}{APOSTROPHES}-]*\\z")


def syllables(word: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(word), f"[^{VOWELS}]", ""))


def neutral_fold(word: Column) -> Column:
    """A spelling in which regular differences between the orthographies vanish."""
    low = F.lower(word)
    soft = F.regexp_replace(F.regexp_replace(low, "(?<=л)я", "а"), "(?<=л)ю", "у")
    return F.translate(soft, "эёыґўь", "еоігу")


def first_syllable_stressed(word: Column, clitics: list[str]) -> Column:
    """By the spelling alone: no clitic, and one syllable or ё as the first vowel."""
    low = F.lower(word)
    return ~low.isin(clitics) & ((syllables(low) == 1) | (F.regexp_extract(low, f"[{VOWELS}]", 0) == "ё"))


#: Constructs of wiki markup whose contents are no prose, links, and quotes that mark type; how deep templates nest.
MARKUP = ("<ref[^>]*/>", "<ref.*?</ref>", "<!--.*?-->", "<math.*?</math>", "\\{\\{[^{}]*\\}\\}", "\\{\\|.*?\\|\\}", "\\[\\[[Ff]ile:.*?\\]\\]", "\\[\\[[Іі]мідж:.*?\\]\\]", "\\[\\[[Вв]ыява:.*?\\]\\]", "<[^>]+>")
LINK = "\\[\\[(?:[^\\]|]*\\|)?([^\\]|]*)\\]\\]"
NESTING = 4
STRESS_MARKS = "+`́"


def strip_wikitext(text: Column) -> Column:
    """Prose of wiki markup: constructs become a blank, innermost templates first, links their text."""
    for _ in range(NESTING):
        for pattern in MARKUP:
            text = F.regexp_replace(text, f"(?s){pattern}", " ")
    return F.regexp_replace(F.regexp_replace(text, LINK, "$1"), "'{2,}", "")


def strip_stress(text: Column) -> Column:
    return F.translate(text, STRESS_MARKS, "")


def stress_positions(marked: Column) -> Column:
    """Numbers, from 1, of the vowels that a + follows."""
    vowels = F.regexp_extract_all(F.lower(marked), F.lit(f"[{VOWELS}]\\+?"), F.lit(0))
    return F.filter(F.transform(vowels, lambda v, k: F.when(v.endswith("+"), k + 1)), lambda k: k.isNotNull())


def char_ngrams(word: Column, n: int) -> Column:
    """The n-grams of the word between ^ and $; the whole if that is shorter."""
    whole = F.concat(F.lit("^"), word, F.lit("$"))
    return F.when(F.length(whole) < n, F.array(whole)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.substring(whole, i, F.lit(n))))


#: What only the second orthography writes.
MARKS_OF_T = "[зсцнл]ь[бвгдзклмнпрстфхцчш]|[зсцн]ь[еёіюя]|дзь|ґ|(?U)\\bэў|[бвгдзкмпстфхр]л[яёю]|[дтзсц]ы[кс]т"


def sentences(text: Column, least: int, most: int) -> Column:
    """Cyrillic sentences of so many words that only the second orthography writes so."""
    parts = F.split(F.translate(text, "\n", " "), "(?U)(?<=[.!?…])\\s+(?=\\p{Lu})")
    clean = F.transform(parts, lambda s: sanitize(F.trim(F.regexp_replace(s, "(?U)\\s+", " "))))
    fits = lambda s: s.rlike("(?U)^[\\p{IsCyrillic}\\s\\p{IsPunctuation}\\d«»—–-]+$") & s.rlike("\\p{IsCyrillic}{2,}") & F.size(F.split(s, " ")).between(least, most) & F.lower(s).rlike(MARKS_OF_T)
    return F.filter(clean, fits)
