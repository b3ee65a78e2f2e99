"""Writing texts in another script, by way of the orthography that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import sanitize
from wordloom.functions.translit import PAIRED, REVERSE, SCHEMES, detect_script, from_script, to_script, transliterated
from wordloom.operators.convert import TO_N, TO_T, Options, converted_words, text_of

CYRILLIC = "cyrillic"


def _converted(docs: DataFrame, key: str, options: Options) -> DataFrame:
    return converted_words(docs, key, F.col("text"), options).select(key, text_of().alias("text"))


def render(docs: DataFrame, key: str, text: Column, script: str, conversion: bool = True, options: Options = Options()) -> DataFrame:
    """(key, text, unresolved): texts in the script, converted before to the orthography that goes with it; unresolved: what the script can't write faithfully."""
    if script != CYRILLIC and script not in SCHEMES:
        raise ValueError(f"unknown script {script!r}")
    direction = TO_T if script == CYRILLIC else PAIRED[script]
    given = docs.select(key, text.alias("text"))
    if conversion:
        given = _converted(given, key, Options(direction, options.aggressive, options.folder, options.stress, options.ment))
    if script == CYRILLIC:
        return given.select(key, "text", F.array().cast("array<string>").alias("unresolved"))
    made = to_script(sanitize(F.col("text")), script, options.folder)
    return given.select(key, made.alias("made")).select(key, "made.text", "made.unresolved")


def read_script(docs: DataFrame, key: str, text: Column, script: str, direction: str | None = None) -> DataFrame:
    """(key, text): Latin texts in Cyrillic, converted after unless the direction is absent or the script's own."""
    if script not in REVERSE:
        raise ValueError(f"{script!r} can't be read back")
    read = docs.select(key, from_script(sanitize(text, "latin"), script)["text"].alias("text"))
    if direction is None or direction == PAIRED[script]:
        return read
    return _converted(read, key, Options(direction))


def transcode(docs: DataFrame, key: str, text: Column, to: str, source: str | None = None) -> DataFrame:
    """(key, text): texts in the script ``to``, from the one they are found to be in (or source). Null where that can't be told or read."""
    found = F.lit(source) if source else detect_script(text)["script"]
    given = docs.select(key, text.alias("text"), found.alias("found"))
    parts = [given.filter(F.col("found") == to).select(key, "text"), given.filter(F.col("found").isNull() | ~F.col("found").isin(to, CYRILLIC, *REVERSE)).select(key, F.lit(None).cast("string").alias("text"))]
    if to != CYRILLIC:
        parts.append(render(given.filter(F.col("found") == CYRILLIC), key, F.col("text"), to).select(key, "text"))
    for script in REVERSE:
        if script == to:
            continue
        read = read_script(given.filter(F.col("found") == script), key, F.col("text"), script)
        parts.append(read if to == CYRILLIC else render(read, key, F.col("text"), to).select(key, "text"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


__all__ = ["TO_N", "TO_T", "read_script", "render", "transcode", "transliterated"]
