"""Lossless tokens and what stands next to a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import APOSTROPHES

#: The alternation of token kinds, in the order in which they are tried, and what a cross-word rule sees through.
WORD = f"\\p{{IsCyrillic}}+(?:[{APOSTROPHES}-]\\p{{IsCyrillic}}+)*"
LATIN = f"\\p{{L}}+(?:[{APOSTROPHES}-]\\p{{L}}+)*"
NUMBER = "\\d+(?:[.,]\\d+)*"
SPACE = "\\s+"
PUNCT = "[^\\p{L}\\d\\s]+"
TOKEN = f"(?Us){WORD}|{LATIN}|{NUMBER}|{SPACE}|{PUNCT}|."
HYPHENS = "-‐‑­"
QUOTES = "«»“”„‟‹›\""


def tokenize(text: Column) -> Column:
    """The text's tokens in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def kind_of(token: Column) -> Column:
    """word, latin, number, space or punct."""
    # The first character tells: the alternatives begin with disjoint classes, Cyrillic before all letters.
    return F.when(token.rlike("^[ \n]"), "space").when(token.rlike("^\\p{IsCyrillic}"), "word").when(token.rlike("^\\p{L}"), "latin").when(token.rlike("(?U)^\\d"), "number").when(token.rlike("(?U)^\\s"), "space").otherwise("punct")


def detokenize(tokens: DataFrame, key: str, place: str = "i", token: str = "token", name: str = "text") -> DataFrame:
    """(key, name): tokens joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(place, token)))
    return tokens.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[token]), "").alias(name))


def explode_tokens(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, i, token, kind, start): a row for each token; start in code points."""
    rows = docs.select(key, F.posexplode(tokenize(text)).alias("i", "token")).withColumn("kind", kind_of(F.col("token")))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))


def with_bridges(tokens: DataFrame, key: str) -> DataFrame:
    """tokens with ``island``: tokens between which cross-word rules see, and ``plain_island``: between which only blanks stand."""
    order = Window.partitionBy(key).orderBy("i")
    quotes = F.col("token").rlike(f"^[{QUOTES}]+$")
    hyphens = F.col("token").rlike(f"^[{QUOTES}{HYPHENS}]+$")
    beside = lambda shift: F.coalesce(shift("kind").over(order) != "space", F.lit(False))
    bridge = (F.col("kind") == "space") | ((F.col("kind") == "punct") & (quotes | (hyphens & (beside(F.lag) | beside(F.lead)))))
    wall = (~(bridge | (F.col("kind") == "word"))).cast("int")
    plain_wall = (~F.col("kind").isin("space", "word")).cast("int")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("_wall", wall).withColumn("_plain", plain_wall).withColumn("island", F.sum("_wall").over(so_far)).withColumn("plain_island", F.sum("_plain").over(so_far)).drop("_wall", "_plain")


def context_words(tokens: DataFrame, key: str, width: int = 2) -> DataFrame:
    """Word tokens with the nearest words on either side, nearest first."""
    order = Window.partitionBy(key).orderBy("i")
    near = lambda shift: F.filter(F.array(*[shift("token", n).over(order) for n in range(1, width + 1)]), lambda x: x.isNotNull())
    return tokens.filter("kind = 'word'").select(key, "i", "token", near(F.lag).alias("before"), near(F.lead).alias("after"))
