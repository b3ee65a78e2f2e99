"""What two spellings have in common and where they differ, from one alignment of each pair.

The alignment is a list of matching blocks (i, j, n): n characters from i in the
source and from j in the target, in ascending order, as difflib defines them;
the JVM has no such function, so distinct pairs go through Python in Arrow
batches. All the rest are Columns over the blocks: the edits between them, the
alternations, the shape, the likeness, and what a beginning became.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from wordloom.functions import text as tx
from wordloom.functions.text import let

BLOCKS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("i", "j", "n")]))
#: Vowels and what they become after a soft л; alternations by the letters that change.
SOFTENED = {"а": "я", "о": "ё", "у": "ю", "ы": "і"}
ALTERNATIONS = {("і", "ы"): "i", ("е", "э"): "e"}


@F.pandas_udf(BLOCKS)
def matching_blocks(source: pd.Series, target: pd.Series) -> pd.Series:
    """The blocks of each pair, the last one empty, at both ends; null for a null."""
    match = lambda a, b: None if a is None or b is None else [{"i": i, "j": j, "n": n} for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
    return pd.Series([match(a, b) for a, b in zip(source, target, strict=True)], dtype=object)


def edits(source: Column, target: Column, blocks: Column) -> Column:
    """array<struct(at, old, new)>: what lies between neighbouring blocks; at: where in the source, from 0."""

    def gap(block: Column, k: Column) -> Column:
        earlier = F.when(k > 0, F.get(blocks, k - 1))
        i, j = F.coalesce(earlier["i"] + earlier["n"], F.lit(0)), F.coalesce(earlier["j"] + earlier["n"], F.lit(0))
        return F.struct(i.alias("at"), F.substring(source, i + 1, block["i"] - i).alias("old"), F.substring(target, j + 1, block["j"] - j).alias("new"))

    return F.filter(F.transform(blocks, gap), lambda e: (e["old"] != "") | (e["new"] != ""))


def _letter_codes(source: Column, edit: Column) -> Column:
    """A code for each letter that gave way to another."""

    def code(pair: Column, k: Column) -> Column:
        x, y = pair["x"], pair["y"]
        found = F.when((x == "ґ") | (y == "ґ"), "g").otherwise("other")
        after_l = F.substring(source, edit["at"] + k, F.lit(1)) == "л"
        for hard, soft in SOFTENED.items():
            found = F.when((edit["at"] + k > 0) & after_l & (x == hard) & (y == soft), "l").otherwise(found)
        for (old, new), name in ALTERNATIONS.items():
            found = F.when((x == old) & (y == new), name).otherwise(found)
        return F.when(x != y, found)

    letters = F.zip_with(F.split(edit["old"], ""), F.split(edit["new"], ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(letters, code)


def alternations(source: Column, target: Column, changes: Column) -> Column:
    """array<string>: which alternations make the target of the source; ``soft`` for a ь elsewhere than after л, ``other`` for what none explains."""

    def codes(e: Column) -> Column:
        sign = F.when((e["at"] > 0) & (F.substring(source, e["at"], F.lit(1)) == "л"), "l").otherwise("soft")
        whole = F.when(((e["old"] == "") | (e["new"] == "")) & (F.concat(e["old"], e["new"]) == "ь"), sign).when(F.concat(e["old"], e["new"]).contains("ґ"), "g").otherwise("other")
        return F.when(F.length(e["old"]) == F.length(e["new"]), _letter_codes(source, e)).otherwise(F.array(whole))

    found = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(changes, codes)), lambda c: c.isNotNull())))
    return F.when(source.rlike("^е[ўу]") & target.rlike("^э[ўу]"), F.array(F.lit("eu"))).otherwise(found)


def shape(changes: Column) -> Column:
    """The edits as text."""
    none = lambda c: F.when(c == "", "∅").otherwise(c)
    return F.array_join(F.transform(changes, lambda e: F.concat(none(e["old"]), F.lit("→"), none(e["new"]))), "  ")


def likeness(a: Column, b: Column, blocks: Column) -> Column:
    """Twice the matching characters of both words' own; 1 for two empty ones."""
    same = F.aggregate(blocks, F.lit(0), lambda n, x: n + x["n"])
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * same / (F.length(a) + F.length(b)))


def prefix_image(blocks: Column, target: Column, upto: Column) -> Column:
    """What the source's first ``upto`` characters are in the target: a border inside a block moves with it, one inside a changed stretch goes to that stretch's end."""
    start = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n")))

    def end(bs: Column) -> Column:
        # The last block that begins before the border, and the one after it.
        k = F.greatest(F.size(F.filter(bs, lambda b: b["i"] < upto)), F.lit(1))

        def by(x: Column) -> Column:
            here, after = x["here"], x["after"]
            own = here["i"] + here["n"]
            return F.when(upto < own, here["j"] + upto - here["i"]).when((upto == own) & (after["i"] != upto), here["j"] + here["n"]).otherwise(after["j"])

        return let(F.struct(F.get(bs, k - 1).alias("here"), F.get(bs, k).alias("after")), by)

    return F.substring(target, F.lit(1), let(F.concat(start, blocks), end))


def with_differences(pairs: DataFrame, source: str = "source", expected: str = "expected") -> DataFrame:
    """(source, expected, codes, shape, similarity) of distinct pairs in small letters: alternations, the edits as text, and the likeness of the folded words.

    Join back by the pair. Pairs with a null are left out.
    """
    low = pairs.select(F.lower(source).alias("source"), F.lower(expected).alias("expected")).filter("source IS NOT NULL AND expected IS NOT NULL").distinct()
    folded = low.select("*", tx.neutral_fold(F.col("source")).alias("a"), tx.neutral_fold(F.col("expected")).alias("b"))
    matched = folded.select("*", matching_blocks("source", "expected").alias("blocks"), matching_blocks("a", "b").alias("folded"))
    changed = matched.select("*", edits(F.col("source"), F.col("expected"), F.col("blocks")).alias("edits"))
    codes = F.array_join(alternations(F.col("source"), F.col("expected"), F.col("edits")), ",")
    return changed.select("source", "expected", codes.alias("codes"), shape(F.col("edits")).alias("shape"), likeness(F.col("a"), F.col("b"), F.col("folded")).alias("similarity"))
