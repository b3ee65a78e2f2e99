"""Words as a sorted table: search by beginning reads the files and row groups that may hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a row group: a search reads a few of them at most.
ROW_GROUP = 4 << 20


def write_index(words: DataFrame, path: str, word: str = "word", row_group: int = ROW_GROUP) -> None:
    """Write words (null ones go), with their other columns, in ranges of the word and sorted within."""
    ranged = words.filter(F.col(word).isNotNull()).repartitionByRange(word).sortWithinPartitions(word)
    ranged.write.option("parquet.block.size", row_group).mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def beginning(index: DataFrame, prefix: str, word: str = "word") -> DataFrame:
    """The index's rows whose word begins so; the scan leaves out what cannot."""
    return index.filter(F.col(word).startswith(prefix))


def search(index: DataFrame, prefix: str, limit: int, *order: str | Column, word: str = "word") -> DataFrame:
    """The first rows that begin so, in the order given and then by word."""
    return beginning(index, prefix, word).orderBy(*order, word).limit(limit)


def contained(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """The rows of words whose word the index has."""
    return words.join(index.select(word), word, "left_semi")


def completions(index: DataFrame, prefixes: DataFrame, limit: int, *order: str | Column, longest: int = 32, word: str = "word") -> DataFrame:
    """(prefix, rank, and the index's columns): for each distinct prefix the first words that begin so; null prefixes, and those that no word has, are left out.

    Each word meets its own beginnings of the lengths that occur, so no word is
    compared with a prefix that it lacks; ranks are cut within tasks before they
    are by prefix, so one that begins a third of all words sends a few rows on.
    A prefix beyond longest is an error.
    """
    wanted = prefixes.select("prefix").filter("prefix IS NOT NULL").distinct()
    lengths = [r["k"] for r in wanted.select(F.least(F.length("prefix"), F.lit(longest + 1)).alias("k")).distinct().orderBy("k").collect()]
    if lengths and lengths[-1] > longest:
        raise ValueError(f"a prefix is longer than {longest}")
    fits = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length(word))
    own = index.select(F.explode(F.transform(fits, lambda k: F.substring(F.col(word), F.lit(1), k))).alias("prefix"), *index.columns)
    ranked = own.join(wanted, "prefix", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*order, word)))
    return ranked.filter(F.col("rank") <= limit).select("prefix", "rank", *index.columns)
