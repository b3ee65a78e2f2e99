"""A dictionary that grows: words are resolved when they are first met, and kept in a folder for later batches.

The folder holds a Parquet table for each batch (the words that it met first)
and, every MERGED batches, one with all words before. A batch reads only what
earlier batches wrote and replaces what an earlier try of itself left, so one
that runs again finds what it found the first time. A store belongs to one
stream and to one set of options: it names their digest, and others are refused.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.resolve import Options, dictionary, lexicon_rows
from wordloom.operators.settled import settle
from wordloom.sources import reference_tables

#: Batches whose tables are merged into one, so that a long stream leaves few of them to read.
MERGED = 32
ENTRIES = "word string, target string, method string, rule string, stressed boolean, names array<string>"


def digest_of(options: Options) -> str:
    """What the words' entries depend on: direction, variant, and the rows of all tables, in any order."""
    fixed = (options.code, options.aggressive, lexicon_rows(options.code, options.folder), reference_tables.stems(options.folder), reference_tables.function_words(options.folder), options.rules)
    sums = []
    for table, column in ((options.stress, "form"), (options.ment, "suffix")):
        row = None if table is None else table.select(column).distinct().agg(F.count("*"), F.sum(F.xxhash64(column).cast("decimal(38, 0)"))).first()
        sums.append(None if row is None else tuple(row))
    return hashlib.sha256(repr((fixed, sums)).encode()).hexdigest()


@dataclass(frozen=True)
class WordStore:
    """path: a folder that driver and executors share; options: those of every conversion that uses the store."""

    spark: SparkSession
    path: str
    options: Options

    def __post_init__(self) -> None:
        made_for, digest = f"{self.path}/options", digest_of(self.options)
        if self._complete(made_for):
            if self.spark.read.text(made_for).first()["value"] != digest:
                raise ValueError(f"{self.path} holds words resolved with other options or tables")
        else:
            self.spark.createDataFrame([(digest,)], "value string").write.mode("overwrite").text(made_for)

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _complete(self, path: str) -> bool:
        files, place = self._folder(f"{path}/_SUCCESS")
        return files.exists(place)

    def known(self, batch: int) -> DataFrame:
        """The entries of all words that batches before this one met."""
        merged = batch // MERGED * MERGED
        while merged and not self._complete(f"{self.path}/merged={merged}"):
            merged -= MERGED
        parts = [f"{self.path}/merged={merged}"] if merged else []
        parts += [p for p in (f"{self.path}/batch={k}" for k in range(merged, batch)) if self._complete(p)]
        return self.spark.read.schema(ENTRIES).parquet(*parts) if parts else self.spark.createDataFrame([], ENTRIES)

    def entries(self, words: DataFrame, batch: int) -> DataFrame:
        """The entries of the words (word), like ``dictionary``; those that no earlier batch met are resolved and kept under this one."""
        words = settle(words.select("word").filter("word IS NOT NULL").distinct())
        if batch and batch % MERGED == 0 and not self._complete(f"{self.path}/merged={batch}"):
            self.known(batch).write.mode("overwrite").parquet(f"{self.path}/merged={batch}")
        known = self.known(batch)
        fresh = words.join(known, "word", "left_anti")
        dictionary(fresh, self.options).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        # A word is in one of the tables only.
        return known.unionByName(self.fresh(batch)).join(words, "word", "left_semi")

    def fresh(self, batch: int) -> DataFrame:
        """The entries that the batch added."""
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/batch={batch}")
