"""Recall and precision by the number of candidate stems that the inventory takes in, for every number at once.

A word, or a part of it between hyphens, changes only where a candidate begins
it that is no shorter than the stem it had: those of lower rank, and the
inventory's own. So each word has a few steps, found by one join on beginnings;
each step is worked out once, and gives what it adds to the hits and to the
wrong changes at its rank. The curve is the running sum of these by rank, by
blocks of ranks, so neither the words nor the ranks are in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.candidates import prefixes
from wordloom.operators.evaluate import classify_scope, ratio, wilson
from wordloom.operators.resolve import Options, lexicon_of, ruled
from wordloom.operators.settled import settle
from wordloom.operators.stems import STEM, match_stems

#: Ranks of a block of the running sums.
BLOCK = 10_000


def _steps(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(word, rank, k, part, best): each word at each rank of a candidate that begins one of its parts, with the stem that each part then has (null: its own)."""
    begun = parts.filter("part <> ''").select("part", "own").distinct().select("part", "own", F.explode(prefixes(F.col("part"))).alias("stem"))
    entry = F.struct(F.length("stem").alias("length"), "rank", "stem", "codes", "target")
    met = begun.join(candidates, "stem").filter(F.length("stem") >= F.coalesce("own", F.lit(0))).select("part", entry.alias("c"))
    met = settle(parts.join(met, "part").select("word", "k", "c"))
    ranks = met.select("word", F.col("c.rank").alias("rank")).distinct()
    # A word has no more candidates than letters, so neither of these joins grows within a word.
    best = met.join(ranks, "word").filter("c.rank <= rank").groupBy("word", "rank", "k").agg(F.max("c").alias("best"))
    return ranks.join(parts.select("word", "k", "part"), "word").join(best, ["word", "rank", "k"], "left")


def _stem(best: Column) -> Column:
    """A candidate as match_stems would give it."""
    fields = (best["stem"].alias("stem"), F.lit("loan").alias("kind"), best["codes"].alias("alternations"), F.lit(0).alias("first"), best["length"].alias("last"), best["target"].alias("target"), F.lit(None).cast("int").alias("length"))
    return F.struct(*fields).cast(STEM)


def recall_curve(pairs: DataFrame, candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """(stems, hits, in_scope, wrong, recall, recall_low, recall_high, precision, precision_low, precision_high), a row for each number of stems from 0.

    pairs: (source, expected) words, as often as they count, each taken by
    itself in small letters; candidates: (rank, stem, codes, target), ranks 1, 2
    and so on; codes: array of alternations; of equal stems the one of higher
    rank counts, and any replaces the inventory's own. Words that the lexicon
    has don't change. Rows with a null are left out. The point at N is what
    ``recall_figures`` gives for conversion with the first N candidates.
    """
    counted = pairs.select(F.lower("source").alias("word"), F.lower("expected").alias("expected")).filter("word <> '' AND expected IS NOT NULL").groupBy("word", "expected").agg(F.count("*").alias("n"))
    counted = settle(counted.withColumn("in_scope", (F.col("word") != F.col("expected")) & (classify_scope(F.col("word"), F.col("expected")) == "in_scope")))
    listed = F.broadcast(lexicon_of(pairs.sparkSession, options).select("word", F.col("target").alias("fixed")))
    words = counted.select("word").distinct().join(listed, "word", "left")
    cut = words.select("word", "fixed", F.posexplode(F.when(F.col("fixed").isNull(), F.split("word", "-")).otherwise(F.array("word"))).alias("k", "part"))
    own = settle(match_stems(cut.filter("part <> ''").select(F.col("part").alias("word")).distinct(), options.direction, folder=options.folder))
    parts = settle(cut.join(own.select(F.col("word").alias("part"), F.length("stem.stem").alias("own")), "part", "left").select("word", "fixed", "k", "part", "own"))
    at_first = parts.select("word", F.lit(0).cast("long").alias("rank"), "k", "part", F.lit(None).cast("struct<length: int, rank: long, stem: string, codes: array<string>, target: string>").alias("best"))
    given = candidates.select(F.col("rank").cast("long").alias("rank"), "stem", "codes", "target")
    steps = settle(at_first.unionByName(_steps(parts.filter("fixed IS NULL"), given)))
    # Each part with each of its stems goes through the rules once.
    new = steps.filter("best IS NOT NULL").select(F.col("part").alias("word"), _stem(F.col("best")).alias("stem"), F.col("best.rank").alias("by")).distinct()
    old = own.select("word", "stem", F.lit(0).cast("long").alias("by"))
    outs = ruled(new.unionByName(old), options, "by").select(F.col("word").alias("part"), "by", "target")
    made = steps.withColumn("by", F.coalesce("best.rank", F.lit(0).cast("long"))).join(outs, ["part", "by"], "left").select("word", "rank", "k", F.coalesce("target", "part").alias("out"))
    whole = made.groupBy("word", "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "out"))), lambda x: x["out"]), "-").alias("out"))
    judged = whole.join(counted, "word").select("word", "expected", "rank", "n", (F.col("in_scope") & (F.col("out") == F.col("expected"))).cast("int").alias("hit"), ((F.col("word") == F.col("expected")) & (F.col("out") != F.col("word"))).cast("int").alias("wrong"))
    earlier = Window.partitionBy("word", "expected").orderBy("rank")
    gain = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(earlier), F.lit(0))) * F.col("n")
    gains = judged.select("rank", gain("hit").alias("hits"), gain("wrong").alias("wrong")).groupBy("rank").agg(F.sum("hits").alias("hits"), F.sum("wrong").alias("wrong"))
    points = given.select("rank").distinct().unionByName(pairs.sparkSession.range(1).select(F.col("id").alias("rank"))).join(gains, "rank", "left").select("rank", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
    summed = _running(settle(points))
    total = counted.agg(F.coalesce(F.sum(F.when(F.col("in_scope"), F.col("n"))), F.lit(0)).alias("n")).first()["n"]
    made_changes, scope = F.col("hits") + F.col("wrong"), F.lit(total).cast("long")
    r, p = wilson(F.col("hits"), scope), wilson(F.col("hits"), made_changes)
    return summed.select(F.col("rank").alias("stems"), "hits", scope.alias("in_scope"), "wrong", ratio(F.col("hits"), scope).alias("recall"), r["low"].alias("recall_low"), r["high"].alias("recall_high"), ratio(F.col("hits"), made_changes).alias("precision"), p["low"].alias("precision_low"), p["high"].alias("precision_high"))


def _running(points: DataFrame) -> DataFrame:
    """points (rank, hits, wrong) with running sums: within blocks of ranks, and over the blocks' sums."""
    block = F.floor(F.col("rank") / BLOCK).alias("block")
    blocks = points.groupBy(block).agg(F.sum("hits").alias("h"), F.sum("wrong").alias("w"))
    # A row for each block of ranks.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("h", "w")])
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = points.select("*", block).select("rank", "block", F.sum("hits").over(inside).alias("hits"), F.sum("wrong").over(inside).alias("wrong"))
    return summed.join(F.broadcast(blocks), "block").select("rank", (F.col("hits") + F.col("h")).alias("hits"), (F.col("wrong") + F.col("w")).alias("wrong"))
