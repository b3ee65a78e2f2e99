"""What happened to a word, step by step, and which cases reach which rules and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.rules import RULES, citation, rules_for, traces
from wordloom.operators.resolve import Options, lexicon_of
from wordloom.operators.settled import settle
from wordloom.operators.stems import match_stems


def explain_words(words: DataFrame, options: Options = Options()) -> DataFrame:
    """(word, target, method, stem, steps, citation) of distinct words: the lexicon's entry, or each rule's change with the word before and after.

    Words are taken in small letters and without their neighbours. Null and
    empty words, and repeated ones, give one row at most, with no steps.
    """
    low = words.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    found = match_stems(low, options.direction, folder=options.folder)
    traced = found.select("word", F.col("stem.stem").alias("stem"), traces(F.col("word"), F.col("stem"), rules_for(options.direction, options.aggressive, options.rules)).alias("steps"))
    both = traced.join(F.broadcast(lexicon_of(words.sparkSession, options)), "word", "left")
    ruled = F.coalesce(F.try_element_at("steps", F.lit(-1))["after"], F.col("word"))
    listed = F.col("method").isNotNull()
    none = F.array().cast("array<struct<rule: string, before: string, after: string>>")
    steps = F.when(listed, none).otherwise(F.col("steps"))
    return both.select("word", F.coalesce("target", ruled).alias("target"), F.coalesce("method", F.when(F.size("steps") > 0, "rule").otherwise("unknown")).alias("method"), "stem", steps.alias("steps"), citation(F.transform(steps, lambda s: s["rule"]), options.rules).alias("citation"))


def replay(cases: DataFrame, actual: Column | str = "actual") -> DataFrame:
    """cases (kind, input, expected, ...) with ``passed``: whether what is made now equals what was recorded; a null is equal to a null only."""
    made = F.col(actual) if isinstance(actual, str) else actual
    return cases.withColumn("passed", made.eqNullSafe(F.col("expected")))


def case_coverage(words: DataFrame, tables: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, n, gap) of converted words of all cases (source, out, method, rule): how many changes reach each rule and each lexicon table (name, word).

    A gap is a rule or table that nothing reaches, unless it is exempt.
    """
    changed = settle(words.filter("source <> out").select(F.lower("source").alias("word"), "method", "rule"))
    rules = words.sparkSession.createDataFrame([(r.id,) for r in RULES], "name string")
    fired = changed.select(F.explode(F.split("rule", "\\+")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    ruled = rules.join(fired, "name", "left").select(F.lit("rule").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    listed = changed.filter("method = 'lexicon'").groupBy("word").agg(F.count("*").alias("k"))
    held = tables.distinct().join(listed, "word", "left").groupBy("name").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    both = ruled.unionByName(held.select(F.lit("lexicon").alias("kind"), "name", "n"))
    return both.withColumn("gap", (F.col("n") == 0) & ~F.col("name").isin(*exempt) if exempt else F.col("n") == 0)
