"""Problems in tables, one row each; a table without rows has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.rules import FUNCTIONS, TO_N, TO_T, Function, compiled
from wordloom.operators.stems import match_stems
from wordloom.sources.reference_tables import ALTERNATIONS, APPLIED, CLASSES, DIRECTIONS, PROVENANCES, ROLES
from wordloom.sources.rule_tables import RuleRow

ERROR, WARNING = "error", "warning"


def _problems(df: DataFrame, table: str, row: Column, found: list[tuple[Column, str]]) -> DataFrame:
    """(table, row, severity, problem): a row for each condition that holds."""
    each = F.filter(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(text)) for condition, text in found]), lambda p: p.isNotNull())
    return df.select(F.lit(table).alias("table"), row.alias("row"), F.lit(ERROR).alias("severity"), F.explode(each).alias("problem"))


def lexicon_problems(pairs: DataFrame, *order: str) -> DataFrame:
    """Of lexicon rows (narkamauka, taraskievica, and the columns of their order): empty sides, blanks, letters outside the alphabet; as a warning, an entry that contradicts the first one for its word."""
    a, b = F.coalesce("narkamauka", F.lit("")), F.coalesce("taraskievica", F.lit(""))
    row = F.concat_ws(" → ", "narkamauka", "taraskievica")
    empty = (a == "") | (b == "")
    foreign = lambda c: ~empty & F.lower(c).rlike(f"[^{tx.LETTERS}{tx.APOSTROPHES}-]")
    faults = _problems(pairs, "lexicon", row, [(empty, "empty side"), (~empty & a.rlike("\\s"), "blank in the source"), (~empty & b.rlike("\\s"), "blank in the target"), (foreign(a), "letters outside the alphabet in the source"), (foreign(b), "letters outside the alphabet in the target")])
    whole = pairs.filter(~empty).withColumn("key", F.lower("narkamauka"))
    place = F.struct(*order) if order else F.lower("taraskievica")
    first = whole.groupBy("key").agg(F.min_by(F.lower("taraskievica"), place).alias("first"))
    clash = whole.join(first, "key").filter(F.lower("taraskievica") != F.col("first"))
    return faults.unionByName(clash.select(F.lit("lexicon").alias("table"), row.alias("row"), F.lit(WARNING).alias("severity"), F.concat(F.lit("contradicts the first entry, "), "first").alias("problem")))


def stem_problems(stems: DataFrame) -> DataFrame:
    """Of stems (stem, kind, alternations, target, source, provenance, anchored): repeated ones, those said to be cited without a source, those that would never fire, and values that aren't known."""
    codes = F.coalesce("alternations", F.array().cast("array<string>"))
    idle = (F.size(codes) == 0) & F.col("target").isNull()
    loan = F.col("kind") == "loan"
    repeated = F.count("*").over(Window.partitionBy("stem", "anchored")) > 1
    marked = stems.withColumn("_repeated", repeated)
    return _problems(marked, "stems", F.col("stem"), [
        (F.col("_repeated"), "repeated stem"), (F.coalesce("stem", F.lit("")) == "", "empty stem"),
        (~F.col("kind").isin(*CLASSES), "unknown class"), (~F.col("provenance").isin(*PROVENANCES), "unknown provenance"),
        (F.size(F.array_except(codes, F.array(*[F.lit(c) for c in ALTERNATIONS]))) > 0, "unknown alternation"),
        (loan & (F.col("provenance") == "cited") & (F.coalesce("source", F.lit("")) == ""), "cited without a source"),
        (loan & F.col("provenance").isin(*APPLIED) & idle, "never fires"), ((F.col("kind") == "native") & ~idle, "a native stem licenses nothing"),
    ])


def function_word_problems(words: DataFrame) -> DataFrame:
    """Of function words (form, role, target, citation)."""
    empty = lambda c: F.coalesce(c, F.lit("")).isin("", "-", "?")
    return _problems(words, "function words", F.col("form"), [(empty("form"), "empty form"), (~F.col("role").isin(*ROLES), "unknown role"), (F.col("role").startswith("particle") & empty("target"), "a particle needs a target"), (empty("citation"), "no citation")])


def corpus_problems(rows: DataFrame) -> DataFrame:
    """Of parallel rows (source, expected, title, similarity, split): empty sides, equal sides, unknown splits, similarities outside 0 to 1, articles in more than one split."""
    a, b = F.coalesce("source", F.lit("")), F.coalesce("expected", F.lit(""))
    faults = _problems(rows, "corpus", F.concat_ws(" → ", "source", "expected"), [((a == "") | (b == ""), "empty side"), ((a == b) & (a != ""), "equal sides"), (~F.col("split").isin("train", "dev", "test"), "unknown split"), (~F.col("similarity").between(0, 1), "similarity outside 0 to 1")])
    several = rows.filter("title <> ''").groupBy("title").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
    return faults.unionByName(several.select(F.lit("corpus").alias("table"), F.col("title").alias("row"), F.lit(ERROR).alias("severity"), F.lit("an article in more than one split").alias("problem")))


def known_problems(rows: DataFrame) -> DataFrame:
    """Of known false positives (direction, source, target, rule, cause): unknown directions, words that don't change, repeated words."""
    marked = rows.withColumn("_k", F.count("*").over(Window.partitionBy("direction", "source")))
    return _problems(marked, "known", F.col("source"), [(~F.col("direction").isin(*DIRECTIONS), "unknown direction"), (F.col("source") == F.col("target"), "nothing changes"), (F.col("_k") > 1, "repeated word")])


def failing_rule_tests(spark: SparkSession, rows: tuple[RuleRow, ...], functions: dict[str, Function] = FUNCTIONS) -> DataFrame:
    """(rule, word, expected, made) of the rules' own tests that fail; each rule is tried by itself, once."""
    rules, out = {r.id: r for r in compiled(rows, functions)}, None
    for direction in (TO_T, TO_N):
        cases = [(r.id, word, expected) for r in rows if r.direction == direction for word, expected in r.tests]
        tests = spark.createDataFrame(cases, "rule string, word string, expected string")
        found = tests.join(match_stems(tests.select("word").distinct(), direction), "word")
        made = F.lit(None).cast("string")
        for rule in {rule for rule, *_ in cases}:
            made = F.when(F.col("rule") == rule, rules[rule].change(F.col("word"), F.col("stem"))).otherwise(made)
        failed = found.select("rule", "word", "expected", made.alias("made")).filter("NOT made <=> expected")
        out = failed if out is None else out.unionByName(failed)
    return out


CHECKS = {"lexicon": lexicon_problems, "stems": stem_problems, "function words": function_word_problems, "corpus": corpus_problems, "known": known_problems}


def all_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """Problems of all tables given by name."""
    unknown = tables.keys() - CHECKS.keys()
    if unknown or not tables:
        raise ValueError(f"no checks for {sorted(unknown)}" if unknown else "no tables")
    out = None
    for name, df in tables.items():
        part = CHECKS[name](df)
        out = part if out is None else out.unionByName(part)
    return out
