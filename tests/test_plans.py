"""Where the registered queries move their rows, and what they look at."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions.translit import transliterated
from wordloom.operators import classifier, convert
from wordloom.operators.resolve import Options
from wordloom.operators.tokens import kind_of, tokenize
from wordloom.plans import queries, sql_queries

TEXTS = [(0, "Łacinka i жla, la’ж"), (1, "laé d’la McDonald"), (2, "ж-a b-ж"), (3, None), (None, "жla’la łaé'la"), (5, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_joined_where_they_lie(spark, tables):
    plan = queries.tokens_joined(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("query", ["word_frequencies", "scoped_neighbours"])
def test_kinds_are_told_of_counted_tokens(spark, tables, query):
    plan = optimized((queries.QUERIES | sql_queries.QUERIES)[query](spark, tables))
    below = plan[plan.index("Generate ") :]
    assert "RLIKE" in plan and "RLIKE" not in below


def test_dictionary_meets_the_words_of_whole_texts(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    read = F.transform(F.filter(tokenize(transliterated(F.col("text"), "lacinka_reverse")), lambda t: kind_of(t) == "word"), F.lower)
    wanted = docs.select(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)).cast("int").alias("batch"), F.explode(read).alias("word")).distinct()
    assert sorted(map(tuple, queries.met_words(docs).collect())) == sorted(map(tuple, wanted.collect()))


def test_features_are_counted_by_single_words(spark, monkeypatch):
    rows = [("сонца", None, "й"), ("сонца", "э-э", None), ("й", "сонца", "ён"), ("й", "сонца", "ён"), ("ёсць", None, None), (None, "й", "й")]
    places = spark.createDataFrame(rows, "source string, before string, after string")
    wanted = classifier.featurize(places).select(F.explode("named").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    sizes, settle = [], classifier.settle
    monkeypatch.setattr(classifier, "settle", lambda df: (out := settle(df), sizes.append(out.count()))[0])
    assert sorted(map(tuple, classifier.feature_counts(places).collect())) == sorted(map(tuple, wanted.collect()))
    # Three words and a null as sources and before, two and a null after.
    assert sizes == [11]


def test_words_that_stay_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(convert, "BROADCAST_WORDS", 1)
    docs = spark.createDataFrame([(1, "снег ляжаў тут доўга, а мы там былі")], "k long, text string")
    rows = convert.with_words(docs, "k", F.col("text"), Options())
    # One word has a rule; the texts are dealt by key, as their tokens need not move.
    assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()
    words = {w["token"]: (w["low"], w["target"], w["method"], w["stressed"], w["names"]) for w in rows.first()["words"]}
    assert words["снег"][:3] == ("снег", "сьнег", "rule") and words["тут"] == ("тут", "тут", "unknown", False, [])
