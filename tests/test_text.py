"""Hygiene, casing, tokens, scripts and statistics."""

import math

import pytest

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.rules import RULES
from wordloom.functions.translit import detect_script, from_script, to_script
from wordloom.operators import evaluate as ev
from wordloom.operators import word_store
from wordloom.operators.convert import convert
from wordloom.operators.resolve import Options
from wordloom.operators.stems import STEM
from wordloom.operators.tokens import kind_of, tokenize
from wordloom.operators.word_store import WordStore
from wordloom.streaming.convert_stream import convert_stream


def values(spark, column, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k long, s string")
    return [r.v for r in df.select("k", column(F.col("s")).alias("v")).orderBy("k").collect()]


def test_sanitize(spark):
    got = values(spark, tx.sanitize, ["сло​ва", "cлова pure", "з'ява з`ява", "край", None])
    assert got == ["слова", "слова pure", "з’ява з’ява", "край", None]
    assert values(spark, lambda c: tx.sanitize(tx.sanitize(c)), ["cло'ва"]) == ["сло’ва"]
    assert values(spark, tx.to_nfc, ["й", "é", None]) == ["й", "é", None]


def test_casing(spark):
    assert values(spark, tx.case_of, ["снег", "Снег", "СНЕГ", "У", "сНег", "12", "З’ява"]) == ["lower", "title", "upper", "title", "mixed", "lower", "title"]
    df = spark.createDataFrame([("СНЕГ", "сьнег"), ("Нью-Ёрк", "нью-ёрк"), ("План-СІСТЭМА", "плян-сыстэма"), ("«я", "ён")], "a string, b string")
    assert [r.v for r in df.select(tx.recase_like(F.col("a"), F.col("b")).alias("v")).collect()] == ["СЬНЕГ", "Нью-Ёрк", "Плян-СЫСТЭМА", "ён"]


def test_tokens_are_lossless(spark):
    texts = ["Што-небудзь з’ява, abc-d 12,5... \n\t🎉х", "", "a—b  «с»", " \x85x"]
    assert values(spark, lambda c: F.array_join(tokenize(c), ""), texts) == texts
    kinds = values(spark, lambda c: F.transform(tokenize(c), kind_of), texts)[0]
    assert kinds == ["word", "space", "word", "punct", "space", "latin", "space", "number", "punct", "space", "punct", "word"]


def test_scripts(spark):
    assert values(spark, lambda c: to_script(c, "lacinka")["text"], ["сьнег лес ляк Я", "маўзэр"]) == ["śnieh les lak Ja", "maŭzer"]
    assert values(spark, lambda c: from_script(c, "lacinka")["text"], ["Śnieh, les! kantrol"]) == ["Сьнег, лес! кантроль"]
    found = values(spark, detect_script, ["Снег", "biełaruskaja", "ĺ", "łĺ", "12", "abc"])
    assert [(x.script, x.certain) for x in found] == [("cyrillic", True), ("lacinka", True), ("official", True), (None, False), (None, False), ("lacinka", False)]


def test_scope_and_folds(spark):
    assert values(spark, tx.neutral_fold, ["сьнег", "плян", "сыстэма", "Блёк"]) == ["снег", "план", "сістема", "блок"]
    df = spark.createDataFrame([("снег", "сьнег"), ("армейскі", "армэйскі"), ("лістка", "лістку"), ("яго", "ягонага"), ("хата", "будынак")], "a string, b string")
    got = [r.v for r in df.select(ev.classify_scope(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == ["in_scope", "in_scope", "grammatical", "grammatical", "not_orthographic"]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (3, 10), (10, 10)], "s long, n long")
    for r in df.select("s", "n", ev.wilson(F.col("s"), F.col("n")).alias("w")).collect():
        if r.n == 0:
            assert tuple(r.w) == (0.0, 0.0)
            continue
        p, z = r.s / r.n, 1.96
        centre = (p + z * z / (2 * r.n)) / (1 + z * z / r.n)
        margin = z * math.sqrt(p * (1 - p) / r.n + z * z / (4 * r.n**2)) / (1 + z * z / r.n)
        assert abs(r.w.low - max(0, centre - margin)) < 1e-12 and abs(r.w.high - min(1, centre + margin)) < 1e-12


@pytest.mark.parametrize(("kind", "hits", "n"), [("int", 20_000, 23_171), ("int", 2_000_000_000, 2_100_000_000), ("long", 3_000_000_000, 4_000_000_000)])
def test_wilson_of_counts_whose_squares_are_no_integers(spark, kind, hits, n):
    """As of numbers that don't end; a count of either width may be up to its type's end."""
    low, high = spark.createDataFrame([(hits, n)], f"s {kind}, n {kind}").select(ev.wilson(F.col("s"), F.col("n")).alias("w")).first().w
    p, z = hits / n, 1.96
    centre, margin = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n**2))
    assert (low, high) == pytest.approx(((centre - margin) / (1 + z * z / n), (centre + margin) / (1 + z * z / n)), abs=1e-12)


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "Снег і план", "Сьнег і плян"), (2, "адно слова", "тры словы тут"), (3, "лес", "лес")], "id long, n string, t string")
    words = ev.aligned(pairs, "id", "n", "t").cache()
    row = ev.evaluate(words).first()
    assert (row.words, row.changed_words, row.changed_correct, row.false_positives) == (4, 2, 2, 0)
    assert row.accuracy == 1.0 and row.baseline_accuracy == 0.5
    assert {r.rule: (r.fired, r.correct) for r in ev.per_rule(words).collect()} == {"palat.assim": (1, 1)}
    assert {r.scope: (r.n, r.hits) for r in ev.recall(words).collect()} == {"in_scope": (2, 2)}


def test_coverage(spark):
    forms = spark.createDataFrame([("план", 5), ("снег", 3), ("лес", 2), ("План", 1)], "word string, n long")
    got = {r.bucket: (r.forms, r.occurrences) for r in ev.coverage(forms).collect()}
    assert got == {"stem_loan": (2, 6), "rule": (1, 3), "untouched": (1, 2)}


def test_baselines(spark):
    schema = "name string, value double"
    recorded = spark.createDataFrame([("a_recall", 0.5), ("b_rate", 0.1), ("forms", 10.0), ("c_precision", 0.9)], schema)
    measured = spark.createDataFrame([("a_recall", 0.49), ("b_rate", 0.101), ("forms", 9.0), ("c_precision", 0.95)], schema)
    assert {r.name: r.regressed for r in ev.compare_baseline(recorded, measured).collect()} == {"a_recall": True, "b_rate": False, "forms": True, "c_precision": False}


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "Снег"), (2, "План і снег")], "id long, text string").repartition(2).write.parquet(folder)
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    convert_stream(stream, "id", "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "Сьнег", 2: "Плян і сьнег"}


def test_stream_resolves_a_word_once(spark, tmp_path):
    """With a dictionary of its own a stream gives what a batch gives, and later batches resolve only words that are new."""
    texts = ["Снег і план, не быў", "План і снег; снег-снег у Германіі", "", None, "сталіца Украіны, не быў"]
    kind = "id long, text string"
    for k, text in enumerate(texts):
        spark.createDataFrame([(k, text)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    words = str(tmp_path / "words")
    convert_stream(stream, "id", "text", str(tmp_path / "out"), str(tmp_path / "state"), words=words).awaitTermination()
    fields = ("id", "text", "changes", "stats")
    by_id = lambda df: {r.id: r for r in df.select(*fields).collect()}
    assert by_id(spark.read.parquet(str(tmp_path / "out"))) == by_id(convert(spark.createDataFrame(list(enumerate(texts)), kind), "id", F.col("text")))
    store = WordStore(spark, words, Options())
    added = [sorted(r.word for r in store.fresh(k).collect()) for k in range(5)]
    assert sorted(sum(added, [])) == sorted({"снег", "і", "план", "не", "быў", "снег-снег", "у", "германіі", "сталіца", "украіны"})
    assert all(added[k] != added[j] or not added[k] for k in range(5) for j in range(k))
    # A batch that runs again finds and leaves the same.
    again = spark.createDataFrame([("снег",), ("у",), ("снег",), (None,)], "word string")
    second = next(k for k in range(5) if "снег-снег" in added[k])
    before = {r.word for r in store.known(second).collect()}
    assert {r.word for r in store.entries(again, second).collect()} == {"снег", "у"}
    assert {r.word for r in store.fresh(second).collect()} == {"снег", "у"} - before
    with pytest.raises(ValueError):
        WordStore(spark, words, Options(aggressive=True))


def test_a_long_store_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(word_store, "MERGED", 2)
    store = WordStore(spark, str(tmp_path / "words"), Options())
    for k in range(5):
        got = store.entries(spark.createDataFrame([("снег",), (f"слова{'а' * k}",)], "word string"), k)
        assert {r.word: r.target for r in got.collect()}["снег"] == "сьнег" and got.count() == 2
    assert sorted(p.name for p in (tmp_path / "words").glob("merged=*")) == ["merged=2", "merged=4"]
    assert [store.fresh(k).count() for k in range(5)] == [2, 1, 1, 1, 1]
    assert store.known(5).count() == 6


def test_softness_chains_as_far_as_the_reference_takes_it(spark):
    rule = next(r for r in RULES if r.id == "palat.geminate")
    made = lambda w: spark.range(1).select(rule.change(F.lit(w), F.lit(None).cast(STEM)).alias("x")).first()["x"]
    assert made("энссссссе") == "энсьсьсьсьсьсе" and made("энссссе") == "энсьсьсьсе"
    assert [r["x"] for r in spark.createDataFrame([("а\n",), ("",), ("Ўё’-",), ("щ",), ("и",)], "w string").select(tx.is_word(F.col("w")).alias("x")).collect()] == [False, True, True, False, False]


def test_look_alikes_are_folded_in_mixed_runs_only(spark):
    # A sign of the script that is no letter stands beside its run, not in it.
    given = ["мaма cat", "a҃ б", "x1ж", "жxж’a-бc", "cat", "бaб́a oo", ""]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(tx.fold_homoglyphs(F.col("t"))).collect()] == ["мама cat", "a҃ б", "x1ж", "жхж’a-бс", "cat", "баб́a oo", ""]
