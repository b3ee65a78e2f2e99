"""Traces, requirements of rules, checks of tables, case coverage, the classifier."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wordloom.functions import rules
from wordloom.functions.rules import TO_N, TO_T, Rule
from wordloom.operators import checks, classifier
from wordloom.operators.explain import case_coverage, explain_words, replay
from wordloom.operators.resolve import Options
from wordloom.operators.stems import STEM


def test_traces(spark):
    words = spark.createDataFrame([("снег",), ("Снег",), ("план",), ("лес",), ("",), (None,)], "word string")
    out = {r["word"]: r for r in explain_words(words).collect()}
    assert sorted(out) == ["лес", "план", "снег"]
    assert [tuple(s) for s in out["снег"]["steps"]] == [("palat.assim", "снег", "сьнег")] and out["снег"]["citation"] == "Збор 2005, §29"
    assert out["план"]["target"] == "плян" and out["план"]["stem"] == "план"
    assert (out["лес"]["target"], out["лес"]["method"], out["лес"]["steps"]) == ("лес", "unknown", [])
    back = explain_words(spark.createDataFrame([("сьнег",)], "word string"), Options(TO_N)).first()
    assert back["target"] == "снег" and [s["rule"] for s in back["steps"]] == ["palat.unassim"]
    assert explain_words(words.limit(0)).count() == 0


def test_requirements(spark):
    one, two = Rule("one", TO_T, 9, "", "а", "о"), Rule("two", TO_T, 8, "", "к", "х", requires=("one",))
    steps = spark.createDataFrame([("кат",), ("кіт",)], "word string").select("word", rules.traces(F.col("word"), F.lit(None).cast(STEM), [one, two]).alias("s")).collect()
    assert {r["word"]: [s["rule"] for s in r["s"]] for r in steps} == {"кат": ["one", "two"], "кіт": []}
    assert rules.validate() == []
    bad = (Rule("a", TO_T, 1, "", requires=("b",)), Rule("b", TO_T, 1, "", requires=("a",)), Rule("c", TO_N, 1, "", requires=("a", "x")), Rule("a", "north", 1, ""))
    assert [p.split()[0] + p.split()[1] for p in rules.validate(bad[:2])] == ["ais", "bis"]
    text = "\n".join(rules.validate(bad))
    assert "a repeats" in text and "x, which is absent" in text and "other direction" in text and "unknown direction" in text
    assert [r.id for r in rules.with_options(TO_T, ("loan.f_substitution",)) if r.optional] == ["loan.f_substitution"]
    with pytest.raises(ValueError, match="no optional rules"):
        rules.with_options(TO_T, ("palat.assim",))


def test_checks(spark):
    pairs = spark.createDataFrame([(0, "снег", "сьнег"), (1, "Снег", "снег"), (2, "", "x"), (3, "a b", "лес"), (4, None, "лес"), (5, "дом", "дом")], "k int, narkamauka string, taraskievica string")
    found = {(r["row"], r["severity"], r["problem"]) for r in checks.lexicon_problems(pairs, "k").collect()}
    assert found == {("Снег → снег", "warning", "contradicts the first entry, сьнег"), (" → x", "error", "empty side"), ("лес", "error", "empty side"), ("a b → лес", "error", "blank in the source"), ("a b → лес", "error", "letters outside the alphabet in the source")}
    rows = [("план", "loan", ["l"], None, "x", "cited", True), ("план", "loan", ["l"], None, "", "cited", True), ("клас", "loan", [], None, "x", "reviewed", True), ("дом", "native", ["l"], None, "", "cited", True), ("лес", "tree", ["z"], None, "", "y", True)]
    stems = spark.createDataFrame(rows, "stem string, kind string, alternations array<string>, target string, source string, provenance string, anchored boolean")
    got = sorted((r["row"], r["problem"]) for r in checks.stem_problems(stems).collect())
    assert got == sorted([("план", "repeated stem")] * 2 + [("план", "cited without a source"), ("клас", "never fires"), ("дом", "a native stem licenses nothing"), ("лес", "unknown class"), ("лес", "unknown provenance"), ("лес", "unknown alternation")])
    corpus = spark.createDataFrame([("а", "б", "T", 0.9, "train"), ("а", "а", "T", 1.5, "dev"), ("", "б", "", 0.5, "x")], "source string, expected string, title string, similarity double, split string")
    every = checks.all_problems({"corpus": corpus, "stems": stems.limit(0), "function words": spark.createDataFrame([("не", "particle_n2t", "-", "")], "form string, role string, target string, citation string")})
    assert sorted(r["problem"] for r in every.collect()) == sorted(["equal sides", "similarity outside 0 to 1", "empty side", "unknown split", "an article in more than one split", "a particle needs a target", "no citation"])
    known = spark.createDataFrame([("n2t", "а", "а"), ("x", "б", "в"), ("n2t", "а", "г")], "direction string, source string, target string")
    assert sorted(r["problem"] for r in checks.known_problems(known).collect()) == ["nothing changes", "repeated word", "repeated word", "unknown direction"]
    with pytest.raises(ValueError, match="no checks"):
        checks.all_problems({"x": corpus})


def test_cases(spark):
    words = spark.createDataFrame([("снег", "сьнег", "rule", "palat.assim"), ("Міф", "міт", "lexicon", None), ("лес", "лес", "unknown", None)], "source string, out string, method string, rule string")
    tables = spark.createDataFrame([("a.tsv", "міф"), ("b.tsv", "дом")], "name string, word string")
    out = {r["name"]: (r["n"], r["gap"]) for r in case_coverage(words, tables, exempt=("loan.eu",)).collect()}
    assert out["palat.assim"] == (1, False) and out["a.tsv"] == (1, False) and out["b.tsv"] == (0, True) and out["loan.eu"] == (0, False) and out["palat.geminate"] == (0, True)
    cases = spark.createDataFrame([("a", "a"), ("b", "a"), (None, None), (None, "a")], "actual string, expected string")
    assert [r["passed"] for r in replay(cases).collect()] == [True, False, True, False]


def test_classifier(spark):
    pairs = [(f"{a}ла{b}", f"{a}ля{b}", "гэта " + f"{a}ла{b}") for a in ("п", "к", "б", "ф", "г") for b in ("н", "с", "та")] + [("не", "ня", f"{w} не быў") for w in ("я", "ты", "ён", "хто", "яны")] + [(w, w, w) for w in ("дом", "рэчка", "хата", "вада", "мора", "поле")] + [("дом", "вежа", "")]
    rows = spark.createDataFrame(pairs, "source string, target string, context string")
    table = classifier.training_table(rows)
    labels = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels == {"soft_l": 15, "particle": 5, "keep": 6}
    neighbours = classifier.with_neighbours(spark.createDataFrame([("не", "Ён не быў"), ("лес", "дом"), ("а", None)], "source string, context string")).collect()
    assert [(r["before"], r["after"]) for r in neighbours] == [("ён", "быў"), (None, None), (None, None)]
    model = classifier.train(table)
    asked = spark.createDataFrame([("плаз", "гэта плаз"), ("не", "яна не быў"), ("вада", "вада")], "source string, context string")
    got = {r["source"]: r for r in classifier.predict(model, asked, threshold=0.5).collect()}
    assert got["плаз"]["word"] == "пляз" and got["не"]["word"] == "ня" and got["вада"]["word"] == "вада"
    assert {r["word"] for r in classifier.predict(model, asked, threshold=1.1).collect()} == {"плаз", "не", "вада"}
    folds = classifier.cross_validate(table, 3).collect()
    assert sum(r["n"] for r in folds) == 26 and all(r["accuracy"] > 0.7 for r in folds)
