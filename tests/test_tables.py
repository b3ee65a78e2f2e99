"""Readers and writers of tables, samples and splits."""

from __future__ import annotations

import bz2
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import candidates as cd
from wordloom.sources import tables


def test_files_in_order_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\nснег\tсьнег\r\nплан\tплян\tn2t\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("клас\tкляса\tt2n\n", encoding="utf-8")
    read = tables.lines(spark, str(tmp_path))
    assert {tuple(r) for r in tables.pairs(read, "t2n").collect()} == {("снег", "сьнег", ""), ("клас", "кляса", "t2n")}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "list.tsv").write_text("# n\nі\t9\nлес\nна\t8\nу\t7\n", encoding="utf-8")
    assert [tuple(r) for r in tables.frequencies(tables.lines(spark, str(tmp_path / "f")), 2).collect()] == [("і", 9), ("на", 8)]
    (tmp_path / "b.tsv").write_text("клас\tкляса\tx\n", encoding="utf-8")
    with pytest.raises(Exception, match="unknown direction"):
        tables.pairs(tables.lines(spark, str(tmp_path))).select("taraskievica").collect()
    with pytest.raises(Exception, match="begin with"):
        tables.w_names(spark.createDataFrame([("вільям\thand\tx",)], "value string")).collect()


def test_declared_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#!schema s:1\n#!columns stem\tclass\n# note\nплан\tloan\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("план\tloan\n#!schema s:1\n", encoding="utf-8")
    (tmp_path / "c.tsv").write_text("#!schema s:2\nклас\tloan\n", encoding="utf-8")
    kept = tables.declared_files(tables.lines(spark, str(tmp_path)), "s:1")
    assert {r.file for r in kept.collect()} == {"a.tsv"}
    said = {r["file"]: (r["schema"], r["columns"]) for r in tables.declarations(tables.lines(spark, str(tmp_path))).collect()}
    assert said == {"a.tsv": ("s:1", ["stem", "class"]), "c.tsv": ("s:2", None)}


def test_names_begin_words(spark):
    names = spark.createDataFrame([("ўільям",), ("ўолт",)], "stem string")
    words = spark.createDataFrame([("Ўільяма",), ("ўчора",), ("лес",), (None,), ("",)], "word string")
    assert {r.word: r.w_name for r in tables.with_w_names(words, names).collect()} == {"Ўільяма": True, "ўчора": False, "лес": False, None: False, "": False}


def test_dump_and_grammar(spark, tmp_path):
    dump = """<mediawiki>
  <page><title>Зіма</title><ns>0</ns><revision><text bytes="9" xml:space="preserve">Снег &lt;b&gt;ідзе</text></revision></page>
  <page><title>Лета</title><ns>0</ns><redirect title="Зіма" /><revision><text>x</text></revision></page>
  <page><title>Размовы</title><ns>1</ns><revision><text>y</text></revision></page>
  <page><title>Вясна</title><ns>0</ns><revision><text>z</text></revision></page>
</mediawiki>"""
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(dump.encode()))
    out = tables.wiki_articles(spark, str(tmp_path / "dump.xml.bz2"), spark.createDataFrame([("Вясна",)], "title string"))
    assert [tuple(r) for r in out.collect()] == [("Зіма", "Снег <b>ідзе")]
    (tmp_path / "g.xml").write_text('<Wordlist><Paradigm lemma="до+м" tag="N"><Variant id="a"><Form tag="NS">до+м</Form><Form tag="GS">до+ма</Form></Variant></Paradigm></Wordlist>', encoding="utf-8")
    assert sorted(tuple(r) for r in tables.paradigms(spark, str(tmp_path / "g.xml")).collect()) == [("до+м", "N", "до+м", "NS"), ("до+м", "N", "до+ма", "GS")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("rule", 'a"ў', 1, None), ("gold", "b", 2, "x")], "kind string, input string, n int, note string").coalesce(1)
    digest = tables.write_jsonl(rows, str(tmp_path / "cases.jsonl"))
    data = (tmp_path / "cases.jsonl").read_bytes()
    assert digest == hashlib.sha256(data).hexdigest()
    assert [json.loads(x) for x in data.decode().splitlines()] == [{"kind": "rule", "input": 'a"ў', "n": 1}, {"kind": "gold", "input": "b", "n": 2, "note": "x"}]
    assert tables.case_manifest(rows, 3, "1.0", digest)["cases_by_kind"] == {"gold": 1, "rule": 1}
    tables.write_report(rows, ["kind", "n", "note"], str(tmp_path / "r.tsv"), ("# h",))
    assert (tmp_path / "r.tsv").read_text(encoding="utf-8") == "# h\nrule\t1\t\ngold\t2\tx\n"
    with pytest.raises(ValueError, match="more than 1"):
        tables.write_report(rows, ["kind"], str(tmp_path / "r.tsv"), (), most=1)
    tables.write_metrics(spark.createDataFrame([("a_rate", 0.5), ("b", 2.0)], "name string, value double"), str(tmp_path / "m.json"))
    assert {tuple(r) for r in tables.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {("a_rate", 0.5), ("b", 2.0)}


def test_digests_and_compiled_lexicon(spark, tmp_path):
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "a.tsv"
    prints = []
    for text in ("# a\nснег\tсьнег\nплан\tплян\n", "# b\nснег\tсьнег\nплан\tплян\n", "план\tплян\nснег\tсьнег\n"):
        file.write_text(text, encoding="utf-8")
        prints.append(tables.fingerprint(tables.lines(spark, str(file))))
    assert prints[0] == prints[1] != prints[2] and len(prints[0]) == 16
    before = tables.content_digest(spark, str(tmp_path / "in"))
    file.write_bytes("план\tплян\r\nснег\tсьнег\r\n".encode())
    assert tables.content_digest(spark, str(tmp_path / "in")) == before
    tables.save_lexicon(tables.pairs(tables.lines(spark, str(file))), str(tmp_path / "lexicon"), before)
    assert tables.load_lexicon(spark, str(tmp_path / "lexicon"), before).count() == 2
    with pytest.raises(ValueError, match="other files"):
        tables.load_lexicon(spark, str(tmp_path / "lexicon"), "0" * 64)


def test_splits_samples_and_records(spark):
    titles = [f"Артыкул {i}" for i in range(200)]
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in titles], "t string").withColumn("s", cd.split_of(F.col("t"))).collect()}
    for t in titles:
        at = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") / 2**64
        assert got[t] == ("train" if at < 0.6 else "dev" if at < 0.8 else "test")
    rows = spark.range(103).repartition(7)
    for n in (1, 7, 50, 102, 103, 500):
        exact = list(range(103)) if n >= 103 else [i * 103 // n for i in range(n)]
        assert sorted(r.id for r in cd.spread(rows, n, "id").collect()) == exact
    a, b = ([r.id for r in cd.seeded_sample(rows.repartition(k), 9, 4, "id").collect()] for k in (2, 5))
    assert a == b and len(set(a)) == 9
    m = lambda rows: spark.createDataFrame(rows, "name string, value double")
    assert {r.name: r.value for r in cd.raised(m([("x_rate", 0.2), ("y_recall", 0.5), ("z", 3.0)]), m([("x_rate", 0.3), ("y_recall", 0.6), ("new", 1.0)])).collect()} == {"x_rate": 0.2, "y_recall": 0.6, "z": 3.0, "new": 1.0}


def test_failure_groups(spark):
    rows = [("rule", "r1", "lexicon", None, "a", "b", "c", "s"), ("rule", "r1", "lexicon", None, "d", "e", "f", "s"), ("none", None, "rule", "r2", "g", "h", "i", "s")]
    out = tables.failure_rows(spark.createDataFrame(rows, "there_method string, there_rule string, back_method string, back_rule string, source string, there string, back string, sentence string"))
    assert {(r.group, r.n) for r in out.collect()} == {("rule:r1 | lexicon", 2), ("none | rule:r2", 1)}
