"""The pipeline's stages, each on what the one before kept."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_large_operators import brute_classes, brute_quality, brute_targets
from tokenizers import Tokenizer

import corpus_pipeline
from wordloom.llm import jaccard, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = [f"word{k}" for k in range(800)]
    rows = []
    for k in range(240):
        text = " ".join(r.choices(vocabulary, k=r.randint(25, 120)))
        if k % 10 == 3:
            text = rows[-1][1]
        if k % 10 == 5:
            text = "junk again " * 40
        if k % 10 == 7:
            text += ' token = "0123456789abcdef0123"'
        rows.append((k, text, r.choice(["en", None]), r.choice(["a", "b", None]), len(text)))
    rows += [(1000, None, "en", "a", None), (1001, "", "en", "a", 0), rows[0], (None, rows[1][1], "en", "b", len(rows[1][1]))]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 5), 0) for k in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality rules":
            kept = {r.doc_id for r in quality.quality_rules(docs, labels).filter("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept and 5 not in kept and 1000 not in kept
        if name == "near duplicates":
            classes = {r.doc_id: r.component_id for r in jaccard.classes(docs).collect() if r.doc_id is not None}
            ids = [r.doc_id for r in out.collect()]
            assert sorted(x for x in ids if x is not None) == sorted({c for c in classes.values()})
        if name == "secret scan":
            assert out.count() == docs.count()
            assert out.filter(F.col("text").contains("0123456789abcdef")).count() == 0
            assert out.filter("length(text) <> n_chars").count() == 0
        if name == "source mix":
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        if name != "packing":
            assert out.columns == columns
        docs = out
    assert docs.count() > 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_small_languages_lose_their_junk(spark, tmp_path):
    """Some hundred labels are enough for cutoffs; a rule that many good texts break doesn't keep the others from theirs."""
    r = random.Random(13)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(2000)]

    def text(end, upper=False):
        words = " ".join(w + end for w in r.choices(vocabulary, k=40))
        return words.upper() if upper else words

    rows = []
    for lang, n in (("small", 420), ("few", 120), ("capitals", 1800)):
        for k in range(n):
            good = k % 6 > 0
            rows.append((len(rows), text("" if good else "##", lang == "capitals"), lang, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    table.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table.select("doc_id", "text", "lang")
    kept = {x.doc_id for x in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    # Hundred good labels can't bound 2 % of the good documents, so nothing may leave there.
    assert kept == {k for k, _, lang, good in rows if good or lang == "few"}
    scored = quality.features(docs, keep=["doc_id"])
    cuts = {c.stratum: c for c in quality.calibrate_together(scored, table.select("doc_id", "quality")).collect()}
    assert {lang: c.n_good for lang, c in cuts.items()} == {"small": 350, "few": 100, "capitals": 1500}
    assert [cuts["small"][f"{rule}_cutoff"] for rule in quality.GRIDS] == [grid[-1] for grid in quality.GRIDS.values()]
    assert [cuts["few"][f"{rule}_cutoff"] for rule in quality.GRIDS] == [None] * 4
    assert cuts["capitals"].upper_share_cutoff is None and cuts["capitals"].symbol_share_cutoff == 0.02


def pairs(rows):
    return Counter((x.doc_id, x.text) for x in rows)


def check_quality(given, out, labelled_good):
    # So few labels can't show that at most 2 % of the good documents go, hence no cutoffs.
    assert 0.98 ** len(labelled_good) > 0.05
    want = [x for x in given for n in [brute_quality(x.text)] if n[0] >= 20 and 100 * n[4] <= 30 * n[0]]
    assert pairs(out) == pairs(want)


def check_near_duplicates(given, out):
    found = brute_classes([(x.doc_id, x.text) for x in {x.doc_id: x for x in given if x.doc_id is not None}.values()])
    heads = {x.doc_id: x for x in given if x.doc_id is not None and found[x.doc_id][1] == x.doc_id}
    assert pairs(out) == pairs([*heads.values(), *(x for x in given if x.doc_id is None)])


def check_secrets(given, out):
    want = [(x.doc_id, (x.text or "").replace('token = "0123456789abcdef0123', "[SECRET]")) for x in given]
    assert pairs(out) == Counter(want) and all(x.n_chars == len(x.text) for x in out)


def check_mix(given, out):
    size = lambda x: len(x.text.split())
    names = sorted({x.source for x in given}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(x) for x in given if x.source == name) for name in names]
    assert {(x.doc_id, x.text, x.source) for x in out} <= {(x.doc_id, x.text, x.source) for x in given}
    copies, largest = pairs(out), max(map(size, given))
    for name, n, target in zip(names, sizes, brute_targets(sizes, mixing.Recipe()), strict=True):
        assert abs(sum(size(x) for x in out if x.source == name) - target) <= largest
        whole = int(target / n + 1e-9)
        for x in given:
            if x.source == name:
                assert whole <= copies[x.doc_id, x.text] <= (whole + 1 if target > whole * n + 1e-6 else whole)


def check_packing(given, out):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    copies, texts = Counter(x.doc_id for x in given), {x.doc_id: x.text for x in given}
    assert {x.doc_id for x in out} == set(copies)
    for key, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = [x for x in out if x.doc_id == key]
        pieces = Counter((x.start, x.length) for x in mine)
        assert set(pieces.values()) == {copies[key]}
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] == len(ids)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) and x.doc_tokens == len(ids) for x in mine)


def test_stages_against_plain_python(spark, folder, tmp_path):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    checks = {
        "quality rules": lambda given, out: check_quality(given, out, labels.filter("quality = 1").collect()),
        "near duplicates": check_near_duplicates,
        "secret scan": check_secrets,
        "source mix": check_mix,
        "packing": check_packing,
    }
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        given, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        out = docs.collect()
        checks[name](given, out)
        lost = next(x for x in out if name != "source mix" or x.source == "a")
        with pytest.raises(AssertionError):
            checks[name](given, [x for x in out if x is not lost])


def test_stages_take_any_further_columns(spark, folder, tmp_path):
    """Columns with the names that stages work with, null in every column, and empty tables."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("_id", F.lit(1))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("_id", "_digest", "_out", "_place", "_words", "_lines", "_upper", "_kept", "_none", "_hash", "_size", "id", "stratum", "slots"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = docs.unionByName(docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 0
