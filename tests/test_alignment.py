"""Edits, alternations, shapes and images as Columns, against difflib's own opcodes."""

import difflib
import random

from pyspark.sql import functions as F

from wordloom.operators.alignment import edits, matching_blocks, prefix_image, with_differences
from wordloom.operators.mining import common_shapes


def test_edits_are_the_gaps_between_blocks(spark):
    r = random.Random(2)
    pairs = [("", ""), ("", "аб"), ("аб", ""), ("план", "плян"), ("філасофія", "філязофія")]
    pairs += [("".join(r.choices("алеэіыь", k=r.randint(0, 7))), "".join(r.choices("алеэіыь", k=r.randint(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame([(a, b, k) for a, b in pairs for k in range(len(a) + 1)], "a string, b string, k int").withColumn("blocks", matching_blocks("a", "b"))
    found = df.select("a", "b", "k", edits(F.col("a"), F.col("b"), F.col("blocks")).alias("e"), prefix_image(F.col("blocks"), F.col("b"), F.col("k")).alias("image"))
    for row in found.collect():
        a, b, k = row["a"], row["b"], row["k"]
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert [tuple(e) for e in row["e"]] == [(i, a[i:j], b[m:n]) for kind, i, j, m, n in ops if kind != "equal"], (a, b)
        # The stretches that end by k, and the one that k lies in.
        end = max([n for _, i, j, m, n in ops if j <= k] + [m + k - i if kind == "equal" else n for kind, i, j, m, n in ops if i < k < j], default=0)
        assert row["image"] == b[:end], (a, b, k)


def test_codes_and_shapes(spark):
    known = {
        ("план", "плян"): ("l", "а→я"), ("альфа", "алфа"): ("l", "ь→∅"), ("снег", "сьнег"): ("soft", "∅→ь"), ("сіла", "сыла"): ("i", "і→ы"), ("сервіс", "сэрвіс"): ("e", "е→э"),
        ("ганак", "ґанак"): ("g", "г→ґ"), ("еўра", "эўра"): ("eu", "е→э"), ("філасофія", "філязофія"): ("l,other", "ас→яз"), ("дом", "дым"): ("other", "о→ы"), ("лес", "лес"): ("", ""), ("ґа", ""): ("g", "ґа→∅"), ("ам", "ямка"): ("other", "ам→ямка"),
    }
    rows = [(a.title(), b.upper()) for a, b in known] + [(None, "а"), ("а", None), *known]
    out = {(r["source"], r["expected"]): r for r in with_differences(spark.createDataFrame(rows, "source string, expected string")).collect()}
    assert set(out) == set(known)
    for pair, (codes, text) in known.items():
        assert out[pair]["codes"] == codes, pair
        if pair != ("ам", "ямка"):
            assert out[pair]["shape"] == text, pair
    assert out["снег", "сьнег"]["similarity"] == 1.0 and out["дом", "дым"]["similarity"] == 2 * 2 / 6
    misses = with_differences(spark.createDataFrame([("дом", "дым"), ("кот", "кыт"), ("сон", "сын"), ("рак", "рык")], "source string, expected string"))
    assert [tuple(r) for r in common_shapes(misses, 1).collect()] == [("о→ы", 3)]
