"""Periodic runs, shards and hard negatives against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import hard_negatives, periodic_runs, sharding
from wordloom.llm.periodic_runs import Least, find_runs, longest, planted, runs_of_words, survivors


def brute_runs(x):
    """All runs, by comparing every pair of words up to a quarter of the text apart."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(r):
    words = []
    for _ in range(r.randint(0, 6)):
        if r.random() < 0.3:
            words += [r.randint(0, r.choice([1, 2, 5, 1000])) for _ in range(r.randint(0, 40))]
        else:
            q = r.choice([1, 2, 3, 5, 8, 16, 17, 20, 33, 70])
            words += ([r.randint(0, r.choice([1, 2, 3, 50])) for _ in range(q)] * 10)[: int(q * r.uniform(2, 9))]
            if words and r.random() < 0.3:
                words[r.randrange(len(words))] = 7
    return [str(w).encode() for w in words]


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        words = repetitive(r)
        assert runs_of_words(words, Least()) == brute_runs(words), words


def test_runs_lie_in_survivors():
    """Every word of a run is inside a repeated 5-gram, and words of no repeated one are masked."""
    assert Least().overlap == 5
    r = random.Random(4)
    for _ in range(300):
        words = repetitive(r)
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        kept = survivors(np.array([numbers[w] for w in words], np.int64), 5)
        assert all(any(s <= start and start + n <= e for s, e in kept) for start, n, _ in brute_runs(words))
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
        assert {i for s, e in kept for i in range(s, e)} == inside


def test_runs_of_long_texts():
    x = [b"%d" % (i % 30_000) for i in range(150_000)]
    assert runs_of_words(x, Least()) == [(0, 150_000, 30_000)]
    assert runs_of_words([b"a"] * 300_000, Least()) == [(0, 300_000, 1)]


def test_find_runs_of_any_rows(spark):
    rows = [(1, "a b " * 5 + "c"), (1, "a b " * 5 + "c"), (None, "x\x1cy \x0bx\x1cy x\x1cy\tx\x1cy\nx\x1cy x\x1cy"), (3, None), (4, ""), (5, " \n"), (6, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("ID", F.lit("clash"))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in find_runs(df).collect()]
    wanted = [(1, 11, [(0, 10, 2)], "a b c")] * 2 + [(None, 6, [(0, 6, 1)], "x\x1cy"), (3, 0, [], ""), (4, 0, [], ""), (5, 0, [], ""), (6, 100_000, [(0, 100_000, 1)], "word")]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert find_runs(df.limit(0)).count() == 0


def test_planted_tails(spark):
    r = random.Random(8)
    rows = [(k, " ".join(r.choices("abcdefgh", k=r.randint(0, 60)))) for k in range(300)] + [(7, None), (None, "a b"), (11, "")]
    out = {}
    for row in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[row["doc_id"]] = row["text"]
    for k, text in rows[:300]:
        if k in (7, 11):
            continue
        h, w = zlib.crc32(str(k).encode()), text.split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert out[k].split() == w
    best = spark.sql("SELECT array(struct(0L AS start, 9L AS length, 2L AS period), struct(20L AS start, 18L AS length, 4L AS period), struct(50L AS start, 18L AS length, 4L AS period)) AS runs")
    assert tuple(best.select(longest(F.col("runs")).alias("x")).first()["x"]) == (0, 9, 2)


def brute_capacity(sizes, shards):
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        new = [0] + [math.inf] * len(sizes)
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j, -1, -1):
                new[j] = min(new[j], max(best[i], total))
                if i:
                    total += sizes[i - 1]
        best = new
    return best[-1]


def test_capacity_is_the_smallest(spark):
    r = random.Random(5)
    for trial in range(6):
        n = r.randint(1, 40)
        # Keys that agree in many digits, so that blocks are divided again and again.
        keys = sorted({"abc" * (trial % 2) * 6 + "%032x" % r.getrandbits(128) if k % 2 else "%032x" % r.getrandbits(128) for k in range(n)})
        keys = sorted({k[:32] for k in keys})
        weights = {k: r.choice([1, 2, 5, 30]) for k in keys}
        rows = [(k, 1) for k in keys for _ in range(weights[k])]
        shards = r.randint(1, 8)
        plan = sharding.plan_shards(spark.createDataFrame(rows, "key string, size long"), shards)
        assert plan.capacity == brute_capacity([weights[k] for k in keys], shards)
        of = [sum(c <= k for c in plan.cuts) for k in keys]
        loads = Counter()
        for k, s in zip(keys, of, strict=True):
            loads[s] += weights[k]
        assert max(loads.values()) <= plan.capacity and of == sorted(of) and len(plan.cuts) == shards - 1
        assert list(plan.firsts) == [sum(weights[k] for k, s in zip(keys, of, strict=True) if s < j) for j in range(shards)]


def test_place_keeps_groups_and_slots(spark):
    r = random.Random(6)
    rows = [(k, r.choice(["hot text " * 30, None, "", "ключ \U0001f600"]) if k % 3 == 0 else "text %d " % (k // 2) * r.randint(1, 20)) for k in range(400)]
    rows += [(1, "same"), (1, "same"), (None, "no id"), (None, None), (5000, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("size", "key", "id", "shard", "slot", "law", "_place"):
        df = df.withColumn(name, F.lit("clash"))
    found = sharding.place(df.repartition(5)).collect()
    assert len(found) == len(rows) and {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for row in found:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    placed = sharding.with_shard(df).select("doc_id", "text", "shard_").collect()
    groups = defaultdict(set)
    for row in placed:
        groups[row["text"]].add(row["shard_"])
    assert all(len(x) == 1 for x in groups.values())
    assert Counter(r["shard_"] for r in placed) == Counter(r["shard"] for r in found)


def test_place_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sharding.place(df.limit(0)).count() == 0
    assert {(r["shard"], r["slot"]) for r in sharding.place(df, 8).collect()} == {(0, 0), (1, 0)}
    assert {r["shard"] for r in sharding.place(df, 1).collect()} == {0}


def brute_negatives(rows, asks, window=(30, 90, 100), positives=5, negatives=10):
    usable = []
    for k, label, v in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((k, label, [math.floor(256 * x) for x in v]))
    found = []
    for a in usable:
        if not asks(a[0]):
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=False))  # noqa: B023, E731
        near = sorted((-score(b), b[0]) for b in usable if b[1] == a[1] and b[0] != a[0])[:positives]
        far = sorted((-score(b), b[0]) for b in usable if b[1] != a[1])
        for s, p in near:
            inside = [(-t, n) for t, n in far if window[0] * -s <= window[2] * -t <= window[1] * -s][:negatives]
            found += [(a[0], p, k, n, -s, t) for k, (t, n) in enumerate(inside, 1)]
    return Counter(found)


def vectors(n, dims, clusters, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    return [(k, int(r.integers(0, 4)), (centres[k % clusters] * 0.6 + r.normal(size=dims) * 0.3).tolist()) for k in range(n)]


AS_ROWS = "vec_id long, label int, embedding array<float>"


def as_floats(rows):
    return [(k, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, label, v in rows]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_hard_negatives_equal_brute_force(spark, chunk):
    rows = as_floats(vectors(2500, 8, 6))
    df = spark.createDataFrame(rows, AS_ROWS).repartition(6)
    found = hard_negatives.mine(df, F.col("vec_id") % 400 == 0, chunk=chunk).collect()
    assert Counter(map(tuple, found)) == brute_negatives(rows, lambda k: k % 400 == 0)


def test_hard_negatives_of_any_rows(spark):
    rows = vectors(300, 6, 3, seed=2)
    tied = [(1000 + k, k % 2, [0.5] * 6) for k in range(60)]
    odd = [(100, None, [1.0] * 6), (None, 1, [1.0] * 6), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")] * 6), (304, 1, [float("inf")] * 6), (305, 1, []), (306, 0, [0.9, 0.2]), (307, 0, [0.1] * 9)]
    rows = as_floats(rows + tied + odd + [rows[7]] * 3 + [tied[0]])
    df = spark.createDataFrame(rows, AS_ROWS)
    for name in ("id", "v", "asks", "rank", "score", "slot"):
        df = df.withColumn(name, F.lit("clash"))
    found = hard_negatives.mine(df, (F.col("vec_id") % 50 == 0) | F.col("vec_id").isin(305, 306, 307)).collect()
    assert Counter(map(tuple, found)) == brute_negatives(rows, lambda k: k % 50 == 0 or k in (305, 306, 307))
    assert hard_negatives.mine(df.limit(0), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(df.filter("vec_id = 1"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [3e30])], AS_ROWS), F.lit(True))


def test_brackets_hold_and_leave_rows_out():
    r = np.random.default_rng(1)
    v = np.floor(256 * (r.normal(size=(1, 4)) + r.normal(size=(12, 1, 4)) * 2 + r.normal(size=(12, 50, 4)) * 0.1)).reshape(-1, 4)
    largest = float((v * v).sum(1).max())
    pivots = hard_negatives.choose_pivots(v[::7], largest)
    d, anchors = pivots.of_rows(v), v[:20]
    least, most = hard_negatives.score_brackets(d, d, pivots.of_anchors(anchors), (anchors * anchors).sum(1), largest)
    scores = anchors @ v.T
    assert (least <= scores).all() and (scores <= most).all()
    tenth = np.sort(scores, 1)[:, -10]
    assert (most < tenth[:, None]).mean() > 0.5


def test_periodic_query_runs_its_operator(spark):
    """The operator that the query calls finds what brute force finds in planted texts."""
    r = random.Random(9)
    df = planted(spark.createDataFrame([(k, " ".join(r.choices("abc", k=80))) for k in range(60)], "doc_id long, text string"))
    texts = {row["doc_id"]: (row["text"] or "").split() for row in df.collect()}
    for row in periodic_runs.find_runs(df).collect():
        words = texts[row["doc_id"]]
        runs = brute_runs(words)
        assert [tuple(x) for x in row["runs"]] == runs
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)
