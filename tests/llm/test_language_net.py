"""The byte network against plain loops: its forward pass, its training steps, and the whole query's predictions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import language_id
from wordloom.llm.language_id import ByteConvNet, Settings, held_out, predict, train, windows

SMALL = Settings(window=48, embedding=3, widths=(2, 3), filters=2, epochs=2, batch=16)


def loop_scores(net, row):
    """Log-probabilities of one window, number by number."""
    s, w = net.settings, net.weights
    features = []
    for k, width in enumerate(s.widths):
        for f in range(k * s.filters, (k + 1) * s.filters):
            best = -math.inf
            for p in range(len(row)):
                seen = 0.0
                for j in range(width):
                    byte = int(row[p + j]) if p + j < len(row) else 0
                    for e in range(s.embedding):
                        seen += float(w["bytes"][byte, e]) * float(w["kernel"][j, e, f])
                best = max(best, seen)
            features.append(max(0.0, best + float(w["shift"][f])))
    scores = [float(w["bias"][c]) + sum(x * float(w["out"][f, c]) for f, x in enumerate(features)) for c in range(len(net.languages))]
    top = max(scores)
    whole = math.log(sum(math.exp(x - top) for x in scores)) + top
    return [x - whole for x in scores]


def loop_predict(net, text):
    """(language, probability) of a whole text, window by window."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    total, length, stride = [0.0] * len(net.languages), 0, net.settings.window * 128
    for at in range(0, len(text), stride):
        for row in windows(text[at : at + stride], net.settings.window):
            size = max(1, sum(int(b) != 0 for b in row))
            length += size
            total = [t + size * x for t, x in zip(total, loop_scores(net, row))]
    odds = [math.exp(t / length - max(total) / length) for t in total]
    best = odds.index(max(odds))
    return net.languages[best], odds[best] / sum(odds)


def random_net(seed):
    net = ByteConvNet(SMALL, ["aa", "bb", "cc"])
    rng = np.random.default_rng(seed)
    for name, value in net.weights.items():
        mask = net._mask() if name == "kernel" else 1
        net.weights[name] = (rng.normal(0, 0.6, value.shape) * mask).astype(np.float32)
    net.weights["bytes"][0] = 0
    return net


def test_forward_pass_equals_loops():
    net = random_net(3)
    texts = ["snow and light", "ж" * 40, "a", "The quick brown fox jumps over the lazy dog, again and again."]
    rows = np.concatenate([windows(t, SMALL.window) for t in texts])
    want = np.array([loop_scores(net, row) for row in rows])
    assert np.abs(net.log_probabilities(rows) - want).max() < 1e-4


def loss(net, x, y):
    """Cross-entropy with classes weighted alike."""
    counts = np.bincount(y, minlength=len(net.languages))
    weight = len(y) / np.count_nonzero(counts) / np.maximum(1, counts)
    return float(-(weight[y] * net.log_probabilities(x)[np.arange(len(y)), y]).sum() / len(y))


def test_a_training_step_follows_the_numeric_gradient():
    """The first step of this descent moves every weight by the rate against the sign of its gradient."""
    rng = np.random.default_rng(5)
    x = rng.integers(97, 105, (9, SMALL.window)).astype(np.uint8)
    x[0, 30:] = 0
    y = np.array([0, 1, 2, 0, 0, 0, 1, 2, 0])
    net = random_net(7)
    net.settings = Settings(**{**SMALL.__dict__, "epochs": 1, "batch": len(x)})
    start = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.fit(x, y)
    moved = {k: net.weights[k] - start[k] for k in start}
    probe, tried = ByteConvNet(net.settings, net.languages, {k: v.copy() for k, v in start.items()}), 0
    mask = np.broadcast_to(net._mask(), start["kernel"].shape)
    for name, value in start.items():
        for place in np.ndindex(value.shape):
            if name == "bytes" and not 97 <= place[0] < 105 or name == "kernel" and not mask[place]:
                assert moved[name][place] == 0
                continue
            ends = []
            for side in (1e-5, -1e-5):
                probe.weights[name][place] = value[place] + side
                ends.append(loss(probe, x, y))
            probe.weights[name][place] = value[place]
            slope = (ends[0] - ends[1]) / 2e-5
            if abs(slope) > 1e-4:
                tried += 1
                assert abs(moved[name][place] + net.settings.rate * np.sign(slope)) < 1e-5, (name, place, slope)
    assert tried > 40


def test_predictions_equal_loops(spark):
    r = random.Random(2)
    sounds = {"aa": ["ka", "ma", "to"], "bb": ["ßu", "zö", "ér"], "cc": ["xy", "qu", "wz"]}
    make = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=3)) for _ in range(n))
    rows = [(k, make(lang, r.randint(1, 25)), lang) for k in range(120) for lang in [r.choice([*sounds])]]
    # Longer than the part of a text that is cut into windows at a time.
    rows += [(500, make("bb", 1200), None), (501, None, "aa"), (502, "12 3", "aa"), (503, "", "bb"), (504, "K", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = train(docs, settings=SMALL)
    got = {x.doc_id: (x.lang_pred, x.score) for x in predict(docs, net).collect()}
    for key, text, _ in rows:
        language, score = loop_predict(net, text)
        assert got[key][0] == language and abs(got[key][1] - score) < 1e-4, key
    # The query's rows are those of its network.
    assert {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, settings=SMALL).collect()} == got
    out = docs.select("doc_id", held_out("doc_id").alias("out")).filter(F.col("out")).collect()
    # Labels of the fold that is held out teach nothing.
    blind = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert out and {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(blind, settings=SMALL).collect()} == got
