"""Language identification by a byte convolutional network, trained and applied in numpy.

A lower-cased text is cut into windows of a fixed number of UTF-8 bytes. Each
byte has a vector; filters of several widths slide over the window, a filter's
largest response is its feature, and a softmax over the features gives a
window's probabilities. A text's probabilities are the normalised exponentials
of its windows' mean log-probabilities, weighted by their lengths in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import sliced, sparing


UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """The bounds of the training sample, and the network's shape.

    sample_per_language: expected number of training documents of each language
    (all, where there are fewer); sample_documents: of all languages, which with
    many of them lowers that of each; sample_windows: of each document;
    most_languages: the most frequent ones are learned, others never predicted.
    """

    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 16
    sample_per_language: int = 600
    sample_documents: int = 20_000
    sample_windows: int = 6
    most_languages: int = 1000
    epochs: int = 8
    batch: int = 64
    rate: float = 0.003
    seed: int = 7


def windows(text: str, size: int) -> np.ndarray:
    """Bytes of the lower-cased text in rows of size, the last one filled with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    rows = -(-len(data) // size)
    out = np.zeros(rows * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, size)


@dataclass
class ByteConvNet:
    """Filters of every width are columns of one matrix over the longest width; shorter ones have zeros at its end."""

    settings: Settings
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        n = s.filters * len(s.widths)
        kernel = rng.normal(0, 0.3, (max(s.widths), s.embedding, n)).astype(np.float32) * self._mask()
        self.weights = {
            "bytes": rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32),
            "kernel": kernel,
            "shift": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.1, (n, len(self.languages))).astype(np.float32),
            "bias": np.zeros(len(self.languages), np.float32),
        }
        self.weights["bytes"][0] = 0

    def _mask(self) -> np.ndarray:
        s = self.settings
        mask = np.zeros((max(s.widths), 1, s.filters * len(s.widths)), np.float32)
        for k, width in enumerate(s.widths):
            mask[:width, :, k * s.filters : (k + 1) * s.filters] = 1
        return mask

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(rows, positions, longest width * embedding): what the filters see at each position."""
        deep = self.weights["bytes"][np.pad(x, ((0, 0), (0, max(self.settings.widths) - 1)))]
        seen = np.lib.stride_tricks.sliding_window_view(deep, max(self.settings.widths), axis=1)
        return np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(len(x), x.shape[1], -1)

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        seen = self._columns(x)
        response = seen @ w["kernel"].reshape(-1, w["kernel"].shape[2])
        return seen, response

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        best = self._features(x)[1].max(1) + w["shift"]
        scores = np.maximum(best, 0) @ w["out"] + w["bias"]
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on cross-entropy with classes weighted alike; only the largest response of a filter has a gradient."""
        s, w, rng = self.settings, self.weights, np.random.default_rng(self.settings.seed + 1)
        mask, width = self._mask(), max(s.widths)
        weight = 1 / np.maximum(1, np.bincount(y, minlength=len(self.languages)))
        weight = (weight * len(y) / max(1, np.count_nonzero(np.bincount(y, minlength=len(self.languages))))).astype(np.float32)
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                rows = order[at : at + s.batch]
                xb, yb = x[rows], y[rows]
                seen, response = self._features(xb)
                where = response.argmax(1)
                best = np.take_along_axis(response, where[:, None, :], 1)[:, 0] + w["shift"]
                feature = np.maximum(best, 0)
                scores = feature @ w["out"] + w["bias"]
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= (weight[yb] / len(yb))[:, None]
                back = (p @ w["out"].T) * (best > 0)
                chosen = np.take_along_axis(seen, where[:, :, None], 1)  # rows, filters, inputs
                kernel = np.einsum("rf,rfi->if", back, chosen).reshape(w["kernel"].shape) * mask
                inputs = np.einsum("rf,if->rfi", back, w["kernel"].reshape(-1, w["kernel"].shape[2])).reshape(*back.shape, width, s.embedding)
                padded = np.pad(xb, ((0, 0), (0, width - 1)))
                spots = padded[np.arange(len(xb))[:, None, None], where[:, :, None] + np.arange(width)]
                table = np.zeros_like(w["bytes"])
                np.add.at(table, spots.ravel(), inputs.reshape(-1, s.embedding))
                table[0] = 0
                gradient = {"bytes": table, "kernel": kernel, "shift": back.sum(0), "out": feature.T @ p, "bias": p.sum(0)}
                step += 1
                for k, g in gradient.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w[k] -= (s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None], chunk: int = 128) -> list[tuple[str, float]]:
        """(language, score) of each whole text."""
        s = self.settings
        total = np.zeros((len(texts), len(self.languages)))
        length = np.zeros(len(texts))
        rows, owners, sizes = [], [], []

        def run() -> None:
            x = np.concatenate(rows)
            size = np.concatenate(sizes)
            got = self.log_probabilities(x) * size[:, None]
            np.add.at(total, np.array(owners), got)
            np.add.at(length, np.array(owners), size)
            rows.clear(), owners.clear(), sizes.clear()

        known = [text is not None and any(map(str.isalpha, text)) for text in texts]
        held = 0
        for k, text in enumerate(texts):
            if not known[k] or not self.languages:
                continue
            for at in range(0, len(text), s.window * chunk):
                x = windows(text[at : at + s.window * chunk], s.window)
                for part in range(0, len(x), chunk):
                    y = x[part : part + chunk]
                    rows.append(y)
                    owners += [k] * len(y)
                    sizes.append((y != 0).sum(1).clip(1))
                    held += len(y)
                    if held >= chunk:
                        run()
                        held = 0
        if rows:
            run()
        out = []
        for k in range(len(texts)):
            if not length[k]:
                out.append((UNKNOWN, 0.0))
                continue
            mean = total[k] / length[k]
            p = np.exp(mean - mean.max())
            best = int(p.argmax())
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """Whether the id's checksum puts it in the fold that training never sees; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Settings = Settings()) -> ByteConvNet:
    """Fit a network on a bounded sample of the labelled rows that are not held out.

    The sample is drawn by a hash of id and text at a rate that gives each
    language ``sample_per_language`` documents on average, and of a document up
    to ``sample_windows`` windows at even distances. The driver gets these
    windows only. Of more than ``most_languages`` labels, the most frequent ones
    (of equal ones the first) are learned.
    """
    s = settings
    fit = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(~held_out("id") & F.col("label").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(s.most_languages).collect()}
    languages = sorted(counts)
    net = ByteConvNet(s, languages)
    if len(languages) < 2:
        return net
    per = max(1, min(s.sample_per_language, s.sample_documents // len(languages)))
    draw = F.pmod(F.xxhash64("id", F.col("text")), F.lit(1 << 30))
    rate = F.lit(0)
    for k, n in counts.items():
        rate = F.when(F.col("label") == k, F.lit(int(min(1.0, per / n) * (1 << 30)))).otherwise(rate)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            label, data = [], []
            for k, text in enumerate(batch.column(1)):
                value = text.as_py()
                starts = np.unique(np.linspace(0, max(0, len(value) - s.window), s.sample_windows).astype(int))
                for at in starts.tolist():
                    label.append(batch.column(0)[k])
                    data.append(windows(value[at : at + s.window], s.window)[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in label], pa.string()), pa.array(data, pa.binary())], names=["label", "data"])

    rows = fit.filter(draw < rate).select("label", "text").mapInArrow(sparing(take), "label string, data binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["data"])))
    if rows:
        at = {k: i for i, k in enumerate(languages)}
        net.fit(np.stack([np.frombuffer(bytes(r["data"]), np.uint8) for r in rows]), np.array([at[r["label"]] for r in rows]))
    return net


def predict(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), a row for each row of docs; only texts go to the network."""
    weights, languages, settings = net.weights, net.languages, net.settings
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteConvNet(settings, languages, weights)
        for part in sliced(batches):
            got = own.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sparing(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Train on docs and predict each row: (id_col, held_out, lang_pred, score).

    A null text, and one without a letter, is ``und`` with score 0; so is every
    text if no row is labelled. With one label only, that is predicted. A null id
    is held out. Ids may repeat. An empty table gives an empty result. Other
    columns are not read.
    """
    net = train(docs, id_col, text_col, label_col, settings)
    return predict(docs, net, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
