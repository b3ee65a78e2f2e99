"""Runs of repeated words in texts: masking by repeated k-grams, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q (words q apart are equal), of
at least max(6, 4 q) words, that neither neighbour extends. Two copies of it, q
words apart, overlap in at least min over q of (max(6, 4 q) - q) = 5 words, and
each of its words lies in a stretch of 5 words that occurs once more, q words
before or after, inside the run. So words outside all 5-grams that the document
repeats can't be in a run, and a run never reaches over one: only segments of
neighbouring words inside repeated 5-grams are searched.

A segment is searched as Main and Lorentz do: a run either lies in one half or
crosses the middle, and in the latter case has two of its periods on one side of
it, so that the words beside the middle are a square there. All squares that
begin or end at the middle are found at once by running hashes, checked word by
word, and extended to both sides. Of squares with different smallest periods
there are few at one place, the others are skipped. Halving stops at blocks of
``LEAF`` words, whose runs all have periods up to ``LEAF / 4``: these are found
for the whole segment by comparing it with itself, shifted by each such period.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import sliced, sparing, unused

#: Words of a block that isn't halved further.
LEAF = 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Least:
    """A run has at least ``words`` words and ``periods`` periods."""

    words: int = 6
    periods: int = 4

    def length(self, q: int) -> int:
        return max(self.words, self.periods * q)

    @property
    def overlap(self) -> int:
        """The smallest overlap of a run and itself, one period later."""
        return min(self.length(q) - q for q in range(1, self.words + 1))


def _powers(n: int) -> np.ndarray:
    """FACTOR to the powers 0 to n, modulo 2^64."""
    found = np.full(n + 1, FACTOR, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def survivors(x: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words inside k-grams that x has twice or more; x: word numbers."""
    n = len(x) - k + 1
    if n < 2:
        return []
    grams = np.zeros(n, np.uint64)
    mixed = (x.astype(np.uint64) + np.uint64(1)) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    for j in range(k):
        grams = grams * FACTOR + mixed[j : j + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    # Different k-grams of one hash survive too: that costs a look, not a result.
    again = np.zeros(n + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.diff(again.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + k - 1
    # Stretches whose k-grams touch or overlap are one.
    apart = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.r_[0, apart + 1]].tolist(), ends[np.r_[apart, len(ends) - 1]].tolist(), strict=True))


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries are equal, looked at in growing parts."""
    n, at, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, step * 4
    return n


def _squares(x: np.ndarray, sums: np.ndarray, powers: np.ndarray, lo: int, hi: int) -> Iterator[int]:
    """Smallest periods of the squares that begin at lo and end by hi, ascending."""
    most = (hi - lo) // 2
    q = np.arange(1, most + 1)
    first, both = sums[lo + q] - sums[lo], sums[lo + 2 * q] - sums[lo + q]
    candidates = q[both == first * powers[q]]
    at = 0
    while at < len(candidates):
        p = int(candidates[at])
        if np.array_equal(x[lo : lo + p], x[lo + p : lo + 2 * p]):
            yield p
            # Squares that the same period goes on through have a multiple of it.
            through = p + _agreement(x[lo:hi], x[lo + p : hi])
            at = max(at + 1, int(np.searchsorted(candidates, through // 2, "right")))
        else:
            at += 1


def runs_of(x: np.ndarray, least: Least) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x, a segment, by start and then period."""
    n = len(x)
    smallest: dict[tuple[int, int], int] = {}

    def met(start: int, end: int, q: int) -> None:
        if end - start >= least.length(q):
            smallest[start, end] = min(q, smallest.get((start, end), q))

    for q in range(1, min(LEAF, n) // least.periods + 1):
        equal = np.diff((x[:-q] == x[q:]).astype(np.int8), prepend=0, append=0)
        for start, end in zip(np.flatnonzero(equal == 1).tolist(), np.flatnonzero(equal == -1).tolist(), strict=True):
            met(start, end + q, q)
    if n > LEAF:
        powers = _powers(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        back = x[::-1].copy()
        back_sums = np.concatenate([[np.uint64(0)], np.cumsum((back.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        open_ = [(0, n)]
        while open_:
            lo, hi = open_.pop()
            if hi - lo <= LEAF:
                continue
            mid = (lo + hi) // 2
            open_ += [(lo, mid), (mid, hi)]
            periods = {*_squares(x, sums, powers, mid, hi), *_squares(back, back_sums, powers, n - mid, n - lo)}
            for q in periods:
                for start, end in _across(x, back, lo, mid, hi, q):
                    if (start > lo or lo == 0 or x[lo - 1] != x[lo - 1 + q]) and (end < hi or hi == n or x[hi] != x[hi - q]):
                        met(start, end, q)
    return sorted((start, end - start, q) for (start, end), q in smallest.items())


def _across(x: np.ndarray, back: np.ndarray, lo: int, mid: int, hi: int, q: int) -> Iterator[tuple[int, int]]:
    """The stretches of period q in lo to hi with two periods right, or left, of mid; back: x reversed."""
    n = len(x)
    right = q + _agreement(x[mid : hi - q], x[mid + q : hi]) if mid + q <= hi else 0
    if right >= 2 * q:
        yield mid - _agreement(back[n - mid : n - lo], back[n - mid - q : n - lo - q]), mid + right
    left = q + _agreement(back[n - mid : n - lo - q], back[n - mid + q : n - lo]) if mid - q >= lo else 0
    if left >= 2 * q:
        yield mid - left, mid + _agreement(x[mid:hi], x[mid - q : hi - q])


def runs_of_words(words: list[bytes], least: Least) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and then period."""
    numbers: dict[bytes, int] = {}
    x = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return []
    return [(start + s, length, q) for start, end in survivors(x, least.overlap) for s, length, q in runs_of(x[start:end], least)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: Least = Least()) -> DataFrame:
    """(id_col, n_words, runs, collapsed), a row for each row of docs; other columns are not read.

    runs: array of (start, length, period) by start and then period, in words
    from 0; collapsed: the words that no run contains after its first period,
    joined by one space. A null text has no words: no runs, and an empty
    collapsed text, like an empty one. Ids may be null or repeat. A text of any
    length is searched whole, in the memory of one task: some 100 bytes a word.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            counts, found, texts = [], [], []
            for text in b.column("text"):
                words = (text.as_py() or "").encode().split()
                runs = runs_of_words(words, least)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            columns = [b.column("id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(sparing(search), f"id {given.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equal ones the first by start and period. Null without runs."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id_col, text_col), where every tenth document by checksum of its id has a tail that repeats itself.

    With h the checksum, g = h / 10 and n words, the words from a = g % n on
    become those of a stretch of 1 + (n - a) / (3 + g % 8) words from a, again and again.
    """
    names = [id_col, text_col]
    h, g, n, a, p, w = (unused(f"_{x}", names) for x in ("h", "g", "n", "a", "p", "w"))
    blanks = "[\\x20\\x09-\\x0D]+"
    docs = docs.select(*names, F.crc32(F.col(id_col).cast("string").cast("binary")).alias(h))
    docs = docs.withColumn(w, F.when(F.col(h) % 10 == 0, F.array_remove(F.split(text_col, blanks), ""))).withColumn(n, F.size(w)).withColumn(g, F.floor(F.col(h) / 10))
    docs = docs.withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n))).withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8)))
    tail = F.transform(w, lambda x, i: F.when(i >= F.col(a), F.get(w, (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))).otherwise(x))
    return docs.select(id_col, F.when(F.col(n) > 0, F.array_join(tail, " ")).otherwise(F.col(text_col)).alias(text_col))
