"""Exact similarity join on n-gram sets, as classes of linked documents.

Steps, each exact:

1. Documents with equal sets become one (by a 128-bit fingerprint); the
   smallest id stands for its copies from here on.
2. Documents without a chance leave: of two linked sets, the smallest hashes
   (a prefix a little longer than the prefix filter asks for, so that several
   must be shared) have a known number in common. A document of whose prefix
   fewer n-grams occur in any other prefix has no partner.
3. Among the rest, n-grams are counted; each set is ordered rare first, and of
   this order the prefix that two linked sets must share in part is kept.
4. Documents are first compared with one pivot each, so that groups of near
   copies become classes by as many comparisons as they have members.
5. All pairs that share a prefix n-gram and lie in different classes pass a
   length, a positional and a suffix filter and are verified, once per pair.
   Within an n-gram's list, only those outside its largest class are paired
   with others, so a list of one class costs nothing.

Sets hold 64-bit hashes of n-grams; two n-grams count as equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wordloom.llm.common import discard, freeing_shuffles, settle, sparing, unused
from wordloom.llm.components import connected_components

#: Ids are broadcast up to this number, else joined by shuffle.
BROADCAST_IDS = 500_000
#: Parts of the range of hashes by which the suffix filter compares what is left of two sets.
BINS = 8
_ROWS = 100_000


@dataclass(frozen=True)
class Join:
    """Sets of n words in a row; linked at numerator / denominator of the union or more. key_bits: bits of a hash that step 2 compares."""

    n: int = 5
    numerator: int = 3
    denominator: int = 4
    key_bits: int = 48

    def least_overlap(self, size: int) -> int:
        """With any linked set."""
        return -(-self.numerator * size // self.denominator)

    def extra(self, size: int) -> int:
        return 1 + size // 8

    def long_prefix(self, size: int) -> int:
        return size - self.least_overlap(size) + self.extra(size)

    def needed(self, size: int) -> int:
        """N-grams of the long prefix that must occur in another's: a partner has least_overlap(size) n-grams or more."""
        return self.extra(self.least_overlap(size))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit hash (murmur3), in place of a table of random numbers."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words; of the whole sequence if it has fewer words; none without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    width = min(n, len(h))
    count = len(h) - width + 1
    out = h[:count].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + count]
    if width < n:
        out ^= np.uint64(0xD6E8FEB86659FD93 * width % 2**64)
    return np.unique(_mix(out))


def _each(docs: DataFrame, emit: Callable[[object, np.ndarray], list[tuple]], types: list[pa.DataType], names: list[str], schema: str, n: int) -> DataFrame:
    """Rows that emit gives for the id and set of each of (id, text); columns of tuples: id, then values or arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), n)
                rows.append(emit(key, found))
                held += len(found)
                if len(rows) >= 2000 or held >= 10 * _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.mapInArrow(sparing(run), schema)


def _sizes(docs: DataFrame, join: Join) -> DataFrame:
    """(id, n, f, g): set size and fingerprint of each document."""

    def emit(key, s):
        d = xxhash.xxh3_128_digest(s.tobytes())
        return key, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    return _each(docs, emit, [pa.int64()] * 4, ["id", "n", "f", "g"], "id long, n long, f long, g long", join.n)


def _prefixes(docs: DataFrame, join: Join) -> DataFrame:
    """(h, id): the n-grams of each document's long prefix in the order of hashes, cut to key_bits: n-grams that then look alike only let more documents stay."""
    mask = np.uint64(2**64 - 2 ** (64 - join.key_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), join.n)
                s = s[: join.long_prefix(len(s))] & mask
                keys.append(s.view(np.int64))
                ids.append(np.full(len(s), key, np.int64))
                held += len(s)
                if held >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["h", "id"])
                    keys, ids, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["h", "id"])

    return docs.mapInArrow(sparing(run), "h long, id long")


def _sets(docs: DataFrame, join: Join) -> DataFrame:
    """(id, n, set)."""

    def emit(key, s):
        return key, len(s), s.view(np.int64)

    return _each(docs, emit, [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["id", "n", "set"], "id long, n long, set array<long>", join.n)


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with a settled table of ids, broadcast if that is small."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", how)


def _linked(join: Join, both: Column, n: Column, m: Column) -> Column:
    return both * (join.numerator + join.denominator) >= (n + m) * join.numerator


def verify(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(_linked(join, F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")


def rare_prefixes(sets: DataFrame, join: Join) -> DataFrame:
    """(id, h, n, pos, pivot, suffix): the shared n-grams of each set's rare-first prefix.

    pos: place in the set's order from 1; pivot: the smallest id with the n-gram;
    suffix: how many shared n-grams follow in the set's order, by the part of the
    range of hashes in which they are (those that no other set has come first,
    and can't be common to two).
    """
    grams = sets.select("id", "n", F.explode("set").alias("h"))
    known = grams.groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("pivot")).filter("df > 1")
    shared = grams.join(known, "h")
    order = Window.partitionBy("id").orderBy("df", "h")
    whole, so_far = Window.partitionBy("id"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bits = (BINS - 1).bit_length()
    here = [F.count_if(F.shiftrightunsigned("h", 64 - bits) == b) for b in range(BINS)]
    left = F.array(*[(x.over(whole) - x.over(so_far)).cast("int") for x in here])
    ranked = shared.withColumn("pos", F.row_number().over(order) + F.col("n") - F.count("*").over(whole)).withColumn("suffix", left)
    least = F.expr(f"({join.numerator} * n + {join.denominator - 1}) DIV {join.denominator}")
    return ranked.filter(F.col("pos") <= F.col("n") - least + 1).select("id", "h", "n", "pos", "pivot", "suffix")


def _candidates(prefixes: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) in different classes that share a prefix n-gram and pass the filters, each once."""
    known = prefixes.join(classes.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component", "pivot")
    by_class = known.groupBy("h", "class").agg(F.count("*").alias("k"))
    lists = by_class.groupBy("h").agg(F.count("*").alias("classes"), F.max_by("class", F.struct("k", "class")).alias("largest")).filter("classes > 1").drop("classes")
    mixed = known.join(lists, "h")
    left = mixed.filter("class <> largest").select("h", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("suffix").alias("sx"), F.col("class").alias("cx"))
    right = mixed.select("h", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("suffix").alias("sy"), F.col("class").alias("cy"), "largest")
    once = (F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))
    similar = F.least("nx", "ny") * join.denominator >= F.greatest("nx", "ny") * join.numerator
    # Before a pair's first common n-gram nothing is common, so it leaves room for the overlap in both orders; one such
    # n-gram is in the lists of both, and the join asks it of every row.
    need = F.expr(f"({join.numerator} * (nx + ny) + {join.numerator + join.denominator - 1}) DIV {join.numerator + join.denominator}")
    early = (F.col("nx") - F.col("px") + 1 >= need) & (F.col("ny") - F.col("py") + 1 >= need)
    # Likewise for the suffixes: beside that n-gram only what follows in both can be common, in each part of the hashes.
    room = F.lit(1)
    for b in range(BINS):
        room = room + F.least(F.get("sx", F.lit(b)), F.get("sy", F.lit(b)))
    met = left.join(right, "h").filter((F.col("cx") != F.col("cy")) & once & similar & early & (room >= need))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_a_chance(docs: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """Settled ids of the documents that step 2 leaves."""
    prefixes = _prefixes(docs, join)
    shared = prefixes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    met = prefixes.join(shared.hint("shuffle_hash"), "h", "left_semi").groupBy("id").agg(F.count("*").alias("k"))
    least = f"(({join.numerator} * n + {join.denominator - 1}) DIV {join.denominator})"
    return settle(met.join(sizes, "id").filter(F.expr(f"k >= 1 + {least} DIV 8")).select("id"))


def _first_links(rare: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Settled links of documents to their pivots."""
    pivots = rare.filter("pivot <> id").groupBy("id", "pivot").agg(F.count("*").alias("k")).groupBy("id").agg(F.max_by("pivot", F.struct("k", -F.col("pivot"))).alias("b"))
    return settle(verify(pivots.select(F.col("id").alias("a"), "b"), sets, join))


def _links(docs: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between documents of different sets that give their classes; sizes: (id, n) of docs.

    Each step is settled before the next begins, and what only it has read is
    deleted then: the disk holds one step's files at a time.
    """
    chance = _with_a_chance(docs, sizes, join)
    sets = settle(_sets(only(docs, chance, "left_semi"), join))
    discard(chance)
    rare = settle(rare_prefixes(sets, join))
    first = _first_links(rare, sets, join)
    classes = settle(connected_components(first))
    discard(first)
    pairs = settle(_candidates(rare, classes, join))
    discard(rare)
    rest = settle(verify(pairs, sets, join))
    discard(pairs, sets)
    return classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs.

    Ids are whole numbers. Rows that repeat an id are one document, whose text is
    the smallest of theirs. A row without an id has its n_shingles and no
    component. A null text and one without words have the empty set, which is
    linked with nothing: such a document is its own component. An empty table
    gives an empty result. Other columns are not read.
    """
    with freeing_shuffles(docs.sparkSession):
        return _classes(docs, id_col, text_col, join)


def _classes(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named, nameless = given.filter("id IS NOT NULL"), given.filter("id IS NULL")
    repeats = not named.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").isEmpty()
    if repeats:
        named = named.groupBy("id").agg(F.min("text").alias("text"))
    sizes = settle(_sizes(named, join))
    # Only sets with copies need one to stand for them. The table is dealt anew, so that the join below deals both sides
    # and Spark can split the key of a large group.
    stands = sizes.filter("n > 0").groupBy("f", "g").agg(F.min("id").alias("stand"), F.count("*").alias("k")).filter("k > 1").drop("k")
    stands = settle(stands.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    members = settle(sizes.join(stands, ["f", "g"], "left").select("id", "n", F.coalesce("stand", "id").alias("stand")))
    discard(sizes, stands)
    others = settle(members.filter("id <> stand OR n = 0").select("id"))
    links = _links(only(named, others, "left_anti"), members.select("id", "n"), join)
    discard(others)
    found = connected_components(links)
    result = members.join(found.withColumnRenamed("node", "stand"), "stand", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "stand").alias("component_id"))
    if repeats:
        result = given.filter("id IS NOT NULL").select("id").join(result, "id")
    lone = _sizes(nameless, join).select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(lone).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """docs without those that are linked, over any number of links, with a smaller id; docs' columns, whatever their names.

    Of rows that repeat an id one stays, that with the smallest text (null last);
    rows without an id stay, and so does a null or empty text, which is linked
    with nothing. An empty table gives an empty result.
    """
    out_col, place = unused("_out", docs.columns), unused("_place", docs.columns)
    key = F.col(f"`{id_col}`")
    found = settle(classes(docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", join))
    out = settle(found.filter("id <> component_id").select(F.col("id").alias(out_col)).distinct())
    small = out.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(out) if small else out, key.cast("long") == F.col(out_col), "left_anti")
    repeats = not found.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").isEmpty()
    discard(found)
    if not repeats:
        return kept
    first = Window.partitionBy(key).orderBy(F.col(f"`{text_col}`").asc_nulls_last())
    unique = kept.filter(key.isNotNull()).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
    return unique.unionByName(kept.filter(key.isNull()))
