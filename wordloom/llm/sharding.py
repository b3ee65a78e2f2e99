"""Shards of near equal bytes that keep equal texts together, by minimax contiguous partition.

Documents with equal texts are one group, which no cut may divide. Groups stand
in the order of their keys (the digest of the text, so neighbours have nothing
to do with each other), and a shard is a stretch of that order. A capacity is
feasible if stretches, each filled as far as it allows, cover all groups; the
smallest feasible one is found by binary search. What room it leaves is spent
evenly: each cut is the border nearest to an even share of what is left, among
those from which the rest still fits into that capacity.

The search reads running sums at the borders of groups, but never all of them:
it begins with sums by the key's first digits, and only blocks in which it had
to look up a place are divided further, until every place that it looks up is
known to the group. So the driver holds a few thousand sums at any size.

Everything here is DataFrame and SQL expressions; the search itself is
arithmetic over those sums.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import discard, settle, unused

#: Digits of the key by which sums are first taken, and by which a block is divided further.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Blocks divided in one job, at most; the rest follow in the next.
BLOCKS_A_JOB = 2000
#: After every key.
BEYOND = "~"


@dataclass(frozen=True)
class Block:
    """Groups whose keys begin with prefix, their size and rows; atomic: they are one group."""

    prefix: str
    size: int
    rows: int
    atomic: bool


@dataclass(frozen=True)
class Plan:
    """capacity: the smallest feasible one; cuts: where the second shard and each after it begins; firsts: rows before each shard."""

    capacity: int
    cuts: tuple[str, ...]
    firsts: tuple[int, ...]


class _Ruler:
    """Running sums at the borders of blocks, and the blocks in which a place was looked up though it isn't known there."""

    def __init__(self, blocks: list[Block]) -> None:
        self.blocks = blocks
        self.ends = list(accumulate((b.size for b in blocks), initial=0))
        self.unclear: set[int] = set()

    def _inside(self, i: int) -> None:
        if not self.blocks[i].atomic:
            self.unclear.add(i)

    def at_most(self, x: int) -> int:
        """The last border that isn't over x."""
        i = bisect_right(self.ends, x) - 1
        if self.ends[i] < x and i < len(self.blocks):
            self._inside(i)
        return self.ends[i]

    def at_least(self, x: int) -> int:
        """The first border that isn't under x."""
        i = bisect_left(self.ends, x)
        if self.ends[i] > x and i:
            self._inside(i - 1)
        return self.ends[i]


def _smallest_capacity(ruler: _Ruler, shards: int) -> int:
    total = ruler.ends[-1]
    low = -(-total // shards)
    # With the heaviest block to spare, every shard but the last takes its share or more.
    high = min(total, low + max((b.size for b in ruler.blocks), default=0))
    while low < high:
        tried, end = (low + high) // 2, 0
        for _ in range(shards):
            end = ruler.at_most(end + tried)
        low, high = (low, tried) if end == total else (tried + 1, high)
    return low


def _borders(ruler: _Ruler, shards: int, capacity: int) -> list[int]:
    """Where the second shard and each after it begins, as running sums."""
    total = ruler.ends[-1]
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(ruler.at_least(max(0, earliest[-1] - capacity)))
    borders, at = [], 0
    for k, least in zip(range(shards, 1, -1), earliest[:0:-1], strict=True):
        aim = at - (at - total) // k
        below, above = ruler.at_most(aim), ruler.at_least(aim)
        near = below if below > at and aim - below <= above - aim else above
        at = min(max(near, least), ruler.at_most(at + capacity))
        borders.append(at)
    return borders


def _sums(rows: DataFrame, digits: int) -> list[Block]:
    prefix = F.substring("key", 1, digits)
    found = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), (F.min("key") == F.max("key")).alias("atomic"))
    return [Block(r["prefix"], r["size"], r["rows"], r["atomic"]) for r in found.collect()]


def _divided(rows: DataFrame, blocks: list[Block]) -> list[Block]:
    found = []
    for digits, some in groupby(sorted(blocks, key=lambda b: len(b.prefix)), key=lambda b: len(b.prefix)):
        here = rows.filter(F.substring("key", 1, digits).isin([b.prefix for b in some]))
        found += _sums(here, digits + MORE_DIGITS)
    return found


def plan_shards(rows: DataFrame, shards: int = 8) -> Plan:
    """Cuts for rows (key, size): keys are hexadecimal digests, in whose order groups stand; sizes count as 0 where null or negative.

    rows is read once for each level of digits, and should be settled. With
    fewer groups than shards the last shards are empty; an empty table has
    nothing but empty ones.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = rows.select("key", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"))
    blocks = sorted(_sums(rows, FIRST_DIGITS), key=lambda b: b.prefix)
    while True:
        ruler = _Ruler(blocks)
        capacity = _smallest_capacity(ruler, shards)
        borders = _borders(ruler, shards, capacity)
        if not ruler.unclear:
            break
        heavy = sorted(ruler.unclear, key=lambda i: -blocks[i].size)[:BLOCKS_A_JOB]
        parts = _divided(rows, [blocks[i] for i in heavy])
        blocks = sorted([b for i, b in enumerate(blocks) if i not in set(heavy)] + parts, key=lambda b: b.prefix)
    starts = [bisect_left(ruler.ends, x) for x in borders]
    before = list(accumulate((b.rows for b in blocks), initial=0))
    return Plan(capacity, tuple(blocks[i].prefix if i < len(blocks) else BEYOND for i in starts), (0, *(before[i] for i in starts)))


def shard_of(key: Column, plan: Plan) -> Column:
    """The shard of a key: the number of cuts that aren't after it."""
    if not plan.cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in plan.cuts]), lambda c: c <= key))


def key_of(text: Column) -> Column:
    """The group of a text: equal texts, and null ones with the empty one, have one key."""
    return F.md5(F.coalesce(text, F.lit("")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, size, text_crc32) of each row: its group, the text's UTF-8 bytes (null: none) and one more, its checksum (null: 0, as of no bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), key_of(F.col(text_col)).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))


def with_shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """docs with one more column, its shard, for ``write.partitionBy``; no text moves.

    A column of docs of that name, in whatever case, keeps it; the new one gets underscores.
    """
    rows = settle(sizes(docs, id_col, text_col).select("key", "size"))
    plan = plan_shards(rows, shards)
    discard(rows)
    return docs.withColumn(unused(name, docs.columns), shard_of(key_of(F.col(text_col)), plan))


def place(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs; other columns are not read.

    law is always ``bytes`` and grown_shard null. Slots number a shard's rows
    by key and id, nulls first, from 0 without gaps. Null texts stand with empty
    ones; a very long text is a group like any other; ids may be null or repeat,
    and equal rows get a slot each. A group heavier than a shard's even share
    makes the capacity its own size, and the others stay even beside it.

    Texts are read once. What moves are ids, keys and sizes, by ranges of key,
    id and place, so that a group of any number of rows is dealt over many tasks.
    """
    rows = settle(sizes(docs, id_col, text_col).withColumn("_place", F.monotonically_increasing_id()))
    plan = plan_shards(rows, shards)
    ordered = settle(rows.repartitionByRange("key", "id", "_place").sortWithinPartitions("key", "id", "_place").drop("_place"))
    discard(rows)
    # A settled table's rows are read back in the partitions and in the order in which they were written.
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() % (1 << 33))
    # Over a row for each partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = ordered.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    firsts = F.array(*[F.lit(x).cast("long") for x in plan.firsts])
    placed = ordered.join(F.broadcast(counted), "_part").withColumn("shard", shard_of(F.col("key"), plan)).withColumn("slot", F.col("_before") + F.col("_k") - F.get(firsts, F.col("shard")))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
