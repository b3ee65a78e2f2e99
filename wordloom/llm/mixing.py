"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks of about equal words. The
target in words becomes a quota of blocks: as many whole passes over the source
as fit, and of the next pass permuted blocks that still fit, and then the
smallest other one, cut between the two documents nearest to the target. A tree then splits all quotas among the
output shards: at each node the left half's share of every source is a draw
without replacement from the node's quotas (multivariate hypergeometric), so
shards differ as a shuffle's would while quotas hold exactly. Each shard takes
its own, disjoint, permuted blocks and shuffles them locally.

The driver holds sums by source and by block: their number is bounded by
``most_blocks`` and ``most_sources``, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from wordloom.llm.common import BLANKS, discard, settle


@dataclass(frozen=True)
class Recipe:
    """What is mixed, and in which portions.

    weights repeat over the sources in their order; share: words of the mix for
    each word of the input; passes: most times a source is used. A block, a shard
    and a partition have about so many words, or more where there would be over
    most_blocks blocks or most_shards shards; every source has a block.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    passes: int = 2
    block_words: int = 10_000
    most_blocks: int = 131_072
    shard_words: int = 100_000
    most_shards: int = 65_536
    partition_words: int = 4_000_000
    most_sources: int = 100_000
    seed: int = 11


def targets(sizes: list[int], recipe: Recipe = Recipe()) -> list[float]:
    """Words of each source: shares by weight, no more than passes times its size, what is over reshared by weight."""
    weights = [recipe.weights[k % len(recipe.weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), recipe.share * sum(sizes)
    while free:
        total = sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if left * weights[k] / total > recipe.passes * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(recipe.passes * sizes[k])
        free -= set(over)
        left -= sum(out[k] for k in over)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> list[dict[int, int]]:
    """Each shard's blocks by source. Shards' totals differ by one at most; sources' totals are the quotas."""
    out: list[dict[int, int]] = [{} for _ in range(shards)]

    def split(kinds: np.ndarray, counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = dict(zip(kinds.tolist(), counts.tolist(), strict=True))
            return
        middle, total = (low + high) // 2, int(counts.sum())
        end = int(quotas.sum())
        left = (end * middle // shards) - (end * low // shards)
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(counts, min(left, total), method="marginals") if len(counts) else counts
        for part, a, b in ((drawn, low, middle), (counts - drawn, middle, high)):
            split(kinds[part > 0], part[part > 0], a, b)

    there = np.flatnonzero(quotas)
    split(there, quotas[there].astype(np.int64), 0, shards)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")).cast("long")


@dataclass
class Mix:
    """A worked-out mixture: apply it to the documents it was planned for."""

    recipe: Recipe
    sources: DataFrame  # source, number, blocks, source_size, target
    slots: DataFrame  # number, block, slots: array of (pass, shard, cut); cut: words to take of the block, null for all
    shards: int
    words: int  # of the whole mix, about

    def apply(self, rows: DataFrame, hash_col: str, size_col: str, source_col: str) -> DataFrame:
        """rows with source_size, target, slots (pass, shard) and taken."""
        # Both tables are small by construction: most_sources rows, and passes * (most_blocks + most_sources) rows.
        rows = rows.join(F.broadcast(self.sources), rows[source_col].eqNullSafe(F.col("_source")), "left").drop("_source")
        uniform = F.shiftrightunsigned(hash_col, 11) / F.lit(float(1 << 53))
        rows = rows.withColumn("_block", F.floor(uniform * F.col("_blocks")).cast("int"))
        rows = rows.join(F.broadcast(self.slots), ["_number", "_block"], "left")
        rows = rows.withColumn("_cut", F.expr("get(filter(_slots, x -> x.cut IS NOT NULL), 0).cut"))
        whole, cut = rows.filter("_cut IS NULL"), rows.filter("_cut IS NOT NULL")
        order = Window.partitionBy("_number").orderBy(hash_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(size_col).over(order), F.lit(0))
        fits = before + F.col(size_col) / 2 <= F.col("_cut")
        cut = cut.withColumn("_fits", fits)
        both = whole.withColumn("_fits", F.lit(True)).unionByName(cut)
        slots = F.expr("transform(filter(coalesce(_slots, array()), x -> x.cut IS NULL OR _fits), x -> struct(x.pass AS pass, x.shard AS shard))")
        both = both.withColumn("slots", slots).withColumn("taken", F.size("slots") * F.col(size_col))
        return both.drop("_number", "_block", "_blocks", "_slots", "_cut", "_fits")


def plan_mix(sized: DataFrame, hash_col: str, size_col: str, source_col: str, recipe: Recipe = Recipe()) -> Mix:
    """Work out the mixture for rows of (hash, size, source): two sums over them, by source and by block."""
    spark = sized.sparkSession
    sums = sized.groupBy(source_col).agg(F.sum(size_col).alias("n")).limit(recipe.most_sources + 1).collect()
    if len(sums) > recipe.most_sources:
        raise ValueError(f"{source_col} has over {recipe.most_sources} values")
    named = sorted(((r[0], int(r["n"] or 0)) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in named]
    aims = targets(sizes, recipe)
    per_block = max(1, recipe.block_words, -(-sum(sizes) // recipe.most_blocks))
    blocks = [max(1, -(-n // per_block)) for n in sizes]
    schema = T.StructType().add("_source", sized.schema[source_col].dataType).add("_number", T.IntegerType()).add("_blocks", T.IntegerType()).add("source_size", T.LongType()).add("target", T.DoubleType())
    sources = spark.createDataFrame([(s, k, blocks[k], sizes[k], aims[k]) for k, (s, _) in enumerate(named)], schema)
    block = F.floor(F.shiftrightunsigned(hash_col, 11) / F.lit(float(1 << 53)) * F.col("_blocks")).cast("int")
    with_number = sized.join(F.broadcast(sources), sized[source_col].eqNullSafe(F.col("_source")))
    words = {(r["_number"], r["_block"]): int(r["n"] or 0) for r in with_number.groupBy("_number", block.alias("_block")).agg(F.sum(size_col).alias("n")).collect()}

    draws: list[list[tuple[int, int, float | None]]] = []  # of each source: pass, block, cut
    for k, n in enumerate(sizes):
        rng = np.random.default_rng([recipe.seed, k])
        mine: list[tuple[int, int, float | None]] = []
        left, turn = aims[k], 0
        while left > 0 and n > 0:
            order = rng.permutation(blocks[k]).tolist()
            if left >= n:
                mine += [(turn, b, None) for b in order]
                left, turn = left - n, turn + 1
                continue
            over = []
            for b in order:
                held = words.get((k, b), 0)
                if held <= left:
                    mine.append((turn, b, None))
                    left -= held
                else:
                    over.append((held, b))
            if over and left > 0:
                mine.append((turn, min(over)[1], left))
            break
        draws.append(mine)
    quotas = np.array([len(x) for x in draws], np.int64)
    shards = int(max(1, min(-(-sum(aims) // recipe.shard_words), recipe.most_shards, quotas.sum())))
    at = [0] * len(draws)
    slots: dict[tuple[int, int], list[tuple]] = {}
    for shard, got in enumerate(split_quotas(quotas, shards, recipe.seed)):
        for k, n in got.items():
            for turn, b, cut in draws[k][at[k] : at[k] + n]:
                slots.setdefault((k, b), []).append((turn, shard, cut))
            at[k] += n
    schema = "_number int, _block int, _slots array<struct<pass:int,shard:int,cut:double>>"
    table = spark.createDataFrame([(k, b, x) for (k, b), x in slots.items()], schema)
    return Mix(recipe, sources, table, shards, int(sum(aims)))


def row_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", recipe: Recipe = Recipe()) -> DataFrame:
    """(id_col, size, source_size, target, slots, taken), a row for each row of docs.

    size: words of the text (a null text has none and is never taken); slots:
    in which pass and shard the document is; taken: its words in the mix. A null
    source is a source of its own, the last. Repeated rows count each, and fall
    in one block. An empty table gives an empty result; more than
    ``most_sources`` sources are an error. Other columns are not read.
    """
    sized = settle(docs.select(F.col(id_col), row_hash(id_col, text_col, recipe.seed).alias("_hash"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("_of")))
    mix = plan_mix(sized, "_hash", "size", "_of", recipe)
    return mix.apply(sized, "_hash", "size", "_of").select(id_col, "size", "source_size", "target", "slots", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", recipe: Recipe = Recipe()) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, by shard and shuffled within it; docs' columns, whatever their names.

    The order within a shard is that of a hash of the row and its pass. Texts
    are moved once, to the partition of their shard. A null, empty or blank text
    has no words: its row comes along with its block, but counts nothing and may
    be left out. A null source is a source of its own, the last; repeated rows
    are taken each. An empty table gives an empty result.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), row_hash(id_col, text_col, recipe.seed).alias("_hash"), word_count(F.col(text_col)).alias("_size"), F.col(source_col).alias("_of"))
    sized = settle(rows.select("_hash", "_size", "_of"))
    plan = plan_mix(sized, "_hash", "_size", "_of", recipe)
    discard(sized)
    taken = plan.apply(rows, "_hash", "_size", "_of").select("_row", "_hash", F.explode("slots").alias("_slot"))
    # Partition p has the shards from p * shards / partitions on.
    partitions = max(1, min(plan.shards, -(-plan.words // recipe.partition_words)))
    dealt = taken.repartitionById(partitions, (F.col("_slot.shard") * partitions / plan.shards).cast("int"))
    return dealt.sortWithinPartitions("_slot.shard", F.xxhash64(F.lit(recipe.seed), "_hash", "_slot.pass")).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
