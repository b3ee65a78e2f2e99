"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is cut into segments, and every code is indexed under the value of each
of its segments. A query looks up, for a radius 0, 1, 2 and so on, all values at
that distance from its own in every segment. A code not met by then differs by
more than the radius in each segment, so by segments * (radius + 1) or more in
all: as soon as the query's kth verified distance is below that, its answer is
complete. A code is met in the segment in which it is nearest (the first such),
and counted there only, so nothing is verified twice.

Vectors with equal codes share one entry, which names the k + 1 smallest ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import settle


def segments_of(vector: str, bits: int, width: int) -> Column:
    """Signs of the vector's first ``bits`` entries, width to a number; entries that are missing, null or not positive give 0."""
    bit = lambda k: F.when(F.get(vector, F.lit(k)) > 0, F.lit(1 << (k % width))).otherwise(F.lit(0))
    return F.array(*[sum((bit(k) for k in range(at + 1, min(bits, at + width))), bit(at)) for at in range(0, bits, width)])


def _values_at(radius: int, width: int) -> Column:
    masks = [x for x in range(1 << width) if x.bit_count() == radius]
    return F.expr(f"array({','.join(map(str, masks))})")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, distance): for each row that queries picks, the k nearest other ids, by distance and then id.

    width: bits of a segment; without it the logarithm of the number of codes,
    from 4 to 16. Rows with a null id or vector are left out, as queries and as
    answers. Ids that repeat are one id; where their vectors differ, the nearest
    counts. Fewer than k other ids give fewer rows; an empty table none.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("id IS NOT NULL AND vector IS NOT NULL")
    shape = given.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("bits")).first()
    bits = max(1, shape["bits"] or 1)
    width = min(bits, width or max(4, min(16, round((shape["n"] or 1).bit_length()))))
    coded = settle(given.select("id", "asks", segments_of("vector", bits, width).alias("code")))
    parts = -(-bits // width)

    first = Window.partitionBy("code").orderBy("id")
    members = coded.select("code", "id").withColumn("_n", F.dense_rank().over(first)).filter(F.col("_n") <= k + 1)
    entries = members.groupBy("code").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    index = settle(entries.select("ids", "code", F.posexplode("code").alias("part", "value")).repartition("part", "value"))
    asking = settle(coded.filter("asks").select("id", "code").distinct())
    open_ = settle(asking.groupBy("code").agg(F.min("id").alias("query")).withColumnRenamed("code", "asked"))

    apart = [F.bit_count(F.get("code", F.lit(j)).bitwiseXOR(F.get("asked", F.lit(j)))) for j in range(parts)]
    distance = sum(apart[1:], apart[0])
    nearest = Window.partitionBy("query").orderBy("distance", "id")
    best: DataFrame | None = None
    found: DataFrame | None = None
    for radius in range(width + 1):
        probes = open_.select("query", "asked", F.posexplode("asked").alias("part", "own")).select("query", "asked", "part", F.explode(_values_at(radius, width)).alias("mask"), "own")
        probes = probes.select("query", "asked", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        here = F.lit(True)
        for j in range(parts):
            here = here & F.when(F.lit(j) < F.col("part"), apart[j] > radius).otherwise(apart[j] >= radius)
        met = index.join(probes, ["part", "value"]).filter(here).select("query", distance.cast("int").alias("distance"), F.explode("ids").alias("id"))
        merged = met if best is None else best.unionByName(met)
        merged = merged.groupBy("query", "id").agg(F.min("distance").alias("distance"))
        merged = settle(merged.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= k + 1).drop("_n"))
        covered = parts * (radius + 1)
        ready = merged.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far")).filter((F.col("n") > k) & (F.col("far") < covered) if radius < width else F.lit(True)).select("query")
        ready = settle(ready)
        done = merged.join(ready, "query", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = settle(open_.join(ready, "query", "left_anti"))
        if open_.isEmpty():
            break
        best = merged.join(ready, "query", "left_anti")
    owners = asking.join(asking.groupBy("code").agg(F.min("id").alias("query")), "code").select("query", F.col("id").alias("query_id"))
    answers = owners.join(found, "query").filter("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    place = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")
