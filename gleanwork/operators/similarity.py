"""Near-equal 64-bit hashes: Hamming joins by blocking, and greedy resolution."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..runtime import cut


def block_keys(bits: Column, threshold: int, blocks: int | None = None) -> Column:
    """Keys of which two hashes within the threshold share one (pigeonhole).

    64 bits are cut into blocks; at most `threshold` of them differ, so some choice
    of the others is equal. More blocks mean more, and more selective, keys.
    """
    blocks = blocks or min(64, threshold + 2)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(bits, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    keep = blocks - threshold
    return F.array(*[F.xxhash64(F.lit(i), *[parts[j] for j in chosen]) for i, chosen in enumerate(combinations(range(blocks), keep))])


def hash_links(hashes: DataFrame, threshold: int = 6, blocks: int | None = None) -> DataFrame:
    """Linked pairs (a, b), a < b, of distinct values of `hash` (long) at a distance of 1 to threshold.

    Equal hashes are one value here, so copies never multiply pairs.
    """
    one = hashes.select("hash").distinct()
    keyed = one.select("hash", F.explode(block_keys(F.col("hash"), threshold, blocks)).alias("key"))
    left, right = keyed.select("key", F.col("hash").alias("a")), keyed.select("key", F.col("hash").alias("b"))
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)).select("a", "b").distinct()


def similar_counts(items: DataFrame, threshold: int = 6, blocks: int | None = None) -> DataFrame:
    """(id, hash, n_similar): other items with a hash within the threshold, equal ones included.

    From items (id, hash); a null hash is similar to none.
    """
    counted = items.filter("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))
    links = hash_links(counted, threshold, blocks)
    both = links.union(links.select("b", "a"))
    near = both.join(counted.select(F.col("hash").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("near"))
    totals = counted.join(near.withColumnRenamed("a", "hash"), "hash", "left").select("hash", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"))
    return items.join(totals, "hash", "left").select("id", "hash", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"))


def similar_to_kept(hashes: DataFrame, kept: DataFrame, threshold: int = 6, blocks: int | None = None) -> DataFrame:
    """Rows of hashes (id, hash) for which a kept hash lies within the threshold."""
    probe = hashes.select("id", "hash", F.explode(block_keys(F.col("hash"), threshold, blocks)).alias("key"))
    index = kept.select(F.col("hash").alias("kept_hash")).distinct().select("kept_hash", F.explode(block_keys(F.col("kept_hash"), threshold, blocks)).alias("key"))
    hit = probe.join(index, "key").filter(hamming(F.col("hash"), F.col("kept_hash")) <= threshold).select("id").distinct()
    return hashes.join(hit, "id", "left_semi")


def greedy_keep(items: DataFrame, threshold: int = 6, blocks: int | None = None) -> DataFrame:
    """Items (rank, hash) that a scan in rank order keeps: those near no item kept before.

    Nearness isn't transitive, so this is the first maximal independent set by
    rank: in each round, undecided items without an undecided earlier neighbour
    stay and their neighbours go.
    """
    firsts = items.groupBy("hash").agg(F.min("rank").alias("rank"))
    pairs = hash_links(firsts, threshold, blocks)
    ranks = firsts.select(F.col("hash").alias("a"), F.col("rank").alias("ra"))
    edges = pairs.join(ranks, "a").join(ranks.toDF("b", "rb"), "b")
    edges = cut(edges.select(F.least("ra", "rb").alias("early"), F.greatest("ra", "rb").alias("late")))
    kept = cut(firsts.select("rank").join(edges.select(F.col("late").alias("rank")), "rank", "left_anti"))
    left = cut(edges)
    while not left.isEmpty():
        blocked = left.select("late").distinct()
        sure = left.select(F.col("early").alias("rank")).distinct().join(blocked.withColumnRenamed("late", "rank"), "rank", "left_anti")
        sure = cut(sure)
        gone = cut(left.join(sure.withColumnRenamed("rank", "early"), "early", "left_semi").select(F.col("late").alias("rank")).distinct())
        rest = cut(left.join(sure.withColumnRenamed("rank", "early"), "early", "left_anti").join(gone.withColumnRenamed("rank", "early"), "early", "left_anti").join(gone.withColumnRenamed("rank", "late"), "late", "left_anti"))
        # an item whose earlier neighbours have all gone is free of them now
        was = left.select(F.col("late").alias("rank")).distinct()
        free = was.join(gone, "rank", "left_anti").join(rest.select(F.col("late").alias("rank")), "rank", "left_anti")
        kept = cut(kept.union(sure).union(free).distinct())
        left = rest
    return items.join(kept, "rank", "left_semi")
