"""Shards of near-equal bytes for groups of rows that must stay together."""

from __future__ import annotations

import heapq
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_out

#: A group of more than 1 / (shards * LARGE) of all bytes is dealt by itself; there are at most shards * LARGE of them.
LARGE = 128
#: A block holds about so many of the other items and packs them into so many bundles, which are the items of the next round.
BLOCK, BUNDLES = 20_000, 32
#: Bundles that the last differencing takes at most, besides the large groups and about so many to twice as many others,
#: picked by a hash, that even out what bundles of equal size can't.
LAST, LOOSE = 16_384, 4_096
#: Rows of a shard that a task numbers, about.
NUMBERED = 50_000


def differencing(sizes: list[int], ways: int) -> tuple[list[int], list[int]]:
    """Karmarkar-Karp: the way of each size, and each way's total.

    Every size begins as a partial partition with one filled way. The two partial
    partitions with the largest spread (largest less smallest way) are combined again and
    again, the fullest way of one with the emptiest of the other, until one is left.
    """
    if not sizes:
        return [], [0] * ways
    parent: list[int] = list(range(len(sizes)))
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)] + [(0, -1)] * (ways - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = []
        for (x, i), (y, j) in zip(a, reversed(b)):
            if i >= 0 and j >= 0:
                parent.append(len(parent))
                parent[i] = parent[j] = len(parent) - 1
                i = len(parent) - 1
            both.append((x + y, max(i, j)))
        both.sort(key=lambda way: (-way[0], way[1]))
        heapq.heappush(heap, (both[-1][0] - both[0][0], len(parent), both))
        parent.append(len(parent))  # a number for the tie, never anyone's parent
    ways_left = heap[0][2]
    root_way = {i: w for w, (_, i) in enumerate(ways_left) if i >= 0}
    way = [-1] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        way[i] = root_way.get(i, -1) if parent[i] == i else way[parent[i]]
    return way[: len(sizes)], [x for x, _ in ways_left]


def _bundle(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a block's (item, bytes), the bundle each item goes to."""
    frame = frame.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
    way, _ = differencing(frame["bytes"].tolist(), BUNDLES)
    return pd.DataFrame({"item": frame["item"], "bytes": frame["bytes"], "into": frame["block"] * BUNDLES + way})


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Deal all rows into ``shards`` so that bytes come out near equal and equal texts stay together.

    Returns one row for each row of ``docs``: the id column, ``size`` (UTF-8 bytes of the
    text plus 1), ``text_crc32``, ``shard`` and ``slot`` (a gapless number from 0 in the shard).

    Groups (equal texts, told by SHA-256) are indivisible. Those above 1 / (128 * shards)
    of all bytes, at most 128 * shards of them, are items of their own. All others are
    dealt into blocks of about 20,000 by key; a task differences a block into
    32 bundles, which are dealt and differenced again while there are more than 16,384. The last
    differencing takes these, the large groups and some thousand others, whatever the input's size. One group larger than a shard's
    fair share gets a shard that holds little else; it is never split.

    Null and empty texts count as the same empty text (size 1, checksum 0). Null, repeated and tied
    ids keep one row each. An empty table gives an empty table. Only the id and text
    columns are read, so other columns' names can't clash. Reruns agree on the shard, whatever the partitions, and on the slot of
    rows with an id; slots among rows of one id and text are arbitrary.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = write_out(
        docs.select(
            F.col(row_id).alias("id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("key"),
        ),
        "shard-rows",
    )
    groups = write_out(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cut = total // (shards * LARGE)
    large = groups.filter(F.col("bytes") > cut).orderBy(F.desc("bytes"), "key").collect()  # fewer than shards * LARGE

    others = write_out(groups.filter(F.col("bytes") <= cut).groupBy(F.xxhash64("key").alias("item")).agg(F.sum("bytes").alias("bytes")), "shard-items")
    is_loose = F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(max(1, others.count() // LOOSE))) == 0
    loose = others.filter(is_loose).orderBy("item").collect()
    items, steps = others.filter(~is_loose), []
    while True:
        blocks = -(-items.count() // BLOCK) or 1
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(len(steps))), F.lit(blocks)))
        steps.append(write_out(dealt.groupBy("block").applyInPandas(_bundle, "item long, bytes long, into long"), "shard-bundles"))
        items = steps[-1].groupBy(F.col("into").alias("item")).agg(F.sum("bytes").alias("bytes"))
        if blocks * BUNDLES <= LAST:
            break
    bundles = items.orderBy("item").collect()
    way, _ = differencing([r["bytes"] for r in [*large, *loose, *bundles]], shards)
    of_large = spark.createDataFrame([(r["key"], w) for r, w in zip(large, way)], "key binary, shard int")
    of_loose = spark.createDataFrame([(r["item"], w) for r, w in zip(loose, way[len(large) :])], "item long, shard int")
    of_bundle = spark.createDataFrame([(r["item"], w) for r, w in zip(bundles, way[len(large) + len(loose) :])], "into long, shard int")

    # Rows of large groups never enter the shuffled join, so no key is hot there. Both lists have fixed bounds.
    own = rows.join(F.broadcast(of_large), "key", "left")
    small = F.broadcast(of_bundle)
    for step in reversed(steps):
        small = step.join(small, "into").select(F.col("item").alias("into"), "shard")
    small = small.withColumnRenamed("into", "item").union(of_loose)
    open_ = own.filter("shard is null").drop("shard").withColumn("item", F.xxhash64("key")).join(small, "item").drop("item")
    dealt = own.filter("shard is not null").unionByName(open_)
    return number_slots(dealt, rows.count()).select(F.col("id").alias(row_id), "size", "text_crc32", "shard", "slot")


def number_slots(dealt: DataFrame, n: int) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, to about n rows, without a shard in one task.

    Rows are numbered inside (shard, bucket); a bucket, told by a hash of id and text, starts where the buckets before it
    end. Rows without an id spread by their partition. The starts, a row for each bucket, are few.
    """
    spread = F.when(F.col("id").isNull(), F.spark_partition_id()).otherwise(F.lit(0))
    dealt = write_out(dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "key", spread), F.lit(n // NUMBERED + 1))), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "key")
    return dealt.withColumn("at", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long")).drop("at", "start", "bucket")
