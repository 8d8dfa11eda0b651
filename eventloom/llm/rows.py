"""Rows told apart by a hash of id and text, and removed by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers is sent to every executor (16 MB of keys); a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def sent(table: DataFrame) -> DataFrame:
    """A written table as one side of a join: sent to every executor if it has at most BROADCAST_KEYS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def row_key(text: str = "text", row_id: str = "doc_id") -> Column:
    return F.xxhash64(F.col(row_id), F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, keys: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key isn't among ``keys`` (column row_key); texts are only shuffled if the list is long."""
    drop = keys.select(F.col("row_key").alias("_dropped_key")).distinct()
    if drop.count() <= BROADCAST_KEYS:
        drop = F.broadcast(drop)
    return docs.join(drop, row_key(text, row_id) == F.col("_dropped_key"), "left_anti")


def once(docs: DataFrame, keys: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each key among ``keys`` (column row_key), which lists every row of ``docs``; rows that aren't repeated are not shuffled."""
    repeated = keys.groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias("_repeated_key"))
    if repeated.isEmpty():
        return docs
    own = docs.withColumn("_own_key", row_key(text, row_id)).join(repeated, F.col("_own_key") == F.col("_repeated_key"), "left_semi")
    kept = own.dropDuplicates(["_own_key"]).drop("_own_key")
    return without(docs, repeated.select(F.col("_repeated_key").alias("row_key")), text, row_id).unionByName(kept)
