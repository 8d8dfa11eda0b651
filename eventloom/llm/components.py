"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import BROADCAST_KEYS, sent
from .scratch import remove, write_out

#: Edges for which a round writes one partition. Few edges in hundreds of files are hundreds of tasks and file
#: entries in each round, which the driver holds.
EDGES_A_PARTITION = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b, whole numbers): the least node that it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014): every node points its larger,
    then its smaller neighbours to the least one, until each component is a star. A
    round costs two aggregations of minima, which combine before the shuffle, and two joins with these minima. They are
    sent to every executor while there are few, and else written out, so that adaptive execution
    can split the rows of a star's centre. Edges are never
    collected; each round is written out, in partitions by the number of edges, which cuts its lineage. Loops and repeated edges change
    nothing. An empty table has no nodes.
    """
    now = write_out(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:  # every round that changes edges lowers their sum, so the rounds end
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, parts = state, state[0] // EDGES_A_PARTITION + 1
        few = 2 * state[0] <= BROADCAST_KEYS  # as many nodes at most, so the minima needn't be written to be counted
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = F.broadcast(least) if few else sent(written := write_out(least, "components-least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = write_out(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(parts), "components-down")
        smallest = down.groupBy("a").agg(F.min("b").alias("m"))
        smallest = smallest if few else write_out(smallest, "components-least")
        small = down.join(F.broadcast(smallest) if few else sent(smallest), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        last, now = now, write_out(small.filter("a <> b").distinct().coalesce(parts), "components")
        remove(last, down, *(() if few else (written, smallest)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
