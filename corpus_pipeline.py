"""From documents to balanced shards: toxic texts, near copies and benchmark passages go, sources are mixed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.jaccard_join import ngram_components
from eventloom.llm.mixing import mix_sources
from eventloom.llm.rows import once, sent, without
from eventloom.llm.scratch import write_out
from eventloom.llm.sharding import shard_by_bytes
from eventloom.llm.toxicity import score_toxicity, train_toxicity
from eventloom.llm.winnowing import decontaminate

#: Scores from which a text is rejected as toxic.
TOXIC = 0.7
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below TOXIC, by a model of the labelled rows among them (outside the held-out third)."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, score="_toxicity").filter(F.col("_toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of Jaccard similarity 0.8 on five-word shingles connect: the least id, null last.

    Among rows of one id, or of none, the least hash of id and text stays. Rows without words link with nothing and all stay.
    """
    found = write_out(ngram_components(docs, words=5, threshold="0.8"), "copies").filter("n_shingles > 0")
    kept = without(docs, found.filter(F.col("row_key") != F.col("component_key")))
    return once(kept, found)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no ten words in a row (or a whole shorter item) with the benchmark."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it: not at all, once or twice.

    Rows are told apart by all their columns; rows alike in all of them stand for one another.
    """
    absent = F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in docs.columns))
    key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), absent)
    taken = mix_sources(docs, key=key).groupBy("row_key").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows")).filter("_times > 0")
    taken = write_out(taken.select(F.col("row_key").alias("_key"), "_times", "_rows"), "mix-taken")
    keyed = docs.withColumn("_key", key)
    single = keyed.join(sent(taken.filter("_rows = 1")), "_key")
    alike = keyed.join(sent(taken.filter("_rows > 1")), "_key").dropDuplicates(["_key"])
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / 1000)))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("_times") - 1000 * F.col("_thousand"))))
    repeated = single.unionByName(alike).withColumn("_thousand", thousands).withColumn("_copy", each)
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every row, shards of near-equal bytes, with equal texts in one shard."""
    return shard_by_bytes(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL expresses a trained classifier, balanced sampling or differencing; the tests compare with loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
