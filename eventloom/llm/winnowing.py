"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import write_out

#: Distinct benchmark fingerprints up to which documents are searched with the set itself; beyond it a salted join shuffles.
SET_SIZE = 20_000
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other letters take the faster function."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(exact)


def benchmark_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def gram_sizes(span: int) -> tuple[int, int]:
    """k and the winnowing window such that every shared run of ``span`` words has a shared fingerprint: k + window - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


#: A mark is a whole number: the 32-bit hash of a k-gram, then this less the k-gram's position.
LAST = (1 << 31) - 1


def k_grams(words: Column, span: int) -> Column:
    """Array of the marks of every k-gram, in order; null for texts shorter than ``span``."""
    k, _ = gram_sizes(span)
    each = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.shiftleft(F.hash(*[F.get(words, i + j) for j in range(k)]).cast("long"), 32) + (F.lit(LAST) - i))
    return F.when(F.size(words) >= span, each)


def winnowed(marks: Column, span: int) -> Column:
    """The least mark of every window of k-grams, each once: the least hash, rightmost if tied.

    The choice depends on a window's words alone, so two texts that share ``span``
    consecutive words choose the same k-gram there.
    """
    _, window = gram_sizes(span)
    if window == 1:
        return marks
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(marks) - window), lambda i: F.least(*[F.get(marks, i + j) for j in range(window)])))


def _hash_of(mark: Column) -> Column:
    return F.shiftright(mark, 32).cast("int")


def _context(words: Column, at: Column, before: int, length: int) -> Column:
    """``length`` words from ``before`` words ahead of position ``at`` (from 0); null where the text has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.when(at - before + j >= 0, F.get(words, at - before + j)))


def _marks(rows: DataFrame, span: int, keys: list[str], wanted: list[int] | None = None) -> DataFrame:
    """One row for each fingerprint (in ``wanted``, if given) of each row of (keys, words): keys, hash, at, around (the words near it)."""
    k, _ = gram_sizes(span)
    picked = rows.withColumn("marks", k_grams(F.col("words"), span)).withColumn("picked", winnowed(F.col("marks"), span))
    if wanted is not None:
        picked = picked.withColumn("picked", F.filter("picked", lambda p: _hash_of(p).isin(wanted)))

    def located(mark: Column) -> Column:
        at = F.lit(LAST) - mark.bitwiseAND(F.lit(LAST)).cast("int")
        return F.struct(_hash_of(mark).alias("hash"), at.alias("at"), _context(F.col("words"), at, span - k, 2 * span - k).alias("around"))

    # with explode, Spark would filter on the array's size first and compute the array anew for that
    seen = picked.select(*keys, F.explode_outer(F.transform("picked", located)).alias("p")).filter("p is not null")
    return seen.select(*keys, "p.hash", "p.at", "p.around")


def _extended(span: int, mine: str, other: str) -> tuple[Column, Column]:
    """Words to the left and right of a fingerprint, its own included, that two rows' surroundings share; -1 if the k-gram differs."""
    k, _ = gram_sizes(span)
    reach = span - k
    same = lambda i: F.coalesce(F.get(F.col(mine), i) == F.get(F.col(other), i), F.lit(False))
    left = F.aggregate(F.sequence(F.lit(1), F.lit(reach)), F.lit(0), lambda a, i: F.when((a == i - 1) & same(reach - i), i).otherwise(a)) if reach else F.lit(0)
    right = F.aggregate(F.sequence(F.lit(0), F.lit(span - 1)), F.lit(0), lambda a, i: F.when((a == i) & same(reach + i), i + 1).otherwise(a))
    return left, right


def _spans(docs: DataFrame, items: DataFrame, span: int, whole: bool) -> DataFrame:
    """(keys, item_id, start, stop) of the runs of at least ``span`` shared words around each shared fingerprint.

    ``whole``: items of exactly ``span`` words only, which are one window each.
    """
    chosen = items.filter(F.size("words") == span) if whole else items.filter(F.size("words") >= span)
    test = write_out(_marks(chosen, span, ["item_id"]).select("item_id", "hash", F.col("around").alias("item_around")), f"winnow-items-{span}")
    hashes = test.select("hash").distinct().limit(SET_SIZE + 1).collect()
    if len(hashes) <= SET_SIZE:
        met = _marks(docs, span, ["doc_id", "key"], [r[0] for r in hashes]).join(test, "hash")
    else:  # a fingerprint that a third of all documents share spreads over SALTS tasks
        salted = _marks(docs, span, ["doc_id", "key"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "at"), F.lit(SALTS)))
        spread = test.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = salted.join(spread, ["hash", "salt"])
    left, right = _extended(span, "around", "item_around")
    k, _ = gram_sizes(span)
    found = met.withColumn("left", left).withColumn("right", right).filter((F.col("right") >= k) & (F.col("left") + F.col("right") >= span))
    return found.select("doc_id", "key", "item_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Find every run of ``span`` words that a row of ``docs`` shares with a benchmark item.

    Returns for each row of ``docs``: the id, ``row_key`` (a hash of id and text), ``n_words``, ``n_hit`` (words inside shared windows),
    ``n_items``, ``items_sha256`` (of the items' ids as sorted strings, comma-joined) and ``contaminated``.

    Both sides keep the least k-gram hash of every sliding window of k-grams, where
    k + window - 1 = span; so every shared run of ``span`` words has a shared fingerprint. Hits are
    verified and extended word by word in the surroundings that a fingerprint carries. An item of
    fewer than ``span`` words is one window: each such length has its own k and window.

    The corpus is scanned once for each window length in use. While the benchmark has at
    most 20,000 distinct fingerprints (checked), documents keep only those before anything is shuffled;
    a larger benchmark meets them in a salted join, with the same results. Only hits are grouped, by document. A row's identity is its id with a hash of
    its text, so repeated rows get equal results. Null and empty texts have no words and
    no hits; null ids keep their rows. Items without words, or a null text, are never found. Other
    columns are not read. Empty tables give zeros, or no rows.
    """
    items = write_out(benchmark.select(F.col(item_id).cast("string").alias("item_id"), benchmark_words(F.col(text)).alias("words")).filter(F.size("words") > 0), "winnow-benchmark")
    lengths = [r[0] for r in items.filter(F.size("words") < span).select(F.size("words")).distinct().collect()]  # fewer than span
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(F.col(row_id), body).alias("key"), benchmark_words(F.col(text)).alias("words"))
    rows = docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(F.col(row_id), body).alias("key"), F.size(benchmark_words(F.col(text))).cast("long").alias("n_words"))

    hits = _spans(cut, items, span, False)
    for n in sorted(lengths):
        hits = hits.unionByName(_spans(cut, items, n, True))
    hits = write_out(hits.distinct(), "winnow-hits")
    words = hits.select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("word")).distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    own = hits.select("doc_id", "key", "item_id").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    hit = words.join(own, (words.doc_id.eqNullSafe(own.doc_id)) & (words.key == own.key)).select(words.doc_id.alias("hit_id"), words.key.alias("hit_key"), "n_hit", "n_items", "ids")
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("doc_id").alias(row_id),
        F.col("key").alias("row_key"),
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
