"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048
TOXIC = 0.7
GOOD = 0.5


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    dealt = shard_by_bytes(_read(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .fertility import fertility

    measured = fertility(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measures = ["n_tokens", "chars_per_token", "byte_share", "entropy", "evenness", "band"]
    return measured.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("fertile")).alias("kept"), *measures)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("row_key")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import ngram_components

    return ngram_components(_read(spark, sf_dir, "documents"), words=3, threshold="0.9").select("doc_id", "n_shingles", "component_id", "links")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, secret_digest

    return secret_digest(find_secrets(_read(spark, sf_dir, "documents")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score_toxicity, train_toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotraining import score_quality, train_quality
    from .toxicity import held_out

    docs = _read(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels"), held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= GOOD).alias("kept"))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import HostRule, filter_urls

    rules = [HostRule("block", "com", "/en/"), HostRule("allow", "example.com", "/en/7"), HostRule("allow", "net", "/de/"), HostRule("block", "example.net", "/de/8"), HostRule("block", "org", "/es/")]
    return filter_urls(_read(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shard": op1_shard,
        "op2_fertility": op2_fertility,
        "op3_decontaminate": op3_decontaminate,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_secrets": op5_secrets,
        "op6_mix": op6_mix,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_filter_urls": op9_filter_urls,
        "op10_token_counts": op10_token_counts,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) u(p) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id)"""

_OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS digest FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y, ny.digest AS dy, nx.digest AS dx FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
near AS (SELECT x, count(DISTINCT dy) AS links FROM links WHERE dx <> dy GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id, coalesce(near.links, 0) AS links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id LEFT JOIN near ON near.x = d.doc_id"""


def _op9() -> str:
    from .url_rules import PATTERNS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(p.action)}, {quoted(p.regex)})" for p in PATTERNS)
    host, path = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1)", r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1)"
    rules = "('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')"
    return f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(coalesce(url, '')) AS low, lower({host}) AS host, {path} AS path FROM pages),
rules(action, h, t) AS (VALUES {rules}), patterns(action, regex) AS (VALUES {values}),
fits AS (SELECT r, h || t AS rule, rules.action, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(t) DESC) AS k FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)),
met AS (SELECT r, count(*) AS patterns, bool_or(patterns.action = 'block') AS blocks, bool_or(patterns.action = 'allow') AS allows FROM p JOIN patterns ON regexp_matches(low, regex) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(fits.action, CASE WHEN blocks AND NOT allows THEN 'block' ELSE 'allow' END) AS verdict, coalesce(patterns, 0) AS patterns
FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) fits USING (r) LEFT JOIN met USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op4_jaccard_join": _OP4, "op9_filter_urls": _op9()}
