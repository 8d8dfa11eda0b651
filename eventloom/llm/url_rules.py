"""URL filters: exact host and path rules, and pattern rules found by their rarest token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import sent

class Pattern(NamedTuple):
    """An action (block or allow) and a pattern over the lower-cased url.

    ``*`` stands for any characters, ``^`` for one that is no letter, digit, or any of
    ``_-.%``, or for the end. Everything else is literal.
    """

    action: str
    pattern: str

    @property
    def regex(self) -> str:
        part = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
        return "".join(part.get(c) or re.escape(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that a matching url must hold as whole tokens."""
        runs = re.finditer(r"[a-z0-9]+", self.pattern)
        whole = [m[0] for m in runs if m.start() > 0 and m.end() < len(self.pattern) and self.pattern[m.start() - 1] != "*" and self.pattern[m.end()] != "*"]
        return sorted(set(whole))


class HostRule(NamedTuple):
    """An action for a host with all its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str


#: What public block lists name: advertising, gambling, adult and counterfeit goods, link farms, malware. A parameter; users bring their own.
PATTERNS = [
    *(Pattern("block", p) for p in ("/ads^*banner", "&ad_id=", "/adserver/", "/adserv/", ".adserver.", "/banners/", "/popunder^", "/doubleclick/", ".doubleclick.", "/clicktracker^")),
    *(Pattern("block", p) for p in ("-casino.", "/casino/", ".casino.", "/gambling/", "/betting-odds/", "/slots-online/", "/payday-loan^", "/payday-loans^")),
    *(Pattern("block", p) for p in ("/xxx/", ".xxx.", "-porn.", "/porn/", "/porno/", "/escorts/", "/camgirls/")),
    *(Pattern("block", p) for p in ("-pills.", "/pills/", "/viagra/", "/cialis/", "/replica-watches/", "/steroids-online/")),
    *(Pattern("block", p) for p in ("//spam-", ".spam-", ".link-farm.", "/link-farm/", "/warez/", "/keygen/", "/cracked-software/", "/phishing-kit/")),
    *(Pattern("allow", p) for p in ("/abuse/report^", "/spam-policy^", "/responsible-gambling^")),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where ``://`` is absent."""
    # [\s\S] and \z, as a url can hold line ends
    host = F.regexp_extract(url, r"\A[\s\S]*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"\A[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The rule with the longest host and path that fits, as struct (rule, action); null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action")),
        )
        for r in ordered
    ]
    return F.coalesce(*fits)


def rarest_tokens(urls: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """The index: of each pattern its rarest whole token, by the number of urls (column tokens) that hold it.

    A pattern without a whole token is filed under the empty token, which every url has.
    """
    spark = urls.sparkSession
    words = sorted({t for p in patterns for t in p.tokens})
    named = spark.createDataFrame([(w,) for w in words], "token string")
    counts = urls.select(F.explode("tokens").alias("token")).join(sent(named), "token").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()}  # at most one row for each of the rules' tokens
    index = [(min(p.tokens, key=lambda t: (seen.get(t, 0), t), default=""), p.action, p.regex) for p in patterns]
    return spark.createDataFrame(index, "token string, action string, regex string")


def filter_urls(pages: DataFrame, rules: Sequence[HostRule], patterns: Sequence[Pattern] = PATTERNS, url: str = "url", row_id: str = "page_id") -> DataFrame:
    """Judge every url: the id column, host, path, rule (of the host rules), verdict and patterns (number that fit).

    The longest host rule that fits decides. Without one, a url is blocked if a block
    pattern fits and no allow pattern does. Patterns are indexed by their rarest literal token;
    a url's tokens fetch candidate patterns by an equality join, and a regular expression
    runs on those candidates only. Up to a million patterns are sent to every executor, so
    no shuffle has a token as its key: one with a third of all pages is no hot key. More are joined by a shuffle. Host rules
    are one expression and meant to be some hundreds. The urls that a pattern fits are folded per url and joined back
    by url, where a very frequent url can be split by adaptive execution.

    Null urls, empty ones and those without ``://`` have empty host and path; patterns still see
    the whole url (null: none fits, allowed). Repeated rows keep a row each, other columns are
    not read. An empty table gives an empty table.
    """
    host, path = url_parts(F.col(url))
    lower = F.translate(F.coalesce(F.col(url), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.filter(F.array_distinct(F.split(lower, "[^a-z0-9]+")), lambda t: t != "")
    rows = pages.select(F.col(row_id).alias("id"), host.alias("host"), path.alias("path"), lower.alias("lower"), split.alias("tokens"))
    index = rarest_tokens(rows, patterns)

    # The distinct urls that hold an index token, with the actions of the patterns that fit.
    tokens = F.explode(F.array_union(F.col("tokens"), F.array(F.lit(""))))
    candidates = rows.select("lower", tokens.alias("token")).join(sent(index), "token")
    fitting = candidates.filter(F.expr("lower rlike regex"))
    judged = fitting.groupBy("lower").agg(F.countDistinct("regex", "action").alias("patterns"), F.max((F.col("action") == "block")).alias("blocks"), F.max((F.col("action") == "allow")).alias("allows"))
    out = rows.join(judged, "lower", "left").withColumn("own", host_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("blocks") & ~F.col("allows"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(row_id), "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.action"), method).alias("verdict"), F.coalesce(F.col("patterns"), F.lit(0)).cast("long").alias("patterns"))
