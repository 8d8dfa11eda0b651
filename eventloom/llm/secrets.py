"""Secrets in texts: known forms, and strings of high local entropy. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Form(NamedTuple):
    """A kind of secret: its pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int
    least: int


class CharClass(NamedTuple):
    """Characters whose strings are scanned, the least entropy in bits of a window, and sets of characters of each of which a string must hold one."""

    kind: str
    characters: str
    bits: float
    holds: tuple[str, ...]


FORMS = [
    Form("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run that is long enough is a match of these whole; shorter runs can't hold one
    Form("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Form("hex", r"[0-9a-f]{32,}", 0, 32),
]
WINDOW = 20
#: A window of 20 characters holds at most 4.32 bits; random hexadecimal ones hold about 3.2, random base64 ones about 4.1,
#: random ones of one case and digits about 3.8, 3.4 at least in 98 of 100 strings of 20 characters.
CLASSES = [
    CharClass("entropy_hex", "0123456789abcdefABCDEF", 3.0, ("[0-9]", "[a-fA-F]")),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9, ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4, ("[0-9]", "[A-Z]")),
    CharClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4, ("[0-9]", "[a-z]")),
]
#: Strings that look random but are public: UUIDs, digests written with their algorithm's name, paths of words, keys of manuals.
#: A pattern sees a run of a class and suppresses what it matches; the rest of the run is rated. Repeated groups are
#: possessive, as the regular expressions of the JVM recurse at each repetition of others.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^md5-(?:[0-9a-fA-F]{32}|[A-Za-z0-9+/_-]{22})",
    r"^sha1-(?:[0-9a-fA-F]{40}|[A-Za-z0-9+/_-]{27})",
    r"^sha256-(?:[0-9a-fA-F]{64}|[A-Za-z0-9+/_-]{43})",
    r"^sha512-(?:[0-9a-fA-F]{128}|[A-Za-z0-9+/_-]{86})",
    r"^(?:[A-Za-z]++[/_-])++[A-Za-z]++$",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE(?:KEY)?",
    r"AKIA[A-Z0-9]{0,16}EXAMPLE|EXAMPLE(?:KEY)?",
]


#: Values that a block of a running combination holds.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array of whole numbers from 0, the combination (a sum or greatest) of all up to it.

    An array that grows by one is copied each time, so it grows in blocks.
    """
    empty = F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("blocks"), F.array().cast("array<int>").alias("block"))

    def step(a: Column, x: Column) -> Column:
        now, full = combine(a["last"], x), F.size(a.block) >= BLOCK
        blocks, block = F.when(full, F.array_append(a.blocks, a.block)).otherwise(a.blocks), F.when(full, F.array(now)).otherwise(F.array_append(a.block, now))
        return F.struct(now.alias("last"), blocks.alias("blocks"), block.alias("block"))

    return F.aggregate(values, empty, step, lambda a: F.flatten(F.array_append(a.blocks, a.block)))


def found_at(text: Column, pattern: str) -> Column:
    """Array of structs (start, hit) of all matches, leftmost and non-overlapping; positions in code points.

    The pieces between matches and the matches alternate, so a match ends after all pieces and matches up to it.
    """

    def located(own: Column) -> Column:
        gaps, hits = F.split(own, pattern), F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
        pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct((F.length(g) + F.length(h)).alias("length"), h.alias("hit"))), lambda p: p.hit.isNotNull())
        ends = lambda found: running(F.transform(found, lambda p: p.length), lambda x, y: x + y)
        return bound(pairs, lambda found: F.zip_with(ends(found), found, lambda end, p: F.struct((end - F.length(p.hit)).alias("start"), p.hit.alias("hit"))))

    return bound(text, lambda own: F.when(own.rlike(pattern), located(own)).otherwise(F.array().cast("array<struct<start:int,hit:string>>")))


def window_bits(string: Column, window: int = WINDOW) -> Column:
    """The highest entropy of any ``window`` consecutive characters of ``string``; 0 if it has fewer.

    One walk keeps the sum of count * log2(count) over the window's characters: a step changes it by
    the counts of the character that leaves and of the one that enters, and no others.
    """
    plogp = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    table = lambda values: F.array(*map(F.lit, values))
    loss, gain = table([0.0] + [plogp[n - 1] - plogp[n] for n in range(1, window + 1)]), table([plogp[n + 1] - plogp[n] for n in range(window)])
    held = lambda part, c: F.size(part) - F.size(F.array_remove(part, c))

    def move(codes: Column, a: Column, c: Column) -> Column:
        full = a.at >= window
        out = F.when(full, F.get(loss, held(F.slice(codes, a.at - window + 1, F.lit(window)), F.get(codes, a.at - window)))).otherwise(F.lit(0.0))
        kept = F.when(full, F.slice(codes, a.at - window + 2, F.lit(window - 1))).otherwise(F.slice(codes, F.lit(1), a.at))
        total = a["sum"] + out + F.get(gain, held(kept, c))
        return F.struct((a.at + 1).alias("at"), total.alias("sum"), F.when(a.at >= window - 1, F.least(a.least, total)).otherwise(a.least).alias("least"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(plogp[window]).alias("least"))
    return bound(F.split(string, ""), lambda codes: F.aggregate(codes, start, lambda a, c: move(codes, a, c), lambda a: math.log2(window) - a.least / window))


def _form_spans(text: Column, form: Form, order: int) -> Column:
    own = F.transform(
        found_at(text, form.pattern),
        lambda m: F.struct(m.start.alias("start"), F.lit(order).alias("order"), F.lit(form.kind).alias("kind"), (m.start + F.length(m.hit)).alias("end"), F.length(F.regexp_extract(m.hit, form.pattern, form.group)).alias("n")),
    )
    return F.transform(F.filter(own, lambda s: s.n >= form.least), lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.kind.alias("kind"), s.end.alias("end")))


def _blanked(string: Column, pattern: str) -> Column:
    """The string with as many spaces in place of each match."""
    gaps, hits = F.split(string, pattern), F.regexp_extract_all(string, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(h), F.lit(0))))), "")


def _class_runs(text: Column, own: CharClass, order: int, allowed: Sequence[str]) -> Column:
    """Runs of the class that hold what they must, less what is allowed: structs (start, order, end, hit)."""
    inside = "".join("\\" + c if c in "-/+" else c for c in own.characters)
    pattern = f"[{inside}]{{{WINDOW},}}"
    runs = found_at(text, pattern)
    if allowed:
        public = "|".join(allowed)
        left = lambda m: F.transform(found_at(_blanked(m.hit, public), pattern), lambda p: F.struct((m.start + p.start).alias("start"), p.hit.alias("hit")))
        runs = F.flatten(F.transform(runs, lambda m: F.when(m.hit.rlike(public), left(m)).otherwise(F.array(m))))
    mixed = F.filter(runs, lambda m: reduce(Column.__and__, (m.hit.rlike(x) for x in own.holds)))
    return F.transform(mixed, lambda m: F.struct(m.start.alias("start"), F.lit(order).alias("order"), (m.start + F.length(m.hit)).alias("end"), m.hit.alias("hit")))


def _outside(spans: Column, forms: int) -> Column:
    """Of sorted spans, the dense ones that no known form holds: in this order, none of the forms so far reaches as far."""

    def kept(own: Column) -> Column:
        reach = running(F.transform(own, lambda s: F.when(s.order < forms, s.end).otherwise(F.lit(0))), F.greatest)
        return F.transform(F.filter(F.zip_with(own, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: (x.s.order >= forms) & (x.r < x.s.end)), lambda x: x.s)

    return bound(spans, kept)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, forms: Sequence[Form] = FORMS, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All secrets in every whole text: the id, ``base`` (spans of the known forms) and ``spans`` (those and the dense ones).

    A span is a struct (start, order, kind, end) in code points, end exclusive; arrays are ordered by start, then
    by kind as listed. Dense strings are runs of a character class that hold a window of 20
    characters with enough Shannon entropy, less what an allow-list pattern matches, unless
    they lie inside a known form; a run that reaches beyond the form is kept whole. The entropy's counts
    move with the window. Runs of letters only, or of digits only, aren't rated. The work grows with the length of a text, of a run and of the
    number of matches, not with their squares.

    A narrow pass per row, without shuffles; texts without a match of a pattern cost one search.
    Null texts count as empty and have no spans. Repeated rows have equal results. Other columns are not
    read. An empty table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.concat(*[_form_spans(body, f, i) for i, f in enumerate(forms)]))
    rows = docs.select(F.col(row_id), body.alias("body"), base.alias("base"))
    runs = F.concat(*[_class_runs(F.col("body"), c, len(forms) + i, allowed) for i, c in enumerate(classes)])
    known = F.transform("base", lambda b: F.struct(b.start.alias("start"), b.order.alias("order"), b.end.alias("end"), F.lit(None).cast("string").alias("hit")))
    bits, kinds = F.array(*(F.lit(c.bits) for c in classes)), F.array(*(F.lit(c.kind) for c in classes))
    open_ = F.when(F.size("runs") > 0, _outside(F.sort_array(F.concat(known, "runs")), len(forms))).otherwise(F.col("runs"))
    dense = F.filter("open", lambda s: window_bits(s.hit) >= F.get(bits, s.order - len(forms)))
    named = F.transform("dense", lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), F.get(kinds, s.order - len(forms)).alias("kind"), s.end.alias("end")))
    rows = rows.select(row_id, "base", runs.alias("runs")).select(row_id, "base", open_.alias("open")).select(row_id, "base", dense.alias("dense"))
    return rows.select(row_id, "base", F.sort_array(F.concat("base", named)).alias("spans"))


def secret_digest(found: DataFrame, row_id: str = "doc_id", forms: Sequence[Form] = FORMS) -> DataFrame:
    """Counts of the known forms, the SHA-256 of their spans, and all spans as text."""

    def count(form: Form) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == form.kind)).cast("long").alias(f"n_{form.kind}")

    counts = [count(f) for f in forms]
    return found.select(row_id, *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
