"""Set-similarity join of texts on word n-grams, by prefixes of single tokens and of token combinations.

A text's set holds 64-bit hashes of its word n-grams, its tokens. With Jaccard similarity
of at least t, a set of n tokens lacks at most m = n - ceil(t * n) of them in its partner, and
both together differ in at most d = floor((1 - t) / t * n) tokens. Tokens are ordered by hash, and a token
is frequent if more than FREQUENT sets hold it where it is counted.

* Round 1 takes the tokens below a share of the hash space that depends on a set's size alone, a little more
  than 1 - t. A set with more than m rare tokens there indexes these: a similar set has one of them (prefix filter).
* Round 2 takes the other sets alone, with longer prefixes in which tokens are counted anew. A set
  indexes its rare tokens one by one. If it has too few of them, it also indexes its frequent ones in combinations of
  up to three neighbours: with x of these tokens absent from the partner and y others among the partner's, at most
  k * x + (k - 1) * y of the combinations break, and the prefix is long enough that one stays whole in both.

Pairs are counted by shared rare tokens, so few that aren't similar remain to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .rows import sent
from .scratch import remove, write_out
from .texts import Chunk, chunks, mix

#: Sets that hold a token or combination, above which no pairs are made of them.
FREQUENT = 8
#: Tokens in a combination, at most.
COMBINED = 3
#: Bits of the map that tells which rows a later scan needs: so many for each key, and in all.
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Sets of one family that a task verifies against as many others, and tokens in them.
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 20


def limits(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """m and d of the module's text, for sets of n tokens."""
    p, q = t.numerator, t.denominator
    return n - (n * p + q - 1) // q, (n * (q - p)) // p


def share(n, t: Fraction):
    """The part of the hash space whose tokens a set of n tokens must index; it falls with n. For arrays and columns."""
    return 1.25 * float(1 - t) + 5.0 / n


def _highest(part):
    """The largest token of that part of the hash space, as a double."""
    return (part - 0.5) * 2.0**64


def region(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Tokens by hash, of the second round, among which a set counts its rare ones."""
    m, _ = limits(n, t)
    return m + m // 2 + 5


def extended(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Tokens by hash that the second round takes of a set: enough for combinations, and beyond the region of any similar set."""
    m, d = limits(n, t)
    largest = n * t.denominator // t.numerator + 1
    return np.minimum(n, np.maximum(COMBINED * (m + 1) + (COMBINED - 1) * (d - m), region(largest, t) + m))


def combined(n: np.ndarray, t: Fraction) -> np.ndarray:
    """The largest k up to COMBINED for which a pair whose smaller set has n tokens surely shares a combination of k."""
    m, d = limits(n, t)
    out = np.ones(len(n), np.int64)
    for k in range(2, COMBINED + 1):
        out = np.where(k * (m + 1) + (k - 1) * (d - m) <= n, k, out)
    return out


def _sizes_of_combinations(n: np.ndarray, t: Fraction) -> list[list[int]]:
    """For each set, every k that it needs for a partner of whatever size."""
    p, q = t.numerator, t.denominator
    found: dict[int, list[int]] = {}
    for x in set(n.tolist()):
        found[x] = sorted(set(combined(np.arange((x * p + q - 1) // q, x + 1), t).tolist()))
    return [found[x] for x in n.tolist()]


def _tokens_of(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and token, sorted and each once, of a chunk's texts."""
    c.words()
    own = c.hashes(c.starts, c.ends, lower=True)
    at, tokens = c.windows(own, words)
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < words))
    whole = np.array([_sequence(own[c.first[r] : c.first[r + 1]]) for r in short], np.uint64)
    row, tokens = np.concatenate((c.row[at], short)), np.concatenate((tokens, whole)).view(np.int64)
    order = np.lexsort((tokens, row))
    row, tokens = row[order], tokens[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (tokens[1:] != tokens[:-1])
    return row[fresh], tokens[fresh]


def _sequence(hashes: np.ndarray) -> np.uint64:
    total = np.full(1, len(hashes), np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(3) + h)
    return total[0]


def shingle_sets(docs: DataFrame, words: int, t: Fraction, text: str, row_id: str, part: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(doc_id, key, n, sid, below, ks, tokens) of each row: a hash of id and text, and its set's size, hash and tokens in order.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words is one
    token. part: ``first`` gives the tokens that any similar set indexes in round 1, and below, how many of them this
    set does; ``extended`` the prefix of round 2, and ks, the sizes of its combinations; ``all`` every token.
    With ``wanted``, a bit map of keys, only rows whose key may be in it.
    """
    id_type = docs.schema[row_id].dataType.simpleString()
    bits = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None
    p, q = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                at = batch.column(2).to_numpy() & (64 * len(bits.value) - 1)
                batch = batch.filter(pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for c in chunks(batch.column(1)):
                row, tokens = _tokens_of(c, words)
                n = np.bincount(row, minlength=c.n_rows)
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens.view(np.uint64)))))
                sid = mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64)).view(np.int64)
                below, ks = np.zeros(c.n_rows, np.int64), [[]] * c.n_rows
                if part == "first":
                    many = np.maximum(n, 1)
                    own = tokens <= _highest(share(many, t))[row]
                    below = np.bincount(row[own], minlength=c.n_rows)
                    kept = tokens <= _highest(share((many * p + q - 1) // q, t))[row]
                elif part == "extended":
                    kept = (np.arange(len(row)) - ends[row]) < extended(n, t)[row]
                    ks = _sizes_of_combinations(n, t)
                else:
                    kept = np.ones(len(row), bool)
                tokens, ends = tokens[kept], np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=c.n_rows))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int64()))
                ids, keys = (batch.column(i).slice(c.first_row, c.n_rows) for i in (0, 2))
                out = [ids, keys, pa.array(n, pa.int64()), pa.array(sid), pa.array(below, pa.int64()), pa.array(ks, pa.list_(pa.int32())), lists]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "key", "n", "sid", "below", "ks", "tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(row_id), body.alias("body"), F.xxhash64(F.col(row_id), body).alias("key"))
    return read.mapInArrow(run, f"doc_id {id_type}, key long, n long, sid long, below long, ks array<int>, tokens array<long>")


def bit_map(keys: DataFrame) -> np.ndarray:
    """Words of 64 bits, set for the low bits of each key: 16 bits for each key, 16 MB at most however many there are."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_A_KEY * keys.count()):
        bits <<= 1
    low = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    word = low.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(bits // 64, np.uint64)
    found = word.toPandas()
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return out


def _lacked(t: Fraction) -> Column:
    """m of column n."""
    n, p, q = F.col("n"), t.numerator, t.denominator
    return n - F.floor((n * p + (q - 1)) / q)


def _pairs(held: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, shared): pairs of sets with a key in common, of sizes that allow a link; ``held``: (key, sid, n), at most FREQUENT sets of a key."""
    p, q = t.numerator, t.denominator
    groups = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "sid"))).alias("held")).filter(F.size("held") > 1)
    one = groups.select("held", F.posexplode("held").alias("at", "x"))
    two = one.select("x", F.explode(F.filter(F.slice("held", F.col("at") + 2, FREQUENT), lambda y: y.n * p <= F.col("x.n") * q)).alias("y"))
    return two.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _enough(pairs: DataFrame, needs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many keys as one of them needs, at least one of which needs any."""
    need = lambda x: needs.select(F.col("sid").alias(x), F.col("need").alias(f"need_{x}"))
    both = pairs.join(need("a"), "a").join(need("b"), "b").withColumn("need", F.greatest("need_a", "need_b"))
    return both.filter((F.col("need") > 0) & (F.col("shared") >= F.col("need"))).select("a", "b")


def candidate_edges(first: DataFrame, extend: Callable[[DataFrame], DataFrame], t: Fraction) -> DataFrame:
    """Edges (a, b) that join any two different sets which may be similar, directly or through others.

    ``first``: (sid, key, n, below, tokens), each set once, with its tokens of round 1; ``extend`` gives (sid, n, ks,
    tokens) of round 2 for some of them. A set that needs some of its rare tokens in a partner shares
    that many with any similar one. Combinations of more than FREQUENT sets give a star.
    """
    emitted = first.select("sid", "n", F.explode("tokens").alias("token"))
    shared = write_out(_shared(emitted), "join-shared")
    known = write_out(emitted.join(shared, "token"), "join-first")
    within = F.col("token").cast("double") <= _highest(share(F.col("n"), t))
    often = known.filter(F.col("frequent") & within).groupBy("sid").agg(F.count(F.lit(1)).alias("often"))
    counts = first.select("sid", "key", "n", "below").join(often, "sid", "left")
    needs = write_out(counts.select("sid", "key", (F.col("below") - F.coalesce("often", F.lit(0)) - _lacked(t)).alias("need")), "join-needs")
    single = known.filter("not frequent").select(F.col("token").alias("key"), "sid", "n")
    found = write_out(_enough(_pairs(single, t), needs), "join-pairs")

    rest = write_out(extend(needs.filter("need <= 0").select("sid", "key")), "join-rest")
    more = rest.select("sid", "n", F.posexplode("tokens").alias("at", "token"))
    again = write_out(_shared(more), "join-shared")
    marked = write_out(more.join(again, "token"), "join-marked")
    near = F.floor(_lacked(t) / 2) + _lacked(t) + 5  # as region()
    inside = marked.filter(F.col("frequent") & (F.col("at") < near)).groupBy("sid").agg(F.count(F.lit(1)).alias("often"))
    left = rest.select("sid", "n", F.least(F.size("tokens"), near).alias("below")).join(inside, "sid", "left")
    needed = write_out(left.select("sid", (F.col("below") - F.coalesce("often", F.lit(0)) - _lacked(t)).alias("need")), "join-needs")
    rare = marked.filter("not frequent").select(F.col("token").alias("key"), "sid", "n")
    seconds = _enough(_pairs(rare, t), needed)

    poor = rest.select("sid", "n", "ks").join(needed.filter("need <= 0").select("sid"), "sid")
    often = marked.filter("frequent").select("sid", "token").join(poor, "sid").groupBy("sid", "n", "ks").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    runs = often.select("sid", "n", "tokens", F.explode("ks").alias("k")).filter(F.size("tokens") >= F.col("k"))
    keys = F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("k") + 1), lambda i: F.xxhash64("k", F.slice("tokens", i, F.col("k"))))
    index = write_out(runs.select("sid", "n", F.explode(keys).alias("key")), "join-index")
    sizes = write_out(index.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("sid").alias("least")).filter("held > 1"), "join-sizes")
    of = index.join(sent(sizes), "key")
    stars = of.filter(F.col("held") > FREQUENT).select(F.col("sid").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    some = _pairs(of.filter(F.col("held") <= FREQUENT).select("key", "sid", "n"), t).select("a", "b")
    edges = write_out(found.union(seconds).union(some).union(stars).distinct(), "join-edges")
    remove(shared, known, needs, found, rest, again, marked, needed, index, sizes)
    return edges


def _shared(emitted: DataFrame) -> DataFrame:
    """(token, frequent) of the tokens that two sets or more hold."""
    held = emitted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return held.select("token", (F.col("df") > FREQUENT).alias("frequent"))


def _links(t: Fraction):
    """Of the sets of two blocks (or of one): a spanning forest of the links among them, each with its sets' sizes."""
    p, q = t.numerator, t.denominator

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = frame["i"].iloc[0] == frame["j"].iloc[0]
        frame = frame.sort_values(["own", "n", "sid"], kind="stable")
        sids, n = frame["sid"].to_numpy(), frame["n"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        _, token, counts = np.unique(np.concatenate(frame["tokens"].to_numpy()), return_inverse=True, return_counts=True)
        shared = counts[token] > 1
        row, token = row[shared], token[shared]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        overlap = np.zeros((len(n), len(n)), np.float32)
        step = 1 << 12
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, step):
            lo, hi = np.searchsorted(token, (at, at + step))
            if lo < hi:
                present = np.zeros((len(n), step), np.float32)
                present[row[lo:hi], token[lo:hi] - at] = 1
                used = present.any(0)
                present = present[:, used]
                overlap += present @ present.T
        both = overlap.astype(np.int64)
        linked = np.triu(both * q >= (n[:, None] + n[None, :] - both) * p, 1)
        if not same:
            side = frame["own"].to_numpy() == frame["i"].iloc[0]
            linked &= side[:, None] != side[None, :]
        degree = linked.sum(0) + linked.sum(1)
        root = list(range(len(n)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for x, y in zip(*np.nonzero(linked)):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                kept.append((sids[x], sids[y]))
        out = pd.DataFrame(kept, columns=["a", "b"]).astype("int64") if kept else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        counted = pd.DataFrame({"a": sids, "b": sids, "links": degree.astype(np.int64)})
        return pd.concat([out.assign(links=0), counted[counted["links"] > 0]])

    return run


def similar_sets(first: DataFrame, extend: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame], t: Fraction) -> DataFrame:
    """(a, b, links): of every pair of blocks a spanning forest of its links, and rows (a, a, links) that add up to each set's number of links.

    Candidates form families; a family's sets are cut into blocks by size and hash, and a
    task compares two blocks whose sizes allow a link, exactly. So all links are
    found, a set is shipped once for each block it may meet, and a family of thousands of near copies spreads over
    tasks without a row for each pair.
    """
    edges = candidate_edges(first, extend, t)
    family = write_out(connected_components(edges), "join-families")
    own = write_out(first.select("sid", "key", "n").join(family.select(F.col("node").alias("sid"), F.col("component").alias("family")), "sid"), "join-members")
    # A histogram of (family, n) gives where each size begins; equal sizes spread over their blocks by hash.
    counts = own.groupBy("family", "n").agg(F.count(F.lit(1)).alias("count"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.col("n"))))
    before = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size that occurs
    blocks = F.col("count") / room
    starts = write_out(counts.select("family", "n", blocks.alias("blocks"), F.coalesce(F.sum(blocks).over(before), F.lit(0.0)).alias("start")), "join-starts")
    spread = F.pmod(F.xxhash64("sid", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    ranked = own.join(sent(starts), ["family", "n"]).select("family", "sid", "key", "n", F.floor(F.col("start") + spread * F.col("blocks")).alias("block"))
    ranked = write_out(ranked, "join-blocks")
    spans = ranked.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("held"))
    p, q = t.numerator, t.denominator
    x = spans.select("family", F.col("block").alias("i"), F.col("high").alias("hi"), F.col("held").alias("ni"))
    y = spans.select("family", F.col("block").alias("j"), F.col("low").alias("lo"), F.col("held").alias("nj"))
    meet = x.join(y, "family").filter((F.col("i") <= F.col("j")) & (F.col("lo") * p <= F.col("hi") * q) & ((F.col("i") != F.col("j")) | (F.col("ni") > 1)))
    sides = meet.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    members = ranked.select("family", F.col("block").alias("own"), "sid", "key").join(sides, ["family", "own"])
    shipped = members.join(whole(own.select("sid", "key")), ["sid", "key"]).drop("key")
    linked = write_out(shipped.groupBy("family", "i", "j").applyInPandas(_links(t), "a long, b long, links long"), "join-links")
    remove(edges, family, own, starts, ranked)
    return linked


def ngram_components(docs: DataFrame, words: int = 5, threshold: str = "0.8", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Near copies among all rows: the id, ``n_shingles``, ``links``, ``component_id`` and ``component_key``.

    Also ``row_key``, a hash of id and text. Two rows link when the Jaccard similarity of their sets of word n-grams is at least
    ``threshold`` (a decimal string, compared exactly in whole numbers). ``links`` counts
    the different sets that link with the row's own; equal sets are one class. ``component_id`` is the
    least id that links reach, ``component_key`` the row_key of that row (the least key if several rows have the id, or none has one).

    Rows with equal sets are one set from the start, so a group of exact copies costs one
    set however large it is. Tokens and sets are told apart by 64-bit hashes.

    Null and empty texts, and texts without words, have an empty set and link with nothing; they are
    their own component. Rows with a null id take part; a component of such rows only has a null id.
    Repeated rows share a component. Other columns are not read. An empty table gives an empty table.
    """
    t = Fraction(threshold)
    rows = write_out(shingle_sets(docs, words, t, text, row_id, "first").drop("ks"), "join-rows")
    filled = rows.filter("n > 0")
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("key"))).alias("f")
    by_set = write_out(filled.groupBy("sid").agg(first_of), "join-classes")
    one = by_set.select("sid", F.col("f.key").alias("key"))
    first = write_out(filled.join(one, ["sid", "key"]).groupBy("sid", "key").agg(*(F.first(c).alias(c) for c in ("n", "below", "tokens"))), "join-sets")

    def again(some: DataFrame, part: str) -> DataFrame:
        """Tokens of the sets of ``some`` (sid, key), each once: only rows whose key is in a bit map leave the scan."""
        found = shingle_sets(docs, words, t, text, row_id, part, bit_map(some))
        return found.join(some, ["sid", "key"]).groupBy("sid", "key").agg(*(F.first(c).alias(c) for c in ("n", "ks", "tokens")))

    linked = similar_sets(first, lambda some: again(some, "extended"), lambda some: again(some, "all").drop("ks"), t)
    parts = write_out(connected_components(linked.select("a", "b")), "join-components")
    least = write_out(by_set.join(parts.withColumnRenamed("node", "sid"), "sid").groupBy("component").agg(F.min("f").alias("c")), "join-least")
    of_set = parts.join(sent(least), "component").select(F.col("node").alias("sid"), "c")
    links = linked.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    found = write_out(by_set.join(of_set, "sid", "left").join(links, "sid", "left").select("sid", F.coalesce("c", "f").alias("c"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "join-found")
    remove(first, by_set, linked, parts, least)
    own = rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(found, "sid", "left")
    return own.select(
        F.col("doc_id").alias(row_id),
        F.col("key").alias("row_key"),
        F.col("n").alias("n_shingles"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.when(F.col("n") > 0, F.col("c.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("c.key")).otherwise(F.col("key")).alias("component_key"),
    )
