"""Plain-loop versions of whole results, clashing names, null and empty tables, and long inputs."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from . import brute
from .test_operators import SF, edge_rows, make_docs, sample


def test_hashes_of_patterned_words_differ():
    from eventloom.llm.texts import chunks

    for n in (1024, 2048, 4096):
        word = "".join("ab"[i.bit_count() & 1] for i in range(n))
        (chunk,) = chunks(pa.array([word + " " + word.translate(str.maketrans("ab", "ba")) + " " + word]))
        chunk.words()
        one, other, again = chunk.hashes(chunk.starts, chunk.ends).tolist()
        assert one == again != other


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_vocabularies_that_need_whole_texts(spark, name):
    import public_tokenizers

    from eventloom.llm.token_counts import encoder, token_counts

    path = str(public_tokenizers.path(name))
    rows = [(d, t) for d, t in edge_rows() if d is not None and len(t or "") < 10_000]
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts(make_docs(spark, rows), path).collect())
    encode = encoder(path)
    assert got == sorted((d, encode([t or ""])[0]) for d, t in rows)


def test_fertility_against_loops(spark):
    import public_tokenizers
    import sentencepiece

    from eventloom.llm.fertility import BANDS, EVEN_TOKENS, fertility

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(d, t) for d, t in edge_rows() + sample(spark, "documents") if d != 200]
    rows += [(500, "слово за словом " * 9), (501, "汉字 假名 " * 9), (502, "word$$$ by*** word&&& and### sign%%% " * 9), (503, "▒▓█◄► ⠁⠂ ")]
    docs = make_docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 5 == 0, "xx"))
    seen = Counter()
    text_of = {}
    for d, t in rows:
        text_of.setdefault((d, len(brute.WORD.findall(t or "")), brute.quality_base(t)[1]), t)
    for r in fertility(docs, path).collect():
        text = text_of[(r.doc_id, r.n_words, r.word_chars)] or ""
        words = brute.WORD.findall(text)
        ids = [i for w in words for i in model.encode(w)]
        counts = Counter(ids).values()
        bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts)
        share = sum(map(model.is_byte, ids)) / max(len(ids), 1)
        per = sum(map(len, words)) / max(len(ids), 1)
        even = bits / math.log2(min(max(len(ids), 2), EVEN_TOKENS))
        assert (r.n_tokens, r.chars_per_token, r.byte_share) == (len(ids), pytest.approx(per), pytest.approx(share))
        assert (r.entropy, r.evenness) == (pytest.approx(bits, abs=1e-9), pytest.approx(even, abs=1e-9))
        band = BANDS[r.band]
        inside = band.chars_per_token[0] <= per <= band.chars_per_token[1] and share <= band.byte_share and band.evenness[0] <= even <= band.evenness[1]
        assert r.fertile == (inside or not ids)
        assert (r.band == "en") == (r.doc_id is not None and r.doc_id % 2 == 0)
        seen[r.fertile] += 1
    assert min(seen.values()) > 3
    assert fertility(make_docs(spark, []), path).count() == 0


def _plain_spans(text):
    """All spans as written: known forms, then runs of each class less what is allowed, that hold a window of enough entropy."""
    from eventloom.llm.secrets import ALLOWED, CLASSES, WINDOW

    base = [(m.start(), 0, "assign", m.end()) for m in brute.ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    public, found = re.compile("|".join(ALLOWED)), list(base)
    for order, own in enumerate(CLASSES, 3):
        run_of = re.compile("[" + re.escape(own.characters) + "]{%d,}" % WINDOW)
        for run in run_of.finditer(text):
            left = public.sub(lambda m: " " * len(m[0]), run[0])
            for m in run_of.finditer(left):
                start, end = run.start() + m.start(), run.start() + m.end()
                if not all(re.search(x, m[0]) for x in own.holds) or any(b[0] <= start and end <= b[3] for b in base):
                    continue
                bits = max(-sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(m[0][i : i + WINDOW]).values()) for i in range(len(m[0]) - WINDOW + 1))
                if bits >= own.bits - 1e-12:
                    found.append((start, order, own.kind, end))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secret_spans_against_loops(spark):
    from eventloom.llm.secrets import find_secrets, secret_digest

    draw = random.Random(4)
    alphabets = ["0123456789abcdef", "ABCDEFabcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "abcDEF123"]
    extra = ["AKIA", "EXAMPLEKEY", "password=", "é ", " ", "sha256-", "token: '", "path/to/", "-", "md5-"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(1, 8)):
            own = draw.choice(alphabets)
            parts += [draw.choice(extra), "".join(draw.choice(own) for _ in range(draw.randint(5, 60)))]
        rows.append((i, "".join(parts)))
    rows += [(d, t) for d, t in edge_rows() if d is not None and d > 200]
    got = {r.doc_id: r.spans for r in secret_digest(find_secrets(make_docs(spark, rows))).collect()}
    for d, t in rows:
        assert got[d] == _plain_spans(t or ""), d


def test_secrets_in_long_runs_take_no_square_of_time(spark):
    from eventloom.llm.secrets import find_secrets, secret_digest

    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    rows = [(1, "".join(draw.choice(letters) for _ in range(100_000))), (2, "password=abcdefgh " * 100_000), (3, "aBc/" * 50_000 + "x1"), (4, "AKIA" * 25_000), (5, "aBc" * 40_000)]
    began = time.time()
    got = {r.doc_id: r for r in secret_digest(find_secrets(make_docs(spark, rows))).collect()}
    assert time.time() - began < 240
    assert got[1].spans == "entropy_base64:0:100000" and got[2].n_assign == 100_000 and got[4].spans == "access:0:100000" and not got[5].spans


def test_shards_do_not_depend_on_partitions(spark):
    from eventloom.llm.sharding import shard_by_bytes

    rows = [(i, f"text {i * 7919 % 4001} " * (i % 13)) for i in range(3000)] + [(None, "x")] * 3
    docs = make_docs(spark, rows)
    plain = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect() if r.doc_id is not None)
    one = shard_by_bytes(docs, 8)
    sums = [r.b for r in one.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sums) - min(sums) <= 0.001 * sum(sums)
    before = plain(one)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert plain(shard_by_bytes(docs.repartition(5), 8)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_toxicity_scores_against_loops(spark):
    from eventloom.llm.toxicity import candidate_strings, score_toxicity, train

    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    model = train([(texts[d], labels[d]) for d in sorted(labels) if d in texts])
    rows = [(d, t) for d, t in edge_rows() if d is not None and d != 200] + [(5000 + d, texts[d]) for d in sorted(labels) if d in texts][:150]
    strings = sorted({s for _, t in rows for s in candidate_strings(t or "")})
    margin = dict(zip(strings, model.features(strings) @ model.weights + model.bias))
    for r in score_toxicity(make_docs(spark, rows).withColumn("row", F.lit(1)), model, score="_tox").collect():
        assert r["score"] == -1 and r["row"] == 1
        want = max([model.bias, *(margin[s] for s in candidate_strings(r.text or ""))])
        assert r["_tox"] == pytest.approx(float(model.chance(np.array([want]))[0]), abs=2e-3)


def test_quality_scores_against_loops_and_odd_rows(spark):
    from eventloom.llm.cotraining import meta_features, score_quality, text_features, train_quality
    from eventloom.llm.texts import chunks

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (90007, "", "en", "s", -5), (90007, "", "en", "s", -5), (90008, "long " * 30_000, None, "s", 150_000)], docs.schema)
    docs = docs.unionByName(odd)
    for name in ("label", "fold", "text_view", "row_id", "view", "id"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(90007, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    views = train_quality(docs, labels)
    got = {r.doc_id: r for r in score_quality(docs, views).collect()}
    assert len(got) > 100
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    for i in range(0, len(frame), 7):
        own = frame.iloc[i : i + 1]
        (chunk,) = chunks(pa.array([own["text"].iloc[0]], pa.string()))
        text, meta, both = views.scores(text_features(chunk), meta_features(own))
        doc = own["doc_id"].iloc[0]
        r = got[None if doc is None or doc != doc else int(doc)]
        assert (r.text_score, r.meta_score, r.score) == (pytest.approx(text[0]), pytest.approx(meta[0]), pytest.approx(both[0]))
    assert score_quality(docs.limit(0), views).count() == 0
    assert train_quality(docs.limit(0), labels) is None and train_quality(docs, labels.limit(0)) is None
    assert {r.score for r in score_quality(docs.limit(3), None).collect()} == {1.0}


def test_components_of_stars_and_chains(spark):
    from eventloom.llm.components import connected_components

    draw = random.Random(6)
    edges = [(5000, i) for i in range(1, 800)] + [(i, i + 1) for i in range(6000, 6200)] + [(draw.randint(7000, 7300), draw.randint(7000, 7300)) for _ in range(200)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("few", [True, False])
def test_components_write_few_files_for_few_edges(spark, monkeypatch, few):
    from eventloom.llm import components, rows

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    files, write_out = {}, components.write_out

    def written(df, name):
        out = write_out(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "write_out", written)
    if not few:
        monkeypatch.setattr(components, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(rows, "BROADCAST_KEYS", 0)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    # a round's tables have one file each, and the minima are only written if they are many
    assert max(files["components"][1:] + files["components-down"]) == 1
    assert ("components-least" in files) != few


def test_training_holds_no_copy_of_its_rows():
    import tracemalloc

    from eventloom.llm import toxicity as T

    draw = np.random.default_rng(3)
    features, root = draw.random((30_000, 40), np.float32), draw.random((40, 40))
    at, y, weight = np.arange(30_000), np.where(features[:, 0] > 0.5, 1.0, -1.0), np.ones(30_000)
    x = T._mapped(features, at, root)
    assert np.allclose(x, features @ root)
    tracemalloc.start()
    w = T._svm(x, y, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
    x1 = np.hstack([x, np.ones((len(x), 1))])
    active = y * (x1 @ w) < 1
    gradient = x1[active].T @ (x1[active] @ w - y[active]) + np.diag([1e-3] * 40 + [1e-6]) @ w
    assert abs(gradient).max() < 1e-2 and (np.sign(x1 @ w) == y).mean() > 0.95


def test_stages_keep_other_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    base = " ".join(f"w{i}" for i in range(80))
    rows = [(6, base), (6, base + " more"), (None, base + " else"), (None, "other " + " ".join(f"x{i}" for i in range(60))), (None, "another " + " ".join(f"x{i}" for i in range(60))), (1, None), (2, ""), (2, ""), (3, "lone words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), -5.0, i, i, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double, times int, row_key int, component_key int")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, str(tmp_path)).collect()
        if name in ("toxicity", "benchmark_decontamination"):
            assert sorted((str(r.doc_id), r.score, r.times, r.row_key) for r in out) == sorted((str(d), -5.0, i, i) for i, (d, _) in enumerate(rows))
        if name == "ngram_jaccard_join":
            assert sorted((r.doc_id or 0, bool(r.text)) for r in out) == [(0, True), (1, False), (2, False), (2, False), (3, True), (6, True)]
        if name == "mixing":
            times = Counter(r.times for r in out)
            assert all(n <= 2 for n in times.values()) and all(r.score == -5.0 and r.row_key == r.times for r in out)
            assert sum(len((r.text or "").split()) for r in out) == pytest.approx(1.5 * sum(len((t or "").split()) for _, t in rows), abs=90)
        if name == "sharding":
            assert len(out) == len(rows)


def test_large_benchmarks_give_the_same(spark, monkeypatch):
    from eventloom.llm import winnowing

    rows = [(d, t) for d, t in edge_rows() if d is not None and d != 200]
    bench = spark.createDataFrame([(1, rows[5][1]), (2, "alpha Beta"), (3, rows[-4][1])], "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in winnowing.decontaminate(make_docs(spark, rows), bench).collect())
    few = found()
    monkeypatch.setattr(winnowing, "SET_SIZE", 0)
    assert found() == few and any(r[-1] for r in few)


def test_families_of_many_blocks(spark, monkeypatch):
    from eventloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = f"v{draw.randint(0, 6)}"
        rows.append((i, " ".join(own[: draw.randint(80, 90)])))
    got = {r.doc_id: r for r in jaccard_join.ngram_components(make_docs(spark, rows), 3, "0.8").collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_components(rows, 3, "0.8")
    sets = {d: frozenset(brute.shingles(t, 3)) for d, t in rows}
    for d, s in sets.items():
        assert got[d].links == len({x for x in sets.values() if x != s and 10 * len(s & x) >= 8 * len(s | x)})
