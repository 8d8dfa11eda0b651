"""A quality classifier by co-training: one view reads the text, one the row's metadata."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import remove, write_out
from .texts import Chunk, chunks

#: Labelled rows that training reads at most.
LABELLED_ROWS = 6000
#: Rounds, each of which looks at every unlabelled row, and the rows that a view labels in each: the surest of either class.
ROUNDS, PSEUDO_LABELS = 2, 400
#: A view hands over rows of which it is at least so sure.
CONFIDENT = 0.9
#: Slots for hashed values of a metadata column, and for hashed words.
SLOTS, WORD_SLOTS = 64, 256

_SHAPES = 7
_SHAPE = np.full(256, 5, np.uint8)  # other signs
_SHAPE[list(range(97, 123)) + list(range(128, 256))] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2
_SHAPE[[9, 11, 12, 13, 32]] = 3
_SHAPE[10] = 4
_SHAPE[list(b".,;:!?'\"()-")] = 6
TEXT_FEATURES = WORD_SLOTS + _SHAPES**2 + 3
META_FEATURES = 2 * SLOTS + 12


def text_features(chunk: Chunk) -> np.ndarray:
    """Of each row: shares of its words by hash, of pairs of neighbouring character shapes, and how words repeat; nothing of its length."""
    n = chunk.n_rows
    shape = _SHAPE[chunk.data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(chunk.bounds))
    out = np.zeros((n, TEXT_FEATURES))
    shared = lambda counts: np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    if len(shape) > 1:
        inside = row[1:] == row[:-1]
        pair = (row[:-1] * _SHAPES**2 + shape[:-1] * _SHAPES + shape[1:])[inside]
        out[:, WORD_SLOTS:-3] = shared(np.bincount(pair, minlength=n * _SHAPES**2).reshape(n, -1))
    chunk.words()
    words = np.maximum(chunk.n_words, 1)
    if len(chunk.starts):
        hashes = chunk.hashes(chunk.starts, chunk.ends, lower=True)
        slot = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
        out[:, :WORD_SLOTS] = shared(np.bincount(chunk.row * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, -1))
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (chunk.row[1:] == chunk.row[:-1])))
        length = np.bincount(chunk.row, chunk.ends - chunk.starts, minlength=n) / words
        key = hashes ^ (chunk.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(chunk.row[np.unique(key, return_index=True)[1]], minlength=n) / words
        out[:, -3:] = np.stack([length / 10, distinct, np.bincount(chunk.row[same], minlength=n) / words], 1)
    return out


def meta_features(meta: pd.DataFrame) -> np.ndarray:
    """Hashed language and source, and the length the row states; none of the text."""
    out = np.zeros((len(meta), META_FEATURES))
    for at, name in ((0, "lang"), (SLOTS, "source")):
        slots = {v: crc32(str(v).encode()) % SLOTS for v in meta[name].unique()}
        out[np.arange(len(meta)), at + meta[name].map(slots).to_numpy(int)] = 1
    size = np.log1p(pd.to_numeric(meta["n_chars"]).fillna(0).clip(lower=0).to_numpy(float))
    bins = np.clip(size.astype(int), 0, 10)
    out[np.arange(len(meta)), 2 * SLOTS + bins] = 1
    out[:, -1] = size / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights and bias of a ridge logistic regression with balanced labels, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + penalty, x1.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sure(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Views(NamedTuple):
    """Weights of both views, and of the logistic curve that calibrates and combines their log-odds."""

    text: np.ndarray
    meta: np.ndarray
    combine: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = np.stack([text @ self.text[:-1] + self.text[-1], meta @ self.meta[:-1] + self.meta[-1]], 1)
        return _sure(text, self.text), _sure(meta, self.meta), _sure(np.clip(odds, -12, 12), self.combine)


class Taught:
    """The rows that both views learn from: features, and each view's own labels (-1 for none)."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray) -> None:
        self.x, self.y = {"text": text, "meta": meta}, {"text": label.copy(), "meta": label.copy()}

    def add(self, text: np.ndarray, meta: np.ndarray, for_text: np.ndarray, for_meta: np.ndarray) -> None:
        """Rows with the labels that each view gets from the other."""
        for view, rows, labels in (("text", text, for_text), ("meta", meta, for_meta)):
            self.x[view], self.y[view] = np.vstack([self.x[view], rows]), np.concatenate([self.y[view], labels])

    def weights(self, view: str) -> np.ndarray | None:
        """None if the view's labels are all alike."""
        known = self.y[view] >= 0
        return _logistic(self.x[view][known], self.y[view][known].astype(float)) if len(np.unique(self.y[view][known])) == 2 else None


_META = ["lang", "source", "n_chars"]


def _rows(docs: DataFrame, row_id: str, text: str, *extra: Column) -> DataFrame:
    """Just the columns that are read, under names of their own: _id, _text, the metadata, then the extra ones."""
    return docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"), *_META, *extra)


def _featured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    view = [text_features(c) for c in chunks(batch.column(1))]
    return np.concatenate(view) if view else np.zeros((0, TEXT_FEATURES)), meta_features(batch.select(_META).to_pandas())


def _collected(rows: DataFrame, *extra: str) -> pd.DataFrame:
    """Both views of a bounded number of rows (of ``_rows``), on the driver, in the order of their ids; texts stay on the executors."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = ["_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.array(list(v), pa.list_(pa.float64())) for v in _featured(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *lists], names=[*kept, "text", "meta"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "text array<double>", "meta array<double>"])
    return rows.mapInArrow(run, schema).toPandas().sort_values(kept, kind="stable")


def _surest(rows: DataFrame, known: DataFrame, weights: dict[str, np.ndarray], most: int) -> DataFrame:
    """(view, value, id) of the ``most`` rows that each view is surest to be good, and to be bad, less those of ``known``.

    Texts stay where they are read: a narrow pass gives an id and two chances for each row of which a view is sure, and only these meet the known ids.
    """
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = [_sure(x, weights[view]) for view, x in zip(("text", "meta"), _featured(batch))]
            sure = pa.array(np.logical_or.reduce([(p >= CONFIDENT) | (p <= 1 - CONFIDENT) for p in chances]))
            out = [batch.column(0), batch.column(5), *(pa.array(p) for p in chances)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "place", "text", "meta"]).filter(sure)

    scored = rows.mapInArrow(run, f"id {id_type}, place long, text double, meta double")
    found = write_out(scored.join(known.select(F.col("_known")), F.col("id") == F.col("_known"), "left_anti"), "quality-sure")

    def best(view: str, value: int) -> DataFrame:
        chance = F.col(view) if value else 1 - F.col(view)
        own = found.filter(chance >= CONFIDENT).orderBy(chance.desc(), "place", "id").limit(most)
        return own.select(F.lit(view).alias("view"), F.lit(value).alias("value"), "id")

    picked = write_out(best("text", 0).union(best("text", 1)).union(best("meta", 0)).union(best("meta", 1)), "quality-picked")
    remove(found)
    return picked


def train_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, labelled: int = LABELLED_ROWS, pseudo: int = PSEUDO_LABELS, text: str = "text", row_id: str = "doc_id") -> Views | None:
    """Blum and Mitchell (1998): both views learn from the labels, then from each other's surest guesses about all unlabelled rows.

    At most ``labelled`` rows teach, picked by a hash of their id; a fifth of them (by the hash) is kept aside to calibrate and
    combine the views. In each round every other row of ``docs`` is scored on the executors, and each view hands the
    ``pseudo`` surest ones of either class to the other view; only the features of these rows reach the driver. An id with several
    labels counts as good if one says so. Rows of ``held_out`` never take part, nor do null ids.
    None if the labels are all alike.
    """
    if held_out is not None:
        labels, docs = labels.filter(~held_out), docs.filter(~held_out)
    docs = docs.filter(F.col(row_id).isNotNull())
    known = labels.filter(F.col(row_id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(row_id).alias("_known")).agg(F.max("quality").cast("int").alias("_label"))
    picked = F.broadcast(known.orderBy(F.xxhash64("_known"), "_known").limit(labelled))
    aside = (F.pmod(F.xxhash64("_known", F.lit(8)), F.lit(5)) == 0).alias("_fold")
    frame = _collected(_rows(docs.join(picked, F.col(row_id) == F.col("_known")), row_id, text, F.col("_label"), aside), "_label", "_fold")
    if not len(frame):
        return None
    fold, label = frame["_fold"].to_numpy(bool), frame["_label"].to_numpy(int)
    views = {v: np.stack(frame[v]) for v in ("text", "meta")}
    taught = Taught(views["text"][~fold], views["meta"][~fold], label[~fold])
    place = F.xxhash64(F.col(row_id), F.lit(8)).alias("_place")
    for step in range(ROUNDS + 1):
        weights = {v: taught.weights(v) for v in views}
        if any(w is None for w in weights.values()):
            return None
        if step == ROUNDS:
            break
        sure = _surest(_rows(docs, row_id, text, place), known, weights, pseudo)
        guesses = sure.groupBy("id").pivot("view", ["text", "meta"]).agg(F.max("value"))  # at most four times pseudo rows
        guesses = guesses.select(F.col("id").alias("_guessed"), *(F.coalesce(v, F.lit(-1)).alias(f"_by_{v}") for v in views))
        new = _collected(_rows(docs.join(F.broadcast(guesses), F.col(row_id) == F.col("_guessed")), row_id, text, F.col("_by_text"), F.col("_by_meta")).limit(8 * pseudo), "_by_text", "_by_meta")
        new = new.drop_duplicates("_id")
        known = known.select("_known").union(guesses.select("_guessed"))
        if not len(new):
            break
        taught.add(np.stack(new["text"]), np.stack(new["meta"]), new["_by_meta"].to_numpy(int), new["_by_text"].to_numpy(int))
    kept = fold if len(np.unique(label[fold])) == 2 else np.ones(len(label), bool)
    odds = np.stack([views[v][kept] @ weights[v][:-1] + weights[v][-1] for v in views], 1)
    return Views(weights["text"], weights["meta"], _logistic(np.clip(odds, -12, 12), label[kept].astype(float), ridge=1.0))


def score_quality(docs: DataFrame, views: Views | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The id, both views' scores and their calibrated combination ``score`` (0 to 1, high is good) of every row.

    A narrow pass without shuffles over whole texts. Null texts count as empty, null metadata as
    a value of its own, and missing lengths as 0. Repeated rows score alike. Other columns are not read. Without a model all scores are 1, so that
    nothing is rejected. An empty table gives an empty table.
    """
    if views is None:
        return docs.select(row_id, *(F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")))
    id_type = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = meta_features(batch.select(_META).to_pandas())
            for c in chunks(batch.column(1)):
                scores = views.scores(text_features(c), meta[c.first_row : c.first_row + c.n_rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first_row, c.n_rows), *map(pa.array, scores)], names=[row_id, "text_score", "meta_score", "score"])

    return _rows(docs, row_id, text).mapInArrow(run, f"`{row_id}` {id_type}, text_score double, meta_score double, score double")
