"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import Chunk, chunks

ORDER, DECAY = 3, 0.6
#: Letters of a candidate string that one kernel value sees; a longer string is seen in windows that begin so many letters apart.
SPAN, STRIDE = 20, 4
#: Labelled rows that training reads at most, in the order of a hash of their id, and bytes of their texts.
TRAINING_ROWS, TRAINING_BYTES = 5000, 64 << 20
#: Of these, texts labelled 1 and texts labelled 0 whose sentences the machine learns from; all of them count for the landmarks.
TOXIC_TEXTS, OTHER_TEXTS = 600, 1500
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS, ROUNDS = 80, 6, 3
#: Rows that training multiplies at a time, so that the driver holds one copy of what the machine learns from.
BLOCK_ROWS = 1 << 11
#: Candidate strings whose scores a Python worker keeps; beyond it they are scored anew.
CACHE_SIZE = 1 << 19
#: Digits and signs that stand in for letters.
STANDINS = str.maketrans("013457@$", "oieastas")


def letters(word: str) -> str:
    """Lower-case letters of a word, with stand-ins replaced and what stands between them dropped."""
    return "".join(filter(str.isalpha, unicodedata.normalize("NFC", word.lower()).translate(STANDINS)))


def pieces(word: str) -> list[str]:
    own = letters(word)
    if len(own) <= SPAN:
        return [own]
    return [own[i : i + SPAN] for i in range(0, len(own) - SPAN + STRIDE, STRIDE)]


def _codes(strings: list[str]) -> np.ndarray:
    width = max(map(len, strings), default=0)
    return np.array(strings, f"U{max(width, 1)}").view(np.int32).reshape(len(strings), -1)[:, :width]


def subsequence_kernel(left: list[str], right: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted counts of common subsequences of ``order`` letters (Lodhi et al., 2002), for all pairs.

    A common subsequence counts decay ** (its span in one + its span in the other), so inserted
    letters weaken a match and don't end it. All pairs advance together, by a letter of the left.
    """
    s, t = _codes(left), _codes(right)
    width, shape = t.shape[1], (len(left), len(right))
    one, gap = np.float32(decay**2), np.float32(decay)
    # prefix[i][j]: weight of the common subsequences of i letters in the left so far and the right's first j letters
    prefix = [np.ones((width + 1, *shape), np.float32)] + [np.zeros((width + 1, *shape), np.float32) for _ in range(order - 1)]
    total = np.zeros(shape, np.float32)
    for at in range(s.shape[1]):
        x = s[:, at : at + 1]
        same = [((x == t[:, j]) & (x != 0)) * one for j in range(width)]
        for j in range(width):
            total += same[j] * prefix[order - 1][j]
        for i in range(order - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            for j in range(width):
                run *= gap
                run += same[j] * prefix[i - 1][j]
                prefix[i][j + 1] *= gap
                prefix[i][j + 1] += run
    return total


def _self_kernel(strings: list[str]) -> np.ndarray:
    return np.array([subsequence_kernel([s], [s])[0, 0] if s else 0 for s in strings], np.float32)


class Model(NamedTuple):
    """Landmarks with their own kernel values, the weight of each normalised kernel value, bias, and the calibration."""

    name: str
    landmarks: list[str]
    norms: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def features(self, strings: list[str]) -> np.ndarray:
        """Normalised kernel values against the landmarks; 0 for strings of fewer than ORDER letters."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        for own in _by_length(strings).values():
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                texts = [strings[i] for i in part]
                out[part] = subsequence_kernel(texts, self.landmarks) / np.sqrt(_diagonal(texts)[:, None] * self.norms[None])
        return out

    def collapsed(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum over landmarks as one weight for each subsequence of ORDER letters, and the place of each code point.

        The kernel is an inner product over subsequences, so all landmarks add up to one vector over
        them; a string then costs its own subsequences, however many landmarks there are. Place 0
        stands for letters that no landmark holds.
        """
        held = sorted({ord(c) for s in self.landmarks for c in s})
        place = np.zeros(max(held) + 1, np.int32)
        place[held] = np.arange(1, len(held) + 1)
        table = np.zeros((len(held) + 1,) * ORDER)
        for s, norm, weight in zip(self.landmarks, self.norms, self.weights):
            for at in combinations(range(len(s)), ORDER):
                table[tuple(place[ord(s[i])] for i in at)] += weight / np.sqrt(norm) * DECAY ** (at[-1] - at[0] + 1)
        return table.ravel().astype(np.float32), place

    def margins(self, strings: list[str], table: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Weighted kernel values and bias; the bias alone for strings of fewer than ORDER letters."""
        out = np.full(len(strings), self.bias)
        size = round(len(table) ** (1 / ORDER))
        for width, own in _by_length(strings).items():
            at = np.array(list(combinations(range(width), ORDER)))
            decay = np.float32(DECAY) ** (at[:, -1] - at[:, 0] + 1).astype(np.float32)
            step = max(1, (1 << 19) // len(at))
            for begin in range(0, len(own), step):
                part = own[begin : begin + step]
                texts = [strings[i] for i in part]
                codes = _codes(texts)
                codes = np.where(codes < len(place), place[np.minimum(codes, len(place) - 1)], 0)
                which = codes[:, at[:, 0]]
                for i in range(1, ORDER):
                    which = which * size + codes[:, at[:, i]]
                out[part] += (table[which] @ decay) / np.sqrt(_diagonal(texts))
        return out

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _by_length(strings: list[str]) -> dict[int, list[int]]:
    """Places of the strings of each length from ORDER."""
    found: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        if len(s) >= ORDER:
            found.setdefault(len(s), []).append(i)
    return found


def _diagonal(texts: list[str]) -> np.ndarray:
    """Kernel of each string with itself, all of one length."""
    s = _codes(texts)
    one, gap = np.float32(DECAY**2), np.float32(DECAY)
    n, width = s.shape
    prefix = [np.ones((width + 1, n), np.float32)] + [np.zeros((width + 1, n), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    for at in range(width):
        same = [(s[:, at] == s[:, j]) * one for j in range(width)]
        for j in range(width):
            total += same[j] * prefix[ORDER - 1][j]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(width):
                run = run * gap + same[j] * prefix[i - 1][j]
                prefix[i][j + 1] = prefix[i][j + 1] * gap + run
    return total


def _single(word: str) -> bool:
    """One code point, not counting combining marks (U+0300 to U+036F)."""
    return len(word) == 1 or sum(not "\u0300" <= c <= "\u036f" for c in word) == 1


def candidate_strings(sentence: str) -> list[str]:
    """Words of a sentence as letters, and runs of single letters as one string."""
    words = sentence.split()
    out = [p for w in words for p in pieces(w)]
    run: list[str] = []
    for w in [*words, "  "]:
        if _single(w):
            run.append(w)
        else:
            if len(run) >= ORDER:
                out += pieces("".join(run))
            run = []
    return [s for s in out if len(s) >= ORDER]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin.

    The sums over rows are taken block by block, so a step holds no copy of x.
    """
    w = np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        left, right = penalty.copy(), np.zeros(len(w))
        for at in range(0, len(x), BLOCK_ROWS):
            own, sign, heavy = (part[at : at + BLOCK_ROWS] for part in (x, y, weight))
            active = sign * (own @ w[:-1] + w[-1]) < 1
            one = np.hstack([own[active], np.ones((active.sum(), 1))])
            weighted = (one * heavy[active][:, None]).T
            left += weighted @ one
            right += weighted @ sign[active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new
    return w


def _mapped(features: np.ndarray, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The rows ``at`` of features times root, block by block."""
    out = np.empty((len(at), root.shape[1]))
    for begin in range(0, len(at), BLOCK_ROWS):
        out[begin : begin + BLOCK_ROWS] = features[at[begin : begin + BLOCK_ROWS]] @ root
    return out


def _platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the weighted margins (Platt, 1999), by Newton steps."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def _pick_landmarks(positive: Counter, negative: Counter, n1: int, n0: int) -> tuple[list[str], list[str]]:
    """Strings that tell toxic from other texts, unlike each other; and the others' most frequent ones of those both hold."""
    gain = {}
    for s, k in positive.items():
        if k >= 4:
            a, b = (k + 0.5) / (n1 + 1), (negative[s] + 0.5) / (n0 + 1)
            if a > 8 * b and k * np.log(a / b) > 10:
                gain[s] = k * np.log(a / b)
    chosen: list[str] = []
    norms: dict[str, float] = {}
    for s in sorted(gain, key=lambda s: (-gain[s], s))[:400]:
        norms[s] = float(_self_kernel([s])[0])
        if chosen and max(subsequence_kernel([s], chosen)[0] / np.sqrt(norms[s] * np.array([norms[c] for c in chosen]))) > 0.8:
            continue
        chosen.append(s)
        if len(chosen) == POSITIVE_LANDMARKS:
            break
    common = [s for s, _ in sorted(negative.items(), key=lambda x: (-x[1], x[0])) if s not in gain][:NEGATIVE_LANDMARKS]
    return chosen, common


def train(rows: Iterable[tuple[str | None, int]]) -> Model | None:
    """A model of labelled texts; None if one of the labels is absent or no string tells them apart.

    Sentences of texts labelled 0 are negative. Of each text labelled 1 the sentence with
    the highest margin is positive, anew in each round, since its label says that some sentence
    is toxic and not which. A sentence is seen as its highest candidate string. The machine
    is linear on the Nystroem map K(string, landmarks) K(landmarks, landmarks) ** -1/2.
    """
    rows = [(text or "", int(label)) for text, label in rows]
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not n1 or not n0:
        return None
    # only strings of toxic texts can tell, so only they are counted in the others
    positive = Counter(s for text, y in rows if y for s in set(candidate_strings(text)))
    negative = Counter(s for text, y in rows if not y for s in set(candidate_strings(text)) if s in positive)
    telling, common = _pick_landmarks(positive, negative, n1, n0)
    del positive, negative
    if not telling:
        return None
    landmarks = [*telling, *common]
    place: dict[str, int] = {}
    room = {1: TOXIC_TEXTS, 0: OTHER_TEXTS}
    labels, where = [], []  # of each text that teaches: its label, and of each sentence the places of its strings
    for text, y in rows:
        if room[y] > 0:
            room[y] -= 1
            own = [c for x in re.split(r"[.!?\n]+", text) if (c := sorted(set(candidate_strings(x))))]
            labels.append(y)
            where.append([np.array([place.setdefault(s, len(place)) for s in x], np.int32) for x in own])
    strings = list(place)
    del place
    norms = _self_kernel(landmarks)
    gram = subsequence_kernel(landmarks, landmarks) / np.sqrt(norms[:, None] * norms[None])
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    model = Model(uuid.uuid4().hex, landmarks, norms, np.zeros(len(landmarks)), 0.0, 1.0, 0.0)
    features = model.features(strings)
    margin = features[:, : len(telling)].max(1).astype(np.float64)
    for _ in range(ROUNDS):
        top = [[x[margin[x].argmax()] for x in sentences] for sentences in where]
        rows_, signs = [], []
        for own, y in zip(top, labels):
            if y and own:
                rows_.append(max(own, key=lambda i: margin[i]))
                signs.append(1)
            elif own:
                rows_ += own
                signs += [-1] * len(own)
        at, y = np.array(rows_), np.array(signs, float)
        # a negative string counts once however many sentences hold it, less those that frequent labels contradict
        key = at * 2 + (y > 0)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        at, y, weight = at[first], y[first], np.sqrt(count)
        w = _svm(_mapped(features, at, root), y, weight * np.where(y > 0, 1.0, 0.3))
        margin = features @ (root @ w[:-1]).astype(np.float32) + w[-1]
    least = float(w[-1])
    best = np.array([max([least, *(margin[x].max() for x in sentences)]) for sentences in where])
    y = np.array(labels, float)
    # the texts that teach hold more toxic ones than all do; the curve is weighted back
    slope, offset = _platt(best, y, np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum()))
    return model._replace(weights=(root @ w[:-1]).astype(np.float32), bias=least, slope=slope, offset=offset)


_seen: dict[str, dict[int, float]] = {}


def _spaced(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces for all white space that ``str.split`` knows."""
    out = np.where((data >= 0x1C) & (data <= 0x1F), np.uint8(0x20), data)
    a = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
    a = a[np.isin(data[a], (0xC2, 0xE1, 0xE2, 0xE3))]
    b, c = (data[np.minimum(a + i, len(data) - 1)] for i in (1, 2))
    two = (data[a] == 0xC2) & ((b == 0x85) | (b == 0xA0))
    code = (data[a].astype(np.int32) & 15) << 12 | (b.astype(np.int32) & 63) << 6 | (c & 63)
    three = (data[a] > 0xC2) & (np.isin(code, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) | ((code >= 0x2000) & (code <= 0x200A)))
    for at, width in ((a[two], 2), (a[three], 3)):
        for i in range(width):
            out[at + i] = 0x20
    return out


def _letter_runs(chunk: Chunk) -> Iterator[tuple[int, str]]:
    """Row and letters of each run of ORDER and more words of one code point, spelled out with spaces."""
    data = chunk.data
    after = np.append(data[1:], np.uint8(0))
    # a code point begins at each byte that continues none; combining marks (U+0300 to U+036F) don't count
    begins = ((data & 0xC0) != 0x80) & (data != 0xCC) & ((data != 0xCD) | (after >= 0xB0))
    before = np.concatenate(([0], np.cumsum(begins)))
    single = before[chunk.ends] - before[chunk.starts] == 1
    # a run ends with its row
    cut = np.flatnonzero(np.concatenate(([True], (single[1:] != single[:-1]) | (chunk.row[1:] != chunk.row[:-1]), [True])))
    for start, stop in zip(cut[:-1], cut[1:]):
        if stop - start >= ORDER and single[start]:
            yield int(chunk.row[start]), "".join(chunk.text(chunk.starts[i], chunk.ends[i]) for i in range(start, stop))


def _chunk_margins(chunk: Chunk, model: Model, seen: dict[int, float], collapsed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The highest margin of each row's candidate strings, the bias at least."""
    chunk.data = _spaced(chunk.data)
    chunk.words()
    best = np.full(chunk.n_rows, model.bias)
    if not len(chunk.starts):
        return best
    words, at, which = np.unique(chunk.hashes(chunk.starts, chunk.ends, lower=True), return_index=True, return_inverse=True)
    margins = np.array([seen.get(x, np.nan) for x in words.tolist()])
    if len(new := np.flatnonzero(np.isnan(margins))):
        own = [pieces(chunk.text(chunk.starts[at[i]], chunk.ends[at[i]])) for i in new]
        flat = sorted({p for x in own for p in x if len(p) >= ORDER})
        value = dict(zip(flat, model.margins(flat, *collapsed).tolist()))
        margins[new] = [max(value.get(p, model.bias) for p in x) for x in own]
        if len(seen) + len(new) > CACHE_SIZE:
            seen.clear()
        seen.update(zip(words[new].tolist(), margins[new].tolist()))
    np.maximum.at(best, chunk.row, margins[which])
    for row, run in _letter_runs(chunk):
        own = [p for p in pieces(run) if len(p) >= ORDER]
        if own:
            best[row] = max(best[row], float(model.margins(own, *collapsed).max()))
    return best


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, under any name) to every row: the calibrated highest margin of its whole text's candidate strings.

    A narrow pass without shuffles; the model is some kilobytes. Scores of words are kept by a
    Python worker, 524,288 at most. Null and empty texts score as texts without candidates. Repeated rows score
    alike. Without a model every score is 0. A column of that name is replaced. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c != score]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.name not in _seen:
            _seen.clear()
        seen, collapsed = _seen.setdefault(model.name, {}), model.collapsed()
        for batch in batches:
            margins = [_chunk_margins(c, model, seen, collapsed) for c in chunks(batch.column(keep.index(text)))]
            scores = model.chance(np.concatenate(margins) if margins else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*keep, score])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep, F.lit(0.0).alias(score)).schema)


def held_out(row_id: str = "doc_id"):
    """Rows that training never sees: the checksum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % 3 == 1, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, text: str = "text", row_id: str = "doc_id") -> Model | None:
    """Train on at most ``rows`` labelled rows outside the held-out part, and ``most_bytes`` of their texts, in the order of a hash of their id.

    Rows with a null label, or whose id ``docs`` lacks, don't count. The picked ids (a bounded
    list) go to the documents, so texts are not shuffled; texts that would exceed the bytes are left out.
    """
    order = F.xxhash64(F.col(row_id)).alias("_order")
    picked = labels.filter(~held_out(row_id) & F.col("toxic").isNotNull() & F.col(row_id).isNotNull()).select(row_id, "toxic").distinct().withColumn("_order", order).orderBy("_order", "toxic").limit(rows)
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(row_id), body.alias("_body")).join(F.broadcast(picked), row_id)
    by = Window.orderBy("_order", "toxic", "_key")  # over the picked rows, without their texts
    sizes = found.select(row_id, "toxic", "_order", F.xxhash64("_body").alias("_key"), F.octet_length("_body").alias("_bytes")).orderBy("_order", "toxic", "_key").limit(rows)
    fitting = sizes.withColumn("_sum", F.sum("_bytes").over(by)).filter(F.col("_sum") <= most_bytes).select(row_id, "toxic", F.col("_key"))
    taken = found.withColumn("_key", F.xxhash64("_body")).join(F.broadcast(fitting.distinct()), [row_id, "toxic", "_key"]).orderBy("_order", "toxic", "_key").limit(rows).collect()
    return train([(r["_body"], r["toxic"]) for r in taken])
