"""Token counts of whole texts under a public vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import IS_WORD, SPACES, Chunk, chunks

#: Bytes of distinct pieces that go to the encoder at once.
BATCH_BYTES = 1 << 18
#: Counts of pieces seen before that a Python worker keeps, for any vocabulary; beyond it they are counted anew.
CACHE_SIZE = 1 << 20
_seen: dict[str, dict[int, int]] = {}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


#: Normalisers that change each letter by itself or with its combining marks, so a cut at white space changes nothing.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "StripAccents", "Sequence"}


@lru_cache(maxsize=4)
def cut_at_spaces(path: str) -> bool:
    """Whether ASCII white space parts tokens: it is dropped before words are looked up, and no added token holds any.

    So it is for vocabularies that first split texts into pieces without white space. Others, such as those of byte
    pairs whose tokens begin with a space, and sentencepiece models, must see whole texts.
    """
    if not path.endswith(".json"):
        return False
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    added = [t.content for t in model.get_added_tokens_decoder().values()]
    kinds = re.findall(r'"type": ?"(\w+)"', json.dumps(json.loads(model.to_str())["normalizer"] or {}))
    probe = "".join(f"aB{c}{c}12{c}.,{c}é{c}" for c in SPACES.decode())
    cut = model.pre_tokenizer.pre_tokenize_str(probe) if model.pre_tokenizer else [(probe, (0, len(probe)))]
    return set(kinds) <= LOCAL and not any(any(c.isspace() for c in t) for t in added) and not any(c.isspace() for _, (i, j) in cut for c in probe[i:j])


_ANY = np.ones(256, bool)


def count_pieces(chunk: Chunk, encode: Callable[[list[str]], list[int]], seen: dict[int, int], whole: bool = False) -> np.ndarray:
    """Tokens of each row: a piece (a word, or the whole row) that ``seen`` lacks is encoded, in batches of about equal bytes."""
    chunk.words(_ANY if whole else IS_WORD)
    if not len(chunk.starts):
        return np.zeros(chunk.n_rows, np.int64)
    hashes = chunk.hashes(chunk.starts, chunk.ends)
    pieces, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.array([seen.get(x, -1) for x in pieces.tolist()], np.int64)
    if len(order := np.flatnonzero(counts < 0)):
        starts, ends = chunk.starts[at], chunk.ends[at]
        order = order[np.argsort((ends - starts)[order], kind="stable")]  # a batch holds pieces of like length
        sizes = np.cumsum((ends - starts)[order])
        for part in np.split(order, np.flatnonzero(np.diff(sizes // BATCH_BYTES)) + 1):
            counts[part] = encode([chunk.text(starts[i], ends[i]) for i in part])
        if len(seen) + len(order) > CACHE_SIZE:
            seen.clear()
        seen.update(zip(pieces[order].tolist(), counts[order].tolist()))
    return np.bincount(chunk.row, counts[which], minlength=chunk.n_rows).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` to every row of ``docs``.

    Long texts are split where no token can cross: at ASCII white space, for vocabularies
    that drop it before they merge (such as BPE within words; checked by ``cut_at_spaces``). For others a text is one piece. Tokens that mark
    a text's begin or end are not added; such strings inside a text count as the library's
    default has it. Only lengths leave the encoder. A task holds one run of about
    1 MB of text (or one longer text) at a time.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows are each counted. Columns of
    ``docs`` called n_bytes or n_tokens are replaced. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, whole = encoder(vocabulary), _seen.setdefault(vocabulary, {}), not cut_at_spaces(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n_bytes, n_tokens = [], []
            for chunk in chunks(column):
                n_bytes.append(np.diff(chunk.bounds))
                n_tokens.append(count_pieces(chunk, encode, seen, whole))
            out = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_bytes, n_tokens)]
            yield pa.RecordBatch.from_arrays(batch.columns + out, names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep).mapInArrow(count, schema)
