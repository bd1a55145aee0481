"""Language identification by prediction by partial matching.

Each language has a byte context tree of order three with escape counts (method C, full exclusion),
frozen after training. All code lengths of the trees are expanded once into one table
``bits[context, byte, language]``; a text's code length is then a sum of table rows, exact and free
of any per-byte branching. Prediction: the language with the shortest code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, bounded_sample, fold_bucket, joined, trained

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes never trained on
    node: np.ndarray  # code of the last three symbols -> context kept for them
    bits: np.ndarray  # [context * symbols + symbol, language] code length in bits

    @property
    def size(self) -> int:
        return int(self.symbol.max()) + 1

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """[text, language] code length in bits; an empty text has length 0."""
        data, offsets = joined(texts)
        total = np.zeros((len(texts), len(self.languages)))
        if not data.size:
            return total
        node, symbols = _contexts(data, offsets[:-1], self.symbol, self.size)
        each = self.bits[self.node[node].astype(np.int64) * self.size + symbols]
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        total[full] = np.add.reduceat(each, offsets[:-1][full], axis=0, dtype=np.float64)
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the posterior; ``und`` and 0 without any letter. Ties: first by name."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.code_lengths(texts)
        best = cost.argmin(axis=1)
        share = 1 / np.exp2(np.clip(cost.min(axis=1, keepdims=True) - cost, -1000, 0)).sum(axis=1)
        letters = pc.match_substring_regex(pa.array(texts, pa.large_binary()).cast(pa.large_string()), r"\p{L}").to_numpy(zero_copy_only=False)
        names = [self.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, share, 0.0)


def _contexts(data: np.ndarray, starts: np.ndarray, symbol: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the three symbols before each byte (0 before a text's start), and its own symbol."""
    own = symbol[data].astype(np.int32)
    code = np.zeros(len(own), np.int32)
    for back in (3, 2, 1):
        before = np.zeros_like(own)
        before[back:] = own[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(own)]] = 0
        code = code * size + before
    return code, own


def _zeroed_starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    texts = [t for t in texts if t]
    data, offsets = joined(texts)
    return data, offsets[:-1]


def train(samples: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees of each language, with every context of the samples.

    Their number is bounded by the bytes of the sample; a table row holds a code length for each symbol and language.
    """
    languages = sorted(k for k, texts in samples.items() if any(texts))
    if not languages:
        return ContextTrees([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    seen = np.zeros(256, bool)
    for k in languages:
        for text in samples[k]:
            seen[_LOWER[np.frombuffer(text, np.uint8)]] = True
    letters = np.flatnonzero(seen)[:255]
    size = len(letters) + 1
    rank = np.zeros(256, np.uint8)
    rank[letters] = np.arange(1, size)
    symbol = rank[_LOWER]
    streams = {k: _contexts(*_zeroed_starts(samples[k]), symbol, size) for k in languages}

    third = np.unique(np.concatenate([np.unique(code) for code, _ in streams.values()])).astype(np.int64)
    second = np.unique(third % (size * size))
    # contexts: order three, then order two, then order one; each falls back to the next
    codes = np.concatenate([third, second])
    fall = np.tile(len(codes) + np.arange(size, dtype=np.int32), size)
    fall[second] = len(third) + np.arange(len(second), dtype=np.int32)
    node = np.tile(fall, size)
    node[third] = np.arange(len(third), dtype=np.int32)
    of_third = np.full(size**3, -1, np.int32)
    of_third[third] = np.arange(len(third), dtype=np.int32)

    bits = np.zeros(((len(codes) + size) * size, len(languages)), np.float32)
    for k, name in enumerate(languages):
        code, own = streams[name]
        n2 = np.bincount((code % (size * size)).astype(np.int64) * size + own, minlength=size**3).reshape(-1, size)
        n1 = n2.reshape(size, size, size).sum(axis=0)
        n0 = n1.sum(axis=0)
        at = of_third[code]
        n3 = np.bincount(at[at >= 0].astype(np.int64) * size + own[at >= 0], minlength=len(third) * size).reshape(-1, size)
        pair = np.concatenate([third % (size * size), second])
        top = np.concatenate([n3, np.zeros((len(second), size), n3.dtype)])
        levels = [top, n2[pair], n1[pair % size], np.broadcast_to(n0, top.shape)]
        ones = [np.zeros_like(n1), np.zeros_like(n1), n1, np.broadcast_to(n0, n1.shape)]
        levels = [np.concatenate(x) for x in zip(levels, ones, strict=True)]
        bits[:, k] = _expand(levels).reshape(-1)
    return ContextTrees(languages, symbol, node, bits)


def _expand(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths of every symbol in every context from the counts of each order, longest first."""
    shape = levels[0].shape
    chance, left, excluded = np.zeros(shape), np.ones((shape[0], 1)), np.zeros(shape, bool)
    for counts in levels:
        fresh = np.where(excluded, 0, counts)
        total, kinds = fresh.sum(axis=1, keepdims=True), (fresh > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        chance += left * fresh / whole
        left = np.where(total > 0, left * kinds / whole, left)
        excluded |= fresh > 0
    rest = (~excluded).sum(axis=1, keepdims=True)
    chance += np.where(excluded, 0, left / np.maximum(rest, 1))
    return -np.log2(np.maximum(chance, 2.0**-60))


def fit(train_docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 300) -> ContextTrees:
    """Train on about ``per_language`` whole labelled texts of each language (the bound of the sample), in one task."""
    rows = bounded_sample(train_docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col), [lang_col], text_col, id_col, per_language)
    return trained(rows.select(lang_col, text_col), _train_rows)


def _train_rows(rows: list[tuple[str, str]]) -> ContextTrees:
    samples: dict[str, list[bytes]] = {}
    for lang, text in rows:
        samples.setdefault(lang, []).append(text.encode())
    return train(samples)


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score`` to each row. Null or letterless text: ``und`` and 0."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return annotate(docs, text_col, added, lambda texts: list(model.value.predict(texts)), keep)


def query(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", "text", "lang", (fold_bucket("doc_id", 4) == 2).alias("held_out"))
    trees = fit(marked.where(~F.col("held_out")))
    return identify(marked.select("doc_id", "held_out", "text"), trees, keep=["doc_id", "held_out"])
