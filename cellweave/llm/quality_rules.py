"""Quality rules: base counts, and Jensen-Shannon distance to language references.

A language's reference is the histogram of character classes (of code points) and of common words over
all its documents. A word is common in a language if it makes at least ``COMMON`` of the language's words,
so there are at most 1 / COMMON of them. A text is held against every language and its nearest one
counts: the greater of the distance of characters and WORD_SHARE times that of words, as words of a short
text are few and far from any reference. Shorter texts than the guards are not judged by distance.

Null and empty texts count as texts without words and fail the base rules; with no language in the whole
table there is no reference and distance is 0. Rows are judged one by one, so repeats and ids play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, joined, texts_of

COMMON = 0.004
#: Guards, the greatest distance that is kept, and what the distance of words counts against that of characters.
MIN_WORDS, MIN_CHARS, MAX_DISTANCE, WORD_SHARE = 20, 100, 0.3, 0.6
SYMBOLS = b"#*$%&|<>"
#: Character classes of the histogram.
CLASSES = ("control", "lower", "upper", "digit", "space", "line", "stop", "symbol", "bang", "other", "latin", "greek", "cyrillic", "semitic", "indic", "east", "beyond")
_NONE = len(CLASSES)  # bytes that begin no code point
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in (
    (0, bytes(range(32))), (1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:'\"-()"), (7, SYMBOLS), (8, b"!?"),
    (_NONE, bytes(range(0x80, 0xC0))), (10, bytes(range(0xC0, 0xCE))), (11, b"\xce\xcf"), (12, bytes(range(0xD0, 0xD6))), (13, bytes(range(0xD6, 0xE0))), (14, b"\xe0\xe1"), (15, bytes(range(0xE2, 0xF0))), (16, bytes(range(0xF0, 256))),
):
    _CLASS[list(_chars)] = _k
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _plain(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?\"'()#*$%&|<>")


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray  # [language, class], each row sums to 1
    words: dict[bytes, int]  # common word -> column
    word_shares: np.ndarray  # [language, column + 1]; the last is any other word


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """One pass over all documents with a language; only bins over the threshold reach the driver."""
    schema = "lang string, kind string, key binary, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush():
            rows = [(lang, "class", bytes([k]), int(n)) for lang, h in classes.items() for k, n in enumerate(h)]
            rows += [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            classes.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "kind", "key", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, "__text"), strict=True):
                own = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_NONE + 1)[:_NONE]
                classes[lang] = classes[lang] + own if lang in classes else own
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > 500_000:
                yield flush()
        yield flush()

    counts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("__text")).mapInArrow(count, schema)
    summed = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    total = summed.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    share = (F.col("n") / F.col("total")).alias("share")
    bins = summed.join(total, ["lang", "kind"]).where((F.col("kind") == "class") | (F.col("n") >= COMMON * F.col("total"))).select("lang", "kind", "key", share).where(F.col("share") > 0).collect()
    languages = sorted({r["lang"] for r in bins})
    at = {k: i for i, k in enumerate(languages)}
    common = sorted({_plain(bytes(r["key"])) for r in bins if r["kind"] == "word"} - {b""})
    words = {w: i for i, w in enumerate(common)}
    classes = np.zeros((len(languages), len(CLASSES)))
    shares = np.zeros((len(languages), len(words) + 1))
    for r in bins:
        if r["kind"] == "class":
            classes[at[r["lang"]], bytes(r["key"])[0]] = r["share"]
        elif (k := words.get(_plain(bytes(r["key"])))) is not None:
            shares[at[r["lang"]], k] += r["share"]
    shares[:, -1] = np.maximum(1 - shares[:, :-1].sum(axis=1), 0)
    return References(languages, classes, words, shares)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (0 to 1) of each row of p to each row of q."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    half = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=2)
    return np.sqrt(np.clip((half(a) + half(b)) / 2, 0, 1))


def repeated(ids: np.ndarray, text: np.ndarray, size: int = 8) -> np.ndarray:
    """Which words stand in a window of ``size`` (a power of two) words that its text holds twice or more.

    Hashes find the texts in which two windows may be equal; in those, windows are compared exactly.
    """
    n = len(ids)
    out = np.zeros(n, bool)
    if n < size:
        return out
    code, width = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < size:
        code = (code[:-width] ^ (code[:-width] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + code[width:]
        width *= 2
    at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])  # windows inside one text
    if not len(at):
        return out
    code = code[at] + text[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(code)
    twin = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    likely = np.unique(text[at[order[twin]]])
    if not len(likely):
        return out
    held = np.isin(text, likely)
    out[held] = _repeated_exactly(ids[held], text[held], size)
    return out


def _repeated_exactly(ids: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    n = len(ids)
    code, width = ids.astype(np.int64), 1
    while width < size:  # rank windows twice as long by the pair of their halves
        pair = code[:-width] * (int(code.max()) + 1) + code[width:]
        code = np.unique(pair, return_inverse=True)[1]
        width *= 2
    at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    _, back, counts = np.unique(text[at] * (int(code.max()) + 1) + code[at], return_inverse=True, return_counts=True)
    start = at[counts[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    return np.cumsum(cover[:n]) > 0


def measure(texts: list[bytes], ref: References) -> list:
    """The added columns: base counts, the nearest reference's distance and the verdict."""
    data, offsets = joined(texts)
    per = lambda flags: np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    word_chars = per(_START[data] & ~_SPACE[data])
    n_symbols = per(_SYMBOL[data])
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in split for w in words), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeats = np.bincount(owner, repeated(flat, owner), len(texts)).astype(np.int64)
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    # histograms against the references
    hist = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)) * (_NONE + 1) + _CLASS[data], minlength=len(texts) * (_NONE + 1)).reshape(-1, _NONE + 1)[:, :_NONE]
    column = np.fromiter((ref.words.get(_plain(w), len(ref.words)) for w in ids), np.int64, len(ids))
    wide = len(ref.words) + 1
    words = np.bincount(owner * wide + column[flat], minlength=len(texts) * wide).reshape(-1, wide) if len(flat) else np.zeros((len(texts), wide))
    distance = np.zeros(len(texts))
    judged = (n_words >= MIN_WORDS) & (hist.sum(axis=1) >= MIN_CHARS)
    if ref.languages and judged.any():
        norm = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
        both = np.maximum(jensen_shannon(norm(hist[judged]), ref.classes), jensen_shannon(norm(words[judged]), ref.word_shares) * WORD_SHARE)
        distance[judged] = both.min(axis=1)
    return [n_words, word_chars, n_symbols, dup_lines, repeats, failed, ~failed & (distance <= MAX_DISTANCE), distance]


ADDED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("js_distance", T.DoubleType())])


def judge(docs: DataFrame, ref: References, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the counts, ``base_failed``, ``kept`` and ``js_distance``. Null text: as empty, so it fails."""
    shared = docs.sparkSession.sparkContext.broadcast(ref)
    return annotate(docs, text_col, ADDED, lambda texts: measure(texts, shared.value), keep)


def query(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, kept and js_distance of every row, against references of the whole table."""
    ref = references(docs.select("text", "lang"))
    return judge(docs.select("doc_id", "text"), ref, keep=["doc_id"])
