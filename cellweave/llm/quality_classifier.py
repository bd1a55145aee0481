"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of 256-byte passages. Each is encoded (character classes, trigram variety, learned
trigram evidence, then a small tanh layer); gated attention, learned from document labels alone,
weighs the passages, and the weighted representation gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, fold_bucket, joined, trained
from .toxicity import labelled_rows, labelled_sample

PASSAGE, CELLS, GRAM_BITS, HIDDEN, GATE = 256, 128, 12, 12, 8
#: Character classes: other control, lower, upper, digit, space, line end, stops, symbols, bars, bangs, quotes and brackets, beyond ASCII.
_CLASSES = 12
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:"), (7, b"#*$%&<>@^~=+_/\\"), (8, b"|"), (9, b"!?"), (10, b"\"'()[]{}`-"), (11, bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k
FEATURES = _CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Raw features of every passage, its hashed trigrams with their passage, and passages per text (1 for an empty one)."""
    data, offsets = joined(texts)
    lengths = np.diff(offsets)
    counts = np.maximum(-(-lengths // PASSAGE), 1)
    base = np.r_[0, np.cumsum(counts)]
    owner = np.repeat(base[:-1] - offsets[:-1] // PASSAGE, 0) if not len(data) else np.repeat(base[:-1], lengths) + (np.arange(len(data)) - np.repeat(offsets[:-1], lengths)) // PASSAGE
    total = int(base[-1])
    classes = np.bincount(owner * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float32)
    size = np.maximum(classes.sum(axis=1), 1)
    f = np.zeros((total, FEATURES), np.float32)
    f[:, :_CLASSES] = np.sqrt(classes / size[:, None])
    wide = data.astype(np.uint32)
    grams = np.zeros(0, np.int64)
    where = np.zeros(0, np.int64)
    if len(data) > 2:
        mixed = ((wide[:-2] << 16) + (wide[1:-1] << 8) + wide[2:]) * np.uint32(2654435761)
        same = owner[:-2] == owner[2:]
        grams, where = (mixed[same] >> np.uint32(32 - GRAM_BITS)).astype(np.int64), owner[:-2][same]
        cells = np.bincount(where * CELLS + (grams & (CELLS - 1)), minlength=total * CELLS).reshape(total, CELLS)
        f[:, _CLASSES] = (cells > 0).sum(axis=1) / np.minimum(size, CELLS)
        f[:, _CLASSES + 1] = (cells.max(axis=1) / size) * 10
    f[:, _CLASSES + 2] = np.log1p(size) / 5
    return f, grams, where, counts


@dataclass
class Attention:
    evidence: np.ndarray  # learned log-odds of a hashed trigram
    w: dict[str, np.ndarray]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        f, grams, where, counts = passages(texts)
        n = np.maximum(np.bincount(where, minlength=len(f)), 1)
        f[:, _CLASSES + 3] = np.bincount(where, self.evidence[grams], len(f)) / n
        return f, counts

    def forward(self, f: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        w, first = self.w, np.r_[0, np.cumsum(counts)[:-1]]
        h = np.tanh(f @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        alpha = e / np.repeat(np.add.reduceat(e, first), counts)
        pooled = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        return pooled @ w["out"] + w["bias"][0], {"h": h, "v": v, "u": u, "alpha": alpha, "pooled": pooled, "first": first}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.forward(*self.encode(texts))[0].astype(np.float64)))


def train(texts: list[bytes], labels: list[int], prior: float | None = None, steps: int = 400, seed: int = 5) -> Attention:
    """Fit on labelled texts with Adam; ``prior`` is the share of label 1 outside a balanced sample."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    draw = lambda *shape: rng.normal(0, 0.4, shape).astype(np.float32)
    w = {"enc": draw(FEATURES, HIDDEN), "enc_b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "out": draw(HIDDEN), "bias": np.zeros(1, np.float32)}
    net = Attention(np.zeros(1 << GRAM_BITS, np.float32), w)
    rate = float(y.mean()) if prior is None and len(y) else (prior or 0.5)
    if len(set(labels)) < 2:
        w["out"][:] = 0
        w["bias"][0] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        return net
    f, grams, where, counts = passages(texts)
    text_of = np.repeat(np.arange(len(texts)), counts)
    side = y[text_of[where]] == 1
    p, q = (np.bincount(grams[m], minlength=1 << GRAM_BITS) + 1.0 for m in (side, ~side))
    net.evidence = np.clip(np.log(p / p.sum()) - np.log(q / q.sum()), -3, 3).astype(np.float32)
    f, counts = net.encode(texts)
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean())).astype(np.float32) / len(y)
    moment = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in w.items()}
    for tick in range(1, steps + 1):
        logit, m = net.forward(f, counts)
        d = (1 / (1 + np.exp(-logit)) - y) * weight
        h, v, u, alpha = m["h"], m["v"], m["u"], m["alpha"]
        spread = np.repeat(d, counts)
        g = {"out": m["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
        dalpha = spread * (h @ w["out"])
        de = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, m["first"]), counts))
        g["a"] = (v * u).T @ de
        dv, du = de[:, None] * w["a"] * u * (1 - v * v), de[:, None] * w["a"] * v * u * (1 - u)
        g["v"], g["u"] = h.T @ dv, h.T @ du
        dh = (alpha * spread)[:, None] * w["out"] + dv @ w["v"].T + du @ w["u"].T
        dz = dh * (1 - h * h)
        g["enc"], g["enc_b"] = f.T @ dz, dz.sum(axis=0)
        for k, grad in g.items():
            a, b = moment[k]
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            w[k] -= (0.03 * (a / (1 - 0.9**tick)) / (np.sqrt(b / (1 - 0.99**tick)) + 1e-7)).astype(np.float32)
    return net


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", per_class: int = 800) -> Attention:
    """Train on about ``per_class`` whole texts of each label (the bound of the sample); null labels are left out."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(id_col, text_col, label_col)
    return trained(*labelled_sample(rows, text_col, label_col, id_col, per_class, train))


def score(docs: DataFrame, net: Attention, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Append ``score`` and ``predicted``; null and empty texts score as one empty passage."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(texts: list[bytes]) -> list:
        s = model.value.scores(texts)
        return [s, (s >= threshold).astype(np.int32)]

    return annotate(docs, text_col, added, run, keep)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = fold_bucket("doc_id", 5) == 0
    net = fit(labelled_rows(docs.where(~held), labels, "quality"))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), net, keep=["doc_id", "held_out"])
