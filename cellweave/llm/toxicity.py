"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (words of the training sample) beside the mean embedding of its
hashed character trigrams, so invented spellings still carry their stem. Windows of 40 words that
overlap by ten are read in both directions; attention pools the states to one logit a window and a
text scores by its highest window, rescaled on training rows held back from the network.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, bounded_sample, fold_bucket, pieces, trained

WINDOW, STRIDE, GRAM_BITS, STATES, WORD_DIM, CHAR_DIM = 40, 30, 13, 6, 6, 6
STEPS = 240  # least steps of training in all
_SLOTS = 16  # bits of a slot number in the table of known words
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Byte -> folded byte: letters lowered, digits and bytes beyond ASCII kept, all else a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)], np.uint8)
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.tanh(x * np.float32(0.5))
    y *= np.float32(0.5)
    y += np.float32(0.5)
    return y


@dataclass
class Words:
    """The words of some texts, as hashes and hashed character trigrams."""

    key: np.ndarray  # hash of each word
    grams: np.ndarray  # a trigram around each byte of each word
    start: np.ndarray  # first trigram of each word
    counts: np.ndarray  # words of each text

    def of_texts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct word hashes and trigrams of each text."""
        edge = np.r_[0, np.cumsum(self.counts)]
        at = np.r_[self.start, len(self.grams)]
        return [(np.unique(self.key[a:b]), np.unique(self.grams[at[a] : at[b]])) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def words_of(texts: list[bytes]) -> Words:
    """Words are runs of letters, digits and bytes beyond ASCII, case folded (ASCII and Latin-1)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)
    folded = _FOLD[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    folded[accented] += 32
    inside = folded != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    at = np.flatnonzero(inside)
    grams = (folded[at - 1].astype(np.uint32) << np.uint32(16)) + (folded[at].astype(np.uint32) << np.uint32(8)) + folded[at + 1]
    grams = ((grams * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    size = last - first
    start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    # a word's hash: its bytes' values times powers that restart with the word
    within = np.arange(len(at)) - np.repeat(start, size)
    value = _VALUE[folded[at]] * _powers(int(size.max(initial=1)))[within]
    key = np.add.reduceat(value, start) if len(start) else np.zeros(0, np.uint64)
    key = (key ^ (key >> np.uint64(29))) * _ODD
    text_at = np.r_[1, 1 + np.cumsum([len(t) + 1 for t in texts])]
    counts = np.diff(np.searchsorted(first, text_at)) if texts else np.zeros(0, np.int64)
    return Words(key, grams, start, counts)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every overlapping window of texts laid end to end, and its text."""
    starts, lengths, owner, base = [], [], [], 0
    for k, n in enumerate(counts):
        at = np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE) if n else np.zeros(0, np.int64)
        starts.append(at + base)
        lengths.append(np.minimum(WINDOW, n - at))
        owner.append(np.full(len(at), k))
        base += n
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(starts), cat(lengths), cat(owner)


@dataclass
class Network:
    known: np.ndarray  # sorted hashes of the known words; word k has row k + 1 of ``words``, any other has row 0
    first: np.ndarray  # slot -> place of its first hash, and one place more at the end
    w: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    def rows(self, key: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(64 - _SLOTS)).astype(np.int64)
        start, stop, row = self.first[slot], self.first[slot + 1], np.zeros(len(key), np.int32)
        for k in range(int(np.diff(self.first).max(initial=0))):  # as many looks as the fullest slot has words
            at = np.minimum(start + k, len(self.known) - 1)
            row = np.where((start + k < stop) & (self.known[at] == key), at + 1, row)
        return row

    def embed(self, words: Words) -> np.ndarray:
        """[word, WORD_DIM + CHAR_DIM]"""
        out = np.empty((len(words.key), WORD_DIM + CHAR_DIM), np.float32)
        if not len(out):
            return out
        out[:, :WORD_DIM] = self.w["words"][self.rows(words.key)]
        n = np.diff(np.r_[words.start, len(words.grams)]).astype(np.float32)
        for d in range(CHAR_DIM):
            table = np.ascontiguousarray(self.w["chars"][:, d])
            out[:, WORD_DIM + d] = np.add.reduceat(table[words.grams], words.start) / n
        return out

    def logits(self, embedded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.float32)
        projected = embedded @ self.w["wx"] + self.w["b"]
        for a in range(0, len(starts), 512):
            s, n = starts[a : a + 512], lengths[a : a + 512]
            at = np.minimum(s[None] + np.arange(WINDOW)[:, None], len(projected) - 1)
            out[a : a + 512] = self.forward(projected[at], n, False)[0]
        return out

    def forward(self, x: np.ndarray, n: np.ndarray, training: bool = True) -> tuple[np.ndarray, dict]:
        """Logit of each window from its projected inputs; steps beyond a window's length are inert."""
        steps, count = x.shape[:2]
        live = (np.arange(steps)[:, None] < n[None]).astype(np.float32)
        states = np.zeros((steps, count, 2 * STATES), np.float32)
        saved = []
        for way in (0, 1):
            u, h = self.w["u"][way], np.zeros((count, STATES), np.float32)
            cut = slice(way * 3 * STATES, (way + 1) * 3 * STATES)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                g = x[t][:, cut]
                hu = h @ u
                zr = _sigmoid(g[:, : 2 * STATES] + hu[:, : 2 * STATES])
                z, r = zr[:, :STATES], zr[:, STATES:]
                c = np.tanh(g[:, 2 * STATES :] + r * hu[:, 2 * STATES :])
                step = (z * (c - h)) * live[t][:, None]
                if training:
                    saved.append((way, t, h, z, r, c, hu))
                h = h + step
                states[t, :, way * STATES : (way + 1) * STATES] = h
        tanh = np.tanh(states @ self.w["att"])
        e = tanh @ self.w["att_v"] + (live - 1) * 1e9
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[..., None] * states).sum(axis=0)
        logit = pooled @ self.w["out"] + self.w["bias"][0]
        return logit, {"states": states, "tanh": tanh, "a": a, "pooled": pooled, "saved": saved, "live": live}

    def backward(self, memo: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        states, a, tanh = memo["states"], memo["a"], memo["tanh"]
        g = {k: np.zeros_like(self.w[k]) for k in ("u", "att", "att_v", "out", "bias")}
        g["out"], g["bias"] = memo["pooled"].T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * self.w["out"]
        da = (states * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        g["att_v"] = np.einsum("tb,tbk->k", de, tanh)
        dt = de[..., None] * self.w["att_v"] * (1 - tanh**2)
        g["att"] = np.einsum("tbi,tbk->ik", states, dt)
        dstates = a[..., None] * dp + dt @ self.w["att"].T
        dx = np.zeros((*states.shape[:2], 6 * STATES), np.float32)
        carried = np.zeros((states.shape[1], STATES), np.float32)
        at = None
        for way, t, h, z, r, c, hu in reversed(memo["saved"]):
            if way != at:
                at, carried = way, np.zeros_like(carried)
            u = self.w["u"][way]
            dh = carried + dstates[t][:, way * STATES : (way + 1) * STATES]
            dstep = dh * memo["live"][t][:, None]
            dc = dstep * z * (1 - c * c)
            dz = dstep * (c - h) * z * (1 - z)
            dr = dc * hu[:, 2 * STATES :] * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            dx[t][:, way * 3 * STATES : (way + 1) * 3 * STATES] = np.concatenate([dz, dr, dc], axis=1)
            g["u"][way] += h.T @ dhu
            carried = dh - dstep * z + dhu @ u.T
        return g, dx

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Chance of toxicity of each text: that of its highest window; a text without words gets that of a logit of -4."""
        words = words_of(texts)
        starts, lengths, owner = windows_of(words.counts)
        best = np.full(len(texts), -4.0)
        if len(starts):
            got = self.logits(self.embed(words), starts, lengths)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best[owner[first]] = np.maximum.reduceat(got, first)
        return _sigmoid(self.scale[0] * best + self.scale[1])


def _log_odds(present: list[np.ndarray], labels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that at least ``least`` texts hold, and their smoothed log-odds in positive against negative texts."""
    sides = [np.concatenate([np.zeros(0, np.uint64), *(k.astype(np.uint64) for k, y in zip(present, labels, strict=True) if y == side)]) for side in (0, 1)]
    keys, back = np.unique(np.concatenate(sides), return_inverse=True)
    q, p = np.bincount(back[: len(sides[0])], minlength=len(keys)), np.bincount(back[len(sides[0]) :], minlength=len(keys))
    odds = np.log((p + 0.5) / (np.sum(labels == 1) + 1)) - np.log((q + 0.5) / (np.sum(labels == 0) + 1))
    return keys[p + q >= least], odds[p + q >= least]


def train(texts: list[bytes], labels: list[int], prior: float | None = None, rounds: int = 4, seed: int = 7) -> Network:
    """Fit on labelled texts; ``prior`` is the share of toxic texts outside a balanced sample."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    held = rng.random(len(y)) < 0.25
    fitted = np.flatnonzero(~held)
    words = words_of([texts[i] for i in fitted])
    text_y = y[fitted]
    normal = lambda *shape, by=0.3: rng.normal(0, by, shape).astype(np.float32)
    per_text = words.of_texts()
    keys, odds = _log_odds([k for k, _ in per_text], text_y, 3)
    first = np.searchsorted(keys >> np.uint64(64 - _SLOTS), np.arange((1 << _SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
    w = {"words": normal(len(keys) + 1, WORD_DIM, by=0.05), "chars": normal(1 << GRAM_BITS, CHAR_DIM, by=0.05), "wx": normal(WORD_DIM + CHAR_DIM, 6 * STATES), "b": np.zeros(6 * STATES, np.float32), "u": normal(2, STATES, 3 * STATES, by=0.2), "att": normal(2 * STATES, 2 * STATES), "att_v": normal(2 * STATES), "out": normal(2 * STATES), "bias": np.zeros(1, np.float32)}
    w["words"][1:, 0] = np.clip(odds, -3, 3)
    grams, gram_odds = _log_odds([g for _, g in per_text], text_y, 3)
    w["chars"][grams.astype(np.int64), 0] = np.clip(gram_odds, -3, 3)
    net = Network(keys, first, w)
    if len(set(text_y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.1
        net.scale = (0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
        return net
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    tick = 0
    starts, lengths, owner = windows_of(words.counts)
    gram_edge = np.r_[words.start, len(words.grams)]
    for turn in range(rounds):
        logit = net.logits(net.embed(words), starts, lengths)
        # of each text its highest window, and as many random windows of clean ones
        order = np.lexsort((-logit, owner))
        top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        clean = np.flatnonzero(text_y[owner] == 0)
        pick = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        batch_size = min(128, max(16, len(pick) // 8))
        passes = max(2, -(-STEPS * batch_size // (rounds * len(pick))))  # few texts are gone through more often
        for _ in range(passes):
            rng.shuffle(pick)
            for a in range(0, len(pick), batch_size):
                tick += 1
                p = pick[a : a + batch_size]
                at = np.minimum(starts[p][None] + np.arange(WINDOW)[:, None], len(words.key) - 1)
                inner, back = np.unique(at, return_inverse=True)
                size = gram_edge[inner + 1] - gram_edge[inner]
                begin = np.r_[0, np.cumsum(size)[:-1]]
                within = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(gram_edge[inner], size)
                batch = Words(words.key[inner], words.grams[within], begin, size)
                back = back.reshape(at.shape)
                e = net.embed(batch)
                got, memo = net.forward((e @ w["wx"] + w["b"])[back], lengths[p])
                d = (_sigmoid(got) - text_y[owner[p]]).astype(np.float32) / len(p)
                g, dx = net.backward(memo, d)
                dproj = np.zeros((len(inner), dx.shape[2]), np.float32)
                np.add.at(dproj, back.ravel(), dx.reshape(-1, dx.shape[2]))
                g["wx"], g["b"] = e.T @ dproj, dproj.sum(axis=0)
                de = dproj @ w["wx"].T
                g["words"], g["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
                np.add.at(g["words"], net.rows(batch.key), de[:, :WORD_DIM])
                np.add.at(g["chars"], batch.grams, np.repeat(de[:, WORD_DIM:] / size[:, None], size, axis=0))
                for k, grad in g.items():
                    m, v = moment[k]
                    m *= 0.9
                    m += 0.1 * grad
                    v *= 0.99
                    v += 0.01 * grad * grad
                    rate = 0.01 * (1 - turn / (2 * rounds))
                    w[k] -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    net.scale = _rescale(net, [texts[i] for i in np.flatnonzero(held)], y[held], prior)
    return net


def _rescale(net: Network, texts: list[bytes], y: np.ndarray, prior: float | None) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the highest logit, weighted to the prior."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    p = np.clip(np.concatenate([net.scores(texts[a:b]) for a, b in pieces(texts)]), 1e-6, 1 - 1e-6)
    x = np.log(p / (1 - p))
    share = y.mean() if prior is None else prior
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    a, b = 1.0, 0.0
    for _ in range(2000):
        d = (_sigmoid(a * x + b) - y) * weight
        a, b = a - 0.2 * float((d * x).sum() + 0.002 * (a - 1)), b - 0.2 * float(d.sum())
    return max(a, 0.05), b


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_class: int = 800) -> Network:
    """Train on about ``per_class`` whole texts of each label (the bound of the sample); null labels are left out."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(id_col, text_col, label_col)
    return trained(*labelled_sample(rows, text_col, label_col, id_col, per_class, train))


def labelled_sample(rows: DataFrame, text_col: str, label_col: str, id_col: str, per_class: int, learn) -> tuple[DataFrame, object]:
    """A bounded sample of labelled rows, and the function of its rows that learns with the share of label 1 in all rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else None

    def run(got: list[tuple]) -> object:
        got = sorted((i is None, i or 0, k, (t or "").encode()) for i, t, k in got)
        return learn([t for *_, t in got], [int(k) for _, _, k, _ in got], prior)

    return bounded_sample(rows, [label_col], text_col, id_col, per_class), run


def score(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Append the chance of toxicity and the verdict, under ``names``. Null and wordless texts get a low, fixed score."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    added = T.StructType([T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(texts: list[bytes]) -> list:
        s = model.value.scores(texts)
        return [s, (s >= threshold).astype(np.int32)]

    return annotate(docs, text_col, added, run, keep)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Every row of documents whose id has a label; where an id repeats in the labels its lowest label counts."""
    once = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    return docs.select("doc_id", "text").join(once, "doc_id")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; see ``score`` for null and empty texts."""
    held = fold_bucket("doc_id", 3) == 1
    net = fit(labelled_rows(docs.where(~held), labels, "toxic"))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), net, keep=["doc_id", "held_out"])
