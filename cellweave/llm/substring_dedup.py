"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of the last ``GEAR_WINDOW`` bytes is worked out at every byte; a chunk ends where the hash is the
lowest within ``REACH`` bytes to either side. A cut depends on nearby bytes alone, so an insertion
moves no cut beyond it. Chunks are deduplicated by a 128-bit digest: the first occurrence by
(document, place) stays, the others are repeats. Runs of repeated chunks make the reported spans.
A repeat's first ``GEAR_WINDOW + REACH`` and last ``REACH`` bytes can hold no sure cut, and up to the next
cut about 20 bytes more are lost on either side, so equal chunks cover a repeat less about 93 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, texts_of

REACH, GEAR_WINDOW = 20, 12
_GEAR = np.random.default_rng(29).integers(0, 2**32, 256, dtype=np.uint32)
_GEAR[255] = 0  # never in UTF-8: it parts the texts


def cuts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its chunk ends (bytes, the text's end last). An empty text has none."""
    if not texts:
        return []
    gap = GEAR_WINDOW + REACH
    data = np.frombuffer(b"".join(t + b"\xff" * gap for t in texts), np.uint8)
    h = _GEAR[data]
    shift = 1
    while shift < GEAR_WINDOW:
        longer = h.copy()
        longer[shift:] += h[:-shift] << np.uint32(shift)
        h, shift = longer, shift * 2
    h[data == 255] = 0xFFFFFFFF
    low = h.copy()  # lowest of the REACH bytes from here on
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        np.minimum(low[:-step], low[step:].copy(), out=low[:-step])
        width += step
    after, before = np.full_like(h, 0xFFFFFFFF), np.full_like(h, 0xFFFFFFFF)
    after[:-1] = low[1:]
    before[REACH:] = low[:-REACH]
    begins = np.r_[(data[1:] & 0xC0) != 0x80, True]  # cut before a code point only
    cut = np.flatnonzero((h <= after) & (h < before) & (data != 255) & begins) + 1
    out, base = [], 0
    for t in texts:
        own = cut[np.searchsorted(cut, base + 1) : np.searchsorted(cut, base + len(t))] - base
        out.append(np.r_[own, len(t)] if len(t) else own)
        base += len(t) + gap
    return out


def chunks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc, place, first and last byte and digest (lo, hi) of every chunk; ``row`` tells rows without id apart by their text's hash, 0 with an id."""
    schema = "doc long, row long, place int, start int, stop int, lo long, hi long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch, "__text"), batch.column(0).to_pylist()
            for a, b in pieces(texts):
                ends = cuts(texts[a:b])
                digests, starts = [], []
                for text, stop in zip(texts[a:b], ends, strict=True):
                    first = np.r_[0, stop[:-1]] if len(stop) else stop
                    starts.append(first)
                    digests += [xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)]
                n = [len(e) for e in ends]
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                each = pa.array(np.repeat(np.arange(b - a), n))
                owner = pa.array(ids[a:b], pa.int64()).take(each)
                row = pa.array([xxhash.xxh3_64_intdigest(texts[k]) >> 1 if ids[k] is None else 0 for k in range(a, b)], pa.int64()).take(each)
                place = np.arange(sum(n)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                flat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays([owner, row, pa.array(place.astype(np.int32)), flat(starts), flat(ends), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["doc", "row", "place", "start", "stop", "lo", "hi"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_bytes: int = 120) -> DataFrame:
    """Spans of at least ``min_bytes`` whose every chunk stands earlier in this or another document.

    One row a span: the document, first and last byte, chunks and the documents of the first chunk's
    first occurrence. Null and empty texts have no chunk and no row; rows that share an id are one document,
    rows without id are one where their texts are equal.
    """
    every = chunks(docs, text_col, id_col)
    first = every.groupBy("lo", "hi").agg(F.min(F.struct("doc", "row", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("lo", "hi", F.col("first.doc").alias("first_doc"), F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    later = every.join(first, ["lo", "hi"]).where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("row") == F.col("first_row")) & (F.col("place") == F.col("first_place"))))
    by_doc = Window.partitionBy("doc", "row").orderBy("place")
    runs = later.withColumn("run", F.col("place") - F.dense_rank().over(by_doc)).groupBy("doc", "row", "run")
    spans = runs.agg(F.min("start").alias("start_byte"), F.max("stop").alias("end_byte"), (F.max("place") - F.min("place") + 1).cast("long").alias("n_chunks"), F.min_by("first_doc", "place").alias("first_doc_id"))
    return spans.where(F.col("end_byte") - F.col("start_byte") >= min_bytes).select(F.col("doc").alias("doc_id"), "start_byte", "end_byte", "n_chunks", "first_doc_id")


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs.select("doc_id", "text"))
