"""What the text operators share: the word pattern, table reading, lineage cuts and Arrow plumbing."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.graph import settle, shared_folder  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_bucket(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(text_col))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def annotate(docs: DataFrame, text_col: str, added: T.StructType, function: Callable[[list[bytes]], list], keep: list[str] | None = None) -> DataFrame:
    """Append to each row what ``function`` (texts -> one array per added column) finds in its text.

    One narrow Arrow pass. An input column named like an added one is replaced. ``keep`` names the
    input columns to carry (default: all), so that the scan reads no others.
    """
    names = [f.name for f in added]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*carried, F.col(text_col).alias("__text")) if text_col in names or text_col not in carried else docs.select(*carried)
    text_at = "__text" if "__text" in source.columns and text_col not in carried else text_col
    schema = T.StructType([source.schema[c] for c in carried] + list(added))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_types = [f.type for f in to_arrow_schema(T.StructType(list(added)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_at)
            parts: list[list] = [[] for _ in names]
            for a, b in pieces(texts):
                for part, values in zip(parts, function(texts[a:b]), strict=True):
                    part.extend(values.tolist() if isinstance(values, np.ndarray) else values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried] + [pa.array(p, t) for p, t in zip(parts, arrow_types, strict=True)],
                names=carried + names,
            )

    return source.mapInArrow(run, schema)


def bounded_sample(docs: DataFrame, strata: list[str], text_col: str, salt_col: str, per_stratum: int) -> DataFrame:
    """About ``per_stratum`` rows of each stratum and at most twice as many in all; reruns pick the same rows.

    Rows are picked by a hash of ``salt_col`` and the text, so neither a repeated id nor a missing one picks
    many at once, and repeated rows are cut at the bound. Only the strata and their counts come to the driver.
    """
    counts = docs.groupBy(*strata).count().collect()
    if not counts:
        return docs.limit(0)
    unit = F.pmod(F.xxhash64(F.col(salt_col), F.col(text_col), F.lit(17)), F.lit(1 << 30))
    wanted = F.lit(False)
    for row in counts:
        share = min(1.0, per_stratum / row["count"])
        same = F.lit(True)
        for name in strata:
            same = same & F.col(name).eqNullSafe(F.lit(row[name]))
        wanted = wanted | (same & (unit < F.lit(int(share * (1 << 30)))))
    return docs.where(wanted).orderBy(unit, *strata).limit(2 * per_stratum * len(counts))


def trained(sample: DataFrame, function: Callable[[list[tuple]], object]) -> object:
    """What ``function`` makes of the rows of a bounded sample, in one task of an executor; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        packed = pickle.dumps(function(rows))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else function([])
