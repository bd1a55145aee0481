"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate (target over size) gives each document whole copies and a fractional one. Fractions
are paired within salted buckets of a source: mass in words moves from one to the other at random,
so that each keeps its expectation and their words stay the same, until one is 0 or 1. What a bucket
leaves over is combined up a reduction tree; only the last document of a source is rounded alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import WORD, settle

MOST_COPIES, BUCKET, FAN_IN = 3, 5000, 64


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Words to take of each source. Sources by code point, null last, weigh ``weights``, repeating.

    A target stops at MOST_COPIES times its source; what is over is shared anew by weight among the rest.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, whole = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > MOST_COPIES * sizes[s]]
        if not above:
            return {s: fixed.get(s, share.get(s, 0.0)) for s in order}
        fixed |= {s: float(MOST_COPIES * sizes[s]) for s in above}


def pivot(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move mass along the rows until all but one chance is 0 or 1. Rows have sizes over 0."""
    p = chance.tolist()
    words = size.tolist()
    draw = rng.random(len(p)).tolist()
    i = 0
    for j in range(1, len(p)):
        ratio = words[j] / words[i]
        gain, give = 1 - p[i], p[j] * ratio
        lose, take = p[i], (1 - p[j]) * ratio
        a, b = min(gain, give), min(lose, take)
        up = draw[j] * (a + b) < b
        if up and gain > give:
            p[i], p[j] = p[i] + a, 0.0
        elif not up and lose > take:
            p[i], p[j] = p[i] - b, 1.0
        else:
            p[j] = min(max(p[j] - a / ratio if up else p[j] + b / ratio, 0.0), 1.0)
            p[i] = 1.0 if up else 0.0
            i = j
    return np.array(p)


def _round(level: int, seed: int):
    """Pivot the open chances of one bucket of a source. Arrow throughout, so ids keep their type beside nulls."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("turn", "ascending"), ("size", "ascending")]))
        key = f"{rows['source'][0].as_py()}|{rows['bucket'][0].as_py()}|{level}|{seed}"
        chance, size = rows["chance"].to_numpy().copy(), rows["size"].to_numpy().astype(np.float64)
        open_ = np.flatnonzero((chance > 0) & (chance < 1) & (size > 0))
        if len(open_):
            chance[open_] = pivot(chance[open_], size[open_], np.random.default_rng(zlib.crc32(key.encode())))
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(chance))

    return run


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), seed: int = 1, carry: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target and copies (0 to 3) of every row, and the columns named in ``carry``.

    Null text has size 0 and no copy. A null source is a source of its own, the last. The numbers of
    sources and buckets reach the driver, never rows. Reruns over the same files agree: buckets, order and
    draws are hashes of id and text. Rows without an id are dealt by their place in the table too, so
    any number of them, all alike even, spreads over the buckets. An empty table gives no rows.
    """
    carry = carry or []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = settle(docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("hash")))
    totals = {r["source"]: (r["words"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    target = targets({s: w for s, (w, _) in totals.items()}, weights)
    rows = [(s, w, target[s], target[s] / w if w else 0.0, -(-n // BUCKET)) for s, (w, n) in totals.items()]
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "of string, source_size long, target double, rate double, buckets long")
    held = [f"c{k}" for k in range(len(carry))]
    placed = sized.withColumn("place", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))
    turn = F.xxhash64("id", "size", "hash", "place", F.lit(seed))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state = joined.select(*held, "id", "source", "size", "source_size", "target", F.least(F.floor("rate"), F.lit(MOST_COPIES)).cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"), F.pmod(turn, F.col("buckets")).alias("bucket"), turn.alias("turn"))
    schema, parts, level = state.schema, [], 0
    buckets = max((r[4] for r in rows), default=0)
    while True:
        state = settle(state.groupBy("source", "bucket").applyInArrow(_round(level, seed), schema))
        left = (F.col("chance") > 0) & (F.col("chance") < 1) & (F.col("size") > 0)
        parts.append(state.where(~left))
        state, level = state.where(left), level + 1
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN_IN)
        state = state.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    last = F.pmod(F.col("turn"), F.lit(1 << 20)) / (1 << 20) < F.col("chance")
    parts.append(state.withColumn("chance", last.cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + (F.col("chance") >= 0.5).cast("int"), F.lit(MOST_COPIES))).otherwise(0)
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; see ``mix`` for nulls, repeats and empty tables."""
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
