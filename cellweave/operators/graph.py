"""Connected components of an edge table, distributed."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels

#: Fixed value: so many edges are finished in one task.
LAST_EDGES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir, or a temporary folder where all runs in one local JVM."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cellweave-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the session's shared folder, so a lost executor costs no recomputation.

    The result is a plain table of the checkpointed rows: a checkpoint alone would keep the plan's estimate of
    its size, and estimates of joins multiply, round after round of a loop, to numbers of millions of digits.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def components(edges: DataFrame, a: str = "a", b: str = "b", hubs: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its lowest node.

    Every round points each node's larger neighbours at its lowest one, then each node and its smaller
    neighbours too; chains halve, so rounds grow with the logarithm of the longest. Only two numbers a
    round reach the driver. With ``hubs`` both sides of the widest join are tables, plain exchanges then,
    so that adaptive execution can split the edges of a node with very many of them.
    """
    pairs = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    pairs, before = pairs.where("u != v"), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        low = settle(low) if hubs else low
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        rest = larger.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(rest.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    low = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(low, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def few_components(edges: DataFrame) -> DataFrame:
    """What ``components`` gives of at most LAST_EDGES edges (a long, b long), all in one task and without its rounds."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for batch in batches]
        x, y = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(2))
        names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
        lowest = names[kernels.components(len(names), ends[: len(x)], ends[len(x) :])]
        for k in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in (names, lowest)], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(finish, "node long, component long")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w) of the edges in the minimum spanning forest of an edge table (a long, b long, w double), by w, then a, then b.

    The heaviest edge of a circle is never in it, so each task first thins its own edges as they come, and only
    what is left is moved. While that is over LAST_EDGES, each component's lightest edge is taken and its
    ends become one node (Boruvka); then one task finishes.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "w", "u", "v"]
        kept, waiting, size = None, [], 0
        for batch in batches:
            waiting.append([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
            size += batch.num_rows
            if size >= max(1 << 18, 0 if kept is None else len(kept[0])):
                kept, waiting, size = lightest(kept, waiting), [], 0
        kept = lightest(kept, waiting) if waiting else kept
        if kept is not None:
            for k in range(0, len(kept[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in kept], names=names)

    def lightest(kept, waiting):
        columns = [np.concatenate(c) for c in zip(*([kept] if kept else []), *waiting, strict=True)]
        chosen = kernels.spanning_forest(*columns)
        return [c[chosen] for c in columns]

    schema = "a long, b long, w double, u long, v long"
    left = settle(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").mapInArrow(thin, schema))
    taken = []
    while (n := left.count()) > LAST_EDGES:
        ends = left.withColumn("x", F.explode(F.array("u", "v")))
        least = settle(ends.groupBy("x").agg(F.min(F.struct("w", "a", "b", "u", "v")).alias("e")).select("e.*").distinct())
        taken.append(least.select("a", "b", "w"))
        into = components(least, "u", "v")
        for c in ("u", "v"):
            left = left.join(into.select(F.col("node").alias(c), F.col("component").alias("to")), c).drop(c).withColumnRenamed("to", c)
        # parallel edges meet in one task and are thinned to one
        left = settle(left.where("u != v").select("a", "b", "w", "u", "v").repartition(max(1, 4 * n // LAST_EDGES), F.least("u", "v")).mapInArrow(thin, schema))
    out = left.coalesce(1).mapInArrow(thin, schema).select("a", "b", "w")
    for t in taken:
        out = out.union(t)
    return settle(out)
