"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets form a class; classes are
linked when the Jaccard similarity of their sets reaches the threshold. In each of ``TREES``
independent trees a class branches, level by level, on the token of its set that is lowest under a
hash chosen by the path so far, so two classes stay together down a level with a chance equal to
their similarity. The first nodes looked at are ``DEPTH`` levels deep. There every class is held
against a pivot of its node, which joins most groups of copies.

Of the nodes that the confirmed links still leave in more than one component, small ones are compared
exhaustively across their components, those of at most a block on parity bitmaps of the sets: the bits in
which two differ are at most the tokens in which the sets do, so no pair at the threshold is passed over.
Larger ones branch on: ``STEP`` levels deeper, ``FORKS`` times over, so that a pair at the threshold goes
on with a chance of 0.87 a step while others thin out. Where that does not thin a node out, as its members
resemble each other nearly as much as the threshold asks, it is compared exhaustively too, block by block.
The blocks of a node's widest component are held against those of its other members, not against each other.
Recursion ends when no large node is left; there is no limit on depth, members or candidates.

Every link is confirmed on full sets. A pair of similarity 0.8 is missed with a chance of
(1 - 0.8 ** 3) ** 16, about 1e-5, in nodes of up to a block and in dense ones, and of less than 1e-3 further down.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import graph
from .common import settle, texts_of

TREES, DEPTH, SMALL = 16, 3, 24
STEP, FORKS = 2, 2
#: A large node whose pairs stay together more often than this in a step is dense: it is compared, not branched.
DENSE = 0.36
#: Members of a node, or of two halves of a wider one, that one task compares.
BLOCK = 2048
HALF = BLOCK // 2
_SEEDS = np.random.default_rng(41).integers(1, 2**62, TREES).astype(np.uint64)
_FORK_SEEDS = np.random.default_rng(43).integers(1, 2**62, FORKS).astype(np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: bytes, words_each: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words the whole sequence is one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - words_each + 1, 1)
    code = np.full(n, np.uint64(min(len(h), words_each)))
    for k in range(min(words_each, len(h))):
        code = ((code ^ (code >> np.uint64(29))) * _MORE + h[k : k + n]) * _MIX
    code ^= code >> np.uint64(32)
    return np.unique(code * _MORE)


def deeper(tokens: np.ndarray, nodes: np.ndarray, levels: int) -> np.ndarray:
    """The nodes that a set reaches ``levels`` below each of these: at every level it follows the token lowest there."""
    if nodes.size > 1 and nodes.size * tokens.size > 4_000_000:  # very long texts: a part of the nodes at a time
        half = nodes.size // 2
        return np.concatenate([deeper(tokens, nodes[:half], levels), deeper(tokens, nodes[half:], levels)])
    state = nodes.copy()
    for _ in range(levels):
        order = (tokens[None, :] ^ state[:, None]) * _MIX
        order ^= order >> np.uint64(31)
        chosen = tokens[(order * _MORE).argmin(axis=1)]
        state = ((state ^ (state >> np.uint64(30))) * _MORE + chosen) * _MIX
    return state


def forked(tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """[node, fork]: the nodes ``STEP`` levels below, along ``FORKS`` independent paths."""
    return np.stack([deeper(tokens, (nodes ^ seed) * _MIX, STEP) for seed in _FORK_SEEDS], axis=1)


def _features(docs: DataFrame, text_col: str, id_col: str, words_each: int, carry: list[str]) -> DataFrame:
    """Carried columns, doc, n, the digest (lo, hi) of the set, text hash and the first nodes of every row."""
    source = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("__text"))
    kept = source.schema.fields[:-1]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n", "lo", "hi")), T.StructField("nodes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in texts_of(batch, "__text"):
                tokens = shingle_set(text, words_each)
                sizes.append(len(tokens))
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                keys.append(deeper(tokens, _SEEDS, DEPTH) if len(tokens) else np.zeros(TREES, np.uint64))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * TREES)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            nodes = pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), nodes], names=schema.names)

    return source.mapInArrow(run, schema)


def _sets(texts: DataFrame, words_each: int, made, kind: str) -> DataFrame:
    """id and what ``made`` makes of the set (and the row's ``nodes``, where there are any) of each text of (id, lo, hi, __text).

    A text whose set has another digest is not the class's and is left out.
    """
    others = [c for c in texts.columns if c not in ("id", "lo", "hi", "__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = at or {n: k for k, n in enumerate(batch.schema.names)}
            ids, lo, hi = (batch.column(at[c]).to_pylist() for c in ("id", "lo", "hi"))
            extra = [batch.column(at[c]).to_pylist() for c in others]
            out_ids, out = [], []
            for k, text in enumerate(texts_of(batch, "__text")):
                tokens = shingle_set(text, words_each)
                if xxhash.xxh3_128_digest(tokens.tobytes()) == lo[k].to_bytes(8, "little", signed=True) + hi[k].to_bytes(8, "little", signed=True):
                    out_ids.append(ids[k])
                    out.append(made(tokens, *(e[k] for e in extra)))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, arrow)], names=["id", "value"])
                    out_ids, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, arrow)], names=["id", "value"])

    arrow = {"array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}[kind]
    return texts.mapInArrow(run, f"id long, value {kind}")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of at least eight bits a token, a power of two in all."""
    size = 1 << max(10, (8 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def forest(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of edges that join what all of them join: every component takes its heaviest edge, round by round."""
    names, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = ends[: len(left)], ends[len(left) :]
    label, order, taken = np.arange(len(names)), np.argsort(weight, kind="stable"), []
    while True:
        order = order[label[x[order]] != label[y[order]]]
        if not len(order):
            return np.unique(np.concatenate([*taken, np.zeros(0, np.int64)])).astype(np.int64)
        heaviest = np.full(len(names), -1)
        for side in (x, y):
            best = np.full(len(names), -1)
            best[label[side[order]]] = np.arange(len(order))  # of equal places the last one stays, which is the heaviest
            heaviest = np.maximum(heaviest, best)
        edges = order[np.unique(heaviest[heaviest >= 0])]
        taken.append(edges)
        while True:  # the lowest label spreads over the edges taken
            low = np.minimum(label[x[edges]], label[y[edges]])
            spread = label.copy()
            np.minimum.at(spread, label[x[edges]], low)
            np.minimum.at(spread, label[y[edges]], low)
            if (spread[label] == label).all():
                break
            label = spread[label]


def block_candidates(block: pa.Table, percent: int, layers: int = 1) -> pa.Table:
    """Pairs (a, b) of one block of a node that may reach the threshold, between different components.

    Of all of them ``layers`` disjoint forests over the components are given, closest pairs first: where
    they are confirmed the others join nothing more. If any pair is left out, a row (-1, node) says so.
    """
    i, j, own, ids, n, component = (block.column(c).to_numpy() for c in ("i", "j", "own", "id", "n", "component"))
    by_width: dict[int, tuple[list[int], list[bytes]]] = {}
    for k, b in enumerate(block.column("bits").to_pylist()):
        at, parts = by_width.setdefault(len(b) // 8, ([], []))
        at.append(k)
        parts.append(b)
    groups = {w: (np.array(at), np.frombuffer(b"".join(parts), np.uint64).reshape(-1, w)) for w, (at, parts) in by_width.items()}
    hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for w1, (at1, bits1) in groups.items():
        for w2, (at2, bits2) in groups.items():
            left, right = own[at1] == i[at1], own[at2] == j[at2]
            x, y = at1[left], at2[right]
            width = min(w1, w2)
            one, two = _folded(bits1[left], width), _folded(bits2[right], width)
            for k, row in zip(x.tolist(), one, strict=True):
                near = (100 * np.minimum(n[k], n[y]) >= percent * np.maximum(n[k], n[y])) & (component[k] != component[y])
                if i[k] == j[k]:
                    near &= ids[k] < ids[y]
                near = np.flatnonzero(near)
                both = n[k] + n[y[near]]
                apart = np.bitwise_count(two[near] ^ row).sum(axis=1, dtype=np.int64)
                spare = (100 - percent) * both - (100 + percent) * apart  # from 0 on the pair may reach the threshold
                hit = np.flatnonzero(spare >= 0)
                if len(hit):
                    hits.append((np.full(len(hit), k), y[near[hit]], spare[hit] / both[hit]))
    x, y, weight = (np.concatenate(part) for part in zip(*hits, strict=True))
    rest, taken = np.arange(len(x)), [np.zeros(0, np.int64)]
    for _ in range(layers):
        if len(rest):
            some = rest[forest(component[x[rest]], component[y[rest]], weight[rest])]
            taken.append(some)
            rest = np.setdiff1d(rest, some, assume_unique=True)
    at, none, nodes = np.concatenate(taken), [-1] if len(rest) else [], [block.column("node")[0].as_py()] if len(rest) else []
    a, b = ids[x[at]], ids[y[at]]
    return pa.table({"a": np.r_[np.minimum(a, b), none].astype(np.int64), "b": np.r_[np.maximum(a, b), nodes].astype(np.int64)})


def _block_pairs(rows: DataFrame, bitmaps: DataFrame, percent: int, layers: int) -> DataFrame:
    """What ``block_candidates`` gives of each node, by blocks.

    A node of at most ``BLOCK`` members is one block. A wider one has blocks of about ``HALF``, two of which are
    compared at a time; its widest component has blocks of its own, which come before those of the others.
    """
    held, wide = rows.columns, rows.where(F.col("c") > BLOCK)
    dealt = rows.where(F.col("c") <= BLOCK).select(*held, F.lit(0).alias("own"), F.lit(0).alias("other"))
    if not wide.isEmpty():
        widest = wide.groupBy("node", "component").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", "component")).alias("w"))
        wide = wide.join(settle(widest.select("node", "w.m", F.col("w.component").alias("widest"))), "node")
        inner, outer = F.ceil(F.col("m") / F.lit(HALF)).cast("int"), F.ceil((F.col("c") - F.col("m")) / F.lit(HALF)).cast("int")
        within = F.col("component") == F.col("widest")
        own = F.when(within, F.pmod(F.xxhash64("id"), inner)).otherwise(inner + F.pmod(F.xxhash64("id"), outer)).cast("int")
        others = F.sequence(F.when(within, inner).otherwise(0), inner + outer - 1)
        dealt = dealt.union(wide.select(*held, own.alias("own"), F.explode(others).alias("other")))
    blocks = dealt.join(bitmaps, "id").select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component", F.col("value").alias("bits"))
    return blocks.groupBy("node", "i", "j").applyInArrow(lambda block: block_candidates(block, percent, layers), "a long, b long")


class _Join:
    """The classes of one table, and what is known of their links."""

    def __init__(self, docs: DataFrame, text_col: str, id_col: str, words_each: int, percent: int, carry: list[str]):
        self.words_each, self.percent = words_each, percent
        self.features = settle(_features(docs, text_col, id_col, words_each, carry))
        rep = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th"))
        grouped = self.features.where("n > 0").groupBy("lo", "hi").agg(F.any_value("n").alias("n"), F.any_value("nodes").alias("nodes"), rep.alias("rep"))
        # ids are given once: the table is settled, and whatever comes later reads it
        self.classes = settle(grouped.select(F.monotonically_increasing_id().alias("id"), "lo", "hi", "n", F.col("rep.doc").alias("doc"), F.xxhash64("rep.doc", "rep.th").alias("rep"), "nodes"))
        self.texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("rep"), F.col(text_col).alias("__text"))
        self.of = self.store = None

    def of_classes(self, ids: DataFrame, made, kind: str) -> DataFrame:
        """(id, value): what ``made`` makes of the sets of these classes; ``ids`` may carry more columns for it."""
        rows = self.store.join(ids, "id") if self.store is not None else self.with_texts(ids)
        return settle(_sets(rows.select("id", "lo", "hi", "__text", *(c for c in ids.columns if c != "id")), self.words_each, made, kind))

    def with_texts(self, ids: DataFrame) -> DataFrame:
        """``ids`` with lo, hi and one text of each class: a pass over all texts."""
        wanted = settle(self.classes.select("id", "lo", "hi", "rep").join(ids, "id"))
        rows = self.texts.join(wanted, "rep").drop("rep")
        # rows alike in id and text are one
        return rows.groupBy("id").agg(*(F.any_value(c).alias(c) for c in rows.columns if c != "id"))

    def narrow(self, ids: DataFrame) -> None:
        """From now on only these classes are asked for: their texts are put by."""
        self.store = settle(self.with_texts(ids))

    def near_size(self) -> Column:
        return 100 * F.least("n", "n2") >= self.percent * F.greatest("n", "n2")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Add those of the pairs (a, b) whose full sets reach the threshold, and give the new (id, component)."""
        pairs = settle(pairs.distinct())
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.of_classes(ids, lambda tokens: tokens.view(np.int64), "array<long>")
        self._let_go()
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("value").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("value").alias("tb")), "b")
        shared = F.size(F.array_intersect("ta", "tb"))
        self.good = settle(both.where(100 * shared >= self.percent * (F.size("ta") + F.size("tb") - shared)).select("a", "b"))
        del pairs, ids, sets, both
        self._let_go()
        new = self.good.count()
        if self.of is None or new:
            self.of = settle(self._united(self.good, new))
        return self.of

    def _let_go(self) -> None:
        """Shuffles and checkpoints that nothing reads any more go from the disks: they stay until the driver collects its garbage."""
        gc.collect()
        self.features.sparkSession.sparkContext._jvm.System.gc()

    def _united(self, good: DataFrame, new: int) -> DataFrame:
        """The components with these links, ``new`` in number, added.

        With few enough in all, one task takes the links and those of each class to its component. Else they
        are united in rounds, and of the links only those between two components count.
        """
        of = self.of
        if new + (0 if of is None else of.count()) <= graph.LAST_EDGES:
            links = good if of is None else good.union(of.select("id", "component"))
            return graph.few_components(links).withColumnRenamed("node", "id")
        if of is None:
            return graph.components(good, hubs=True).withColumnRenamed("node", "id")
        for side in "ab":
            good = good.join(of.select(F.col("id").alias(side), F.col("component").alias("of_" + side)), side, "left")
        between = good.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b")
        moved = settle(graph.components(between, hubs=True).select(F.col("node").alias("component"), F.col("component").alias("into")))
        known = of.join(moved, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
        return known.union(moved.select(F.col("component").alias("id"), F.col("into").alias("component")).join(of, "id", "left_anti"))


def members(rows: DataFrame) -> DataFrame:
    """Rows (id, n, node) of nodes with company, with the node's count and a pivot.

    The pivot is the class of lowest number, mostly the same one in the nodes of a group in all trees, so that
    the trees ask for the same pairs.
    Counts are settled, so the join is one of plain exchanges and a hot node can be split.
    """
    pick = F.min(F.struct(F.col("id").alias("pivot"), F.col("n").alias("n2")))
    nodes = settle(rows.groupBy("node").agg(F.count("*").alias("c"), pick.alias("p")).where("c > 1").select("node", "c", "p.pivot", "p.n2"))
    return settle(rows.join(nodes, "node"))


def unsettled(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of nodes that still hold more than one component, with their component."""
    named = settle(rows.join(of, "id", "left").withColumn("component", F.coalesce("component", "id")))
    split = settle(named.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("node"))
    return settle(named.join(split, "node", "left_semi"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words_each: int = 2, percent: int = 80, carry: list[str] | None = None) -> DataFrame:
    """doc, n (set size), component and group of every row, after the columns named in ``carry``.

    The component is the lowest id that links reach; the group is a number that its rows share, null for
    a set without shingles, which links with nothing. Every row is a document of its own: rows that repeat an id
    with other texts link as their texts do, rows without an id too (their component is null where no
    linked row has one). Null and empty texts have an empty set. An empty table gives no rows.
    """
    carry = carry or []
    join = _Join(docs, text_col, id_col, words_each, percent, carry)
    top = members(join.classes.select("id", "n", F.explode("nodes").alias("node")))
    stars = top.where(F.col("id") != F.col("pivot")).where(join.near_size()).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    of = join.confirm(stars)
    rows = top.drop("pivot", "n2")
    while not (rows := unsettled(rows, of)).isEmpty():
        if join.store is None:
            join.narrow(rows.select("id").distinct())
        small = rows.where(F.col("c") <= SMALL)
        other = small.select("node", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
        pairs = small.join(other, "node").where("id < id2 AND component != component2").where(join.near_size()).select(F.col("id").alias("a"), F.col("id2").alias("b"))
        large, below = rows.where(F.col("c") > SMALL), None
        if not large.isEmpty():
            dense, below = _branch(join, large)
            of = _compare(join, pairs, dense)
        else:
            of = join.confirm(pairs)
        if below is None:
            break
        rows = members(below).drop("pivot", "n2")
    lowest = join.classes.join(of, "id", "left").select("lo", "hi", "doc", F.coalesce("component", "id").alias("grp"))
    names = settle(lowest.groupBy("grp").agg(F.min("doc").alias("component")))
    named = settle(lowest.join(names, "grp").select("lo", "hi", "grp", "component"))
    held = [F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]
    linked = join.features.where("n > 0").join(named, ["lo", "hi"]).select(*held, "doc", "n", "component", "grp")
    alone = join.features.where("n = 0").select(*held, "doc", "n", F.col("doc").alias("component"), F.lit(None).cast("long").alias("grp"))
    return linked.union(alone)


def _compare(join: _Join, pairs: DataFrame, dense: DataFrame) -> DataFrame:
    """Links among these pairs and within the nodes of ``dense``, by blocks; gives the components after them.

    A forest of candidates is asked for first. Only where some of them prove no links and others were left out
    are more forests asked for, of the nodes that left some out and are still in parts, until every candidate was
    looked at or joined.
    """
    if dense.isEmpty():
        return join.confirm(pairs)
    bitmaps, layers = join.of_classes(dense.select("id").distinct(), lambda tokens: bitmap(tokens).tobytes(), "binary"), 1
    while True:
        found = settle(_block_pairs(dense, bitmaps, join.percent, layers).distinct())
        asked = found.where("a >= 0")
        of = join.confirm(asked.union(pairs) if layers == 1 else asked)
        left_out = found.where("a < 0").select(F.col("b").alias("node"))
        if left_out.isEmpty() or asked.join(join.good, ["a", "b"], "left_anti").isEmpty():
            return of
        dense, layers = unsettled(dense.drop("component").join(left_out, "node", "left_semi"), of), 16 * layers
        if dense.isEmpty():
            return of


def _branch(join: _Join, large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of nodes to compare as they are, and the rows (id, n, node) of the others one step further down.

    A node of at most a block costs less to compare than to branch, so only wider ones are asked whether they thin out.
    """
    held, large = large.where(F.col("c") <= BLOCK), large.where(F.col("c") > BLOCK)
    if large.isEmpty():
        return held, None
    paths = large.groupBy("id").agg(F.collect_set("node").alias("nodes"))  # nodes of one class: a few a tree

    def step(tokens: np.ndarray, nodes: list[int]) -> list[list[int]]:
        at = np.array(nodes, np.int64)
        below = forked(tokens, at.view(np.uint64)).view(np.int64)
        return [[int(a), *b] for a, b in zip(nodes, below.tolist(), strict=True)]

    moved = join.of_classes(paths, step, "array<array<long>>").select("id", F.explode("value").alias("v"))
    edges = settle(moved.select("id", F.col("v")[0].alias("node"), F.explode(F.slice("v", 2, FORKS)).alias("below")))
    together = edges.groupBy("node", "below").count().groupBy("node").agg(F.sum(F.col("count").cast("double") ** 2).alias("pairs"))
    sizes = large.groupBy("node").agg(F.first("c").alias("c"))
    thick = settle(sizes.join(together, "node").where(F.col("pairs") > DENSE * FORKS * F.col("c") * F.col("c")).select("node"))
    thin = settle(edges.join(thick, "node", "left_anti"))
    rest = thin.join(join.classes.select("id", "n"), "id").select("id", "n", F.col("below").alias("node"))
    return settle(held.union(large.join(thick, "node", "left_semi"))), rest


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; see ``near_duplicates`` for nulls, repeats and empty texts."""
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))
