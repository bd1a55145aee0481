"""Benchmark decontamination: SimHash of windows sized by the item, multi-index Hamming blocks, exact check.

DataFrame expressions only. The items' lengths give the windows: an item under 8 words its own length, under 15
words 8, under 93 words 12, then 24 and 48 (``CLASSES``). With a similarity of 0.8 an item of L words has lost at most
a ninth of its shingles, so beside at most L / 45 edits inside it some stretch of a window and a stride
stands unchanged. Windows of each length that the benchmark needs are laid over whole documents, a stride
apart and at the text's end, and over each item at a whole stride of places in every such stretch.

A window's fingerprint is the SimHash of its word pairs (of the word, for items of one): bit by bit the
majority of the pairs' hashes, added up for all bits at once by full adders and in lanes of bytes, so 64
sums cost a few operations a pair and stay inside generated code. Fingerprints are cut into BLOCKS blocks.
Two within RADIUS bits differ by at most one bit in some block, so the items' blocks are indexed under all
values so near, and a join on (class, block, value) finds all fingerprints within the radius.

Each candidate is then compared exactly: every placing of the item around the window that puts a shared
shingle in its place, by weighted Jaccard similarity of five-word shingles, weighted by how often each
stands there. An item of fewer words is one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

SHINGLE, BITS = 5, 64
RADIUS, BLOCKS = 7, 4
WIDTH = BITS // BLOCKS
#: (least words of an item, words of its windows, stride); items of less than eight words have their own length.
CLASSES = (*((n, n, 1) for n in range(1, 9)), (15, 12, 4), (93, 24, 8), (189, 48, 16))
STRIDE = {size: step for _, size, step in CLASSES}
#: Word pairs of a document that are laid out at a time, and items that are searched for at a time (which bounds the broadcast).
PART, ITEMS_AT_ONCE = 2048, 1000
_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words with A-Z lowered; null and blank texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trimmed = F.btrim(lowered, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_class(size: Column) -> Column:
    """Words of the windows of an item of ``size`` words."""
    out = F.lit(0)
    for least, words_each, _ in CLASSES:
        out = F.when(size >= least, F.lit(words_each)).otherwise(out)
    return out


def shingles(hashes: Column, each: Column) -> Column:
    """Hash of every run of ``each`` word hashes."""
    last = F.size(hashes) - each + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, each)))).otherwise(F.array().cast("array<bigint>"))


def majority(rows: DataFrame, inputs: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``print``: of each bit whether at least half of the inputs (an even number up to 62) have it.

    Two layers of full adders turn three columns of one weight into a sum and a carry, for all 64 bits at once.
    What they leave is added up in eight columns of eight lanes of a byte: column k counts the bits k, k + 8, ...
    """
    digits = {0: inputs}
    for layer in range(2):
        made, after = [], {}
        for weight, cols in sorted(digits.items()):
            for g in range(0, len(cols) - 2, 3):
                a, b, c = (F.col(x) for x in cols[g : g + 3])
                at = len(made)
                made += [a.bitwiseXOR(b).bitwiseXOR(c).alias(f"s{layer}_{at}"), a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b))).alias(f"c{layer}_{at}")]
                after.setdefault(weight, []).append(f"s{layer}_{at}")
                after.setdefault(weight + 1, []).append(f"c{layer}_{at}")
            rest = cols[len(cols) // 3 * 3 :]
            after.setdefault(weight, []).extend(rest)
            made += [F.col(x) for x in rest]
        rows, digits = rows.select(*keep, *made), after
    lanes = lambda n: F.lit(sum(n << 8 * j for j in range(8))).cast("long")
    counts = []
    for k in range(8):
        total = F.lit((64 - len(inputs) // 2) * 0x0101010101010101).cast("long")  # half of the inputs reach bit 6 of a lane
        for weight, cols in digits.items():
            for x in cols:
                one = F.shiftrightunsigned(x, k).bitwiseAND(lanes(1))
                total = total + (F.shiftleft(one, weight) if weight else one)
        counts.append(F.shiftleft(F.shiftrightunsigned(total.bitwiseAND(lanes(64)), 6), k).alias(f"bits{k}"))
    rows = rows.select(*keep, *counts)
    every = F.col("bits0")
    for k in range(1, 8):
        every = every.bitwiseOR(F.col(f"bits{k}"))
    return rows.select(*keep, every.alias("print"))


def features(rows: DataFrame, keep: list[str], singles: bool) -> DataFrame:
    """``keep``, n, pairs (hashes of neighbouring words) and, for windows of one word, singles of each row's ``words``."""
    none = F.array().cast("array<bigint>")
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1)))).otherwise(none)
    return rows.select(*keep, F.size("words").alias("n"), pairs.alias("pairs"), (F.transform("words", lambda w: F.xxhash64(w)) if singles else none).alias("singles"))


def _laid(size: int, source: str, count: int, padding: list[int]):
    def window(i: Column) -> Column:
        cut = F.slice(F.col(source), i + 1, F.lit(count))
        return F.struct(F.lit(size).alias("class"), i.cast("int").alias("start"), (F.concat(cut, F.array(*(F.lit(x).cast("long") for x in padding))) if padding else cut).alias("w"))

    return window


def prints(rows: DataFrame, classes: list[int], starts, keep: list[str]) -> DataFrame:
    """``keep``, class, start and print of windows of the rows' features; ``starts(class)`` gives their places."""
    wide = max(2, *(c - 1 + (c - 1) % 2 for c in classes))
    every = []
    for c in classes:
        count = max(c - 1, 1)
        ones = wide // 2 - -(-count // 2)  # what is padded leaves the majority as it is
        none = F.array().cast("array<struct<class:int,start:int,w:array<bigint>>>")
        laid = F.transform(starts(c), _laid(c, "pairs" if c > 1 else "singles", count, [-1] * ones + [0] * (wide - count - ones)))
        every.append(F.when(F.col("n") >= c, laid).otherwise(none))
    held = [*keep, "class", "start"]
    laid = rows.select(*keep, F.inline(F.concat(*every) if len(every) > 1 else every[0]))
    taken = [F.coalesce(F.get("w", F.lit(k)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(wide)]
    return majority(laid.select(*held, *taken), [f"w{k}" for k in range(wide)], held)


def block_keys(near: bool) -> Column:
    """An array of join keys (class, block, value) of ``print``; with ``near`` also those one bit away."""
    keys = []
    for block in range(BLOCKS):
        value = F.shiftrightunsigned("print", block * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
        base = F.shiftleft(F.col("class").cast("long") * F.lit(BLOCKS).cast("long") + F.lit(block).cast("long"), WIDTH)
        keys += [base.bitwiseOR(value.bitwiseXOR(F.lit(mask).cast("long"))) for mask in [0, *(1 << j for j in range(WIDTH) if near)]]
    return F.array(*keys)


def item_index(items: DataFrame, classes: list[int]) -> DataFrame:
    """key, item_print, code and shift (the window's first word in the item) of the items' windows."""
    index = None
    for c in classes:
        span, stretch = F.col("n") - c, c + STRIDE[c] - 1

        def places(_, span=span, stretch=stretch, step=STRIDE[c]):
            every = F.sequence(F.lit(0), span)
            return F.when(span < 2 * stretch, every).otherwise(F.filter(every, lambda o: (o % stretch < step) | (o > span - step)))

        own = prints(features(items.where(F.col("class") == c), ["code"], c == 1), [c], places, ["code"])
        index = own if index is None else index.union(own)
    return index.select(F.explode(block_keys(True)).alias("key"), F.col("print").alias("item_print"), "code", F.col("start").alias("shift"))


def candidates(docs: DataFrame, items: DataFrame, classes: list[int]) -> DataFrame:
    """id, code and place: where a window of a document (id, words) lies within the radius of an item's, the item would begin at place."""
    whole = features(docs, ["id"], 1 in classes)
    overlap = max(classes)
    cut = lambda name, b: F.slice(name, b + 1, F.lit(PART + overlap - 1)).alias(name)
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PART)), lambda b: F.struct(b.alias("base"), F.least(F.col("n") - b, F.lit(PART + overlap - 1)).alias("n"), cut("pairs", b), cut("singles", b)))
    parts = F.when(F.col("n") > 0, parts).otherwise(F.array().cast("array<struct<base:int,n:int,pairs:array<bigint>,singles:array<bigint>>>"))
    last = lambda c: F.least(F.lit(PART - 1), F.col("n") - c)
    starts = lambda c: F.sequence(F.lit(0), last(c)) if STRIDE[c] == 1 else F.array_union(F.sequence(F.lit(0), last(c), F.lit(STRIDE[c])), F.array(last(c)))
    windows = prints(whole.select("id", F.inline(parts)), classes, starts, ["id", "base"])
    keyed = windows.select("id", (F.col("base") + F.col("start")).alias("start"), "print", F.explode(block_keys(False)).alias("key"))
    index = F.broadcast(item_index(items, classes))  # of about ITEMS_AT_ONCE items at most
    near = keyed.join(index, "key").where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    return near.select("id", "code", (F.col("start") - F.col("shift")).alias("place")).distinct()


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, weights being their counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    least = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return least / (F.size(a) + F.size(b) - least)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """id, item, first word, similarity: the best window of each document over each item it holds.

    Null and empty texts, items without a word and documents without an id match nothing. Rows that
    share an id are one document; repeated items count once, of texts that share an item id the best
    counts, and an item without id is reported with a null one. Of equally good windows the first counts.
    """
    hashes = lambda text: F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    named = benchmark.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("item_words"), hashes(item_text).alias("h")).withColumn("code", F.xxhash64("h"))
    items = named.where(F.size("h") > 0).dropDuplicates(["code"])
    items = items.select("code", "h", "item_words", window_class(F.size("h")).alias("class"))
    known = items.agg(F.count("*").alias("n"), F.collect_set("class").alias("classes")).first()
    times = max(-(-known["n"] // ITEMS_AT_ONCE), 1)
    texts, found = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")), None
    for k in range(times):  # a benchmark of many items is searched for in blocks
        block = items.select("code", F.col("item_words").alias("words"), "class").where(F.pmod(F.xxhash64("code"), F.lit(times)) == k)
        own = candidates(texts, block, sorted(known["classes"]) or [1])
        found = own if found is None else found.union(own)
    found = settle(found.distinct())
    # exact comparison, around each candidate
    each = F.least(F.col("size"), F.lit(SHINGLE))
    facts = items.withColumn("size", F.size("h")).select("code", "size", shingles(F.col("h"), each).alias("ih"))
    reach = (F.col("size") / 4 + 4).cast("int")
    wanted = found.join(facts.select("code", "size", reach.alias("reach")), "code").groupBy("id").agg(F.collect_set(F.struct("code", "size", "reach", F.greatest("place", F.lit(0)).alias("place"))).alias("places"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("doc_text")).join(wanted, "id").select("id", "places", hashes("doc_text").alias("h"))
    low = lambda p: F.greatest(p["place"] - p["reach"], F.lit(0))
    # h is named twice here, so that the optimizer keeps it as a column and does not work it out again for every place
    around = F.transform("places", lambda p: F.struct(p["code"].alias("code"), F.least(p["place"] + p["reach"], F.size("h")).alias("high"), low(p).alias("low"), F.slice("h", low(p) + 1, p["size"] + p["reach"] * 2).alias("near")))
    near = texts.select("id", F.inline(around)).join(facts, "code").select("*", shingles(F.col("near"), each).alias("ng"))
    at = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.size("ih") - 1), lambda o: F.element_at("ih", o + 1) == F.element_at("ng", i + 1)), lambda o: F.greatest(F.col("low") + i - o, F.lit(0)))
    placings = F.when(F.size("ng") > 0, F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("ng") - 1), lambda i: F.array_contains("ih", F.element_at("ng", i + 1))), at))).otherwise(F.array().cast("array<int>"))
    placed = near.select("id", "code", "size", "ih", "near", "low", F.explode(F.array_distinct(F.filter(placings, lambda s: (s >= F.col("low")) & (s <= F.col("high"))))).alias("start"))
    window = shingles(F.slice("near", F.col("start") - F.col("low") + 1, F.col("size")), each)
    # settled, as the filter would else be pushed below the windows and work each of them out again for every shingle
    scored = settle(placed.select("id", "code", "start", "ih", window.alias("wg"))).select("id", "code", "start", similarity(F.col("wg"), F.col("ih")).alias("similarity")).where(F.col("similarity") >= threshold)
    names = named.select("code", "item").distinct()
    best = scored.join(names, "code").groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("id", "item", (-F.col("best.s")).alias("first_word"), F.col("best.similarity").alias("similarity"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word and similarity of every item found; see ``contaminated`` for nulls, repeats and ties."""
    return contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "similarity")
