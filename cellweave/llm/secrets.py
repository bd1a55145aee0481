"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame expressions only. Two first-order models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: random strings are drawn from digests over the usual
alphabets (hexadecimal, base 64 and its URL form, base 62, lower and upper base 36), ordinary ones are the
words of all documents outside the fixed patterns. A token of TOKEN_LEAST characters or more that holds a
letter is a span of kind ``markov`` if its mean log-likelihood ratio a pair of characters passes the
threshold. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed patterns (kind, pattern, group that is measured, its least length).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(k for k, *_ in BASE), "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_LEAST = 16
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
WORDLIKE = r"[A-Za-z0-9+/_=-]{4,}"


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern, as structs (start, kind's rank, end, value): the gaps that ``split`` leaves give the offsets.

    Only a text that has a match is taken apart.
    """
    hits = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    nothing = F.array().cast("array<struct<start:int,rank:int,stop:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))
    rank = F.lit(KINDS.index(kind))

    def step(acc: Column, x: Column) -> Column:
        begin = (acc["at"] + x["gap"]).cast("int")
        span = F.array(F.struct(begin.alias("start"), rank.alias("rank"), (begin + x["size"]).cast("int").alias("stop"), x["value"].alias("value")))
        good = x["size"].isNotNull() & (F.char_length(x["value"]) >= least)
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).cast("int").alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(hits, start, step, lambda acc: acc["spans"])).otherwise(nothing)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(found(text, *spec) for spec in BASE)))


def random_strings(spark: SparkSession, each: int = 4000) -> DataFrame:
    """Labelled random strings (value, random = 1): ``each`` digests, written in every alphabet."""
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    short = F.translate(plain, "+/=", "")
    forms = F.array(digest, F.translate(plain, "=", ""), F.translate(plain, "+/=", "-_"), short, F.lower(short), F.upper(short))
    return spark.range(each).select(F.explode(forms).alias("value"), F.lit(1).alias("random"))


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled strings: random ones (random 1), and the words of all documents outside the fixed patterns (random 0)."""
    plain = F.coalesce(F.col(text_col), F.lit(""))
    for _, pattern, _, _ in BASE:
        plain = F.regexp_replace(plain, pattern, " ")
    words = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(WORDLIKE), F.lit(0))).alias("value"), F.lit(0).alias("random"))
    return random_strings(docs.sparkSession).union(words)


def train(samples: DataFrame, value_col: str = "value", label_col: str = "random") -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each pair of characters, add-half smoothed.

    Pairs are counted before they reach the driver: at most 2 * len(ALPHABET)^2 rows do.
    """
    value = F.col(value_col)
    pairs = samples.where(F.char_length(value) >= 2).select(F.col(label_col).alias("label"), F.explode(F.transform(F.sequence(F.lit(1), F.char_length(value) - 1), lambda i: value.substr(i, F.lit(2)))).alias("pair"))
    n = len(ALPHABET)
    counts = {0: [0.5] * (n * n), 1: [0.5] * (n * n)}
    for row in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").count().collect():
        counts[row["label"]][ALPHABET.index(row["pair"][0]) * n + ALPHABET.index(row["pair"][1])] += row["count"]
    ratio = []
    for a in range(n):
        rows = [counts[k][a * n : a * n + n] for k in (1, 0)]
        ratio += [math.log(p / sum(rows[0])) - math.log(q / sum(rows[1])) for p, q in zip(*rows, strict=True)]
    return ratio


def ratio_of(token: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio a pair of a token."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.char_length(token) - 1
    each = F.zip_with(F.slice(codes, F.lit(1), pairs), F.slice(codes, F.lit(2), pairs), lambda a, b: F.element_at(table, ((a - 1) * len(ALPHABET) + b).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / pairs


def scan(docs: DataFrame, ratio: list[float], text_col: str = "text", threshold: float = 1.0) -> DataFrame:
    """Append ``base_found`` and ``markov_found`` (arrays of spans); null text counts as empty.

    Spans of the models stand beside base spans that they overlap. Input columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base_found", base_spans(text))
    tokens = F.filter(found(text, "markov", TOKEN, 0, TOKEN_LEAST), lambda s: s["value"].rlike("[A-Za-z]") & (ratio_of(s["value"], ratio) > threshold))
    return out.withColumn("markov_found", tokens)


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, ratio: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span by ``mark``; spans that overlap are replaced together. Other rows and all other columns stay."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}  # no input column is named like an added one
    text = F.col(names[text_col])
    spans = F.array_sort(F.concat("base_found", "markov_found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"])))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

    whole = lambda acc: F.array_join(F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, F.char_length(text)))), mark)
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, whole)).otherwise(text)
    inside = scan(docs.withColumnsRenamed(names), ratio, names[text_col])
    return inside.select(*((clean if c == text_col else F.col(names[c])).alias(c) for c in docs.columns))


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    return train(labelled_samples(docs, text_col))


def query(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row. Null and empty texts have none; repeated rows and rows without id are scanned alike."""
    docs = docs.select("doc_id", "text")
    spans = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base_found", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    everything = F.array_sort(F.concat("base_found", "markov_found"))
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k, *_ in BASE), F.sha2(written(F.col("base_found")), 256).alias("base_sha256"), written(everything).alias("spans"))
