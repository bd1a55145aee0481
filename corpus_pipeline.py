"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, mixing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the session's shared folder and reads again as the next one's documents. All
but the last return the columns of documents; the last adds ``copies`` (1 to 3) and keeps the rows
that are taken at least once.

Decisions are made row by row, never by id: rows without an id, and rows that repeat one, are documents
of their own. Columns beyond those of documents are carried through, whatever their names; only an input
column named ``copies`` gives way to the last stage's. Empty tables pass every stage as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.llm import decontamination, mixing, neardup, secrets, toxicity
from cellweave.llm.common import settle, shared_folder, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"{name}_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names each row, and its name: file and place in it, or a settled number."""
    name = _free(docs, "row_key")
    try:
        return docs.select(*docs.columns, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(name)), name
    except AnalysisException:  # not rows of files
        return settle(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and wordless texts score low and stay. Equal texts are decided alike. Without labels of both
    kinds the model has nothing to tell by and rejects nothing.
    """
    labels = table(spark, sf_dir, "labels")
    net = toxicity.fit(toxicity.labelled_rows(docs, labels, "toxic"))
    names = _free(docs, "score"), _free(docs, "predicted")
    return toxicity.score(docs, net, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one with the lowest id.

    Rows without id come after all others; of rows with equal ids the first in the files stays. Null
    and wordless texts have no shingle, belong to no group and all stay.
    """
    rows, key = _numbered(docs)
    found = settle(neardup.near_duplicates(rows, words_each=5, carry=[key]).where("grp IS NOT NULL").select("grp", "doc", key))
    best = found.groupBy("grp").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", key)).alias("best")).select(f"best.{key}")
    gone = found.select(key).join(best, key, "left_anti")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; an empty benchmark keeps everything."""
    rows, key = _numbered(docs)
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return rows.join(found.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark and ``n_chars`` follows; no document goes. Null texts stay null."""
    clean = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document so that the sources reach their target weights.

    Null and wordless texts are taken 0 times and go; a null source is a source of its own.
    """
    rows, key = _numbered(docs)
    mixed = mixing.mix(rows, carry=[key]).where("copies > 0").select(key, F.col("copies").alias(_free(rows, "times")))
    kept = [c for c in docs.columns if c != "copies"]
    return rows.join(mixed, key).select(*kept, F.col(_free(rows, "times")).alias("copies"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Trained models and iterated components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
