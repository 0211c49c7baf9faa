"""A corpus pipeline: language ID, toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdlab.llm import langid, line_dedup, minhash, packing, toxicity
from rdlab.llm.common import Tables

MIN_LANGUAGE_SCORE = 0.4
TOXIC = 0.5
ARROW_BYTES = "16m"  #: of texts handed to Python at once; long texts make batches of 64 MB otherwise, on both sides of each worker


def bounded(spark: SparkSession) -> None:
    """The session's Arrow batches for the stages that run models over texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text), or whose words can't be labelled surely, go; those that switch languages stay. Each row is judged by itself, whatever its id."""
    bounded(spark)
    model = spark.sparkContext.broadcast(langid.train(docs.where(~langid.held_out(F.col("doc_id")))))
    x = spare(docs, "found")
    found = docs.withColumn(x, langid.detect_document("text", model))
    return found.where((F.col(x)["lang"] != langid.NONE) & (F.col(x)["sure"] >= MIN_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of TOXIC or more go; a null or empty text stays. Each row is judged by itself, whatever its id."""
    bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = spark.sparkContext.broadcast(toxicity.train(docs, labels))
    x = spare(docs, "score")
    return docs.withColumn(x, toxicity.score("text", model)).where(F.col(x) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a document keeps its row, even without lines; a null text becomes empty. Rows that repeat an id are documents of their own."""
    out = line_dedup.line_dedup(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, with all rows of this id; so do rows with a null id."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the training sequences: one row for each piece of a document. A null or empty text has one piece of length 0; rows that repeat an id are documents of their own; no rows give no bins."""
    return packing.best_fit_packing(docs.select("doc_id", "source", *packing.sizes(docs)))


STAGES = [("language", language), ("toxicity", toxic), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models decide in the first stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins made of all documents of a folder that every stage keeps; nulls, repeats and empty tables are as the stages say. Each stage's table is removed once the next is written."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
