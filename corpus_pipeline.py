"""The corpus pipeline: quality, language, near-duplicates, mixing, packing, over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all
but the last return the columns of documents. ``run`` writes each stage as Parquet in the shared folder and
reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import langid, minhash, mixing, packing, quality
from normlens.llm.common import broadcast_if_small, materialise
from normlens.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its quality score is below this. It is the classifier's own threshold.
LEAST_QUALITY = quality.THRESHOLD
#: A document goes if no language is found, or none has this mean probability; even odds of four are 0.25.
LEAST_LANGUAGE = 0.3

ORACLE_SQL = None  # trained models, hashing and tokenizers have no SQL form; the tests check each stage


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns of documents, with a column that tells every row from the others, and its name.

    It is the id where that is never null nor repeated, else a number in the order of ids, null ids last."""
    rows = docs.select(*COLUMNS)
    repeated = rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if repeated.isEmpty():
        return rows, "doc_id"
    order = (F.col("doc_id").asc_nulls_last(), F.sha2("text", 256), F.col("source").asc_nulls_last())
    return materialise(rows.orderBy(*order).withColumn("row", F.monotonically_increasing_id()), "rows"), "row"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; fitted on the labels outside its held-out fold.

    Null and empty texts have the score of the bias alone, and stay or go by it. Repeated rows and null ids are rows
    like any other. Without labelled documents all scores are 0.5, and all rows stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_rows(docs, model, LEAST_QUALITY, COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network finds; null, empty and letterless texts go.

    The network always names one of the languages it learned. With four of them it is below ``LEAST_LANGUAGE`` only if
    it cannot tell them apart at all, so text in a fifth language mostly stays. Without a document that has a language
    nothing is learned, and all rows go. Repeated rows and null ids are rows like any other."""
    return langid.filter_rows(docs, langid.fit(docs), LEAST_LANGUAGE, COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, null ids last. Equal rows of one id count once.

    With repeated or null ids every different row takes part for itself. Null and empty texts have no group and stay."""
    rows, key = with_key(docs)
    if key != "doc_id":
        rows = rows.join(rows.groupBy("doc_id", "text").agg(F.min(key).alias("first")).select("first"), F.col(key) == F.col("first")).drop("first")
        rows = materialise(rows, "rows")
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")), "gone")
    return rows.join(broadcast_if_small(gone), F.col(key) == F.col("gone"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: its words taken over its size, rounded half up.

    Texts without words are taken no times. Every row takes part for itself, with repeated or null ids too."""
    rows, key = with_key(docs)
    taken = mixing.mix(rows.select(F.col(key).alias("doc_id"), "source", "text")).where("size > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = materialise(taken.select(F.col("doc_id").alias("mixed"), copies.alias("copies")).where("copies > 0"), "copies")
    rows = rows.join(broadcast_if_small(taken), F.col(key) == F.col("mixed"))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_language),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
