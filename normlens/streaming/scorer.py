"""Answering requests: uploads of images and patch vectors, in batches and as streams, against a bank of normal vectors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.functions.vectors import distance, l2_normalize
from normlens.operators.nearest import nearest
from normlens.operators.scoring import image_scores, label_from_score, patch_scores
from normlens.scratch import Scratch, process_scratch
from normlens.session import remove_folder, shared_dir
from normlens.sources import pixels

#: The two predictions.
PREDICTIONS = ("good", "defect")


@dataclass
class Model:
    """What answers a micro-batch: ``bank`` has id and unit vectors v."""

    version: str
    bank: DataFrame
    threshold: float
    ready: bool = True


RESPONSE = "request_id long, status int, prediction string, anomaly_score double, threshold double"


def responses(requests: DataFrame, bank: DataFrame, threshold: float, ready: bool = True) -> DataFrame:
    """One response for each request (request_id, v): status 200 with a prediction, 400 for a request without a
    usable vector, 503 for all if the bank is not ready."""
    # One request is one vector here; images of many patches reduce by max before they are labelled.
    good = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    usable, refused = requests.where(good), requests.where(~good)
    nothing = [F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("double").alias("anomaly_score"), F.lit(threshold).alias("threshold")]
    if not ready:
        return requests.select("request_id", F.lit(503).alias("status"), *nothing)
    found = nearest(usable.select(F.col("request_id").alias("id"), l2_normalize(F.col("v")).alias("v")), bank)
    score = distance(F.col("similarity"))
    answered = found.select(F.col("query_id").alias("request_id"), F.lit(200).alias("status"), label_from_score(score, F.lit(threshold)).alias("prediction"), score.alias("anomaly_score"), F.lit(threshold).alias("threshold"))
    return checked(answered.unionByName(refused.select("request_id", F.lit(400).alias("status"), *nothing)))


def checked(answers: DataFrame) -> DataFrame:
    """``answers``, of which one whose prediction is neither of ``PREDICTIONS`` (or null), or that has one without status 200, ends the job."""
    wrong = F.col("prediction").isNotNull() & (~F.col("prediction").isin(*PREDICTIONS) | (F.col("status") != 200)) | ((F.col("status") == 200) & F.col("prediction").isNull())
    told = F.raise_error(F.concat(F.lit("no such prediction: "), F.coalesce("prediction", F.lit("null")), F.lit(" with status "), F.col("status").cast("string")))
    return answers.withColumn("prediction", F.when(wrong, told.cast("string")).otherwise(F.col("prediction")))


def predict(requests: DataFrame, bank: DataFrame, threshold: float, features: Callable, grid: int = 32, ready: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """One answer for each upload (request_id, content_type, content): status, detail, prediction, anomaly_score, threshold.

    The patches are a table of ``scratch`` (that of the process without one), which has to live as long as the answers are read.

    503 if the bank is not ready; 400 for what is not declared an image, is empty or cannot be decoded; 500 if the
    features fail or no patch is valid; else 200, with the greatest distance of a patch to its nearest bank vector."""
    threshold_of = F.lit(float(threshold)).alias("threshold")
    nothing = [F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("double").alias("anomaly_score"), threshold_of]
    if not ready:
        return requests.select("request_id", F.lit(503).alias("status"), F.lit("not ready").alias("detail"), *nothing)
    declared = F.coalesce(F.startswith("content_type", F.lit("image/")), F.lit(False))
    empty = F.coalesce(F.octet_length("content") == 0, F.lit(True))
    refused = requests.where(~declared | empty).select("request_id", F.lit(400).alias("status"), F.when(~declared, "not an image").otherwise("empty").alias("detail"), *nothing)
    patches = pixels.extract_patches(requests.where(declared & ~empty), features, grid, key="request_id")
    patches = (scratch or process_scratch(requests.sparkSession)).table(patches, "patches")  # read twice: the good ones and the bad ones
    bad = patches.where("error IS NOT NULL").select("request_id", F.when(F.col("error") == "undecodable", 400).otherwise(500).alias("status"), F.col("error").alias("detail"), *nothing)
    queries = patches.where("error IS NULL").select(F.col("patch").cast("long").alias("id"), F.col("request_id").alias("image_id"), l2_normalize(F.col("v")).alias("v"))
    scored = image_scores(patch_scores(queries, bank))
    label = label_from_score(F.col("score"), F.lit(threshold)).alias("prediction")
    good = scored.select(F.col("image_id").alias("request_id"), F.lit(200).alias("status"), F.lit("").alias("detail"), label, F.col("score").alias("anomaly_score"), threshold_of)
    return checked(good.unionByName(bad).unionByName(refused))


def health(bank: DataFrame, threshold: float | None) -> DataFrame:
    """One row: status ('ok' or 'not ready'), code, device, model_loaded, coreset_size, dims, threshold."""
    sums = bank.agg(F.count("v").alias("coreset_size"), F.max(F.size("v")).alias("dims"))
    ready = (F.col("coreset_size") > 0) & F.lit(threshold is not None)
    value = F.lit(threshold).cast("double").alias("threshold")
    return sums.select(F.when(ready, "ok").otherwise("not ready").alias("status"), F.when(ready, 200).otherwise(503).alias("code"), F.lit("cpu").alias("device"), ready.alias("model_loaded"), "coreset_size", "dims", value)


def score_stream(stream: DataFrame, bank: DataFrame, threshold: float, out: str, checkpoint: str):
    """Starts a query that answers a stream of requests in micro-batches and appends Parquet files to ``out``.

    A batch that is run again writes the folder of its own number again, so no answer is kept twice."""

    def answer(batch: DataFrame, number: int) -> None:
        responses(batch, bank, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predict_stream(uploads: DataFrame, model: Callable[[], Model], features: Callable, out: str, checkpoint: str, delay: str = "10 minutes", grid: int = 32, once: bool = True):
    """Starts a query that answers a stream of uploads (request_id, sent, content_type, content) and appends Parquet files to ``out``.

    A request id that comes again within ``delay`` of event time is answered once; what is later than that is dropped. ``model``
    is asked once for each micro-batch, so a new bank or threshold holds from the next batch on; answers carry its version.
    A batch that is run again writes the folder of its own number again, so no answer is kept twice."""

    def answer(batch: DataFrame, number: int) -> None:
        now = model()
        with Scratch(batch.sparkSession) as scratch:
            requests = scratch.table(batch, "uploads")  # else each of the answers' branches would read the source again
            answers = predict(requests, now.bank, now.threshold, features, grid, now.ready, scratch)
            answers.withColumn("version", F.lit(now.version)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    fresh = uploads.withWatermark("sent", delay).dropDuplicatesWithinWatermark(["request_id"])
    writer = fresh.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_table_as_stream(spark: SparkSession, sf_dir: str, threshold: float = 1.1) -> DataFrame:
    """The embeddings table replayed as a stream of requests against the bank of normal vectors; all answers."""
    from normlens.plans.bindings import units

    where = f"{shared_dir(spark)}/normlens-stream-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, where)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    # A pattern, since a plain path must be a folder here and the table may be one file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    requests = stream.select(F.col("vec_id").alias("request_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    bank = units(spark, sf_dir).where("part = 'bank'").select("id", "v")
    score_stream(requests, bank, threshold, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema(RESPONSE).option("basePath", f"{where}/out").parquet(f"{where}/out").select("request_id", "status", "prediction", F.round("anomaly_score", 6).alias("anomaly_score"), "threshold")
