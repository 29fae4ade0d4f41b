"""Predictions for aggregated-hit files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow import schemas
from cladeflow.plans.scoring import predict_membership

PART_BYTES = 32 << 20  # of an arriving file, for each part that its predictions are written in


def stream_predictions(spark: SparkSession, arriving: str, out: str, checkpoint: str, classes: DataFrame, samples: DataFrame, sep: str = "\t", files_at_once: int | None = None) -> StreamingQuery:
    """Predict each arriving file by itself: (file and the columns of predictions), in a folder of `out` for each file.

    A file is a unit: scores, totals and ranks are its own, whatever files come in one batch with it. Its folder is named by a digest of
    its path and is replaced whole, so that a batch that is run again leaves each file's rows once. Read the folder `out` for all predictions.
    Rows are dealt by file before they are written, in more parts the larger the file that came, so a folder has as many files as its size asks for, however many
    tasks and arriving files there are.
    """
    stream = spark.readStream.schema(schemas.AGGREGATED_HITS).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    rows = stream.csv(arriving).select("*", F.col("_metadata.file_path").alias("file"), F.ceil(F.col("_metadata.file_size") / PART_BYTES).alias("file_parts"))

    def write(batch: DataFrame, number: int) -> None:
        found = predict_membership(batch, classes, samples, ("file", "file_parts")).withColumn("file_key", F.sha2("file", 256))
        parts = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = found.repartition(parts, "file_key", F.pmod(F.hash("virus_name"), F.col("file_parts"))).drop("file_parts")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_key").parquet(out)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
