"""Predict newly arriving FASTA files with the batch predictor, file by file batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from spanforge.functions.text import strip
from spanforge.plans.predict import Predictor
from spanforge.session import cut_lineage


def predict_new_files(
    spark: SparkSession, predictor: Predictor, source: str, results: str, checkpoint: str
) -> StreamingQuery:
    """Run until all files now in ``source`` are predicted into ``results`` (Parquet).

    Prediction is keyed by record, so micro-batches need no state; each batch
    overwrites its own ``batch`` folder, so a replayed batch does not repeat rows.
    Files must start with a header line.
    """
    records = spark.readStream.option("lineSep", "\n>").text(source)

    def run(batch: DataFrame, number: int) -> None:
        text = F.regexp_replace("value", r"^\s*>", "")
        body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n"), F.length(text))).otherwise("")
        rows = batch.filter(strip(F.col("value")) != "").select(
            F.monotonically_increasing_id().alias("id"),
            strip(F.substring_index(text, "\n", 1)).alias("header"),
            F.regexp_replace(body, r"\s", "").alias("sequence"),
        )
        # ids are used in several joins, so they are fixed in a written table
        done, _ = predictor.predict(cut_lineage(rows))
        done.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
