"""Incremental ingestion: new document files are cleaned, chunked and appended.

The checkpoint of the stream records which files are done, so a stopped run
resumes where it was.  Files are handled in bounded micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexatlas.operators.chunking import chunk_records
from lexatlas.operators.cleaning import clean_documents

SCHEMA = "doc_id string, title string, text string, source string"


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: str = SCHEMA,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Ingest all files that are new since the last run, then stop.

    A batch is written under its own number, so a batch that is repeated after
    a failure replaces its earlier, partial output.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        cleaned = clean_documents(batch, carry=("title", "source"))
        records = chunk_records(cleaned, placed=True)
        records.write.mode("overwrite").partitionBy("record").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """Latest records of every document; a re-sent document replaces its old ones."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")
