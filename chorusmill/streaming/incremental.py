"""Incremental ingest with Structured Streaming: new capture files are merged once, however often the run is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, resume
from ..schemas import CAPTURE


def capture_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Capture files as a stream, with fingerprint and path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select("path", F.sha2("content", 256).alias("fingerprint"), F.from_json(text, CAPTURE).alias("c")).select("path", "fingerprint", "c.*")


def run(spark: SparkSession, captures: str, state: str, asins: list[str] | None = None, query: str | None = None, files_per_batch: int = 100) -> None:
    """Process what is new into the ingest state under `state` (operators.resume) and stop.

    Each batch is one run of the state. A batch that is run again after a failure finds its number committed, or repeats it
    as a whole. A copy of a processed file under another name is skipped by its fingerprint. The first arrival of a row wins
    across batches, and no reader dedupes again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        resume.resume_ingest(ingest.checked(batch.withColumn("ord", F.col("path"))), state, asins, query, batch=number)

    stream = capture_stream(spark, captures, files_per_batch)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def processed(spark: SparkSession, state: str) -> DataFrame:
    """(ord, fingerprint) of the captures processed so far."""
    return resume.open_state(spark, state).processed()


def unique_rows(spark: SparkSession, state: str) -> DataFrame:
    """The unique rows of everything processed so far."""
    return resume.current_rows(resume.open_state(spark, state))
