"""Incremental ingest of generator replies with Structured Streaming.

Generation workers (or ``operators.generate.run_requests``) drop JSON-line
files of replies into a folder.  ``ingest_replies`` turns that folder into the
``replies`` table:

* file source with a fixed schema: only files not seen before are read; the
  stream checkpoint records which files were processed, so a restarted job
  neither loses nor re-reads a file (exactly-once with the file sink);
* every reply is kept, however late; ``best_replies`` chooses one per
  ``request_id`` on reading: a success over a failure, then the latest;
* ``trigger(availableNow=True)``: each run processes what is there and stops,
  which is how a batch job "resumes" (the reference re-read its whole
  progress file instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

REPLY_FILE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("reply", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

def write_reply_files(replies: DataFrame, folder: str) -> None:
    """Append a batch of replies as JSON-line files (what a worker would drop)."""
    (replies.withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp())) if "ts" in replies.columns
     else replies.withColumn("ts", F.current_timestamp())) \
        .select(*[f.name for f in REPLY_FILE_SCHEMA.fields]) \
        .write.mode("append").json(folder)


def reply_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return (spark.readStream.schema(REPLY_FILE_SCHEMA).option("maxFilesPerTrigger", max_files)
            .json(folder))


def best_replies(table: DataFrame) -> DataFrame:
    """One reply per request: ``ok`` before any other status, then the latest."""
    best = F.max_by(F.struct(*table.columns), F.struct((F.col("status") == "ok").alias("ok"), "ts", "attempts", "reply"))
    return table.groupBy("request_id").agg(best.alias("b")).select("b.*")


def ingest_replies(spark: SparkSession, folder: str, table: str, checkpoint: str,
                   max_files: int = 1000) -> StreamingQuery:
    """Start the ingest; with ``availableNow`` it stops once the folder is drained."""
    return (reply_stream(spark, folder, max_files)
            .writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def run_ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> DataFrame:
    """Drain the folder into the table and return the best reply of each request."""
    q = ingest_replies(spark, folder, table, checkpoint)
    q.awaitTermination()
    return best_replies(spark.read.schema(REPLY_FILE_SCHEMA).parquet(table))
