"""The scan as a stream: texts come in, findings go out once.

Every step is the batch scan's own; a stream only needs a time column to forget
old state by.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.language import file_name, is_skipped, language_of
from ..functions.text import decode_bytes, is_binary
from ..operators.scan import active_rules, hide_secrets, hits_of, keyed_hits, with_rules

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files arriving under ``path`` as texts, with their time as ``ts``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", files_per_batch).load(path))
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    full = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "")
    relative = F.when(full.startswith(root + "/"), full.substr(F.lit(len(root) + 2), F.length(full))
                      ).otherwise(file_name(full))
    files = files.where(~is_skipped(relative)).where(~is_binary(F.col("content")))
    text, _ = decode_bytes(F.col("content"))
    return files.select("path", language_of(F.col("path")).alias("language"), text.alias("text"),
                        F.col("modificationTime").alias("ts"))


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def scan_stream(texts: DataFrame, rules=None, packs=None, threshold: str = "medium", facts: bool = True,
                delay: str = "1 hour", width: int | None = None) -> DataFrame:
    """Findings of a stream of texts with a ``ts`` column, each once within ``delay``."""
    chosen = active_rules(rules, threshold, packs)
    found = keyed_hits(hits_of(texts, chosen, facts, keep=("ts",), width=width), keep=("ts",))
    # A session without time zones gives plain timestamps, which watermarks refuse.
    found = found.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    found = found.dropDuplicatesWithinWatermark(["finding_id"])
    return hide_secrets(with_rules(found, chosen, keep=("ts",)))


def window_counts(findings: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Findings per window and severity."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (findings.groupBy(window.alias("w"), "severity").agg(F.count("*").alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "total"))


def session_counts(findings: DataFrame, gap: str = "30 minutes", by: str = "path",
                   slice_seconds: int = 86_400) -> DataFrame:
    """Findings per key and session: a run of findings with no longer pause than ``gap``.

    A table is first counted in time slices, so that a key with much of the data is
    spread over tasks; what is left, at most a few rows per slice, is joined up.  A
    stream keeps one state per key instead.
    """
    session = F.session_window("ts", gap).alias("w")
    if findings.isStreaming:
        whole = findings.groupBy(session, by).agg(F.count("*").alias("total"))
        return whole.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "total")
    part = (findings.groupBy(session, by, F.floor(F.unix_seconds(F.col("ts")) / slice_seconds).alias("slice")).agg(F.count("*").alias("total"))
            .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total"))
    order = W.partitionBy(by).orderBy("start")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    part = part.withColumn("begins", F.when(F.col("start") < reached, 0).otherwise(1))
    part = part.withColumn("number", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (part.groupBy(by, "number").agg(F.min("start").alias("session_start"), F.max("end").alias("session_end"),
                                           F.sum("total").alias("total"))
            .select("session_start", "session_end", by, "total"))


def write_new(findings: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append findings not stored before, one folder per micro-batch.

    A batch that is run again writes its own folder again, so nothing is stored twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["finding_id"])
        if batch_id > 0:
            before = (spark.read.schema("finding_id string, batch long").option("basePath", path).parquet(path)
                      .where(F.col("batch") < batch_id).select("finding_id"))
            new = new.join(before, "finding_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = findings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
