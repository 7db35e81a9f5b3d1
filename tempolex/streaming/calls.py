"""Recorded calls as a stream: tolerant JSON source, watermark, tumbling, sliding and session windows, stream-static audit.

The batch figures of operators.telemetry are the reference: a stream over the same files ends with equal windows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolex.functions.citations import citations
from tempolex.operators.audit import checked

CALL = "event_id bigint, at_s double, tool string, outcome string, ms double, refused boolean, refusal_status string, error string, is_sample boolean, statuses map<string,bigint>"


def read_calls(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 16) -> DataFrame:
    """Calls appended to a folder; lines that are no calls are dropped."""
    reader = spark.readStream.schema(CALL).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("mode", "DROPMALFORMED").json(path) if fmt == "json" else reader.parquet(path)).where("event_id is not null")


#: A file of calls is closed at this size and the next begins; one closed file is kept beside it.
MOST_BYTES = 8 << 20


def record(call: dict, path: str | None) -> bool:
    """Appends one call as a JSON line to a local file, if a path is given. It never fails: a call that cannot be written is not.

    A file that has reached MOST_BYTES becomes path.1, in the place of the one before.
    """
    if not path:
        return False
    try:
        line = json.dumps({"at_s": time.time()} | call, ensure_ascii=False, default=str)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if os.path.exists(path) and os.path.getsize(path) >= MOST_BYTES:
            os.replace(path, f"{path}.1")
        with open(path, "a", encoding="utf-8", newline="") as f:
            f.write(line + "\n")
        return True
    except (OSError, TypeError, ValueError):
        return False


def recorded(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The calls of a file and of the closed one beside it, damaged lines left out; with a limit the latest ones."""
    there = [p for p in (f"{path}.1", path) if os.path.exists(p)]
    calls = spark.read.schema(CALL).option("mode", "DROPMALFORMED").json(there) if there else spark.createDataFrame([], CALL)
    calls = calls.where("at_s is not null or event_id is not null or tool is not null")
    return calls.orderBy(F.desc("at_s")).limit(limit) if limit else calls


def timed(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Adds ts and drops repeated deliveries of an event within the watermark."""
    return calls.withColumn("ts", F.timestamp_seconds("at_s")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windows(calls: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, tool, calls, refused, ms): tumbling windows, or sliding ones with a slide."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    tally = calls.groupBy(w.alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"), F.sum(F.coalesce("ms", F.lit(0.0))).alias("ms"))
    return tally.select(F.col("w.start").alias("start"), "tool", "calls", "refused", "ms")


def sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(start, end, tool, calls): runs of calls of a tool without a pause of `gap`."""
    tally = calls.groupBy(F.session_window("ts", gap).alias("w"), "tool").agg(F.count("*").alias("calls"))
    return tally.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "calls")


def audited(documents: DataFrame, versions: DataFrame, doc_id: str, text: str, day: str, keys: list[str]) -> DataFrame:
    """Citations of a stream of documents checked against a static table of versions as of each document's day."""
    cited = citations(documents, doc_id, text, keys)
    dated = cited.withColumn("as_of", F.lit(day).cast("date"))
    return checked(dated, versions)
