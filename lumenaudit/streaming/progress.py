"""Progress and logs as streams: latest state, counters and bounded logs per task, and the incremental audit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.stored import shared_folder

#: The message type of each event type.
TYPES = {"view": "page_discovered", "click": "agent_reasoning", "purchase": "issue_found", "error": "event_detected", "signup": "task_progress"}


def messages(events: DataFrame) -> DataFrame:
    """messages(type, task_id, data, timestamp, event_id) of an event table or stream."""
    kind = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return events.select(F.coalesce(F.try_element_at(kind, F.col("event_type")), F.col("event_type")).alias("type"), F.col("user_id").alias("task_id"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("timestamp"), "event_id", "value")


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}*.parquet")


def latest(messages_: DataFrame) -> DataFrame:
    return messages_.groupBy("task_id").agg(F.max_by(F.struct("type", "value", "event_id"), F.struct("timestamp", "event_id")).alias("m")).select("task_id", "m.*")


def counters(messages_: DataFrame) -> DataFrame:
    return messages_.groupBy("task_id", "type").agg(F.count(F.lit(1)).alias("n"))


LOG = 100
_LINE = "timestamp string, event_id long, type string"


def bounded_log(messages_: DataFrame, most: int = LOG) -> DataFrame:
    """(task_id, nth, event_id, type, seen) as a stream: after each batch the last `most` messages of the tasks that had new ones, oldest first, kept as state per task.

    Within a batch messages are taken in the order of time and id. `seen` counts a task's messages so far, so its rows with the highest `seen` are its log.
    """

    def run(key, batches, state):
        seen, kept = state.get if state.exists else (0, [])
        kept = [tuple(x) for x in kept]
        new = sorted((str(r.timestamp), int(r.event_id), r.type) for b in batches for r in b.itertuples())
        kept, seen = (kept + new)[-most:], seen + len(new)
        state.update((seen, kept))
        yield pd.DataFrame({"task_id": [key[0]] * len(kept), "nth": range(1, len(kept) + 1), "event_id": [x[1] for x in kept], "type": [x[2] for x in kept], "seen": seen})

    return messages_.select("task_id", "timestamp", "event_id", "type").groupBy("task_id").applyInPandasWithState(run, "task_id long, nth int, event_id long, type string, seen long", f"seen long, kept array<struct<{_LINE.replace(' ', ':').replace(',:', ',')}>>", "update", GroupStateTimeout.NoTimeout)


#: The status that a lifecycle message gives a task. Starting a running task is refused.
STATUS = {"start": "running", "complete": "completed", "fail": "failed", "cancel": "cancelled"}


def lifecycle(steps: DataFrame) -> DataFrame:
    """(task_id, status, refused, seen) as a stream, after each batch, of steps(task_id, step, timestamp, event_id); tasks begin as pending, other steps change nothing."""

    def run(key, batches, state):
        status, refused, seen = state.get if state.exists else ("pending", 0, 0)
        for _, _, step in sorted((str(r.timestamp), int(r.event_id), r.step) for b in batches for r in b.itertuples()):
            seen += 1
            if step == "start" and status == "running":
                refused += 1
            else:
                status = STATUS.get(step, status)
        state.update((status, refused, seen))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "refused": [refused], "seen": [seen]})

    return steps.select("task_id", "timestamp", "event_id", "step").groupBy("task_id").applyInPandasWithState(run, "task_id long, status string, refused long, seen long", "status string, refused long, seen long", "update", GroupStateTimeout.NoTimeout)


def newest(updates: DataFrame) -> DataFrame:
    """Of updates(task_id, seen, …), each task's last."""
    return updates.join(updates.groupBy("task_id").agg(F.max("seen").alias("seen")), ["task_id", "seen"], "left_semi").drop("seen", "batch")


def drain(out: DataFrame, mode: str, keep: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its last complete state as a table."""
    spark = out.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{at}/out" if mode == "complete" else f"{at}/out/batch={batch_id}"  # rewriting a batch is idempotent
        batch.write.mode("overwrite").parquet(target)

    q = out.writeStream.outputMode(mode).foreachBatch(keep or write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def incremental_audit(spark: SparkSession, pages: DataFrame, rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pages as they arrive, audited batch by batch: a page's issues depend on that page alone."""
    at = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        rules(batch).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    q = pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def distinct(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows of a stream without later ones of the same keys that arrive within `delay` of event time: a key is held no longer, so the state
    follows the traffic of a delay, not the whole history; a copy that comes later counts as new."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
