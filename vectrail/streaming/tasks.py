"""Background tasks: submitted as rows, run oldest first by one streaming query, with their state in a table."""

from __future__ import annotations

import json
import time
import traceback
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
INGEST, COMPACT, BUILD = "BATCH_INGEST", "COMPACT_SEGMENTS", "BUILD_HNSW"
TASK = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("task_type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("created", T.DoubleType())])
STATE = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("at", T.DoubleType())])
Handler = Callable[[dict[str, Any]], None]


class TaskQueue:
    """Tasks and their states are append-only folders; a task's state is its last row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.handlers: dict[str, Handler] = {}
        for part, schema in (("tasks", TASK), ("states", STATE)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{part}")

    def handle(self, task_type: str, handler: Handler) -> None:
        self.handlers[task_type] = handler

    def submit(self, task_type: str, payload: dict[str, Any]) -> str:
        task_id = uuid.uuid4().hex
        row = [(task_id, task_type, json.dumps(payload), time.time())]
        self.spark.createDataFrame(row, TASK).coalesce(1).write.mode("append").parquet(f"{self.root}/tasks")
        self._note(task_id, PENDING, None)
        return task_id

    def _note(self, task_id: str, status: str, message: str | None) -> None:
        self.spark.createDataFrame([(task_id, status, message, time.time())], STATE).coalesce(1).write.mode("append").parquet(f"{self.root}/states")

    def states(self) -> DataFrame:
        """(task_id, task_type, payload, created, status, message): the last state of each task."""
        last = self.spark.read.schema(STATE).parquet(f"{self.root}/states").groupBy("task_id").agg(F.max_by(F.struct("status", "message"), "at").alias("s"))
        tasks = self.spark.read.schema(TASK).parquet(f"{self.root}/tasks")
        return tasks.join(last, "task_id", "left").select(*tasks.columns, F.coalesce("s.status", F.lit(PENDING)).alias("status"), F.col("s.message").alias("message"))

    def next(self) -> DataFrame:
        """The oldest pending task."""
        return self.states().where(F.col("status") == PENDING).orderBy("created", "task_id").limit(1)

    def recover(self) -> int:
        """Tasks that were running when their process ended wait again."""
        stuck = [r["task_id"] for r in self.states().where(F.col("status") == PROCESSING).collect()]
        for t in stuck:
            self._note(t, PENDING, "Recovered after an interruption")
        return len(stuck)

    def run(self, task_id: str, task_type: str, payload: str) -> None:
        self._note(task_id, PROCESSING, None)
        try:
            if task_type not in self.handlers:
                raise ValueError(f"no handler for task type {task_type!r}")
            self.handlers[task_type](json.loads(payload))
        except Exception:
            self._note(task_id, FAILED, traceback.format_exc())
        else:
            self._note(task_id, COMPLETED, None)

    def run_pending(self) -> int:
        """Run what is pending, oldest first."""
        n = 0
        while rows := self.next().collect():
            self.run(rows[0]["task_id"], rows[0]["task_type"], rows[0]["payload"])
            n += 1
        return n

    def start(self, available_now: bool = False, interval: str = "500 milliseconds") -> StreamingQuery:
        """Poll by a streaming query over the tasks folder: one dispatcher owns the queue."""
        self.recover()
        stream = self.spark.readStream.schema(TASK).parquet(f"{self.root}/tasks")
        writer = stream.writeStream.foreachBatch(lambda batch, _: self.run_pending()).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def ordered(tasks: DataFrame) -> DataFrame:
    """Pending tasks with their place in the queue, by type."""
    return tasks.where(F.col("status") == PENDING).withColumn("place", F.row_number().over(Window.partitionBy("task_type").orderBy("created", "task_id")))
