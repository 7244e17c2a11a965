"""Schema of event-log records and of the canonical tables.

One open record type covers all events: absent fields are NULL, and the text of the record stays
available for fields that are not listed.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_METRICS = """STRUCT<
  `Executor Run Time`: BIGINT, `ExecutorRunTime`: BIGINT, `Executor CPU Time`: BIGINT, `Executor Deserialize Time`: BIGINT,
  `JVM GC Time`: BIGINT, `JVMGCTime`: BIGINT, `TotalGCTime`: BIGINT, `MinorGCTime`: BIGINT, `MajorGCTime`: BIGINT,
  `JVMHeapMemory`: BIGINT, `JVMOffHeapMemory`: BIGINT, `Result Size`: BIGINT, `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
  `Memory Spill Metrics`: STRUCT<`Spilled Bytes`: BIGINT, `Spilled Records`: BIGINT>,
  `Shuffle Read Metrics`: STRUCT<`Total Bytes Read`: BIGINT, `Shuffle Bytes Read`: BIGINT, `Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT,
                                 `Records Read`: BIGINT, `Fetch Wait Time`: BIGINT>,
  `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT, `Shuffle Write Time`: BIGINT, `Shuffle Records Written`: BIGINT>,
  `Input Metrics`: STRUCT<`Bytes Read`: BIGINT, `Records Read`: BIGINT>, `Output Metrics`: STRUCT<`Bytes Written`: BIGINT, `Records Written`: BIGINT>>"""

_STAGE = """STRUCT<
  `Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Stage Name`: STRING, `Name`: STRING, `Number of Tasks`: BIGINT, `Num Tasks`: BIGINT,
  `Parent IDs`: ARRAY<BIGINT>, `RDD Info`: ARRAY<STRUCT<`Name`: STRING>>, `Submission Time`: BIGINT, `Completion Time`: BIGINT, `Failure Reason`: STRING>"""

_TASK = """STRUCT<
  `Task ID`: BIGINT, `Index`: BIGINT, `Attempt`: BIGINT, `Partition ID`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT, `Executor ID`: STRING,
  `Host`: STRING, `Locality`: STRING, `Speculative`: BOOLEAN, `Failed`: BOOLEAN, `Killed`: BOOLEAN>"""

EVENT_DDL = f"""
  `Event` STRING, `Timestamp` BIGINT, `Time` BIGINT, `Submission Time` BIGINT, `Completion Time` BIGINT,
  `App Name` STRING, `App ID` STRING, `User` STRING, `App Attempt ID` STRING, `Spark Version` STRING,
  `Job ID` BIGINT, `Stage IDs` ARRAY<BIGINT>, `Stage Infos` ARRAY<STRUCT<`Stage ID`: BIGINT, `Stage Name`: STRING, `Num Tasks`: BIGINT>>,
  `Job Result` STRUCT<`Result`: STRING>, `Stage Info` {_STAGE},
  `Stage ID` BIGINT, `Stage Attempt ID` BIGINT, `Task Type` STRING, `Task End Reason` STRING, `Task Info` {_TASK},
  `Task Executor Metrics` {_METRICS}, `Task Metrics` {_METRICS},
  `Executor ID` STRING, `Executor Info` STRUCT<`Host`: STRING, `Total Cores`: BIGINT>, `Removed Reason` STRING,
  `Block Manager ID` STRUCT<`Executor ID`: STRING, `Host`: STRING, `Port`: BIGINT>, `Maximum OnHeap Memory` BIGINT, `Maximum OffHeap Memory` BIGINT,
  `Spark Properties` MAP<STRING, STRING>"""

CORRUPT = "_corrupt_record"


def event_schema() -> StructType:
    return StructType.fromDDL(EVENT_DDL + f", `{CORRUPT}` STRING")


# Fields that a typed event must carry
REQUIRED = {
    "SparkListenerApplicationStart": ("App Name", "Timestamp", "User"),
    "SparkListenerApplicationEnd": ("Timestamp",),
    "SparkListenerJobStart": ("Job ID",),
    "SparkListenerJobEnd": ("Job ID", "Completion Time"),
    "SparkListenerStageSubmitted": ("Stage Info",),
    "SparkListenerStageCompleted": ("Stage Info",),
    "SparkListenerTaskStart": ("Stage ID", "Stage Attempt ID", "Task Info"),
    "SparkListenerTaskEnd": ("Stage ID", "Stage Attempt ID", "Task Type", "Task End Reason", "Task Info", "Task Executor Metrics"),
    "SparkListenerExecutorAdded": ("Timestamp", "Executor ID", "Executor Info"),
    "SparkListenerExecutorRemoved": ("Timestamp", "Executor ID", "Removed Reason"),
    "SparkListenerBlockManagerAdded": ("Timestamp", "Block Manager ID"),
    "SparkListenerBlockManagerRemoved": ("Timestamp", "Block Manager ID"),
}

SUMMARY_DDL = """applicationId STRING, applicationName STRING, sparkVersion STRING, startTime STRING, endTime STRING,
  stages ARRAY<STRUCT<stageId: BIGINT, name: STRING, numTasks: BIGINT, executorRunTime: BIGINT, gcTime: BIGINT, memoryBytesSpilled: BIGINT, diskBytesSpilled: BIGINT,
    taskMetrics: STRUCT<avgCpuUtilization: DOUBLE, avgTaskDurationMs: BIGINT, maxTaskDurationMs: BIGINT, failedTasks: BIGINT, fetchFailed: BOOLEAN, failureReason: STRING>>>,
  executors ARRAY<STRUCT<id: STRING, totalDuration: BIGINT, gcTime: BIGINT, totalInputBytes: BIGINT, totalShuffleRead: BIGINT, totalShuffleWrite: BIGINT,
    maxMemoryUsage: DOUBLE, lost: BOOLEAN, lossReason: STRING>>,
  summary STRUCT<totalInputRecords: BIGINT, totalOutputRecords: BIGINT, numFailedStages: BIGINT, totalGCOverheadPercent: DOUBLE, totalCpuUtilization: DOUBLE,
    totalMemorySpillGB: DOUBLE, totalDiskSpillGB: DOUBLE>"""
