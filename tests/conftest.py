import json
import sys
from pathlib import Path
from typing import NamedTuple

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


BEGIN = 1_612_137_600_000


class Task(NamedTuple):
    """A task of the log below: times in ms, sizes in bytes."""

    stage: int
    number: int
    worker: str
    start: int
    length: int
    cpu: float = 0.8  # share of the run time
    gc: int = 0
    heap: int = 64_000_000
    read: int = 0
    written: int = 0
    spilled: int = 0
    attempt: int = 0
    outcome: str = "Success"


TASKS = [
    Task(7, 100, "w-a", 2_000, 900, written=70_000), Task(7, 101, "w-b", 2_000, 1_200, written=90_000, gc=60), Task(7, 102, "w-a", 3_000, 800, cpu=0.55, written=40_000),
    Task(7, 103, "w-c", 3_100, 7_000, cpu=0.9, gc=900, heap=220_000_000, written=2_600_000), Task(7, 104, "w-b", 3_300, 1_100, outcome="FetchFailed"),
    Task(7, 104, "w-b", 4_600, 700, written=30_000, attempt=1),
    Task(8, 200, "w-a", 11_000, 650, read=800_000), Task(8, 201, "w-b", 11_000, 400, cpu=0.7, read=300_000), Task(8, 202, "w-b", 11_500, 2_500, gc=150, read=1_700_000, spilled=5_300_000),
    Task(9, 300, "w-a", 15_000, 300), Task(9, 301, "w-a", 15_400, 1_000, cpu=1.0), Task(9, 302, "w-b", 15_100, 600),
]
#: stage -> (name, parents, submitted, completed, attempt that completed)
STAGES = {7: ("map at Daily.scala:12", [], 1_900, 10_200, 1), 8: ("reduceByKey at Daily.scala:31", [7], 10_900, 14_200, 0), 9: ("saveAsTable at Daily.scala:40", [8], 14_900, 16_500, 0)}
WORKERS = {"w-a": (500, 8), "w-b": (700, 8), "w-c": (900, 2)}
LOST_AT = 17_000


def _event(kind, **fields):
    return {"Event": f"SparkListener{kind}", **{k.replace("_", " "): v for k, v in fields.items()}}


def _task_event(t):
    run = t.length - 20
    figures = {"Executor Run Time": run, "Executor CPU Time": int(run * t.cpu) * 1_000_000, "JVM GC Time": t.gc, "JVMHeapMemory": t.heap}
    if t.read:  # either of two forms
        figures["Shuffle Read Metrics"] = {"Total Bytes Read": t.read} if t.number % 2 else {"Remote Bytes Read": t.read // 4, "Local Bytes Read": t.read - t.read // 4}
    if t.written:
        figures["Shuffle Write Metrics"] = {"Shuffle Bytes Written": t.written, "Shuffle Write Time": t.written // 10_000, "Shuffle Records Written": t.written // 50}
    if t.spilled:
        figures["Memory Spill Metrics"] = {"Spilled Bytes": t.spilled}
    reason = {"Reason": t.outcome} if t.outcome == "Success" else {"Reason": t.outcome, "Message": "no map output"}
    info = {"Task ID": t.number, "Attempt": t.attempt, "Launch Time": BEGIN + t.start, "Finish Time": BEGIN + t.start + t.length, "Executor ID": t.worker, "Host": f"node-{t.worker}",
            "Locality": "ANY", "Speculative": False}
    return _event("TaskEnd", Stage_ID=t.stage, Stage_Attempt_ID=t.attempt, Task_Type="ShuffleMapTask", Task_End_Reason=reason, Task_Info=info, Task_Executor_Metrics=figures)


def small_log(app_id="app-small"):
    """A log of three stages, twelve tasks and three executors, one of them lost."""
    out = [_event("ApplicationStart", App_Name="nightly", App_ID=app_id, Timestamp=BEGIN, User="batch", Spark_Version="4.0.0")]
    out += [_event("ExecutorAdded", Timestamp=BEGIN + at, Executor_ID=w, Executor_Info={"Host": f"node-{w}", "Total Cores": cores}) for w, (at, cores) in WORKERS.items()]
    out.append(_event("BlockManagerAdded", Timestamp=BEGIN + 950, Block_Manager_ID={"Executor ID": "w-b", "Host": "node-w-b", "Port": 4040}, Maximum_OnHeap_Memory=300_000_000))
    for stage, (name, parents, submitted, completed, last) in STAGES.items():
        n = len({t.number for t in TASKS if t.stage == stage})
        out.append(_event("StageSubmitted", Timestamp=BEGIN + submitted, Stage_Info={"Stage ID": stage, "Stage Attempt ID": last, "Name": name, "Number of Tasks": n, "Parent IDs": parents, "RDD Info": []}))
        out += [_task_event(t) for t in TASKS if t.stage == stage]
        out.append(_event("StageCompleted", Stage_Info={"Stage ID": stage, "Stage Attempt ID": last, "Name": name, "Number of Tasks": n, "Completion Time": BEGIN + completed}))
    out.append(_event("ExecutorRemoved", Timestamp=BEGIN + LOST_AT, Executor_ID="w-c", Removed_Reason="worker lost: no heartbeat for 8 s"))
    return out


def write_lines(path, events):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(e) if isinstance(e, dict) else e for e in events) + "\n")


def write_array(path, events, lead=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(lead + json.dumps(events, indent=1))
