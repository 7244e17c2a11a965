"""Late rows and restarts of streams."""

from pyspark.sql import functions as F

from eventlens.bench.views import tasks
from eventlens.streaming import live

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def test_late_rows_are_counted_and_nothing_vanishes(spark, tmp_path):
    source, store, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    base = tasks(spark, SF).where("app_id < 'app-4'").withColumn("finish_ms", F.expr("pmod(xxhash64(task_id), 48) * 1800000L + task_id % 1000"))
    for part, order in enumerate((2, 0, 1)):  # the middle third of the day comes last
        base.where(f"finish_ms div {16 * HOUR // 2} = {order}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(base.schema).parquet(source)
        live.run_counted(stream, store, mark, HOUR, HOUR)
        assert live.counted_progress(spark, store).count() == part + 1
    total = live.counted_progress(spark, store).agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late")).first()
    timely, whole = (live.counted_windows(spark, store, HOUR, late) for late in (False, True))
    assert total.rows == base.count() == whole.agg(F.sum("tasks")).first()[0]
    assert 0 < total.late == total.rows - timely.agg(F.sum("tasks")).first()[0]
    want = base.groupBy("app_id", F.expr(f"finish_ms div {HOUR} * {HOUR} AS w")).agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("most"))
    got = {(r.app_id, r.window_start_ms): (r.tasks, r.mean_duration_ms, r.max_duration_ms) for r in whole.collect()}
    assert got == {(r.app_id, r.w): (r.n, r.mean, r.most) for r in want.collect()}
