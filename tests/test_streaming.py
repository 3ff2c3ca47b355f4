from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.plans.reporting import pressure_counter
from lattica.sources import sinks
from lattica.sources.sinks import current_table
from lattica.streaming.sessions import delta_stream, late_pressure_stream, pressure_stream, read_deltas, upsert_stream, windowed_counts

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path, parts=3):
    """The events table as a stream of files in time order."""
    table = spark.read.parquet(f"{SF}/events.parquet")
    ordered = table.withColumn("n", F.percent_rank().over(Window.orderBy("ts", "event_id")))
    for i in range(parts):
        ordered.where((F.col("n") >= i / parts) & ((F.col("n") < (i + 1) / parts) | F.lit(i == parts - 1))).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_pressure_equals_the_batch_form(spark, tmp_path):
    got = {r.event_id: (r.pressure, r.due) for r in run(pressure_stream(stream(spark, tmp_path)), "pressure").collect()}
    want = {r.event_id: (r.pressure, r.due) for r in pressure_counter(spark, SF).where("event_type = 'view'").collect()}
    assert got == want


def test_windowed_counts(spark, tmp_path):
    got = run(windowed_counts(stream(spark, tmp_path), "1 day", "30 days"), "windows", "complete")
    table = spark.read.parquet(f"{SF}/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == table.count()


def test_upserts_keep_the_last_row(spark, tmp_path):
    changes = stream(spark, tmp_path).select("user_id", "event_id", "value")
    upsert_stream(changes, f"file://{tmp_path}/out", ["user_id"], "event_id").awaitTermination()
    table = spark.read.parquet(f"{SF}/events.parquet")
    got = {r.user_id: r.event_id for r in current_table(spark, f"file://{tmp_path}/out").collect()}
    assert got == {r.user_id: r.m for r in table.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_deltas_give_the_last_row_and_restarts_add_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/deltas"
    changes = stream(spark, tmp_path).select("user_id", "event_id", "value")
    for _ in range(2):
        delta_stream(changes, out, ["user_id"], "event_id").awaitTermination()
    table = spark.read.parquet(f"{SF}/events.parquet")
    got = [(r.user_id, r.event_id) for r in read_deltas(spark, out, ["user_id"], "event_id").collect()]
    assert len(got) == len(set(got)) and dict(got) == {r.user_id: r.m for r in table.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert len([p for p in (tmp_path / "deltas").iterdir() if p.name.startswith("epoch=")]) == 3


def test_upserts_survive_a_crash_before_a_version_is_published(spark, tmp_path, monkeypatch):
    """The table stays as it was, and the restart gives what no crash would have."""
    out, publish, calls = f"file://{tmp_path}/out", sinks.publish_table, []
    changes = stream(spark, tmp_path).select("user_id", "event_id", "value")

    def failing(rows, path):
        calls.append(path)
        if len(calls) == 2:
            rows.write.parquet(f"{path}/version-half")
            raise OSError("the driver is gone")
        return publish(rows, path)

    monkeypatch.setattr(sinks, "publish_table", failing)
    with pytest.raises(Exception, match="the driver is gone"):
        upsert_stream(changes, out, ["user_id"], "event_id").awaitTermination()
    kept = current_table(spark, out).count()
    assert kept > 0 and len(calls) == 2
    upsert_stream(changes, out, ["user_id"], "event_id").awaitTermination()
    table = spark.read.parquet(f"{SF}/events.parquet")
    got = {r.user_id: r.event_id for r in current_table(spark, out).collect()}
    assert got == {r.user_id: r.m for r in table.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def shuffled(spark, tmp_path, parts=3):
    """The events table in an order of no sense, then one row a year on, which moves the watermark past all others."""
    table = spark.read.parquet(f"{SF}/events.parquet")
    dealt = table.withColumn("n", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    for i in range(parts):
        dealt.where(F.col("n") == i).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    end = table.agg(F.max("ts") + F.expr("interval 400 days")).first()[0]
    spark.createDataFrame([(-1, end, -1, "error", 0.0, "{}")], table.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late")


def test_pressure_of_shuffled_batches_equals_the_batch_form(spark, tmp_path, rocks):
    got = run(late_pressure_stream(shuffled(spark, tmp_path), "200 days"), "late_pressure").collect()
    want = {r.event_id: (r.pressure, r.due) for r in pressure_counter(spark, SF).where("event_type = 'view'").collect()}
    assert len(got) == len(want) and {r.event_id: (r.pressure, r.due) for r in got} == want


def test_idle_users_begin_anew(spark, tmp_path, rocks):
    hour = 3_600_000
    got = {r.event_id: r.pressure for r in run(late_pressure_stream(shuffled(spark, tmp_path), "200 days", hour), "idle_pressure").collect()}
    want, last, level = {}, {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").selectExpr("event_id", "user_id", "event_type", "unix_millis(cast(ts as timestamp)) as ms").collect():
        if r.user_id in last and r.ms - last[r.user_id] > hour:
            level[r.user_id] = 0
        last[r.user_id] = r.ms
        level[r.user_id] = level.get(r.user_id, 0) + {"view": 1, "purchase": -3}.get(r.event_type, 0)
        if r.event_type == "view":
            want[r.event_id] = level[r.user_id]
    assert got == want and len(set(want.values())) > 2
