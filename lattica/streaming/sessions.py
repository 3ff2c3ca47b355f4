"""Structured Streaming forms: windowed counts, the session pressure counter, file deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(window, event_type, n, total) of tumbling windows; rows later than ``late`` behind the watermark are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def pressure_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, pressure, due) of every search, from a stream of (event_id, user_id, event_type, ts).

    Within a micro-batch a user's rows are taken by time; state holds two counts for each user, whatever came before, so
    batches must be in time order. ``view`` is a search and ``purchase`` a use.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        searches, uses = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        found = rows["event_type"] == "view"
        s, u = searches + found.cumsum(), uses + (rows["event_type"] == "purchase").cumsum()
        level = s - 3 * u
        state.update((int(s.iloc[-1]), int(u.iloc[-1])))
        due = found & (level >= 5) & ((level % 5 == 0) | (level >= 20))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "pressure": level, "due": due})[found]

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, pressure long, due boolean", "searches long, uses long", "append", GroupStateTimeout.NoTimeout)


class _LatePressure(StatefulProcessor):
    """A user's rows wait until the watermark has passed them, then count in the order of (ts, event_id)."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, event_type string, ms long, us long")
        self.counts = handle.getValueState("counts", "searches long, uses long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            new = [(int(e), t, int(u) // 1000, int(u)) for e, t, u in zip(part["event_id"], part["event_type"], us, strict=True)]
            self.waiting.appendList(new)
            self.handle.registerTimer(min(n[2] for n in new) + 1)
        yield pd.DataFrame({c: [] for c in ("event_id", "user_id", "pressure", "due")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if r[2] < mark), key=lambda r: (r[3], r[0]))
        later = [r for r in rows if r[2] >= mark]
        searches, uses, last = self.counts.get() if self.counts.exists() else (0, 0, 0)
        found = []
        for event, kind, ms, _ in ready:
            if self.idle is not None and last and ms - last > self.idle:
                searches, uses = 0, 0
            searches, uses, last = searches + (kind == "view"), uses + (kind == "purchase"), ms
            if kind == "view":
                level = searches - 3 * uses
                found.append((event, key[0], level, level >= 5 and (level % 5 == 0 or level >= 20)))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[2] for r in later) + 1)
        else:
            self.waiting.clear()
        if self.idle is not None and not later and last + self.idle < mark:
            self.counts.clear()
        else:
            self.counts.update((searches, uses, last))
            if self.idle is not None and not later:
                self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame(found, columns=["event_id", "user_id", "pressure", "due"])

    def close(self) -> None:
        pass


def late_pressure_stream(events: DataFrame, late: str, idle: int | None = None) -> DataFrame:
    """``pressure_stream`` for rows in any order: each counts once the watermark, ``late`` behind the newest row, has passed it.

    Rows that come later than that are left out, as with every watermark. A user's state is the rows that wait and two counts;
    after ``idle`` milliseconds without a row the counts begin anew and the state goes (None: never). Rows with a null user
    are one user's; those with a null time are left out. The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.where("ts is not null").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_LatePressure(idle), "event_id long, user_id long, pressure long, due boolean", "append", "eventTime")


def upsert_stream(changes: DataFrame, path: str, key: list[str], seq: str):
    """A running query that keeps the last row of each key in the table at ``path``, one version a micro-batch.

    The table is read with ``current_table``. Its checkpoint is beside it, so a restart goes on where it stopped: a crash leaves
    the version before or after the micro-batch, and one that runs again gives the same rows. Each micro-batch writes the whole
    table; for large ones use ``delta_stream``.
    """
    from lattica.operators.edges import last_writer
    from lattica.sources.sinks import current_version, publish_table

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = current_version(spark, path)
        rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch) if before else batch
        publish_table(last_writer(rows, key, seq).select(batch.columns), path)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()


def delta_stream(changes: DataFrame, path: str, key: list[str], seq: str):
    """A running query that writes each micro-batch's last row of each key to a folder of its own below ``path``.

    A micro-batch that is run again overwrites its folder, so each change counts once; no batch reads or writes what others
    wrote. ``read_deltas`` gives the last rows of all.
    """
    from lattica.operators.edges import last_writer

    def each(batch: DataFrame, epoch: int) -> None:
        last_writer(batch, key, seq).select(batch.columns).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()


def read_deltas(spark: SparkSession, path: str, key: list[str], seq: str) -> DataFrame:
    """The last row of each key over all micro-batches that ``delta_stream`` has written."""
    from lattica.operators.edges import last_writer

    return last_writer(spark.read.parquet(path).drop("epoch"), key, seq)
