"""Contact tracking over a stream of events: rates by time window and episodes by user, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events of a folder's Parquet files as they arrive."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def contact_rates(events: DataFrame, ground: float, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, n_contacts, top) for each window; works on streams and tables alike. Rows later than ``late`` may be left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= ground).alias("n_contacts"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "event_type", "n", "n_contacts", "top")


def contact_episodes(events: DataFrame, ground: float, lost: str = "1 day") -> DataFrame:
    """(user_id, started, ended, n, top, why) of each run of a user's rows at or over the ground, in order of time: it ends with the row before one below the
    ground (``left``) or before a silence longer than ``lost`` (``lost``); the last run of a table may still go on (``open``). Repeated rows count once."""
    rows = events.filter(F.col("ts").isNotNull() & F.col("value").isNotNull()).dropDuplicates(["event_id"])
    track = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr(f"INTERVAL {lost}")
    touching = F.col("value") >= ground
    rows = rows.withColumns({"touches": touching, "before": F.lag(touching).over(track), "earlier": F.lag("ts").over(track), "after": F.lead(touching).over(track), "later": F.lead("ts").over(track)})
    begins = F.col("touches") & ~(F.coalesce("before", F.lit(False)) & (F.col("ts") <= F.col("earlier") + gap))
    why = F.when(F.col("later").isNull(), "open").when(F.col("later") > F.col("ts") + gap, "lost").when(~F.col("after"), "left")
    runs = rows.withColumns({"run": F.count_if(begins).over(track.rowsBetween(Window.unboundedPreceding, 0)), "why": why}).filter("touches")
    return runs.groupBy("user_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.max("why").alias("why")).drop("run")


STATE = "started long, ended long, n long, top double, ids array<long>, times array<long>, vals array<double>"
EPISODES = "user_id long, started timestamp, ended timestamp, n long, top double, why string"


def tracked_contacts(events: DataFrame, ground: float, late: str = "1 hour", lost_s: int = 86_400) -> DataFrame:
    """``contact_episodes`` of a stream, each as soon as it is over. A user's state is the episode that goes on and the rows that earlier ones may still come
    before: rows are taken in order of time once the watermark has passed them, so the order of arrival does not matter. A timer ends the episode of a user who is not seen again.
    Rows that come after the watermark are left out, as the watermark says."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, n, top, *held = state.get if state.exists else (0, 0, 0, 0.0, [], [], [])
        waiting = set(zip(held[1], held[0], held[2], strict=True))
        for batch in batches:
            waiting.update(zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["value"].tolist(), strict=True))
        mark, over = state.getCurrentWatermarkMs() * 1000, []

        def end(why: str) -> None:
            nonlocal n
            if n:
                over.append((key[0], started, ended, n, top, why))
            n = 0

        for row in sorted(r for r in waiting if r[0] <= mark):
            waiting.remove(row)
            if n and row[0] - ended > lost_s * 1_000_000:
                end("lost")
            if row[2] < ground:
                end("left")
            else:
                started, top = (started, max(top, row[2])) if n else (row[0], row[2])
                ended, n = row[0], n + 1
        if n and mark - ended > lost_s * 1_000_000:
            end("lost")
        if n or waiting:
            due = min([r[0] for r in waiting] + ([ended + lost_s * 1_000_000] if n else []))
            rest = sorted(waiting)
            state.update((started, ended, n, top, [r[1] for r in rest], [r[0] for r in rest], [r[2] for r in rest]))
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        else:
            state.remove()
        out = pd.DataFrame(over, columns=["user_id", "started", "ended", "n", "top", "why"])
        yield out.assign(**{c: pd.to_datetime(out[c], unit="us") for c in ("started", "ended")})

    rows = events.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "value").groupBy("user_id").applyInPandasWithState(run, EPISODES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
