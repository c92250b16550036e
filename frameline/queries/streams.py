"""The streaming operators over whole tables, as one batch of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.streaming.tracker import contact_episodes as episodes
from frameline.streaming.tracker import contact_rates
from frameline.views import table


def windowed_contacts(spark: SparkSession, d: str) -> DataFrame:
    rows = contact_rates(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 90.0)
    return rows.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "n_contacts", "top")


def contact_episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = episodes(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 60.0, "1 day")
    return rows.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n", "top", "why")


QUERIES = {"windowed_contacts": windowed_contacts, "contact_episodes": contact_episodes}
ORACLE_SQL = {
    "windowed_contacts": "SELECT CAST(floor(epoch_us(ts) / 86400000000.0::DOUBLE) AS BIGINT) * 86400000000 AS start_us, event_type, count(*) AS n, count(CASE WHEN value >= 90 THEN 1 END) AS n_contacts, max(value) AS top FROM events GROUP BY 1, 2",
    "contact_episodes": """WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, value >= 60 AS hit FROM events),
        n AS (SELECT *, lag(hit) OVER w AS b, lag(us) OVER w AS e, lead(hit) OVER w AS a, lead(us) OVER w AS l FROM r WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
        k AS (SELECT *, sum(CASE WHEN hit AND NOT (coalesce(b, FALSE) AND us - e <= 86400000000) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run,
            CASE WHEN l IS NULL THEN 'open' WHEN l - us > 86400000000 THEN 'lost' WHEN NOT a THEN 'left' END AS why FROM n)
        SELECT user_id, min(us) AS started_us, max(us) AS ended_us, count(*) AS n, max(value) AS top, max(why) AS why FROM k WHERE hit GROUP BY user_id, run""",
}
