"""Episodes of a stream against those of the table it carries, whatever the order of arrival."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from frameline.streaming.tracker import contact_episodes, tracked_contacts

KIND = "event_id long, ts timestamp, user_id long, value double"
START = datetime.datetime(2024, 1, 1)


def episodes(rows: list[tuple], ground: float, lost: datetime.timedelta) -> list[tuple]:
    """A walk over each user's rows."""
    out = []
    for user in {r[2] for r in rows}:
        now: list[tuple] = []
        mine = sorted({r for r in rows if r[2] == user}, key=lambda r: (r[1], r[0]))
        for r in mine:
            if now and r[1] - now[-1][1] > lost:
                out.append((user, now, "lost"))
                now = []
            if r[3] >= ground:
                now.append(r)
            elif now:
                out.append((user, now, "left"))
                now = []
        if now:
            out.append((user, now, "open"))
    return sorted((u, e[0][1], e[-1][1], len(e), max(r[3] for r in e), why) for u, e, why in out)


def events(seed: int) -> list[tuple]:
    chance, rows = random.Random(seed), []
    for k in range(400):
        rows.append((k, START + datetime.timedelta(minutes=10 * k + chance.randint(0, 9)), chance.randint(1, 4), float(chance.randint(0, 10))))
    return rows


def found(df) -> list[tuple]:
    return sorted((r["user_id"], r["started"].replace(tzinfo=None), r["ended"].replace(tzinfo=None), r["n"], r["top"], r["why"]) for r in df.collect())


def test_episodes_of_a_table(spark):
    rows = [*events(1), *events(1)[:50]]  # repeated rows
    odd = [(900, None, 1, 9.0), (901, START, 9, None), (902, START, 8, 9.0)]
    got = found(contact_episodes(spark.createDataFrame([*rows, *odd], KIND), 4.0, "2 hours"))
    assert got == episodes([*rows, odd[2]], 4.0, datetime.timedelta(hours=2))
    assert contact_episodes(spark.createDataFrame([], KIND), 4.0).count() == 0


def test_a_stream_in_any_order_gives_the_table_s_episodes(spark, tmp_path):
    rows, lost = events(2), datetime.timedelta(hours=2)
    last = (9999, START + datetime.timedelta(days=9), 77, 0.0)  # moves the watermark past all the others
    chance = random.Random(3)
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=chance.randint(0, 50)))  # less late than the watermark waits
    parts = [late[k : k + 80] + late[max(0, k - 5) : k] for k in range(0, len(late), 80)] + [[last], [(10000, last[1], 77, 0.0), rows[0]]]  # repeated rows, and one that is far too late
    for k, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        (tmp_path / f"in/part={k}").touch()
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = tracked_contacts(stream, 4.0, "1 hour", 7200).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive
    got = found(spark.read.parquet(str(tmp_path / "out")))
    wanted = [e if e[-1] != "open" else (*e[:-1], "lost") for e in episodes(rows, 4.0, lost)]  # by the end, nobody has been seen for long
    assert got == wanted
