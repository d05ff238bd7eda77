"""What grows by batches: pages of a key, reservation states, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, numbered


def page_bounds(df: DataFrame, key: str, size: int, after: int | None = None) -> DataFrame:
    """(page, first_key, last_key, rows) of the pages of size rows in the order of a unique numeric key, from one sort."""
    rows = df.select(F.col(key).alias("k")) if after is None else df.where(F.col(key) > after).select(F.col(key).alias("k"))
    placed = numbered(rows, [], bucket_of("k", edges(rows, "k")), [F.col("k")], "at")
    pages = placed.groupBy(((F.col("at") - 1 - F.pmod(F.col("at") - 1, F.lit(size))) / size).cast("long").alias("page"))
    return pages.agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("rows"))


def keyset_pages(df: DataFrame, key: str, size: int, consume: Callable[[DataFrame], None], after: int | None = None) -> int | None:
    """Runs consume over pages of size rows in the order of a key; returns the last key, from which a later call resumes.

    The pages' ends are found once; a page then is a range of the key, which a sorted or partitioned source prunes.
    """
    for page in page_bounds(df, key, size, after).orderBy("page").toLocalIterator():
        consume(df.where(F.col(key).between(page["first_key"], page["last_key"])))
        after = page["last_key"]
    return after


def reservation_states(events: DataFrame, key: str, at: str, kind: str, stages: list[str], stops: list[str]) -> DataFrame:
    """key, state, attempts: how far each request has come, by one aggregate that needs no order of arrival.

    A request is in the furthest of the stages that it reached before its first stop, or in that stop; a stage repeated is an
    attempt. Events of other kinds don't count.
    """
    stage = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])[F.col(kind)]
    order = F.struct(F.col(at), F.col(kind))
    stopped = events.groupBy(key).agg(F.min(F.when(F.col(kind).isin(stops), order)).alias("stop"))
    rows = events.join(stopped, key).where(F.col("stop").isNull() | (order <= F.col("stop")))
    out = rows.groupBy(key).agg(F.max(stage).alias("far"), F.first("stop").alias("stop"), F.count_if(F.col(kind) == stages[0]).alias("attempts"))
    reached = F.element_at(F.array(*map(F.lit, stages)), F.col("far") + 1)
    return out.where("far is not null or stop is not null").select(key, F.coalesce(F.col("stop")[kind], reached).alias("state"), "attempts")


def event_windows(events: DataFrame, size: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window of event time; late rows beyond the watermark are left out of streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events).withWatermark("ts", lateness).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def _timed(events: DataFrame) -> DataFrame:
    """ts with the session's time zone (UTC), as watermarks want it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_sessions(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user: stretches of events with less than gap between them."""
    out = _timed(events).withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
