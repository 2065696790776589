"""New and resolved threats between polls of a package, from a stream of polls or a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window as W
from pyspark.sql import functions as F

from depsift.functions.threats import level_rank
from depsift.streaming.ordered import InOrder, in_order, timestamp

CHANGES = "package string, at timestamp, description string, level string, change string"
Change = Row("package", "at", "description", "level", "change")
RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


class Polls(InOrder):
    """What is kept of a package: its last poll with the descriptions and levels that it told."""

    fields = ["description", "level"]
    held_schema = "at long, description string, level string"
    kept = "at long, descriptions array<string>, levels array<string>"

    def __init__(self, forget: int | None):
        self.forget_after = forget

    def apply(self, key, state, at, rows):
        before = {} if state is None else dict(zip(state[1], state[2]))
        now: dict[str, str | None] = {}
        for description, level in rows:
            if description is not None and (description not in now or RANKS.get(level, 0) > RANKS.get(now[description], 0)):
                now[description] = level
        when = timestamp(at)
        out = [Change(key[0], when, d, level, "new") for d, level in now.items() if d not in before]
        out += [Change(key[0], when, d, level, "resolved") for d, level in before.items() if d not in now]
        return (at, list(now), list(now.values())), out

    def deadline(self, state):
        return None if self.forget_after is None else state[0] + self.forget_after


def threat_changes(polls: DataFrame, forget_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """New and resolved threats of each poll of a package: package, at, description, level, change.

    polls: package, at (time of the poll, the same for all its rows), description (null: the poll found none), level. A threat is new if the
    package's poll before did not tell it, and resolved if the poll before told it and this one does not; the level of a
    resolved one is that it had. Of a description repeated in one poll the greatest level counts. With `forget_seconds`, a poll
    that long after the one before has none before it. Rows without a package or time are left out.

    On a stream polls may come late, in parts and out of order: a poll is compared once the watermark has passed it, and what comes
    behind the watermark is dropped. A package keeps its last poll and the polls inside the delay, and nothing once it is
    forgotten. On a table polls are compared by joins on (package, at), and only their times are ordered.
    """
    rows = polls.select(F.col("package").cast("string"), F.col("at").cast("timestamp"), "description", "level").where("package is not null and at is not null")
    if rows.isStreaming:
        return in_order(rows, "package", Polls(None if forget_seconds is None else forget_seconds * 1_000_000), CHANGES, late)
    told = rows.where("description is not null").groupBy("package", "at", "description").agg(F.max_by("level", level_rank(F.col("level"))).alias("level"))
    order = W.partitionBy("package").orderBy("at")
    near = lambda c: c if forget_seconds is None else F.when(F.abs(F.unix_micros(c) - F.unix_micros(F.col("at"))) <= forget_seconds * 1_000_000, c)
    steps = rows.select("package", "at").distinct().select("package", "at", F.lag("at").over(order).alias("before"), F.lead("at").over(order).alias("after"))
    steps = steps.select("package", "at", near(F.col("before")).alias("before"), near(F.col("after")).alias("after"))
    keys = ["package", "at", "description"]
    ahead = told.join(steps, ["package", "at"])
    fresh = ahead.select("package", F.col("before").alias("at"), "description", "level", F.col("at").alias("now"))
    known = told.select(*keys, F.lit(True).alias("known"))
    new = fresh.join(known, keys, "left").where("known is null").select("package", F.col("now").alias("at"), "description", "level", F.lit("new").alias("change"))
    gone = ahead.where("after is not null").select("package", F.col("after").alias("at"), "description", "level")
    return new.unionByName(gone.join(known, keys, "left_anti").withColumn("change", F.lit("resolved")))


def threat_alerts(changes: DataFrame, least: str) -> DataFrame:
    """New threats of at least a level."""
    return changes.where((F.col("change") == "new") & (level_rank(F.col("level")) >= level_rank(F.lit(least))))
