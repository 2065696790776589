"""Tickets and the flaws they stand for, kept up to date from a stream of ticket events or a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W
from pyspark.sql import functions as F

from depsift.streaming.ordered import InOrder, in_order, timestamp

# What a ticket's state says of its finding; other states mean Open.
TICKET_STATES = (
    ("Open", ("to do", "open", "backlog")),
    ("InProgress", ("in progress", "in review")),
    ("Fixed", ("done", "closed", "resolved")),
    ("Verified", ("verified",)),
    ("AcceptedRisk", ("won't fix", "accepted risk")),
)
#: States that end a finding's work: their tickets expire.
CLOSED = ("Fixed", "Verified", "AcceptedRisk")


def ticket_status(state: Column, deleted: Column) -> Column:
    """Status of a finding from its ticket's state, whatever its case; deleted tickets accept the risk."""
    out = F.when(F.coalesce(deleted, F.lit(False)), "AcceptedRisk")
    for status, states in TICKET_STATES:
        out = out.when(F.lower(state).isin(*states), status)
    return out.otherwise("Open")


def _events(events: DataFrame) -> DataFrame:
    gone = F.coalesce("deleted", F.lit(False))
    return events.select(
        F.col("ticket").cast("string"), F.col("cve").cast("string"), ticket_status(F.col("state"), F.lit(False)).alias("status"), gone.alias("gone"), F.col("at").cast("timestamp")
    ).where("ticket is not null and at is not null")


def ticket_sync(events: DataFrame, keep: str | None = None) -> DataFrame:
    """Live tickets: ticket, cve, status, synced (time of the last event). events: ticket, cve, state, deleted, at.

    An event tells its ticket's state, and may name the CVE that the ticket stands for, which holds until another is named. A deletion
    removes the ticket with its CVE; events after it begin anew. Of events at one time deletions come last, before them greater
    status names, then greater CVEs. Events without a ticket or time are left out.

    With `keep`, an interval, a closed ticket (CLOSED) that nothing happened to for longer is let go with its CVE: by
    a later event of its own, which begins anew, or by the newest event of all. Without it one aggregation answers; with it a ticket's events are read in
    order.
    """
    rows = _events(events)
    if keep is None:
        live, named = ~F.col("gone"), ~F.col("gone") & F.col("cve").isNotNull()
        found = rows.groupBy("ticket").agg(
            F.max(F.when(F.col("gone"), F.col("at"))).alias("end"), F.max(F.when(live, F.struct("at", "status"))).alias("last"),
            F.max(F.when(named, F.struct("at", "status", "cve"))).alias("name"),
        )
        since = lambda c: F.col("end").isNull() | (F.col(c) > F.col("end"))
        found = found.where(F.col("last").isNotNull() & since("last.at"))
        return found.select("ticket", F.when(since("name.at"), F.col("name.cve")).alias("cve"), "last.status", F.col("last.at").alias("synced"))
    newest = rows.agg(F.max("at").alias("newest"))
    order = W.partitionBy("ticket").orderBy("at", "gone", "status", F.col("cve").asc_nulls_first())
    before = lambda c: F.lag(c).over(order)
    silent = F.col("at") > before("at") + F.expr(f"interval {keep}")
    fresh = F.coalesce(before("gone"), F.lit(True)) | (before("status").isin(*CLOSED) & silent)
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("life", F.sum("fresh").over(order))
    last = rows.groupBy("ticket").agg(F.max(F.struct("life", "at", "gone", "status")).alias("last"))
    names = rows.where("cve is not null").groupBy("ticket", "life").agg(F.max(F.struct("at", "gone", "status", "cve")).alias("name"))
    live = last.where("not last.gone").select("ticket", "last.*").join(names, ["ticket", "life"], "left").crossJoin(F.broadcast(newest))  # one row
    over = F.col("status").isin(*CLOSED) & (F.col("newest") > F.col("at") + F.expr(f"interval {keep}"))
    return live.where(~over).select("ticket", F.col("name.cve").alias("cve"), "status", F.col("at").alias("synced"))


def cve_tickets(tickets: DataFrame) -> DataFrame:
    """The ticket of each CVE, the last synced of several: cve, ticket."""
    return tickets.where("cve is not null").groupBy("cve").agg(F.max(F.struct("synced", "ticket")).alias("t")).select("cve", "t.ticket")


CHANGES = "ticket string, cve string, status string, at timestamp, change string"
Change = Row("ticket", "cve", "status", "at", "change")


class Tickets(InOrder):
    """What is kept of a ticket: its last event's time, its status and its CVE; nothing once it is deleted or expired."""

    fields = ["status", "cve", "gone"]
    held_schema = "at long, status string, cve string, gone boolean"
    kept = "synced long, status string, cve string"

    def __init__(self, keep: int | None):
        self.keep = keep

    def apply(self, key, state, at, rows):
        out = []
        for status, cve, gone in sorted(rows, key=lambda r: (r[2], r[0], r[1] is not None, r[1] or "")):
            held = None if state is None else state[2]
            if gone:
                out.append(Change(key[0], held, "AcceptedRisk", timestamp(at), "deleted"))
                state = None
                continue
            now = (at, status, cve if cve is not None else held)
            if state is None or state[1:] != now[1:]:
                out.append(Change(key[0], now[2], status, timestamp(at), "status"))
            state = now
        return state, out

    def deadline(self, state):
        return state[0] + self.keep if self.keep is not None and state[1] in CLOSED else None

    def forget(self, key, state):
        return [Change(key[0], state[2], state[1], timestamp(state[0] + self.keep), "expired")]


def ticket_changes(events: DataFrame, keep_seconds: int | None = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """A stream of events as a stream of changes: ticket, cve, status, at, change (status, deleted or expired).

    Rules are those of `ticket_sync`; a change is told once the watermark has passed it, so events that come out of order or twice
    change nothing. The last change of a ticket is its state: `ticket_state` reads it from what was written. State holds live
    tickets and the events inside the delay; deletion and expiry clear a ticket's state.
    """
    keep = None if keep_seconds is None else keep_seconds * 1_000_000
    return in_order(_events(events), "ticket", Tickets(keep), CHANGES, late)


def ticket_state(changes: DataFrame) -> DataFrame:
    """Live tickets from written changes: ticket, cve, status, since."""
    rank = F.when(F.col("change") == "status", 0).when(F.col("change") == "deleted", 1).otherwise(2)
    last = changes.groupBy("ticket").agg(F.max(F.struct("at", rank.alias("rank"), "status", "cve", "change")).alias("l"))
    return last.where("l.change = 'status'").select("ticket", "l.cve", "l.status", F.col("l.at").alias("since"))
