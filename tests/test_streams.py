"""Streams give what the same operator gives on the whole table, however rows come."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from depsift.streaming import rescan, threats, tickets, windows

EVENTS = "/root/testdata/sf0.001/events.parquet"
START = datetime(2024, 1, 1)


def streamed(spark, tmp_path, make, mode):
    table = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "in")
    table.orderBy("ts").repartitionByRange(4, "ts").write.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    name = f"out_{make.__name__}"
    run = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert not run.isActive
    return sorted(map(tuple, spark.table(name).collect()), key=str), sorted(map(tuple, make(table).collect()), key=str)


def batches(spark, tmp_path, parts, schema):
    """A stream that reads the parts one by one."""
    folder = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b={k:03}"))
        for f in (folder / f"b={k:03}").glob("*.parquet"):  # files are read in order of their times
            import os

            os.utime(f, (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*")


def run_all(stream, path, checkpoint):
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert not run.isActive and run.exception() is None
    return run


def disordered(rows, at, late, seed):
    """Rows in parts, none more than `late` behind those before it."""
    rng = random.Random(seed)
    mixed = sorted(rows, key=lambda r: at(r) + timedelta(seconds=rng.uniform(0, late * 0.9)))
    return [mixed[k::1][: len(mixed) // 6 + 1] for k in range(0, len(mixed), len(mixed) // 6 + 1)]


def test_audit_counts_on_a_stream(spark, tmp_path):
    def audit(rows):
        return windows.audit_counts(rows, late="100 days", at="ts", action="event_type")

    got, want = streamed(spark, tmp_path, audit, "complete")
    assert want and got == want


def test_entries_delivered_twice_count_once(spark, tmp_path):
    rng = random.Random(2)
    entries = [(i, START + timedelta(minutes=i * 7), rng.choice(["scan", "fix", None])) for i in range(300)]
    twice = entries + [e for e in entries if e[0] % 3 == 0] + [e for e in entries if e[0] % 5 == 0]
    schema = "id long, at timestamp, action string"
    parts = disordered(twice, lambda r: r[1], 3600, 1) + [[(10**6, START + timedelta(days=30), "end")]]
    counts = windows.audit_counts(batches(spark, tmp_path, parts, schema), late="1 hour", entry="id")
    run = windows.write_closed_windows(counts, str(tmp_path / "out"), str(tmp_path / "c"))
    run.awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = sorted(map(tuple, windows.audit_counts(spark.createDataFrame(twice, schema), entry="id").collect()), key=str)
    assert sum(r[2] for r in want) == 300 and got == want
    again = windows.write_closed_windows(counts, str(tmp_path / "out"), str(tmp_path / "c"))  # nothing new: nothing written
    again.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want


def test_ticket_states(spark):
    cases = [("To Do", False, "Open"), ("CLOSED", False, "Fixed"), ("Accepted Risk", None, "AcceptedRisk"), ("done", True, "AcceptedRisk"), (None, None, "Open"), ("verified", False, "Verified")]
    rows = spark.createDataFrame(cases, "state string, deleted boolean, want string")
    assert rows.where(tickets.ticket_status(F.col("state"), F.col("deleted")) != F.col("want")).count() == 0


TICKET = "ticket string, cve string, state string, deleted boolean, at timestamp"


def ticket_events(seed, many=260):
    rng = random.Random(seed)
    rows = []
    for _ in range(many):
        at = START + timedelta(seconds=rng.choice([1, 60, 600]) * rng.randint(0, 300))
        rows.append((f"T{rng.randint(0, 11)}", rng.choice([None, None, "C1", "C2", "C3"]), rng.choice(["done", "open", "In Review", "verified", "?", None]), rng.random() < 0.12, at))
    return rows + [(None, "C1", "open", False, START), ("T0", "C1", "open", False, None)]


def brute_tickets(rows, keep, newest=None):
    """Ticket by ticket, event by event."""
    status = {"done": "Fixed", "open": "Open", "In Review": "InProgress", "verified": "Verified"}
    rows = [r for r in rows if r[0] is not None and r[4] is not None]
    newest = newest or max(r[4] for r in rows)
    live = {}
    order = lambda r: (r[0], r[4], bool(r[3]), status.get(r[2], "Open"), r[1] is not None, r[1] or "")
    closed = lambda x: x[1] in ("Fixed", "Verified", "AcceptedRisk")
    for r in sorted(rows, key=order):
        ticket, cve, state, deleted, at = r
        old = live.get(ticket)
        if old and keep and closed(old) and at > old[2] + keep:
            old = None
        if deleted:
            live.pop(ticket, None)
        else:
            live[ticket] = (cve or (old[0] if old else None), status.get(state, "Open"), at)
    return {(t, *x) for t, x in live.items() if not (keep and closed(x) and newest > x[2] + keep)}


def test_ticket_sync_on_tables(spark):
    for seed in range(3):
        rows = ticket_events(seed)
        df = spark.createDataFrame(rows, TICKET)
        assert set(map(tuple, tickets.ticket_sync(df).collect())) == brute_tickets(rows, None)
        assert set(map(tuple, tickets.ticket_sync(df, "2 hours").collect())) == brute_tickets(rows, timedelta(hours=2))
    assert tickets.ticket_sync(df.limit(0)).isEmpty() and tickets.ticket_sync(df.limit(0), "1 hour").isEmpty()
    found = tickets.ticket_sync(df)
    assert {r.cve for r in tickets.cve_tickets(found).collect()} == {r.cve for r in found.collect() if r.cve}


def kept_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def test_ticket_changes_on_a_stream(spark, tmp_path):
    rows = ticket_events(7)
    late, keep = 4 * 3600, timedelta(hours=10)
    parts = disordered([r for r in rows if r[4]], lambda r: r[4], late, 3) + [[r for r in rows if not r[4]]]
    parts.append([r for r in rows if r[4]][:20])  # delivered again, behind the watermark or not
    end = START + timedelta(days=40)
    parts.append([("end", None, "open", False, end)])
    changes = tickets.ticket_changes(batches(spark, tmp_path, parts, TICKET), int(keep.total_seconds()), f"{late} seconds")
    run_all(changes, str(tmp_path / "out"), str(tmp_path / "c"))
    written = spark.read.parquet(str(tmp_path / "out"))
    want = brute_tickets(rows, keep, end)
    got = {(r.ticket, r.cve, r.status) for r in tickets.ticket_state(written).collect()}
    assert got == {x[:3] for x in want} and {"status", "deleted", "expired"} == {r.change for r in written.select("change").distinct().collect()}
    # state: live tickets alone, and the one event that the watermark has not passed
    assert {r[0] for r in kept_rows(spark, str(tmp_path / "c"), "kept").select("key.ticket").collect()} == {x[0] for x in want}
    assert kept_rows(spark, str(tmp_path / "c"), "held").count() == 1


def polls(rows):
    level = F.expr("case event_id % 3 when 0 then 'Low' when 1 then 'High' else 'Critical' end")
    return rows.select(F.col("user_id").alias("package"), F.date_trunc("day", "ts").alias("at"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("description"), level.alias("level"))


def test_threat_changes_of_polls_out_of_order(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    rows = [tuple(r) for r in polls(table).collect()]
    schema = "package long, at timestamp, description string, level string"
    rows = [r for r in rows if r[0] != 3 or r[1].day % 9 == 0]  # a package that is forgotten between its polls
    parts = disordered(rows, lambda r: r[1], 3 * 86400, 5) + [[(-1, START + timedelta(days=400), None, None)]]
    changes = threats.threat_changes(batches(spark, tmp_path, parts, schema), 5 * 86400, "3 days")
    run_all(changes, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    whole = threats.threat_changes(spark.createDataFrame(rows, schema), 5 * 86400)
    want = sorted(map(tuple, whole.collect()), key=str)
    assert {"new", "resolved"} == {r[4] for r in want} and got == want
    assert kept_rows(spark, str(tmp_path / "c"), "kept").count() == 0 and kept_rows(spark, str(tmp_path / "c"), "held").count() == 1
    assert threats.threat_alerts(whole, "High").where("level = 'Low' or change <> 'new'").isEmpty()


def test_rescan_alerts_on_a_stream(spark, tmp_path):
    findings = spark.createDataFrame([(i % 20, s) for i in range(60) for s in ("CRITICAL", "high", "LOW")], "project long, severity string")

    def alerts(rows):
        changes = rows.select(F.col("user_id").alias("project"), F.expr("if(event_id % 3 = 0, 'a/pom.xml', 'a/x.py')").alias("path"), F.col("ts").alias("at"))
        return rescan.rescan_alerts(changes, findings, late="100 days")

    got, want = streamed(spark, tmp_path, alerts, "complete")
    assert want and got == want


def test_watched_folder_and_replayed_batches(spark, tmp_path):
    def put(path):
        file = tmp_path / "watched" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(path)

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    held = [("app", "CRITICAL"), ("app", "high"), ("lib", "LOW")]
    findings = lambda: spark.createDataFrame(held, "project string, severity string")
    sweep = lambda: rescan.rescan_batches(rescan.watched_files(spark, str(tmp_path / "watched")), findings, out, checkpoint).awaitTermination(120)
    told = lambda: {tuple(r[c] for c in ("project", "files", "critical", "high", "batch")) for r in rescan.rescan_summaries(spark, out).collect()}
    for path in ("app/1/pom.xml", "app/1/sub/Cargo.lock", "app/1/main.rs", "lib/1/go.sum", "doc/1/readme.md"):
        put(path)
    assert sweep() and told() == {("app", 2, 1, 1, 0), ("lib", 1, 0, 0, 0)}
    held += [("lib", "critical")]
    put("lib/2/go.sum")
    assert sweep() and told() == {("app", 2, 1, 1, 0), ("lib", 1, 1, 0, 1)}
    before = told()
    for note in ("1", ".1.crc"):  # the job is lost before the end of its batch is noted: the batch runs again
        (Path(checkpoint) / "commits" / note).unlink(missing_ok=True)
    assert sweep() and told() == before
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
