"""The streaming operators over the whole event table; tests run them on a stream too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.queries.registry import Tables, query
from depsift.streaming import rescan, threats, tickets
from depsift.streaming import windows as S

START = "date_format(start, 'yyyy-MM-dd HH:mm') as start"
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type as action, count(*) as n from events group by 1, 2")
def stream_audit(t: Tables) -> DataFrame:
    """Entries worth 20 or more were delivered twice."""
    delivered = t.events.unionByName(t.events.where("value >= 20"))
    return S.audit_counts(delivered, at="ts", action="event_type", entry="event_id").selectExpr(START, "action", "n")


@query("""
    select strftime(date_trunc('hour', ts) - to_hours(h), '%Y-%m-%d %H:%M') as start, user_id as package, count(*) as n
    from events, (select unnest(range(24)) as h) group by 1, 2 having count(*) >= 3
""")
def stream_release_burst(t: Tables) -> DataFrame:
    return S.release_bursts(t.events, at="ts", package="user_id").selectExpr(START, "package", "n")


_TICKETS = """
    e as (select user_id::varchar as ticket, ts as tm, event_type = 'error' and value >= 15 as gone, case when event_type = 'purchase' then 'CVE-' || floor(value)::int end as cve,
          case event_type when 'view' then 'InProgress' when 'click' then 'Open' when 'purchase' then 'Fixed' when 'signup' then 'AcceptedRisk' else 'Open' end as status from events)"""


@query(f"""
    with {_TICKETS},
    ended as (select ticket, max(tm) as finish from e where gone group by 1),
    live as (select e.* from e left join ended using (ticket) where not e.gone and (finish is null or e.tm > finish))
    select ticket, arg_max(status, tm) as status, arg_max(cve, tm) filter (where cve is not null) as cve, strftime(max(tm), '%Y-%m-%d %H:%M:%S.%f') as synced, false as expiring from live group by 1
    union all
    select ticket, status, cve, strftime(tm, '%Y-%m-%d %H:%M:%S.%f'), true from (
        select ticket, tm, status, gone, last_value(cve ignore nulls) over (partition by ticket, life order by tm) as cve, max(tm) over () as newest, row_number() over (partition by ticket order by tm desc) as place
        from (select *, sum(fresh::int) over (partition by ticket order by tm) as life from (
            select *, coalesce(lag(gone) over w, true) or (lag(status) over w in ('Fixed', 'AcceptedRisk') and tm > lag(tm) over w + interval 1 hour) as fresh from e window w as (partition by ticket order by tm))))
    where place = 1 and not gone and not (status in ('Fixed', 'AcceptedRisk') and newest > tm + interval 1 hour)
""")
def stream_ticket_sync(t: Tables) -> DataFrame:
    """Live tickets, and those that are left if closed ones expire after an hour."""
    state = F.expr("case event_type when 'view' then 'In Review' when 'click' then 'BACKLOG' when 'purchase' then 'done' when 'signup' then 'Accepted Risk' else 'Blocked' end")
    cve = F.when(F.col("event_type") == "purchase", F.concat(F.lit("CVE-"), F.floor("value").cast("string")))
    gone = (F.col("event_type") == "error") & (F.col("value") >= 15)
    events = t.events.select(F.col("user_id").alias("ticket"), cve.alias("cve"), state.alias("state"), gone.alias("deleted"), F.col("ts").alias("at"))
    found = tickets.ticket_sync(events).withColumn("expiring", F.lit(False)).unionByName(tickets.ticket_sync(events, "1 hour").withColumn("expiring", F.lit(True)))
    return found.select("ticket", "status", "cve", F.date_format("synced", TIME).alias("synced"), "expiring")


_FORGET = 86400


@query(f"""
    with p as (select user_id::varchar as package, date_trunc('hour', ts) as tm, case when event_type <> 'signup' then event_type end as description, case when value < 5 then 'Low' when value < 15 then 'High' else 'Critical' end as level from events),
    told as (select package, tm, description, case max(case level when 'Critical' then 4 when 'High' then 3 else 1 end) when 4 then 'Critical' when 3 then 'High' else 'Low' end as level from p where description is not null group by 1, 2, 3),
    near as (select package, tm, lag(tm) over w as b, lead(tm) over w as a from (select distinct package, tm from p) window w as (partition by package order by tm)),
    steps as (select package, tm, case when tm - b <= interval {_FORGET} second then b end as before, case when a - tm <= interval {_FORGET} second then a end as after from near),
    out as (
        select t.package, t.tm, t.description, t.level, 'new' as change from told t join steps s using (package, tm) where not exists (select 1 from told b where b.package = t.package and b.tm = s.before and b.description = t.description)
        union all select t.package, s.after, t.description, t.level, 'resolved' from told t join steps s using (package, tm)
        where s.after is not null and not exists (select 1 from told b where b.package = t.package and b.tm = s.after and b.description = t.description))
    select package, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') as "at", description, level, change from out
""")
def stream_threats(t: Tables) -> DataFrame:
    """Hourly polls; after a day without one a package's threats are forgotten."""
    level = F.expr("case when value < 5 then 'Low' when value < 15 then 'High' else 'Critical' end")
    kind = F.when(F.col("event_type") != "signup", F.col("event_type"))
    polls = t.events.select(F.col("user_id").alias("package"), F.date_trunc("hour", "ts").alias("at"), kind.alias("description"), level.alias("level"))
    return threats.threat_changes(polls, _FORGET).withColumn("at", F.date_format("at", TIME))


@query("""
    select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, user_id as project, count(*) as files, coalesce(any_value(f.critical), 0) as critical, coalesce(any_value(f.high), 0) as high
    from events e left join (select image, count_if(severity = 'CRITICAL') as critical, count_if(severity = 'HIGH') as high from findings group by 1) f on f.image = e.user_id where event_type in ('error', 'purchase') group by 1, 2
    union all
    select 'whole', user_id, count(*), coalesce(any_value(f.critical), 0), coalesce(any_value(f.high), 0)
    from events e left join (select image, count_if(severity = 'CRITICAL') as critical, count_if(severity = 'HIGH') as high from findings group by 1) f on f.image = e.user_id where event_type in ('error', 'purchase') group by 2
""")
def stream_rescan_alert(t: Tables) -> DataFrame:
    """Alerts of each hour, and the summaries that one batch of all changes writes."""
    path = F.expr("case event_type when 'error' then 'app/go.sum' when 'purchase' then 'pom.xml' else concat('app/go.sum/', event_type) end")
    changes = t.events.select(F.col("user_id").alias("project"), path.alias("path"), F.col("ts").alias("at"))
    findings = t.findings.select(F.col("image").alias("project"), "severity")
    hourly = rescan.rescan_alerts(changes, findings).selectExpr(START, "project", "files", "critical", "high")
    whole = rescan.changed_projects(changes, findings).selectExpr("'whole' as start", "cast(project as long) as project", "files", "critical", "high")
    return hourly.unionByName(whole)
