"""Queries on audit logs, policies, configurations and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators import audit as O
from depsift.queries.registry import Tables, query

_AUDIT = "select event_id as entry, cast(user_id % 7 as string) as user, event_type as action, {unix} as timestamp_unix, case event_id % 3 when 0 then 'pass' when 1 then 'fail' else 'warn' end as result from events"
_AUDIT_SQL = _AUDIT.format(unix="floor(epoch(ts))::bigint")


def entries(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id as entry", "cast(user_id % 7 as string) as user", "event_type as action", "unix_timestamp(ts) as timestamp_unix",
        "case event_id % 3 when 0 then 'pass' when 1 then 'fail' else 'warn' end as result", "user_id",
    )


_FROM, _TO = 1704672000, 1705276800  # 2024-01-08 and 2024-01-15


@query(f"select entry, user from ({_AUDIT_SQL}) where timestamp_unix between {_FROM} and {_TO} and action = 'click' and result = 'fail'")
def query_audit(t: Tables) -> DataFrame:
    return O.query_audit(entries(t), _FROM, _TO, "click", "fail").select("entry", "user")


@query(f"select entry from ({_AUDIT_SQL}) where timestamp_unix >= {_TO} - 5 * 86400")
def audit_retention(t: Tables) -> DataFrame:
    return O.audit_retention(entries(t), 5, _TO).select("entry")


@query(f"select entry, timestamp_unix from ({_AUDIT_SQL}) order by timestamp_unix desc, entry desc limit 100")
def audit_tail(t: Tables) -> DataFrame:
    return O.audit_tail(entries(t), 100, "timestamp_unix", "entry").select("entry", "timestamp_unix")


@query(f"select entry, action from ({_AUDIT_SQL}) order by timestamp_unix desc, entry desc limit 20")
def recent_sync_events(t: Tables) -> DataFrame:
    return O.latest(entries(t), 20, "timestamp_unix", "entry").select("entry", "action")


@query("""
    with v as (select image, count(*) as violations, count_if(severity in ('LOW', 'MEDIUM')) as warnings from findings where severity <> 'UNKNOWN' and layer % 2 = 0 group by 1)
    select o_orderkey as image, coalesce(violations, 0) as violations, coalesce(warnings, 0) as warnings,
           case when o_orderkey % 3 = 0 then 'Pass' when coalesce(violations, 0) = 0 then 'Warn' else 'Fail' end as result from orders left join v on v.image = o_orderkey
""")
def audit_entry(t: Tables) -> DataFrame:
    checks = t.orders.select(F.col("o_orderkey").alias("image"), (F.col("o_orderkey") % 3 == 0).alias("passed"))
    return O.audit_entry(checks, t.findings.where("severity <> 'UNKNOWN' and layer % 2 = 0"), "image").select("image", "violations", "warnings", "result")


@query("""
    with u as (select user_id % 5 as team, cast(user_id as string) as user, count(*) as n, count_if(event_type = 'purchase') as f from events where event_type in ('purchase', 'click') group by 1, 2),
    r as (select *, row_number() over (partition by team order by n desc, user) as place from u)
    select team, sum(f)::bigint as fixed, string_agg(case when place <= 5 then user || ':' || n end, ',' order by place) as top from r group by 1
""")
def team_metrics(t: Tables) -> DataFrame:
    action = F.expr("case event_type when 'purchase' then 'VulnFixed' when 'click' then 'Assigned' else 'Viewed' end")
    rows = O.team_metrics(t.events.select((F.col("user_id") % 5).alias("team"), F.col("user_id").cast("string").alias("user"), action.alias("action")))
    return rows.select("team", "fixed", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["user"], x["n"].cast("string"))), ",").alias("top"))


_POLICY = """select l_orderkey as project, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as at, case l_partkey % 5 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' when 3 then 'CRITICAL' end as severity,
    l_suppkey % 2 = 0 as kev_gate, case when l_partkey % 3 > 0 then cast(l_partkey % 10 as double) / 10 end as epss, l_suppkey % 3 > 0 as vex_auto, l_partkey, l_suppkey from {lineitem}"""
_SEV = "list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)"
_SETS = "case when l_partkey % 4 > 0 then ['MIT', 'L' || l_partkey % 3] end as allow, case when l_partkey % 5 > 0 then ['GPL', 'L' || l_suppkey % 4] end as deny"


def policies(t: Tables) -> DataFrame:
    rows = t.spark.sql(_POLICY, lineitem=t.lineitem)
    pair = lambda a, c, n: F.array(F.lit(a), F.concat(F.lit("L"), (F.col(c) % n).cast("string")))
    rows = rows.withColumn("allow", F.when(F.col("l_partkey") % 4 > 0, pair("MIT", "l_partkey", 3))).withColumn("deny", F.when(F.col("l_partkey") % 5 > 0, pair("GPL", "l_suppkey", 4)))
    return rows.drop("l_partkey", "l_suppkey")


def _merged(name: str, low: str, any_: str, all_: str, allow: str, deny: str):
    sql = f"""
        with p as (select *, {_SETS} from ({_POLICY.replace('{lineitem}', 'lineitem')}))
        select project, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][{low}({_SEV})] as severity, {any_}(kev_gate) as kev_gate, {low}(epss) as epss, {all_}(vex_auto) as vex_auto,
               array_to_string(list_sort({allow}), ',') as allow, array_to_string(list_sort({deny}), ',') as deny from p group by 1
    """

    def run(t: Tables) -> DataFrame:
        listed = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
        return O.merge_policies(policies(t), name.rsplit("_", 1)[1]).select("project", "severity", "kev_gate", "epss", "vex_auto", listed("allow"), listed("deny"))

    run.__name__ = name
    query(sql)(run)


_ALL = "list_distinct(flatten(list({0}) filter ({0} is not null)))"
# every list has its first licence in common, so that common ones never run out
_COMMON = "case when count({0}) > 0 then case when count(distinct {0}[2]) = 1 then [min({0}[1]), min({0}[2])] else [min({0}[1])] end end"
_EMPTY = lambda c: "case when count({0}) > 0 then {1} end".format(c, _ALL.format(c))
_merged("merge_policies_strict", "min", "bool_or", "bool_and", _COMMON.format("allow"), _EMPTY("deny"))
_merged("merge_policies_permissive", "max", "bool_and", "bool_or", _EMPTY("allow"), _COMMON.format("deny"))


@query(f"""
    select project, arg_max(severity, "at") as severity, arg_max(kev_gate, "at") as kev_gate from (select project, "at", coalesce(severity, 'none') as severity, kev_gate from ({_POLICY.replace('{lineitem}', 'lineitem')})) group by 1
""")
def merge_policies(t: Tables) -> DataFrame:
    return O.merge_policies(policies(t), "override").select("project", F.coalesce("severity", F.lit("none")).alias("severity"), "kev_gate")


@query("""
    select p_partkey as id, 'common.gone' as path, 'removed' as change from part where p_partkey % 2 = 0 union all select p_partkey, 'common.deep.fresh', 'added' from part where p_partkey % 3 = 0
    union all select p_partkey, 'first', 'removed' from part union all select p_partkey, 'last', 'added' from part where p_partkey % 5 = 0
""")
def config_diff(t: Tables) -> DataFrame:
    old = F.expr("""concat('{"same": 1, "first": {"a": 1}, "common": {"kept": "x", "deep": {"b": [1]}', if(p_partkey % 2 = 0, ', "gone": 2', ''), '}}')""")
    new = F.expr("""concat('{"same": 2, "common": {"kept": {"y": 1}, "deep": {"b": [2]', if(p_partkey % 3 = 0, ', "fresh": null', ''), '}}', if(p_partkey % 5 = 0, ', "last": {"c": 1}', ''), '}')""")
    return O.config_diff(t.part.select(F.col("p_partkey").alias("id"), old.alias("old"), new.alias("new")), "id")


_SAID = """select cve, case when advisory_key % 2 = 0 then concat('pkg:', lower(ecosystem), '/', name) end as purl, case advisory_key % 4 when 0 then 'not_affected' when 1 then 'affected' when 2 then 'fixed' else 'not_affected' end as status,
    concat('2024-0', cast(advisory_key % 5 + 1 as string)) as timestamp, advisory_key as position from {advisories}"""


@query(f"select distinct cve from ({_SAID.replace('{advisories}', 'advisories')}) where purl is null and status in ('not_affected', 'fixed')")
def suppressed_cves(t: Tables) -> DataFrame:
    return O.suppressed_cves(t.spark.sql(_SAID, advisories=t.advisories))


@query("""
    select package as cve, purl, case arg_max(position, [timestamp, lpad(position::varchar, 12, '0')]) % 3 when 0 then 'fixed' when 1 then 'affected' else 'not_affected' end as status from (
        select concat('CVE-', event_type) as package, case when user_id % 3 > 0 then cast(user_id % 10 as string) end as purl, strftime(ts, '%Y-%m-%d') as timestamp, event_id as position from events) group by 1, 2
""")
def latest_vex(t: Tables) -> DataFrame:
    status = F.expr("case event_id % 3 when 0 then 'fixed' when 1 then 'affected' else 'not_affected' end")
    purl = F.expr("case when user_id % 3 > 0 then cast(user_id % 10 as string) end")
    return O.latest_vex(t.events.select(F.concat(F.lit("CVE-"), "event_type").alias("cve"), purl.alias("purl"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("event_id").alias("position")))


@query("select project, component_id from project_components where direct")
def direct_dependencies(t: Tables) -> DataFrame:
    relation = F.when(F.col("direct"), "DIRECT").otherwise("INDIRECT")
    return O.direct_dependencies(t.project_components.withColumn("relation", relation)).select("project", "component_id")


@query("select component_id, 'maven' as asked from components where component_id % 5 = 2 union all select component_id, 'jar' as asked from components where component_id % 3 = 0")
def artifacts_by_type(t: Tables) -> DataFrame:
    rows = t.components.select("component_id", F.expr("case when component_id % 5 = 2 then concat('g:', name) end").alias("coordinates"), F.expr("if(component_id % 3 = 0, 'jar', 'war')").alias("kind"))
    return O.artifacts_by_type(rows).select("component_id", F.lit("maven").alias("asked")).union(O.artifacts_by_type(rows, "jar").select("component_id", F.lit("jar").alias("asked")))
