"""Queries on licences, look-alike names and upgrade feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators import supply as S
from depsift.queries.registry import Tables, query

_FEEDBACK = """
    select l_partkey as package, l_linestatus as from_version, cast(l_linenumber as string) as to_version,
           l_returnflag <> 'R' as success, case when l_returnflag = 'R' then concat('issue-', cast(l_suppkey % 5 as string)) end as issue from {lineitem}
"""
_SUCCESS = f"""
    select package, from_version, to_version, count(*) as attempts, count_if(success) as successes,
           coalesce(array_to_string(list_sort(list(distinct issue) filter (issue is not null)), ','), '') as issues
    from ({_FEEDBACK.format(lineitem="lineitem")}) group by package, from_version, to_version
"""


def feedback(t: Tables) -> DataFrame:
    return t.spark.sql(_FEEDBACK, lineitem=t.lineitem)


@query("""
    with rules as (select * from (values
        ('MIT', 'MIT', 'Safe'), ('MIT', 'Apache-2.0', 'Safe'), ('MIT', 'BSD-3-Clause', 'Safe'), ('MIT', 'ISC', 'Safe'),
        ('MIT', 'GPL-3.0-only', 'Critical'), ('MIT', 'GPL-2.0-only', 'Critical'), ('MIT', 'AGPL-3.0-only', 'Critical'),
        ('Apache-2.0', 'MIT', 'Safe'), ('Apache-2.0', 'Apache-2.0', 'Safe'), ('Apache-2.0', 'BSD-3-Clause', 'Safe'), ('Apache-2.0', 'ISC', 'Safe'),
        ('Apache-2.0', 'GPL-3.0-only', 'Medium'), ('Apache-2.0', 'GPL-2.0-only', 'High'), ('Apache-2.0', 'AGPL-3.0-only', 'High'),
        ('GPL-3.0-only', null, 'Safe')) r(project, dep, risk)),
    pairs as (select pc.project as order_key, c.component_id, case pc.project % 3 when 0 then 'MIT' when 1 then 'Apache-2.0' else 'GPL-3.0-only' end as project, c.license
              from project_components pc join components c on pc.component_id = c.component_id)
    select p.order_key as project, coalesce(r.risk, case when p.license is null then 'High' else 'Medium' end) as risk, count(*) as n
    from pairs p left join rules r on p.project = r.project and (r.dep is null or r.dep = p.license) group by 1, 2
""")
def license_compatibility(t: Tables) -> DataFrame:
    kind = F.expr("case project % 3 when 0 then 'MIT' when 1 then 'Apache-2.0' else 'GPL-3.0-only' end")
    rows = t.project_components.join(t.components.select("component_id", "license"), "component_id")
    return rows.groupBy("project", S.license_compatibility(kind, F.col("license")).alias("risk")).agg(F.count("*").alias("n"))


@query("""
    with n as (select distinct name from components), k as (select distinct name as known from components where component_id % 4 = 0),
    met as (select name, known, levenshtein(name, known) as distance, 1 - levenshtein(name, known)::double / greatest(length(name), length(known)) as similarity
            from n join k on abs(length(name) - length(known)) <= 2 and name <> known where levenshtein(name, known) <= 2),
    best as (select * from met where similarity > 0.8 qualify row_number() over (partition by name order by similarity desc, known) = 1)
    select name, known, distance, case when similarity > 0.95 and distance = 1 then 'Critical' when similarity > 0.9 then 'High' when similarity > 0.85 then 'Medium' else 'Low' end as level from best
""")
def typosquat_basic(t: Tables) -> DataFrame:
    return S.typosquats(t.components, t.components.where("component_id % 4 = 0")).select("name", "known", "distance", "level")


@query(f"""
    with s as ({_SUCCESS}) select *, null as upgrades, null as packages from s
    union all select null, null, null, sum(attempts), sum(successes), null, count(*), count(distinct package) from s
""")
def upgrade_success(t: Tables) -> DataFrame:
    """Each upgrade, and a row over all without a package."""
    found = S.upgrade_success(feedback(t))
    rows = found.select("package", "from_version", "to_version", "attempts", "successes", F.array_join("issues", ",").alias("issues"))
    return rows.unionByName(S.upgrade_statistics(found).drop("rate"), allowMissingColumns=True)


@query(f"""
    with s as ({_SUCCESS}) select o.o_orderkey as upgrade, round(s.successes / s.attempts, 6) as rate
    from orders o left join s on s.package = o.o_custkey and s.from_version = o.o_orderstatus and s.to_version = '1'
""")
def upgrade_success_lookup(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_orderkey").alias("upgrade"), F.col("o_custkey").alias("package"), F.col("o_orderstatus").alias("from_version"), F.lit("1").alias("to_version"))
    return S.upgrade_success_lookup(asked, S.upgrade_success(feedback(t))).select("upgrade", F.round("rate", 6).alias("rate"))
