"""Reachability, paths and alias groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators import graph as G
from depsift.queries.registry import Tables, query

STARTS = "select component_id from components where brand = 'Brand#1' and component_id % 3 = 0"
REACH = f"with recursive reach(node) as ({STARTS} union select e.dst from reach r join edges e on e.src = r.node)"


def starts(t: Tables) -> DataFrame:
    return t.components.where("brand = 'Brand#1' and component_id % 3 = 0").select(F.col("component_id").alias("node"))


@query(f"{REACH} select component_id as node, exists (select 1 from reach where reach.node = component_id) as reachable from components")
def reachable_nodes(t: Tables) -> DataFrame:
    return G.reachable_split(t.components.select(F.col("component_id").alias("node")), t.edges, starts(t))


@query("""
    with recursive back(node) as (select c.component_id from components c where exists (select 1 from advisories a where a.name = c.name and a.ecosystem = c.ecosystem)
        union select e.src from back b join edges e on e.dst = b.node)
    select node from back
""")
def affected_targets(t: Tables) -> DataFrame:
    """Every component that depends on one of an advisory's name and ecosystem."""
    named = t.components.join(t.advisories.select("name", "ecosystem").distinct(), ["name", "ecosystem"], "left_semi")
    return G.affected_targets(t.edges, named.select(F.col("component_id").alias("node")))


@query(f"""
    with recursive walk(node, depth) as ({STARTS.replace('component_id from', 'component_id, 0 from')} union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 3)
    select node, min(depth) as depth from walk group by node
""")
def deps_within_depth(t: Tables) -> DataFrame:
    return G.closure(t.edges, starts(t), max_depth=3)


@query(f"""
    with recursive walk(node, path) as (select component_id, [component_id] from ({STARTS}) union all
        select e.dst, list_append(w.path, e.dst) from walk w join edges e on e.src = w.node)
    select node, len(path) - 1 as depth, array_to_string(path, '>') as path from (select node, arg_min(path, [len(path)] || path) as path from walk group by node)
""")
def call_chain(t: Tables) -> DataFrame:
    return G.call_chains(t.edges, starts(t)).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""
    with recursive walk(node, path) as (select component_id, [component_id] from components where component_id not in (select dst from edges) union all
        select e.dst, list_append(w.path, e.dst) from walk w join edges e on e.src = w.node)
    select node, array_to_string(arg_min(path, [len(path)] || path), '>') as path from walk group by node
""")
def dependency_path(t: Tables) -> DataFrame:
    """Shortest path from a package that nothing depends on, to every node."""
    nodes = t.components.select(F.col("component_id").alias("node"))
    roots = nodes.join(t.edges.select(F.col("dst").alias("node")).hint("merge"), "node", "left_anti")
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return G.call_chains(t.edges, roots).select("node", path.alias("path"))


@query("""
    with recursive walk(project, node, depth) as (select distinct project, component_id, 0 from project_components union select w.project, e.dst, w.depth + 1 from walk w join edges e on e.src = w.node),
    least as (select project, node, min(depth) as depth from walk group by 1, 2)
    select project, count_if(depth = 1) as direct, count_if(depth > 1) as transitive from least group by 1
""")
def transitive_counts(t: Tables) -> DataFrame:
    """Direct and transitive dependencies of every project."""
    return G.dependency_counts(t.edges, t.project_components.select("project", F.col("component_id").alias("node")), ("project",))


@query("select component_id from components where component_id not in (select dst from edges)")
def isolated_packages(t: Tables) -> DataFrame:
    return t.components.select("component_id").join(t.edges.select(F.col("dst").alias("component_id")), "component_id", "left_anti")


@query("""
    with deps as (select distinct c.component_id as package, e.dst as dep from components c join edges e on e.src = c.component_id where c.size > 5)
    select dep, count(*) as n, array_to_string(list_sort(list(package::varchar)), ',') as packages from deps group by 1 having count(*) > 1
""")
def shared_dependency_conflicts(t: Tables) -> DataFrame:
    """A row per dependency that two packages or more share, not one per pair: pairs grow with the square of a popular one."""
    return G.shared_dependencies(t.edges, t.components.where("size > 5").select(F.col("component_id").alias("package"))).select("dep", "n", F.array_join("packages", ",").alias("packages"))


@query("""
    with recursive records as (
        select advisory_key * 2 as pos, cve as id, case when advisory_key % 2 = 0 then [ghsa] else [] end as aliases, cvss, summary as details, [concat('u/', name)] as urls,
               case when cvss > 3 then 'S' || cvss end as severity, [ecosystem || ':' || name, fixed] as affected from advisories
        union all select advisory_key * 2 + 1, ghsa, case when advisory_key % 4 = 0 then [concat('CVE-2024-', lpad(cast(advisory_key + 3 as string), 6, '0'))] else [] end, cvss / 2, concat(summary, '!'), [concat('v/', name)], 'S' || (cvss / 2), [ecosystem || ':' || name, case when cvss > 5 then fixed || '+' else introduced end] from advisories
    ), pairs as (select id as a, unnest(aliases) as b from records union select unnest(aliases), id from records),
    reach(node, other) as (select id, id from (select id from records union select a from pairs union select b from pairs) union select r.node, p.b from reach r join pairs p on p.a = r.other),
    labels as (select node, min(other) as component from reach group by node),
    rows_ as (select r.*, l.component from records r join labels l on l.node = r.id),
    united as (select component, string_agg(affected[1] || '@' || coalesce(affected[2], '-'), ',' order by affected[1]) as affected
                 from (select * from rows_ qualify row_number() over (partition by component, affected[1] order by pos desc) = 1) group by 1)
    select arg_min(id, pos) as id, max(cvss) as cvss, arg_max(details, [length(details), -pos]) as details, count(*) as records,
           array_to_string(list_sort(list_distinct(flatten(list(urls)))), ',') as urls, array_to_string(list_sort(list_distinct(flatten(list(list_append(aliases, id))))), ',') as aliases,
           arg_min(severity, [-coalesce(cvss, 0), pos]) filter (severity is not null) as severity, any_value(p.affected) as affected
    from rows_ join united p using (component) group by component
""")
def merge_advisories(t: Tables) -> DataFrame:
    a, key, score = t.advisories, F.col("advisory_key"), F.col("cvss")
    none = F.array().cast("array<string>")
    following = F.concat(F.lit("CVE-2024-"), F.lpad((key + 3).cast("string"), 6, "0"))
    text = lambda c: F.concat(F.lit("S"), c.cast("string")).alias("severity")
    package = lambda version: F.array(F.struct("ecosystem", F.col("name").alias("package"), version.alias("version"))).alias("affected")
    first = a.select(
        (key * 2).alias("pos"), F.col("cve").alias("id"), F.when(key % 2 == 0, F.array("ghsa")).otherwise(none).alias("aliases"), "cvss", F.col("summary").alias("details"),
        F.array(F.concat(F.lit("u/"), "name")).alias("urls"), text(F.when(score > 3, score)), package(F.col("fixed")),
    )
    second = a.select(
        (key * 2 + 1).alias("pos"), F.col("ghsa").alias("id"), F.when(key % 4 == 0, F.array(following)).otherwise(none).alias("aliases"), (score / 2).alias("cvss"), F.concat("summary", F.lit("!")).alias("details"),
        F.array(F.concat(F.lit("v/"), "name")).alias("urls"), text(score / 2), package(F.when(score > 5, F.concat("fixed", F.lit("+"))).otherwise(F.col("introduced"))),
    )
    merged = G.merge_advisories(first.unionByName(second))
    affected = F.concat_ws(",", F.transform("affected", lambda x: F.concat(x["ecosystem"], F.lit(":"), x["package"], F.lit("@"), F.coalesce(x["version"], F.lit("-")))))
    return merged.withColumn("urls", F.concat_ws(",", "urls")).withColumn("aliases", F.concat_ws(",", "aliases")).withColumn("affected", affected)
