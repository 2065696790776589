"""Plans and rows that only large tables show."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from depsift.llm import simhash as S
from depsift.operators import components as K
from depsift.operators import containers as C
from depsift.operators import findings as O
from depsift.operators import graph as G
from depsift.operators import match
from depsift.operators import threats as T
from depsift.operators import upgrades as U
from depsift.plans.skew import paired_join
from depsift.plans.tables import oracle
from depsift.queries import ORACLES, QUERIES
from depsift.sources import documents as D
from depsift.sources import feeds
from test_queries import DATA, canon


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [300_000, 0])
def test_starts_of_classes_are_not_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(U, "SMALL", most, raising=False)
    # ranges, as Spark knows their size
    classes = spark.range(1, 6).select("id", F.expr("element_at(array('abc.x', 'ab', '', null, 'zz'), cast(id as int))").alias("class"))
    shaded = F.expr("case id when 0 then 'abc' when 1 then 'ab' when 2 then '' else concat('q', id) end")
    relocations = spark.range(500).select(F.concat(F.lit("org."), shaded).alias("pattern"), shaded.alias("shaded"))
    found = U.relocation_match(classes, relocations)
    assert "BuildLeft" not in plan(found)
    assert sorted((r.id, r.original) for r in found.collect()) == [(1, "org.abc.x"), (1, "org.abc.x"), (2, "org.ab"), (3, "org.")]


def test_versions_are_parsed_before_rows_meet(spark):
    packages = spark.createDataFrame([(1, "a", "1.9-r0"), (1, "a", "1.10-r0"), (2, "a", "1.0-r0"), (1, None, "1.0-r0"), (1, "b", None)], "release int, name string, installed string")
    fixes = spark.createDataFrame([(1, "a", "1.10-r0", ["x", "y"]), (1, "b", "9", ["z"]), (1, None, "9", ["z"])], "release int, name string, fixed string, cves array<string>")
    found = C.os_match_alpine(packages, fixes)
    steps = plan(found)
    assert "regexp" not in steps[:steps.index("Exchange")]
    assert sorted((r.installed, r.cve) for r in found.collect()) == [("1.9-r0", "x"), ("1.9-r0", "y")]


@pytest.mark.parametrize("pairs", [1, 3, 500])
def test_pairs_are_dealt_over_tasks(spark, pairs):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([(None, 1), (9, 1)], "k long, a long"))
    others = spark.range(50).select((F.col("id") % 4).alias("k"), F.col("id").alias("b"))
    found = paired_join(rows, others, ["k"], pairs)
    assert found.rdd.getNumPartitions() >= min(4, 500 // pairs)
    want = sorted((a % 3, a, b) for a in range(40) for b in range(50) if a % 3 == b % 4)
    assert sorted(map(tuple, found.select("k", "a", "b").collect())) == want


def test_plan_takes_the_highest_fix_and_each_cve_once(spark):
    rows = [(1, "p", "1", "c1", "1:9"), (1, "p", "1", "c2", "1:10"), (1, "p", "1", "c1", "1:10"), (1, "p", "1", "c3", None), (2, "p", "1", "c1", "1:9")]
    found = U.os_upgrade_plan(spark.createDataFrame(rows, "release int, package string, installed string, cve string, fixed string"), "debian")
    assert sorted((r.release, r.recommended, r.cves) for r in found.collect()) == [(1, "1:10", ["c1", "c2"]), (2, "1:9", ["c1"])]


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Tables whose advisories have numbers of six and seven digits, so that CVEs, cut to six, are shared."""
    folder, con = tmp_path_factory.mktemp("keys"), duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[:-8]
        moved = "{0} + case when {0} < 100 then 104950 else 1049900 end as {0}"
        shift = {"part": f"replace ({moved.format('p_partkey')}, 'same' as p_name)", "lineitem": f"replace ({moved.format('l_partkey')})"}
        con.execute(f"copy (select * {shift.get(name, '')} from '{path}') to '{folder}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["apply_vex", "apply_vex_by_alias", "attach_reachability", "fill_unknown_severity", "match_advisories_swept", "remediation_summary", "read_epss"])
def test_shared_cves(spark, large_keys, name):
    folder, con = large_keys
    found, want = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want.fetchall(), columns)


def test_dedupe_of_shared_cves_leaves_only_what_its_sql_leaves_open(spark, large_keys):
    """All but the EPSS as in the SQL; the EPSS is the highest of those that the first tool and layer tell, between which the SQL's `arg_min` is free."""
    folder, con = large_keys
    found, want = QUERIES["dedupe_findings"](spark, folder), con.execute(ORACLES["dedupe_findings"])
    columns = [c[0] for c in want.description]
    at = columns.index("epss")
    rows, sql = [tuple(r) for r in found.select(*columns).collect()], want.fetchall()
    cut, rest = lambda r: r[:at] + r[at + 1:], columns[:at] + columns[at + 1:]
    assert canon(map(cut, rows), rest) == canon(map(cut, sql), rest)
    told = con.execute(oracle("""select image, cve, max(epss) from (select *, rank() over (partition by image, cve order by tool_order, layer) as place
        from (select * replace (case when layer <> 2 then epss + tool_order end as epss) from findings) where epss is not null) where place = 1 group by 1, 2""")).fetchall()
    assert canon([(r[0], r[1], r[at]) for r in rows if r[at] is not None], ["a", "b", "c"]) == canon(told, ["a", "b", "c"])


def test_dedupe_takes_the_worst_severity_and_the_first_fix(spark):
    rows = [("i", "c", s, 1.0, f, 1, "t", o, "p", "1", e, False) for s, f, o, e in (("HIGH", None, 0, 0.1), ("LOW", "1.2", 1, 0.3), ("UNKNOWN", "3.0", 2, 0.9), ("LOW", None, 0, 0.2))]
    findings = spark.createDataFrame(rows, "image string, cve string, severity string, cvss double, fixed string, layer int, tool string, tool_order int, package string, installed string, epss double, is_kev boolean")
    assert [(r.severity, r.fixed, r.epss) for r in O.dedupe_findings(findings).collect()] == [("HIGH", "1.2", 0.2)]
    assert [(r.severity, r.fixed) for r in O.dedupe_findings(findings, severity=F.max("severity"), fixed=F.max("fixed")).collect()] == [("UNKNOWN", "3.0")]


def test_maps_of_a_file_are_not_repeated_beside_their_entries(spark):
    doc = """{"artifacts": {"g:a": {"version": "1", "shasums": {"jar": "s"}}, "g:b": {"version": "2"}, "g:c": {"version": ""}, "nocolon": {"version": "1"}, "g:d:jar": {"version": "3"}},
        "dependencies": {"g:a": ["g:b", "g:c", "g:z"], "g:a:1": ["g:d:jar"], "g:b": ["g:a", "g:c"]}, "repositories": {"one": ["g:b"], "two": ["g:a", "g:b"], "none": null}}"""
    docs = spark.createDataFrame([("f", doc), ("g", doc.replace('"2"', '"5"')), ("h", None), ("i", "{}")], "file string, value string")
    made, edges = feeds.maven_install(docs), feeds.maven_install_edges(docs)
    assert "Join" in plan(made) and "Join" in plan(edges)
    assert sorted((r.file, r.coordinates, r.sha256, r.repository) for r in made.collect() if r.file == "f") == [("f", "g:a:1", "s", "two"), ("f", "g:b:2", None, "one"), ("f", "g:d:3", None, None)]
    assert sorted(map(tuple, edges.collect())) == [("f", "g:a:1", "g:d:jar:3"), ("f", "g:b:2", "g:a:1"), ("f", "g:b:2", "g:c:"), ("g", "g:a:1", "g:d:jar:3"), ("g", "g:b:5", "g:a:1"), ("g", "g:b:5", "g:c:")]


@pytest.mark.parametrize("name", ["apk_compare", "deb_compare"])
def test_versions_of_a_small_file_are_parsed_by_all_cores(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["reachable_nodes", "call_chain", "dependency_path"])
def test_graphs_are_not_broadcast(spark, monkeypatch, name):
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(plan(df)) or cut(df))
    monkeypatch.setattr(G, "numbered", lambda rows, *more, own=G.numbered: plans.append(plan(rows)) or own(rows, *more))
    plans.append(plan(QUERIES[name](spark, DATA)))
    # what is numbered meets a row for each partition, which is broadcast
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "__range" not in line]
    assert len(plans) > 3 and not joins


def test_components_and_near_copies_broadcast_ids_alone(spark, monkeypatch):
    plans, sent = [], []
    for module in (K, S):
        monkeypatch.setattr(module, "cut", lambda df, own=module.cut: plans.append(plan(df)) or own(df))
    monkeypatch.setattr(S, "sized_join", lambda rows, small, *more, own=S.sized_join: sent.append(small.columns) or own(rows, small, *more))
    text = lambda n, k: " ".join(f"w{n}-{i if i != k else 'x'}" for i in range(80))
    # the id 5 has two texts, one a copy of another
    rows = [(1, text(0, 80)), (2, text(0, 3)), (3, text(1, 80)), (5, text(1, 40)), (5, text(2, 80)), (6, text(3, 80)), (7, text(2, 10))]
    found = {(r.doc_id, r.component_id) for r in S.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (7, 3)}
    components = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and ("ht#" in line or "na#" in line or "v#" in line or "[cur#" in line)]
    assert len(plans) > 10 and not components and sent == [["doc_id"]]


def test_popular_names_of_a_feed_are_dealt_over_tasks(spark):
    packages = spark.range(0, 2000, 1, 1).select("id", F.expr("if(id = 7, null, if(id = 8, 'other', 'name'))").alias("name"))
    feed = spark.range(0, 900, 1, 1).select(F.col("id").alias("entry"), F.expr("case id % 3 when 0 then 'name' when 1 then 'na*' else 'na*x' end").alias("pattern"))
    many = T.feed_lookup(packages, feed).groupBy(F.spark_partition_id().alias("task"), "pattern").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    assert sum(r.n for r in many) == 1998 * 600 and sum(r.s for r in many) == (sum(range(2000)) - 15) * 600
    assert max(r.n for r in many) < 500_000


def test_project_priorities_send_no_sets_of_cves(spark, large_keys, monkeypatch):
    folder, con = large_keys
    for together in (10_000, 2):
        monkeypatch.setattr(match.count_by_priority, "__defaults__", (together,))
        found, want = QUERIES["project_priorities"](spark, folder), con.execute(ORACLES["project_priorities"])
        assert "collect_set(cve" not in plan(found)
        columns = [c[0] for c in want.description]
        assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want.fetchall(), columns)


def test_classes_of_cves_keep_their_weights(spark):
    """More CVEs on one range than a class's number can weigh, versions that meet two ranges of a CVE, and CVEs of two names."""
    ids = spark.range(70_000).select(F.concat(F.lit("c"), "id").alias("cve"), F.lit("e").alias("ecosystem"), F.lit("a").alias("name"), F.lit("r1").alias("advisory"))
    more = spark.createDataFrame([("c1", "e", "a", "r2"), ("c2", "e", "b", "r3"), ("d", "e", "b", "r3")], ids.schema)
    rated = ids.select("cve", F.lit("P1").alias("priority")).unionByName(spark.createDataFrame([("c2", "P1"), ("c2", "P4"), ("d", "P0")], "cve string, priority string"))
    hits = spark.createDataFrame([("e", "a", "1", "r1"), ("e", "a", "1", "r2"), ("e", "a", "2", "r1"), ("e", "b", "1", "r3")], "ecosystem string, name string, version string, advisory string")
    components = spark.createDataFrame([(1, "e", "a", "1"), (2, "e", "a", "2"), (3, "e", "b", "1"), (4, "e", "z", "1")], "component_id long, ecosystem string, name string, version string")
    uses = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 3), (3, 4)], "project long, component_id long")
    for together in (10_000, 2):
        found = match.count_by_priority(uses, components, hits, ids.unionByName(more), rated, together)
        want = [(1, "P0", 1, 1), (1, "P1", 3 * 70_001 + 2, 70_000), (1, "P4", 4, 1), (2, "P0", 1, 1), (2, "P1", 2, 1), (2, "P4", 1, 1)]
        assert sorted(map(tuple, found.collect())) == want


def stages_of(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_classes_of_cves_do_not_move_with_rows(spark):
    """Names with 2,000 CVEs that each stand on a range of their own and of a second name, which no project has beside the first."""
    names = spark.range(6).select(F.lit("e").alias("ecosystem"), F.concat(F.lit("n"), "id").alias("name"), "id")
    held = spark.range(6000).select(F.concat(F.lit("c"), "id").alias("cve"), F.explode(F.expr("array(id % 3 * 2, id % 3 * 2 + 1)")).alias("id")).join(names, "id")
    held = held.select("cve", "ecosystem", "name", F.concat(F.lit("r"), "cve").alias("advisory"))
    hits = held.select("ecosystem", "name", F.lit("1").alias("version"), "advisory")
    components = names.select(F.col("id").alias("component_id"), "ecosystem", "name", F.lit("1").alias("version"))
    uses = spark.range(1200).select(F.expr("id div 3").alias("project"), (F.col("id") % 3 * 2).alias("component_id"))
    before = stages_of(spark)
    found = match.count_by_priority(uses, components, hits, held, held.select("cve", F.lit("P1").alias("priority")).distinct()).collect()
    assert {tuple(r)[1:] for r in found} == {("P1", 6000, 6000)} and len(found) == 400
    assert sum(n for stage, n in stages_of(spark).items() if stage not in before) < 5_000_000


@pytest.mark.parametrize("together", [32, 3])
@pytest.mark.parametrize("narrow", [32, 3])
def test_distinct_cves_of_a_project_by_brute_force(spark, monkeypatch, narrow, together):
    """Versions of one name in one project, repeated rows, CVEs of many names, a project without an id, and names and versions that are null."""
    monkeypatch.setattr(match, "NARROW", narrow, raising=False)
    draw = random.Random(7)
    hits = [("e", f"n{n}", f"{v}", f"r{r}") for n in range(6) for v in range(4) for r in range(5) if draw.random() < 0.35]
    held = [(f"c{c}", "e", f"n{n}", f"r{draw.randrange(5)}") for c in range(60) for n in draw.sample(range(7), draw.choice([1, 1, 2, 3, 6]))]
    rated = [(f"c{c}", draw.choice(["P0", "P1", "P2", "P3", "P4"])) for c in range(61) for _ in range(draw.choice([1, 1, 2, 3]))]
    components = [(i, "e", f"n{i % 7}", f"{i // 7}") for i in range(35)] + [(35, "e", None, "1"), (36, "e", "n1", None)]
    uses = [(draw.choice([None, *range(12)]), draw.choice([*range(37), 99])) for _ in range(110)]
    of = {i: {c for c, *h in held if (*h[:2], v, h[2]) in hits and (*h[:2], v) == (e, n, v)} for i, e, n, v in components}
    findings, cves = Counter(), {}
    for project, i in uses:
        for c in of.get(i, ()):
            for cve, p in rated:
                if cve == c:
                    findings[project, p] += 1
                    cves.setdefault((project, p), set()).add(c)
    name = "ecosystem string, name string, "
    made = [spark.createDataFrame(rows, kinds) for rows, kinds in (
        (uses, "project long, component_id long"), (components, f"component_id long, {name}version string"), (hits, f"{name}version string, advisory string"),
        (held, f"cve string, {name}advisory string"), (rated, "cve string, priority string"))]
    want = {(*k, n, len(cves[k])) for k, n in findings.items()}
    found = [tuple(r) for r in match.count_by_priority(*made, together).collect()]
    assert set(found) == want and len(found) == len(want) > 40


def test_images_move_once(spark):
    layers = [(1, 0, "org:a"), (1, 1, "lib-b-dev"), (1, 2, "a"), (1, 2, ""), (1, 3, None), (2, 0, "zz"), (None, 0, "a"), (4, 0, "x:a"), (4, None, "abc")]
    findings = [(1, "c1", "a"), (1, "c1", "b"), (1, "c2", "b"), (1, "c3", "q"), (1, "c4", ""), (1, "c5", None), (2, "c1", "zz-top"), (3, "c1", "a"), (None, "c1", "a"), (4, "c1", "y:a"), (4, "c2", "b"), (4, "c3", "o:abcd")]
    made = spark.createDataFrame(layers, "image long, layer int, package string"), spark.createDataFrame(findings, "image long, cve string, package string")
    found = [sorted(map(str, C.layer_attribution(*made, few).collect())) for few in (64, 2, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 13
    assert plan(C.layer_attribution(*made)).count("Join") == 1


def test_spdx_rows_move_by_project_once(spark):
    """Repeated rows, two components of one id, a licence that says what a missing one does, a self edge, ends of other projects."""
    kinds = "project long, component_id long, ecosystem string, name string, version string, license string, dsts array<long>"
    named = {1: ("npm", "a", "1", "MIT", [2, 3, 9]), 2: ("npm", "b", "1", None, [1, 2]), 3: ("npm", "b", "1", "NOASSERTION", [5]), 4: ("Go", "c", "2", None, None), 5: ("Go", "@x/d", "2", "ISC", [])}
    uses = [(1, 1), (1, 2), (1, 2), (1, 3), (1, 5), (2, 1), (2, 4), (3, 5), (4, 2), (4, 3)]
    rows = spark.createDataFrame([(p, c, *named[c]) for p, c in uses], kinds)
    ids = rows.select("project", F.col("component_id").alias("c"), D.spdx_ref().alias("id")).distinct()
    ends = rows.select("project", D.spdx_ref().alias("src"), F.explode("dsts").alias("c")).join(ids, ["project", "c"]).select("project", "src", F.col("id").alias("dst")).distinct()
    want = D.spdx(rows.drop("component_id", "dsts").distinct(), edges=ends)
    assert sorted(map(tuple, D.spdx_of_components(rows).collect())) == sorted(map(tuple, want.collect()))


def test_write_spdx_moves_rows_to_their_project_once(spark):
    steps = plan(QUERIES["write_spdx"](spark, DATA))
    first = steps.split("== Initial Plan ==")[-1]
    assert first.count("Exchange hashpartitioning(project") == 1
