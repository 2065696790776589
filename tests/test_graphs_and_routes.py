"""Paths, counts of dependencies and routed findings against brute force."""

import random
import re

import pytest

from depsift.operators import containers, findings, graph


def brute_paths(edges, starts):
    best = {s: (s,) for s in starts}
    level = dict(best)
    while level:
        ahead = {}
        for node, path in level.items():
            for a, b in edges:
                if a == node and b not in best:
                    ahead[b] = min(ahead.get(b, path + (b,)), path + (b,))
        best |= ahead
        level = ahead
    return best


@pytest.mark.parametrize("seed, nodes, many", [(1, 40, 90), (2, 25, 120), (3, 60, 50)])
def test_paths_equal_brute_force(spark, seed, nodes, many):
    rng = random.Random(seed)
    edges = [(rng.randint(0, nodes), rng.randint(0, nodes)) for _ in range(many)]
    starts = [0, 1, 5]
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    found = graph.call_chains(df, spark.createDataFrame([(s,) for s in starts], "node long")).collect()
    assert {r.node: tuple(r.path) for r in found} == brute_paths(edges, starts) and all(r.depth == len(r.path) - 1 for r in found)


def test_paths_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Paths of a chain of 3,000 nodes are rebuilt in 12 rounds, and what is written is in proportion to the paths."""
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(df) or df.checkpoint(eager=True))
    from depsift.plans.lineage import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    tree = spark.createDataFrame([(i, i, i - 1 if i else None) for i in range(3000)], "node int, depth int, parent int")
    found = graph.paths_of(tree)
    assert found.selectExpr("bool_and(path = sequence(0, node))", "count(*)").first() == (True, 3000) and len(cuts) <= 13


def test_names_of_other_types_and_no_start(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "src string, dst string")
    found = graph.call_chains(df, spark.createDataFrame([("a",), ("x",)], "node string")).collect()
    assert {r.node: r.path for r in found} == {"a": ["a"], "x": ["x"], "b": ["a", "b"], "c": ["x", "c"]}
    assert graph.call_chains(df, spark.createDataFrame([], "node string")).isEmpty()


def test_dependency_counts_equal_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randint(-70, 200), rng.randint(-70, 200)) for _ in range(300)]
    roots = [(p, n, x) for p in range(60) for n in {7, *(rng.randint(-70, 200) for _ in range(3))} for x in (0, 1)][:400]  # all have 7
    df = spark.createDataFrame(edges, "src long, dst long")
    found = graph.dependency_counts(df, spark.createDataFrame(roots + roots[:9] + [(0, None, 0)], "project long, node long, scope long"), ("project", "scope"))
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    want = {}
    for p, x in {(p, x) for p, _, x in roots}:
        own = {n for q, n, y in roots if (q, y) == (p, x)}
        seen, todo = set(own), list(own)
        while todo:
            new = ahead.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        direct = set().union(*(ahead.get(n, set()) for n in own)) - own
        want[p, x] = (len(direct), len(seen - own - direct))
    assert {(r.project, r.scope): (r.direct, r.transitive) for r in found.collect()} == want


@pytest.mark.parametrize("pattern, text", [
    ("abc", "abc"), ("^lib-x.*core$", "lib-x"), ("a|b", ""), ("ab?cd", "cd"), ("(abc)d", "d"), ("x+yz", "yz"), (r"\Qa.b\E", ""), ("(?i)abc", ""), (r"org\.apache", "org.apache"),
    ("", ""), (None, ""), ("[a", ""), (r"a\b-c", "a-c"), ("(?:ab){2}q", "q"), (r"\p{L}abc", ""),
])
def test_required_text(pattern, text):
    assert findings.required_text(pattern) == text


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(2)
    names = [f"lib-{rng.randint(0, 10**6)}-{w}" for w in ("core", "api", "x") for _ in range(150)] + ["", "a", "zz", None, "org.apache.log"]
    rules = [(k, f"^lib-{k * 7 % 1000003}-", f"t{k}") for k in range(100_000)] + [(200_000, "core$", "core"), (200_001, "(api|x)$", "either"), (200_002, r"^\w?$", "short"), (200_003, r"org\.apache", "apache"), (5, "zz", "z"), (200_004, None, "none")]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names + names[:20])], "package string, row int")
    found = findings.route_findings(df, spark.createDataFrame(rules, "at long, pattern string, team string"))
    tried = sorted((r for r in rules if r[1] is not None and r[0] >= 200_000 or r[0] == 5), key=lambda r: r[0])
    exact = {p: (k, t) for k, p, t in rules[:100_000]}

    def want(name):
        if name is None:
            return None
        hits = [(k, t) for k, p, t in tried if p and re.search(p, name)]
        m = re.match(r"^lib-\d+-", name)
        if m and "^" + m.group() in exact:
            hits.append(exact["^" + m.group()])
        return min(hits)[1] if hits else None

    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.row: r.team for r in found.collect()}
    assert got == {i: want(n) for i, n in enumerate(names + names[:20])} and len({t for t in got.values() if t}) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_by_parts_of_names(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["", "org:", "lib"]) + "".join(rng.choice("ab-") for _ in range(rng.randint(0, 5))) + rng.choice(["", "", "ssl", "-dev"])
    layers = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 3), name()) for _ in range(120)]
    found = [(rng.choice([1, 1, 2, 4]), f"C{rng.randint(0, 60)}", name()) for _ in range(150)]
    got = containers.layer_attribution(spark.createDataFrame(layers, "image int, layer int, package string"), spark.createDataFrame(found, "image int, cve string, package string").distinct())
    parts = lambda p: {p, p.rsplit(":", 1)[-1]}
    best = {}
    for image, cve, package in set(found):
        own = [(layer, p) for i, layer, p in layers if i == image]
        hit = {layer for layer, p in own if parts(p) & parts(package)} or {layer for layer, p in own if p and package and (p in package or package in p)} or {None}
        for layer in hit:
            best[image, layer, cve] = min(best.get((image, layer, cve), package), package)
    assert {(r.image, r.layer, r.cve): r.package for r in got.collect()} == best
