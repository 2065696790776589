"""Queries without SQL, over all nodes, projects and images of the smallest test tables, against brute force."""

from collections import Counter, defaultdict

import pytest

from depsift.plans.tables import table
from depsift.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name, *columns: [tuple(r) for r in table(spark, DATA, name).select(*columns).collect()]


@pytest.fixture(scope="module")
def after(rows):
    out = defaultdict(set)
    for a, b in rows("edges", "src", "dst"):
        out[a].add(b)
    return out


def depths(after, starts):
    found, ahead, depth = dict.fromkeys(starts, 0), set(starts), 0
    while ahead:
        depth += 1
        ahead = {b for a in ahead for b in after.get(a, ())} - set(found)
        found.update(dict.fromkeys(ahead, depth))
    return found


def test_dependency_path(spark, rows, after):
    nodes, met = [n for n, in rows("components", "component_id")], {b for x in after.values() for b in x}
    paths = {n: [n] for n in nodes if n not in met}
    ahead = dict(paths)
    while ahead:
        new = {}
        for a, path in ahead.items():
            for b in after.get(a, ()):
                if b not in paths:
                    new[b] = min(new.get(b, path + [b]), path + [b])
        paths.update(new)
        ahead = new
    assert {r.node: r.path for r in QUERIES["dependency_path"](spark, DATA).collect()} == {n: ">".join(map(str, p)) for n, p in paths.items()}


def test_transitive_counts(spark, rows, after):
    starts = defaultdict(set)
    for project, node in rows("project_components", "project", "component_id"):
        starts[project].add(node)
    want = {}
    for project, nodes in starts.items():
        many = Counter(depths(after, nodes).values())
        want[project] = (many[1], sum(n for d, n in many.items() if d > 1))
    assert {r.project: (r.direct, r.transitive) for r in QUERIES["transitive_counts"](spark, DATA).collect()} == want


def test_affected_targets(spark, rows, after):
    back = defaultdict(set)
    for a, x in after.items():
        for b in x:
            back[b].add(a)
    named = set(rows("advisories", "name", "ecosystem"))
    want = depths(back, [i for i, *key in rows("components", "component_id", "name", "ecosystem") if tuple(key) in named])
    assert sorted(r.node for r in QUERIES["affected_targets"](spark, DATA).collect()) == sorted(want)
