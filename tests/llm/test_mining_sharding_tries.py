"""Hard negatives, shards and conversation tries against brute force on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from depsift.llm import hard_negatives, prefix_trie, queries, sharding

VECTORS = "vec_id long, embedding array<float>, label int, id long, score string, key int, found string"
DOCS = "doc_id long, text string, source string, shard string, place int, size string"
TURNS = "conv_id long, turn int, role string, text string, depth string, total long, place long"


def vectors(many=230):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(11)] for _ in range(6)]
    rows = []
    for i in range(many):
        v = [x + rng.choice([0, 0, 0.01, 0.3]) * rng.uniform(-1, 1) for x in rng.choice(base)]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2])))
    rows += [(many, None, 1), (many + 1, [1.0] * 11, None), (many + 2, [1.0, None] + [0.0] * 9, 1), (many + 3, [float("nan")] * 11, 1), (many + 4, [float("inf")] * 11, 0)]
    rows += [(many + 5, [], 1), (many + 6, [0.5] * 3, 1), (many + 7, [0.25] * 3, 1), (many + 8, [-0.0] * 11, 1), (None, base[0], 0), (10, rows[10][1], rows[10][2]), (500, base[1], 0), (501, base[1], 1)]
    return [(i, v, label, 1, "x", 2, "y") for i, v, label in rows]


def brute_negatives(rows, is_anchor):
    seen, ok = set(), []
    for i, v, label, *_ in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            if (i, label, q) not in seen:
                seen.add((i, label, q))
                ok.append((i, label, q))
    out = Counter()
    place = lambda i: (i is None, i or 0)
    for i, label, q in ok:
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), place(j), j, m) for j, m, r in ok if len(r) == len(q) and (j, m, r) != (i, label, q)]
        for s, _, j, m in sorted(x for x in scored if x[3] == label)[:5]:
            hits = sorted(x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out.update((i, j, rank, n[2], -s, -n[0]) for rank, n in enumerate(hits, 1))
    return out


@pytest.mark.parametrize("block, lane", [(16_384, 1024), (30, 4)])
def test_hard_negatives_equal_brute_force(spark, block, lane):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, lane=lane)
    got = Counter(tuple(r) for r in found.collect())
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 50 and got == want
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_lookups_equal_products():
    rng = np.random.default_rng(1)
    for width, most in ((1, 1), (7, 5), (8, 256), (64, 256), (65, 100_000)):
        anchors, rows = rng.integers(-most, most + 1, (5, width)), rng.integers(-most, most + 1, (40, width))
        planes = hard_negatives.bit_planes(rows, most.bit_length() + 1)
        assert (hard_negatives.lookup_scores(planes, hard_negatives.subset_sums(anchors, np.int64)) == rows @ anchors.T).all()


def test_wide_components_use_long_sums_and_too_wide_ones_are_told(spark):
    rows = [(i, [float(i * 1000), 7.5], i % 2, 0, "", 0, "") for i in range(1, 21)]
    df = spark.createDataFrame(rows, VECTORS)
    got = Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 5 == 0).collect())
    assert got and got == brute_negatives(rows, lambda i: i % 5 == 0)
    with pytest.raises(ValueError):
        hard_negatives.mine_hard_negatives(spark.createDataFrame([(1, [1e30], 0, 0, "", 0, "")], VECTORS), F.lit(True))


def documents():
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "né", "", "x" * 500]), rng.choice(["hot"] * 8 + ["b", "ç", None]), "s", 1, "z") for i in range(203)]
    return rows + [(None, "null id", "b", "s", 1, "z"), (None, None, None, "s", 1, "z"), rows[5], rows[5], (300, None, "hot", "s", 1, "z")]


@pytest.mark.parametrize("shards", [1, 8, 11])
def test_shards(spark, shards):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = sharding.shard_documents(df, shards=shards).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, *_ in rows)
    held = defaultdict(list)
    for r in found:
        held[r.shard].append(r.slot)
    assert sorted(held) == list(range(shards)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    mixture, whole = Counter((r.shard, r.source) for r in found), Counter(r.source for r in found)
    assert all(abs(mixture[s, name] - n / shards) < 3 for s in range(shards) for name, n in whole.items())
    # by definition: seeded order in each source, fractional rank, cut
    key = lambda r: ("=" + r[2] if r[2] is not None else "-")
    digest = lambda r: hashlib.md5(("11/" + (f"={r[0]}" if r[0] is not None else "-" + (r[1] or ""))).encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append((digest(r), -1 if r[0] is None else r[0], zlib.crc32(text(r[1]))))
    order = sorted(((2 * k + 1) / (2 * len(g)), name, *x) for name, g in groups.items() for k, x in enumerate(sorted(g)))
    want = Counter((None if x[3] < 0 else x[3], x[4], at * shards // len(order)) for at, x in enumerate(order))
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in found) == want
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, sharding.shard_documents(df.repartition(2), shards=shards).collect()), key=str)


def test_shards_of_an_empty_table_and_files(spark, tmp_path):
    df = spark.createDataFrame(documents(), DOCS)
    assert sharding.shard_documents(df.limit(0)).count() == 0
    back = sharding.write_shards(df, str(tmp_path / "shards"))
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={k}" for k in range(8)]
    assert Counter(map(tuple, back.select("row.*").collect())) == Counter(map(tuple, df.collect()))
    assert back.select("shard", "slot").distinct().count() == df.count()


def conversations(hot=0):
    rng = random.Random(5)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "né", "", None, "so"]))
    rows = []
    for c in [0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 101, 102, 10**12, -3, -10]:
        first = [("system", "same"), ("user", "go")] if c % 2 else []
        turns = first + [say() for _ in range(rng.randint(0 if first else 1, 9))]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, *t) for k, t in enumerate(turns)]
    rows += [(20, k, "user", f"t{k % 7}") for k in range(hot)] + [(21, k, "user", f"t{k % 7}") for k in range(hot - 1)] + [(22, 0, "user", "t0")] * min(hot, 3)
    rows += [(None, 1, "user", "lost")] + [(c, 0, "user", "copy") for c in range(30, 60)]
    return [(*r, "x", 1, 2) for r in rows]


def brute_trie(rebuilt):
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[k] for k in kids[path])
    ends = lambda p: ",".join(str(c) for c in sorted(nodes[p]) if len(rebuilt[c]) == len(p))
    return Counter(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in nodes.items()
    )


def ordered(rows):
    held = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, (role or "", text or "")))
    return {c: [t[2] for t in sorted(x, key=lambda t: t[:2])] for c, x in held.items()}


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("hot, sizes", [(0, (16, 1024, 1024)), (70, (16, 1024, 1024)), (70, (3, 8, 4))])
def test_trie_equals_brute_force(spark, hot, sizes):
    rows = conversations(hot)
    own = ordered(rows)
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, TURNS).repartition(4))
    whole = prefix_trie.prefix_trie(prefix_trie.whole_conversations(turns), *sizes)
    assert Counter(map(tuple, whole.select(OUT).collect())) == brute_trie(own)
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    shared = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns), *sizes)
    assert any(not t for t in rebuilt.values())
    assert Counter(map(tuple, shared.select(OUT).collect())) == brute_trie(rebuilt)


def test_trie_of_an_empty_table_and_texts_of_nodes(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    empty = prefix_trie.numbered_turns(df.limit(0))
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(empty)).count() == 0
    nodes = prefix_trie.prefix_trie(prefix_trie.whole_conversations(prefix_trie.numbered_turns(df)))
    own = ordered(conversations())
    for r in prefix_trie.node_texts(nodes, df).collect():
        assert (r.role, r.text) == (own[r.conv_id][r.depth - 1] if r.depth else (None, None))


@pytest.mark.parametrize("name", ["op11_mine_hard_negatives", "op12_shard_documents", "op13_conversation_trie"])
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = queries.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(columns).collect())) == Counter(want.fetchall())
