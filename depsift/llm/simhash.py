"""SimHash near-dedup over a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.runs import sorted_runs
from depsift.operators.components import connected_components
from depsift.plans.lineage import cut
from depsift.plans.skew import sized_join, spread_join

#: Fingerprints of one posting list that are compared in one group; longer lists are compared block by block.
BLOCK = 4096
#: Longest lists that are spanned together with others of their length, and pairs of rows in one such step.
MANY, AT_ONCE = 64, 1 << 20
#: Orders of the bits that an index without a guarantee has.
ORDERS = 15
#: Texts of a bit-linked group on each side of one block of shingle comparisons.
SIDE = 1024


def fingerprint(text: str, shingle: int, bits: int = 64) -> bytes:
    """SimHash over the words of the text, A-Z lower-cased; all zero without words.

    Shingles are hashed by XXH64 with seed 42 for the first 64 bits, 43 for the next, and so on. A bit is set
    if it is set in over half of the hashes.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    out = []
    for seed in range(42, 42 + bits // 64):
        digest = xxhash.xxh64_digest
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, last)]), np.uint8)
        set_ = _bit_sums(hashes.reshape(-1, 8))
        out.append(np.packbits(set_ * 2 > len(last)).tobytes())
    return b"".join(out)


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, 255 rows at a time in single bytes."""
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for i in range(0, len(rows), 16384):
        part = np.unpackbits(rows[i : i + 16384], axis=1)
        pad = -len(part) % 128
        if pad:
            part = np.concatenate([part, np.zeros((pad, part.shape[1]), np.uint8)])
        total += part.reshape(128, -1, part.shape[1]).sum(axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (binary) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py() or "", shingle, bits) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp binary")


def index_positions(size: int, matches: int) -> list[tuple[int, ...]]:
    """Sets of byte positions so that any `matches` of `size` positions hold at least one set.

    For four of eight, twenty sets of three are enough (two positions of one group and one of the next, or
    three of one, over groups of 3, 3 and 2); otherwise all sets of one byte less than the guarantee, at
    most three and at least one.
    """
    if (size, matches) == (8, 4):
        groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
        own = [c for g in groups for c in combinations(g, 3)]
        crossing = [(*c, x) for i, g in enumerate(groups) for c in combinations(g, 2) for x in groups[(i + 1) % 3]]
        return own + crossing
    return list(combinations(range(size), max(1, min(3, matches))))


def arrangements(bits: int, many: int, seed: int = 7) -> list[np.ndarray]:
    """Orders of a fingerprint's bits, the given one first: bytes of another order are other positional bytes."""
    rng = np.random.default_rng(seed)
    return [np.arange(bits), *(rng.permutation(bits) for _ in range(many - 1))]


def _keys(rows: np.ndarray, sets: list[tuple[int, ...]], orders: list[np.ndarray] | None) -> Iterator[np.ndarray]:
    """The keys of fingerprints (row, byte), list by list: the number of an order and set, and the bytes there."""
    bits = np.unpackbits(rows, axis=1) if orders else None
    for k, order in enumerate(orders or [None]):
        own = rows if order is None else np.packbits(bits[:, order], axis=1)
        for n, positions in enumerate(sets, k * len(sets)):
            key = np.full(len(rows), n, np.int64)
            for p in positions:
                key = key << 8 | own[:, p]
            yield key


def postings(prints: DataFrame, sets: list[tuple[int, ...]], orders: list[np.ndarray] | None = None) -> DataFrame:
    """key, fp: a row per fingerprint, order of its bits and set of positions; the key is their number and the bytes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(0).to_pylist()
            keys = list(_keys(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), sets, orders))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fps * len(keys), pa.binary())], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp binary")


def _first_shared(a: np.ndarray, b: np.ndarray, sets: list[tuple[int, ...]], orders: list[np.ndarray] | None) -> np.ndarray:
    """The key of the first list that two fingerprints share, pair by pair; -1 without one."""
    first = np.full(len(a), -1, np.int64)
    for x, y in zip(_keys(a, sets, orders), _keys(b, sets, orders)):
        first = np.where((first < 0) & (x == y), x, first)
    return first


def _linked(a: np.ndarray, b: np.ndarray, matches: int, distance: int) -> np.ndarray:
    """Count filter and verification of row pairs: shared positional bytes first, then differing bits."""
    out = np.zeros(len(a), bool)
    differing = a ^ b
    near = np.flatnonzero((differing == 0).sum(axis=1) >= matches)
    out[near] = np.bitwise_count(differing[near]).sum(axis=1) <= distance
    return out


def _forest(rows: np.ndarray, matches: int, distance: int) -> tuple[list[int], list[int]]:
    """Pairs that span the linked components of one list, each row entering by its first link."""
    left, out_a, out_b = np.arange(len(rows)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = _linked(np.broadcast_to(rows[at], (len(left), rows.shape[1])), rows[left], matches, distance)
            found = left[hit].tolist()
            out_a += [at] * len(found)
            out_b += found
            todo += found
            left = left[~hit]
    return out_a, out_b


def _nearest_forest(rows: np.ndarray, matches: int, distance: int) -> tuple[list[int], list[int]]:
    """As `_forest`, but each row enters by its link of fewest differing bits: a minimum spanning forest.

    Of equal links that to the first row counts, so that lists which share rows span them by the same links.
    """
    wide = np.ascontiguousarray(rows).view(np.uint64)
    least, entry, waiting = np.full(len(rows), distance + 1), np.zeros(len(rows), np.int64), np.arange(1, len(rows))
    at, out_a, out_b = 0, [], []
    while len(waiting):
        bits = np.bitwise_count(wide[waiting] ^ wide[at]).sum(axis=1, dtype=np.int64)
        closer = np.flatnonzero((bits < least[waiting]) | (bits == least[waiting]) & (at < entry[waiting]))
        closer = closer[(rows[waiting[closer]] == rows[at]).sum(axis=1) >= matches]
        least[waiting[closer]], entry[waiting[closer]] = bits[closer], at
        pick = int(least[waiting].argmin())
        at, waiting = int(waiting[pick]), np.delete(waiting, pick)
        if least[at] <= distance:
            out_a.append(int(entry[at]))
            out_b.append(at)
    return out_a, out_b


def _nearest_forests(lists: np.ndarray, matches: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_nearest_forest` of many equally long lists (list, row, byte) at once: the list and the two rows of each link.

    The first row counts of equal links here too.
    """
    n, k, _ = lists.shape
    every, wide = np.arange(n), lists.view(np.uint64)
    bits = np.bitwise_count(wide[:, :, None] ^ wide[:, None]).sum(axis=3, dtype=np.int64)
    bits[(lists[:, :, None] == lists[:, None]).sum(axis=3) < matches] = distance + 1
    least, entry, done = np.full((n, k), distance + 1), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    at, out = np.zeros(n, np.int64), []
    for _ in range(k - 1):
        done[every, at] = True
        closer = (bits[every, at] < least) | (bits[every, at] == least) & (at[:, None] < entry)
        least[closer] = bits[every, at][closer]
        entry = np.where(closer, at[:, None], entry)
        at = np.where(done, distance + 2, least).argmin(axis=1)
        hit = np.flatnonzero(least[every, at] <= distance)
        out.append((hit, entry[hit, at[hit]], at[hit]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole posting lists of a partition sorted by list, several at a time: (list starts, rows, block)."""
    keys, prints, sides = [], [], []

    def joined():
        return np.concatenate(keys), np.concatenate(prints), np.concatenate(sides)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        raw = batch.column(4).to_pylist()
        keys.append(key)
        prints.append(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1))
        sides.append(batch.column(3).to_numpy(zero_copy_only=False))
        if (keys[-1][-1] != keys[0][0]).any():
            k, p, s = joined()
            open_ = int(np.flatnonzero((k == k[-1]).all(axis=1))[0])
            if open_:
                yield k[:open_], p[:open_], s[:open_]
            keys, prints, sides = [k[open_:]], [p[open_:]], [s[open_:]]
    if keys:
        yield joined()


def links(
    prints: DataFrame, distance: int, matches: int, sets: list[tuple[int, ...]], block: int = BLOCK, short: int = 16, nearest: bool = False,
    orders: list[np.ndarray] | None = None,
) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints that span all links found in the posting lists.

    A list of more than `block` fingerprints is dealt into
    blocks by hash, and each pair of blocks is a group of its own, so no task gets a whole hot list and no
    pair is left out. Inside a group, pairs are tallied in arrays; only the links that join two parts of a
    group leave it, fewer than its rows; without `nearest`, lists of `short` rows at most are compared all at
    once and give all their links. `nearest` spans every group by its links of fewest differing bits, for callers
    that verify links by other means afterwards, and a link leaves only the first list, and of a block's own links only the block, that
    both its ends are in: there they are linked already, directly or by links of still earlier lists, so the components stay
    while a large group has a few links for each fingerprint, not one for each of its lists. With `orders`, lists are those of several orders of the bits; what shares a
    list shares the bytes of its set in that order, and `matches` counts bytes of the given one.
    """
    span = _nearest_forest if nearest else _forest
    rows = postings(prints, sets, orders)
    long_ = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long_ = long_.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    rows = rows.join(long_, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, m, own in _lists(batches):
            edges = [], []
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            size = np.diff(np.r_[start, len(key)])
            # short lists all at once: the k-th row of a list against the one s places on
            small = np.repeat(size <= (0 if nearest else short), size)
            ends = np.repeat(start + size, size)
            live = np.flatnonzero(small)
            for s in range(1, short):
                live = live[live + s < ends[live]]
                if not len(live):
                    break
                hit = live[_linked(m[live], m[live + s], matches, distance)]
                edges[0].append(hit)
                edges[1].append(hit + s)
            many = MANY if nearest else short
            for n in np.unique(size[(size > 1) & (size <= many)]) if nearest else ():  # lists of one length all at once
                first = start[size == n]
                for part in np.array_split(first, -(-len(first) * int(n) ** 2 // AT_ONCE)):
                    which, a, b = _nearest_forests(m[part[:, None] + np.arange(n)], matches, distance)
                    edges[0].append(part[which] + a)
                    edges[1].append(part[which] + b)
            for at, n in zip(start[size > many], size[size > many]):
                a, b = span(m[at : at + n], matches, distance)
                edges[0].append(np.array(a, np.int64) + at)
                edges[1].append(np.array(b, np.int64) + at)
            a, b = (np.concatenate(e).astype(np.int64) if e else np.empty(0, np.int64) for e in edges)
            if nearest:
                new = (key[a, 1] == key[a, 2]) | (own[a] != own[b])
                a, b = a[new], b[new]
                new = _first_shared(m[a], m[b], sets, orders) == key[a, 0]
                a, b = a[new], b[new]
            yield pa.RecordBatch.from_arrays([pa.array([m[i].tobytes() for i in x], pa.binary()) for x in (a, b)], names=["src", "dst"])

    # lists come in order of fingerprints, so lists with the same members span them by the same links
    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return dealt.mapInArrow(run, "src binary, dst binary").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, distance: int = 4, bits: int = 64, matches: int | None = None,
    sets: list[tuple[int, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id.

    Fingerprints at `distance` or fewer differing bits are linked; component_id is the smallest doc_id
    reachable by links. d differing bits touch d bytes at most, so linked fingerprints share at least
    `bits / 8 - distance` bytes at their positions: the index holds sets of positions of which any so many
    contain one, each list tallies the shared bytes of its pairs, and pairs with fewer than `matches` (the
    guaranteed number unless given) go before bits are compared. Given `matches` and `sets` below the
    guarantee make the search approximate and are for distances without one.

    Only distinct fingerprints are indexed, so exact copies cost nothing more. Texts of any length are read whole. Null, empty and wordless texts
    have the zero fingerprint and are linked like any other; texts shorter than a shingle are one shingle.
    Keys of three bytes have 24 bits, so posting lists grow with the number of distinct fingerprints (60 entries
    a list at a billion), and comparisons with lists times their length.
    Rows repeated with one doc_id are fingerprinted each. An empty table gives an empty result; other columns
    are ignored.
    """
    matches = max(1, bits // 8 - distance) if matches is None else matches
    sets = index_positions(bits // 8, matches) if sets is None else sets
    prints = cut(fingerprints(docs, shingle, bits, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")))
    labels = connected_components(links(classes, distance, matches, sets))
    classes = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    members = cut(spread_join(classes, roots, ["component"], "fp").select("fp", "component_id", "many"))
    return spread_join(prints, members, ["fp"], "doc_id", size="many").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str, shingle: int) -> bytes:
    """The sorted distinct 32-bit hashes of a text's shingles, packed."""
    import xxhash

    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, parts), np.uint32, len(parts))).tobytes()


def set_digests(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """doc_id, fp, digest: the fingerprint of every row, and a 128-bit hash of its set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            prints = pa.array([fingerprint(t, shingle, bits) for t in texts], pa.binary())
            digests = pa.array([xxhash.xxh3_128_digest(shingle_hashes(t, shingle)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, digests], names=["doc_id", "fp", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp binary, digest binary")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest, shingles: the set of shingles of every row (doc_id, text) and its 128-bit hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_hashes(t.as_py() or "", shingle) for t in batch.column(1)]
            digests = pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, shingles binary")


def cosine(pairs: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of rows (src, dst, a, b) whose shingle sets a and b are similar enough; empty sets are equal.

    Similarity is the cosine of the sets, shared shingles over the geometric mean of their sizes: what SimHash
    estimates by its share of equal bits.
    """
    kind = pairs.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * np.sqrt(len(x) * len(y)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["src", "dst"])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, f"src {kind}, dst {kind}")


def _joins(table: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """Rows of one block, (fragment, loose, shingles) in their order, that join fragments: loose ones against all."""
    names, part = np.unique(table.column("fragment").to_pylist(), return_inverse=True)
    sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root, one = np.arange(len(names)), np.zeros(len(names), np.int64)
    one[part] = np.arange(len(sets))
    out_a, out_b = [], []
    for row in np.flatnonzero(table.column("loose").to_numpy()):
        apart = root[part] != root[part[row]]
        if not apart.any():
            continue
        low, high = np.searchsorted(tokens, sets[row]), np.searchsorted(tokens, sets[row], side="right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = apart & (both >= similarity * np.sqrt(sizes[row] * sizes))
        for other in np.unique(root[part[near]]):
            out_a.append(int(row))
            out_b.append(int(one[other]))
            root[root == other] = root[part[row]]
    return out_a, out_b


def fragment_links(grams: DataFrame, fragments: DataFrame, similarity: float, side: int = SIDE) -> DataFrame:
    """Pairs (src, dst) that join the fragments which verified links have left of each bit-linked group.

    grams has group, doc_id and shingles, fragments has node and component; a doc_id without one is a
    fragment of its own. Every text outside the largest fragment of its group is compared with all texts of
    the other fragments, so afterwards no two fragments of a group hold a similar pair that was not tried. A
    group is dealt into blocks of about `side` texts against `side` texts by hash; only links leave a block.
    """
    kind = grams.schema["doc_id"].dataType.simpleString()
    rows = grams.join(fragments.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = cut(rows.select("group", "doc_id", F.coalesce("component", "doc_id").alias("fragment"), "shingles"))
    parts = rows.groupBy("group", "fragment").agg(F.count("*").alias("n"))
    split = parts.groupBy("group").agg(F.max_by("fragment", F.struct("n", "fragment")).alias("core"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts"))
    pieces = lambda n: F.ceil(n / F.lit(side)).cast("long")
    split = split.where("parts > 1").select("group", "core", pieces(F.col("all")).alias("wide"), pieces(F.col("all") - F.col("most")).alias("high"))
    rows = rows.join(split, "group").withColumn("turn", F.xxhash64("doc_id"))
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    all_ = rows.withColumn("b", F.pmod("turn", "wide")).withColumn("a", F.explode(blocks("high"))).withColumn("loose", F.lit(False))
    loose = rows.where("fragment <> core").withColumn("a", F.pmod("turn", "high")).withColumn("b", F.explode(blocks("wide"))).withColumn("loose", F.lit(True))
    dealt = all_.unionByName(loose).select("group", "a", "b", "loose", "fragment", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_runs(batches, 3):
            a, b = _joins(block, similarity)
            names = block.column("fragment").combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (a, b)], names=["src", "dst"])

    dealt = dealt.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")
    return dealt.mapInArrow(run, f"src {kind}, dst {kind}").distinct()


def near_duplicate_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 128, distance: int = 34, matches: int = 2,
    sets: list[tuple[int, ...]] | None = None, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per doc_id: doc_id, component_id, linked by verified similarity of shingle sets.

    At a similarity of 0.8, fingerprints differ in more bits than the index has bytes, so no number of
    shared bytes is guaranteed. Here fingerprints are wider, and the index has the bytes of `orders` orders of their bits, two
    by two: fingerprints that share two neighbouring bytes in any order meet, others are missed (see the README for what was measured).
    Given `sets` of positions of the given order take their place, with `matches` shared bytes at least. Each posting list is spanned by its closest pairs, the likeliest to be verified.
    Pairs that meet within `distance` bits are then verified: the cosine of their sets of distinct shingles must
    be `similarity` at least, so nothing is grouped on fingerprints alone: texts of one
    fingerprint are one node only if their sets of shingles are equal, and compared otherwise. What is still apart in a group of bit links is compared by shingles as well (see
    `fragment_links`), so the result hangs on these groups and not on which pairs spanned a list. Rows with
    one doc_id count as one document; null ids are left out. Null, empty and wordless texts have an empty set and
    are copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = {"sets": sets, "matches": matches}
    if sets is None:  # what meets in a list shares its two bytes
        index = {"sets": [(p, p + 1) for p in range(0, bits // 8, 2)], "matches": 0, "orders": arrangements(bits, orders)}
    prints = cut(set_digests(base, shingle, bits))
    nodes = cut(prints.groupBy("fp", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")))
    classes = nodes.groupBy("fp").agg(F.min_by("digest", F.struct("first", "digest")).alias("lead"), F.count("*").alias("sets"))
    found = cut(links(nodes.select("fp").distinct(), distance, nearest=True, **index))
    groups = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    needed = cut(nodes.join(classes.hint("merge"), "fp").join(groups.hint("merge"), "fp", "left").where("group is not null or sets > 1").select(
        F.col("first").alias("doc_id"), "fp", "digest", F.coalesce("group", "fp").alias("group"), (F.col("digest") == F.col("lead")).alias("lead")
    ))
    # ids alone are broadcast; of rows that share an id, those of other sets go by their digest
    grams = shingle_sets(sized_join(base, needed.select("doc_id").distinct(), ["doc_id"]), shingle)
    grams = cut(grams.join(needed.hint("merge"), ["doc_id", "digest"]).drop("digest"))
    sides = [grams.where("lead").select(F.col("fp").alias(k), F.col("doc_id").alias(c), F.col("shingles").alias(n)) for k, c, n in (("s", "src", "a"), ("d", "dst", "b"))]
    verified = cut(cosine(found.select(F.col("src").alias("s"), F.col("dst").alias("d")).join(sides[0].hint("merge"), "s").join(sides[1].hint("merge"), "d"), similarity))
    joined = fragment_links(grams.select("group", "doc_id", "shingles"), connected_components(verified), similarity)
    same = spread_join(prints, nodes, ["fp", "digest"], "doc_id", size="many").where("doc_id <> first").select(F.col("doc_id").alias("src"), F.col("first").alias("dst"))
    labels = connected_components(verified.unionByName(joined).unionByName(same))
    ids = prints.select("doc_id").distinct()
    return ids.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
