"""Packing by the configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.llm import encoders
from depsift.plans.lineage import cut

Pattern = tuple[tuple[int, int], ...]  # (length, copies) of one sequence


@dataclass
class Cover:
    """A fractional cover of a histogram: how much each configuration is used, its value, and what proves how good it is.

    `prices` are a dual solution: no configuration's lengths cost more than 1 together, so no cover is worth less than
    `bound`, the price of all pieces.
    """

    amounts: dict[Pattern, float]
    value: float
    prices: dict[int, float]
    bound: float


def _tables(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of the best multiset of lengths within each capacity, and the place of the length that it ends with (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = best[c - lengths[: ends[c]]] + values[: ends[c]]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], last[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    return best, last


def _walk(best: np.ndarray, last: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """Places of the lengths of the best multiset within a capacity."""
    chosen, c = Counter(), capacity
    while c > 0:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
        else:
            chosen[int(last[c])] += 1
            c -= int(lengths[last[c]])
    return chosen


def configuration_lp(
    histogram: dict[int, int], capacity: int, rate: float = 1.0, step: float = 0.25, favour: float = 0.5, near: float = 0.01, rounds: int = 400,
) -> Cover:
    """The configuration linear program, solved by multiplicative weights with knapsack pricing: a fractional cover and a dual bound.

    Each length has a weight that falls exponentially with the share of its pieces already covered, times its size, a little more for long
    ones. A round prices configurations by one dynamic program: for each length the dearest one with it, of which those within `near` of the dearest
    of all are used, as much as a `step` of the pieces of their lengths and what is left of them allow. All lengths are
    used up together, so configurations stay full. Divided by the dearest configuration's price, a round's weights are a dual
    solution; the best of all rounds, and of the sizes alone, is returned. What `rounds` leave is covered by sequences of one length. The
    work hangs on the capacity alone, as there are at most `capacity` lengths.
    """
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths], dtype=float)
    left, amounts = counts.copy(), Counter()
    worth = lengths * (1 + favour * lengths / capacity)
    prices = lengths / (capacity if len(lengths) else 1)
    for _ in range(rounds):
        live = np.flatnonzero(left > 1e-9)
        if not len(live):
            break
        sizes, weights = lengths[live], worth[live] * np.exp(rate * (left[live] / counts[live] - 1))
        best, last = _tables(sizes, weights, capacity)
        if counts[live] @ weights / best[capacity] > counts @ prices:
            prices = np.zeros(len(lengths))
            prices[live] = weights / best[capacity]
        room = np.minimum(step * counts[live], left[live])
        through = weights + best[capacity - sizes]
        for i in np.argsort(-through):
            if through[i] < (1 - near) * best[capacity]:
                break
            if room[i] <= 1e-12:
                continue
            config = _walk(best, last, sizes, capacity - int(sizes[i]))
            config[int(i)] += 1
            at, copies = np.array(list(config)), np.array(list(config.values()), dtype=float)
            amount = float((room[at] / copies).min())
            if amount > 1e-12:
                room[at] -= amount * copies
                left[live[at]] -= amount * copies
                amounts[tuple(sorted(((int(sizes[k]), c) for k, c in config.items()), reverse=True))] += amount
    for n, rest in zip(lengths.tolist(), left.tolist()):
        if rest > 1e-9:
            amounts[((n, capacity // n),)] += rest / (capacity // n)
    return Cover(dict(amounts), sum(amounts.values()), dict(zip(lengths.tolist(), prices.tolist())), float(counts @ prices))


def _whole_steps(
    histogram: dict[int, int], capacity: int, rate: float = 1.0, step: float = 0.25, favour: float = 0.5, fill: float = 0.98,
) -> list[tuple[Pattern, int]]:
    """Rounding of what a cover leaves: multiplicative weights as in `configuration_lp`, in steps of whole sequences.

    A round takes the dearest configuration as often as a `step` of the pieces of its lengths allows. A length with fewer pieces left than a
    configuration asks for is left out from then on. Rounds end when no configuration fills `fill` of the capacity.
    """
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths], dtype=float)
    left, open_, out = counts.copy(), np.ones(len(lengths), bool), []
    steps = np.maximum(1, np.floor(step * counts))
    worth = lengths * (1 + favour * lengths / capacity)
    while open_.any():
        live = np.flatnonzero(open_)
        sizes = lengths[live]
        config = _walk(*_tables(sizes, worth[live] * np.exp(rate * (left[live] / counts[live] - 1)), capacity), sizes, capacity)
        if sum(int(sizes[k]) * c for k, c in config.items()) < fill * capacity:
            break
        at, copies = live[list(config)], np.array(list(config.values()), dtype=float)
        if (left[at] < copies).any():
            open_[at[left[at] < copies]] = False
            continue
        amount = int(max(1, min(np.minimum(steps[at], left[at]) // copies)))
        left[at] -= amount * copies
        open_[at] &= left[at] > 0
        out.append((tuple(sorted(((int(lengths[k]), int(c)) for k, c in zip(at, copies)), reverse=True)), amount))
    return out


def _fullest(left: dict[int, int], lengths: list[int], room: int) -> Pattern:
    """Lengths of `left` that fill `room` best, by dynamic programming over the sums that can be reached.

    Sums are bits of one integer; a length counts as often as it is left. Of equally full ones that with the longest
    lengths is taken. `lengths` has those of `left`, longest first.
    """
    if not room:
        return ()
    reached, steps, goal = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(left[n], room // n)):  # a length stops where its next copy reaches no new sum
            grown = reached | (reached << n) & goal
            if grown == reached:
                break
            steps.append((n, reached))
            reached = grown
        if reached >> room & 1:
            break
    at, taken = reached.bit_length() - 1, Counter()
    for n, before in reversed(steps):
        if not before >> at & 1:
            at -= n
            taken[n] += 1
    return tuple(sorted(taken.items(), reverse=True))


def rounded(histogram: dict[int, int], capacity: int, cover: dict[Pattern, float], fill: float = 0.98) -> Counter:
    """A cover in whole sequences: configurations that fill `fill` of the capacity as often as their amounts hold whole ones, fullest first;
    of what is left whole steps, and then one configuration for the longest piece at a time, the fullest, as often as it fits."""
    left, plan = dict(histogram), Counter()

    def use(pattern: Pattern, many: int) -> None:
        plan[pattern] += many
        for n, copies in pattern:
            left[n] -= copies * many
            if not left[n]:
                del left[n]

    size = {p: sum(n * c for n, c in p) for p in cover}
    for pattern in sorted(cover, key=lambda p: (-size[p], -cover[p], p)):
        if size[pattern] >= fill * capacity:
            many = min(int(cover[pattern] + 1e-9), *(left.get(n, 0) // c for n, c in pattern))
            if many:
                use(pattern, many)
    for pattern, many in _whole_steps(left, capacity) if left else ():
        use(pattern, many)
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        more = Counter(dict(_fullest(left, lengths, capacity - first)))
        left[first] += 1
        more[first] += 1
        use(tuple(sorted(more.items(), reverse=True)), min(left[n] // c for n, c in more.items()))
    return plan


def plan_sequences(histogram: dict[int, int], capacity: int) -> Counter:
    """Patterns and how many sequences use each; covers the histogram exactly.

    The linear program's cover is rounded twice, once from its whole amounts and once by whole steps from the start, which keeps
    more of its fullness where lengths have a piece or two; the rounding with fewer sequences is taken.
    """
    fixed = Counter({((n, 1),): k for n, k in histogram.items() if n == capacity})
    rest = {n: k for n, k in histogram.items() if n < capacity and k > 0}
    if not rest:
        return fixed
    plans = [rounded(rest, capacity, cover) for cover in (configuration_lp(rest, capacity).amounts, {})]
    return fixed + min(plans, key=lambda p: p.total())


def slot_table(plan: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies a sequence, first sequence, first offset) of each run of slots."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, many in sorted(plan.items(), reverse=True):
        offset = 0
        for n, copies in pattern:
            rows.append((n, ranks[n], ranks[n] + copies * many, copies, sequence, offset))
            ranks[n] += copies * many
            offset += n * copies
        sequence += many
    return rows


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenize every document and cut the long ones: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoders.byte_bpe(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = np.array(ids_of(text.as_py() or "") + [end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1  # only the first piece may be shorter
                starts = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(rows, (key.as_py(), i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            types = (batch.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack_sequences(
    docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer
    than the capacity are cut into full pieces, the first one taking the remainder. The driver sees only the
    length histogram (at most `capacity` rows), solves the linear program over it and rounds, in time that hangs on the capacity alone; pieces are then matched to
    slots by their rank within a length, which is counted per (length, bucket), with the number of buckets in
    proportion to the pieces, so that no length is numbered in one task. The slot table is bounded by the
    capacity as well, and broadcast.

    Null and empty texts are one end token. Repeated rows are packed once each. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, path or encoders.default_path("byte_bpe_50k.json"), capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        slot_table(plan_sequences(histogram, capacity)), "length long, low long, high long, copies long, base long, at long"
    )
    buckets = max(16, sum(histogram.values()) // 50_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    run = W.partitionBy("length").orderBy("bucket")
    counts = counts.select("length", "bucket", (F.sum("n").over(run) - F.col("n")).alias("before"))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(inside)).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1)
    fits = (ranked.length == slots.length) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", ranked.length.alias("length"), "ids_crc32",
        (F.col("base") + F.floor(turn / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + turn % F.col("copies") * ranked.length).alias("offset"),
    )
