"""Removal of byte strings that repeat across documents, found by sampled fingerprints and compared byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bytes that are hashed at a sampled position.
GRAM = 16
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes of the array's differences, lowest bytes of all first: small steps leave planes of zeros."""
    steps = np.diff(a, prepend=a.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)


def _unplane(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


class Block:
    """The documents of one block in order of (doc_id, text), and their bytes one behind the other."""

    def __init__(self, payloads: list[bytes]):
        rows: list[tuple[int, bytes]] = []
        for p in payloads:
            raw = _expand(p)
            n = int.from_bytes(raw[:8], "little")
            ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
            ends = 8 + 16 * n + np.cumsum(sizes)
            rows += [(int(i), raw[e - s : e]) for i, s, e in zip(ids, sizes.tolist(), ends.tolist())]
        rows.sort()
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about CHUNK bytes."""
        at = 0
        while at < len(self.texts):
            end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + CHUNK, side="right")))
            yield at, end
            at = end


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, doubling their length from one byte."""
    h = b.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i : i + width]) for every i with a whole window, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(b: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the sampled suffixes of documents lying one behind the other in b.

    In each string of `length` bytes within a document, those positions are sampled whose GRAM-byte hash is
    the least of the string: what is sampled hangs on the string alone, so equal strings sample alike.
    """
    width = length - GRAM + 1
    if len(b) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(b) | np.uint64(1)
    least = _sliding(h, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int32)
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, np.minimum(ends[long_] - length + 1, len(least)), -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, np.maximum)[: len(h)]
    at = np.flatnonzero(most == h)
    return at, h[at]


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k + 1] > cuts[k]:
            yield k, order[cuts[k] : cuts[k + 1]]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes over it also starts in a document with a smaller doc_id;
    strings are those of the input and never cross documents. This is not prefix doubling, which the README says why:
    of each string one position is sampled (see `anchors`) and given the hash of its GRAM bytes; positions whose hash no
    other document has are dropped (a block hashes its positions again then, instead of sending them), and of what is left the bytes around it up to
    `length` on both sides are compared. Hashes move in one exchange of packed arrays, dealt by hash; whatever is
    removed was compared byte by byte.

    Work is dealt by document block and by rank; the numbers of both grow with the input, and a block must be smaller
    than 4 GiB. A block sends each rank once and each surrounding once, so that what a task gets of a passage grows with
    the number of blocks and not with its copies. Null text counts as
    empty. Ids must be integers, other types are refused with a ValueError. Rows with a null doc_id are compared with nothing and keep all bytes. Rows repeated with one doc_id
    are each judged against smaller ids only. Documents shorter than `length` lose nothing. An empty table
    gives an empty result; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    blocks = blocks or 2 * buckets
    span = length - GRAM
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: dict[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
            keys, out = [], []
            for k, docs_ in held.items():
                sizes = np.array([len(t) for _, t in docs_], "<i8")
                head = np.array([len(docs_), *[i for i, _ in docs_]], "<i8").tobytes() + sizes.tobytes()
                keys.append(k)
                out.append(zstandard.ZstdCompressor(level=3).compress(head + b"".join(t for _, t in docs_)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["block", "payload"])

        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0
        for batch in batches:
            for key, block, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                held.setdefault(block.as_py(), []).append((key.as_py(), raw))
                size += len(raw)
                if size > 48 << 20:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    def ranked(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, document, hash) of the sampled positions of a block."""
        at, hashes, owner = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for a, z in block.chunks():
            low = int(block.starts[a])
            p, h = anchors(block.bytes[low : int(block.ends[z - 1])], block.ends[a:z] - low, block.starts[a:z] - low, length)
            at.append(p + low)
            hashes.append(h)
            owner.append(np.searchsorted(block.ends, p + low, side="right"))
        return np.concatenate(at), np.concatenate(owner), np.concatenate(hashes)

    low40 = np.uint64((1 << 40) - 1)
    bucket_of = lambda h: (h >> np.uint64(40)) % np.uint64(buckets)

    def sample(table: pa.Table) -> pa.Table:
        """The distinct ranks of a block, dealt by rank, each with whether two of the block's documents have it."""
        keys, out = [], []
        _, o, h = ranked(Block(table.column("payload").to_pylist()))
        if len(h):
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start)
            h = h[start]
            for k, rows in _by_bucket(bucket_of(h), buckets):
                rank = np.sort(h[rows] & low40)
                keys.append(k)
                order = np.argsort(h[rows] & low40, kind="stable")
                out.append(_squeeze(np.array([len(rows)], "<u4"), _planes(rank), many[rows][order]))
        name = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array(keys, pa.int64()), "block": pa.array([name] * len(keys), pa.int64()), "payload": pa.array(out, pa.binary())})

    def repeats(table: pa.Table) -> pa.Table:
        """Ranks that two documents or more have, back to the blocks that hold them."""
        rank, many, block = [], [], []
        for name, blob in zip(table.column("block").to_pylist(), table.column("payload").to_pylist()):
            raw = _expand(blob)
            n = int.from_bytes(raw[:4], "little")
            rank.append(_unplane(raw[4 : 4 + 8 * n], "<u8"))
            many.append(np.frombuffer(raw, bool, n, 4 + 8 * n))
            block.append(np.full(n, name, np.int64))
        rank, many, block = (np.concatenate(x) for x in (rank, many, block))
        order = np.argsort(rank, kind="stable")
        start = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
        size = np.diff(np.r_[start, len(order)])
        shared = (size > 1) | np.maximum.reduceat(many[order], start)
        keep = order[np.repeat(shared, size)]
        keep = keep[np.lexsort((rank[keep], block[keep]))]
        keys, out = [], []
        bucket = table.column("bucket")[0].as_py()
        edges = np.flatnonzero(np.r_[True, block[keep][1:] != block[keep][:-1]]) if len(keep) else []
        for a, z in zip(edges, [*edges[1:], len(keep)]):
            keys.append(int(block[keep[a]]))
            out.append(_squeeze(np.array([bucket], "<u8"), _planes(rank[keep[a:z]])))
        return pa.table({"block": pa.array(keys, pa.int64()), "payload": pa.array(out, pa.binary())})

    wide = length + span  # bytes around a sampled position that its strings can reach

    def around(texts: pa.Table, found: pa.Table) -> pa.Table:
        """For each shared position, the bytes that its strings can reach, dealt by rank; equal ones of a block once.

        Of positions with equal bytes that of the smallest document stands for the others, so a passage sends one view
        a block however often it stands there, and positions, without bytes, for the rest.
        """
        keys, out = [], []
        if texts.num_rows and found.num_rows:
            block = Block(texts.column("payload").to_pylist())
            kept = []
            for blob in found.column("payload").to_pylist():
                raw = _expand(blob)
                kept.append(np.frombuffer(raw, "<u8", 1)[0] << np.uint64(40) | _unplane(raw[8:], "<u8"))
            at, _, h = ranked(block)
            rank = bucket_of(h) << np.uint64(40) | h & low40
            at = at[np.isin(rank, np.concatenate(kept))]
            owner = np.searchsorted(block.ends, at, side="right")
            left = np.minimum(at - block.starts[owner], span).astype(np.uint8)
            right = np.minimum(block.ends[owner] - at - GRAM, span).astype(np.uint8)
            padded = np.concatenate([np.zeros(span, np.uint8), block.bytes, np.zeros(span, np.uint8)])
            gram = np.lib.stride_tricks.sliding_window_view(block.bytes, GRAM)
            rank = np.zeros(len(at), np.uint64)
            for i in range(GRAM):
                rank = rank * np.uint64(0x9E3779B97F4A7C15) + gram[at, i] + np.uint64(1)
                rank ^= rank >> np.uint64(32)
            views = np.lib.stride_tricks.sliding_window_view(padded, wide)
            ids = block.ids[owner]
            for k, rows in _by_bucket((rank >> np.uint64(16)) % np.uint64(buckets), buckets):
                around_ = np.concatenate([views[at[rows]], left[rows, None], right[rows, None]], axis=1)
                column = np.arange(wide)[None]
                around_[:, :wide][(column < span - left[rows, None]) | (column >= span + GRAM + right[rows, None])] = 0
                # rows come in order of ids, so the first of equal views is of the smallest document
                _, first, stands = np.unique(np.ascontiguousarray(around_).view(np.dtype((np.void, wide + 2))).ravel(), return_index=True, return_inverse=True)
                other = np.setdiff1d(np.arange(len(rows)), first, assume_unique=True)
                later = ids[rows[other]] > ids[rows[first[stands[other]]]]
                heads = rows[first]
                keys.append(k)
                sizes = np.array([len(first), len(other)], "<u4")
                own = (around_[first, :wide], left[heads], right[heads], _planes(at[heads].astype(np.uint32)), _planes(ids[heads]))
                rest = (_planes(at[rows[other]].astype(np.uint32)), _planes(stands[other].astype(np.uint32)), later)
                out.append(_squeeze(sizes, *own, *rest))
        name = texts.column("block")[0].as_py() if texts.num_rows else 0
        return pa.table({"bucket": pa.array(keys, pa.int64()), "block": pa.array([name] * len(keys), pa.int64()), "payload": pa.array(out, pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        """Which strings over each position also start in a smaller document; a bit for each offset."""
        views, left, right, at, ids, block, rest, have = [], [], [], [], [], [], [], 0
        for name, blob in zip(table.column("block").to_pylist(), table.column("payload").to_pylist()):
            raw = _expand(blob)
            n, m = np.frombuffer(raw, "<u4", 2).tolist()
            p = 8 + n * wide
            views.append(np.frombuffer(raw, np.uint8, n * wide, 8).reshape(n, wide))
            left.append(np.frombuffer(raw, np.uint8, n, p))
            right.append(np.frombuffer(raw, np.uint8, n, p + n))
            at.append(_unplane(raw[p + 2 * n : p + 6 * n], "<u4"))
            ids.append(_unplane(raw[p + 6 * n : p + 14 * n], "<i8"))
            block.append(np.full(n, name, np.int64))
            p += 14 * n
            rest.append((_unplane(raw[p : p + 4 * m], "<u4"), _unplane(raw[p + 4 * m : p + 8 * m], "<u4").astype(np.int64) + have, np.frombuffer(raw, bool, m, p + 8 * m), np.full(m, name, np.int64)))
            have += n
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")  # so that the first of equal strings has the smallest doc_id
        views, left, right, at, block = (np.concatenate(x) for x in (views, left, right, at, block))
        mask = np.empty(len(ids), np.uint64)
        mask[order] = first_starts(views[order], left[order], right[order], ids[order], span, length)
        every = np.zeros(len(ids), np.uint64)  # all strings that fit a view: those of a later document with the same view
        for x in range(span + 1):
            every[(left >= x) & (right >= span - x)] |= np.uint64(1 << x)
        more, stands, later, where = (np.concatenate(x) for x in zip(*rest))
        at, block = np.r_[at, more], np.r_[block, where]
        mask = np.r_[mask, np.where(later, every[stands], mask[stands])]
        keys, out = [], []
        hit = np.flatnonzero(mask)
        hit = hit[np.lexsort((at[hit], block[hit]))]
        edges = np.flatnonzero(np.r_[True, block[hit][1:] != block[hit][:-1]]) if len(hit) else []
        for a, z in zip(edges, [*edges[1:], len(hit)]):
            rows = hit[a:z]
            keys.append(int(block[rows[0]]))
            out.append(_squeeze(np.array([z - a], "<u4"), _planes(at[rows]), _planes(mask[rows])))
        return pa.table({"block": pa.array(keys, pa.int64()), "payload": pa.array(out, pa.binary())})

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(texts.column("payload").to_pylist() if texts.num_rows else [])
        begins = np.zeros(len(block.bytes) + 1, np.int32)
        for blob in found.column("payload").to_pylist() if texts.num_rows else []:
            raw = _expand(blob)
            n = int.from_bytes(raw[:4], "little")
            at, mask = _unplane(raw[4 : 4 + 4 * n], "<u4").astype(np.int64), _unplane(raw[4 + 4 * n :], "<u8")
            for x in range(span + 1):
                begins[at[(mask >> np.uint64(x)) & np.uint64(1) == 1] - x] = 1
        upto = np.cumsum(begins, dtype=np.int32)
        covered = upto[: len(block.bytes)].copy()
        covered[length:] -= upto[: max(0, len(block.bytes) - length)]
        gone = covered > 0
        removed, spans, digests = [], [], []
        for a, z, text in zip(block.starts.tolist(), block.ends.tolist(), block.texts):
            g = gone[a:z]
            n = int(g.sum())
            removed.append(n)
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0)
            digests.append(hashlib.sha256(block.bytes[a:z][~g].tobytes() if n else text).hexdigest())
        sizes = block.ends - block.starts
        return pa.table({"doc_id": pa.array(block.ids), "n_bytes": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    keyed = base.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "text")
    packed = keyed.mapInArrow(pack, "block long, payload binary")
    by_block = packed.groupBy("block")
    dealt = "bucket long, block long, payload binary"
    back = "block long, payload binary"
    sampled = by_block.applyInArrow(sample, dealt)
    left_over = sampled.groupBy("bucket").applyInArrow(repeats, back)
    views = by_block.cogroup(left_over.groupBy("block")).applyInArrow(around, dealt)
    masks = views.groupBy("bucket").applyInArrow(settle, back)
    kind = docs.schema[id_col].dataType
    out = by_block.cogroup(masks.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = F.encode("text", "UTF-8")
    apart = base.where("doc_id is null").select(
        F.lit(None).cast(kind).alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"),
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(apart)


def first_starts(views: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, span: int, length: int) -> np.ndarray:
    """Bit x of a row: the string that begins x bytes before its position also starts in a smaller document.

    Rows come in order of ids. For each x, rows with such a string are ordered by its hash, and each is
    compared, byte by byte, with the first of its hash; rows that differ from it are ordered by their bytes.
    """
    mask = np.zeros(len(ids), np.uint64)
    rng = np.random.default_rng(3)
    factors = rng.integers(1, 1 << 63, views.shape[1], dtype=np.uint64) | np.uint64(1)
    rolling = np.zeros(len(ids), np.uint64)  # hash of the string at the present offset, moved a byte a step
    for j in range(span, span + length):
        rolling += views[:, j] * factors[j]
    for x in range(span + 1):
        if x:
            rolling += views[:, span - x] * factors[span - x] - views[:, span - x + length] * factors[span - x + length]
        rows = np.flatnonzero((left >= x) & (right >= span - x))
        if not len(rows):
            continue
        a = span - x
        h = rolling[rows]
        order = np.argsort(h, kind="stable")
        rows = rows[order]
        head = np.r_[True, h[order][1:] != h[order][:-1]]
        first = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = np.flatnonzero(ids[rows] > ids[first])
        if not len(later):
            continue
        same = np.ones(len(later), bool)
        for i in range(0, len(later), 1 << 16):
            part = later[i : i + (1 << 16)]
            same[i : i + (1 << 16)] = (views[rows[part], a : a + length] == views[first[part], a : a + length]).all(axis=1)
        mask[rows[later[same]]] |= np.uint64(1 << x)
        if not same.all():  # hashes met: settle these lists by their bytes
            lists = np.isin(h[order], h[order][later[~same]])
            seen: dict[bytes, int] = {}
            for r in np.sort(rows[lists]):
                text = views[r, a : a + length].tobytes()
                if ids[r] > seen.setdefault(text, int(ids[r])):
                    mask[r] |= np.uint64(1 << x)
    return mask
