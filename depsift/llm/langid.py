"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.plans.lineage import cut

UNDETERMINED = "und"
#: Letters stay (all non-ASCII bytes count as such), the rest becomes the word boundary.
_BOUNDARY = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def subwords(text: str, slots: int) -> np.ndarray:
    """Slots of the text's byte trigrams and fourgrams, word boundaries included."""
    raw = b" " + b" ".join(text.lower().encode().translate(_BOUNDARY).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    three = three[b[1:-1] != 32]
    out = [three * np.uint32(0x9E3779B1) >> 8]
    if len(b) > 3:
        four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        four = four[(b[1:-2] != 32) & (b[2:-1] != 32)]
        out.append(four * np.uint32(0x85EBCA6B) >> 9)
    return (np.concatenate(out) % np.uint32(slots)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """`table` holds each slot's embedding times the softmax weights, so that a text needs one sum."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected)."""
        if text is None or not any(map(str.isalpha, text)) or not self.languages:
            return UNDETERMINED, 0.0, True
        slots = subwords(text, len(self.table))
        mean = self.table[slots].sum(axis=0, dtype=np.float64) / max(1, len(slots))
        p = _softmax((mean + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], slots: int, width: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> LanguageModel:
    """Train on (language, slots, counts) rows by stochastic gradient descent, one text a step.

    Every fifth text is held back: on these the temperature is chosen by likelihood, and the rejection
    threshold as the score that one in a thousand correctly labelled texts falls below, at most one half.
    """
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return LanguageModel((), np.zeros((1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    y = np.array([languages.index(r[0]) for r in rows])
    mean = [(r[1], r[2] / max(1.0, r[2].sum())) for r in rows]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / width, (slots, width))
    weights, bias = rng.normal(0, 1 / np.sqrt(width), (width, len(languages))), np.zeros(len(languages))
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            at, share = mean[i]
            hidden = share @ embed[at]
            error = _softmax((hidden @ weights + bias)[None])[0]
            error[y[i]] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
            embed[at] -= step * 20 * np.outer(share, back)  # shares are small, so their step is larger
    table = embed @ weights
    check = np.flatnonzero(held) if held.any() else train
    logits = np.array([mean[i][1] @ table[mean[i][0]] + bias for i in check])
    grid = np.geomspace(0.25, 8, 21)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.argmax(axis=1) == y[check]
    threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], 0.001)) if right.any() else 0.0)
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold * 0.9)


def held_out(id_col: str | Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = 3000, slots: int = 1 << 15, max_numbers: int = 20_000_000) -> LanguageModel:
    """Fit on at most `max_rows` labelled rows with `max_numbers` features, those with the least hash of their id.

    Both bounds are documented parameters; a feature is two 32-bit numbers, so 160 MB at most reach the driver.
    Rows of one hash follow by language and features, and equal ones count once. Held-out rows, rows without text, letters or lang are no
    training rows; an empty table gives a model that rejects everything.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    hashes = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(order.alias("h")).orderBy("h").limit(max_rows)
    top = hashes.agg(F.max("h")).first()[0]
    if top is None:
        return fit([], slots)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.unique(subwords(t.as_py(), slots), return_counts=True) for t in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array([p[0].astype("<i4").tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype("<i4").tobytes() for p in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "lang", "slots", "counts"])

    chosen = usable.where(order <= top).select(order.alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = cut(chosen.mapInArrow(features, "h long, lang string, slots binary, counts binary").withColumn("key", F.struct("h", "lang", F.xxhash64("slots", "counts").alias("x"))).dropDuplicates(["key"]))
    sizes = found.select("key", (F.length("slots") / 4).cast("long").alias("n")).orderBy("key").limit(max_rows).collect()
    fits = np.searchsorted(np.cumsum([r["n"] for r in sizes]), max_numbers, side="right")
    if not fits:
        return fit([], slots)
    rows = found.where(F.col("key") <= F.struct(*map(F.lit, sizes[fits - 1]["key"]))).select("h", "lang", "slots", "counts").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"], bytes(r["slots"])))
    return fit([(r["lang"], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(float)) for r in rows], slots)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Whole texts are read. Null texts and texts without a letter are `und` with score 0 and rejected; so is
    everything if there was nothing to learn from. Other texts get a learned language, and `rejected` says
    that the calibrated score is under the threshold. Repeated rows are predicted each; an empty table gives
    an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, whose text the model does not reject."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
