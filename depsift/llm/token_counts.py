"""Exact token counts at every prefix."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm import encoders

SPACE = "▁"
#: Segments and pairs of pieces that are remembered at a time in one worker, and the longest such segment.
REMEMBERED, LONG = 200_000, 60


class PrefixTable:
    """Exact token counts of a text's prefixes: the counts at the segments' ends, and inside each segment."""

    def __init__(self, parts: list[list[int] | bytes], shift: int):
        self.parts, self.shift = parts, shift
        self.ends = [n - shift for n in accumulate(map(len, parts))]
        self.totals = list(accumulate(p[-1] for p in parts))

    @property
    def total(self) -> int:
        return self.totals[-1] if self.totals else 0

    def _before(self, i: int) -> tuple[int, int]:
        return (self.totals[i - 1], self.ends[i - 1]) if i else (0, -self.shift)

    def at(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        if chars <= 0:
            return 0
        i = bisect_right(self.ends, chars)
        before, start = self._before(i)
        return before if i == len(self.ends) or start == chars else before + self.parts[i][chars - start - 1]

    def counts(self) -> np.ndarray:
        """Tokens of the prefixes of 1, 2, ... characters."""
        sizes = list(map(len, self.parts))
        inner = np.fromiter((n for p in self.parts for n in p), np.int64, sum(sizes))
        return (inner + np.repeat(np.array([0, *self.totals[:-1]][: len(sizes)], np.int64), sizes))[self.shift :]

    def fit(self, budget: int) -> int:
        """The longest prefix, in characters, that has at most `budget` tokens."""
        i = bisect_right(self.totals, budget)
        if i == len(self.ends):
            return max(0, self.ends[-1]) if self.ends else 0
        before, start = self._before(i)
        inner = [k + 1 for k, n in enumerate(self.parts[i]) if before + n <= budget]
        return max(0, start + max(inner, default=0))


class PrefixCounter:
    """Prefix tables of texts under a sentencepiece BPE model, by dynamic programming.

    No piece joins a word to the space after it, so a text's tokens are those of its segments, a segment being a run of
    spaces and the word behind it. In a segment, the tokens of a prefix are those of a shorter prefix and one last
    piece: the piece that stays apart from the shorter prefix's own last one when the two are encoded together. So each
    prefix is settled by those before it, and the count at the text's end is the last entry of its table; nothing is
    encoded but pairs of pieces, each once. Only pieces that text can have are tried: control, unknown, unused and byte
    pieces stand for no text, and a character without a piece is one token for each byte. Models whose pieces,
    normalizer or spaces do not allow this are refused by `supported`.
    """

    def __init__(self, path: str):
        self.model = m = encoders.pieces(path)
        barred = (m.is_control, m.is_unknown, m.is_unused, m.is_byte)
        self.ids = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not any(f(i) for f in barred)}
        self.names = {i: p for p, i in self.ids.items()}
        self.found = ahocorasick.Automaton()  # tells the pieces that end at each character, the longest first
        for piece, i in self.ids.items():
            self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.lead = m.encode("a", out_type=str)[0].startswith(SPACE)
        self.supported = self._supported()

    def _supported(self) -> bool:
        m = self.model
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        same = all(m.decode(m.encode(t)) == t for t in ("a b", "a  b ", "ﬁ　½ é"))
        return apart and same and len(m.encode("a ")) == len(m.encode("a")) + 1

    def segments(self, text: str) -> list[str]:
        """The text as the model sees it, with its leading space, cut before each run of spaces."""
        seen = (SPACE if self.lead else "") + text.replace(" ", SPACE) if text else ""
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", seen)

    def _pieces(self, segment: str) -> list[int]:
        """Ids of a segment; the model puts a space in front of what it encodes, which is taken off here."""
        if not self.lead:
            return self.model.encode(segment)
        if segment.startswith(SPACE):
            return self.model.encode(segment[1:].replace(SPACE, " ")) if segment != SPACE else [self.model.piece_to_id(SPACE)]
        return self.model.encode("\n" + segment)[self._newline :]

    @functools.cached_property
    def _newline(self) -> int:
        return len(self.model.encode("\n"))

    def inside(self, segment: str) -> list[int]:
        """Token counts of the segment's prefixes of 1, 2, ... characters."""
        pairs, n = self.pairs, len(segment)
        count, last, done = [0] * (n + 1), [-1] * (n + 1), 0
        for end, (size, piece) in self.found.iter(segment):
            end += 1
            if end <= done:
                continue
            start = end - size
            while done < end - 1:
                done += 1
                self._bytes(segment, done, count)
            left = last[start]
            if left >= 0:
                apart = pairs.get(left << 32 | piece)
                if not (self._apart(left, piece) if apart is None else apart):
                    continue
            count[end] = count[start] + 1
            last[end] = piece
            done = end
        while done < n:
            done += 1
            self._bytes(segment, done, count)
        return count[1:]

    @staticmethod
    def _bytes(segment: str, end: int, count: list[int]) -> None:
        """A character without a piece: one token for each byte, joined to nothing."""
        count[end] = count[end - 1] + len(segment[end - 1].encode())

    def _apart(self, left: int, right: int) -> bool:
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        both = self._pieces(self.names[left] + self.names[right])
        self.pairs[left << 32 | right] = both == [left, right]
        return both == [left, right]

    def table(self, text: str) -> PrefixTable:
        segments = self.segments(text)
        if len(self.known) > REMEMBERED:  # segments met since the last time stay for another
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        parts: list[list[int] | bytes] = []
        for s in segments:
            inner = known.get(s)
            if inner is None:
                inner = before.get(s) or self.inside(s)
                if len(s) <= LONG:  # four tokens a character at most, so counts fit in bytes
                    known[s] = inner = bytes(inner)
            parts.append(inner)
        return PrefixTable(parts, len(SPACE) if self.lead and text else 0)


@functools.lru_cache(maxsize=1)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter a worker, so that what it has met serves its later tasks too."""
    return PrefixCounter(path)


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    `n_tokens` is the last entry of the text's prefix table and `fit_chars` the length of its longest prefix
    within `limit` tokens, read off the table without encoding again. Models that `PrefixCounter` cannot
    serve are counted by encoding, with null `fit_chars`.

    Texts of any length are counted whole. Null and empty texts have 0 bytes and tokens. Special strings inside texts are ordinary text, as is the
    library's default. Repeated rows are counted each; an empty table gives an empty result; other columns
    are ignored.
    """
    path = path or encoders.default_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            tokens, fits, sizes = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                if counter.supported:
                    table = counter.table(text)
                    tokens.append(table.total)
                    fits.append(table.fit(limit))
                else:
                    tokens.append(len(counter.model.encode(text)))
                    fits.append(None)
            over = pa.array([n > limit for n in tokens], pa.bool_())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), over, pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )
