"""Licence scans: templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that are counted as base matches (fixed values).
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Disclaimers that end the texts of several licences, word by word (fixed values).
_AS_IS = """the software is provided as is [without warranty of any kind] [express or implied] [including but not limited to the warranties of merchantability fitness for a
    particular purpose and noninfringement] [in no event shall the authors or copyright holders be liable for any claim damages or other liability [whether in an action of
    contract tort or otherwise] arising from out of or in connection with the software or the use or other dealings in the software]"""
_BSD_END = """[this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
    fitness for a particular purpose are disclaimed [in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages {40}
    even if advised of the possibility of such damage]]"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution"""
_GPL_END = """[or at your option any later version] [{3} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
    merchantability or fitness for a particular purpose [see the gnu {3} license for more details]] [you should have received a copy of the gnu {3} license along with {3}]"""

#: Whole texts and notices (fixed values). [words] may be missing, and may hold other such; {n} stands for one to n words of any kind.
TEMPLATES = (
    (f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so [subject to the following conditions] the above copyright notice and this permission notice [including the next
        paragraph] shall be included in all copies or substantial portions of the software [{_AS_IS}]""", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software [and associated documentation files] [the software] to deal", "mit"),
    ("[licensed] [released] [distributed] [available] [under] [the] [terms] [of] the mit license", "mit"),
    ("mit licensed", "mit"),
    ("""licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license [you may obtain a copy of the license at
        [http] [https] [www] apache org licenses license 2 0 [unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
        as is basis without warranties or conditions of any kind either express or implied [see the license for the specific language governing permissions and limitations under
        the license]]]""", "apache-2"),
    ("licensed under [the] apache [software] license [version] [v] 2 [0]", "apache-2"),
    ("released under [the] apache [software] [license] [version] [v] 2 [0]", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("under [the] [creative commons] cc by nc [sa] [nd] [4 0]", "cc-by-nc"),
    ("[under] [the] creative commons attribution non commercial [share alike] [no derivatives] [4 0] [international] [license]", "cc-by-nc"),
    ("[under] [the] creative commons attribution noncommercial [sharealike] [noderivatives] [4 0] [international] [license]", "cc-by-nc"),
    ("under [the] cc by [4 0] license", "cc-by"),
    ("under [the] cc by sa", "cc-by-sa"),
    (f"{_BSD_START} [3] neither the name of {{10}} nor the names of {{4}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}", "bsd-3"),
    (f"{_BSD_START} {_BSD_END}", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (f"is free software you can redistribute it and or modify it under the terms of the gnu general public license [as published by the free software foundation] [either] version 2 [of the license] {_GPL_END}", "gpl-2"),
    (f"is free software you can redistribute it and or modify it under the terms of the gnu general public license [as published by the free software foundation] [either] version 3 [of the license] {_GPL_END}", "gpl-3"),
    (f"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license [as published by the free software foundation] [either] version {{2}} [of the license] {_GPL_END}", "lgpl"),
    (f"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license [as published by the free software foundation] [either] version 3 [of the license] {_GPL_END}", "agpl"),
    ("[the] gnu general public license [as published by the free software foundation] [either] version 2", "gpl-2"),
    ("[the] gnu general public license [as published by the free software foundation] [either] version 3", "gpl-3"),
    ("[the] gnu lesser general public license", "lgpl"),
    ("[the] gnu affero general public license", "agpl"),
    ("[this source code form is] [subject to] [the terms of] [the] mozilla public license [version] [v] 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at [http] [https] mozilla org mpl 2 0]", "mpl-2"),
    ("""permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this
        permission notice appear in all copies] [the software is provided as is and {4} disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness]""", "isc"),
    ("""this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely [subject to the
        following restrictions]""", "zlib"),
    ("""this is free and unencumbered software released into the public domain [anyone is free to copy modify publish use compile sell or distribute this software either in
        source code form or as a compiled binary for any purpose commercial or non commercial and by any means]""", "unlicense"),
    ("copyright {6} all rights reserved", "all-rights-reserved"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache-2"),
    ("spdx license identifier bsd 2 clause", "bsd-2"),
    ("spdx license identifier bsd 3 clause", "bsd-3"),
    ("spdx license identifier gpl 2 0 [only] [or later]", "gpl-2"),
    ("spdx license identifier gpl 3 0 [only] [or later]", "gpl-3"),
    ("spdx license identifier lgpl {2} [only] [or later]", "lgpl"),
    ("spdx license identifier agpl 3 0 [only] [or later]", "agpl"),
    ("spdx license identifier mpl 2 0", "mpl-2"),
    ("spdx license identifier isc", "isc"),
    ("spdx license identifier zlib", "zlib"),
    ("spdx license identifier unlicense", "unlicense"),
    ("spdx license identifier cc by 4 0", "cc-by"),
    ("spdx license identifier cc by sa 4 0", "cc-by-sa"),
    ("spdx license identifier cc by nc [sa] [nd] 4 0", "cc-by-nc"),
    ("[the] [modified] [new] bsd 3 clause [license]", "bsd-3"),
    ("[the] [simplified] bsd 2 clause [license]", "bsd-2"),
    ("[the] gnu general public license [version] v2 [0] [only] [or later]", "gpl-2"),
    ("[the] gnu general public license [version] v3 [0] [only] [or later]", "gpl-3"),
    ("[gnu] gplv2", "gpl-2"),
    ("[gnu] gplv3", "gpl-3"),
    ("[gnu] gpl v2 [0]", "gpl-2"),
    ("[gnu] gpl v3 [0]", "gpl-3"),
    ("[gnu] lgplv3", "lgpl"),
    ("[gnu] agplv3", "agpl"),
)

#: Moves of the automaton that are remembered at a time in one worker.
MOVES = 100_000

#: Bytes that part words; A-Z become a-z on the way.
_KEEP = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of the lower-cased text: runs of digits, a-z and non-ASCII characters."""
    return text.encode().translate(_KEEP).split()


@dataclass(frozen=True)
class Automaton:
    """All templates in one nondeterministic automaton over words.

    `steps[s]` maps a word to next states, with `None` for any word; `skips[s]` are states reached without a
    word; `accepts[s]` is the template that ends at s; `fixed[n]` is how many mandatory words template n has.
    """

    steps: tuple[dict, ...]
    skips: tuple[tuple[int, ...], ...]
    accepts: dict
    fixed: tuple[int, ...]

    def closure(self, states) -> frozenset:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skips[s]
        return frozenset(out)


def compile_templates(templates: tuple[str, ...]) -> Automaton:
    steps: list[dict] = [{}]
    skips: list[list[int]] = [[]]
    accepts, fixed = {}, []

    def state() -> int:
        steps.append({})
        skips.append([])
        return len(steps) - 1

    def word(at: int, token: bytes | None) -> int:
        end = state()
        steps[at].setdefault(token, []).append(end)
        return end

    for n, template in enumerate(templates):
        at, optional, mandatory = state(), [], 0
        skips[0].append(at)
        for part in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
            if part == "[":
                optional.append(at)
            elif part == "]":
                skips[optional.pop()].append(at)
            elif part.startswith("{"):
                end = state()
                for _ in range(int(part[1:-1])):
                    at = word(at, None)
                    skips[at].append(end)
                at = end
            else:
                mandatory += not optional
                at = word(at, part.encode())
        accepts[at] = n
        fixed.append(mandatory)
    return Automaton(tuple(steps), tuple(map(tuple, skips)), accepts, tuple(fixed))


class Scanner:
    """Runs the automaton from every word that can begin a template; its subsets are built when first met.

    A template may begin with optional parts, but not with a replaceable one, as every word would begin it.
    """

    def __init__(self, templates: tuple[str, ...]):
        self.automaton = a = compile_templates(templates)
        self.start = a.closure([0])
        self.moves: dict = {}
        self.vocabulary = {w for s in a.steps for w in s if w is not None}
        self.first = {w for s in self.start for w in a.steps[s] if w is not None}
        if any(None in a.steps[s] for s in self.start):
            raise ValueError("a template can't begin with a replaceable part")

    def _move(self, states: frozenset, token: bytes | None) -> tuple[frozenset, tuple[int, ...]]:
        key = (states, token)
        if key not in self.moves:
            if len(self.moves) > MOVES:
                self.moves.clear()
            a = self.automaton
            ahead = [t for s in states for w in {token, None} for t in a.steps[s].get(w, ())]
            after = a.closure(ahead)
            self.moves[key] = after, tuple(sorted(a.accepts[s] for s in after if s in a.accepts))
        return self.moves[key]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of each accepted stretch, the longest for each template and start."""
        first, vocabulary = self.first, self.vocabulary
        for start in [i for i, w in enumerate(words) if w in first]:
            states, found = self.start, {}
            for end in range(start, len(words)):
                w = words[end]
                states, ended = self._move(states, w if w in vocabulary else None)
                if not states:
                    break
                for n in ended:
                    found[n] = end + 1
            for n, end in found.items():
                yield n, start, end


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[str, ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases are templates without optional parts; a place is a start at which all their words stand.
    A template of a licence's text or notice matches where its mandatory words stand in order, its optional regions
    whole or not at all, and its replaceable ones filled with as many words as they take. `score` is the share of
    mandatory words in the longest accepted stretch (1 when nothing optional or replaced stands in it), 0 without a match. Null and empty texts have no words and empty labels, and texts
    of any length are scanned whole, in one pass over their words.
    Repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
    """
    base, templates = tuple(base), tuple(templates)
    phrases = tuple(p for p, _ in base + templates)
    labels = tuple(x for _, x in base + templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = scanner(phrases)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                words = words_of(value.as_py() or "")
                found = list(run.matches(words))
                places = [s for n, s, _ in found if n < len(base)]
                longest = max(((e - s, run.automaton.fixed[n]) for n, s, e in found), default=(1, 0))
                values = (
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted({labels[n] for n, _, _ in found if n < len(base)})),
                    ",".join(sorted({labels[n] for n, _, _ in found})), longest[1] / longest[0],
                )
                for column, x in zip(rows, values):
                    column.append(x)
            types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
