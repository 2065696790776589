"""The llm operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from depsift.llm import embeddings, encoders, exact, html_main, langid, license_scan, mixing, packing, simhash, suffixes, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept boolean"


def texts():
    rng = random.Random(4)
    words = ["alpha", "bra", "cé", "dog", "under", "the", "mit", "license", "x1", "zeta", "<|endoftext|>", "Ünder", "\n", "a  b"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = say(4000)
    base = [say(rng.randint(1, 120)) for _ in range(25)]
    out = base + [base[3], base[3], base[7] + " extra", base[8].upper(), None, "", "   ", "a" * 3000, long_, "x" + long_[50:], long_ + " tail"]
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4], 1, 7, False) for i, t in texts()]
    return spark.createDataFrame(rows + [rows[4]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    rows = packing.pack_sequences(docs).collect()
    ids_of, known = encoders.byte_bpe(encoders.default_path("byte_bpe_50k.json")), dict(texts())
    by_doc, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        lanes[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(known)
    for i, t in known.items():
        ids = np.array(ids_of(t or "") + [2], "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == 1024 for p in pieces[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in pieces)
    for lane in lanes.values():
        lane.sort()
        assert [o for o, _ in lane] == [sum(n for _, n in lane[:k]) for k in range(len(lane))] and sum(n for _, n in lane) <= 1024
    assert packing.pack_sequences(empty).count() == 0


def test_fast_encoder_equals_library():
    from tokenizers import Tokenizer

    path = encoders.default_path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), encoders.byte_bpe(path)
    for _, t in texts():
        assert fast(t or "") == slow.encode(t or "", add_special_tokens=False).ids


def test_plan_covers_histogram():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 64) for _ in range(3000))
    plan = packing.plan_sequences(dict(histogram), 64)
    covered = Counter()
    for pattern, many in plan.items():
        assert sum(n * a for n, a in pattern) <= 64
        covered.update({n: a * many for n, a in pattern})
    assert covered == histogram
    assert plan.total() <= 1.02 * sum(n * k for n, k in histogram.items()) / 64 + 1
    lp = packing.configuration_lp({n: k for n, k in histogram.items() if n < 64}, 64)
    assert lp.bound <= lp.value <= 1.02 * lp.bound and sum(int(x) for x in lp.amounts.values()) >= 0.5 * lp.value  # most of it is whole


def configurations(lengths, capacity):
    """All multisets of lengths within a capacity."""
    if not lengths:
        return [()]
    n, rest = lengths[0], lengths[1:]
    return [((n, k), *more) for k in range(capacity // n + 1) for more in configurations(rest, capacity - n * k)]


@pytest.mark.parametrize("seed", range(5))
def test_linear_program_covers_and_its_prices_are_a_bound(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(2, 19), 6))
    histogram = {n: rng.choice([1, 2, 30, 700]) for n in lengths}
    lp = packing.configuration_lp(histogram, 20)
    covered = Counter()
    for pattern, amount in lp.amounts.items():
        assert amount > 0 and sum(n * c for n, c in pattern) <= 20
        for n, c in pattern:
            covered[n] += c * amount
    assert all(abs(covered[n] - k) < 1e-6 for n, k in histogram.items()) and abs(sum(lp.amounts.values()) - lp.value) < 1e-6
    # dual feasible: no configuration costs more than one sequence
    assert all(sum(lp.prices[n] * k for n, k in c) <= 1 + 1e-9 for c in configurations(lengths, 20))
    assert sum(n * k for n, k in histogram.items()) / 20 - 1e-6 <= lp.bound <= lp.value + 1e-6
    assert packing.plan_sequences(histogram, 20).total() >= lp.bound - 1e-6


@pytest.mark.parametrize("seed, low, high", [(2, 1, 1023), (3, 300, 1023), (4, 1, 200), (5, 512, 520)])
def test_plan_is_close_to_the_bound(seed, low, high):
    rng = random.Random(seed)
    histogram = dict(Counter(rng.randint(low, high) for _ in range(20_000)))
    plan, covered = packing.plan_sequences(histogram, 1024), Counter()
    for pattern, many in plan.items():
        assert sum(n * a for n, a in pattern) <= 1024
        covered.update({n: a * many for n, a in pattern})
    large = sum(k for n, k in histogram.items() if n > 512)
    bound = max(sum(n * k for n, k in histogram.items()) / 1024, large, large + (sum(k for n, k in histogram.items() if n == 512)) / 2)
    assert covered == Counter(histogram) and plan.total() <= 1.01 * bound + 2
    assert packing.plan_sequences({1024: 5}, 1024).total() == 5 and packing.plan_sequences({}, 1024).total() == 0


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(docs, empty):
    prints = {i: int.from_bytes(simhash.fingerprint(t or "", 4), "big") for i, t in texts()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_components(prints, linked)
    rows = simhash.near_duplicates(docs, shingle=4, distance=4).collect()
    assert len(rows) == len(prints) + 1
    assert all(int.from_bytes(r.fp, "big") == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    words = "The quick brown fox jumps over THE lazy dog".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint("The quick brown fox  jumps over THE lazy\tdog", 4) == want.to_bytes(8, "big")


@pytest.mark.parametrize("block", [4096, 8])
def test_hot_posting_lists(spark, block):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)})
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    found = [(int.from_bytes(r.src, "big"), int.from_bytes(r.dst, "big")) for r in simhash.links(df, 4, 4, simhash.index_positions(8, 4), block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert brute_components(prints, found) == brute_components(prints, want)


def test_verified_groups(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(10):
        near = list(base[i])
        near[100] = "changed"
        rows.append((100 + i, " ".join(near)))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[100 + i] == i for i in range(10)) and all(found[i] == i for i in range(30))


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts()) + 1 and mixing.mix_sources(empty).count() == 0
    sums, targets, sizes = Counter(), {}, Counter()
    for r in rows:
        sums[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)


def test_token_counts(docs, empty):
    path = encoders.default_path("piece_bpe_32k.model")
    model, known = encoders.pieces(path), dict(texts())
    for r in token_counts.count_tokens(docs, limit=50).collect():
        text = known[r.doc_id] or ""
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)
        assert len(model.encode(text[: r.fit_chars])) <= 50 and (r.fit_chars == len(text) or len(model.encode(text[: r.fit_chars + 1])) > 50)
    assert token_counts.count_tokens(empty).count() == 0


def test_counts_at_every_prefix():
    counter = token_counts.PrefixCounter(encoders.default_path("piece_bpe_32k.model"))
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", " ", "  ", "<s>", "</s>", "<unk>", "<0x41>", "▁", "é", "日本", "😀", "\n", "ﬁ", "0", "12", "\u200b", "\x00", "'s", "ﷺ", "THE", "--"]
    for _ in range(80):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        table = counter.table(text)
        want = [len(counter.model.encode(text[:k])) for k in range(len(text) + 1)]
        assert table.total == want[-1] and [table.at(k) for k in range(len(text) + 1)] == want and table.counts().tolist() == want[1:]
        for budget in (0, 3, 10):
            assert table.fit(budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_counts_of_long_words():
    counter = token_counts.PrefixCounter(encoders.default_path("piece_bpe_32k.model"))
    for text in ("ab" * 100_000, " " * 200_000 + "x", "日" * 50_000):
        assert counter.table(text).total == len(counter.model.encode(text))


def test_html(spark):
    page = "<head><title>t</title></head><nav><a>home</a></nav><div class='ad'>buy now</div><article><h1>Big &amp; small</h1><p>One<br>two\n three<p>four<script>x</p></script></article><section class=comments>bad</section><footer>&copy; f</footer>"
    rows = [(1, "http://h.org/a", page), (2, "http://h.org/b", None), (3, None, "<div>shared menu of the site</div><div>own text here</div>"), (4, None, "<div>shared menu of the site</div><p>other words &lt;now"), (4, None, "<p>plain")]
    found = [(r.page_id, r.text, r.n_chars) for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()]
    want = [(1, "Big & small\nOne two three\nfour"), (2, ""), (3, "own text here"), (4, "other words <now"), (4, "plain")]
    assert sorted(found) == sorted((i, t, len(t)) for i, t in want)


def test_suffix_array():
    rng = random.Random(3)
    s = np.array([rng.randint(0, 2) for _ in range(200)])
    assert html_main.suffix_array(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("length", [50, 32])
def test_repeats(docs, empty, length):
    first, want = {}, {}
    for i, t in texts():
        b = (t or "").encode()
        covered = bytearray(len(b))
        mine = [p for p in range(len(b) - length + 1) if first.get(b[p : p + length], i) < i]
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
        for p in mine:
            covered[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        want[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    rows = suffixes.remove_repeats(docs, length).collect()
    assert len(rows) == len(want) + 1 and all(tuple(r)[1:] == want[r.doc_id] for r in rows)
    assert sum(w[1] for w in want.values()) > 10_000 and suffixes.remove_repeats(empty).count() == 0


def test_exact(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    groups[texts()[4][1]].append(5)
    for r in exact.exact_dedup(docs).collect():
        members = groups[dict(texts())[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), r.doc_id == max(members))
        assert r.text_sha256 == hashlib.sha256((dict(texts())[r.doc_id] or "").encode()).hexdigest()
    assert exact.exact_dedup(empty).count() == 0


def test_licenses(docs, empty):
    known = dict(texts())
    for r in license_scan.scan_licenses(docs).collect():
        words = license_scan.words_of(known[r.doc_id] or "")
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.encode().split()
            hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base) == (len(words), len(places)) and r.base_labels == ",".join(sorted(labels))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_templates():
    run = license_scan.Scanner(("a b [c d] e", "copyright {2} reserved"))
    match = lambda s: [(n, i, j) for n, i, j in run.matches(s.encode().split())]
    assert match("a b e") == [(0, 0, 3)] and match("x a b c d e") == [(0, 1, 6)] and match("a b c e") == []
    late = license_scan.Scanner(("[the [old]] mit license",))
    assert list(late.matches(b"by the mit license".split())) == [(0, 1, 4), (0, 2, 4)] and list(late.matches(b"the old mit license".split()))[0] == (0, 0, 4)
    with pytest.raises(ValueError):
        license_scan.Scanner(("{2} licensed",))
    assert match("copyright x y reserved") == [(1, 0, 4)] and match("copyright reserved") == [] and match("copyright x y z reserved") == []


@pytest.mark.parametrize("notice, label", [
    ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"), ("BSD 3-Clause License", "bsd-3"),
    ("GNU General Public License v3.0", "gpl-3"), ("GPLv3", "gpl-3"), ("GNU GPL v2", "gpl-2"), ("a general public of v3 clauses", ""),
])
def test_short_notices(spark, notice, label):
    assert license_scan.scan_licenses(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first().labels == label


def test_texts_of_many_words_are_scanned_whole(spark):
    text = "word " * 200_000 + "under the MIT license"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (200_004, 1, 200_000, "mit")


def template_ends(template, words, start):
    """Ends of a template's matches from a start, by trying every reading of its parts."""
    import re

    parts = re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template)

    def tree(i):
        out = []
        while i < len(parts) and parts[i] != "]":
            if parts[i] == "[":
                inner, i = tree(i + 1)
                out.append(inner)
            else:
                out.append(parts[i])
            i += 1
        return out, i

    def run(nodes, ends):
        for node in nodes:
            if isinstance(node, list):
                ends = ends | run(node, ends)
            elif node[0] == "{":
                ends = {e + k for e in ends for k in range(1, int(node[1:-1]) + 1) if e + k <= len(words)}
            else:
                ends = {e + 1 for e in ends if e < len(words) and words[e] == node.encode()}
        return ends

    return run(tree(0)[0], {start})


def test_labels_equal_brute_force(spark):
    rng = random.Random(17)
    import re

    def written(template):
        """A text of a template: optional regions kept or not, replaceable ones filled, now and then a word changed."""
        while "[" in template:
            template = re.sub(r"\[([^\[\]]*)\]", lambda m: m[1] if rng.random() < 0.6 else "", template)
        words = [w for p in template.split() for w in ([f"x{rng.randrange(9)}" for _ in range(rng.randint(1, int(p[1:-1])))] if p[0] == "{" else [p])]
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "odd"
        return " ".join(words)

    every = license_scan.BASE + license_scan.TEMPLATES
    rows = [(i, " then ".join(written(rng.choice(every)[0]) for _ in range(rng.randint(1, 3)))) for i in range(120)] + [(500, None), (501, ""), (502, "the mit license")]
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = license_scan.words_of(dict(rows)[r.doc_id] or "")
        hits = {(n, s, max(ends)) for n, (t, _) in enumerate(every) for s in range(len(words)) if (ends := template_ends(t, words, s) - {s})}
        assert r.labels == ",".join(sorted({every[n][1] for n, _, _ in hits}))
        if hits:
            fixed = {n: sum(1 for p in re.sub(r"\{\d+\}", "", bare(every[n][0])).split()) for n, _, _ in hits}
            size, most = max((e - s, fixed[n]) for n, s, e in hits)
            assert r.score == pytest.approx(most / size)
        else:
            assert r.score == 0


def bare(template):
    import re

    while "[" in template:
        template = re.sub(r"\[[^\[\]]*\]", "", template)
    return template


@pytest.mark.parametrize("block, wide", [(2048, 16), (7, 16), (7, 1), (4, 0)])
def test_embeddings(spark, block, wide):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(8):
            centre = rng.normal(size=12)
            for _ in range(rng.integers(1, 8)):
                rows.append((n, [float(x) for x in centre + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.08])], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 12, 1), (n + 2, [float("nan")] + [1.0] * 11, 1), (n + 3, [1.0, 2.0], 1), (n + 4, rows[0][1], 1), (n + 5, [None] + [1.0] * 11, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if v and label and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    linked = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    want, count = brute_components([r[0] for r in rows], linked), Counter(i for p in linked for i in p)
    for r in embeddings.near_duplicate_vectors(df, block=block, wide=wide).collect():
        assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.train(docs, max_rows=300)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and np.mean([r.rejected for r in rows]) < 0.01
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(odd, langid.train(docs, max_rows=100)).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predict(odd, langid.train(odd)).collect()} == {"und"}


def test_languages_equal_a_plain_reading_of_the_model(spark):
    """Predictions of all rows from a dictionary of subwords counted letter by letter."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, "12 !"), (-3, "a"), (-4, "Ünder thé  x9y"), (-5, "word " * 5000)], "doc_id long, text string")
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), max_rows=300)
    slots = len(model.table)

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        kept = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in text.lower().encode())
        raw = " " + " ".join(kept.split(" ")) + " "
        while "  " in raw:
            raw = raw.replace("  ", " ")
        code = lambda s: sum(ord(c) << 8 * (len(s) - 1 - k) for k, c in enumerate(s))
        found = [((code(raw[i : i + 3]) * 0x9E3779B1) % 2**32 >> 8) % slots for i in range(len(raw) - 2) if raw[i + 1] != " "]
        found += [((code(raw[i : i + 4]) * 0x85EBCA6B) % 2**32 >> 9) % slots for i in range(len(raw) - 3) if " " not in raw[i + 1 : i + 3]]
        mean = [sum(float(model.table[s][k]) for s in found) / max(1, len(found)) + model.bias[k] for k in range(len(model.languages))]
        e = [np.exp((x - max(mean)) / model.temperature) for x in mean]
        best = int(np.argmax(e))
        return model.languages[best], e[best] / sum(e), e[best] / sum(e) < model.threshold

    texts_ = {r.doc_id: r.text for r in docs.union(extra).collect()}
    rows = langid.predict(docs.union(extra), model).collect()
    assert len(rows) == len(texts_)
    for r in rows:
        language, score, rejected = plain(texts_[r.doc_id])
        assert (r.lang_pred, r.rejected) == (language, rejected) and abs(r.score - score) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        found = stage(spark, before, "")
        rows = spark.createDataFrame(found.collect(), found.schema)
        if name == "exact_dedup":
            assert rows.count() == before.select("text").distinct().count()
        if name != "pack":
            assert rows.columns == columns
    assert rows.count() > 0


def test_nearest_forest_spans_components_by_their_closest_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, 16), dtype=np.uint8)
    rows = np.repeat(base, 20, axis=0)
    rows[np.arange(60), rng.integers(2, 16, 60)] ^= np.uint8(1) << rng.integers(0, 8, 60).astype(np.uint8)
    a, b = simhash._nearest_forest(rows, 2, 6)
    assert len(a) == 57 and all(x // 20 == y // 20 for x, y in zip(a, b))
    every = np.bitwise_count(rows ^ rows[:, None]).sum(axis=2, dtype=int)
    np.fill_diagonal(every, 999)
    ends, used = np.r_[a, b], np.full(60, 999)
    np.minimum.at(used, ends, np.tile(every[a, b], 2))
    assert (used == every.min(axis=1)).all()  # a minimum spanning forest holds a closest pair of every row
    which, x, y = simhash._nearest_forests(np.stack([rows, rows[::-1].copy()]), 2, 6)
    first = simhash._nearest_forest(rows, 2, 6), simhash._nearest_forest(rows[::-1].copy(), 2, 6)
    assert [sorted(zip(x[which == k].tolist(), y[which == k].tolist())) for k in (0, 1)] == [sorted(zip(*f)) for f in first]


def brute_groups(rows, similarity=0.8, distance=30, matches=2, sets=((0,),)):
    """Components of similar pairs inside the groups of bit links, by comparing all pairs."""
    shingles, prints = {}, {}
    for i, text in rows:
        words = text.split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        prints[i] = simhash.fingerprint(text, 5, 128)
    m = np.frombuffer(b"".join(prints[i] for i, _ in rows), np.uint8).reshape(len(rows), -1)
    ids, linked = [i for i, _ in rows], []
    for k in range(len(rows)):
        differing = m[k + 1 :] ^ m[k]
        ok = (np.bitwise_count(differing).sum(axis=1) <= distance) & ((differing == 0).sum(axis=1) >= matches)
        ok &= np.any([(differing[:, list(s)] == 0).all(axis=1) for s in sets], axis=0)
        linked += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(ok)]
    group = brute_components(ids, linked)
    members = defaultdict(list)
    for i in ids:
        members[group[i]].append(i)
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= similarity * (len(shingles[a]) * len(shingles[b])) ** 0.5
    return brute_components(ids, [(a, b) for g in members.values() for a in g for b in g if a < b and alike(a, b)])


def test_groups_in_long_posting_lists_equal_brute_force(spark):
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(10_000 + i, " ".join(say(30))) for i in range(6000)]  # over 16 unrelated fingerprints a list of one byte
    for family in range(150):
        base = say(150)
        for copy in range(3):
            words = list(base)
            for at in rng.sample(range(5, 145), rng.randint(2, 3)):
                words[at] = f"c{rng.randrange(10**6)}"
            rows.append((family * 3 + copy, " ".join(words)))
    sets = [(i,) for i in range(16)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), sets=sets, distance=30).collect()}
    assert found == brute_groups(rows, sets=sets)


@pytest.mark.parametrize("side", [1024, 3])
def test_fragments_of_a_group_are_compared_in_blocks(spark, side):
    rng = random.Random(5)
    rows = [(i, frozenset(rng.sample(range(26), 20)), i % 3) for i in range(60)]
    frame = spark.createDataFrame([(g, i, np.array(sorted(s), np.uint32).tobytes()) for i, s, g in rows], "group long, doc_id long, shingles binary")
    known = [(0, 3), (3, 6), (1, 4)]
    labels = brute_components(range(60), known)
    fragments = spark.createDataFrame([(i, labels[i]) for p in known for i in p], "node long, component long").distinct()
    found = [tuple(r) for r in simhash.fragment_links(frame, fragments, 0.8, side).collect()]
    linked = [(a, b) for a, s, g in rows for b, x, h in rows if g == h and a < b and len(s & x) >= 0.8 * (len(s) * len(x)) ** 0.5]
    assert brute_components(range(60), found + known) == brute_components(range(60), linked + known)


def test_equal_fingerprints_of_other_texts_are_no_copies(spark):
    rng = random.Random(8)
    filler = ["filler"] * 400
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + filler)) for i in range(6)]
    rows += [(10 + i, rows[i][1] + " filler filler") for i in range(3)]  # equal sets
    near = rows[4][1].split()
    near[0] = "other"
    rows.append((20, " ".join(near)))
    assert len({simhash.fingerprint(t, 5, 128) for _, t in rows}) == 1
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in range(6)}, **{10 + i: i for i in range(3)}, 20: 4}


@pytest.mark.parametrize("parts", [1, 7])
def test_html_repeats_are_found_over_the_whole_host(spark, parts):
    rows = [(i, "http://h.org/", f"<div>the menu of this site</div><div>own{i} words{i} of{i} page{i}</div>") for i in range(513)]
    rows += [(600, "http://i.org/", "<div>the menu of this site</div>")]  # once on its host
    found = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
    assert found == {**{i: f"own{i} words{i} of{i} page{i}" for i in range(513)}, 600: "the menu of this site"}


def test_html_outside_articles(spark):
    page = lambda i: f"<div>lead{i} of{i} this{i} page{i}</div><div>the menu of this site</div><article>copied text of the article</article>"
    rows = [(i, "http://h.org/", page(i)) for i in range(4)]
    rows += [(10 + i, "http://i.org/", f"<p>alpha{i} beta{i} four tokens in common gamma{i} delta{i} eta{i}</p>") for i in range(2)]
    rows += [(1000 + i, "http://j.org/", "<p>rarely said but twice</p>" if i < 2 else f"<p>own{i}</p>") for i in range(250)]
    found = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"lead{i} of{i} this{i} page{i}\ncopied text of the article" for i in range(4)}
    want |= {10 + i: f"alpha{i} beta{i} four tokens in common gamma{i} delta{i} eta{i}" for i in range(2)}
    want |= {1000 + i: "rarely said but twice" if i < 2 else f"own{i}" for i in range(250)}
    assert found == want


def test_most_planted_near_copies_are_found(spark):
    rng = random.Random(21)
    rows, shingles = [], {}
    for k in range(150):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randint(80, 250))]
        rows.append((2 * k, " ".join(base)))
        for at in rng.sample(range(len(base)), int(len(base) * rng.uniform(0.01, 0.045))):
            base[at] = f"c{rng.randrange(10**5)}"
        rows.append((2 * k + 1, " ".join(base)))
    for i, t in rows:
        words = t.split()
        shingles[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
    near = [k for k in range(0, 300, 2) if len(shingles[k] & shingles[k + 1]) >= 0.8 * (len(shingles[k]) * len(shingles[k + 1])) ** 0.5]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 100 and np.mean([found[k + 1] == k for k in near]) >= 0.9
    assert all(found[k + 1] == k + 1 for k in range(0, 300, 2) if k not in near) and all(found[k] == k for k in range(0, 300, 2))


def test_recall_of_near_copies_in_the_test_table(spark):
    """Pairs of different texts of sf0.1 at a similarity of 0.8 or more, found by their shingles: nine in ten end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    first = {}
    for i, t in docs.orderBy("doc_id").collect():
        first.setdefault(simhash.shingle_hashes(t or "", 5), i)
    sets = {i: np.frombuffer(x, np.uint32) for x, i in first.items() if x}
    where, both = defaultdict(list), Counter()
    for i, x in sets.items():
        for s in x.tolist():
            where[s].append(i)
    for ids in where.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    near = [(a, b) for (a, b), n in both.items() if n >= 0.8 * np.sqrt(len(sets[a]) * len(sets[b]))]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert len(near) > 300 and np.mean([found[a] == found[b] for a, b in near]) >= 0.9


def test_encoder_takes_a_million_spaces():
    ids_of = encoders.byte_bpe(encoders.default_path("byte_bpe_50k.json"))
    assert len(ids_of(" " * 1_000_000 + "x")) > 1000


def test_ids_of_other_types(spark):
    rows = [(f"d{i}", "one two three " * i, "s", i) for i in range(6)] + [(None, "null id", None, 1), (None, None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, n long")
    assert mixing.mix_sources(df).count() == 8
    with pytest.raises(ValueError):
        suffixes.remove_repeats(df)


def test_exact_copies_over_the_hot_bound(spark):
    rows = [(i, "the same text") for i in range(1500)] + [(2000 + i, f"text {i}") for i in range(50)] + [(None, None), (3000, "")]
    found = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: (1499, 1500, i == 1499) for i in range(1500)} | {2000 + i: (2000 + i, 1, True) for i in range(50)} | {None: (3000, 2, False), 3000: (3000, 2, True)}
    assert len(found) == 1552 and all((r.keep_id, r.group_size, r.kept) == want[r.doc_id] for r in found)


def test_double_vectors_keep_their_precision(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [1e300, 1e290], 1), (3, [0.0, 1e-300], 1), (4, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame([(i, [x / 1e150 for x in v], a) for i, v, a in rows], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicate_vectors(df.where("vec_id < 3")).collect()} == {1: 1, 2: 1}


def test_language_sample_is_bounded_by_numbers(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox " * 40 if i % 2 else "der schnelle braune fuchs " * 40, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    whole, part = langid.train(docs), langid.train(docs, max_numbers=100)
    assert whole.languages == ("de", "en") and len(part.languages) <= 2
    assert langid.train(docs.limit(0)).languages == ()


def test_pipeline_stages_take_odd_tables(spark, empty):
    import corpus_pipeline as P

    columns = SCHEMA + ", __key string, __turn long, __mix string, held_out boolean, lang_pred string"
    words = lambda k: " ".join(f"the{k} quick{k} fox{j}" for j in range(60))
    rows = [(i if i % 3 else None, words(i), "en", "a" if i % 2 else None, 1, 1, True, "k", 1, "m", True, "xx") for i in range(24)]
    rows += [rows[4], rows[3], (50, None, "en", "a", 0, 0, False, None, None, None, None, None), (51, "", None, None, 0, 0, False, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    count = lambda df: Counter(map(tuple, df.collect()))
    exact_ = P.exact_dedup(spark, docs, "")
    assert count(exact_) == Counter(set(map(tuple, rows)) - {tuple(rows[-2])})
    assert count(P.near_dedup(spark, docs, "")) == Counter(map(tuple, rows)) - Counter([rows[-1]])
    mixed, taken = count(P.mix_sources(spark, docs, "")), mixing.mix_sources(docs).collect()
    assert set(mixed) <= set(map(tuple, rows)) and sum(mixed.values()) == sum(r.copies for r in taken)
    per, times = Counter(), Counter(map(tuple, rows))
    for r in taken:
        per[(r.doc_id, r.source, r.size, r.mark)] += r.copies
    assert sorted(mixed.values()) == sorted(n for n in per.values() if n) and times[tuple(rows[4])] == 2
    assert all(r["text"] for r in P.language_id(spark, docs, "").collect())
    blank = spark.createDataFrame([], columns)
    assert all(stage(spark, blank, "").count() == 0 for _, stage in P.STAGES)
    assert P.pack(spark, docs, "").where("doc_id = 50").first().length == 1


def test_runs_equal_brute_force():
    rng = random.Random(14)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(25)] + [list("abcab")] * 2 + [[], ["a"]]
    want = Counter()
    for s in streams:
        want.update({tuple(s[k : k + 4]) for k in range(len(s) - 3)})
    runs, pages = html_main.page_runs(streams, 4)
    assert len(runs) == len(set(runs)) and dict(zip(runs, pages)) == {html_main.run_hash(list(r)): n for r, n in want.items()}


@pytest.mark.parametrize("page, want", [
    ("<head><title>t</title><p>x", "x"), ("<body class='has-sidebar'><p>t", "t"), ("<div class='sidebar'>s<main class='no-sidebar'>a</main>b</div>", "a"),
    ("<article id='post-related-work'><p class='share-price'>1<p>2</article>", "1\n2"), ("<article><div class='entry-header'><h1>T</h1></div><li class='ad'>x<li>y</article>", "T\ny"),
    ("<div class='ad-banner'>x</div><div id=site-footer>y</div><ol class='comment-list'><li>c</ol>z", "z"), ("<table><tr><td class=ad>1<td>2<tr><td>3</table>", "2\n3"),
    ("<a href='x>y'>k</a><!-- <p>no --><p>a<p>b<br>c", "k\na\nb c"), ("a < b &lt; c", "a < b < c"), ("<p title=\"never ends>abc <b>def</b>", "abc def"), ("x<p", "x"), ("<", "<"), ("", ""),
])
def test_html_cases(page, want):
    assert html_main.main_text(html_main.blocks_of(page), set()) == want


def test_hostile_markup_is_read_in_one_pass():
    import time

    start = time.perf_counter()
    for part in ("<p ", '<a href="x', "<!--", "<script>", "<div>", "<a '", "<ul><li>", "<p><div>", "= ", "word ", "</p>", "&amp"):
        html_main.blocks_of(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 60


def test_html_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, host string, runs long"
    assert html_main.extract_main(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "t", "h", 1), (2, "x", "<p>a", None, None, None), (2, "x", "<p>a", None, None, None), (None, "http://h/", "<nav>n</nav><p>b", "t", "h", 1)]
    found = html_main.extract_main(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, None, "", 0), (2, "x", "a", 1), (2, "x", "a", 1), (None, "http://h/", "b", 1)], key=str)


def brute_repeats(rows, length=50):
    first, want = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mine = [p for p in range(len(b) - length + 1) if first.get(b[p : p + length], i) < i]
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
        covered = bytearray(len(b))
        for p in mine:
            covered[p : p + length] = b"\1" * length
        want[i] = (sum(covered), hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    return want


@pytest.mark.parametrize("blocks", [1, 3, None])
def test_common_passages_and_letter_runs(spark, blocks):
    rng = random.Random(31)
    passage = " ".join(f"w{rng.randrange(99)}" for _ in range(60))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(40)] + [(100 + i, passage * (1 + i % 3)) for i in range(8)]
    rows += [(200 + i, "a" * (40 + 30 * i)) for i in range(6)] + [(300, "b" + "a" * 300), (301, "ab" * 200), (302, "ab" * 150 + "a" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(df, blocks=blocks).collect()} == brute_repeats(rows)


def test_texts_of_a_megabyte(spark):
    """Each operator on texts of 1 MB: words, white space, one letter, one word without a space."""
    rng = random.Random(40)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, words, "en", "s"), (2, words + " x", "en", "s"), (3, " " * 1_000_000, "en", "s"), (4, "a" * 1_000_000, "en", None), (5, "".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    packed = packing.pack_sequences(docs).groupBy("doc_id").sum("length").collect()
    assert len(packed) == 5
    assert len({r.component_id for r in simhash.near_duplicates(docs, shingle=4, distance=4).collect() if r.doc_id in (1, 2)}) == 1
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert groups[2] == 1 and len(set(groups.values())) == 4
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()} == {1: 150_000, 2: 150_001, 3: 0, 4: 1, 5: 1}
    model = encoders.pieces(encoders.default_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs.where("doc_id > 2")).collect()} == {i: len(model.encode(t)) for i, t, _, _ in rows if i > 2}
    pages = docs.selectExpr("doc_id as page_id", "'http://h/' as url", "concat('<article>', text, '</article>') as html")
    assert {r.page_id: r.text for r in html_main.extract_main(pages).collect()} == {i: t.strip() for i, t, _, _ in rows}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs.where("doc_id in (1, 2, 5)")).collect()}
    assert removed[1][1] == 0 and removed[2] == (len(rows[1][1]), len(words)) and removed[5][1] == 0
    assert all(r.kept for r in exact.exact_dedup(docs).collect())
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(docs).collect()} == {1: 150_000, 2: 150_001, 3: 0, 4: 1, 5: 1}
    assert {r.doc_id for r in langid.predict(docs, langid.train(docs)).where("lang_pred <> 'und'").collect()} == {1, 2, 4, 5}


def test_clashing_columns_of_vectors_and_languages(spark):
    rows = [(1, [1.0, 0.0], 1, 5, 6, False), (2, [1.0, 0.001], 1, 5, 6, False), (3, [0.0, 1.0], 1, None, None, None), (3, [0.0, 1.0], 1, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links long, component_id long, kept boolean")
    found = sorted(map(tuple, embeddings.near_duplicate_vectors(df).collect()))
    assert found == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    docs = spark.createDataFrame([(i, "the quick brown fox", "en", True, "xx", 2.0) for i in range(9)] * 2, "doc_id long, text string, lang string, held_out boolean, lang_pred string, score double")
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == 18 and {r.lang_pred for r in out} == {"en"} and {r.held_out for r in out} == {zlib.crc32(str(i).encode()) % 3 == 1 for i in range(9)}
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0


@pytest.mark.parametrize("block", [4096, 60])
def test_a_large_group_of_near_copies_has_few_links(spark, block):
    """Near copies share most of their lists, which span them one by one: only new links count, and components stay."""
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.integers(0, 2, (2, 128), dtype=np.uint8), [200, 100], axis=0)
    for row in bits[:300]:
        row[rng.choice(128, 12, replace=False)] ^= 1
    bits = np.unique(np.concatenate([bits, rng.integers(0, 2, (100, 128), dtype=np.uint8)]), axis=0)
    sets, orders = [(p, p + 1) for p in range(0, 16, 2)], simhash.arrangements(128, 15)
    near = (bits[:, None] != bits[None]).sum(axis=2) <= 34
    shared = np.zeros_like(near)
    for order in orders:
        lists = bits[:, order].reshape(len(bits), 8, 16)
        shared |= (lists[:, None] == lists[None]).all(axis=3).any(axis=2)

    def components(pairs):
        root = list(range(len(bits)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    fps = [np.packbits(row).tobytes() for row in bits]
    place = {fp: i for i, fp in enumerate(fps)}
    frame = spark.createDataFrame([(fp,) for fp in fps], "fp binary")
    found = [(place[bytes(r.src)], place[bytes(r.dst)]) for r in simhash.links(frame, 34, 0, sets, block, nearest=True, orders=orders).collect()]
    assert all((near & shared)[a, b] for a, b in found)
    assert components(found) == components(zip(*np.nonzero(near & shared)))
    assert len(found) < 6 * len(bits)
