"""HTML extraction: main text of pages, with boilerplate found by a suffix array of each host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.plans.lineage import cut

#: Elements whose content is never text (fixed values of the HTML standard).
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "select", "textarea", "button", "title")
#: Elements around an article.
AROUND = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset")
#: Elements that hold the article, and those whose class and id tell nothing of what is in them.
MAIN, PLAIN = ("article", "main"), ("html", "body", "main")
#: Elements that end a block (fixed values of the HTML standard).
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Fixed values of the HTML standard: elements that end where one of theirs begins, and the elements that hold them.
ENDED_BY = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
HOLDERS = ("ul", "ol", "menu", "dl", "table", "select", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header")
#: Elements that may stand in a head; any other one ends it (fixed values of the HTML standard).
IN_HEAD = ("base", "link", "meta", "title", "style", "script", "noscript", "template", "head", "html")
#: Words of class and id that tell what is not the article, and words that say nothing beside them.
MARKS = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "notice", "popup", "modal", "newsletter", "subscribe", "signup", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "sidebar", "footer", "header", "masthead", "share", "social", "related", "recommended", "widget", "comment", "comments", "respond",
    "disqus", "replies", "skip", "toolbar", "pagination",
)
#: Marks that a layout around a whole page may carry; an article inside is text if no other one is.
LAYOUT = ("sidebar", "header", "footer", "menu", "nav", "navbar", "banner", "widget", "breadcrumb", "breadcrumbs", "toolbar", "masthead")
NEUTRAL = (
    "site", "page", "main", "global", "top", "bottom", "left", "right", "list", "item", "items", "box", "area", "wrap", "wrapper", "container", "inner", "outer", "bar", "block",
    "section", "slot", "unit", "links", "link", "icons", "icon", "buttons", "button", "posts", "articles", "thread", "form", "row", "col", "content", "user", "reader", "google", "js",
)
#: A run of at least this many tokens on at least this many pages and this share of the pages of a host is repeated.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 4, 2, 0.01
#: An unlabelled block is boilerplate if repeated runs cover this share of its tokens.
COVER = 0.8
#: Pages of a host whose suffixes are sorted in one array; counts of runs are summed over arrays.
PAGES = 512

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^a-z]+")


@dataclass
class Block:
    """One block of a page: its text and where it stands (main: inside an article; around: inside what is not; layout: only
    as marks of a layout around its article say so)."""

    text: str
    main: bool
    around: bool
    layout: bool = False
    drop: np.ndarray | None = field(default=None)


#: What is said of an element: nothing, that a layout is named after something else, or that it is no article.
NONE, LOOSE, FIRM = 0, 1, 2


def _marked(attributes: str) -> int:
    """Whether a class, id or role says that the element is no article: one whose words are all marks or neutral, with a mark."""
    found = NONE
    for _, value in _attributes(attributes, ("class", "id", "role")):
        for name in value.lower().split():
            words = [w for w in _WORDS.split(name) if w]
            marks = [w for w in words if w in MARKS]
            if marks and all(w in MARKS or w in NEUTRAL for w in words):
                found = max(found, LOOSE if all(w in LAYOUT for w in marks) else FIRM)
    return found


#: An attribute with its value, if any, or a stretch of what can't be one: each step moves on, and none goes back.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>="']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?|["'=]++)""")


def _attributes(attributes: str, names: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(name, value) of those of a tag's attributes, empty where there is none; one pass from left to right."""
    at, n = 0, len(attributes)
    while at < n:
        m = _ATTRIBUTE.match(attributes, at)
        if not m:
            return
        at, name, value = m.end(), (m[1] or "").lower(), m[2] or ""
        if name in names:
            yield name, value[1:-1] if value[:1] in "\"'" and value else value


#: The rest of a tag behind its name; no step is tried twice.
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag in order; comments, declarations and raw elements have no name.

    A forward scan: every search starts where the last one ended, and one that finds nothing is not made again, so
    the work is in proportion to the page whatever its markup. A > inside quotes ends no tag; behind a quote that never
    ends, tags end at any >. A tag that never ends takes the rest of the page.
    """
    n, at, broken = len(page), 0, False
    lower = page.lower() if len(page.lower()) == n else page
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        """Place behind the next `what`, or the page's end."""
        if what in missing:
            return n
        k = lower.find(what, start)
        if k < 0:
            missing.add(what)
            return n
        return k + len(what)

    while True:
        start = page.find("<", at)
        if start < 0:
            return
        ahead = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            at = find("-->", start + 4)
            yield start, at, "", False, ""
            continue
        if ahead and ahead in "!?":
            at = find(">", start + 1)
            yield start, at, "", False, ""
            continue
        closing = ahead == "/"
        m = _NAME.match(page, start + 1 + closing)
        if not m:
            if closing and ahead:
                at = find(">", start + 1)
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        name = m[0].lower()
        whole = None if broken else _TAG_END.match(page, m.end())
        broken = whole is None
        stop = find(">", m.end()) if broken else whole.end()
        at = stop
        attributes = page[m.end() : stop - 1 if page.startswith(">", stop - 1) else stop]
        if name in RAW and not closing:
            close = find(f"</{name}", at)
            at = n if close >= n else find(">", close)
            yield start, at, "", False, ""
            continue
        yield start, at, name, closing, attributes


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; one pass over tags with a stack of open elements.

    What is said of an element holds for all that is in it: marks of class, id or role, an article's own too, the attribute
    `hidden`, and elements that stand around an article. Only where no article is without a mark, those count that nothing but marks of a
    layout around the outermost article speak against. Elements that HTML lets end by the next one, and a head without its end, end so.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    main = around = False
    outside, marked = NONE, NONE  # marks around the outermost article, and those on it and in it

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            held = around or marked != NONE
            blocks.append(Block(text, main, held or outside != NONE, main and not held and outside == LOOSE))

    def close(k: int) -> None:
        nonlocal main, around, outside, marked
        _, main, around, outside, marked = stack[k]
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    def end_of(names: tuple[str, ...], holders: tuple[str, ...]) -> None:
        """Close the innermost of `names` that no holder parts from here."""
        if not any(open_.get(x) for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in holders:
                return

    at = 0
    for start, end, name, closing, attributes in tags_of(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if open_.get("head") and name not in IN_HEAD:
            end_of(("head",), ())
        if name in VOID:
            continue
        if closing:
            if open_.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
            continue
        if name in BLOCKS and open_.get("p"):  # a paragraph ends where the next block begins
            end_of(("p",), HOLDERS)
        for other in ENDED_BY.get(name, ()):
            end_of((other,), HOLDERS)
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, main, around, outside, marked))
        open_[name] = open_.get(name, 0) + 1
        own_header = name == "header" and main  # an article's own header holds its title
        if name in MAIN and not main:
            main, outside, marked = True, marked, NONE
        around |= (name in AROUND and not own_header) or name == "head"
        if attributes and name not in ("html", "body"):
            marked = marked if name in PLAIN else max(marked, _marked(attributes))
            around |= any(value.lower() != "until-found" for _, value in _attributes(attributes, ("hidden",)))
    parts.append(page[at:])
    flush()
    if not any(b.main and not b.around for b in blocks):
        for b in blocks:
            b.around &= not b.layout
    return blocks


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer string, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        changed = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        new[order[1:]] = np.cumsum(changed)
        rank = new
        if rank.max() == n - 1 or step >= n:
            return order
        step *= 2


def common_lengths(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in order (0 for the first)."""
    n = len(tokens)
    place, out, k = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    place[order] = np.arange(n)
    text, where, before = tokens.tolist(), place.tolist(), order.tolist()
    for i in range(n):
        if where[i]:
            j = before[where[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            out[where[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out


def page_runs(streams: list[list[str]], least_tokens: int = LEAST_TOKENS) -> tuple[list[int], list[int]]:
    """Hashes of the distinct runs of `least_tokens` tokens in the streams, and on how many streams each stands.

    The streams are joined with separators that occur once each, so that no run crosses pages. Suffixes with
    `least_tokens` in common stand together in the suffix array; each such stretch is one run.
    """
    words: dict[str, int] = {}
    codes, owner, room = [], [], []
    for page, stream in enumerate(streams):
        codes += [words.setdefault(t, len(words) + len(streams)) for t in stream] + [page]
        owner += [page] * (len(stream) + 1)
        room += range(len(stream), -1, -1)
    if len(codes) <= least_tokens:
        return [], []
    tokens, owner, room = np.array(codes, np.int64), np.array(owner, np.int64), np.array(room)
    order = suffix_array(tokens)
    edge = np.r_[True, common_lengths(tokens, order)[1:] < least_tokens]
    pairs = np.unique(np.stack([np.cumsum(edge) - 1, owner[order]]), axis=1)
    pages = np.bincount(pairs[0])
    first = order[edge]
    whole = room[first] >= least_tokens
    spelt = [streams[owner[i]] for i in first[whole]]
    starts = [len(s) - int(room[i]) for s, i in zip(spelt, first[whole])]
    return [run_hash(s[k : k + least_tokens]) for s, k in zip(spelt, starts)], pages[whole].tolist()


def run_hash(tokens: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(tokens).encode(), 42) - (1 << 63)


def unlabelled(blocks: list[Block]) -> tuple[list[Block], list[str]]:
    """The blocks on which repeats decide, those outside articles that no element labels, and their token stream."""
    open_ = [b for b in blocks if not b.main and not b.around]
    return open_, [t for b in open_ for t in ("<block>", *b.text.split(" "))]


def main_text(blocks: list[Block], repeats: set[int], least_tokens: int = LEAST_TOKENS) -> str:
    """Main text of a page, given the runs that stand on several pages of its host.

    A block inside `article` or `main`, and not in something around it, is text whatever it says: copies of
    whole articles are not boilerplate. A block in a menu, header, footer, sidebar, form, advert, notice or
    comment is none, articles among these included. Any other block, on pages with and without an article, is text unless repeated runs cover
    COVER of its tokens: single runs in common with other pages cut nothing out of it.
    """
    open_, stream = unlabelled(blocks)
    covered = np.zeros(len(stream), bool)
    for k in range(len(stream) - least_tokens + 1 if repeats else 0):
        if run_hash(stream[k : k + least_tokens]) in repeats:
            covered[k : k + least_tokens] = True
    at = 0
    for b in open_:
        n = len(b.text.split(" "))
        b.drop = covered[at + 1 : at + 1 + n]
        at += 1 + n
    return "\n".join(b.text for b in blocks if not b.around and (b.drop is None or b.drop.mean() < COVER))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty for null and for anything else."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Repeats are counted over whole hosts: where pages lie, suffix arrays find the runs of unlabelled blocks
    and on how many pages each stands, at most PAGES of a host at a time; these counts are summed by
    (host, run). Runs on LEAST_PAGES pages and LEAST_SHARE of the host's pages or more go back to the pages that
    hold them, by a hash of the page. No task gets a whole host, and where pages are cut into arrays changes no text.

    Pages of any length are read whole, in one pass over their markup. Null html is an empty page; a page without text gives an empty string. Pages with a null or odd URL form
    one host. Cut-off markup at the end of a page is no text. Repeated rows are extracted each; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("page", F.struct(F.xxhash64("page_id", "url", "html").alias("x"), F.hash("html", "url", "page_id").alias("y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[list[str]]] = {}
            for host, html_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = unlabelled(blocks_of(html_.as_py()))[1]
                if len(stream) >= LEAST_TOKENS:
                    held.setdefault(host, []).append(stream)
            for host, streams in held.items():
                for at in range(0, len(streams), PAGES):
                    runs, many = page_runs(streams[at : at + PAGES])
                    arrays = [pa.array([host] * len(runs), pa.string()), pa.array(runs, pa.int64()), pa.array(many, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["host", "run", "pages"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs = [], []
            for i, html_ in enumerate(batch.column(2)):
                stream = unlabelled(blocks_of(html_.as_py()))[1]
                own = {run_hash(stream[k : k + LEAST_TOKENS]) for k in range(len(stream) - LEAST_TOKENS + 1)}
                at += [i] * len(own)
                runs += own
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(runs, pa.int64())], names=["host", "page", "run"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks_of(h.as_py()), set(r.as_py() or ())) for h, r in zip(batch.column(2), batch.column(3))]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    counts = rows.select("host", "html").mapInArrow(count, "host string, run long, pages long")
    counts = counts.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    hosts = rows.groupBy("host").agg(F.count("*").alias("all"))
    common = cut(counts.join(hosts, "host").where(F.col("pages") >= F.col("all") * LEAST_SHARE).select("host", "run"))
    whole = rows.select("page_id", "url", "html", "page")
    if common.isEmpty():
        given = whole.select("page_id", "url", "html", F.array().cast("array<long>").alias("runs"))
    else:
        held = rows.select("host", "page", "html").mapInArrow(spread, "host string, page struct<x: long, y: int>, run long").join(common, ["host", "run"])
        held = held.groupBy("page").agg(F.collect_set("run").alias("runs"))
        given = whole.join(held, "page", "left").select("page_id", "url", "html", "runs")
    return given.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
