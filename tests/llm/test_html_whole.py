"""Extracted text of whole pages against a second parser that builds the tree and reads it by definition."""

import random
from html.parser import HTMLParser

import pytest

from depsift.llm import html_main

INLINE, BLOCK = ("b", "i", "a", "span"), ("div", "section", "p", "ul", "h2", "blockquote")
CLASSES = ("", "", "", "ad", "comments", "comment list", "related", "sidebar", "site-footer", "entry body", "post-related-work", "sidebar main", "promo box x")
FIRM = {"ad", "comments", "comment", "related", "promo"}


class Tree(HTMLParser):
    """A tree of (name, attributes, children) from well-formed markup."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ("root", {}, [])
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        node = (name, {k: v or "" for k, v in attrs}, [])
        self.stack[-1][2].append(node)
        if name not in ("br", "img"):
            self.stack.append(node)

    def handle_endtag(self, name):
        assert self.stack.pop()[0] == name

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def marks(node):
    """0: none, 1: only a layout's, 2: firm."""
    if node[0] == "main":
        return 0
    found = 0
    for name in node[1].get("class", "").split():
        words = name.split("-")
        known = [w for w in words if w in html_main.MARKS]
        if known and all(w in html_main.MARKS or w in html_main.NEUTRAL for w in words):
            found = max(found, 2 if any(w in FIRM for w in known) else 1)
    return found


def second(page):
    blocks, text = [], []

    def flush(where):
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            blocks.append((joined, *where))

    def read(node, article, hard, outside, inside):
        where = (article, hard, outside, inside)
        for child in node[2]:
            if isinstance(child, str):
                text.append(child)
            elif child[0] == "br":
                text.append(" ")
            elif child[0] not in ("script", "style", "img"):
                block = child[0] not in INLINE
                if block:
                    flush(where)
                a, o, i = article, outside, inside
                if child[0] in ("article", "main") and not a:
                    a, o, i = True, inside, 0
                h = hard or child[0] in ("nav", "aside", "footer", "form") or (child[0] == "header" and not article) or "hidden" in child[1]
                read(child, a, h, o, max(i, marks(child)))
                if block:
                    flush((a, h, o, max(i, marks(child))))

    read(Tree(page).root, False, False, 0, 0)
    flush((False, False, 0, 0))
    free = any(a and not (h or o or i) for _, a, h, o, i in blocks)
    return "\n".join(t for t, a, h, o, i in blocks if not (h or i) and (not o or (a and o == 1 and not free)))


def page_of(rng):
    words = lambda: " ".join(rng.choice(["one", "two &amp; three", "né", "&lt;x", "a\n b", "  "]) for _ in range(rng.randint(0, 4)))

    def made(depth, inline):
        out = words()
        for _ in range(rng.randint(0, 4 if depth < 4 else 0)):
            name = rng.choice(INLINE) if inline or rng.random() < 0.3 else rng.choice((*BLOCK, "article", "article", "main", "nav", "aside", "header", "footer", "article"))
            attributes = f" class='{rng.choice(CLASSES)}'" if name not in INLINE and rng.random() < 0.5 else rng.choice(["", "", "", " id=x"])
            attributes += " hidden" if rng.random() < 0.04 else ""
            out += f"<{name}{attributes}>{made(depth + 1, inline or name in (*INLINE, 'p', 'h2'))}</{name}>" + rng.choice(["", words(), "<br>", "<script>var x = '<p>';</script>", "<!-- no <p> -->"])
        return out

    return f"<html><body>{made(0, False)}</body></html>"


@pytest.mark.parametrize("seed", range(4))
def test_whole_pages_equal_a_second_parser(seed):
    rng = random.Random(seed)
    some = 0
    for _ in range(1500):
        page = page_of(rng)
        want = second(page)
        assert html_main.main_text(html_main.blocks_of(page), set()) == want, page
        some += bool(want)
    assert some > 500


@pytest.mark.parametrize("page, want", [
    ("<main><article><p>Body</p></article><section class='comments'><article class='comment'><p>nice</p></article></section></main>", "Body"),
    ("<main><article><p>Body</p></article></main><section class='related'><article><h3>Other story</h3></article></section>", "Body"),
    ("<article>Body<article class='comment'>nice</article><div hidden>x</div></article><p hidden>y", "Body"),
    ("<div class='sidebar-right'><article>Body<div class='comments'><article>nice</article></div></article></div>", "Body"),
    ("<div class='comments'><article>nice</article></div>", ""), ("<p hidden='until-found'>found</p>", "found"),
])
def test_articles_that_are_not_the_article(page, want):
    assert html_main.main_text(html_main.blocks_of(page), set()) == want
