"""Main text of web pages by a tree-structured graphical model.

Every element of a page's tree is content or not. A node's own potential comes from what its subtree is like - how much
text, how much of the page's, how long its runs, how far linked, where on the page, what children - and from its tag
and class and id words; potentials between parent and child say how content is passed on. Sum-product messages run
from the leaves up and from the root down and give every node's marginal; text whose element has a marginal over
one half is main text. The potentials are fitted, by the gradient of the labels' likelihood that the same messages
give, to labelled pages: a fixed set made by rule, in many layouts and half of it with class words that mean nothing,
and a bounded sample of the corpus' own pages in which a single article element marks the content without doubt.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedmill.llm.common import carried, field, others

#: Pages of the corpus that are used as labelled ones, at most about, and their longest html in characters.
MOST_PAGES, LONGEST_SAMPLE = 40, 200_000
#: What all sampled pages weigh together, in fixed labelled pages. Rounds, pages of a step, its size, and the pull of weights to 0.
SAMPLE_WEIGHT, STEPS, BATCH, RATE, PULL = 12.0, 16, 10, 0.5, 0.004

#: Tag kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("head script style noscript template iframe object svg canvas audio video select option button textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second kind begins.
ENDED_BY = {
    "p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
#: Which elements end where an element begins.
ENDS = {tag: frozenset(k for k, ending in ENDED_BY.items() if tag in ending) for tag in BLOCK | {"option"}}
SCOPE = frozenset("table ul ol dl div article section main aside nav header footer form blockquote td th body".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile("[>\"']")
# a name begins behind what is no part of one, so that a long run without a sign is read once
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'<>/])([^\s=\"'<>/]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
_NAME_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?。！？…](?=\s|[\"'»”)\]]|$)")
#: Children that are alike in any text.
ALIKE = frozenset("p li tr td th dt dd tbody h1 h2 h3 h4 h5 h6 hr br".split())


class Node:
    """An element: its subtree's characters of text, those in links, its runs of text and sentence ends, the characters of its
    own runs, where its text begins and ends on the page, and how often its block children have a tag and names."""

    __slots__ = ("tag", "parent", "names", "mark", "n", "linked", "runs", "stops", "own", "begin", "end", "children")

    def __init__(self, tag, parent, names, mark):
        self.tag, self.parent, self.names, self.mark = tag, parent, names, mark
        self.n = self.linked = self.runs = self.stops = self.own = self.begin = self.end = 0
        self.children: dict[str, int] = {}


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of every tag in page order, comments and declarations with an empty name.

    A quote holds a value only behind an equals sign and if it is closed. A tag that nothing closes, and all behind it, is text; a comment
    that nothing closes goes on to the end. Nothing is searched twice: what is not to be found once is not there later either. The
    consumer may send a place at which to go on.
    """
    at, gone = 0, set()  # of the three marks those that occur no more

    def find(mark: str, start: int) -> int:
        k = -1 if mark in gone else source.find(mark, start)
        if k < 0:
            gone.add(mark)
        return k

    while (begin := source.find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(source)
            yield begin, at, "", False, ""
            continue
        declared = source[begin + 1 : begin + 2] in ("!", "?")
        closing = source.startswith("</", begin)
        name = None if declared else _NAME.match(source, begin + 1 + closing)
        if not declared and not name:
            at = begin + 1
            continue
        k = name.end() if name else begin + 2
        end = find(">", k)
        while name and end >= 0:  # the first sign that no value holds
            m = _MARK.search(source, k, end + 1)
            if m[0] == ">":
                break
            k = m.end()
            if source[max(name.end(), m.start() - 64) : m.start()].rstrip()[-1:] == "=":
                close = find(m[0], k)
                if close >= 0:
                    k = close + 1
                    if k > end:
                        end = find(">", k)
        if end < 0:
            return
        at = end + 1
        further = yield begin, at, name[0].lower() if name else "", closing, source[name.end() : end] if name else ""
        if further is not None:
            at = further
            yield 0, 0, "", False, ""  # what ``send`` returns


class _Open:
    """The open elements. Every scope element opens a count of its own, so that an end tag without a beginning in its scope is seen at once."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.scopes, self.all, self.hidden = nodes, [0], [{}], {}, 0

    def push(self, i: int) -> None:
        tag = self.nodes[i].tag
        self.stack.append(i)
        self.hidden += tag in HIDDEN
        self.all[tag] = self.all.get(tag, 0) + 1
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if tag in SCOPE:
            self.scopes.append({})

    def pop(self) -> None:
        tag = self.nodes[self.stack.pop()].tag
        self.hidden -= tag in HIDDEN
        self.all[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1

    def close(self, tag: str) -> None:
        """The end tag of the innermost open element of this tag; one of another kind than a scope does not reach beyond its scope."""
        if self.all.get(tag, 0) if tag in SCOPE else self.scopes[-1].get(tag, 0):
            while self.nodes[self.stack[-1]].tag != tag:
                self.pop()
            self.pop()

    def end_before(self, tag: str) -> None:
        """Ends the innermost element of the scope that cannot hold ``tag``."""
        if any(self.scopes[-1].get(t, 0) for t in ENDS.get(tag, ())):
            while tag not in ENDED_BY.get(self.nodes[self.stack[-1]].tag, ()):
                self.pop()
            self.pop()
        elif len(self.stack) > 1 and self.nodes[self.stack[-1]].tag in SCOPE and tag in ENDED_BY.get(self.nodes[self.stack[-1]].tag, ()):
            self.pop()


def parse(source: str | None):
    """(nodes, pieces): the elements in page order, each with the number of its parent, and the text between
    tags as (node, text, block number). Missing end tags are supplied, stray ones passed over; scripts,
    styles and other hidden elements' text is left out. Takes time in proportion to the page, whatever it holds."""
    root = Node("#root", -1, (), None)
    nodes, pieces, block, at = [root], [], 0, 0
    source = source or ""
    open_ = _Open(nodes)

    def text(raw):
        if not open_.hidden and raw:
            pieces.append((open_.stack[-1], html.unescape(raw), block))

    found = tags(source)
    for begin, end, tag, closing, rest in found:
        text(source[at:begin])
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            text(" ")
        if closing:
            open_.close(tag)
            continue
        open_.end_before(tag)
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        names = {w.lower() for key in ("class", "id", "role") if key in attributes for w in _NAME_WORD.findall(attributes[key])}
        parent = open_.stack[-1]
        nodes.append(Node(tag, parent, tuple(sorted(names)), attributes.get("data-content")))
        if tag in BLOCK:
            sign = " ".join((tag, *nodes[-1].names))
            nodes[parent].children[sign] = nodes[parent].children.get(sign, 0) + 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        open_.push(len(nodes) - 1)
        if tag in RAW:  # what stands in a script or style is no tag
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else len(source)
            found.send(at)
    text(source[at:])
    _measure(nodes, pieces)
    return nodes, pieces


def _measure(nodes: list[Node], pieces: list[tuple[int, str, int]]) -> None:
    """The subtrees' numbers: pieces go to their own nodes, and from the last node to the first each node adds to its parent."""
    at = 0
    for i, t, _ in pieces:
        n, node = len(t.strip()), nodes[i]
        if n:
            if not node.n:
                node.begin = at
            node.own += n
            node.n += n
            node.end = at + n
            node.runs += 1
            node.stops += len(_STOP.findall(t))
            at += n
    for node in reversed(nodes[1:]):
        if not node.n:
            continue
        if node.tag == "a":
            node.linked = node.n
        up = nodes[node.parent]
        up.begin, up.end = (min(up.begin, node.begin), max(up.end, node.end)) if up.n else (node.begin, node.end)
        up.n += node.n
        up.runs += node.runs
        up.stops += node.stops
        up.linked += node.linked

def _step(x: float, *bounds: float) -> int:
    """How many bounds ``x`` reaches."""
    return sum(x >= b for b in bounds)


def node_features(nodes: list[Node], i: int) -> tuple[str, ...]:
    """Names of the features that node ``i`` has. Inline elements have those of their tag and names only: they are as their parents."""
    node, total = nodes[i], max(1, nodes[0].n)
    out = [f"tag={node.tag}", *[f"name={w}" for w in node.names]]
    if node.tag not in BLOCK and node.parent >= 0:
        return tuple(out)
    if not node.n:
        return (*out, "amount=0")
    amount, links, mean = _step(node.n, 25, 100, 400), _step(node.linked / node.n, 0.25, 0.5, 0.75), _step(node.n / node.runs, 15, 45, 120)
    share = _step(node.n / total, 0.05, 0.2, 0.5, 0.8)
    out += [f"amount={amount}", f"links={links}", f"mean={mean}", f"own={_step(node.own, 1, 25, 100)}", f"share={share}"]
    out += [f"stops={_step(100 * node.stops / node.n, 0.2, 0.8, 2.0)}", f"from={_step(node.begin / total, 0.02, 0.3, 0.8)}", f"to={_step(node.end / total, 0.2, 0.7, 0.98)}", f"kind={amount}{links}{mean}"]
    out += [f"share={share} own={_step(node.own, 1, 25, 100)}", f"share={share} mean={mean}", f"tag={node.tag} share={share}", f"tag={node.tag} own={_step(node.own / total, 0.01, 0.3, 0.7, 0.95)}"]
    if node.parent >= 0:  # what stands around it: the parent's kind, and the children that bear the same tag and names
        above, bare = nodes[node.parent], int(not node.names)
        peers = _step(above.children.get(" ".join((node.tag, *node.names)), 0), 2, 4)
        out += [f"under={above.tag} bare={bare} links={links}", f"under={above.tag} bare={bare} tag={node.tag}", f"peers={peers} bare={bare} amount={amount} under={above.tag}", f"own={_step(node.own, 1, 25, 100)} bare={bare} links={links} under={above.tag}"]
    paragraphs = headings = alike = 0
    for sign, k in node.children.items():
        tag = sign.split(" ", 1)[0]
        paragraphs += k * (tag == "p")
        headings += k * (tag[0] == "h" and tag[1:].isdigit())
        if tag not in ALIKE:
            alike = max(alike, k)
    return (*out, f"paragraphs={_step(paragraphs, 1, 2, 4)}", f"headings={_step(headings, 1, 2)}", f"alike={_step(alike, 2, 3)}")


#: Labelled pages: data-content=1 marks content, data-content=0 what is not; an element without mark is as its parent.
#: What labelled pages are made of - containers of content, furniture around it, furniture inside it.
CONTAINERS = [
    "article", "main", "main>article", "section>article", "div class=content", "div id=content", "div class=article", "div class=article-body", "div class=post", "div class=post-content", "div class=entry", "div class=entry-content",
    "div class=story", "div class=story-body", "div id=main>div class=text", "div id=main-content", "div class=page>main", "div class=wrapper>article", "div class=container>div class=content", "div role=main", "td class=content", "paragraphs", "blocks", "text", "text", "plain",
]
AROUND = [
    "header", "nav", "footer", "aside", "form", "div class=header", "div id=header", "div class=site-header", "div class=topbar", "div class=masthead", "div class=logo", "div class=nav", "div class=navigation", "div class=navbar", "div class=menu", "ul class=menu", "ul class=nav",
    "div class=breadcrumbs", "div class=footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "div class=recommended", "div class=popular", "div class=trending", "div class=ad", "div class=ads",
    "div class=advert", "div class=advertisement", "div class=banner", "div class=promo", "div class=sponsored", "div class=cookie", "div class=cookie-banner", "div id=cookie-consent", "div class=notice", "div class=alert", "div class=popup", "div class=modal", "div class=newsletter",
    "div class=subscribe", "div class=signup", "div class=login", "div class=search", "div class=share", "div class=social", "div id=comments", "div class=comments", "div class=comment-list", "section class=comments", "section id=comments", "div class=comment", "div class=replies", "div class=reply",
    "div id=disqus", "div class=discussion", "div class=pagination", "div class=pager", "div class=tags", "div role=navigation", "div role=banner", "div role=contentinfo", "div role=complementary",
    "td class=menu", "td class=nav", "td class=sidebar", "td class=links",
]
INSIDE = [
    "aside", "nav", "form", "footer", "div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "div class=banner", "div class=notice", "div class=related", "div class=share", "div class=social", "div class=newsletter", "div class=subscribe", "div class=comments", "section class=comments",
    "div class=comment", "div class=sidebar", "div class=pagination", "div class=cookie-notice",
]


class _Writer:
    """Makes labelled pages by chance from those parts."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rnd.choice("aeioubdklmnrst") for _ in range(self.rnd.randint(2, 8)))

    def words(self, lo: int, hi: int) -> str:
        """A sentence or several."""
        n, out = self.rnd.randint(lo, hi), []
        while n > 0:
            k = min(n, self.rnd.randint(4, 14))
            out.append(" ".join(self.word() for _ in range(k)).capitalize() + ("." if k > 3 or self.rnd.random() < 0.3 else ""))
            n -= k
        return " ".join(out)

    def named(self, kind: str, blind: bool) -> str:
        """The part as it is listed, or with names that mean nothing."""
        if not blind or "=" not in kind:
            return kind
        return kind.split()[0] + (f' class="{self.word()}{self.rnd.choice(["", "-" + self.word()])}"' if self.rnd.random() < 0.8 else "")

    def inline(self, lo: int, hi: int) -> str:
        t, tag = self.words(lo, hi), self.rnd.choice(["a href=/x", "b", "i", "em", "strong", "span", "code", "sup", "", "", "", "", ""])
        if tag:
            return f"{t} <{tag}>{self.words(1, 3)}</{tag.split()[0]}> {self.words(1, 5)}"
        return t + self.rnd.choice(["", "", "", "<br>" + self.words(1, 9)])

    def links(self, lo: int, hi: int, longest: int = 3) -> list[str]:
        return [f"<a href=/x>{self.words(1, longest)}</a>" for _ in range(self.rnd.randint(lo, hi))]

    def comments(self, kind: str) -> str:
        """A list of replies, each with a name, a date and a short text."""
        one = self.rnd.choice(["div", "li", "article", "section"])
        name = self.rnd.choice(["", f" class={self.word()}"])
        head = lambda: self.rnd.choice([f"<b>{self.word()}</b>", f"<a href=/u>{self.word()}</a>", f"<span>{self.word()}</span> <time>2020</time>", f"<p>{self.word()}</p>"])
        said = lambda: self.rnd.choice([f"{head()}<p>{self.words(2, 25)}</p>", f"<p>{self.words(2, 25)}</p>", self.words(2, 15)])
        rows = "".join(f"<{one}{name}>{said()}{self.rnd.choice(['', '<a href=/r>' + self.word() + '</a>'])}</{one}>" for _ in range(self.rnd.choice([1, 1, 2, 3, 5, 7])))
        if one == "li":
            rows = self.rnd.choice(["<ol>{}</ol>", "<ul>{}</ul>"]).format(rows)
        title = self.rnd.choice(["", f"<h{self.rnd.randint(2, 4)}>{self.rnd.choice(['', '3 '])}{self.words(1, 3)}</h3>"])
        return f"<{kind} data-content=0>{title}{rows}</{kind.split()[0]}>"

    def furniture(self, kind: str) -> str:
        """What is not content: link lists, short notes, forms, now and then sentences."""
        parts = [
            lambda: f"<p>{self.inline(2, 18)}</p>",
            lambda: self.words(2, 12),
            lambda: f"<ul>{''.join(f'<li>{a}</li>' for a in self.links(1, 8))}</ul>",
            lambda: " ".join(self.links(1, 6)),
            lambda: f"<h{self.rnd.randint(2, 4)}>{self.words(1, 3)}</h3>",
            lambda: f"<div>{self.words(2, 15)}</div>",
            lambda: f"<input name=q><button>{self.words(1, 2)}</button> {self.words(1, 4)}",
            lambda: f"&copy; 2020 {self.words(1, 6)}",
        ]
        inner = "".join(self.rnd.choice(parts)() for _ in range(self.rnd.randint(1, 3)))
        return f"<{kind} data-content=0>{inner}</{kind.split()[0]}>"

    def block(self) -> str:
        """A block of content."""
        k = self.rnd.random()
        if k < 0.08:
            return f"<p>{self.rnd.choice([self.words(1, 5), self.word() + ' &lt; ' + self.word(), ' '.join(self.word() for _ in range(self.rnd.randint(2, 7)))])}</p>"
        if k < 0.6:
            return f"<p>{self.inline(1, 70)}</p>"
        if k < 0.67:
            return f"<h{self.rnd.randint(2, 4)}>{self.words(1, 5)}</h2>"
        if k < 0.73:
            return f"<ul>{''.join(f'<li>{self.inline(1, 12)}</li>' for _ in range(self.rnd.randint(1, 4)))}</ul>"
        if k < 0.76:
            return f"<ol>{''.join(f'<li>{self.words(1, 12)}</li>' for _ in range(self.rnd.randint(1, 4)))}</ol>"
        if k < 0.8:
            return f"<blockquote><p>{self.words(3, 30)}</p></blockquote>"
        if k < 0.84:
            return f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>"
        if k < 0.88:
            return f"<div>{self.inline(5, 40)}</div>"
        if k < 0.92:
            return f"<section><h2>{self.words(1, 4)}</h2><p>{self.inline(5, 40)}</p></section>"
        if k < 0.95:
            return f"<figure><img src=x><figcaption>{self.words(2, 8)}</figcaption></figure>"
        if k < 0.97:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<dl><dt>{self.words(1, 2)}</dt><dd>{self.words(2, 9)}</dd></dl>"

    def content(self, blind: bool) -> str:
        """Blocks of content, or runs of text, with furniture between them."""
        if self.rnd.random() < 0.15:
            return self.rnd.choice(["<br>", "<br><br>", " "]).join(self.rnd.choice([self.words, self.inline])(5, 60) for _ in range(self.rnd.randint(1, 4)))
        if self.rnd.random() < 0.08:
            return f"<p>{self.inline(3, 40)}</p>"
        out = [f"<h{self.rnd.choice('1112')}>{self.words(1, 8)}</h1>"] if self.rnd.random() < 0.8 else []
        if out and self.rnd.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(self.rnd.randint(0 if out else 1, 8)):
            if self.rnd.random() < 0.14:
                links = self.links(1, 4, 6)
                out.append(self.rnd.choice([f"<p>{links[0]}</p>", f"<ul>{''.join(f'<li>{a}</li>' for a in links)}</ul>"]))
            else:
                out.append(self.block())
        for _ in range(self.rnd.choice([0, 1, 1, 2])):
            out.insert(self.rnd.randint(0, len(out)), self.furniture(self.named(self.rnd.choice(INSIDE), blind)))
        if self.rnd.random() < 0.2:
            out.append(self.comments(self.named(self.rnd.choice(["div class=comments", "section class=comments", "ol class=comment-list"]), blind)))
        return "".join(out)

    def page(self, container: str, blind: bool) -> str:
        rnd = self.rnd
        around = [self.furniture(self.named(rnd.choice(AROUND), blind)) for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 5, 6, 7]))]
        if rnd.random() < 0.25:
            around.append(self.comments(self.named("div id=comments", blind)))
        cut = rnd.randint(0, max(0, len(around) - 1))
        before, behind = "".join(around[:cut]), "".join(around[cut:])
        *outer, box = container.split(">")
        if box in ("paragraphs", "blocks", "text"):
            if rnd.random() < 0.5:  # nothing but content
                before = behind = ""
            longest = rnd.choice([4, 15, 60])
            if box != "text":  # blocks of content directly in the body, or in no element at all, the first and the last of them short at times
                one, n = "p" if box == "paragraphs" else "div", rnd.randint(1, 5)
                ends = rnd.choice([(0,), (n - 1,), (0, n - 1), ()])
                inner = "".join(f"<{one} data-content=1>{self.words(1, 4) if i in ends else self.inline(1, longest)}</{one}>" for i in range(n))
                head, end = rnd.choice([("<html><body>", "</body></html>"), ("", "")])
            else:  # text directly in the body
                inner = rnd.choice(["<br>", "<br><br>", " "]).join(rnd.choice([self.words, self.inline])(1, longest) for _ in range(rnd.randint(1, 5)))
                head, end = "<html><body data-content=1>", "</body></html>"
            return f"{head}{before}{inner}{behind}{end}"
        if box == "plain":  # text without any element, or with inline ones only
            return "\n".join(rnd.choice([self.words, self.inline])(5, 60) for _ in range(rnd.randint(1, 4)))
        top = "".join(f"<{self.named(o, blind)} data-content={int(o == 'main')}>" for o in outer)
        bottom = "".join(f"</{o.split()[0]}>" for o in reversed(outer))
        side = self.furniture(self.named(rnd.choice(AROUND), blind)) if outer and rnd.random() < 0.5 else ""
        if rnd.random() < 0.1:
            before = behind = ""
        head, end = rnd.choice([("<html><body>", "</body></html>")] * 5 + [("<body>", "</body>"), ("", "")])
        return f"{head}{before}{top}<{self.named(box, blind)} data-content=1>{self.content(blind)}</{box.split()[0]}>{side}{bottom}{behind}{end}"


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Labelled pages: data-content=1 marks content, 0 what is not; an element without mark is as its parent. Every other one has
    names that mean nothing. A page without elements but inline ones is content."""
    writer = _Writer(seed)
    return [writer.page(CONTAINERS[i // 2 % len(CONTAINERS)], i % 2 == 1) for i in range(n)]


class Potentials:
    """Log potentials: ``node[feature]`` for content against not, and ``edge[child is a block, parent content, child content]``."""

    def __init__(self, node: dict[str, float], edge: np.ndarray):
        self.node, self.edge = node, edge

    def beliefs(self, nodes: list[Node], features: list[tuple[str, ...]]):
        """Log beliefs of all nodes, those of the upward pass alone, and the messages to the parents."""
        n, get = len(nodes), self.node.get
        own = [[0.0, sum([get(f, 0.0) for f in fs])] for fs in features]
        edges = self.edge.tolist()
        up: list = [None] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            b0, b1 = own[i]
            (e00, e01), (e10, e11) = edges[nodes[i].tag in BLOCK]
            m = up[i] = (_add(e00 + b0, e01 + b1), _add(e10 + b0, e11 + b1))
            p = own[nodes[i].parent]
            p[0] += m[0]
            p[1] += m[1]
        full = [own[0]] + [None] * (n - 1)
        for i in range(1, n):
            p, (m0, m1), (b0, b1) = full[nodes[i].parent], up[i], own[i]
            q0, q1 = p[0] - m0, p[1] - m1
            (e00, e01), (e10, e11) = edges[nodes[i].tag in BLOCK]
            b0, b1 = b0 + _add(e00 + q0, e10 + q1), b1 + _add(e01 + q0, e11 + q1)
            full[i] = [b0 - max(b0, b1), b1 - max(b0, b1)]
        return full, own, up

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node."""
        full, _, _ = self.beliefs(nodes, [node_features(nodes, i) for i in range(len(nodes))])
        return [1 / (1 + math.exp(min(max(b0 - b1, -50.0), 50.0))) for b0, b1 in full]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _labels(nodes: list[Node]) -> list[int]:
    """Labels by the marks of a labelled page."""
    out = [0] * len(nodes)
    out[0] = int(all(n.tag not in BLOCK and n.tag != "html" for n in nodes[1:]))
    for i in range(1, len(nodes)):
        out[i] = int(nodes[i].mark) if nodes[i].mark in ("0", "1") else out[nodes[i].parent]
    return out


def _article_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page with exactly one article element; None for others."""
    if sum(n.tag == "article" for n in nodes) != 1:
        return None
    out = [0] * len(nodes)
    for i in range(1, len(nodes)):
        n = nodes[i]
        out[i] = int((n.tag == "article" or out[n.parent]) and n.tag not in HIDDEN and n.tag not in ("nav", "aside", "footer", "form"))
    return out


def fit(pages: list[tuple[list[Node], list[int], float]]) -> Potentials:
    """Potentials by adaptive gradient steps on the log likelihood of the labels; ``pages`` are (nodes, labels, weight)."""
    featured = [[node_features(nodes, i) for i in range(len(nodes))] for nodes, _, _ in pages]
    model = Potentials({}, np.zeros((2, 2, 2)))
    seen: dict[str, float] = {}
    seen_edge = np.full((2, 2, 2), 1e-2)
    rnd = random.Random(3)
    for _ in range(STEPS):
        order = list(range(len(pages)))
        rnd.shuffle(order)
        for lo in range(0, len(order), BATCH):
            grad, edge_grad = {}, -PULL * model.edge
            for k in order[lo : lo + BATCH]:
                (nodes, labels, weight), features = pages[k], featured[k]
                full, own, up = model.beliefs(nodes, features)
                for i in range(len(nodes)):
                    b0, b1 = full[i]
                    off = weight * (labels[i] - 1 / (1 + math.exp(min(max(b0 - b1, -50.0), 50.0))))
                    for f in features[i]:
                        grad[f] = grad.get(f, 0.0) + off
                    if not i:
                        continue
                    p, kind = full[nodes[i].parent], int(nodes[i].tag in BLOCK)
                    edge = model.edge[kind]
                    pair = [[p[a] - up[i][a] + edge[a, c] + own[i][c] for c in (0, 1)] for a in (0, 1)]
                    top = max(max(pair[0]), max(pair[1]))
                    pair = np.array([[math.exp(x - top) for x in row] for row in pair])
                    edge_grad[kind] -= weight * pair / pair.sum()
                    edge_grad[kind, labels[nodes[i].parent], labels[i]] += weight
            for f, g in grad.items():
                g -= PULL * model.node.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + g * g
                model.node[f] = model.node.get(f, 0.0) + RATE * g / seen[f] ** 0.5
            seen_edge += edge_grad**2
            model.edge = model.edge + RATE * edge_grad / np.sqrt(seen_edge)
    return model


def train(pages: DataFrame, html_col: str = "html", most_pages: int = MOST_PAGES) -> Potentials:
    """Potentials from the fixed labelled pages and about ``most_pages`` of ``pages``, taken by a hash of their html."""
    rows = pages.filter(F.length(html_col) <= LONGEST_SAMPLE).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("page"))
    total = rows.count()
    sample = rows.filter(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * most_pages / total)) if total > most_pages else rows
    sampled = [(nodes, labels) for r in sorted(sample.distinct().collect()) for nodes in [parse(r.page)[0]] for labels in [_article_labels(nodes)] if labels]
    fixed = [(nodes, _labels(nodes), 1.0) for nodes in (parse(p)[0] for p in labelled_pages())]
    return fit(fixed + [(n, labels, SAMPLE_WEIGHT / len(sampled)) for n, labels in sampled])


def main_text(source: str | None, model: Potentials) -> str:
    """Blocks of content text in page order, white space inside one space, joined by one space."""
    nodes, pieces = parse(source)
    if not pieces:
        return ""
    content = model.marginals(nodes)
    out, last, parts = [], None, []
    for i, t, block in pieces:
        if content[i] <= 0.5:
            continue
        if block != last and parts:
            out.append("".join(parts))
            parts = []
        last = block
        parts.append(t)
    out.append("".join(parts))
    return " ".join(x for x in (_SPACE.sub(" ", b).strip() for b in out) if x)


def extract(pages: DataFrame, model: Potentials, html_col: str = "html", passed: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``passed``) with ``text`` and ``n_chars`` (its code points).

    Null and empty html and pages without content give an empty text. Whole pages are read; text in a block
    has its character references decoded and every run of white space made one space. Rows are independent:
    repeated rows repeat, an empty table stays empty. Columns named like the two results, in any case, are replaced;
    other names cannot clash.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.node, model.edge))
    keep = others(passed if passed is not None else pages.columns, ("text", "n_chars"))
    data = pages.select(carried(keep).alias("row"), field(html_col).alias("html"))

    def run(batches):
        own = Potentials(*shared.value)
        for batch in batches:
            got = [main_text(h.as_py(), own) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["row", "text", "n_chars"])

    found = data.mapInArrow(run, data.select("row").schema.add("text", "string").add("n_chars", "long"))
    return found.select(*(["row.*"] if keep else []), "text", "n_chars")
