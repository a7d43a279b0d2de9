"""Main text of web pages by wrapper inference for each host.

A page is read as a stream of tags and texts; block elements, labelled by name, class and id, make its
skeleton. Pages of a host are aligned one after another into a wrapper, a regular expression without
unions: an element that only some pages have becomes optional, one that occurs again beside itself
becomes repeated, labels that come back after others are put into one repeated group. Texts are kept as
hashes: what all pages with the element have is a constant of the template, if these are half of the host's
pages (and EVIDENCE or more), the rest are slots. A label occurs once among the children of a wrapper node, so a wrapper is bounded by the variety of
the templates, not by the pages. Wrappers also count the pages and characters of a text.

The article is what is marked as an article, else the lowest element that all slots are in, without the
constants inside it. Hosts of fewer pages tell no slots; there it is the element with nearly all of the text
that no heading or paragraph is beside. Menus, adverts and the like are recognised by element, role, or
words of class and id, as far as the wrapper does not put the article inside of them: what holds the only
articles, or nearly all text with headings, menus and the like inside, is the layout and stays open.

Wrappers are merged inside each task, then by host and salt, then by host; hosts with many pages send
one small wrapper for each task. What an element is, is part of its label, and all counts, constants and
marks of a wrapper are the same in whatever order pages are merged. Defined cases: null html and pages without text give empty text; a
null url belongs to the host ''; a page that its wrapper's article is missing from is judged alone;
very long pages stay whole; repeated rows each keep a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch, slices, small_batches, table

#: Element names of the HTML standard by their role here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title xmp noembed noframes object canvas audio video".split())
CHROME = frozenset("nav header footer aside form button select dialog menu search head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar status".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead footer header cookie cookies consent gdpr notice notices alert comment comments disqus replies share sharing social related recommended popup modal overlay newsletter subscribe signup login search pagination pager toolbar widget".split()
)
#: Parts of a class name that make it tell of something beside or below the element, not of the element.
BESIDE_WORDS = frozenset("has with without no not is layout template theme".split())
#: Elements of which classes and ids tell nothing: they are the page, or its text.
OPEN = frozenset("html body main article".split())
#: Elements that only the layout of a page has around others.
LAYOUT = frozenset("h1 main article nav header footer aside".split())
ARTICLE_WORDS = frozenset("article articlebody articletext maintext mainarticle story storybody".split())
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: Elements whose inside is separate from what is open around them.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "head": set()}
#: Hosts whose wrappers a task holds before it passes them on.
MAX_HOSTS = 2000
#: Pages that must have a text before it counts as a constant: two may just be copies.
EVIDENCE = 3
#: Deeper elements are opened and closed as others, but what is in them is read as part of the one above, except for chrome and articles.
MAX_DEPTH = 150
SALTS = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("name", "label", "chrome", "article", "hidden", "kids")

    def __init__(self, name: str, label: str, chrome: bool = False, article: bool = False, hidden: bool = False):
        # kids: nodes and texts in page order
        self.name, self.label, self.chrome, self.article, self.hidden, self.kids = name, label, chrome, article, hidden, []


def _is_chrome(mark: str) -> bool:
    """Whether a class or id names a part of the page that is not the article: by its first or last word."""
    words = _WORDS.findall(_CAMEL.sub(" ", mark).lower())
    return bool(words) and (words[0] in CHROME_WORDS or words[-1] in CHROME_WORDS) and not any(w in BESIDE_WORDS for w in words)


def _open(name: str, attributes: str) -> Node:
    label, chrome, article, hidden = name, name in CHROME, name == "article", False
    if attributes and attributes.strip(" /"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        marks = " ".join(html.unescape(found[k]) for k in ("class", "id") if found.get(k))
        if marks:
            label = f"{name}.{' '.join(sorted(set(_DIGITS.sub('0', marks).split())))}"
            if name not in OPEN:
                chrome |= any(map(_is_chrome, marks.split()))
            article |= any(w in ARTICLE_WORDS for w in _WORDS.findall(_CAMEL.sub(" ", marks).lower()))
        # what the label does not tell so far is added to it
        role = found.get("role", "").lower()
        if role in CHROME_ROLES and not chrome and name not in OPEN:
            chrome, label = True, f"{label}!"
        if (role == "article" or found.get("itemprop", "").lower() == "articlebody") and not article:
            article, label = True, f"{label}*"
        if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
            chrome, hidden, label = True, True, f"{label}~"
    return Node(name, label, chrome, article, hidden)


def parse(page: str) -> Node:
    """Block elements and the text between them; inline elements leave their text where it is."""
    root = Node("", "")
    stack, at = [root], 0
    opened: Counter = Counter()

    def close(i: int) -> None:
        for node in stack[i:]:
            opened[node.name] -= 1
        if len(stack) > MAX_DEPTH and i > 0 and stack[-1].kids is stack[i - 1].kids:
            stack[i - 1].kids.append(Node(stack[i].name, stack[i].label))  # what follows is a block of its own
        del stack[i:]

    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].kids.append(text)
        if not found:
            return root
        at = found.end()
        end, name = found[1], (found[2] or "").lower()
        if not name:
            continue
        if end:
            if name in BLOCKS and opened[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
        elif name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if not found[3].rstrip().endswith("/") or stop and name in ("script", "style", "title", "textarea"):
                at = stop.end() if stop else len(page)
        elif name == "br" or name == "wbr":
            stack[-1].kids.append(" " if name == "br" else "")
        elif name in BLOCKS:
            closing = True
            while closing:
                closing = False
                for i in range(len(stack) - 1, 0, -1):
                    own = stack[i].name
                    if own == "p" or name in CLOSED_BY.get(own, ()):
                        close(i)
                        closing = True
                        break
                    if own in SCOPES.get(name, ()) or own not in CLOSED_BY and own not in ("tbody", "thead", "tfoot"):
                        break
            node = _open(name, found[3])
            stack[-1].kids.append(node)
            if name not in VOID:
                if len(stack) >= MAX_DEPTH:
                    deep = stack[MAX_DEPTH:]
                    apart = (node.chrome or node.article and not any(x.article for x in deep)) and not any(x.chrome for x in deep)
                    if not apart:
                        # open as any other, so that ends match their own starts, but its inside is that of the one above
                        node = Node(node.name, node.label)
                        node.kids = stack[-1].kids
                stack.append(node)
                opened[name] += 1


def _own(node: Node) -> str:
    """A hash of the element's own text, without that of blocks inside; empty if it has none."""
    text = " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if text else ""


def skeleton(node: Node) -> dict:
    """The wrapper of one page. kids: label -> [wrapper, optional, repeated, group]; repeated: beside itself; group: it, or one before it, came back after others."""
    chars, own = sum(len(k.strip()) for k in node.kids if isinstance(k, str)), _own(node)
    out = {"n": 1, "chars": chars, "texts": [own] if own else [], "slot": False, "chrome": node.chrome, "article": node.article, "hidden": node.hidden, "name": node.name, "kids": {}}
    kids, last, times = out["kids"], None, Counter()
    for kid in node.kids:
        if isinstance(kid, str):
            continue
        own = skeleton(kid)
        held = kids.get(kid.label)
        if held is None:
            kids[kid.label] = [own, False, False, False]
        else:
            _merge(held[0], own, True)
            if last == kid.label:
                held[2] = True
            elif not held[3] or not kids[last][3]:
                labels = list(kids)
                for label in labels[labels.index(kid.label) :]:
                    kids[label][3] = True
        times[kid.label] += last != kid.label
        last = kid.label
    for label, held in kids.items():
        held[1] |= held[3] and times[label] < max(times.values())
    return out


def _merge(a: dict, b: dict, page: bool = False) -> None:
    """Align b's children with a's and put b into a: another page's, or what comes later on the same page.

    Texts of one page are put together; of pages, what all have is constant, and anything else makes a slot.
    """
    kids = {}
    order, rest = list(a["kids"]), list(b["kids"])
    at = 0
    for label in rest:
        if label in a["kids"]:
            # what a has before it and b has not yet passed comes first, and is optional if b lacks it
            while at < len(order) and order[at] != label and label not in kids:
                kids.setdefault(order[at], a["kids"][order[at]])
                at += 1
            kids.setdefault(label, a["kids"][label])
        else:
            kids[label] = [b["kids"][label][0], True, *b["kids"][label][2:]]
    for label in order:
        kids.setdefault(label, a["kids"][label])
    for label, held in a["kids"].items():
        other = b["kids"].get(label)
        if other is None:
            held[1] = True
        else:
            _merge(held[0], other[0], page)
            held[1] |= other[1]
            held[2] |= other[2]
            held[3] |= other[3]
    if page:
        a["texts"] = sorted({*a["texts"], *b["texts"]})
    else:
        a["n"] += b["n"]
        a["slot"] |= b["slot"] or a["texts"] != b["texts"]
        a["texts"] = sorted({*a["texts"]} & {*b["texts"]})
    a["chars"] += b["chars"]
    a["kids"] = kids


def _least(wrapper: dict) -> int:
    """Pages of the host that must have an element for its text to be a constant: half of them, and EVIDENCE."""
    return max(EVIDENCE, -(-wrapper["n"] // 2))


def _varies(wrapper: dict, least: int = EVIDENCE) -> bool:
    """Whether its own text is a slot: it differs between pages, or too few have it."""
    return bool(wrapper["chars"]) and (wrapper["slot"] or wrapper["n"] < least)


def expression(wrapper: dict, label: str = "") -> str:
    """The wrapper as a union-free regular expression; # is a slot, = a constant text."""
    inner, group = ("#" if _varies(wrapper) else "=" if wrapper["chars"] else ""), False
    for x, (k, o, r, g) in wrapper["kids"].items():
        if g != group:
            inner, group = inner + ("(" if g else ")+"), g
        inner += expression(k, x) + ("*" if o and r else "?" if o else "+" if r else "")
    inner += ")+" if group else ""
    return f"(<{label}>{inner}</>)" if label else inner


def _mass(wrapper: dict, least: int = 0) -> int:
    """Characters outside of chrome; with the least pages of a constant given, those of slots only."""
    return 0 if wrapper["chrome"] else (wrapper["chars"] if not least or _varies(wrapper, least) else 0) + sum(_mass(k[0], least) for k in wrapper["kids"].values())


def _prose(wrapper: dict) -> bool:
    """Whether there is a heading or a paragraph with text outside of chrome."""
    return not wrapper["chrome"] and (bool(re.fullmatch("h[1-6]|p", wrapper["name"])) and _mass(wrapper) > 0 or any(_prose(k[0]) for k in wrapper["kids"].values()))


def _all(wrapper: dict) -> int:
    """Characters, those of chrome too."""
    return 0 if wrapper["hidden"] else wrapper["chars"] + sum(_all(k[0]) for k in wrapper["kids"].values())


def _laid_out(wrapper: dict) -> bool:
    """Whether the element holds others that only the layout of a page does."""
    return any(k["name"] in LAYOUT or _laid_out(k) for k, *_ in wrapper["kids"].values())


Path = tuple[str, ...]


def _marked(wrapper: dict, wanted) -> dict[Path, int]:
    """Label paths of the elements that are wanted, and their characters. Those in chrome count where there are no others and they have most of the text."""
    open_: dict[Path, int] = {}
    closed: dict[Path, int] = {}

    def look(at: dict, path: Path, out: dict[Path, int]) -> None:
        for label, (kid, *_) in at["kids"].items():
            own = path + (label,)
            if kid["hidden"]:
                continue
            if wanted(kid) and not kid["chrome"]:
                out[own] = _mass(kid)
            else:
                look(kid, own, closed if kid["chrome"] else out)

    look(wrapper, (), open_)
    if any(open_.values()):
        return {p: n for p, n in open_.items() if n}
    return {p: n for p, n in closed.items() if n} if 2 * sum(closed.values()) > _all(wrapper) else {}


def article(wrapper: dict) -> tuple[list[Path], dict[Path, frozenset[str]], frozenset[Path]]:
    """Label paths of the elements that hold the article; by path the texts inside that the template has on every page; paths of chrome that stays open."""
    marked = _marked(wrapper, lambda kid: kid["article"])
    if marked:
        return list(marked), {}, frozenset()
    opened: set[Path] = set()
    every = _all(wrapper)

    def reopen(at: dict, path: Path) -> None:
        for label, (kid, *_) in at["kids"].items():
            if not kid["hidden"] and _all(kid) > 0.8 * every:
                if kid["chrome"] and _laid_out(kid):
                    kid["chrome"] = False
                    opened.add(path + (label,))
                reopen(kid, path + (label,))

    mains = _marked(wrapper, lambda kid: kid["name"] == "main")
    path, at = max(mains, key=lambda p: (mains[p], p)) if mains else (), wrapper
    if not mains:
        reopen(wrapper, ())
    for label in path:
        at = at["kids"][label][0]
    least = _least(wrapper)
    slots = _mass(at, least) > 0  # pages that are all the same have none
    few = wrapper["n"] < EVIDENCE

    def holds_all(at: dict, label: str) -> bool:
        """All slots are in the child; where too few pages tell slots, nearly all text, and no heading or paragraph is beside it."""
        total, own = (_mass(x, least if slots else 0) for x in (at, at["kids"][label][0]))
        return total > 0 and (own == total or few and own > 0.8 * total and not any(_prose(k[0]) for x, k in at["kids"].items() if x != label))

    while True:
        step = next((x for x, (k, _, r, g) in at["kids"].items() if not k["chrome"] and not r and not g and k["name"] in ("html", "body", "div", "section", "main", "center", "td", "tr", "table", "tbody", "form") and holds_all(at, x)), None)
        if step is None:
            break
        path, at = path + (step,), at["kids"][step][0]
    fixed: dict[Path, frozenset[str]] = {}

    def look_fixed(at: dict, path: Path) -> None:
        if at["texts"] and at["n"] >= least:
            fixed[path] = frozenset(at["texts"])
        for label, (kid, *_) in at["kids"].items():
            if not kid["chrome"]:
                look_fixed(kid, path + (label,))

    if slots:
        look_fixed(at, path)
    return [path], fixed, frozenset(opened)


def _nodes(node: Node, path: tuple[str, ...]) -> Iterator[Node]:
    if not path:
        yield node
        return
    for kid in node.kids:
        if isinstance(kid, Node) and kid.label == path[0]:
            yield from _nodes(kid, path[1:])


def _blocks(node: Node, out: list[list[str]], path: Path, fixed: dict[Path, frozenset[str]], opened: frozenset[Path]) -> None:
    out.append([])
    constant = path in fixed and _own(node) in fixed[path]
    for kid in node.kids:
        if isinstance(kid, str):
            if not constant:
                out[-1].append(html.unescape(kid))
            continue
        own = path + (kid.label,) if fixed or opened else ()
        if not kid.chrome or own in opened:
            _blocks(kid, out, own, fixed, opened)
        elif kid.name == "header" and node.article:
            # the heading of the article itself
            for head in kid.kids:
                if isinstance(head, Node) and re.fullmatch("h[1-6]", head.name) and not head.chrome:
                    _blocks(head, out, (), {}, frozenset())
        out.append([])


def extract(page: str | None, paths: list[Path] | None, fixed: dict[Path, frozenset[str]] | None = None, opened: frozenset[Path] = frozenset()) -> str:
    root = parse(page or "")
    found = [n for p in paths or () for n in _nodes(root, p)]
    start, fixed = paths[0] if len(paths or ()) == 1 else (), fixed or {}
    if not found:
        paths, _, opened = article(skeleton(root))
        start, fixed = paths[0] if len(paths) == 1 else (), {}
        found = [n for p in paths for n in _nodes(root, p)]
    if len(paths) > 1:
        order: dict[int, int] = {}

        def number(node: Node) -> None:
            order[id(node)] = len(order)
            for kid in node.kids:
                if isinstance(kid, Node):
                    number(kid)

        number(root)
        found.sort(key=lambda n: order[id(n)])
    blocks: list[list[str]] = []
    for node in found:
        _blocks(node, blocks, start, fixed, opened)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (host, html) -> host, wrapper (JSON)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(w)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["host", "wrapper"])

        for batch in slices(batches, "html"):
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = skeleton(parse(page or ""))
                if name in held:
                    _merge(held[name], own)
                else:
                    held[name] = own
            if len(held) > MAX_HOSTS:
                yield out()
        yield out()

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        wrappers = [json.loads(x) for x in sorted(group["wrapper"])]
        for other in wrappers[1:]:
            _merge(wrappers[0], other)
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(wrappers[0])]})

    made = pages.select("host", "html").mapInArrow(learn, "host string, wrapper string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = made.groupBy("host", "salt").applyInPandas(unite, "host string, wrapper string")
    return scratch.save(salted.groupBy("host").applyInPandas(unite, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    pages = small_batches(pages).select("page_id", "url", "html", host().alias("host"))
    wrappers = infer(pages, scratch)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in slices(batches, "html"):
            texts = []
            for name, wrapper, page in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if name not in known:
                    if len(known) > MAX_HOSTS:
                        known.clear()
                    known[name] = article(json.loads(wrapper))
                texts.append(extract(page, *known[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(wrappers, "host").select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), Scratch(spark, "wrappers"))
