"""Operator 9: main text of web pages by union-free wrappers inferred for each host.

Pages of a host come from one template. A wrapper is a regular expression without unions over
nested token streams: tags, fixed texts, text slots, optional groups and repeated groups. It
starts as one page and is aligned with others in turn, level by level, each level being the stream
of tokens between an element's two tags: neighbours of one shape fold into a
repeated group, tags that only one side has become optional, and texts that differ become slots.
Elements nested deeper than ``DEEP`` are not learnt, but read as part of their page.

The wrapper decides where the article is: the region that holds most of the host's changing text,
that is of the characters in slots outside of links, over all its pages; a heading beside that region
belongs to it. It also decides which texts go from within the region: those that are fixed for the
host, as long as they aren't most of it. Names only break ties: elements named as the article (tags and
roles, then words in a class) say how far up the region reaches and settle it where pages are few
or no region holds most; elements named as something else, by tag, role or word, are left out where the
wrapper sees changing text and so can't tell an advert from a paragraph. A form, or a word inside a longer
class name, doesn't count against an element that is or holds the article. Each page is
then read whole along its host's wrapper; what the wrapper does not know, such as the end of a
page that breaks off, is judged by its own tags.

A wrapper rests on every different page of its host: each task aligns the pages it reads, and the
partial wrappers of a host are then merged, those of a large host in two rounds. Copies of a page
count once; ids and hashes are shuffled to tell them apart, pages are not.

Results for odd input: null and empty html, and pages without an article's text, give the empty
text; unclosed and stray tags are closed or ignored as browsers do; a null or unusable url counts as
one more host; repeated ids and rows are kept; an empty table gives no rows; other columns are
ignored. A line break (br) counts as white space inside its block.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import store

#: Different pages that must agree before a text counts as the template's.
AGREE = 3
#: Hosts whose partial wrappers a task holds at once.
HOSTS = 1000
#: Tasks whose partial wrappers of a host are merged together in the first round.
TASKS = 32
#: Wrappers' bytes that are sent to every task; above this they meet their pages by a shuffle, in which a host has ``SALTS`` keys.
SEND, SALTS = 64 << 20, 16
#: The share of the changing text that makes a region the article.
MOST = 0.6
#: Elements nested deeper than this are read, but not learnt.
DEEP = 120
#: Why an element is dropped: by its kind; by a whole word of its class or id; by a part of one, or as a form.
HARD, NAMED, MIXED = 3, 2, 1

# Names of HTML elements and the words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html option td th tr tbody thead tfoot caption legend button".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
DROPPED = frozenset(
    "script style noscript template nav aside footer form iframe svg button select textarea dialog menu canvas object audio video head "
    "title noembed noframes math datalist search xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner cookie cookies "
    "consent gdpr notice notices alert alerts comment comments commentlist discussion disqus respond reply replies sidebar sidebars "
    "widget widgets nav navbar navigation navi breadcrumb breadcrumbs footer menu menus share sharing social related recommended "
    "newsletter subscribe signup login popup modal overlay pagination pager toolbar masthead topbar skip disclaimer".split()
)
HEADERS = frozenset("header headers".split())
#: Elements that never hold text to read.
TECHNICAL = frozenset("script style noscript template iframe svg canvas object audio video head title noembed noframes math datalist xmp".split())
CONTENT = frozenset("article content post entry story main maincontent articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>?))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85   -     　]+")


class Node:
    """An element (name, key, drop) with children, which are elements or texts."""

    __slots__ = ("drop", "header", "key", "kids", "main", "name")

    def __init__(self, name: str, key: str, drop: int, header: bool, main: int):
        self.name, self.key, self.drop, self.header, self.main = name, key, drop, header, main
        self.kids: list[Node | str] = []


_known: dict[tuple[str, str], tuple[str, int, bool, int]] = {}
#: How an element says that it is the article: by a tag or role; by a word in its class.
TAGGED, WORDED = 2, 1


def describe(name: str, attributes: str) -> tuple[str, int, bool, int]:
    """(key, whether it is no part of an article (HARD) or only seems to be none, whether it is a header, whether it is named as the article)."""
    at = (name, attributes if len(attributes) < 200 else "")
    if at in _known and len(attributes) < 200:
        return _known[at]
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in WORD.findall(names)} | {w.lower() for w in names.split()}
    role = found.get("role", "").lower().strip()
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    drop = HARD if (name in DROPPED and name != "form") or (role in ROLES and role != "form") or hidden else 0
    if not drop and name not in {"html", "body", "main"} and words & WORDS:
        drop = NAMED if WORDS.intersection(names.lower().split()) else MIXED
    if not drop and (name == "form" or role == "form"):
        drop = MIXED
    header = name == "header" or bool(words & HEADERS)
    main = name in {"article", "main"} or role in {"main", "article"} or found.get("itemprop", "").lower() == "articlebody"
    key = name + "".join("." + w for w in sorted(set(found.get("class", "").split()))) + ("@" + role if role else "")
    worded = drop != HARD and bool(words & CONTENT) and name in {"div", "section", "td"}
    out = (key, drop, header, TAGGED if main else WORDED if worded else 0)
    if len(attributes) < 200:
        if len(_known) > 50_000:
            _known.clear()
        _known[at] = out
    return out


def parse(page: str) -> Node:
    """A page as nested nodes; every text is kept, with its character references decoded."""
    root = Node("#page", "#page", 0, False, 0)
    stack, at, n = [root], 0, len(page)
    text = lambda s: stack[-1].kids.append(references.unescape(s) if "&" in s else s)

    def leave(names: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in fence:
                return

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        m = TAG.match(page, begin)
        if m is None:  # a sign, not a tag
            following = page.find("<", begin + 1)
            following = n if following < 0 else following
            text(page[at:following])
            at = following
            continue
        if begin > at:
            text(page[at:begin])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # the page ends inside a tag
            break
        name = m[2].lower()
        if m[1]:
            leave({name}, frozenset() if name in BLOCK or name not in {"b", "i", "a", "em", "strong", "span", "u", "s", "small", "font", "code"} else BLOCK - {"p"})
            continue
        if name in CLOSES_P:
            leave({"p"}, {"button", "td", "th", "table", "caption", "object", "article", "section", "main", "div", "li", "body"} - {name} | {"button"})
        if name in ENDS:
            leave(ENDS[name], FENCE[name])
        node = Node(name, *describe(name, m[3]))
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
        elif name not in VOID and not (m[3].endswith("/") and name in {"path", "rect", "circle", "use"}):
            stack.append(node)
    settle(root)
    return root


def settle(root: Node) -> None:
    """Keeps elements that only seem to be no part of the article but are it or hold it.

    That is an article element with a mark such as ``has-sidebar`` that holds more text than the
    article's elements outside of marks, and, where these hold none, an element around an article
    or around most of the page's text.
    """
    while True:
        order: list[tuple[Node, int]] = [(root, -1)]
        at = 0
        while at < len(order):
            order += [(k, at) for k in order[at][0].kids if not isinstance(k, str) and k.drop != HARD]
            at += 1
        if not any(n.drop for n, _ in order):
            return
        # text outside of marks; outside of whole words as marks; that in elements for articles, likewise; headings; paragraphs
        open_, reach, shown, held = ([0] * len(order) for _ in range(4))
        h1, p = [n.name == "h1" for n, _ in order], [n.name == "p" for n, _ in order]
        for i in range(len(order) - 1, -1, -1):
            n, up = order[i]
            own = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
            open_[i] += own
            reach[i] += own
            if n.main:
                shown[i], held[i] = open_[i], reach[i]
            if up >= 0 and n.drop != NAMED:
                reach[up] += reach[i]
                held[up] += held[i]
                h1[up] += h1[i]
                p[up] += p[i]
            if up >= 0 and not n.drop:
                open_[up] += open_[i]
                shown[up] += shown[i]
        for i, (n, up) in enumerate(order):
            while n.drop and up >= 0 and not order[up][0].drop:
                up = order[up][1]
            if not n.drop or up >= 0:  # inside another mark
                continue
            article = n.main and (n.name == "article" or "@" in n.key)
            if article and n.drop == MIXED and held[i] > shown[0]:
                break
            most = reach[i] and reach[i] >= 0.6 * (reach[i] + open_[0])
            if most and not shown[0] and (article or (n.drop == MIXED and held[i]) or (h1[i] and p[i] > 2) or (n.drop == MIXED and (h1[i] or p[i] > 2))):
                break
        else:
            return
        n.drop = 0


class Part:
    """A piece of a wrapper: a tag with parts inside it, or a text (key ``#``)."""

    __slots__ = ("chars", "drop", "fixed", "header", "key", "kids", "main", "many", "name", "optional", "seen")

    def __init__(self, key: str, name: str = "", drop: int = 0, header: bool = False, main: int = 0):
        self.key, self.name, self.drop, self.header, self.main = key, name, drop, header, main
        self.kids: list[Part] = []
        self.optional = self.many = False
        self.fixed: str | None = None
        self.seen, self.chars = 1, 0

    def dump(self) -> list:
        return [self.key, self.name, self.drop, self.header, self.main, self.optional, self.many, self.fixed, self.seen, self.chars, [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, row: list) -> Part:
        part = cls(*row[:5])
        part.optional, part.many, part.fixed, part.seen, part.chars = row[5:10]
        part.kids = [cls.load(k) for k in row[10]]
        return part


def squeeze(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


def part_of(node: Node | str, depth: int = 0) -> Part:
    """A page's node as a wrapper of its own, with neighbours of one shape folded."""
    if isinstance(node, str):
        part = Part("#")
        part.fixed = squeeze(node)
        part.chars = len(part.fixed)
        return part
    part = Part(node.key, node.name, node.drop, node.header, node.main)
    if depth < DEEP:
        part.kids = fold([part_of(k, depth + 1) for k in node.kids if not isinstance(k, str) or k.strip()])
        part.chars = sum(k.chars for k in part.kids)
    return part


def shape(kids: list) -> set[str]:
    """The names of the blocks among an element's children."""
    return {k.name for k in kids if not isinstance(k, str) and k.name in BLOCK}


def alike(a: list, b: list) -> bool:
    """Whether two elements of one key have children of one kind: blocks in common, or none."""
    x, y = shape(a), shape(b)
    return bool(x & y) or not (x or y)


def fold(parts: list[Part]) -> list[Part]:
    """Neighbours with one key and alike children become a repeated group."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].key == p.key and alike(out[-1].kids, p.kids):
            last = out[-1]
            seen = last.seen
            merge(last, p)
            last.many, last.seen = True, seen
        else:
            out.append(p)
    return out


def aligned(kids: list, part: Part | None) -> list[Part | None]:
    """The part that each of a node's children stands for, in order."""
    out: list[Part | None] = []
    start, following = 0, part.kids if part is not None else []
    for k in kids:
        key, own = "#" if isinstance(k, str) else k.key, None
        if key != "#" or k.strip():
            near = [i for i in range(start, len(following)) if following[i].key == key]
            near = [i for i in near if key == "#" or alike(k.kids, following[i].kids)][:1] or near[:1]
            if near:
                own = following[near[0]]
                start = near[0] if own.many else near[0] + 1
        out.append(own)
    return out


def merge(a: Part, b: Part) -> None:
    """Generalises ``a`` so that it also covers ``b``."""
    a.seen += b.seen
    a.chars += b.chars
    a.drop = min(a.drop, b.drop)
    a.many |= b.many
    a.optional |= b.optional
    if a.key == "#":
        if a.fixed != b.fixed:
            a.fixed = None  # a slot
        return
    keys_a, keys_b = [k.key for k in a.kids], [k.key for k in b.kids]
    if keys_a == keys_b:
        for x, y in zip(a.kids, b.kids, strict=True):
            merge(x, y)
        return
    kids: list[Part] = []
    for what, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a.kids[i:j], b.kids[k:m], strict=True):
                merge(x, y)
                kids.append(x)
        else:
            for x in (*a.kids[i:j], *b.kids[k:m]):
                x.optional = True
                kids.append(x)
    a.kids = fold(kids) if any(x.key == y.key for x, y in zip(kids, kids[1:], strict=False)) else kids


def infer(pages: list[str]) -> Part | None:
    """The wrapper of some pages of a host; copies of a page count once."""
    wrapper = None
    for page in sorted(set(pages)):
        wrapper = joined(wrapper, part_of(parse(page)))
    return wrapper


def joined(wrapper: Part | None, other: Part) -> Part:
    """``wrapper`` so generalised that it also covers ``other``."""
    if wrapper is None:
        return other
    merge(wrapper, other)
    return wrapper


def changing(part: Part, marks: bool = True, fixed: bool = False) -> int:
    """Characters of a part's text that change from page to page and aren't links'; with ``marks``, none in elements named
    as no article; with ``fixed``, those that don't change, too."""
    if part.key == "#":
        return 0 if not fixed and part.fixed is not None and part.seen >= AGREE else part.chars
    if part.name == "a" or part.name in TECHNICAL or (marks and part.drop):
        return 0
    return sum(changing(k, marks, fixed) for k in part.kids)


class Region:
    """Where a host's article is: the parts from the page down to it, and whether its name says so."""

    def __init__(self, wrapper: Part):
        self.path: list[Part] = []
        self.semantic = False
        found = self.by_mass(wrapper)
        named = self.by_name(wrapper)
        if named:
            inside, around = self.begins(named, found), self.begins(found, named)
            here, there = [wrapper, *found][-1], [wrapper, *named][-1]
            mass, own = changing(here), changing(there)
            most = changing(there, fixed=True) >= MOST * changing(here, fixed=True)
            # around the region: the name says how far it reaches; inside it or beside it: the name must hold much of the text
            if around or wrapper.seen < AGREE or most or (own >= 0.3 * mass if inside else 2 * own > mass):
                self.path, self.semantic = named, True
                return
        self.path = found

    @staticmethod
    def begins(path: list[Part], other: list[Part]) -> bool:
        return len(path) >= len(other) and all(a is b for a, b in zip(path, other, strict=False))

    @staticmethod
    def by_mass(wrapper: Part) -> list[Part]:
        """The path to the region that holds most of the changing text."""
        part, path = wrapper, []
        marks = changing(wrapper) > 0
        while True:
            total = changing(part, marks)
            inner = [k for k in part.kids if k.key != "#" and (not k.many or k.main) and k.name in BLOCK and not (marks and k.drop) and changing(k, marks) >= MOST * total > 0]
            if not inner or (inner[0].name in {"p", *HEADINGS}):
                return path
            part = inner[0]
            path = [*path, part]

    @classmethod
    def by_name(cls, wrapper: Part) -> list[Part]:
        """The path to what is named as the article, of several the innermost tag, or that with the most text; empty if nothing is."""
        best, found = None, []
        todo: list[list[Part]] = [[k] for k in wrapper.kids]
        while todo:
            path = todo.pop()
            part = path[-1]
            if part.drop or part.key == "#":
                continue
            value = (part.main, part.name == "article", part.chars)
            if part.main and part.chars:
                inside = bool(found) and cls.begins(path, found)
                if best is None or (value[:2] > best[:2] if inside else value > best):
                    best, found = value, path
            todo += [[*path, k] for k in part.kids]
        return found


class Wrapper:
    """A host's wrapper, ready to read pages."""

    def __init__(self, part: Part):
        self.part = part
        region = Region(part)
        self.path, self.semantic = region.path, region.semantic
        here = [part, *self.path][-1]
        # a text is the template's if it is on enough pages; under a named article, on half of them
        self.agree = max(AGREE, (here.seen + 1) // 2 if self.semantic else 0)
        self.cut = self._fixed(here) <= changing(here)
        self.title = None if self.semantic else self._title()

    def _fixed(self, part: Part) -> int:
        if part.key == "#":
            return part.chars if part.fixed is not None and part.seen >= self.agree else 0
        return 0 if part.drop or part.name in TECHNICAL else sum(map(self._fixed, part.kids))

    def _title(self) -> tuple[int, str] | None:
        """The depth and key of a changing heading beside the path, the nearest one; none if the region has one."""
        way = [self.part, *self.path]
        if any(k.name in {"h1", "h2"} for k in way[-1].kids):
            return None
        for depth in range(len(way) - 2, -1, -1):
            for k in way[depth].kids:
                if k.name in {"h1", "h2"} and not k.many and not k.drop and changing(k):
                    return depth, k.key
        return None

    def read(self, page: str | None) -> str:
        """The article's text of a whole page."""
        if not page:
            return ""
        root = parse(page)
        nodes, part = self.find(root)
        if not nodes:
            own = Wrapper(part_of(root)) if self.part is not None else self
            nodes, part = own.find(root)
            return texts(nodes or [root], None, 0)
        return texts(nodes, part, self.agree if self.cut else 0)

    def find(self, root: Node) -> tuple[list[Node], Part | None]:
        """The article's nodes in page order: all that a named path leads to, else the heaviest of alike siblings, and its heading."""
        nodes, part, title = [root], self.part, []
        for depth, target in enumerate(self.path):
            if self.title and self.title[0] == depth:
                title = [k for n in nodes for k in n.kids if not isinstance(k, str) and k.key == self.title[1]][:1]
            if self.semantic:
                nodes = [k for n in nodes for k in n.kids if not isinstance(k, str) and k.key == target.key and not k.drop]
            else:
                both = [(k, own) for n in nodes for k, own in zip(n.kids, aligned(n.kids, part), strict=True) if not isinstance(k, str)]
                nodes = [k for k, own in both if own is target] or [k for k, _ in both if k.key == target.key]
                nodes = [max(nodes, key=weight)] if len(nodes) > 1 else nodes
            part = target
        nodes = [n for n in nodes if n.main or not self.semantic]
        return (title + nodes if nodes else []), part


def texts(nodes: list[Node], part: Part | None, agree: int) -> str:
    own = lambda n: part if part is not None and n.key == part.key else None
    return "\n".join(t for t in (blocks(n, own(n), agree) for n in nodes) if t)


def weight(node: Node) -> int:
    """Characters of text in a node."""
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                total += len(k)
            elif not k.drop:
                todo.append(k)
    return total


def blocks(root: Node, wrapper: Part | None, agree: int) -> str:
    """The text blocks of an article, by its tags and its part of the wrapper; texts fixed on ``agree`` pages or more go (0: none)."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            text = squeeze("".join(held))
            if text:
                out.append(text)
            held.clear()

    # entries: (node, part, in a header); None closes a block
    todo: list = [(root, wrapper, False)]
    while todo:
        top = todo.pop()
        if top is None:
            close()
            continue
        node, part, header = top
        if isinstance(node, str):
            if header:
                continue
            if agree and part is not None and part.fixed is not None and part.seen >= agree and part.fixed == squeeze(node):
                continue
            held.append(node)
            continue
        if node is not root and node.drop:
            if node.name in BLOCK:
                close()
            continue
        if node.name == "br":
            held.append(" ")
            continue
        if node.header and node is not root:
            header = True
        elif node.name in HEADINGS:
            header = False
        block = node.name in BLOCK
        if block:
            close()
            todo.append(None)
        todo += reversed([(k, own, header) for k, own in zip(node.kids, aligned(node.kids, part), strict=True)])
    close()
    return "\n".join(out)


PARTIAL = pa.schema([("host", pa.string()), ("task", pa.int32()), ("wrapper", pa.string())])


def learn(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all different pages of each host."""
    rows = pages.filter("html <> ''").select("host", "page_id", "html", F.xxhash64("html").alias("h"))
    first = store.table(rows.groupBy("host", "h").agg(F.min("page_id").alias("first")), "first")
    few = first.count() <= 100_000
    mine = F.broadcast(first) if few else first
    same = (rows["host"] == mine["host"]) & (rows["h"] == mine["h"]) & rows["page_id"].eqNullSafe(mine["first"])
    rows = rows.join(mine, same, "left_semi").select("host", "h", "html", F.spark_partition_id().alias("task"))
    dump = lambda w: json.dumps(w.dump())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part] = {}
        seen: set[tuple[str, int]] = set()
        task = 0
        made = lambda: pa.RecordBatch.from_pydict({"host": list(known), "task": [task] * len(known), "wrapper": [dump(w) for w in known.values()]}, schema=PARTIAL)
        for batch in store.slices(batches):
            for host, h, page, task in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # noqa: B007
                if (host, h) in seen:
                    continue
                if host not in known and len(known) >= HOSTS:
                    yield made()
                    known.clear()
                seen.add((host, h))
                known[host] = joined(known.get(host), part_of(parse(page)))
        yield made()

    def run(part: pa.Table) -> pa.Table:
        wrapper = None
        for data in sorted(part.column("wrapper").to_pylist()):
            wrapper = joined(wrapper, Part.load(json.loads(data)))
        return pa.table({"host": part.column("host")[:1], "task": part.column("task")[:1], "wrapper": pa.array([dump(wrapper)], pa.string())}, schema=PARTIAL)

    kind = "host string, task int, wrapper string"
    parts = store.table(rows.mapInArrow(partial, kind), "partial")
    rounds = parts.groupBy("host", F.floor(F.col("task") / TASKS).alias("some")).applyInArrow(run, kind)
    return store.table(rounds.groupBy("host").applyInArrow(run, kind).select("host", "wrapper"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = learn(pages)
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = None
    if size <= SEND:
        found = wrappers.toArrow()  # at most ``SEND`` bytes
        shared = pages.sparkSession.sparkContext.broadcast(dict(zip(found.column("host").to_pylist(), found.column("wrapper").to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        plain = Wrapper(Part("#page"))
        for batch in store.slices(batches):
            texts, keep = [], []
            for i, (page, host, data) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                if host not in known or data:
                    if len(known) > HOSTS:
                        known.clear()
                    data = data or (shared.value.get(host) if shared else None)
                    known[host] = Wrapper(Part.load(json.loads(data))) if data else plain
                if shared or batch.column(5)[i].as_py():
                    keep.append(i)
                    texts.append(known[host].read(page))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = f"page_id {kind}, url string, text string, n_chars long"
    if shared:
        return pages.select("*", F.lit(None).cast("string").alias("wrapper"), F.lit(True).alias("page")).mapInArrow(run, out)
    # a host's wrapper goes ahead of its pages, once for each of the host's keys
    mine = pages.select("*", F.lit(None).cast("string").alias("wrapper"), F.lit(True).alias("page"), F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    theirs = wrappers.select("host", "wrapper", F.lit(False).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    return both.repartition("host", "salt").sortWithinPartitions("host", "salt", "page").select("page_id", "url", "html", "host", "wrapper", "page").mapInArrow(run, out)
