"""Main text of pages by wrappers: union-free expressions inferred from the pages of a host.

A page is a nested sequence of element and text tokens.  The pages of a host are aligned level by
level: tokens of one kind (tag, class, id, role; elements that bear neither, by their place among
their like) stand for each other.  A kind that some page lacks is optional, one that a page has
twice is repeated, kinds that come in different orders form a repeated group of optional members,
and text tokens that stand for each other are compared over all pages: one value is template
text, different ones make a text slot.  So a wrapper is a regular expression without alternatives.

A wrapper keeps, for each text token, on how many pages it is, its length, the length inside
links, and the least hashes of its values, which estimate how many different ones there are.
Merging wrappers adds counts and unites kinds, orders and hashes; it is associative and
commutative, so it does not matter how pages are dealt to tasks, and a host with a third of all
pages is folded in every task first and then in rounds of few wrappers.

The wrapper decides which of its slots are main text (`reading`).  A slot weighs what its pages
say in it outside links, times the share of different values; so what a host repeats weighs little.
Reading a page descends from its root to the element that holds nearly all weight; everything
in it is main text but slots the wrapper marks: what the host repeats while other slots change,
blocks of links that it repeats, and elements whose tag or name says that they stand beside the
text (forms, menus, footers, adverts, comments).  Names such as `notice` or `related` count only
where the wrapper has no evidence or agrees with them.  A page is read through the wrapper alone:
what does not match it gives no text.

Defined cases: a null html is an empty page with empty text; broken markup is closed as browsers
do for paragraphs and list items, and at the end of the page; a null or odd url is of the host '';
rows that repeat are extracted each; broken UTF-8 is read as U+FFFD; no rows give no
rows; other columns are not used.  A level with more than KINDS kinds of one tag has one kind for
that tag.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.common import clean_text, partitions, written
from docspend.shipping import ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: What stands in these is not markup.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "object", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"
}
#: An opening tag of the key closes an open element of these kinds.
CLOSES = {k: {"p", "svg", "math"} for k in BLOCKS}
CLOSES |= {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}
}
#: Closing stops at these.
SCOPES = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "aside", "nav", "body", "html", "blockquote"}
#: Bare elements of these kinds are told apart by their place among their like, the first PLACES of them.
PLACED, PLACES = {"div", "section", "td", "center"}, 8

#: Never text of an article.
BESIDE = {
    "head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "noscript", "svg", "math", "canvas", "audio", "video",
    "map"
}
#: What a reading may descend into.
CONTAINERS = {"page", "html", "body", "div", "section", "article", "main", "center", "form", "table", "tbody", "tr", "td", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "pre", "blockquote", "ul", "ol", "dl"}


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_ ])(?:{words})(?:$|[-_ ])", re.I)


#: Names of what stands beside an article, and names that may also be of its own text.
STRONG = _names(
    r"ads?|advert\w*|adsense|banners?|promo\w*|sponsor\w*|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|popups?|modals?|newsletter|subscribe|signup|login|pagination|pager|skip"
)
WEAK = _names(r"notices?|alerts?|overlay|share|sharing|social|related|recommended|widgets?|footer|header|masthead|toolbar|search")
FAVOURED = _names(r"article|story|post|entry|content|articlebody|main")

TEXT = "#"
#: Elements nested deeper stand beside each other.
DEEPEST = 100
#: Kinds of one tag on a level, and least hashes of a slot's values.
KINDS, VALUES = 64, 32
#: Pages from which the wrapper's own evidence counts.
ENOUGH = 5
#: The share of the weight that an element must hold to be descended into.
HOLDS = 0.8


class Node:
    """An element of a page; a text token has key '#', its text and the characters of it inside links."""

    __slots__ = ("key", "children", "text", "linked")

    def __init__(self, key: str):
        self.key, self.children, self.text, self.linked = key, [], [], 0

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]


def page_tree(page: str) -> Node:
    """The block elements of a page, with the inline text between them as children of key '#'."""
    root = Node("page")
    stack, at, raw, links = [root], 0, None, 0

    def add(text: str) -> None:
        if text:
            top = stack[-1]
            if not (top.children and top.children[-1].key == TEXT):
                if text.isspace():
                    return
                top.children.append(Node(TEXT))
            top.children[-1].text.append(text)
            if links:
                top.children[-1].linked += len(text)

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        closing, tag, attributes = m.group(1), m.group(2), m.group(3)
        if raw is not None:
            if not (closing and tag and tag.lower() == raw):
                continue
            raw, at = None, m.end()
            continue
        add(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            raw = tag if not attributes.endswith("/") else None
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            named = not closing and NAMED.search(attributes) if tag in ("span", "a", "small") else None
            if not named or not STRONG.search(named.group(2) or named.group(3) or named.group(4) or ""):
                if closing and stack[-1].tag == tag:
                    stack.pop()
                continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                add(" " if tag != "wbr" else "")
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag in ("p", "li", "div", "span"):
                    break
            continue
        if tag in BLOCKS:
            links = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPES and tag != "body":
                break
        names = " ".join(x.group(2) or x.group(3) or x.group(4) or "" for x in NAMED.finditer(attributes))
        key = f"{tag} {re.sub(r'[0-9]+', '0', ' '.join(names.split()))}".strip()
        if key in PLACED:
            place = 1 + sum(x.key.startswith(f"{key} @") for x in stack[-1].children)
            key = f"{key} @{place}" if place <= PLACES else f"{key} @+"
        node = Node(key)
        stack[-1].children.append(node)
        if not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    if raw is None:
        add(page[at:])
    return root


@dataclass
class Slot:
    """A kind of token on a level of a wrapper."""

    key: str
    pages: int = 0
    many: bool = False
    chars: int = 0  # these of texts only
    linked: int = 0
    values: set[str] = field(default_factory=set)
    kids: dict[str, Slot] = field(default_factory=dict)
    order: set[tuple[str, str]] = field(default_factory=set)  # kinds of neighbours

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]

    @property
    def names(self) -> str:
        return self.key.partition(" ")[2]

    def kid(self, key: str) -> Slot | None:
        return self.kids.get(key) or self.kids.get(f"{key.partition(' ')[0]} *")

    def different(self) -> int:
        """The number of different values, estimated from the least hashes if there are many."""
        if len(self.values) < VALUES:
            return len(self.values)
        return max(VALUES, round((VALUES - 1) / ((int(max(self.values), 16) + 1) / 16**12)))


def shown(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def take(into: Slot, nodes: list[Node]) -> None:
    """Add what one page has for a slot."""
    into.pages += 1
    level: dict[str, list[Node]] = {}
    for node in nodes:
        last, here = None, Counter()
        for x in node.children:
            slot = into.kid(x.key)
            kind = slot.key if slot else x.key
            level.setdefault(x.key, []).append(x)
            here[x.key] += 1
            if last is not None and last != kind:
                into.order.add((last, kind))
            last = kind
        for key, k in here.items():
            slot = into.kid(key) or into.kids.setdefault(key, Slot(key))
            slot.many |= k > 1
    for key, found in level.items():  # kinds that share a slot count each, as they would if they met later
        slot = into.kid(key)
        if key != TEXT:
            take(slot, found)
            continue
        texts = [shown(x.text) for x in found]
        slot.pages += 1
        slot.chars += sum(map(len, texts))
        slot.linked += sum(min(x.linked, len(t)) for x, t in zip(found, texts))
        slot.values.add(hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=6).hexdigest())
        if len(slot.values) > VALUES:
            slot.values.remove(max(slot.values))
    if len(into.kids) > KINDS:
        _collapse(into)


def merge(into: Slot, other: Slot) -> None:
    """Add another wrapper's slot."""
    into.pages += other.pages
    into.many |= other.many
    into.chars += other.chars
    into.linked += other.linked
    into.values = set(sorted(into.values | other.values)[:VALUES])
    into.order |= other.order
    for key, x in other.kids.items():
        if key in into.kids:
            merge(into.kids[key], x)
        else:
            into.kids[key] = x
    _collapse(into)


def _collapse(slot: Slot) -> None:
    """Levels of very many kinds of a tag keep one for it; the union of kinds only grows, so the order of merges does not matter."""
    of = Counter(x.tag for x in slot.kids.values())
    wide = {t for t, k in of.items() if k > KINDS} | {x.tag for k, x in slot.kids.items() if k.endswith(" *") and of[x.tag] > 1}
    if not wide:
        return
    for key in sorted(k for k, x in slot.kids.items() if x.tag in wide and not k.endswith(" *")):
        x = slot.kids.pop(key)
        one = slot.kids.setdefault(f"{x.tag} *", Slot(f"{x.tag} *"))
        merge(one, x)
        one.many = True
    named = lambda k: f"{k.partition(' ')[0]} *" if k.partition(" ")[0] in wide else k
    slot.order = {(named(a), named(b)) for a, b in slot.order if named(a) != named(b)}


def wrapper_of(*pages: str) -> Slot:
    out = Slot("page")
    for page in pages:
        take(out, [page_tree(page)])
    return out


def dumped(slot: Slot) -> str:
    def plain(x: Slot):
        keys = sorted(x.kids)
        at = {k: i for i, k in enumerate(keys)}
        order = sorted([at[a], at[b]] for a, b in x.order)
        own = [x.chars, x.linked, sorted(x.values)] if x.key == TEXT else [order, [plain(x.kids[k]) for k in keys]]
        return [x.key, x.pages, int(x.many), *own]

    return json.dumps(plain(slot), separators=(",", ":"), ensure_ascii=False)


def loaded(text: str) -> Slot:
    def slot(x) -> Slot:
        out = Slot(x[0], x[1], bool(x[2]))
        if out.key == TEXT:
            out.chars, out.linked, out.values = x[3], x[4], set(x[5])
        else:
            kids = [slot(y) for y in x[4]]
            out.kids = {y.key: y for y in kids}
            out.order = {(kids[a].key, kids[b].key) for a, b in x[3]}
        return out

    return slot(json.loads(text))


def expression(slot: Slot) -> str:
    """The wrapper as a readable regular expression; template text as '=', slots as '#'."""

    def one(x: Slot, parent: Slot) -> str:
        body = ("=" if x.pages > 1 and len(x.values) == 1 else "#") if x.key == TEXT else f"<{x.key}>{expression(x)}</{x.tag}>"
        mark = "+" * x.many + "?" * (x.pages < parent.pages)
        return f"({body}){mark}" if mark else body

    after = {k: {b for a, b in slot.order if a == k} for k in slot.kids}
    for k in after:  # everything that can come later
        new = set(after[k])
        while new:
            new = {c for b in new for c in after.get(b, ())} - after[k]
            after[k] |= new
    groups: list[list[str]] = []
    for k in sorted(slot.kids, key=lambda k: (-len(after[k] - {k}), k)):
        mates = next((g for g in groups if k in after[g[0]] and g[0] in after[k]), None)
        (mates.append(k) if mates else groups.append([k]))
    groups.sort(key=lambda g: (-len({y for y in after[g[0]] if g[0] not in after[y]}), g[0]))
    out = ""
    for g in groups:
        body = "".join(one(slot.kids[k], slot) for k in g)
        out += f"({body})+" if len(g) > 1 else body
    return out


def reading(wrapper: Slot) -> list:
    """How pages are read through a wrapper: nested [key, weight, beside, [kids]]."""
    most = 0

    def largest(x: Slot) -> None:
        nonlocal most
        if x.key == TEXT and 2 * x.pages >= wrapper.pages:
            most = max(most, x.different())
        for y in x.kids.values():
            largest(y)

    largest(wrapper)

    def evidence(x: Slot) -> tuple[int, int, float, bool]:
        """Characters, those in links, characters times share of different values, and whether the host repeats it all."""
        if x.key == TEXT:
            n = x.different()
            same = x.pages >= ENOUGH and most >= ENOUGH and 5 * n <= min(x.pages, most)
            return x.chars, x.linked, x.chars * n / max(1, x.pages), same
        c, l, v, same = 0, 0, 0.0, True
        for y in x.kids.values():
            a, b, d, e = evidence(y)
            c, l, v, same = c + a, l + b, v + d, same and e
        return c, l, v, same and c > 0

    def read(x: Slot, inside: bool, parent: Slot) -> tuple[float, list]:
        """The weight on all pages, and the plan of a slot; inside: of an article or main element."""
        if x.key == TEXT:
            total = (x.chars - x.linked) * x.different() / max(1, x.pages)
            return total, [TEXT, round(total / max(1, x.pages), 3), 0, []]
        within = inside or x.tag in ("article", "main")
        kids = [read(x.kids[k], within, x) for k in sorted(x.kids)]
        chars, linked, changing, same = evidence(x)
        change, link = changing / max(1, chars), linked / max(1, chars)
        outer = x.tag in ("page", "html", "body", "article", "main")
        factor, beside = 1.0, False
        if x.tag in BESIDE:
            factor, beside = 0.02, True
        elif not outer and STRONG.search(x.names):
            factor, beside = 0.1, True
        elif not outer and (x.tag == "header" or WEAK.search(x.names)):
            known = x.pages >= ENOUGH
            beside = (not known and (not inside or x.tag != "header")) or known and (change < 0.5 or link > 0.5)
            factor = 0.1 if beside else 1.0
        elif not outer and same and not (inside and x.tag in PROSE):
            beside = True
        elif not outer and x.pages >= ENOUGH and link > 0.8 and change < 0.1:
            beside = True
        if x.tag == "article":
            factor = 20.0
        elif x.tag == "main" or "main" in x.names.split():
            factor = 5.0
        elif factor == 1.0 and FAVOURED.search(x.names):
            factor = 2.0
        total = factor * sum(t for t, _ in kids)
        return total, [x.key, round(total / max(1, x.pages), 3), int(beside), [k for _, k in kids], round(change, 3)]

    return read(wrapper, False, wrapper)[1]


class Reading:
    """A reading of a host, ready for its pages."""

    __slots__ = ("key", "weight", "beside", "kids", "tag", "change")

    def __init__(self, plan: list):
        self.key, self.weight, self.beside = plan[0], plan[1], bool(plan[2])
        self.kids = {k[0]: Reading(k) for k in plan[3]}
        self.change = plan[4] if len(plan) > 4 else 1.0
        self.tag = self.key.partition(" ")[0]

    def kid(self, key: str) -> Reading | None:
        return self.kids.get(key) or self.kids.get(f"{key.partition(' ')[0]} *")


def main_blocks(page: Node, plan: Reading) -> list[str]:
    """The text blocks of a page in the slots that its host's wrapper takes for main text, in page order."""
    nodes, at = [page], plan
    while True:
        here: dict[str, list[Node]] = {}
        for node in nodes:
            for x in node.children:
                slot = at.kid(x.key)
                if slot is not None:
                    here.setdefault(slot.key, []).append(x)
        slots = [at.kids[k] for k in here]
        total = sum(s.weight for s in slots)
        best = max(slots, key=lambda s: (s.weight, s.key), default=None)
        if best is None or best.tag not in CONTAINERS or best.weight < HOLDS * total or not best.weight:
            break
        beside = lambda s: s is best or s.beside or s.tag not in PROSE or s.change < 0.5
        if best.tag not in ("article", "main") and not all(map(beside, slots)):
            break  # the text of this element itself belongs to it
        nodes, at = here[best.key], best
    out: list[str] = []

    def walk(node: Node, pattern: Reading) -> None:
        for x in node.children:
            slot = pattern.kid(x.key)
            if slot is None or slot.beside:
                continue
            if x.key != TEXT:
                walk(x, slot)
            elif text := shown(x.text):
                out.append(text)

    for node in nodes:
        walk(node, at)
    return out


def extracted(page: str, wrapper: Slot) -> str:
    return "\n".join(main_blocks(page_tree(page), Reading(reading(wrapper))))


#: Hosts a task keeps at a time; more are handed on and folded later.
HOSTS = 1000


def _rows(found: dict[str, Slot], first: int) -> pa.RecordBatch:
    hosts, texts = list(found), [dumped(w) for w in found.values()]
    part = range(first, first + len(hosts))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(hosts, pa.string()), pa.array(texts, pa.string())], ["part", "host", "wrapper"])


WRAPPERS = "part long, host string, wrapper string"


def wrappers(pages: DataFrame) -> DataFrame:
    """part (a number of the row), host, wrapper from rows (host, html): one row for each host and task, more for tasks of many hosts."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str, Slot] = {}
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if host not in found:
                    if len(found) >= HOSTS:
                        yield _rows(found, part)
                        part += len(found)
                        found.clear()
                    found[host] = Slot("page")
                take(found[host], [page_tree(page)])
        yield _rows(found, part)

    return pages.select("host", "html").mapInArrow(fold, WRAPPERS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of rows (host, bucket), which come together."""
    from pyspark import TaskContext

    part, key, held = TaskContext.get().partitionId() << 33, None, None
    for batch in batches:
        for host, bucket, text in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "wrapper"))):
            if (host, bucket) == key:
                merge(held, loaded(text))
                continue
            if held is not None:
                yield _rows({key[0]: held}, part)
                part += 1
            key, held = (host, bucket), loaded(text)
    if held is not None:
        yield _rows({key[0]: held}, part)


def host_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(rest)


#: Wrappers of a host that one merge takes.
FEW = 64


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: the wrapper of each host of pages (url, html)."""
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col("url")).alias("host"), clean_text("html").alias("html"))
    found = written(wrappers(rows), "wrappers")
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return found.select("host", "wrapper")
        dealt = found.join(sizes, "host").select("host", "wrapper", F.pmod(F.xxhash64("part"), F.ceil(F.col("n") / FEW)).alias("bucket"))
        dealt = dealt.repartition(partitions(found.sparkSession), "host", "bucket").sortWithinPartitions("host", "bucket")
        found = written(dealt.mapInArrow(_merged, WRAPPERS), "wrappers")


def readings(wrappers: DataFrame) -> DataFrame:
    """host, plan: the reading of each wrapper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [json.dumps(reading(loaded(w)), separators=(",", ":"), ensure_ascii=False) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(plans, pa.string())], ["host", "plan"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, plan string")


#: Bytes of readings up to which they are broadcast; more are joined, hosts dealt over SALT keys.
BROADCAST, SALT = 32 << 20, 32


def read_through(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages read through the plan of their host."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Reading] = {}
        for batch in batches:
            texts = []
            for page, plan in zip(batch.column("html").to_pylist(), batch.column("plan").to_pylist()):
                if plan not in ready:
                    if len(ready) > HOSTS:
                        ready.clear()
                    ready[plan] = Reading(json.loads(plan))
                texts.append("\n".join(main_blocks(page_tree(page), ready[plan])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", clean_text("html").alias("html"), host_of(F.col("url")).alias("host"))
    if (plans.agg(F.sum(F.octet_length("plan") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST:
        joined = rows.join(F.broadcast(plans), "host")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        joined = rows.withColumn(
            "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")
        ).join(plans.select("host", "plan", salts), ["host", "salt"])
    return joined.select("page_id", "url", "html", "plan").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    return read_through(pages, written(readings(infer(pages)), "readings"))
