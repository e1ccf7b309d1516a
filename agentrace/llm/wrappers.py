"""Main text of web pages by inferred wrappers: union-free regular expressions over page tokens.

A page is a stream of block tags and text slots. Adjacent repeats fold into repeated groups, and the
folded streams of a host are aligned one after the other: where they differ, the difference becomes
an optional group, or a repeated one if one side repeats what the other has once. The result
describes all pages of the host. Every slot of it sums, over all pages, how much of its text stands
where articles stand and how much inside links, and these sums say which slots are main text.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, map_slices
from agentrace.llm.keys import null_safe
from agentrace.llm.registry import query, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(template|noscript|iframe|svg|select)\b[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# The block elements of HTML; all other elements are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
# Elements whose end tag may be left out, or that have none.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup hr".split())
# Elements, and words of class, id and role, that hold no main text.
ASIDE = frozenset("head title nav footer aside form button dialog menu search fieldset".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer contentinfo "
    "sidebar rail complementary aside widget ad ads advert adverts advertisement adsense sponsor "
    "sponsored promo promotion banner notice notices cookie cookies consent gdpr alert popup modal "
    "dialog overlay newsletter subscribe signup login search share sharing social related "
    "recommended comment comments respond reply replies disqus pagination pager copyright legal "
    "disclaimer skip".split()
)
MAIN = frozenset(("article", "main"))
SUMS = re.compile(r"\[\d+,\d+,\d+\]")
#: How the folding of a host's distinct streams is spread: groups of the first and second round.
SPREAD = (256, 16)


class Slot:
    """A place of text: bytes of text in all, in article places and in links; its number; places."""

    __slots__ = ("size", "good", "linked", "name", "at")

    def __init__(self, size=0, good=0, linked=0, name=None, at=()):
        self.size, self.good, self.linked, self.name, self.at = size, good, linked, name, at

    def with_(self, other: Slot) -> Slot:
        name = self.name if self.name is not None else other.name
        sums = (self.size + other.size, self.good + other.good, self.linked + other.linked)
        return Slot(*sums, name, (*self.at, *other.at))


class Group:
    """Items that repeat ('+'), may be missing ('?'), both ('*'), or stand once ('1')."""

    __slots__ = ("op", "items")

    def __init__(self, op, items):
        self.op, self.items = op, items


def shape(item):
    if isinstance(item, str):
        return item
    return "#" if isinstance(item, Slot) else (item.op, *map(shape, item.items))


def first_of(item):
    """The first tag or slot of an item: groups that begin alike may be the same group."""
    while isinstance(item, Group):
        item = item.items[0]
    return item if isinstance(item, str) else "#"


def key(item):
    return ("group", first_of(item)) if isinstance(item, Group) else shape(item)


def same_shape(a: list, b: list) -> list:
    """Two runs of one shape as one; their slots add up."""
    out = []
    for x, y in zip(a, b):
        if isinstance(x, Slot):
            out.append(x.with_(y))
        elif isinstance(x, Group):
            out.append(Group(x.op, same_shape(x.items, y.items)))
        else:
            out.append(x)
    return out


def repeats(ids: list[int], unit: int) -> bool:
    """Whether some run of ``unit`` names is followed by itself.

    The run has a place at a multiple of ``unit``, around which the names equal those ``unit`` later.
    """
    for at in range(0, len(ids) - unit, unit):
        to = at + unit
        if ids[at] == ids[to]:
            most = min(unit, len(ids) - to)
            ahead = next((k for k in range(1, most) if ids[at + k] != ids[to + k]), most)
            most = min(unit, at + 1)
            back = next((k for k in range(1, most) if ids[at - k] != ids[to - k]), most)
            if ahead + back > unit:
                return True
    return False


def folded(items: list) -> list:
    """Adjacent repeats as repeated groups, the shortest units first, until nothing repeats."""
    names: dict = {}
    number = lambda x: names.setdefault(shape(x), len(names))
    ids = [number(x) for x in items]
    changed = True
    while changed:
        changed = False
        for unit in count(1):
            if 2 * unit > len(ids):
                break
            if not repeats(ids, unit):
                continue
            i, out, out_ids = 0, [], []
            while i < len(items):
                j = i + unit
                run = None
                while j + unit <= len(ids) and ids[i] == ids[j] and ids[i : i + unit] == ids[j : j + unit]:
                    run = same_shape(run or items[i:j], items[j : j + unit])
                    j += unit
                lone = unit == 1 and isinstance(items[i], Group)
                if j > i + unit:
                    group = run[0] if lone else Group("+", run)
                    out.append(group)
                    out_ids.append(number(group))
                    i, changed = j, True
                else:
                    out.append(items[i])
                    out_ids.append(ids[i])
                    i += 1
            items, ids = out, out_ids
    return items


def regrouped(items: list, units: set) -> list:
    """Runs that equal the content of a group of the other side, as groups that stand once."""
    shapes, out, i = [shape(x) for x in items], [], 0
    sizes = sorted({len(u) for u in units}, reverse=True)
    while i < len(items):
        size = next((n for n in sizes if tuple(shapes[i : i + n]) in units), 0)
        out.append(Group("1", items[i : i + size]) if size else items[i])
        i += size or 1
    return out


def combined(a: str, b: str) -> str:
    missing, many = "?" in (a, b) or "*" in (a, b), {"+", "*"} & {a, b}
    return ("*" if many else "?") if missing else "+" if many else "1"


def optional(items: list) -> list:
    """A run that only one side has."""
    if not items:
        return []
    if len(items) == 1 and isinstance(items[0], Group):
        return [Group(combined(items[0].op, "?"), items[0].items)]
    return [Group("?", items)]


def aligned(a: list, b: list) -> list:
    """One expression for what either side describes."""
    content = lambda side: {tuple(map(shape, x.items)) for x in side if isinstance(x, Group)}
    a, b = regrouped(a, content(b) - content(a)), regrouped(b, content(a) - content(b))
    out, i, j = [], 0, 0
    matcher = SequenceMatcher(None, [key(x) for x in a], [key(x) for x in b], autojunk=False)
    for at, to, size in matcher.get_matching_blocks():
        out += optional(a[i:at]) + optional(b[j:to])
        for x, y in zip(a[at : at + size], b[to : to + size]):
            if isinstance(x, Slot):
                out.append(x.with_(y))
            elif isinstance(x, Group):
                out.append(Group(combined(x.op, y.op), aligned(x.items, y.items)))
            else:
                out.append(x)
        i, j = at + size, to + size
    return out


def slots(items: list):
    for x in items:
        if isinstance(x, Slot):
            yield x
        elif isinstance(x, Group):
            yield from slots(x.items)


def dumped(items: list) -> str:
    def plain(x):
        if isinstance(x, Slot):
            return [x.size, x.good, x.linked]
        return x if isinstance(x, str) else {x.op: [plain(y) for y in x.items]}

    return json.dumps([plain(x) for x in items], separators=(",", ":"))


def loaded(text: str) -> list:
    def node(x):
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return Slot(*x)
        ((op, items),) = x.items()
        return Group(op, [node(y) for y in items])

    return [node(x) for x in json.loads(text)]


def tag_of(name: str, attributes: str) -> tuple[str, set[str]]:
    """The token of an opening tag, and the words of its class, id and role."""
    words = []
    for m in NAMED.finditer(attributes) if "=" in attributes else ():
        words += re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())
    told = sorted(set(words) & ASIDE_WORDS)
    return ".".join([name, *told]), set(told)


def page_tokens(page: str) -> tuple[list, list[str]]:
    """Tags and slots of a page, and the texts of the slots: blocks with single spaces.

    A slot counts as good if it stands in an article and in no part that holds other matter; on a
    page without article, if it stands in no such part. A tag in a comment, script or other part that
    is skipped opens no article.
    """
    items: list = []
    texts: list[str] = []
    inside: list[tuple[str, bool, bool]] = []
    piece: list[str] = []
    state = {"link": 0, "linked": 0, "aside": 0, "main": 0, "articles": 0}
    places: list[tuple[Slot, bool, bool]] = []
    open_names: Counter = Counter()

    def end_block():
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            slot = Slot(len(text), 0, min(len(text), state["linked"]), at=(len(texts),))
            places.append((slot, not state["aside"], state["main"] > 0))
            items.append(slot)
            texts.append(text)
        state["linked"] = 0

    def leave():
        name, aside, main = inside.pop()
        open_names[name] -= 1
        state["aside"] -= aside
        state["main"] -= main
        return name

    def say(text):
        if text:
            text = html.unescape(text)
            piece.append(text)
            if state["link"]:
                state["linked"] += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[4] or m[7] or "").lower()
        closing = bool(m[3] or m[6])
        if not name:
            continue
        if name == "br":
            piece.append(" ")
        if name == "a":
            state["link"] = 0 if closing else 1
        if name not in BLOCKS:
            continue
        end_block()
        if closing:
            if open_names[name]:
                while leave() != name:
                    pass
            if name not in OPEN_ENDED:
                items.append("/" + name)
            continue
        token, words = tag_of(name, m[5] or m[8] or "")
        items.append(token)
        if name == "hr":
            continue
        if name in OPEN_ENDED:
            # A new paragraph or list item ends an open one; other elements stay open.
            while inside and inside[-1][0] in OPEN_ENDED and (name == "p" or inside[-1][0] == name):
                leave()
        header = name == "header" and not state["main"]
        inside.append((name, bool(words) or name in ASIDE or header, name in MAIN))
        open_names[name] += 1
        state["aside"] += inside[-1][1]
        state["main"] += inside[-1][2]
        state["articles"] += inside[-1][2]
    say(page[at:])
    end_block()
    for slot, plain, main in places:
        slot.good = slot.size * (plain and (main or not state["articles"]))
    return items, texts


@lru_cache(256)
def wrapper_slots(wrapper: str) -> tuple[list, tuple[bool, ...]]:
    """A wrapper with numbered slots, and whether each holds main text."""
    items = loaded(wrapper)
    found = list(slots(items))
    for i, slot in enumerate(found):
        slot.name = i
    has_article = any(re.search(rf"\"{name}[.\"]", wrapper) for name in MAIN)
    return items, tuple(
        2 * s.good > s.size and (has_article or 2 * s.linked <= s.size) for s in found
    )


@lru_cache(4096)
def slots_good(wrapper: str, stream: str) -> tuple[bool | None, ...]:
    """For each slot of a folded stream whether it is main text; None where the wrapper has none."""
    known, good = wrapper_slots(wrapper)
    items = loaded(stream)
    own = list(slots(items))
    for i, slot in enumerate(own):
        slot.at = (i,)
    out: list[bool | None] = [None] * len(own)
    for slot in slots(aligned(known, items)):
        if slot.name is not None:
            for i in slot.at:
                out[i] = good[slot.name]
    return tuple(out)


def main_text(page: str, wrapper: str | None) -> str:
    """The texts of a page that fall into the main slots of its host's wrapper."""
    items, texts = page_tokens(page)
    good = {s.at[0]: 2 * s.good > s.size for s in items if isinstance(s, Slot)}
    if wrapper is not None and texts:
        stream = folded(items)
        judged = slots_good(wrapper, SUMS.sub("[0,0,0]", dumped(stream)))
        for slot, told in zip(slots(stream), judged):
            if told is not None:
                good.update(dict.fromkeys(slot.at, told))
    return "\n\n".join(t for i, t in enumerate(texts) if good[i])


def host_column(url):
    """The host part of an address, in lower case; null for a null address."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: ``host, wrapper``, from all its pages.

    Equal folded streams of a slice of pages are added up in the task that reads them. Streams of a
    host are aligned in three rounds, first in many groups dealt by a hash of the stream, so that a
    host with a third of all pages is no task of its own; within a group, in the order of the text
    of the streams, which makes the wrapper independent of how pages lie in partitions.
    """
    source = pages.select("host", "html")
    schema = fields(source, "host", stream="string")

    def streams(batch):
        sums: dict = {}
        hosts = batch.column("host").to_pylist()
        for host, page in zip(hosts, batch.column("html").to_pylist()):
            items = folded(page_tokens(page)[0])
            name = (host, tuple(map(shape, items)))
            sums[name] = same_shape(sums[name], items) if name in sums else items
        return {
            "host": [host for host, _ in sums],
            "stream": [dumped(items) for items in sums.values()],
        }

    found = map_slices(source, streams, schema, "html").withColumn(
        "form", F.regexp_replace("stream", r"\[\d+,\d+,\d+\]", "#")
    )

    def merge(group):
        rows = sorted(zip(group.column("form").to_pylist(), group.column("stream").to_pylist()))
        merged: dict[str, list] = {}
        for form, stream in rows:
            items = loaded(stream)
            merged[form] = same_shape(merged[form], items) if form in merged else items
        whole: list | None = None
        for items in merged.values():
            whole = items if whole is None else folded(aligned(whole, items))
        out = {"host": group.column("host").slice(0, 1), "stream": [dumped(whole)]}
        return type(group).from_pydict(out, schema=group.select(["host", "stream"]).schema)

    for spread in (*SPREAD, 1):
        dealt = F.pmod(F.xxhash64("form"), F.lit(spread)).cast("int")
        found = (
            found.withColumn("part", dealt)
            .groupBy("host", "part")
            .applyInArrow(merge, schema)
            .withColumn("form", F.regexp_replace("stream", r"\[\d+,\d+,\d+\]", "#"))
        )
    return found.select("host", F.col("stream").alias("wrapper"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: ``page_id, url, text``, the main text of the page.

    Blocks are joined by blank lines; nothing of a main slot is left out. A null page has the empty
    text, as has a page without main text; pages with a null address share a wrapper. Repeated rows
    get equal texts, an empty table gives none. The wrapper side of the join is dealt by one key
    more than it was grouped by, so both sides are plain shuffles and a hot host can be split.
    """
    source = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        host_column(F.col(url_col).cast("string")).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    salt = F.xxhash64("host").alias("salt")
    joined = null_safe(
        source.withColumn("salt", salt),
        host_wrappers(source).withColumn("salt", salt),
        ["host", "salt"],
        "left",
    ).select("page_id", "url", "html", "wrapper")
    schema = fields(joined, "page_id", "url", text="string")

    def texts(batch):
        rows = zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": [main_text(page, wrapper) for page, wrapper in rows],
        }

    return map_slices(joined, texts, schema, "html")


@query("op2_page_text")
def op2_page_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
