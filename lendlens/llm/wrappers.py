"""Main text of web pages by inferred wrappers.

The pages of a host come from a few templates. A wrapper is a union-free regular expression over
their tokens: elements and text slots, some optional, some repeated. It is found by aligning the
token streams of the host one after another. Elements nest, so each element has an expression of its
own content. Where two contents differ, what only one has becomes optional; neighbours of one kind,
or sequences of up to `PERIOD` kinds that follow each other, become repeated groups; texts that
differ become slots, texts that agree on all pages are template. Every page then is read along the
wrapper of its host, and the slots of the article give its text.

Tasks align their own pages first, so a host of any size sends one wrapper per task; these are
aligned in two steps, dealt by host and salt and then by host. An expression of more than `MOST`
items becomes one repeated group of optional items, which matches all that the expression did.

The article is what stands in `article` elements; on pages without, in `main`; otherwise the part of
the wrapper that holds most text outside links, without template texts and link lists. Inside,
menus, footers, sidebars, notices, adverts, forms, scripts, comments and the like are left out, known
by element, role, or words of class and id.

Defined cases: null html is empty; a page without article text gives an empty text; a null url or one
without host belongs to the host of no name; repeated rows are pages of their own, but copies alone
make no text a template; markup that ends early is closed where it ends; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.session import materialize

PERIOD, MOST = 4, 64
SALTS = 64
# Wrappers that a task holds at a time before it sends them on.
HELD = 2000
# Elements nested deeper than this only part texts; browsers have such a bound as well.
DEEPEST = 96

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|template|textarea|title|iframe|noscript|noembed|noframes|xmp)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
PLAIN = re.compile(r"[a-z_-]{1,24}")  # class names with digits are often made up for one page
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Element names and words that authors use for parts beside the article.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol "
    "optgroup option p pre search section select summary svg math table tbody td tfoot th thead tr ul video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BESIDE = frozenset("nav footer aside form menu dialog head select button svg math object video audio canvas search fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices nav navbar navigation menu sidebar aside footer header masthead comment comments respond replies reply disqus share "
    "sharing social related breadcrumb breadcrumbs pagination pager popup modal overlay newsletter subscribe widget toolbar login "
    "signup searchbox searchform alert".split())
PARAGRAPHS = frozenset("p li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6 tr tbody ul ol dl table".split())
LANDMARKS = frozenset("html body article main".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}


# Pages as token streams ----------------------------------------------------------------------


@dataclass(slots=True)
class Element:
    """An element of a page: its kind, and text and elements in page order."""

    kind: str
    content: list = field(default_factory=list)


def kind_of(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The kind of an element, and whether it stands beside the article."""
    beside = name in BESIDE or name == "header" and not inside
    label = name
    if attributes and not attributes.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        beside |= found.get("role", "").lower() in BESIDE_ROLES
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        if names and name not in LANDMARKS:
            for each in names:
                words = re.findall(r"[a-z0-9]+", each)
                beside |= bool(words) and words[0] not in ("has", "with", "no") and (words[0] in BESIDE_WORDS or words[-1] in BESIDE_WORDS)
            label += "".join(f".{each}" for each in names[:3] if PLAIN.fullmatch(each))
    return label + "!" * beside, beside


def read_page(source: str) -> Element:
    """The page as nested elements; inline markup, comments and what stands beside the article are dropped."""
    root = Element("")
    stack, names = [root], [""]
    hidden = 0  # number of open elements up to the one that stands beside the article, 0 if none
    links = articles = 0
    pieces: list[tuple[str, bool]] = []
    flat: dict[str, int] = {}  # open elements by name that are nested too deep to be kept
    at = 0

    def in_head() -> bool:
        return hidden > 0 and names[hidden - 1] == "head"

    def text(piece: str) -> None:
        if in_head() and not piece.isspace():
            leave_head()
        if piece and not hidden:
            pieces.append((html.unescape(piece) if "&" in piece else piece, links > 0))

    def close_text() -> None:
        if pieces:
            words = " ".join("".join(p for p, _ in pieces).split())
            if words:
                stack[-1].content.append((words, sum(len(p) for p, linked in pieces if linked)))
            pieces.clear()

    def pop() -> None:
        nonlocal hidden, articles
        close_text()
        stack.pop()
        articles -= names.pop() in ("article", "main")
        if hidden > len(stack):
            hidden = 0

    def leave_head() -> None:
        while in_head():
            pop()

    for found in TOKEN.finditer(source):
        if found.start() > at:
            text(source[at:found.start()])
        at = found.end()
        raw, slash, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text(" ")
        elif name == "a":
            links = 0 if slash else 1
        if name not in BLOCKS:
            continue
        if slash:
            if flat.get(name):
                flat[name] -= 1
                close_text()
            elif name in names:
                while names[-1] != name:
                    pop()
                pop()
            continue
        links = 0
        if names[-1] == "p":
            pop()
        if name in ENDS:
            ended, scope = ENDS[name]
            place = len(names) - 1
            while place > 0 and names[place] not in ended and names[place] not in scope:
                place -= 1
            if place > 0 and names[place] in ended:
                while len(names) > place:
                    pop()
        close_text()
        if name in ("body", "html") and name in names:
            continue
        if in_head():  # it was not ended
            leave_head()
        if len(stack) > DEEPEST and name not in VOID:
            flat[name] = flat.get(name, 0) + 1
            continue
        if hidden:
            if name not in VOID:
                stack.append(Element(name)), names.append(name)
                articles += name in ("article", "main")
            continue
        kind, beside = kind_of(name, attributes, articles > 0)
        element = Element(kind)
        stack[-1].content.append(element)
        if name not in VOID:
            stack.append(element), names.append(name)
            articles += name in ("article", "main")
            if beside:
                hidden = len(stack)
    if at < len(source):
        text(source[at:])
    while len(stack) > 1:
        pop()
    close_text()
    return root


# Wrappers ------------------------------------------------------------------------------------
# An item of an expression is a dict: "k" its kind ("#" for a text slot, "(...)" for a group), "o"
# whether it may be absent, "r" whether it may repeat, "c" the expression inside; slots hold "h", the
# hash of a text that is alike on all pages (else None), "n" texts, "s" their characters, "l" those in links.


def slot(text: str, linked: int) -> dict:
    return {"k": "#", "o": 0, "r": 0, "h": zlib.crc32(text.encode("utf-8", "surrogatepass")), "n": 1, "s": len(text), "l": linked}


def expression(element: Element) -> list[dict]:
    """The expression of the content of one element, repeats folded."""
    items = []
    for part in element.content:
        items.append(slot(*part) if isinstance(part, tuple) else {"k": part.kind, "o": 0, "r": 0, "c": expression(part)})
    return folded(items)


def merged(a: dict, b: dict) -> dict:
    """One item for two of the same kind."""
    item = {"k": a["k"], "o": a["o"] | b["o"], "r": a["r"] | b["r"]}
    if a["k"] == "#":
        return item | {"h": a["h"] if a["h"] == b["h"] else None, "n": a["n"] + b["n"], "s": a["s"] + b["s"], "l": a["l"] + b["l"]}
    return item | {"c": aligned(a["c"], b["c"])}


def as_group(items: list[dict], optional: bool = False) -> dict:
    return {"k": f"({' '.join(i['k'] for i in items)})", "o": int(optional), "r": 1, "c": items}


def zipped(a: list[dict], b: list[dict]) -> list[dict]:
    return [merged(x, y) for x, y in zip(a, b)]


def name_of(item: dict) -> str:
    return re.split(r"[.!]", item["k"], maxsplit=1)[0]


def alike(a: dict, b: dict) -> bool:
    """Whether neighbours can be one repeated item; containers of different content are different things."""
    if a["k"] != b["k"]:
        return False
    return a["k"] == "#" or name_of(a) in PARAGRAPHS or {i["k"] for i in flattened(a["c"])} == {i["k"] for i in flattened(b["c"])}


def folded(items: list[dict]) -> list[dict]:
    """Neighbours of one kind become one repeated item, sequences that follow each other a repeated group."""
    for period in range(1, PERIOD + 1):
        if len(items) < 2 * period:
            continue
        made, at = [], 0
        while at < len(items):
            whole, after, repeats = items[at:at + period], at + period, 1
            while after + period <= len(items) and all(map(alike, whole, items[after:after + period])):
                whole = zipped(whole, items[after:after + period])
                after, repeats = after + period, repeats + 1
            if repeats == 1:
                made.append(items[at])
                at += 1
                continue
            made.append(whole[0] | {"r": 1} if period == 1 else as_group(whole))
            at = after
        items = made
    if len(items) > MOST:
        kept: dict[str, dict] = {}
        for item in flattened(items):
            kept[item["k"]] = merged(kept[item["k"]], item) if item["k"] in kept else item
        return [as_group([i | {"o": 1} for i in kept.values()], True) | {"k": "(*)"}]
    return items


def flattened(items: list[dict]) -> Iterator[dict]:
    for item in items:
        if item["k"].startswith("("):
            yield from flattened(item["c"])
        else:
            yield item


def grouped_like(items: list[dict], other: list[dict]) -> list[dict]:
    """Sequences that are a repeated group in the other expression become such a group here."""
    for group in other:
        if not group["k"].startswith("(") or group["k"] == "(*)":
            continue
        kinds, size = [i["k"] for i in group["c"]], len(group["c"])
        made, at = [], 0
        while at < len(items):
            if [i["k"] for i in items[at:at + size]] == kinds:
                made.append(as_group(items[at:at + size]) | {"r": 0})
                at += size
            else:
                made.append(items[at])
                at += 1
        items = made
    return items


def aligned(a: list[dict], b: list[dict]) -> list[dict]:
    """The expression of two expressions: common items are merged, others become optional."""
    for x, y in ((a, b), (b, a)):
        if len(x) == 1 and x[0]["k"] == "(*)":
            kept = {i["k"]: i for i in x[0]["c"]}
            for item in flattened(y):
                kept[item["k"]] = merged(kept[item["k"]], item) | {"o": 1} if item["k"] in kept else item | {"o": 1}
            return [x[0] | {"c": list(kept.values())}]
    if [i["k"] for i in a] == [i["k"] for i in b]:
        return zipped(a, b)
    a, b = grouped_like(a, b), grouped_like(b, a)
    # Longest common subsequence of the kinds.
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    made, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["k"] == b[j]["k"]:
            made.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            made.append(a[i] | {"o": 1})
            i += 1
        else:
            made.append(b[j] | {"o": 1})
            j += 1
    return folded(made)


# Reading pages along a wrapper ---------------------------------------------------------------


class Reader:
    """An expression as an automaton over its elements and slots; item lists of elements nest."""

    def __init__(self, items: list[dict]) -> None:
        self.atoms: list[dict] = []
        self.follow: list[set[int]] = []
        self.first, self.last, self.empty = self.built(items)
        self.inner: dict[int, Reader] = {}
        kinds = [a["k"] for a in self.atoms]
        self.several = {k for k in kinds if kinds.count(k) > 1}

    def built(self, items: list[dict]) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for item in items:
            if item["k"].startswith("("):
                f, l, e = self.built(item["c"])
            else:
                self.atoms.append(item), self.follow.append(set())
                f, l, e = {len(self.atoms) - 1}, {len(self.atoms) - 1}, False
            if item["r"]:
                for p in l:
                    self.follow[p] |= f
            e = e or bool(item["o"])
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def fits(self, content: list, known: dict) -> bool:
        """Whether the expression matches a content down to its last element."""
        found = self.places(content, known)
        return (found[-1] in self.last if found else self.empty) and all(
            place is not None and (isinstance(part, tuple) or self.inside(place).fits(part.content, known))
            for part, place in zip(content, found))

    def suits(self, atom: int, part: tuple | Element, known: dict) -> bool:
        """Whether an atom of the right kind matches; looks inside only where another atom has that kind."""
        if isinstance(part, tuple) or self.atoms[atom]["k"] not in self.several:
            return True
        inner = self.inside(atom)
        if (id(part), id(inner)) not in known:
            known[id(part), id(inner)] = inner.fits(part.content, known)
        return known[id(part), id(inner)]

    def places(self, content: list, known: dict) -> list[int | None]:
        """The atom that each part of a content stands for; None where the expression does not fit.

        `known` keeps which elements match which expressions while one page is read.
        """
        kinds = ["#" if isinstance(part, tuple) else part.kind for part in content]
        steps: list[dict[int, int | None]] = []
        now: dict[int, int | None] = {}
        for number, kind in enumerate(kinds):
            then: dict[int, int | None] = {}
            if number == 0 or not now:
                then = {q: None for q in sorted(self.first) if self.atoms[q]["k"] == kind and self.suits(q, content[number], known)}
            else:
                for p in now:
                    for q in sorted(self.follow[p]):
                        if self.atoms[q]["k"] == kind and q not in then and self.suits(q, content[number], known):
                            then[q] = p
            if not then:  # cannot happen for a page that the wrapper was made from
                then = {q: None for q, atom in enumerate(self.atoms) if atom["k"] == kind}
            steps.append(then)
            now = then
        found: list[int | None] = [None] * len(kinds)
        at = None
        for number in range(len(kinds) - 1, -1, -1):
            if at is None or at not in steps[number]:
                ends = [q for q in steps[number] if number < len(kinds) - 1 or q in self.last] or list(steps[number])
                at = ends[0] if ends else None
            found[number] = at
            at = steps[number][at] if at is not None else None
        return found

    def inside(self, atom: int) -> Reader:
        if atom not in self.inner:
            self.inner[atom] = Reader(self.atoms[atom].get("c", []))
        return self.inner[atom]


def weight(item: dict) -> int:
    """Characters outside links in the slots of an item that differ between pages."""
    if item["k"] == "#":
        return (item["s"] - item["l"]) * (item["h"] is None or item["n"] < 2)
    return 0 if name_of(item) in ("article", "main") else sum(weight(i) for i in item["c"])


def slots_of(items: list[dict]) -> Iterator[dict]:
    for item in items:
        if item["k"] == "#":
            yield item
        else:
            yield from slots_of(item["c"])


def marked(wrapper: list[dict]) -> list[dict]:
    """Marks each slot with its part: "article", "main", "body" (most text outside links) or none."""
    if all(s["h"] is not None for s in slots_of(wrapper)):
        for s in slots_of(wrapper):  # one page, or copies of it: no text is known to be template
            s["h"] = None

    def mark(items: list[dict], part: str) -> None:
        for item in items:
            if item["k"] == "#":
                item["part"] = part
            else:
                name = name_of(item)
                mark(item["c"], "article" if "article" in (name, part) else "main" if "main" in (name, part) else part)
    mark(wrapper, "")
    region = wrapper
    while True:  # down to the element that holds most of the text, as long as one does
        choices = [i for i in flattened(region) if i["k"] != "#" and name_of(i) not in PARAGRAPHS]
        heaviest = max(choices, key=weight, default=None)
        if heaviest is None or 2 * weight(heaviest) <= sum(map(weight, region)):
            break
        region = heaviest["c"]
    for s in slots_of(region):
        if not s["part"] and s["h"] is None and 2 * s["l"] <= s["s"]:
            s["part"] = "body"
    return wrapper


def main_text(page: Element, reader: Reader) -> str:
    """The texts of the page in slots of its article, joined by spaces."""
    texts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
    seen = {"body"}

    def walk(element: Element, reader: Reader, within: str) -> None:
        for part, place in zip(element.content, reader.places(element.content, known)):
            if isinstance(part, tuple):
                where = within if place is None else reader.atoms[place]["part"]
                if where:
                    texts[where].append(part[0])
                continue
            name = re.split(r"[.!]", part.kind, maxsplit=1)[0]
            seen.add(name)
            inside = name if name in texts and within != "article" and name != "body" else within
            walk(part, reader.inside(place) if place is not None else Reader([]), inside)
    known: dict = {}
    walk(page, reader, "")
    return " ".join(texts[next(part for part in texts if part in seen)])


# Spark ---------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def page_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of the pages of a task."""
    held: dict[str, list[dict]] = {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = expression(read_page(source or ""))
            held[host] = aligned(held[host], found) if host in held else found
        if len(held) > HELD:
            yield wrapper_rows(held)
            held = {}
    if held:
        yield wrapper_rows(held)


def wrapper_rows(held: dict[str, list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])


def joined_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the wrappers of each host; rows are sorted by host, so one is held at a time."""
    at, held = None, None
    for batch in batches:
        for host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = json.loads(wrapper)
            if held is not None and host == at:
                held = aligned(held, found)
            else:
                if held is not None:
                    yield wrapper_rows({at: held})
                at, held = host, found
    if held is not None:
        yield wrapper_rows({at: held})


def infer_wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, wrapper (JSON) of all pages of each host."""
    schema = "host string, wrapper string"
    partial = pages.select(host_of(F.col(url)).alias("host"), F.col(source).cast("string").alias("html")).mapInArrow(page_wrappers, schema)
    # Copies of one expression with different sums stay apart; the salt follows the wrapper.
    salted = partial.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions("host", "wrapper")
    some = salted.mapInArrow(joined_wrappers, schema)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(joined_wrappers, schema)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    wrappers = materialize(infer_wrappers(pages, url, source), "wrappers")
    rows = pages.select(key, url, F.col(source).cast("string").alias("_html"), host_of(F.col(url)).alias("host"))
    placed = rows.join(wrappers, "host", "left")

    @F.arrow_udf("string")
    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        readers: dict[str, Reader] = {}
        for sources, wrappers in batches:
            found = []
            for source, wrapper in zip(sources.to_pylist(), wrappers.to_pylist()):
                if wrapper not in readers:
                    if len(readers) >= HELD:
                        readers.clear()
                    readers[wrapper] = Reader(marked(json.loads(wrapper)))
                found.append(main_text(read_page(source or ""), readers[wrapper]))
            yield pa.array(found, pa.string())
    return placed.select(key, url, texts("_html", "wrapper").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
