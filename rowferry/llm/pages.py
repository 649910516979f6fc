"""Main text of web pages by template deduction from equivalence classes.

The tokens of a page are its tags, each with the path of open elements, and
its runs of text. Tokens of one host that occur equally often on every page
share an occurrence vector and form a class; vectors are compared by sums of
hashes over (page, count), so they are gathered by partial aggregation and no
task holds a host. A class found on at least half of the host's distinct pages, with
several tokens, a tag among them, is valid if it nests: all of it lies in one
slot between neighbours of the host's widest class. Valid classes make up the
host's template. What fills the slots is extracted: the article or main element
whole; on pages without one the slot with most of the text that differs, which
names of asides only help to choose. Texts of the template outside it are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.session import settled as settle

#: Pages a class must be found on at least, besides half of the host's.
MIN_PAGES = 3
#: Distinct tokens that a task gathers before it passes them on.
GATHERED = 200_000

# Elements of HTML.
CONTAINERS = frozenset("article aside center details div dl fieldset footer form header main menu nav ol search section table tbody td tr ul".split())
LISTS = frozenset("dl menu ol ul".split())
HEADING = re.compile("h[1-6]|hgroup")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("caption dd dt head html body option tbody td tfoot th thead title tr".split()) | {"dd", "dt"}
PARAGRAPH_SCOPE = frozenset("button caption html object table td th template".split())
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Elements, roles and names of what is no article.
ASIDE_ELEMENTS = frozenset(
    "head nav aside footer form button select textarea script style noscript template iframe svg math menu dialog object canvas audio video".split()
)
NEVER_ELEMENTS = frozenset("head button select textarea script style noscript template iframe svg math object canvas audio video".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs pager "
    "pagination footer masthead topbar toolbar share sharing social follow related recommended recommendations newsletter subscribe "
    "subscription signup login copyright disclaimer".split()
)
CONTENT_NAMES = frozenset("content main article post entry page has with no".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|iframe|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@lru_cache(maxsize=4096)
def _aside(name: str, attributes: str, inside: bool) -> int:
    """How little an element holds an article: 0 for it may, 1 by its name or as a form, 2 by its kind, 3 if it is
    not shown or holds comments. ``inside`` an article."""
    if name in NEVER_ELEMENTS:
        return 3
    own = 1 if name == "form" else 2 if name in ASIDE_ELEMENTS or name == "header" and not inside else 0
    if "=" not in attributes and "hidden" not in attributes:
        return own
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 3
    role = found.get("role", "").lower()
    if role in ASIDE_ROLES:
        own = max(own, 1 if role == "form" else 2)
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    if name in ("html", "body", "main"):
        return own
    if name == "article":
        if not COMMENT_NAMES.isdisjoint(names.split()):
            return 3
        return max(own, int(not ASIDE_NAMES.isdisjoint(names.split())))
    parts = set(re.findall(r"[a-z]+", names))
    if not COMMENT_NAMES.isdisjoint(parts):
        return 3
    named = CONTENT_NAMES.isdisjoint(parts) and (not ASIDE_NAMES.isdisjoint(parts) or "header" in parts and not inside)
    return max(own, int(named))


@lru_cache(maxsize=4096)
def _main(name: str, attributes: str) -> int:
    """2 for an article, 1 for a main element."""
    if name == "article" or "articleBody" in attributes:
        return 2
    return int(name == "main" or 'role="main"' in attributes or "role='main'" in attributes)


def parse(html: str) -> Iterator[tuple[str, str, int, int, bool, tuple[int, int]]]:
    """Tokens (kind, label or text, aside, main, in a link, saved) in page order.

    An article or main element that opens in an aside of degree 1 or 2 is none itself;
    ``saved`` is that degree and the element's number, else (0, 0).

    Kinds: '<' and '>' for opened and closed elements, 't' for text, 'b' for
    the border of a block, 's' for a space. Open paragraphs, list items and
    cells end where HTML ends them; end tags without a start are left out.
    """
    names: list[str] = []
    paths: list[str] = [""]
    asides: list[int] = [0]
    mains: list[int] = [0]
    saves: list[tuple[int, int]] = [(0, 0)]
    opened = 0
    links = 0
    last = 0

    def pop(depth):
        nonlocal links
        while len(names) > depth:
            name = names.pop()
            paths.pop()
            aside, main, saved = asides.pop(), mains.pop(), saves.pop()
            links -= name == "a"
            if name in BLOCK:
                yield "b", "", aside, main, False, saved
            yield ">", f"{paths[-1]}</{name}", aside, main, False, saved

    for m in TOKEN.finditer(html):
        if m.start() > last:
            yield "t", html[last : m.start()], asides[-1], mains[-1], links > 0, saves[-1]
        last = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:
            depth = len(names) - 1
            while depth >= 0 and names[depth] != name and (name in BLOCK or names[depth] not in BLOCK):
                depth -= 1
            if depth >= 0 and names[depth] == name:
                yield from pop(depth)
            continue
        if name in ENDS_PARAGRAPH:
            depth = len(names) - 1
            while depth >= 0 and names[depth] != "p" and names[depth] not in PARAGRAPH_SCOPE:
                depth -= 1
            if depth >= 0 and names[depth] == "p":
                yield from pop(depth)
        if name in SIBLINGS:
            same, scope = SIBLINGS[name]
            depth = len(names) - 1
            while depth >= 0 and names[depth] not in same and names[depth] not in scope:
                depth -= 1
            if depth >= 0 and names[depth] in same:
                yield from pop(depth)
        attributes = m[4] or m[7] or ""
        if name in VOID:
            yield ("b" if name == "hr" else "s"), "", asides[-1], mains[-1], False, saves[-1]
            continue
        opened += 1
        own, kind, saved = _aside(name, attributes, mains[-1] == 2), _main(name, attributes), saves[-1]
        main, aside = max(mains[-1], kind), max(asides[-1], own)
        if kind and not own and 0 < asides[-1] < 3:
            aside, saved = 0, (asides[-1], opened)
        yield "<", f"{paths[-1]}<{name}", aside, main, False, saved
        if name in BLOCK:
            yield "b", "", aside, main, False, saved
        names.append(name)
        paths.append(f"{paths[-1]}/{name}")
        asides.append(aside)
        mains.append(main)
        saves.append(saved)
        links += name == "a"
    if last < len(html):
        yield "t", html[last:], asides[-1], mains[-1], links > 0, saves[-1]


def text_token(run: str) -> str:
    return f"#{xxhash.xxh64_hexdigest(run)}"


def page_tokens(html: str) -> dict[str, tuple[int, int]]:
    """Token -> how often it occurs, and its first place."""
    found: dict[str, tuple[int, int]] = {}
    place = 0
    for kind, label, *_ in parse(html):
        if kind in "bs":
            continue
        if kind == "t":
            label = label.strip()
            if not label:
                continue
            label = text_token(label)
        place += 1
        old = found.get(label)
        found[label] = (old[0] + 1, old[1]) if old else (1, place)
    return found


def host() -> Column:
    """The host in a url, in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def contents(pages: DataFrame) -> DataFrame:
    """(host, key, html): the distinct contents of each host's pages."""
    rows = pages.select(host().alias("host"), F.xxhash64("html").alias("key"), "html").where("host <> ''")
    copied = settle(rows.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    # Only copies are dealt anew with their html.
    once = rows.join(copied, ["host", "key"], "left_anti")
    return once.unionByName(rows.join(copied, ["host", "key"], "left_semi").dropDuplicates(["host", "key"]))


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, v, w, place): of each token its pages, its occurrence vector's hash in two sums, and the sum of its first places."""
    schema = "host string, token string, pages long, v long, w long, place long"
    columns = ["host", "token", "pages", "v", "w", "place"]
    types = [pa.string(), pa.string(), *[pa.int64()] * 4]

    def task(batches):
        gathered: dict[tuple[str, str], list[int]] = {}

        def given():
            rows = [(*k, *v) for k, v in gathered.items()]
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], columns)

        for batch in batches:
            for name, key, html in zip(*(c.to_pylist() for c in batch.columns)):
                for token, (count, place) in page_tokens(html or "").items():
                    value = xxhash.xxh64_intdigest(f"{key}:{count}")
                    held = gathered.get((name, token))
                    if held is None:
                        gathered[name, token] = [1, value >> 33, value & 0x7FFFFFFF, place]
                    else:
                        held[0] += 1
                        held[1] += value >> 33
                        held[2] += value & 0x7FFFFFFF
                        held[3] += place
                if len(gathered) > GATHERED:
                    yield given()
        if gathered:
            yield given()

    rows = contents(pages).select("host", "key", "html")
    sums = [F.sum(c).alias(c) for c in columns[2:]]
    return rows.mapInArrow(task, schema).groupBy("host", "token").agg(*sums)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of classes on at least half of the host's pages, by place, with their class.

    Equal pages of a host count once. A host with fewer than MIN_PAGES distinct pages has no template.
    """
    keys = pages.select(host().alias("host"), F.xxhash64("html").alias("key")).where("host <> ''").distinct()
    counts = keys.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= MIN_PAGES)
    often = token_vectors(pages).join(counts, "host").where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), F.col("all") / 2))
    token = F.struct((F.col("place") / F.col("pages")).alias("place"), "token")
    classes = often.groupBy("host", "pages", "v", "w").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    tagged = classes.where((F.size("tokens") > 1) & F.exists("tokens", lambda t: ~t["token"].startswith("#")))
    return tagged.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("rank"), (-F.size("tokens")).alias("size"), "tokens"))).alias("template"))


def nested_tokens(template: list[list[tuple[float, str]]] | None) -> frozenset[str]:
    """The tokens of valid classes; classes come widest first, their tokens by place."""
    if not template:
        return frozenset()
    borders = [place for place, _ in template[0]]
    found = set()
    for number, tokens in enumerate(template):
        slots = {sum(b < place for b in borders) for place, _ in tokens}
        if number == 0 or len(slots) == 1:
            found.update(t for _, t in tokens)
    return frozenset(found)


class Run(NamedTuple):
    text: str
    aside: int
    main: int
    link: bool
    saved: tuple[int, int]
    own: bool
    slot: int
    node: int


def _size(runs: list[Run]) -> int:
    return sum(len(r.text.strip()) for r in runs)


def _article(runs: list[Run]) -> list[Run] | None:
    """The runs in articles, else in main elements; None if there are none.

    Articles that stand in a form, or in an element of an aside's name, count if one of them has more text than
    the others have together; those in elements that are asides by their kind only if there are no others.
    """
    level = max((r.main for r in runs if not r.saved[0] and r.text.strip()), default=0)
    plain = [r for r in runs if level and not r.saved[0] and r.main >= level]
    for degree in (1, 2):
        saved = [r for r in runs if r.saved[0] == degree]
        best = max((r.main for r in saved if r.text.strip()), default=0)
        sizes: dict[tuple[int, int], int] = {}
        for r in saved:
            sizes[r.saved] = sizes.get(r.saved, 0) + len(r.text.strip())
        other = _size(plain) if level else 0 if degree == 1 else _size([r for r in runs if not r.saved[0] and not r.link])
        if best and max(sizes.values()) > other and (degree == 1 or not level):
            return [r for r in saved if r.main >= best]
    return plain or None


def _kept(blocks: list[list[Run]], parents: list[int], names: list[str]) -> list[list[Run]]:
    """The blocks of a page without article or main elements that are no template and no navigation."""

    def chain(node: int) -> Iterator[int]:
        while node:
            yield node
            node = parents[node]

    def nearest(block: list[Run]) -> int:
        return next((n for n in chain(block[0].node) if names[n] in CONTAINERS), 0)

    words: dict[int, int] = {}
    varying: dict[int, int] = {}
    prose = []
    for number, block in enumerate(blocks):
        for r in block:
            size = len(r.text.strip())
            if size and not r.link:
                for n in (0, *chain(r.node)):
                    words[n] = words.get(n, 0) + any(map(str.isalnum, r.text))
                    if r.own and names[n] in CONTAINERS or not n:
                        varying[n] = varying.get(n, 0) + size * r.own
                if r.own and any(map(str.isalnum, r.text)):
                    prose.append(number)
        if any(HEADING.fullmatch(names[n]) for n in chain(block[0].node)) and any(r.own and r.text.strip() for r in block):
            prose.append(number)
    # The innermost element with most of the prose that differs from page to page; later elements are further in.
    slot = max((n for n, size in varying.items() if 2 * size > varying[0]), default=0)
    first, last = (min(prose), max(prose)) if prose else (len(blocks), -1)
    out = []
    for number, block in enumerate(blocks):
        near, above = nearest(block), set(chain(block[0].node))
        within = not slot or slot in above
        between = within and first <= number <= last
        if not any(r.own and r.text.strip() for r in block) and not (between or slot and near == slot):
            continue
        linked = 2 * _size([r for r in block if r.link]) > _size(block)
        if linked and near and near != slot and not words.get(near) and not any(HEADING.fullmatch(names[n]) for n in above):
            if not within or not slot and (number < first or names[near] not in LISTS):
                continue
        out.append(block)
    return out


def extract(html: str, template: frozenset[str] = frozenset()) -> str:
    """The blocks of the article, joined by an empty line.

    Text stands in the article, else in the main element; nothing is dropped there but asides. On other pages the
    article's slot is the innermost element with most of the text that differs from the host's other pages: blocks
    that the template holds go if they lie outside it, as do lists and divisions of nothing but links. An element of
    an aside's name holds the article if its slot of the template has more such text than all that is not named so.
    If nothing is left the page is the template's only filling and keeps its text.
    """
    blocks: list[list[Run]] = [[]]
    parents, names, stack, slot = [0], [""], [0], 0
    for kind, label, aside, main, link, saved in parse(html):
        if kind in "<>":
            slot += label in template
            if kind == "<":
                parents.append(stack[-1])
                names.append(label.rpartition("<")[2])
                stack.append(len(names) - 1)
            else:
                stack.pop()
        elif kind == "b":
            if blocks[-1]:
                blocks.append([])
        elif aside < 2:
            run = label.strip()
            own = kind == "t" and bool(run) and text_token(run) not in template
            blocks[-1].append(Run(unescape(label) if kind == "t" else " ", aside, main, link, saved, own, slot, stack[-1]))
    runs = [r for block in blocks for r in block]
    chosen = _article([r for r in runs if not r.aside])
    if chosen is None:
        sizes: dict[int, int] = {}
        for r in runs:
            if template and r.aside and r.own and not r.link:
                sizes[r.slot] = sizes.get(r.slot, 0) + len(r.text.strip())
        widest = max(sizes, key=lambda k: sizes[k], default=None)
        if widest is not None and sizes[widest] <= _size([r for r in runs if not r.aside and r.own and not r.link]):
            widest = None
        shown = [[r for r in block if not r.aside or r.slot == widest] for block in blocks]
        shown = [block for block in shown if any(r.text.strip() for r in block)]
        # Without a template each text is the page's own.
        kept = _kept(shown, parents, names) or _kept([[r._replace(own=True) for r in block] for block in shown], parents, names)
    else:
        inside = set(map(id, chosen))
        kept = [[r for r in block if id(r) in inside] for block in blocks]
    texts = (" ".join("".join(r.text for r in block).split()) for block in kept)
    return "\n\n".join(t for t in texts if t)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page; the text is empty where there is none, or no html.

    Rows are pages each for itself: repeated rows are extracted alike and count
    once in their host's template. Pages without a host have no template.
    """
    pages = pages.select("page_id", "url", "html")
    templates = settle(deduce_templates(pages).select("host", F.col("template.tokens").alias("template")), "templates")
    p, t = pages.withColumn("host", host()).alias("p"), templates.alias("t")
    rows = p.join(t, F.col("p.host") == F.col("t.host"), "left").select("p.page_id", "p.url", "p.html", "p.host", "t.template")

    def task(batches):
        texts: dict[str, frozenset[str]] = {}
        for batch in batches:
            found = []
            for number, (html, name) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist())):
                if name not in texts:
                    if len(texts) > 1000:
                        texts.clear()
                    template = batch.column("template")[number].as_py()
                    texts[name] = nested_tokens(template and [[(x["place"], x["token"]) for x in tokens] for tokens in template])
                found.append(extract(html or "", texts[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(task, f"{kinds}, text string")
