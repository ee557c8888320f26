"""Main text of web pages by union-free wrappers of their hosts.

A page is a stream of tokens: structural tags with their classes, and texts. The streams of a host are aligned one after
the other. Elements that agree are one part of the wrapper; a part that comes again under its parent becomes a repeated
group (with other parts in between, the parent's parts repeat together), and what only some pages have becomes optional.
A text that all pages have at a part is a token of the template; where texts differ the part has a slot. The result is a
regular expression without unions. The part that says it is the article, or else that with most of the text of slots
that is no link, is where the host has its articles; pages are read through it, without the template's texts. A page is
read by its own elements where it has an article element of its own, or nothing at the host's part.

Trees are kept as lists in which parents come before their parts, and each part of a parent has its own name, so that
neither depth nor length of a page costs more than its tokens.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Wrappers that one task aligns before they go on as one, fewer (two at least) where these exceed BYTES in their packed
#: form; pages that must differ for equal texts to be a template.
FOLD, BYTES, DISTINCT = 64, 32_000_000, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.S)
#: Elements whose content is text and no tags, up to their own end tag.
_RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements in a line that hold other elements but no text of an article.
_EMBEDDED = frozenset("template svg object canvas audio video select datalist option optgroup button annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key's kind ends where one of its set begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "p": _CLOSES_P, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "button": {"button"}}
_OUT_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Whole class words, ids and roles of what is no part of an article; related-work or search-algorithms are none.
_OUT_WORD = re.compile(
    r"(?:(?:site|page|main|top|left|right|global|primary|secondary|mobile|post|user|reader|wp|js)[-_])*"
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:s|ed)?|promos?|promoted|promotions?|banners?|nav|navs|navbar|navigation|menus?|breadcrumbs?|side-?bars?|footers?|masthead|(?:site|page|global|top)[-_]?header"
    r"|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|newsletters?|subscribe|subscriptions?|sign-?up|comments?|disqus|responses|reply|replies|related|recommended|recommendations|share|sharing|social|toolbar"
    r"|pagination|pager|widgets?|copyright|skip|search|login|contentinfo|complementary)"
    r"(?:[-_](?:box|bar|block|wrap|wrapper|container|list|lists|area|section|panel|items?|inner|outer|content|text|body|notice|banner|message|posts?|articles?|stories|links?|form|menu|nav|popup|overlay|modal|slot|unit|widgets?|buttons?|icons?|media|top|bottom|left|right|main|sidebar|header|footer|thread|respond|[0-9]+))*",
    re.I,
)
_MAIN_WORDS = re.compile(r"(?:^|[-_ ])(?:article(?:-?body|-?content|-?text)?|post-?(?:content|body)|entry-?(?:content|body)|main-?content|story-?body|page-?content|content)(?:$|[-_ ])", re.I)


@dataclass
class Block:
    """Text of a block, and the part of the page's tree that it is in."""

    part: int
    text: str
    link: int
    out: bool
    main: bool  # an element around it says that it is the main content
    article: bool


class Tree:
    """Parts of a page or a wrapper: parents come first, and no two parts of one parent have one name.

    No part is left out, however many or rare they are. A part is optional where fewer pages have it than its parent, and
    only a part that all pages have can have texts that all have; so an alignment costs what it adds, not the whole.
    """

    def __init__(self) -> None:
        self.parents, self.names, self.at = [-1], [""], {}
        self.repeated, self.mixed = [False], [False]
        self.pages, self.text, self.link = [1], [0], [0]
        self.texts: dict[int, dict[int, int]] = {}  # by part: texts (hash, length) of all pages with it, until one lacks it
        self.distinct: list[int] = []  # hashes of up to DISTINCT different pages

    def part(self, parent: int, name: str, pages: int = 1) -> int:
        found = self.at.get((parent, name))
        if found is None:
            found = self.at[parent, name] = len(self.names)
            for column, x in ((self.parents, parent), (self.names, name), (self.repeated, False), (self.mixed, False), (self.pages, pages), (self.text, 0), (self.link, 0)):
                column.append(x)
        return found

    def optional(self, part: int) -> bool:
        return self.pages[part] < self.pages[self.parents[part]]

    def common(self, part: int) -> dict[int, int]:
        """Texts (hash, length) that every page of the wrapper has at the part."""
        return self.texts.get(part, {}) if self.pages[part] == self.pages[0] else {}

    def packed(self) -> str:
        common = [[k, *map(list, c.items())] for k in self.texts if (c := self.common(k))]
        flags = [[int(x) for x in column] for column in (self.repeated, self.mixed)]
        return json.dumps([self.parents, self.names, *flags, self.pages, self.text, self.link, common, self.distinct], separators=(",", ":"))

    @staticmethod
    def of(packed: str) -> Tree:
        out = Tree()
        out.parents, out.names, out.repeated, out.mixed, out.pages, out.text, out.link, common, out.distinct = json.loads(packed)
        out.texts = {k: dict(map(tuple, c)) for k, *c in common}
        out.at = {(p, n): k for k, (p, n) in enumerate(zip(out.parents, out.names, strict=True)) if k}
        return out

    def slots(self) -> list[int]:
        """Text of each part and those in it that is neither link nor template, over all pages."""
        mass = [max(0, t - 2 * li - (p * sum(self.common(k).values()) if len(self.distinct) >= DISTINCT else 0)) for k, (t, li, p) in enumerate(zip(self.text, self.link, self.pages, strict=True))]
        for k in range(len(mass) - 1, 0, -1):
            mass[self.parents[k]] += mass[k]
        return mass


def _signature(tag: str, attributes: str) -> tuple[str, list[str], bool]:
    """The element's tag with its classes, its words, and whether it is hidden."""
    got = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = html.unescape(" ".join(got.get(k, "") for k in ("class", "id", "role"))).split()
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    fixed = [x for x in got.get("class", "").split() if not re.search("[0-9]", x)]  # numbers differ from page to page
    return ".".join([tag, *fixed]), words, hidden


def parsed(page: str) -> tuple[Tree, list[Block]]:
    """The page's tree and its blocks with text in them, in order; those that are no part of any article are marked out."""
    tree = Tree()
    # tag, part, out, main, article, the parts met in the element, the last of them
    stack: list[list] = [["", 0, False, False, False, set(), 0]]
    open_tags: Counter[str] = Counter()
    found: list[Block] = []
    buffer: list[str] = []
    link = raw = inner = 0  # inner: where the outermost embedded element stands on the stack
    raw_tag, in_link = "", 0

    def flush() -> None:
        nonlocal link
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            _, part, out, main, article, _, _ = stack[inner - 1 if inner else -1]
            found.append(Block(part, text, min(link, len(text)), out, main, article))
        buffer.clear()
        link = 0

    def close(at: int) -> None:
        open_tags.subtract(x[0] for x in stack[at:])
        del stack[at:]

    for m in _TOKEN.finditer(page):
        tag = m[2]
        if tag is None:
            if not raw and not inner and m[4] is not None:
                buffer.append(m[4])
                link += len(m[4]) if in_link else 0
            continue
        tag, closing = tag.lower(), bool(m[1])
        if raw:
            if closing and tag == raw_tag:
                raw = 0
            continue
        if tag in _RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                raw, raw_tag = 1, tag
            continue
        if tag in _INLINE:
            if tag == "a" and (closing or not inner):
                in_link = 0 if closing else 1
            elif tag == "br" and not inner:
                buffer.append(" ")
            continue
        if tag not in _EMBEDDED and not inner:
            flush()
        if tag in _VOID or (tag in _EMBEDDED and m[3].rstrip().endswith("/")):
            continue
        if closing:
            if not open_tags[tag] or tag in ("body", "html"):  # what follows these still belongs to the body
                continue
            at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
            if inner and at < inner:
                flush()
            close(at)
            inner = inner if inner < len(stack) else 0
            continue
        if inner and tag in ("article", "main") and not any(x[0] == "template" for x in stack[inner:]):
            close(inner)  # an article is in no embedded element: that was left open
            inner = 0
            flush()
        while len(stack) > 1 and tag in _ENDS.get(stack[-1][0], ()):
            close(len(stack) - 1)
        inner = inner if inner < len(stack) else 0
        if tag in _EMBEDDED and not inner:
            inner = len(stack)
        signature, words, hidden = _signature(tag, m[3])
        above = stack[-1]
        _, parent, out, main, article, _, _ = above
        heading = tag == "header" and not article and not main
        named = tag not in ("html", "body", "article", "main") and any(map(_OUT_WORD.fullmatch, words))
        out = out or hidden or tag in _OUT_TAGS or heading or named or (tag == "article" and article and any(re.search(r"comment|\bads?\b", w, re.I) for w in words))
        if not out:
            article = article or tag == "article"
            main = main or tag == "main" or "main" in words or bool(_MAIN_WORDS.search(" ".join(words)))
        part = tree.part(parent, signature)
        if part in above[5]:
            tree.repeated[part] = True
            tree.mixed[parent] |= above[6] != part
        above[5].add(part)
        above[6] = part
        open_tags[tag] += 1
        stack.append([tag, part, out, main, article, set(), 0])
    flush()
    return tree, found


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def skeleton(tree: Tree, found: list[Block]) -> Tree:
    """The page's tree as a wrapper of this page alone: parts that hold no text of an article are left out."""
    used = [False] * len(tree.names)
    used[0] = True
    for block in found:
        if not block.out:
            used[block.part] = True
            tree.text[block.part] += len(block.text)
            tree.link[block.part] += block.link
            tree.texts.setdefault(block.part, {})[text_hash(block.text)] = len(block.text)
    for k in range(len(used) - 1, 0, -1):
        used[tree.parents[k]] |= used[k]
    tree.distinct = [text_hash("\n".join(b.text for b in found if not b.out))]
    return _only(tree, used)


def _only(tree: Tree, used: list[bool]) -> Tree:
    """The tree without the parts that are not used; with each used part its parent is."""
    if all(used):
        return tree
    out, new = Tree(), {}
    for k, keep in enumerate(used):
        if keep:
            new[k] = out.part(new[tree.parents[k]], tree.names[k]) if k else 0
            for column in ("repeated", "mixed", "pages", "text", "link"):
                getattr(out, column)[new[k]] = getattr(tree, column)[k]
            if k in tree.texts:
                out.texts[new[k]] = tree.texts[k]
    out.distinct = tree.distinct
    return out


def aligned(a: Tree, b: Tree) -> Tree:
    """The wrapper a, resolved with the wrapper b of other pages of the host; a is changed."""
    place, last = [0] * len(b.names), {}
    a.pages[0] += b.pages[0]
    for k in range(len(b.names)):
        at = 0
        if k:
            new = (place[b.parents[k]], b.names[k]) not in a.at
            place[k] = at = a.part(place[b.parents[k]], b.names[k], 0)
            if not new:
                parent = a.parents[at]
                a.mixed[parent] |= last.get(parent, -1) > at  # the same parts in another order
                last[parent] = at
            a.pages[at] += b.pages[k]
        if at in a.texts:
            there = b.common(k)
            a.texts[at] = {h: n for h, n in a.texts[at].items() if h in there}
        a.repeated[at] |= b.repeated[k]
        a.mixed[at] |= b.mixed[k]
        a.text[at] += b.text[k]
        a.link[at] += b.link[k]
    a.distinct = sorted({*a.distinct, *b.distinct})[:DISTINCT]
    return a


def expression(tree: Tree) -> str:
    """The wrapper as a union-free regular expression: #text is a slot, and texts of the template are counted."""
    inner: list[list[str]] = [["#text"] if t > p * sum(c.values()) else [f"#fixed{len(c)}"] if c else [] for k, (t, p) in enumerate(zip(tree.text, tree.pages, strict=True)) for c in [tree.common(k)]]
    done: list[str] = [""] * len(tree.names)
    children: dict[int, list[int]] = {}
    for k in range(len(tree.names) - 1, -1, -1):
        parts = [done[c] for c in reversed(children.pop(k, []))]
        inside = " ".join([*inner[k], *parts])
        inside = f"({inside})*" if tree.mixed[k] else inside
        if k:
            body = f"<{tree.names[k]}> {inside} </{tree.names[k].split('.')[0]}>"
            mark = "*" if tree.repeated[k] and tree.optional(k) else "+" if tree.repeated[k] else "?" if tree.optional(k) else ""
            done[k] = f"({body}){mark}" if mark else body
            children.setdefault(tree.parents[k], []).append(k)
        else:
            done[k] = inside
    return done[0]


def article_part(tree: Tree) -> int:
    """Where the wrapper has the article: the largest part that says so; else the smallest that holds most of the text."""
    mass = tree.slots()
    best = None
    for k in range(1, len(tree.names)):
        tag, _, classes = tree.names[k].partition(".")
        if tag in ("article", "main") or _MAIN_WORDS.search(classes.replace(".", " ")):
            best = max(best or (False, -1, 0), (tag == "article", mass[k], -k))
    if best is not None:
        return -best[2]
    heaviest: dict[int, int] = {}
    for k in range(1, len(tree.names)):
        if mass[k] > mass[heaviest.get(tree.parents[k], 0)] or tree.parents[k] not in heaviest:
            heaviest[tree.parents[k]] = k
    now = 0
    while now in heaviest and not tree.repeated[heaviest[now]] and mass[heaviest[now]] > 0.6 * mass[now]:
        now = heaviest[now]
    return now


def host_rule(tree: Tree) -> tuple[list[str], list[int]]:
    """The names from the root to the article's part, and the texts of the template at it and below."""
    part = article_part(tree)
    inside = [k == part for k in range(len(tree.names))]
    for k in range(part + 1, len(tree.names)):
        inside[k] = inside[k] or inside[tree.parents[k]]
    fixed = {h for k in tree.texts if inside[k] for h in tree.common(k)} if len(tree.distinct) >= DISTINCT else set()
    path = []
    while part:
        path.append(tree.names[part])
        part = tree.parents[part]
    return path[::-1], sorted(fixed)


def main_text(page: str | None, path: list[str] | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The main text: of the page's own article; else at the host's part, without fixed texts; else of what isn't marked out."""
    tree, found = parsed(page or "")
    found = [b for b in found if not b.out]
    there = [b for b in found if b.article]
    if not there and path:
        part = 0
        for name in path:
            part = tree.at.get((part, name), -1)
            if part < 0:
                break
        if part > 0:
            inside = [False] * len(tree.names)
            inside[part] = True
            for k in range(part + 1, len(inside)):
                inside[k] = inside[tree.parents[k]]
            there = [b for b in found if inside[b.part]]
    if not any(b.article for b in there):
        there = there or [b for b in found if b.main] or found
        there = [b for b in there if not fixed or text_hash(b.text) not in fixed] or there
    return "\n".join(b.text for b in there)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of each batch; a page without text has none."""
    for batch in batches:
        seen: dict[str, Tree] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tree, found = parsed(page or "")
            if any(not b.out for b in found):
                tree = skeleton(tree, found)
                seen[host] = aligned(seen[host], tree) if host in seen else tree
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([t.packed() for t in seen.values()], pa.string())], ["host", "wrapper"])


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(frame["wrapper"]):
        tree = Tree.of(text)
        whole = tree if whole is None else aligned(whole, tree)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [whole.packed()]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of the hosts of pages(url, html)."""
    rows = pages.select(_host(F.col("url")).alias("host"), "html")
    found = materialize(rows.mapInArrow(_skeletons, "host string, wrapper string"), "skeletons")
    while True:  # a host's wrappers are folded some at a time, until each host has one
        at_once = F.greatest(F.lit(2), F.least(F.lit(FOLD), F.floor(BYTES / F.avg(F.length("wrapper")))))
        counts = materialize(found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), at_once.alias("at_once")), "counts")
        if not counts.where("n > 1").limit(1).count():
            return found
        salted = found.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / F.col("at_once"))))
        found = materialize(salted.groupBy("host", "salt").applyInPandas(_fold, "host string, wrapper string"), "folded")


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [host_rule(Tree.of(x.as_py())) for x in batch.column("wrapper")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([f for _, f in found], pa.list_(pa.int64()))], ["host", "path", "fixed"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = [main_text(page.as_py(), path.as_py(), frozenset(fixed.as_py() or ())) for page, path, fixed in zip(part.column("html"), part.column("path"), part.column("fixed"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Blocks are joined by a line feed, white space within one is a single space, references are decoded. A null or empty
    html has an empty text; a null url has the empty host. A page cut off ends its open elements. Rows repeated whole
    are extracted alike. What an article element holds is never held against the host's template. Other columns are not
    read.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    rules = materialize(wrappers(pages).mapInArrow(_rules, "host string, path array<string>, fixed array<long>"), "rules")
    joined = rows.join(rules, "host", "left").select("page_id", "url", "html", "path", "fixed")
    return joined.mapInArrow(_extracted, f"page_id {id_type}, url string, text string, n_chars long")
