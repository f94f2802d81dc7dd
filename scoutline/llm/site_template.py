"""HTML extraction: removal of site templates.

Pages are parsed into elements. Every element subtree is hashed; Spark counts the pages of each
host that hold a subtree, and subtrees that recur beside differing content are deleted, in what a
page marks as its article or main part as elsewhere. Copies of one article recur too: copies of a
page count once, and the longest texts beside a subtree must differ between half of its pages.
Elements whose tag, role, class or id name a menu, header, footer,
sidebar, notice, advert, form or reader comments are left out everywhere; class and id leave out no
element that holds the page's main part.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch, parts

# HTML element names by the part that they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option dialog object svg canvas audio video map menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
MAIN = frozenset(("article", "main"))
#: An opening tag closes these where one is open, up to the scope given by the second set.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
# Roles, and words of class and id, that name what is no part of the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup login sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond disqus "
    "replies share sharing social related recommended widget skiplink pagination pager".split()
)
# Names of lists of links, which name prose as well, and words that say no more than where or what kind of box something is.
LINKED = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager related recommended share sharing social widget promo promotion notice sidebar".split())
PLAIN = frozenset(
    "site page main top bottom left right primary secondary global inner outer upper lower header title body content wrap wrapper container box bar block area section region zone slot unit "
    "list item items link links button buttons icon icons form panel row col column group holder placeholder text message label thread post posts article articles story stories entry read reading".split()
)
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>\x00]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
#: One attribute after the other: the name, and the value if there is one.
ATTRIBUTE = re.compile(r"""([^\s/=>"'][^\s/=>]*)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: What holds the page or its main part is no part of a menu, whatever its class and id say.
HOLDERS = MAIN | {"html", "body"}
#: A heading is named for what follows it.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A subtree is template that is on so many pages of its host, and on such a share of them. On hosts of fewer
#: than twice PAGES pages half of them are enough, but no fewer than LEAST.
PAGES, SHARE, LEAST = 8, 0.01, 3
#: So many texts beside a subtree stand for the content that it recurs with.
BESIDE = 3
#: Up to so many templates are broadcast, 16 bytes each; more meet the pages in a join.
BROADCAST = 2_000_000


class Element:
    __slots__ = ("tag", "dropped", "main", "parts", "hash", "holds_main", "named", "linked_name", "rank", "text", "linked")

    def __init__(self, tag: str, dropped: bool, main: bool):
        self.tag, self.dropped, self.main, self.holds_main = tag, dropped, main, main
        self.parts: list[Element | str] = []
        self.hash = 0
        self.named, self.linked_name, self.rank, self.text, self.linked = False, False, 0, 0, 0


def attributes(tag: str) -> dict[str, str]:
    """Names and values of an opening tag, in lower case; of repeated names the first counts, as in a browser."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def hidden(of: dict[str, str]) -> bool:
    """Whether the element does not show."""
    return "hidden" in of or of.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", "")))


def names(of: dict[str, str]) -> set[str]:
    """The words of NAMED that class and id say of an element. A compound counts if all of its words are of NAMED or say only what kind of box it is: share-buttons, but not share-price."""
    out: set[str] = set()
    for token in (of.get("class", "") + " " + of.get("id", "")).split():
        words = {w for w in re.split(r"[^a-z]+", token) if w}
        if words <= NAMED | PLAIN:
            out |= words & NAMED
    return out


def settle(root: Element) -> None:
    """Drops what is named by class or id, but not what holds the main part: a main element, or articles of which none is outside of what is named.

    Inside a main part what has only names of lists of links goes if half of its text or more is in links.
    """
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.parts if isinstance(x, Element) and not x.dropped]
    for e in reversed(order):
        own = 0 if not e.main else 1 if e.tag == "article" else 2
        e.rank = max([own, *(x.rank for x in e.parts if isinstance(x, Element))])
        e.text = sum(len("".join(x.split())) if isinstance(x, str) else x.text for x in e.parts)
        e.linked = e.text if e.tag == "a" else sum(x.linked for x in e.parts if isinstance(x, Element))
    todo, found = [(root, False)], False
    while todo:
        holders = []
        while todo:
            top, inside = todo.pop()
            inside |= top.main
            for x in top.parts:
                if not isinstance(x, Element) or x.dropped:
                    continue
                if x.named and x.rank < 2 and not (inside and x.linked_name and 2 * x.linked < x.text):
                    x.dropped = True
                    if x.rank:
                        holders.append((x, inside))
                    continue
                found |= x.main
                todo.append((x, inside))
        if not found:
            for x, _ in holders:
                x.dropped = False
            todo = holders


def parse(page: str) -> Element:
    """The element tree. What a browser would repair is repaired simply: unknown end tags are
    skipped, an end tag closes what is open within it, an unfinished tag or comment ends the page.
    Where open tags lie in the stack is kept by tag, so that no step looks through the stack."""
    root = Element("html", False, False)
    stack, at, end, any_named, mains = [root], 0, len(page), False, 0
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []

    def close(n: int) -> None:
        nonlocal mains
        while len(stack) > n:
            e = stack.pop()
            stack[-1].holds_main |= e.holds_main
            places[e.tag].pop()
            mains -= e.main
            if e.tag in BLOCKS:
                blocks.pop()

    def last(tags: frozenset[str]) -> int:
        """Where the innermost open one of these is; 0 if none is open."""
        return max(places[t][-1] if places[t] else 0 for t in tags)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].parts.append(page[at:])
            break
        if lt > at:
            stack[-1].parts.append(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if after in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and page[lt + 2 : lt + 3].isalpha()):
            stack[-1].parts.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        of = attributes(m[3])
        role = (of.get("role", "").split() or [""])[0]
        if tag in ("html", "body") and not hidden(of) and role not in ROLES:
            stack[-1].parts.append(Element(tag, False, False))
            continue
        if tag in CLOSES:
            own, scope = CLOSES[tag]
            while (i := last(own)) > last(scope):
                close(i)
                if tag != "tr":
                    break
        elif tag in BLOCKS and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        inside = mains > 0
        dropped = tag in DROPPED or hidden(of) or role in ROLES or (tag == "header" and not inside)
        e = Element(tag, dropped, not dropped and (tag in MAIN or role == "main"))
        found = names(of) if not dropped and not e.main and tag not in HOLDERS | HEADINGS else set()
        e.named, e.linked_name = bool(found), found <= LINKED
        any_named |= e.named
        stack[-1].parts.append(e)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            at = page.find(">", stop.start()) + 1 if stop else end
            at = at or end
            continue
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCKS - VOID:
            places[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            mains += e.main
            stack.append(e)
    close(1)
    if any_named:
        settle(root)
    return root


def hashed(root: Element) -> None:
    """Sets the hash of every subtree from its tag, texts and the hashes of its elements, without recursion."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.parts if isinstance(x, Element)]
    for e in reversed(order):
        h = xxhash.xxh3_64(e.tag.encode())
        for x in e.parts:
            h.update(x.hash.to_bytes(8, "little") if isinstance(x, Element) else b"\x00" + " ".join(x.split()).encode())
        e.hash = h.intdigest()


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def longest(texts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted(set(texts), reverse=True)[:BESIDE]


def subtrees(root: Element) -> tuple[int, list[tuple[int, list[int]]]]:
    """The hash of the content (the marked main part, else all), and the distinct elements that may be deleted, each
    with the hashes of the longest texts of the content outside of it; none if there is no such text."""
    hashed(root)
    whole = not marked(root)
    texts: list[tuple[int, int]] = []
    found: list[tuple[int, int, int]] = []
    # (element, whether it is in the content, position, texts before it)
    stack: list[list] = [[root, whole, 0, 0]]
    while stack:
        e, inside, i, first = top = stack[-1]
        if i == len(e.parts):
            stack.pop()
            if e is not root and not e.main and not e.holds_main and e.tag not in VOID and e.parts:
                found.append((signed(e.hash), first, len(texts)))
            continue
        top[2] += 1
        x = e.parts[i]
        if isinstance(x, Element):
            if not x.dropped:
                stack.append([x, inside or x.main, 0, len(texts)])
        elif inside and (t := " ".join(x.split())):
            texts.append((len(t), signed(xxhash.xxh3_64_intdigest(t.encode()))))
    before: list[list[tuple[int, int]]] = [[]]
    for t in texts:
        before.append(longest([*before[-1], t]))
    after: list[list[tuple[int, int]]] = [[]]
    for t in reversed(texts):
        after.append(longest([*after[-1], t]))
    out = {}
    for h, i, j in found:
        if h not in out and (near := [x for _, x in longest(before[i] + after[len(texts) - j])]):
            out[h] = near + near[-1:] * (BESIDE - len(near))
    content = xxhash.xxh3_64()
    for _, h in texts:
        content.update(h.to_bytes(8, "little", signed=True))
    return signed(content.intdigest()), sorted(out.items())


def text_of(root: Element, template: frozenset[int] = frozenset()) -> str:
    """Text blocks in page order. If the page marks its main part (outside of what is dropped) only that, else all; without template subtrees, which hashed() must have told apart."""
    whole = not marked(root)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if line := " ".join(html.unescape("".join(now)).split()):
            blocks.append(line)
        now.clear()

    # (element, position, whether it is in the main part)
    stack: list[list] = [[root, 0, whole]]
    while stack:
        e, i, inside = top = stack[-1]
        if i == len(e.parts):
            stack.pop()
            if e.tag in BLOCKS:
                flush()
            continue
        top[1] += 1
        x = e.parts[i]
        if isinstance(x, str):
            if inside:
                now.append(x)
        elif x.dropped or (x.hash and not x.main and not x.holds_main and signed(x.hash) in template):
            if x.tag in BLOCKS or x.tag in DROPPED - {"button", "svg"}:
                flush()
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
            stack.append([x, 0, inside or x.main])
    flush()
    return "\n".join(blocks)


def marked(root: Element) -> bool:
    todo = [root]
    while todo:
        e = todo.pop()
        if e.main:
            return True
        todo += [x for x in e.parts if isinstance(x, Element) and not x.dropped and x.holds_main]
    return False


def recurring(root: Element, site: int, sites: np.ndarray, hashes: np.ndarray) -> frozenset[int]:
    """Which of the page's subtrees are templates of its host; templates are sorted by host and hash."""
    first, last = np.searchsorted(sites, [site, site + 1]) if site < 2**63 - 1 else (np.searchsorted(sites, site), len(sites))
    if first == last:
        return frozenset()
    hashed(root)
    own, todo = [], [root]
    while todo:
        e = todo.pop()
        own.append(signed(e.hash))
        todo += [x for x in e.parts if isinstance(x, Element)]
    own, there = np.array(own, np.int64), hashes[first:last]
    return frozenset(own[there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own].tolist())


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_subtrees(pages: DataFrame) -> DataFrame:
    """(key, site, content, found: of each subtree its hash and the texts beside it) of every page row."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("beside", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            got = [subtrees(parse(x.as_py() or "")) for x in b.column("html")]
            found = pa.array([[{"hash": h, "beside": near} for h, near in f] for _, f in got], kind)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("site"), pa.array([c for c, _ in got], pa.int64()), found], ["key", "site", "content", "found"])

    return pages.select("key", "site", "html").mapInArrow(run, "key long, site long, content long, found array<struct<hash: long, beside: array<long>>>")


def templates(seen: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(site, hash) of the subtrees that recur beside differing content.

    Pages of equal content count once. The pages of a subtree are told apart by the texts beside it: each rank of
    these is counted, and the middle count must reach ``pages`` (fewer on small hosts), ``share`` of the
    host's pages, and half of the pages of the subtree.
    """
    once = seen.groupBy("site", "content").agg(F.min_by("found", "key").alias("found"))
    size = once.groupBy("site").agg(F.count("*").alias("n"))
    one = once.select("site", F.explode("found").alias("f")).select("site", "f.hash", F.posexplode("f.beside").alias("rank", "text"))
    ranks = one.groupBy("site", "hash", "rank", "text").agg(F.count("*").alias("c")).groupBy("site", "hash", "rank").agg(F.count("*").alias("d"), F.sum("c").alias("c"))
    # BESIDE counts a subtree.
    counts = ranks.where(F.col("c") >= min(LEAST, pages)).groupBy("site", "hash").agg(F.sort_array(F.collect_list("d"))[BESIDE // 2].alias("d"), F.max("c").alias("c"))
    least = F.least(F.lit(pages), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / 2)))
    return counts.join(size, "site").where((F.col("d") >= least) & (F.col("d") >= F.col("n") * share) & (2 * F.col("d") >= F.col("c"))).select("site", "hash")


def main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars, one row per input row.

    Null html counts as empty, with an empty text. Pages without a URL share the empty host.
    Null and repeated page_ids are rows like any other; other columns are ignored; an empty table
    gives an empty result. Pages of any length and depth are parsed whole, in time that grows with their length.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = pages.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn("site", F.xxhash64(host(F.col("url"))))
    with Scratch(pages.sparkSession) as scratch:
        seen = scratch.save(site_subtrees(keyed))
        found = scratch.keep(templates(seen))
        held = None
        if found.count() <= broadcast:
            rows = found.toArrow().sort_by([("site", "ascending"), ("hash", "ascending")])
            held = pages.sparkSession.sparkContext.broadcast((rows.column("site").to_numpy(), rows.column("hash").to_numpy()))
            met = keyed.withColumn("cut", F.lit(None).cast("array<long>"))
        else:
            # Bounded by the elements of one page: rows of one key are equal pages.
            own = seen.select("key", "site", F.explode("found.hash").alias("hash"))
            cut = scratch.keep(own.join(found, ["site", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("cut")))
            met = keyed.join(cut, "key", "left")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = []
            for x, site, gone in zip(b.column("html"), b.column("site").to_pylist(), b.column("cut"), strict=True):
                root = parse(x.as_py() or "")
                template = frozenset(gone.as_py() or ()) if held is None else recurring(root, site, *held.value)
                if template and held is None:
                    hashed(root)
                texts.append(text_of(root, template))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "site", "cut").mapInArrow(run, schema)
