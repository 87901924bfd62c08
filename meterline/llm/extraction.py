"""Main-text extraction from web pages by container paths that a host's pages agree on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .urlfilter import split_url

# Element names and class words.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside body center dd details div fieldset figure main section td form".split())
DROPPED = frozenset(
    "head nav header footer aside form button select option dialog menu search svg math canvas audio video object applet label "
    "fieldset".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer colophon copyright sidebar sidebars side aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond responses discussion "
    "share sharing social related recommended recommendations teaser teasers outbrain taboola form search".split()
)
#: Compounds that are written as one word.
DROPPED_COMPOUND = re.compile(r"^comments?(?:list|area|section|box|form|block|body|thread|wrap|wrapper|count)$|^(?:advert|cookie|sidebar|breadcrumb|newsletter|adsby)|(?:sidebar|nav|menu|footer|header|banner)$")
#: Layout words such as ``sidebar`` say nothing against an <article>; these do.
ASIDES = frozenset("comment comments reply teaser teasers related recommended promo sponsored ad ads advert advertisement".split())
#: Words that also mark the layout of a wrapper; alone they don't drop what holds most of a page's text.
LAYOUT = frozenset("nav navbar navigation menu menus toolbar topbar header masthead footer sidebar sidebars side aside rail widget widgets banner".split())
#: Class words that say what an element has or lacks, not what it is.
MODIFIER = re.compile(r"^(?:has|with|without|no)(?:[-_]|(?=[A-Z]))")
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
GOOD_WORDS = frozenset("article content entry main post story text body".split())
#: What an open element of this name is closed by.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
    "p": BLOCK,
}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
MIN_SHARE = 0.9  # of the text that isn't dropped; a container with less leaves too much out


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        if m[5]:
            found.setdefault("hidden", "")
        else:
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


class Block:
    """One block of text, the containers it is in, and how much of it is links."""

    __slots__ = ("containers", "link_chars", "marked", "text")

    def __init__(self, text: str, containers: tuple[tuple[str, int], ...], link_chars: int, marked: tuple[int, ...] = ()) -> None:
        self.text, self.containers, self.link_chars, self.marked = text, containers, link_chars, marked

    def weight(self) -> int:
        return max(0, len(self.text) - 2 * self.link_chars)


def _label(name: str, attributes: dict[str, str]) -> str:
    """A tag with its classes in general form: sorted, digits as #."""
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([name, *classes])


def _is_dropped(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element goes whatever it holds."""
    if name in DROPPED or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return name == "article" and not ASIDES.isdisjoint(_words(attributes))


def _words(attributes: dict[str, str]) -> list[str]:
    """The words of an element's classes and id, less modifiers such as ``has-sidebar``."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return [w.lower() for c in names if not MODIFIER.match(c) for w in _WORD.findall(c)]


def _marks(name: str, attributes: dict[str, str]) -> list[str]:
    """The words of classes and id that speak for dropping an element, unless it holds the article; see ``_unmarked``."""
    if name in ("html", "body", "main", "article"):
        return []
    return [w for w in _words(attributes) if w in DROPPED_WORDS or DROPPED_COMPOUND.search(w)]


class Marked:
    """An element with marks, and whether a <main> or <h1> is in it."""

    __slots__ = ("aside", "heads", "layout")

    def __init__(self, marks: list[str]) -> None:
        self.aside = not ASIDES.isdisjoint(marks)
        self.layout = all(w in LAYOUT or w.endswith(("sidebar", "nav", "menu", "footer", "header", "banner")) for w in marks)
        self.heads = False


def _unmarked(found: list[Block], marked: dict[int, Marked], articles: dict[int, tuple[int, ...]]) -> list[Block]:
    """The blocks less those in marked elements, from the innermost out.

    A marked element stays if it has a <main> or <h1>, or, its marks not being those of an aside, the fullest <article>
    (``articles``: the marked elements around each), or, all its marks being of layout, more than half of what is left of the text.
    """
    if not marked:
        return found
    sizes = dict.fromkeys(articles, 0)
    for b in found:
        for _, number in b.containers:
            if number in sizes:
                sizes[number] += b.weight()
    around = articles[max(sizes, key=sizes.get)] if sizes else ()
    for number in sorted(marked, reverse=True):
        m = marked[number]
        if m.heads or (number in around and not m.aside):
            continue
        own = sum(b.weight() for b in found if number in b.marked)
        if not (m.layout and 2 * own > sum(b.weight() for b in found)):
            found = [b for b in found if number not in b.marked]
    return found


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in page order, less what is dropped. Missing and misplaced end tags are put up with."""
    out: list[Block] = []
    if not html:
        return out
    open_: list[tuple[str, str, bool, int]] = []  # name, label, dropped, number
    path: tuple[tuple[str, int], ...] = ()
    marked: dict[int, Marked] = {}
    articles: dict[int, tuple[int, ...]] = {}
    inside: tuple[int, ...] = ()  # open marked elements
    dropped, links, number, text, link_chars = 0, 0, 0, [], 0

    def end_block() -> None:
        nonlocal link_chars
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append(Block(line, path, link_chars, inside))
            text.clear()
        link_chars = 0

    def close(to: int) -> None:
        """Close open elements down to the first ``to``."""
        nonlocal dropped, inside, path
        while len(open_) > to:
            name, _, was_dropped, own = open_.pop()
            dropped -= was_dropped
            if inside and inside[-1] == own:
                inside = inside[:-1]
            if name in CONTAINER:
                path = path[:-1]

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece and not dropped:
            text.append(piece)
            if links:
                link_chars += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name == "a":
                links = 0
            elif name in BLOCK or any(o[0] == name for o in open_):
                if name in BLOCK:
                    end_block()
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == name:
                        close(i)
                        break
                    if open_[i][0] in ("td", "th", "article", "main") and name not in ("table", "tr", "body", "html"):
                        break
            continue
        if name in RAW:
            ending = _ENDS[name].search(html, at)
            at = ending.end() if ending else end
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            else:
                text.append(" ")
            continue
        rest = m[3] if m[2] else m[6]
        if name == "a":
            links = 1
        attributes = _attributes(rest) if rest.strip(" /\n\t") else {}
        marks = _marks(name, attributes)
        is_dropped = _is_dropped(name, attributes) or bool(marks) and name not in BLOCK
        if name not in BLOCK and not is_dropped:
            continue
        if name in BLOCK:
            end_block()
            links = 0
            for i in range(len(open_) - 1, -1, -1):
                if name in CLOSED_BY.get(open_[i][0], ()):
                    close(i)
                    break
                if open_[i][0] in CONTAINER or open_[i][0] in ("ul", "ol", "dl", "table"):
                    break
        if rest.endswith("/") and name not in BLOCK:
            continue
        number += 1
        label = _label(name, attributes)
        open_.append((name, label, is_dropped, number))
        dropped += is_dropped
        if marks and not is_dropped:
            marked[number] = Marked(marks)
            inside = (*inside, number)
        if not dropped and name in ("main", "h1"):
            for i in inside:
                marked[i].heads = True
        if not dropped and name == "article":
            articles[number] = inside
        if name in CONTAINER:
            path = (*path, (label, number))
    end_block()
    return _unmarked(out, marked, articles)


def _paths(block: Block) -> Iterator[str]:
    """The generalised path of each container around a block, from the outermost in."""
    for i in range(len(block.containers)):
        yield "/".join(label for label, _ in block.containers[: i + 1])


def container_scores(found: list[Block]) -> dict[str, float]:
    """For each container path of a page its share of the text, links counted off."""
    weights = {id(b): b.weight() for b in found}
    total = sum(weights.values())
    scores: dict[str, float] = {}
    for b in found:
        for p in _paths(b) if total else ():
            scores[p] = scores.get(p, 0.0) + weights[id(b)] / total
    return scores


def level(path: str) -> int:
    """How plainly a container is named as an article's: 3 by <article>, 2 by <main>, 1 by a class."""
    name, *classes = path.rsplit("/", 1)[-1].split(".")
    named = any(not GOOD_WORDS.isdisjoint(_WORD.findall(c)) for c in classes)
    return {"article": 3, "main": 2}.get(name, int(named))


def prefer(path: str, share: float) -> tuple:
    """The order in which containers are taken.

    Those with at least MIN_SHARE of the text come first, then the most plainly named; of named ones the
    fullest, of others the innermost. What has less than MIN_SHARE isn't taken on a page of its own (``extract``).
    """
    named = level(path)
    return share >= MIN_SHARE, named, round(share, 2) if named else 0.0, path.count("/"), share, path


def extract(found: list[Block], path: str | None) -> str:
    """The blocks under ``path``; if the page lacks it, those under the page's own best container."""
    kept = [b.text for b in found if path is not None and path in _paths(b)]
    if not kept:
        scores = container_scores(found)
        best = max(scores, key=lambda p: prefer(p, scores[p])) if scores else None
        if best is not None and scores[best] < MIN_SHARE:
            best = None
        kept = [b.text for b in found if best is None or best in _paths(b)]
    return "\n\n".join(kept)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares by host and path, summed over a batch."""
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        full: Counter = Counter()
        for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            for path, share in container_scores(blocks(html)).items():
                sums[host, path] = sums.get((host, path), 0.0) + share
                full[host, path] += share >= MIN_SHARE
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in sums], pa.string()),
                pa.array([k[1] for k in sums], pa.string()),
                pa.array(list(sums.values()), pa.float64()),
                pa.array([level(k[1]) for k in sums], pa.int32()),
                pa.array([full[k] for k in sums], pa.int64()),
            ],
            ["host", "path", "share", "level", "full"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: the container that each host's pages (url, html) vote for.

    A page gives each of its containers its share of the page's text. A path's votes, divided by
    those of the fullest container, which is as good as the number of pages, are its mean share; see ``prefer``, but
    here a path has enough if it holds MIN_SHARE of the text on half of the pages.
    """
    voted = (
        pages.select(split_url(F.col("url"))[0].alias("host"), "html")
        .where("html is not null")
        .mapInArrow(_vote, "host string, path string, share double, level int, full long")
        .groupBy("host", "path", "level")
        .agg(F.sum("share").alias("share"), F.sum("full").alias("full"))
    )
    voted = staged(voted, "extraction-votes")
    fullest = voted.groupBy("host").agg(F.max("share").alias("fullest_share"))
    shares = voted.join(fullest, "host").withColumn("full", F.col("full") >= F.col("fullest_share") / 2).withColumn("share", F.round(F.col("share") / F.col("fullest_share"), 6))
    ranked = shares.withColumn(
        "order",
        F.struct(
            F.col("full").alias("enough"),
            "level",
            F.when(F.col("level") > 0, F.round("share", 2)).otherwise(0.0).alias("fullest"),
            F.size(F.split("path", "/")).alias("depth"),
            "share",
            "path",
        ),
    )
    return ranked.groupBy("host").agg(F.max_by("path", "order").alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["html"].to_pylist(), batch["path"].to_pylist(), strict=True)
        texts = [extract(blocks(html), path) for html, path in pairs]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each row of ``pages`` (page_id, url, html), from the whole page.

    Pages vote by host on the container that holds the article, and each is then extracted from its host's winning
    path; a page without that container uses its own best one. Menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments are left out by their elements, roles, classes and ids, but classes and ids
    don't drop a wrapper that holds the article (see ``_unmarked``).
    Character references are decoded, white space in a block becomes one space, and blocks are joined by a blank line.

    Returns page_id, url, text, n_chars: a row for each row. Null and empty pages have an empty text; pages with a null url, or
    one without ``://``, vote together as one host.
    """
    winners = staged(host_paths(pages), "extraction-hosts")
    keyed = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    found = keyed.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return found.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
