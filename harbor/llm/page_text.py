"""Main text of web pages by consensus host paths.

Pages of a host share templates. In a first pass each page scores its containers and
votes for the generalised tag-class path of the one that holds its text best. Votes
are counted per host. In a second pass every page gives the text of the elements on
the path its host has elected, or of its own choice where it has no such element.
"""

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import trimmed
from harbor.sources.scratch import materialize

HOLDS = 0.6  # share of a page's running text that the core of its container must hold
LONG_BLOCK = 40  # characters from which a block counts as running text
LINKED = 0.5  # share of linked characters from which a block does not

# Element names of the HTML standard by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
CLOSED_SCOPE = {"table", "td", "th", "ul", "ol", "dl", "button", "html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements and words of class, id and role names that mark what is not the article.
NOT_TEXT = RAW | set(
    "head nav footer aside form button select option input svg math canvas object audio video template dialog menu search map".split()
)
NOT_ARTICLE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner sidebar sidebars "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus reply replies respond discussion related recommended recommendations "
    "search form widget widgets complementary contentinfo teaser outbrain taboola skip".split()
)
# Of these, words that name sections of articles as well, and words that only say what kind of box it is.
OFTEN_ARTICLE = set(
    "discussion alert search form social notice notices notification notifications complementary skip banner modal popup overlay widget "
    "widgets menu menus promotion promotions sponsor sponsored subscription signup login toolbar teaser respond reply share".split()
)
BOXES = set(
    "box block area wrap wrapper container section list bar inner item items link links button buttons content thread post posts unit "
    "slot top bottom left right side panel group row col tags icon icons title heading body main site page primary secondary".split()
)
WHOLE = {"html", "body", "main", "article"}  # never dropped for their names
NEGATIONS = {"has", "no", "with", "without", "not", "non", "is"}

# A quote opens a value right after an equals sign only; elsewhere it is a character of the tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    label: str
    parent: int
    dropped: bool
    soft: bool = False  # a header or inside one: of a header in the article only headings stay
    doubtful: bool = False  # in a box of the article that may be none of it: linked blocks go
    heading: bool = False  # a heading or inside one


ROOT = Element("", "", -1, False)


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, linked characters


def _names(attributes: str) -> tuple[list[str], str, str, bool]:
    """Class names, the role, the id, and whether the element is hidden."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    bare = ATTRIBUTE.sub(" ", attributes).lower().split()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    return found.get("class", "").split(), found.get("role", ""), found.get("id", ""), hidden


def _marks_other(names: str) -> bool:
    before = ""
    for part in NAME_PART.findall(names):
        part = part.lower()
        if part in NOT_ARTICLE and before not in NEGATIONS:
            return True
        before = part
    return False


def _marks_inside(classes: list[str]) -> tuple[bool, bool]:
    """Whether classes below main or article mark a box that is surely not the article's, and whether they may.

    A name of other words too, as in related-work, or a word that names sections of articles only may.
    """
    sure = maybe = False
    for name in classes:
        if not _marks_other(name):
            continue
        parts = {part.lower() for part in NAME_PART.findall(name)}
        if parts & NOT_ARTICLE - OFTEN_ARTICLE and parts <= NOT_ARTICLE | BOXES:
            sure = True
        else:
            maybe = True
    return sure, maybe


def _label(tag: str, classes: list[str]) -> str:
    """Tag and classes; digits become one mark and names that look generated are left out, as are those of a whole page."""
    if tag in ("html", "body"):
        return tag
    general = {re.sub(r"\d+", "#", name) for name in classes if len(re.findall(r"\d", name)) < 3}
    return ".".join([tag, *sorted(general)])


def _described(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """Label of an element, and whether it is dropped, doubtful, or a header; ``inside`` main or article."""
    classes, role, own_id, hidden = _names(attributes) if attributes else ([], "", "", False)
    # Below main or article an id is the article's own: a slug of its heading or section.
    told = " ".join([*classes, role] + [own_id] * (not inside))
    header = tag == "header" or "header" in (part.lower() for part in NAME_PART.findall(told))
    sure, maybe = _marks_inside(classes) if inside else (_marks_other(told), False)
    other = tag not in WHOLE and (sure or _marks_other(role))
    return _label(tag, classes), tag in NOT_TEXT or hidden or other, maybe and tag not in WHOLE, header and tag not in WHOLE | HEADINGS


REMEMBERED_CHARS = 200  # tags of longer attributes are described anew
_remembered = lru_cache(4096)(_described)


def parse(source: str) -> Page:
    """The elements of a page and its blocks of text, in page order.

    Lenient as browsers are: end tags may be missing or stray. A block is the text
    between two starts or ends of block elements, white space as single blanks.
    """
    page = Page()
    elements, stack = page.elements, []  # numbers of elements rise along the stack
    opened: dict[str, list[int]] = {}  # those of the stack by tag
    pieces: list[str] = []
    first, linked = -1, 0

    def flush() -> None:
        nonlocal pieces, first, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((first, text, min(linked, len(text))))
            pieces, first, linked = [], -1, 0

    def add(text: str) -> None:
        nonlocal first, linked
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if stack and elements[stack[-1]].dropped:
            return
        pieces.append(text)
        if text.strip():
            if first < 0:
                first = stack[-1] if stack else -1
            if opened.get("a"):
                linked += len(text.strip())

    def close_to(place: int) -> None:
        if any(elements[n].tag not in INLINE for n in stack[place:]):
            flush()
        for n in stack[place:]:
            opened[elements[n].tag].pop()
        del stack[place:]

    def scope(tags: set[str], stop: set[str]) -> int | None:
        """The place of the innermost of ``tags`` if none of ``stop`` is further in."""
        found = max((opened[tag][-1] for tag in tags if opened.get(tag)), default=-1)
        if found < 0 or any(opened[tag][-1] > found for tag in stop if opened.get(tag)):
            return None
        return bisect_left(stack, found)

    at = 0
    while True:
        match = TOKEN.search(source, at)
        if match is None:
            add(source[at:])
            break
        add(source[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            place = scope({tag}, set())
            if place is not None:
                if tag in INLINE:
                    opened[tag].pop()
                    del stack[place]
                else:
                    close_to(place)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in ENDS_PARAGRAPH:
            place = scope({"p"}, CLOSED_SCOPE)
            if place is not None:
                close_to(place)
        if tag in HEADINGS:
            place = scope(HEADINGS, CLOSED_SCOPE | ENDS_PARAGRAPH - HEADINGS)
            if place is not None:
                close_to(place)
        if tag in ENDED_BY:
            while (place := scope(ENDED_BY[tag], {"table", "ul", "ol", "dl", "select"})) is not None:
                close_to(place)
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        parent = stack[-1] if stack else -1
        above = elements[parent] if parent >= 0 else ROOT
        describe = _described if len(match[3]) > REMEMBERED_CHARS else _remembered
        label, dropped, maybe, header = describe(tag, match[3], bool(opened.get("main") or opened.get("article")))
        elements.append(Element(
            tag, label, parent, above.dropped or dropped, above.soft or header, above.doubtful or maybe, above.heading or tag in HEADINGS,
        ))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if not (tag in ("path", "use") and match[0].endswith("/>")):
            stack.append(len(elements) - 1)
            opened.setdefault(tag, []).append(len(elements) - 1)
    flush()
    return page


def kept_blocks(page: Page) -> list[tuple[int, str, int]]:
    """The blocks without those in doubtful boxes that are mostly linked."""
    return [
        (element, text, linked)
        for element, text, linked in page.blocks
        if element < 0 or not page.elements[element].doubtful or linked < LINKED * len(text)
    ]


def path_of(page: Page, element: int) -> str:
    """The generalised path of an element."""
    labels = []
    while element >= 0:
        labels.append(page.elements[element].label)
        element = page.elements[element].parent
    return "/".join(reversed(labels))


def on_path(page: Page, path: str) -> list[int]:
    """The elements of a generalised path. Of each element it is known how far its own path goes along."""
    reach: list[int] = []
    for element in page.elements:
        at = reach[element.parent] if element.parent >= 0 else 0
        step = element.label if element.parent < 0 else "/" + element.label
        reach.append(at + len(step) if at >= 0 and path.startswith(step, at) else -1)
    return [n for n, end in enumerate(reach) if end == len(path)]


def chosen_container(page: Page) -> int:
    """The element that holds the article: all of the running text, or what is around most of it; -1 where none does.

    It is the deepest element inside the body that holds all running text. Where there is
    none, what is around the deepest one that holds enough, up to the body, is the article.
    A main or article around that is taken whole, as headings and leads may stand beside it.
    An element's score is the length of the unlinked long blocks in it; on a page
    without such blocks, of all blocks.
    """
    elements = page.elements
    blocks = [block for block in kept_blocks(page) if block[0] < 0 or not elements[block[0]].soft]
    running = [(n, len(text)) for n, text, linked in blocks if len(text) >= LONG_BLOCK and linked < LINKED * len(text)]
    running = running or [(n, len(text)) for n, text, _ in blocks]
    scores = [0] * len(elements)
    for n, size in running:
        if n >= 0:
            scores[n] += size
    for n in range(len(elements) - 1, -1, -1):  # what is inside comes later
        if elements[n].parent >= 0:
            scores[elements[n].parent] += scores[n]
    least = HOLDS * sum(size for _, size in running)
    small = INLINE | HEADINGS | {"p", "li", "blockquote", "pre"}
    choice = max((n for n, score in enumerate(scores) if score and score >= least and elements[n].tag not in small), default=-1)
    around, at = [], choice
    while at >= 0:
        if elements[at].tag not in ("html", "body"):
            around.append(at)
        at = elements[at].parent
    if not around or choice not in around:
        return choice
    for tag in ("main", "article"):
        named = [n for n in around if elements[n].tag == tag]
        if named:
            return named[-1]
    return max(around, key=lambda n: 0 if elements[n].tag in small else scores[n])


def main_text(page: Page, path: str | None) -> str:
    """The blocks of the elements on ``path``, else of the page's own choice, one to a line."""
    elements = page.elements
    places = set((on_path(page, path) if path else []) or [chosen_container(page)])
    inside: list[int] = []  # the innermost place around each element
    for n, element in enumerate(elements):
        inside.append(n if n in places else inside[element.parent] if element.parent >= 0 else -1)
    out = []
    for element, text, _ in kept_blocks(page):
        place = inside[element] if element >= 0 else -1
        if place < 0 and -1 not in places:
            continue
        if element >= 0 and elements[element].soft:
            article = place >= 0 and elements[place].tag not in ("html", "body") and not elements[place].soft
            if not (article and elements[element].heading):
                continue
        out.append(text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host and the path that most of its pages voted for, the first in order of several."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            votes = []
            for text in batch.column(1):
                page = parse(text.as_py())
                choice = chosen_container(page)
                votes.append(path_of(page, choice) if choice >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string())], ["host", "path"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(source, F.lit("")).alias("html")).filter("host IS NOT NULL")
    votes = rows.mapInArrow(vote, "host string, path string").filter("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = counted.groupBy("host").agg(F.max("votes").alias("votes"))
    return counted.join(best, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path (the one elected by the page's host) of every row.

    Character references are decoded, white space in a block becomes one blank, blocks
    are joined by line ends. A null or empty page has an empty text; a page without a
    host decides alone; equal rows give equal rows. One row per host is joined to the
    pages, which Spark broadcasts while it is small.
    """
    elected = materialize(host_paths(pages, url, source), "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            texts = [main_text(parse(s.as_py()), p.as_py()) for s, p in zip(batch.column(2), batch.column(3), strict=True)]
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes, batch.column(3)],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(source, F.lit("")).alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    rows = rows.join(elected, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long, path string")
