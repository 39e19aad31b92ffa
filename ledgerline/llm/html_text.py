"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. Blocks inside
menus, headers, footers, sidebars, notices, adverts, forms and comments stay as
lines without length, and so do characters of links. Lengths are summed over a
sliding window of lines; text begins at a surge of these sums and ends where they
dive. The span between them with the most text is kept, with the marked lines
inside it taken out. Other spans of the same article, or of the container that
has most of the span, are joined to it with what is between; so are short blocks
and a headline beside it. A container that would be apart, but holds the article or
nearly all of the page's text, is a wrapper and isn't. Where a page marks its article, spans end at its
borders and text outside of it weighs less.

A null or empty page has an empty text; a page without a surge keeps its longest
span of whatever length. Repeated pages come out alike, and pages without page_id or url like
others. Very long pages, of whatever depth, take time in proportion. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices

#: Lines of a window, and what a window's characters have to exceed in a surge.
WINDOW, SURGE = 3, 60
#: Lines without length that a surge may bridge before it dives, and lines from a linked heading to its text.
BRIDGE = 4
#: What a character outside of a page's article weighs when the longest span is chosen.
OUTSIDE = 0.25

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section select table ul button label".split())
_NOISE = frozenset("aside footer form menu nav button select dialog label".split())
_HIDDEN = "script|style|noscript|template|svg|iframe|textarea|title"
_NOISE_NAME = re.compile(
    r"""(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|foot|comments?|commentlist|respond|replies|reply|disqus|discussion|reader-comments|related|recommended|recommendations|share|sharing|social|widget|toolbar|pagination|pager|search|form|hidden|skip)(?:$|[\s_-])""",
    re.I,
)
_NOISE_ELEMENTS = _NOISE - {"form"} | {"header"}
_DISCUSSION_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus|discussion)(?:$|[\s_-])", re.I)
#: Headers hold a site's name outside of an article, and a headline within one.
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: Names that only say what else a page has, such as has-sidebar.
_MENTION = re.compile(r"(?:^|\s)\S*?(?:has|with|without|no)[_-]\S+", re.I)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())

#: Possessive, and without < outside of quotes, so that no broken tag makes it search a page again and again.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({_HIDDEN})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is apart from the page's text, by its name, class, id or role."""
    if name in _NOISE or (name == "header" and not in_article):
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        what, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "role" and value in _NOISE_ROLE):
            return True
        value = _MENTION.sub(" ", value)
        if what in ("class", "id") and name not in ("html", "body", "article", "main") and (_NOISE_NAME.search(value) or (not in_article and _HEADER_NAME.search(value))):
            return True
    return False


class _Line:
    __slots__ = ("article", "container", "heading", "length", "link", "marked", "parts", "title", "words")

    def __init__(self, marked: bool, article: bool, container: int):
        self.parts, self.link, self.marked, self.article, self.container = [], 0, marked, article, container
        self.heading = self.title = False


class _Container:
    """A container of the page: `end` is the number after its last descendant's; number 0 is the page itself."""

    __slots__ = ("discussion", "end", "hidden", "marked", "named", "parent", "starts_article")

    def __init__(self, name: str, attributes: str, parent: int, in_article: bool):
        self.parent, self.end, self.starts_article = parent, 1 << 62, name in _ARTICLE
        self.marked, self.named = _marked(name, attributes, in_article), name in _NOISE_ELEMENTS
        self.hidden = self.discussion = False
        for m in _ATTRIBUTE.finditer(attributes) if self.marked and attributes else ():
            what, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            self.hidden |= what == "hidden" or (what == "aria-hidden" and value == "true")
            self.discussion |= what in ("class", "id") and bool(_DISCUSSION_NAME.search(value))


def _unmark_wrappers(lines: list[_Line], containers: list[_Container]) -> None:
    """Take the mark from containers that hold the page's article, or nearly all of its text, and so can't be apart from it.

    Discussions don't count, for they can be longer than what they are about.
    Steps go inwards, one marked container in another, so this is linear.
    """
    if not any(c.marked for c in containers):
        return
    n = len(containers)
    own, own_article, heads = [0] * n, [0] * n, [0] * n
    for x in lines:
        own[x.container] += x.length
        own_article[x.container] += x.length if x.article else 0
        heads[x.container] += x.title

    def upward(values: list[int]) -> list[int]:
        sums = values[:]
        for i in range(n - 1, 0, -1):
            sums[containers[i].parent] += sums[i]
        return sums

    heads = upward(heads)
    has_heads = [heads[0] > 0 and h == heads[0] for h in heads]
    discussed = [False] * n
    for i, c in enumerate(containers[1:], 1):
        discussed[i] = discussed[c.parent] or (c.discussion and not has_heads[i])
    if any(v for v, d in zip(own, discussed, strict=True) if not d):
        own = [0 if d else v for v, d in zip(own, discussed, strict=True)]
        own_article = [0 if d else v for v, d in zip(own_article, discussed, strict=True)]
    text, article = upward(own), upward(own_article)
    # Sums by the innermost marked container, and the marked ones directly in it.
    near, inner = [0] * n, {}
    free, free_article, starts = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(containers):
        if i and c.marked:
            inner.setdefault(near[c.parent], []).append(i)
        near[i] = i if c.marked or not i else near[c.parent]
        free[near[i]] += own[i]
        free_article[near[i]] += own_article[i]
        starts[near[i]] += c.starts_article
    scope, outside, outside_article, articles = 0, free[0], free_article[0], starts[0]
    while scope in inner:
        found = None
        for i in (max(inner[scope], key=article.__getitem__), max(inner[scope], key=text.__getitem__)):
            c, small = containers[i], outside <= SURGE
            holds_article = article[i] and not c.named and article[i] >= max(outside, 9 * outside_article) and (small or has_heads[i] or not outside_article)
            # Of the text that isn't apart, or where that doesn't surge and no headline tells, of all.
            holds_text = text[i] and not articles and ((has_heads[i] and text[i] >= 9 * outside) or (small and 10 * text[i] >= 9 * text[0]))
            if not c.hidden and (holds_article or holds_text):
                found = i
                break
        if found is None:
            break
        containers[found].marked = False
        scope, outside, outside_article, articles = found, outside + free[found], outside_article + free_article[found], articles + starts[found]


def page_lines(html: str) -> tuple[list[_Line], list[_Container]]:
    """The blocks with words in page order, and the containers in order of their beginnings.

    A line's length is that of its text outside links, 0 if the line is marked.
    """
    lines: list[_Line] = []
    containers = [_Container("", "", -1, False)]
    open_: list[tuple[str, int]] = []  # open containers by name and number
    articles = links = 0
    inline = ""  # the marked element that isn't a container, such as a paragraph
    line = _Line(False, False, 0)

    def end_line() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = _Line(bool(inline), articles > 0, open_[-1][1] if open_ else 0)

    def text(raw: str) -> None:
        line.parts.append(raw)
        if links:
            line.link += len(raw.strip())

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                line.parts.append(" ")
            continue
        closing = bool(m[2])
        if name == "br":
            line.parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in _CONTAINERS:
            if name in _BLOCKS:
                end_line()
            if closing:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == name:
                        for gone, number in open_[i:]:
                            containers[number].end = len(containers)
                            articles -= gone in _ARTICLE
                        del open_[i:]
                        break
            else:
                containers.append(_Container(name, m[4], open_[-1][1] if open_ else 0, articles > 0))
                open_.append((name, len(containers) - 1))
                articles += name in _ARTICLE
            inline, links = "", 0
            line.marked, line.article, line.container = False, articles > 0, open_[-1][1] if open_ else 0
        elif name in _BLOCKS:
            inline = "" if closing or not _marked(name, m[4], articles > 0) else name
            links = 0
            end_line()
            line.heading, line.title = not closing and name in _HEADINGS, not closing and name == "h1"
        elif closing:
            if name == inline:
                inline = ""
                end_line()
        elif m[4] and not inline and name in ("span", "small", "strong", "em", "b", "i", "font", "ins") and _marked(name, m[4], articles > 0):
            end_line()
            inline = name
            line.marked = True
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the page's end cuts off
        text(rest[: cut.start()] if cut else rest)
    end_line()
    found = []
    for x in lines:
        x.words = _SPACE.sub(" ", unescape("".join(x.parts))).strip(" ")
        if x.words:
            x.length = 0 if x.marked else max(0, len(x.words) - x.link)
            found.append(x)
    _unmark_wrappers(found, containers)
    apart = [False] * len(containers)
    for i, c in enumerate(containers):
        apart[i] = c.marked or (c.parent >= 0 and apart[c.parent])
    for x in found:
        if apart[x.container]:
            x.marked, x.length = True, 0
    return found, containers


def _home(lines: list[_Line], containers: list[_Container], first: int, last: int) -> tuple[int, int]:
    """Numbers from and to (without) which containers are inside the deepest one with more than half of a span's text; none if it is the page."""
    held = [0] * len(containers)
    for x in lines[first : last + 1]:
        held[x.container] += x.length
    half, home = sum(held) / 2, 0
    for i in range(len(containers) - 1, 0, -1):
        if held[i] > half:
            home = i
            break
        held[containers[i].parent] += held[i]
    return (home, containers[home].end) if home else (0, 0)


def surges(lines: list[_Line]) -> list[tuple[int, int]]:
    """First and last lines of the spans between surge and dive; there is one where any line has a length."""
    lengths = [x.length for x in lines]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    least = SURGE if max(sums, default=0) > SURGE else 0
    spans, begin, last = [], None, 0
    for i, n in enumerate(lengths):
        if begin is not None and lines[i].article != lines[begin].article:
            spans.append((begin, last))
            begin = None
        if begin is None:
            if sums[i] > least and n:
                begin = last = i
        elif n:
            last = i
        elif not any(lengths[i : i + BRIDGE]):
            spans.append((begin, last))
            begin = None
    if begin is not None:
        spans.append((begin, last))
    return spans


def main_text(html: str | None) -> str:
    """The blocks of the span, between surge and dive, that holds the most text, and what belongs to it; joined by empty lines."""
    lines, containers = page_lines(html or "")
    lengths = [x.length for x in lines]
    if not any(lengths):
        # All text is links; those of an article are all that there is of it.
        return "\n\n".join(x.words for x in lines if x.article and not x.marked)
    spans = surges(lines)
    outside = OUTSIDE if any(x.article and x.length for x in lines) else 1
    first, last = max(spans, key=lambda s: sum(lengths[s[0] : s[1] + 1]) * (1 if lines[s[0]].article else outside))
    article = lines[first].article
    begin, end = (0, 0) if article else _home(lines, containers, first, last)
    here = [x.article == article and (article or begin <= x.container < end) for x in lines]
    # What surges in the same article or container is the same text.
    joined = [s for s in spans if here[s[0]]]
    first, last = min([first, *(s[0] for s in joined)]), max([last, *(s[1] for s in joined)])
    # Short blocks before a surge, or after the last of several, belong to it; those of the same article or container at any distance.
    for step in (-1, 1):
        at = (first if step < 0 else last) + step
        while 0 <= at < len(lines) and lines[at].article == article and (lengths[at] or here[at]):
            if lengths[at]:
                first, last = min(first, at), max(last, at)
            at += step
    # A headline may be a link: the nearest beside the text, or the title of the same article or container.
    begins = first
    for at in range(begins - 1, -1, -1):
        if lines[at].article != article or not (here[at] or at == begins - 1):
            break
        if not lines[at].marked and (lines[at].title or (lines[at].heading and begins - at <= BRIDGE)):
            first = at
            break
    return "\n\n".join(x.words for x in lines[first : last + 1] if not x.marked)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def extract(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


#: SQL can't tell surge from dive; this reads the articles of the test tables by their regular layout.
ORACLE_SQL = r"""
with articles as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) as a from pages
), parts as (
  select page_id, unnest(string_split(regexp_replace(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>', chr(0), 'g'), chr(0))) as part,
    generate_subscripts(string_split(regexp_replace(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>', chr(0), 'g'), chr(0)), 1) as i
  from articles
), blocks as (
  select page_id, i, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(part, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp(;|$)', '&', 'g'), '&copy;', chr(169)), '[\x20\x09-\x0D]+', ' ', 'g')) as block from parts
), texts as (
  select page_id, string_agg(block, chr(10) || chr(10) order by i) as text from blocks where block <> '' group by page_id
)
select pages.page_id, url, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from pages left join texts using (page_id)
"""
