import html
import re

import pytest

from ledgerline.llm import html_text
from ledgerline.llm.html_text import extract_text, main_text
from ledgerline.llm.queries import QUERIES
from tests.conftest import same_rows

P1, P2 = "The first paragraph of the article is long enough to be a surge of text.", "The second one follows it and is about as long as the first one was."


def article_of(page):
    """What the test tables' pages hold, read by their own regular layout."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [re.sub(r"[ \t\n\x0b\x0c\r]+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?p>|</?h1>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_test_tables(spark, sf_dir):
    expected = {r["page_id"]: article_of(r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op8_line_blocks"](spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in found} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op8_line_blocks"](spark, sf_dir), duck, html_text.ORACLE_SQL)


NOISE = [
    "<nav><ul><li><a href='/'>Home page of this site</a><li>Other entries of the menu here</ul></nav>", "<header><h1>The Site's own name and motto, rather long</h1></header>", "<footer>&copy; All rights of this page are reserved by us</footer>",
    "<aside><p>A sidebar with some text that isn't of the article</p></aside>", '<div class="cookie-notice"><p>We use cookies to make this page work well for you</p></div>', '<div id="ad-1" class="ad">Buy this thing now, it is cheap and good</div>',
    "<form><label>Your mail address, please</label><input><button>Send it to us now</button></form>", "<script>var t = '</p><p>not text at all, but a script';</script>", "<style>p { color: red; font-size: 12px }</style>",
    "<!-- a comment <p>with markup in it</p> -->", '<section class="comments"><p>A reader says that this is a very good article indeed</p><div><p>And another one agrees with that</p></div></section>', '<p class="advert">An advert in a paragraph of its own, long enough</p>',
    '<div role="navigation">One of many other pages | Two of many other pages</div>', "<noscript>Please turn on scripts to read this page here</noscript>",
]


@pytest.mark.parametrize("noise", NOISE)
def test_noise_around_and_within_the_text_goes(noise):
    for wrap in ("<article>{}</article>", "<div id=content>{}</div>", "{}"):
        within = "" if "<header>" in noise and "article" in wrap else noise
        inside = wrap.format(f"<h1>Headline</h1><p>{P1}</p>{within}<p>{P2}</p>")
        page = f"<html><head><title>Title</title></head><body>{noise}{inside}{noise}</body></html>"
        assert main_text(page) == f"Headline\n\n{P1}\n\n{P2}"


def test_an_articles_own_header_holds_its_headline():
    page = f"<header>Site</header><article><header class='entry-header'><h1>Headline</h1></header><p>{P1}</p><footer>By someone</footer></article>"
    assert main_text(page) == f"Headline\n\n{P1}"


def test_a_mention_of_noise_marks_nothing():
    assert main_text(f"<div class='layout with-sidebar has-header'><p>{P1}</p><p>{P2}</p></div><div class='sidebar'>{P1}</div>") == f"{P1}\n\n{P2}"


def test_white_space_references_and_blocks():
    page = f"<article><p>{P1}\n  A &amp; B&nbsp;&lt;c&gt; &#233;&#x1D518;<br>next</p><p>x</p><ul><li>one<li>two</ul><blockquote>said</blockquote></article>"
    assert main_text(page) == f"{P1} A & B\u00a0<c> é𝔘 next\n\nx\n\none\n\ntwo\n\nsaid"


def test_broken_markup():
    assert main_text(f"<div class=ad>left open<article><p><b>{P1}<p>{P2}") == f"{P1}\n\n{P2}"
    assert main_text(f"<article><p>{P1}</p><p>{P2} &am") == f"{P1}\n\n{P2} &am"
    assert main_text(f'<article><p>{P1}</p><a href="http://x') == P1
    assert main_text("a < b and c > d " * 9).startswith("a < b and c > d a <")
    assert main_text("<script>never closed " + P1) == ""


def test_broken_tags_take_no_longer():
    for piece in ("<a ", '<a "', "<a '<b \"", "</", "<!--<a ", "<script ", "<p class='"):
        main_text(piece * 200_000)


def test_the_longest_span_wins():
    links = "".join(f"<li><a href='/{i}'>A link with a rather long text number {i}</a></li>" for i in range(12))
    page = f"<div><p>{P1}</p></div><ul>{links}</ul><div>" + "".join(f"<p>{P2} {i}</p>" for i in range(5)) + f"</div><ul>{links}</ul>"
    assert main_text(page) == "\n\n".join(f"{P2} {i}" for i in range(5))


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>short</p>"), (3, "u", "<p>short</p>"), (None, "u", "no markup"), (4, "u", "<article>" + f"<p>{P1}</p>" * 20_000 + "</article>"), (5, "u", "<" * 5000), (6, "u", "<div" * 3000)]
    found = extract_text(spark.createDataFrame([(*r, "c", 0) for r in rows], schema)).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert (by[1]["text"], by[2]["n_chars"], by[3]["text"], by[None]["text"]) == ("", 0, "short", "no markup")
    assert by[4]["n_chars"] == 20_000 * (len(P1) + 2) - 2
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_the_test_tables_without_article_tags(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert main_text(re.sub(r"<(/?)article>", r"<\1div>", r["html"])) == article_of(r["html"])


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>A link with a rather long text number {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_surge_and_dive_choose_the_span(tag):
    """The same with an article and without: links at the ends go, and what surges in one container, short blocks and the headline stay."""
    inside = f"{LINKS}<h1><a href='/'>Headline</a></h1><p>By me</p><p>At ten</p><p>Now</p><p>{P1}</p>{LINKS}<p>{P2}</p><p>{P1}</p><p><a href='/'>More</a></p><p>End.</p>{LINKS}"
    links = re.findall("<a [^>]*>(.*?)</a>", LINKS)
    assert main_text(f"<div>Site</div>{LINKS}<{tag}>{inside}</{tag}>{LINKS}<div>{P1}</div>") == "\n\n".join(["Headline", "By me", "At ten", "Now", P1, *links, P2, P1, "More", "End."])


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("n", [3, 6, 40])
def test_no_block_of_the_text_is_lost_at_any_distance(tag, n):
    captions = [f"A caption with a link number {i}" for i in range(n)]
    linked = "".join(f"<p><a href='/{i}'>{c}</a></p>" for i, c in enumerate(captions))
    asides = "".join(f"<aside>Beside the text {i}</aside>" for i in range(n))
    page = f"<div>Site</div>{LINKS}<{tag}><h1><a href='/'>Headline</a></h1>{linked}<p>Lead.</p>{linked}<p>{P1}</p><p>{P2}</p>{asides}<p>End.</p>{asides}</{tag}>{LINKS}"
    assert main_text(page) == "\n\n".join(["Headline", *captions, "Lead.", *captions, P1, P2, "End."])


def test_an_article_mark_is_a_weight():
    text = [f"{P2} {i}" for i in range(20)]
    body = "".join(f"<p>{x}</p>" for x in text)
    assert main_text(f"<article><p>{P1}</p></article><div>{body}</div>") == "\n\n".join(text)
    assert main_text(f"<div><p>{P1}</p><p>{P2}</p></div><article><p>{P1}</p></article><div><p>{P2}</p></div>") == P1
    assert main_text("<article><p><a href='/'>All of it is a link</a></p></article>") == "All of it is a link"


WRAPPERS = ["<div class='container sidebar-right'>{}</div>", "<div class='nav-open'>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='nav-open'><form id='aspnetForm'>{}</form></div>", "<div id='page-comments-open'>{}</div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_a_wrapper_of_the_text_is_no_noise(wrapper, inner):
    text = inner.format(f"<h1>Headline</h1><p>{P1}</p><p>{P2}</p>")
    noise = "".join(x for x in NOISE if "<h1>" not in x)
    for page in (wrapper.format(text), wrapper.format(noise + text + noise), "<div>A motto</div>" + wrapper.format(text + noise) + noise, f"<article>{wrapper.format(text)}</article>"):
        # What stands right before a headline, unmarked and outside of an article, is a short block of it.
        found = main_text(page).removeprefix("A motto\n\n")
        assert found == f"Headline\n\n{P1}\n\n{P2}", page


def test_noise_of_much_text_stays_noise():
    many = "".join(f"<p>{P2} {i}</p>" for i in range(40))
    for noise in (f"<section class='comments'>{many}</section>", f"<div class='related'><article>{P1}</article></div>", f"<ol class='commentlist'><li><article>{many}</article></ol>", f"<div class='consent'>{many}</div>", f"<div hidden>{many}</div>"):
        for inner in ("<article>{}</article>", "<div>{}</div>"):
            assert main_text(inner.format(f"<h1>Headline</h1><p>{P1}</p><p>{P2}</p>") + noise) == f"Headline\n\n{P1}\n\n{P2}", noise
    assert main_text(f"<div class='ad'>{P1}</div><article></article>") == ""


def test_deep_marked_containers_take_no_longer():
    assert main_text("<div class='ad'>" * 50_000 + f"<article>{P1}") == P1


def test_the_window_decides_every_page(spark, sf_dir, monkeypatch):
    """Each page has a surge, and where the window's spans are others, so is the text."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert all(html_text.surges(html_text.page_lines(p)[0]) for p in pages)
    texts = [main_text(p) for p in pages]
    line = lambda lines: next(i for i, x in enumerate(lines) if x.length and not x.article)
    monkeypatch.setattr(html_text, "surges", lambda lines: [(line(lines), line(lines))])
    moved = [main_text(f"<div><p>{P1}</p></div>{p}") for p in pages]
    assert len(pages) > 0 and not any(a == b for a, b in zip(texts, moved, strict=True))
