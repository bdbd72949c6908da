import html
import re
import time

import pytest

from tiebreak.llm import html_text, queries
from tiebreak.llm.html_text import main_text

MAIN = """<h1>A title &amp; more</h1><p>First   paragraph of the article,\n with some length to it.</p>
<p>Second one, <a href=x>with a link</a> inside &mdash; and <b>bold</b> words that go on for a while.</p><ul><li>an item</li><li>another</li></ul>"""
TEXT = ("A title & more\nFirst paragraph of the article, with some length to it.\n"
        "Second one, with a link inside — and bold words that go on for a while.\nan item\nanother")
BAD = """<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<form><label>Mail</label><input></form><script>var x = "<p>no</p>";</script><style>p{}</style>"""
TAIL = """<section id="comments"><p>A reader wrote a long comment here, longer than the article itself. %s</p></section>
<aside>Side note</aside><div class="sidebar">More</div><div class="ad-slot">Buy</div><footer>&copy; us</footer>""" % ("Nice! " * 60)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    for wrap in ("<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div id='c'><section>%s</section></div>"):
        assert html_text.main_text(page(BAD + wrap % MAIN + TAIL)) == TEXT


def test_no_wrapper_at_all():
    assert html_text.main_text(page(BAD + MAIN + TAIL)) == TEXT


def test_inserts_inside_the_article():
    inner = MAIN.replace("<p>Second", '<div class="advert">Buy now</div><!-- x --><p>Second') + '<div class="share-buttons">Share</div>'
    assert html_text.main_text(page(BAD + f"<article>{inner}</article>" + TAIL)) == TEXT


def test_unclosed_and_broken_markup():
    cases = {
        "<article><p><b>one two<br><p>three <i>four</article>tail": "one two\nthree four",
        "<p>a < b &lt; c</p><p>x &#228; &unknown; &nbsp; y": "a < b < c\nx ä &unknown; y",
        "<article><p>open <a href='x>text</article>": "open <a href='x>text",
        "plain text only": "plain text only",
        "</p></div><p>late</p>": "late",
        "<p>t<!-- never closed <p>hidden": "t",
        "<nav><a href=x>only menu</a></nav>": "", "": "", "<script>x": "",
        "<body class='has-sidebar'><article class='no-comments'><p>kept text</p></article>": "kept text",
    }
    for source, want in cases.items():
        assert html_text.main_text(source) == want, source


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>word</p>" + "<b>" * 3000 + "x"
    assert html_text.main_text(deep).startswith("word")
    long = page("<article>" + "<p>" + "words " * 10 + "</p>" * 1 + "<p>" * 20000 + "end</article>")
    assert html_text.main_text(long).endswith("end")


def test_density_prefers_text_to_links():
    assert html_text._density(1000, 5, 10, 1, 0.1) > html_text._density(1000, 5, 900, 5, 0.1)
    assert html_text._density(1000, 5, 0, 0, 0.0) > html_text._density(1000, 50, 0, 0, 0.0)
    assert html_text._density(0, 5, 0, 0, 0.0) == 0.0


def test_query_equals_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    sources = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op6_html_extraction"](spark, sf).collect()
    assert len(rows) == len(sources)
    for r in rows:
        article = sources[r.page_id].html.split("<article>")[1].split("</article>")[0]
        blocks = re.sub("<[^>]*>", " ", re.sub("</?(?:p|h1)>", "\0", article)).split("\0")
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x)
        assert (r.url, r.n_chars) == (sources[r.page_id].url, len(r.text))


def test_nulls_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (None, "u", "", 0), (2, "u", "<p>x", 0), (2, "u", "<p>x", 0)],
                                  "page_id long, url string, html string, n_chars int")
    rows = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=repr)
    assert rows == [(1, None, "", 0), (2, "u", "x", 1), (2, "u", "x", 1), (None, "u", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_ids_from_headings_and_linked_lists_stay_in_the_article():
    inner = MAIN + """<section id='related-work'><h2 id='social-impact'>Social impact</h2><p id='notice-of-meeting'>Some words.</p></section>
<h3 id='search-results' class='section-header'>Search results</h3><h2><span id='Comments'>Comments</span></h2><p>Kept.</p>
<section><h2>Sources</h2><ul><li><a href=x>A first source with a long title</a></li><li><a href=y>A second source</a></li></ul></section>
<table><tr><td><a href=z>A linked cell</a></td></tr></table><div class='see-also'><a href=q>See also this page</a></div>"""
    marked = """<div class='related-posts'><p>Read on</p></div><div class='ad'>Buy</div><div id='comments'><p>Nice!</p></div>"""
    want = TEXT + ("\nSocial impact\nSome words.\nSearch results\nComments\nKept.\nSources\nA first source with a long title\nA second source"
                   "\nA linked cell\nSee also this page")
    assert html_text.main_text(page(BAD + f"<article id='sharing-news'>{inner}{marked}</article>" + TAIL)) == want


def test_ids_of_headings_count_nowhere():
    inner = MAIN.replace("<h1>", "<h1 id='sponsored-search'>") + "<section id='related-work'><h2 id='social-impact'>Impact</h2><p>More words.</p></section>"
    assert html_text.main_text(page(BAD + f"<main>{inner}</main>" + TAIL)) == TEXT + "\nImpact\nMore words."


@pytest.mark.parametrize("part", ["<a \"", "<a '", "<a ", "<a \"'", "<a \"\" ", "<p>", "<b>", "<li><p>", "<", "</", "<!--", "<article>"])
def test_a_megabyte_of_broken_markup_ends_soon(part):
    start = time.process_time()
    main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 10


def test_open_quotes_are_text():
    assert main_text('<body><p>one <a "two <b>three</b></p>') == main_text('<body><p>one &lt;a "two <b>three</b></p>')
