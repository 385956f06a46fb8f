import html
import re
import time

from conftest import SF

from surtido.llm import line_blocks
from surtido.llm.line_blocks import main_text

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
<ul class=menu><li><a href=x>Home</a><li><a href=y>News</a></ul><div id="content"><h1>Title here</h1><p>{a}<p>Second
<a href=1>link</a> &eacute;{b}</div><div id=comments><h3>Comments</h3><p>I like it</p></div><form><label>Name</label>
<input></form><div class="footer">(c)</div><script>var x = "<p>no</p>";</script></body></html>"""


def test_articles_of_the_table_are_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in line_blocks.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def test_page_without_marks():
    page = PAGE.format(a="word " * 60, b=" more" * 40)
    assert main_text(page) == "Title here\n" + " ".join(["word"] * 60) + "\nSecond link é" + " more" * 40


def test_parts_inside_an_article_that_are_none():
    page = ("<article><header><h1>T</h1></header><p>One.<div class='ad'>Buy</div><p>Two &lt;b&gt; &amp;<br>three"
            "<section class=comments><article><p>I disagree</p></article></section><p>Four</article><footer>F</footer>")
    assert main_text(page) == "T\nOne.\nTwo <b> & three\nFour"


def test_short_text_after_excluded_blocks_of_an_article():
    blocks = "<div class=ad>Buy</div><div class=share>Share</div><form>Sign up</form>"
    for mark in ("article", "main"):
        assert main_text(f"<{mark}><p>{'a' * 300}</p>{blocks}<p>Ending</p></{mark}>") == "a" * 300 + "\nEnding"
    posts = f"<article><p>{'b' * 300}</p></article>{'<p>between</p>' * 3}<article><p>Short.</p></article>"
    assert main_text(posts) == "b" * 300 + "\nShort."
    # Without marks too: what excluded blocks leave empty does not end the text, lines of links do.
    assert main_text(f"<p>{'a' * 300}</p>{blocks}<p>Ending</p>") == "a" * 300 + "\nEnding"
    links = "<p><a href=1>More of this</a></p>" * 4
    assert main_text(f"<p>Top</p>{links}<p>{'a' * 300}</p>{links}<p>Small print</p>") == "a" * 300


def test_names_that_speak_of_a_part_without_being_it():
    for mark in ('article style="overflow:hidden"', 'div class="overflow-hidden"', 'div class="content no-sidebar"',
                 'article class="post has-comments"', 'article class="post-with-sidebar"', "div hidden=false", 'div data-x="hidden"'):
        assert main_text(f"<{mark}><p>Whole text</p></{mark.split()[0]}>") == "Whole text", mark
    for mark in ('div class="site-footer"', "div id=commentList", "div hidden", "div class='x main-sidebar-left'",
                 'article class="comment"', 'section style="display: none"', "div role=navigation"):
        assert main_text(f"<p>Text</p><{mark}><p>Other</p></{mark.split()[0]}>") == "Text", mark


def test_broken_markup_loses_no_text():
    assert main_text("<p>if a < b then c follows here") == "if a < b then c follows here"
    assert main_text("<p>a <b and no end") == "a <b and no end"
    assert main_text("<p>x</p><b title=it's href=y>one</b><p>two</p><p>it's</p>") == "x\none\ntwo\nit's"
    assert main_text('<p>x</p><p class="open>two</p><p>three</p>') == "x\ntwo\nthree"
    assert main_text("<p>a</p></ p><p>b <3 c</p><?x?><!doctype x>") == "a\nb <3 c"
    assert main_text("<p>a<svg><path d='M0'/><p>b</p>").startswith("a")


def test_an_article_that_is_a_teaser_does_not_stand_for_the_page():
    teaser = "<article><p>Teaser.</p></article>"
    assert main_text(f"<main><p>{'long ' * 100}</p>{teaser}<p>End.</p></main>") == ("long " * 100).strip() + "\nTeaser.\nEnd."
    assert main_text(f"<p>{'long ' * 100}</p>{teaser}<p>End.</p>") == ("long " * 100).strip() + "\nTeaser.\nEnd."
    assert main_text(f"<main><p>Intro</p><article><p>{'text ' * 50}</p></article></main>") == ("text " * 50).strip()


def test_broken_pages_take_linear_time():
    for piece in ("<script ", "<a ", "<", "<!--", "</", "<a b='", '<p x="', "<b>", "</b>", "<i><p>", "&", "<svg>", "<!x", "<textarea", "< p='"):
        for end in ("", ">", "-->", "</p>"):
            began = time.perf_counter()
            main_text(piece * (1_000_000 // len(piece)) + end)
            assert time.perf_counter() - began < 12, (piece, end)


def test_odd_pages():
    assert main_text("") == main_text("   ") == main_text("<nav>a</nav>") == main_text("<script>x") == main_text("<!-- a") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>unclosed <b>bold<p>next</i>") == "unclosed bold\nnext"
    assert main_text("<main><p>short</p></main><p>" + "long " * 100) == "short"
    assert len(main_text("<p>" + "a b " * 300_000)) == 1_199_999


def test_rows_and_empty_table(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    found = sorted(map(tuple, line_blocks.extract_main_text(pages).collect()), key=str)
    assert found == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, None, "")], key=str)
    assert line_blocks.extract_main_text(pages.limit(0)).collect() == []
