"""Main text of HTML pages: planted articles, a plain reading of the given pages, odd markup."""

import html
import re

import numpy as np
import pytest

from notelake.llm import extraction, html_blocks

TREE = extraction.learn_blocks()
WORDS = "the river bridge council winter market evening letter garden window teacher village music harbour".split()


def prose(draw, least=1, most=60):
    return " ".join(draw.choice(WORDS, int(draw.integers(least, most)))).capitalize() + "."


def planted(draw):
    """A page around known article blocks, of varying marks and boilerplate."""
    article = [prose(draw, 2, 8), *(prose(draw) for _ in range(int(draw.integers(1, 8)))), prose(draw, 20)]
    heading, body = article[0], article[1:]
    tag = draw.choice(['<article>|</article>', '<main>|</main>', '<div class="post-content">|</div>', '<div id="article-body">|</div>', '<div role="main">|</div>'])
    opening, closing = str(tag).split("|")
    head = draw.choice([f"<h1>{heading}</h1>", f"<header><h1>{heading}</h1></header>", f"<h2 class=title><b>{heading}</b></h2>"])
    inner = [str(head)]
    for text in body:
        inner.append(str(draw.choice([f"<p>{text}</p>", f"<p>{text}", f"<ul><li>{text}</ul>", f"<blockquote><p><em>{text}</em></p></blockquote>", f"<p>{text}<script>if (a<b) document.write('<p>x</p>')</script></p>"])))
        if draw.random() < 0.3:
            inner.append(str(draw.choice([
                f'<div class="ad-slot">{prose(draw)}</div>', f"<aside><p>{prose(draw)}</p></aside>", f'<div class="share"><a href="#">{prose(draw, 1, 4)}</a></div>',
                f"<form><p>{prose(draw)}</p><input name=q><button>Send it</button></form>", "<!-- <p>not this</p> -->", "<style>p { color: red }</style>",
            ])))
    before = [
        f"<nav><ul><li><a href=/>{prose(draw, 1, 3)}</a></li></ul></nav>", f"<header><p>{prose(draw)}</p></header>", f'<div class="cookie-notice"><p>{prose(draw)}</p></div>',
        f'<div id="top-menu"><a href=/a>{prose(draw, 1, 3)}</a></div>', f"<div class=\"banner\">{prose(draw)}</div>",
    ]
    after = [
        f"<footer><p>&copy; {prose(draw)}</p></footer>", f'<section id="comments"><h2>Comments</h2><article><p>{prose(draw)}</p></article></section>', f'<div class="sidebar"><h3>{prose(draw)}</h3><p>{prose(draw)}</p></div>',
        f'<aside>{prose(draw)}</aside>', f'<form action="/x"><label>{prose(draw)}</label><textarea>{prose(draw)}</textarea></form>', f'<div class="related-posts"><a href=/z>{prose(draw)}</a></div>',
    ]
    parts = [p for p in before if draw.random() < 0.6] + [opening, *inner, closing] + [p for p in after if draw.random() < 0.6]
    page = f"<!DOCTYPE html><html><head><title>{heading}</title><script>var t = '</p>';</script></head><body>{''.join(parts)}</body></html>"
    return page, "\n".join(article)


def text(page):
    return "\n".join(b.text for b in extraction.main_blocks(page, TREE))


def test_the_table_of_labels_is_learned():
    rows, labels = extraction.labelled_rows()
    assert len(rows) < 200
    assert [TREE.is_main(r) for r in rows.tolist()] == [bool(x) for x in labels]


def test_planted_articles():
    draw = np.random.default_rng(12)
    wrong = [(page, want, text(page)) for page, want in (planted(draw) for _ in range(400)) if text(page) != want]
    assert not wrong, (len(wrong), wrong[0])


def test_pages_without_marks():
    draw = np.random.default_rng(3)
    for _ in range(50):
        body = [prose(draw, 30), prose(draw, 2, 6), prose(draw, 30)]
        page = '<div><a href="/">Start</a></div><div><a href="/m">Map</a></div>' + "".join(f"<p>{t}</p>" for t in body) + '<div><a href="/i">Imprint</a></div>'
        assert text(page) == "\n".join(body)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>", ""),
        ("<article>a&nbsp;&nbsp;b\n\tc<br>d &lt;e&gt; &#233;&#x1F600; &unknown; &amp;amp;</article>", "a b c d <e> é😀 &unknown; &amp;"),
        ("<article><p>one<p>two<b>bold</b>er <!-- x --> 1 < 2 <table><tr><td>x<td>y</table>tail", "one\ntwobolder 1 < 2\nx\ny\ntail"),
        ("<article><p title='a>b' data-x=\"<p>\">kept</p><script>for(;;)</script", "kept"),
        ("<article><p>kept</p><style>p{} <p>lost", "kept"),
        ("<article><p>half a tag <a href=", "half a tag"),
        ("<article></div></span></p><p>stray ends</p></section></article>", "stray ends"),
        ("<ARTICLE><P>loud</P><NAV>no</NAV></ARTICLE>", "loud"),
        ("<article><div hidden>no</div><div style='display: none'>no</div><p>yes</p></article>", "yes"),
        ("<article><noscript><p>no</p></noscript><p>yes</p><svg><text>no</text></svg></article>", "yes"),
        ("<article><h1>T</h1><p>a</p></article><script>var x='</article><p>no</p>'</script><!--><p>-->", "T\na"),
        ("<body class='has-sidebar'><div class='page-wrapper header-layout'><article><p>yes</p></article></div>", "yes"),
        ("<article class='post tag-related category-ads'><p>yes</p></article><article class=teaser><p>no</p></article>", "yes"),
        ("<section class=comments><article><p>no</p></article></section>", ""),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_deep_and_broken_markup_takes_linear_time():
    many = 100_000
    for page in ("<div>" * many + "x", "</div>" * many + "x", "<a href='" * many, "<p><b>" * many + "x", "<" * many, "&" * many, "<!--" * many, "<article>" + "<li>x" * many, "<script>" * many):
        list(html_blocks.blocks(page))


def test_given_pages(spark, sf_dir):
    """Their articles have paragraphs, headings and unclosed tags only, which a pattern can read."""
    from notelake.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op12_html_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id].html)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article))
        assert (r.url, r.text) == (pages[r.page_id].url, "\n".join(line for line in lines if line))
        assert r.n_chars == len(r.text)


def test_rows(spark):
    page = "<nav>Menu</nav><article><p>Text</p></article>"
    rows = [("v", "a", page, 1, "x"), ("v", "a", page, 1, "x"), (None, "b", None, 2, "y"), ("v", None, "", 3, None)]
    df = spark.createDataFrame(rows, "vault string, path string, content string, n_blocks int, texts string")
    got = sorted(map(tuple, extraction.extract_text(df, carry=["texts"]).collect()), key=str)
    assert got == sorted([("v", "a", "x", "Text", 2, 1)] * 2 + [("", "b", "y", "", 0, 0), ("v", "", None, "", 0, 0)], key=str)
    assert extraction.extract_text(df.limit(0)).collect() == []
    long = "<article>" + "<p>word word</p>" * 200_000 + "</article>"
    out = extraction.extract_text(spark.createDataFrame([("v", "l", long)], "vault string, path string, content string")).first()
    assert out.content == "\n".join(["word word"] * 200_000)
