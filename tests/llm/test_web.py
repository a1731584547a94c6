import time
from html.parser import HTMLParser

import duckdb
import pytest

from tidewright.llm import html_extract, queries, url_filter

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site head</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy</div>
<div class="cookie-notice"><p>We use cookies</p></div><article id="a12"><h1>Big &amp; small</h1><p>One  two<br>three</p><p>Four <b>five</b> &eacute;&#33;
<p>Six<ul><li>Seven<li>Eight</ul><form><p>Mail</p></form><aside><p>Aside</p></aside><div class="comments"><p>Nice!</p></div></article>
<div class="sidebar"><p>Side text that is long enough to win if it counted, and longer still, and longer</p></div><footer>&copy; x</footer></body></html>"""
WANT = "Big & small\nOne two three\nFour five é!\nSix\nSeven\nEight"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text int")


def test_extraction(spark):
    rows = [(1, "http://h.example/1", PAGE, 1), (2, None, None, 2), (3, "http://h.example/3", "", 3), (4, "x", "<p>Just <i>this</i>", 4), (None, "http://h.example/1", PAGE, 1), (6, "http://h.example/6", "<article>", None)]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[(1, "http://h.example/1")] == (WANT, len(WANT)) == got[(None, "http://h.example/1")]
    assert got[(2, None)] == ("", 0) == got[(3, "http://h.example/3")] == got[(6, "http://h.example/6")]
    assert got[(4, "x")] == ("Just this", 9)
    assert html_extract.extract_text(pages(spark, rows).limit(0)).count() == 0


def test_consensus_beats_a_page_that_misleads(spark):
    good = "<html><body><div class='post-{k}'><h1>Title {k}</h1><p>A paragraph of the article of page {k} here.</p><p>More text.</p></div><div class='extra'><p>Short.</p></div></body></html>"
    odd = "<html><body><div class='post-9'><p>Tiny.</p></div><div class='extra'><p>" + "long words here " * 30 + "</p></div></body></html>"
    rows = [(k, "https://s.example/p", good.replace("{k}", str(k)), 0) for k in range(9)] + [(9, "https://s.example/q", odd, 0)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[9] == "Tiny." and got[3].startswith("Title 3\nA paragraph")
    alone = html_extract.extract_text(pages(spark, [(9, "https://other.example/q", odd, 0)])).first()["text"]
    assert alone.startswith("long words here")


@pytest.mark.parametrize("tag", ["article", "main"])
def test_an_article_split_over_siblings_is_whole(spark, tag):
    page = f"<body><{tag}><h1>Title</h1><div class=lead><p>{'lead ' * 30}</p></div><div class=body><p>{'body ' * 70}</p></div></{tag}><div class=x><p>Out</p></div></body>"
    got = html_extract.extract_text(pages(spark, [(k, "https://split.example/p", page, 0) for k in range(3)])).collect()
    assert {r["text"] for r in got} == {"\n".join(["Title", ("lead " * 30).strip(), ("body " * 70).strip()])}


def test_parser_survives_broken_markup():
    for bad in ("<", "<p", "<p><", "</p></p>", "<div class=\"x><p>y</p>", "<script>x", "<!-- never closed <p>a", "<a href='>'>t</a>", "&#x110000;&bad;&", "<p>" * 3000 + "z", "<table><tr><td>a<td>b<tr><td>c</table>"):
        html_extract.blocks_of(bad)
    assert [t for _, t, _ in html_extract.blocks_of("<table><tr><td>a<td>b<tr><td>c</table>")] == ["a", "b", "c"]
    assert [t for _, t, _ in html_extract.blocks_of("x<script>1<2</script>y<style>z</style>")] == ["xy"]


@pytest.mark.parametrize("name", ["has-sidebar", "content has-sidebar", "share-price", "no-ads", "ad-free", "with-comments"])
def test_a_wrapper_with_a_telling_word_in_its_name_is_no_boilerplate(spark, name):
    page = f"<body><nav>Menu</nav><div class='{name}'><div class=entry><h1>Title</h1><p>{'words of it ' * 9}</p></div></div></body>"
    got = html_extract.extract_text(pages(spark, [(1, "https://w.example/p", page, 0)])).first()["text"]
    assert got == "Title\n" + ("words of it " * 9).strip()


@pytest.mark.parametrize("name", ["sidebar", "main-ad", "cookieNotice", "comments-area", "site-footer", "related posts", "ad3"])
def test_boilerplate_by_whole_names(name):
    assert [t for _, t, _ in html_extract.blocks_of(f"<div class='{name}'><p>x</p></div><p>y</p>")] == ["y"]


def test_sibling_containers_are_kept(spark):
    page = f"<body><div class=wrap><div class=intro><p>{'intro ' * 20}</p></div><div class=rest><p>{'rest ' * 60}</p></div></div><div class=x><p>Out</p></div></body>"
    beside = f"<body><div id=c><h1>Title</h1><div class=entry><p>{'entry ' * 200}</p></div></div></body>"
    got = html_extract.extract_text(pages(spark, [(1, "https://a.example/p", page, 0), (2, "https://b.example/p", beside, 0)])).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: ("intro " * 20).strip() + "\n" + ("rest " * 60).strip(), 2: "Title\n" + ("entry " * 200).strip()}


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<a x=\">\" " * 120_000, "<b><i>" * 80_000 + "<table>" + "</b>" * 80_000, "<script>" + "</script " * 100_000, "<ul><li>x" * 40_000,
     "<!--" * 200_000, '<a x="' * 170_000 + '">"', "<span>x" * 90_000 + "</p>" * 90_000],
    ids=["open tags", "nested", "quotes", "formatting", "script", "lists", "comments", "quoted tags", "ends"],
)
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    found = html_extract.blocks_of(page)
    found.below(html_extract.elected(found)[0])
    assert time.process_time() - start < 12


def test_extraction_of_a_long_page_and_clashing_names(spark):
    long = "<article>" + "<p>A paragraph of it.</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "http://h.example/1", long, 1, 2, "m", "old"), (1, "http://h.example/1", long, 1, 2, "m", "old"), (2, None, None, 3, 4, None, None)], "page_id long, url string, html string, paths int, host int, markup string, n_chars string")
    got = html_extract.extract_text(df)
    assert got.columns == ["page_id", "url", "paths", "host", "markup", "text", "n_chars"]
    rows = got.collect()
    assert [(r["page_id"], r["paths"], r["host"], r["markup"], r["n_chars"]) for r in sorted(rows)] == [(1, 1, 2, "m", 19 * 50_000 - 1)] * 2 + [(2, 3, 4, None, 0)]


def plain_text_of(page):
    """The words below the first <article> by another parser."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    return "".join(reader.out).split()


def test_query_against_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages_ = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    some = 0
    for r in queries.op6_html_extract(spark, sf).collect():
        want = plain_text_of(pages_[r["page_id"]] or "")
        if want:
            some += 1
            assert "".join(r["text"].split()) == "".join(want) and r["n_chars"] == len(r["text"])
    assert some > 100


def test_generalised_names():
    assert html_extract.general_name("div", ' class="post-12 wide"') == ("div.post.wide", False)
    assert html_extract.general_name("div", ' class="main-ad"')[1] and html_extract.general_name("div", " id=comments")[1]
    assert not html_extract.general_name("div", ' class="loading-shadow"')[1] and html_extract.general_name("p", " hidden")[1]


URLS = [
    ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://a.example.com/en/p", "a.example.com", "/en/p", "example.com/en/", "block"),
    ("https://example.com/En/p", "example.com", "/En/p", "com/", "allow"),
    ("https://casino.com/x", "casino.com", "/x", "com/", "allow"),
    ("https://casino.com", "casino.com", "", None, "block"),
    ("ftp://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("https://x.net/en/free/cheap", "x.net", "/en/free/cheap", None, "block"),
    ("https://x.net/en/free/free", "x.net", "/en/free/free", None, "allow"),
    ("https://x.net/casinos", "x.net", "/casinos", None, "allow"),
    ("https://spam-farm.example.org/en/1", "spam-farm.example.org", "/en/1", None, "block"),
    ("https://x.org?casino", "x.org", "", None, "allow"),
    ("no scheme.com/casino", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://://x.net/fr/", "", "", None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(k, u[0], "mine") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        if verdict:
            assert got[k] == (host, path, rule, verdict), URLS[k]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, u[0]) for k, u in enumerate(URLS)])
    assert {r[0]: tuple(r[1:]) for r in con.execute(url_filter.oracle()).fetchall()} == got
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("casino", (1, 0)), ("xcasino", (0, 0)), ("a-casino_b", (1, 0)), ("win-win.win", (0, 1)), ("bets bet", (0, 2)), ("", (0, 0))])
def test_vocabulary(text, want):
    assert url_filter.Vocabulary().hits(text) == want


def test_pages_of_a_table_have_their_article(spark):
    rows = queries.op6_html_extract(spark, "/root/testdata/sf0.001").collect()
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    import html
    import re

    for r in rows:
        article = re.search("<article>(.*?)</article>", raw[r["page_id"]], re.S)[1].replace("<br>", " ").replace("<b>", "")
        want = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_a_vocabulary_from_a_table(spark):
    rows = [("Casino", 5.0), ("deal", 0.5), ("deal", 1.0), ("hot", 0.5), ("cheap", 1.0), (None, 3.0), ("", 3.0), ("nil", 0.0), ("void", None)]
    v = url_filter.Vocabulary.from_table(spark.createDataFrame(rows, "term string, weight double"))
    assert v.strict == ("casino",) and v.soft == ("cheap", "deal", "hot") and v.weights == {"cheap": 1.0, "deal": 1.0, "hot": 0.5}
    assert v.rejects("x/casino") and v.rejects("cheap/deal") and not v.rejects("deal/hot") and not v.rejects("cheap/cheap/hot") and v.rejects("cheap-deal-hot")
    con = duckdb.connect()
    for t in ("x/casino", "cheap/deal", "deal/hot", "cheap/hot", "casinos", "hot"):
        assert con.execute(f"SELECT {v.sql(chr(39) + t + chr(39))}").fetchone()[0] == v.rejects(t)
    with pytest.raises(ValueError):
        url_filter.Vocabulary.from_table(spark.createDataFrame(rows, "term string, weight double"), most=2)
    assert not url_filter.Vocabulary.from_table(spark.createDataFrame([], "term string, weight double")).rejects("casino")


def test_long_urls_and_clashing_columns(spark):
    long = "https://x.org/" + "a/" * 200_000 + "casino"
    df = spark.createDataFrame([(1, long, 7, "h", "v"), (1, long, 7, "h", "v"), (2, "https://x.org/a", 8, "g", "w")], "page_id long, url string, strict_hits int, host string, verdict string")
    got = url_filter.judge_urls(df).collect()
    assert [(r["page_id"], r["verdict"], r["strict_hits"]) for r in got] == [(1, "block", 1), (1, "block", 1), (2, "allow", 0)]
    assert url_filter.judge_urls(df.limit(0)).count() == 0
