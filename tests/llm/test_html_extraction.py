"""HTML extraction: markup cases, template removal against a plain count, and the driver's pages."""
import html
import re
from collections import Counter

from tests.llm.helpers import rows, with_clashes
from wayfare.llm import html_extraction as H

SF = "/root/testdata/sf0.01/pages.parquet"


def text(source, templates=frozenset()):
    return H.main_text(H.parse(source), templates)


def test_blocks_white_space_and_references():
    assert text("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;&nbsp;three<br>four</p>five<p>six<b>se</b>ven</article>") \
        == "A & B\none two three four\nfive\nsixseven"
    assert text("<article><p>&lt;p&gt; &#65;&#x42; &amp;amp; a &lt b &copy 1 < 2 <3 &am</p></article>") == "<p> AB &amp; a < b © 1 < 2 <3 &am"
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>") == "a\nb\nc d\ne"


def test_unclosed_truncated_and_odd_markup():
    assert text("<article><p><b>T.<br><p>x</p></p>y</article><footer>f") == "T.\nx\ny"
    assert text("<article><p>a</p><p>b <a href='x>y'>c</a> d<scr") == "a\nb c d"
    assert text('<article><p title="a > b">t</p><p class="x>u</p></article>') in ("t\nu", "t")
    assert text("<ARTICLE><P>a</P><SCRIPT>var x='</p>';</SCRIPT><!-- c <p>no</p> --><p>b</ARTICLE>") == "a\nb"
    assert text("<article><p>" + "<i>" * 5000 + "deep" + "</article>") == "deep"
    assert text("") == "" and text("plain") == "plain" and text("<") == "<" and text("<!doctype") == ""


def test_boilerplate_goes():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>no</header><nav><a href=/>no</a></nav>
    <div class="ad">no</div><div id="cookie-notice">no</div><aside>no</aside><div style="display: none">no</div>
    <main><article class="post has-sidebar"><header><h1>Title</h1></header><p>Text.</p><div class="share-buttons">no</div>
    <form><p>no</p></form><p>More.</p><section id="comments"><article class="comment">no</article></section></article></main>
    <div role="complementary">no</div><footer>no</footer></body></html>"""
    assert text(page) == "Title\nText.\nMore."
    assert text("<body><div class=sidebar>no</div><div class='content with-sidebar'><p>yes</p></div></body>") == "yes"
    assert text("<body><main><p>yes</p></main><p>no</p></body>") == "yes"
    assert text("<article><p>a</p></article><div><article><p>b</p></article></div>") == "a\nb"


def test_names_count_as_a_whole_inside_an_article():
    for name in ("share-price", "ad-hoc", "social-history", "related-work", "menu-of-the-day", "notice-of-appeal", "medical-notice",
                 "widget-text", "promo", "copyright", "noticeBoardHistory", "comment-on-the-text"):
        assert text(f"<article><p class={name}>Real article text here.</p></article>") == "Real article text here.", name
        assert text(f"<main><p id='{name}'>Real article text here.</p></main>") == "Real article text here.", name
    for name in ("share-price", "ad-hoc", "social-history", "related-work", "menu-of-the-day"):
        assert text(f"<article><div class={name}><p>Real.</p></div></article>") == "Real.", name
    for block in ("<p class=ad>no</p>", "<div class='advert-box'>no</div>", "<p class=related-links><a href=/>no</a></p>", "<div class=related>no</div>",
                  "<ul class='social share-list'><li>no</li></ul>", "<div class=comments><p>no</p></div>", "<section id=comment-thread>no</section>",
                  "<div class=newsletterSignup>no</div>", "<li class=sponsored>no</li>", "<div class='cookie-notice'>no</div>"):
        assert text(f"<article><p>yes</p>{block}</article>") == "yes", block


def test_main_and_articles_are_united_unless_one_holds_the_other():
    assert text("<main><p>m</p></main><article>a</article><article>teaser</article>") == "m\na\nteaser"
    assert text("<article>a</article><p>no</p><main><p>m</p></main>") == "a\nm"
    assert text("<main><p>no</p><article>a</article></main><article>b</article>") == "a\nb"
    assert text("<article>a<main>m</main></article>") == "a\nm"
    assert text("<main><p>m</p><div role=main>n</div></main>") == "m\nn"


def _page(n, box, body):
    return f"<html><body><div>{box}</div><div><p>{body}</p></div></body></html>"


def test_templates_are_removed_per_host_and_articles_are_held_apart(spark):
    data = [(i, f"https://a.example/{i}", _page(i, "Welcome to <i>our</i> site", f"Body number {i}")) for i in range(10)]
    data += [(100 + i, f"https://b.example/{i}", _page(i, "Welcome to <i>our</i> site" if i == 0 else f"Box {i}", f"Other {i}")) for i in range(10)]
    copy = "<body><article><p>The same republished text.</p><p><a href='/s'>Share</a></p></article></body>"
    data += [(200 + i, f"http://c.example/{i}", copy) for i in range(10)] + [(300, "http://d.example/", copy)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {r.page_id: r.text for r in H.extract(df, limit=0).collect()}       # joined by host and salt
    assert all(got[i] == f"Body number {i}" for i in range(10))
    assert got[100] == "Welcome to our site\nOther 0" and got[103] == "Box 3\nOther 3"
    assert all(got[200 + i] == "The same republished text." for i in range(10))
    assert got[300] == "The same republished text.\nShare"
    found = {r.host: set(r.templates) for r in H.templates(df).collect()}
    for host in ("a.example", "b.example", "c.example"):
        own = [d[2] for d in data if host in d[1]]
        counts = Counter(h for s in own for h in H.subtree_hashes(H.parse(s)))
        assert found.get(host, set()) == {h for h, n in counts.items() if n >= max(H.MIN_PAGES, H.MIN_SHARE * len(own) ** 0.5)}


def test_templates_of_layouts_that_hold_a_fifth_of_a_host_each(spark):
    data = [(i, f"https://a.example/{i}", _page(i, f"Box of <b>layout</b> {i % 5}", f"Body number {i}")) for i in range(100)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for limit in (H.BROADCAST_BYTES, 0):
        assert {r.page_id: r.text for r in H.extract(df, limit=limit).collect()} == {i: f"Body number {i}" for i in range(100)}


def test_links_in_running_text_stay_though_the_menu_holds_them(spark):
    link, menu = "<a href=/de>the guide</a>", "<div><a href=/de>the guide</a><a href=/x>More</a></div>"
    share = "<ul><li>{0}</li><li><a href=/x>More</a></li></ul><p>{0}</p>".format(link)

    def page(i):
        words = f"<h2>{link}</h2><p>Read {link} first, {i}.</p><div>Or {link}</div>"
        return f"<body>{menu}<article>{words}{share}</article></body>" if i % 2 else f"<body>{menu}<div><p>Read {link} first, {i}.</p></div></body>"

    df = spark.createDataFrame([(i, f"https://a.example/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(got[i] == (f"the guide\nRead the guide first, {i}.\nOr the guide" if i % 2 else f"Read the guide first, {i}.") for i in range(20))


def test_copies_without_article_markup_keep_their_text(spark):
    words = "<h1>Title</h1><div><p>The same republished text.</p><p>Its second paragraph.</p></div>"
    pages = [f"<body><nav>Menu {i}</nav>{words}</body>" for i in range(10)]
    pages += [f"<body><div ROLE=main>{words}<p>{i}</p></div></body>" for i in range(10)]
    for host, own in (("a", pages[:10]), ("b", pages[10:])):
        df = spark.createDataFrame([(i, f"https://{host}.example/{i}", p) for i, p in enumerate(own)], "page_id long, url string, html string")
        want = "Title\nThe same republished text.\nIts second paragraph."
        assert {r.page_id: r.text for r in H.extract(df).collect()} == {i: want + (f"\n{i}" if host == "b" else "") for i in range(10)}


def test_driver_pages_equal_the_article_read_by_pattern(spark):
    df = spark.read.parquet(SF)
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_awkward_rows(spark):
    data = [(1, None, None), (None, "http://a/", "<p>x</p>"), (2, "", ""), (3, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>"),
            (4, "http://b/", "<article><p>" + "long text " * 100_000 + "</p></article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = rows(H.extract(df).select("page_id", "url", "n_chars"))
    assert got == sorted([(1, None, 0), (None, "http://a/", 1), (2, "", 0), (3, "http://a/", 1), (3, "http://a/", 1), (4, "http://b/", 999_999)],
                         key=lambda t: tuple((x is None, str(x)) for x in t))
    clash = with_clashes(df).selectExpr("*", "'x' AS text", "'h' AS host", "1 AS salt", "0 AS n_chars", "0 AS templates")
    assert rows(H.extract(clash).select("page_id", "url", "n_chars")) == got
    assert H.extract(df.limit(0)).count() == 0
