import pytest

from souk.llm import site_style_tree as s
from tests.llm.tables import prose, rows_of


def text_of(html, noise=()):
    return s.main_text(s.Page(html), frozenset(noise))


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a &amp; b &lt;c&gt; &#233;&nbsp;d</p>", "a & b <c> é d"),
        ("<p>one\n  two<br>three</p><p>four", "one two three\nfour"),
        ("<h1>T</h1><p><b>x<br><p>y", "T\nx\ny"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a</p><noscript>n</noscript>", "a"),
        ("<nav>m</nav><header>h</header><main><p>a</p></main><aside>s</aside><footer>f</footer>", "a"),
        ("<article><header><h1>T</h1></header><p>a</p></article>", "T\na"),
        ("<div class='cookie-notice'>c</div><div class='ad'>x</div><p>a</p><div id='comments'><p>c</p></div>", "a"),
        ("<div class='has-sidebar content'><p>a</p></div>", "a"),
        ("<div class='address shadow'><p>a</p></div>", "a"),
        ("<div role='navigation'>n</div><div hidden>h</div><p>a</p><form><p>q</p></form>", "a"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\ntwo\na\nb\nc"),
        ("<p>a <!-- no --> b</p><p>unclosed <i>tag", "a b\nunclosed tag"),
        ("text <p>a</p> tail", "text\na\ntail"),
        ("<p>a</p></div></p><p>b", "a\nb"),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


def test_deep_and_long_pages_are_read_whole():
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "".join(f"<p>{i}</p>" for i in range(20_000))
    assert text_of(long) == "\n".join(map(str, range(20_000)))


def site(host, pages, mark="x1"):
    """Pages without any telling element: boilerplate and article are bare divs of opaque classes."""
    return [
        (
            i,
            f"https://{host}/p/{i}",
            f"<html><body><div class='{mark}'><div>Sign in now</div><div>Our <a href='/all'>offers</a></div></div>"
            f"<div class='{mark}b'><p>{prose(i, 20)}</p><p>{prose(i + 9000, 15)}</p></div>"
            f"<div class='{mark}c'>All rights reserved</div></body></html>",
        )
        for i in pages
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as noise", "3 as text")


def test_branches_that_repeat_over_a_site_go(spark):
    rows = site("a.example.org", range(40))
    rows += [(900, "https://a.example.org/copy", rows[3][2])] * 30  # copies are one page
    rows += site("one.example.org", [500])  # too few pages to tell
    rows += [(910, None, "<p>no host</p>"), (911, "https://a.example.org/n", None), (912, "", ""), (None, "x", "<p>no id</p>")]
    found = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in s.main_texts(frame(spark, rows).repartition(4)).collect()}
    article = lambda i: f"{prose(i, 20)}\n{prose(i + 9000, 15)}"
    for i in range(40):
        assert found[i, f"https://a.example.org/p/{i}"] == (article(i), len(article(i)))
    assert found[900, "https://a.example.org/copy"][0] == article(3)
    assert found[500, "https://one.example.org/p/500"][0] == f"Sign in now\nOur offers\n{article(500)}\nAll rights reserved"
    assert found[910, None][0] == "no host" and found[911, "https://a.example.org/n"] == ("", 0)
    assert found[912, ""] == ("", 0) and found[None, "x"][0] == "no id"
    assert s.main_texts(frame(spark, rows)).count() == len(rows)


def test_running_text_of_an_article_is_never_noise(spark):
    same = "<html><body><article><h1>One title</h1><p>One text for all.</p></article><div class='z'>More</div></body></html>"
    rows = [(i, f"http://h.example.com/{i}", same.replace("</div>", f" {i}</div>" if i % 2 else "</div>")) for i in range(12)]
    assert all(r["text"].startswith("One title\nOne text for all.") for r in s.main_texts(frame(spark, rows)).collect())


def test_importance_follows_the_formulas(spark):
    """Content of three paths: on every page alike, on half of them alike, on each its own."""
    import math

    rows = []
    for i in range(16):
        html = f"<div class='same'>same</div><div class='half'>{'x' if i % 2 else 'y'}</div><div class='own'>own {i} {prose(i, 4)}</div>"
        rows.append((i, f"http://h.example.com/{i}", f"<html><body>{html}</body></html>"))
    want = {"same": 0.0, "half": 1 - math.log(8) / math.log(16), "own": 1.0}
    for threshold in (0.1, 0.2, 0.3, 0.999):
        noise = {p.rsplit(".", 1)[1] for (p,) in rows_of(s.noise_branches(frame(spark, rows), threshold), "path") if "." in p}
        assert noise == {k for k, v in want.items() if v < threshold}


def test_an_empty_table(spark):
    assert s.main_texts(frame(spark, site("a.example.org", [1])).where("false")).collect() == []


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><section id='related-work'><p>a</p></section><h2 id='notice-period'>b</h2></article>", "a\nb"),
        ("<section id='search-and-rescue'><p>a</p></section><div id='social-impact'>b</div>", "a\nb"),
        ("<div class='card-share-price'>a</div><main><div class='comments'>b</div></main>", "a\nb"),
        ("<h2 id='search'>a</h2><div class='main-nav'>m</div><div class='related-posts'>r</div><div id='sidebar'>s</div>", "a"),
    ],
)
def test_listed_words_take_no_content(html, want):
    assert text_of(html) == want


def test_listed_branches_of_an_article_follow_their_importance(spark):
    page = "<html><body><article><p>{0}</p><div class='related'>{0} r</div><div class='share'>Share this</div></article></body></html>"
    rows = [(i, f"http://l.example.com/{i}", page.format(prose(i, 12))) for i in range(12)]
    found = {r["page_id"]: r["text"] for r in s.main_texts(frame(spark, rows)).collect()}
    assert found == {i: f"{prose(i, 12)}\n{prose(i, 12)} r" for i in range(12)}


def test_hosts_of_few_pages_and_pages_without_article(spark):
    rows = site("few.example.org", range(3))
    rows += site("some.example.org", range(20, 40))
    bare = "<html><body><div class='x1'><div>Sign in now</div><div>Our <a href='/all'>offers</a></div></div></body></html>"
    rows.append((800, "https://some.example.org/empty", bare))
    found = {r["page_id"]: r["text"] for r in s.main_texts(frame(spark, rows)).collect()}
    for i in (*range(3), *range(20, 40)):
        assert found[i] == f"{prose(i, 20)}\n{prose(i + 9000, 15)}"
    assert found[800] == ""
