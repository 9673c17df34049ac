import pytest

from ordinate.llm import html as h

ARTICLE = "<h1>The &amp; title</h1><p>First  paragraph\n of&nbsp;text, <b>bold</b>wise.</p><p>Second<br>line &lt;here&gt; &eacute;&#233;</p><ul><li>one<li>two</ul><blockquote>quoted</blockquote><pre>x\n  y</pre>"
TEXT = "The & title\nFirst paragraph of text, boldwise.\nSecond line <here> éé\none\ntwo\nquoted\nx y"
AROUND = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>home</a></ul></nav><article>", '</article><aside>side text that is long enough to matter</aside><footer>foot</footer></body></html>'),
    ('<body><div id="header" class="header">Site name</div><div class="cookie-notice">We use cookies, quite many of them</div><div class="post-content-17">', '<div class="comments"><p>A reader says a lot of things that are not the article</p></div></div><div class="sidebar">links and more links</div></body>'),
    ('<body><div class="menu"><a href=a>a</a> <a href=b>b</a></div><main><!-- <p>hidden</p> --><form><input name=q><button>Go</button></form>', '<div class="share">Share this</div><div hidden>gone</div></main><div class="ad">Buy now, buy cheap, buy again</div>'),
    ('<body><ul><li><a href=1>home</a><li><a href=2>news</a></ul><div class="topnav">top</div><div class="adsbygoogle">ad</div><section>', "</section></body>"),
    ('<table><tr><td class="nav">left menu</td><td class="body">', "</td></tr></table>"),
    ("", ""),
]


@pytest.mark.parametrize("around", AROUND)
def test_pages(around):
    assert h.extract(around[0] + ARTICLE + around[1], None)[0] == TEXT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("  ", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<p>x < y and a <3</p>", "x < y and a <3"), ("<p title='a>b'>q</p>", "q"), ("<p>cut <b", "cut <b"), ("<script>x", ""), ("</p></div>tail", "tail")])
def test_odd_markup(page, text):
    assert h.extract(page, None)[0] == text


def test_hosts_agree(spark):
    """A page whose own best container is another is read by its host's path."""
    long, short = "word " * 80, "A short but true article here."
    page = lambda body, box: f'<body><div class="box-{len(box)}"><p>{box}</p></div><div class="text"><p>{body}</p></div></body>'
    rows = [(i, f"http://www.news.example.org/{i}", page(long, "box " * 3)) for i in range(20)] + [(99, "https://news.example.org/x", page(short, "box " * 60))]
    rows += [(200, "::bad url[", "<p>alone</p>"), (201, None, None), (201, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert h.extract(rows[20][2], None)[0] != short
    for limit in (8 << 20, 0):  # winners handed out whole, or joined
        out = {r["page_id"]: r for r in h.extract_main_text(df, broadcast_bytes=limit).collect()}
        assert out[99]["text"] == short and out[99]["path"] == "/body/div.text" and out[0]["text"] == long.strip()
        assert out[200]["text"] == "alone" and out[201]["text"] == "" and out[201]["n_chars"] == 0 and out[99]["n_chars"] == len(short)
        assert h.extract_main_text(df, broadcast_bytes=limit).count() == len(rows)
    votes = {(r["host"], r["path"]): r["pages"] for r in h.host_votes(df).collect()}
    assert votes[("news.example.org", "/body/div.text")] == 21


def test_long_and_clashing(spark):
    from pyspark.sql import functions as F

    body = "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000))
    df = spark.createDataFrame([(1, "u", f"<article>{body}</article>")], "page_id bigint, url string, html string").withColumn("text", F.lit(5))
    row = h.extract_main_text(df).collect()[0]
    assert row["text"].count("\n") == 19_999 and h.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("around", [
    ('<body class="has-sidebar sidebar">', "</body>"),
    ('<body class="sticky-header"><article class="post no-comments">', "</article>"),
    ('<main class="overflow-hidden" id="search">', "</main>"),
    ('<body><form id="form1" class="search"><div class="menu">menu</div>', "</form></body>"),
    ('<div class="with-share col-ad-free"><p>', "</p></div>"),
])
def test_words_that_do_not_condemn(around):
    assert h.extract(around[0] + ARTICLE + around[1], None)[0] == TEXT


def test_sections_named_after_their_subject():
    page = '<article><p>text</p><h2 id="related-work">Related</h2><p>a</p><section id="discussion"><p>b</p></section><h2 id="search-algorithms" class="menu">Search</h2><div id="navigation"><p>c</p></div>%s</article>'
    gone = '<div id="comments">x</div><div class="left"><div class="comments-area">y</div></div><div class="cookie-notice">z</div><form><p>Send</p></form><div class="adSlot">v</div>'
    assert h.extract(page % gone, None)[0] == "text\nRelated\na\nb\nSearch\nc"


SPLIT = [
    ('<div class="lead"><p>{a}</p></div><div class="text"><p>{b}</p></div>', 400, 2000),
    ("<p>{a}</p><table><tr><td>{b}</td></tr></table>", 1000, 3000),
    ('<p>{a}</p><div class="scroll"><table><tr><td><div>{b}</div></td></tr></table></div>', 1000, 3000),
    ('<div class="row"><div class="col"><p>{a}</p></div><div class="side-by"><p>{b}</p></div></div><div class="more"><p>{b}</p></div>', 500, 600),
]
REFERENCES = '<h2>References</h2><ul><li><a href="1">first source</a></li><li><a href="2">second source</a></li></ul>'


@pytest.mark.parametrize(("inside", "a", "b"), SPLIT)
def test_split_articles(spark, inside, a, b):
    a, b = ("word " * (n // 5) for n in (a, b))
    page = f'<body><ul><li><a href="/">home</a></li></ul><div class="post">{inside.format(a=a, b=b)}{REFERENCES}</div><div class="menu">menu</div></body>'
    want = "\n".join([a.strip()] + [b.strip()] * inside.count("{b}") + ["References", "first source", "second source"])
    assert h.extract(page, None) == (want, "/body/div.post")
    df = spark.createDataFrame([(i, "http://split.example/", page) for i in range(5)], "page_id bigint, url string, html string")
    assert {(r["text"], r["path"]) for r in h.extract_main_text(df).collect()} == {(want, "/body/div.post")}


def test_winners_climb(spark):
    rows = [("a", "", 0.1, 1.0), ("a", "/body", 0.2, 1.0), ("a", "/body/div", 0.3, 0.99), ("a", "/body/div/div", 0.9, 0.5), ("b", "/body", 0.1, 1.0), ("b", "/body/article", 0.9, 0.2), ("c", "", 1.0, 1.0)]
    votes = spark.createDataFrame(rows, "host string, path string, votes double, holds double")
    assert {(r["host"], r["path"]) for r in h.winners(votes).collect()} == {("a", "/body/div"), ("b", "/body/article"), ("c", "")}


@pytest.mark.parametrize("piece", ["<a '", "<div>x", "<div class=a>y</p>", "<b>z", "<a '>'", "<!--", "</div>", "<p title=\"", "<", "&amp", "<ul><li>"])
def test_time_grows_with_the_length(piece):
    import time

    def seconds(n):
        began = time.perf_counter()
        h.extract(piece * n, None)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 25 * max(0.02, seconds(4_000))


def test_deep_nesting_keeps_all_text():
    page = "<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>after"
    assert h.extract(page, None)[0] == "deep\nafter"


def test_formulas_stay():
    assert h.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", None)[0] == "Let x=1 be."


@pytest.mark.parametrize("name", ["content with-comments", "post side-image", "follow-up-story", "home nav-open", "page search-enabled"])
def test_parts_of_names_do_not_condemn(name):
    for tag in ("body", "div", "article", "section"):
        assert h.extract(f'<{tag} class="{name}">{ARTICLE}</{tag}>', None)[0] == TEXT


def test_query_against_labelled_pages(spark, tmp_path):
    """The registered query over pages whose article is known, from hosts with different templates."""
    import random

    from ordinate.llm import queries

    rng, rows, want = random.Random(4), [], {}
    frames = [
        '<body><nav><a href="/">Home</a></nav><main><h1>{t}</h1>{b}</main><footer>About us</footer>',
        '<body><div class="sidebar"><p>Latest posts of ours</p></div><div class="entry-{k}"><h1>{t}</h1>{b}<div class="comments"><p>I like it</p></div></div><div class="ads">Buy</div>',
        '<table><tr><td class="menu"><ul><li><a href=x>x</a></ul></td><td class="main"><h1>{t}</h1>{b}</td></tr></table><script>b()</script>',
        '<body><form action=go><div id="hd" class="header">Site</div><div class="story"><h1>{t}</h1>{b}</div></form>',
    ]
    for i in range(120):
        title = f"Title {i}"
        body = [" ".join(rng.choice(["rain", "falls", "on", "the", "plain"]) for _ in range(rng.randrange(10, 60))) for _ in range(rng.randrange(2, 6))]
        rows.append((i, f"https://h{i % 4}.example/{i}", frames[i % 4].format(t=title, k=i, b="".join(f"<p>{x}</p>" for x in body))))
        want[i] = "\n".join([title, *body])
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op8_html(spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(want[i]) for i, r in got.items())


@pytest.mark.parametrize("head", ["<html><head><meta charset=utf-8><title>t</title><body>", "<head><style>p{}</style>", "<head><link rel=x></head><body>"])
def test_a_head_may_end_without_a_tag(head):
    assert h.extract(head + "<p>All of the article stands here.</p>", None)[0] == "All of the article stands here."


def test_inline_parts_that_are_not_the_article():
    page = '<article><p>Said <button>Share</button>in <label>Mail</label><span class="ad">Buy</span><span hidden>no</span>full.</p><ins class="adsbygoogle">more ads</ins><p>End <select><option>a<option>b</select></p></article>'
    assert h.extract(page, None)[0] == "Said in full.\nEnd"


@pytest.mark.parametrize("name", ["left-sidebar", "rightSidebar", "user-comments", "reader_comments", "site-notice", "page-footer", "nav-links", "sidebar-box", "mobile-menu"])
def test_parts_named_by_place_or_owner(name):
    rest = "Something that is said at much greater length than the article itself. " * 3
    assert h.extract(f'<div class="wrap"><div class="{name}"><p>{rest}</p></div><div class="body-text"><p>The article is short.</p></div></div>', None)[0] == "The article is short."
