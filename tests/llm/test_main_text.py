from salescope.llm import main_text as M

DDL = "page_id bigint, url string, html string, text string, host string"


def test_article_as_browsers_see_it():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li>menu<li>two</ul></nav><div class="ad">buy</div><header>head</header>
    <article><header><h1>The  title</h1></header><p>One <b>bold<br>line<p>Two &amp; three &lt;x&gt; 1 < 2<!-- note -->
    <div class="comments"><p>reader</p></div><aside>side</aside><form>name</form><blockquote>quote</blockquote></article>
    <footer>&copy; us</footer></body></html>"""
    assert M.main_text(page, set()) == "The title\nOne bold line\nTwo & three <x> 1 < 2\nquote"


def test_cut_off_pages():
    assert M.main_text("<article><p>one</p><p>two &amp three <b cla", set()) == "one\ntwo & three"
    assert M.main_text("<article><p>one</p><script>var a", set()) == "one"
    assert M.main_text("<p>plain</p></article><p>more", set()) == "plain\nmore"
    assert M.main_text(None, set()) == "" and M.main_text("", set()) == ""
    assert M.main_text("<" * 1000, set()) == "<" * 1000


def test_templates_go_where_no_article_is_marked(spark):
    def page(i):
        return (f"<body><div><p>welcome to our site</p></div><div><p>story number {i} of the day</p></div>"
                f"<section><p>all rights</p></section></body>")

    rows = [(i, f"http://Host.example/{i}", page(i), "x", "y") for i in range(8)]
    rows += [(20, "http://other.example/", page(20), "x", "y"), (None, None, None, "x", "y"), (21, "no url", "", None, None)]
    rows += [(30 + k, "http://copies.example/", page(1), "x", "y") for k in range(9)]
    got = {(r["row"]["page_id"], r.text) for r in M.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    assert {(i, f"story number {i} of the day") for i in range(8)} <= got
    assert (20, "welcome to our site\nstory number 20 of the day\nall rights") in got
    assert (None, "") in got and (21, "") in got
    # Copies of one page are no template of its text.
    assert (30, "welcome to our site\nstory number 1 of the day\nall rights") in got


def test_repeated_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://h.example/", f"<nav>menu</nav><article><p>same words</p><p>page {i}</p></article>", "", "") for i in range(9)]
    got = {(r["row"]["page_id"], r.text) for r in M.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(i, f"same words\npage {i}") for i in range(9)}
    assert M.extract_pages(spark.createDataFrame(rows, DDL).limit(0)).collect() == []


def test_quotes_count_only_after_an_equals_sign():
    stray = "<article><p>one <a title='it's'>two</a> three</p><p>it's four</p><p>five</p></article>"
    assert M.main_text(stray, set()) == "one two three\nit's four\nfive"
    assert M.main_text(stray.replace("it's four", "four"), set()) == "one two three\nfour\nfive"
    assert M.main_text("<article><p title=\"x>y\" z = 'a>b' w=c\"d>one</p><p x=>two</p><p y>three", set()) == "one\ntwo\nthree"
    assert M.main_text('<article><p>one</p><p title="cut>two</p>', set()) == "one\ntwo"


def test_templates_in_articles_go(spark):
    def page(i):
        return (f"<div class='page has-sidebar'><article><h2>Report</h2><p>story {i}</p><div class='zz9'><p>join our readers</p></div>"
                f"<p class='x1'>all times local</p><div><p>more on {i}</p></div><ul><li>as ever</li></ul></article></div>")

    rows = [(i, f"http://h.example/{i}", page(i), "", "") for i in range(9)]
    got = {(r["row"]["page_id"], r.text) for r in M.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(i, f"Report\nstory {i}\nmore on {i}\nas ever") for i in range(9)}


def test_parts_of_compound_names():
    page = "<div id='main-menu-layout'><article><p>text</p>{}<section class='no-ads'><p>more</p></section></article></div>"
    for name in ("ad-banner", "cookie-notice", "comment_list", "related-posts"):
        assert M.main_text(page.format(f"<div class='{name}'><p>gone</p></div>"), set()) == "text\nmore"
    assert M.main_text(page.format("<div class='adverb-list'><p>kept</p></div>"), set()) == "text\nkept\nmore"


def test_a_story_that_many_pages_bring_stays(spark):
    """Same story, other surroundings; and other headings, but most of the text the same."""
    same = "<p>ad {i}</p><article><h1>T</h1><div class='content'><p>The story text.</p></div></article>"
    most = "<article><h1>T {i}</h1><div class='content'><p>The long text of a story.</p></div></article>"
    rows = [(i, "http://a.example/", same.format(i=i), "", "") for i in range(6)] + [(10 + i, "http://b.example/", most.format(i=i), "", "") for i in range(6)]
    got = {(r["row"]["page_id"], r.text) for r in M.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(i, "T\nThe story text.") for i in range(6)} | {(10 + i, f"T {i}\nThe long text of a story.") for i in range(6)}


def test_anchors_and_nested_articles():
    page = ("<article><h2 id='comments'>On comments</h2><p id='notice'>a</p><section id='search'><p>b</p></section>"
            "<article class='comment'><p>reader</p></article><div id='comments'><p>c</p></div></article>"
            "<article class='related'><p>teaser</p></article><article class='second'><p>d</p></article>")
    assert M.main_text(page, set()) == "On comments\na\nb\nd"
    assert M.main_text("<div class='widget'>w</div><div><p>text</p></div>", set()) == "text"
    assert M.main_text("<article class='related story'><p>only one</p></article>", set()) == "only one"


def test_deep_pages_take_linear_time():
    import time

    begun = time.perf_counter()
    deep = "<article>" + "<div>word" * 20_000
    page = M.parse(deep)
    assert len(set(M.hashes(page))) == 20_001
    assert M.main_text(deep, {1}).count("word") == 20_000
    assert time.perf_counter() - begun < 20


def test_equal_subtrees_have_equal_hashes():
    page = M.parse("<div><p>one  <b>x</b>\n two</p></div><div><p>one <b>x</b> two</p></div><div><p>one <b>y</b> two</p></div>")
    a, b, c = (h for h, e in zip(M.hashes(page), page.elements) if e.tag == "div")
    assert a == b != c
