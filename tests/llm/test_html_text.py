import html as H
import re
import time

from pyspark.sql import functions as F

from kinsift.llm import html_text as T


def plain(page):
    """The generated pages' articles by regular expressions."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(H.unescape(re.sub("<[^>]*>", " ", b) if "<br>" in b else re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_equals_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in T.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_recurrence_decides_most_and_alone_gives_the_same_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, _ = T.address(F.col("url"))
    rows = pages.select(host.alias("host"), "html", F.xxhash64("html").alias("page"))
    recurring = {}
    for r in T.recurring_subtrees(rows, T.LEAST_PAGES, T.SHARE, T.TEXT_SHARE)[1].collect():
        recurring.setdefault(r.host, set()).add(r.key)
    by = [T.Page(r.html).removed(recurring.get(r.host, set())) for r in rows.collect()]
    recurrence, only_meaning = sum(x[0] for x in by), sum(x[1] for x in by)
    print(recurrence, only_meaning)
    assert recurrence > 10 * only_meaning
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    alone = {r.page_id: r.text for r in T.extract(pages, meaning=False).collect()}
    neither = {r.page_id: r.text for r in T.extract(pages, meaning=False, least=10**9).collect()}
    print(sum(alone[k] == want[k] for k in want), sum(neither[k] == want[k] for k in want), len(want))
    assert sum(alone[k] == want[k] for k in want) > 0.9 * len(want) and not any(neither[k] == want[k] for k in want)


def test_many_nested_elements_take_linear_time():
    page = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    start = time.perf_counter()
    assert T.Page(page).subtrees() and T.Page(page).main_text(frozenset([1])) == "deep"
    assert time.perf_counter() - start < 10


def test_meaning_of_elements():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id=cookie-notice>Accept</div>
    <ul class="menu"><li>One<li>Two</ul><main><article><header><h1>A &amp; B</h1></header><p>First <b>bold</b>\n line<br>next<p>Second&nbsp;x
    <div class="ad">Buy</div><aside>Side</aside><ul><li>i1<li>i2</ul><form><label>Mail</label><input></form><pre>a\n b</pre>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section><span class="share">Tweet</span>tail</article></main>
    <script>if (a < b) "</p>"</script><footer>&copy;</footer></body>"""
    assert T.Page(page).main_text(frozenset()) == "A & B\nFirst bold line next\nSecond x\ni1\ni2\na b\ntail"


def test_recurring_subtrees_go_and_copied_prose_stays(spark):
    rows = [(i, "http://H.example/x", f"<body><div><div>Template <a href=/>home</a></div></div><div><p>Own {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><div>Chrome</div><article><p>Shared passage</p><p>Own {i}</p></article></body>") for i in range(12)]
    rows += [(200 + i, "http://c.example/", "<body><div>Same page</div><p>text</p></body>") for i in range(12)]
    rows += [(300, "http://d.example/", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rows_at_most in (0, 1000):
        got = {r.page_id: r.text for r in T.extract(pages, broadcast_rows=rows_at_most).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == f"Own {i}" and got[100 + i] == f"Shared passage\nOwn {i}" and got[200 + i] == "Same page\ntext" for i in range(12))
        assert got[300] == "Template home\nOwn 0"


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "http://x/", "just &lt;text&gt; & more"), (3, "http://x/", "just &lt;text&gt; & more"), (None, "http://x/", "<p>a<p>b"), (4, "http://x", "<article>" + "<div>" * 3000 + "deep"), (5, "http://x", '<p class="a>unclosed'), (6, "http://x", "<script>never closed"), (7, "http://x", "<!-- open <p>x"), (8, "http://x", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in T.extract(pages).collect()), key=str)
    want = {1: "", 2: "", 3: "just <text> & more", 0: "a\nb", 4: "deep", 5: "unclosed", 6: "", 7: "", 8: ("word " * 100_000).strip()}
    assert len(got) == len(rows) and all(t == want[k] and n == len(t) for k, t, n in got)
    assert T.extract(pages.filter("false")).collect() == []


def test_only_whole_attribute_names_say_that_an_element_is_hidden():
    kept = ['a href="/hidden-lake"', 'a href="/x?id=login"', "a href=/hidden/id=login", 'p title="a hidden gem"', "p title='class=ad'", 'div data-hidden="false"', 'div data-id="ad" data-class=ad', 'p title = "role=search" lang=en', 'div aria-hidden="false"', 'img alt="style=display:none"', 'div hidden-x id=""', "div data-style='display:none'"]
    for tag in kept:
        name = tag.split()[0]
        assert T.Page(f"<article><p>one</p><{tag}>two</{name}></article>").main_text(frozenset()) == "one\ntwo", tag
    gone = ["div hidden", "div HIDDEN=''", 'p title="x"hidden', "div/hidden", 'div class = "x ad"', "p title='x' id=login", "div data-x=1 role=search", "div aria-hidden='true'", 'a href="/x" style="display: none"', 'div id="" hidden', "div hidden/"]
    for tag in gone:
        name = re.match("[a-z]+", tag)[0]
        assert T.Page(f"<article><p>one</p><{tag}>two</{name}></article>").main_text(frozenset()) == "one", tag
    assert T.Page('<article><p>See <a href="/hidden-lake">the lake</a> there</p></article>').main_text(frozenset()) == "See the lake there"


def test_recurring_prose_in_main_goes_and_in_an_article_stays(spark):
    note = "<div><p>Join our readers and get a letter each week.</p></div>"
    rows = [(i, f"http://m.example/{i}", f"<body><main>{note}<p>Own {i}</p></main></body>") for i in range(12)]
    rows += [(100 + i, f"http://a.example/{i}", f"<body><main>{note}<article>{note}<p>Own {i}</p></article></main></body>") for i in range(12)]
    rows += [(200 + i, f"http://f.example/{i}", f"<body><main>{note}<p>Own {i}</p></main></body>") for i in range(2)]
    rows += [(300 + i, f"http://c.example/{i}", f"<body><div>{i}</div><main>{note}<p>Copied</p></main></body>") for i in range(12)]
    got = {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = "Join our readers and get a letter each week."
    assert all(got[i] == f"Own {i}" and got[100 + i] == f"{kept}\nOwn {i}" for i in range(12))
    assert all(got[200 + i] == f"{kept}\nOwn {i}" for i in range(2))  # in fewer parents than a template
    assert all(got[300 + i] == f"{kept}\nCopied" for i in range(12))  # a copied main has one content, and stays
