"""Extraction on small pages with known texts."""

from gazette.llm import html_text
from gazette.llm.html_text import parse


def text(page):
    return "\n".join(t for _, t, _ in parse(page)[0])


def test_article_with_everything_around():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="home">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <article>no</article> --><div class="ad-slot top">Buy</div>
    <main><aside>Side</aside><article id=x><header><h1>Title &amp; more</h1></header><p><b>First  line<br>goes on<p>Second\n\tone&nbsp;&lt;b&gt; &#233;
    <form><p>Mail?</p><input></form><div class="cookie notice">We use</div><table><tr><td>a<td>b<tr><td>c</table><ul><li>one<li>two</ul>
    <section id="comments"><p>Nice</p></section><a title="x > y">link</a> end</article><div class="sidebar">more</div></main><footer>(c)</footer></body></html>"""
    assert text(page) == "Title & more\nFirst line goes on\nSecond one <b> é\na b\nc\none\ntwo\nlink end"


def test_odd_pages():
    assert text("") == text("<") [:0] == text("<!-- <p>x") == text("<script>alert(1)") == ""
    assert text("plain a < b text") == "plain a < b text"
    assert text("</p></div>x<p>y</nav>z") == "x\ny z" or text("</p></div>x<p>y</nav>z") == "x\nyz"
    assert text("<article><p>never closed <i>at all") == "never closed at all"
    assert text("<nav>menu<article><p>in menu</article></nav><p>out") == "out"
    assert text("<div hidden>no</div><div style='display: none'>no</div><p>yes") == "yes"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert text(deep) == "x"


def test_wrappers_are_no_boilerplate():
    story = "<article><h1>Title</h1><p>The story is told here.</p></article>"
    for around in ("<div class='content-sidebar-wrap'>%s</div>", "<div class='layout no-sidebar'>%s</div>", "<div id='search-results-page'>%s</div>", "<div class='layout sidebar'>%s</div>", "<form id='aspnetForm'>%s<footer>(c)</footer></form>", "<form><div class='widget'>%s</div></form>"):
        assert text(f"<body><nav>Menu</nav>{around % story}</body>") == "Title\nThe story is told here.", around
    assert text(f"<form><div class='related'><article>Another card</article></div>{story}</form>") == "Title\nThe story is told here."
    assert text(f"<div class='related'><article>Another card that is longer than the story itself is</article></div>{story}") == "Title\nThe story is told here."
    assert text("<body><form id=f><div><p>Long text without an article</p></div></form><p>short</p></body>") == "Long text without an article\nshort"
    assert text("<body><div><p>The story is as long as this</p></div><div class='ad'>Buy</div><div id='comments'><article>First!</article></div></body>") == "The story is as long as this"
    assert text("<article></article><div class='ad'><p>Buy</p></div>") == text("<body><div class='ad'>Buy</div></body>") == ""


def test_names_within_articles():
    page = "<article><p class='notice'>Mind this</p><section class='related-work'><p>Others did</p></section><h2 id='comments'>Comments on law</h2><p>One <span class='ad'>Buy</span> two</p><div class='comments'><p>" + "Nice " * 50 + "</p></div></article>"
    assert text(page) == "Mind this\nOthers did\nComments on law\nOne two"


def test_tree_removes_what_repeats(spark):
    page = lambda i: f"<body><div class='a'><p>Same banner text</p></div><div class='b'><p>Story number {i} is new</p><p>More {i * 7}</p></div></body>"
    rows = [(i, f"http://H.example/{i}", page(i), 1) for i in range(12)] + [(100, "http://few.example/x", page(3), 1), (101, None, None, 1), (102, "http://h.example/e", "", 1)]
    rows += [(3, "http://H.example/3", page(3), 1)]  # a repeated row
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {}
    for r in html_text.main_text(df).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    assert out[5] == ["Story number 5 is new\nMore 35"] and len(out[3]) == 2
    assert out[100] == ["Same banner text\nStory number 3 is new\nMore 21"]
    assert out[101] == [""] and out[102] == [""] and sum(map(len, out.values())) == len(rows)
    assert html_text.main_text(df.limit(0)).collect() == []
    tree = {r.path: r.importance for r in html_text.style_tree(html_text.parts(df)).where("host = 'h.example'").collect()}
    assert tree[">body>div.a"] < 0.3 < tree[">body>div.b"]


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://h/{i}", "<article><p>The same in all</article>") for i in range(9)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["The same in all"] * 9


def test_tree_decides_within_articles(spark):
    more = "<div class='x'><p>Read more from us</p></div>"
    page = lambda i: f"<body><main><article><h1>Title {i}</h1><p>Story number {i}</p><p>It goes on {i * 7}</p>{more}</article></main></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)]
    rows += [(50, "http://few/1", page(50)), (51, "http://h/51", f"<body><main><article>{more}</article></main></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert all(got[i] == f"Title {i}\nStory number {i}\nIt goes on {i * 7}" for i in range(12))
    assert got[50].endswith("Read more from us") and got[51] == "Read more from us"


def test_articles_are_no_branches():
    blocks = [(">body>*main>p", "a", True), (">body>*main>div.x>*article>p", "b", True), (">body>*main>div.x>*article>div.y>p", "c", True), (">body>p", "d", False)]
    assert html_text.lasting(blocks, {">body>*main>div.x", ">body>*main>div.x>*article", ">body>*main"}) == ["a", "b", "c", "d"]
    assert html_text.lasting(blocks, {">body>*main>p"}) == ["b", "c", "d"]
    assert html_text.lasting(blocks[:1], {">body>*main>p"}) == ["a"]
    assert html_text.lasting(blocks, {">body>*main>div.x>*article>div.y"}) == ["a", "b", "d"]
    assert html_text.lasting(blocks, {">body>*main>div.x>*article>div.y", ">body>*main>div.x>*article>p", ">body"}) == ["a", "b", "c"]


def test_a_story_that_pages_share_stays(spark):
    story = "<p>The agency reports at length what happened on that day in the harbour.</p><p>And its second paragraph says how it ended.</p>"
    shared = [(i, "http://h.example/s", f"<article><h1>Daily bulletin {i}</h1><div class='body'>{story}</div></article>") for i in range(5)]
    others = [(100 + i, "http://h.example/o", f"<article><h1>Own {i}</h1><div class='text'><p>Own text number {i} of this page, and no other.</p></div></article>") for i in range(20)]
    rows = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(shared + others, "page_id long, url string, html string")).collect()}
    assert all("agency reports" in rows[i] and "how it ended" in rows[i] and rows[i].startswith(f"Daily bulletin {i}") for i in range(5))
    assert all(rows[100 + i] == f"Own {i}\nOwn text number {i} of this page, and no other." for i in range(20))


def test_names_within_an_article_are_only_a_doubt(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>Text {i} of the page, long enough to be more than half of all.</p><div class='related'><p>Related work {i} is told here.</p></div><table class='form'><tr><td>cell {i}</td></tr></table><div class='ad'>Buy {i}</div><div class='x'>Read more</div></article>"
    df = spark.createDataFrame([(i, "http://h.example/s", page(i)) for i in range(12)], "page_id long, url string, html string")
    for r in html_text.main_text(df).collect():
        i = r["page_id"]
        assert r["text"] == f"Title {i}\nText {i} of the page, long enough to be more than half of all.\nRelated work {i} is told here.\ncell {i}"
