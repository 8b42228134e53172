import random

import pytest
from tiffinlake.llm import wrapper

SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string"
FURNITURE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body>"
    "<header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
)
AFTER = (
    "<aside>side</aside><section id='comments'><p>a reader says</p></section><form><input><button>Go</button></form>"
    "<div class=ad>buy</div><footer>&copy; x</footer></body></html>"
)


def page(body):
    return FURNITURE + body + AFTER


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A&amp;B</h1><p>x <b>y</b>z<br>q</p><p>\n two\t\twords </p></article>", "A&B x yz q two words"),
        ("<article><p>open<p>next<ul><li>one<li>two</ul></article>", "open next one two"),
        ("<main><div>in main</div></main>", "in main"),
        ("<div><p>plain &lt;b&gt; &#233;&eacute;</p></div>", "plain <b> éé"),
        ("<article><p>a<!-- <p>hidden</p> -->b</p><noscript>no</noscript></article>", "ab"),
        ("<article>text<div class='share'>Share</div><p title='a>b'>more</p></article>", "text more"),
        ("<article><p>short</p></article><article><p>the longer one</p></article>", "short the longer one"),
        ("<article></article>", ""),
    ],
)
def test_main_text(body, text):
    assert wrapper.main_text(page(body)) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("just text", "just text"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut</p", "cut"),
     ("<article><p>a</p><!-- never", "a"), ("<p>a<script>b", "a"), ("a < b <3 c", "a < b <3 c"), ("<a title='x", "")],
)
def test_broken_pages(html, text):
    assert wrapper.main_text(html) == text


def test_long_pages_take_linear_time():
    assert len(wrapper.main_text("<article>" + "<p>a b</p>" * 60_000)) == 60_000 * 4 - 1
    assert wrapper.main_text("<div>" * 3000 + "deep") == "deep"
    wrapper.main_text("<a b='" * 100_000)
    wrapper.main_text("<" * 200_000)


def test_matching_is_the_largest_ordered_one():
    def tree(kind, *children):
        return [kind, 1, {}, list(children)]

    a = tree("r", tree("x"), tree("y", tree("z")), tree("x"))
    b = tree("r", tree("y", tree("z")), tree("w"), tree("x"))
    size, pairs = wrapper.match(a, b, lambda n: n[3], lambda n: n[0])
    assert size == 3 and pairs == [(1, 0), (2, 2)]


def test_texts_of_all_pages_of_a_host_are_template(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(120):
        words = " ".join(rng.choice("abcdefg") * 5 for _ in range(30))
        extra = f"<p class=lead>lead {i}</p><p class=tag>Fixed tag</p>" if i % 3 == 0 else ""
        body = f"<article>{extra}<p>Follow us on all channels</p><p>{words}</p><p>{i}</p></article>"
        rows.append((i, f"https://Site.example/{i}", page(body), "h", "w", "t"))
        want[i] = (f"lead {i} " if extra else "") + f"{words} {i}"
    for i in range(200, 203):  # a host with few pages has no template
        rows.append((i, "http://few.example/", page(f"<article><p>Same</p><p>{i}</p></article>"), "h", "w", "t"))
        want[i] = f"Same {i}"
    for i in range(300, 340):  # copies keep their text
        rows.append((i, "http://copies.example/", page("<article><p>Copied text</p></article>"), "h", "w", "t"))
        want[i] = "Copied text"
    rows += [(400, None, None, None, None, None), (401, "not a url", "", "h", "w", "t"), (402, None, "<p>x", "h", "w", "t")]
    want |= {400: "", 401: "", 402: "x"}
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = wrapper.extract(table)
    assert got.columns == ["page_id", "url", "text"]
    assert {r.page_id: r.text for r in got.collect()} == want
    assert wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    rows = [(i, "http://a.example/", page(f"<article><p>Ad line</p><p>text number {i}</p></article>"), "", "", "") for i in range(30)]
    got = wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {f"text number {i}" for i in range(30)}


ARTICLE = "<article><p>the story</p><div class='share'>Share</div></article>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "no-sidebar", "with-sticky-header", "elementor-widget-container", "menu open"])
def test_named_layout_wrappers_keep_the_article(name):
    for inner in (ARTICLE, f"<main>{ARTICLE}</main>", "<main><p>the story</p></main>", "<p>the story, told without an article</p>"):
        text = wrapper.main_text(page(f"<div class='{name}'><div id='{name}'>{inner}</div></div>"))
        assert text.startswith("the story") and "Share" not in text and "reader" not in text
    inside = f"<article><p>head</p><div class='{name}'><p>most of the story</p></div></article>"
    assert wrapper.main_text(page(inside)) == "head most of the story"


def test_boxes_with_articles_of_their_own_stay_out():
    comments = "<div id='comments'><article><p>a comment that is longer than the story</p></article></div>"
    for body in (ARTICLE + comments, f"<main>{ARTICLE}{comments}</main>", f"<div class='sidebar-wrap'>{comments}{ARTICLE}</div>"):
        assert wrapper.main_text(page(body)) == "the story"
    teaser = "<div class='widget'><article>next</article></div>"
    assert wrapper.main_text(page(f"<main><p>the story</p>{teaser}</main>")) == "the story"
    assert wrapper.main_text(page(f"<article>next</article><div class='content-sidebar-wrap'>{ARTICLE}</div>")) == "the story"
    assert wrapper.main_text(page(f"<form id='aspnetForm'>{ARTICLE}</form>")) == "the story"


def test_deep_pages_among_others_of_their_host(spark):
    bodies = [f"<article><p>Ad line</p><p>text number {i}</p></article>" for i in range(20)]
    deep = ["".join(f"<div class={'abc'[k % 3]}>" for k in range(3000)) + "<p>Ad line</p>" + f"deep {i}" for i in range(3)]
    table = spark.createDataFrame([(i, "http://a.example/", b, "", "", "") for i, b in enumerate(bodies + deep)], SCHEMA)
    got = {r.page_id: r.text for r in wrapper.extract(table.coalesce(2)).collect()}
    assert got == {i: f"text number {i}" for i in range(20)} | {20 + i: f"Ad line deep {i}" for i in range(3)}
    tree = wrapper.page_wrapper(deep[0])
    assert wrapper.dumps(wrapper.loads(wrapper.dumps(tree))) == wrapper.dumps(tree) and wrapper.count_nodes(tree) > 3000


def test_no_frequent_text_is_lost_among_many(spark):
    rows, want = [], {}
    for i in range(300):  # one node with 20 new texts a page, and a notice that the first pages lack
        told = " ".join(f"text {i} {k} of many" for k in range(20))
        body = "".join(f"<p>text {i} {k} of many</p>" for k in range(20)) + ("<p>A notice</p>" if i >= 5 else "")
        rows.append((i, "http://a.example/", f"<article>{body}</article>", "", "", ""))
        want[i] = told
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:03}") for i in range(600)]
    for i, name in enumerate(names):  # more nodes than a wrapper holds, one of them rare and fixed
        box = "<section class=author><p>All about the author</p></section>" if i % 25 == 0 else ""
        body = f"<article>{box}<div class={name}>own {i}</div><p>a story of some length, {i}</p></article>"
        rows.append((1000 + i, "http://b.example/", body, "", "", ""))
        want[1000 + i] = f"own {i} a story of some length, {i}"
    table = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 5):
        assert {r.page_id: r.text for r in wrapper.extract(table.coalesce(parts)).collect()} == want
