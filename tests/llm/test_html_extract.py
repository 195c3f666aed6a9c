import random
import time

from ripplegraph.llm import html_extract as H


def text(source, template=()):
    return H.main_text(H.read_page(source), set(template))


def frame(spark, data):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in data], "page_id long, url string, html string, text string, host int, classes int")


def test_article_without_what_stands_around_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- no --><div class="ad box">buy</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>One  two<br>three<p>Un&eacute;closed &lt;b&gt; &#x41;&nbsp;z</b></p><form>mail</form><aside>side</aside>
    <ul><li>a<li>b <i>c</i></ul><table><tr><td>1<td>2</table><script>x<y</script>tail<div class="comments"><p>reader</p></div></article>
    <section id="comments"><p>more</p></section><footer>&copy; foot</footer></body></html>"""
    assert text(page) == "Head & line\nOne two three\nUnéclosed <b> A z\na\nb c\n1 2\ntail"


def test_odd_html():
    assert text("") == text("   ") == ""
    assert text("no tags at all") == "no tags at all"
    assert text("a < b and c > d <p>e") == "a < b and c > d\ne"
    assert text("<script>never closed") == ""
    assert text("x<!-- never closed <p>y") == "x"
    assert text("<article>one</article> between <article class='comment'>no</article><main>two</main>") == "one\ntwo"
    assert text("<p " + "a" * 50_000) == "<p " + "a" * 50_000
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<p>" + "<a href=x>l</a> " * 9 + "</p><p>words <a>l</a> words words</p>") == "words l words words"


SKELETON = "<html><body><div><span>Welcome to this place</span></div><table><tr><td>Menu of the day</td></tr></table><div>{}</div><div>All rights kept</div></body></html>"


def pages(n, host="http://h.org/"):
    return [(i, f"{host}{i}", SKELETON.format("".join(f"<p>word{i} in paragraph {j} of page {i}</p>" for j in range(i % 4 + 1)))) for i in range(n)]


def test_template_text_goes_and_slots_stay(spark):
    lone = [(100, "http://alone.org/1", pages(1)[0][2])]
    got = {r["page_id"]: r for r in H.extract(frame(spark, pages(12) + lone)).collect()}
    for i in range(12):
        assert got[i]["text"] == "\n".join(f"word{i} in paragraph {j} of page {i}" for j in range(i % 4 + 1))
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"].startswith("Welcome to this place\nMenu of the day\nword0")  # a host of one page has no template


def test_classes_equal_plain_occurrence_vectors(spark):
    data = pages(9)
    own = [H.read_page(h).tokens for _, _, h in data]
    vectors = {}
    for i, tokens in enumerate(own):
        for t, element in tokens:
            v, e = vectors.setdefault(t, ([0] * len(data), element))
            v[i] += 1
    groups = {}
    for t, (v, e) in vectors.items():
        if max(v) == 1 and sum(v) >= max(H.MIN_PAGES, H.MIN_SHARE * len(data)):
            groups.setdefault(tuple(v), []).append((t, e))
    want = sorted(sorted(t for t, _ in g) for g in groups.values() if len(g) > 1 and any(e for _, e in g))
    got = H.templates(frame(spark, data)).collect()
    assert len(got) == 1
    assert sorted(sorted(t & H.MASK for t in c) for c in got[0]["classes"]) == want


def test_nesting():
    page = H.Page(tokens=[(i, True) for i in range(10)])
    assert H.nested_template(page, [[0, 9], [2, 4], [3, 5], [6], [7, 77]]) == {0, 9, 2, 4, 6}


def test_nulls_repeats_and_empty(spark):
    article = "<article><p>same text</p></article>"
    data = [(1, None, None), (2, "x", ""), (None, "http://h.org/", article), (3, "http://h.org/", article), (3, "http://h.org/", article), (4, "http://h.org/long", "<article>" + "<p>word word</p>" * 30_000 + "</article>")]
    got = sorted(((r["page_id"], r["url"], r["text"][:20], r["n_chars"]) for r in H.extract(frame(spark, data)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "x", "", 0), (None, "http://h.org/", "same text", 9), (3, "http://h.org/", "same text", 9), (3, "http://h.org/", "same text", 9), (4, "http://h.org/long", "word word\nword word\n", 299_999)], key=str)
    assert H.extract(frame(spark, [])).count() == 0


def test_copies_of_articles_are_no_template(spark):
    data = [(i, f"http://c.org/{i}", "<nav>menu</nav><article><h1>Licence</h1><p>The same words on every page.</p></article>") for i in range(20)]
    assert {r["text"] for r in H.extract(frame(spark, data)).collect()} == {"Licence\nThe same words on every page."}


def test_copies_without_article_count_once(spark):
    copy = "<html><body><div><h1>Licence</h1><p>The same words on every page.</p><p>And some more.</p></div></body></html>"
    data = [(i, f"http://c.org/{i}", copy) for i in range(20)] + [(20 + i, f"http://c.org/{20 + i}", f"<html><body><div><p>other {i}</p></div></body></html>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in H.extract(frame(spark, data)).collect()}
    assert {got[i] for i in range(20)} == {"Licence\nThe same words on every page.\nAnd some more."}
    assert [got[20 + i] for i in range(3)] == [f"other {i}" for i in range(3)]


def test_names_do_not_set_the_main_part_aside():
    story = "<h1>Head</h1><p>The story is told here at length.</p>"
    want = "Head\nThe story is told here at length."
    for page in (
        f"<html class='no-menu'><body class='has-sidebar'><article>{story}</article></body></html>",
        f"<body class='sidebar'><div>{story}</div></body>",
        f"<main class='with-menu'>{story}</main>",
        f"<article class='post comment-open'>{story}</article><div class='comments'><article class='comment'>reader</article></div>",
        f"<div class='layout has-sidebar'><div class='sidebar'>side</div><main>{story}<div class='share-box'>share</div></main></div>",
        f"<div class='content-with-sidebar'><article>{story}</article></div><p>small print</p>",
        f"<main><div class='with-sidebar'><article>{story}</article></div></main>",
        f"<div class='widget'><article>{story}</article></div>",
        f"<article class='comment'>{story}</article>",
        f"<article>{story}</article><div class='related-posts'><article>teaser</article></div>",
        f"<div>{story}</div><div id='comments'><article>reader {'words ' * 40}</article></div><div class='comment-list'><article>short</article></div>",
    ):
        assert text(page) == want, page


def test_template_text_within_articles_goes(spark):
    article = "<html><body><nav>menu</nav><article><h1>Title {0}</h1><p>Story {0} is told here.</p>{1}<div><p>Tell your friends about us.</p></div></article></body></html>"
    data = [(i, f"http://h.org/{i}", article.format(i, "<p>It goes on.</p>" if i % 3 == 0 else "")) for i in range(12)]
    data += [(100 + i, f"http://h.org/copy{i}", article.format(50, "")) for i in range(40)]  # copies do not make their article a template
    data += [(200, "http://h.org/bare", "<html><body><article><div><p>Tell your friends about us.</p></div></article></body></html>")]
    got = {r["page_id"]: r["text"] for r in H.extract(frame(spark, data)).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nStory {i} is told here." + ("\nIt goes on." if i % 3 == 0 else "")
    assert {got[100 + i] for i in range(40)} == {"Title 50\nStory 50 is told here."}
    assert got[200] == "Tell your friends about us."


def test_the_template_decides_where_no_element_is_named(spark):
    """Pages of the same layout without article, main, nav, class or id: the article is the slot with most of the varying text."""
    page = "<html><body><div><a href=x>Home</a> <a href=y>News</a></div><div>Buy {ad}!</div><div><h1>Title {i}</h1>{story}<div>Like this? Tell your friends.</div></div><div>Written {ad} by the staff</div></body></html>"
    story = lambda i: "".join(f"<p>Story {i} goes on in part {j} with many words.</p>" for j in range(2 + i % 3))
    data = [(i, f"http://n.org/{i}", page.format(i=i, ad=f"item{i}", story=story(i))) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in H.extract(frame(spark, data)).collect()}
    for i in range(20):
        assert got[i] == "\n".join([f"Title {i}", *(f"Story {i} goes on in part {j} with many words." for j in range(2 + i % 3))])
    alone = H.main_text(H.read_page(data[0][2]), set())
    assert "Buy item0!" in alone and "Like this?" in alone  # without a template nothing tells them


def test_the_query_equals_a_plain_reading(spark, write):
    """Classes from whole occurrence vectors in one process, then the same laying and choosing page by page."""
    rnd = random.Random(3)
    layout = "<html><body><ul><li>Menu</li><li>About</li></ul><div>{0}</div><section>{1}<p>Share it</p></section><footer>foot {2}</footer></body></html>"
    data = [(i, f"http://{'ab'[i % 2]}.org/{i // 2}", layout.format(rnd.choice("xyz"), "".join(f"<p>{' '.join(rnd.choices(['red', 'green', 'blue', 'sky'], k=9))}</p>" for _ in range(rnd.randrange(1, 5))), i)) for i in range(40)]
    want = {}
    for host in "ab":
        own = [(i, h) for i, u, h in data if u.startswith(f"http://{host}.")]
        pages = [H.read_page(h) for _, h in own]
        vectors, chars, around = {}, {}, {}
        for k, p in enumerate(pages):
            for t, _ in p.tokens:
                vectors.setdefault(t, [0] * len(own))[k] += 1
            for t, (box, c, main) in H._measured(p).items():
                chars[t], around[t] = chars.get(t, 0) + c, (box, main)
        groups = {}
        for t, v in vectors.items():
            if max(v) == 1 and sum(v) >= H.MIN_SHARE * len(own):
                groups.setdefault(tuple(v), []).append(t)
        groups = sorted((-sum(v), sorted(H._signed(t) for t in g)) for v, g in groups.items() if len(g) > 1 and any(t & 1 for t in g))
        region = H.main_box([(t & H.MASK, around[t & H.MASK][0], chars[t & H.MASK], around[t & H.MASK][1]) for _, g in groups for t in g if t & H.MASK in chars])
        assert region
        for i, h in own:
            page = H.read_page(h, region)
            want[i] = H.main_text(page, H.nested_template(page, [[t & H.MASK for t in g] for _, g in groups]))
    got = {r["page_id"]: r["text"] for r in H.op7_html_extract(spark, write(pages=frame(spark, data))).collect()}
    assert got == want and not any("Share it" in t or "Menu" in t for t in got.values())


def test_broken_markup_takes_linear_time():
    began = time.perf_counter()
    n = 60_000
    for page in ("<a '" * (4 * n), '<a ="' * (4 * n), "<a " * (4 * n), "<span>" * n + "</b>" * n, "<b>" * n + "<div>" + "<i>" * n + "</b>" * n, "<li><span>" * n, "<script" * n, "</script " * n, "<!--" * n, "<div>" * n + "<p>x", "&amp" * n, "<td>" * n, "<!x" * n):
        H.read_page(page)
    assert time.perf_counter() - began < 60


def test_references_stay_within_their_run():
    assert text("<p>AT&<b>amp;</b> &lt;i&gt;</p>") == "AT&amp; <i>"
    assert text("<article><p>x <math><mi>y</mi></math> z</p></article>") == "x y z"
