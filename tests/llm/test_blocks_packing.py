import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldpulse.llm import html_blocks, packing
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def article(page):
    """The given pages' article: h1 and paragraphs of the article element, by a plain pattern."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<[^>]+>", "", x) for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(x for x in (" ".join(html_blocks.entities.unescape(p).split()) for p in parts) if x)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = Counter((r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages.collect())
    assert Counter(tuple(r) for r in html_blocks.extract(pages).collect()) == want


PAGE = """<!doctype html><html><head><title>Site</title><style>p{}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="post"><header><h1>My site</h1><ul><li><a href=/>Home</a></li></ul></header><div id=cookie-notice><p>We use cookies, really a lot of them and long text.</p></div>
<main><h1>The  title &amp; more</h1><div class="share-bar">Share this</div><p>First <b>para</b>graph with <a href="x" title="a > b">a link</a>&nbsp;and&#8212;more.<br>second line
<p>Yes.<ul><li>one</li><li>two</li></ul><blockquote>Quoted</blockquote><table><tr><td>cell</td><td>next</td></tr></table>
<aside>Aside text that is long enough to look like an article, with many words and no link at all in it.</aside>
<form><label>Your name</label><input value=x><button>Send</button></form><!-- <p>hidden</p> -->
<section class="comments"><p>Great read, I liked it a lot, thank you so much for writing it and sharing it here.</p></section></main>
<div class=sidebar><p>Sidebar text of some length, again without any link so that only its place tells.</p></div><footer>&copy; x</footer><noscript>no js</noscript>"""


def test_one_page_in_full():
    assert html_blocks.main_text(PAGE).split("\n\n") == [
        "The title & more", "First paragraph with a link and—more. second line", "Yes.", "one", "two", "Quoted", "cell", "next"]


def test_unmarked_page():
    long = "A paragraph of a page without any mark that goes on for quite some words, " * 3
    page = f"<div><a>Home</a> <a>News</a></div><div>{long}</div><div>{long}</div><div><a href=x>more</a> <a href=y>links here</a></div>"
    assert html_blocks.main_text(page) == f"{long.strip()}\n\n{long.strip()}"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<", ""), ("<p", ""), ("<article>a < b &lt c</article>", "a < b < c"), ("<article><script>x", ""),
    ("<article>one<!-- open", "one"), ("<article>x" + " y" * 50000, "x" + " y" * 50000), ("<article>" + "<div>" * 30000 + "deep" + "</p></b>" * 30000, "deep"),
    ("<article><span class=ad>buy</span> text <a href=x>link</a></article>", "text link"), ("<article>" + "<b class=ad>x" * 20000, ""),
    ('<article><a title="' * 2000 + "x", ""), ("<article>A&amp;amp;&#x41;&bogus;</article>", "A&amp;A&bogus;")])
def test_awkward_pages(page, text):
    assert html_blocks.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ap \"'=&;", max_size=200))
def test_any_markup(page):
    html_blocks.main_text(page)


def test_tree_learns_its_table():
    wrong = [r for r in html_blocks.LABELLED if html_blocks.classify(r[:-1], html_blocks.tree()) != r[-1]]
    assert not wrong


def test_pages_with_nulls(spark):
    rows = [(1, None, None, "x"), (None, "u", "<article>t</article>", None), (1, None, None, "x"), (2, "v", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert Counter(tuple(r) for r in html_blocks.extract(pages).collect()) == Counter({(1, None, "", 0): 2, (None, "u", "t", 1): 1, (2, "v", "", 0): 1})
    assert html_blocks.extract(pages.limit(0)).count() == 0


def prose(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def kept(page):
    """Leading words of the blocks that stay, without their number."""
    return [x.split()[0].rstrip("0") for x in html_blocks.main_text(page).split("\n\n") if x]


def test_names_of_wrappers_do_not_decide():
    body = "".join(f"<p>{prose(t, 60)}</p>" for t in "abc")
    for open_, close in (('<div class="content has-sidebar">', "</div>"), ('<div id="content-sidebar-wrap">', "</div>"), ('<article class="post comment-status-open">', "</article>"),
                         ('<form id="aspnetForm">', "</form>"), ('<div class="widget">', "</div>")):
        assert kept(f"<body>{open_}{body}{close}</body>") == ["a", "b", "c"], open_
    assert kept(f'<form><article><h1>h0 title</h1>{body}</article></form>') == ["h", "a", "b", "c"]
    # names that are whole still tell short text and text among links
    assert kept(f'<article>{body}<div class="share-bar">s0 this</div>{body}</article>') == ["a", "b", "c"] * 2
    comment = f"<p>John</p><p>{prose('z', 60)}</p><a href=r>Reply</a>"
    assert kept(f'<article>{body}</article><section class="comments">{comment * 3}</section>') == ["a", "b", "c"]


@pytest.mark.parametrize("mark", [f'class="{x}"' for x in (
    "ad", "ad-slot", "ad-unit", "google-ad", "adsbygoogle", "sponsored-content", "promo-teaser", "comments", "comment-body", "user-comment", "reader-comments",
    "alert-message", "sidebar-module", "share-tools", "cookie-notice", "relatedPosts", "x1 newsletter-signup")] + ['id="comments"', 'id=disqus_thread', 'style="display: none"', 'style="x:y;visibility:hidden"', "hidden"])
@pytest.mark.parametrize("tag", ["div", "section", "p", "article"])
def test_what_is_no_article_text_goes_wherever_it_stands(tag, mark):
    body = "".join(f"<p>{prose(t, 60)}</p>" for t in "ab")
    inner = "".join(f"<p>{prose('z', 60)}</p>" for _ in range(3)) if tag != "p" else prose("z", 200)
    part = f"<{tag} {mark}>{inner}</{tag}>"
    assert kept(f"<article>{body}{part}{body}</article>") == ["a", "b"] * 2
    assert kept(f"<body><article>{body}</article>{part}</body>") == ["a", "b"]
    assert kept(f"<body><div>{body}</div>{part}<div>{body}</div></body>") == ["a", "b"] * 2


@pytest.mark.parametrize("name", ["content sidebar", "content-sidebar-wrap", "has-sidebar", "post-content comments-open", "comment-status-open", "no-ads-here", "shared-space", "discussion", "widget", "adder"])
def test_names_that_may_be_wrappers_keep_their_text(name):
    body = "".join(f"<p>{prose(t, 60)}</p>" for t in "abc")
    assert kept(f'<body><div class="{name}">{body}</div></body>') == ["a", "b", "c"]


def test_short_pages_without_marks_keep_their_text():
    assert html_blocks.main_text("<h1>Title</h1><p>Nine words stand in this first short paragraph here.</p><p>And a few more.</p>") == (
        "Title\n\nNine words stand in this first short paragraph here.\n\nAnd a few more.")
    links = "<ul><li><a href=a>Home</a></li><li><a href=b>All the news</a></li></ul>"
    assert html_blocks.main_text(f"{links}<h1>Title</h1><p>Some eight words or so of a text.</p><p>The last one has about nine words, too.</p>{links}") == (
        "Title\n\nSome eight words or so of a text.\n\nThe last one has about nine words, too.")
    assert html_blocks.main_text(links) == "" and html_blocks.main_text("<p>One line.</p>") == "One line."


@pytest.mark.parametrize("tag", ["""<a title='5" pipe'>""", """<a href="x"">""", """<a href="x>""", """<a title='a > b' class="x">""", """<a alt=it's>""", """<a title="a > b">""",
                                 """<a title='see class=ad'>""", """<b title="has > role=menu hidden ">""", "<svg>", "<video controls>", "<object data=x>", "<select>"])
def test_odd_tags_keep_the_rest_of_the_page(tag):
    page = f'<article><p>one {tag}two</p><p class="x">three <a href="y">four</a></p><p id="z">five</p></article>'
    assert html_blocks.main_text(page) == "one two\n\nthree four\n\nfive"


@pytest.mark.parametrize("part", ['<a b=">"', "<a b='>", """<a b="'>""", "<svg>", '<a b="" c=', "<a b='\"", "<a =", '<p title="'])
def test_odd_tags_take_time_in_proportion(part):
    start = time.process_time()
    html_blocks.blocks(part * (1_000_000 // len(part)) + "\">'")
    assert time.process_time() - start < 20


def test_neighbours_decide_about_equal_blocks():
    links, short, long = "<p><a href=x>more links here</a></p>", "<p>s0 short</p>", f"<p>{prose('t', 60)}</p>"
    # (block, before, after) with the same words, density and marks
    def one(block, before, after, wrap="{}"):
        page = wrap.format(before + block + after)
        found = html_blocks.blocks(page)
        return html_blocks.classify(html_blocks.described(found)[len(html_blocks.blocks(before))], html_blocks.tree())
    assert one(links, long, long, "<main>{}</main>") == 1 and one(links, links, links, "<main>{}</main>") == 0
    assert one(short, long, long) == 1 and one(short, links, links) == 0
    inner = '<main><p>x</p></main><div>{}</div>'
    assert one(long, long, long, '<div class="widget">{}</div>') == 1 and one(long, links, links, '<div class="widget">{}</div>') == 0
    found = html_blocks.blocks(inner.format(long * 3))
    assert [html_blocks.classify(x, html_blocks.tree()) for x in html_blocks.described(found)] == [1, 0, 1, 0]

    def used(node):
        return set() if isinstance(node, int) else {html_blocks.FEATURES[node[0]]} | used(node[2]) | used(node[3])
    assert used(html_blocks.tree()) == set(html_blocks.FEATURES)


def brute_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
                if sum(x[0] for x in b) + size <= capacity and not any((source is not None and source == x[1]) or (cluster is not None and cluster == x[2]) for x in b)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((size, source, cluster))
        out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c", "d"]), st.sampled_from([None, 1, 2, 3, 4, 5, 6])), max_size=40))
def test_best_fit_matches_brute_force(items):
    assert packing.best_fit(items, 20) == brute_best_fit(items, 20)


@pytest.mark.parametrize("which", ["given", "odd"])
def test_packing(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "given" else odd.frame(spark)
    rows = docs.collect()
    sizes = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) + 1) for r in rows)
    got = packing.pack(docs, capacity=512, group_items=60).collect()
    assert sum(r.n_tokens for r in got) == sum(n * k for (_, n), k in sizes.items())
    fill, members = Counter(), defaultdict(list)
    of = {r.doc_id: r for r in rows}
    for r in got:
        fill[r.bin] += r.n_tokens
        members[r.bin].append(r.doc_id)
        assert 0 < r.n_tokens <= 512 and r.first_token == 512 * r.piece
    assert max(fill.values()) <= 512 and sorted(fill) == list(range(len(fill)))
    if which == "given":
        for ids in members.values():
            own = [of[i] for i in ids]
            assert len({r.source for r in own}) == len(own) and len({r.text for r in own}) == len(own)
    assert len(fill) < 0.75 * len(rows) + sum(n // 512 for (_, n), k in sizes.items() for _ in range(k))


def test_packing_empty(spark):
    assert packing.pack(odd.none(spark)).count() == 0
