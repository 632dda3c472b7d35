import time
from collections import defaultdict

import pytest

from rillet.llm import html_extract as h

CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("<article><h1>A&amp;B</h1><p>one  <b>t</b>wo<br>three\n</p></article>", "A&B one two three"),
    (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>"
        "<article><h1>H</h1><p><b>open<br><p>next</p></article><footer>&copy; f</footer></body></html>",
        "H open next",
    ),
    ("<main><p>x &lt;y&gt; &#233;&#x4e2d; &quot;q&quot;</p><aside>side</aside><form>f<p>g</form><p>z</main>", 'x <y> é中 "q" z'),
    ("<article><p>a</p><div class='comments'><p>c</p></div><div id=\"related-posts\">r</div><p>b</p></article>", "a b"),
    ("<article><p>text<!-- no > comment --> more</p><!-- cut off", "text more"),
    ("<article><p>cut <a href=\"/x", "cut"),
    ("<article>t<script>never closed <p>x", "t"),
    ("<body class='has-sidebar'><article class='post'>kept</article></body>", "kept"),
    ("<article>" + "w " * 50000 + "</article>", ("w " * 50000).strip()),
    ("<div id='content'><p>c</p></div><div class='cookie-notice'>n</div>", "c"),
    ("<ARTICLE><P>Up</P></ARTICLE><NAV>n</NAV>", "Up"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1 2 3 4"),
    ("<article>a<br/>b<hr>c<img src=x alt='d>'>e</article>", "a b c e"),
    ("a < b and c > d", "a < b and c > d"),
]


def run(spark, rows):
    df = spark.createDataFrame([(i, u, t, 0) for i, u, t in rows], "page_id long, url string, html string, text int")
    return {r["page_id"]: r["text"] for r in h.main_text(df).collect()}


def test_markup(spark):
    rows = [(i, f"http://h{i}.org/", html) for i, (html, _) in enumerate(CASES)]
    got = run(spark, rows)
    for i, (html, want) in enumerate(CASES):
        assert got[i] == want, html


NAMES = [
    (
        '<article><section id="market-share">a</section><h2 id="search-methods">b</h2><div class="table-header">c</div>'
        '<p id="notice-of-appeal">d</p><div class="share">x</div><div role="navigation">y</div><p class="lead ad">z</p></article>',
        "a b c d",
    ),
    ('<div class="post-meta">by me</div><div><p>the whole article stays here</p></div>', "by me the whole article stays here"),
    ('<div><span>2020</span></div><div class="entry-content"><p>the whole article is here</p></div>', "the whole article is here"),
]


@pytest.mark.parametrize(("html", "want"), NAMES)
def test_names_drop_no_article(html, want):
    main, tokens = h._read(html)
    assert (main or " ".join(tokens)) == want


def covered_by_suffix_array(pages, k):
    """Tokens in a common prefix of at least k tokens with a suffix of another page, by sorting all suffixes."""
    suffixes = sorted((tokens[i:], page, i) for page, tokens in pages.items() for i in range(len(tokens)))
    covered = defaultdict(set)
    for n, (a, page, i) in enumerate(suffixes):
        for step in (-1, 1):
            m, common = n + step, len(a)
            while 0 <= m < len(suffixes):
                b, other, _ = suffixes[m]
                common = next((j for j in range(min(common, len(b))) if a[j] != b[j]), min(common, len(b)))
                if common < k:
                    break
                if other != page:
                    covered[page].update(range(i, i + common))
                    break
                m += step
    return covered


@pytest.mark.parametrize("k", [3, 8])
def test_repeated_runs_are_those_of_a_suffix_array(spark, k):
    menu = [f"menu{i}" for i in range(12)]
    foot = [f"foot{i}" for i in range(9)]
    pages = {}
    for p in range(12):
        own = [f"w{p}_{i}" for i in range(20)]
        part = menu if p % 3 else menu[:7]
        pages[p] = part + own[:10] + (foot if p % 2 else foot[2:]) + own[10:]
    pages[12] = list(pages[11])
    pages[13] = menu[:2]
    covered = covered_by_suffix_array(pages, k)
    rows = [(p, "https://Site.org/a", "<div><p>" + " ".join(t) + "</p></div>") for p, t in pages.items()]
    rows += [(100, "https://other.org/b", "<div>" + " ".join(menu) + "</div>")]  # another host: not repeated there
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.main_text(df, run=k).collect()}
    for p, tokens in pages.items():
        assert got[p] == " ".join(t for i, t in enumerate(tokens) if i not in covered[p]), p
    assert got[100] == " ".join(menu)


def test_article_text_stays_though_pages_share_it(spark):
    html = "<nav>m</nav><article>" + " ".join(f"w{i}" for i in range(60)) + "</article>"
    got = run(spark, [(i, "http://a.org/x", html) for i in range(3)])
    assert set(got.values()) == {" ".join(f"w{i}" for i in range(60))}


def test_no_rows_null_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame(
        [(1, None, "<div>a b</div>"), (1, None, "<div>a b</div>"), (None, "x", "<article>q</article>"), (None, "x", None)],
        "page_id long, url string, html string",
    )
    rows = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in h.main_text(df).collect())
    assert rows == [(0, "", 0), (0, "q", 1), (1, "a b", 3), (1, "a b", 3)]


LOSSES = [
    ('<article><p>a</p><svg class="x"/><p>b</p></article>', "a b"),
    ("<article><p>a</p><object><p>b</p><math><mi>x</mi></math><p>c</p></article>", "a b c"),
    ("<article><p data-x=it's>one</p><p>two</p></article>", "one two"),
    ("<article><p title='a>b' data-y=\"c>'d\" e=f=\"g>one</p><p>two</p></article>", "one two"),
    ("<article><h2 class='search'>a</h2><p class='notice'>b</p><p class='share promo'>c <span class='comment'>d</span></p><p class='ad'>e</p></article>", "a b c d"),
    ("<article><p>teaser</p></article><div><p>the text of the page is longer than that</p></div>", "teaser the text of the page is longer than that"),
    ("<article><p>the text of the page</p></article><div><p>other</p></div>", "the text of the page"),
    ("<article><script>x</scripts> y</script><p data-id='ad'>kept</p></article>", "kept"),
]


@pytest.mark.parametrize(("html", "want"), LOSSES)
def test_no_text_is_lost_to_single_marks(html, want):
    main, tokens = h._read(html)
    assert (main or " ".join(tokens)) == want


def test_main_loses_a_repeated_plain_footer_and_keeps_its_article(spark):
    foot = "<div><span>about us and all our other pages in this footer</span></div>"
    shared = " ".join(f"shared{i}" for i in range(20))
    rows = []
    for i in range(5):
        own = " ".join(f"w{i}_{j}" for j in range(30))
        rows.append((i, "http://a.org/x", f"<main><h1>Page {i}</h1><p>{own}</p>{foot}</main>"))
    # An article element keeps a passage of other pages; of main, text on two pages only stays.
    rows += [(10 + i, "http://b.org/x", f"<main><article>own{i} {shared}</article>{foot}</main>") for i in range(4)]
    rows += [(20 + i, "http://c.org/x", f"<main><p>{shared}</p><p>one{i}</p></main>") for i in range(2)]
    # Copies of one page are one page.
    rows += [(30 + i, "http://d.org/x", f"<main><p>{shared}</p></main>") for i in range(9)]
    got = run(spark, rows)
    for i in range(5):
        assert got[i] == f"Page {i} " + " ".join(f"w{i}_{j}" for j in range(30))
    assert [got[10 + i] for i in range(4)] == [f"own{i} {shared}" for i in range(4)]
    assert [got[20 + i] for i in range(2)] == [f"{shared} one{i}" for i in range(2)]
    assert {got[30 + i] for i in range(9)} == {shared}


def test_deep_and_unclosed_markup_takes_linear_time():
    n = 100_000
    started = time.monotonic()
    assert h.blocks("<div>" * n + "x" + "</i></div>" * n) == [(h.OPEN, "x")]
    assert h.blocks("<svg>" * n + "x") == [(h.OPEN, "x")]
    assert len(h.blocks("<p><b>x" * n)) == n
    assert h.blocks("<a " + "b='" * n) == [] and h.blocks("<a " + "b=" * n + ">x") == [(h.OPEN, "x")]
    assert time.monotonic() - started < 30
