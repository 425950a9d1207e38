import math
import random
import time

import pytest

from cairnbase.llm import html as H

LONG = "This is the main paragraph of the article, with enough words to be dense."
CASES = [
    ("", ""),
    ("plain text", "plain text"),
    (f"<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Second &amp; third.</article><footer>f</footer></body></html>", f"T {LONG} Second & third."),
    (f"<body><div class='sidebar'>side</div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div></body>", f"{LONG} {LONG}"),
    (f"<body><script>var x='<p>no</p>'</script><style>p{{}}</style><p>{LONG}</p><form>f<input></form></body>", LONG),
    (f"<p>{LONG} a<b>b</b>c<br>d \n\t e&nbsp;f", f"{LONG} abc d e f"),
    (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", f"{LONG} one two x y"),
    (f"<article><div class=ad>buy</div><p>{LONG}</p><aside>no</aside><p hidden>no</p></article><artic", LONG),
    (f"<!-- <p>no</p> --><p title='a > b'>{LONG} 1 < 2</p>", f"{LONG} 1 < 2"),
    ("<nav>only menu</nav>", ""),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_main_text(page, want):
    assert H.main_text(page) == want


LINKS = "".join(f"<li><a href=/{i}>Section no {i}</a></li>" for i in range(8))
MENU, AD = f"<div><ul>{LINKS}</ul></div>", "<div><a href=x>Buy these shoes</a> now</div>"
TEXT = "".join(f"<p>{i} {LONG} {LONG} With <a href=y>a link</a> inside. {LONG}</p>" for i in range(4))
PLAIN = " ".join(f"{i} {LONG} {LONG} With a link inside. {LONG}" for i in range(4))
LINK_TEXT = " ".join(f"Section no {i}" for i in range(8))
UNMARKED = [
    (f"<body>{MENU}<div>{TEXT}</div>{AD}</body>", PLAIN),
    (f"<body>{MENU}<h1>Title</h1>{TEXT}{AD}", f"Title {PLAIN}"),  # no element of the text's own
    (f"<body><div><div><p>Short.</p>{MENU}</div><div><h2><a href=z>Title</a></h2>{TEXT}</div></div>", f"Title {PLAIN}"),
    (f"<body><table><tr><td><ul>{LINKS}</ul><td>{TEXT}</table>", PLAIN),
    (f"<body>{MENU}<x-page>{TEXT}<p><a href=z>Read the report</a></p></x-page>", f"{PLAIN} Read the report"),
    (f"<body><div>{TEXT}</div><table><tr><td>x<td>y<td>z</table><p>By <a href=b>B.</a> Author</p>", PLAIN),  # below the threshold, beside the text
    (f"<body><ul>{LINKS}</ul></body>", LINK_TEXT),  # nothing but links
    (f"<body><article>{TEXT}<ul>{LINKS}</ul></article></body>", f"{PLAIN} {LINK_TEXT}"),
]


@pytest.mark.parametrize(("page", "want"), UNMARKED)
def test_link_lists_without_a_mark(page, want):
    assert H.main_text(page) == want


def test_density_prefers_text_to_links():
    dense = H.composite_density(1000, 10, 5, 1, 2000, 500)
    links = H.composite_density(1000, 950, 60, 50, 2000, 500)
    assert dense > links >= 0 and H.composite_density(0, 0, 0, 0, 0, 0) == 0


BLOCKS, INLINE = ("div", "section", "p", "ul", "blockquote"), ("a", "b", "span")


def random_tree(rng, depth=0):
    """[name, children]: blocks in blocks, words and inline elements anywhere; no paragraph in a paragraph."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45:
            kids.append(" ".join(["word"] * rng.randint(1, 30)))
        elif kind < 0.7 or depth > 3:
            kids.append([rng.choice(INLINE), ["x" * rng.randint(1, 12)]])
        else:
            name = rng.choice(BLOCKS)
            kids.append([name, random_tree(rng, depth + 1) if name != "p" else ["y" * rng.randint(1, 90)]])
    return kids


def markup(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"


def counts(x):
    """Characters, characters in links, tags, links of a tree, counted anew for every node."""
    if isinstance(x, str):
        return len(x.strip()), 0, 0, 0
    c, lc, t, lt = (sum(v) for v in zip(*[(a, b, c + (not isinstance(k, str)), d) for k in x[1] for a, b, c, d in [counts(k)]], strict=True))
    return (c, c, t, lt + 1) if x[0] == "a" else (c, lc, t, lt)


def density(x, whole):
    c, lc, t, lt = counts(x)
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + whole[1] / whole[0] * c + math.e)
    return c / t * max(0.0, math.log((c / max(lc, 1)) * (t / lt)) / (math.log(base) if base > 1 + 1e-9 else 1))


def density_sum(x, whole):
    def is_block(y):
        return y[0] in (*BLOCKS, "body") or any(is_block(k) for k in y[1] if not isinstance(k, str))

    below = sum(density(k, whole) for k in x[1] if not isinstance(k, str) and is_block(k))
    return below or (density(x, whole) if is_block(x) else 0.0)


def test_heart_and_threshold_against_a_search_of_all_nodes():
    rng = random.Random(4)
    for _ in range(150):
        tree = ["body", random_tree(rng)]
        whole, nodes = counts(tree), [([tree], tree)]
        for path, x in nodes:
            nodes += [([k, *path], k) for k in x[1] if not isinstance(k, str)]
        sums = [density_sum(x, whole) for _, x in nodes]
        path, threshold, _ = H.densest(H.parse(markup(tree)))
        assert path[0].total == pytest.approx(max(sums), rel=1e-4) and path[0].chars == counts(nodes[0][1] if not max(sums) else min((x for (_, x), s in zip(nodes, sums, strict=True) if s > max(sums) - 1e-9), key=lambda x: -counts(x)[0]))[0]
        at = [p for (p, _), s in zip(nodes, sums, strict=True) if s > max(sums) - 1e-9]
        assert any(threshold == pytest.approx(min(density(n, whole) for n in p), rel=1e-4) for p in at)


def test_density_finds_the_article_without_its_name(spark):
    """The given pages with other element and class names: the chosen node is the article, but for articles as short as the advert."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    found = long = 0
    for page in pages:
        want = H.main_text(page)
        renamed = page.replace('class="ad"', 'class="zz"').replace("<article>", "<section>").replace("</article>", "</section>")
        path, threshold, _ = H.densest(H.parse(renamed))
        if len(want) > 250:
            long += 1
            found += H.select_node(path, threshold).name == "section" and H.main_text(renamed) == want
    assert found == long > 200


def test_names_that_only_look_like_furniture():
    page = f"<article><section id='related-work'><p>{LONG}</p></section><div class='social-science'><p>{LONG}</p></div><p>Let <math><mi>x</mi></math> be.<p>Press the <button>Save</button> key.</article>"
    assert H.main_text(page) == f"{LONG} {LONG} Let x be. Press the Save key."
    page = f"<article><header>by me<h1>Title</h1><p>today</p></header><p>{LONG}</p><form><button>Go</button></form></article>"
    assert H.main_text(page) == f"Title {LONG}"


def test_split_article_and_plain_advert():
    page = f"<body><h1>Title</h1><div><div>{TEXT}</div><div>{TEXT}</div></div><div>Buy now.</div></body>"
    assert H.main_text(page) == f"Title {PLAIN} {PLAIN}"


@pytest.mark.parametrize("mark", ["class='reader-comments'", "class=post-comments", "id='comment-list'", "class='x ad-slot'", "class=cookie_banner", "class='newsletter-box'"])
def test_compound_names_of_furniture(mark):
    page = f"<article><p>{LONG}</p><div {mark}><p>{LONG}</p></div><p>{LONG}</p></article>"
    assert H.main_text(page) == f"{LONG} {LONG}"
    # a wrapper of the page is no advert, whatever it is called
    assert H.main_text(f"<body><div {mark}><h1>Title</h1><p>{LONG}</p></div></body>") == f"Title {LONG}"


def test_words_in_a_sentence_stay_whatever_their_class():
    page = f"<article><p>{LONG} See <b class='alert'>danger</b> and <span class='social ad-slot'>x</span>.</p></article>"
    assert H.main_text(page) == f"{LONG} See danger and x."


def test_deep_and_misnested_pages_are_linear():
    def seconds(make, n):
        page = make(n)
        began = time.perf_counter()
        H.main_text(page)
        return time.perf_counter() - began

    shapes = [
        lambda n: "<body><article><header></header>" + "<div>x" * n,
        lambda n: "<b>x</i>" * n,
        lambda n: "<nav>" + "<div>x</p>" * n,
        lambda n: "<i><div>" + "<b>x</i>" * n,
        lambda n: "<ul>" + "<li><b>x" * n,
        lambda n: "<div class='comment-x'>x" * n,
    ]
    for make in shapes:
        assert seconds(make, 32_000) < max(1.0, 4 * seconds(make, 16_000))


def test_unclosed_markup_is_linear():
    H.main_text("<a title='" + "x" * 200_000)
    H.main_text("<" * 20_000 + "<p>x")
    assert H.main_text("<div>" * 3000 + LONG) == LONG


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", None), (None, None, ""), (3, "v", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "0 as n_chars")
    got = sorted([(r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract_pages(df).collect()])
    assert got == sorted([(1, LONG, len(LONG)), (1, "", 0), (0, "", 0), (3, ("long text " * 50_000).strip(), 499_999)])
    assert H.extract_pages(df.limit(0)).count() == 0
