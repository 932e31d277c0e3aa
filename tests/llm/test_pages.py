import html
import random
import re
import time

import pytest

from assay.llm import wrapper
from assay.llm.html_pages import Page, aligned


def test_query(spark, sf, queries):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries["op7_html_extraction"](spark, sf).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        text = "\n\n".join(b for b in blocks if b)
        assert got.pop(r.page_id) == (r.url, text, len(text))
    assert not got


def extract(spark, sources, host="h.example"):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    found, name = wrapper.extracted(pages)
    return [r[name].text for r in found.orderBy("page_id").collect()]


def test_template_and_slots(spark):
    """Without any telling element the wrapper alone separates template from content."""
    page = "<body><div><p>Site name</p></div><div><p>Title {0}</p><p>Body {0} one</p><p>Read more here</p></div><div><p>All rights</p></div></body>"
    got = extract(spark, [page.format(i) for i in range(5)])
    assert got == [f"Title {i}\n\nBody {i} one" for i in range(5)]


def test_alignment_survives_missing_parts(spark):
    full = "<body><div><p>Site</p></div><div><p>Promo</p></div><section><p>Text {0}</p></section></body>"
    less = "<body><div><p>Site</p></div><section><p>Text {0}</p></section></body>"
    got = extract(spark, [(less if i == 2 else full).format(i) for i in range(5)])
    assert got[2] == "Text 2" and got[0].endswith("Text 0") and "Site" not in got[0]


def test_all_that_varies_is_text(spark):
    """Tags do not choose among varying places: several places count, and cards in articles do not hide the text."""
    plain = "<body><div><p>Site</p></div><div><h1>Title {0}</h1><div><p>One {0}</p><p>Two {0}</p></div></div><section>More {0}</section></body>"
    assert extract(spark, [plain.format(i) for i in range(4)]) == [f"Title {i}\n\nOne {i}\n\nTwo {i}\n\nMore {i}" for i in range(4)]
    cards = "<body><div><p>Site</p></div><article><p>Card {0}</p></article><div><p>Text {0}</p></div><article><p>Other card {0}</p></article></body>"
    assert extract(spark, [cards.format(i) for i in range(4)]) == [f"Card {i}\n\nText {i}\n\nOther card {i}" for i in range(4)]


def test_copies_keep_their_text(spark):
    """Pages with the same body and another title are one page, with and without an article."""
    for tag in ("article", "div"):
        page = f"<body><{tag}><h1>Title {{0}}</h1><p>First paragraph.</p><p>Second paragraph.</p></{tag}></body>"
        assert extract(spark, [page.format(i) for i in range(5)] * 2) == [f"Title {i}\n\nFirst paragraph.\n\nSecond paragraph." for i in range(5)] * 2


def test_shared_paragraph_of_articles_stays(spark):
    page = "<body><div><p>Site</p></div><article><h1>T{0}</h1><p>Shared words</p><p>Own {0}</p></article></body>"
    assert extract(spark, [page.format(i) for i in range(4)]) == [f"T{i}\n\nShared words\n\nOwn {i}" for i in range(4)]
    # elsewhere among its neighbours a text is no template
    moved = ["<div><p>A{0}</p><p>Same</p><p>B{0}</p><p>C{0}</p></div>", "<div><p>A{0}</p><p>B{0}</p><p>Same</p><p>C{0}</p><p>D{0}</p><p>E{0}</p></div>"]
    got = extract(spark, [moved[i % 2].format(i) for i in range(6)])
    assert all("Same" in text for text in got)


@pytest.mark.parametrize("other", [None, "", "<body><table><tr><td>Old layout</td></tr></table></body>"])
def test_odd_page_leaves_template_detection_on(spark, other):
    page = "<body><div><p>Site name</p></div><div><p>Title {0}</p><p>Body {0}</p><p>Read more</p></div><div><p>All rights</p></div></body>"
    got = extract(spark, [page.format(i) for i in range(5)] + [other])
    assert got == [f"Title {i}\n\nBody {i}" for i in range(5)] + ["Old layout" if other else ""]


def test_links_and_class_names_inside_text(spark):
    page = "<body><{0}><h1><a href=x>Title</a></h1><p>Some words of the text itself.</p><p><a href=y>Linked</a></p>{1}</{0}></body>"
    assert extract(spark, [page.format("div", "")]) == ["Title\n\nSome words of the text itself.\n\nLinked"]
    more = "<ul><li><a href=z>Reference</a></li></ul><header class='entry-header'>Head</header><div class='share-price notice'>Price</div><div class='big comments'>no</div>"
    assert extract(spark, [page.format("article", more)]) == ["Title\n\nSome words of the text itself.\n\nLinked\n\nReference\n\nHead\n\nPrice"]
    assert extract(spark, ["<body><ul><li><a href=z>Menu</a></li></ul><div><a href=z>Menu</a></div><div class='page-header'>x</div><p>Long text</p></body>"]) == ["Long text"]


@pytest.mark.parametrize("bad", [
    "<nav><p>x</p></nav>", "<aside>x</aside>", "<form>x</form>", "<div class='comments'><p>x</p></div>", "<div id=sidebar><p>x</p></div>", "<script>x</p></script>",
    "<style>x</style>", "<!-- x -->", "<footer>x</footer>", "<div class=\"cookie-notice\">x</div>", "<header>x</header>", "<div class='ad'>x</div>", "<noscript>x</noscript>", "<ul><li><a href='a>b'>x</a></li></ul>",
])
def test_what_is_never_text(spark, bad):
    assert extract(spark, [f"<body>{bad}<article><h1>T&amp;amp;</h1><p>one <b>two</b>\n three<br>four</p></article></body>"]) == ["T&amp;\n\none two three four"]


def test_odd_pages(spark):
    got = extract(spark, [None, "", "plain text", "<p>a<p>b</p></p>c", "<article><p>x", "<div" * 50, "&lt;p&gt; &#65;&nbsp;&eacute"])
    assert got == ["", "", "plain text", "a\n\nb\n\nc", "x", got[5], "<p> A é"]
    pages = spark.createDataFrame([(1, None, "<p>a</p>", "b"), (1, None, "<p>a</p>", "b")], "page_id long, url string, html string, main string")
    found, name = wrapper.extracted(pages)
    assert name == "main_" and [r[name].text for r in found.collect()] == ["a", "a"] and found.columns == [*pages.columns, name]
    assert wrapper.extracted(pages.where("false"))[0].count() == 0


def test_long_page(spark):
    body = "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(20_000))
    assert extract(spark, [f"<article>{body}</article>"])[0].count("\n\n") == 19_999


def test_tree_matching():
    one = Page("<div><ul><li>a</li></ul><section><p>b</p></section></div>").skeleton()
    two = Page("<div><section><p>b</p></section><table><tr><td>c</td></tr></table></div>").skeleton()
    match = aligned(one, two)
    labels = lambda s: ["", *(line.split("\t")[1] for line in s.split("\n"))]
    assert {(labels(one)[a], labels(two)[b]) for a, b in match.items()} == {("", ""), ("div", "div"), ("section", "section"), ("p", "p")}
    assert aligned(one, one) == {i: i for i in range(6)}


def plain_matching(a, b):
    """Size of the largest matching of two trees (label, children), by definition."""
    if a[0] != b[0]:
        return 0
    rows = [[0] * (len(b[1]) + 1)]
    for x in a[1]:
        row = [0]
        for k, y in enumerate(b[1]):
            row.append(max(rows[-1][k + 1], row[k], rows[-1][k] + plain_matching(x, y)))
        rows.append(row)
    return rows[-1][-1] + 1


def test_alignment_is_a_largest_matching():
    rng = random.Random(2)

    def made(depth):
        return rng.choice("ab"), [made(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []

    def lines(tree):
        out = []

        def walk(node, parent):
            out.append(f"{parent}\t{node[0]}")
            own = len(out)
            for c in node[1]:
                walk(c, own)
        for c in tree[1]:
            walk(c, 0)
        return "\n".join(out)

    for _ in range(400):
        a, b = ("", [made(3) for _ in range(3)]), ("", [made(3) for _ in range(3)])
        one, two = lines(a), lines(b)
        match = aligned(one, two)
        assert len(match) == plain_matching(a, b)
        parent = lambda s: [(-1, "")] + [(int(p), label) for p, label in (line.split("\t") for line in s.split("\n"))]
        pa_, pb = parent(one), parent(two)
        assert all(pa_[i][1] == pb[j][1] and (i == 0 or match[pa_[i][0]] == pb[j][0]) for i, j in match.items())
        order = [j for _, j in sorted(match.items())]
        assert order == sorted(order)


def test_thousands_of_siblings_and_levels(spark):
    """Cards, all alike or all with names of their own, and deep nesting take seconds."""
    start = time.time()
    for card in ("<div><div>a {1}-{0}</div></div>", "<div class='c{0}'>a {1}-{0}</div>"):
        pages = [f"<body><div><p>Site</p></div>{''.join(card.format(i + k, k) for i in range(n))}</body>" for k, n in ((0, 20_000), (3, 20_001), (9, 20_000))]
        assert [t.count("\n\n") for t in extract(spark, pages)] == [19_999, 20_000, 19_999]
    deep = ["<div>" * 3000 + f"x{i}" for i in range(3)]
    assert extract(spark, deep) == ["x0", "x1", "x2"]
    assert time.time() - start < 90


PROBE = "<body><{0}><div class='post-header'><h1>Title {1}</h1></div><div class='cookie-notice'>We use cookies</div><div class='entry'><p>Body {1} of the text</p></div>" \
    "<div class='search-results'><p>Found {1}</p></div><div class='content related-content'><p>More {1}</p></div><div class='no-sidebar'>Wide {1}</div>" \
    "<div class='sidebar'>Side {1}</div><div class='ad-slot'>Buy {1}</div><div class='comment-body'>Reader {1}</div><div class='post-comments'>They {1}</div></{0}></body>"


@pytest.mark.parametrize("tag", ["main", "div", "article"])
@pytest.mark.parametrize("n", [5, 12])
def test_names_that_tell(spark, tag, n):
    """Parts of names for content keep their text; notices, sidebars, adverts and comments go, whatever they stand in."""
    got = extract(spark, [PROBE.format(tag, i) for i in range(n)])
    assert got == [f"Title {i}\n\nBody {i} of the text\n\nFound {i}\n\nMore {i}\n\nWide {i}" for i in range(n)]


def test_main_is_a_container(spark):
    page = "<body><main><div><p>Site name</p></div><header><h1>Title {0}</h1></header><div><p>Body {0}</p></div><div><p>All rights</p></div></main></body>"
    assert extract(spark, [page.format(i) for i in range(5)]) == [f"Title {i}\n\nBody {i}" for i in range(5)]


def test_against_a_plain_wrapper(spark):
    """Pages without telling tags or names: what stands at one place of all pages with the same words goes, the rest stays, whole texts compared."""
    rng = random.Random(8)
    layout = [("div", "site"), ("section", None), ("ul", "links"), ("div", None), ("table", "foot")]
    sources, want, removed = [], [], 0
    for i in range(9):
        parts, kept = [], []
        for tag, fixed in layout:
            if fixed:
                text, removed = f"Fixed {fixed} words", removed + 1
            else:
                text = f"Own {i} {rng.randint(0, 10 ** 6)} {tag}"
                kept.append(text)
            inner = {"ul": f"<li>{text}</li>", "table": f"<tr><td>{text}</td></tr>"}.get(tag, f"<p>{text}</p>")
            parts.append(f"<{tag}>{inner}</{tag}>")
        sources.append(f"<body>{''.join(parts)}</body>")
        want.append("\n\n".join(kept))
    assert extract(spark, sources) == want and removed == 27
