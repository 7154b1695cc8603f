import html
import random

import pytest

from gridstats.llm import pages

SCHEMA = "page_id bigint, url string, html string, n_chars int, host string"


def page(title, paragraphs, nav=4, extra="", tail="", head="article"):
    links = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(nav))
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    return (
        '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>'
        '<script>var t="</p>";</script></head><body>'
        f'<nav><ul>{links}</ul></nav><!-- ad --><div class="ad">Buy this.</div>{extra}'
        f"<{head}><h1>{html.escape(title)}</h1>{body}</{head.split()[0]}>{tail}"
        "<footer>&copy; host</footer></body></html>"
    )


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, 0, "x") for i, u, h in rows], SCHEMA)

    return make


def texts(found):
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_articles_of_many_layouts(frame):
    draw, rows, expected = random.Random(3), [], {}
    for i in range(200):
        blocks = [f"Block {i} {k} & more" for k in range(draw.randint(0, 7))]
        extra = draw.choice(["", '<div class="cookie-notice">We use cookies</div>', '<aside><p>Side</p></aside>'])
        tail = draw.choice(
            ["", '<section id="comments"><p>First!</p><p>Second</p></section>', "<form><label>Mail</label></form>"]
        )
        rows.append((i, f"https://h{i % 3}.example/p/{i}", page(f"Title {i}", blocks, draw.randint(1, 9), extra, tail)))
        expected[i] = "\n\n".join([f"Title {i}", *blocks])
    assert texts(pages.main_text(frame(rows))) == expected


def test_article_without_its_element(frame):
    rows, expected = [], {}
    for i in range(30):
        blocks = [f"Paragraph {k} of page {i} has quite a few words in it." for k in range(3)]
        rows.append((i, "http://plain.example/x", page(f"T{i}", blocks, 6, head='div class="post-body"')))
        expected[i] = "\n\n".join([f"T{i}", *blocks])
    assert texts(pages.main_text(frame(rows))) == expected


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<article><p>a &lt;b&gt;&nbsp; c&#33;\n\td</p></article>", "a <b> c! d"),
        ("<article><p><b>one<br><p>two</b> three</p></article>", "one\n\ntwo three"),
        ("<article><p>x<i>y</i>z</p><ul><li>1<li>2</ul></article>", "xyz\n\n1\n\n2"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><p clas", "cut"),
        ('<article><a title="a>b">link</a> text</article>', "link text"),
        ("<article><p>1 < 2</p><!-- no --><script>x</article></script><p>3</p></article>", "1 < 2\n\n3"),
        ("<article><div hidden>no</div><p class='share-box'>no</p><p>yes</p></article>", "yes"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("just text", "just text"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(frame, markup, text):
    found = pages.main_text(frame([(1, "http://h.example/", markup)])).first()
    assert (found["text"], found["n_chars"]) == (text, len(text))


def test_null_urls_repeats_and_no_rows(frame):
    rows = [(1, None, page("A", ["b"])), (1, None, page("A", ["b"])), (None, "no url", page("C", []))]
    found = pages.main_text(frame(rows))
    assert sorted(r["text"] for r in found.collect()) == ["A\n\nb", "A\n\nb", "C"]
    assert pages.main_text(frame(rows).limit(0)).count() == 0


def test_very_long_page(frame):
    long = [f"word {k} " * 20 for k in range(5000)]
    found = pages.main_text(frame([(1, "http://h.example/", page("T", long))])).first()
    assert found["text"] == "\n\n".join(["T", *(" ".join(p.split()) for p in long)])


def test_mismatches_become_optional_and_repeated_groups():
    one = pages.wrapper_of(pages.Page("<div><h2>a</h2><p>b</p><p>c</p></div>"))
    two = pages.wrapper_of(pages.Page("<div><h2>x</h2><table><tr><td>1</td></tr></table><p>y</p></div>"))
    assert pages.expression(pages.merged(one, two)) == "(div(h2(text) table(tr(td(text)))? p(text)+))"
    pairs = pages.wrapper_of(pages.Page("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"))
    assert pages.expression(pairs) == "(dl(()(dt(text) dd(text))+))"


def test_wrappers_meet_in_a_tree(frame, monkeypatch):
    monkeypatch.setattr(pages, "FAN_IN", 2)
    rows = [(i, "http://hot.example/", page(f"T{i}", ["p"] * (i % 5))) for i in range(400)]
    found = pages.wrappers(frame(rows).repartition(13)).collect()
    assert [r["host"] for r in found] == ["hot.example"]
    assert texts(pages.main_text(frame(rows).repartition(13)))[7] == "T7\n\np\n\np"


@pytest.mark.parametrize("urls", [["http://mixed.example/x"] * 2, [None, "/relative"]])
def test_pages_with_and_without_the_element_on_one_host(frame, urls):
    rows, expected = [], {}
    for i in range(60):
        blocks = [f"Paragraph {k} of page {i} has quite a few words in it." for k in range(3)]
        head = ["article", 'div class="post-body"', 'div class="text"'][i % 3]
        rows.append((i, urls[i % 3 > 0], page(f"T{i}", blocks, 6, head=head)))
        expected[i] = "\n\n".join([f"T{i}", *blocks])
    rows.append((60, urls[0], page("", [], head="article")))
    rows.append((61, urls[1], page("", [], head='div class="post-body"')))
    assert texts(pages.main_text(frame(rows))) == expected | {60: "", 61: ""}


def test_hosts_of_urls(frame):
    rows = [(1, "//A.example/x", ""), (2, "https://a.example?q", ""), (3, "/a//b", ""), (4, None, "")]
    found = frame(rows).select("page_id", pages.host_of("url").alias("host")).collect()
    assert {r["page_id"]: r["host"] for r in found} == {1: "a.example", 2: "a.example", 3: "", 4: ""}


@pytest.mark.parametrize("head", ["article", 'div class="post-body"', 'div class="text"'])
@pytest.mark.parametrize(
    "wrapper",
    [
        'div class="page has-sidebar"',
        'div id="wrapper" class="sticky-nav"',
        'div class="widget-container"',
        'div class="widget"><div class="widget-content"',
    ],
)
def test_layout_elements_named_like_furniture(wrapper, head):
    found = None
    for i in range(20):
        blocks = [f"Paragraph {k} of page {i} has quite a few words in it." for k in range(3)]
        side = '<div class="sidebar"><p>Also read this.</p></div><section id="comments"><p>First!</p></section>'
        inner = page(f"T{i}", blocks, head=head, tail=side)
        text = inner.replace("<body>", f"<body><{wrapper}>").replace("</body>", "</div>" * wrapper.count("div ") + "</body>")
        one = pages.Page(text)
        found = pages.merged(found, pages.wrapper_of(one)) if found else pages.wrapper_of(one)
    main = pages.main_slots(found)
    assert [t for path, t, _ in one.blocks if path in main] == ["T19", *blocks]


def test_layout_elements_inside_and_on_some_pages(frame):
    body = "<p>A paragraph with quite a few words in it.</p>" * 3
    comments = '<section id="comments">' + '<article class="comment"><p>First! And so on.</p></article>' * 20 + "</section>"
    rows = [
        (1, "http://a.example/", f'<article><h1>T</h1><div class="widget-container">{body}</div></article>'),
        (2, "http://b.example/", f"<main><article><h1>T</h1>{body}</article>{comments}</main>"),
        (3, "http://c.example/", f'<div class="has-sidebar"><article><h1>T</h1>{body}</article>{comments}</div>'),
        (4, "http://c.example/", f"<article><h1>T</h1>{body}</article>{comments}"),
        (5, "http://d.example/", f'<div class="has-sidebar" role="main"><h1>T</h1>{body}</div>'),
        (6, "http://e.example/", f'<div class="post"><h1>T</h1>{body}</div>{comments.replace("article", "div")}'),
    ]
    expected = "\n\n".join(["T", *["A paragraph with quite a few words in it."] * 3])
    assert texts(pages.main_text(frame(rows))) == dict.fromkeys(range(1, 7), expected)


@pytest.mark.parametrize("tag", ["div", "article", "nav", "b", "div class=sidebar"])
def test_deep_nesting(frame, tag):
    """5,000 open elements: a text inside keeps its block, and furniture stays out."""
    inner = f"<{tag}>" * 5000 + "deep" + "<p>deeper</p><nav>menu</nav>"
    rows = [(1, "http://a.x/1", f"<article><h1>T</h1><p>ok</p>{inner}"), (2, "http://a.x/2", "<article><h1>T</h1><p>ok</p></article>")]
    found = texts(pages.main_text(frame(rows)))
    assert found[2] == "T\n\nok"
    inside = {"div": "T\n\nok\n\ndeep\n\ndeeper", "article": "T\n\nok\n\ndeep\n\ndeeper", "b": "T\n\nok\n\ndeep\n\ndeeper"}
    if tag in inside:
        assert found[1] == inside[tag]
    else:
        assert found[1].startswith("T\n\nok") and "menu" not in found[1]


def test_many_differently_named_children(frame):
    """30,000 children with names of their own on each of two pages of a host."""
    rows = []
    for i in (1, 2):
        blocks = "".join(f'<div class="{"".join(chr(97 + int(c)) for c in str(k))}{"xy"[i - 1]}z">w{k}</div>' for k in range(30_000))
        rows.append((i, f"http://a.x/{i}", f"<nav>menu</nav><article><h1>T</h1>{blocks}</article>"))
    found = texts(pages.main_text(frame(rows)))
    assert found[1] == "\n\n".join(["T", *[f"w{k}" for k in range(30_000)]]) == found[2]


def test_common_names(monkeypatch):
    draw = random.Random(3)
    for limit in (1_000_000, 10):
        monkeypatch.setattr(pages, "CELLS", limit)
        for _ in range(200):
            one, two = ([draw.choice("abcdefgh"[: draw.randint(1, 8)]) for _ in range(draw.randint(0, 12))] for _ in range(2))
            pairs = pages.common(one, two)
            assert all(one[i] == two[j] for i, j in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
            if limit > 10:
                best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
                for i in range(len(one)):
                    for j in range(len(two)):
                        best[i + 1][j + 1] = max(best[i][j] + (one[i] == two[j]), best[i][j + 1], best[i + 1][j])
                assert len(pairs) == best[-1][-1]
