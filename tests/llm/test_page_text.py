"""Pages whose article is known."""

import random
import time

import pytest

from harbor.llm import page_text
from tests.llm.tables import rows_of

PAGES = "page_id long, url string, html string, text int, path string, host string"
WORDS = "ship sail wind harbour café quay rope anchor mast deck crew storm tide light".split()


def sentence(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def page(rng, host, template):
    """A page of a template and the article that it holds."""
    blocks = [sentence(rng, 6)[:-1]] + [sentence(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 6))]
    article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace('café', 'caf&eacute;')}" for b in blocks[1:])
    wrap = {
        "article": '<article class="post-{n}">{a}</article>',
        "main": '<main><header class="entry-header"><span>by Ann</span></header><div class="story s{n}">{a}</div></main>',
        "odd": '<div class="zq{n} box"><div class="inner">{a}</div></div><div class="zz{n}"><p>{noise}</p></div>',
        "table": "<table><tr><td>{links}</td><td class=body>{a}</td></tr></table>",
    }[template]
    links = "".join(f'<li><a href="/{w}">{w}</a>' for w in rng.choices(WORDS, k=8))
    body = wrap.format(a=article, n=rng.randint(1, 99), noise=sentence(rng, 8), links=f"<ul>{links}</ul>")
    html = (
        f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>if (a < b) document.write('<p>no</p>')</script>"
        f'<style>p{{margin:0}}</style></head><body class="has-sidebar"><header><h2>{host}</h2></header><nav><ul>{links}</ul></nav>'
        f'<div id="cookieNotice"><p>{sentence(rng)}</p></div>{body}<aside><p>{sentence(rng, 30)}</p></aside>'
        f'<section class="comments"><article class="comment"><p>{sentence(rng, 30)}</p></article></section>'
        f"<form><label>{sentence(rng)}</label><input></form><!-- <p>hidden</p> --><div class='ad'>{sentence(rng, 20)}</div>"
        f'<div style="display: none">{sentence(rng)}</div><footer>&copy; {host} {sentence(rng)}</footer></body></html>'
    )
    return html, "\n".join(blocks)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_articles_of_templates(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for n in range(60):
        template = ["article", "main", "odd", "table"][n % 4]
        html, expected[n] = page(rng, f"h{n % 4}.example.com", template)
        rows.append((n, f"https://user@H{n % 4}.example.com:8080/{n}?q=//x", html, 1, "p", "h"))
    found = page_text.extract_pages(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    assert {r.page_id: r.text for r in found} == expected
    assert all(r.n_chars == len(r.text) for r in found)
    assert len({r.path for r in found}) == 4


def test_a_host_outvotes_an_odd_page(spark):
    rng = random.Random(4)
    rows = [(n, "http://a.example/x", page(rng, "a", "article")[0], 1, "", "") for n in range(9)]
    short = "<html><body><article class='post-7'><h1>Short</h1><p>Few words.</p></article><div><p>" + sentence(rng, 60) + "</p></div></body></html>"
    rows.append((9, "http://a.example/y", short, 1, "", ""))
    found = {r.page_id: r.text for r in page_text.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[9] == "Short\nFew words."
    alone = page_text.extract_pages(spark.createDataFrame(rows[9:], PAGES)).first().text
    assert alone != found[9]


def test_awkward_pages(spark):
    rows = [
        (1, None, None, 1, "", ""), (2, "", "", 1, "", ""), (3, "no url", "plain & simple", 1, "", ""),
        (4, "http://h/", "<p>a<p>b <i>c</i>d</div><!-- x <p>y", 1, "", ""), (None, "http://h/", "<p>a", 1, "", ""),
        (5, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000, 1, "", ""),
        (6, "http://h/", "<p>" + "word " * 200_000, 1, "", ""), (6, "http://h/", '<a href="' * 200 + "x", 1, "", ""),
        (7, "http://h/", "<p>x&nbsp;&amp;\t y&#x41;</p><br><p> </p>", 1, "", ""),
    ]
    found = rows_of(page_text.extract_pages(spark.createDataFrame(rows, PAGES)), "page_id", "text")
    got = dict(x for x in found if x[0] in (1, 2, 3, 4, 5, 7, None))
    assert got[1] == got[2] == "" and got[3] == "plain & simple" and got[4] == "a\nb cd" and got[None] == "a"
    assert got[5] == "deep" and got[7] == "x & yA"
    assert any(i == 6 and len(t) == 5 * 200_000 - 1 for i, t in found)
    assert page_text.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_ids_in_an_article_drop_nothing(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 20) for _ in range(5)]
    html = (
        f'<body><div id="cookieNotice"><p>{texts[4]}</p></div><article><h1 id="search">Title</h1><p>{texts[0]}</p><h2 id="related-work">Work</h2>'
        f'<section id="header-files"><p>{texts[1]}</p></section><div id="social-impact"><h3 id="discussion">Talk</h3><p>{texts[2]}</p></div>'
        f'<p id="search-results-2020">{texts[3]}</p><div class="comments" id="c"><p>{texts[4]}</p></div></article></body>'
    )
    found = page_text.extract_pages(spark.createDataFrame([(1, "http://h/", html, 1, "", "")], PAGES)).first().text
    assert found == "\n".join(["Title", texts[0], "Work", texts[1], "Talk", *texts[2:4]])


def test_whole_articles_of_several_parts(spark):
    rng = random.Random(7)
    intro, lead, side, *body = [sentence(rng, 20) for _ in range(6)]
    parts = f'<div class="intro"><p>{intro}</p></div><div class="content">' + "".join(f"<p>{b}</p>" for b in body) + "</div>"
    htmls = [
        f"<body><article>{parts}</article></body>", f'<body><div class="post">{parts}</div></body>',
        f'<body><main><div class="title"><h1>Title</h1></div>{parts}</main><div class="x"><p>{lead}</p></div></body>',
        f'<body><div class="all"><div class="post">{parts}</div></div><div class="x"><p>{lead}</p></div></body>',
        f'<body><article><div class="title"><h1>Title</h1></div><div class="content"><p>{intro}</p><section class="a"><p>{body[0]}</p></section>'
        f'<section class="b"><p>{body[1]}</p><p>{body[2]}</p></section></div><div class="related"><p>{side}</p></div></article></body>',
    ]
    rows = [(10 * n + k, f"http://h{n}/{k}", html, 1, "", "") for n, html in enumerate(htmls) for k in range(3)]
    found = {r.page_id: r.text for r in page_text.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    whole = "\n".join([intro, *body])
    expected = [whole, whole, f"Title\n{whole}", whole, f"Title\n{whole}"]
    assert found == {10 * n + k: text for n, text in enumerate(expected) for k in range(3)}


def own(html):
    return page_text.main_text(page_text.parse(html), None)


LONG = ["A first paragraph of the article, long enough to be running text.", "It's the second one, don't lose it, of the same article's plain text."]


def test_quotes_open_values_after_equals_signs_only():
    for tag in ("<p title=don't>", "<p don't x='y>z'>", "<p title=\"a>b\">", "<p a = 'x' \"b>"):
        assert own(f"<article><p>{LONG[0]}</p>{tag}{LONG[1]}</p></article>").endswith(LONG[1])
    assert own(f"<article><a title=Bob's>x</a><p>{LONG[0]}</p><p>{LONG[1]}</p></article>") == "\n".join(["x", *LONG])


@pytest.mark.parametrize("name", ["discussion", "alert", "search-results", "form-group", "social-history", "related-work", "menu-of-the-day", "comments-on-law"])
def test_names_of_sections_drop_no_text_of_the_article(name):
    for around in ("main", "article"):
        html = f'<body><{around}><p>{LONG[0]}</p><section class="{name}"><p>{LONG[1]}</p><p><a href="/x">more about ships</a></p></section></{around}></body>'
        assert own(html) == "\n".join(LONG)
    assert own(f'<body><article><p>{LONG[0]}</p></article><div class="{name}"><p>{LONG[1]}</p></div></body>') == LONG[0]


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "related", "newsletter-box", "sidebar", "breadcrumbs", "share-buttons sharing"])
def test_names_of_other_boxes_do(name):
    assert own(f'<body><article><p>{LONG[0]}</p><div class="{name}"><p>{LONG[1]}</p></div></article></body>') == LONG[0]
    assert own(f'<body><article><p>{LONG[0]}</p><div role="search"><p>{LONG[1]}</p></div></article></body>') == LONG[0]


def test_large_pages_take_linear_time():
    pages = [
        "<div>" * 1000 + "<p>some words of a paragraph</p>" * 20_000, "<b>" * 8000 + "<p>x y</p>" * 8000, "<div>" * 100_000 + "deep" + "</div>" * 100_000,
        "<p>x<div>" * 20_000, "<a><b>" * 5000 + "text</a>" * 5000, "<ul><li>x" * 20_000, "<table><tr><td>y" * 10_000,
    ]
    for html in pages:
        before = time.process_time()
        page = page_text.parse(html)
        choice = page_text.chosen_container(page)
        page_text.on_path(page, page_text.path_of(page, choice))
        assert page_text.main_text(page, None)
        assert time.process_time() - before < 10


def plain_path(page, n):
    """The path of an element by its definition."""
    element = page.elements[n]
    return (plain_path(page, element.parent) + "/" if element.parent >= 0 else "") + element.label


def test_paths_and_containers_by_definition():
    rng = random.Random(9)
    names = ["", ' class="a/b"', " class='c a/b'", ' class="x1 y"', ' class="menu"']
    for _ in range(60):
        html = "".join(
            rng.choice([f"<{tag}{rng.choice(names)}>", f"</{tag}>", sentence(rng, rng.randint(1, 12))])
            for tag in rng.choices(["div", "p", "section", "article", "a", "main", "b", "li", "ul"], k=40)
        )
        page = page_text.parse(html)
        all_paths = [plain_path(page, n) for n in range(len(page.elements))]
        for n, path in enumerate(all_paths):
            assert page_text.path_of(page, n) == path
            assert page_text.on_path(page, path) == [m for m, other in enumerate(all_paths) if other == path]
