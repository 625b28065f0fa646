"""HTML extraction on pages of all sorts."""

import random

from gaugeworks.llm import html_text

SCHEMA = "page_id long, url string, html string, text string"


def page(title, body, *, notice="We use cookies on this site", extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p {{x}}</style><script>if (a < b) '<p>no</p>'</script></head>"
        f"<body class='has-sidebar'><header><a href='/'>Site</a></header><nav><ul><li><a>Menu</a></li></ul></nav>"
        f"<p>{notice}</p><div class='content'><h1>{title}</h1>{body}</div><div id='sidebar'>Side</div>"
        f"<form><label>Mail</label><input></form><section class='comments'><article>First!</article></section>"
        f"{extra}<footer>&copy; Site</footer></body></html>"
    )


def extract(spark, rows):
    docs = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], SCHEMA)
    return {r.page_id: r for r in html_text.extract(docs).collect()}


def test_templates_leave_the_article(spark):
    rng = random.Random(1)
    bodies = [[f"Block {i} {k} {rng.random()}" for k in range(rng.randint(1, 5))] for i in range(12)]
    rows = [("http://Host.example/p?x=%d" % i, page(f"Title {i}", "".join(f"<p>{b}</p>" for b in own))) for i, own in enumerate(bodies)]
    found = extract(spark, rows)
    for i, own in enumerate(bodies):
        assert found[i].text == "\n".join([f"Title {i}", *own])
        assert found[i].n_chars == len(found[i].text)


def test_templates_are_nested_classes(spark):
    rows = [("http://h/", page(f"T{i}", f"<p>a{i}</p>")) for i in range(6)]
    pages = spark.createDataFrame([(u, h) for u, h in rows], "url string, html string")
    [template] = html_text.templates(pages).collect()
    assert template.host == "h" and template.article == "/html/body.has-sidebar/div.content"
    # head, menu, notice, sidebar, form, comment and foot: marked elements are tokens like others
    assert len(template.constants) == 7 and template.marks
    assert any(n.startswith("/html: ") for n in template.nested)


def test_templates_find_the_article_among_plain_elements(spark):
    rng = random.Random(3)

    def words(n):
        return " ".join(str(rng.random())[2:8] for _ in range(n))

    rows, articles = [], []
    for i in range(30):
        own = [words(5), *(words(rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))]
        menu = "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(4))
        body = f"<h2>{own[0]}</h2>" + "".join(f"<p>{t}</p>" for t in own[1:])
        rows.append((f"http://plain/{i}", f"<body><div><ul>{menu}</ul></div><div>{words(6)}</div><div>{body}</div><div>Site {words(3)}</div></body>"))
        articles.append("\n".join(own))
    found = extract(spark, rows)
    assert [found[i].text for i in range(30)] == articles
    # the same pages without their template keep adverts and footers
    assert all(html_text.main_text(html, None) != text for (_, html), text in zip(rows, articles))


def test_texts_are_constant_wherever_their_element_stands(spark):
    def html(i):
        shift = "<div></div>" * (i % 3)
        return f"<body>{shift}<div><p>Read this first</p></div><div><p>Own text {i}, long enough to be the article</p></div></body>"

    found = extract(spark, [(f"http://shift/{i}", html(i)) for i in range(9)])
    assert [found[i].text for i in range(9)] == [f"Own text {i}, long enough to be the article" for i in range(9)]


def test_marks_around_all_text_say_nothing(spark):
    rows = [(f"http://side/{i}", f"<body><div class='sidebar'><p>Always so</p><div><p>Text {i}</p><p>More {i}</p></div></div></body>") for i in range(6)]
    found = extract(spark, rows)
    assert [found[i].text for i in range(6)] == [f"Text {i}\nMore {i}" for i in range(6)]


def test_a_text_twice_on_some_pages_is_no_constant(spark):
    def html(i):
        twice = "<ul><li>Maybe</li></ul><ul><li>Maybe</li></ul>" if i < 4 else ""
        return f"<body><div><p>Text {i} that goes on for a while</p><p>And more of {i}</p>{twice}</div></body>"

    found = extract(spark, [(f"http://twice/{i}", html(i)) for i in range(10)])
    assert "Maybe" in html_text.main_text(html(1), {"constants": [], "skipped": [], "article": "", "marked": False, "marks": True})
    template = html_text.templates(spark.createDataFrame([(f"http://twice/{i}", html(i)) for i in range(10)], "url string, html string")).first()
    assert template.constants == [] and found[7].text == "Text 7 that goes on for a while\nAnd more of 7"


def test_few_pages_use_their_own_markup(spark):
    found = extract(spark, [(None, page("T", "<p>One</p>", notice="")), ("no host", None), ("http://a/", ""), ("http://b/", "plain &lt;text&gt; only")])
    assert found[0].text == "T\nOne"
    assert [found[i].text for i in (1, 2, 3)] == ["", "", "plain <text> only"] and found[1].n_chars == 0


def test_articles_white_space_and_references(spark):
    html = (
        "<body><p>outside</p><article><header><h1>A &amp; B</h1></header><p>one\n two&nbsp;&#8212; <b>th<i>r</i>ee</b><br>four"
        "<p>unclosed <span class='ad'>buy</span>end<ul><li>x<li>y</ul><aside>no</aside><div hidden>no</div><footer>no</footer></article>"
    )
    assert html_text.main_text(html, None) == "A & B\none two — three four\nunclosed end\nx\ny".replace("unclosed end", "unclosed\nend")


def test_broken_markup_does_not_crash():
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<div class=\"a'", ">", "<", "</", "<!--", "-->", "text ", "<script>", "</script>", "<a href='x'>", "</a>", "&amp;", "&#x;", "<table><tr><td>", "'", '"', "<br/>", "<li>"]
    for _ in range(500):
        html = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        assert isinstance(html_text.main_text(html, None), str)
    assert html_text.main_text("<div>" * 5000 + "deep", None) == "deep"
    assert html_text.main_text("x " * 400_000, None).count("x") == 400_000


def test_constants_survive_empty_pages_and_other_layouts(spark):
    rows = [("http://h/%d" % i, page(f"T{i}", f"<p>a{i}</p><p>b{i}</p>")) for i in range(8)]
    rows += [("http://h/e", None), ("http://h/f", ""), ("http://h/g", "<div>"), ("http://h/x", "<html><body><div><p>Not found</p></div></body></html>")]
    found = extract(spark, rows)
    assert [found[i].text for i in range(8)] == [f"T{i}\na{i}\nb{i}" for i in range(8)]
    assert [found[i].text for i in range(8, 12)] == ["", "", "", "Not found"]


def test_copies_of_a_page_make_no_template(spark):
    rows = [("http://h/%d" % i, page("Same", "<p>Copied text</p>", notice="Cookies")) for i in range(7)]
    rows += [("http://h/o%d" % i, page(f"Own {i}", f"<p>Text {i}</p>", notice="Cookies")) for i in range(3)]
    found = extract(spark, rows)
    assert {found[i].text for i in range(7)} == {"Same\nCopied text"}
    assert found[8].text == "Own 1\nText 1"


def test_article_elements_are_a_clue_only(spark):
    def cards(i):  # the text in a div, short readers' words in articles
        text = "".join(f"<p>Long main text {i} {k} with many more words in it than any card</p>" for k in range(4))
        return f"<html><body><div class='text'>{text}</div><div class='cards'><article><p>Card {i}</p></article></div></body></html>"

    def marked(i):  # links and a repeated slot inside the article
        return (
            f"<html><body><p class='out'>o{i}</p><article><p>Main text {i} and so on and on</p>"
            f"<p class='by'>Shared again</p><div class='more'><a>Go on to {i}</a></div></article></body></html>"
        )

    found = extract(spark, [("http://c/%d" % i, cards(i)) for i in range(6)] + [("http://m/%d" % i, marked(i)) for i in range(6)])
    assert all(found[i].text.count("Long main text") == 4 for i in range(6))
    assert [found[6 + i].text for i in range(6)] == [f"Main text {i} and so on and on" for i in range(6)]
    assert html_text.main_text(cards(1), None).count("Long main text") == 4


def test_repeated_pages_and_no_pages(spark):
    same = ("http://h/", page("T", "<p>One</p>", notice=""))
    found = extract(spark, [same] * 6)
    assert {r.text for r in found.values()} == {"T\nOne"}
    empty = spark.createDataFrame([], SCHEMA)
    assert html_text.extract(empty).count() == 0


def test_hosts():
    assert [html_text.host_of(u) for u in ("https://A.b:80/x", "//c/d", "http://u:p@e/", "f/g", None)] == ["a.b", "c", "e", None, None]
