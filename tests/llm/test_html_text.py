"""Main text: parsing, tree matching, templates, edge cases."""

import html.parser
import random

from understory.llm import html_text as H
from understory.llm.queries import op2_wrapper_text


def page(n, words="Something said about"):
    return (
        f"<html><head><title>t{n}</title></head><body class='with-sidebar'><div class=bar>Our site has a long line of its own</div>"
        f"<nav><ul><li><a href=x>Go {n}</a></ul></nav><div id=main-part><h1>Title {n}</h1>"
        f"<p>{words} {n} &eacute;&nbsp;and\n more <b>b{n}</b>.<p>Second {words} {n}<br>of it{'!' * n}</p>"
        f"<div class='comments'>I say {n}</div><form><input name=q>Find</form></div><div class=legal>All rights are ours</div></body></html>"
    )


def test_parts_that_are_no_article_go():
    html = (
        "<html><head><title>T</title></head><body><header>Site</header><nav>Menu</nav><!-- <p>no</p> --><div class='ad box'>Buy</div>"
        "<article><h1>A &lt;title&gt;</h1><p>One<p><b>Two</b> is\n\n here<br>now<script>var x='<p>no</p>'</script><ul><li>a<li>b</ul>"
        "<aside>no</aside><div id=comments><p>no</p></div><form>no</form></article><footer>&copy; no</footer></body></html>"
    )
    assert H.extract(html) == "A <title>\nOne\nTwo is here now\na\nb"


def test_layouts_that_hold_most_of_the_text_stay():
    text = "The article says what it has to say at some length, as articles do."
    parts = f"<div class=sidebar>Our side text</div><p>{text}</p><form>Find</form>"
    want = text
    for start, end in (("<div class='post has-sidebar'>", "</div>"), ("<div id='content' class='with-sidebar'>", "</div>"), ("<form>", "</form>"), ("<div role=form>", "</div>")):
        assert H.extract(f"<body><nav>{text * 3}</nav>{start}{parts}{end}<footer>Ours</footer></body>") == want
        assert H.extract(f"<main>{start}{parts}{end}</main>") == want
    assert H.extract(f"<div>{parts}</div><nav>{text * 3}</nav>") == want
    assert H.extract(f"<article class=teaser>Short</article><div><p>{text}</p></div>") == f"Short\n{want}"
    assert H.extract(f"<div>Before</div><article><p>{text}</p></article><div>After</div>") == want
    assert H.extract(f"<article><p>{text}</p><div class=comments>{text * 3}</div></article><div class=ad>{text * 3}</div>") == want
    assert H.extract(f"<div class='page sidebar'><p>{text}</p></div>") == want
    assert H.extract(f"<nav>{text}</nav><div role=navigation>{text}</div>") == ""


def test_broken_and_odd_pages():
    assert H.extract(None) == "" and H.extract("") == "" and H.extract("   ") == ""
    assert H.extract("no markup & 3 < 4") == "no markup & 3 < 4"
    assert H.extract("<article><p>cut <b>off") == "cut off"
    assert H.extract("</p></div>x</article>") == "x"
    assert H.extract("<p>a<script>never closed <p>b") == "a"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.extract("<body class='with-sidebar menu'><p>kept</p></body>") == "kept"


def test_very_long_page():
    body = "".join(f"<p>line {i}</p>" for i in range(30_000))
    other = "".join(f"<p>other {i}</p>" for i in range(30_000))
    text = H.extract(f"<article>{body}</article>", None, f"<article>{other}</article>", [0])
    assert text.count("\n") == 29_999


def brute(a, b):
    """Simple tree matching on whole trees, without runs."""
    if a.label != b.label:
        return 0
    best = {(i, -1): 0 for i in range(-1, len(a.children))} | {(-1, j): 0 for j in range(-1, len(b.children))}
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + brute(x, y))
    return 1 + best[len(a.children) - 1, len(b.children) - 1]


def test_matching_is_the_largest_where_no_run_is_split():
    draw = random.Random(1)

    def tree(depth):
        kinds = draw.sample(["a", "b", "c", "d"], draw.randint(0, 4))
        return H.Node("x", "div", [tree(depth - 1) if depth and draw.random() < 0.5 else H.Node(f"{k}", "div") for k in kinds])

    def labelled(node, n=0):
        for i, c in enumerate(node.children):
            c.label = f"k{draw.randint(0, 3)}" if c.children else c.label
            labelled(c)
        return node

    for _ in range(200):
        a, b = labelled(tree(2)), labelled(tree(2))
        assert H.align(a, b)[0] == brute(a, b)


def test_matching_is_the_largest_where_runs_are_split():
    draw, number = random.Random(2), iter(range(10**9))

    def tree():
        return H.content("".join(draw.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li>{}<li>x</ul>", "<div><p>{}</p></div>"]).format(next(number)) for _ in range(draw.randint(0, 9))))

    for _ in range(200):
        a, b = tree(), tree()
        nodes, pairs = H.align(a, b)
        if not any(x.text == y.text for x, y in pairs):
            assert nodes == brute(a, b)
        assert [x.number for x, _ in pairs] == sorted(x.number for x, _ in pairs)


def test_equal_text_in_a_run_meets_wherever_it_stands(monkeypatch):
    def paragraphs(*texts):
        return H.content("".join(f"<p>{t}</p>" for t in texts))

    def equal():
        a = paragraphs("Letter", "a1", "a2", "Middle", "a3", "a4", "a5", "Rights", "a6")
        b = paragraphs("b0", "Letter", "b1", "Middle", "b2", "Rights")
        return [x.text for x, y in H.align(a, b)[1] if x.text == y.text]

    assert equal() == ["Letter", "Middle", "Rights"]
    monkeypatch.setattr(H, "CELLS", 0)
    assert equal() == ["Letter", "Middle", "Rights"]
    deep = ["<div><p>x</p>" * 300 + t + "</div>" * 300 for t in ("one", "two")]
    assert len(H.align(*map(H.content, deep))[1]) >= 200


def test_template_in_runs_and_in_every_layout_of_a_host_goes(spark):
    said = lambda n, k: f"Page {n} says its own things about matter number {k} in many words"
    rows, want = [], {}
    for n in range(24):
        own = [said(n, k) for k in range(n % 5 + 1)]
        wide, closing = n % 2, "All rights on this wide layout are ours" if n % 2 else "All rights are ours"
        extra = "<div class=legal>The wide layout has a legal text</div>" if wide else ""
        body = "".join(f"<p>{t}</p>" for t in (*own, closing))
        rows.append((n, "http://two.example/", f"<body><div class={'wide' if wide else 'slim'}>{extra}{body}</div></body>"))
        want[n] = "\n".join(own)
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_template_slots_of_a_host_go(spark):
    rows = [(n, f"http://Host.example/{n}", page(n, f"Quite long words that only page {n} has " * 3), "x") for n in range(1, 9)]
    rows += [(20, "http://small.example/", page(20), "x"), (21, None, page(21), "x"), (22, "no address", page(22), None)]
    rows += [(None, "http://host.example/n", None, None), (24, "http://host.example/e", "", "x"), (1, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "html", "text"}
    text = {r["page_id"]: r["text"] for r in got}
    first = "Quite long words that only page 3 has " * 3
    assert text[3] == f"Title 3\n{first.strip()} 3 é and more b3.\nSecond {first.strip()} 3 of it!!!"
    assert text[20].startswith("Our site") and text[20].endswith("All rights are ours")
    assert text[21].startswith("Our site") and text[22].startswith("Our site")
    assert text[None] == "" and text[24] == ""
    assert sorted(r["text"] for r in got if r["page_id"] == 1) == [text[1]] * 2


def test_copies_of_an_article_do_not_become_template(spark):
    article = "The same article stands on every page of this host and must stay. " * 5
    rows = [(n, "http://copies.example/", f"<div class=x>Menu-like {n}</div><p>{article}</p>") for n in range(12)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(article.strip() in r["text"] for r in got)


def test_pages_that_are_mostly_template_vote(spark):
    legal = "Everything on this site is ours and may not be used without our written word. " * 20
    article = lambda n: f"Short note number {n} on the weather of the day in town {n * 7}"
    rows = [(n, "http://short.example/", f"<div class=x>{legal}</div><p>{article(n)}</p>") for n in range(8)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {n: article(n) for n in range(8)}


def test_pages_of_one_content_have_one_vote(spark):
    # Of three articles, one stands on twenty pages with the same aside: too few to call that template.
    page = lambda k, n: f"<nav>{n}</nav><div class=x>One side text of the page</div><p>{f'Article {k} with words of its own. ' * 9}</p>"
    rows = [(n, "http://few.example/", page(min(n, 2), n)) for n in range(22)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert all(r["text"].startswith("One side text") for r in got)


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


class Blocks(html.parser.HTMLParser):
    """Text blocks of the article element, by the standard parser's events."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.parts, self.blocks = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attributes):
        if tag == "article":
            self.inside += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("script", "style") or ("class", "ad") in attributes:
            self.skipped += 1
        if tag not in ("b", "i", "em", "a", "br", "span", "strong", "img", "code"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "a", "br", "span", "strong", "img", "code"):
            self.flush()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_the_query_equals_the_standard_parser_on_the_articles(spark, folder):
    """The pages of the tables have one article each, without marked parts, so its blocks are the main text."""
    got = {r["page_id"]: r["text"] for r in op2_wrapper_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        blocks = Blocks()
        blocks.feed(r["html"] or "")
        blocks.flush()
        assert not blocks.skipped or "<article>" in r["html"]
        assert got[r["page_id"]] == "\n".join(blocks.blocks)


def test_an_article_keeps_text_whose_names_only_hold_a_mark():
    parts = "<section id='comments-on-the-law'><p>One</p></section><div class='notice-of-motion'>Two</div><p class='related'>Three</p><div class='share-price'>Four</div>"
    assert H.extract(f"<article><p>Zero</p>{parts}</article>") == "Zero\nOne\nTwo\nThree\nFour"
    assert H.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><text>drawn</text></svg></p><video>None here</video></article>") == "Let x=1 be drawn\nNone here"
    assert H.extract(f"<article><p>{'Long text. ' * 30}</p><div class='comments'>no</div><div class='share'>no</div></article>") == ("Long text. " * 30).strip()


def bare(draw, i, parts):
    """A page of plain containers whose menu, advert and footer differ from page to page."""
    words = lambda n: " ".join(draw.choice("abcdefghij") * draw.randint(2, 7) for _ in range(n))
    menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(draw.randint(3, 8)))
    article = [f"{words(30)} {i} {k}" for k in range(parts)]
    text = "".join(f"<p>{x}</p>" for x in article)
    return f"<html><body><div><ul>{menu}</ul></div><div>{words(8)}</div><div><h2>Part {i}</h2>{text}</div><div>{words(6)}</div></body></html>", "\n".join([f"Part {i}", *article])


def test_parts_that_vary_outside_the_container_of_the_text_go_where_the_host_agrees(spark):
    draw = random.Random(8)
    made = [bare(draw, i, draw.randint(2, 6)) for i in range(24)]
    rows = [(i, f"https://one.example/{i}", page) for i, (page, _) in enumerate(made)]
    # A host without such a container: paragraphs lie in the body.
    loose = [f"<body><p>{'first words ' * 9}{i}</p><p>{'second words ' * 9}{i}</p></body>" for i in range(12)]
    rows += [(100 + i, f"https://two.example/{i}", page) for i, page in enumerate(loose)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(24)] == [text for _, text in made]
    assert all(got[100 + i] == f"{'first words ' * 9}{i}\n{'second words ' * 9}{i}" for i in range(12))


def test_a_heading_outside_the_container_stays():
    text = "".join(f"<p>{'some words ' * 12}{k}</p>" for k in range(3))
    page = f"<body><h1>Title</h1><div>Menu</div><div class=text>{text}</div><div>Foot</div></body>"
    way = H.holder(H.content(page))[0]
    assert way.endswith("div.text")
    got = H.extract(page, way).split("\n")
    assert got[0] == "Title" and len(got) == 4 and H.extract(page, "other").split("\n")[1] == "Menu"
