import html
import re

import pytest
from pyspark.sql import functions as F

from stayline.llm import extraction

SCHEMA = "page_id long, url string, html string, host string, text string"


def page(i, body):
    return f"""<!doctype html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><div>Site name</div><ul><li><a href="/a">Home</a></li></ul></header>
<div id="cookie-consent">We use cookies. <button>OK</button></div>
<div class="sidebar"><p>Side {i}</p></div>
{body}
<form action="/s"><label>Find</label><input name=q><p>form text</p></form>
<section class="comments"><p>Reader {i} says hello</p></section>
<div class="advert">Buy {i}</div><!-- <p>hidden</p> --><footer>&copy; 2020</footer></body></html>"""


def words(i, n=30):
    return " ".join(f"word{(i * 7 + k * k) % 101}" for k in range(n))


def test_layouts(spark):
    rows, want = [], {}
    for i in range(12):  # no article element: the template's main slot is a plain div
        text = [f"Title {i}", words(i), words(i + 50)]
        body = f'<div class="body"><h1>{text[0]}</h1><p>{text[1]}<br><p><b>{text[2]}</div><div class="tags"><a href=1>x</a> <a href=2>y</a></div>'
        rows.append((i, f"http://plain.example/{i}", page(i, body), "x", "x"))
        want[i] = "\n".join(text)
    for i in range(20, 30):  # an article with its own header, and an advert and readers' comments inside
        body = f'<article><header><h1>Head {i}</h1></header><p>A &amp; B&nbsp;&lt;{i}&gt;\n  {words(i)}</p><div class="ad">Ad</div><ul><li>one<li>two</ul><div class="comment">c</div></article>'
        rows.append((i, f"https://Article.example/{i}", page(i, body), "x", "x"))
        want[i] = f"Head {i}\nA & B <{i}> {words(i)}\none\ntwo"
    for i in range(40, 46):  # the same words on every page of a host: nothing tells them from an article
        rows.append((i, "http://same.example/", page(0, f"<main><p>{words(1)}</p></main>"), "x", "x"))
        want[i] = words(1)
    rows += [(50, None, page(50, "<p>alone</p>"), "x", "x"), (51, "http://one.example", "plain < text, no tags", "x", "x"), (52, "http://two.example", None, "x", "x"), (53, "http://three.example", "", "x", "x")]
    want |= {50: "alone", 51: "plain < text, no tags", 52: "", 53: ""}
    rows += [(54, "http://deep.example", "<div>" * 5000 + "deep" + "</div>" * 5000, "x", "x"), (55, "http://raw.example", "<p>a</p><script>never closed <p>b</p>", "x", "x")]
    want |= {54: "deep", 55: "a"}
    rows += [(56, "http://long.example", "<article>" + "<p>many words in a row</p>" * 20_000 + "</article>", "x", "x"), rows[0], (None, "http://null.example", "<p>no id</p>", "x", "x")]
    want |= {56: "\n".join(["many words in a row"] * 20_000), None: "no id"}
    out = extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)


def test_no_pages(spark):
    assert extraction.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_share_their_occurrence_vector(spark):
    rows = [(i, "http://h.example/", page(i, f"<article><h1>t</h1>{'<p>x y</p>' * (1 + i % 3)}</article>"), "x", "x") for i in range(9)]
    out = {r.path: r for r in extraction.templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    once = [p for p in out if p.endswith(("/article", "/h1", "/footer", "/body"))]
    assert len({out[p]["class"] for p in once}) == 1
    paragraph = next(p for p in out if p.endswith("/article/p"))
    assert out[paragraph]["class"] != out[once[0]]["class"] and out[paragraph].parent == out[once[0]]["class"]
    assert all(r.main.endswith("/article") for r in out.values())
    assert {p.rpartition("/")[2] for p, r in out.items() if r.slot == "main"} == {"article", "h1", "p"}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_table_against_plain_regex(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    out = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article|br)[^>]*>", article)]
        assert out[r.page_id] == "\n".join(x for x in parts if x)


def test_lists_beside_the_article_go_by_class_and_not_by_name(spark):
    rows, want = [], {}
    for i in range(12):
        text = [f"Title {i}", words(i), words(i + 50)]
        talk = "".join(f'<div class="zq"><p>voice {i} {k} agrees</p></div>' for k in range(1 + i % 4))
        rail = f'<div class="qrail"><p>teaser {i % 3} for all</p></div>'
        body = f"<main><h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p>{rail}<div class='talk'>{talk}</div></main>"
        rows.append((i, f"http://beside.example/{i}", f"<html><body>{body}</body></html>", "x", "x"))
        want[i] = "\n".join(text)
    out = extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.page_id: r.text for r in out} == want


def test_classes_decide():
    def slot(classes):
        paths = ["", "/body", "/body/div.a", "/body/div.a/p", "/body/div.b", "/body/div.b/p", "/body/div.b/div.c", "/body/div.b/div.c/p"]
        chars = [0, 0, 0, 50, 0, 30, 0, 40]
        return extraction.article_slot({p: (k, -1, True, float(n), False) for p, k, n in zip(paths, classes, chars, strict=True)}, paths)[0]

    assert slot([0] * 8) == "/body/div.b"
    assert slot([0, 0, 1, 1, 2, 2, 3, 3]) == "/body/div.a"


def test_flattened_classes_lose_the_article():
    """Without classes nothing is page-level but the page itself, even beside an article element."""
    paths = ["", "/body", "/body/article", "/body/article/p", "/body/div.q", "/body/div.q/p"]
    rows = list(zip(paths, [0, 0, 0, 1, 0, 0], [True, True, True, False, True, True], [0, 0, 0, 90.0, 0, 40.0], strict=True))
    told = {p: (c, -1, once, n, False) for p, c, once, n in rows}
    assert extraction.article_slot(told, paths)[0] == "/body/article"
    assert extraction.article_slot({p: (0, *t[1:]) for p, t in told.items()}, paths)[0] == ""


def test_tags_only_break_near_ties():
    def slot(article, box):
        paths = ["", "/body", "/body/article", "/body/article/p", "/body/div.q", "/body/div.q/p"]
        template = {p: (k, -1, True, float(n), False) for p, k, n in zip(paths, [0, 0, 1, 1, 2, 2], [0, 0, 0, article, 0, box], strict=True)}
        return extraction.article_slot(template, paths)[0]

    assert slot(30, 100) == "/body/article"
    assert slot(20, 100) == "/body/div.q"


def test_headings_around_the_text_belong_to_it():
    paths = ["", "/body", "/body/div.w", "/body/div.w/div.x", "/body/div.w/div.x/h2", "/body/div.w/div.x/div.y", "/body/div.w/div.x/div.y/p", "/body/div.w/div.z", "/body/div.w/div.z/p"]
    chars = [0, 0, 0, 0, 5, 0, 100, 0, 30]
    template = {p: (0, -1, True, float(n), False) for p, n in zip(paths, chars, strict=True)}
    assert extraction.article_slot(template, paths)[0] == "/body/div.w/div.x"


def test_copied_articles_are_no_template(spark):
    """Few different articles under many titles, beside a teaser that comes again and words that never change."""
    rows, want = [], {}
    for i in range(24):
        text = [f"Title {i}", words(i % 4), words(i % 4 + 50)]
        body = f'<div class="k7"><h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p></div><div class="q3">teaser {i % 3} of ours</div><div class="q4">Same words on every page</div>'
        rows.append((i, f"http://copies.example/{i}", f"<html><body>{body}</body></html>", "x", "x"))
        want[i] = "\n".join(text)
    out = extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.page_id: r.text for r in out} == want


def test_table_without_telling_names(spark):
    """Article elements renamed to plain containers, class names scrambled: the template alone finds the text."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    renamed = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<article>", '<div class="k7">'), "</article>", "</div>"), 'class="ad"', 'class="q3"')
    out = {r.page_id: r.text for r in extraction.extract(pages.withColumn("html", renamed)).collect()}
    assert out == want


def test_names_inside_the_article_drop_nothing(spark):
    rows, want = [], {}
    for i in range(10):
        text = [f"Head {i}", words(i), f"Related work {i}", words(i + 20), words(i + 40), words(i + 60, 12)]
        body = f'<article><h1>{text[0]}</h1><p id="search">{text[1]}</p><h2 id="related-work">{text[2]}</h2><section id="discussion"><p>{text[3]}</p></section>'
        body += f'<section class="social-policy"><p>{text[4]}</p></section><div class="notice-of-results" data-id="ad">{text[5]}</div></article>'
        rows.append((i, f"http://named.example/{i}", page(i, body), "x", "x"))
        want[i] = "\n".join(text)
    out = extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.page_id: r.text for r in out} == want


def test_layouts_under_half_of_a_host(spark):
    rows, want = [], {}
    for i in range(30):
        kind = ("post", "post", "post", "shop", "note")[i % 5]
        text = [f"Title {i}", words(i), words(i + 50)]
        body = f'<div class="strip"><p>Welcome to our shop</p></div><div class="{kind}"><h3>{text[0]}</h3><p>{text[1]}</p><p>{text[2]}</p></div><div class="tail"><a href="/{i}">see {i}</a></div>'
        rows.append((i, f"http://kinds.example/{i}", f"<html><body>{body}</body></html>", "x", "x"))
        want[i] = "\n".join(text)
    # A page without any article slot: the template's words and link lists are no text there either.
    bare = '<div class="strip"><p>Welcome to our shop</p></div><pre>only here</pre><div class="tail"><a href="/x">see x</a></div>'
    rows.append((99, "http://kinds.example/99", f"<html><body>{bare}</body></html>", "x", "x"))
    want[99] = "only here"
    out = extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.page_id: r.text for r in out} == want
