"""Selectors, listings and main content against hand-made pages."""

import datetime as dt
import html
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docketry.functions import tree
from docketry.functions.tree import CssListing
from docketry.sources import listings
from docketry.sources.listings import ItemRules

PAGE = """<html><head><title>T</title></head><body class="home wide" id=top>
<nav><ul><li class="on first"><a href="/a">A</a><li><a href="/b" title="B page">B</a></ul></nav>
<div class="list"><ul>
<li data-x="one-two"><span>01.02.2024</span> <a href="x/1.pdf#p">Regulation on cards</a><p>First <b>summary</b></p></li>
<li data-x="one"><span>5 Mart 2024</span> <a href="/2">incele</a> Communique about fees No: 12</li>
<li><a href="javascript:x()">no</a></li>
<li>none</li>
<li><a href="x/1.pdf">again</a></li>
</ul></div><p>one<p>two<div>three</div><table><tr><td>c1<td>c2<tr><td>c3</table><br/><i/>end</body></html>"""


def found(selector, root=None):
    return [f"{n.tag}:{n.text()[:14]}" for n in tree.select(root or tree.parse(PAGE), tree.compiled(selector))]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("nav li", ["li:A", "li:B"]),
        ("nav > li", []),
        ("body.wide.home > nav a[title]", ["a:B"]),
        ("#top > p", ["p:one", "p:two"]),
        ("p + p, p + div", ["p:two", "div:three"]),
        ("nav ~ table td:first-child", ["td:c1", "td:c3"]),
        (".list li:nth-child(2n) a", ["a:incele"]),
        (".list li:nth-child(odd) > a", ["a:Regulation on ", "a:no", "a:again"]),
        ("li:nth-last-child(2)", ["li:A", "li:none"]),
        ("li:last-child a:not([title]), li:nth-child(-n+1) span", ["span:01.02.2024", "a:again"]),
        ("[data-x|=one]", ["li:01.02.2024 Reg", "li:5 Mart 2024 in"]),
        ("[data-x='one'], a[href$='.pdf']", ["li:5 Mart 2024 in", "a:again"]),
        ("a[href*='1.pdf']", ["a:Regulation on ", "a:again"]),
        ("li[class~=on] , *[class^='ho'] b", ["li:A", "b:summary"]),
        ("div div", []),
        ("i:empty ~ b", []),
    ],
)
def test_selectors(selector, want):
    assert found(selector) == want


def test_what_is_no_selector():
    for bad in ("", "li >", "a[href", "li:hover", "a,,b", "li:nth-child(x)"):
        with pytest.raises(ValueError):
            tree.compiled(bad)


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "x" + "</p></b>" * 10
    assert len(tree.select(tree.parse(deep), tree.compiled("div div > div"))) == 4998
    assert tree.parse(None).text() == "" and tree.parse("a < b & c").text() == "a < b & c"
    assert found("b i", tree.parse("<b><i>x</b>y</i>")) == ["i:x"]


def test_titles_of_links():
    def of(page):
        return tree.link_title(tree.select(tree.parse(page), tree.compiled("a"))[0])

    assert of("<li>Around it all <a>Some link</a></li>") == "Some link"
    assert of("<li>Around it all <a title='By attribute'>İncele</a></li>") == "By attribute"
    assert of("<li>Tebliğ No 7 hakkında <span><a>İNCELE</a></span> Tıklayınız</li>") == "Tebliğ No 7 hakkında"
    assert of("<div>Far up is the text<p><i><a>»</a></i></p></div>") == "Far up is the text"
    assert of("<a>git</a>") == "git"


def test_items_of_a_listing(spark):
    pages = spark.createDataFrame([(1, "http://h.org/d/", PAGE), (2, "http://h.org/e/", None), (3, None, "<div class=list><li><a href='y'>Yes it is</a></div>"), (4, "http://h.org", "<div class=list><li><a href='http://[x'>Broken one</a></div>")], "page_id long, url string, html string")
    rules = ItemRules(date=r"No: (\d+)", fields={"number": r"No: (\d+)", "word": r"[A-Z]\w+"}, strip=(" about.*",), prefix="P ", id_pattern=r"/(\d)(?:\.pdf)?$", id_prefix="q:")
    got = listings.selected_items(pages, CssListing(".list li", date="span", summary="p", around=True), rules)
    rows = {(r["page_id"], r["place"]): tuple(r)[2:] for r in got.collect()}
    assert rows == {
        (1, 0): ("http://h.org/d/x/1.pdf", "q:1", "P Regulation on cards", dt.date(2024, 2, 1), "First summary", None, "Regulation"),
        (1, 1): ("http://h.org/2", "q:2", "P 5 Mart 2024 Communique", dt.date(2024, 3, 5), None, "12", "Mart"),
        (3, 0): ("y", "q:y", "P Yes it is", None, None, None, "Yes"),
    }
    plain = listings.selected_items(pages.where("page_id = 1"), CssListing("nav a", frame=True))
    assert [(r["url"], r["title"], r["external_id"]) for r in plain.orderBy("place").collect()] == [("http://h.org/a", "A", "/a"), ("http://h.org/b", "B", "/b")]
    assert listings.selected_items(pages.limit(0), CssListing("li")).collect() == []


def test_listings_stop_at_a_day(spark):
    d = dt.date
    items = spark.createDataFrame([(1, "a", d(2024, 3, 9)), (1, "b", d(2024, 3, 5)), (2, "c", d(2024, 2, 1)), (3, "e", d(2024, 1, 1)), (11, "f", d(2024, 3, 1)), (21, "g", d(2024, 3, 1))], "page_id long, url string, day date")
    pages = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 3, 3), ("y", 11, 1), ("y", 12, 2), ("y", 13, 3), ("z", 21, 1)], "listing string, page_id long, number int")
    kept, told = listings.listed_until(items, pages, F.lit(d(2024, 2, 15)))
    assert {(r["listing"], r["url"]) for r in kept.collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("y", "f"), ("z", "g")}
    assert {tuple(r) for r in told.collect()} == {("x", False), ("y", False), ("z", True)}


TEXT = "This is a paragraph of some length that says what the page is about, and it has few links. "


@pytest.mark.parametrize(
    ("body", "want", "method"),
    [
        (f"<nav><a href=1>menu</a></nav><div><a href=1>One</a> <a href=2>Two</a></div><article><h1>Head</h1><p>{TEXT}<p>{TEXT}</article><footer>foot</footer>", f"Head\n\n{TEXT.strip()}\n\n{TEXT.strip()}", "tree"),
        (f"<div id=m><ul>{'<li><a href=1>An entry of a long menu</a></li>' * 30}</ul></div><div><p>{TEXT * 3}</p><ul>{'<li><a href=1>Another entry of it</a></li>' * 9}</ul><table><tr><td>A fee of</td><td>{TEXT}</td></tr></table></div>", f"{(TEXT * 3).strip()}\n\nA fee of {TEXT.strip()}", "tree"),
        ("<p>Short.</p><div><a href=1>A link that is longer than the text</a></div>", "Short.\n\nA link that is longer than the text", "body"),
        ("", "", "body"),
        ("<script>var x = 'no text at all, however long it may be, as it is no text'</script>", "", "body"),
    ],
)
def test_main_content(body, want, method):
    assert tree.main_content(f"<html><head><title>t</title></head><body>{body}</body></html>") == (want, method)


def test_content_by_a_selector():
    page = f"<div class=x>Named</div><p>{TEXT * 3}</p>"
    assert tree.main_content(page, ".x") == ("Named", "selector")
    assert tree.main_content(page, ".y")[1] == "tree" and tree.main_content(None) == ("", "body")


def test_the_content_of_every_page_is_its_article(spark):
    from docketry.plans import catalogue

    got = {r["page_id"]: (r["method"], r["n_chars"]) for r in catalogue.main_content(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        words = re.sub(r"<[^>]*>", " ", article)
        method, n = got[r["page_id"]]
        text = tree.main_content(r["html"])[0]
        article = html.unescape(words).split()
        if len(" ".join(article)) >= 50:
            assert text.split() == article and method == "tree" and n == len(text)
        else:  # too little, so all that is outside of menu and footer counts
            assert text.split()[-len(article) :] == article and method == "body"


def test_fields_of_menus(spark):
    from docketry.plans import catalogue

    rows = catalogue.css_fields(spark, DATA).collect()
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        menu = re.findall(r'<li><a href="([^"]*)">', re.search(r"(?s)<nav>(.*?)</nav>", r["html"])[1])[::3]
        mine = sorted(x["external_id"] for x in rows if x["page_id"] == r["page_id"])
        assert mine == sorted({f"menu:{html.unescape(m)[1:]}" for m in menu}), r["page_id"]
    assert all(x["title"].startswith("M: ") and x["day"] is None for x in rows)


def test_the_gazette_and_its_notices(spark):
    day = dt.date(2024, 3, 5)
    item = lambda key, n, text: f"<div class='fihrist-item'>— <a href='/eskiler/2024/03/{key}-{n}.htm'>– {text}</a></div>"
    main = "<div id='html-content'><div class='html-title'>YÜRÜTME</div><div class='html-subtitle'>TEBLİĞLER</div>" + item("20240305", 1, "One") + "<div class='html-title'>YARGI</div>" + item("20240305", 2, "Two") + item("20240304", 9, "of yesterday") + "<div class='html-title'>İLÂN BÖLÜMÜ</div>" + item("20240305", 3, "Çeşitli İlânlar") + item("20240305", 4, "Artırma") + "</div>"
    pages = [(day, 0, "http://g/f", main), (day, 1, "http://g/f", "<div id=html-content>" + item("20240305M1", 1, "Extra") + "</div>"), (day, 2, "http://g/f", main), (day, 3, "http://g/f", "<div id=html-content>" + item("20240305M3", 1, "never") + "</div>"), (dt.date(2024, 3, 6), 0, "http://g/f", None)]
    found = listings.gazette_items(spark.createDataFrame(pages, "day date, supplement int, url string, html string"), indexes=("çeşitli ilan",))
    rows = {(r["external_id"], r["title"], r["category"], r["role"]) for r in found.collect()}
    assert rows == {("20240305-1", "One", "TEBLİĞLER", "item"), ("20240305-2", "Two", "YARGI", "item"), ("20240305-3", "Çeşitli İlânlar", "İLÂN BÖLÜMÜ", "index"), ("20240305M1-1", "Extra", None, "item")}
    notices = "<a href='/ilanlar/eskiilanlar/2024/03/20240305-7.htm'>BANKACILIK Kurumundan:</a><a href='/ilanlar/eskiilanlar/2024/03/20240305-7.htm'>Bankacılık again</a><a href='/ilanlar/eskiilanlar/2024/03/20240305-8.htm'>Belediye</a><a href='/x.htm'>Bankacılık</a>"
    lists = spark.createDataFrame([("http://g/eskiler/2024/03/20240305-3.htm", notices)], "url string, html string")
    got = listings.gazette_notices(found, lists, [r"bankacılık\b", "sermaye"]).collect()
    assert [(r["issue"], r["external_id"], r["title"], r["issuer"], r["day"]) for r in got] == [("20240305", "20240305-7", "BANKACILIK Kurumundan — Çeşitli İlânlar", "BANKACILIK Kurumundan", day)]


def test_a_page_of_very_many_parts_is_handed_on_in_parts(spark):
    day, n = dt.date(2024, 3, 5), tree.OUTLINE_ROWS * 2 + 5
    page = "".join(f"<p><a href='/x/{i}'>Text {i}</a></p>" for i in range(n))
    pages = spark.createDataFrame([(day, "http://g/f", page), (day, "http://g/f", None), (day, None, "<p>last</p>")], "day date, url string, html string").coalesce(1)
    found = tree.outlined(pages, ["day"], (("line", "p"),))
    sizes = sorted(r["n"] for r in found.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]][:1] for b in batches), "n long").collect())
    assert sum(sizes) == n + 1 and found.select("day").distinct().count() == 1
    rows = {(r["place"], r["text"], r["url"], r["title"]) for r in found.collect()}
    assert rows == {(i, f"Text {i}", f"http://g/x/{i}", f"Text {i}") for i in range(n)} | {(0, "last", None, None)}


def test_an_outline_is_told_in_one_walk_and_pages_are_dealt_over_all_tasks(spark, monkeypatch):
    page = "<div id=c>" + "".join(f"<h2 class='h x'>H {n}</h2><div class=i><a href='/{n}'>I {n}</a></div><div class=i>none</div>" for n in range(20)) + "</div>"
    kinds = (("head", ".h"), ("item", ".i"))
    want = tree.outline(page, "https://a.org/", kinds, "#c")
    assert [(x["kind"], x["text"], x["url"], x["title"]) for x in want[:3]] == [("head", "H 0", None, None), ("item", "I 0", "https://a.org/0", "I 0"), ("item", "none", None, None)] and len(want) == 60
    pages = spark.createDataFrame([(k, page.replace("I ", f"I {k} "), "https://a.org/") for k in range(40)], "page_id long, html string, url string").coalesce(1)
    got = tree.outlined(pages, ["page_id"], kinds, "#c")
    assert got.count() == 40 * 60 and got.rdd.getNumPartitions() >= 4

    def never(*_):
        raise AssertionError("a walk of its own for each kind and item")

    monkeypatch.setattr(tree, "select", never)
    assert tree.outline(page, "https://a.org/", kinds, "#c") == want
