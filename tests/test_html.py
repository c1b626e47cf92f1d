import pytest

from noticelake.functions import html as H

LISTING = """<!DOCTYPE html><html><head><title>A &amp; B </title><script>var a = "<div class='list-item'>";</script></head><body>
<div class="list-item"><a href="/outside.html">x</a></div>
<div id="main_content"><div class="list-item"><p>one<br><a href="/m/101.html">First</a><a href="/m/999.html">second link</a></div>
<div class="wide list-item"><a href="/m/102.html">Б</a></div><div class="list-item"><a name="none">no href</a></div>
<div class="list-item">no link</div><div class="list-item"><a href="/m/101.html">again</a></div><div class="list-item"><a href="about">no id</a></div></div></body></html>"""
DETAIL = """<div id="main_content"><h1> Title<b> bold </b></h1><span class="list-item-date"> 03.01.2026 г. </span>
<div class="view"><p> first <b>bold</b><br>line<style>p{}</style><p>second</p></div></div>"""
ACCORDION = """<div id="infoAccordion"><div class="accordion-group" data-id="7"><a class="accordion-toggle x"> Line <i>5</i> </a>
<div class="accordion-inner"><p>One<p>Two <b>three</b></div><div class="info-time"> 10:00 </div></div><div class="accordion-group"></div></div>"""
LEGACY = '<div class="list-item-date">\n 04.01.2026</div><div class="view wide"><p>wrong</p></div><div class="view"><p>text <b>tag</b> more</p></div>'


def test_links():
    assert H.links_of(H.parse(LISTING)) == ["/m/101.html", "/m/102.html", None, "/m/101.html", "about"]
    assert H.links_of(H.parse("<p>x")) == []
    with pytest.raises(H.MissingContainer):
        H.links_of(H.parse("<p>x"), strict=True)


def test_detail():
    assert H.detail_of(H.parse(DETAIL)) == {"title": "Titlebold", "date": "03.01.2026 г.", "content": "firstboldline"}
    assert H.detail_of(H.parse(DETAIL.replace("list-item-date", "x")))["date"] is None
    assert H.detail_of(H.parse(DETAIL.replace('class="view"', ""))) is None
    assert H.detail_of(H.parse("")) is None


def test_notices_and_defaults():
    assert H.notices_of(H.parse(ACCORDION)) == [
        {"data_id": "7", "header": "Line5", "body": "One Two three", "info_time": "10:00"},
        {"data_id": "No ID", "header": "No header", "body": "No body", "info_time": "No time"},
    ]


def test_first_text_node():
    root = H.parse(LEGACY)
    assert H.first_text_of(root, "view", "p") == "text " and H.first_text_of(root, "list-item-date") == "\n 04.01.2026"
    assert H.first_text_of(root, "none") is None


def test_deep_pages_do_not_recurse():
    assert H.parse("<i>" * 20_000 + "x").text() == "x"


@pytest.mark.parametrize(
    ("page", "want"),
    [("<p>a<p>b", ["p", "p"]), ("<ul><li>a<li>b</ul><p>c", ["ul", "li", "li", "p"]), ("<p>a<div>b</div>", ["p", "div"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["table", "tr", "td", "td", "tr", "td"])],
)
def test_implied_ends(page, want):
    root = H.parse(page)
    assert [n.tag for n in root.walk()] == want and (root.children[0].tag != "p" or root.children[0].text() == "a")


def test_over_a_table(spark):
    rows = [(1, LISTING), (2, DETAIL), (3, ACCORDION), (4, None), (5, "")]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, html string").select("i", H.listing_links("html").alias("l"), H.water_detail("html").alias("d"), H.transit_notices("html").alias("n"), H.element_text("html", "title").alias("t"), H.element_text("html", "title", strip=False).alias("raw"), H.first_text_node("html", "view", "p").alias("f")).collect()}
    assert got[1].l[0] == "/m/101.html" and got[1].t == "A & B" and got[1].raw == "A & B " and got[1].d is None
    assert got[2].d.content == "firstboldline" and got[2].f == " first " and got[2].l == []
    assert [n.data_id for n in got[3].n] == ["7", "No ID"] and got[4].l is None and got[4].d is None and got[5].n == []


def test_queries_read_character_references_as_their_sql_does(spark, tmp_path):
    """A title that is cut within a reference, other references, and white space around a heading."""
    import duckdb

    import __spark_entry__

    texts = ["a &amp;&amp;&amp", "token = &quot;7", "&amp;amp; &lt;b&gt; &nbsp;", "  \u00a0inner\u00a0 ", "\tx\n", "", "plain"]
    pages = [(i, f'<html><head><title>{t}</title></head><body><div class="ad">{t}</div><h1>{t}</h1><a href="/x?{t.strip()}">y</a></body></html>') for i, t in enumerate(texts)]
    spark.createDataFrame([*pages, (98, "<p>nothing</p>"), (99, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_title", "html_heading", "html_first_text", "html_links"):
        got = sorted(map(repr, map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, db.execute(__spark_entry__.oracle_sql()[name]).fetchall())), name
