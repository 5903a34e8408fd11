"""Pages as tables and values stated in scripts, on literal pages: nested, unclosed, hidden and torn markup, literals of every kind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyrun.functions import html as H
from tallyrun.functions import markup, scripts
from tallyrun.operators import listings as L
from tallyrun.plans import page_queries

URL = "https://www.acme.com/careers"


def pages(spark, *texts):
    return spark.createDataFrame([(k, URL, t) for k, t in enumerate(texts)], "page int, url string, html string")


def test_elements():
    page = markup.Page.of('<ul><li>a<li>b<b>c</ul>d<table><tr><td>e<td>f<tr><td>g</table><p hidden>h<i>i</i></p><script>"</p><a>"</script><br/>j<!-- k --><div style="display: none">l</div><em>m &amp; n')
    texts = [(e.tag, page.text(e)) for e in page.elements]
    assert texts == [("ul", "abc"), ("li", "a"), ("li", "bc"), ("b", "c"), ("table", "efg"), ("tr", "ef"), ("td", "e"), ("td", "f"), ("tr", "g"), ("td", "g"), ("p", ""), ("i", ""), ("script", ""), ("br", ""), ("div", ""), ("em", "m & n")]
    assert page.scripts == [("", '"</p><a>"')]
    for odd in (None, "", "<", "<a", "<a href", "</x></y>", "<script>never closed", "<!-- open", "a < b > c", "<p " + "x=1 " * 5000):
        assert isinstance(markup.Page.of(odd).texts, list)
    assert markup.Page.of("<a HREF=x href=y data-href=z>").elements[0].attributes == {"href": "x", "data-href": "z"}


def test_deep_and_long_pages():
    """As deep as long: every open element is ended once."""
    deep = markup.Page.of("<div>" * 20_000 + "x")
    assert len(deep.elements) == 20_000 and all(e.end == 1 for e in deep.elements)
    for piece in ("<li>a", "<a href=x>a", "<h2>a", "</x>", "<td>a", "<p>a"):
        page = markup.Page.of("<div>" * 5000 + piece * 20_000)
        assert sum(len(page.text(e)) for e in page.elements[5000:]) <= 20_000


def test_link_groups(spark):
    text = (
        "<a href='/one'>One</a><a href='/two'> </a><a data-href='/no' href='/two'>Two</a><nav><a href='/careers'>Careers</a></nav><a href='/list'>View jobs</a><a href='https://jobs.lever.co/acme'>x</a>"
        "<a href='mailto:a@b.c'>m</a><a>none</a><div hidden><a href='/h'>h</a></div><script>x='https:\\u002f\\u002fjobs.ashbyhq.com\\/acme'; y='https://www.acme.com/one';</script>"
    )
    got = L.page_links(pages(spark, text, None, ""), "page", "url", "html").orderBy("rank").collect()
    root = "https://www.acme.com"
    assert [(r["page"], r["url"], r["text"]) for r in got] == [(0, "https://jobs.lever.co/acme", "x"), (0, "https://jobs.ashbyhq.com/acme", ""), (0, root + "/careers", "Careers"), (0, root + "/list", "View jobs"), (0, root + "/one", "One"), (0, root + "/two", "Two")]
    many = "".join(f"<a href='/p{k}'>p</a>" for k in range(300)) + "<a href='https://jobs.lever.co/last'>x</a>"
    capped = L.page_links(pages(spark, many), "page", "url", "html").orderBy("rank").collect()
    assert len(capped) == 200 and capped[0]["url"] == "https://jobs.lever.co/last"
    assert spark.range(1).select(H.hrefs(F.lit("<a data-href='no' href='yes'>"))).first()[0] == ["yes"]


def test_cards(spark):
    card = "<div class='card'><h3>{}</h3><a href='{}'>Apply</a>{}</div>"
    texts = [
        card.format("Data Engineer", "/jobs/data-engineer", "<i class='location'>Salem</i>"), card.format("Data Engineer", "/jobs/nurse", ""), card.format("Data Engineer", "/about", ""), card.format("Jobs", "/jobs/jobs", ""),
        "<div class='card'><article><h3>Nurse</h3><a href='/jobs/nurse/1'>x</a></article></div>", "<article><a href='/careers/line-cook'>Line cook</a>", "<ul class='job-list'><li><h3>A chef</h3><a href='/q?id=chef'>x</a><li><h3>B chef</h3><a href='/q?id=b-chef'>x</a></ul>",
        "<ul class='job_result'><li><h3>A chef</h3><a href='/q?id=chef'>x</a><li><h3>B chef</h3><a href='/q?id=b-chef'>x</a></ul>", "<div class='card-body'><h3>Nurse</h3><a href='/jobs/nurse'>x</a></div>",
        card.format("Nurse", "/jobs/nurse", "<i class=location>Full-time</i><i class=location>Bend</i>"), card.format("Nurse", "/jobs/nurse", "<i class=location>A</i><i class=location>B</i>"),
    ]
    got = {}
    for r in L.card_listings(pages(spark, *texts), "page", "url", "html").collect():
        got.setdefault(r["page"], []).append((r["title"], r["url"].removeprefix("https://www.acme.com"), r["location"]))
    assert got == {
        0: [("Data Engineer", "/jobs/data-engineer", "Salem")], 4: [("Nurse", "/jobs/nurse/1", None)], 5: [("Line cook", "/careers/line-cook", None)],
        7: [("A chef", "/q?id=chef", None), ("B chef", "/q?id=b-chef", None)], 9: [("Nurse", "/jobs/nurse", "Bend")], 10: [("Nurse", "/jobs/nurse", None)],
    }


@pytest.mark.parametrize(
    ("script", "want"),
    [
        ("a = {b: 'c', 'd': [1, -2.5, 0x1f, 1e3,], e: !0, f: void 0, g: undefined};", [("a", {"b": "c", "d": [1, -2.5, 31, 1000.0], "e": True, "f": None, "g": None})]),
        ("x = {s: 'it\\'s \\u00e9 \\x41 \\u{1F600} \\\n', t: `p\nq`}", [("x", {"s": "it's é A \U0001f600 ", "t": "p\nq"})]), ("f({a: 1}); g([2])", [("f", {"a": 1}), ("g", [2])]),
        ("// a = {b: 1}\n/* c = [1] */ d = '[1]'; e = \"{\"", []), ("a = {b: g(), c: {d: 1}}", [("c", {"d": 1})]), ("a = `${b}`; c = [`${d}`, [1]]", [("", [1])]), ("if (a) { b(); } else { c = [] }", []),
        ("fetch('/api')", [("fetch", "/api")]), ("http.get('/api', {a: 1})", [("http.get", "/api"), ("", {"a": 1})]), ("s('/api')", []), ('c = {"url": "/j", f() {}}', [("url", "/j")]), ("a.b.c = [1]", [("a.b.c", [1])]), ("[" * 100 + "1" + "]" * 100, [("", None)]), ("'open", []), ("{a:1", []),
    ],
)
def test_literals(script, want):
    got = list(scripts.literals(script))
    if want == [("", None)]:  # deeper than the bound: the inner lists are read
        assert len(got) == 1 and str(got[0][1]).count("[") <= scripts.MOST_DEPTH + 1
    else:
        assert got == want


def test_streamed_chunks_and_json_scripts():
    page = """<script>self.__next_f.push([1,"0:{\\"jobs\\":[{\\"ti"])</script><script>self.__next_f.push([1,"tle\\":\\"a\\"}]}\\nbad\\n"])</script>
    <script type="application/json">{"b": 1}</script><script type="application/json">{"b": </script><script> [1, 2] </script>"""
    assert [v for _, _, v in scripts.page_values(page)] == [{"b": 1}, [1, 2], {"jobs": [{"title": "a"}]}]
    assert list(scripts.page_values(None)) == []


def test_listings_once(spark):
    text = "<article><h3>Nurse</h3><a href='/jobs/nurse'>x</a></article><script>s = {jobs: [{title: 'nurse', url: '/jobs/nurse/'}, {title: 'Cook', link: '/jobs/cook', location: 'Bend'}, {title: 'No url'}]}</script>"
    got = [tuple(r) for r in L.listings(pages(spark, text, None), "page", "url", "html").orderBy("rank").collect()]
    assert got == [(0, 1, "Nurse", "https://www.acme.com/jobs/nurse", None, "card"), (0, 2, "Cook", "https://www.acme.com/jobs/cook", "Bend", "structured_state")]


def test_evidence_as_written(spark, tmp_path):
    head = "<h1>A &amp; B &middot;\n C&amp &quot;d&quot;</h1>"
    pages(spark, head).select(F.col("page").alias("page_id"), "html").write.parquet(f"{tmp_path}/pages.parquet")
    df = spark.read.parquet(f"{tmp_path}/pages.parquet")
    got = L.page_evidence(df, "page_id", "html").first()
    assert (got["text"], got["source"]) == ('A & B · C& "d"', head[4:-5])
    assert page_queries.ext08_page_evidence(spark, str(tmp_path)).first()["text"] == "A & B · C&amp &quot;d&quot;"
