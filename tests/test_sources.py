"""Files, sinks and structured extraction against literal fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyrun.functions import structured as X
from tallyrun.sources import files, sinks


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{path}"


def test_postings(spark, tmp_path):
    rows = [{"company_name": "Acme", "linkedin_job_url": "https://l/1", "linkedin_job_title": "Nurse", "unknown": 1}, {"company_website_url": "https://www.big-co.com/x", "career_page_url": "https://big-co.com/jobs"}]
    paths = [put(tmp_path, "a.json", json.dumps(rows)), put(tmp_path, "b.json", json.dumps({"postings": rows[:1]})), put(tmp_path, "c.json", "[]")]
    found = files.sound_inputs(files.read_postings(spark, paths)).select("company_name", "job_title", "career_root_url").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("Acme", "Nurse", None)] * 2 + [("Big Co", None, "https://big-co.com/jobs")], key=repr)
    bad = files.read_postings(spark, put(tmp_path, "d.json", json.dumps([{"company_name": "X"}])))
    assert files.as_inputs(bad).first()["problem"] == "no_locator"
    with pytest.raises(files.BadInput):
        files.sound_inputs(bad)


def test_json_lines(spark, tmp_path):
    read = lambda text: [r["a"] for r in files.read_json_lines(spark, put(tmp_path, f"{abs(hash(text))}.jsonl", text), "a int").collect()]
    assert read('{"a": 1}\n{"a": 2}\n') == [1, 2] and read('{"a": 1}\n{"a": 2') == [1] and read('{"a": 1}') == [1]
    for text in ('{"a": 1}\n{"a": 2\n', '{"a": 1\n{"a": 2}\n', '{"a": 1}\n\n{"a": 2}\n'):
        with pytest.raises(files.BadInput):
            read(text)


def test_registry(spark, tmp_path):
    head = ",".join(files.REGISTRY_COLUMNS)
    read = lambda text: files.read_registry(spark, put(tmp_path, f"{abs(hash(text))}.csv", text)).orderBy("domain_name").collect()
    rows = read(head + '\nB.gov,City,"Town, of B",,B,CA,me@b.gov\na.gov,City,A,,,,\n')
    assert [r["domain_name"] for r in rows] == ["a.gov", "b.gov"] and rows[1]["organization_name"] == "Town, of B" and "security_contact_email" not in rows[0].asDict()
    for fault, text in (("schema_mismatch", "Domain name,x\na.gov,1\n"), ("domain_collision", head + "\na.gov,C,A,,,,\nA.GOV,C,A,,,,\n"), ("invalid_domain", head + "\na b,C,A,,,,\n"), ("malformed_row", head + "\na.gov,,A,,,,\n"), ("empty_dataset", head + "\n")):
        with pytest.raises(files.BadInput, match=fault):
            read(text)


def test_regex_records(spark):
    df = spark.createDataFrame([("intro\n## 1. Acme\n- url: https://a\n## 2. Big\nno url",)], "t string")
    assert [tuple(r) for r in files.regex_records(df, "t", r"\n## \d+\. ", {"name": r"^([^\n]+)", "url": r"url: (\S+)"}).collect()] == [("Acme", "https://a"), ("Big", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, '=a"b'), (2, "x,y"), (3, None), (4, " -1")], "k int, v string")
    assert [r[0] for r in sinks.csv_lines(df.orderBy("k"), ["k", "v"]).collect()] == ['1,"\'=a""b"', '2,"x,y"', "3,", "4,' -1"]
    path = f"file://{tmp_path}/out"
    sinks.write_csv(df.coalesce(1), ["k", "v"], path)
    joined = lambda: b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert joined().startswith(b"\xef\xbb\xbfk,v\r\n1,") and joined().endswith(b"\r\n") and joined().count(b"\r\n") == 5
    sinks.write_csv(df.repartition(3), ["k", "v"], path)
    assert joined().count(b"\xef\xbb\xbf") == 1 and joined().startswith(b"\xef\xbb\xbfk,v\r\n") and len(joined().splitlines()) == 5
    sinks.write_csv(df.limit(0), ["k", "v"], path)
    assert joined() == b"\xef\xbb\xbfk,v\r\n"
    report = sinks.markdown_report("Run", {"Counts": df.groupBy("v").agg(F.count("*").alias("n"))}, 2)
    assert report.startswith("# Run\n") and "| v | n |" in report and "Only the first 2" in report
    assert sinks.publish(df, path + "2", "require-identical") and not sinks.publish(df, path + "2", "require-identical")
    with pytest.raises(ValueError):
        sinks.publish(df.limit(1), path + "2", "require-identical")


def test_structured_data(spark):
    posting = {"@type": ["JobPosting"], "title": " Nurse ", "url": "https://a.com/1?utm_source=x", "jobLocation": [{"address": {"addressLocality": "Salem", "addressRegion": "OR"}}, {"name": "Remote"}], "hiringOrganization": {"name": "Acme"}}
    graph = {"@graph": [{"@type": "Organization", "name": "Acme", "legalName": "Acme Inc"}, {"@type": "JobPosting", "name": "Cook", "jobLocation": "Paris"}]}
    html = (
        f'<link rel="x canonical" href=\'/c\'><link rel=alternate hreflang="en-US" href="/us"><link rel=alternate hreflang=de href=/de><meta http-equiv="Refresh" content="0; url=/next">'
        f'<script type="application/ld+json">{json.dumps([posting])}</script><script type="application/ld+json">broken{{</script><script type=\'application/ld+json\' id=2>{json.dumps(graph)}</script>'
        f"""<div data-props='{{"u": "https:\\/\\/a.com\\/x"}}' data-b="[&quot;http://b.com/y&quot;]">"""
    )
    df = spark.createDataFrame([("https://a.com/page", html), ("https://b.com/", None)], "url string, html string").select(
        X.job_postings(F.col("html"), F.col("url")).alias("jobs"), X.organization_names(F.col("html")).alias("names"), X.canonical_link(F.col("html")).alias("canonical"),
        X.alternate_links(F.col("html")).alias("us"), X.redirect_target(F.col("html")).alias("to"), X.data_urls(F.col("html")).alias("data"),
    )
    a, b = df.collect()
    assert [tuple(j) for j in a["jobs"]] == [("https://a.com/1", "Nurse", "Salem, OR; Remote", "Acme"), ("https://a.com/page", "Cook", "Paris", None)]
    assert a["names"] == ["Acme", "Acme Inc"] and a["canonical"] == "/c" and a["us"] == ["/us"] and a["to"] == "/next" and a["data"] == ["https://a.com/x", "http://b.com/y"]
    assert b["jobs"] == [] and b["names"] == [] and b["canonical"] is None and b["to"] is None


def test_search_results(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link> https://a </link><description><![CDATA[x]]></description></item><item><title>no link</title></item></channel></rss>"
    hits = json.dumps({"results": [{"url": "https://a", "title": "A", "content": "x"}, {"url": " "}, {"url": "https://b"}]})
    df = spark.createDataFrame([(rss, hits)], "rss string, hits string").select(X.feed_items(F.col("rss")).alias("f"), X.search_hits(F.col("hits")).alias("h")).first()
    assert [tuple(x) for x in df["f"]] == [("https://a", "A & B", "x")] and [tuple(x) for x in df["h"]] == [("https://a", "A", "x"), ("https://b", "", "")]


def test_torn_lines(spark, tmp_path):
    """A tail that could still be completed is left out, whatever its last character; other broken tails raise."""
    for k, (tail, good) in enumerate([('{"a":2,"b":{"c":2}', True), ('{"a":', True), ('{"a":2,"t":"x', True), ('{"a":2,"t":"x\\"}', True), ('{"a":2}}', False), ('{"a":2} x', False), ('{"a":2} {"a":3}', False), ('{"a" 2}', False), ("nonsense", False)]):
        path = put(tmp_path, f"torn{k}.jsonl", '{"a":1,"t":"}"}\n' + tail)
        read = lambda p=path: [r["a"] for r in files.read_json_lines(spark, p, "a int, t string").collect()]
        if good:
            assert read() == [1]
        else:
            with pytest.raises(files.BadInput):
                read()


def test_alias_sets(spark):
    from tallyrun.operators import matching

    rows = spark.createDataFrame([(1, ["a", None, "b"], "b", "x", "x"), (2, ["a"], "b", None, "x"), (3, None, "b", "x", None), (4, [], "b", "x", "y")], "k int, es array<string>, v string, e string, w string")
    got = matching.alias_failures(rows, {"board": ("es", "v"), "site": ("e", "w")}).orderBy("k").collect()
    assert [list(r["failures"]) for r in got] == [[], ["board"], ["site"], ["board", "site"]]
