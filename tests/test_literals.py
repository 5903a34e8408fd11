"""Functions that SQL cannot express, and cases that the driver's tables do not hold, against literals."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from tallyrun.functions import html, privacy, urls
from tallyrun.operators import matching, ordered


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_greedy_quota_with_two_unique_columns(spark):
    rows = [("l", "z", "x", 100), ("l", "a", "x", 95), ("l", "a", "y", 90), ("l", "b", "w", 80), ("l", None, None, 70), ("m", "a", "q", 99), ("m", "c", "q", 98), ("m", "d", "q", 97)]
    df = spark.createDataFrame(rows, "lane string, company string, provider string, score int")
    found = ordered.greedy_quota(df, [("l", 4), ("m", 2)], "lane", [F.desc("score")], ["company", "provider"])
    assert [(r["score"], r["position"], r["quota"]) for r in found.collect()] == [(100, 1, 0), (90, 2, 0), (80, 3, 0), (70, 4, 0), (98, 1, 1)]


def test_greedy_quota_draws_its_head_anew(spark):
    rows = [("l", f"c{k // 30}", f"p{k}", 1000 - k) for k in range(120)]
    df = spark.createDataFrame(rows, "lane string, company string, provider string, score int")
    assert [r["score"] for r in ordered.greedy_quota(df, [("l", 3)], "lane", [F.desc("score")], ["company", "provider"]).collect()] == [1000, 970, 940]


def test_numbered_is_total(spark):
    found = ordered.numbered(spark.range(500).withColumn("k", F.col("id") % 7), [F.col("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 501)) and [(r["k"], r["id"]) for r in found] == sorted((r["k"], r["id"]) for r in found)


def test_international_hosts(spark):
    rows = [("http://b\u00fccher.example:80/a/",), ("https://Plain.example/x?utm_source=1",), (None,), ("https://\u00fc" + "\u00fc" * 80 + ".example/",)]
    df = spark.createDataFrame(rows, "url string")
    assert [r[0] for r in df.select(urls.canonical_international_url(F.col("url"))).collect()] == ["http://xn--bcher-kva.example/a", "https://plain.example/x", None, None]


def coded(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def test_redaction(spark):
    signature = "s" * 20
    session, plain = (".".join([coded({"alg": "HS256", "typ": "JWT"}), coded(claims), signature]) for claims in ({"sub": "1", "exp": 99}, {"sub": "12345", "name": "someone"}))
    cases = {
        f"x {session} y": "x [redacted] y", f"x {plain} y": f"x {plain} y", "nothing here": "nothing here", None: None,
        '{"access_token": "abc", "n": 1}': '{"access_token": "[redacted]", "n": 1}', "a?token=abc&page=2": "a?token=[redacted]&page=2",
        '{"city": "Salem", "state": "OR"}': '{"city": "Salem", "state": "OR"}', '{"state": "abc"}': '{"state": "[redacted]"}', "key AKIA" + "A" * 16 + " end": "key [redacted] end",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", privacy.redact_body(F.col("t")).alias("v")).collect()} == cases
    assert one(spark, privacy.is_session_token(F.lit(session))) and not one(spark, privacy.is_session_token(F.lit(plain)))


def test_mentions_of_any_length(spark):
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (2, "xthe quicky"), (3, None), (4, "fox"), (5, "over the lazy dogs and the quick brown fox jumps over")]
    passages = [(10, "fox"), (11, "he quick"), (12, "quick brown fox"), (13, "he quick brown fox jumps over t"), (14, ""), (15, None), (16, "lazy dog"), (17, "absent words in here now")]
    got = matching.mentions(spark.createDataFrame(texts, "t long, a string"), "t", "a", spark.createDataFrame(passages, "p long, b string"), "p", "b").collect()
    assert sorted((r["t"], r["p"]) for r in got) == sorted((t, p) for t, a in texts for p, b in passages if a and b and b in a)
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "x a b c d e"), (None, "q")], "t long, a string")
    found = matching.mentions(twice, "t", "a", spark.createDataFrame([(5, "a b c"), (5, "b c d"), (None, "b c d e"), (6, "q")], "p long, b string"), "p", "b").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 5), (1, None), (None, 5), (None, None), (None, 6)], key=repr)
    none = matching.mentions(spark.createDataFrame(texts, "t long, a string"), "t", "a", spark.createDataFrame([], "p long, b string"), "p", "b")
    assert none.collect() == []


def test_links_in_any_quotes(spark):
    page = """<a href="/a">x</a><A HREF='/b?x=1'>y</A><a class=c href=/c>z</a><a href = "/a">again</a><a data-href-x="n">"""
    assert one(spark, html.hrefs(F.lit(page))) == ["/a", "/b?x=1", "/c"] and one(spark, html.hrefs(F.lit(None).cast("string"))) == []
