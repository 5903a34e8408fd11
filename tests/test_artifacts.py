"""Captured sources, digests of files and chains of manifests, and the run archive on literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyrun.operators import artifacts as A
from tallyrun.sources import captured


def test_two_sources_one_plan(spark, tmp_path):
    feed = "<rss><channel><item><title>A &amp; b</title><link> https://a/1 </link></item><item><title>no link</title></item></channel></rss>"
    rows = [("q1", feed), ("q2", feed.replace("/1", "/2")), ("q3", "<rss>"), (None, None)]
    hits = [("q1", '{"results": [{"url": "https://h/1", "title": null}, {"url": " "}, 5]}'), ("q2", "[]"), ("q3", '{"results": 1}')]
    for name, body in (("feeds", rows), ("hits", hits)):
        spark.createDataFrame(body, "query string, body string").repartition(2).write.parquet(f"file://{tmp_path}/{name}")
    both = [captured.read_captured(spark, s, f"file://{tmp_path}/{n}").withColumn("source", F.lit(n)) for s, n in zip(captured.SOURCES, ("feeds", "hits"), strict=True)]
    union = both[0].unionByName(both[1])
    assert sorted(map(tuple, union.drop("snippet").collect())) == [("q1", 0, "https://a/1", "A & b", "feeds"), ("q1", 0, "https://h/1", "", "hits"), ("q2", 0, "https://a/2", "A & b", "feeds")]
    one = union.where("query = 'q2' and length(url) > 3")
    assert [r["url"] for r in one.collect()] == ["https://a/2"] and [r["url"] for r in union.where("query in ('q2', 'q9')").collect()] == ["https://a/2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "length(url" in plan and "(query#" not in plan.split("Filter", 1)[1].split("BatchScan", 1)[0].replace("isnotnull(query#", "")


def test_files(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", ""), ("c.csv", "x"), ("d/e.txt", "deep")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    path = f"file://{tmp_path}"
    got = {r["name"]: (r["size"], r["sha256"]) for r in A.file_digests(spark, path, ".txt", excluded=["b.txt"]).collect()}
    assert got == {n: (len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in (("a.txt", "one\ntwo"), ("e.txt", "deep"))}
    assert A.file_digests(spark, path, before="2001-01-01T00:00:00").count() == 0
    lines = A.tagged_lines(spark, path, A.file_digests(spark, path, ".txt"))
    assert sorted((r["name"], r["value"]) for r in lines.collect()) == [("a.txt", "one"), ("a.txt", "two"), ("e.txt", "deep")]


def test_one_changed_byte_names_the_first_broken_link(spark):
    texts = [f"manifest {k}" for k in range(6)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    entries = spark.createDataFrame([("c", k, f"t{k}", digest(t)) for k, t in enumerate(texts)] + [("alone", 0, "u", "x")], "chain string, at int, target string, digest string")
    claims = A.successor_claims(entries, "chain", ["at"], "target", "digest")

    def report(now):
        contents = spark.createDataFrame([(f"t{k}", digest(t)) for k, t in enumerate(now) if t is not None], "target string, digest string")
        return [tuple(r) for r in A.chain_report(A.link_states(claims, contents)).collect()]

    assert report(texts) == [("c", 5, 0, None, None, None)]
    assert report([*texts[:2], "manifest 2!", texts[3], "Manifest 4", texts[5]]) == [("c", 5, 2, 4, "previous", "mismatch")]
    assert report([texts[0], None, *texts[2:]]) == [("c", 5, 1, 3, "previous", "missing")]


def test_binding_issues(spark):
    rows = spark.createDataFrame([(1, "a", "a", 2), (2, "a", "b", 2), (3, None, "b", 0)], "k int, x string, y string, n int")
    got = A.binding_issues(rows, {"digest_mismatch": F.col("x") == F.col("y"), "empty": F.col("n") > 0}).orderBy("k").collect()
    assert [(r["k"], list(r["issues"])) for r in got] == [(2, ["digest_mismatch"]), (3, ["digest_mismatch", "empty"])]


def test_archive(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    rows = spark.createDataFrame([("r1", "a", 1), ("r1", "b", None), ("r2", "a", 2)], "run string, k string, n int")
    told = A.archive_runs(rows, "run", path, "w1")
    assert sorted((r["run"], r["added"]) for r in told.collect()) == [("r1", True), ("r2", True)]
    again = rows.orderBy(F.desc("k")).unionByName(spark.createDataFrame([("r3", "a", 3)], rows.schema))
    assert sorted((r["run"], r["added"]) for r in A.archive_runs(again, "run", path, "w2").collect()) == [("r1", False), ("r2", False), ("r3", True)]
    same = spark.createDataFrame([("r9", "a", 1), ("r9", "b", None)], rows.schema)  # the content of r1 under another name
    assert [r["added"] for r in A.archive_runs(same, "run", path, "w3").collect()] == [False]
    rows.where("run = 'r2'").join(A.run_digests(rows, "run"), "run").withColumn("writer", F.lit("w0")).write.mode("append").partitionBy("digest", "writer").parquet(path)
    assert sorted(tuple(r) for r in A.archived(spark, path).select("run", "k", "n").collect() if r["n"]) == [("r1", "a", 1), ("r2", "a", 2), ("r3", "a", 3)]
    runs = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, "y", 7), ("c", 3, "x", 4), ("d", 4, None, 1), ("e", 5, None, 3)], "run string, at int, kind string, n int")
    got = A.regressions(runs, "run", "at", ["kind"], ["n"]).collect()
    assert sorted((r["run"], r["baseline"], r["delta_n"]) for r in got) == [("a", None, None), ("b", None, None), ("c", "a", -1), ("d", None, None), ("e", "d", 2)]
