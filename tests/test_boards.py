"""Boards of different shapes through one plan, descent through JSON, and postings at any depth of a page, on literals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyrun.functions import structured as X
from tallyrun.functions import variants as V
from tallyrun.sources import boards

PAGES = "board int, provider string, page int, board_url string, body string"


def nested(value, depth, key="x"):
    for _ in range(depth):
        value = {key: value}
    return value


def test_job_records(spark):
    posting = {"@type": ["Thing", "JobPosting"], "title": "a"}
    cases = {
        "type": ({"y": {"@type": "jobposting", "title": "a"}}, ["a"]), "types": ({"y": posting}, []), "field": ([{"jobTitle": "a"}, {"other": 1}], ["a"]),
        "container": ({"Jobs": [{"name": "a", "n": {"name": "b"}}, "text", 5]}, ["a", "b"]), "below": ({"q": {"results": {"deep": [[{"title": "c"}]]}}}, [None, "c"]),
        "depth24": (nested({"jobTitle": "a"}, 24), ["a"]), "depth25": (nested({"jobTitle": "a"}, 25), []), "none": ({"title": "a"}, []), "scalar": (7, []), "number": ({"jobs": [{"title": 12}, {"title": " "}]}, ["12", None]),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("bad", '{"jobs":'), ("null", None)], "k string, j string")
    got = df.select("k", F.transform(V.job_records(F.try_parse_json("j")), lambda r: V.first_text(r, ("title", "name", "jobTitle"))).alias("t")).collect()
    assert {r["k"]: list(r["t"]) for r in got} == {k: want for k, (_, want) in cases.items()} | {"bad": [], "null": []}
    types = df.where("k = 'types'").select(F.size(F.filter(V.objects(F.try_parse_json("j")), lambda n: V.has_type(n["value"], "JobPosting"))).alias("n")).first()
    assert types["n"] == 1


def test_postings_at_any_depth_of_a_page(spark):
    job = {"@type": "JobPosting", "title": "Nurse", "url": "https://a.com/1"}
    for depth, found in ((0, True), (1, True), (5, True), (24, True), (25, False)):
        page = f"<script type='application/ld+json'>{json.dumps(nested(job, depth, 'item'))}</script>"
        rows = spark.range(1).select(X.job_postings(F.lit(page), F.lit("https://a.com/")).alias("v")).first()["v"]
        assert [r["title"] for r in rows] == ["Nurse"] * found
    listed = {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": job}, {"@graph": [{"@type": "organization", "name": "Acme", "sameAs": ["https://acme.com/?utm_source=x"]}]}]}
    page = f"<script type='application/ld+json'>{json.dumps(listed)}</script>"
    row = spark.range(1).select(X.job_postings(F.lit(page), F.lit("https://a.com/")).alias("p"), X.organization_names(F.lit(page)).alias("o"), X.organization_websites(F.lit(page)).alias("w")).first()
    assert [r["url"] for r in row["p"]] == ["https://a.com/1"] and list(row["o"]) == ["Acme"] and list(row["w"]) == ["https://acme.com/"]


def test_boards(spark):
    work = lambda k, **more: {"title": f"t{k}", "externalPath": f"/job/{k}", "locationsText": "Salem"} | more
    full = [work(k) for k in range(20)]
    bodies = [
        (1, "workday", 0, {"jobPostings": full, "total": 22}), (1, "workday", 1, {"jobPostings": [work(20), work(21, title=" ")]}), (1, "workday", 2, {"jobPostings": [work(30)]}),
        (2, "workday", 0, {"jobPostings": full}), (2, "workday", 1, "{"), (2, "workday", 2, {"jobPostings": full}), (3, "workday", 0, {"jobPostings": {}}), (4, "workday", 0, {"jobPostings": []}),
        (5, "lever", 0, [{"text": "a", "hostedUrl": "https://j.com/a", "categories": {"location": "Bend"}}, {"text": "b", "applyUrl": "/b"}, {"text": "c"}, 7]),
        (6, "oracle_hcm", 0, {"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": 5, "Title": "x", "PrimaryLocation": "US"}]}]}), (7, "unknown", 0, []), (8, "greenhouse", 0, None),
        (9, "smartrecruiters", 0, {"content": [{"name": "n", "id": "i9", "location": {"city": "Rome"}}], "totalFound": "1"}), (10, "workday", 0, {"jobPostings": [work(1)], "total": -1}),
    ]
    pages = spark.createDataFrame([(b, p, k, f"https://b{b}.com/jobs/", None if x is None else x if isinstance(x, str) else json.dumps(x)) for b, p, k, x in bodies], PAGES)
    rows, states = boards.read_boards(pages, boards.provider_table(spark))
    found = {r["board"]: (r["n_pages"], r["n_records"], r["n_listed"], r["total"], r["complete"], r["reason"]) for r in states.collect()}
    assert found == {
        1: (2, 22, 21, 22, True, None), 2: (2, 20, 20, None, False, None), 3: (1, 0, 0, None, False, "INVALID_STRUCTURED_DATA"), 4: (1, 0, 0, None, True, "EMPTY_PROVIDER_RESPONSE"),
        5: (1, 4, 2, None, True, None), 6: (1, 1, 1, 2, False, None), 8: (1, 0, 0, None, False, "INVALID_STRUCTURED_DATA"), 9: (1, 1, 1, 1, True, None), 10: (1, 1, 1, None, True, None),
    }
    got = {(r["board"], r["page"], r["position"]): (r["title"], r["url"], r["location"]) for r in rows.collect()}
    assert got[1, 1, 0] == ("t20", "https://b1.com/jobs/job/20", "Salem") and got[5, 0, 1] == ("b", "https://b5.com/b", None) and (1, 2, 0) not in got and (2, 2, 0) not in got
    assert got[6, 0, 0] == ("x", "https://b6.com/jobs/job/5", "US") and got[9, 0, 0] == ("n", "https://b9.com/jobs/i9", "Rome")


def test_inventory_payloads(spark):
    row = lambda **k: {"title": "Cook", "url": "/j/1"} | k
    cases = [
        ([row()], None, True, 1, None, True), ([row()], None, False, 1, None, False), ({"jobs": [row()], "total": 1}, None, False, 1, 1, True), ({"data": [row()], "count": 2}, None, True, 1, 2, False),
        ({"jobs": [row()], "data": []}, None, True, 0, None, False), ({"jobs": [row()], "total": 1, "count": 1}, None, True, 0, None, False), ({"jobs": [row()], "total": "1"}, None, True, 0, None, False),
        ({"records": [row(), row(url="/j/1/")]}, None, True, 1, None, True), ([row(), {"title": "x"}], None, True, 0, None, False), ([row(Title="Chef")], None, True, 0, None, False), ([row(Title="Cook")], None, True, 1, None, True),
        ([{"title": "Line Cook!", "ID": 7}], "https://a.com/{id}/{slug}", True, 1, None, True), ([{"title": "x", "id": "a b"}], "https://a.com/{id}", True, 0, None, False), ([row(jobUrl="/other")], None, True, 0, None, False), ("nope", None, True, 0, None, False), ([], None, True, 0, None, True),
    ]
    df = spark.createDataFrame([(k, x if isinstance(x, str) else json.dumps(x), t, h) for k, (x, t, h, *_) in enumerate(cases)], "k int, body string, t string, h boolean")
    got = {r["k"]: r for r in boards.inventory_payloads(df, F.col("body"), F.lit("https://a.com/api"), F.col("t"), F.col("h")).collect()}
    assert [(len(got[k]["rows"]), got[k]["total"], got[k]["complete"]) for k in range(len(cases))] == [c[3:] for c in cases]
    assert got[11]["rows"][0]["url"] == "https://a.com/7/line-cook"


def test_long_inventories_are_whole(spark):
    jobs = [{"title": f"Cook {k % 1500}", "url": f"/j/{k % 1500}" + "/" * (k // 1500)} for k in range(3000)]
    df = spark.createDataFrame([(json.dumps({"jobs": jobs, "total": 3000}),)], "body string")
    got = boards.inventory_payloads(df, F.col("body"), F.lit("https://a.com/api"), F.lit(None).cast("string"), F.lit(False)).first()
    assert [r["title"] for r in got["rows"]] == [f"Cook {k}" for k in range(1500)] and got["rows"][7]["url"] == "https://a.com/j/7" and (got["total"], got["complete"]) == (3000, True)
