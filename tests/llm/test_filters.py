"""URL filters, quality rules and language identification: edge cases and held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrun.llm import language_id, quality_rules, url_filter

URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no mark/casino": ("", "", None, "block"),
    "http://A.Example.COM/en/1": ("a.example.com", "/en/1", "com/en/", "block"),
    "http://example.com/en/7/x?y": ("example.com", "/en/7/x", "example.com/en/7", "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "http://x.net/de/8#z": ("x.net", "/de/8", "net/de/", "allow"),
    "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
    "http://a.org?/es/": ("a.org", "", None, "allow"),
    "http://a.org/es": ("a.org", "/es", None, "allow"),
    "http://a.io/free/free": ("a.io", "/free/free", None, "allow"),
    "http://a.io/free-bet": ("a.io", "/free-bet", None, "block"),
    "http://a.io/freebet": ("a.io", "/freebet", None, "allow"),
    "x://a://b/c": ("a:", "//b/c", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS)] + [(0, None, "old")]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"))
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == URLS and found.count() == len(rows)
    assert url_filter.judge_urls(spark.createDataFrame([], "url string")).collect() == []


def test_quality_edges(spark):
    words = " ".join(f"word{i}" for i in range(30))
    texts = [None, "", "  \n\t", "one two", words, words + " " + words, "x " * 5000, words + " ####", "\n".join(["same line here"] * 4 + [words] * 2), "é\u00a0ü " * 30]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 7)], "doc_id long, text string, n_words int")
    found = quality_rules.judge_quality(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(texts) + 1 and [got[i]["n_words"] for i in range(6)] == [0, 0, 0, 2, 30, 60]
    assert got[4]["kept"] and not got[4]["base_failed"] and got[5]["n_repeat_words"] == 60 and got[5]["base_failed"]
    assert got[6]["n_repeat_words"] == 5000 and got[7]["n_symbols"] == 4 and not got[7]["kept"] and got[9]["n_words"] == 30
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    empty = spark.createDataFrame([], docs.schema)
    assert quality_rules.judge_quality(empty).collect() == [] and quality_rules.filter_quality(empty).collect() == []


def test_cascade_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.RULES
    ids = [{r[0] for r in docs.filter(quality_rules.verdict(order).isNull()).select("doc_id").collect()} for order in (rules, rules[::-1])]
    assert ids[0] == ids[1] == {r[0] for r in quality_rules.judge_quality(docs).filter("kept").select("doc_id").collect()}


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 30 and right / n > 0.9


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, "der hund und die katze " * 5, "de"), (2, "the dog and the cat " * 5, "en"), (5, "the dog and the cat " * 5, None), (6, "ab", "en"), (None, "der hund", "de")]
    rows += [(10, None, None), (11, "", None), (12, "12 34 !", None), (13, "é", None), (14, "the dog", None), (14, "the dog", None)]
    docs = spark.createDataFrame(rows, schema)
    model = language_id.learn(spark.createDataFrame([(i, t, x) for i in range(30) for t, x in (("der hund und die katze", "de"), ("the dog and the cat", "en"))], schema))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert len(model.langs) == 2 and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (10, 11, 12))
    assert got[14]["lang_pred"] == "en" and got[1]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.learn(spark.createDataFrame([], schema))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], schema), model).collect() == []


def test_lazy_rules(spark):
    words = [f"word{i} more{i} text{i} of line{i}" for i in range(10)]
    texts = {
        1: "\n".join("- " + w for w in words),
        2: "\n".join(" • " + w for w in words),
        3: "\n".join(words[:6] + [w + "..." for w in words[6:]]),
        4: "\n".join(words[:6] + [w + "… \r" for w in words[6:]]),
        5: " ".join(words[:4]) + " 12345" * 3 + " 1 2 3 4 5 6 7 8 9 10 11 12",
        6: "\n".join(["- " + w for w in words[:9]] + words[9:]),
        7: "\n".join(words[:7] + [w + "..." for w in words[7:]]),
        8: "\n".join("中文 " + w for w in words),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    names = {r["doc_id"]: r["v"] for r in docs.select("doc_id", quality_rules.verdict(quality_rules.RULES).alias("v")).collect()}
    assert names == {1: "bullets", 2: "bullets", 3: "ellipses", 4: "ellipses", 5: "letterless", 6: None, 7: None, 8: None}
    assert {r["doc_id"] for r in quality_rules.judge_quality(docs).filter("kept").collect()} == {6, 7, 8}


def test_cascade_puts_first_what_rejects_most_a_second(spark):
    docs = spark.createDataFrame([(i, "few words") for i in range(20)], "doc_id long, text string")
    short, never = quality_rules.Rule("short", "{n_words} < 20"), quality_rules.Rule("never", "{n_words} < 0")
    assert quality_rules.fit_cascade(docs, (never, short)) == [short, never]
    again = quality_rules.Rule("again", "{n_words} < 20")
    assert quality_rules.fit_cascade(docs, (never, again), placed=(short,))[0] in (never, again)
