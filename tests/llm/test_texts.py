"""Decontamination, passages, chats, archives and packing against brute force and round trips."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from tallyrun.llm import chat_format, decontaminate, packing, storage, substring_dedup, warc

DOCS = "doc_id long, text string"


def words(r, n, vocabulary=5000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_leaks(spark):
    r = random.Random(1)
    items = [words(r, 40) for _ in range(5)] + [words(r, 8)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    swapped = [w if k % 8 else "other" for k, w in enumerate(items[1])]
    rows = [
        (0, " ".join(words(r, 100) + items[0] + words(r, 100))), (1, " ".join(words(r, 50) + swapped)), (2, " ".join(items[2][5:18])), (3, ", ".join(items[5]).upper()),
        (4, " ".join(words(r, 300))), (5, " ".join(items[3][:10] + words(r, 60))), (6, None), (7, ""), (8, " ".join(words(r, 20_000) + items[4])), (0, " ".join(items[0])), (None, "x"),
    ]
    docs = spark.createDataFrame([(*x, 5) for x in rows], DOCS + ", n_tokens int")
    for block in (decontaminate.BLOCK_CHARS, 200):
        got = [(x["doc_id"], x["contaminated"], list(x["items"])) for x in decontaminate.judge_leaks(docs, bench, block).collect()]
        want = [(0, True, [0]), (0, True, [0]), (1, True, [1]), (2, True, [2]), (3, True, [5]), (4, False, []), (5, False, []), (6, False, []), (7, False, []), (8, True, [4]), (None, False, [])]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        kept = decontaminate.drop_leaks(docs, bench, block)
        assert kept.columns == docs.columns and sorted(x["doc_id"] or -1 for x in kept.collect()) == [-1, 4, 5, 6, 7]
    named = bench.selectExpr("if(item_id = 2, null, concat('i', item_id)) item_id", "text")
    got = {x["doc_id"]: list(x["items"]) for x in decontaminate.judge_leaks(docs, named).collect()}
    assert got[1] == ["i1"] and got[2] == [None] and got[4] == []
    assert not any(x["contaminated"] for x in decontaminate.judge_leaks(docs, spark.createDataFrame([], bench.schema)).collect())
    assert decontaminate.judge_leaks(spark.createDataFrame([], DOCS), bench).collect() == []


def test_leaks_equal_brute_force(spark):
    """Every stretch along every diagonal, on texts that hold items with about a fifth of their tokens changed."""
    r = random.Random(4)
    items = [words(r, n, 60) for n in (13, 20, 30, 45)]
    rows = [words(r, 30, 60) + [w if r.random() < r.choice((0.7, 0.8, 0.85, 0.9)) else "zz" for w in r.choice(items)] + words(r, 30, 60) for _ in range(120)]

    def leaks(text, item):
        for shift in range(-len(item) + 1, len(text)):
            same = [text[k + shift] == item[k] for k in range(len(item)) if 0 <= k + shift < len(text)]
            if any(5 * sum(same[a:b]) >= 4 * (b - a) for a in range(len(same)) for b in range(a + 13, len(same) + 1)):
                return True
        return False

    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.judge_leaks(spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(rows)], DOCS), bench).collect()
    want = {d: [i for i, item in enumerate(items) if leaks(x, item)] for d, x in enumerate(rows)}
    assert {x["doc_id"]: list(x["items"]) for x in got} == want and 20 < sum(map(bool, want.values())) < 120


def test_masks_hit_every_overlap():
    """All patterns with a fifth of the tokens changed: stretches of 13 to 25 tokens, and short items as a whole."""
    for n in range(1, 26):
        masks = decontaminate.MASKS if n >= decontaminate.MIN_OVERLAP else decontaminate.short_masks(n)
        patterns = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(n), n // 5)])
        ones = [int(m[::-1], 2) << at for m in masks for at in range(n - len(m) + 1)]
        assert np.logical_or.reduce([(patterns & b) == 0 for b in ones]).all(), n


def test_short_items(spark):
    items = [[f"i{n}x{k}" for k in range(n)] for n in range(1, 14)]
    bench = spark.createDataFrame([(len(x), " ".join(x)) for x in items], "item_id long, text string")
    rows = []
    for x in items:
        for c in itertools.combinations(range(len(x)), len(x) // 5):
            rows.append((len(x), " ".join(["before", *["other" if k in c else w for k, w in enumerate(x)], "after"])))
        rows.append((-1, " ".join(["other" if k <= len(x) // 5 else w for k, w in enumerate(x)])))
    got = decontaminate.judge_leaks(spark.createDataFrame(rows, DOCS), bench).collect()
    assert len(got) == len(rows) and all(list(x["items"]) == ([x["doc_id"]] if x["doc_id"] > 0 else []) for x in got)


def test_passages(spark):
    r = random.Random(2)
    passage = words(r, 80)
    changed = list(passage)
    changed[40] = "other"
    texts = [words(r, 60) + passage + words(r, 60), words(r, 30) + passage, changed + words(r, 90), words(r, 300), passage[:30] + words(r, 100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10, None), (11, ""), (12, "a b"), (20, " ".join(texts[3][:100])), (21, " ".join(texts[3][:100]))]
    got = {x["doc_id"]: x for x in substring_dedup.near_duplicate_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i]["class_id"] for i in (0, 1, 2)] == [0, 0, 0] and got[4]["class_id"] == 4 and got[4]["n_dup_words"] == 0
    assert got[0]["starts"][0] <= 62 and got[0]["ends"][-1] >= 138 and 76 <= got[0]["n_dup_words"] <= 110
    assert got[3]["class_id"] == got[20]["class_id"] == got[21]["class_id"] == 3 and got[20]["n_dup_words"] == 100
    assert [(got[i]["n_dup_words"], got[i]["class_id"]) for i in (10, 11, 12)] == [(0, 10), (0, 10), (0, 12)] and len(got) == len(rows)  # null equals empty
    assert substring_dedup.near_duplicate_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_passages_of_variants_and_copies_equal_brute_force(spark):
    """Groups of edited variants and two exact copies: whichever is first in a group, the copies are found."""
    r = random.Random(7)
    texts, groups = [], 12
    for _ in range(groups):
        passage = words(r, 60)
        variants = [list(passage) for _ in range(4)]
        for v in variants[:3]:
            for k in r.sample(range(60), 4):
                v[k] = "edit" + str(r.randrange(10**6))
        texts += [words(r, 50) + v + words(r, 50) for v in [*variants, passage]]
    width = substring_dedup.PASSAGE - substring_dedup.SHINGLE + 1
    codes = [[" ".join(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    covered, root = [set() for _ in texts], list(range(len(texts)))
    for g in range(0, len(texts), 5):
        for a in range(g, g + 5):
            for b in range(a + 1, g + 5):
                for i in range(len(codes[a]) - width + 1):
                    p, q = set(codes[a][i : i + width]), set(codes[b][i : i + width])
                    if 100 * len(p & q) >= 80 * len(p | q):
                        covered[a].update(range(i, i + 50)), covered[b].update(range(i, i + 50))
                        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    got = {x["doc_id"]: x for x in substring_dedup.near_duplicate_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)).collect()}
    assert all(got[i]["class_id"] == got[i + 1]["class_id"] for i in range(3, len(texts), 5))
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_dup_words"] for i in range(len(texts))] == [len(c) for c in covered]


def test_runs_of_a_word_are_one_stretch(spark):
    """A run's windows have the same few shingles: one row a function and set instead of one a window, and all its words are found."""
    values = np.array([1] * 300 + [*range(2, 202)] + [1] * 100 + [*range(300, 400)], np.uint64)
    width, few = 46, 33
    ordinary, first, last = substring_dedup.repetitive(values, width)
    sets = [frozenset(values[i : i + width].tolist()) for i in range(len(values) - width + 1)]
    assert ordinary.tolist() == [len(x) >= few for x in sets]
    low = [80 * len(x) <= 100 * (few - 1) for x in sets]
    starts = [i for i, x in enumerate(sets) if low[i] and (i == 0 or sets[i - 1] != x)]
    assert first.tolist() == starts and all(len(set(sets[a : b + 1])) == 1 and (b + 1 == len(sets) or sets[b + 1] != sets[a]) for a, b in zip(first, last, strict=True))
    r = random.Random(8)
    run, other = ["same"] * 300, words(r, 100)
    texts = [run + other, words(r, 80) + ["same"] * 120 + words(r, 80), words(r, 200), words(r, 50) + ["twice"] * 90 + words(r, 50), words(r, 50) + ["often"] * 120 + words(r, 50)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    assert substring_dedup._all_windows(docs.filter("doc_id = 0"), 5, width, 6).count() < 400
    got = {x["doc_id"]: x for x in substring_dedup.near_duplicate_passages(docs).collect()}
    assert [got[i]["class_id"] for i in range(5)] == [0, 0, 2, 3, 4]
    assert got[0]["starts"][0] == 0 and 300 <= got[0]["ends"][0] <= 340 and got[1]["starts"][0] <= 80 and got[1]["ends"][0] >= 200
    assert got[2]["n_dup_words"] == got[3]["n_dup_words"] == 0 and got[4]["starts"][0] <= 50 and got[4]["ends"][0] >= 170


def test_compact_windows_hold_every_subsequence():
    values = np.random.default_rng(3).permutation(60).astype(np.uint64) << np.uint64(30)
    found = {c: (a, b) for a, c, b in substring_dedup.compact_windows(values, 7)}
    for i in range(54):
        for j in range(i + 6, 60):
            c = i + int(values[i : j + 1].argmin())
            assert found[c][0] <= i and found[c][1] >= j


def test_chats(spark):
    full = [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c")]
    rows = [(1, *t) for t in full] + [(2, *t) for t in full[:2]] + [(3, *t) for t in full] + [(4, *full[0]), (4, 1, "assistant", "x"), (5, None, None, None), (5, None, None, None)]
    rows += [(6, *full[0]), (6, *full[0]), (None, 0, "user", "z"), (7, 0, "user", "\u00e9 <|x|>\n")]
    got = {x["conv_id"]: x for x in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 4, 5, 7, None} and got[1]["n_copies"] == 2 and got[1]["n_turns"] == 3
    assert got[1]["chat"] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n" and got[5]["chat"] == "<||>\n\n"
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_archives(spark):
    big = "x" * 1500
    rows = [(1, "http://a/\u00e9 b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", "\u00e9\r\n\r\n" * 400), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(spark, pages, with_payload=True).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_bytes"]) == ("revisit", 2, 1500) and by[2]["record_type"] == "response"
    assert by[3]["record_type"] == by[4]["record_type"] == "response" and by[5]["payload_bytes"] == 0 and bytes(by[6]["payload"]).decode() == "\u00e9\r\n\r\n" * 400
    assert warc.round_trip(spark, spark.createDataFrame([], pages.schema)).collect() == []


def test_hot_and_other_digests(spark):
    rows = [(i, "h" * 1200) for i in range(30)] + [(100 + i, f"{i // 2}" * 1100) for i in range(20)] + [(None, "h" * 1200), (200, "small")]
    pages = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string")
    want = sorted((i, {"h": 29}.get(t[0], 101 + (i or 0) // 2 * 2 - 100) if i != 200 else None) for i, t in rows if i is not None)
    want = [(i, None if i == x else x) for i, x in want]
    for share in (1, 3, 10_000):
        got = warc.with_record_types(pages, hot_share=share).collect()
        assert sorted((r["page_id"], r["refers_to"]) for r in got if r["page_id"] is not None) == want
        assert [r["refers_to"] for r in got if r["page_id"] is None] == [29] and len(got) == len(rows)


def test_broken_records():
    good = warc.record_bytes(1, "http://a", b"hello", __import__("hashlib").sha1(b"hello").hexdigest(), None)
    assert warc.parsed(good)["error"] is None
    for bad in (good.replace(b"hello", b"hallo"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), b""):
        assert warc.parsed(bad)["error"]


def test_pieces(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = [None, "", " ", "a", " lead", "trail ", "two  blanks", "tab\there", "it's 12345 don't\nnew\n\nlines", "<|endoftext|> x", "\u00e9\u00a0\u3000x \u4e2d\u6587", "e\u0301 \ufffd \x85", " ".join(words(r, 3000)), "a" * 5000, "x " * 4097]
    docs = spark.createDataFrame([*enumerate(texts), (3, "a")], DOCS)
    rows = packing.pack(docs, path, with_ids=True).collect()
    assert len({x["sequence_id"] for x in rows}) == len(rows) and all(x["offset"] == 0 and x["length"] in [1 << k for k in range(12)] for x in rows)
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((x for x in rows if x["doc_id"] == d), key=lambda x: x["start"])
        own = own[:1] if d == 3 else own
        assert [i for x in own for i in x["ids"]] == ids and all(x["doc_tokens"] == len(ids) for x in own)
        assert all(x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes()) for x in own)
    assert packing.pack(spark.createDataFrame([], DOCS), path).collect() == []


def test_scratch_tables(spark):
    scratch = storage.Scratch(spark)
    a, b = scratch(spark.range(3), "a"), scratch(spark.range(4), "b")
    scratch.drop(a)
    assert b.count() == 4 and [t for t, _ in scratch.tables] == [b]


def test_windows_beside_a_hub_equal_brute_force():
    """Windows of edited copies: which are similar to the hub's, and that two similar ones, not both similar to it, share a key."""
    r, width, starts = np.random.default_rng(5), 46, 8
    hub = r.integers(0, 2**63, width + starts - 1).astype(np.uint64)
    base = np.where(r.random(len(hub)) < 0.25, r.integers(0, 2**63, len(hub)).astype(np.uint64), hub)
    x = np.stack([np.where(r.random(len(hub)) < 0.06, r.integers(0, 2**63, len(hub)).astype(np.uint64), base) for _ in range(30)])
    n = len(x)
    close, low, high = substring_dedup.compared(x, np.stack([hub] * n), np.zeros(n, int), np.full(n, len(hub)), np.full(n, starts), width)

    def alike(p, q):
        return 100 * len(set(p) & set(q)) >= 80 * len(set(p) | set(q))

    met = 0
    for i in range(starts):
        windows = x[:, i : i + width]
        assert [alike(w, hub[i : i + width]) for w in windows] == close[:, i].tolist()
        keys = [set(x[k][(low[k] <= i) & (high[k] >= i)]) for k in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if alike(windows[a], windows[b]) and not (close[a, i] and close[b, i]):
                met += 1
                assert keys[a] & keys[b]
    assert met
