"""Suffix-array dedup against brute force on small texts with short windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa

from tallyrun.llm.suffix_array import drop_repeats, remove_repeats, shared_prefixes

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, gram, levels=3):
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA), length, gram, levels)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows, length), key=repr)


def mixed(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(n) for n in (8, 15, 40, 90)]
    rows = []
    for d in range(60):
        parts = [text(r.randint(0, 30)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 3), r.choice(passages))
        if r.random() < 0.3:
            p = r.choice(passages)
            a = r.randint(0, len(p))
            parts.append(p[a : a + r.randint(5, 200)])
        rows.append((d, "".join(parts)))
    for d in range(60, 100):  # near copies of one text, and copies
        own = list(passages[3] + passages[2])
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = "#"
        rows.append((d, "".join(own)))
    return [*rows, (100, rows[0][1]), (100, rows[0][1]), (101, None), (102, ""), (103, "ab" * 150), (104, "a" * 90), (None, rows[5][1]), (None, None)]


def test_mixed_texts(spark):
    check(spark, mixed(1), 24, 8)


def test_long_windows_and_shallow_names(spark):
    check(spark, mixed(2), 60, 20, levels=1)


def test_registered_lengths(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 200))


def test_shared_prefixes():
    lists = pa.array([[1, 2, 3], [1, 2], [1, 2, 4], [], [5], [5]], pa.list_(pa.int64()))
    assert shared_prefixes(lists).tolist() == [2, 2, 0, 0, 1] and shared_prefixes(lists[1:3]).tolist() == [2] and shared_prefixes(lists[:1]).tolist() == []


def test_empty_table_and_short_texts(spark):
    check(spark, [], 24, 8)
    check(spark, [(1, "ab"), (2, "ab")], 24, 8)


def test_text_is_cut_at_characters(spark):
    shared = "é" * 10 + "xyz" * 20
    docs = spark.createDataFrame([(1, "one " + shared + " end", 7, "a"), (2, "two " + shared + " fin", 8, "b"), (3, None, None, "c")], "doc_id long, text string, n_chars long, c0 string")
    rows = {r["doc_id"]: r for r in drop_repeats(docs, 24, 8).collect()}
    assert rows[1]["text"] == "one end" or rows[1]["text"] == "oneend"
    assert rows[3]["text"] is None and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["c0"] == "b"
