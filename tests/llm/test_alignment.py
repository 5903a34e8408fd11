"""Cross-tokenizer alignment against tokenising whole texts and comparing all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tallyrun.llm import alignment, packing

A, B = packing.tokenizer_path(), packing.tokenizer_path("piece_bpe_32k.model")


def whole_text(text, tool):
    """Groups of (A ids, B ids) by the offsets where tokens of both end."""
    raw = (" " + text).encode()
    out, at = [], 0
    for ids, table in ((tool.a.encode(" " + text, add_special_tokens=False).ids, tool.bytes_a), (tool.b.encode(text), tool.bytes_b)):
        if b"".join(table[k] for k in ids) != raw:
            return []
        at, ends = 0, []
        for k in ids:
            at += len(table[k])
            ends.append((at, k))
        out.append(ends)
    cuts = sorted({e for e, _ in out[0]} & {e for e, _ in out[1]})
    return [tuple([k for e, k in ends if low < e <= high] for ends in out) for low, high in zip([0, *cuts], cuts, strict=False)]


def brute(rows):
    tool = alignment.aligner(A, B)
    groups = [whole_text(t, tool) if t else [] for _, t in rows]
    links = [[(a, b) for x, y in own for a in x for b in y] for own in groups]
    counts = Counter(p for own in links for p in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for (d, _), own, pairs in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        out.append((d, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "a\n", "two  blanks", "line\nline", "line\n\n  indented\n", "tab\there", "\x1c x", "no break space", "em space", "᠎",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "piece ▁ sign", "▁", "nul\x00byte", "Übergrößenträger naïve façade", "日本語のテキスト", "\U0001f600\U0001f469‍\U0001f680 emoji", "é combined", "'s 't I'm we'll",
    "a" * 3000, "ab" * 700 + " tail", "12345 3.14159", "﻿bom", "x\r\ny", "don't;  stop\n  now", "ﬁ ligature",
]


@pytest.mark.parametrize("most", [1_000_000, 40, 0])
def test_equals_brute_force(spark, most):
    """All pairs sent, some, and none: the others are joined."""
    r = random.Random(4)
    words = ["the", "of", "tokenizer", "Straße", "anis", "thhe", "heon,", "\n", "word\n", "x=1;", "été"]
    rows = list(enumerate(ODD)) + [(100 + d, " ".join(r.choices(words, k=r.randrange(60)))) for d in range(60)] + [(None, "the null id"), (5, "the repeated id"), (5, "the repeated id")]
    docs = spark.createDataFrame([(*x, 3, "p") for x in rows], "doc_id long, text string, n int, pair string").repartition(4)
    got = alignment.align_corpus(docs, A, B, most)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    named = {x["doc_id"]: x["groups"] for x in alignment.align_corpus(docs, A, B, most, with_groups=True).collect()}
    assert named[0] == "" and named[7].count("|") == 1


def test_groups():
    """Tokens of equal ends, one across many, and borders that never meet before the end."""
    for a, b, want in (([1, 2, 3], [1, 2, 3], [(0, 0), (1, 1), (2, 2)]), ([3], [1, 2, 3], [(0, 0)]), ([1, 3, 6], [2, 6], [(0, 0)]), ([2, 4, 6], [1, 4, 5, 6], [(0, 0), (2, 2)])):
        assert alignment.groups_of(a, b) == want


def test_segments():
    """Cut before blanks, newlines and signs behind a letter; the cut parts together are the text."""
    assert alignment.segments_of("a, b.c\n\n d's x_1 9,") == [" a", ",", " b", ".c", "\n\n d's", " x", "_1", " 9,"]
    for text in filter(None, ODD):
        assert "".join(alignment.segments_of(text)) == " " + text


def test_empty(spark):
    assert alignment.align_corpus(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_histogram_bounds_what_is_sent(spark):
    counts = spark.createDataFrame([(k, 1 + k % 5 + 1000 * (k < 3)) for k in range(100)], "pair long, n long")
    for most in (0, 3, 30, 99, 100):
        least, every = alignment._least_sent(counts, most)
        assert counts.where(f"n >= {least if least < float('inf') else 10**9}").count() <= most and every == (most >= 100)
