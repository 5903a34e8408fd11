"""Line deduplication against brute force, by both ways of probing, and its perfect hashes."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyrun.llm import line_dedup

DOCS = "doc_id long, text string"


def brute(rows, min_chars=20, min_docs=3):
    """In a loop over rows: keys, documents and largest ids; null ids are below all others."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= min_chars else None

    held = defaultdict(list)
    for d, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            held[k].append(-1 if d is None else d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if d is None else d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows_of(r):
    lines = [f"{'Ünïcode line' if k % 3 else 'a plain line'} number {k} {'x' * (k % 7)}" for k in range(40)] + ["short", "", "  ", "nineteen characters", "twenty  characters.."]
    around = ["", " ", "\t", "\r", " \x0b\x0c"]
    rows = [(d, "\n".join(r.choice(around) + (x.upper() if r.random() < 0.2 else x) + r.choice(around) for x in r.choices(lines, k=r.randrange(9)))) for d in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(lines)), (None, "\n".join(lines[:20])), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(300 + d, "the line that everybody holds\n" + "y" * 30_000 * (d == 5)) for d in range(40)]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_equals_brute_force(spark, sent, monkeypatch):
    """Broadcast and dealt probes, one shard and many, copies of a hot shard."""
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame([(*x, 5, "s") for x in rows], DOCS + ", first int, shard string")
    for shard_keys, load in ((1 << 17, 1 << 20), (4, 16)):
        monkeypatch.setattr(line_dedup, "COPY_LOAD", load)
        got = line_dedup.dedup_lines(docs.repartition(5), shard_keys=shard_keys, broadcast_bytes=sent)
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    few = line_dedup.dedup_lines(docs, min_chars=1, min_docs=2, broadcast_bytes=sent)
    assert sorted(map(tuple, few.collect()), key=repr) == brute(rows, 1, 2)


def test_nothing_repeats(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    alone = spark.createDataFrame([(1, "a line of its own, long enough"), (2, None)], DOCS)
    assert sorted(map(tuple, line_dedup.dedup_lines(alone).collect())) == [(1, "a line of its own, long enough", 1, 0), (2, "", 1, 0)]


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        held = line_dedup.PerfectHash.of(keys)
        assert sorted(held.numbers(keys).tolist()) == list(range(len(keys)))
        assert n < 1000 or sum(held.sizes) < 6 * n


def test_keys_that_share_their_first_word():
    first, second = np.array([5, 9, 5, 5], np.int64), np.array([1, 2, 3, 4], np.int64)
    table = pa.table({"shard": [0] * 4, "first": first, "second": second, "n": [3, 300, 4, 5], "keeper": [10, 20, 30, line_dedup.NULL_ID]})
    shard = line_dedup.Shard(line_dedup.build_shard(table).to_pylist()[0])
    probes = [(5, 1, 10), (5, 1, 11), (5, 3, 30), (5, 3, 10), (5, 4, 1), (9, 2, 1), (9, 3, 1), (5, 9, 1)]
    got = shard.dropped(*(np.array(c, t) for c, t in zip(zip(*probes, strict=True), (np.uint64, np.uint64, np.int64), strict=True)), 3)
    assert got.tolist() == [False, True, False, True, True, True, False, False]
