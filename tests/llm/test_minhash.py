"""Near-duplicates against brute force, with a large group of near copies on both sides of the threshold."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyrun.llm import minhash
from tallyrun.llm.components import components
from tallyrun.llm.minhash import BANDS, ROWS, band_keys, drop_near_duplicates, near_duplicates, prefixes, signature
from tallyrun.llm.textvec import constants

SCHEMA = "doc_id long, text string"


def shingle_set(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, n):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    base = [r.choice(words) for _ in range(80)]
    rows = [(d, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for d in range(40)]
    for d in range(100, 220):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 2)] = ["new%d" % r.randrange(10**6)] * r.randint(0, 2)
        rows.append((d, "  ".join(own)))
    rows += [(300, rows[50][1].upper()), (301, rows[3][1]), (301, rows[3][1]), (302, None), (303, ""), (304, " \n"), (305, "one two"), (306, "ONE\ttwo"), (None, rows[60][1]), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    rows = corpus(n)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), n)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows, n), key=repr)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 6, "x"), (2, "a b c d e f", 6, "y"), (3, "q r s t u v", 6, "x"), (3, "q r s t u v", 6, "x"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, node string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (5, "A b c d e F"), (5, "m n o p q r"), (None, "m n o p q r")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f"), (2, "g h i j k l"), (5, "m n o p q r")]


def test_prefixes_lose_no_pair():
    """Two sets that link, but not both with the hub, share one of the shingles that the prefixes hold, in any common order."""
    r = np.random.default_rng(5)
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    met = plain = 0
    for _ in range(6000):
        hub = np.sort(r.choice(10**6, r.integers(10, 60), replace=False)).astype(np.uint64)
        grown = np.union1d(hub[r.random(len(hub)) > r.random() / 3], 10**6 + r.integers(0, 60, r.integers(0, 20) * r.integers(0, 2)).astype(np.uint64))
        a, b = (np.union1d(grown[r.random(len(grown)) > r.random() / 9], 2 * 10**6 + r.integers(0, 999, r.integers(0, 4)).astype(np.uint64)) for _ in range(2))
        if len(a) and len(b) and linked(a, b) and not (linked(hub, a) and linked(hub, b)):
            met += 1
            mine, other = (prefixes(hub, x, min(len(a), len(b)), 80) for x in (a, b))
            shared = [np.intersect1d(mine[k][: mine[k + 1]], other[k][: other[k + 1]]) for k in (1, 3)]
            plain += not len(np.intersect1d(mine[1], other[1]))
            assert len(shared[0]) or len(shared[1])
    assert met > 500 and plain > 20


def test_signatures_estimate_similarity():
    a, b = constants(1000, 1), np.concatenate([constants(1000, 1)[:800], constants(200, 2)])
    agree = (signature(a) == signature(b)).mean()
    assert abs(agree - 800 / 1200) < 0.1
    assert len(set(band_keys(signature(a)[None])[0].tolist())) == BANDS and len(signature(a)) == BANDS * ROWS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 160))


def test_rounds_end_in_families_around_the_threshold(spark, monkeypatch):
    """Members beside the largest component of a bucket are settled at once, not in round after round, and nothing is lost by it."""
    r = random.Random(5)
    rows = []
    base = [f"w{k}" for k in range(120)]
    for d in range(260):
        own = list(base)
        for _ in range(r.randint(0, 4) if d % 8 else r.randint(5, 7)):
            own[r.randrange(120)] = f"new{r.randrange(5)}"
        rows.append((d, " ".join(own)))
    tables = []
    write = minhash.Scratch.__call__

    def counted(self, df, name):
        tables.append(name)
        assert tables.count("buckets") <= 2, "rounds go on"
        return write(self, df, name)

    monkeypatch.setattr(minhash.Scratch, "__call__", counted)
    monkeypatch.setattr(minhash, "HUBS", 4)
    for bound in ("LEFT", "PAIRS"):
        monkeypatch.setattr(minhash, bound, 0, raising=False)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), 4)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 4))
    assert "buckets" in tables


def test_pairs_across_lose_no_link(spark):
    """Every pair of members of one bucket that may link and lies in two components is met, each once, however many tasks it is dealt to."""
    r, sets, rows = np.random.default_rng(9), {}, []
    hub = np.arange(40)
    for node in range(90):
        sets[node] = set(hub[r.random(40) > r.random() / 3].tolist()) | set(r.integers(100, 112, r.integers(0, 12)).tolist())
        rows.append((7, node, len(sets[node]), len(sets[node] & set(hub.tolist())), 0, node % 3 if node % 5 else node))
    members = minhash._sided(spark.createDataFrame(rows, "key long, node long, n long, c long, d long, root long"))
    assert members.first()["n_minor"] > minhash.HUBS
    met = [tuple(sorted((x["a"], x["b"]))) for x in minhash._across(members, 80).collect()]
    root = {x[1]: x[5] for x in rows}
    wanted = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(met) == len(set(met)) and wanted and wanted <= set(met)
