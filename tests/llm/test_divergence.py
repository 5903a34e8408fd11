"""The source divergence audit against brute force in Python integers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from tallyrun.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top):
    docs, in_docs, counts = {}, {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))
        docs.setdefault(lang, set()).add(source)
        in_docs.setdefault(lang, Counter()).update(terms.keys())
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang, sources in docs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(r):
    vocabulary = ["Alpha", "ÉTÉ", "été", "b", "naïve", "日本", "x y", "don't", "a1b2", "\U0001f600", "z" * 3000] + [f"w{chr(97 + k)}{chr(97 + k % 5)}" for k in range(25)]
    rows = []
    for d in range(400):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choice(["hot"] * 4 + [f"s{k}" for k in range(9)] + [None, "é", "Z"])
        rows.append((d, " ".join(r.choices(vocabulary[: 12 + 3 * (len(source or "") % 9)], k=r.randrange(30))), lang, source))
    return rows + [(1, None, "en", "empty"), (1, "", "xx", "a"), (2, "few words", "xx", "b"), (2, "few words", "xx", "b"), (3, "only", "yy", "alone")]


def test_equals_brute_force(spark):
    """One tile and many: blocks of few terms and few sources."""
    rows = rows_of(random.Random(5))
    docs = spark.createDataFrame([(*x, "c") for x in rows], DOCS + ", term string").repartition(5)
    for min_docs, top, term_block, group_block in ((30, 50, 1024, 64), (30, 3, 4, 3), (1, 5, 7, 1), (10_000, 50, 8, 4)):
        got = divergence.audit_sources(docs, min_docs, top, term_block, group_block)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(300):
        total, terms = r.randrange(10**r.randrange(1, 15)), r.randrange(1, 10**6)
        counts = [r.randrange(total + 1), 0, total]
        got = divergence.shares(np.array([counts], np.int64), np.array([[total]], np.int64), terms)[0]
        assert got.tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def test_empty(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []
