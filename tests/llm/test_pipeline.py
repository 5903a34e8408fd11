"""The corpus pipeline stage by stage on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from test_minhash import brute

from tallyrun.llm import packing
from tallyrun.llm.storage import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), name.replace(" ", "-")))
    assert [d.columns == columns for d in seen[:-1]] == [True] * 5
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    rows = [(r["doc_id"], r["text"]) for r in seen[1].select("doc_id", "text").collect()]
    assert ids[2] == {d for d, _, _, kept in brute(rows, 5) if kept}
    texts = dict(seen[4].select("doc_id", "text").collect())
    total = sum(r["length"] for r in seen[5].collect())
    cache = packing.WordCache(packing.tokenizer_path())
    assert total == sum(len(x) + 1 for x in cache._ids([t or "" for t in texts.values()]))
