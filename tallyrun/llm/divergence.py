"""Source divergence audit: how the word shares of each source of a language differ from the other sources' and from the language's.

Each language keeps the V terms found in at least ``min_docs`` of its documents.  A group (a source of a language, or the whole language)
gives a kept term the share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), in exact integers.

1. Tasks count terms per group within batches; aggregates with partial sums make counts per (language, source, term) and, from these,
   per (language, term).
2. Kept terms are dealt by hash to blocks of about ``term_block`` terms, numbered within a block in UTF-8 order; the sources of a language to
   blocks of ``group_block``.  A tile is the int64 matrix of one group block by one term block.
3. For each term block and each pair of group blocks one task lays its two tiles out and broadcasts each group's row against
   all rows of the other tile; the sums of absolute differences are that block's part of the pair matrix, and Spark sums the parts.
   The tile of a group block with itself also meets the language's own row and yields each group's heap of its ``top`` terms.
4. Heaps are merged by a ranking within each group, pairs are ranked likewise.

A tile takes ``group_block * term_block`` counts whatever the number of sources, terms and documents is; pairs of sources are the result itself.
Null lang, source and text are ''.  Every row is a document of its own.  A language without kept terms has pairs of value 0 and no terms;
a language with one source has no pairs.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

MIN_DOCS, TOP_TERMS = 30, 50
SMOOTH, SCALE = 5, 1_000_000_000
TERM_BLOCK, GROUP_BLOCK = 1024, 64
BATCH_TERMS = 200_000
"""Counts that a task holds before it hands them on."""

# A term is a run of ASCII letters and bytes outside ASCII: all other bytes become blanks, upper case becomes lower.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def text_terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """One row per language, source and term: occurrences and documents; a group's documents without a term stand under a null term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            lines = [(*group, None, 0, 0) for group in held]
            lines += [(*group, term.decode(), n, docs_[term]) for group, (total, docs_) in held.items() for term, n in total.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], ["lang", "source", "term", "n", "docs"])

        for part in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                own, size = Counter(text_terms(text)), size - len(total)
                total.update(own)
                in_docs.update(own.keys())
                size += len(total)
                if size > BATCH_TERMS:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    found = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(rows, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), by long division to base 1000, so that no step leaves 64 bits."""
    divisor = total + SMOOTH * terms
    whole, rest = np.divmod(counts + SMOOTH, divisor)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digit
    return whole + 1


_HEAD = ("lang", "block", "left", "right")


def tile_parts(top: int):
    """The work on one term block and two group blocks.

    Rows have a kind: 0 a group (its number and total, with the block's width and V), 1 the count of a term in a group, 2 the whole language's
    total, 3 a term's count in it.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: own for k, own in rows.groupby("kind")}
        groups = kinds[0].sort_values("one")
        numbers, totals = groups["one"].to_numpy(np.int64), groups["n"].to_numpy(np.int64)
        width, terms, group_block = (int(groups[c].iloc[0]) for c in ("width", "terms", "group_block"))
        tile = np.zeros((len(numbers), width), np.int64)
        if 1 in kinds:
            cells = kinds[1]
            tile[np.searchsorted(numbers, cells["one"].to_numpy(np.int64)), cells["col"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
        p = shares(tile, totals[:, None], terms)
        lang, _, left, right = (rows[c].iloc[0] for c in _HEAD)
        block = numbers // group_block
        rest = np.flatnonzero(block == right)
        out = []
        for k in np.flatnonzero(block == left).tolist():
            others = rest if left != right else rest[rest > k]
            sums = np.abs(p[k] - p[others]).sum(axis=1)
            out.append(pd.DataFrame({"part": "pair", "one": numbers[k], "other": numbers[others], "col": -1, "value": sums}))
        if 3 in kinds:
            whole = np.zeros(width, np.int64)
            whole[kinds[3]["col"].to_numpy(np.int64)] = kinds[3]["n"].to_numpy(np.int64)
            q = shares(whole, kinds[2]["n"].to_numpy(np.int64)[:1], terms)
            for k, number in enumerate(numbers.tolist()):
                cols = np.flatnonzero((tile[k] > 0) & (p[k] > q))
                gain = (p[k] - q)[cols]
                best = np.lexsort((cols, -gain))[:top]
                out.append(pd.DataFrame({"part": "term", "one": number, "other": -1, "col": cols[best], "value": gain[best]}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("part", "one", "other", "col", "value")})
        return found.assign(lang=lang, block=rows["block"].iloc[0])

    return work


def audit_sources(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, term_block: int = TERM_BLOCK, group_block: int = GROUP_BLOCK
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (other source or term), value, rank from 1 within a group and part."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch(term_counts(docs), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    kept = kept.drop("docs").join(sizes, "lang").withColumn("blocks", F.ceil(F.col("terms") / term_block).cast("int"))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    terms = scratch(kept.withColumn("col", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "kept-terms")
    blocks = terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"), F.first("terms").alias("terms"), F.first("total").alias("total"))

    cells = scratch(counts.join(terms.select("lang", "term", "block", "col"), ["lang", "term"]).select("lang", "source", "block", "col", "n"), "term-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    named = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["n"])
    groups = scratch(named.withColumn("one", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    last = groups.groupBy("lang").agg(F.floor(F.max("one") / group_block).cast("int").alias("last"))

    def paired(df: DataFrame) -> DataFrame:
        """Each row of a group once for every pair of blocks that its own block takes part in."""
        own = F.floor(F.col("one") / group_block).cast("int")
        every = df.join(last, "lang").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return every.withColumns({"left": F.least(own, "with"), "right": F.greatest(own, "with")}).drop("with", "last")

    heads = paired(groups.join(blocks.drop("total"), "lang", "left").fillna(0, ["block", "width", "terms"])).select(*_HEAD, F.lit(0).alias("kind"), "one", F.lit(-1).alias("col"), "n", "width", "terms")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("terms", "long"))]
    filled = paired(cells.join(groups.select("lang", "source", "one"), ["lang", "source"])).select(*_HEAD, F.lit(1).alias("kind"), "one", "col", "n", *empty)
    diagonal = last.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("last")))).select("lang", "left", F.col("left").alias("right"))
    sums = diagonal.join(blocks, "lang").select(*_HEAD, F.lit(2).alias("kind"), F.lit(-1).alias("one"), F.lit(-1).alias("col"), F.col("total").alias("n"), *empty)
    whole = diagonal.join(terms.drop("terms"), "lang").select(*_HEAD, F.lit(3).alias("kind"), F.lit(-1).alias("one"), "col", "n", *empty)
    tiles = heads.unionByName(filled).unionByName(sums).unionByName(whole).withColumn("group_block", F.lit(group_block))
    parts = scratch(tiles.groupBy(*_HEAD).applyInPandas(tile_parts(top), "lang string, block int, part string, one int, other int, col int, value long"), "tile-parts")

    half = parts.where("part = 'pair'").groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = half.select("lang", "value", F.explode(F.array(F.struct("one", "other"), F.struct(F.col("other").alias("one"), F.col("one").alias("other")))).alias("way"))
    numbers = groups.select("lang", "source", "one")
    named_pairs = ways.select("lang", "value", "way.*").join(numbers, ["lang", "one"]).join(numbers.select("lang", F.col("source").alias("item"), F.col("one").alias("other")), ["lang", "other"])
    pairs = named_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    heaps = parts.where("part = 'term'").select("lang", "block", "one", "col", "value").join(terms.select("lang", "block", "col", F.col("term").alias("item")), ["lang", "block", "col"])
    best = heaps.join(numbers, ["lang", "one"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, best)]
    found = scratch(ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)), "divergence")
    scratch.clear(found)
    return found
