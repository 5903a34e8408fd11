"""Benchmark decontamination by spaced-seed hashing.

A mask of ones and zeros slides over the tokens (lower-cased runs of letters and digits); the hash of a window takes the
tokens under ones only, so a changed token under a zero leaves the hash as it is.  Test windows and training windows
are joined on (mask, hash); each hit fixes a diagonal between an item and a document, and the overlap along that
diagonal is verified token by token: a document is contaminated when a stretch of at least ``MIN_OVERLAP`` tokens (the
whole item if that is shorter) agrees in ``MIN_AGREEMENT`` or more of its tokens.

The benchmark's size is measured first.  It goes to the tasks in blocks of about ``BLOCK_CHARS`` / 2 characters, every block
against all documents, so what the driver and a task hold is bounded; the join itself is a sorted search in each task.  With several
blocks, each one's overlaps are written before the next is read, and joined to the documents by two 64-bit hashes of the text.
The masks hit every stretch of ``MIN_OVERLAP`` to 25 tokens that agrees enough, whatever tokens differ, and so every longer one, which holds
such a stretch.  Shorter items are sought as a whole by masks of their own length, down to one token; under five tokens only exactly.

Null and empty texts have no tokens and are clean; null and empty items match nothing.  Very long texts are read
whole.  Repeated rows are judged alike, an empty table gives an empty result, and with an empty benchmark all are clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .storage import Scratch
from .textvec import BYTE, constants, mix, slices, word_hashes, word_starts

# The masks.
MASKS = ("111010011011", "110110101011", "101111001101", "111111", "1110111", "1101011001")
MIN_OVERLAP = 13
MIN_AGREEMENT = 0.8
BLOCK_CHARS = 8 << 20

_other = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_fold = np.arange(256)
_fold[65:91] += 32
_VALUES = np.where(_other, np.uint64(0), BYTE[_fold])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and where each text's begin."""
    starts, first = word_starts(data, offsets, _other)
    return word_hashes(data, starts, _VALUES), first


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position of the token run."""
    m = len(hashes) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    key = constants(len(mask), 100 + int(mask, 2))
    out = np.zeros(m, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + m] * key[k]
    return mix(out)


def short_masks(length: int) -> list[str]:
    """Masks as long as a short item, of which one is zero wherever ``length`` // 5 tokens may differ."""
    n_parts, n_zero = ((1, 0), (3, 1), (4, 2))[length // 5]
    return ["".join("0" if i * n_parts // length in zero else "1" for i in range(length)) for zero in combinations(range(n_parts), n_zero)]


def masks_for(lengths: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[tuple[str, int]]:
    """(mask, length of the items it is for): the masks, for all items (0), and those of each length under ``MIN_OVERLAP`` that occurs."""
    short = sorted(set(lengths[(lengths > 0) & (lengths < MIN_OVERLAP)].tolist()))
    return [(m, 0) for m in masks] + [(m, n) for n in short for m in short_masks(n)]


@dataclass
class Block:
    """The seeds of some items: sorted hashes with item and position, and the items' tokens."""

    ids: list
    hashes: np.ndarray
    first: np.ndarray
    masks: tuple[str, ...]
    keys: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]


FILTER_BITS = 20


def block_of(items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS) -> Block:
    column = pa.array([t or "" for _, t in items], pa.large_string())
    data = np.frombuffer(column.cast(pa.large_binary()).buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(items) + 1]
    hashes, first = tokens(data, offsets)
    chosen = masks_for(np.diff(first), masks)
    keys, places, filters = [], [], []
    for mask, length in chosen:
        own = seeds(hashes, mask)
        at = np.concatenate([np.arange(a, max(a, b - len(mask) + 1)) for a, b in zip(first[:-1], first[1:], strict=True) if length in (0, b - a)] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(own[at], kind="stable")
        keys.append(own[at][order])
        places.append(at[order])
        table = np.zeros(1 << FILTER_BITS, bool)
        table[(keys[-1] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        filters.append(table)
    return Block([i for i, _ in items], hashes, first, tuple(m for m, _ in chosen), keys, places, filters)


def longest_agreement(same: np.ndarray, least: float = MIN_AGREEMENT) -> int:
    """The length of the longest stretch with a share ``least`` or more of agreeing tokens."""
    gain = np.concatenate([[0.0], np.cumsum(same - least)])
    low = np.minimum.accumulate(gain)
    # the earliest start whose running sum is not above the end's
    at = np.searchsorted(-low, -(gain + 1e-9), "left")
    return int((np.arange(len(gain)) - np.minimum(at, np.arange(len(gain)))).max())


def overlaps(block: Block, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, overlapping tokens) of all texts whose overlap with an item suffices."""
    texts_of, diagonals = [], []
    for mask, keys, places, table in zip(block.masks, block.keys, block.places, block.filters, strict=True):
        own = seeds(hashes, mask)
        at = np.flatnonzero(table[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(keys):
            continue
        low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
        at, low, many = at[high > low], low[high > low], (high - low)[high > low]
        text = np.searchsorted(first, at, "right") - 1
        fits = at + len(mask) <= first[text + 1]
        at, low, many, text = at[fits], low[fits], many[fits], text[fits]
        place = places[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        texts_of.append(np.repeat(text, many))
        diagonals.append(np.stack([np.searchsorted(block.first, place, "right") - 1, np.repeat(at, many) - place], 1))
    if not texts_of:
        return []
    found = np.unique(np.column_stack([np.concatenate(texts_of), np.concatenate(diagonals)]), axis=0)
    best: dict[tuple[int, int], int] = {}
    for text, item, shift in found.tolist():
        a, b = block.first[item], block.first[item + 1]
        low, high = max(a, first[text] - shift), min(b, first[text + 1] - shift)
        n = longest_agreement(block.hashes[low:high] == hashes[low + shift : high + shift])
        if n >= min(MIN_OVERLAP, b - a):
            best[text, item] = max(n, best.get((text, item), 0))
    return [(t, i, n) for (t, i), n in best.items()]


def _ids(benchmark: DataFrame) -> str:
    """Item ids are kept as longs where they are whole numbers, else as text."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | str | None, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    size = F.length("text") + 64
    rows = benchmark.select(F.col("item_id").cast(_ids(benchmark)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = int(total // (block_chars // 2)) + 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.distinct().collect()]


def find_overlaps(docs: DataFrame, items: list[tuple], ids: str = "long", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per input row: its columns but text, with n_tokens, items (array of item ids) and overlap_tokens (the longest)."""
    block = block_of(items, masks)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in docs.columns if c != "text"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for part in batches:
            n_tokens, found, longest = np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)], np.zeros(part.num_rows, np.int64)
            for i, j, data, offsets in slices(part.column("text")):
                hashes, first = tokens(data, offsets)
                n_tokens[i:j] = np.diff(first)
                for text, item, n in overlaps(block, hashes, first):
                    found[i + text].append(block.ids[item])
                    longest[i + text] = max(longest[i + text], n)
            columns = [part.column(c) for c in kept] + [pa.array(n_tokens), pa.array([sorted(x, key=lambda v: (v is None, v or type(v)())) for x in found], pa.list_(pa.int64() if ids == "long" else pa.string())), pa.array(longest)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "items", "overlap_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept, "text").mapInArrow(search, f"{fields}, n_tokens long, items array<{ids}>, overlap_tokens long")


def _by_text(docs: DataFrame, benchmark: DataFrame, block_chars: int, first: list[tuple], rest: Iterator[list[tuple]]) -> DataFrame:
    """(t1, t2, items, overlap_tokens) of the texts that overlap, by two hashes of the text; each block's are written before the next is read."""
    scratch, ids = Scratch(docs.sparkSession), _ids(benchmark)
    hashed = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    found = [scratch(find_overlaps(hashed, part, ids).filter(F.size("items") > 0).drop("n_tokens").dropDuplicates(["t1", "t2"]), "overlaps") for part in chain([first], rest)]
    return reduce(DataFrame.unionByName, found).groupBy("t1", "t2").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"), F.max("overlap_tokens").alias("overlap_tokens"))


def judge_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, contaminated, items (their ids, text unless whole numbers) and overlap_tokens of every row of (doc_id, text)."""
    slim, parts, ids = docs.select("doc_id", "text"), blocks(benchmark, block_chars), _ids(benchmark)
    first, second = next(parts), next(parts, None)
    if second is None:
        found = find_overlaps(slim, first, ids)
    else:
        hits = _by_text(slim, benchmark, block_chars, first, chain([second], parts))
        none = find_overlaps(slim.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}), [], ids).drop("items", "overlap_tokens")
        zero = F.coalesce("overlap_tokens", F.lit(0).cast("long")).alias("overlap_tokens")
        found = none.join(hits, ["t1", "t2"], "left").select("doc_id", "n_tokens", F.coalesce("items", F.array().cast(f"array<{ids}>")).alias("items"), zero)
    return found.select("doc_id", "n_tokens", (F.size("items") > 0).alias("contaminated"), "items", "overlap_tokens")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without an overlap; columns stay as they are."""
    parts = blocks(benchmark, block_chars)
    first, second = next(parts), next(parts, None)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text = docs.toDF(*names), names[docs.columns.index("text")]
    if second is None:
        found = find_overlaps(plain.withColumn("text", F.col(text)), first, _ids(benchmark)).filter(F.size("items") == 0)
    else:
        hits = _by_text(docs, benchmark, block_chars, first, chain([second], parts)).select("t1", "t2")
        found = plain.join(hits, (F.xxhash64(text) == F.col("t1")) & (F.xxhash64(F.lit(1), text) == F.col("t2")), "left_anti")
    return found.select(*names).toDF(*docs.columns)
