"""Line deduplication: sharded minimal perfect hashes over the hashes of repeated lines, probed by the documents.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points found in at
least ``min_docs`` documents lose all their lines but those of the largest doc_id that holds them.

1. Each task hashes its documents' distinct keys to 128 bits; one aggregate with partial sums counts documents and finds the
   largest doc_id of each key.  Only keys of enough documents go on: no other line can be dropped.
2. The first 64 bits deal these keys to shards of about ``shard_keys`` keys.  A shard's perfect hash (levels of bit
   arrays, 3 to 4 bits a key) numbers its keys without gaps; that number indexes a fingerprint array (the other 64
   bits), a count array (in the narrowest integers that hold the shard's counts) and an array of the keeping ids.
3. Documents probe the arrays.  Where all arrays together measure at most ``broadcast_bytes`` they go to every task, and no line is
   shuffled.  Beyond that the probes (hashes, not lines) are dealt to the shards, each shard's arrays streaming in
   before its probes; a shard is copied as often as the documents that hold its keys demand, so a line of a third of all
   documents is spread over many tasks.  Both ways give the same rows.

Two different keys are taken for one with a chance of about 2**-128 a pair, a key outside the arrays for one inside with 2**-64 a probe.
A null text is empty and has one empty line.  Every row is a document of its own; rows that share a doc_id share its decision.  A null
doc_id is below all others.  Rows are judged on the input; an empty table gives an empty result.  Lines may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .textvec import constants, mix

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 17
BROADCAST_BYTES = 64 << 20
COPY_LOAD = 1 << 20
"""A shard beyond the broadcast bound is copied once more for every so many documents that hold its keys."""

WHITE = " \t\n\x0b\x0c\r"
GAMMA, LEVELS = 2.0, 40
_SEEDS = constants(LEVELS, 131)
ARRAYS = "n_keys long, sizes array<long>, bits binary, fingerprints binary, counts binary, count_type string, keepers binary, twins binary"


class PerfectHash:
    """Numbers n distinct 64-bit keys from 0 to n - 1.

    On each level the keys left fall on a bit array of twice their number; those alone on their bit are settled there, and a key's
    number is the rank of its bit among all levels' bits.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = mix(keys ^ _SEEDS[len(sizes)]) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or any number for keys outside."""
        out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(keys[left] ^ _SEEDS[level]) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            held = self.words[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left, base = left[~hit], base + size // 64
        return out


class Shard:
    """A shard's perfect hash with its arrays."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["sizes"], np.frombuffer(row["bits"], "<u8"))
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u8")
        self.counts = np.frombuffer(row["counts"], row["count_type"])
        self.keepers = np.frombuffer(row["keepers"], "<i8")
        self.twins = np.frombuffer(row["twins"], "<u8")

    def dropped(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes (two hash words and the document's id) find a key of enough documents that another document keeps."""
        at = self.hash.numbers(first)
        at[at >= 0] = np.where(self.fingerprints[at[at >= 0]] == second[at >= 0], at[at >= 0], -1)
        for k, twin in enumerate(self.twins, len(self.fingerprints) - len(self.twins)):
            at[(first == twin) & (second == self.fingerprints[k])] = k
        inside = np.flatnonzero(at >= 0)
        out = np.zeros(len(first), bool)
        out[inside] = (self.counts[at[inside]] >= min_docs) & (self.keepers[at[inside]] != ids[inside])
        return out


NULL_ID = np.iinfo(np.int64).min
"""Stands for a null doc_id inside the arrays: below all others, as the rule wants."""


def build_shard(table: pa.Table) -> pa.Table:
    """The arrays of one shard's keys.  Keys that share their first 64 bits with another one stand behind the numbered ones, as ``twins``."""
    first, second, n, keeper = (np.asarray(table.column(c).to_numpy()) for c in ("first", "second", "n", "keeper"))
    first, second = first.astype(np.int64).view("<u8"), second.astype(np.int64).view("<u8")
    numbered, at_first = np.unique(first, return_index=True)
    twins = np.setdiff1d(np.arange(len(first)), at_first)
    held = PerfectHash.of(numbered)
    at = held.numbers(first)
    at[twins] = len(numbered) + np.arange(len(twins))
    kind = np.min_scalar_type(int(n.max())).newbyteorder("<")
    arrays = [np.zeros(len(first), t) for t in ("<u8", kind, "<i8")]
    for array, values in zip(arrays, (second, n, keeper), strict=True):
        array[at] = values
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "copies": pa.array([1 + int(n.sum()) // COPY_LOAD], pa.int64()),
        "n_keys": pa.array([len(first)], pa.int64()), "sizes": pa.array([held.sizes], pa.list_(pa.int64())), "bits": pa.array([held.words.tobytes()], pa.binary()),
        "fingerprints": pa.array([arrays[0].tobytes()], pa.binary()), "counts": pa.array([arrays[1].tobytes()], pa.binary()), "count_type": pa.array([kind.str]),
        "keepers": pa.array([arrays[2].tobytes()], pa.binary()), "twins": pa.array([first[twins].tobytes()], pa.binary()),
    })


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and the hash of each one's key, None where the key is too short to count."""
    lines = (text or "").split("\n")
    keys = [x.strip(WHITE) for x in lines]
    return lines, [xxhash.xxh3_128_digest(k.encode().lower()) if len(k) >= min_chars else None for k in keys]


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and distinct key that counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(0, part.num_rows, 1024):
                piece = part.slice(k, 1024)
                found = [list(dict.fromkeys(h for h in line_keys(t.as_py(), min_chars)[1] if h)) for t in piece.column(1)]
                first, second = _words([h for own in found for h in own])
                ids = np.repeat(_ids(piece.column(0)), [len(own) for own in found])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (first, second, ids)], ["first", "second", "doc_id"])

    return docs.mapInArrow(rows, "first long, second long, doc_id long")


def _cut(docs: DataFrame, min_chars: int, judge) -> DataFrame:
    """Documents without the lines that ``judge`` names: it gets the hash words and ids of a batch's lines that count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(0, part.num_rows, 1024):
                piece = part.slice(k, 1024)
                split = [line_keys(t.as_py(), min_chars) for t in piece.column(1)]
                owner = np.repeat(np.arange(len(split)), [sum(h is not None for h in hashes) for _, hashes in split])
                first, second = _words([h for _, hashes in split for h in hashes if h is not None])
                gone = iter(judge(piece, first, second, owner).tolist())
                texts, counts = [], []
                for lines, hashes in split:
                    kept = [x for x, h in zip(lines, hashes, strict=True) if h is None or not next(gone)]
                    texts.append("\n".join(kept))
                    counts.append((len(lines), len(lines) - len(kept)))
                n, dropped = (pa.array(c, pa.int64()) for c in zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string()), n, dropped], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.mapInArrow(rows, "doc_id long, text string, n_lines long, n_dropped long")


def line_index(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard of the keys found in enough documents: shard, copies and its arrays; and the shard number's bits."""
    counted = _hashed(docs, min_chars).groupBy("first", "second").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    keys = scratch(counted.where(F.col("n") >= min_docs), "line-keys")
    bits = max(0, -(-keys.count() // shard_keys) - 1).bit_length()
    shard = F.shiftrightunsigned("first", 64 - bits) if bits else F.lit(0).cast("long")
    built = keys.withColumn("shard", shard).groupBy("shard").applyInArrow(build_shard, "shard long, copies long, " + ARRAYS)
    return scratch(built, "line-arrays"), bits


def _cut_by_broadcast(docs: DataFrame, index: DataFrame, bits: int, min_chars: int, min_docs: int) -> DataFrame:
    rows = docs.sparkSession.sparkContext.broadcast({r["shard"]: r.asDict() for r in index.collect()})
    shards: dict[int, Shard] = {}

    def judge(piece: pa.RecordBatch, first: np.ndarray, second: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ids, out = _ids(piece.column(0))[owner], np.zeros(len(first), bool)
        at = first >> np.uint64(64 - bits) if bits else np.zeros(len(first), np.uint64)
        for shard in np.unique(at).tolist():
            if shard in rows.value:
                if shard not in shards:
                    shards[shard] = Shard(rows.value[shard])
                own = np.flatnonzero(at == shard)
                out[own] = shards[shard].dropped(first[own], second[own], ids[own], min_docs)
        return out

    return _cut(docs, min_chars, judge)


def _probed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Probes that find a line to drop; each shard's arrays come before its probes."""
    shard = None
    for part in batches:
        at, n = 0, part.num_rows
        marks = np.flatnonzero(part.column("n_keys").is_valid().to_numpy(zero_copy_only=False)).tolist()
        for mark in [*marks, n]:
            if mark > at and shard is not None:
                piece = part.slice(at, mark - at)
                first, second = (piece.column(c).to_numpy().view(np.uint64) for c in ("first", "second"))
                hit = shard.dropped(first, second, piece.column("doc_id").to_numpy(), min_docs)
                yield piece.select(["doc_id", "first", "second"]).filter(pa.array(hit))
            if mark < n:
                shard = Shard(part.slice(mark, 1).to_pylist()[0])
            at = mark + 1


def _cut_by_shards(docs: DataFrame, index: DataFrame, bits: int, min_chars: int, min_docs: int, scratch: Scratch) -> DataFrame:
    shard = F.shiftrightunsigned("first", 64 - bits) if bits else F.lit(0).cast("long")
    copies = scratch(index.select("shard", "copies"), "line-copies")
    probes = _hashed(docs, min_chars).withColumn("shard", shard).join(copies, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id"), "copies").alias("copy"), F.lit(1).alias("kind"), "first", "second", "doc_id")
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), *[x.split()[0] for x in ARRAYS.split(", ")])
    both = probes.unionByName(arrays, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    found = both.mapInArrow(lambda batches: _probed(batches, min_docs), "doc_id long, first long, second long")
    gone = scratch(found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "second")).alias("gone")), "line-drops")
    ids = F.coalesce(docs["doc_id"], F.lit(NULL_ID))
    with_gone = docs.join(gone.withColumnRenamed("doc_id", "held"), F.expr("held") == ids, "left").select(docs["doc_id"], docs["text"], "gone")

    def judge(piece: pa.RecordBatch, first: np.ndarray, second: np.ndarray, owner: np.ndarray) -> np.ndarray:
        sets = [{(x["first"], x["second"]) for x in own or ()} for own in piece.column(2).to_pylist()]
        probes = zip(owner.tolist(), first.view(np.int64).tolist(), second.view(np.int64).tolist(), strict=True)
        return np.array([(a, b) in sets[k] for k, a, b in probes], bool)

    return _cut(with_gone, min_chars, judge)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, text without the dropped lines, n_lines (before dropping), n_dropped."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(docs.sparkSession)
    index, bits = line_index(docs, scratch, min_chars, min_docs, shard_keys)
    measured = [F.octet_length(c) for c in ("bits", "fingerprints", "counts", "keepers")]
    size = index.agg(F.sum(sum(measured[1:], measured[0]))).first()[0] or 0
    if size <= broadcast_bytes:
        found = _cut_by_broadcast(docs, index, bits, min_chars, min_docs)
        scratch.clear()
        return found
    return _cut_by_shards(docs, index, bits, min_chars, min_docs, scratch)
