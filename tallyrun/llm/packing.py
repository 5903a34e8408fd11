"""Packing by power-of-two decomposition: pieces of binary length, one piece a sequence.

A document of n ids is cut into as many pieces of ``max_length`` as fit, then into one piece for every set bit of the
rest, longest first.  Sequences are grouped into buckets of one length each, so a batch of a bucket needs no padding, and no
sequence holds ids of two documents.  Each task tokenises its own rows; nothing is shuffled.

A null text is empty; an empty text is the closing id alone.  Very long texts are tokenised whole.  Rows are independent: repeated
rows give repeated pieces in sequences of their own, an empty table an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import BYTE, constants, mix, slices, word_hashes, word_starts

MAX_LENGTH = 2048
END_ID = 1
CACHE_WORDS = 2_000_000
"""Words whose ids a worker keeps; when there are more, it starts anew."""

_BORDER = np.zeros(256, bool)
_BORDER[[0x20, 0x0A]] = True
_VALUES = np.where(_BORDER, np.uint64(0), BYTE)
_KINDS = constants(256, 77)
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# White space outside ASCII, and the start of a special token.
_ODD_STRINGS = tuple(map(str.encode, ["\x85", "\xa0", "\u1680", "\u180e", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "<|"]))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class HashTable:
    """64-bit keys to 64-bit values, looked up and filled whole arrays at a time (open addressing)."""

    def __init__(self, most: int):
        self.bits = max(10, int(2 * most - 1).bit_length())
        self.keys, self.values, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64), 0

    def _probe(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + k) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none.  Keys are not 0."""
        at = self._probe(keys, 0)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left, k = np.flatnonzero((found != keys) & (found != 0)), 1
        while len(left):
            at = self._probe(keys[left], k)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, k = left[~hit & (found != 0)], k + 1
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        self.n += len(keys)
        k = 0
        while len(keys):
            at = self._probe(keys, k)
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, k = keys[~done], values[~done], k + 1


class WordCache:
    """Ids of whole texts from a byte-level BPE tokenizer, each distinct word tokenised once.

    The pre-tokenizer never joins characters across a blank or newline that stands alone between two others, so a text is the
    concatenation of its words, each with the blank or newline before it.  Words are known by a 64-bit hash.  Texts with
    other white space, with white space at an end or side by side, or with a special token go through the tokenizer whole.
    New words of Latin letters are tokenised by ``words``, where given: a faster function of the same ids.
    """

    def __init__(self, path: str, most_words: int = CACHE_WORDS, words: Callable[[str], list[int]] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.words = Tokenizer.from_file(path), most_words, words
        self.forget()

    def forget(self) -> None:
        self.table, self.flat, self.used = HashTable(self.most_words), np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _irregular(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Indexes of the texts that must be tokenised whole."""
        border = _BORDER[data]
        bad = [np.flatnonzero(border[1:] & border[:-1]) + 1, np.flatnonzero(_ODD[data])]
        full = np.flatnonzero(np.diff(offsets))
        bad += [e[border[e]] for e in (offsets[full], offsets[full + 1] - 1)]
        for i in np.flatnonzero(_LEADS[data]).tolist():
            if data[i : i + 3].tobytes().startswith(_ODD_STRINGS):
                bad.append(np.array([i]))
        return np.unique(np.searchsorted(offsets, np.concatenate(bad), "right") - 1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, hashes: np.ndarray) -> None:
        new, first = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        texts = [raw[s - k : e].decode() for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), (lead[first] > 0).tolist(), strict=True)]
        if self.words is None:
            ids = self._ids(texts)
        else:
            ids = [self.words(x) if max(x) < "\u0250" else None for x in texts]
            other = [k for k, x in enumerate(ids) if x is None]
            for k, own in zip(other, self._ids([texts[k] for k in other]), strict=True):
                ids[k] = own
        n = np.array([len(x) for x in ids])
        at = np.cumsum(n) - n + self.used
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, n.sum())
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.put(new, at << 24 | n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a batch."""
        starts, first = word_starts(data, offsets, _BORDER)
        if not len(starts):
            starts, hashes, lead = starts, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        else:
            lead = data[np.maximum(starts - 1, 0)]
            lead[first[:-1][(np.diff(first) > 0) & (starts[np.minimum(first[:-1], len(starts) - 1)] == offsets[:-1])]] = 0
            hashes = mix(word_hashes(data, starts, _VALUES) ^ _KINDS[lead]) | np.uint64(1)
        whole = self._irregular(data, offsets)
        used = np.ones(len(starts), bool)
        for k in whole:
            used[first[k] : first[k + 1]] = False
        if self.table.n + len(starts) > self.most_words:
            self.most_words = max(self.most_words, len(starts))
            self.forget()
        place = self.table.get(hashes)
        known = place >= 0
        if (new := np.flatnonzero(used & ~known)).size:
            borders = np.flatnonzero(_BORDER[data])
            stop = np.searchsorted(borders, starts[new])
            text_end = offsets[np.searchsorted(offsets, starts[new], "right")]
            ends = np.minimum(np.append(borders, len(data))[stop], text_end)
            self._learn(data, starts[new], ends, lead[new], hashes[new])
            place[new] = self.table.get(hashes[new])
        place = place[used]
        n = place & 0xFFFFFF
        total = np.cumsum(n)
        ids = self.flat[np.repeat((place >> 24) - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(used)])[first]]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(whole):
            raw = data.tobytes()
            for k, own in zip(whole.tolist(), self._ids([raw[offsets[k] : offsets[k + 1]].decode() for k in whole]), strict=True):
                out[k] = np.array(own, np.uint32)
        return out


_CACHES: dict[str, WordCache] = {}


def fast_words(path: str) -> Callable[[str], list[int]] | None:
    """The ids of a word by the rank file of the same vocabulary, where one lies beside the tokenizer's."""
    import base64
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def word_cache(path: str) -> WordCache:
    """The worker's cache, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CACHES:
        _CACHES[path] = WordCache(path, words=fast_words(path))
    return _CACHES[path]


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """As many ``max_length`` as fit in n, then the powers of two of the rest, longest first."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids.

    ``max_length`` is a power of two.  A piece fills its sequence, so offset is 0; bucket is the sequence's length.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        end = np.array([end_id], "<u4")
        for part in batches:
            for i, j, data, offsets in slices(part.column(1)):
                rows, owns = [], []
                for key, found in zip(part.column(0).slice(i, j - i).to_pylist(), cache.encode(data, offsets), strict=True):
                    ids = np.concatenate([found, end]).astype("<u4")
                    at, n = 0, len(ids)
                    for length in piece_lengths(n, max_length):
                        own = ids[at : at + length]
                        rows.append((key, at, length, zlib.crc32(own), n))
                        if with_ids:
                            owns.append(own.astype(np.int32))
                        at += length
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array(owns, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = _SCHEMA + ", ids array<int>" * with_ids
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)
    return found.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})
