"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes, and which tokens they link.

A is a byte-level BPE over blank + text, B a BPE of pieces over text, to which it adds the blank.  For a text, the ends of the B tokens are a static
interval index; bisecting it with the borders of each A token gives the run of B tokens that it overlaps.  The gap behind an A token is spanned
where that run and the next one's share a B token; gaps never spanned become group boundaries.  All A-B pairs of occurrences in a group are links.
The count of an id pair is the number of documents, corpus-wide, that hold it linked.

Every run of blanks and newlines starts a group, and so does an ASCII sign behind a Latin letter: A's pre-tokenizer cuts there, and no piece of B joins
the two (checked on its vocabulary).  So a text is cut at these places and each distinct segment is tokenised and aligned once a
worker (short ones are kept in a bounded cache).  Texts with other white space, or for vocabularies that fail the check all texts, are one segment.

1. Tasks align their documents and write sizes, digest and distinct linked pairs with the number of their links: texts are tokenised once.
2. One aggregate over these pairs gives their counts, another each A id's highest.
3. The most frequent pairs, at most ``most_sent``, are chosen by a histogram of counts and go to every task, where each document's links are summed.
   Links of other pairs, all rare ones, are joined to their counts by pair, and their sums to the documents.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and ''.  Every row is a document of its own,
repeated ids included.  A group of n A and m B tokens has n * m links, which are multiplied and not listed; only its distinct id pairs are.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import fast_words
from .storage import Scratch

MOST_SENT = 1_000_000
CACHE_SEGMENTS, CACHE_CHARS = 150_000, 64
"""A worker keeps the segments of at most so many characters in two halves of so many; a full half replaces the older one."""
MOST_LISTED = 64
"""Links of a group that are listed one by one; where there are more, equal ids are counted first."""
CHUNK = 256
"""Documents whose new segments are tokenised together."""

_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_JOINED = re.compile(f"[{_LETTER}][{_SIGN}]")
_SEGMENT = re.compile(rf"[ \n]*(?:[^ \n{_LETTER}]+|[{_LETTER}]+(?![{_SIGN}]))*[{_LETTER}]?")
_OTHER_SPACE = re.compile(r"[^\S \n]|\u180e")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def segments_of(text: str) -> list[str]:
    """Blank + text, cut before runs of blanks and newlines and before signs behind a letter."""
    return _SEGMENT.findall(" " + text)[:-1]  # the last match is the empty one at the end


def groups_of(a_ends: Sequence[int], b_ends: Sequence[int]) -> list[tuple[int, int]]:
    """First A and first B token of each group, from the ends of the tokens' byte ranges (both cover the same bytes from 0 on)."""
    out = [(0, 0)]
    for i, end in enumerate(a_ends[:-1], 1):
        last = bisect_left(b_ends, end)  # the B token that the A token's last byte stabs
        after = bisect_right(b_ends, end)  # and the one that the next A token's first byte stabs
        if last < after:
            out.append((i, after))
    return out


@dataclass(slots=True, eq=False)
class Segment:
    """Its number of tokens and groups, the groups as text, its linked pairs (a << 32 | b) and how often each stands for a link, where not once."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: list[int]
    times: list[int] | None = None


_N_A, _N_B, _N_GROUPS, _GROUPS, _PAIRS, _TIMES = map(attrgetter, ("n_a", "n_b", "n_groups", "groups", "pairs", "times"))


class Aligner:
    """Both tokenizers and the segments aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens, self.fast = True, fast_words(path_a)
        table = byte_level()
        self.bytes_a = {k: bytes(map(table.__getitem__, x)) for x, k in self.a.get_vocab().items() if all(c in table for c in x)}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        self.sizes_a, self.sizes_b = np.zeros(1 + max(self.bytes_a), np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        self.sizes_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        own = [x for k, x in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        self.by_segment = not any("▁" in x.lstrip("▁") or "\n" in x or _JOINED.search(x) for x in own)
        self.lead = len(self.b.encode("\n"))
        self.new: dict[str, Segment | None] = {}
        self.old: dict[str, Segment | None] = {}

    def _align(self, a: list[int], b: list[int], raw: bytes) -> Segment | None:
        """One part; equal ids of a group are counted before they are paired."""
        own_a, own_b = [self.bytes_a[k] for k in a], [self.bytes_b[k] for k in b]
        if b"".join(own_a) != raw or b"".join(own_b) != raw:
            return None
        starts = groups_of(list(accumulate(map(len, own_a))), list(accumulate(map(len, own_b))))
        links, named = Counter(), []
        for (i, k), (j, m) in zip(starts, [*starts[1:], (len(a), len(b))], strict=True):
            named.append(f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}")
            right = Counter(b[k:m]).items()
            for x, n in Counter(a[i:j]).items():
                for y, p in right:
                    links[x << 32 | y] += n * p
        return Segment(len(a), len(b), len(named), ";".join(named), list(links), list(links.values()))

    def _align_all(self, texts: list[str], found_a: list[list[int]], found_b: list[list[int]]) -> list[Segment | None]:
        """Many short parts as one run of bytes, in which each part's end is an end of both tokenizers' tokens."""
        raws = [x.encode() for x in texts]
        flat = [list(chain.from_iterable(x)) for x in (found_a, found_b)]
        whole, odd = b"".join(raws), False
        for ids, table in zip(flat, (self.bytes_a, self.bytes_b), strict=True):
            odd |= b"".join([table[k] for k in ids]) != whole
        if odd or not texts:
            return [self._align(*x) for x in zip(found_a, found_b, raws, strict=True)]
        a, b = (np.array(x, np.int64) for x in flat)
        a_ends, b_ends = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        last, after = np.searchsorted(b_ends, a_ends, "left"), np.searchsorted(b_ends, a_ends, "right")
        last_a = np.flatnonzero(last < after)  # the A tokens behind which a group ends
        last_b = last[last_a]
        first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (last_a, last_b))
        n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
        bounds = [np.concatenate([[0], np.cumsum([len(x) for x in found])]) for found in (found_a, found_b)]
        own = np.searchsorted(first_a, bounds[0])  # the first group of each part, and one more
        large = np.flatnonzero(n_a * n_b > MOST_LISTED)
        weight = np.where(n_a * n_b > MOST_LISTED, 0, n_a * n_b)
        ends = np.concatenate([[0], np.cumsum(weight)])
        group = np.repeat(np.arange(len(weight)), weight)
        within = np.arange(ends[-1]) - ends[group]
        pairs = (a[first_a[group] + within // n_b[group]] << 32 | b[first_b[group] + within % n_b[group]]).tolist()
        left, right = flat
        named = [f"{left[i]}|{right[k]}" if n == m == 1 else f"{','.join(map(str, left[i:i + n]))}|{','.join(map(str, right[k:k + m]))}" for i, k, n, m in zip(first_a.tolist(), first_b.tolist(), n_a.tolist(), n_b.tolist(), strict=True)]
        at, cut = own.tolist(), ends[own].tolist()
        out: list[Segment | None] = [
            Segment(len(x), len(y), h - g, ";".join(named[g:h]), pairs[p:q])
            for x, y, g, h, p, q in zip(found_a, found_b, at[:-1], at[1:], cut[:-1], cut[1:], strict=True)
        ]
        for k in np.unique(np.searchsorted(own, large, "right") - 1).tolist():
            out[k] = self._align(found_a[k], found_b[k], raws[k])
        return out

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids; of Latin parts by the same vocabulary's rank file, where one lies beside it."""
        if self.fast is None:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        out = [self.fast(x) if x.isascii() or max(x) < "\u0250" else None for x in texts]
        other = [k for k, x in enumerate(out) if x is None]
        for k, found in zip(other, self.a.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def _learn(self, texts: set[str]) -> list[str]:
        """Have ``new`` hold these distinct parts, each of which starts where a group does; returns those that are too long to stay."""
        if len(self.new) >= CACHE_SEGMENTS:
            self.old, self.new = self.new, {}
        missing = texts - self.new.keys()
        again = missing & self.old.keys()
        self.new.update((x, self.old[x]) for x in again)
        rest = list(missing - again)
        # behind a newline a part is tokenised as within a text; the leading ids are the newline's
        found_b = self.b.encode(["\n" + x for x in rest], num_threads=1)
        self.new.update(zip(rest, self._align_all(rest, self._ids_a(rest), [x[self.lead :] for x in found_b]), strict=True))
        return [x for x in rest if len(x) > CACHE_CHARS]

    def texts(self, texts: list[str | None]) -> list[list[Segment]]:
        """The segments of each text in order; none where it has no tokens."""
        cut = [None if not t or not self.by_segment or _OTHER_SPACE.search(t) else segments_of(t) for t in texts]
        long = self._learn(set(chain.from_iterable(filter(None, cut))))
        known, out = self.new.__getitem__, []
        for text, own in zip(texts, cut, strict=True):
            if own is not None:
                found = list(map(known, own))
            elif text:
                found = [self._align(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode())]
            else:
                found = []
            out.append([] if None in found else found)
        for x in long:
            del self.new[x]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, kept from task to task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_TOTALS = (*_SIZES, "n_best", "count_sum")


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, sizes, groups_sha256, the distinct linked pairs with their links and, if asked for, groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for part in batches:
            for k in range(0, part.num_rows, CHUNK):
                ids, texts = (c.to_pylist() for c in part.slice(k, CHUNK).columns)
                out, pairs, links, ends = [], [], [], [0]
                for key, segments in zip(ids, tool.texts(texts), strict=True):
                    sizes = [sum(map(of, segments)) for of in (_N_A, _N_B, _N_GROUPS)]
                    total = Counter(chain.from_iterable(map(_PAIRS, segments)))
                    for segment in filter(_TIMES, segments):
                        for pair, n in zip(segment.pairs, segment.times, strict=True):
                            total[pair] += n - 1
                    named = ";".join(map(_GROUPS, segments))
                    digest = hashlib.sha256(named.encode()).hexdigest() if segments else ""
                    out.append((key, *sizes, sum(total.values()), digest, named))
                    pairs += total.keys()
                    links += total.values()
                    ends.append(len(pairs))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, links)]
                yield pa.RecordBatch.from_arrays([*columns[:6], *lists, *columns[6:][:with_groups]], ["doc_id", *_SIZES, "groups_sha256", "pairs", "links"] + ["groups"] * with_groups)

    return docs.mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>" + ", groups string" * with_groups)


def _least_sent(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least count of the pairs to send, so that at most ``most`` are sent; and whether these are all.

    The histogram has under 400 steps: counts, beyond 16 rounded down to 5 binary digits.
    """
    step = F.floor(F.log2("n")).cast("int") - 4
    unit = F.when(step > 0, F.pow(F.lit(2.0), step)).otherwise(1.0)
    steps = counts.groupBy((F.floor(F.col("n") / unit) * unit).cast("long").alias("least")).count().collect()
    total, least = 0, math.inf
    for row in sorted(steps, key=lambda r: -r["least"]):
        if (total := total + row["count"]) > most:
            return least, False
        least = row["least"]
    return least, True


def align_corpus(docs: DataFrame, path_a: str, path_b: str, most_sent: int = MOST_SENT, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    Groups are written ``a1,a2|b1;a3|b2,b3``: ids of A and B in order.  n_best counts links whose pair has its A id's highest count,
    count_sum adds the pairs' counts over all links.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    found = aligned(docs.select(F.col("doc_id").cast("long"), "text"), path_a, path_b, with_groups)
    first = scratch(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counted = scratch(first.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    best = counted.groupBy("a").agg(F.max("n").alias("best"))
    counts = scratch(counted.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")), "pair-best")
    scratch.drop(counted)
    least, all_sent = _least_sent(counts, most_sent)
    sent = counts.where(F.col("n") >= (least if least < math.inf else 2**62)).sort("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(sent.column(c).to_numpy() for c in ("pair", "n", "is_best")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, is_best = shared.value
        for part in batches:
            offsets, pairs = part.column("pairs").offsets.to_numpy(), part.column("pairs").values.to_numpy()
            links = part.column("links").values.to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            known = at * hit
            value = np.where(hit, n[known], 0) * links if len(keys) else np.zeros(len(pairs), np.int64)
            top = np.where(hit & is_best[known], links, 0) if len(keys) else value
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (top, value)]
            ends = np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(x[offsets[0] : offsets[-1]][~hit[offsets[0] : offsets[-1]]])) for x in (pairs, links)]
            kept = [part.column(c) for c in (*own, *more)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *rest], [*own, *more, "n_best", "count_sum", "pairs", "links"])

    own, more = ("row", "doc_id", *_SIZES, "groups_sha256"), ("groups",) * with_groups
    columns = ["doc_id", *_TOTALS, "groups_sha256", *more]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * with_groups
    summed = first.select(*own, *more, "pairs", "links").mapInArrow(rows, schema + ", n_best long, count_sum long, pairs array<long>, links array<long>")
    if all_sent:
        result = scratch(summed.select(columns), "alignment")
        scratch.clear(result)
        return result
    partly = scratch(summed, "partly-summed")
    rare = partly.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
    left = rare.join(counts.where(F.col("n") < least).withColumnRenamed("pair", "pairs"), "pairs").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    both = partly.drop("pairs", "links").join(left, "row", "left").fillna(0, ["more_best", "more_sum"])
    both = both.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    result = scratch(both.select(columns), "alignment")
    scratch.clear(result)
    return result
