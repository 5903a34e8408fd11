"""Suffix-array dedup: find every byte of a string of ``length`` bytes that also starts anywhere else.

Suffix sorting by a difference cover, on a parse of the texts.  Sorting triples of single bytes moves about 11 bytes of keys
and positions for every byte of text, so the texts are parsed first: of every ``length``-byte window the least of its
``gram``-byte hashes is its anchor, which depends on the window's bytes alone.  Anchors whose gram occurs once cannot lie in a
repeated window; runs of the others are strings over an alphabet of phrases (anchor to next anchor, with the next gram).

1. Sample the positions of each string that are 1 or 2 modulo 3, sort their triples of phrases and name them by rank.
2. Recurse on the names: triples of names, sorted and named again, up to ``LEVELS`` times (27 phrases) or until all differ.
3. Merge the remaining suffixes (0 modulo 3) with each half of the sample, by (phrase, name of the next suffix) and
   (two phrases, name of the suffix after them), so that every two kinds of suffix meet in one sorted list.
4. Compare adjacent prefixes in these lists.  Equal phrases are equal bytes, so this settles all windows inside a repeated run.

Windows that begin or end between phrases of a run are settled exactly afterwards, by a 128-bit hash of their bytes, counted
over all texts; of texts that agree in a run one takes part for all.  Blocks of such windows whose shared bytes occur once go first,
then those whose bytes, taken together, occur again: they are repeated whole, and one of them takes part for all.

Equal texts are one class from the start: a text of ``length`` bytes or more that has a copy is removed whole.
All sorts are by range with ties broken by position, counts are partial before the shuffle, and a task holds one text at a time.

A null text is empty.  Texts shorter than ``length`` lose nothing.  Very long texts are cut into overlapping pieces for the
anchors only.  Repeated rows are copies.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .textvec import BYTE, constants, mix, slices

LENGTH = 200
GRAM = 64
LEVELS = 3
BLOCK = 16
"""Windows of one anchor are counted in blocks of so many starts first, by the bytes that all of a block share."""
_POSITION_BITS = 24
_BASES = tuple(int(x) for x in constants(2, 61) | np.uint64(5))
_BYTES = (BYTE, constants(256, 99))


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, i < n, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


class Rolling:
    """Hashes of substrings of one byte array from prefix sums."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        n = 1 << max(17, (len(data)).bit_length())
        up, self.down = _powers(_BASES[kind], n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[kind][data] * up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach, now = 1, x
    while reach * 2 <= width:
        now = np.minimum(now[:-reach], now[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, grams: np.ndarray) -> np.ndarray:
    """For each position the anchor of the window that starts there; -1 where no window of the text fits."""
    n = len(data)
    out = np.full(n, -1, np.int64)
    step = (1 << _POSITION_BITS) - 2 * length
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    for begin in range(0, max(0, n - length + 1), step):
        own = grams[begin : begin + step + length - gram]
        ranked = (own & ~mask) | np.arange(len(own), dtype=np.uint64)
        least = _window_min(ranked, length - gram + 1)
        out[begin : begin + len(least)] = begin + (least & mask).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out[np.arange(n) + length > ends] = -1
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(anchor of each window, sorted anchors, their gram hashes, hashes of the bytes)."""
    rolling = Rolling(data)
    grams = rolling.all(gram)
    windows = window_anchors(data, offsets, length, gram, grams)
    marked = np.zeros(len(data) + 1, bool)
    marked[windows] = True
    marked[-1] = False
    at = np.flatnonzero(marked)
    return windows, at, grams[at], rolling


def _parsed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, key (SHA-256), n_bytes, and positions and gram hashes of the anchors of every row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, j, data, offsets in slices(part.column(1)):
                _, at, grams, _ = _anchors(data, offsets, length, gram)
                cuts = np.searchsorted(at, offsets)
                local = (at - np.repeat(offsets[:-1], np.diff(cuts))).astype(np.int32)
                raw = memoryview(data)
                keys = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                cuts = pa.array(cuts, pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (local, grams.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(np.diff(offsets)), *lists], ["doc_id", "key", "n_bytes", "at", "grams"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(parse, "doc_id long, key binary, n_bytes long, at array<int>, grams array<long>")


_PHRASES = "row long, run long, j long, i long, at long, gram long, c long, pre array<long>, ext array<long>"


def _phrases(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per candidate anchor: its run and place i in it, its phrase c (0 where the run ends), and the phrases ``pre``
    that cover all windows starting before the next anchor, with the bytes ``ext`` that so many phrases cover."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ARROW, strict=True)]
            return pa.RecordBatch.from_arrays(columns, [name for name, _ in _ARROW])

        for part in batches:
            rows = []
            for row, text, chosen in zip(part.column("row").to_pylist(), part.column("text"), part.column("chosen"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                _, at, grams, rolling = _anchors(data, np.array([0, len(data)]), length, gram)
                candidate = np.zeros(len(at) + 1, bool)
                candidate[np.array(chosen.as_py(), np.int64)] = True
                own = np.flatnonzero(candidate[:-1] & candidate[1:])
                code = np.zeros(len(at), np.uint64)
                code[own] = rolling.of(at[own], at[own + 1] + gram) | np.uint64(1)
                codes, places, hashes = code.view(np.int64).tolist(), at.tolist(), grams.view(np.int64).tolist()
                run = i = -1
                for j in np.flatnonzero(candidate[:-1]).tolist():
                    if j and candidate[j - 1]:
                        i += 1
                    else:
                        run, i = run + 1, 0
                    pre, ext, t = [], [], j
                    if codes[j]:
                        least = places[j + 1] - places[j] + length - 1
                        while codes[t] and (not ext or ext[-1] < least):
                            pre.append(codes[t])
                            t += 1
                            ext.append(places[t] + gram - places[j])
                    rows.append((row, run, j, i, places[j], hashes[j], codes[j], pre, ext))
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return texts.select("row", "text", "chosen").mapInArrow(phrases, _PHRASES)


_ARROW = [(x.split()[0], pa.list_(pa.int64()) if x.endswith(">") else pa.int64()) for x in _PHRASES.split(", ")]


def _named(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name``, growing with the order of ``keys``; and the table of names."""
    names = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = scratch(names.withColumn("name", F.monotonically_increasing_id() + 1), "names")
    return rows.join(names, keys), names


def _sample_names(strings: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(row, run, i, name) of the positions 1 and 2 modulo 3 of strings (row, run, i, c)."""
    order = Window.partitionBy("row", "run").orderBy("i")
    after = lambda k: F.coalesce(F.lead("c", k).over(order), F.lit(0))
    rows = strings.select("row", "run", "i", F.col("c").alias("k0"), after(1).alias("k1"), after(2).alias("k2")).filter("i % 3 != 0")
    ranks = None
    for level in range(levels):
        rows, names = _named(rows, ["k0", "k1", "k2"], scratch)
        before, ranks = ranks, scratch(rows.select("row", "run", "i", F.col("name")), "ranks")
        done = level == levels - 1 or names.count() == ranks.count()
        scratch.drop(names, before)
        if done:
            break
        rows = ranks
        half = Window.partitionBy("row", "run", F.col("i") % 3).orderBy("i")
        later = lambda k: F.coalesce(F.lead("name", k).over(half), F.lit(0))  # noqa: B023, E731
        rows = rows.select("row", "run", "i", F.col("name").alias("k0"), later(1).alias("k1"), later(2).alias("k2"))
    return ranks


def shared_prefixes(lists: pa.ListArray) -> np.ndarray:
    """For each list but the last, how many leading elements it shares with the next."""
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    size = np.diff(offsets)
    out, at = np.zeros(max(0, len(size) - 1), np.int64), np.flatnonzero(np.minimum(size[:-1], size[1:]))
    while len(at):
        m = out[at]
        at = at[values[offsets[at] + m] == values[offsets[at + 1] + m]]
        out[at] += 1
        at = at[np.minimum(size[at], size[at + 1]) > out[at]]
    return out


_ADJACENT = "row long, j long, m long, part long, last boolean, pre array<long>"


def _adjacent(suffixes: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(row, j, m): the leading phrases of ``pre`` that a suffix shares with a neighbour in the order of ``keys``."""
    ordered = suffixes.repartitionByRange(*keys, "row", "j").sortWithinPartitions(*keys, "row", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, before = TaskContext.get().partitionId(), None
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in _ADJACENT.split(", ")]
        edge = lambda at, last: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at[0], at[1], 0, number, last, at[2]), types, strict=True)], names)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, j, pre = batch.column("row"), batch.column("j"), batch.column("pre")
            if before is None:
                yield edge((row[0].as_py(), j[0].as_py(), pre[0].as_py()), False)
            else:
                row, j = (pa.concat_arrays([pa.array([v], pa.int64()), own]) for v, own in zip(before, (row, j), strict=False))
                pre = pa.concat_arrays([pa.array([before[2]], pre.type), pre])
            m = shared_prefixes(pre)
            at = np.flatnonzero(m)
            both = pa.array(np.concatenate([at, at + 1]))
            if len(at):
                columns = [row.take(both), j.take(both), pa.array(np.concatenate([m[at], m[at]])), *[pa.nulls(2 * len(at), t) for t in types[3:]]]
                yield pa.RecordBatch.from_arrays(columns, names)
            before = (row[-1].as_py(), j[-1].as_py(), pre[-1].as_py())
        if before is not None:
            yield edge(before, True)

    found = scratch(ordered.select("row", "j", "pre").mapInArrow(compare, _ADJACENT), "adjacent")
    # two rows a partition: its first and last suffix, compared across the border
    edges = found.filter(F.col("part").isNotNull())
    order = Window.orderBy("part", "last")
    prior = {c: F.lag(c).over(order) for c in ("row", "j", "pre", "last")}
    pairs = edges.select("row", "j", "pre", "last", *[w.alias(f"_{c}") for c, w in prior.items()]).filter("not last and _last")
    size = F.least(F.size("pre"), F.size("_pre"))
    m = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda acc, k: F.when((acc == k) & (F.get("pre", k) == F.get("_pre", k)), acc + 1).otherwise(acc))
    pairs = pairs.filter(size > 0).withColumn("m", m.cast("long")).filter("m > 0")
    across = pairs.select("row", "j", "m").union(pairs.select(F.col("_row").alias("row"), F.col("_j").alias("j"), "m"))
    return found.filter("m > 0").select("row", "j", "m").union(across)


def sorted_matches(phrases: DataFrame, levels: int = LEVELS, scratch: Scratch | None = None) -> DataFrame:
    """(row, j, m) of the anchors whose first m > 0 phrases start elsewhere too, by suffix sorting."""
    scratch = scratch or Scratch(phrases.sparkSession)
    strings = phrases.filter("c != 0").select("row", "run", "j", "i", "c", "pre")
    names = _sample_names(strings, levels, scratch)
    order = Window.partitionBy("row", "run").orderBy("i")
    named = strings.join(names, ["row", "run", "i"], "left")
    rows = scratch(
        named.select(
            "row", "j", "i", "c", "pre", "name", F.coalesce(F.lead("c").over(order), F.lit(0)).alias("c1"),
            F.coalesce(F.lead("name").over(order), F.lit(0)).alias("name1"), F.coalesce(F.lead("name", 2).over(order), F.lit(0)).alias("name2"),
        ), "suffixes",
    )
    lists = [
        _adjacent(rows.filter("i % 3 != 0"), ["name"], scratch),
        _adjacent(rows.filter("i % 3 != 2"), ["c", "name1"], scratch),
        _adjacent(rows.filter("i % 3 != 1"), ["c", "c1", "name2"], scratch),
    ]
    scratch.drop(names, rows)
    return reduce(DataFrame.union, lists).groupBy("row", "j").agg(F.max("m").alias("m"))


def _fields(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The offsets of a list of structs, and its fields as arrays."""
    return lists.offsets.to_numpy(), [lists.values.field(name).to_numpy(zero_copy_only=False) for name in names]


def left_open(offsets: np.ndarray, j: np.ndarray, at: np.ndarray, reach: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchors have a window that the sort has left open: one that starts after an anchor whose shared phrases do not reach its end.

    Windows of anchor p start from ``length - gram`` before it on, so it is settled when every anchor from the last at or before that place up
    to p itself reaches the ends of the windows that start before the next one, with no anchor left out between.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    far = np.int64(at.max(initial=0) + length + 1)
    place = at + row * far
    first = np.searchsorted(place, np.maximum(0, at - (length - gram)) + row * far, "right") - 1
    held = np.zeros(len(at), bool)
    held[:-1] = (row[:-1] == row[1:]) & (j[:-1] == j[1:] - 1) & (at[1:] - 1 + length <= reach[:-1])
    broken = np.concatenate([[0], np.cumsum(~held)])
    return (first < offsets[row]) | (at + length > reach) | (broken[np.arange(len(at))] > broken[np.maximum(first, 0)])


def _open_anchors(phrases: DataFrame, length: int, gram: int) -> DataFrame:
    """Of (row, anchors): the grams of anchors that are left open."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            offsets, (j, at, grams, reach) = _fields(part.column("anchors"), "j", "at", "gram", "reach")
            if len(offsets) > 1 and offsets[-1] > offsets[0]:
                own = slice(offsets[0], offsets[-1])
                found = grams[own][left_open(offsets - offsets[0], j[own], at[own], reach[own], length, gram)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], ["gram"])

    return phrases.select("anchors").mapInArrow(scan, "gram long").distinct()


def _taking(text: pa.Scalar, items: tuple[np.ndarray, ...], length: int, gram: int) -> tuple[np.ndarray, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, their hashes, starts, settled, code, start of the core) of the windows that take part in the count: open ones,
    and settled ones of the leading text of a run.  A code stands for the window's anchor and block; equal windows
    lie alike to their anchors, so they have equal cores: the bytes that all windows of the block share."""
    data = np.frombuffer(text.as_buffer(), np.uint8)
    windows, at, _, rolling = _anchors(data, np.array([0, len(data)]), length, gram)
    needed, reach, leads = np.zeros(len(at) + 1, bool), np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, bool)
    j = items[0]
    needed[j], reach[j], leads[j] = items[1:]
    starts = np.flatnonzero(windows >= 0)
    starts = starts[needed[np.searchsorted(at, windows[starts])]]
    phrase = np.searchsorted(at, starts, "right") - 1  # -1, before the first anchor, is the spare entry
    settled = starts + length <= reach[phrase]
    take = ~settled | leads[phrase]
    starts, settled = starts[take], settled[take]
    block = (windows[starts] - starts) // BLOCK
    return data, rolling, starts, settled, np.searchsorted(at, windows[starts]) * _blocks(length, gram) + block, windows[starts] - BLOCK * block


def _blocks(length: int, gram: int) -> int:
    return (length - gram) // BLOCK + 1


def _cores(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """row, code, the core's hash, and where the text holds it all, bounds and 128-bit hash of the union of every block of windows that take part."""
    names = ["row", "code", "core", "a", "b", "u1", "u2"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            offsets, fields = _fields(part.column("anchors"), "j", "needed", "reach", "leads")
            for row, text, a, b in zip(part.column("row").to_pylist(), part.column("text"), offsets[:-1], offsets[1:], strict=True):
                data, rolling, _, _, code, cores = _taking(text, tuple(f[a:b] for f in fields), length, gram)
                code, first = np.unique(code, return_index=True)
                if not len(code):
                    continue
                begin = cores[first]
                core = rolling.of(begin, begin + length - BLOCK + 1).view(np.int64)
                a, b = begin - BLOCK + 1, begin + length
                inside = (a >= 0) & (b <= len(data))
                a, b = np.where(inside, a, 0), np.where(inside, b, 0)
                union = [pa.array(r.of(a, b).view(np.int64), mask=~inside) for r in (rolling, Rolling(data, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), *map(pa.array, (code, core, a, b)), *union], names)

    return texts.select("row", "text", "anchors").mapInArrow(hashes, ", ".join(f"{c} long" for c in names))


_WINDOWS = "row long, i long, h1 long, h2 long, settled boolean"


def _windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """128-bit hashes of the windows that take part and whose code is among the text's ``codes``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            offsets, fields = _fields(part.column("anchors"), "j", "needed", "reach", "leads")
            for row, text, a, b, codes in zip(part.column("row").to_pylist(), part.column("text"), offsets[:-1], offsets[1:], part.column("codes"), strict=True):
                data, rolling, starts, settled, code, _ = _taking(text, tuple(f[a:b] for f in fields), length, gram)
                take = np.isin(code, codes.values.to_numpy())
                starts, settled = starts[take], settled[take]
                if len(starts):
                    both = [r.of(starts, starts + length).view(np.int64) for r in (rolling, Rolling(data, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), row)), pa.array(starts), *map(pa.array, both), pa.array(settled)], ["row", "i", "h1", "h2", "settled"])

    return texts.select("row", "text", "anchors", "codes").mapInArrow(hashes, _WINDOWS)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted, apart intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(first)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends[:0]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, levels: int = LEVELS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has doc_id, key, n_bytes and n_copies of every input row; spans has key, text (bytes) and the
    removed stretches ``starts`` and ``ends`` of every text that loses some but has no copy."""
    if not 0 < gram < length:
        raise ValueError("gram must be shorter than length")
    scratch = scratch or Scratch(docs.sparkSession)
    parsed = scratch(_parsed(docs, length, gram).withColumn("row", F.monotonically_increasing_id()), "parsed")
    classes = scratch(parsed.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("n_copies")), "classes")
    firsts = parsed.join(classes.select("row", "n_copies"), "row")
    anchors = firsts.select("row", F.posexplode("grams").alias("j", "gram"))
    repeated = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    chosen = scratch(anchors.join(repeated, "gram").groupBy("row").agg(F.sort_array(F.collect_list("j")).alias("chosen")), "chosen")
    wanted = firsts.join(chosen, "row").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "row", "n_copies", "chosen")
    bytes_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    bytes_ = bytes_.withColumn("key", F.unhex(F.sha2("text", 256)))
    texts = bytes_.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("row", "key", "n_copies", "text", "chosen")
    # a row's text comes twice only if its id comes twice with it
    twice = not parsed.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    texts = scratch(texts.dropDuplicates(["row"]) if twice else texts, "texts")
    rows = scratch(parsed.select("doc_id", "key", "n_bytes").join(classes.select("key", "n_copies"), "key"), "rows")
    scratch.drop(parsed, classes, chosen)

    phrases = scratch(_phrases(texts, length, gram), "phrases")
    matches = sorted_matches(phrases, levels, scratch)
    joined = phrases.join(matches, ["row", "j"], "left")
    reach = F.when(F.col("m").isNull(), F.lit(0).cast("long")).otherwise(F.col("at") + F.element_at("ext", F.col("m").cast("int")))
    joined = scratch(joined.select("row", "j", "at", "gram", reach.alias("reach"), F.xxhash64(F.slice("pre", 1, F.coalesce("m", F.lit(0)).cast("int"))).alias("context")), "matches")
    scratch.clear(texts, rows, joined)
    leads = joined.filter(F.col("reach") > 0).groupBy("context").agg(F.min(F.struct("row", "j")).alias("first")).select("first.*", F.lit(True).alias("leads"))
    about = F.sort_array(F.collect_list(F.struct("j", "at", "gram", "reach")))
    open_ = _open_anchors(joined.groupBy("row").agg(about.alias("anchors")), length, gram).withColumn("needed", F.lit(True))
    info = joined.join(open_, "gram", "left").join(leads, ["row", "j"], "left")
    info = info.select("row", F.struct("j", "reach", F.coalesce("needed", F.lit(False)).alias("needed"), F.coalesce("leads", F.lit(False)).alias("leads")).alias("anchor"))
    info = scratch(info.groupBy("row").agg(F.collect_list("anchor").alias("anchors")).filter(F.exists("anchors", lambda a: a["needed"])), "info")
    bare = texts.select("row", "text")
    cores = scratch(_cores(bare.join(info, "row"), length, gram), "cores")
    shared = cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    blocks = scratch(cores.join(shared, "core").drop("core"), "blocks")
    scratch.drop(cores)
    # a block whose union starts elsewhere too is repeated whole; the first of them goes on to the count, for others' sake
    place = F.struct("row", "a")
    unions = blocks.filter("u1 is not null").groupBy("u1", "u2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("u1", "u2", "first")
    found = blocks.join(unions, ["u1", "u2"], "left").select("row", "code", "a", "b", F.col("first").isNotNull().alias("whole"), F.coalesce(F.col("first") == place, F.lit(False)).alias("leads"))
    blocks, before = scratch(found, "blocks"), blocks
    scratch.drop(before)
    codes = blocks.filter("not whole or leads").groupBy("row").agg(F.collect_list("code").alias("codes"))
    windows = scratch(_windows(bare.join(info.join(codes, "row"), "row"), length, gram), "windows")
    scratch.drop(info)
    counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    exact = windows.filter("not settled").join(counted, ["h1", "h2"]).select("row", F.col("i").alias("a"), (F.col("i") + length).alias("b"))
    runs = joined.filter(F.col("reach") >= F.col("at") + length).select("row", F.col("at").alias("a"), F.col("reach").alias("b"))
    whole = blocks.filter("whole").select("row", "a", "b")
    intervals = runs.union(exact).union(whole).groupBy("row").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            pairs = [_merged(np.array(a.as_py()), np.array(b.as_py())) for a, b in zip(part.column("a"), part.column("b"), strict=True)]
            lists = [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *lists], ["row", "starts", "ends"])

    intervals = scratch(intervals.select("row", "a", "b").mapInArrow(union, "row long, starts array<long>, ends array<long>"), "intervals")
    scratch.drop(joined, windows)
    spans = texts.filter("n_copies = 1").select("row", "key", "text").join(intervals, "row").select("key", "text", "starts", "ends")
    return rows, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of (doc_id, text)."""
    rows, spans = repeated_spans(docs, length, gram, levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for text, starts, ends in zip(part.column("text"), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                raw, digest, at = memoryview(text.as_buffer()), hashlib.sha256(), 0
                for a, b in zip(starts, ends, strict=True):
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((sum(ends) - sum(starts), len(starts), digest.hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["_key", "_removed", "_spans", "_sha"])

    lost = spans.mapInArrow(cut, "_key binary, _removed long, _spans long, _sha string")
    whole = (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)
    found = rows.join(lost, F.col("key") == F.col("_key"), "left")
    return found.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("_sha", F.lower(F.hex("key")))).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated stretches taken out of ``text``, and ``n_chars`` counted anew where it is a column.

    A stretch that begins or ends inside a character keeps the whole character; all other columns and all rows stay.
    """
    scratch = Scratch(docs.sparkSession)
    rows, spans = repeated_spans(docs, length, gram, scratch=scratch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for text, starts, ends in zip(part.column("text"), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                raw, pieces, at = bytes(text.as_buffer()), [], 0
                for a, b in zip(starts, ends, strict=True):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    pieces.append(raw[at:a])
                    at = max(at, b)
                out.append(b"".join([*pieces, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], ["_key", "_cut"])

    changed = scratch(spans.mapInArrow(cut, "_key binary, _cut string"), "cut")
    scratch.clear(rows, changed)
    copies = rows.filter((F.col("n_copies") > 1) & (F.col("n_bytes") >= length)).select(F.col("key").alias("_key")).distinct().withColumn("_cut", F.lit(""))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    keyed = plain.withColumn("_own", F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)))
    found = keyed.join(changed.union(copies), F.col("_own") == F.col("_key"), "left")
    columns = {text: F.coalesce("_cut", text)}
    if "n_chars" in names:
        at = f"c{names.index('n_chars')}"
        columns[at] = F.when(F.col("_cut").isNull(), F.col(at)).otherwise(F.length("_cut")).cast(plain.schema[at].dataType)
    return found.withColumns(columns).select(*plain.columns).toDF(*names)
