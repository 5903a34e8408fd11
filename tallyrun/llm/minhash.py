"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: sigma, a permutation of the 64-bit shingles, of which the leading bits scatter them
over a circle of 2^21 places, and pi, one table of ranks, is read at the place shifted by k for coordinate k; the K ranks of a shingle are therefore one contiguous run.
Equal shingle sets are one class, found by a 128-bit hash of the set, and only classes are banded, so copies never
make pairs.  With 40 bands of 5 coordinates a link of similarity 0.8 is missed with a chance of 1.3e-7.

Links are confirmed on full sets, by comparisons with hubs only, so a bucket's members are never paired with each other:
1. every class is compared with the smallest class that it shares a bucket with (its pivot);
2. every class is compared with the class that lies closest to its pivot, which is a lightly changed copy;
3. in buckets that still hold several components, all members are compared with one hub h.  If x and y lie in different
   components, one of them, say y, is not linked to h.  A link of x and y then needs one of two things.  They share enough of what
   either adds to h, at least t (|x| + |y|) - min(common(x, h), common(y, h)) shingles with t = s / (1 + s).  Or they share no such
   shingle, which leaves common(x, y) <= common(y, h) < t (|y| + |h|), so |x| < |h|; then they lack the same of h, at least
   half of what |x - y| + |y - x| would exceed a link's by.  In either case they have one of the first shingles in common, in an order
   by rising frequency, of which so many are looked at as the shared number leaves (the prefix filter).  These shingles, each with
   the hub, are the new buckets.
4. A pair that is still open lies in two components, so one of it is outside the largest component of its bucket.  Where at most ``HUBS`` members
   are outside, these are compared with all members of the bucket, which closes it.  The other buckets get a hub of their own and go through 3 again, until
   the pairs left are ``PAIRS`` a class or a round lessens them by less than a quarter; then all of them are compared, so the rounds end.
   Lightly changed copies add mostly shingles of their own, and these make no bucket.
Components are joined by star contraction.  Comparisons with one hub are dealt to ``SALTS`` tasks.

A null text is empty.  Texts without words have no set and link with nothing; texts of fewer than n words have their whole
sequence as one shingle.  Very long texts are read whole.  Repeated rows are one class, each row gets an answer.  component_id is the
smallest doc_id reachable, nulls ignored, so it is null only where no document of the component has an id, and kept compares
null-safely.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch
from .textvec import constants, mix, shingle_sets, slices

SHINGLE = 5
SIMILARITY = 80
"""In hundredths."""
BANDS, ROWS = 40, 5
CIRCLE_BITS = 21
HUBS = 16
"""A bucket of at most so many members outside its largest component is settled by comparing these with all its members."""
PAIRS = 2
"""When the pairs of members of different components are no more than so many a banded class, all of them are compared, which ends the rounds."""
SALTS = 64
"""Tasks that the comparisons with one hub are dealt to."""
_SEED = 41


@lru_cache(1)
def _circle(coordinates: int) -> np.ndarray:
    """pi, once around and on by the number of coordinates."""
    ranks = np.random.default_rng(_SEED).permutation(1 << CIRCLE_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS, block: int = 2048) -> np.ndarray:
    """Coordinate k is the least pi[(sigma(x) + k) mod D] of the shingles x."""
    circle = _circle(coordinates)
    place = (mix(shingles ^ np.uint64(_SEED)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    out = circle[place[:block]].min(0)
    for i in range(block, len(place), block):
        np.minimum(out, circle[place[i : i + block]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per text and band; the band is part of the key."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    return mix((parts * constants(rows, 3)).sum(2, dtype=np.uint64) + constants(bands, 9)).view(np.int64)


def class_of(shingles: np.ndarray) -> bytes:
    """A 128-bit hash of a set."""
    a = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mix(shingles ^ np.uint64(0x14057B7EF767814F)))
    return np.array([a, b], np.uint64).tobytes()


def _text_hashes(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, class (null without words), band keys and two hashes of the text of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, j, data, offsets in slices(part.column(1)):
                values, bounds = shingle_sets(data, offsets, n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                classes, keys = [None] * (j - i), [None] * (j - i)
                if len(full):
                    marks = np.stack([signature(values[bounds[k] : bounds[k + 1]]) for k in full])
                    for k, own in zip(full, band_keys(marks), strict=True):
                        classes[k], keys[k] = class_of(values[bounds[k] : bounds[k + 1]]), own
                same = [part.column(k).slice(i, j - i) for k in (0, 2, 3)]
                found = [pa.array(sizes), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, *found], ["doc_id", "t1", "t2", "n_shingles", "class", "keys"])

    hashed = docs.select(F.col("doc_id").cast("long"), "text", *_text_hashes("text"))
    return hashed.mapInArrow(describe, "doc_id long, t1 long, t2 long, n_shingles long, class binary, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node and its sorted shingles as bytes, for the given (node, class, rep)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, j, data, offsets in slices(part.column("text")):
                values, bounds = shingle_sets(data, offsets, n)
                owns = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                same = [k for k, (own, c) in enumerate(zip(owns, part.column("class").slice(i, j - i).to_pylist(), strict=True)) if len(own) and class_of(own) == c]
                nodes = part.column("node").slice(i, j - i).take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes, pa.array([owns[k].tobytes() for k in same], pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    chosen = texts.join(nodes.select("node", "class", "rep"), F.col("_doc").eqNullSafe(F.col("rep"))).select("node", "class", "text")
    return chosen.mapInArrow(collect, "node long, shingles binary").dropDuplicates(["node"])


def prefixes(hub: np.ndarray, own: np.ndarray, low: int, similarity: int) -> tuple[int, np.ndarray, int, np.ndarray, int]:
    """(common, adds, take, lacks, take): what a set adds to a hub and lacks of it, and how many of these, the rarest first, have one
    that any set of at least ``low`` shingles shares which may link with it but not through the hub.  ``take`` may be 0."""
    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
    known = hub[at] == own
    missing = np.ones(len(hub), bool)
    missing[at[known]] = False
    s, whole = similarity, 100 + similarity
    common, adds, lacks, n, m = int(known.sum()), own[~known], hub[missing], len(own), len(hub)
    need = max(1, -(-s * (n + max(low, -(-s * n // 100))) // whole) - common)
    most = common * whole // s - n
    """The size of a set that links without shared additions."""
    take = 0
    if most >= low:
        apart, linked = len(adds) + len(lacks), 100 * common >= s * (n + m - common)
        if n < m:
            take = len(lacks) - max(1, -(-(whole * apart + (100 - s) * (m - n)) // (2 * whole))) + 1
        if not linked:
            take = max(take, len(lacks) - max(1, -(-(whole * apart - (100 - s) * (n + m) + 200 * max(1, m - most)) // (2 * whole))) + 1)
    return common, adds, max(0, len(adds) - need + 1), lacks if take > 0 else lacks[:0], max(0, take)


def _compared(pairs: DataFrame, sets: DataFrame, similarity: int, leading: bool = False) -> DataFrame:
    """Sizes and common shingles of each pair of a hub a and a class b; if asked for, also ``prefixes`` for sets of ``low`` shingles and more."""
    names = ["a", "b", "na", "nb", "common"] + ["add", "adds", "lack", "lacks"] * leading

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.int64(), pa.list_(pa.int64())] * 2
        for part in batches:
            rows = []
            for a, b, low, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "low")), part.column("x"), part.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common, adds, add, lacks, lack = prefixes(x, y, low, similarity)
                rows.append((a, b, len(x), len(y), common, add, adds.view(np.int64), lack, lacks.view(np.int64))[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[: len(names)], strict=True)], names)

    low = F.col("low") if leading else F.lit(0).alias("low")
    salted = pairs.select("a", "b", low, F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    x = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    schema = ", ".join(f"{c} {'array<long>' if c in ('adds', 'lacks') else 'long'}" for c in names)
    return salted.join(x, ["a", "salt"]).join(y, "b").select("a", "b", "low", "x", "y").mapInArrow(compare, schema)


def _links(compared: DataFrame, similarity: int) -> DataFrame:
    return compared.filter(100 * F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets ``key`` that hold more than one component, with their ``root``."""
    state = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = state.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("key")
    return state.join(keys, "key")


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The roots after these links; only components that the links join are worked on, and where there are none nothing is."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    across = links.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).filter("u != v")
    across = scratch(across.distinct(), "across")
    if across.isEmpty():
        return roots
    moved = components(across, scratch).select(F.col("node").alias("old"), F.col("root").alias("new"))
    after = roots.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return scratch(after.union(moved.select("old", "new")).distinct(), "roots")


def _next_buckets(met: DataFrame, still: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, n, c, d, root) of the rarest shingles that the nodes of ``still`` (hub, node, n) add to the hub or lack of it; c is what
    a node has in common with the hub, d how many shingles only one of them has.  Buckets of one hub and the same members are one."""
    own = met.withColumnsRenamed({"a": "hub", "b": "node", "common": "c"}).join(still, ["hub", "node"]).withColumn("d", F.col("na") + F.col("nb") - 2 * F.col("c"))
    same = ["hub", "node", "n", "c", "d"]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(take).alias("take"), F.col(all_).alias("all")) for k, (take, all_) in enumerate((("add", "adds"), ("lack", "lacks")))]))
    one = own.select(*same, kinds.alias("x")).select(*same, "x.kind", "x.take", F.explode("x.all").alias("shingle"))
    one = one.withColumn("key", F.xxhash64("hub", "shingle"))
    counts = one.groupBy("key").agg(F.count("*").alias("often"))
    order = Window.partitionBy("hub", "node", "kind").orderBy("often", "key")
    first = one.join(counts, "key").withColumn("place", F.row_number().over(order)).filter("place <= take and often > 1")
    opened = _open(first.select("key", *same), roots)
    alike = opened.groupBy("key").agg(F.xxhash64(F.min("hub"), F.count("*"), F.sum(F.xxhash64("node").cast("decimal(38,0)"))).alias("alike"))
    return opened.join(alike, "key").select(F.col("alike").alias("key"), "node", "n", "c", "d", "root").dropDuplicates(["key", "node"])


def _sided(members: DataFrame) -> DataFrame:
    """The members with ``minor``, whether they lie outside the component of most members of their bucket, and the number ``n_minor`` of such members in it."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    most = counts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), (F.sum("m") - F.max("m")).alias("n_minor"))
    return members.join(most, "key").withColumn("minor", F.col("root") != F.col("most.root")).drop("most")


def _across(members: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of members of one bucket and different components that sizes and what either shares with the bucket's hub let link.

    One of them is always ``minor``; about ``HUBS`` of these meet all members of a bucket in one task.
    """
    blocks = F.ceil(F.col("n_minor") / HUBS)
    few = members.filter("minor").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).select("key", "block", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "c", "root")])
    all_ = members.select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "node", "n", "c", "root", "minor")
    most = F.least("c", "a_c") + F.least(F.col("n") - F.col("c"), F.col("a_n") - F.col("a_c"))
    may = (100 + similarity) * F.least(most, "n", "a_n") >= similarity * (F.col("n") + F.col("a_n"))
    met = few.join(all_, ["key", "block"]).filter((F.col("root") != F.col("a_root")) & (~F.col("minor") | (F.col("a_node") < F.col("node"))) & may)
    return met.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct()


def link_classes(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, n_shingles, class and two hashes of the text; classes has class, n_docs, n_classes of its
    component, rep (smallest doc_id of the class), root (of the component) and component_id."""
    scratch = Scratch(docs.sparkSession)
    described = scratch(_described(docs, n), "described")
    classes = described.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.first("keys").alias("keys"), F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.max("n_shingles").alias("n")
    )
    keyed = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = scratch(described.drop("keys"), "rows")
    scratch.drop(described)
    banded = keyed.select(F.explode("keys").alias("key"), "node", "n")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    members = scratch(banded.join(shared, "key"), "members")
    classes = scratch(keyed.drop("keys"), "classes")
    scratch.drop(keyed)
    first = members.groupBy("node").agg(F.min("low").alias("pivot"))
    sets = scratch(_sets(docs, first.select("node").join(classes.select("node", "class", "rep"), "node"), n), "sets")

    one = scratch(_compared(first.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets, similarity), "compared")
    distance = F.col("na") + F.col("nb") - 2 * F.col("common")
    closest = one.groupBy("a").agg(F.min(F.struct(distance.alias("d"), F.col("b").alias("node"))).alias("c")).select("a", F.col("c.node").alias("hub"))
    hubs = one.join(closest, "a").filter("hub != b").select(F.col("hub").alias("a"), "b")
    two = scratch(_compared(hubs, sets, similarity), "compared")
    links = scratch(_links(one, similarity).union(_links(two, similarity)), "links")
    roots = scratch(components(links, scratch), "roots")
    state = scratch(_open(members.select("key", "node", "n"), roots), "open")
    own = two.select(F.col("b").alias("node"), F.col("a").alias("own")).union(two.select("a", "a")).dropDuplicates(["node"])
    usual = state.join(own, "node").groupBy("key", "own").agg(F.count("*").alias("often"))
    lead = usual.groupBy("key").agg(F.max(F.struct("often", "own")).alias("m")).select("key", F.col("m.own").alias("hub"))
    lead = state.groupBy("key").agg(F.min("node").alias("least")).join(lead, "key", "left").select("key", F.coalesce("hub", "least").alias("hub"))
    state, before = scratch(state.join(lead, "key"), "open"), None
    scratch.clear(rows, classes, sets, roots, state)
    enough = PAIRS * sets.count()
    while not state.isEmpty():
        rest = state.filter("node != hub")
        to_lead = rest.join(rest.groupBy("key").agg(F.min("n").alias("low")), "key").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.min("low").alias("low"))
        met = scratch(_compared(to_lead, sets, similarity, leading=True), "compared")
        roots = _joined(roots, scratch(_links(met, similarity), "links"), scratch)
        still = _open(rest, roots).select("hub", "node", "n").distinct()
        then = scratch(_sided(_next_buckets(met, still, roots)), "buckets")
        cost = then.agg(F.sum("n_minor")).first()[0] or 0
        last = cost <= enough or (before is not None and cost > before * 3 / 4)
        pairs = scratch(_across(then if last else then.filter(F.col("n_minor") <= HUBS), similarity), "pairs")
        links = scratch(_links(_compared(pairs, sets, similarity), similarity), "links")
        roots = _joined(roots, links, scratch)
        if last:
            break
        then, before = then.filter(F.col("n_minor") > HUBS), cost
        near = then.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("slot")).agg(F.min(F.struct("d", "node")).alias("m"))
        lead = near.groupBy("key").agg(F.min("m").alias("m")).select("key", F.col("m.node").alias("hub"))
        state = scratch(then.join(lead, "key").select("key", "node", "n", "root", "hub"), "open")
        scratch.clear(rows, classes, sets, roots, state)
    known = classes.select("class", "node", "rep", "n_docs").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_classes"))
    found = scratch(known.join(least, "root").select("class", "rep", "n_docs", "n_classes", "root", "component_id"), "found")
    scratch.clear(rows, found)
    return rows, found


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    described, classes = link_classes(docs, n, similarity)
    grouped = classes.filter("n_docs > 1 or n_classes > 1").select(F.col("class").alias("_class"), F.col("component_id").alias("_found"), F.lit(True).alias("_grouped"))
    found = described.select("doc_id", "n_shingles", "class").join(grouped, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("_grouped"), F.col("_found")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, of the smallest doc_id (nulls last) and then text hash, and all texts without
    words; repeated rows once.  An id that comes with several texts is decided for each of them.  Columns stay as they are."""
    described, classes = link_classes(docs, n, similarity)
    grouped = classes.filter("n_docs > 1 or n_classes > 1").select(F.col("class").alias("_class"), "root")
    found = described.join(grouped, F.col("class") == F.col("_class"), "left")
    mark = ["doc_id", "t1", "t2"]
    alone = found.filter(F.col("root").isNull()).select(*mark)
    best = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), *mark)).alias("m"))
    kept = alone.union(best.select(*[f"m.{c}" for c in mark])).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    own = (F.col(at).cast("long"), *_text_hashes(text))
    same = own[0].eqNullSafe(F.col("doc_id")) & (own[1] == F.col("t1")) & (own[2] == F.col("t2"))
    return plain.join(kept, same, "left_semi").dropDuplicates([at, text]).toDF(*names)
