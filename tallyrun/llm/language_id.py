"""Language identification with error-correcting output codes.

Every language has a codeword.  For each bit a binary classifier (naive Bayes log odds over hashed byte trigrams, each
language weighing the same) predicts whether the text's language has a 1 there.  Decoding is loss-weighted: the bit's
margin goes through an exponential loss, weighted by how well the bit separates the training languages, and the language
of least total loss wins.  ``score`` is that language's share of exp(-loss); ``ambiguous`` marks a small lead.

Learning takes at most about ``DOCS_PER_LANG`` documents a language, picked by a hash of doc_id; counts per (language, trigram)
are summed in Spark, and the model, of fixed size per language, goes to the tasks.  Whole texts are read in both phases.

Texts that are null or have no letter are ``und`` with score 0, as are all texts when nothing was learned; with one language
learned, texts with letters are of that language with score 1.  Rows with a null lang or doc_id teach nothing.  Ties in the loss go to
the language that sorts first.  Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import constants, mix, slices

DOCS_PER_LANG = 600
"""The bound of the training sample: expected documents a language."""
MOST_LANGS = 500
BUCKETS = 1 << 16
SMOOTHING = 0.5
MARGIN_SCALE = 4.0
LEAD = 0.2
"""A lead in score under this is flagged as ambiguous."""
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[:65] = 32
_LOWER[91:97] = 32
_LOWER[123:128] = 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram at each position; letters in lower case, all other ASCII as blanks."""
    x = _LOWER[data]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 per language.  Up to 6 languages have the exhaustive code, more a random one of 15 bits and over."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = np.arange(1, 1 << (n - 1))
        bits = [np.zeros(len(columns), int)] + [columns >> k & 1 for k in range(n - 1)]
        return np.where(np.array(bits) > 0, 1.0, -1.0)
    width, best = max(15, 6 * int(np.ceil(np.log2(n)))), None
    for k in range(20):
        words = np.where(mix(constants(n * width, seed + k)).reshape(n, width) >> np.uint64(63) > 0, 1.0, -1.0)
        least = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
        best = max(best or (-1, 0), (int(least), k))
    words = np.where(mix(constants(n * width, seed + best[1])).reshape(n, width) >> np.uint64(63) > 0, 1.0, -1.0)
    return words[:, np.abs(words.sum(0)) < n]


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # of each bit

    def judge(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts x bits: index of the language, its score, and whether it is ambiguous."""
        losses = np.exp(np.clip(-MARGIN_SCALE * margins[:, None, :] * self.words[None], -3, 3)) @ self.trust
        odds = np.exp(losses.min(1, keepdims=True) - losses)
        share = odds / odds.sum(1, keepdims=True)
        best = losses.argmin(1)
        top = np.sort(share, 1)
        lead = top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)
        return best, share[np.arange(len(best)), best], lead < LEAD


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """The model of (doc_id, text, lang) rows that are not held out."""
    rows = docs.select(F.col("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).filter(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))])
    pick = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for part in batches:
            owner = np.array([index[x] for x in part.column(1).to_pylist()], np.int64)
            for i, j, data, offsets in slices(part.column(0)):
                for k in range(i, j):
                    own = data[offsets[k - i] : offsets[k - i + 1]]
                    if len(own) > 2:
                        total[owner[k]] += np.bincount(trigrams(own), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    found = rows.filter(pick).select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    counts = np.zeros((len(langs), BUCKETS))
    summed = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    counts[summed["lang"].to_numpy(int), summed["bucket"].to_numpy(int)] = summed["n"].to_numpy(float)
    words = codewords(len(langs))
    freq = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    weights = np.zeros((BUCKETS, words.shape[1]), np.float32)
    trust = np.ones(words.shape[1])
    if len(langs) > 1:
        for b in range(words.shape[1]):
            one = words[:, b] > 0
            weights[:, b] = np.log(freq[one].mean(0)) - np.log(freq[~one].mean(0))
            own = (freq @ weights[:, b]) * words[:, b]  # expected margin of each language, on its own side
            trust[b] = max(0.05, own.min())
    return Model(langs, words, weights, trust / trust.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of (doc_id, text)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for part in batches:
            letters = np.array(part.column(2).to_pylist(), bool)
            best, score, doubt = np.full(len(letters), len(model.langs)), np.zeros(len(letters)), np.zeros(len(letters), bool)
            if model.langs:
                for i, j, data, offsets in slices(part.column(1), 1 << 20):
                    margins = np.zeros((j - i, model.words.shape[1]))
                    if len(data) > 2:
                        n = np.maximum(np.diff(offsets) - 2, 0)
                        code = trigrams(data)
                        full = np.flatnonzero(n)
                        # reduceat runs to the next start, so the two trigrams that cross a border are zeroed first
                        cross = np.concatenate([offsets[1:-1] - 1, offsets[1:-1] - 2])
                        values = model.weights[code]
                        values[cross[(cross >= 0) & (cross < len(code))]] = 0
                        short = np.flatnonzero(np.diff(offsets) < 3)
                        for k in short:
                            values[max(0, offsets[k] - 2) : offsets[k + 1]] = 0
                        if len(full):
                            margins[full] = np.add.reduceat(values, offsets[full], axis=0) / n[full, None]
                    best[i:j], score[i:j], doubt[i:j] = model.judge(margins)
            best[~letters], score[~letters], doubt[~letters] = len(model.langs), 0, False
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(judge, "doc_id long, lang_pred string, score double, ambiguous boolean")
