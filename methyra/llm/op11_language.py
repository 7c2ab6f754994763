"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is a word border, and the grams are the runs of one to ``ORDER``
characters inside a word with its borders. A gram's bucket is a hash of its order and characters. Training counts grams by
(language, bucket) over all training texts: each task sums its own texts in one vector a language and emits the buckets that
occur, so what is shuffled has a bound a task; Spark adds the tasks' counts. The matrix of smoothed log-probabilities,
buckets by languages, has at most ``CELLS`` numbers (64 MB) whatever the corpus holds, since the number of buckets halves as
languages double, and it is broadcast. Texts are scored a batch at a time: the matrix rows of all grams of the batch are
gathered and added up by document, in pieces of bounded size; a text of any length is read in pieces that overlap by the
longest gram, so counts are those of the whole text. Scoring is a map over the scan, without a shuffle.

The score is the posterior probability of the predicted language. Rows: a null text, or one without a letter, is ``und``
with score 0, and so is every text where there was nothing to learn from; equal posteriors go to the smallest language. Null
languages and null ids are not learned from; a row with a null id is not held out. Any language value may be learned, the
empty one too. Repeated rows are scored and counted each; an empty table gives no rows; extra columns are dropped. More
than ``CELLS / LEAST`` languages are an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, batch_of, col_of, table

ORDER, BUCKETS, LEAST = 4, 1 << 16, 1 << 10
#: Numbers of the broadcast matrix at most.
CELLS = 1 << 23
#: Pseudo-count of every bucket.
SMOOTH = 0.1
#: Characters that are hashed at a time, and numbers that are gathered at a time.
PIECE, GATHER = 1 << 18, 1 << 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of letters, 0 elsewhere."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[c], c, 0).astype(np.uint64)


def _grams(codes: np.ndarray, starts: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of the grams of each order that start at the first ``starts`` codes. A border stands only at
    an end of a gram, and no gram is borders alone."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    letter = codes != 0
    h = np.zeros(starts, np.uint64)
    inner = np.ones(starts, bool)
    for k in range(1, ORDER + 1):
        last = slice(k - 1, k - 1 + starts)
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + codes[last] + np.uint64(k)
        if k > 2:
            inner &= letter[k - 2 : k - 2 + starts]
        valid = letter[:starts] if k == 1 else letter[:starts] | letter[last] if k == 2 else inner
        at = np.flatnonzero(valid)
        yield at, (((h[at] ^ (h[at] >> np.uint64(31))) * _MULTIPLIER) >> shift).astype(np.int64)


def hashed(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of all grams, in pieces; indices ascend within a piece."""
    pad = "\n" * ORDER

    def together(at: list[int]):
        joined = "\n" + "\n".join(lower[i] for i in at)
        ends = np.cumsum([len(lower[i]) + 1 for i in at])
        for where, found in _grams(_codes(joined + pad), len(joined), buckets):
            yield np.array(at)[np.searchsorted(ends, where, side="right")], found

    held: list[int] = []
    size = 0
    lower = [t.lower() for t in texts]
    for i, t in enumerate(lower):
        if len(t) > PIECE:
            whole = len(t) + 1
            for start in range(0, whole, PIECE):  # of the text with its border before it
                n = min(PIECE, whole - start)
                part = ("\n" + t[: PIECE + ORDER - 1]) if start == 0 else t[start - 1 : start - 1 + n + ORDER - 1]
                for where, found in _grams(_codes(part + pad), n, buckets):
                    yield np.full(len(where), i), found
            continue
        if size + len(t) > PIECE:
            yield from together(held)
            held, size = [], 0
        held.append(i)
        size += len(t) + 1
    if held:
        yield from together(held)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: log-probabilities, a row for each bucket and a column for each language
    matrix: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-posteriors up to a constant, a row for each text, and the number of its grams."""
        total, grams = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        step = max(1, GATHER // max(1, len(self.languages)))
        for owner, found in hashed(texts, len(self.matrix)):
            grams += np.bincount(owner, minlength=len(texts))
            for i in range(0, len(found), step):
                own = owner[i : i + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(self.matrix[found[i : i + step]], first, axis=0)
        return total, grams

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, sure = ["und"] * len(texts), [0.0] * len(texts)
        if self.languages:
            total, grams = self.scores(texts)
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in np.flatnonzero(grams):
                names[i], sure[i] = self.languages[best[i]], float(share[i])
        return names, sure


def model_of(counts: dict[str, np.ndarray], texts: dict[str, int]) -> Model:
    """Counts of buckets and numbers of texts by language."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    grid = np.stack([counts[x] for x in languages], 1) + SMOOTH
    return Model(languages, np.log(np.array([texts[x] for x in languages]) / sum(texts.values())), np.log(grid / grid.sum(0)))


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) of rows (lang, text); the bucket -1 counts the texts that have a letter."""
    names = ["lang", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(buckets + 1, np.int64))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                pairs = sorted(zip(*(col_of(b.slice(at, SLICE), c).to_pylist() for c in ("lang", "text"))), key=lambda x: x[0])
                known, texts = [x for x, _ in pairs], [t for _, t in pairs]
                seen = np.zeros(len(texts), bool)
                for owner, found in hashed(texts, buckets):
                    seen[owner] = True
                    for lang in {known[i] for i in np.unique(owner)}:
                        lo, hi = known.index(lang), len(known) - known[::-1].index(lang)
                        here = found[np.searchsorted(owner, lo) : np.searchsorted(owner, hi)]
                        sums[lang][:buckets] += np.bincount(here, minlength=buckets)
                for i in np.flatnonzero(seen):
                    sums[known[i]][buckets] += 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield batch_of(names, [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at)), pa.array(total[at])])

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> Model:
    """A model from all rows (lang, text) whose language and text are not null."""
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    languages = rows.select(F.count_distinct("lang")).first()[0]
    if languages > CELLS // LEAST:
        raise ValueError(f"{languages} languages are more than the {CELLS // LEAST} that one matrix can hold")
    buckets = BUCKETS
    while buckets * languages > CELLS:
        buckets //= 2
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    # at most ``CELLS`` rows and one for each language, for any corpus
    for batch in counted(rows, buckets).toArrow().to_batches():
        names, at, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lang in set(names):
            own = np.array([x == lang for x in names])
            total = counts.setdefault(lang, np.zeros(buckets))
            grams = own & (at >= 0)
            total[at[grams]] = n[grams]
            texts[lang] = texts.get(lang, 0) + int(n[own & (at < 0)].sum())
    return model_of(counts, texts)


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score"]

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            found, sure = sent.value.predict([t or "" for t in col_of(b, "text").to_pylist()])
            return batch_of(names, [*(col_of(b, c) for c in keep), pa.array(found, pa.string()), pa.array(sure, pa.float64())])

        return fn

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), make, schema)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold() != 2).select("lang", "text"))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
