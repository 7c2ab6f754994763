"""Shared helpers of the training-data operators: spreading rows, scratch tables, word tokens."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every shingle operator: runs of bytes that are no ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Rows that a Python function of this package handles at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    The session's ``spark.checkpoint.dir`` decides; only where it is unset on a single machine (tests)
    a temporary folder is set for the session. On a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="methyra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/methyra-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and a lost
    executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt evenly by a hash of ``cols`` (all columns if none), so that few large row groups
    and equal or null ids neither leave cores idle nor fill one task."""
    return df.repartition(F.xxhash64(*[F.col(c) for c in (cols or df.columns)]))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table]], schema: str) -> DataFrame:
    """``mapInArrow`` in slices of at most ``SLICE`` rows, so that memory stays bounded by the longest texts.

    ``make`` is called once a task and returns the function applied to each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                out = fn(b.slice(at, SLICE))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def batch_of(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def col_of(batch: pa.RecordBatch, col: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(col))


_M = np.uint64(0xFF51AFD7ED558CCD)
_K = [np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * i & 0xFFFFFFFFFFFFFFFF | 1) for i in range(16)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M
    return x ^ (x >> np.uint64(29))


class WordHasher:
    """64-bit hashes of words, remembered up to ``cap`` words so that frequent ones are hashed once."""

    def __init__(self, cap: int = 150_000):
        import xxhash

        self._seen: dict[str, int] = {}
        self._cap = cap
        self._hash = xxhash.xxh64_intdigest

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self._cap:
            seen.clear()
        new = set(words).difference(seen)
        h = self._hash
        for w in new:
            seen[w] = h(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str) -> list[str]:
    """Lower-cased (A-Z only) words; ASCII white space alone separates."""
    t = lower_ascii(text)
    return t.split() if t.isascii() and not _ODD.search(t) else WORD.findall(t)


_ODD = re.compile("[\x1c-\x1f]")


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * _K[0] + hashes[i : n - k + 1 + i] + _K[i % 16])
        if n < size:
            out = mix64(out + _K[n])
    return np.unique(out)


def null_safe(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
