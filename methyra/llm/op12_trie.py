"""Conversation prefix trie: sorted sequences, their longest common prefixes, and range minima over these.

A turn is a token: 128 bits of the SHA-256 of its role and text, and its number of words. A conversation is the sequence of
its tokens as bytes. Sequences are sorted with their ids over the cluster (``repartitionByRange``), so equal ones
stand together with ascending ids and a very common first turn or conversation spans as many ranges as it needs. Each
range is read by one task: copies collapse to one entry with a count, neighbours give the longest common prefixes, a sparse
table answers range minima over them, and every prefix that occurs first at an entry binary-searches its left and right
extents on that table, each search independent of all others. The extents give members, the smallest member (range minima
over ids), leaves and sums of words by differences of running sums, and the extent of a prefix one turn shorter gives the
parent.

A range knows how far its first sequence agrees with the one before it and its last with the one after it. Prefixes on these two
paths are open: their parts, a few for each range, are added up by key afterwards, since all figures are sums or minima.
The hash over the ids of members that end at a node is taken while ids stream by; where copies span ranges, ids go on as
strings in order, and one task for such a node hashes the stream.

Rows: a null role or text is empty; rows with a null id belong to no conversation and are left out; turns are ordered with null
first, equal ones by the token's hash. Repeated rows are turns of their own. A conversation's tokens are one row (16 bytes a turn).
The remainder of a negative id is negative, as in SQL.
An empty table has no conversations and gives no rows; where all are turnless the root is the one node and a leaf. Extra columns
are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, null_safe, table, written

#: Bytes of a token, and turns of a range of sequences, about.
WIDE, TURNS = 16, 1_000_000
#: Ids of a string of ids, and prefixes whose extents are searched at a time.
IDS, SEARCHED = 4096, 1 << 18
_NONE = hashlib.sha256(b"").hexdigest()
_WORDS = r"[^\x20\x09-\x0D]+"


def token(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a role and a text, as hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDE)


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, key, words): each conversation c with the first h turns of c - c % ``family`` in place of its own first h,
    h = crc32(c) % ``shared``; ``key`` holds the tokens as bytes, ``words`` a number for each turn."""
    role, text = null_safe("role"), null_safe("text")
    turn = F.struct("turn", token(role, text).alias("token"), F.regexp_count(text, F.lit(_WORDS)).alias("words"))
    c = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(c.alias("conv_id"), (c - c % family).alias("base"), turn.alias("t"))
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, shared - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    tail = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    head = F.slice(F.coalesce("heads", F.slice("own", 1, F.lit(0))), F.lit(1), h)
    both = whole.withColumn("heads", heads).select("conv_id", F.concat(head, tail).alias("all"))
    key = F.unhex(F.array_join(F.transform("all", lambda x: x["token"]), ""))
    return both.select("conv_id", key.alias("key"), F.transform("all", lambda x: x["words"]).alias("words"))


def _agree(a: bytes | None, b: bytes | None) -> int:
    """Tokens that two sequences share at their starts; -1 without one of them."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDE
    x, y = (np.frombuffer(s, "<u8", 2 * n).reshape(-1, 2) for s in (a, b))
    differ = np.flatnonzero((x != y).any(1))
    return int(differ[0]) if len(differ) else n


def fences(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range the tokens its first sequence shares with the one before and its last with the one after (-1: none):
    two numbers a range."""
    order = Window.orderBy("part")
    ends = ranges.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    beside = ends.select("part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    agree = F.pandas_udf(lambda a, b: pd.Series([_agree(x, y) for x, y in zip(a, b)], dtype="int64"), "long")
    return {r[0]: (r[1], r[2]) for r in beside.select("part", agree("before", "first"), agree("last", "after")).collect()}


class RangeMinimum:
    """Minima of every run of 2^k values, so that any range's minimum is the smaller of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            half, last = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of the closed ranges low..high."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the largest r >= at with all values at+1..r at least ``least``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            fits = at + step < len(self.rows[0])
            fits[fits] = row[at[fits] + 1] >= least[fits]
            at[fits] += step
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the smallest l <= at with all values l+1..at at least ``least``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            fits = at >= step
            fits[fits] = row[at[fits] - step + 1] >= least[fits]
            at[fits] -= step
        return at


_FIGURES = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_SCHEMA = f"kind string, {_FIGURES}, parent_conv_id long, parent_key binary, key binary, ends_sha256 string, part long, no long, ids string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _table(n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS)], names=_NAMES)


def _path(key: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``depth`` tokens."""
    h, out = hashlib.blake2b(digest_size=WIDE), []
    for d in range(depth + 1):
        out.append(h.digest())
        h.update(key[WIDE * d : WIDE * (d + 1)])
    return out


class _Range:
    """The distinct sequences of a range in order, and then their nodes."""

    def __init__(self, part: int, fence: tuple[int, int]):
        self.part, (self.left, self.right) = part, (max(0, fence[0]), max(0, fence[1]))
        self.follows, self.goes_on = fence[0] >= 0, fence[1] >= 0
        self.keys: list[bytes] = []
        self.words: list[list[int]] = []
        self.firsts: list[int] = []
        self.counts: list[int] = []
        self.ends: list[str | None] = []
        self.ids: list[int] = []

    def add(self, key: bytes, words: list[int], conv_id: int) -> Iterator[pa.RecordBatch]:
        if not self.keys or key != self.keys[-1]:
            yield from self.close(False)
            self.keys.append(key)
            self.words.append(words)
            self.firsts.append(conv_id)
            self.counts.append(0)
        self.counts[-1] += 1
        self.ids.append(conv_id)

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Hashes the ids of the sequence that ends here, or hands them on where its node is open."""
        if self.ids:
            n = len(self.keys[-1]) // WIDE
            before, after = self.follows and len(self.keys) == 1 and self.left == n, last and self.goes_on and self.right == n
            if before or after or not n:
                name = _path(self.keys[-1], n)[-1]
                strings = [",".join(map(str, self.ids[i : i + IDS])) for i in range(0, len(self.ids), IDS)]
                m = len(strings)
                yield _table(m, kind=["ids"] * m, key=[name] * m, part=[self.part] * m, no=list(range(m)), ids=strings)
                self.ends.append(None)
            else:
                self.ends.append(hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest())
            self.ids = []

    def nodes(self) -> Iterator[pa.RecordBatch]:
        yield from self.close(True)
        m, left, right = len(self.keys), self.left, self.right
        sizes = np.array([len(k) // WIDE for k in self.keys])
        at = np.r_[0, np.cumsum(sizes)]
        tokens = np.frombuffer(b"".join(self.keys), "<u8").reshape(-1, 2)
        words = np.fromiter((w for ws in self.words for w in ws), np.int64, at[-1])
        # shared[i]: tokens that entries i-1 and i share
        shared = np.zeros(m, np.int64)
        shared[0] = left
        if m > 1:
            both = np.minimum(sizes[:-1], sizes[1:])
            row = np.repeat(np.arange(m - 1), both)
            place = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
            equal = (tokens[at[row] + place] == tokens[at[row + 1] + place]).all(1)
            shared[1:] = both
            np.minimum.at(shared, row[~equal] + 1, place[~equal])
        after = np.r_[shared[1:], right]
        minima, smallest = RangeMinimum(shared), RangeMinimum(np.array(self.firsts))
        # prefixes that occur first at an entry of this range, by entry and depth; before them those that the range before has too
        fresh = sizes - shared
        base = np.cumsum(fresh) - fresh
        entry = np.repeat(np.arange(m), fresh)
        depth = np.arange(len(entry)) - np.repeat(base, fresh) + shared[entry] + 1
        known = left + 1  # depths 0 to left of the first entry
        entry, depth = np.r_[np.zeros(known, np.int64), entry], np.r_[np.arange(known), depth]
        # running sums over entries and over new prefixes
        counts = np.array(self.counts)
        run = np.r_[0, np.cumsum(words)]
        total = np.r_[0, np.cumsum(counts * (run[at[1:]] - run[at[:-1]]))]
        members, leaves = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum((after < sizes) & (sizes > 0))]
        new = np.r_[0, np.cumsum(words[at[entry[known:]] + depth[known:] - 1])]
        n = len(entry)
        high, parent = np.empty(n, np.int64), np.full(n, -1)
        for i in range(0, n, SEARCHED):
            e, d = entry[i : i + SEARCHED], depth[i : i + SEARCHED]
            high[i : i + SEARCHED] = minima.right(e, d)
            low = minima.left(e, d - 1)
            first = d - 1 > shared[low]
            parent[i : i + SEARCHED] = np.where(first, known + base[low] + d - 2 - shared[low], d - 1)
        parent[0] = -1
        low = entry
        figures = {
            "conv_id": smallest(low, high), "depth": depth, "n_convs": members[high + 1] - members[low],
            "n_children": np.bincount(parent[known:], minlength=n), "n_leaves": leaves[high + 1] - leaves[low],
        }
        own = np.r_[np.zeros(known, np.int64), np.arange(n - known)]  # running number among new prefixes
        before = np.where(depth > 0, run[at[low] + np.maximum(depth - 1, 0)] - run[at[low]], 0)
        figures["saved_tokens"] = total[high + 1] - total[low] - before * figures["n_convs"] - (new[base[high] + fresh[high]] - new[own])
        is_open = np.arange(n) < known
        is_open |= (high == m - 1) & (depth <= right)
        start, end = _path(self.keys[0], left), _path(self.keys[-1], right)
        name = lambda j: start[depth[j]] if j < known else end[depth[j]]

        def rows(kind: str, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(chosen), 1 << 16):
                c = chosen[i : i + (1 << 16)]
                p = parent[c]
                far = (p < 0) | is_open[p]
                ends = [self.ends[e] or _NONE if d == sizes[e] else _NONE for e, d in zip(entry[c].tolist(), depth[c].tolist())]
                yield _table(
                    len(c), kind=[kind] * len(c), **{k: v[c] for k, v in figures.items()},
                    parent_conv_id=pa.array(figures["conv_id"][p], mask=far),
                    parent_key=[name(j) if f and j >= 0 else None for j, f in zip(p.tolist(), far.tolist())],
                    key=[name(j) for j in c.tolist()] if kind == "open" else [None] * len(c),
                    ends_sha256=ends,
                )

        yield from rows("node", np.flatnonzero(~is_open))
        yield from rows("open", np.flatnonzero(is_open))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of rows (key, part, no, ids) that stand in order."""
    key, h = None, None
    done: list[tuple[bytes, str]] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["key", "ends"])
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            if k != key:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if len(done) > SLICE:
            yield flush()
            done.clear()
    if h:
        done.append((key, h.hexdigest()))
    yield flush()


def trie(sequences: DataFrame, ranges: int) -> DataFrame:
    """The nodes of all sequences (conv_id, key, words)."""
    ordered = sequences.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = written(ordered.withColumn("part", F.spark_partition_id().cast("long")), "ordered")
    known = fences(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for part, key, conv_id, words in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is None or now.part != part:
                    if now:
                        yield from now.nodes()
                    now = _Range(part, known[part])
                yield from now.add(key, words, conv_id)
        if now:
            yield from now.nodes()

    dealt = ordered.select("part", "key", "conv_id", "words").repartition(ranges, "part").sortWithinPartitions("part", "key", "conv_id")
    found = written(dealt.mapInArrow(run, _SCHEMA), "nodes")
    ids = found.where("kind = 'ids'").select("key", "part", "no", "ids").repartition("key").sortWithinPartitions("key", "part", "no")
    ends = ids.mapInArrow(_hashed, "key binary, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    inside = F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))).alias("inside")  # all members that end there in one range
    parts = found.where("kind = 'open'").groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.any_value("parent_key", True).alias("parent_key"), inside, *sums)
    opened = written(parts.join(ends, "key", "left"), "open")
    # a small table: Spark broadcasts it where its files are small enough, and splits a parent of very many otherwise
    above = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = found.where("kind = 'node'")
    inner = nodes.where("parent_key is null").select(*out)
    beside = nodes.where("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("parent", "parent_conv_id").select(*out)
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long")
    open_nodes = opened.join(above, "parent_key", "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", leaves.alias("n_leaves"), "saved_tokens", F.coalesce("ends", "inside", F.lit(_NONE)).alias("ends_sha256"),
    )
    return inner.unionByName(beside).unionByName(open_nodes)


def ranges_of(conversations: DataFrame) -> int:
    """Ranges of about ``TURNS`` turns, as many as the session's partitions at least."""
    return max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // TURNS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(conversations), ranges_of(conversations))


#: crc32 of a decimal, its remainder by 4 as ``h``: the table of the reflected polynomial and a fold over the digits.
OP12_SQL = r"""
with crc as materialized (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), x::bigint)) as tab),
turns as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, token) as i, token,
    length(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as words
  from (select conv_id, turn, coalesce(text, '') as text, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) as token
        from conversations where conv_id is not null)),
convs as materialized (
  select conv_id, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from turns), crc),
parts as (
  select c.conv_id, 0 as late, t.i, t.token, t.words from convs c join turns t on t.conv_id = c.base and t.i <= c.h
  union all select c.conv_id, 1, t.i, t.token, t.words from convs c join turns t on t.conv_id = c.conv_id and t.i > c.h),
placed as (select conv_id, row_number() over (partition by conv_id order by late, i) as depth, token, words from parts),
inst as materialized (
  select conv_id, depth, words, sha256(string_agg(token, '' order by depth) over (partition by conv_id order by depth rows unbounded preceding)) as node,
    depth = max(depth) over (partition by conv_id) as is_last
  from placed
  union all
  select conv_id, 0, 0, 'root', not exists (select 1 from placed p where p.conv_id = convs.conv_id) from convs),
nodes as materialized (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_last), '')) as ends_sha256
  from inst group by node, depth),
paths as materialized (select n.node, i.node as above, i.depth as up from nodes n join inst i on i.conv_id = n.conv_id and i.depth <= n.depth),
children as materialized (select p.above as node, count(*) as n from paths p join nodes n on n.node = p.node where p.up = n.depth - 1 group by p.above),
below as (
  select p.above as node, sum((n.n_convs - 1) * n.words) as saved, count(*) filter (where c.n is null) as leaves
  from paths p join nodes n on n.node = p.node left join children c on c.node = p.node group by p.above)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0)::bigint as n_children, b.leaves::bigint as n_leaves,
  b.saved::bigint as saved_tokens, n.ends_sha256
from nodes n left join children c on c.node = n.node join below b on b.node = n.node
left join paths p on p.node = n.node and p.up = n.depth - 1 left join nodes q on q.node = p.above
"""
