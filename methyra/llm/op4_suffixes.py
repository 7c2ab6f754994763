"""Removal of repeated byte strings by a sampled suffix array, sorted deep-shallow.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (smaller document id, or earlier in the same
document); strings are judged on the input and never cross documents.

Every string of ``LENGTH`` bytes holds an *anchor*: the ``GRAM``-byte gram of least hash among those in it (the leftmost
of equal ones). Equal strings have equal anchors at equal places, so starts need comparing only among occurrences of
the same anchor gram, and an anchor stands for the run of starts that choose it (about one start in 35 is an anchor).

1. Each document's anchors are found with their gram hash, the range of starts they stand for and two hashes (128 bits,
   of independent bases) of the bytes that those starts cover (the context). Within a task equal contexts keep their
   first occurrence; the others repeat.
2. Anchors meet by gram. Of equal contexts the first stays, the others repeat as a whole. Grams with several distinct
   contexts are *open*: some of their starts may be equal.
3. The contexts of open grams are fetched, and the suffixes from each anchor (to the right, and mirrored to the left)
   are sorted: multikey quicksort by eight-byte words (three-way partitions of all groups at once) down to a shallow
   depth, then a blind trie for each group that still shares its prefix. From both orders and their common-prefix
   lengths, the starts at distance d left of the anchor are equal where d bytes to the left and LENGTH - d to the right
   are. The first of each class stays.

Contexts count as equal where gram hash and both context hashes agree (192 bits); all other decisions compare bytes,
or, for frequent grams, both hashes of the whole string. Among 10^12 contexts the chance of one false equality is
below 10^-14.

Grams that a task sees very often with different contexts (a short line in a third of all documents) would meet
in one task. The starts of the ``LISTED`` most frequent such grams are compared one by one instead, dealt by the hash of
the whole string. Any other gram has at most about ``CONTEXTS`` contexts over all tasks or a ``LISTED``-th part of all
frequent contexts, and goes the way above; results are the same either way.

``doc_id`` is a whole number. Null texts count as empty, texts under ``LENGTH`` bytes lose nothing. Null ids come after
all others. Rows that repeat an id are ordered by a row number given once when the texts are stored. Empty tables give
no rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, mix64, scratch, table, texts_of, written

LENGTH, GRAM = 100, 32
#: Bytes by which groups are sorted before blind tries take over.
SHALLOW = 16
#: Distinct contexts of one gram in one task from which the gram counts as frequent, and contexts that a gram may have over all
#: tasks without that: with very many tasks the first is lowered to keep the second.
FREQUENT, CONTEXTS = 64, 1 << 17
#: Frequent grams that are told apart; an exact way serves those beyond.
LISTED = 4096

_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, base, np.uint64), out=out[1:])
    return out


class Hashes:
    """Polynomial hashes of all substrings of a byte array: prefix sums of byte * base^i, scaled back to place 0."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASE):
        n = len(data)
        self.back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(base, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.back[start])


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every window."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    low, span = values, 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b < a
        low = np.where(right, b, a)
        best = np.where(right, best[step:], best[:-step])
        span += step
    return best[:n]


def anchors(data: np.ndarray, check: bool = True) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, gram hash, context hash, second context hash) of each anchor of one document;
    without ``check`` the second hash is 0."""
    empty, none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return empty, empty, empty, none, none, none
    h = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = h.of(at, at + GRAM)
    chosen = _window_min(grams, LENGTH - GRAM + 1)
    cut = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    first, last = cut, np.r_[cut[1:], len(chosen)] - 1
    place = chosen[cut]
    left = (place - first).astype(np.uint64) * _BASE
    second = mix64(Hashes(data, _OTHER).of(first, last + LENGTH) + left) if check else np.zeros(len(cut), np.uint64)
    return place, first, last, grams[place], mix64(h.of(first, last + LENGTH) ^ left), second


# -- deep-shallow sorting ------------------------------------------------------------------------------------------


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian eight-byte words."""
    n, w = rows.shape
    padded = np.zeros((n, -(-w // 8) * 8), np.uint8)
    padded[:, :w] = rows
    return padded.view(">u8").astype(np.uint64)


class BlindTrie:
    """Orders strings of one length that share a prefix: a trie that keeps branching places only, so an insertion walks
    blindly to some leaf, compares once, and branches where the two differ."""

    def __init__(self, strings: list[bytes]):
        self._s = strings
        self._root: list | int | None = None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        # A leaf is [ids of equal strings]; a branch is (place, {byte: node}).
        s = self._s[i]
        if self._root is None:
            self._root = [i]
            return
        node = self._root
        while isinstance(node, tuple):
            place, kids = node
            node = kids.get(s[place]) or next(iter(kids.values()))
        t = self._s[node[0]]
        if s == t:
            node.append(i)
            return
        x = int.from_bytes(s) ^ int.from_bytes(t)
        split = len(s) - 1 - (x.bit_length() - 1) // 8
        node, above = self._root, None
        while isinstance(node, tuple) and node[0] < split:
            above = (node[1], s[node[0]])
            node = node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == split:
            node[1][s[split]] = [i]
            return
        branch = (split, {t[split]: node, s[split]: [i]})
        if above is None:
            self._root = branch
        else:
            above[0][above[1]] = branch

    def ordered(self) -> list[tuple[int, int]]:
        """(id, common prefix with the one before) in order; the first has 0, equal strings their whole length."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[object, int]] = [(self._root, 0)] if self._root is not None else []
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, tuple):
                place, kids = node
                order = sorted(kids)
                for k in reversed(order[1:]):
                    stack.append((kids[k], place))
                stack.append((kids[order[0]], lcp))
            else:
                out.append((node[0], lcp))
                out += [(i, len(self._s[i])) for i in node[1:]]
        return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Order of rows by group and then by their first ``depth`` words. All segments of rows that agree so far are
    partitioned at once around their own pivot (the median of three): rows below and above it stay at their word, rows
    equal to it go on with the next."""
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.empty(0, bool)
    pos, seg = np.arange(len(order)), np.cumsum(new) - 1
    level = np.zeros(int(new.sum()), np.int64)
    while len(pos):
        # keep the segments that have several rows and words left
        size = np.bincount(seg, minlength=len(level))
        keep = (size > 1) & (level < depth)
        at = keep[seg]
        pos, seg = pos[at], (np.cumsum(keep) - 1)[seg[at]]
        level, size = level[keep], size[keep]
        if not len(pos):
            break
        word = words[order[pos], level[seg]]
        start = np.cumsum(size) - size
        pivot = np.sort(np.stack([word[start], word[start + size // 2], word[start + size - 1]]), axis=0)[1][seg]
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1
        key = 3 * seg + side
        moved = np.argsort(key, kind="stable")
        order[pos] = order[pos[moved]]
        key = key[moved]
        new = np.r_[True, key[1:] != key[:-1]]
        seg = np.cumsum(new) - 1
        level = level[key[new] // 3] + (key[new] % 3 == 1)
    return order


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows within groups, and the common prefix of each with the one before it in that order (-1 where a
    group begins)."""
    n, width = rows.shape
    words = _words(rows)
    depth = min(SHALLOW // 8, words.shape[1])
    order = multikey_quicksort(words, group, depth)
    lcp = np.zeros(n, np.int64)
    g = group[order]
    lcp[np.r_[True, g[1:] != g[:-1]]] = -1
    going = lcp >= 0
    for i in range(depth):
        w = words[order, i]
        diff = w.copy()
        diff[1:] ^= w[:-1]
        same = diff == 0
        high = np.zeros(n, np.int64)
        some = going & ~same
        low = some & ((diff >> np.uint64(32)) == 0)
        top = some & ~low
        high[top] = (31 - np.floor(np.log2((diff[top] >> np.uint64(32)).astype(np.float64))).astype(np.int64)) // 8
        high[low] = 4 + (31 - np.floor(np.log2((diff[low] & np.uint64(0xFFFFFFFF)).astype(np.float64))).astype(np.int64)) // 8
        lcp[some] = 8 * i + high[some]
        going &= same
    if 8 * depth < width:
        # runs of rows that share the shallow prefix
        deep = going
        starts = np.flatnonzero(~deep & np.r_[deep[1:], False])
        ends = np.flatnonzero(deep & ~np.r_[deep[1:], False]) + 1
        for a, b in zip(starts, ends):
            ids = order[a:b]
            found = BlindTrie([rows[i].tobytes() for i in ids]).ordered()
            order[a:b] = ids[[i for i, _ in found]]
            lcp[a + 1 : b] = [x for _, x in found[1:]]
    else:
        lcp[going] = width
    lcp[lcp > width] = width
    return order, lcp


def repeated_starts(group: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """(row, distance of the start left of the anchor) of all starts whose string an earlier row of the group has too.

    ``left``: bytes before the anchor, mirrored; ``right``: bytes from the anchor on; ``first`` and ``last``: the largest
    and the smallest distance that a row stands for; ``rank``: order of occurrence.
    """
    n, reach = len(group), LENGTH - GRAM
    lo, llcp = deep_shallow(left, group)
    ro, rlcp = deep_shallow(right, group)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lclass, rclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach + 1):
        on = (first >= d) & (last <= d)
        if on.sum() < 2:
            continue
        lclass[lo] = np.cumsum(llcp < d)
        rclass[ro] = np.cumsum(rlcp < LENGTH - d)
        rows = np.flatnonzero(on)
        order = rows[np.lexsort([rank[rows], rclass[rows], lclass[rows]])]
        same = (lclass[order][1:] == lclass[order][:-1]) & (rclass[order][1:] == rclass[order][:-1])
        again = order[1:][same]
        found.append((again, np.full(len(again), d)))
    if not found:
        return []
    return list(zip(np.concatenate([x for x, _ in found]).tolist(), np.concatenate([x for _, x in found]).tolist()))


# -- stages --------------------------------------------------------------------------------------------------------

_ANCHOR = "gram long, context long, second long, doc_id long, uid long, spot long"
_NAMES = [x.split()[0] for x in _ANCHOR.split(", ")]
#: Kinds of anchor rows: a first occurrence in its task, a known repetition, a start of a frequent gram.
FIRST, AGAIN, SINGLE = 0, 1, 2
_LAST_ID = (1 << 63) - 1


def packed(kind: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place, distances of the first and the last start to its left (under 128), and kind as one number, in that order."""
    return (place << 16) | ((place - first) << 9) | ((place - last) << 2) | kind


def unpacked(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, place, first, last) of ``packed`` numbers."""
    place = spot >> 16
    return spot & 3, place, place - (spot >> 9 & 127), place - (spot >> 2 & 127)


def _anchor_rows(frequent: set[int]):
    big = np.array(sorted(frequent), np.int64)

    def run(batches):
        parts: dict[int, list] = {FIRST: [], SINGLE: []}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for doc_id, uid, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts_of(some)):
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    place, first, last, *hashes = anchors(data)
                    if not len(place):
                        continue
                    doc = _LAST_ID if doc_id is None else doc_id
                    gram, context, second = (x.view(np.int64) for x in hashes)
                    often = np.isin(gram, big)
                    if often.any():
                        starts = np.concatenate([np.arange(f, l + 1) for f, l in zip(first[often], last[often])])
                        whole = [Hashes(data, x).of(starts, starts + LENGTH).view(np.int64) for x in (_BASE, _OTHER)]
                        parts[SINGLE].append((np.repeat(gram[often], (last - first + 1)[often]), *whole, *_owner(doc, uid, len(starts)), packed(SINGLE, starts, starts, starts)))
                        gram, context, second, place, first, last = (x[~often] for x in (gram, context, second, place, first, last))
                    parts[FIRST].append((gram, context, second, *_owner(doc, uid, len(place)), packed(FIRST, place, first, last)))
        for rows in parts.values():
            if not rows:
                continue
            gram, context, second, doc, uid, spot = (np.concatenate(x) for x in zip(*rows))
            rows.clear()
            order = np.lexsort([spot, uid, doc, second, context, gram])
            gram, context, second, doc, uid, spot = (x[order] for x in (gram, context, second, doc, uid, spot))
            again = np.zeros(len(order), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (second[1:] == second[:-1])
            spot[again] = spot[again] & ~3 | AGAIN
            for x in (gram, context, second):  # what is known to repeat meets no other row
                x[again] = 0
            for at in range(0, len(order), 50_000):
                yield batch_of(_NAMES, [pa.array(x[at : at + 50_000], pa.int64()) for x in (gram, context, second, doc, uid, spot)])

    return run


def _owner(doc: int, uid: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, doc), np.full(n, uid)


def _frequent_grams(tasks: int):
    """Grams with many distinct contexts in a task."""
    least = max(2, min(FREQUENT, CONTEXTS // tasks))
    return lambda batches: _often(batches, least)


def _often(batches, least: int):
    grams, contexts = [], []
    for b in batches:
        for text in texts_of(b):
            _, _, _, g, c, _ = anchors(np.frombuffer(text.encode("utf-8"), np.uint8), check=False)
            if len(g):
                grams.append(g)
                contexts.append(c)
    if not grams:
        return
    g, c = np.concatenate(grams), np.concatenate(contexts)
    order = np.lexsort([c, g])
    g, c = g[order], c[order]
    g, n = np.unique(g[np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]], return_counts=True)
    many = n >= least
    if many.any():
        yield batch_of(["gram", "n"], [pa.array(g[many].view(np.int64)), pa.array(n[many].astype(np.int64))])


def _contexts(batches):
    """Rows of open anchors with their texts become rows with the bytes left (mirrored) and right of the anchor."""
    reach = LENGTH - GRAM
    names = ["gram", "doc_id", "uid", "place", "first", "last", "left", "right"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = b.slice(at, 256)
            out: list[tuple] = []
            for doc_id, uid, spots, text in zip(*(some.column(i).to_pylist() for i in range(3)), texts_of(some)):
                data = text.encode("utf-8")
                for s in spots:
                    p, f, l = s["place"], s["first"], s["last"]
                    out.append((s["gram"], doc_id, uid, p, f, l, data[f:p][::-1], data[p : l + LENGTH]))
            if out:
                kinds = [*[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary(), pa.binary()]
                yield batch_of(names, [pa.array(c, k) for c, k in zip(zip(*out), kinds)])


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0")[:width] for s in strings), np.uint8).reshape(len(strings), width)


def _open_starts(batches):
    """Repeated starts of open grams; rows come sorted by gram."""
    pending: list[pa.RecordBatch] = []
    held = 0

    def solve(t: pa.Table):
        if not t.num_rows:
            return None
        gram, doc, uid, place, first, last = (t.column(i).to_numpy() for i in range(6))
        rank = np.empty(t.num_rows, np.int64)
        rank[np.lexsort([place, uid, doc])] = np.arange(t.num_rows)
        left = _matrix(t.column(6).to_pylist(), LENGTH - GRAM)
        right = _matrix(t.column(7).to_pylist(), LENGTH)
        pairs = repeated_starts(gram, left, right, place - first, place - last, rank)
        if not pairs:
            return None
        row, d = np.array(pairs, np.int64).T
        return batch_of(["uid", "first", "last"], [pa.array(uid[row]), pa.array((place[row] - d).astype(np.int32)), pa.array((place[row] - d).astype(np.int32))])

    for b in batches:
        pending.append(b)
        held += b.num_rows
        if held >= 100_000:
            t = pa.Table.from_batches(pending)
            gram = t.column(0).to_numpy()
            cut = int(np.searchsorted(gram == gram[-1], True)) if gram[0] != gram[-1] else 0
            if cut:
                out = solve(t.slice(0, cut))
                pending, held = t.slice(cut).to_batches(), t.num_rows - cut
                if out is not None:
                    yield out
    if pending:
        out = solve(pa.Table.from_batches(pending))
        if out is not None:
            yield out


def _removed(batches):
    """Digest of each document without its repeated strings."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = b.slice(at, 256)
            rows = []
            for doc_id, runs, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts_of(some)):
                data = text.encode("utf-8")
                spans = merged(runs or [])
                kept, last = [], 0
                for s, e in spans:
                    kept.append(data[last:s])
                    last = e
                kept.append(data[last:])
                rows.append((doc_id, len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            if rows:
                yield batch_of(names, [pa.array(c, k) for c, k in zip(zip(*rows), [*[pa.int64()] * 4, pa.string()])])


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed spans from runs of repeated starts."""
    out: list[list[int]] = []
    for s, e in sorted((r["first"], r["last"] + LENGTH) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, uid, text) as files in the shared folder, bucketed by uid: later stages join by it without moving
    texts."""
    spark = docs.sparkSession
    n = _partitions(spark)
    name, path = f"methyra_{uuid.uuid4().hex}", f"{scratch(spark)}/texts"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).select("doc_id", "uid", "text")
    rows.repartition(n, "uid").write.bucketBy(n, "uid").option("path", path).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay in the shared folder while the plan reads them
    return texts


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(uid, first, last): runs of starts whose string also starts earlier."""
    seen = texts.select("text").mapInArrow(_frequent_grams(_partitions(texts.sparkSession)), "gram long, n long")
    frequent = {r[0] for r in seen.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(LISTED).collect()}
    found = texts.select("doc_id", "uid", "text").mapInArrow(_anchor_rows(frequent), _ANCHOR)
    # first occurrences meet by gram, whole strings by themselves; what is known to repeat goes anywhere
    kind = F.col("spot").bitwiseAND(F.lit(3))
    key = F.when(kind == FIRST, F.col("gram")).when(kind == SINGLE, F.xxhash64("gram", "context")).otherwise(F.xxhash64("uid", "spot"))
    dealt = found.repartition(key).sortWithinPartitions(kind, "gram", "context", "second", "doc_id", "uid", "spot")
    judged = written(dealt.mapInArrow(_judge, "open boolean, gram long, uid long, place int, first int, last int"), "judged")
    later = judged.where("not open").select("uid", "first", "last")

    spots = judged.where("open").groupBy("uid").agg(F.collect_list(F.struct("gram", "place", "first", "last")).alias("spots"))
    contexts = texts.join(spots, "uid").select("doc_id", "uid", "spots", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)))
    near = contexts.mapInArrow(_contexts, "gram long, doc_id long, uid long, place int, first int, last int, left binary, right binary")
    starts = near.repartition("gram").sortWithinPartitions("gram").mapInArrow(_open_starts, "uid long, first int, last int")

    return later.unionByName(starts)


def _judge(batches):
    """Of anchors sorted by kind, gram, context and occurrence: repetitions (not open), and the first of each context where
    its gram has several (open)."""
    names = ["open", "gram", "uid", "place", "first", "last"]
    tail: pa.Table | None = None

    def solve(t: pa.Table):
        gram, context, second, uid, spot = (t.column(x).to_numpy() for x in ("gram", "context", "second", "uid", "spot"))
        kind, place, first, last = unpacked(spot)
        new_gram = np.r_[True, (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])]
        new = (new_gram | np.r_[True, (context[1:] != context[:-1]) | (second[1:] != second[:-1])]) & (kind != AGAIN)
        group = np.cumsum(new_gram) - 1
        several = np.bincount(group, weights=new)[group] > 1
        keep = ~new | (several & (kind == FIRST))
        return batch_of(names, [pa.array(new[keep]), *(pa.array(x[keep]) for x in (gram, uid)), *(pa.array(x[keep].astype(np.int32)) for x in (place, first, last))])

    for b in batches:
        t = pa.Table.from_batches([b])
        if tail is not None:
            t = pa.concat_tables([tail, t]).combine_chunks()
        if not t.num_rows:
            continue
        kind, gram = t.column("spot").to_numpy() & 3, t.column("gram").to_numpy()
        cut = int(np.argmax((kind == kind[-1]) & (gram == gram[-1])))
        if cut:
            yield solve(t.slice(0, cut))
        tail = t.slice(cut)
    if tail is not None and tail.num_rows:
        yield solve(tail)


def without_repeats(docs: DataFrame) -> DataFrame:
    texts = stored(docs)
    runs = repeated_runs(texts).groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(runs, "uid", "left").select("doc_id", "runs", "text").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
