"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

Leaves are runs of words inside a sentence, with the white space after them, so the leaves of a text put together are
the text. A run of ``LEAST`` characters ends after a word whose own hash says so (one in four), any run at the
sentence's end and at ``LONGEST`` characters at the latest; a word of more than ``WORD`` characters (junk, scripts
without spaces) is itself cut after a pair of characters that says so. Cuts are taken from left to right and no cut
depends on what follows its word, so texts without a full stop or line break share the leaves of an unchanged half
unless it is shorter than about ``LONGEST`` characters. A paragraph (a line) hashes its leaves, a section hashes its paragraphs, the root hashes the sections. A section ends after a paragraph whose own hash says so
(one in eight), hence an edit moves no section border but those beside it. Equal roots mean equal texts;
``differing`` walks down from unequal branches to the paragraphs of edits and ``located`` on to the characters.

The fingerprint is the root, the branches (hash and length in characters of every section, in order), and the smallest
``KEEP`` leaf hashes. Two fingerprints can be compared alone: equal roots mean equal texts, ``lacking`` locates the
sections that differ, and ``likeness`` estimates the share of common leaves (exact up to ``KEEP`` leaves).
A leaf that a text repeats counts each time: its second and later occurrences have hashes of their own.

The query pairs each text with the next one in descending order of id. Rows fall into ranges of about equal counts, by id
and, where one id (or none) has more rows than a range, by the hash of the text; each range also receives the first row of the range
below, so a task reads its ranges in order and holds two texts at a time. Only range borders and one id and hash per range
reach the driver. The columns ``lost`` and ``gained`` locate
the edit: characters start:end of the text that the edited one lacks, and of the edited text that the text lacks.

``doc_id`` is a whole number. Null texts count as empty: their tree has no leaves. Null ids stand last. Equal ids are ordered by the hash of the text
(64 bits), then by text; each row has its own successor. A table of one row is its own successor; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, table

KEEP = 64
#: Characters of a leaf that a word may end, of a leaf at most, and of a word that is not cut.
LEAST, LONGEST, WORD = 12, 24, 16
_SENTENCE = re.compile(r"[^.!?\n。！？]*[.!?\n。！？]+\s*|[^.!?\n。！？]+")
_WORD = re.compile(r"\S+\s*|\s+")


def _hash(parts: bytes, level: bytes) -> bytes:
    return hashlib.blake2b(parts, digest_size=16, person=level).digest()


def _parts(word: str) -> list[str]:
    """A long word cut after pairs of characters that say so, and after ``WORD`` characters at the latest."""
    out, at, before = [], 0, 0
    for i, c in enumerate(map(ord, word), 1):
        if (c - before) % 8 == 3 or i - at == WORD:
            out.append(word[at:i])
            at = i
        before = c
    return out if at == len(word) else [*out, word[at:]]


def leaves(text: str) -> list[str]:
    out, crc = [], zlib.crc32
    for s in _SENTENCE.findall(text):
        start = at = 0
        for w in _WORD.findall(s):
            for p in (w,) if len(w) <= WORD else _parts(w):
                end = at + len(p)
                if end - start > LONGEST:
                    out.append(s[start:at])
                    start = at
                at = end
                if at - start >= LEAST and not crc(p.encode("utf-8", "surrogatepass")) & 3:
                    out.append(s[start:at])
                    start = at
        if start < at:
            out.append(s[start:])
    return out


def tree(text: str, cut: list[str] | None = None) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]]:
    """(root, sections); a section is (hash, paragraphs) and a paragraph (hash, leaf hashes). ``cut`` has the leaves,
    if they are known."""
    sections: list = []
    paragraphs: list = []
    own: list[bytes] = []

    def end_paragraph():
        nonlocal own, paragraphs
        if own:
            h = _hash(b"".join(own), b"paragraph")
            paragraphs.append((h, own))
            own = []
            if h[0] % 8 == 0:
                end_section()

    def end_section():
        nonlocal paragraphs
        if paragraphs:
            sections.append((_hash(b"".join(h for h, _ in paragraphs), b"section"), paragraphs))
            paragraphs = []

    for s in leaves(text) if cut is None else cut:
        own.append(_hash(s.encode("utf-8", "surrogatepass"), b"leaf"))
        if "\n" in s:
            end_paragraph()
    end_paragraph()
    end_section()
    return _hash(b"".join(h for h, _ in sections), b"root"), sections


def lacking(a: str, b: str) -> list[tuple[int, int]]:
    """Characters start:end of the text of fingerprint ``a`` whose sections the text of ``b`` lacks, from the fingerprints
    alone; neighbouring sections are one span."""
    there = {x.split(":")[0] for x in b.split("-")[1].split(",")}
    out: list[tuple[int, int]] = []
    at = 0
    for x in filter(None, a.split("-")[1].split(",")):
        h, n = x.split(":")
        if h not in there:
            out = [*out[:-1], (out[-1][0], at + int(n))] if out and out[-1][1] == at else [*out, (at, at + int(n))]
        at += int(n)
    return out


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branch ``b`` lacks; unequal branches only are entered."""
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return []
    there, below = {h for h, _ in sb}, {h for _, ps in sb for h, _ in ps}
    return [(i, j) for i, (h, ps) in enumerate(sa) if h not in there for j, (p, _) in enumerate(ps) if p not in below]


def located(cut: list[str], a: tuple, b: tuple) -> str:
    """Characters start:end of the text with leaves ``cut`` and tree ``a`` that lie in no branch of the tree ``b``, joined
    by commas; unequal branches only are entered, and neighbouring leaves are one span."""
    (ra, sa), (rb, sb) = a, b
    if ra == rb:
        return ""
    there, below = {h for h, _ in sb}, {h for _, ps in sb for h, _ in ps}
    held = {x for _, ps in sb for _, own in ps for x in own}
    spans: list[list[int]] = []
    at = k = 0
    for h, ps in sa:
        for p, own in ps:
            equal = h in there or p in below
            for x in own:
                end = at + len(cut[k])
                k += 1
                if not equal and x not in held:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = end
                    else:
                        spans.append([at, end])
                at = end
    return ",".join(f"{x}:{y}" for x, y in spans)


def fingerprint(text: str) -> str:
    return _fingerprint(tree(text, cut := leaves(text)), cut)


def _fingerprint(of: tuple, cut: list[str]) -> str:
    root, sections = of
    sizes = iter(map(len, cut))
    branches = ",".join(f"{h[:8].hex()}:{sum(next(sizes) for _, own in ps for _ in own)}" for h, ps in sections)
    held = Counter(x for _, ps in sections for _, own in ps for x in own)
    small = {x[:4] for x in held}
    small |= {_hash(x + n.to_bytes(8, "big"), b"again")[:4] for x, c in held.items() if c > 1 for n in range(1, c)}
    small = sorted(small)[:KEEP]
    return f"{root.hex()}-{branches}-{b''.join(small).hex()}"


def likeness(a: str, b: str) -> float:
    """Share of common leaves of two fingerprints: twice the common ones by both counts, from the smallest of either."""
    if a[:32] == b[:32]:
        return 1.0
    xs, ys = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a.rsplit("-", 1)[1], b.rsplit("-", 1)[1]))
    if not xs or not ys:
        return 0.0
    union = xs | ys
    if len(xs) >= KEEP or len(ys) >= KEEP:
        union = set(sorted(union)[:KEEP])
    common = len(union & xs & ys)
    return 2 * common / (len(union) + common)


class Ranges:
    """Which range of the order (id downwards, nulls last, then hash of the text) a row falls into.

    Ranges are numbered against the order. ``cuts`` are quantiles of the ids, in order; an id that is several of them is cut
    itself, into as many ranges of the hash, and null ids are cut into ``nulls`` ranges."""

    def __init__(self, cuts: list[int], nulls: int):
        self.borders, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.parts, self.nulls = np.where(times > 1, times, 0), max(1, nulls)
        self.step = int(self.parts.max(initial=0)) + 1

    def of(self, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        known, h = ids.notna().to_numpy(), hashes.to_numpy(np.int64)
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64
        part = lambda n: (n - 1 - np.minimum(np.floor(share * n), n - 1)).astype(np.int64)
        at = -self.nulls + part(np.full(len(h), self.nulls))
        values = ids[known].to_numpy(np.int64)
        i = np.searchsorted(self.borders, values, side="left")
        inside = np.minimum(i, max(0, len(self.borders) - 1))
        n = np.where((i < len(self.borders)) & (self.borders[inside] == values), self.parts[inside], 0) if len(self.borders) else np.zeros(len(values), np.int64)
        cut = np.full(len(h), 1)
        cut[known] = np.maximum(n, 1)
        at[known] = i * self.step + np.where(n > 0, 1 + part(cut)[known], 0)
        return at


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (doc_id, text, late, id_range), each range in order, its successor from the range after it last (late)."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    quantiles = F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), max(10_000, 4 * ranges)) if shares else F.lit(None).cast("array<long>")
    cuts, nulls, n = whole.select("doc_id").agg(quantiles, F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    parts = Ranges(cuts or [], -(-nulls * ranges // max(1, n)))
    hashed = whole.withColumn("h", F.xxhash64("text"))
    range_of = F.pandas_udf(lambda s, h: pd.Series(parts.of(s, h)), "long")
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("first")
    firsts = {r["r"]: (r["first"]["doc_id"], ~r["first"]["h"]) for r in hashed.select(range_of("doc_id", "h").alias("r"), "doc_id", "h").groupBy("r").agg(first).collect()}
    order = sorted(firsts)
    # the first row of each range goes to the range before it as well; that of the first one to the last
    extra = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}

    def targets(s: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for r, v, x in zip(parts.of(s, h), s, h):
            head, own = firsts[r]
            out.append([r, extra[r]] if own == x and ((head is None and pd.isna(v)) or head == v) else [r])
        return pd.Series(out)

    dealt = hashed.select("doc_id", "text", "h", F.posexplode(F.pandas_udf(targets, "array<long>")("doc_id", "h")).alias("late", "id_range"))
    return dealt.repartition("id_range").sortWithinPartitions("id_range", "late", F.col("doc_id").desc_nulls_last(), "h", "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lost", "gained"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lost string, gained string"


def _pairs(batches):
    before = None  # (range, late, doc_id, text, fingerprint, leaves, tree)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = []
            for doc_id, text, late, where in zip(*(part.column(i).to_pylist() for i in range(4))):
                own = tree(text, cut := leaves(text))
                now = (where, late, doc_id, text, _fingerprint(own, cut), cut, own)
                if before is not None and before[0] == where and not before[1]:
                    new = edited(before[3], text)
                    other = tree(new, new_cut := leaves(new))
                    fp = _fingerprint(other, new_cut)
                    places = located(before[5], before[6], other), located(new_cut, other, before[6])
                    rows.append((before[2], len(before[3]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), before[4], fp, likeness(before[4], fp), likeness(before[4], now[4]), *places))
                before = now
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                yield batch_of(_NAMES, [pa.array(c, k) for c, k in zip(zip(*rows), kinds)])


def fingerprints(docs: DataFrame) -> DataFrame:
    ranges = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, ranges).select("doc_id", "text", "late", "id_range").mapInArrow(_pairs, _SCHEMA)


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
