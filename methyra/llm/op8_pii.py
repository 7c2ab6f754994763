"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://``, plus signs, digits and identifier cues. From
each anchor a deterministic local parser expands to both sides and validates: e-mail addresses around at-signs,
numbered addresses, cards and phone numbers from digits and plus signs, web addresses after a scheme, and account
values after a cue. The base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of
their definitions; ``url`` and ``account`` are added by the method and take nothing from the base.

Offsets count code points, ends are exclusive. Null texts count as empty; rows are handled one by one, so repeated
rows, ties, null ids and extra columns (dropped) change nothing. Work is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch_of, col_of, lower_ascii, spread, table, texts_of

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Cue words before an account-like value, in any case of their letters.
CUES = ("account", "acct", "iban", "konto", "passport", "ssn", "customer id", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_HOST = re.compile(r"[A-Za-z0-9._~%:@\[\]-]+(?:[/?#][^\s<>\"']*)?")
_VALUE = re.compile(r"[ \t]*(?:no\.?|number|nr\.?)?[ \t]*[:=#]?[ \t]*([A-Z0-9][A-Z0-9-]{4,33}[A-Z0-9])(?![A-Za-z0-9])")
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, "d")
        a.add_word("@", "@")
        a.add_word("+", "+")
        a.add_word("://", "/")
        for cue in CUES:
            a.add_word(cue, "c")
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digit_runs(at: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    start = prev = -2
    for i in at:
        if i != prev + 1:
            if start >= 0:
                runs.append((start, prev + 1))
            start = i
        prev = i
    if start >= 0:
        runs.append((start, prev + 1))
    return runs


def _emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in ats:
        if at < floor:
            continue
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
    return out


def _ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i + 3 < len(runs):
        part = runs[i : i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(part, part[1:])):
            if all(len(n := text[a:b].lstrip("0")) < 3 or len(n) == 3 and n <= "255" for a, b in part):
                out.append((part[0][0], part[3][1]))
            i += 4
        else:
            i += 1
    return out


def _cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(runs):
        j, count = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
            count += runs[j][1] - runs[j][0]
        if 14 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append((runs[i][0], runs[j][1]))
        i = j + 1
    return out


def _phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in pluses:
        if at >= floor and (m := _PHONE.match(text, at)):
            floor = m.end()
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(m.span())
    return out


def _urls(text: str, slashes: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in slashes:
        if at < floor:
            continue
        scheme = _SCHEME.search(text[max(floor, at - 16) : at])
        host = _HOST.match(text, at + 3)
        if scheme and host:
            out.append((at - len(scheme[0]), host.end()))
            floor = host.end()
    return out


def _accounts(text: str, cues: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in cues:
        m = _VALUE.match(text, at)
        if m and m.start(1) >= floor and sum(c.isdigit() for c in m[1]) >= 4:
            out.append(m.span(1))
            floor = m.end(1)
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by the order of ``KINDS``."""
    digits: list[int] = []
    ats: list[int] = []
    pluses: list[int] = []
    slashes: list[int] = []
    cues: list[int] = []
    for end, kind in _automaton().iter(lower_ascii(text)):
        if kind == "d":
            digits.append(end)
        elif kind == "@":
            ats.append(end)
        elif kind == "+":
            pluses.append(end)
        elif kind == "/":
            slashes.append(end - 2)
        else:
            cues.append(end + 1)
    if not (digits or ats or slashes):
        return []
    runs = _digit_runs(digits)
    spans = [(_emails(text, ats)), _ips(text, runs), _cards(text, runs), _phones(text, pluses), _urls(text, slashes), _accounts(text, cues)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((a, b, k) for k, found in zip(KINDS, spans) for a, b in found), key=lambda x: (x[0], order[x[2]], x[1]))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"]

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [find(t) for t in texts_of(b)]
            counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in KINDS[:4]]
            base = [hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, e, k in f if k in KINDS[:4]).encode()).hexdigest() for f in found]
            every = [",".join(f"{k}:{a}:{e}" for a, e, k in f) for f in found]
            return batch_of(names, [col_of(b, "doc_id"), *counts, pa.array(base, pa.string()), pa.array(every, pa.string())])

        return fn

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base_sha256 string, spans string"
    return arrow_map(docs.select("doc_id", "text"), make, schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii(spread(docs))
