"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger is a Parquet table of (blob, rule
version, spans) in a folder that all executors reach. A run scans only (blob, rule version) pairs that the ledger
lacks, each once however many paths have it, and appends what it found in one commit; findings are joined back to every
path. A pair counts once when the ledger is read, however often a repeated or a concurrent run appended it. The query
takes the sources in two loads, as versions arrive over time: the second scans only blobs that the first had not.

The base kinds (assign, access, hex) are the leftmost non-overlapping matches of their definitions, failing ones
dropped; ``private_key`` and ``service_token`` are added by the rules and take nothing from the base. Offsets count
code points, ends are exclusive. A private key runs from its BEGIN line to the END line of the same label before the
next BEGIN; without one, to the end of the base64 lines (after headers such as Proc-Type) that follow.

Copies are dropped within a task before the exchange by blob, so a text that a third of the rows share reaches the
scanning task once per upstream task. Null texts count as empty; paths may be null, repeated or tied: each row gets
its blob's findings. Extra columns are dropped; ``masked`` keeps all, of any name.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, batch_of, null_safe, scratch, table, texts_of

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "service_token")
#: Name of the rules below; a change of any rule takes a new name, and so a new scan of every blob.
RULES = "rules-3"

_KEYS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_PRIVATE = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
#: A line break, written out in string literals too; headers, on the line of the body too where that follows; and lines of base64 only, or runs as long as a line.
_BREAK = r"(?:[^\S\n]|\\[rt])*+(?:\n|\\n)(?:\s|\\[nrt]|[>\"'+,])*+"
_KEY_BODY = re.compile(
    rf"(?:{_BREAK}[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*+"
    r"(?:(?:[^\S\n]++[A-Za-z][A-Za-z0-9-]*+:[^\S\n]*+[^\s\\]++)++(?=[^\S\n]++[A-Za-z0-9+/]{40}))?+"
    rf"(?:(?:{_BREAK}|[^\S\n]++)[A-Za-z0-9+/]{{40,}}+={{0,2}}|{_BREAK}[A-Za-z0-9+/]++={{0,2}}(?=[^\S\n]*+(?:\n|\\[nr]|[\"']|\Z))|[^\S\n]++(?=[A-Za-z0-9+/]*[0-9+/=])[A-Za-z0-9+/]++={{0,2}}(?!\S))*+"
)
_SERVICE = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")


def _private(text: str) -> list[tuple[int, int]]:
    """Spans of private keys, from BEGIN to END or to the end of the base64 block."""
    out, begins = [], list(_PRIVATE.finditer(text))
    for m, following in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        last = f"-----END {m[1]}-----"
        at = text.find(last, m.end(), following)
        out.append((m.start(), at + len(last) if at >= 0 else _KEY_BODY.match(text, m.end(), following).end()))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by the order of ``KINDS``."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(*s, 3) for s in _private(text)]
    if "gh" in text or "xox" in text or "sk_live_" in text:
        out += [(*m.span(), 4) for m in _SERVICE.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _first_of_each(batches):
    """Rows whose blob was not seen before in this task."""
    seen: set[str] = set()
    for b in batches:
        for at in range(0, b.num_rows, 4 * SLICE):
            part = b.slice(at, 4 * SLICE)
            keep = []
            for x in part.column(0).to_pylist():
                keep.append(x not in seen)
                seen.add(x)
            if any(keep):
                yield part.filter(pa.array(keep))


def _scan(blobs: DataFrame, rules: str) -> DataFrame:
    """(blob, rules, spans) of each blob; spans are structs of kind, start and end."""
    names = ["blob", "rules", "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        seen: set[str] = set()

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, spans = [], []
            for blob, text in zip(b.column(0).to_pylist(), texts_of(b)):
                if blob not in seen:
                    seen.add(blob)
                    ids.append(blob)
                    spans.append([{"kind": k, "start": s, "end": e} for s, e, k in find(text)])
            return batch_of(names, [pa.array(ids, pa.string()), pa.array([rules] * len(ids), pa.string()), pa.array(spans, kind)])

        return fn

    return arrow_map(blobs, make, "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>")


def _blob(text: str):
    return F.sha2(null_safe(text).cast("binary"), 256)


def update(versions: DataFrame, ledger: str, rules: str = RULES, text: str = "text") -> None:
    """Scans the blobs of ``versions`` that ``ledger`` lacks under ``rules`` and appends their findings. ``ledger`` is a
    folder; the first run makes it."""
    named = versions.select(_blob(text).alias("blob"), null_safe(text).alias("text"))
    blobs = named.mapInArrow(_first_of_each, "blob string, text string")
    known = _ledger(versions.sparkSession, ledger, rules)
    if known is None:
        blobs = blobs.repartition("blob")
    else:  # the join deals by blob
        blobs = blobs.join(known.select("blob").hint("merge"), "blob", "left_anti")
    _scan(blobs, rules).write.mode("append").parquet(ledger)


def found(versions: DataFrame, ledger: str, rules: str = RULES, text: str = "text") -> DataFrame:
    """Every version as a struct ``row``, with its blob and the ledger's spans."""
    known = _ledger(versions.sparkSession, ledger, rules)
    return versions.select(F.struct("*").alias("row"), _blob(text).alias("blob")).join(known, "blob", "left")


def scan(versions: DataFrame, ledger: str, rules: str = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Brings the ledger up to date and gives the ``keep`` columns, blob and spans of every version."""
    update(versions, ledger, rules, text)
    paths = versions.select(*dict.fromkeys([*keep, text]))
    return found(paths, ledger, rules, text).select(*(F.col("row")[c].alias(c) for c in keep), "blob", "spans")


def masked(docs: DataFrame, ledger: str) -> DataFrame:
    """The rows of ``docs``, all columns, with their secrets masked; n_chars follows the text where there is such a column."""

    def redact(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else mask(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(text, spans)])

    update(docs, ledger)
    hit, old = F.size("spans") > 0, F.col("row.text")
    text = F.when(hit, F.pandas_udf(redact, "string")(F.coalesce(old, F.lit("")), "spans")).otherwise(old)
    rows = found(docs, ledger).select("row", "spans", text.alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.when(hit, F.length("masked").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def _ledger(spark: SparkSession, path: str, rules: str) -> DataFrame | None:
    """(blob, spans) of a rule version, each blob once; None without a ledger."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).where(F.col("rules") == rules).groupBy("blob").agg(F.any_value("spans").alias("spans"))


def joined(spans: str, kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, joined by commas."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    base = KINDS[:3]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined("spans", base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), f"{scratch(spark)}/ledger"
    early = F.crc32(null_safe("source").cast("binary")) % 2 == 0
    for load in (docs.where(early), docs.where(~early)):
        update(load.select("doc_id", "text"), ledger)
    rows = found(docs.select("doc_id", "text"), ledger)
    return digest(rows.select(F.col("row.doc_id").alias("doc_id"), "spans"))
